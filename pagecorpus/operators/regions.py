"""Light regions and light coverage over sampled page rasters.

A raster is a table of cells ``(page_key, row, col, light)``, row 0 at the top, with the
raster size known per page; rectangles live in image coordinates (bottom-left origin).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.functions import geometry as g
from pagecorpus.operators.components import component_roots
from pagecorpus.session import freeze

# (rectangles, rectangle column, step column) -> grid points with a ``light`` flag.
Sampler = Callable[[DataFrame, str, str], DataFrame]

# The scores, shares and limits in the functions below.

# Side of a tile in cells; components are found inside tiles, then stitched together.
TILE = 32
# Columns per bucket of the rectangle-cell join.
COL_BUCKET = 256


def grid_points(rects: DataFrame, rect: str, step: str) -> DataFrame:
    """Sampling points ``(row, col, px, py)`` on a regular grid over each rectangle.

    The number of points follows from image size and step, both bounded by the image.
    """
    r, s = F.col(rect), F.col(step)
    rows, cols = g.grid_extent(r, s)
    by_row = rects.withColumn("row", F.explode(F.sequence(F.lit(0), rows - 1)))
    points = by_row.withColumn("col", F.explode(F.sequence(F.lit(0), cols - 1)))
    return points.withColumn("px", g.sample_x(r, s, F.col("col"))).withColumn("py", g.sample_y(r, s, F.col("row")))


def sample_raster(points: DataFrame, cells: DataFrame, page: str = "page_key") -> DataFrame:
    """Add ``light`` to points carrying img_w, img_h, raster_w, raster_h.

    An equi join on page, raster row and raster column; a point without a cell is dark.
    """
    placed = points.withColumn(
        "_pc", g.pixel_index(F.col("px"), F.col("img_w"), F.col("raster_w"))
    ).withColumn("_pr", g.pixel_index(F.col("img_h") - F.col("py"), F.col("img_h"), F.col("raster_h")))
    looked_up = cells.select(page, F.col("row").alias("_pr"), F.col("col").alias("_pc"), "light")
    joined = placed.join(looked_up, [page, "_pr", "_pc"], "left")
    return joined.withColumn("light", F.coalesce("light", F.lit(False))).drop("_pr", "_pc")


def raster_sampler(cells: DataFrame, page: str = "page_key") -> Sampler:
    """Sample a cell table; rectangles carry img_w, img_h, raster_w, raster_h."""
    return lambda rects, rect, step: sample_raster(grid_points(rects, rect, step), cells, page)


def light_coverage(rects: DataFrame, sampler: Sampler, keys: Sequence[str], rect: str = "rect") -> DataFrame:
    """Share of light sampling points per rectangle; 0 below four pixels in a direction.

    ``rects`` carry the keys (page_key among them), img_w, img_h and what the sampler needs.
    """
    img_w, img_h = F.col("img_w"), F.col("img_h")
    cut = rects.withColumn("_cut", g.clamp_rect(F.col(rect), img_w, img_h))
    large = (F.col("_cut")["width"] >= 4) & (F.col("_cut")["height"] >= 4)
    sampled = sampler(cut.where(large).withColumn("_step", g.coverage_step(img_w, img_h)), "_cut", "_step")
    shares = sampled.groupBy(*keys).agg(
        (F.count_if("light").cast("double") / F.count(F.lit(1)).cast("double")).alias("coverage")
    )
    return rects.select(*keys).join(shares, list(keys), "left").select(
        *keys, F.coalesce("coverage", F.lit(0.0)).alias("coverage")
    )


def cells_in_rects(rects: DataFrame, cells: DataFrame, page: str = "page_key") -> DataFrame:
    """Cells inside ``(row0..row1, col0..col1)``, limits included.

    The covered rows and column buckets of a rectangle are spelled out, so the join is on
    equality and a page with very many cells spreads over its rows and buckets.
    """
    first, last = F.floor(F.col("col0") / COL_BUCKET), F.floor(F.col("col1") / COL_BUCKET)
    spread = rects.where((F.col("row0") <= F.col("row1")) & (F.col("col0") <= F.col("col1")))
    spread = spread.withColumn("row", F.explode(F.sequence("row0", "row1"))).withColumn(
        "_bucket", F.explode(F.sequence(first, last))
    )
    bucketed = cells.withColumn("_bucket", F.floor(F.col("col") / COL_BUCKET))
    joined = spread.join(bucketed, [page, "row", "_bucket"])
    return joined.where(F.col("col").between(F.col("col0"), F.col("col1"))).drop("_bucket")


def best_column_x(
    bases: DataFrame, sampler: Sampler, keys: Sequence[str], base: str = "base", width: str = "column_width", steps: int = 14
) -> DataFrame:
    """``(keys, column_x)``: the lightest of ``steps + 1`` column positions, null when none will do.

    Score: coverage less 0.08 times the relative distance from the middle; the first best
    position wins and needs 0.42.
    """
    b, w = F.col(base), F.col(width)
    wide = bases.where(b["width"] > w + F.lit(1.0))
    tried = wide.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn(
        "x", b["x"] + (b["width"] - w) * (F.col("step").cast("double") / F.lit(float(steps)))
    )
    tried = tried.withColumn("rect", g.rect(F.col("x"), b["y"], w, b["height"]))
    covered = light_coverage(tried, sampler, [*keys, "step"])
    off_middle = F.abs((F.col("x") + w / F.lit(2.0)) - (b["x"] + b["width"] / F.lit(2.0)))
    penalty = off_middle / F.greatest(F.lit(1.0), b["width"]) * F.lit(0.08)
    scored = (
        tried.select(*keys, "step", "x", penalty.alias("penalty"))
        .join(covered, [*keys, "step"])
        .withColumn("score", F.col("coverage") - F.col("penalty"))
    )
    best = scored.groupBy(*keys).agg(
        F.max("score").alias("score"), F.max_by("x", F.struct(F.col("score"), -F.col("step"))).alias("x")
    )
    return bases.select(*keys).join(best, list(keys), "left").select(
        *keys, F.when(F.col("score") >= 0.42, F.col("x")).alias("column_x")
    )


def search_windows(blocks: DataFrame, rect: str = "rect") -> DataFrame:
    """Blocks with ``search`` and ``step``; windows under eight pixels have no region."""
    img_w, img_h = F.col("img_w"), F.col("img_h")
    search = g.light_search_rect(F.col(rect), F.col("flow"), img_w, img_h)
    windows = blocks.withColumn("search", search).withColumn("step", g.region_step(img_w, img_h))
    return windows.where((F.col("search")["width"] >= 8) & (F.col("search")["height"] >= 8))


def light_regions(
    windows: DataFrame, sampler: Sampler, keys: Sequence[str] = ("page_key", "pos"), rect: str = "rect", tile: int = TILE
) -> DataFrame:
    """``(keys, region)``: the light area connected to each text rectangle.

    ``windows`` come from :func:`search_windows`. All light points of a window connected
    (by edges) to a light point in or next to the text rectangle count. Blocks without an
    acceptable region have no row.
    """
    r, s, search = F.col(rect), F.col("step"), F.col("search")
    near = g.inset(r, -s, -s)
    points = sampler(windows, "search", "step").where("light").select(
        *keys, "row", "col", g.contains_point(near, F.col("px"), F.col("py")).alias("seed")
    )
    boxes = flood_boxes(points, keys, tile)
    joined = windows.join(boxes, list(keys))
    low, high = F.col("min_row").cast("double"), F.col("max_row").cast("double")
    left, right = F.col("min_col").cast("double"), F.col("max_col").cast("double")
    one = F.lit(1.0)
    found = g.rect(
        search["x"] + left * s, search["y"] + low * s, (right - left + one) * s, (high - low + one) * s
    )
    staged = joined.withColumn("_found", found)
    f = F.col("_found")
    large = (f["width"] >= r["width"] * F.lit(0.60)) & (f["height"] >= r["height"] * F.lit(0.60))
    share = (f["width"] * f["height"]) / F.greatest(one, search["width"] * search["height"])
    sprawling = (share > 0.88) & ((f["width"] > r["width"] * F.lit(2.8)) | (f["height"] > r["height"] * F.lit(2.8)))
    accepted = staged.where((F.col("n_cells") >= 4) & large & ~sprawling)
    return accepted.select(*keys, g.clamp_rect(f, F.col("img_w"), F.col("img_h")).alias("region"))


def flood_boxes(points: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Bounding box and cell count of all cells connected to a seed, per grid.

    ``points(keys, row, col, seed)`` are the light cells; the seeds of a grid are the light
    cells of one rectangle.
    """
    parts = components(points, keys, tile)
    return (
        parts.where("seed")
        .groupBy(*keys)
        .agg(
            F.min("min_row").alias("min_row"),
            F.max("max_row").alias("max_row"),
            F.min("min_col").alias("min_col"),
            F.max("max_col").alias("max_col"),
            F.sum("n_cells").alias("n_cells"),
        )
    )


def components(points: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Edge-connected components of light cells: ``(keys, root, box, n_cells, seed)``.

    Components are first found inside tiles of bounded size, in one fold over their row
    runs. Components that touch across tile borders are then joined by star contraction,
    which a grid that fits one tile does not need.
    """
    keys = list(keys)
    runs = freeze(_tile_runs(points, keys, tile))
    parts = runs.groupBy(*keys, "node").agg(*_box_measures(runs=True))
    edges = freeze(_border_edges(runs, keys, tile))
    if edges.isEmpty():
        return parts.withColumnRenamed("node", "root")
    roots = component_roots(edges, keys)
    rooted = parts.join(roots, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.groupBy(*keys, "root").agg(*_box_measures(runs=False))


def _box_measures(runs: bool) -> list[Column]:
    row_low, row_high = ("row", "row") if runs else ("min_row", "max_row")
    col_low, col_high = ("c0", "c1") if runs else ("min_col", "max_col")
    n = F.col("c1") - F.col("c0") + 1 if runs else F.col("n_cells")
    return [
        F.min(row_low).alias("min_row"),
        F.max(row_high).alias("max_row"),
        F.min(col_low).alias("min_col"),
        F.max(col_high).alias("max_col"),
        F.sum(n).cast("bigint").alias("n_cells"),
        F.bool_or("seed").alias("seed"),
    ]


def _tile_runs(points: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Row runs ``(keys, row, c0, c1, node, seed)``; ``node`` names the run's tile component.

    A tile has at most ``tile * tile`` cells, whatever the size of its grid.
    """
    t = F.lit(tile)
    seed = F.col("seed")
    placed = points.withColumn("_tr", F.floor(F.col("row") / t).cast("int")).withColumn(
        "_tc", F.floor(F.col("col") / t).cast("int")
    )
    inside = ((F.col("row") - F.col("_tr") * t) * t + (F.col("col") - F.col("_tc") * t)).cast("int")
    grouped = placed.groupBy(*keys, "_tr", "_tc").agg(
        F.array_sort(F.collect_list(inside)).alias("_cells"),
        F.min(F.when(seed, F.col("row"))).alias("_sr0"),
        F.max(F.when(seed, F.col("row"))).alias("_sr1"),
        F.min(F.when(seed, F.col("col"))).alias("_sc0"),
        F.max(F.when(seed, F.col("col"))).alias("_sc1"),
    )
    cells = F.col("_cells")
    after = F.transform(F.filter(cells, lambda c: c % t != t - 1), lambda c: c + 1)
    before = F.transform(F.filter(cells, lambda c: c % t != 0), lambda c: c - 1)
    starts, ends = F.array_except(cells, after), F.array_except(cells, before)
    zipped = F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(F.floor(a / t).cast("int").alias("r"), (a % t).alias("a"), (b % t).alias("b")),
    )
    with_runs = grouped.withColumn("_runs", zipped).drop("_cells")
    labelled = with_runs.withColumn("_labels", _run_labels(F.col("_runs"), tile))
    tagged = F.zip_with(
        "_runs", "_labels", lambda run, label: F.struct(run["r"].alias("r"), run["a"].alias("a"), run["b"].alias("b"), label.alias("label"))
    )
    rows = labelled.select(*keys, "_tr", "_tc", "_sr0", "_sr1", "_sc0", "_sc1", "_runs", F.explode(tagged).alias("_x"))
    # The first run of a component names it by the grid position of its first cell.
    first = F.element_at("_runs", F.col("_x.label"))
    row, c0, c1 = F.col("_tr") * t + F.col("_x.r"), F.col("_tc") * t + F.col("_x.a"), F.col("_tc") * t + F.col("_x.b")
    node_row = (F.col("_tr") * t + first["r"]).cast("bigint")
    node_col = (F.col("_tc") * t + first["a"]).cast("bigint")
    touches = row.between(F.col("_sr0"), F.col("_sr1")) & (c0 <= F.col("_sc1")) & (c1 >= F.col("_sc0"))
    return rows.select(
        *keys,
        row.alias("row"),
        c0.alias("c0"),
        c1.alias("c1"),
        (F.shiftleft(node_row, 31) + node_col).alias("node"),
        F.coalesce(touches, F.lit(False)).alias("seed"),
    )


def _run_labels(runs: Column, tile: int = TILE) -> Column:
    """Component of each run: the 1-based index of the component's first run.

    One pass in row order: a run takes the smallest label among the runs it touches in
    the row above, and the other labels it touches are renamed to that one. A row of a
    tile has half as many runs as columns at most, so those of its own row and the row
    above are among the last ``tile`` + 1 runs.
    """

    def step(labels: Column, run: Column) -> Column:
        recent = F.least(F.size(labels), F.lit(tile + 1))
        first = F.size(labels) - recent + 1
        earlier = F.zip_with(
            F.slice(runs, first, recent),
            F.slice(labels, first, recent),
            lambda o, label: F.when(
                (o["r"] == run["r"] - 1) & (o["a"] <= run["b"]) & (o["b"] >= run["a"]), label
            ),
        )
        met = F.array_compact(earlier)
        own = F.size(labels) + 1

        def merge(pair: Column) -> Column:
            renamed = F.transform(
                labels, lambda label: F.when(F.array_contains(pair["met"], label), pair["new"]).otherwise(label)
            )
            return F.array_append(F.when(F.size(pair["met"]) > 1, renamed).otherwise(labels), pair["new"])

        def choose(m: Column) -> Column:
            return F.struct(m.alias("met"), F.coalesce(F.array_min(m), own).alias("new"))

        once = F.transform(F.transform(F.array(met), choose), merge)
        return F.element_at(once, 1)

    return F.aggregate(runs, F.array().cast("array<int>"), step)


def _border_edges(runs: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Pairs of tile components that touch across a tile border."""
    t = F.lit(tile)
    right = runs.where(F.col("c1") % t == t - 1).select(
        *keys, "row", (F.col("c1") + 1).alias("c0"), F.col("node").alias("u")
    )
    left = runs.where(F.col("c0") % t == 0).select(*keys, "row", "c0", F.col("node").alias("v"))
    across = right.join(left, [*keys, "row", "c0"]).select(*keys, "u", "v")
    upper = runs.where(F.col("row") % t == t - 1).select(
        *keys,
        (F.col("row") + 1).alias("row"),
        F.floor(F.col("c0") / t).alias("_tc"),
        F.col("c0").alias("a0"),
        F.col("c1").alias("a1"),
        F.col("node").alias("u"),
    )
    lower = runs.where(F.col("row") % t == 0).select(
        *keys, "row", F.floor(F.col("c0") / t).alias("_tc"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("node").alias("v")
    )
    down = (
        upper.join(lower, [*keys, "row", "_tc"])
        .where((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
        .select(*keys, "u", "v")
    )
    return across.unionByName(down).distinct()
