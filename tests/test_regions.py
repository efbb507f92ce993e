import random

import pytest
from pyspark.sql import functions as F

from pagecorpus.functions import geometry as g
from pagecorpus.operators import regions
from pagecorpus.operators.components import component_roots
from pagecorpus.sources.scan import image_sampler


def flood(cells, seeds):
    reached, queue = set(seeds), list(seeds)
    while queue:
        r, c = queue.pop()
        for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if n in cells and n not in reached:
                reached.add(n)
                queue.append(n)
    rows, cols = [r for r, _ in reached], [c for _, c in reached]
    return (min(rows), max(rows), min(cols), max(cols), len(reached)) if reached else None


def serpentine(side):
    cells = {(r, c) for r in range(0, side, 2) for c in range(side)}
    for k, r in enumerate(range(1, side - 1, 2)):
        cells.add((r, side - 1 if k % 2 == 0 else 0))
    return cells


@pytest.mark.parametrize("tile", [2, 5, 32])
def test_flood_equals_brute_force(spark, tile):
    rng = random.Random(tile)
    grids = {}
    for page in range(25):
        h, w, share = rng.randint(1, 20), rng.randint(1, 20), rng.choice([0.3, 0.6, 0.75, 1.0])
        grids[page] = {(r, c) for r in range(h) for c in range(w) if rng.random() < share}
    grids[25] = serpentine(15)
    rect = (3, 6, 2, 7)
    seed = lambda r, c: rect[0] <= r <= rect[1] and rect[2] <= c <= rect[3]
    rows = [(p, r, c, seed(r, c)) for p, cells in grids.items() for r, c in cells]
    points = spark.createDataFrame(rows, "page_key int, row int, col int, seed boolean")
    got = {
        r.page_key: (r.min_row, r.max_row, r.min_col, r.max_col, r.n_cells)
        for r in regions.flood_boxes(points, ["page_key"], tile).collect()
    }
    expected = {p: flood(cells, {x for x in cells if seed(*x)}) for p, cells in grids.items()}
    assert got == {p: b for p, b in expected.items() if b}


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(k, rng.randrange(60), rng.randrange(60)) for k in range(3) for _ in range(45)]
    edges += [(9, 0, i) for i in range(1, 200)] + [(8, i, i + 1) for i in range(100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for k, u, v in edges:
        a, b = find((k, u)), find((k, v))
        if u != v and a != b:
            parent[max(a, b)] = min(a, b)
    touched = {(k, x) for k, u, v in edges if u != v for x in (u, v)}
    df = spark.createDataFrame(edges, "g int, u bigint, v bigint")
    got = {(r.g, r.node): r.root for r in component_roots(df, ["g"]).collect()}
    assert got == {x: find(x)[1] for x in touched}


def page_of_light(spark):
    """White rounded box on a tinted page, 640 x 360, as BGR bytes and as a raster."""
    tint, light = bytes([150, 120, 100]), bytes([242, 242, 242])
    rows = []
    for y in range(360):
        for x in range(640):
            rows.append(light if 110 <= x < 530 and 120 <= y < 240 else tint)
    data = bytearray(b"".join(rows))
    images = spark.createDataFrame([(1, 640, 360, 3, data)], "page_key int, width int, height int, channels int, data binary")
    block = (1, 0, 640.0, 360.0, 640, 360, g.HORIZONTAL, (200.0, 150.0, 240.0, 60.0))
    windows = spark.createDataFrame(
        [block],
        "page_key int, pos int, img_w double, img_h double, raster_w int, raster_h int, flow string, rect struct<x: double, y: double, width: double, height: double>",
    )
    return images, regions.search_windows(windows)


def brute_region(windows_row):
    w = windows_row
    s, r, step = w.search, w.rect, w.step
    cols, rows = max(1, -(-s.width // step)), max(1, -(-s.height // step))
    point = lambda i, j: (s.x + (j + 0.5) * step, s.y + (i + 0.5) * step)
    light = lambda x, y: 110 <= int(x) < 530 and 120 <= int(360 - y) < 240
    cells = {(i, j) for i in range(int(rows)) for j in range(int(cols)) if light(*point(i, j))}
    inside = lambda x, y: r.x - step <= x < r.x + r.width + step and r.y - step <= y < r.y + r.height + step
    box = flood(cells, {x for x in cells if inside(*point(*x))})
    return s.x + box[2] * step, s.y + box[0] * step, (box[3] - box[2] + 1) * step, (box[1] - box[0] + 1) * step


def test_light_region_from_image_bytes(spark):
    images, windows = page_of_light(spark)
    found = regions.light_regions(windows, image_sampler(images), ["page_key", "pos"]).first().region
    assert (found.x, found.y, found.width, found.height) == brute_region(windows.first())


def test_coverage_limits(spark):
    rects = spark.createDataFrame(
        [(1, 0, (0.0, 0.0, 3.0, 50.0)), (1, 1, (0.0, 0.0, 40.0, 80.0)), (1, 2, (-50.0, 0.0, 70.0, 80.0))],
        "page_key int, pos int, rect struct<x: double, y: double, width: double, height: double>",
    ).select("*", *[F.lit(80.0).alias(n) for n in ("img_w", "img_h")], *[F.lit(10).alias(n) for n in ("raster_w", "raster_h")])
    cells = spark.range(100).select(
        F.lit(1).alias("page_key"), F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col")
    ).withColumn("light", F.col("col") < 3)
    got = {r.pos: r.coverage for r in regions.light_coverage(rects, regions.raster_sampler(cells), ["page_key", "pos"]).collect()}
    assert got == {0: 0.0, 1: 0.6, 2: 1.0}


def test_cells_in_wide_rectangles(spark):
    cells = spark.range(3000).select(
        F.lit(1).alias("page_key"), (F.col("id") % 3).cast("int").alias("row"), F.floor(F.col("id") / 3).cast("int").alias("col")
    )
    rects = spark.createDataFrame([(1, 7, 0, 1, 100, 899), (1, 8, 2, 2, 5, 4)], "page_key int, pos int, row0 int, row1 int, col0 int, col1 int")
    assert regions.cells_in_rects(rects, cells).count() == 2 * 800
