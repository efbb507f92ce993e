"""Queries on boxes, text fitting, light regions and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.functions import geometry as g
from pagecorpus.functions.text import renderable
from pagecorpus.operators import blocks as b
from pagecorpus.operators import layout, regions
from pagecorpus.plans.block_layout import lay_out
from pagecorpus.plans.catalogue import query
from pagecorpus.plans.queries_text import sql_compact, sql_renderable
from pagecorpus.plans.views import BOXES, CONV_BLOCKS, GEOMETRY, GRID_CELLS, Views
from pagecorpus.sources.scan import image_sampler

def _size() -> tuple[Column, Column]:
    return F.col("img_w"), F.col("img_h")


def _flat(name: str, prefix: str) -> list[Column]:
    return [F.col(f"{name}.{f}").alias(prefix + s) for f, s in zip(("x", "y", "width", "height"), "xywh", strict=True)]


def _sql_flat(x: str, y: str, w: str, h: str, prefix: str) -> str:
    return f"{x} AS {prefix}x, {y} AS {prefix}y, {w} AS {prefix}w, {h} AS {prefix}h"


def _rects(v: Views) -> DataFrame:
    boxed = b.normalise_boxes(v.boxes)
    return boxed.withColumn("rect", g.pixel_rect(F.col("box"), *_size())).withColumn(
        "flow", g.text_flow(F.col("rect"), F.col("n_chars"))
    )


def _containers(v: Views) -> DataFrame:
    covered = _rects(v).withColumn("fallback", g.redaction_rect(F.col("rect"), F.col("flow"), F.col("n_chars"), *_size()))
    return covered.withColumn("whole", g.integral_rect(F.col("fallback"))).withColumn(
        "text_rect", g.text_inset(F.col("whole"), F.col("flow"))
    )


@query(f"WITH {BOXES} SELECT page_key, pos, {_sql_flat('bx', 'bt', 'bw', 'bh', 'b')} FROM norm")
def normalised_boxes(v: Views) -> DataFrame:
    return b.normalise_boxes(v.boxes).select("page_key", "pos", *_flat("box", "b"))


@query(f"WITH {BOXES} SELECT page_key, pos, {_sql_flat('bx', '1.0::DOUBLE - (bt + bh)', 'bw', 'bh', 'b')} FROM norm")
def flipped_boxes(v: Views) -> DataFrame:
    flipped = b.normalise_boxes(v.boxes).withColumn("box", g.flip_box(F.col("box")))
    return flipped.select("page_key", "pos", *_flat("box", "b"))


@query(f"WITH {BOXES} SELECT page_key, pos, {_sql_flat('rx', 'ry', 'rw', 'rh', 'r')} FROM rects")
def pixel_rects(v: Views) -> DataFrame:
    return _rects(v).select("page_key", "pos", *_flat("rect", "r"))


@query(f"WITH {BOXES} SELECT page_key, pos, flow FROM flows")
def text_flows(v: Views) -> DataFrame:
    return _rects(v).select("page_key", "pos", "flow")


@query(f"WITH {BOXES} SELECT page_key, pos, {_sql_flat('fx', 'fy', 'fw', 'fh', 'f')} FROM fallbacks")
def redaction_rects(v: Views) -> DataFrame:
    return _containers(v).select("page_key", "pos", *_flat("fallback", "f"))


@query(
    f"""WITH {BOXES}, raw AS (
 SELECT page_key, pos, x1, y1, x2-x1 AS w, y2-y1 AS h, img_w, img_h FROM boxes),
clamped AS (
 SELECT *, greatest(0.0::DOUBLE, x1) AS cx, greatest(0.0::DOUBLE, y1) AS cy,
  greatest(1.0::DOUBLE, least(img_w, x1+w) - greatest(0.0::DOUBLE, x1)) AS cw,
  greatest(1.0::DOUBLE, least(img_h, y1+h) - greatest(0.0::DOUBLE, y1)) AS ch FROM raw),
joined AS (
 SELECT *, least(cx, 400.0::DOUBLE) AS ux, least(cy, 600.0::DOUBLE) AS uy,
  greatest(cx+cw, 450.5::DOUBLE) - least(cx, 400.0::DOUBLE) AS uw, greatest(cy+ch, 620.25::DOUBLE) - least(cy, 600.0::DOUBLE) AS uh FROM clamped)
SELECT page_key, pos, {_sql_flat('cx', 'cy', 'cw', 'ch', 'c')}, {_sql_flat('ux', 'uy', 'uw', 'uh', 'u')},
 {_sql_flat('floor(ux)', 'floor(uy)', 'ceil(ux+uw) - floor(ux)', 'ceil(uy+uh) - floor(uy)', 'i')} FROM joined"""
)
def rect_algebra(v: Views) -> DataFrame:
    """Clamp to the image, unite with a fixed rectangle, grow to whole pixels."""
    raw = g.rect(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    fixed = g.rect(F.lit(400.0), F.lit(600.0), F.lit(50.5), F.lit(20.25))
    staged = v.boxes.withColumn("clamped", g.clamp_rect(raw, *_size()))
    staged = staged.withColumn("united", g.union_rect(F.col("clamped"), fixed))
    staged = staged.withColumn("whole", g.integral_rect(F.col("united")))
    return staged.select("page_key", "pos", *_flat("clamped", "c"), *_flat("united", "u"), *_flat("whole", "i"))


@query(f"WITH {BOXES} SELECT page_key, pos, {_sql_flat('tx', 'ty', 'tw', 'th', 't')} FROM texts")
def text_insets(v: Views) -> DataFrame:
    return _containers(v).select("page_key", "pos", *_flat("text_rect", "t"))


@query(
    f"""WITH {BOXES}, limits AS (
 SELECT row_number() OVER () AS rid, page_key, pos, n, greatest(1.0::DOUBLE, tw-4) AS w, greatest(1.0::DOUBLE, th-4) AS h,
  least(greatest(least(tw*0.52::DOUBLE, th*0.16::DOUBLE), coalesce(detected*0.78::DOUBLE, least(tw*0.52::DOUBLE, th*0.16::DOUBLE)), 16.0::DOUBLE), 96.0::DOUBLE) AS high,
  greatest(8.0::DOUBLE, least(greatest(greatest(13.0::DOUBLE, least(tw, th)*0.12::DOUBLE), 11.0::DOUBLE), 28.0::DOUBLE)) AS low FROM texts),
tried AS (
 SELECT *, high - i AS size FROM (SELECT *, unnest(range(0, 120)) AS i FROM limits) WHERE high - i >= low),
fits AS (
 SELECT rid, max(size) AS size FROM tried
 WHERE n > 0 AND ceil(n / greatest(1, floor(h / ceil(size*1.08::DOUBLE)))) * ceil(size*1.18::DOUBLE) <= w GROUP BY rid),
chosen AS (
 SELECT l.*, coalesce(f.size, greatest(7.0::DOUBLE, low*0.72::DOUBLE)) AS font_size, f.size IS NULL AS overflow
 FROM limits l LEFT JOIN fits f ON l.rid = f.rid)
SELECT page_key, pos, font_size, ceil(font_size*1.08::DOUBLE) AS line_height, ceil(font_size*1.18::DOUBLE) AS column_width,
 CAST(greatest(1, floor(h / ceil(font_size*1.08::DOUBLE))) AS INTEGER) AS max_rows,
 CAST(ceil(n / greatest(1, floor(h / ceil(font_size*1.08::DOUBLE)))) AS INTEGER) AS n_columns, overflow FROM chosen"""
)
def vertical_fit(v: Views) -> DataFrame:
    fitted = layout.fit_vertical(_containers(v))
    return fitted.select(
        "page_key", "pos", "font_size", "line_height", "column_width", "max_rows", "n_columns", "overflow"
    )


# Same advance for all characters, so that SQL can split long words by arithmetic.
EVEN = layout.AdvanceWidths(wide=600, narrow=600, other=600, space=300)


def _captions(v: Views) -> DataFrame:
    """Conversation turns in boxes whose size follows from their keys."""
    width, height = 150.0 + F.col("page_key") % 7 * 90.0, 120.0 + F.col("pos") * 110.0
    return v.conv_blocks.select(
        "page_key",
        "pos",
        renderable("original_text").alias("render_text"),
        g.rect(F.lit(0.0), F.lit(0.0), width, height).alias("text_rect"),
        F.when(F.col("pos") % 2 == 1, 10.0 + F.col("page_key") % 30).alias("detected_font_size"),
    )


def _wrap_sql(jobs: str) -> str:
    """Greedy wrapping of ``jobs(jid, words, lim)`` where every character counts 600 and a space 300.

    ``lim`` is in thousandths of an em; result ``wrapped(jid, n_lines)``.
    """
    return f"""steps AS (
 SELECT jid, words, lim, greatest(1, CAST(floor(lim / 600) AS BIGINT)) AS per_line, CAST(0 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS cur FROM {jobs}
 UNION ALL
 SELECT jid, words, lim, per_line, idx + 1,
  CASE WHEN joined <= lim THEN n
       WHEN word <= lim THEN n + (cur > 0)::BIGINT
       ELSE n + (cur > 0)::BIGINT + CAST(ceil(chars / per_line::DOUBLE) AS BIGINT) - 1 END,
  CASE WHEN joined <= lim THEN joined WHEN word <= lim THEN word
       ELSE (chars - (CAST(ceil(chars / per_line::DOUBLE) AS BIGINT) - 1) * per_line) * 600 END
 FROM (SELECT *, length(words[idx + 1]) AS chars, length(words[idx + 1]) * 600 AS word,
   CASE WHEN cur = 0 THEN 0 ELSE cur + 300 END + length(words[idx + 1]) * 600 AS joined FROM steps WHERE idx < len(words))),
wrapped AS (SELECT jid, n + (cur > 0)::BIGINT AS n_lines FROM steps WHERE idx = len(words))"""


def _fit_sql(captions: str) -> str:
    """Size search over ``captions(page_key, pos, words, tw, th, detected)``: ``judged`` and ``best``."""
    return f"""limits AS (
 SELECT *, tw-12 AS w, th-8 AS h,
  least(greatest(least(th*0.42::DOUBLE, tw*0.22::DOUBLE), coalesce(detected*0.92::DOUBLE, least(th*0.42::DOUBLE, tw*0.22::DOUBLE)), 16.0::DOUBLE), 112.0::DOUBLE) AS high,
  greatest(8.0::DOUBLE, least(greatest(greatest(13.0::DOUBLE, least(tw, th)*0.10::DOUBLE), 11.0::DOUBLE), 28.0::DOUBLE)) AS low FROM {captions}),
hards AS (SELECT *, greatest(7.0::DOUBLE, low*0.72::DOUBLE) AS hard FROM limits),
sizes AS (
 SELECT *, high - i AS size FROM (SELECT *, unnest(range(0, 130)) AS i FROM hards) WHERE high - i >= low
 UNION ALL SELECT *, low - 1 - i FROM (SELECT *, unnest(range(0, 30)) AS i FROM hards) WHERE low - 1 - i >= hard
 UNION ALL SELECT *, 1000 AS i, hard AS size FROM hards),
jobs AS (SELECT row_number() OVER () AS jid, *, w * 1000.0::DOUBLE / size AS lim FROM sizes),
{_wrap_sql('jobs')},
judged AS (
 SELECT j.*, n_lines, i < 1000 AND 600 <= lim AND n_lines * ceil(size*1.06::DOUBLE) <= h AS fits
 FROM jobs j JOIN wrapped x ON j.jid = x.jid),
best AS (SELECT page_key, pos, max(size) FILTER (WHERE fits) AS fit FROM judged GROUP BY page_key, pos)"""


@query(
    f"""WITH RECURSIVE {CONV_BLOCKS}, captions AS (
 SELECT page_key, pos, list_filter(string_split({sql_renderable('original_text')}, ' '), lambda x: x <> '') AS words,
  150.0::DOUBLE + page_key % 7 * 90 AS tw, 120.0::DOUBLE + pos * 110 AS th,
  CASE WHEN pos % 2 = 1 THEN (10 + page_key % 30)::DOUBLE END AS detected FROM conv_blocks),
{_fit_sql("captions")}
SELECT DISTINCT j.page_key, j.pos, size AS font_size, ceil(size*1.06::DOUBLE) AS line_height, CAST(n_lines AS INTEGER) AS n_lines, fit IS NULL AS overflow
FROM judged j JOIN best b ON j.page_key = b.page_key AND j.pos = b.pos
WHERE CASE WHEN fit IS NULL THEN i = 1000 ELSE i < 1000 AND size = fit END"""
)
def horizontal_fit(v: Views) -> DataFrame:
    fitted = layout.fit_horizontal(_captions(v), widths=EVEN)
    return fitted.select("page_key", "pos", "font_size", "line_height", "n_lines", "overflow")


@query(
    f"""WITH RECURSIVE {CONV_BLOCKS}, norm AS (
 SELECT page_key, pos, 1000.0::DOUBLE AS img_w, 1400.0::DOUBLE AS img_h, (page_key % 10) / 20.0::DOUBLE AS bx, pos / 16.0::DOUBLE AS bt,
  0.1::DOUBLE + (page_key % 7) / 16.0::DOUBLE AS bw, 0.05::DOUBLE + pos / 32.0::DOUBLE AS bh, length({sql_compact("original_text")})::DOUBLE AS n,
  false AS source_is_vertical, CASE WHEN pos % 2 = 1 THEN (10 + page_key % 30)::DOUBLE END AS detected, original_text FROM conv_blocks),
{GEOMETRY},
captions AS (SELECT *, list_filter(string_split({sql_renderable("original_text")}, ' '), lambda x: x <> '') AS words FROM texts WHERE flow = 'horizontal'),
{_fit_sql("captions")}
SELECT DISTINCT j.page_key, j.pos, flow, ix AS cx, iy AS cy, iw AS cw, ih AS ch, tx, ty, tw, th, size AS font_size,
 ceil(size*1.06::DOUBLE) AS line_height, CAST(n_lines AS INTEGER) AS n_lines, fit IS NULL AS overflow
FROM judged j JOIN best b ON j.page_key = b.page_key AND j.pos = b.pos
WHERE CASE WHEN fit IS NULL THEN i = 1000 ELSE i < 1000 AND size = fit END"""
)
def page_layout(v: Views) -> DataFrame:
    """The whole layout job on conversation turns; none of them is short enough to be vertical."""
    box = g.rect(
        (F.col("page_key") % 10) / F.lit(20.0),
        F.col("pos") / F.lit(16.0),
        F.lit(0.1) + (F.col("page_key") % 7) / F.lit(16.0),
        F.lit(0.05) + F.col("pos") / F.lit(32.0),
    )
    blocks = v.conv_blocks.select(
        "page_key",
        "pos",
        "original_text",
        F.lit("").alias("translated_text"),
        F.lit(1000.0).alias("img_w"),
        F.lit(1400.0).alias("img_h"),
        box.alias("box"),
        F.lit(None).cast("boolean").alias("source_is_vertical"),
        F.when(F.col("pos") % 2 == 1, 10.0 + F.col("page_key") % 30).alias("detected_font_size"),
    )
    placed = lay_out(blocks, widths=EVEN)
    return placed.select(
        "page_key",
        "pos",
        "flow",
        *_flat("container", "c"),
        *_flat("text_rect", "t"),
        "font_size",
        "line_height",
        F.size("lines").alias("n_lines"),
        "overflow",
    )


@query(
    f"""WITH RECURSIVE {CONV_BLOCKS}, jobs AS (
 SELECT page_key, pos, CAST(8 + pos AS BIGINT) AS k,
  list_filter(string_split({sql_renderable('original_text')}, ' '), lambda x: x <> '') AS words FROM conv_blocks),
steps AS (
 SELECT page_key, pos, words, k, CAST(0 AS BIGINT) AS idx, CAST([] AS VARCHAR[]) AS done, '' AS cur FROM jobs
 UNION ALL
 SELECT page_key, pos, words, k, idx + 1,
  CASE WHEN length(joined) <= k THEN done
       WHEN length(word) <= k THEN list_concat(done, CASE WHEN cur = '' THEN [] ELSE [cur] END)
       ELSE list_concat(list_concat(done, CASE WHEN cur = '' THEN [] ELSE [cur] END),
        list_transform(range(0, CAST(ceil(length(word) / k::DOUBLE) AS BIGINT) - 1), lambda i: substr(word, i * k + 1, k))) END,
  CASE WHEN length(joined) <= k THEN joined WHEN length(word) <= k THEN word
       ELSE substr(word, (CAST(ceil(length(word) / k::DOUBLE) AS BIGINT) - 1) * k + 1) END
 FROM (SELECT *, words[idx + 1] AS word, CASE WHEN cur = '' THEN words[idx + 1] ELSE concat(cur, ' ', words[idx + 1]) END AS joined
  FROM steps WHERE idx < len(words)))
SELECT page_key, pos, array_to_string(list_concat(done, CASE WHEN cur = '' THEN [] ELSE [cur] END), '|') AS lines
FROM steps WHERE idx = len(words)"""
)
def wrapped_lines(v: Views) -> DataFrame:
    """Lines of eight and more characters; longer words are split."""
    words = layout.words(renderable("original_text"), layout.UNIT_WIDTHS)
    staged = v.conv_blocks.withColumn("words", words)
    lines = layout.wrapped_lines("words", F.col("pos") + 8, layout.UNIT_WIDTHS.space)
    return staged.select("page_key", "pos", F.array_join(lines, "|").alias("lines"))


@query(
    f"""WITH {BOXES}, found AS (
 SELECT *, CASE WHEN pos % 2 = 0 THEN rx - 30 END AS gx, ry - 20 AS gy, CASE WHEN pos % 4 = 0 THEN 5 ELSE 1.5 END::DOUBLE * rw AS gw, rh * 1.25::DOUBLE AS gh FROM fallbacks),
merged AS (
 SELECT *, least(gx, rx) AS mx, least(gy, ry) AS my, greatest(gx+gw, rx+rw) - least(gx, rx) AS mw, greatest(gy+gh, ry+rh) - least(gy, ry) AS mh FROM found),
contained AS (
 SELECT *, gx IS NOT NULL AND mw >= fw*0.72::DOUBLE AND mh >= fh*0.72::DOUBLE AS used,
  greatest(0.0::DOUBLE, mx) AS kx, greatest(0.0::DOUBLE, my) AS ky FROM merged),
placed AS (
 SELECT *, CASE WHEN used THEN kx ELSE fx END AS cx, CASE WHEN used THEN ky ELSE fy END AS cy,
  CASE WHEN used THEN greatest(1.0::DOUBLE, least(img_w, mx+mw) - kx) ELSE fw END AS cw,
  CASE WHEN used THEN greatest(1.0::DOUBLE, least(img_h, my+mh) - ky) ELSE fh END AS ch FROM contained),
bubbles AS (
 SELECT * EXCLUDE (cx, cy, cw, ch), floor(cx) AS cx, floor(cy) AS cy, ceil(cx+cw) - floor(cx) AS cw, ceil(cy+ch) - floor(cy) AS ch FROM placed),
sides AS (
 SELECT *, CASE WHEN flow = 'vertical' THEN greatest(4.0::DOUBLE, cw*0.10::DOUBLE) ELSE greatest(6.0::DOUBLE, cw*0.05::DOUBLE) END AS sx,
  CASE WHEN flow = 'vertical' THEN greatest(6.0::DOUBLE, ch*0.05::DOUBLE) ELSE greatest(5.0::DOUBLE, ch*0.07::DOUBLE) END AS sy FROM bubbles),
bases AS (
 SELECT *, cx+sx AS ax, cy+sy AS ay,
  CASE WHEN cw-2.0::DOUBLE*sx < 0 OR ch-2.0::DOUBLE*sy < 0 THEN 0.0::DOUBLE ELSE cw-2.0::DOUBLE*sx END AS aw,
  CASE WHEN cw-2.0::DOUBLE*sx < 0 OR ch-2.0::DOUBLE*sy < 0 THEN 0.0::DOUBLE ELSE ch-2.0::DOUBLE*sy END AS ah FROM sides),
columned AS (
 SELECT *, flow = 'horizontal' AND source_is_vertical AND ch >= cw*1.12::DOUBLE AS narrow,
  least(aw, greatest(96.0::DOUBLE, least(rw*0.70::DOUBLE, cw*0.44::DOUBLE))) AS nw FROM bases)
SELECT page_key, pos, {_sql_flat('cx', 'cy', 'cw', 'ch', 'c')},
 CASE WHEN narrow THEN greatest(ax, least(ax+aw-nw, cx + cw/2.0::DOUBLE - nw/2.0::DOUBLE)) ELSE ax END AS tx,
 ay AS ty, CASE WHEN narrow THEN nw ELSE aw END AS tw, ah AS th FROM columned"""
)
def text_containers(v: Views) -> DataFrame:
    """Containers and text areas where every other box has a light region."""
    r = F.col("rect")
    region = g.rect(
        r["x"] - 30,
        r["y"] - 20,
        F.when(F.col("pos") % 4 == 0, 5.0).otherwise(1.5) * r["width"],
        r["height"] * F.lit(1.25),
    )
    staged = _containers(v).withColumn("region", F.when(F.col("pos") % 2 == 0, region))
    bubble = layout.container_rect(F.col("fallback"), r, F.col("region"), *_size())
    staged = staged.withColumn("container", g.integral_rect(bubble))
    area = layout.text_rect(
        F.col("container"), r, F.col("flow"), F.col("source_is_vertical"), F.lit(None).cast("double")
    )
    return staged.withColumn("area", area).select("page_key", "pos", *_flat("container", "c"), *_flat("area", "t"))


@query(
    """WITH c AS (
 SELECT vec_id AS page_key, CAST(i - 1 AS INTEGER) AS i, 1.0::DOUBLE - abs(CAST(embedding[i] AS DOUBLE)) AS r,
  1.0::DOUBLE - abs(CAST(embedding[i % 64 + 1] AS DOUBLE)) AS g, 1.0::DOUBLE - abs(CAST(embedding[(i + 7) % 64 + 1] AS DOUBLE)) AS b,
  CASE WHEN i % 9 = 0 THEN 0.1 ELSE 1 END::DOUBLE AS a
 FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))
SELECT page_key, i, a > 0.2::DOUBLE AND 0.2126::DOUBLE*r + 0.7152::DOUBLE*g + 0.0722::DOUBLE*b >= 0.82::DOUBLE
 AND greatest(r, g, b) - least(r, g, b) <= 0.18::DOUBLE AS light FROM c"""
)
def light_cells(v: Views) -> DataFrame:
    """Three neighbouring values as colour channels."""

    def channel(offset: int) -> Column:
        idx = (F.col("i") + offset) % 64 + 1
        return F.lit(1.0) - F.abs(F.element_at("embedding", idx).cast("double"))

    cells = v.table("embeddings").select(
        F.col("vec_id").alias("page_key"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    )
    alpha = F.when((F.col("i") + 1) % 9 == 0, 0.1).otherwise(1.0)
    return cells.select("page_key", "i", g.is_light(channel(0), channel(1), channel(8), alpha).alias("light"))


def _rasters(v: Views) -> DataFrame:
    """One page per embedding: a 96 x 96 image with an 8 x 8 raster and one text rectangle."""
    return v.spread_table("embeddings", "vec_id", "label").select(
        F.col("vec_id").alias("page_key"),
        F.lit(0).alias("pos"),
        F.lit(96.0).alias("img_w"),
        F.lit(96.0).alias("img_h"),
        F.lit(8).alias("raster_w"),
        F.lit(8).alias("raster_h"),
        F.lit(g.HORIZONTAL).alias("flow"),
        g.rect(F.lit(30.0) + F.col("label") % 3, F.lit(40.0), F.lit(20.0) + F.col("label") % 20, F.lit(24.0)).alias("rect"),
    )


SAMPLED = """rasters AS (
 SELECT vec_id AS page_key, 30.0::DOUBLE + label % 3 AS rx, 40.0::DOUBLE AS ry, 20.0::DOUBLE + label % 20 AS rw, 24.0::DOUBLE AS rh FROM embeddings)"""


@query(
    f"""WITH {GRID_CELLS}, {SAMPLED}, points AS (
 SELECT *, rx + (c + 0.5::DOUBLE) * 8 AS px, ry + (r + 0.5::DOUBLE) * 8 AS py FROM rasters,
  (SELECT unnest(range(0, 3)) AS r), (SELECT unnest(range(0, 5)) AS c)
 WHERE c < ceil(rw / 8)),
looked AS (
 SELECT p.page_key, coalesce(light, false) AS light FROM points p LEFT JOIN grid_cells g ON p.page_key = g.page_key
  AND g.col = CAST(floor(px / 96 * 8) AS INTEGER) AND g."row" = CAST(floor((96 - py) / 96 * 8) AS INTEGER))
SELECT page_key, (count(*) FILTER (WHERE light))::DOUBLE / count(*)::DOUBLE AS coverage FROM looked GROUP BY page_key"""
)
def light_coverage(v: Views) -> DataFrame:
    return regions.light_coverage(_rasters(v), regions.raster_sampler(v.grid_cells), ["page_key"])


@query(
    f"""WITH {GRID_CELLS}, rects AS (
 SELECT vec_id AS page_key, CAST(label % 4 AS INTEGER) AS row0, CAST(label % 4 + 2 AS INTEGER) AS row1, CAST(label % 3 AS INTEGER) AS col0, 5 AS col1 FROM embeddings)
SELECT r.page_key, count(*) AS n_cells, avg(light::INTEGER) AS share FROM rects r
JOIN grid_cells g ON r.page_key = g.page_key AND "row" BETWEEN row0 AND row1 AND col BETWEEN col0 AND col1 GROUP BY r.page_key"""
)
def cells_in_rects(v: Views) -> DataFrame:
    label = F.col("label")
    rects = v.table("embeddings").select(
        F.col("vec_id").alias("page_key"),
        (label % 4).cast("int").alias("row0"),
        (label % 4 + 2).cast("int").alias("row1"),
        (label % 3).cast("int").alias("col0"),
        F.lit(5).alias("col1"),
    )
    inside = regions.cells_in_rects(rects, v.grid_cells)
    return inside.groupBy("page_key").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg(F.col("light").cast("int")).alias("share")
    )


@query(
    f"""WITH {GRID_CELLS}, tried AS (
 SELECT vec_id AS page_key, step, 8.0::DOUBLE + (80.0::DOUBLE - 30.0::DOUBLE) * (step / 14.0::DOUBLE) AS x
 FROM embeddings, (SELECT unnest(range(0, 15))::DOUBLE AS step)),
points AS (
 SELECT page_key, step, x, x + (c + 0.5::DOUBLE) * 8 AS px, 20.0::DOUBLE + (r + 0.5::DOUBLE) * 8 AS py
 FROM tried, (SELECT unnest(range(0, 6)) AS r), (SELECT unnest(range(0, 4)) AS c)),
covered AS (
 SELECT p.page_key, step, x, (count(*) FILTER (WHERE light))::DOUBLE / count(*)::DOUBLE AS coverage FROM points p
 LEFT JOIN grid_cells g ON p.page_key = g.page_key AND g.col = least(7, CAST(floor(px / 96 * 8) AS INTEGER))
  AND g."row" = CAST(floor((96 - py) / 96 * 8) AS INTEGER) GROUP BY p.page_key, step, x),
scored AS (
 SELECT *, coverage - abs((x + 30.0::DOUBLE/2) - (8.0::DOUBLE + 80.0::DOUBLE/2)) / 80.0::DOUBLE * 0.08::DOUBLE AS score FROM covered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY score DESC, step) AS place FROM scored)
SELECT page_key, CASE WHEN score >= 0.42::DOUBLE THEN x END AS column_x FROM ranked WHERE place = 1"""
)
def best_columns(v: Views) -> DataFrame:
    bases = _rasters(v).withColumn(
        "base", g.rect(F.lit(8.0), F.lit(20.0), F.lit(80.0), F.lit(44.0))
    ).withColumn("column_width", F.lit(30.0))
    return regions.best_column_x(bases, regions.raster_sampler(v.grid_cells), ["page_key"])


def _seeded(v: Views) -> DataFrame:
    inside = F.col("row").between(2, 4) & F.col("col").between(3, 5)
    return v.grid_cells.where("light").select("page_key", "row", "col", inside.alias("seed"))


FLOOD = f"""{GRID_CELLS}, lights AS (SELECT page_key, "row", col FROM grid_cells WHERE light),
reached AS (
 SELECT page_key, "row", col FROM lights WHERE "row" BETWEEN 2 AND 4 AND col BETWEEN 3 AND 5
 UNION
 SELECT l.page_key, l."row", l.col FROM reached r JOIN lights l ON l.page_key = r.page_key
  AND abs(l."row" - r."row") + abs(l.col - r.col) = 1)
SELECT page_key, min("row") AS min_row, max("row") AS max_row, min(col) AS min_col, max(col) AS max_col, count(*) AS n_cells
FROM reached GROUP BY page_key"""


@query(f"WITH RECURSIVE {FLOOD}")
def flood_boxes(v: Views) -> DataFrame:
    return regions.flood_boxes(_seeded(v), ["page_key"])


@query(f"WITH RECURSIVE {FLOOD}")
def flood_boxes_stitched(v: Views) -> DataFrame:
    """The same with tiles of three cells, so that components cross tile borders."""
    return regions.flood_boxes(_seeded(v), ["page_key"], tile=3)


REGIONS = f"""WITH RECURSIVE {GRID_CELLS}, {SAMPLED}, windows AS (
 SELECT *, greatest(0.0::DOUBLE, rx-72) AS sx, greatest(0.0::DOUBLE, ry-60) AS sy,
  least(96.0::DOUBLE, (rx-72)+(rw+144)) - greatest(0.0::DOUBLE, rx-72) AS sw, least(96.0::DOUBLE, (ry-60)+(rh+120)) - greatest(0.0::DOUBLE, ry-60) AS sh FROM rasters),
points AS (
 SELECT *, sx + (c + 0.5::DOUBLE) * 6 AS px, sy + (r + 0.5::DOUBLE) * 6 AS py FROM windows,
  (SELECT unnest(range(0, 16)) AS r), (SELECT unnest(range(0, 16)) AS c)
 WHERE r < ceil(sh / 6) AND c < ceil(sw / 6)),
lights AS (
 SELECT p.page_key, r, c, px >= rx-6 AND px < (rx-6)+(rw+12) AND py >= ry-6 AND py < (ry-6)+(rh+12) AS seed
 FROM points p JOIN grid_cells g ON p.page_key = g.page_key AND light
  AND g.col = CAST(floor(px / 96 * 8) AS INTEGER) AND g."row" = CAST(floor((96 - py) / 96 * 8) AS INTEGER)),
reached AS (
 SELECT page_key, r, c FROM lights WHERE seed
 UNION
 SELECT l.page_key, l.r, l.c FROM reached x JOIN lights l ON l.page_key = x.page_key AND abs(l.r - x.r) + abs(l.c - x.c) = 1),
grown AS (
 SELECT page_key, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, count(*) AS n FROM reached GROUP BY page_key),
found AS (
 SELECT w.*, n, sx + c0*6.0::DOUBLE AS fx, sy + r0*6.0::DOUBLE AS fy, (c1-c0+1)*6.0::DOUBLE AS fw, (r1-r0+1)*6.0::DOUBLE AS fh
 FROM windows w JOIN grown g ON w.page_key = g.page_key)
SELECT page_key, greatest(0.0::DOUBLE, fx) AS x, greatest(0.0::DOUBLE, fy) AS y,
 greatest(1.0::DOUBLE, least(96.0::DOUBLE, fx+fw) - greatest(0.0::DOUBLE, fx)) AS width,
 greatest(1.0::DOUBLE, least(96.0::DOUBLE, fy+fh) - greatest(0.0::DOUBLE, fy)) AS height
FROM found WHERE n >= 4 AND fw >= rw*0.60::DOUBLE AND fh >= rh*0.60::DOUBLE
 AND NOT (fw*fh / greatest(1.0::DOUBLE, sw*sh) > 0.88::DOUBLE AND (fw > rw*2.8::DOUBLE OR fh > rh*2.8::DOUBLE))"""


@query(REGIONS)
def light_regions(v: Views) -> DataFrame:
    windows = regions.search_windows(_rasters(v))
    found = regions.light_regions(windows, regions.raster_sampler(v.grid_cells), ["page_key", "pos"])
    return found.select("page_key", "region.*")


def _images(v: Views) -> DataFrame:
    """The rasters as image bytes: white where the value is positive, else black."""
    pixel = F.transform("embedding", lambda e: F.when(e > 0, "FFFFFF").otherwise("000000"))
    return v.table("embeddings").select(
        F.col("vec_id").alias("page_key"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.lit(3).alias("channels"),
        F.unhex(F.array_join(pixel, "")).alias("data"),
    )


@query(
    f"""WITH {GRID_CELLS}, rasters AS (
 SELECT vec_id AS page_key, i AS pos, 1.0::DOUBLE + i * 5 AS rx, 40.0::DOUBLE AS ry, 20.0::DOUBLE + label % 8 AS rw
 FROM embeddings, (SELECT unnest(range(0, 12)) AS i)),
points AS (
 SELECT *, rx + (c + 0.5::DOUBLE) * 8 AS px, ry + (r + 0.5::DOUBLE) * 8 AS py FROM rasters,
  (SELECT unnest(range(0, 3)) AS r), (SELECT unnest(range(0, 5)) AS c) WHERE c < ceil(rw / 8)),
looked AS (
 SELECT p.page_key, pos, coalesce(light, false) AS light FROM points p LEFT JOIN grid_cells g ON p.page_key = g.page_key
  AND g.col = CAST(floor(px / 96 * 8) AS INTEGER) AND g."row" = CAST(floor((96 - py) / 96 * 8) AS INTEGER))
SELECT page_key, CAST(pos AS INTEGER) AS pos, (count(*) FILTER (WHERE light))::DOUBLE / count(*)::DOUBLE AS coverage FROM looked GROUP BY ALL"""
)
def light_coverage_from_images(v: Views) -> DataFrame:
    """Twelve rectangles per image."""
    twelve = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos")
    rects = v.spread_table("embeddings", "vec_id", "label").select(F.col("vec_id").alias("page_key"), "label", twelve)
    left = F.lit(1.0) + F.col("pos") * 5
    placed = rects.select(
        "page_key",
        "pos",
        F.lit(96.0).alias("img_w"),
        F.lit(96.0).alias("img_h"),
        g.rect(left, F.lit(40.0), F.lit(20.0) + F.col("label") % 8, F.lit(24.0)).alias("rect"),
    )
    return regions.light_coverage(placed, image_sampler(_images(v)), ["page_key", "pos"])


@query(REGIONS)
def light_regions_from_images(v: Views) -> DataFrame:
    windows = regions.search_windows(_rasters(v))
    found = regions.light_regions(windows, image_sampler(_images(v)), ["page_key", "pos"])
    return found.select("page_key", "region.*")
