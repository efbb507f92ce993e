"""Page-corpus views over the generic test tables, with their SQL twins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus.session import spread


@dataclass(frozen=True)
class Views:
    """Views over the Parquet tables of one folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread_table(self, name: str, *columns: str) -> DataFrame:
        return spread(self.table(name).select(*columns))

    @property
    def page_paths(self) -> DataFrame:
        """Documents as files ``source/doc_id.ext``, some of them hidden."""
        endings = ["png", "JPG", "webp", "txt", "cbz", "gif"]
        ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("doc_id") % 6 + 1).cast("int"))
        dot = F.when(F.col("doc_id") % 37 == 0, ".").otherwise("")
        path = F.concat("source", F.lit("/"), dot, F.col("doc_id").cast("string"), F.lit("."), ending)
        return self.table("documents").select(
            F.col("doc_id").alias("page_id"), F.col("source").alias("volume"), path.alias("path")
        )

    @property
    def doc_blocks(self) -> DataFrame:
        """Every line of every document is a block."""
        lines = F.posexplode(F.split("text", "\n")).alias("pos", "original_text")
        return self.spread_table("documents", "doc_id", "text").select(F.col("doc_id").alias("page_key"), lines)

    @property
    def doc_pages(self) -> DataFrame:
        sha = F.sha2("text", 256).alias("sha")
        return self.spread_table("documents", "doc_id", "text").select(F.col("doc_id").alias("page_key"), sha)

    @property
    def conv_blocks(self) -> DataFrame:
        return self.spread_table("conversations", "conv_id", "turn", "text").select(
            F.col("conv_id").alias("page_key"), F.col("turn").alias("pos"), F.col("text").alias("original_text")
        )

    @property
    def boxes(self) -> DataFrame:
        """Line items as pixel corners on a 1000 x 1400 page."""
        x1 = F.col("l_quantity") * 20 - 50
        y1 = F.col("l_discount") * 10000 - 100
        columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
        return self.spread_table("lineitem", *columns).select(
            F.col("l_orderkey").alias("page_key"),
            F.col("l_linenumber").alias("pos"),
            F.lit(1000.0).alias("img_w"),
            F.lit(1400.0).alias("img_h"),
            x1.alias("x1"),
            y1.alias("y1"),
            (x1 + F.col("l_tax") * 5000).alias("x2"),
            (y1 + F.col("l_quantity") * 12).alias("y2"),
            (F.col("l_partkey") % 40).cast("int").alias("n_chars"),
            (F.col("l_suppkey") % 2 == 0).alias("source_is_vertical"),
            F.when(F.col("l_suppkey") % 3 == 0, F.col("l_quantity")).alias("detected_font_size"),
        ).withColumn("xyxy", F.array("x1", "y1", "x2", "y2"))

    @property
    def grid_cells(self) -> DataFrame:
        """Embeddings of 64 values as 8 x 8 rasters."""
        cell = F.posexplode("embedding").alias("i", "v")
        return self.spread_table("embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("page_key"), cell).select(
            "page_key",
            F.floor(F.col("i") / 8).cast("int").alias("row"),
            (F.col("i") % 8).alias("col"),
            F.col("v").cast("double").alias("lum"),
            (F.col("v") > 0).alias("light"),
        )


# The same views for the SQL engine; each text starts a WITH list.
PAGE_PATHS = """page_paths AS (
 SELECT doc_id AS page_id, source AS volume,
  concat(source, '/', CASE WHEN doc_id % 37 = 0 THEN '.' ELSE '' END, CAST(doc_id AS VARCHAR), '.',
   CASE doc_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'webp'
                   WHEN 3 THEN 'txt' WHEN 4 THEN 'cbz' ELSE 'gif' END) AS path
 FROM documents),
pages AS (
 SELECT page_id, volume, path,
  list_transform(regexp_extract_all(lower(path), '([0-9]+|[^0-9]+)'),
   lambda t: CASE WHEN t[1] BETWEEN '0' AND '9' THEN concat('0', lpad(t, 20, '0')) ELSE concat('1', t) END) AS nat
 FROM page_paths
 WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg','jpeg','png','webp','tif','tiff','bmp','gif')
  AND NOT regexp_matches(path, '(^|/)\\.'))"""

DOC_BLOCKS = """doc_blocks AS (
 SELECT page_key, CAST(pos - 1 AS INTEGER) AS pos, parts[pos] AS original_text FROM (
  SELECT doc_id AS page_key, parts, unnest(generate_series(1, len(parts))) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""

CONV_BLOCKS = """conv_blocks AS (
 SELECT conv_id AS page_key, turn AS pos, text AS original_text FROM conversations)"""

CORNERS = """boxes AS (
 SELECT l_orderkey AS page_key, l_linenumber AS pos, 1000.0::DOUBLE AS img_w, 1400.0::DOUBLE AS img_h,
  l_quantity*20 - 50 AS x1, l_discount*10000 - 100 AS y1,
  l_quantity*20 - 50 + l_tax*5000 AS x2, l_discount*10000 - 100 + l_quantity*12 AS y2,
  CAST(l_partkey % 40 AS DOUBLE) AS n, l_suppkey % 2 = 0 AS source_is_vertical,
  CASE WHEN l_suppkey % 3 = 0 THEN l_quantity END AS detected
 FROM lineitem),
cut AS (
 SELECT *, greatest(0.0::DOUBLE, x1) AS a1, greatest(0.0::DOUBLE, y1) AS b1,
  least(img_w, x2) AS a2, least(img_h, y2) AS b2 FROM boxes),
norm AS (
 SELECT *, a1/img_w AS bx, b1/img_h AS bt, (a2-a1)/img_w AS bw, (b2-b1)/img_h AS bh
 FROM cut WHERE a2 > a1 AND b2 > b1)"""

# From normalised boxes to text areas; continues a WITH list that defines ``norm``.
GEOMETRY = """rects AS (
 SELECT *, bx*img_w AS rx, greatest(1.0::DOUBLE, bw*img_w) AS rw, greatest(1.0::DOUBLE, bh*img_h) AS rh,
  img_h - bt*img_h - greatest(1.0::DOUBLE, bh*img_h) AS ry FROM norm),
flows AS (
 SELECT *, CASE WHEN rh >= rw*2.05::DOUBLE AND n <= 8 THEN 'vertical' ELSE 'horizontal' END AS flow FROM rects),
pads AS (
 SELECT *,
  greatest(10.0::DOUBLE, rw * CASE WHEN flow = 'vertical' THEN least(0.24::DOUBLE, 0.12::DOUBLE + n*0.004::DOUBLE)
   ELSE least(0.26::DOUBLE, 0.10::DOUBLE + n*0.004::DOUBLE) END) AS dx,
  CASE WHEN flow = 'vertical' THEN greatest(8.0::DOUBLE, rh*0.08::DOUBLE)
   ELSE greatest(7.0::DOUBLE, rh*least(0.18::DOUBLE, 0.08::DOUBLE + n*0.002::DOUBLE)) END AS dy FROM flows),
fallbacks AS (
 SELECT *, greatest(0.0::DOUBLE, rx-dx) AS fx, greatest(0.0::DOUBLE, ry-dy) AS fy,
  greatest(1.0::DOUBLE, least(img_w, (rx-dx) + (rw+2.0::DOUBLE*dx)) - greatest(0.0::DOUBLE, rx-dx)) AS fw,
  greatest(1.0::DOUBLE, least(img_h, (ry-dy) + (rh+2.0::DOUBLE*dy)) - greatest(0.0::DOUBLE, ry-dy)) AS fh FROM pads),
wholes AS (
 SELECT *, floor(fx) AS ix, floor(fy) AS iy, ceil(fx+fw) - floor(fx) AS iw, ceil(fy+fh) - floor(fy) AS ih FROM fallbacks),
insets AS (
 SELECT *, CASE WHEN flow = 'vertical' THEN greatest(4.0::DOUBLE, iw*0.10::DOUBLE) ELSE greatest(6.0::DOUBLE, iw*0.05::DOUBLE) END AS tdx,
  CASE WHEN flow = 'vertical' THEN greatest(6.0::DOUBLE, ih*0.05::DOUBLE) ELSE greatest(5.0::DOUBLE, ih*0.07::DOUBLE) END AS tdy FROM wholes),
texts AS (
 SELECT *, ix+tdx AS tx, iy+tdy AS ty,
  CASE WHEN iw-2.0::DOUBLE*tdx < 0 OR ih-2.0::DOUBLE*tdy < 0 THEN 0.0::DOUBLE ELSE iw-2.0::DOUBLE*tdx END AS tw,
  CASE WHEN iw-2.0::DOUBLE*tdx < 0 OR ih-2.0::DOUBLE*tdy < 0 THEN 0.0::DOUBLE ELSE ih-2.0::DOUBLE*tdy END AS th FROM insets)"""

BOXES = f"{CORNERS},\n{GEOMETRY}"

GRID_CELLS = """grid_cells AS (
 SELECT vec_id AS page_key, CAST(floor((i-1)/8) AS INTEGER) AS "row", CAST((i-1) % 8 AS INTEGER) AS col,
  CAST(embedding[i] AS DOUBLE) AS lum, embedding[i] > 0 AS light
 FROM (SELECT vec_id, embedding, unnest(generate_series(1,64)) AS i FROM embeddings))"""
