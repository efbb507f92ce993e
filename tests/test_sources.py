import hashlib
import io
import os
import struct
import zipfile
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecorpus import schema
from pagecorpus.sources import archives, project_json, scan, store, versions


def png(path, width, height, pixel):
    raw = b"".join(b"\0" + bytes(v for x in range(width) for v in pixel(x, y)) for y in range(height))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scans(spark, tmp_path):
    for name in ["12.gif", "3.bmp", "list.csv", ".cut.png", "_cover.png", "b/11.tif", "b/4 장.png", "_b/5.jpg", "__MACOSX/3.bmp"]:
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(b"x" + name.encode())
    flat = scan.scan_pages(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.rel_path for r in flat] == ["3.bmp", "12.gif", "_cover.png"]
    deep = scan.scan_pages(spark, str(tmp_path), recursive=True).orderBy("position").collect()
    names = ["3.bmp", "12.gif", "_b/5.jpg", "_cover.png", "b/4 장.png", "b/11.tif"]
    assert [r.rel_path for r in deep] == names
    shas = {r.path.split("/")[-1]: r.sha for r in scan.fingerprinted(spark, str(tmp_path)).collect()}
    assert shas == {n.split("/")[-1]: hashlib.sha256(b"x" + n.encode()).hexdigest() for n in names}


def test_manifest_does_not_read_contents(spark, tmp_path):
    (tmp_path / "1.png").write_bytes(b"x")
    plan = scan.file_manifest(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_archives(spark, tmp_path):
    def pack(name, entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for entry in entries:
                z.writestr(entry, b"data of " + entry.encode())

    inside = ["v1/07.webp", "v1/03.jpeg", "info.xml", "__MACOSX/v1/03.jpeg", "v1/.09.png", "_01.png"]
    pack("tome.cbz", inside)
    pack("copy.zip", inside)
    pack("text.zip", ["info.xml"])
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 not really")
    (tmp_path / "other.rar").write_bytes(b"x")
    found = archives.read_archives(spark, str(tmp_path))
    nothing = spark.createDataFrame([], "archive_sha string")
    todo = archives.pending_archives(found, nothing)
    assert todo.count() == 3
    entries = archives.expand_archives(todo)
    pages, problems = archives.archive_pages(entries)
    names = sorted(r.entry for r in pages.collect())
    assert names == ["_01.png", "v1/03.jpeg", "v1/07.webp"]
    assert bytes(pages.where("entry = 'v1/03.jpeg'").first().content) == b"data of v1/03.jpeg"
    status = {r.archive.split("/")[-1]: r.status for r in problems.collect()}
    assert status == {"broken.zip": "extraction_failed", "text.zip": schema.NO_IMAGES}
    done = found.where(F.contains("path", F.lit("tome"))).select("archive_sha")
    assert {r.path.split("/")[-1] for r in archives.pending_archives(found, done).collect()} == {"broken.zip", "text.zip"}


def test_archives_too_large_for_a_row_are_opened_in_place(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big one.cbz", "w") as z:
        for i in range(9):
            z.writestr(f"{i}.png", b"y" * (1000 + i))
    (tmp_path / "bad.cbz").write_bytes(b"PK" + b"x" * 100)
    found = archives.read_archives(spark, str(tmp_path), max_row_bytes=10)
    rows = {r.path.split("/")[-1]: r for r in found.collect()}
    shas = {r.path.split("/")[-1]: r.archive_sha for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert {n: r.archive_sha for n, r in rows.items()} == shas
    pages, problems = archives.archive_pages(archives.expand_archives(found))
    assert {(r.entry, len(r.content)) for r in pages.collect()} == {(f"{i}.png", 1000 + i) for i in range(9)}
    assert [r.status for r in problems.collect()] == ["extraction_failed"]


def test_archives_nobody_can_open_are_reported(spark, tmp_path):
    form = "path string, length long, archive_sha string, content binary, status string"
    for sha, status in ((None, archives.EXTRACTION_FAILED), ("ab", schema.OK)):
        gone = spark.createDataFrame([(f"file:{tmp_path}/gone.zip", 10, sha, None, status)], form)
        found = archives.expand_archives(archives.pending_archives(gone, spark.createDataFrame([], "archive_sha string")))
        _, problems = archives.archive_pages(found)
        assert [(r.entry, r.status) for r in problems.collect()] == [(None, archives.EXTRACTION_FAILED)]


@pytest.mark.parametrize("in_place", [False, True])
def test_large_entries_leave_their_siblings_alone(spark, tmp_path, in_place):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, size in (("film.mkv", 5000), ("1.png", 10), ("2.png", 900), ("3.png", 20)):
            z.writestr(name, b"z" * size)
    found = archives.read_archives(spark, str(tmp_path), max_row_bytes=10 if in_place else 10**6)
    pages, problems = archives.archive_pages(archives.expand_archives(found, max_entry_bytes=100))
    assert {(r.entry, len(r.content)) for r in pages.collect()} == {("1.png", 10), ("3.png", 20)}
    assert [(r.entry, r.status) for r in problems.collect()] == [("2.png", schema.OVERSIZE)]


def test_images(spark, tmp_path):
    png(tmp_path / "white.png", 5, 4, lambda x, y: (250, 250, 250) if x < 2 else (10, 10, 10))
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = {r.path.split("/")[-1]: r for r in scan.read_images(spark, str(tmp_path)).collect()}
    assert (rows["white.png"].width, rows["white.png"].height, rows["white.png"].status) == (5, 4, "ok")
    assert (rows["broken.png"].width, rows["broken.png"].status) == (None, schema.INVALID_IMAGE)
    light = scan.pixel_is_light(F.col("data"), F.col("channels"), F.col("i"))
    pixels = scan.read_images(spark, str(tmp_path)).where("status = 'ok'").crossJoin(spark.range(20).withColumn("i", F.col("id").cast("int")))
    got = [r.l for r in pixels.select("i", light.alias("l")).orderBy("i").collect()]
    assert got == [i % 5 < 2 for i in range(20)]


@pytest.mark.parametrize(("channels", "data", "expected"), [(1, "FF80", [True, False]), (4, "FFFFFFFFFFFFFF10", [True, False])])
def test_other_channel_counts(spark, channels, data, expected):
    df = spark.range(2).select(F.col("id").cast("int").alias("i"), F.unhex(F.lit(data)).alias("d"), F.lit(channels).alias("c"))
    light = scan.pixel_is_light(F.col("d"), F.col("c"), F.col("i"))
    assert [r.l for r in df.orderBy("i").select(light.alias("l")).collect()] == expected


def test_project_documents(spark):
    good = '{"pages":{"p7.png":[{"xyxy":[2,4,7,8],"text":["x","y"],"translation":null,"src_is_vertical":true,"_detected_font_size":9.5}]}}'
    partial = '{"pages":{"p7.png":[{"xyxy":[2,4,7,8],"text":["x"]},{"text":["x"]}]}}'
    rows = [(1, good), (2, partial), (3, "{}"), (4, "nonsense"), (5, '{"pages":{"other.png":[]}}'), (6, good)]
    documents = spark.createDataFrame(rows, "doc int, json string")
    status = {r.doc: r.status for r in project_json.parsed(documents).collect()}
    bad = schema.INVALID_DOCUMENT
    assert status == {1: "ok", 2: bad, 3: bad, 4: bad, 5: "ok", 6: "ok"}
    assert {r.doc for r in project_json.quarantined(documents).collect()} == {2, 3, 4}
    sizes = spark.createDataFrame([(i, 10.0, 20.0) for i in range(1, 6)], "doc int, img_w double, img_h double")
    rules = spark.createDataFrame([], schema.RULES)
    blocks, empty = project_json.text_blocks(documents, sizes, rules, ["doc"], page_name="p7.png")
    row = blocks.first()
    assert blocks.count() == 1 and (row.original_text, row.translated_text, row.confidence) == ("x\ny", "", 1.0)
    assert row.box.asDict() == {"x": 0.2, "y": 0.2, "width": 0.5, "height": 0.2}
    assert (row.source_is_vertical, row.detected_font_size) == (True, 9.5)
    assert {(r.doc, r.status) for r in empty.collect()} == {(5, schema.NO_TEXT_BLOCKS), (6, schema.INVALID_IMAGE)}


def test_sizes_by_page(spark):
    block = '{"xyxy":[2,4,7,8],"text":["x"]}'
    documents = spark.createDataFrame([(1, f'{{"pages":{{"a.png":[{block}],"b.png":[{block}]}}}}')], "doc int, json string")
    rules = spark.createDataFrame([], schema.RULES)
    sizes = spark.createDataFrame([(1, "a.png", 10.0, 20.0), (1, "b.png", 20.0, 40.0)], "doc int, page_name string, img_w double, img_h double")
    blocks, empty = project_json.text_blocks(documents, sizes, rules, ["doc"])
    assert {(r.page_name, r.box.x, r.box.y) for r in blocks.collect()} == {("a.png", 0.2, 0.2), ("b.png", 0.1, 0.1)}
    assert empty.count() == 0
    _, empty = project_json.text_blocks(documents, sizes.where("page_name = 'a.png'"), rules, ["doc"])
    assert [r.status for r in empty.collect()] == [schema.INVALID_IMAGE]


def record(spark, key, text, stamp="2021-11-30 21:08:07", positions=(0,), segment=0):
    blocks = [(p, f"id-{key}-{p}", (0.5, 0.25, 0.125, 0.375), "見本", text, 0.75, None, None) for p in positions]
    row = (key, segment, "/srv/scan 4.png", "ja", "ko", None, blocks)
    df = spark.createDataFrame([row], store.RECORD)
    return df.withColumn("created_at", F.to_timestamp(F.lit(stamp)))


def test_document_json_round_trip(spark):
    document = store.to_documents(record(spark, "k-09", "견본")).first()
    assert document.file_name == "k-09.json"
    text = document.json
    assert '"createdAt" : "2021-11-30T21:08:07Z"' in text
    order = [text.index(f'"{k}"') for k in ("blocks", "createdAt", "imageFingerprint", "imageURL", "sourceLanguage", "targetLanguage")]
    assert order == sorted(order) and text.count("\n") > 5
    again = store.from_documents(spark.createDataFrame([(text,)], "json string"))
    assert again.collect() == record(spark, "k-09", "견본").collect()


def test_positions_and_segments_survive_json(spark):
    stored = record(spark, "k", "x", positions=(0, 2)).union(record(spark, "k", "x", positions=(5, 6, 9), segment=1))
    documents = store.to_documents(stored)
    assert documents.count() == 1
    back = store.from_documents(documents).first()
    assert [b.pos for b in back.blocks] == [0, 2, 5, 6, 9] and back.segment == 0
    bare = documents.select(F.regexp_replace("json", r'"position" : \d+,\s*', "").alias("json"))
    assert [b.pos for b in store.from_documents(bare).first().blocks] == [0, 1, 2, 3, 4]


def test_broken_documents_are_quarantined(spark):
    text = store.to_documents(record(spark, "k", "x")).first().json
    rows = [text, "{broken", text.replace('"box"', '"bax"'), text.replace('"imageURL"', '"url"'), None, "[]"]
    documents = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, json string")
    assert {(r.i, r.status) for r in store.quarantined_documents(documents).collect()} == {(i, schema.INVALID_DOCUMENT) for i in range(1, 6)}
    assert [r.cache_key for r in store.from_documents(documents).collect()] == ["k"]


def test_read_by_key(spark, tmp_path):
    root = str(tmp_path / "t")
    store.initialise(spark, root)
    store.write_version(record(spark, "00ab", "one").union(record(spark, "f1", "two")), root, 1)
    store.write_version(record(spark, "f1", "three"), root, 2)
    wanted = spark.createDataFrame([("f1",), ("zz",)], "cache_key string")
    found = store.read_current(spark, root, keys=wanted)
    assert [(r.cache_key, r.blocks[0].translated_text) for r in found.collect()] == [("f1", "three")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cache_key" in plan and "prefix#" in plan.split("PartitionFilters")[1]


def test_read_document_files(spark, tmp_path):
    (tmp_path / "k.json").write_text(store.to_documents(record(spark, "k", "x")).first().json)
    assert store.read_documents(spark, str(tmp_path)).first().cache_key == "k"


def test_versions_replace_delete_and_compact(spark, tmp_path):
    root, target = str(tmp_path / "table"), str(tmp_path / "compacted")
    store.initialise(spark, root)
    assert store.read_current(spark, root).count() == 0
    store.write_version(record(spark, "00ab", "one").union(record(spark, "0012", "two")), root, 1)
    store.write_deletions(spark.createDataFrame([("0012",), ("zz",)], "cache_key string"), root, 2)
    store.write_version(record(spark, "00ab", "new").union(record(spark, "ff", "three")), root, 3)

    def texts(df):
        return {r.cache_key: r.blocks[0].translated_text for r in df.collect()}

    assert texts(store.read_current(spark, root)) == {"00ab": "new", "ff": "three"}
    assert texts(store.read_current(spark, root, before=3)) == {"00ab": "one"}
    store.write_version(record(spark, "00ab", "again"), root, 3)
    assert texts(store.read_current(spark, root)) == {"00ab": "again"}
    store.compact(spark, root, target)
    assert texts(store.read_current(spark, target)) == {"00ab": "again"}


def rows_read(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_look_up_of_few_keys_reads_few_rows(spark, tmp_path):
    root, form = str(tmp_path / "t"), T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    key = lambda c: F.sha2(c.cast("string"), 256).alias("k")
    for i in range(10):
        versions.write(spark.range(3000 * i, 3000 * i + 3000).select(key(F.col("id")), F.col("id").alias("v")), root, i, "k", i % 2)
    absent = spark.range(1_000_000, 1_000_030).select(key(F.col("id")))
    assert rows_read(versions.read(spark, root, form, keys=absent, key="k")) < 3000
    some = spark.range(4000, 4003).select(key(F.col("id")))
    found = versions.read(spark, root, form, keys=some, key="k")
    assert rows_read(found) < 6000
    assert {(r.v, r.version) for r in found.collect()} == {(4000, 1), (4001, 1), (4002, 1)}
    many = spark.range(0, 3 * versions.MAX_KEYS, 2).select(key(F.col("id")))
    assert versions.read(spark, root, form, keys=many, key="k").count() == 3 * versions.MAX_KEYS // 2
    assert versions.merge(spark, root, form, "k") == 1
    assert len(versions.runs(spark, root)) == 1
    assert {(r.v, r.version) for r in versions.read(spark, root, form, keys=some, key="k").collect()} == {(4000, 1), (4001, 1), (4002, 1)}
    assert versions.vacuum(spark, root) == 10 and versions.read(spark, root, form).count() == 30_000


def test_versions_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    texts = lambda: {r.cache_key: r.blocks[0].translated_text for r in store.read_current(spark, root).collect()}
    store.write_version(record(spark, "a", "one"), root, 1)
    before = store.read_current(spark, root)
    # Killed after the data are written: readers keep the old state, and a replay takes its place.
    monkeypatch.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.write_version(record(spark, "a", "two"), root, 1)
    with pytest.raises(KeyboardInterrupt):
        store.write_version(record(spark, "b", "new"), root, 2)
    monkeypatch.undo()
    assert texts() == {"a": "one"}
    # Written again: a reader that planned before sees the old form to its end.
    store.write_version(record(spark, "a", "three"), root, 1)
    assert texts() == {"a": "three"}
    assert before.first().blocks[0].translated_text == "one"
    assert versions.vacuum(spark, root) == 3
    assert texts() == {"a": "three"}


def test_merging_keeps_what_is_in_force(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    monkeypatch.setattr(versions, "FAN", 3)
    store.initialise(spark, root)
    for i in range(1, 8):
        if i % 3 == 2:
            store.write_deletions(spark.createDataFrame([(f"k{i - 1}",)], "cache_key string"), root, i)
        else:
            store.write_version(record(spark, f"k{i % 5}", f"v{i}").union(record(spark, f"k{i}", f"v{i}")), root, i)
    texts = lambda: {r.cache_key: r.blocks[0].translated_text for r in store.read_current(spark, root).collect()}
    expected = texts()
    # Only what is before version 7 is merged, so that a replay of 7 finds what it found.
    earlier = store.read_current(spark, root, before=7).count()
    assert store.merge_versions(spark, root, before=7) >= 1
    assert texts() == expected and store.read_current(spark, root, before=7).count() == earlier
    store.write_version(record(spark, "k7", "again"), root, 7)
    assert texts()["k7"] == "again"
    with pytest.raises(ValueError):
        store.write_version(record(spark, "k", "x"), root, 6)
    with pytest.raises(ValueError):
        store.read_current(spark, root, before=6)
    # A marker left by a killed merge is superseded by the one that covers it.
    merged = versions.runs(spark, root)[0]
    versions._commit(spark, root, versions.Run(merged.low + 1, merged.low + 1, "gone", 5, 0))
    assert texts()["k7"] == "again"


def test_workers_get_archives_in_bounded_batches(spark):
    """Neither what a worker gets nor what it hands back grows with the number of archives."""
    rows = []
    for i in range(40):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr("1.png", os.urandom(500_000))
        rows.append((f"{i}.cbz", str(i), bytearray(buffer.getvalue()), "ok"))
    packed = spark.createDataFrame(rows, "path string, archive_sha string, content binary, status string").coalesce(1)
    entries = archives.expand_archives(packed)
    assert entries.where("status = 'ok'").count() == 40

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [sum(map(len, batch["content"]))]})

    for table in (packed, entries.select("content")):
        found = [r.n for r in table.mapInPandas(sizes, "n long").collect()]
        assert sum(found) >= 40 * 500_000 and max(found) <= 5 << 20
