import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from pagecorpus.functions import keys, paths, text
from pagecorpus.functions.responses import response_fields
from pagecorpus.operators.blocks import page_text


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_utrim_takes_every_unicode_space(spark):
    rows = ["　 a　b \n", " x ", "", "   ", None, "\u0085y\u000b"]
    assert values(spark, rows, text.utrim("s")) == ["a　b", "x", "", "", None, "y"]


def test_compact_and_clean_breaks(spark):
    assert values(spark, ["a　b \n c"], text.compact("s")) == ["abc"]
    rows = ["a \n b", "a  \n  b", " \n\n x"]
    assert values(spark, rows, text.clean_breaks("s")) == ["a\nb", "a \n b", "x"]


def test_renderable(spark):
    rows = ["a\nb  ,c　! d ...", "x ?\n…", " \n "]
    assert values(spark, rows, text.renderable("s")) == ["a b,c! d...", "x?…", ""]


def test_graphemes_group_marks_and_skip_spaces(spark):
    rows = ["é 가　ñ", "", "👨‍👩‍👧x"]
    assert values(spark, rows, text.graphemes("s")) == [["é", "가", "ñ"], [], ["👨‍👩‍👧", "x"]]
    assert values(spark, rows, text.char_count("s")) == [3, 0, 2]


def test_display_text(spark):
    df = spark.createDataFrame([(" t ", "o"), ("　", " o "), (None, " o")], "t string, o string")
    shown = df.select(text.display_text("t", "o").alias("a"), text.display_text("t", "o", False).alias("b")).collect()
    assert [(r.a, r.b) for r in shown] == [("t", "t"), ("o", " o "), ("o", " o")]


def test_contains_script(spark):
    rows = ["abc", "a한", None, "힣", "꯿"]
    assert values(spark, rows, text.contains_script("s")) == [False, True, False, True, False]


@pytest.mark.parametrize(
    "names",
    [
        ["3.bmp", "4.gif", "30.tif"],
        ["ep/3.bmp", "ep/21.bmp", "front.gif"],
        ["a1b2", "a1b10", "a02b1", "a10", "b"],
        ["p99999999999999999999999.png", "p100000000000000000000000.png"],
    ],
)
def test_natural_key_order(spark, names):
    df = spark.createDataFrame([(n,) for n in reversed(names)], "s string")
    assert [r.s for r in df.orderBy(text.natural_key("s"), "s").collect()] == names


def test_keys(spark):
    sha = F.lit("ab12")
    row = spark.range(1).select(
        keys.cache_key(sha, "engine-v1", "google_web").alias("k"),
        keys.cache_key(sha, "engine-v1", "google_web", ("ja", "ko")).alias("l"),
        keys.fingerprint(F.lit("abc")).alias("f"),
        keys.export_name(F.lit("/a/b/page 1.old.webp")).alias("e"),
        keys.export_name(F.lit("/a/b/plain")).alias("p"),
    ).first()
    assert row.k == "ab12-engine-v1-google-web" and row.l == "ab12-engine-v1-google-web-ja-ko"
    assert row.f == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert (row.e, row.p) == ("page 1.old_ko.png", "plain_ko.png")


def test_path_predicates(spark):
    rows = ["a/1.PNG", "a/x.cbz", "a/n.txt", "a/.png", "noext", "a.png/file", "a/.h/1.png", "__MACOSX/1.png", "x/__MACOSX"]
    assert values(spark, rows, paths.is_image("s")) == [True, False, False, False, False, False, True, True, False]
    assert values(spark, rows, paths.is_hidden("s")) == [False, False, False, True, False, False, True, False, False]
    assert values(spark, rows, paths.in_resource_folder("s"))[-2:] == [True, True]
    assert values(spark, rows, paths.input_kind("s"))[:3] == ["image", "archive", "unsupported"]
    assert values(spark, rows, paths.parent("s"))[:2] == ["a", "a"]
    assert values(spark, ["/r/a/b.png", "/other/c.png"], paths.relative_to("s", "/r/")) == ["a/b.png", "c.png"]


def test_response_text(spark):
    rows = [
        '[[["하늘","そら",null,null,3]],null,"ja"]',
        '[[[" ","",null,null,3]],null,"ja"]',
        '[[["a","x"],5,[7,"q"],["b"],{"a":1},"str",[]],null]',
        '{"a":1}',
        "nonsense",
        "[]",
        "[[]]",
        None,
    ]
    got = [(r["text"], r["status"]) for r in values(spark, rows, response_fields("s"))]
    bad, missing = (None, "invalid_response"), (None, "missing_text")
    assert got == [("하늘", "ok"), missing, ("ab", "ok"), bad, bad, bad, missing, bad]


def test_a_text_joined_in_segments_is_the_same(spark):
    rows = [("a", i, None if 4 <= i < 8 or i == 9 else f"t{i}") for i in (3, 1, 0, 2, 4, 5, 6, 7, 9, 11, 8)] + [("b", 900, "x"), ("b", 5, ""), ("c", 1, None)]
    blocks = spark.createDataFrame(rows, "page_key string, pos long, original_text string")
    whole = sorted(map(tuple, page_text(blocks).collect()))
    assert whole[0] == ("a", "t0\nt1\nt2\nt3\nt8\nt11")
    for segment in (1, 4, 1000):
        assert sorted(map(tuple, page_text(blocks, segment=segment).collect())) == whole


def test_long_pages_share_all_events(spark):
    pages = entry_module.queries()["long_pages"](spark, "/root/testdata/sf0.001").collect()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert sorted(r.page_key for r in pages) == [0, 1]
    assert sum(r.n_blocks for r in pages) == sum(len(r.page_text.split("\n")) for r in pages) == events
