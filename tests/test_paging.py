import random

import pytest
from pyspark.sql import functions as F

from pagecorpus.operators import paging
from pagecorpus.operators.ordering import with_positions


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_positions_with_one_hot_group(spark, slices):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(400), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, o int, id int")
    got = {r.id: r for r in with_positions(df, ["g"], ["o", "id"], neighbours_of="id", slices=slices).collect()}
    for group in {r[0] for r in rows}:
        ids = [r[2] for r in sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2]))]
        for k, i in enumerate(ids):
            r = got[i]
            assert (r.position, r.group_size) == (k + 1, len(ids))
            assert r.prev == (ids[k - 1] if k else None)
            assert r.next == (ids[k + 1] if k + 1 < len(ids) else None)
    assert len(got) == len(rows)


def test_flat_folder_siblings(spark):
    names = ["30.tif", "4.gif", "list.csv", ".cut.png", "3.bmp"]
    manifest = spark.createDataFrame([("/r/" + n,) for n in names] + [("/q/x.txt",), ("/r/sub/8.png",)], "path string")
    selected = spark.createDataFrame([("/r/4.gif",), ("/q/x.txt",)], "path string")
    siblings = paging.folder_siblings(manifest, selected)
    rows = siblings.orderBy("folder", "page_no").collect()
    assert [r.path for r in rows] == ["/q/x.txt", "/r/3.bmp", "/r/4.gif", "/r/30.tif"]
    index = {r.path: r.page_index for r in paging.selected_index(siblings, selected).collect()}
    assert index == {"/r/4.gif": 1, "/q/x.txt": 0}


def test_recursive_scan_and_numbers(spark):
    names = ["ep/21.bmp", "ep/3.bmp", "front.gif", "list.csv", "__MACOSX/1.png", "_cover.png"]
    manifest = spark.createDataFrame([(n,) for n in names], "path string").withColumn("volume", F.lit("v"))
    pages = paging.supported_pages(manifest)
    numbered = paging.page_numbers(pages).orderBy("page_no").collect()
    assert [r.path for r in numbered] == ["_cover.png", "ep/3.bmp", "ep/21.bmp", "front.gif"]
    assert [r.page_label for r in numbered] == ["1 / 4", "2 / 4", "3 / 4", "4 / 4"]
    assert [r.prev_path for r in numbered] == [None, "_cover.png", "ep/3.bmp", "ep/21.bmp"]
    assert [r.path for r in paging.natural_order(pages).collect()] == [r.path for r in numbered]
    labels = paging.volume_labels(spark.createDataFrame([("v",), ("w",)], "volume string"), pages)
    assert {r.volume: r.page_label for r in labels.collect()} == {"v": "1 / 4", "w": "0 / 0"}
