import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from pagecorpus.functions import geometry as g
from pagecorpus.functions.text import graphemes
from pagecorpus.operators import layout
from pagecorpus.operators.regions import raster_sampler
from pagecorpus.plans.block_layout import lay_out
from pagecorpus.sources.scan import image_sampler

WIDTHS = layout.AdvanceWidths()


def width_of(char):
    if char[0] in "iljtfr.,:;!'|()[]":
        return WIDTHS.narrow
    if 0x1100 <= ord(char[0]) <= 0x11FF or 0x2E80 <= ord(char[0]) <= 0xD7A3:
        return WIDTHS.wide
    return WIDTHS.other


def chars(text):
    return regex.findall(r"\X", text)


def measure(text):
    return sum(WIDTHS.space if c == " " else width_of(c) for c in chars(text))


def wrap(text, limit):
    lines, current = [], ""
    for word in [w for w in text.split(" ") if w]:
        candidate = word if not current else f"{current} {word}"
        if measure(candidate) <= limit:
            current = candidate
            continue
        if current:
            lines.append(current)
            current = ""
        if measure(word) <= limit:
            current = word
            continue
        for c in chars(word):
            if current and measure(current + c) > limit:
                lines.append(current)
                current = c
            else:
                current += c
    return lines + ([current] if current else [])


def random_text(rng):
    alphabet = "abcdefil. 한국어말가é" + "x" * 3
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 9))).strip()


def test_wrapping_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, random_text(rng), rng.choice([300, 900, 1500, 2600, 5000])) for i in range(300)]
    rows.append((300, "", 900))
    df = spark.createDataFrame(rows, "i int, t string, k int").withColumn("w", layout.words("t", WIDTHS))
    got = df.select(
        "i",
        layout.wrapped_lines("w", F.col("k"), WIDTHS.space).alias("lines"),
        layout.line_count("w", F.col("k").cast("double"), WIDTHS.space).alias("n"),
    ).collect()
    for r in got:
        expected = wrap(rows[r.i][1], rows[r.i][2])
        assert r.lines == expected and r.n == len(expected)


def horizontal(text, w, h, detected, scale, text_only):
    width, height = max(1.0, w - 12), max(1.0, h - 8)
    limit = min(h * 0.42, w * 0.22)
    source = detected * 0.92 if detected is not None else limit
    size = min(max(limit, source, 16.0), 112.0) * scale
    low = max(8.0, min(max(max(10.0 if text_only else 13.0, min(w, h) * 0.10) * scale, 11.0), 28.0))
    hard = max(7.0, low * 0.72)

    def fits(s):
        k = width * 1000.0 / s
        lines = wrap(text, k)
        return lines and len(lines) * math.ceil(s * 1.06) <= height and all(measure(x) <= k for x in lines)

    while size >= low:
        if fits(size):
            return size, wrap(text, width * 1000.0 / size), False
        size -= 1
    size = low - 1
    while size >= hard:
        if fits(size):
            return size, wrap(text, width * 1000.0 / size), False
        size -= 1
    return hard, wrap(text, width * 1000.0 / hard), True


def vertical(n, w, h, detected, scale, text_only):
    width, height = max(1.0, w - 4), max(1.0, h - 4)
    limit = min(w * 0.52, h * 0.16)
    source = detected * 0.78 if detected is not None else limit
    size = min(max(limit, source, 16.0), 96.0) * scale
    low = max(8.0, min(max(max(10.0 if text_only else 13.0, min(w, h) * 0.12) * scale, 11.0), 28.0))

    def columns(s):
        rows = max(1, math.floor(height / math.ceil(s * 1.08)))
        return rows, math.ceil(n / rows)

    while size >= low:
        rows, cols = columns(size)
        if cols and cols * math.ceil(size * 1.18) <= width:
            return size, rows, cols, False
        size -= 1
    hard = max(7.0, low * 0.72)
    return hard, *columns(hard), True


@pytest.mark.parametrize(("scale", "text_only"), [(1.0, False), (1.3, True), (0.4, False)])
def test_fits_equal_brute_force(spark, scale, text_only):
    rng = random.Random(5)
    rows = [
        (i, random_text(rng), rng.uniform(8, 400), rng.uniform(8, 400), rng.choice([None, rng.uniform(5, 200)]), rng.randint(0, 30))
        for i in range(150)
    ]
    df = spark.createDataFrame(
        rows, "i int, render_text string, w double, h double, detected_font_size double, n_chars int"
    ).withColumn("text_rect", g.rect(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")))
    for r in layout.fit_horizontal(df, scale=scale, text_only=text_only).collect():
        expected = horizontal(rows[r.i][1], r.w, r.h, r.detected_font_size, scale, text_only)
        assert (r.font_size, r.lines, r.overflow) == (pytest.approx(expected[0], abs=1e-9), *expected[1:])
        assert r.line_height == math.ceil(r.font_size * 1.06) and r.n_lines == len(r.lines)
    for r in layout.fit_vertical(df, scale=scale, text_only=text_only).collect():
        expected = vertical(r.n_chars, r.w, r.h, r.detected_font_size, scale, text_only)
        assert (r.font_size, r.max_rows, r.n_columns, r.overflow) == (pytest.approx(expected[0], abs=1e-9), *expected[1:])


def test_vertical_columns(spark):
    df = spark.createDataFrame([("가나 다라마", 2), ("", 3), ("ab", 9)], "t string, k int")
    got = [r.c for r in df.select(layout.vertical_columns(graphemes("t"), F.col("k")).alias("c")).collect()]
    assert got == [[["가", "나"], ["다", "라"], ["마"]], [], [["a", "b"]]]


def test_boxes(spark):
    df = spark.createDataFrame(
        [([-5.0, 10.0, 50.0, 400.0],), ([1.0, 2.0, 3.0],), ([9.0, 9.0, 9.0, 20.0],), ([1.0, None, 3.0, 4.0],), (None,)],
        "xyxy array<double>",
    )
    boxes = [r.b for r in df.select(g.normalised_box(F.col("xyxy"), F.lit(100.0), F.lit(200.0)).alias("b")).collect()]
    assert boxes[0].asDict() == {"x": 0.0, "y": 0.05, "width": 0.5, "height": 0.95}
    assert boxes[1:] == [None] * 4
    tiny = g.inset(g.rect(F.lit(1.0), F.lit(1.0), F.lit(6.0), F.lit(50.0)), F.lit(4.0), F.lit(6.0))
    row = spark.range(1).select(tiny.alias("t")).first().t
    assert (row.width, row.height) == (0.0, 0.0)


BLOCK = "page_key int, pos int, x double, y double, width double, height double, original_text string, translated_text string, source_is_vertical boolean, detected_font_size double"


def page_blocks(spark):
    rows = [
        (1, 0, 0.22, 0.34, 0.56, 0.24, "こんにちは 世界", "안녕하세요 세상", None, None),
        (1, 1, 0.76, 0.12, 0.10, 0.58, "縦書きの長い台詞", "긴 한국어 문장을 좁은 세로 말풍선 안에 읽기 좋게 배치합니다", True, None),
        (1, 2, 0.05, 0.10, 0.04, 0.50, "縦", " ", True, 20.0),
        (1, 3, 0.05, 0.10, 0.04, 0.50, " ", "", None, None),
    ]
    df = spark.createDataFrame(rows, BLOCK)
    return df.select(
        "*",
        F.lit(640.0).alias("img_w"),
        F.lit(360.0).alias("img_h"),
        F.struct("x", "y", "width", "height").alias("box"),
        F.lit(64).alias("raster_w"),
        F.lit(36).alias("raster_h"),
    ).drop("x", "y", "width", "height")


def test_lay_out_page(spark):
    placed = {r.pos: r for r in lay_out(page_blocks(spark)).collect()}
    assert sorted(placed) == [0, 1, 2]
    assert [placed[i].flow for i in range(3)] == ["horizontal", "horizontal", "vertical"]
    assert "".join(placed[0].lines).replace(" ", "") == "안녕하세요세상"
    assert placed[2].columns == [["縦"]]
    for r in placed.values():
        c = r.container
        assert 0 <= c.x and c.x + c.width <= 640 and c.x == int(c.x)


def test_lay_out_on_light_page(spark):
    cells = spark.range(36 * 64).select(
        F.lit(1).alias("page_key"),
        F.floor(F.col("id") / 64).cast("int").alias("row"),
        (F.col("id") % 64).cast("int").alias("col"),
    ).withColumn("light", F.col("col").between(5, 58) & F.col("row").between(8, 24))
    placed = {r.pos: r for r in lay_out(page_blocks(spark), text_only=True, sampler=raster_sampler(cells)).collect()}
    assert sorted(placed) == [0, 1, 2]
    # Rows 8..24 of 10 pixels are light: y 110..280 from below. The region follows the sampling grid.
    box = placed[0].container
    assert 104 <= box.y <= 122 and 268 <= box.y + box.height <= 286
    assert box.width >= 358
    # The tall bubble of a vertical source gets one column.
    assert placed[1].text_rect.width < placed[1].container.width * 0.9
    data = b"".join(
        (b"\xff" if 5 <= c <= 58 and 8 <= r <= 24 else b"\x00") * 3 for r in range(36) for c in range(64)
    )
    images = spark.createDataFrame(
        [(1, 64, 36, 3, bytearray(data))], "page_key int, width int, height int, channels int, data binary"
    )
    again = lay_out(page_blocks(spark), text_only=True, sampler=image_sampler(images)).collect()
    assert {r.pos: r for r in again} == placed
