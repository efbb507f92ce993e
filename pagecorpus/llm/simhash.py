"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Fingerprints link at two or fewer differing bits. Every distinct fingerprint emits all
variants within half that radius, itself and its 64 one-bit flips; two fingerprints link
exactly if they share a variant. All members of a variant's group differ from the variant
in one bit at most, so the whole group is one 64-bit mask: the shuffle carries fixed-width
partial masks, and no group of rows is ever collected.

Near copies, texts of which 0.8 of the five-word shingles are shared, are too far apart for one
such fingerprint. They have many independent ones, signs of sums of random weights, and each
emits the part of its ball in which near copies lie: the 16 variants in which some of its four
least certain bits, those with the smallest sums, are flipped. Texts that share a variant meet,
so any bits in which two fingerprints differ are bridged from the one side or the other, up to
eight; that happens to a pair at 0.8 with a chance of 0.156 at 32 bits, and once in 45
fingerprints with 0.9995. Pairs are verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm.common import FILE, ROW, bare, give_back, located, without
from pagecorpus.llm.minhash import APART, HOT_BUCKET, PER_SALT, SKETCH, closed, hashed, in_groups, joined_to_hubs, texts_of
from pagecorpus.operators.components import component_roots
from pagecorpus.operators.skew import spread_lookup
from pagecorpus.session import broadcast_if_small, freeze, shuffles_removed, sized_in_memory, spread

RADIUS = 2
SEED = 42
BITS = 64
#: Shingles hashed at once: bounds memory for a text of any length.
BLOCK = 65_536

#: Bits of a near copy's fingerprint and how many fingerprints a text has, by the rows that
#: width is for: wider ones meet less often by chance, so chance meetings grow no faster than rows.
WIDTHS = ((1 << 20, 32, 45), (1 << 24, 36, 76), (None, 40, 129))
#: Least certain bits that are flipped, bits of a fingerprint's place in its number.
UNSURE, PLACE_BITS, PRINT_BITS = 4, 6, 40
#: Shingles weighed at once: sums of so many bytes fit in 16 bits.
WEIGHED = 128
#: Variants that are shuffled in one go: so many of each text, or so many in all if that is more.
IN_ONE_GO, FEW = 128, 6_000_000
#: Each pair of numbers gives a shingle eight random weights.
_SEEDS = np.random.default_rng(SEED).integers(1, 1 << 63, (2, max(bits * prints for _, bits, prints in WIDTHS) // 8), dtype=np.uint64) | np.uint64(1)

FLIPS = [0] + [(1 << i) - ((1 << BITS) if i == BITS - 1 else 0) for i in range(BITS)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text over shingles of ``words`` words, as a signed number.

    A-Z count as a-z; words end at ASCII blanks. Repeats count. A shorter text is one
    shingle; without any word (or null) the fingerprint is zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    total = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    starts = np.zeros(len(parts), dtype=np.int64)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = (starts + lengths)[min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, BLOCK):
        first, last = starts[at : min(at + BLOCK, total)].tolist(), ends[at : at + BLOCK].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifier and fingerprint; texts become Python strings one at a time."""
    for batch in batches:
        prints = pa.array((fingerprint(t.as_py()) for t in batch.column(1)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "f"])


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def fingerprint_links(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Links ``(u, v)`` that connect all distinct fingerprints at two or fewer differing bits.

    Members of one variant's group are linked to its smallest member, which differs from
    them in two bits at most; each link is checked again and returned once.
    """
    flip = F.explode(F.array(*[F.lit(m).cast("bigint") for m in FLIPS])).alias("flip")
    emitted = prints.select(F.col(column).alias("f")).where("f IS NOT NULL").distinct().select("f", flip)
    # The variant is f with one bit flipped, so the members of its group are the variant
    # with the flipped bits of the mask turned back, and itself if it is a fingerprint.
    met = (
        emitted.groupBy(F.col("f").bitwiseXOR(F.col("flip")).alias("variant"))
        .agg(F.bit_or("flip").alias("mask"), F.max(F.col("flip") == 0).alias("own"))
        .where(F.bit_count("mask") + F.col("own").cast("int") > 1)
    )
    single = F.array(*[F.lit(m).cast("bigint") for m in FLIPS[1:]])
    turned = F.filter(single, lambda m: m.bitwiseAND(F.col("mask")) != 0)
    members = F.concat(
        F.transform(turned, lambda m: m.bitwiseXOR(F.col("variant"))),
        F.when(F.col("own"), F.array("variant")).otherwise(F.array().cast("array<bigint>")),
    )
    grouped = met.select(members.alias("members")).select(F.array_min("members").alias("v"), F.explode("members").alias("u"))
    return grouped.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)).distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fingerprint, component_id, group_size)``.

    ``fingerprint`` is 16 hexadecimal digits, ``component_id`` the smallest identifier that
    can be reached over links, ``group_size`` the rows of the component. Null and blank
    texts share fingerprint zero and link like any other. Repeated rows stay repeated. Null
    identifiers never name a component unless it has no other. Other columns are not looked
    at. An empty table gives no rows.
    """
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")))
    prints = freeze(rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, f bigint"))
    distinct = freeze(prints.groupBy("f").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = component_roots(fingerprint_links(distinct, "f"), [])
    # A fingerprint without links is its own root.
    rooted = distinct.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    rooted = freeze(rooted)
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("group_size"))
    lookup = rooted.select("f", "root").join(named, "root").select("f", "component_id", "group_size")
    return prints.join(freeze(lookup), "f").select(
        "doc_id", as_hex(F.col("f")).alias("fingerprint"), "component_id", "group_size"
    )


def projections(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` sums, each of one random weight of either sign per shingle."""
    salts, odds = _SEEDS[0, : -(-count // 8)], _SEEDS[1, : -(-count // 8)]
    low = np.uint64(0x00FF00FF00FF00FF)
    total = np.zeros(8 * len(salts), dtype=np.int64)
    for at in range(0, len(hashes), WEIGHED):
        found = (hashes[at : at + WEIGHED, None] ^ salts) * odds
        found ^= found >> np.uint64(32)
        found *= np.uint64(0x94D049BB133111EB)
        found ^= found >> np.uint64(29)
        # Four bytes of a word are added at once, in its 16-bit lanes.
        halves = [(found & low).sum(axis=0, dtype=np.uint64), ((found >> np.uint64(8)) & low).sum(axis=0, dtype=np.uint64)]
        total += np.concatenate(halves).view("<u2")
    return (2 * total - 255 * len(hashes))[:count]


def near_prints(text: str | None, bits: int, prints: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of distinct shingles, the fingerprints and a sketch of 256 of their bits.

    A fingerprint's number holds its bits and then the places of its least certain ones.
    """
    hashes = hashed(text)
    sums = projections(hashes, bits * prints).reshape(prints, bits)
    ones = np.zeros((prints, 64), dtype=np.uint8)
    ones[:, :bits] = sums > 0
    found = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    places = np.argsort(np.abs(sums), axis=1, kind="stable")[:, :UNSURE].astype(np.uint64)
    for i in range(UNSURE):
        found = found | (places[:, i] << np.uint64(PRINT_BITS + PLACE_BITS * i))
    sketch = np.packbits(ones[:, :bits].reshape(-1)[: 64 * len(SKETCH)], bitorder="little").view("<i8")
    return len(hashes), found.view(np.int64), sketch


def _variants(number: str, least: int) -> list[Column]:
    """The fingerprint of a number with any of its ``least`` least certain bits flipped."""
    found = [F.col(number).bitwiseAND((1 << PRINT_BITS) - 1)]
    for i in range(least):
        flip = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({number}, {PRINT_BITS + PLACE_BITS * i}) & {(1 << PLACE_BITS) - 1} AS int))")
        found += [f.bitwiseXOR(flip) for f in found]
    return found


def _buckets(signed: DataFrame, roots: DataFrame | None, prints: int, least: int, in_one_go: int) -> DataFrame:
    """``(b, node)`` of the variants that texts of different roots share, a part of the fingerprints at a time."""
    rooted = signed.select("node", "prints", F.col("node").alias("root"))
    if roots is not None:
        rooted = signed.join(broadcast_if_small(roots), "node", "left").select("node", "prints", F.coalesce("root", "node").alias("root"))
    found = None
    step = max(1, in_one_go >> least)
    for at in range(0, prints, step):
        part = rooted.select("node", "root", F.posexplode(F.slice("prints", at + 1, step)).alias("t", "p"))
        bucket = F.explode(F.array(*_variants("p", least))).alias("v")
        emitted = part.select("node", "root", "t", bucket)
        emitted = emitted.select("node", "root", (F.col("v") + F.shiftleft((F.col("t") + at).cast("bigint"), PRINT_BITS)).alias("b"))
        several = emitted.groupBy("b").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("b")
        met = freeze(emitted.select("b", "node").join(broadcast_if_small(freeze(several)), "b"))
        found = met if found is None else found.unionByName(met)
    return found


def _crowd(met: DataFrame, signed: DataFrame) -> DataFrame:
    """The buckets for :func:`pagecorpus.llm.minhash.closed`: one of those that have the same members.

    Two texts that met by chance are told by their sketches.
    """
    mark = F.xxhash64("node")
    known = met.join(signed.select("node", *SKETCH), "node")
    sizes = known.groupBy("b").agg(
        F.count(F.lit(1)).alias("size"), F.sum(mark.bitwiseAND((1 << 31) - 1)).alias("sum"),
        F.bit_xor(mark).alias("xor"), *[F.bit_xor(c).alias(c) for c in SKETCH],
    )
    # Of two members these are the bits in which the sketches differ.
    apart = sum((F.bit_count(c) for c in SKETCH[1:]), F.bit_count(SKETCH[0]))
    sizes = sizes.where((F.col("size") > 2) | (apart <= APART))
    sizes = freeze(sizes.groupBy("size", "sum", "xor").agg(F.min("b").alias("b")).select("b", "size"))
    met = spread_lookup(met, sizes.withColumn("uses", F.col("size")), ["b"], "uses", ["node"], "inner", HOT_BUCKET, PER_SALT)
    return freeze(met.join(signed.select("node", "n", *SKETCH), "node"))


def near_groups(docs: DataFrame, key: str = "key", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(node, key)`` of all rows, and ``(node, root)`` of all that links at 0.8 or more connect to others.

    Texts meet by ball hashing. Those with an equal fingerprint go first, so that the balls of a
    group of close copies need not be told apart. Nodes are numbers of this call. Null and
    blank texts are alike and link with each other.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("_text"))
    kind = rows.schema["key"].dataType.simpleString()
    n = rows.count()
    bits, prints = next((b, p) for most, b, p in WIDTHS if most is None or n <= most)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [near_prints(t.as_py(), bits, prints) for t in batch.column(1)]
            flat = pa.array(np.concatenate([p for _, p, _ in found]) if found else np.zeros(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, prints), pa.int32()), flat)
            sketches = np.array([s for *_, s in found], dtype=np.int64).reshape(len(found), len(SKETCH))
            columns = [batch.column(0), pa.array([m for m, *_ in found], pa.int64()), lists, *map(pa.array, sketches.T)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "prints", *SKETCH])
        give_back()

    with shuffles_removed(docs.sparkSession), sized_in_memory(docs.sparkSession):
        schema = f"key {kind}, n bigint, prints array<bigint>, " + ", ".join(f"{c} bigint" for c in SKETCH)
        signed = freeze(spread(rows).mapInArrow(sign, schema).withColumn("node", F.monotonically_increasing_id()))
        seen: list[DataFrame] = []
        read = lambda nodes: texts_of(rows, signed, nodes)
        in_one_go = max(IN_ONE_GO, FEW // max(1, n))
        roots = joined_to_hubs(_crowd(_buckets(signed, None, prints, 0, in_one_go), signed), seen, read)
        roots = closed(_crowd(_buckets(signed, roots, prints, UNSURE, in_one_go), signed), roots, seen, read)
        return signed.select("node", "key"), freeze(in_groups(roots))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, that of its smallest identifier.

    Near copies share 0.8 of their five-word shingles. Candidates share a variant of one of
    their fingerprints; groups are closed over links verified on the texts. Of rows that share
    the identifier the first by file and row stays; a null comes after all others.
    """
    source = bare(docs)
    rows = located(source, source.columns)
    place = F.struct(FILE, ROW)
    keys, roots = near_groups(rows.select(place.alias("key"), F.col(text).alias("text")))
    with sized_in_memory(docs.sparkSession):
        linked = freeze(roots.join(keys, "node").select("root", f"key.{FILE}", f"key.{ROW}"))
        # All columns of a row but its identifier may be large, so only the linked rows' identifiers are joined.
        ids = rows.select(FILE, ROW, F.col(doc_id).isNull().alias("__llm_none"), F.col(doc_id).alias("__llm_id"))
        ordered = freeze(ids.join(broadcast_if_small(linked), [FILE, ROW]))
        order = F.struct("__llm_none", "__llm_id", FILE, ROW)
        first = ordered.groupBy("root").agg(F.min(order).alias("first"))
        stay = first.select(F.col(f"first.{FILE}").alias(FILE), F.col(f"first.{ROW}").alias(ROW))
        gone = freeze(ordered.join(broadcast_if_small(freeze(stay)), [FILE, ROW], "left_anti"))
    return without(rows, gone)
