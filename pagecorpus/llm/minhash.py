"""Near copies by the similarity of their shingles: buckets closed over links verified on the texts.

A text is the set of its shingles of five words. Texts that share a key are a bucket; the keys
are those of :func:`pagecorpus.llm.simhash.near_groups`, or MinHash bands (:func:`near_groups`):
112 minima of keyed hashes of a set are read in two arrangements of 16 bands of seven, which
have at most one minimum in common; two texts meet if they share a band, which a pair at
Jaccard 0.8 does with probability 0.999.

Only connections count, so a bucket needs few of its pairs: first every member is laid
against the hub, the member whose buckets are largest. Members that a hub has not joined to
its component are laid against four, sixteen, ... further members, until all are joined or
each of them has met the whole bucket. A pair is left out only if its texts are joined
already, or their numbers of shingles or far apart sketches rule it out, whatever the size of
the bucket; no pair is verified twice.

Between these, shingles are counted over all members of the buckets that are not joined. One
that no other member holds is in no intersection, so a text with too many of them is alike
none of the others and meets none; without it further shingles have a single holder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm.common import give_back
from pagecorpus.llm.repeats import Runs, mixed
from pagecorpus.operators.components import component_roots
from pagecorpus.operators.skew import spread_lookup
from pagecorpus.session import broadcast_if_small, freeze, spread

WORDS, LEAST = 5, 0.8
#: Bands of each of the two arrangements, minima of a band, seed of the keyed hashes.
BANDS, DEPTH, SEED = 16, 7, 42
#: Shingles hashed at once: bounds memory for a text of any length.
BLOCK = 1_024
#: Each round meets so many times more members of a bucket than the one before.
GROWTH = 4
#: Pairs of one text from which they are dealt out over salts, and pairs per salt.
HOT, PER_SALT = 500, 100
#: Members of a bucket from which they are dealt out.
HOT_BUCKET = 20_000

#: Columns of a sketch of 256 bits, and the most bits in which two near copies' sketches differ:
#: 39 on average and six more as a standard deviation at the least similarity, 128 if unlike.
SKETCH, APART = ("s0", "s1", "s2", "s3"), 84
#: Room for rounding where numbers of shingles are compared.
SLACK = 1e-6
#: Texts are ruled out again as long as no larger share of them stays.
ENOUGH = 0.98

_RANDOM = np.random.default_rng(SEED)
_KEYS = _RANDOM.integers(1, 1 << 32, (2, BANDS * DEPTH), dtype=np.uint32) | np.uint32(1)
_SPIN = _RANDOM.integers(1, 1 << 63, BANDS * DEPTH, dtype=np.uint64) | np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """The distinct shingles; a shorter text is one, a text without any word has none."""
    parts = _words(text)
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def similarity(one: set[bytes], other: set[bytes]) -> float:
    """Jaccard similarity; two texts without any word are alike."""
    both = len(one & other)
    return both / (len(one) + len(other) - both) if one or other else 1.0


def hashed(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    parts = _words(text)
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(max(1, len(parts) - words + 1))
    return np.unique(Runs(parts).hashes(starts, np.minimum(starts + words, len(parts)), 0))


def signature(text: str | None, words: int = WORDS) -> tuple[int, np.ndarray]:
    """The number of distinct shingles, and one signed 64-bit key per band, equal for equal minima."""
    hashes = hashed(text, words)
    least, short = np.full(BANDS * DEPTH, np.uint32(0xFFFFFFFF)), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), BLOCK):
        keyed = (short[at : at + BLOCK, None] ^ _KEYS[0]) * _KEYS[1]
        np.minimum(least, keyed.min(axis=0), out=least)
    spun = mixed(least.astype(np.uint64)) * _SPIN
    sums = np.concatenate((spun.reshape(BANDS, DEPTH).sum(axis=1), spun.reshape(DEPTH, BANDS).sum(axis=0)))
    return len(hashes), mixed(sums + np.arange(2 * BANDS, dtype=np.uint64)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signature(t.as_py()) for t in batch.column(1)]
        flat = pa.array(np.concatenate([k for _, k in found]) if found else np.zeros(0, dtype=np.int64))
        keys = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, 2 * BANDS), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), keys], ["key", "n", "bands"])
    give_back()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, text in zip(batch.column(0), batch.column(1)):
            found = hashed(text.as_py()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.repeat(node, len(found)), pa.array(found)], ["node", "h"])
    give_back()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hub, mine = None, set()
    for batch in batches:
        u, v, one, other = batch.columns
        alike = []
        for node, a, b in zip(u.to_pylist(), one, other):
            # The pairs of a hub come one after the other.
            if node != hub:
                hub, mine = node, shingles(a.as_py())
            alike.append(similarity(mine, shingles(b.as_py())) >= LEAST)
        alike = pa.array(alike, pa.bool_())
        yield pa.RecordBatch.from_arrays([u.filter(alike), v.filter(alike)], ["u", "v"])
    give_back()


def _possible(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of ``(u, n_u, v, n_v)`` whose numbers of shingles allow the similarity."""
    close = F.least("n_u", "n_v") >= LEAST * F.greatest("n_u", "n_v")
    return pairs.where(close).select("u", "v").distinct()


def _alike(n_u: str, n_v: str, common: Column) -> Column:
    """Whether texts with so many shingles, ``common`` of them shared at most, can reach the similarity."""
    return common + SLACK >= LEAST * (F.col(n_u) + F.col(n_v) - common)


def _sketched(prefix: str, *columns: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in (*columns, *SKETCH)]


def _sketches_near(one: str, other: str) -> Column:
    """Whether the sketches allow that two texts are alike."""
    apart = [F.bit_count(F.col(f"{one}_{c}").bitwiseXOR(F.col(f"{other}_{c}"))) for c in SKETCH]
    return sum(apart[1:], apart[0]) <= APART


def _rooted(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    hubs = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    return freeze(crowd.join(roots, "node").join(hubs, "hub"))


def _linkable(crowd: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """``crowd`` with ``c``, the shingles of a text that others hold too.

    Without buckets that are all joined, and without texts whose other shingles rule out
    that they are alike any text of their buckets.
    """
    buckets = crowd.join(roots, "node").groupBy("b").agg(
        (F.min("root") != F.max("root")).alias("apart"), F.min("n").alias("fewest"), F.count(F.lit(1)).alias("uses")
    )
    buckets = freeze(buckets.where("apart").drop("apart"))
    live = freeze(spread_lookup(crowd, buckets, ["b"], "uses", ["node"], "inner", HOT_BUCKET, PER_SALT))
    # No text with fewer shingles than this can be alike.
    partner = F.greatest(F.min("fewest"), F.ceil(LEAST * F.first("n") - SLACK)).alias("partner")
    left = freeze(live.groupBy("node").agg(F.first("n").alias("n"), partner))
    pieces = texts.join(broadcast_if_small(left.select("node")), "node").mapInArrow(_pieces, "node bigint, h bigint")
    rows = left.count()
    while rows:
        pieces = freeze(pieces)
        single = pieces.groupBy("h").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("held")).where("held = 1")
        own = single.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
        common = left.select("node", "n", "partner").join(own, "node", "left").withColumn("c", F.col("n") - F.coalesce("own", F.lit(0)))
        left = freeze(common.where(_alike("n", "partner", F.col("c"))).drop("own"))
        before, rows = rows, left.count()
        # Fewer and fewer go; whoever stays is laid against the others.
        if rows > ENOUGH * before:
            break
        pieces = pieces.join(broadcast_if_small(left.select("node")), "node", "left_semi")
    if "c" not in left.columns:
        left = left.withColumn("c", F.col("n"))
    return freeze(live.drop("fewest").join(broadcast_if_small(left.select("node", "c")), "node"))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of nodes whose texts are alike; the texts of a hub are copied, not gathered."""
    used = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("uses"))
    hubs = freeze(texts.withColumnRenamed("node", "u").join(used, "u").withColumnRenamed("_text", "_one"))
    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("_text").alias("_other")), "v")
    both = spread_lookup(both, hubs, ["u"], "uses", ["v"], "inner", HOT, PER_SALT)
    both = both.select("u", "v", "_one", "_other").sortWithinPartitions("u")
    return freeze(both.mapInArrow(_verified, "u bigint, v bigint"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` with the components that ``links`` connect made one."""
    if links.isEmpty():
        return roots
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "uv"]
    edges = links.join(ends[0], "u").join(ends[1], "v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    moved = component_roots(edges, []).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return freeze(roots.join(broadcast_if_small(freeze(moved)), "root", "left").select("node", F.coalesce("_to", "root").alias("root")))


def _hubs_met(crowd: DataFrame, roots: DataFrame, seen: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``crowd`` with the hub of each bucket, and the pairs of members and hubs that are not joined."""
    weight = freeze(crowd.groupBy("node").agg(F.sum("size").alias("weight")))
    named, known = F.struct("node", "n", "c", *SKETCH), ("n", "c", *SKETCH)
    hubs = crowd.join(weight, "node").groupBy("b").agg(F.max_by(named, F.struct("weight", "node")).alias("h"), F.count(F.lit(1)).alias("uses"))
    hubs = freeze(hubs.select("b", F.col("h.node").alias("hub"), *[F.col(f"h.{c}").alias(f"hub_{c}") for c in known], "uses"))
    crowd = freeze(spread_lookup(crowd, hubs, ["b"], "uses", ["node"], "inner", HOT_BUCKET, PER_SALT))
    hub = [F.col("hub").alias("u"), *[F.col(f"hub_{c}").alias(f"u_{c}") for c in known]]
    met = _rooted(crowd, roots).where("root != hub_root").select(*hub, F.col("node").alias("v"), *_sketched("v", "n", "c"))
    # The hub stays first: its text is read once for all its pairs.
    pairs = _met(met)
    for old in seen:
        old = old.select(F.col("u").alias("high"), F.col("v").alias("low"))
        pairs = pairs.join(old, (F.greatest("u", "v") == F.col("high")) & (F.least("u", "v") == F.col("low")), "left_anti")
    pairs = freeze(pairs)
    seen.append(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return crowd.drop(*[f"hub_{c}" for c in known]), pairs


def _met(pairs: DataFrame) -> DataFrame:
    """Distinct pairs that sketches and numbers of shingles allow."""
    pairs = pairs.where(_sketches_near("u", "v")).withColumnsRenamed({"u_n": "n_u", "v_n": "n_v"})
    return _possible(pairs.where(_alike("n_u", "n_v", F.least("u_c", "v_c"))))


def joined_to_hubs(crowd: DataFrame, seen: list[DataFrame], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(node, root)`` of the members of buckets, joined by their links to the hubs; see :func:`closed`."""
    roots = freeze(crowd.select("node").distinct().select("node", F.col("node").alias("root")))
    _, pairs = _hubs_met(crowd.withColumn("c", F.col("n")), roots, seen)
    texts = freeze(read(freeze(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())))
    return _merged(roots, _linked(pairs, texts))


def closed(crowd: DataFrame, before: DataFrame, seen: list[DataFrame], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(node, root)`` of all nodes of ``before`` and of the buckets ``crowd``, closed over the links in those.

    ``crowd`` is a frozen table of ``(b, node, size, n)`` and the columns ``SKETCH``, ``size`` the
    members of ``b``. ``seen`` holds the pairs verified before and gets those verified now.
    ``read`` gives the texts ``(node, _text)`` of nodes.
    """
    nodes = freeze(crowd.select("node").distinct())
    texts = freeze(read(nodes))
    roots = freeze(before.unionByName(nodes.select("node", F.col("node").alias("root")).join(before, "node", "left_anti")))
    crowd, pairs = _hubs_met(_linkable(crowd, roots, texts), roots, seen)
    roots = _merged(roots, _linked(pairs, texts))
    # A bucket of two has no other pair.
    low, high, crowd = 0, GROWTH, freeze(crowd.where("size > 2"))
    while True:
        mine = _rooted(crowd, roots)
        member = ["n", "c", "root"]
        apart = mine.where("root != hub_root").select("b", F.col("node").alias("v"), *_sketched("v", *member))
        if apart.isEmpty():
            break
        # A random part of each bucket that grows with the rounds; in the end all of it.
        slot = F.pmod(F.xxhash64("b", "node"), F.col("size"))
        drawn = mine.where((slot >= low) & (slot < high) & (F.col("node") != F.col("hub")))
        drawn = drawn.select("b", F.col("node").alias("u"), *_sketched("u", *member))
        pairs = _met(apart.join(drawn, "b").where("u_root != v_root"))
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        for old in seen:
            pairs = pairs.join(old, ["u", "v"], "left_anti")
        seen.append(freeze(pairs))
        roots = _merged(roots, _linked(seen[-1], texts))
        # What is apart in buckets up to this size has now met all of them.
        crowd, low, high = freeze(crowd.where(F.col("size") > high)), high, high * GROWTH
    return roots


def in_groups(roots: DataFrame) -> DataFrame:
    """Those of ``roots`` whose component has several members."""
    several = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("root")
    return roots.join(several, "root", "left_semi")


def texts_of(rows: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, _text)`` of the ``nodes`` of ``signed`` from ``rows``, joined by ``key``."""
    keys = broadcast_if_small(freeze(signed.join(broadcast_if_small(nodes), "node").select("node", "key")))
    return rows.join(keys, "key").select("node", "_text")


def near_groups(docs: DataFrame, key: str = "key", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(node, key)`` of all rows, and ``(node, root)`` of all that links at 0.8 or more connect to others.

    Texts meet by MinHash bands. Nodes are numbers of this call. Null and blank texts are alike
    and link with each other.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("_text"))
    kind = rows.schema["key"].dataType.simpleString()
    signed = spread(rows).mapInArrow(_signed, f"key {kind}, n bigint, bands array<bigint>")
    signed = freeze(signed.withColumn("node", F.monotonically_increasing_id()))
    member = signed.select("node", "n", F.explode("bands").alias("b"))
    sizes = freeze(member.groupBy("b").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    crowd = spread_lookup(member, sizes.withColumn("uses", F.col("size")), ["b"], "uses", ["node"], "inner", HOT_BUCKET, PER_SALT)
    crowd = freeze(crowd.select("*", *[F.lit(0).cast("bigint").alias(c) for c in SKETCH]))
    seen: list[DataFrame] = []
    read = lambda nodes: texts_of(rows, signed, nodes)
    roots = closed(crowd, joined_to_hubs(crowd, seen, read), seen, read)
    return signed.select("node", "key"), in_groups(roots)
