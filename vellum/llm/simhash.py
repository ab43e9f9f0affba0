"""SimHash near-duplicate detection with covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles.
Candidates come from structured bit masks: bit i carries a nonzero vector m(i) of
GF(2)^(r+1), and the table of a nonzero v keeps the bits with <m(i), v> = 1. For any r
positions some v is orthogonal to all of their vectors, so every pair within radius r
agrees on the kept bits of at least one of the 2^(r+1) - 1 tables.

Two bits of a plain majority stand for a shingle similarity of about 0.99. Where the
similarity is lower, `similar` takes several fingerprints a text: each ranks the shingles
by a hash of its own and lets a shingle's vote fall by a constant factor with its rank, so
that two bits tolerate changes in the lower ranks and several fingerprints those in the
higher. The same masks find the candidates, and their shingles are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import connected, durable, row_key, stored, text_bytes

BITS = 64
#: Shingles whose bits are counted at once; bounds the memory of very long texts.
BLOCK = 1 << 17


def _hashes(text: bytes, width: int) -> np.ndarray:
    return _shingles(text.lower().split(), width)


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width]))
    parts = map(joined.__getitem__, map(slice, starts.tolist(), (ends[width - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(words) - width + 1)


def _counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        # per byte position a histogram of its values, then how often each bit is set
        octets = part.astype("<u8").view(np.uint8).reshape(-1, 8)
        if len(part) < 512:
            total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            for k in range(8):
                total[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _OCTET
    return total


_OCTET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_WEIGHT = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 ``text``; zero where it has no words."""
    hashes = _hashes(text, width)
    return int(_WEIGHT[_counts(hashes) * 2 > len(hashes)].sum(dtype=np.uint64)) if len(hashes) else 0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (id, fp long, then the ``carry`` columns): one row per input row; null texts have no words."""
    kept = [F.col(c) for c in carry]
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("id"), *kept)
    schema = "fp bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x, width) for x in text_bytes(batch.column(0))], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])

    return rows.mapInArrow(scan, schema).select("id", "fp", *kept)


def masks(radius: int, within: int = -1) -> list[int]:
    """Bit masks of the covering tables over the bits of ``within``, as signed 64-bit integers."""
    order = (1 << (radius + 1)) - 1
    bits = [i for i in range(BITS) if within >> i & 1]
    found = []
    for v in range(1, order + 1):
        mask = sum(1 << i for n, i in enumerate(bits) if bin((1 + n % order) & v).count("1") % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _tables(radius: int) -> Column:
    """The buckets of a fingerprint ``fp``: (t, key) of every table."""
    return F.array(*[F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for n, m in enumerate(masks(radius))])


def _subtables(radius: int) -> Column:
    """Of a row (t, fp) the buckets of the tables over the bits that table t leaves out: pairs of one bucket differ in these only."""
    each = [F.array(*[F.struct(F.lit(n).alias("s"), F.col("fp").bitwiseAND(_long(m)).alias("sub")) for n, m in enumerate(masks(radius, ~outer))]) for outer in masks(radius)]
    return F.element_at(F.array(*each), F.col("t") + 1)


def _by_hub(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) of members within the radius of their bucket's hub, its smallest fingerprint, and the members of buckets that hold others."""
    # fingerprints are distinct and most buckets hold one, so combining first saves nothing: one exchange, and no bucket is larger than its open bits allow
    whole = Window.partitionBy("bucket")
    placed = rows.select("*", F.min("fp").over(whole).alias("hub"), F.min_by("node", "fp").over(whole).alias("hub_node"), F.count("*").over(whole).alias("n")).where("n > 1").drop("n")
    seen = durable(placed.withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("hub")))))
    near = seen.where((F.col("d") <= radius) & (F.col("fp") != F.col("hub"))).select(F.col("node").alias("u"), F.col("hub_node").alias("v"))
    crowded = seen.groupBy("bucket").agg(F.max("d").alias("most"), F.count("*").alias("n")).where((F.col("most") > radius) & (F.col("n") > 2))
    return near, seen.drop("hub", "hub_node", "d").join(crowded.select("bucket"), "bucket", "left_semi")


def links(distinct: DataFrame, *, radius: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` whose closure is that of all pairs within ``radius``.

    Where rows have a ``group`` and a ``node``, fingerprints are distinct and linked within
    each group, and edges are between nodes.

    Each table's bucket has its smallest fingerprint as hub. Members within the radius
    of the hub get an edge to it. If a bucket also holds others, its members are dealt to
    covering tables of the bits that the bucket leaves open, and once more to hubs. Of
    buckets that hold others even then, the exact way is taken for all members: two
    fingerprints at distance d <= 2s share a string at distance s from both, so members are
    dealt to the strings within s = ceil(radius / 2) and each such set, at most as large as
    a Hamming ball, is a chain. No pairs are emitted. Buckets are told apart by 64-bit
    hashes; two that meet in one only make it crowded.
    """
    if "group" not in distinct.columns:
        return links(distinct.select("fp", F.lit(0).alias("group"), F.col("fp").alias("node")), radius=radius)
    rows = distinct.select("fp", "node", "group", F.explode(_tables(radius)).alias("b"))
    rows = rows.select(F.xxhash64("group", "b.t", "b.key").alias("bucket"), "fp", "node", F.col("group").cast("int").alias("group"), F.col("b.t").cast("int").alias("t"))
    first, crowded = _by_hub(rows, radius)
    crowded = crowded.select("bucket", "fp", "node", "group", F.explode(_subtables(radius)).alias("b"))
    second, crowded = _by_hub(crowded.select(F.xxhash64("bucket", "b.s", "b.sub").alias("bucket"), "fp", "node", "group"), radius)
    members = crowded.select("group", "fp", "node").distinct()
    one = [1 << i if i < 63 else -(1 << 63) for i in range(BITS)]
    ball = F.array(_long(0), *[_long(b) for b in one])
    steps = (radius + 1) // 2
    spread = members.select("group", F.struct("fp", "node").alias("x"), F.col("fp").alias("c"))
    for _ in range(steps):
        spread = spread.select("group", "x", F.explode(ball).alias("e"), "c").select("group", "x", F.col("c").bitwiseXOR(F.col("e")).alias("c"))
    if steps > 1:
        spread = spread.distinct()
    sets = spread.groupBy("group", "c").agg(F.sort_array(F.collect_list("x")).alias("all")).where(F.size("all") > 1)
    if radius % 2:  # an odd radius lets a ball hold pairs one bit too far
        pair = F.explode(F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (y["fp"] > x["fp"]) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius)), lambda y: F.struct(x["node"].alias("u"), y["node"].alias("v"))))))
        exact = sets.select(pair.alias("p")).select("p.u", "p.v")
    else:
        exact = sets.select(F.explode(F.slice("all", F.lit(2), F.size("all") - 1)["node"]).alias("u"), F.col("all")[0]["node"].alias("v"))
    return first.union(second).union(exact).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """Components of the documents whose fingerprints link within ``radius`` bits.

    Returns one row per input row: ``id_col``, fingerprint (16 lowercase hex digits),
    component_id, the smallest id reachable through links, the row's own included, root
    (the component's first fingerprint) and the ``carry`` columns. Texts that are null,
    empty or without words have fingerprint zero and link like any other. Repeated rows
    stay repeated; null ids never become a component id unless a component has no other.
    Other columns are ignored. Empty input, empty result.
    """
    prints = durable(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, carry=carry))
    # in two steps, so that no task reads a row of a frequent fingerprint from every other
    distinct = prints.groupBy("fp", (F.spark_partition_id() % 16).alias("part")).agg(F.min("id").alias("least"))
    distinct = durable(distinct.groupBy("fp").agg(F.min("least").alias("least")))
    roots = connected(links(distinct.select("fp"), radius=radius))
    roots = roots.union(roots.select("root", "root").distinct())
    parts = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = parts.groupBy("root").agg(F.min("least").alias("component"))
    joined = parts.join(least, "root").select("fp", "component", "root")
    found = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component"))
    by_print = durable(distinct.join(joined, "fp", "left").select("fp", found.alias("component_id"), F.coalesce("root", "fp").alias("root")))  # a plain side, so that a hot fingerprint's rows can be split
    digits = [F.lower(F.lpad(F.hex(c), 16, "0")).alias(name) for c, name in (("fp", "fingerprint"), ("root", "root"))]
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), digits[0], "component_id", digits[1], *[F.col(c) for c in carry])


#: How a shingle's vote falls with its rank, and how many ranks vote; what is beyond weighs less than a millionth.
DECAY, RANKS = 0.58, 26
_VOTES = DECAY ** np.arange(RANKS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (that of the SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranked_fingerprints(hashes: np.ndarray, families: int) -> np.ndarray:
    """``families`` fingerprints of a set of shingle hashes; zeros for an empty set."""
    if not len(hashes):
        return np.zeros(families, np.uint64)
    seeds = np.arange(1, families + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    best = None
    for at in range(0, len(hashes), BLOCK):
        order = _mixed(hashes[None, at : at + BLOCK] + seeds[:, None])
        if order.shape[1] > RANKS:
            order = np.partition(order, RANKS - 1, axis=1)[:, :RANKS]
        best = order if best is None else np.sort(np.concatenate((best, order), axis=1), axis=1)[:, :RANKS]
    best = np.sort(best, axis=1)
    bits = np.unpackbits(np.ascontiguousarray(_mixed(best)).astype("<u8").view(np.uint8).reshape(families, -1, 8), axis=2, bitorder="little")
    votes = np.einsum("r,frb->fb", _VOTES[: best.shape[1]], bits.astype(np.float64) * 2 - 1)
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _prints(batches: Iterator[pa.RecordBatch], width: int, families: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sizes, prints = [], [], []
        for x in text_bytes(batch.column(0)):
            words = x.lower().split()
            shingles = np.unique(_shingles(words, width))
            texts.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sizes.append(len(shingles))
            prints.append(ranked_fingerprints(shingles, families).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], names=[*batch.schema.names[1:], "words", "size", "fps"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(_hashes(x, width) >> np.uint64(32)).astype("<u4").tobytes() for x in text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
            low, high = sorted((len(x), len(y)))
            if low >= similarity * high:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])


#: Edges that one hub's shingles are sent out for at once.
FAN = 256


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, families: int = 12, radius: int = 2) -> DataFrame:
    """Which rows are the first of their group of similar texts.

    Texts of equal words are one text. Two texts are linked if they are candidates, by one
    of ``families`` fingerprints that differ in ``radius`` bits at most, and their sets of
    ``width``-word shingles (as 32-bit hashes) have a Jaccard similarity of ``similarity`` or more; groups are
    the closure. Candidates are found, not proved: at a similarity of exactly 0.8 a pair is
    one with a probability of about 0.99, at 0.9 of nearly one, and each member of a bucket is
    compared with its hub only. No text is compared with more than a few others.

    Returns distinct (key, first): `row_key` of every distinct row, and whether it stays
    for its group: of the smallest id, null ids last; kept in the checkpoint folder. Null and empty texts are one group.
    Shorter texts than ``width`` words have their whole sequence as shingle. Empty input,
    empty result.
    """
    keyed = docs.select(F.col(text_col).cast("string").alias("text"), row_key(docs).alias("key"), F.col(id_col).alias("id"))
    kinds = f"key struct<a:bigint,b:bigint>, id {docs.schema[id_col].dataType.simpleString()}"
    prints = stored(keyed.mapInArrow(partial(_prints, width=width, families=families), f"{kinds}, words binary, size bigint, fps array<bigint>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    texts = stored(prints.groupBy("words").agg(first, F.min("size").alias("size"), F.min("fps").alias("fps")).withColumn("node", F.monotonically_increasing_id()))

    marked = texts.select("node", F.posexplode("fps").alias("group", "fp"))
    # each fingerprint draws a hub of its own, so that one text that is like few others misleads one of them only
    leads = stored(marked.groupBy("group", "fp").agg(F.min_by("node", F.xxhash64("group", "node")).alias("node"), F.count("*").alias("n")))
    shared = leads.where("n > 1").select("group", "fp", F.col("node").alias("lead"))
    same = marked.join(shared, ["group", "fp"]).where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    near = links(leads.select("group", "fp", "node"), radius=radius)
    pairs = same.union(near).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    # sets whose sizes differ by more than the similarity allows cannot have it
    u_size, v_size = (texts.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size")) for c in ("u", "v"))
    pairs = pairs.join(u_size, "u").join(v_size, "v").where(F.least("u_size", "v_size") >= F.greatest("u_size", "v_size") * similarity)
    pairs = stored(pairs.select("u", "v"))

    wanted = stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(texts.select("node", F.col("first.key").alias("key")), "node"))
    bodies = docs.select(row_key(docs).alias("key"), F.col(text_col).cast("string").alias("text")).join(wanted.hint("merge"), "key").groupBy("key").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")
    sets = stored(bodies.mapInArrow(partial(_sets, width=width), "node bigint, set binary"))
    busy = stored(pairs.groupBy("v").count().where(F.col("count") > FAN).select("v", F.ceil(F.col("count") / FAN).alias("parts")))
    salted = pairs.join(busy, "v", "left").select("u", "v", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("u"), F.col("parts"))).otherwise(F.lit(0)).alias("salt"))
    hubs = sets.join(busy.withColumnRenamed("v", "node"), "node", "left").select(F.col("node").alias("v"), F.col("set").alias("v_set"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("salt"))
    both = salted.join(hubs, ["v", "salt"]).join(sets.select(F.col("node").alias("u"), F.col("set").alias("u_set")), "u").select("u", "v", "u_set", "v_set")
    roots = connected(both.mapInArrow(partial(_compared, similarity=similarity), "u bigint, v bigint"))

    placed = texts.select("node", "first").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    heads = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"), F.lit(True).alias("is_first"))
    return stored(prints.select("key").distinct().join(heads, "key", "left").select("key", F.coalesce("is_first", F.lit(False)).alias("first")))


def deduplicate(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of ``docs`` that `similar` calls first, each once, as they are. Texts travel once more, equal rows combined before."""
    first = similar(docs, **how).where("first").select("key")
    cells = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    once = docs.select(row_key(docs).alias("key"), cells).groupBy("key").agg(F.first("row").alias("row"))
    return once.join(first.hint("merge"), "key", "left_semi").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
