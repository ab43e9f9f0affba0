"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors become integer codes. Candidates are dealt to buckets by length, queries to blocks
of bounded size. A first pass over the bucket of the longest vectors and over that of the
block's own length gives every query a score that its k-th best cannot fall below. A block
is paired with no bucket whose greatest length cannot reach any of its queries' scores, and
only ids travel until that is known. In a pair the score and the bucket's greatest length
give the least cosine that a member needs: above one the bucket is skipped, a high one
lets coordinates be pruned, a low one only lengths. Products of what is left are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import durable

#: Codes beyond this are held at it, so that they fit a long.
LARGEST = 1 << 62
#: Cosine from which coordinates are pruned, and how many of a query's largest.
COORD_FROM, COORDS = 0.5, 3


def _codes(column: pa.Array, scale: float) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for row in column.cast(pa.list_(pa.float64())):
        values = row.values
        if values is None or values.null_count:
            out.append(None)
            continue
        x = values.to_numpy(zero_copy_only=False)
        out.append(np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype(np.int64) if len(x) and np.isfinite(x).all() else None)
    return out


def quantise(vectors: DataFrame, *, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """Rows (id, dim, length, code): floor(scale * x) as little-endian 64-bit integers.

    Rows whose id or vector is null, or whose vector is empty or holds a null or
    non-finite component, are left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(batch.column(1), scale)
            keep = [i for i, c in enumerate(codes) if c is not None]
            kept = [codes[i] for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([len(c) for c in kept], pa.int32()), pa.array([float(np.sqrt((c.astype(np.float64) ** 2).sum())) for c in kept], pa.float64()), pa.array([c.astype("<i8").tobytes() for c in kept], pa.binary())], names=["id", "dim", "length", "code"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL")
    return rows.mapInArrow(scan, "id bigint, dim int, length double, code binary")


def _narrow(codes: np.ndarray) -> tuple[str, bytes]:
    most = int(np.abs(codes).max(initial=0))
    kind = next(k for k, top in (("<i1", 1 << 7), ("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < top)
    return kind, codes.astype(kind).tobytes()


def _blocks(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Blocks of at most ``size`` rows of one dimension, by descending length: (dim, part, longest, kind, ids, codes)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kind, codes = _narrow(np.stack([np.frombuffer(c, "<i8") for _, _, _, c in held]))
            ids = np.array([h[0] for h in held], "<i8").tobytes()
            row = [[held[0][1]], [max(h[2] for h in held)], [kind], [ids], [codes]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.float64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["dim", "longest", "kind", "ids", "codes"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (held[0][1] != row[1] or len(held) == size):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    dealt = rows.repartitionByRange(parts, "dim", F.col("length").desc(), "id").sortWithinPartitions("dim", F.col("length").desc(), "id")
    return dealt.mapInArrow(scan, "dim int, longest double, kind string, ids binary, codes binary").withColumn("no", F.monotonically_increasing_id())


def _matrix(kind: str, codes: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(codes, kind).reshape(rows, -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: floats where all partial sums are exact in them, else whole numbers held within a long."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1]
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search(qids: np.ndarray, q: np.ndarray, least: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, last: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's index, ids, scores) of up to ``k`` best members of a bucket that reach the query's ``least`` score.

    ``c`` is by descending length; ``least`` is minus infinity where no score is known.
    Members of just that score count up to the id ``last``: k others have smaller ones.
    """
    last = np.full(len(q), np.iinfo(np.int64).max) if last is None else last
    length = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    q_length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    unit = None
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(least > 0, least / (q_length * length.max(initial=0)), -1.0)  # what the bucket's longest member needs
        reach = np.where(least > 0, least / q_length, 0.0)
    plain: list[tuple[int, int]] = []
    for i in range(len(q)):
        if cosine[i] > 1 + 1e-9:
            continue
        # lengths: members below least / |q| cannot reach it
        upto = int(np.searchsorted(-length, -(reach[i] * (1 - 1e-9)), "right")) if least[i] > 0 else len(c)
        if not upto:
            continue
        if cosine[i] < COORD_FROM:
            plain.append((i, upto))
            continue
        # coordinates: an angle within arccos(cosine) of the query bounds each coordinate
        unit = c / np.maximum(length, 1e-300)[:, None] if unit is None else unit
        own, reach_by = q[i] / q_length[i], np.arccos(min(1.0, cosine[i]))
        mask = np.ones(upto, bool)
        for f in np.argsort(-np.abs(own))[:COORDS]:
            angle = np.arccos(np.clip(own[f], -1, 1))
            mask &= (unit[:upto, f] >= np.cos(min(np.pi, angle + reach_by)) - 1e-9) & (unit[:upto, f] <= np.cos(max(0.0, angle - reach_by)) + 1e-9)
        at = np.flatnonzero(mask)
        if len(at):
            yield from _best(i, qids[i], cids[at], _products(q[i : i + 1], c[at])[0], least[i], k, last[i])
    for start in range(0, len(plain), 64):
        some = plain[start : start + 64]
        upto = max(n for _, n in some)
        scores = _products(q[[i for i, _ in some]], c[:upto])
        for (i, n), row in zip(some, scores, strict=True):
            yield from _best(i, qids[i], cids[:n], row[:n], least[i], k, last[i])


def _best(i: int, own: int, ids: np.ndarray, scores: np.ndarray, least: float, k: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    keep = (ids != own) & ((scores > least) | (scores == least) & (ids <= last))
    ids, scores = ids[keep], scores[keep]
    if len(ids) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= floor
        ids, scores = ids[keep], scores[keep]
    if len(ids):
        order = np.lexsort((ids, -scores))[:k]
        yield i, ids[order], scores[order]


#: What a query knows: the score that its k-th best reaches, the id up to which that score counts, and the query's length.
KNOWN = np.dtype([("least", "<f8"), ("last", "<i8"), ("length", "<f8")])


def _floors(k: int):
    """Arrow rows (q_no, known) of what each block's queries know from one bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, cids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q, c = _matrix(row["q_kind"], row["q_codes"], len(qids)), _matrix(row["kind"], row["codes"], len(cids))
                known = np.zeros(len(qids), KNOWN)
                known["least"], known["last"] = -np.inf, np.iinfo(np.int64).max
                known["length"] = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                for i, ids, scores in search(qids, q, known["least"].copy(), cids, c, k):
                    if len(scores) == k:
                        exact = abs(int(scores[-1])) < 1 << 53  # beyond, a score as a float says less
                        known[i] = (scores[-1] if exact else np.nextafter(float(scores[-1]), -np.inf), ids[-1] if exact else known["last"][i], known["length"][i])
                yield pa.RecordBatch.from_arrays([pa.array([row["q_no"]], pa.int64()), pa.array([known.tobytes()], pa.binary())], names=["q_no", "known"])

    return scan


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of what a block knows from several buckets, and the length that a bucket must have to matter to it."""
    for batch in batches:
        out, need = [], []
        for row in batch.column(1).to_pylist():
            parts = [np.frombuffer(x, KNOWN) for x in row]
            best = parts[0].copy()
            for other in parts[1:]:
                better = (other["least"] > best["least"]) | (other["least"] == best["least"]) & (other["last"] < best["last"])
                best[better] = other[better]
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(best["least"] > 0, best["least"] / best["length"], -1.0)
            out.append(best.tobytes())
            need.append(float(reach.min()) * (1 - 1e-9))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(need, pa.float64())], names=["q_no", "known", "need"])


def _hits(k: int):
    """Arrow rows (query_id, vec_id, score) of one pair of block and bucket each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, cids, known = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], KNOWN)
                q, c = _matrix(row["q_kind"], row["q_codes"], len(qids)), _matrix(row["kind"], row["codes"], len(cids))
                parts = [(np.full(len(s), qids[i]), n, s) for i, n, s in search(qids, q, known["least"], cids, c, k, known["last"])]
                columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "vec_id", "score"])

    return scan


def _ranks(buckets: DataFrame, asked: DataFrame, value: str, *, equal: bool) -> DataFrame:
    """``asked`` with ``upto``: how many buckets of its dimension are longer than ``value``, or as long.

    One window over a row a bucket and a row a block, so its size is that of neither's vectors.
    """
    every = [F.col(c) for c in asked.columns]
    rows = buckets.select("dim", F.col("longest").alias("_value"), F.lit(1).alias("_one")).unionByName(asked.withColumn("_value", F.col(value)).withColumn("_one", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy("dim").orderBy(F.col("_value").desc(), F.col("_one").desc() if equal else F.col("_one").asc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("_one").over(before)).where("_one = 0").select(*every, "upto")


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: float = 64.0, bucket: int = 8192, block: int = 512) -> DataFrame:
    """The ``k`` candidates of highest integer inner product for each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with
    another id and as many components. Returns query_id, rank (from 1), vec_id and score,
    ties to the smaller id. See `quantise` for what takes no part. Of rows that repeat a
    query's id the smallest code is the query; repeated candidates count as rows. Scores
    beyond a long are held at its ends. Other columns are ignored; empty input, empty result.
    """
    hits = pairs(vectors, id_col=id_col, vector_col=vector_col, k=k, every=every, scale=scale, bucket=bucket, block=block).mapInArrow(_hits(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distinguished(codes: DataFrame, k: int) -> DataFrame:
    """The candidates without those equal vectors that can be nobody's: of equal codes the ``k`` + 1 smallest ids come first for every query, and ``k`` rows of an id suffice."""
    equal = Window.partitionBy("dim", "code").orderBy("id")
    kept = codes.withColumn("_at", F.dense_rank().over(equal)).where(F.col("_at") <= k + 1).drop("_at")
    again = Window.partitionBy("dim", "code", "id").orderBy("length")
    return kept.withColumn("_at", F.row_number().over(again)).where(F.col("_at") <= k).drop("_at")


def pairs(vectors: DataFrame, *, id_col: str, vector_col: str, k: int, every: int, scale: float, bucket: int, block: int) -> DataFrame:
    """The pairs of query block and bucket that `top_k` has to look at, with their codes and what the queries know."""
    codes = durable(quantise(vectors, id_col=id_col, vector_col=vector_col, scale=scale))
    rows = codes.count()
    buckets = durable(_blocks(distinguished(codes, k), bucket, max(1, -(-rows // bucket))))
    asked = codes.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "code", "length")).alias("q")).select("id", "q.dim", "q.length", "q.code")
    asked = durable(_blocks(asked, block, max(1, -(-rows // (every * block)))).select(F.col("no").alias("q_no"), "dim", F.col("longest").alias("q_longest"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes")))
    ranked = durable(buckets.select("no", "dim", "longest").withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.col("longest").desc(), "no"))))
    counts = ranked.groupBy("dim").agg(F.max("rank").alias("all"))

    def with_codes(wanted: DataFrame) -> DataFrame:
        found = wanted.join(ranked.select("dim", "rank", "no"), ["dim", "rank"]).drop("dim", "rank")
        return found.join(asked.drop("dim", "q_longest"), "q_no").join(buckets.select("no", "kind", "ids", "codes"), "no")

    # the first bucket, and the first that is no longer than the block: its own, where many vectors are equal that of the smallest ids
    own = _ranks(ranked, asked.select("q_no", "dim", "q_longest"), "q_longest", equal=False).join(counts, "dim")
    first = own.select("q_no", "dim", F.explode(F.array_distinct(F.array(F.lit(1).cast("long"), F.least(F.col("upto") + 1, "all").cast("long")))).alias("rank"))
    known = with_codes(first).mapInArrow(_floors(k), "q_no bigint, known binary").groupBy("q_no").agg(F.collect_list("known").alias("known"))
    known = durable(known.mapInArrow(_joined, "q_no bigint, known binary, need double"))
    reached = _ranks(ranked, known.join(asked.select("q_no", "dim"), "q_no").select("q_no", "dim", "need"), "need", equal=True).where("upto > 0")
    wanted = reached.select("q_no", "dim", F.explode(F.sequence(F.lit(1).cast("long"), "upto")).alias("rank"))
    return with_codes(wanted).join(known.select("q_no", "known"), "q_no")


def oracle(*, k: int = 20, every: int = 20, scale: float = 64.0) -> str:
    """DuckDB SQL for `top_k` over embeddings."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.code, c.code)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND len(c.code) = len(q.code))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
"""
