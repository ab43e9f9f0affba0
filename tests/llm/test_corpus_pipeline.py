from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_packing import PATHS, rebuilt
from tests.llm.test_secrets import brute
from vellum.llm import mixing, quality, secrets
from vellum.llm.queries import MIX, grades


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_groups(texts):
    """Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and the similar pairs of different texts."""
    shingles = {}
    for i, t in texts.items():
        own = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles.setdefault(frozenset(" ".join(own[k : k + 5]) for k in range(max(1, len(own) - 4))), []).append(i)
    sets, pairs = list(shingles), []
    root = {i: min(ids) for ids in shingles.values() for i in ids}
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        near = Counter(j for x in s for j in holders[x])
        for j, both in near.items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                pairs.append((min(shingles[s]), min(shingles[sets[j]])))
        for x in s:
            holders[x].append(k)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            if low != high:
                root = {i: low if r == high else r for i, r in root.items()}
                changed = True
    return root, pairs


def test_stages_on_the_table(spark, sf_dir, tmp_path):
    at = f"{sf_dir}/../sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], at).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(f.columns == docs.columns and f.dtypes == docs.dtypes for f in frames[:-1])
    rows = [[tuple(r) for r in f.collect()] for f in frames]

    model = quality.train(docs, grades(spark, at), grades=3, most=4000)
    features = quality.Features()

    def tail(text):
        where, value = features((text or "").encode())
        return model.tails(np.array([value.astype(float) @ model.weights[where]]))[0, 0]

    assert Counter(rows[1]) == Counter(r for r in rows[0] if tail(r[1]) >= 0.5)
    kept = {r[0] for r in rows[1]}
    assert all(i in kept for i, r in labels.items() if r.quality == 1) and not any(i in kept for i, r in labels.items() if r.quality == 0)

    group, pairs = brute_groups({r[0]: r[1] for r in rows[1]})
    left = {r[0] for r in rows[2]}
    assert Counter(rows[2]) == Counter(r for r in rows[1] if r[0] in left) and len(rows[2]) < len(rows[1])
    assert all(i in left for i, root in group.items() if i == root)  # the smallest of each group stays
    found = [(a, b) for a, b in pairs if not (a in left and b in left)]
    assert len(pairs) >= 5 and len(found) >= 0.9 * len(pairs)  # of texts that resemble each other without being equal

    def redacted(text):
        spans = sorted([(a, b) for _, a, b in brute(text)] + [m.span() for m in re.finditer(secrets.ADDED[0].pattern, text)])
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[secret]"
            at = max(at, b)
        return out + text[at:]

    cleaned = [(r[0], redacted(r[1]), *r[2:4], len(redacted(r[1])) if redacted(r[1]) != r[1] else r[4]) for r in rows[2]]
    assert Counter(rows[3]) == Counter(cleaned) and any("[secret]" in r[1] for r in cleaned)

    text = {r[0]: r[1] for r in rows[3]}
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows[3]:
        size[r[3]] += len(words(r[1]))
    by_doc = Counter()
    for r in rows[4]:
        own = words(r[1])
        by_doc[r[0]] += len(own)
        taken[r[3]] += len(own)
        assert r[1] == text[r[0]] or " ".join(own) in " ".join(words(text[r[0]])) and r[4] == len(r[1])
    assert all(n <= 2 * len(words(text[i])) for i, n in by_doc.items())
    from tests.llm.test_mixing import brute_targets

    assert all(abs(taken[s] - t) <= 16 for s, t in brute_targets(size).items())

    tokenizer = Tokenizer.from_file(PATHS["tokenizer_path"])
    pieces = frames[5].collect()
    wanted = Counter(tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows[4])
    starts = sorted((r for r in pieces), key=lambda r: (r.sequence_id, r.offset))
    got, open_doc = Counter(), []
    for r in starts:  # tasks pack in order, so a document's pieces follow each other
        open_doc += np.frombuffer(bytes(r.tokens), "<u4").tolist()
        if r.start + r.length == r.doc_tokens:
            got[tuple(open_doc)] += 1
            open_doc = []
    assert got == wanted and not open_doc
    assert rebuilt is not None


def test_edge_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(None, None, None, None, None), (None, "token=abcdef0 and words", None, None, 3), (5000, "", "en", "s", 0), (5001, "same text here", "en", None, 14), (5001, "same text here", "en", None, 14), (5002, "w " * 200_000, "en", "long", 400_000)], docs.schema)
    frame = docs.union(extra).union(extra).withColumn("_key", F.lit(1)).withColumn("tails", F.lit("x")).withColumn("shard", F.lit(2))
    now = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.columns == frame.columns and out.count() > 0
        now = stage(spark, now, sf_dir)
        assert stage(spark, frame.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.packing_stage(spark, now, sf_dir).count() > 0
    once = corpus_pipeline.simhash_stage(spark, frame, sf_dir).collect()
    assert len(once) == len({(r.doc_id, r.text) for r in once})


def test_columns_come_back(spark, sf_dir):
    """Columns of the stages' own names keep their names, types and values."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    names = ("_key", "_text", "_piece", "copies", "parts", "_first", "key", "row", "findings", "blob", "size", "node", "fps", "first", "words", "expected_grade", "cut", "piece")
    frame = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names], F.create_map(F.lit("a"), F.col("doc_id")).alias("a map"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.dtypes == frame.dtypes
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names) and all(r["a map"] == {"a": r.doc_id} for r in rows)


def test_near_duplicates_on_a_larger_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet")
    group, pairs = brute_groups({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    left = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, sf_dir).select("doc_id").collect()}
    assert all(i in left for i, root in group.items() if i == root)
    found = sum(not (a in left and b in left) for a, b in pairs)
    assert len(pairs) >= 40 and found >= 0.9 * len(pairs)


def test_mixing_of_a_row_that_repeats(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "CROWD", 50)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    hot = spark.createDataFrame([(1, "one text of six words here", "en", "hot", 26)] * 700, docs.schema)
    out = corpus_pipeline.mixing_stage(spark, docs.union(hot), sf_dir)
    n = sum(len(words(r.text)) for r in out.where("source = 'hot'").collect())
    takes = mixing.mix(docs.union(hot), **MIX).where("doc_id = 1 AND size = 6").agg(F.sum("taken")).first()[0]
    assert n == takes > 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
