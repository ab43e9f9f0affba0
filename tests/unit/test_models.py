from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import decode, layout
from vellum.operators import lexicon as L
from vellum.operators import lm as N
from vellum.operators import measures as Q
from vellum.operators import search as S


def brute_model(texts, order, least):
    counts = {}
    for t in texts:
        for n in range(1, order + 1):
            for i in range(len(t) - n + 1):
                key = (t[i : i + n - 1], t[i + n - 1])
                counts[key] = counts.get(key, 0) + 1
    kept = {k: c for k, c in counts.items() if not k[0] or c >= least}
    total = {}
    for (ctx, _), c in kept.items():
        total[ctx] = total.get(ctx, 0) + c
    return {k: math.log10(c / total[k[0]]) for k, c in kept.items()}


def brute_score(model, text, order):
    out = 0.0
    for i, ch in enumerate(text):
        ctx = text[max(0, i - order + 1) : i]
        if ("", ch) not in model:
            out += -12.0
            continue
        for s in range(len(ctx) + 1):
            if (ctx[s:], ch) in model:
                out += model[ctx[s:], ch] + s * math.log10(0.4)
                break
    return out


def test_character_model_and_scores(spark):
    texts = ["корова мычала. " * 50, "коза", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    table = N.model(N.char_ngrams(frame, 4), 2)
    want = brute_model(texts, 4, 2)
    assert {(r.context, r.next): pytest.approx(r.logprob) for r in table.collect()} == want
    asked = ["корова", "мычит", "Ж", ""]
    got = {r.id: r.logprob for r in N.text_logprobs(spark.createDataFrame(list(enumerate(asked)), "id long, text string"), table, 4).collect()}
    assert got == {i: pytest.approx(brute_score(want, t, 4)) for i, t in enumerate(asked)}
    score = decode.char_scorer([(r.context, r.next, r.logprob) for r in table.collect()], 4)
    assert sum(score("корова"[:i], c) for i, c in enumerate("корова")) == pytest.approx(got[0])
    weighted = N.char_ngrams(N.corpus_mix(frame.limit(1), frame.limit(0), spark.createDataFrame([("аб",)], "text string"), 3), 1, weight="weight")
    assert {r.next: r["count"] for r in weighted.collect()}["к"] == 150


GRAPHEMES = ["", "а", "б", " "]


def lines(spark, *frames):
    return spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "line_id long, frames array<array<double>>")


def test_greedy_and_candidates(spark):
    one = [[0.1, 0.8, 0.1, 0.0], [0.1, 0.8, 0.1, 0.0], [0.9, 0.05, 0.05, 0.0], [0.1, 0.8, 0.1, 0.0], [0.0, 0.1, 0.9, 0.0]]
    rows = lines(spark, one, [])
    assert {r.line_id: r.t for r in rows.select("line_id", decode.greedy(F.col("frames"), GRAPHEMES).alias("t")).collect()} == {0: "ааб", 1: ""}
    c = rows.where("line_id = 0").select(decode.frame_candidates(F.get("frames", F.lit(0)), 3, 0.5).alias("a"), decode.frame_candidates(F.get("frames", F.lit(2)), 2).alias("b")).first()
    assert [(x.label, round(10**x.log, 3)) for x in c.a] == [(1, 0.8)] and [x.label for x in c.b] == [0, 1]


def brute_readings(frames):
    """Probability of every reading by all label sequences."""
    out = {(): {"": 1.0}}
    paths = {(): 1.0}
    for f in frames:
        paths = {(*p, k): w * f[k] for p, w in paths.items() for k in range(len(f)) if f[k] > 0}
    out = {}
    for p, w in paths.items():
        text, last = "", 0
        for k in p:
            if k != last and k:
                text += GRAPHEMES[k]
            last = k
        out[text] = out.get(text, 0.0) + w
    return out


def test_beam_sums_over_alignments(spark):
    rng = random.Random(3)
    frames = []
    for _ in range(5):
        w = [rng.random() + 0.01 for _ in range(4)]
        frames.append([x / sum(w) for x in w])
    want = sorted(brute_readings(frames).items(), key=lambda x: -x[1])[:5]
    wide = decode.Beam(width=500, top_k=4, alpha=0.0, beta=0.0, word_bonus=0.0, prune=99.0)
    got = decode.decode_lines(lines(spark, frames, []), GRAPHEMES, settings=wide, n=5).collect()
    assert [(r.text, pytest.approx(10**r.acoustic)) for r in got if r.line_id == 0] == want and [(r.rank, r.text) for r in got if r.line_id == 1] == [(1, "")]


def test_language_and_words_move_the_choice(spark):
    unsure = [[0.0, 0.52, 0.48, 0.0]]
    lm = [("", "а", -2.0), ("", "б", -0.1)]
    plain = decode.decode_lines(lines(spark, unsure), GRAPHEMES, settings=decode.Beam(alpha=0, beta=0, word_bonus=0), n=1).first()
    by_lm = decode.decode_lines(lines(spark, unsure), GRAPHEMES, settings=decode.Beam(alpha=1, beta=0, word_bonus=0), lm=(lm, 2), n=1).first()
    by_word = decode.decode_lines(lines(spark, unsure), GRAPHEMES, settings=decode.Beam(alpha=0, beta=0.1), known=frozenset({"б"}), n=1).first()
    assert (plain.text, by_lm.text, by_word.text) == ("а", "б", "б") and by_word.words == 0.0


def test_second_pass(spark):
    schema = "line_id long, rank int, text string, score double, acoustic double, lm_score double, n_words int, all_known boolean"
    rows = [(1, 1, "аб", -1.0, -0.2, -9.0, 1, True), (1, 2, "вг", -1.1, -0.2, -1.0, 1, True), (2, 1, "аб", -1.0, -0.2, -9.0, 1, False), (2, 2, "вг", -1.1, -0.2, -1.0, 1, True), (3, 1, "аб", -1.0, -9.0, -9.0, 1, True), (3, 2, "вг", -1.1, -0.2, -1.0, 1, True), (4, 1, "аб", -1.0, -9.0, 0.0, 1, False)]
    frame = spark.createDataFrame(rows, schema)
    assert {r.line_id: r.text for r in N.rescore(frame).collect()} == {1: "аб", 2: "вг", 3: "вг", 4: "аб"}
    assert {r.line_id: r.changed for r in N.rescore(frame, guard=False).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_error_rates(spark):
    pairs = spark.createDataFrame([("дед", "дет"), ("", ""), ("", "x"), ("не знаю", "незнаю"), (None, None)], "reference string, hypothesis string")
    got = [(r.cer, r.wer) for r in Q.row_rates(Q.pair_counts(pairs)).collect()]
    assert got == [(pytest.approx(1 / 3), 1.0), (0.0, 0.0), (1.0, 1.0), (pytest.approx(1 / 7), 1.0), (0.0, 0.0)]
    row = Q.rates(Q.pair_counts(spark.createDataFrame([("ab", "ab"), ("cd", "cx")], "reference string, hypothesis string"))).first()
    assert (row.cer, row.lines) == (0.25, 2)
    rows = spark.createDataFrame([("нож", "пож"), ("нос", "пос"), ("дом", "дам"), ("x", "x"), (None, "a")], "predicted string, corrected string")
    assert [(r.recognized, r.correct, r.n) for r in Q.confusions(rows).collect()] == [("н", "п", 2)]


def test_verdicts(spark):
    words = ["дом", "домъ", "новаго", "кто-то", "кто-нибудь", "5кг", "12", "я", "Анна", "Анна-дом", "зю", "дом-зю"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    lists = [spark.createDataFrame([(w,) for w in ws], "word string") for ws in (["дом", "нового", "кто", "то"], ["кто-нибудь"], ["анна"])]
    got = {r.word: r.verdict for r in L.verdicts(frame, lists[0], extra=lists[1], author=lists[2]).collect()}
    assert got == {"дом": "known", "домъ": "known", "новаго": "known", "кто-то": "known", "кто-нибудь": "known", "5кг": "known", "12": "known", "я": "known", "Анна": "author", "Анна-дом": "author", "зю": "unknown", "дом-зю": "unknown"}
    lines_ = spark.createDataFrame([(1, "дом зю, Анна", False), (2, "зю зю", True), (3, "зю", False)], "line_id long, text string, words_stale boolean")
    boxes = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z"), (2, 0, "дом"), (2, 1, "Анна"), (3, 0, "дом"), (3, 1, "...")], "line_id long, position int, text string")
    verdict = L.verdicts(frame.union(spark.createDataFrame([("x",), ("y",), ("z",)], "word string")), lists[0], author=lists[2])
    by_box, by_line = L.annotate(lines_, boxes, verdict)
    assert {(r.line_id, r.position): (r.in_lexicon, r.author_only) for r in by_box.collect()} == {(1, 0): (True, False), (1, 1): (False, False), (1, 2): (True, True), (2, 0): (True, False), (2, 1): (True, True), (3, 0): (True, False), (3, 1): (None, False)}
    assert {r.line_id: (r.oov_words, r.oov_count) for r in by_line.collect()} == {1: (["зю"], 1), 2: (["зю", "зю"], 2), 3: (["зю"], 1)}


def test_line_breaks(spark):
    pages = [(1, 0, "он слуша-"), (1, 1, "лась потом"), (1, 2, "звакуи"), (1, 3, "ровать всех ямы"), (1, 4, "во дворе"), (2, 0, "во двор")]
    frame = spark.createDataFrame(pages, "page_id long, order_index int, text string")
    known = spark.createDataFrame([(w,) for w in ["слушалась", "эвакуировать", "ямы", "во", "потом", "ямыво"]], "word string")
    inside = spark.createDataFrame([("ямы",), ("во",)], "word string")
    joins, fragments = L.line_breaks(frame, known, interior=inside)
    assert sorted((r.fragment, r["head"], r.word, r.hyphenated, r.fuzzy) for r in joins.collect()) == [("звакуи", "ровать", "звакуировать", False, True), ("слуша-", "лась", "слушалась", True, False)]
    assert {r.word for r in fragments.collect()} == {"слуша-", "лась", "звакуи", "ровать"}
    forms, counts = L.author_vocabulary(frame, known)
    assert "слушалась" in {r.word for r in forms.collect()} and {r.word: r.n for r in counts.collect()}.get("слушалась") == 1


def test_bloom(spark):
    words = spark.range(2000).select(F.concat(F.lit("слово"), F.col("id").cast("string")).alias("word"))
    size, hashes = L.bloom_size(2000, 0.01)
    row = L.bloom_build(words.repartition(5), size, hashes).first()
    assert row.n == 2000
    hits = L.bloom_probe(words.union(spark.createDataFrame([(None,)], "word string")), bytes(row.bits), hashes)
    assert hits.where("may_contain").count() == 2000
    other = spark.range(5000).select(F.concat(F.lit("иное"), F.col("id").cast("string")).alias("word"))
    assert L.bloom_probe(other, bytes(row.bits), hashes).where("may_contain").count() < 150


def test_search(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vector array<double>")
    assert [(r.id, r["rank"]) for r in S.top_k(chunks, asked, 3).orderBy("rank").collect()] == [(1, 1), (3, 2), (2, 3)]
    texts = spark.createDataFrame([("a",), ("a",), (" ",), ("bb",), (None,)], "text string")
    got = {r.text: r.vector for r in S.embed(texts, lambda ts: [[float(len(t)), 0.0] for t in ts], dimension=2, prefix="p:").collect()}
    assert got == {"a": [1.0, 0.0], " ": None, "bb": [1.0, 0.0]}
    row = S.prompt_quality(spark.createDataFrame([(0.9, True), (0.8, True), (0.8, False), (0.1, False)], "similarity double, related boolean")).first()
    assert row.auc == 0.875 and row.related_mean == pytest.approx(0.85)


def test_layout(spark):
    rows = [(1, i, [[0.0, 100.0 * i], [400.0, 100.0 * i]], 30.0) for i in range(5)] + [(1, 10, [[420.0, 102.0], [600.0, 102.0]], 30.0), (1, 11, [[0.0, 130.0], [300.0, 130.0]], 30.0), (2, 1, [[0.0, 1.0]], 5.0)]
    frame = spark.createDataFrame(rows, "page_id long, line_id long, baseline array<array<double>>, height double")
    pitches = {r.page_id: r.pitch for r in layout.pitch(frame).collect()}
    assert pitches[1] == pytest.approx(100, abs=35)
    groups = {r.line_id: r.group for r in layout.collinear_groups(frame, spark.createDataFrame([(1, 100.0)], "page_id long, pitch double")).where("page_id = 1").collect()}
    assert groups[1] == groups[10] == 1 and groups[11] == 11 and groups[2] == 2
    order = [r.line_id for r in layout.reading_order(frame.where("page_id = 1")).orderBy("order_index").collect()]
    assert order == [0, 1, 10, 11, 2, 3, 4]
    row = spark.range(1).select(layout.word_confidence(F.array(*[F.lit(x) for x in (0.5, 1.0, 0.0)]), F.lit(0), F.lit(2)).alias("a"), layout.word_confidence(F.array(F.lit(1.0)), F.lit(1), F.lit(1)).alias("b")).first()
    assert tuple(row) == (0.75, None)
    assert layout.hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    ink = [(1, y, 10.0 if 3 <= y < 8 or 12 <= y < 14 or 20 <= y < 30 else 0.5) for y in range(40)]
    bands = layout.row_bands(spark.createDataFrame(ink, "page_id long, y int, ink double")).orderBy("band").collect()
    assert [(r.band, r.top, r.bottom) for r in bands] == [(1, 3, 8), (2, 20, 30)]
    grey = [(1, 10, 500), (1, 240, 1500)]
    assert layout.otsu(spark.createDataFrame(grey, "image_id long, level int, n long")).first().threshold == pytest.approx(125.0)


def test_midlines_and_nearest_boxes(spark):
    line = layout.midline([(0, 0), (100, 20), (100, 30), (0, 10)], 4)
    assert len(line) == 4 and all(abs(y - (5 + 0.2 * x)) < 1.5 for x, y in line) and line[0][0] < line[-1][0]
    got = spark.createDataFrame([([[0.0, 0.0], [10.0, 0.0], [10.0, 4.0], [0.0, 4.0]],)], "o array<array<double>>").select(layout.baseline_of(F.col("o"), 2).alias("b")).first().b
    assert [[round(v, 6) for v in p] for p in got] == [[2.5, 2.0], [7.5, 2.0]]
    words = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 9.0, 0.0)], "line_id long, word_id long, x double, y double")
    boxes = spark.createDataFrame([(1, 5, 1.0, 0.0), (1, 4, -1.0, 0.0), (1, 6, 9.0, 3.0)], "line_id long, box_id long, x double, y double")
    assert {r.word_id: (r.box_id, r.distance) for r in layout.nearest_boxes(words, boxes).collect()} == {1: (4, 1.0), 2: (6, 3.0)}
