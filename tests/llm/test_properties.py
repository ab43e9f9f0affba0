from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import html_text, licences, mpeg, packing, quality, simhash, topk, toxicity

QUICK = settings(max_examples=150, deadline=None)
MARKUP = st.lists(st.one_of(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<script>", "</script>", "<!--", "-->", "<a href=x>", "</a>", "<li>", "<b", ">", "&amp;", "&#x41;", "<br/>", "<nav>", "</nav>", "<td>", "\n"]), st.text(max_size=12)), max_size=40).map("".join)


@QUICK
@given(MARKUP)
def test_any_markup_gives_plain_text(page):
    text = html_text.extract(page)
    assert text == " ".join(text.split()) or "\x1c" <= min(text, default=" ") <= "\x1f"
    assert html_text.extract(page) == text


@QUICK
@given(st.binary(max_size=4000))
def test_any_bytes_are_stored_and_any_bytes_are_read(data):
    payload = mpeg.padded(data)
    media = mpeg.store(payload)
    assert mpeg.payload(media, mpeg.read(media)) == payload and len(payload) % 64 == 0 and payload
    mpeg.read(data)


@QUICK
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(41, 80))
def test_windows_never_exceed_the_size(steps, size):
    places = np.concatenate(([0], np.cumsum(steps)))
    starts = packing.cuts(places, np.zeros(len(places), np.int32), size)
    ends = [*starts[1:], len(places) - 1]
    assert starts[0] == 0 and all(0 <= places[b] - places[a] <= size for a, b in zip(starts, ends, strict=True))


@QUICK
@given(st.text(max_size=400))
def test_features_and_fingerprints_of_any_text(text):
    raw = text.encode("utf-8", "surrogatepass")
    at, value = quality.Features()(raw)
    assert len(at) == len(set(at.tolist())) == len(value) and np.isfinite(value).all()
    assert simhash.fingerprint(raw) == simhash.fingerprint(b" " + raw + b"\n")
    licences.Scanner().licences(text)
    if words := toxicity.tokens(raw):
        grams, counts = toxicity.trigrams(words)
        assert counts.sum() == len(grams) and grams.max() < toxicity.TRIGRAMS


@QUICK
@given(st.integers(0, 2**32 - 1), st.integers(1, 12))
def test_pruned_search_equals_full_search(seed, k):
    rng = np.random.default_rng(seed)
    c = rng.integers(-30, 31, (60, 6)) * rng.integers(1, 5, (60, 1))
    c = c[np.argsort(-(c**2).sum(axis=1), kind="stable")]
    q = c[rng.integers(0, 60, 5)] + rng.integers(-2, 3, (5, 6))
    scores = q @ c.T
    least = np.sort(scores, axis=1)[:, -k].astype(float)
    got = {i: s.tolist() for i, _, s in topk.search(np.full(5, -1), q, least, np.arange(60), c, k)}
    assert got == {i: sorted(scores[i].tolist(), reverse=True)[:k] for i in range(5)}
