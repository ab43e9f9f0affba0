from __future__ import annotations

import re

from pyspark.sql import functions as F

from vellum.llm import licences, queries

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_lines_of_the_table(spark, sf_dir):
    at = f"{sf_dir}/../sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").collect()
    want = {r.doc_id: sorted({name for line, name in LINES.items() if any(s.strip() == line for s in re.split(r"\n|(?<=[.])\s(?=[A-Z])", r.text or ""))}) for r in docs}
    got = {r.doc_id: r.licences for r in queries.op10_licences(spark, at).collect()}
    assert got == {i: ",".join(w) for i, w in want.items()} and any(want.values())


def test_full_texts_wrapped_and_interrupted():
    s = licences.SENTENCES
    wrap = lambda t, n: "\n ".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    scanner = licences.Scanner()
    mit = ".\n\n".join(wrap(s[k], 9) for k in ("mit-grant", "mit-notice", "mit-as-is"))
    assert [x[1:] for x in scanner.licences(f"Title\n{mit}.\nmore")] == [("MIT", 2)]
    apache = ". ".join(wrap(s[k], 7) for k in ("apache-2.0-grant", "apache-2.0-copy", "apache-2.0-as-is", "apache-2.0-see"))
    assert [x[1] for x in scanner.licences(f"{apache}.\nWords here.\n{mit}. Released under the mit LICENSE!")] == ["Apache-2.0", "MIT", "MIT"]
    bsd = ". ".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"))
    assert [x[1] for x in scanner.licences(bsd)] == ["BSD-3-Clause"]
    assert [x[1] for x in scanner.licences(bsd.replace(s["bsd-names"], ""))] == ["BSD-2-Clause"]
    assert scanner.licences(". ".join(s[k] for k in ("mit-notice", "mit-grant", "mit-as-is"))) == []
    assert scanner.licences("I read about the MIT License. We say: not Released under the MIT License") == []
    for name, wording in s.items():
        assert [n for _, n in scanner.identifiers(f"x y. {wording}. z")] == [name]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License.\n" * 50_000), (3, "Licensed under CC BY 4.0"), (None, "a Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(1))
    got = sorted((r.doc_id or 0, r.licences, len(r.matches)) for r in licences.scan(docs).collect())
    assert got == [(0, [], 0), (1, [], 0), (2, [], 0), (3, ["CC-BY-4.0"], 1), (3, ["MIT"], 50_000)]
    assert licences.scan(docs.limit(0)).collect() == []


def test_every_rule_is_found_in_its_own_sentences():
    scanner = licences.Scanner()
    for number, rule in enumerate(licences.RULES):
        text = "Words before. " + " ".join(f"{licences.SENTENCES[i]}." for i in rule.ids) + "\nwords after, which go on"
        found = scanner.licences(text)
        assert [(b, c) for _, b, c in found] == [(rule.licence, number)], rule
        wrapped = text.replace(" of ", " of\n")
        assert [b for _, b, _ in scanner.licences(wrapped)] == [rule.licence]
    assert scanner.licences("This program is free software, mostly. " + "x, " * 300_000) == []
