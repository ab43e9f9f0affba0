"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is content-addressed by its SHA-256. The ledger holds, for each
blob and rule version that was scanned, the spans that were found, none included. A scan
looks only at pairs of blob and rule version that the ledger lacks, each blob once however
many paths have it, and joins the findings back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.arrays import blocks, let, running
from vellum.llm.common import checkpoint_folder, durable


@dataclass(frozen=True)
class Rule:
    """A rule: its pattern finds leftmost non-overlapping matches; those of which ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: Spans that the method adds: private keys from their first to their last line; where that lacks, the encoded lines that follow.
ADDED = (Rule("pem", 2, r"-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----(?:[^-]*+(?:-[^-]++){0,8}+-----END (?:[A-Z]+ ){0,4}PRIVATE KEY-----|(?:\s{1,4}[A-Za-z0-9+/=]{16,80}(?![A-Za-z0-9+/=])){0,200}+)", 0, 1),)
RULES = BASE + ADDED

SPAN = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, kind string, version int, spans {SPAN}"


def matches(text: Column, rule: Rule) -> Column:
    """The rule's matches as text; those that it will drop included."""
    return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))


def spans(text: Column, found: Column, rule: Rule) -> Column:
    """Code-point spans, end exclusive, of the rule's matches ``found``; an empty array where it has none.

    What lies between matches comes from splitting at them, so running sums of the
    lengths of both give the places. A match read by itself has the groups that it had.
    """
    size = lambda w: F.length(F.regexp_extract(w, rule.pattern, rule.group)) if rule.group else F.length(w)
    gaps = let(F.size(found), lambda n: F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), n), F.length))
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda w: F.struct(F.length(w).alias("n"), (size(w) >= rule.least).alias("kept"))).alias("w"))

    def place(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["gap"] + x["w"]["n"]))
        placed = F.arrays_zip(p.alias("p"), ends.alias("end"))
        return F.transform(F.filter(placed, lambda x: x["p"]["w"]["kept"]), lambda x: F.struct((x["end"] - x["p"]["w"]["n"]).cast("int").alias("start"), x["end"].cast("int").alias("end")))

    return F.when(F.size(found) > 0, let(parts, place)).otherwise(F.array().cast(SPAN))


def blob(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for the pairs of blob and rule version not in ``ledger``.

    Blobs without findings get rows with empty spans, so that they are not scanned again.
    """
    blobs = docs.select(blob(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", F.col("version").cast("string"))).alias("done"))
        blobs = blobs.join(done, "blob", "left").where(F.coalesce(F.size(F.array_except(F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules]), "done")) > 0, F.lit(True)))
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"), *([F.first("done").alias("done")] if ledger is not None else []))

    def wanted(r: Rule) -> Column:
        return F.lit(True) if ledger is None else ~F.coalesce(F.array_contains("done", f"{r.kind}:{r.version}"), F.lit(False))

    once = once.select("*", *[F.when(wanted(r), matches(F.col("text"), r)).alias(f"_{i}") for i, r in enumerate(rules)])
    found = [F.when(F.col(f"_{i}").isNotNull(), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), F.col(f"_{i}"), r).alias("spans"))) for i, r in enumerate(rules)]
    return once.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("blob", "f.kind", "f.version", "f.spans")


def _joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, ledger: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``id_col``, blob and findings (array of kind, start, end by start, then kind as ruled)."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    rows = ledger.where((F.size("spans") > 0) & F.array_contains(current, F.concat_ws(":", "kind", F.col("version").cast("string"))))
    flat = rows.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, F.col("kind")).alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("s"))
    by_blob = flat.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("s"))).alias("s"))
    by_blob = durable(by_blob.select("blob", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings")))  # a plain side, so that a hot blob's paths can be split
    paths = docs.select(F.col(id_col), blob(F.col(text_col)).alias("blob"))
    return paths.join(by_blob, "blob", "left").select(id_col, "blob", F.coalesce("findings", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("findings"))


def find(docs: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every row, scanning only what ``ledger`` lacks; see `report`, and `update` for a kept ledger.

    Null texts count as empty; repeated rows stay repeated; null ids pass through; other
    columns are ignored; empty input gives an empty result.
    """
    new = scan(docs, ledger, text_col=text_col, rules=rules)
    return report(docs, new if ledger is None else ledger.select(new.columns).unionByName(new), id_col=id_col, text_col=text_col, rules=rules)


def stored_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at ``path``; None where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update(docs: DataFrame, path: str | None = None, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger kept at ``path`` lacks, appends it there and returns the whole ledger.

    Any version of any text may be given at any time, together or one after another: a pair
    of blob and rule version is scanned once. Without a path a new ledger is begun in the
    checkpoint folder.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}"
    scan(docs, stored_ledger(spark, path), text_col=text_col, rules=rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def digest(found: DataFrame, *, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Replaces findings by counts per base kind, the hash of the base spans and all spans as text."""
    in_base = F.filter("findings", lambda x: x["kind"].isin(*[r.kind for r in base]))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in base]
    return found.select(*[c for c in found.columns if c not in ("blob", "findings")], *counts, F.sha2(_joined(in_base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))


def redact(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """The text with the union of the findings' spans replaced by ``mark``; findings are in order of their starts.

    What lies between is cut by blocks of spans: first the part of the text that holds a
    block's spans, then the pieces of that part.
    """

    def clean(all_found: Column) -> Column:
        covered = F.transform(running(F.transform(all_found, lambda x: x["end"]), "max"), lambda x: x.cast("int"))

        def kept(cover: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), cover)
            seen = F.arrays_zip(all_found.alias("f"), F.slice(before, F.lit(1), F.size(all_found)).alias("since"))
            fresh = F.transform(F.filter(seen, lambda x: x["f"]["start"] >= x["since"]), lambda x: F.struct(x["since"].alias("a"), x["f"]["start"].alias("b")))

            def pieces(part: Column) -> Column:
                low, high = F.element_at(part, 1)["a"], F.element_at(part, -1)["b"]
                return let(F.struct(low.alias("low"), F.substring(text, low + 1, high - low).alias("text")), lambda r: F.transform(part, lambda x: F.substring(r["text"], x["a"] - r["low"] + 1, x["b"] - x["a"])))

            heads = F.array_join(F.flatten(F.transform(blocks(fresh), pieces)), mark)
            return F.concat(heads, F.lit(mark), F.substring(text, F.element_at(cover, -1) + 1, F.length(text)))

        return let(covered, kept)

    return F.when(F.size(findings) > 0, let(findings, clean)).otherwise(text)
