"""Secret scans over an incremental ledger of blobs.

Every version of every text is a blob, addressed by the SHA-256 of its content. The ledger is a table
in a shared folder that says which blobs have been scanned under which version of the rules, and what
was found. A run scans only pairs of blob and rule version that the ledger lacks, each blob once
however many paths hold it, and findings are joined back to all paths.

Only DataFrame functions. Positions come from cutting a text at the matches: the lengths of gaps and
matches, summed in order, are the spans. Copies are collapsed before texts are shuffled.

Defined results: a null text is the empty blob; rows with equal ids are paths of their own; runs that
die leave no rows behind, and a pair scanned twice by two runs at once counts once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.common import bind
from fleetlens.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates from left to right; one counts if group `group` has `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The patterns of the base kinds, then widely published token formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the same as runs of [0-9a-f] with 16 characters or more
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]+-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"://[^\s:/@]{1,100}:[^\s/@]{1,100}@"),
)
BASE_KINDS = ("assign", "access", "hex")


def rules_version(rules: tuple[Rule, ...]) -> str:
    """Content address of the rules: any change makes a new version."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def cut(text: Column, rule: Rule, number: int) -> Column:
    """Array of the candidates of a rule: rule number, order, gap before, length, whether it counts."""

    def rows(gaps: Column) -> Column:
        def row(hit: Column, k: Column) -> Column:
            held = F.length(hit) if not rule.group else F.length(F.regexp_extract(hit, rule.pattern, rule.group))
            return F.struct(
                F.lit(number).alias("rule"), k.alias("k"), F.length(F.get(gaps, k)).alias("gap"),
                F.length(hit).alias("size"), (held >= rule.least).alias("counts"),
            )

        return F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), row)

    return F.when(text.rlike(rule.pattern), bind(F.split(text, rule.pattern, -1), rows))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, start, end) of blobs (blob, text); a blob without findings has one row with null rule."""
    candidates = [F.coalesce(cut(F.col("text"), r, i), F.expr(
        "cast(array() as array<struct<rule:int,k:int,gap:int,size:int,counts:boolean>>)")) for i, r in enumerate(rules)]
    rows = blobs.select("blob", F.inline_outer(F.concat(*candidates)))
    so_far = Window.partitionBy("blob", "rule").orderBy("k")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    # A blob whose candidates all fail keeps the row of its first candidate, as one without findings.
    marked = placed.withColumn("rule", F.when(F.col("counts"), F.col("rule")))
    found = F.col("rule").isNotNull()
    return marked.select("blob", "rule", F.when(found, F.col("end") - F.col("size")).alias("start"), F.when(found, F.col("end")).alias("end"))


class Ledger:
    """Scanned pairs and their findings at `path`, appended run by run."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules, self.version = spark, path, rules, rules_version(rules)

    def rows(self) -> DataFrame | None:
        """All rows of this rule version, or None before the first run."""
        try:
            held = self.spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return held.where(F.col("rules") == self.version)

    def update(self, versions: DataFrame, text: str = "text") -> None:
        """Scan the blobs of `versions` that this rule version has not seen, and append what was found."""
        blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        held = self.rows()
        if held is not None:
            blobs = blobs.join(held.select("blob").distinct(), "blob", "left_anti")
        fresh = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        found = scan(fresh, self.rules).distinct().withColumn("rules", F.lit(self.version))
        found.write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """One row per blob with findings: spans (kind, start, end) by start, then rule order."""
        kinds = F.array(*(F.lit(r.kind) for r in self.rules))
        held = self.rows()
        found = held.where(F.col("rule").isNotNull()).select("blob", "rule", "start", "end")
        spans = found.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "rule", "end"))).alias("spans"))
        return spans.select("blob", F.transform("spans", lambda s: F.struct(
            F.get(kinds, s["rule"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))

    def of_paths(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """`versions` with `spans`, the findings of their blobs; empty where nothing was found."""
        kept = [c for c in versions.columns if c not in ("blob", "spans")]
        paths = versions.select(*kept, blob_of(versions[text]).alias("blob"))
        # Read from a table, both sides of the join are plain exchanges, and a blob that many paths share is split.
        joined = paths.join(cut_lineage(self.findings(), "findings"), "blob", "left")
        empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
        return joined.select(*kept, F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per path: counts of the base kinds, digest of the base spans, and all spans as text."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        doc, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )


def redact(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Texts with every span, or union of overlapping spans, replaced by `mark`; `spans` goes."""

    def widen(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        apart = F.array_append(a, F.struct(s["start"].alias("start"), s["end"].alias("end")))
        grown = F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when(F.size(a) == 0, apart).when(s["start"] < last["end"], grown).otherwise(apart)

    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    unions = F.reverse(F.aggregate("spans", empty, widen))
    clean = F.aggregate(unions, F.col(text), lambda t, s: F.overlay(t, F.lit(mark), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text))).drop("spans")
