"""Observed statements: slow-statement selection, enrichment, snapshot merge, classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.constants import ACCESS_PATTERNS
from fleetlens.functions import sqltext as T
from fleetlens.functions.common import or_default
from fleetlens.operators.topn import top_n
from fleetlens.session import cut_lineage


def slow_statements(
    stats: DataFrame, threshold_ms: float = 1000.0, keys: Sequence[str] = ("database_id", "poll_time"),
    n: int = 50, min_calls: int = 5,
) -> DataFrame:
    """The `n` slowest statements per poll with more than `min_calls` calls.

    Expects `queryid, query, calls, total_exec_time, row_count`; rows per call is a whole number.
    """
    mean = F.try_divide(F.col("total_exec_time"), F.col("calls"))
    slow = stats.where((F.col("calls") > min_calls) & (mean > threshold_ms)).withColumn("mean_time_ms", mean)
    slow = slow.withColumn("avg_rows", F.expr("row_count div nullif(calls, 0)"))
    return top_n(slow, keys, [F.desc("mean_time_ms"), F.asc("queryid")], n)


def slow_digests(
    digests: DataFrame, threshold_ms: float = 1000.0, keys: Sequence[str] = ("database_id", "poll_time"),
    n: int = 50, min_calls: int = 5,
) -> DataFrame:
    """The same selection over digest rows, whose timers are picoseconds."""
    ms = digests.withColumn("mean_time_ms", F.col("avg_timer_wait") / 1e9).withColumn(
        "total_time_ms", F.col("sum_timer_wait") / 1e9
    )
    slow = ms.where((F.col("calls") > min_calls) & (F.col("mean_time_ms") > threshold_ms))
    return top_n(slow, keys, [F.desc("mean_time_ms"), F.asc("queryid")], n)


def enrich(statements: DataFrame, sql: str = "query") -> DataFrame:
    """Add canonical text, fingerprint and access pattern; rows without text are dropped."""
    return (
        statements.where(F.coalesce(F.col(sql), F.lit("")) != "")
        .withColumn("normalized_sql", T.normalize_sql(F.col(sql)))
        .withColumn("simhash", T.simhash64(F.col("normalized_sql")))
        .withColumn("fingerprint", T.hex16(F.col("simhash")))
        .withColumn("access_pattern", T.access_pattern(F.col("normalized_sql"), canonical=True))
    )


def snapshot_rows(enriched: DataFrame, sql: str = "query", time: str = "poll_time") -> DataFrame:
    """Enriched slow statements in the stored snapshot shape."""
    def column(name: str) -> Column:
        return F.col(name) if name in enriched.columns else F.lit(None).cast("double")

    total = F.coalesce(
        F.nullif(column("total_time_ms"), F.lit(0.0)), column("total_exec_time"), F.lit(0.0)
    )
    return enriched.select(
        "fingerprint", "database_id", "normalized_sql", F.col(sql).alias("sample_sql"),
        or_default(F.col("calls"), 1).cast("bigint").alias("call_count"),
        F.coalesce(F.col("mean_time_ms"), F.lit(0.0)).cast("double").alias("mean_time_ms"),
        total.cast("double").alias("total_time_ms"),
        "access_pattern", F.col(time).alias("last_seen_at"), F.col("queryid").cast("string").alias("queryid"),
    )


SNAPSHOT_KEYS = ["fingerprint", "database_id"]
FIRST_SEEN = ["normalized_sql", "sample_sql", "access_pattern"]
LAST_SEEN = ["call_count", "mean_time_ms", "total_time_ms", "last_seen_at"]


def merge_snapshots(rows: DataFrame) -> DataFrame:
    """One row per (fingerprint, database): texts of the first sighting, numbers of the last.

    Within one poll statements arrive slowest first, so the fastest one is the last. Both picks are
    algebraic: a fingerprint seen a billion times leaves one row per map task. `first_rank` keeps
    the first sighting's order so that the result can be merged again with later rows.
    """
    order = F.struct(
        F.col("last_seen_at"), (-F.col("mean_time_ms")).alias("m"), F.col("queryid").alias("q")
    )
    first = F.col("first_rank") if "first_rank" in rows.columns else order
    ranked = rows.withColumn("first_rank", first).withColumn("last_rank", F.col("last_rank") if "last_rank" in rows.columns else order)
    merged = ranked.groupBy(*SNAPSHOT_KEYS).agg(
        F.min_by(F.struct(*FIRST_SEEN), "first_rank").alias("f"),
        F.max_by(F.struct(*LAST_SEEN, "queryid"), "last_rank").alias("l"),
        F.min("first_rank").alias("first_rank"),
        F.max("last_rank").alias("last_rank"),
    )
    return merged.select(*SNAPSHOT_KEYS, "f.*", "l.*", "first_rank", "last_rank")


def top_slow(snapshots: DataFrame, n: int = 20) -> DataFrame:
    """The `n` slowest stored statements per database."""
    order = [F.desc_nulls_first("mean_time_ms"), F.asc("fingerprint")]
    return top_n(snapshots, ["database_id"], order, n)


def shapes(enriched: DataFrame, *keys: str) -> DataFrame:
    """Rows of `enrich` with equal canonical text and `keys` as one, `statements` of them: all that rules and models read."""
    return enriched.groupBy("normalized_sql", *keys).agg(F.count(F.lit(1)).alias("statements"))


def labelled_features(statements: DataFrame, sql: str, label: str, canonical: bool = False, weight: str | None = None) -> DataFrame:
    """Distinct feature rows with their frequency as weight: a log of any size trains on few rows.

    `canonical` says that `sql` is canonical text; `weight` names a column of frequencies.
    """
    names = T.FEATURES
    norm = statements.withColumn("_n", F.col(sql) if canonical else T.normalize_sql(F.col(sql)))
    many = F.col(weight) if weight else F.lit(1)
    rows = norm.select(
        *T.features(F.col("_n")), F.array_position(F.lit(ACCESS_PATTERNS), F.col(label)).alias("_l"), many.alias("_many")
    ).where(F.col("_l") > 0)
    return rows.withColumn("label", (F.col("_l") - 1).cast("double")).groupBy(*names, "label").agg(
        F.sum("_many").cast("double").alias("weight")
    )


def fit_classifier(training: DataFrame, algorithm: str = "forest", trees: int = 100, depth: int = 4):
    """A pipeline model over FEATURES: one multi-class forest, or boosted trees one-vs-rest.

    Training reads its rows several times, so the few weighted rows are written down first.
    """
    training = cut_lineage(training, "training")
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=T.FEATURES, outputCol="features")
    if algorithm == "boosted":
        model = OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth), weightCol="weight")
    else:
        model = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, weightCol="weight", seed=7, featureSubsetStrategy="all"
        )
    return Pipeline(stages=[assembler, model]).fit(training)


def model_patterns(statements: DataFrame, sql: str, model, canonical: bool = False) -> DataFrame:
    """`statements` with `guess`, the model's access pattern."""
    norm = statements.withColumn("_n", F.col(sql) if canonical else T.normalize_sql(F.col(sql)))
    scored = model.transform(norm.select("*", *T.features(F.col("_n"))))
    return scored.select(*statements.columns, F.get(F.lit(ACCESS_PATTERNS), F.col("prediction").cast("int")).alias("guess"))


def classify_unknown(statements: DataFrame, sql: str, model, canonical: bool = False) -> DataFrame:
    """Access pattern by rule, by model where no rule applies."""
    norm = statements.withColumn("_n", F.col(sql) if canonical else T.normalize_sql(F.col(sql)))
    scored = model.transform(norm.select("*", *T.features(F.col("_n"))))
    guess = F.get(F.lit(ACCESS_PATTERNS), F.col("prediction").cast("int"))
    return scored.select(
        *statements.columns, T.access_pattern(F.col("_n"), guess, canonical=True).alias("access_pattern")
    )
