"""Plans and memory that must not grow faster than the input."""

from pyspark.sql import functions as F

from fleetlens import session
from fleetlens.operators import detectors
from fleetlens.operators import statements as operators
from suite import statements
from suite.views import view


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deployments_are_neither_multiplied_nor_broadcast(spark):
    at = lambda c: F.expr(f"timestamp_ntz'2024-01-10 00:00:00' + make_dt_interval(0, 0, 0, cast({c} as decimal(18, 6)))")
    samples = spark.range(3000).select(F.concat(F.lit("db-"), F.col("id") % 2).alias("database_id"), at("id * 97").alias("time"),
                                       F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 1000).cast("double")).alias("p99_latency_ms"))
    made = spark.range(40).select(F.col("id").alias("proposal_id"), F.concat(F.lit("db-"), F.col("id") % 3).alias("database_id"), at("id * 7777 - 90000").alias("deployed_at"))
    made = made.unionByName(made.where("proposal_id = 7")).unionByName(made.limit(1).withColumns({"proposal_id": F.lit(99), "deployed_at": F.lit(None).cast("timestamp_ntz")}))
    out = detectors.post_deploy_regressions(samples, made)
    plan = physical(out)
    assert "Broadcast" not in plan and "sequence(" not in plan
    rows = [(r.database_id, r.time, r.p99_latency_ms) for r in samples.collect() if r.p99_latency_ms is not None]
    want = {}
    for d in made.where("deployed_at IS NOT NULL").collect():
        near = [(t, v) for db, t, v in rows if db == d.database_id and abs((t - d.deployed_at).total_seconds()) <= 86400]
        mean = lambda x: round(sum(x) / len(x), 6) if x else None
        if near:
            want[d.proposal_id] = (mean([v for t, v in near if t < d.deployed_at]), mean([v for t, v in near if t >= d.deployed_at]))
    got = {r.proposal_id: tuple(None if x is None else round(x, 6) for x in (r.before_mean, r.after_mean)) for r in out.collect()}
    assert got == want and len(got) > 15


def test_plans_are_not_broadcast_to_their_statements(spark, sf):
    assert "Broadcast" not in physical(statements.lint_with_plans(spark, sf))


def test_a_large_table_is_dealt_out_by_bytes(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_BYTES", 1 << 10)
    orders = view(spark, sf, "query_log")
    dealt = session.spread(orders)
    assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert dealt.count() == orders.count()


def test_shapes_teach_and_answer_as_their_statements(spark, sf):
    log = operators.enrich(view(spark, sf, "query_log").unionByName(view(spark, sf, "query_log").where("log_id % 3 = 0")), "sql_text")
    few = operators.shapes(log, "access_pattern").where("access_pattern <> 'unknown'")
    assert few.count() < log.count() / 4
    got = operators.labelled_features(few, "normalized_sql", "access_pattern", True, "statements")
    want = operators.labelled_features(log.where("access_pattern <> 'unknown'"), "sql_text", "access_pattern")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
