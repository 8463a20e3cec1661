"""Golden rows and independent plain-Python formulas."""

import hashlib
import re
import statistics

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import snapshot, sqltext, text
from fleetlens.functions.common import bucket_start, fixed_text
from fleetlens.operators import lint, quantiles, security
from fleetlens.plans import corpus
from fleetlens.sources import registry


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


STATEMENTS = [
    "", "select * from t where a = 5 -- tail", "/* x\ny */ SELECT 'a--b', \"q\" FROM t WHERE id IN (1, 2,3)  AND x1 = 2.50",
    "INSERT INTO t VALUES (1, 'x')", "SELECT Größe FROM straße WHERE ä5 = 7", "  \n\t ", "a a a b",
]


def canonical(sql):
    s = sql.strip()
    for pattern, to, flags in [
        (r"--[^\n]*", "", 0), (r"/\*.*?\*/", "", re.S), (r"'[^']*'|\"[^\"]*\"", "?", 0),
        (r"\bIN\s*\([^)]+\)", "IN (?)", re.I), (r"\b\d+(\.\d+)?\b", "?", 0), (r"\s+", " ", 0),
    ]:
        s = re.sub(pattern, to, s, flags=flags)
    return s.strip().upper()


def simhash(sql):
    counts = [0] * 64
    for word in canonical(sql).split():
        digest = int(hashlib.md5(word.encode()).hexdigest(), 16)
        for bit in range(64):
            counts[bit] += 1 if digest >> bit & 1 else -1
    return format(sum(1 << bit for bit in range(64) if counts[bit] > 0), "016x")


def test_canonical_text_and_fingerprint(spark):
    assert column(spark, STATEMENTS, sqltext.normalize_sql) == [canonical(s) for s in STATEMENTS]
    got = column(spark, STATEMENTS, lambda v: sqltext.hex16(sqltext.simhash64(sqltext.normalize_sql(v))))
    assert got == [simhash(s) for s in STATEMENTS]
    assert got[0] == "0" * 16


def test_access_pattern(spark):
    cases = {
        "SELECT COUNT(*) FROM ORDERS": "unknown", "SELECT SUM(TOTAL) FROM ORDERS": "olap_scan",
        "SELECT COUNT(*) FROM ORDERS WHERE STATUS = ?": "oltp_point", "CREATE INDEX I ON T (A)": "ddl",
        "INSERT INTO T VALUES " + "(?) " * 6 + "X": "batch_insert", "INSERT INTO T VALUES (?)": "unknown",
        "SELECT A FROM T JOIN U ON X JOIN V ON Y WHERE Z = ?": "unknown",
        "SELECT A FROM T WHERE B = ? GROUP BY A": "olap_scan",
    }
    assert column(spark, cases, sqltext.access_pattern) == list(cases.values())


def test_gate(spark):
    cases = {
        "select 1; drop table t": None, "select 1;": "select 1 LIMIT 100", "select 1 limit 5 ;;": "select 1 limit 5",
        "": None, "with x as (select 1) select * from x": "with x as (select 1) select * from x LIMIT 100",
        "explain select 1": None, "select updated from t": "select updated from t LIMIT 100", "select 1 union delete": None,
    }
    assert column(spark, cases, sqltext.safe_select) == list(cases.values())


def test_lint_columns(spark):
    cases = {
        "select x from t where a=5": ["a"], "select x from t where a = 5": [],
        "select x from t where status in (1)": ["status"], "select x from t where a=$1 and login > 3": ["log"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, query string")
    assert [r.index_columns for r in lint.lint(df).orderBy("i").collect()] == list(cases.values())
    fixed = lint.lint(df, fixed=True).orderBy("i").collect()
    assert [r.index_columns for r in fixed] == [["a"], ["a"], ["status"], ["a", "login"]]


def test_plan_filter_columns(spark):
    cases = ["(status = 'pending'::text)", "(domain ~~ 'x')", "(a > 1 AND b <= 2)"]
    assert column(spark, cases, corpus.filter_columns) == [["status", "pend"], ["doma"], ["a", "b"]]
    assert column(spark, cases, lambda v: corpus.filter_columns(v, True)) == [["status"], [], ["a", "b"]]


def test_deep_and_wide_plans(spark):
    deep = "".join('{"Node Type":"N%d","Plans":[' % i for i in range(499)) + '{"Node Type":"N499"}' + "]}" * 499
    wide = '{"Node Type":"Append","Plans":[' + ",".join('{"Node Type":"Seq Scan","Actual Rows":%d}' % i for i in range(10_000)) + "]}"
    docs = [(1, '{"Plan":' + deep + "}"), (2, '[{"Plan":' + wide + "}]"), (3, "{"), (4, None), (5, "[]"), (6, '{"Plan":{"Plans":[7,{"Plan Rows":"12","Total Cost":"x"}]}}'), (7, '{"Plan":{}} {}')]
    parsed = corpus.parse_plans(spark.createDataFrame(docs, "plan_id int, plan_json string"), fields=corpus.FOR_FINDINGS)
    assert {r.plan_id for r in parsed.where("parse_error").collect()} == {3, 4, 7}
    nodes = corpus.flatten_plans(parsed).collect()
    got = {i: [r for r in nodes if r.plan_id == i] for i in (1, 2, 5, 6)}
    assert [(r.depth, r.node_type) for r in got[1]] == [(i, f"N{i}") for i in range(500)] and got[1][2].path == "0.0.0" and got[1][2].parent_path == "0.0"
    assert [(r.path, r.actual_rows) for r in got[2][1:]] == [(f"0.{i}", i) for i in range(10_000)]
    assert [(r.path, r.node_type, r.plan_rows, r.total_cost) for r in got[5] + got[6]] == [
        ("0", "Unknown", 0, 0.0), ("0", "Unknown", 0, 0.0), ("0.0", "Unknown", 0, 0.0), ("0.1", "Unknown", 12, 0.0)]


def test_security_counts(spark):
    cases = {"GRANT ALL ON orders TO app": 2, "select pg_sleep(5)": 2, "select 1": 0, "SELECT * FROM users, x": 1,
             "select id from users": 0}
    df = spark.createDataFrame([("d", q, "t") for q in cases], "database_id string, query string, poll_time string")
    got = {r["sql_sample"]: r["n"] for r in security.scan_statements(df).groupBy("sql_sample").agg(F.count("*").alias("n")).collect()}
    assert got == {q: n for q, n in cases.items() if n}


@pytest.mark.parametrize("pieces", [None, 1, 40])
def test_exclusive_percentiles(spark, pieces):
    groups = {"a": [float(i) for i in range(1, 11)], "b": [3.0] * 50, "c": [1.0], "d": [(i * 37 % 101) / 7 - 3 for i in range(333)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r for r in quantiles.exclusive_percentiles(df, ["k"], "v", pieces=pieces).collect()}
    assert abs(got["a"].p99 - 10.89) < 1e-12 and got["c"].p50 is None and got["b"].p95 == 3.0
    for k in "abd":
        cuts = statistics.quantiles(groups[k], n=100)
        for p in (50, 95, 99):
            assert abs(got[k][f"p{p}"] - cuts[p - 1]) < 1e-9


def test_order_statistics_of_equal_and_nearly_equal_values(spark):
    """A third each: one value, its neighbours a few bits away, infinities."""
    df = spark.range(300_000).select(F.lit(None).cast("string").alias("k"), F.expr(
        "CASE id % 3 WHEN 0 THEN 1D WHEN 1 THEN 1D + (id % 1000) * 2.220446049250313E-16D ELSE IF(id % 2 = 0, double('-Infinity'), double('Infinity')) END").alias("v"))
    values = sorted(r.v for r in df.collect())
    ranks = {f"r{i}": F.lit(i) for i in (1, 50_000, 50_001, 120_000, 250_000, 250_001, 300_000, 300_001)}
    got = quantiles.order_statistics(df, ["k"], "v", ranks, pieces=7).first()
    assert got.n == 300_000 and got.r300001 is None
    assert all(got[f"r{i}"] == values[i - 1] for i in (1, 50_000, 50_001, 120_000, 250_000, 250_001, 300_000))


def test_fixed_text_equals_python_format(spark):
    values = [0.25, 0.35, 115.25, 115.35, 2.675, 0.5, 1.5, 2.5, 84.5, -1.25, 1234567.005, 0.05, 99.95, 0.0]
    for digits in (0, 1, 2):
        assert column(spark, values, lambda v: fixed_text(v, digits), "double") == [f"{v:.{digits}f}" for v in values]


def test_sizes_and_buckets(spark):
    sizes = {0: "0 bytes", 10239: "10239 bytes", 10240: "10 kB", 10485247: "10239 kB", 10485760: "10 MB", 5 * 2**40: "5120 GB"}
    assert column(spark, sizes, snapshot.pretty_size, "bigint") == list(sizes.values())
    start = column(spark, ["2024-01-03 10:00:00"], lambda v: bucket_start(v.cast("timestamp_ntz"), 7 * 86400).cast("string"))
    assert start == ["2024-01-01 00:00:00"]


def test_json_and_questions(spark):
    answers = ['x ```json\n{"k": 1}\n```', '{"k": 1} trailing', "[1, 2]", "no json", '{"k": 1}} x', "[1] ] y"]
    parsed = column(spark, answers, lambda v: text.json_from_text(v).isNotNull())
    assert parsed == [True, False, True, False, False, False]
    asked = {"What are the top 12 slowest queries?": ("slow_queries", 12), "cache 007?": ("cache", 7), "any deadlock": ("locks", 5),
             "list 99999999999999999999 alerts": ("alerts", 25), "hello 0": ("none", 1)}
    assert column(spark, asked, text.intent) == [v[0] for v in asked.values()]
    assert column(spark, asked, text.requested_rows) == [v[1] for v in asked.values()]


def test_registry(spark):
    urls = ["postgres://me:p%40x@Db1:6000/app", "mysql://h/x", "postgresql:///only", "mysql://u:p@h:bad/x", "postgres://a:b@c@h2/y"]
    df = registry.parse_urls(registry.explode_urls(spark.createDataFrame([(",".join(urls),)], "s string"), "s"))
    got = {(r.db_type, r.host, r.port, r.database_name, r.username): r.id for r in df.collect()}
    assert set(got) == {
        ("postgresql", "db1", 6000, "app", "me"), ("mysql", "h", 3306, "x", ""), ("postgresql", "localhost", 5432, "only", ""),
        ("postgresql", "h2", 5432, "y", "a"),
    }
    assert got["mysql", "h", 3306, "x", ""] == hashlib.sha256(b"mysql:h:3306:x").hexdigest()[:16]


def test_sql_functions_equal_column_functions(spark):
    from fleetlens.functions.sqlfunctions import register

    register(spark)
    spark.createDataFrame([(s,) for s in STATEMENTS], "s string").createOrReplaceTempView("seen")
    for r in spark.sql("select s, normalize_sql(s) n, access_pattern(normalize_sql(s)) p from seen").collect():
        assert r.n == canonical(r.s)
        assert [r.p] == column(spark, [r.n], sqltext.access_pattern)
    assert spark.sql("select fingerprint_distance(-1, 0), fingerprint_similar(5, 4), fingerprint_hex(255)").first()[:] == (
        64, True, "00000000000000ff")
