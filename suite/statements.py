"""Statement text analytics, gates, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import constants as K
from fleetlens.functions import sqltext, text
from fleetlens.operators import conversation, lint, rollups, security, similarity, statements
from fleetlens.plans import corpus
from fleetlens.session import cut_lineage, spread
from suite.health import rounded
from suite.views import table, view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def normal(c: str) -> str:
    """Canonical form of a statement in DuckDB. Word borders there are ASCII only, so letters beyond
    ASCII next to digits are handled by the pattern itself."""
    steps = [
        (r"--[^\n]*", ""), (r"(?s)/\*.*?\*/", ""), (r"'[^']*'|\"[^\"]*\"", "?"), (r"(?i)\bIN\s*\([^)]+\)", "IN (?)"),
        # A letter beyond ASCII next to a digit is no word border: keep the two apart for a moment.
        (r"(\p{L})(\d)", r"\1qzq\2"), (r"(\d)(\p{L})", r"\1qzq\2"), (r"\b\d+(\.\d+)?\b", "?"), ("qzq", ""),
        (r"[\s\p{Z}]+", " "),
    ]
    out = f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{quoted(pattern)}', '{to}', 'g')"
    return f"replace(upper(trim({out})), chr(7838), 'SS')"


def simhash(source: str, key: str, norm: str) -> str:
    """CTEs that give (key, fp UBIGINT) from a canonical text column."""
    ones = ", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))
    bits = " | ".join(f"CASE WHEN 2 * b{i} > n THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END" for i in range(64))
    return f"""words AS (SELECT {key}, unnest(string_split({norm}, ' ')) AS w FROM {source}),
hashed AS (SELECT {key}, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM words WHERE w <> ''),
summed AS (SELECT {key}, count(*) AS n, {ones} FROM hashed GROUP BY {key}),
prints AS (SELECT s.{key}, coalesce({bits}, 0::UBIGINT) AS fp FROM (SELECT {key} FROM {source}) s LEFT JOIN summed USING ({key}))"""


HEX = "lower(lpad(hex(fp), 16, '0'))"
NORMED = f"normed AS (SELECT *, {normal('sql_text')} AS normalized_sql FROM query_log)"
PATTERN = r"""CASE WHEN regexp_matches(normalized_sql, '^(CREATE|DROP|ALTER|TRUNCATE|RENAME)\b') THEN 'ddl'
  WHEN regexp_matches(normalized_sql, '^INSERT\b') AND (length(normalized_sql) - length(replace(normalized_sql, '(?) ', ''))) / 4 > 5 THEN 'batch_insert'
  WHEN regexp_matches(normalized_sql, '^(SELECT|UPDATE|DELETE)\b') AND regexp_matches(normalized_sql, '\bWHERE\b')
    AND NOT regexp_matches(normalized_sql, '\b(GROUP BY|HAVING|DISTINCT)\b') AND NOT regexp_matches(normalized_sql, '\bJOIN\b.*\bJOIN\b') THEN 'oltp_point'
  WHEN regexp_matches(normalized_sql, '\b(GROUP BY|HAVING|SUM\(|COUNT\(|AVG\(|MAX\(|MIN\()\b') THEN 'olap_scan' ELSE 'unknown' END"""


def _log(spark, sf):
    return spread(view(spark, sf, "query_log"))


def _prints(spark, sf):
    return similarity.simhash_texts(spread(table(spark, sf, "documents")), "doc_id", "text")


# --- canonical text, fingerprints -----------------------------------------------------------------


@query(with_views("query_log", more=NORMED) + f" SELECT log_id, normalized_sql, {PATTERN} AS access_pattern FROM normed")
def canonical_statements(spark, sf):
    return statements.enrich(_log(spark, sf), "sql_text").select("log_id", "normalized_sql", "access_pattern")


@query(with_views("query_log", more=NORMED) + f" SELECT log_id, normalized_sql, {PATTERN} AS access_pattern FROM normed")
def sql_functions(spark, sf):
    """The same functions called from SQL."""
    from fleetlens.functions.sqlfunctions import register

    register(spark)
    _log(spark, sf).createOrReplaceTempView("statements_seen")
    return spark.sql("""
        SELECT log_id, normalized_sql, access_pattern(normalized_sql) AS access_pattern
        FROM (SELECT log_id, normalize_sql(sql_text) AS normalized_sql FROM statements_seen)""")


@query(with_views("query_log", more=NORMED + ", " + simhash("normed", "log_id", "normalized_sql")) + f" SELECT log_id, {HEX} AS fingerprint FROM prints")
def statement_fingerprints(spark, sf):
    return statements.enrich(_log(spark, sf), "sql_text").select("log_id", "fingerprint")


DOCS = f"normed AS (SELECT doc_id, {normal('text')} AS normalized_sql FROM documents), " + simhash("normed", "doc_id", "normalized_sql")


@query(f"WITH {DOCS} SELECT doc_id, {HEX} AS fingerprint FROM prints")
def text_fingerprints(spark, sf):
    """Fingerprints of long texts, whole texts."""
    return _prints(spark, sf).select("doc_id", sqltext.hex16(F.col("simhash")).alias("fingerprint"))


@query(with_views("query_log", more=NORMED + ", " + simhash("normed", "log_id", "normalized_sql")) + """,
pairs AS (SELECT log_id, fp, lag(fp) OVER (PARTITION BY log_id // 64 ORDER BY log_id) AS before FROM prints)
SELECT log_id, CAST(bit_count(xor(fp, before)) AS INTEGER) AS distance, bit_count(xor(fp, before)) < 8 AS similar FROM pairs WHERE before IS NOT NULL""")
def fingerprint_distances(spark, sf):
    """Distance of each statement to the one before it in its block of 64."""
    from pyspark.sql import Window

    rows = statements.enrich(_log(spark, sf), "sql_text").select("log_id", "simhash")
    w = Window.partitionBy(F.floor(F.col("log_id") / 64)).orderBy("log_id")
    rows = rows.withColumn("before", F.lag("simhash").over(w)).where(F.col("before").isNotNull())
    a, b = F.col("simhash"), F.col("before")
    return rows.select("log_id", sqltext.hamming(a, b).alias("distance"), sqltext.similar(a, b).alias("similar"))


NEAR = """, distinct_prints AS (SELECT DISTINCT fp FROM prints),
near AS (SELECT x.fp AS a, y.fp AS b, CAST(bit_count(xor(x.fp, y.fp)) AS INTEGER) AS distance FROM distinct_prints x JOIN distinct_prints y
  ON x.fp < y.fp AND bit_count(xor(x.fp, y.fp)) < 8)"""


GROUPED = NEAR + """, links AS (SELECT a AS s, b AS t FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT fp AS s, fp AS t FROM distinct_prints UNION SELECT r.s, l.t FROM reach r JOIN links l ON l.s = r.t),
named AS (SELECT s AS fp, count(*) AS members FROM reach GROUP BY s)"""


@query(f"WITH RECURSIVE {DOCS}{GROUPED} SELECT doc_id, members FROM prints JOIN named USING (fp)")
def similar_text_groups(spark, sf):
    """Connected groups of near fingerprints: how many distinct ones each text's group holds."""
    prints = cut_lineage(_prints(spark, sf), "prints")
    found = similarity.clusters(prints)
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    named = found.join(sizes, "cluster").select("simhash", "members")
    return prints.join(named, "simhash").select("doc_id", "members")


SHAPES = NORMED + """, shapes AS (SELECT normalized_sql AS k, count(*) AS c FROM normed WHERE coalesce(sql_text, '') <> '' GROUP BY 1), """ + simhash("shapes", "k", "k") + """,
seen AS (SELECT fp, sum(c) AS statements FROM prints JOIN shapes USING (k) GROUP BY fp),
links AS (SELECT x.fp AS s, y.fp AS t FROM seen x JOIN seen y ON x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)) < 8),
named(fp, label) USING KEY (fp) AS (SELECT fp, fp FROM seen UNION
  SELECT l.s, min(n.label) FROM named n JOIN links l ON l.t = n.fp JOIN recurring.named r ON r.fp = l.s WHERE n.label < r.label GROUP BY l.s),
sized AS (SELECT label, count(*) AS members FROM named GROUP BY 1)"""


@query(with_views("query_log", more=SHAPES).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT {HEX} AS fingerprint, members, CAST(statements AS BIGINT) AS statements FROM seen JOIN named USING (fp) JOIN sized USING (label)""")
def similar_statement_groups(spark, sf):
    """Statement shapes, how often each was seen, and how many near shapes its group holds."""
    seen = statements.enrich(_log(spark, sf), "sql_text").groupBy("simhash").agg(F.count(F.lit(1)).alias("statements"))
    seen = cut_lineage(seen, "shapes")
    found = similarity.clusters(seen)
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    return seen.join(found.join(sizes, "cluster"), "simhash").select(
        sqltext.hex16(F.col("simhash")).alias("fingerprint"), "members", "statements")


def _count(word: str, c: str = "normalized_sql") -> str:
    return f"CAST((length({c}) - length(replace({c}, '{word}', ''))) / {len(word)} AS DOUBLE)"


@query(with_views("query_log", more=NORMED) + " SELECT log_id, " + ", ".join([
    *[f"CAST(starts_with(normalized_sql, '{w}') AS INTEGER)::DOUBLE AS is_{w.lower()}" for w in ("SELECT", "INSERT", "UPDATE", "DELETE")],
    "CAST(regexp_matches(normalized_sql, '^(CREATE|DROP|ALTER)') AS INTEGER)::DOUBLE AS is_ddl",
    *[f"{_count(w)} AS n_{w.lower().replace(' ', '_')}" for w in ("JOIN", "WHERE", "GROUP BY", "ORDER BY", "LIMIT", "HAVING", "DISTINCT", "UNION")],
    f"{_count('SUBQUERY')} + {_count('SELECT', 'substr(normalized_sql, 2)')} AS n_nested", "length(normalized_sql)::DOUBLE AS n_chars",
]) + " FROM normed")
def statement_features(spark, sf):
    norm = _log(spark, sf).withColumn("n", sqltext.normalize_sql(F.col("sql_text")))
    return norm.select("log_id", *sqltext.features(F.col("n")))


@query(with_views("query_log", more=NORMED) + f""" SELECT {PATTERN} AS access_pattern, count(*) AS statements, count(*) FILTER (log_id // 10 % 2 = 1) AS held_out,
  TRUE AS learned FROM normed WHERE {PATTERN} <> 'unknown' GROUP BY 1""")
def pattern_classifier(spark, sf):
    """A model taught on one half of the statements that rules decide, held against the rules on the other half."""
    log = statements.enrich(_log(spark, sf), "sql_text").withColumn("held", F.floor(F.col("log_id") / 10) % 2 == 1)
    # Every statement is made canonical once; rules and model read the distinct ones, which stand for all.
    ruled = cut_lineage(statements.shapes(log, "access_pattern", "held"), "shapes").where("access_pattern <> 'unknown'")
    held, many = F.col("held"), F.col("statements")
    model = statements.fit_classifier(statements.labelled_features(ruled.where(~held), "normalized_sql", "access_pattern", True, "statements"))
    guessed = statements.model_patterns(ruled, "normalized_sql", model, True)
    right = F.sum(F.when(held & (F.col("guess") == F.col("access_pattern")), many).otherwise(0)) / F.sum(F.when(held, many))
    return guessed.groupBy("access_pattern").agg(
        F.sum("statements").alias("statements"), F.sum(F.when(held, many).otherwise(0)).alias("held_out"), (right > 0.95).alias("learned")
    )


# What the model answers has no SQL; tests hold the counts by rule against DuckDB and the rest against its properties.
@query()
def statement_patterns(spark, sf):
    """Every statement of the log by its answer: how many the rules decided, and how many the model where no rule applies."""
    log = cut_lineage(statements.shapes(statements.enrich(_log(spark, sf), "sql_text"), "access_pattern"), "shapes").withColumnRenamed("access_pattern", "rule")
    model = statements.fit_classifier(statements.labelled_features(log.where("rule <> 'unknown'"), "normalized_sql", "rule", True, "statements"))
    answered = statements.classify_unknown(log, "normalized_sql", model, True)
    by_rule, many = F.col("rule") != "unknown", F.col("statements")
    return answered.groupBy("access_pattern").agg(
        F.sum("statements").alias("statements"), F.sum(F.when(by_rule, many).otherwise(0)).alias("by_rule"), F.sum(F.when(~by_rule, many).otherwise(0)).alias("by_model")
    )


# --- security -------------------------------------------------------------------------------------

INJECTION = " UNION ALL ".join(
    f"SELECT log_id, database_id, 'critical' AS severity, 'sql_injection_{n}' AS anomaly_type, sql_text FROM query_log WHERE regexp_matches(sql_text, '{quoted(p)}', 'i')"
    for n, p in K.INJECTION_PATTERNS.items())
PRIVILEGE = " UNION ALL ".join(
    f"SELECT log_id, database_id, 'high' AS severity, 'privilege_escalation_attempt' AS anomaly_type, sql_text FROM query_log WHERE regexp_matches(sql_text, '{quoted(p)}', 'i')"
    for p in K.PRIVILEGE_PATTERNS)
NAMES = ", ".join(f"'{t}'" for t in K.SENSITIVE_TABLES)
SENSITIVE = rf"""SELECT log_id, database_id, 'medium' AS severity, 'sensitive_table_full_scan' AS anomaly_type, sql_text
  FROM (SELECT *, unnest(regexp_extract_all(sql_text, '\bFROM\s+(\w+)\b', 1, 'i')) AS t FROM query_log)
  WHERE lower(t) IN ({NAMES}) AND regexp_matches(trim(sql_text), '^SELECT\s+\*', 'i')"""
EVENT = ["log_id", "database_id", "severity", "anomaly_type", "sql_sample"]


def _events(spark, sf, *kinds):
    found = security.scan_statements(_log(spark, sf), "sql_text", "ts", keep=("log_id",), kinds=kinds)
    return found.select(*EVENT)


def _scan(sql: str) -> str:
    return with_views("query_log") + f" SELECT log_id, database_id, severity, anomaly_type, substr(sql_text, 1, 500) AS sql_sample FROM ({sql})"


@query(_scan(INJECTION))
def injection_scan(spark, sf):
    return _events(spark, sf, "injection")


@query(_scan(PRIVILEGE))
def privilege_scan(spark, sf):
    return _events(spark, sf, "privilege")


@query(_scan(SENSITIVE))
def sensitive_scan(spark, sf):
    return _events(spark, sf, "sensitive")


@query(_scan(f"{INJECTION} UNION ALL {PRIVILEGE} UNION ALL {SENSITIVE}"))
def security_scan(spark, sf):
    return _events(spark, sf, "injection", "privilege", "sensitive")


# --- lint -----------------------------------------------------------------------------------------

LINTED = r"""low AS (SELECT *, lower(sql_text) AS s FROM query_log),
named AS (SELECT *, nullif(regexp_extract(s, '\bfrom\s+([a-zA-Z_][\w\.]*)', 1), '') AS t,
  regexp_extract_all(s, '(?s)\bwhere\b(.*?)(?:group by|order by|limit|$)', 1)[1] AS clause FROM low),
picked AS (SELECT *, list_filter(regexp_extract_all(coalesce(clause, ''), 'COLUMN', 1), lambda x: x NOT IN ('and', 'or', 'not', 'null')) AS raw FROM named),
uniq AS (SELECT *, list_slice(list_filter(raw, lambda x, i: list_position(raw, x) = i), 1, 3) AS c FROM picked),
advised AS (SELECT *, CASE WHEN t IS NOT NULL AND len(c) > 0 THEN
   concat('CREATE INDEX CONCURRENTLY idx_', replace(t, '.', '_'), '_', array_to_string(c, '_'), ' ON ', t, ' (', array_to_string(c, ', '), ')') END AS index_ddl,
  regexp_matches(s, 'select\s+\*') AS star, contains(s, 'order by') AND NOT contains(s, 'limit') AS ord, regexp_matches(s, 'like\s+''%') AS wild FROM uniq),
linted AS (SELECT *, concat_ws(' | ', CASE WHEN star THEN 'STAR' END, CASE WHEN ord THEN 'ORDER' END, CASE WHEN wild THEN 'WILD' END) AS joined,
  CAST(least(95, CASE WHEN star THEN 15 ELSE 0 END + CASE WHEN index_ddl IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN ord THEN 10 ELSE 0 END
   + CASE WHEN wild THEN 10 ELSE 0 END) AS INTEGER) AS impact_score FROM advised)"""
for word, line in (("STAR", K.LINT_STAR_TEXT), ("ORDER", K.LINT_ORDER_TEXT), ("WILD", K.LINT_WILDCARD_TEXT)):
    LINTED = LINTED.replace(f"'{word}'", f"'{quoted(line)}'")


def _lint_oracle(column: str) -> str:
    return with_views("query_log", more=LINTED.replace("COLUMN", quoted(column))) + f""" SELECT log_id,
  CASE WHEN joined = '' THEN '{K.LINT_NOTHING_TEXT}' ELSE joined END AS issues, index_ddl, impact_score, 0.4::DOUBLE AS confidence FROM linted"""


def _shown(df):
    return df.select("log_id", F.array_join("issues", " | ").alias("issues"), "index_ddl", "impact_score", "confidence")


@query(_lint_oracle(K.LINT_COLUMN))
def statement_lint(spark, sf):
    return _shown(lint.lint(_log(spark, sf), "sql_text"))


@query(_lint_oracle(K.LINT_COLUMN_FIXED))
def statement_lint_spaced(spark, sf):
    """The corrected column pattern, which also reads operators followed by blanks."""
    return _shown(lint.lint(_log(spark, sf), "sql_text", fixed=True))


@query(with_views("query_log", "plan_docs", more=LINTED.replace("COLUMN", quoted(K.LINT_COLUMN))) + """,
rows_of AS (SELECT plan_id, CAST(json_extract(plan_json, '$.Plan."Actual Rows"') AS BIGINT) AS root,
  CAST(json_extract(plan_json, '$.Plan.Plans[0]."Actual Rows"') AS BIGINT) AS scan FROM plan_docs),
scans AS (SELECT plan_id, contains(lower(concat_ws(chr(10), CASE WHEN scan > 500 THEN 'SEQ SCANS (1):' END,
  CASE WHEN scan > 100 AND abs(scan - 20) / 20.0 > 10 THEN '  - Seq Scan on orders: estimated=20' END)), 'seq scan') AS seq FROM rows_of)
SELECT log_id, CAST(least(95, impact_score + CASE WHEN seq THEN 20 ELSE 0 END) AS INTEGER) AS impact_score FROM linted JOIN scans ON plan_id = log_id""")
def lint_with_plans(spark, sf):
    """The statement's own plan adds a finding when it holds a reported sequential scan."""
    plans = corpus.plan_summaries(corpus.parse_plans(spread(view(spark, sf, "plan_docs")), fields=corpus.FOR_SUMMARIES)).select(
        F.col("plan_id").alias("log_id"), "has_seq_scan"
    )
    # As many rows as statements, which the planner cannot tell from the Python pass: never to be broadcast.
    joined = _log(spark, sf).join(plans.hint("merge"), "log_id", "left")
    return lint.lint(joined, "sql_text", seq_scan=F.col("has_seq_scan")).select("log_id", "impact_score")


@query(with_views("query_log", more=LINTED.replace("COLUMN", quoted(K.LINT_COLUMN))) + """ SELECT database_id,
  concat('Optimization for query (impact ', impact_score, '/100)') AS title, CASE WHEN index_ddl IS NULL THEN 'query_rewrite' ELSE 'index' END AS proposal_type,
  'proposed' AS state, sql_text AS original_sql, coalesce(index_ddl, '') AS ddl, CASE WHEN index_ddl IS NOT NULL THEN 50::DOUBLE END AS estimated_improvement_pct,
  impact_score::DOUBLE AS estimated_impact_score, ts AS created_at FROM linted""")
def lint_proposals(spark, sf):
    out = lint.proposals_from_lint(lint.lint(_log(spark, sf), "sql_text"), "sql_text", "ts")
    return out.withColumn("ddl", F.array_join("ddl_statements", "; ")).drop("ddl_statements")


# --- slow statements and snapshots ----------------------------------------------------------------

SLOW = """slow AS (SELECT * FROM (SELECT *, total_exec_time / calls AS mean_time_ms, row_number() OVER
  (PARTITION BY database_id, poll_date ORDER BY total_exec_time / calls DESC, queryid) AS rn FROM statement_stats
  WHERE calls > 5 AND total_exec_time / calls > 100) WHERE rn <= 50)"""


def _stats(spark, sf):
    return view(spark, sf, "statement_stats").withColumnRenamed("poll_date", "poll_time")


def _slow(spark, sf):
    return statements.slow_statements(_stats(spark, sf), 100.0)


@query(with_views("statement_stats", more=SLOW) + """ SELECT database_id, CAST(poll_date AS VARCHAR) AS poll, queryid, query, calls,
  round(mean_time_ms, 9) AS mean_time_ms, CAST(row_count // calls AS BIGINT) AS avg_rows FROM slow""")
def slow_statements(spark, sf):
    out = _slow(spark, sf).select("database_id", F.col("poll_time").cast("string").alias("poll"), "queryid", "query",
                                  "calls", "mean_time_ms", "avg_rows")
    return rounded(out, "mean_time_ms")


@query(with_views("statement_stats", more="""ranked AS (SELECT *, total_exec_time / calls AS m, row_number() OVER (PARTITION BY database_id, poll_date
  ORDER BY total_exec_time / calls DESC, queryid) AS rn FROM statement_stats WHERE calls > 5 AND total_exec_time / calls > 200)""") + """
SELECT database_id, CAST(poll_date AS VARCHAR) AS poll, queryid, calls, round(m, 9) AS mean_time_ms, round(total_exec_time, 9) AS total_time_ms FROM ranked WHERE rn <= 50""")
def slow_digests(spark, sf):
    """Digest rows whose timers are picoseconds."""
    digests = _stats(spark, sf).withColumn("avg_timer_wait", F.col("total_exec_time") / F.col("calls") * 1e9).withColumn(
        "sum_timer_wait", F.col("total_exec_time") * 1e9
    )
    out = statements.slow_digests(digests, 200.0).select(
        "database_id", F.col("poll_time").cast("string").alias("poll"), "queryid", "calls", "mean_time_ms", "total_time_ms")
    return rounded(out, "mean_time_ms", "total_time_ms")


ENRICHED = SLOW + f""", normed AS (SELECT *, {normal('query')} AS normalized_sql, concat(database_id, poll_date, '#', queryid) AS k FROM slow), """ + simhash(
    "normed", "k", "normalized_sql") + f""",
snaps AS (SELECT {HEX} AS fingerprint, database_id, normalized_sql, query AS sample_sql, calls AS call_count, mean_time_ms,
  total_exec_time AS total_time_ms, {PATTERN} AS access_pattern, poll_date, CAST(queryid AS VARCHAR) AS queryid FROM normed JOIN prints USING (k)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, database_id ORDER BY poll_date, mean_time_ms DESC, queryid) AS up,
  row_number() OVER (PARTITION BY fingerprint, database_id ORDER BY poll_date DESC, mean_time_ms, queryid DESC) AS down FROM snaps),
merged AS (SELECT f.fingerprint, f.database_id, f.normalized_sql, f.sample_sql, f.access_pattern, l.call_count, l.mean_time_ms, l.total_time_ms, l.poll_date
  FROM ordered f JOIN ordered l ON f.fingerprint = l.fingerprint AND f.database_id = l.database_id AND f.up = 1 AND l.down = 1)"""


def _snapshots(spark, sf):
    return statements.merge_snapshots(statements.snapshot_rows(statements.enrich(_slow(spark, sf))))


@query(with_views("statement_stats", more=ENRICHED) + """ SELECT fingerprint, database_id, normalized_sql, sample_sql, access_pattern, call_count,
  round(mean_time_ms, 9) AS mean_time_ms, round(total_time_ms, 9) AS total_time_ms, CAST(poll_date AS VARCHAR) AS last_seen FROM merged""")
def query_snapshots(spark, sf):
    """Slow statements enriched and merged: first-seen texts, last-seen numbers."""
    out = _snapshots(spark, sf).withColumn("last_seen", F.col("last_seen_at").cast("string"))
    return rounded(out.drop("first_rank", "last_rank", "queryid", "last_seen_at"), "mean_time_ms", "total_time_ms")


@query(with_views("statement_stats", more=ENRICHED) + """ SELECT fingerprint, database_id, round(mean_time_ms, 9) AS mean_time_ms, band FROM (
  SELECT *, row_number() OVER (PARTITION BY database_id ORDER BY mean_time_ms DESC, fingerprint) AS rn,
  CASE WHEN mean_time_ms > 2000 THEN 'red' WHEN mean_time_ms > 500 THEN 'orange' ELSE 'green' END AS band FROM merged) WHERE rn <= 20""")
def top_slow_statements(spark, sf):
    from fleetlens.functions.snapshot import statement_band

    out = statements.top_slow(_snapshots(spark, sf), 20).withColumn("band", statement_band(F.col("mean_time_ms")))
    return rounded(out.select("fingerprint", "database_id", "mean_time_ms", "band"), "mean_time_ms")


@query(with_views("statement_stats", more=ENRICHED) + """ SELECT database_id, access_pattern, CAST(sum(call_count) AS BIGINT) AS calls,
  round(sum(total_time_ms), 9) AS total_time_ms, count(*) AS statements,
  round(sum(total_time_ms) / sum(sum(total_time_ms)) OVER (PARTITION BY database_id), 9) AS time_share FROM merged GROUP BY 1, 2""")
def workload_summary(spark, sf):
    return rounded(rollups.workload_summary(_snapshots(spark, sf)), "time_share", "total_time_ms")


@query(with_views("statement_stats", more=SLOW + f""", texts AS (SELECT *, CAST(round(mean_time_ms, 9) AS VARCHAR) AS mean_text,
  {normal('query')} AS normal FROM slow)""") + """ SELECT database_id, CAST(poll_date AS VARCHAR) AS poll, CAST((rn - 1) // 20 AS BIGINT) AS batch,
  CAST(count(*) AS INTEGER) AS rows, concat('Analyze these ', count(*), ' slow postgresql queries as a batch.', chr(10), chr(10),
   string_agg(concat('QUERY ', (rn - 1) % 20 + 1, ' (avg ', mean_text, 'ms):', chr(10), '```sql', chr(10), normal, chr(10), '```'), chr(10) ORDER BY rn), chr(10), chr(10),
   'Return a JSON array with one optimization object per query, same schema as single-query analysis.') AS body FROM texts GROUP BY 1, 2, 3""")
def query_batches(spark, sf):
    """Slow statements of a poll in numbered groups of 20."""
    slow = _slow(spark, sf).withColumn("poll", F.col("poll_time").cast("string")).withColumn("slowness", -F.col("mean_time_ms"))
    out = conversation.batch_rows(
        slow, ["database_id", "poll"], [F.asc("slowness"), F.asc("queryid")],
        lambda number: conversation.query_text(number, F.round("mean_time_ms", 9), sqltext.normalize_sql(F.col("query"))),
    )
    return out.withColumn("body", conversation.query_batch_text(F.col("rows"), F.col("body")))


# --- gates and free text --------------------------------------------------------------------------

WORDS = "|".join(K.FORBIDDEN_WORDS)


@query(with_views("query_log", more=rf"""given AS (SELECT log_id, CASE WHEN log_id % 3 = 0 THEN concat('  ', sql_text, ';; ')
   WHEN log_id % 7 = 0 THEN concat(sql_text, ' LIMIT 7') ELSE sql_text END AS s FROM query_log),
clean AS (SELECT log_id, trim(regexp_replace(trim(s), ';+$', '')) AS s FROM given),
judged AS (SELECT log_id, CASE WHEN s <> '' AND NOT contains(s, ';') AND (starts_with(lower(s), 'select') OR starts_with(lower(s), 'with'))
  AND NOT regexp_matches(s, '\b({WORDS})\b', 'i') THEN CASE WHEN regexp_matches(lower(s), '\blimit\s+\d+') THEN s ELSE concat(s, ' LIMIT 100') END END AS safe_sql FROM clean)""") + """
SELECT log_id, safe_sql IS NOT NULL AS is_safe, safe_sql FROM judged""")
def readonly_gate(spark, sf):
    i, s = F.col("log_id"), F.col("sql_text")
    given = F.when(i % 3 == 0, F.concat(F.lit("  "), s, F.lit(";; "))).when(i % 7 == 0, F.concat(s, F.lit(" LIMIT 7"))).otherwise(s)
    safe = sqltext.safe_select(given)
    return _log(spark, sf).select("log_id", safe.isNotNull().alias("is_safe"), safe.alias("safe_sql"))


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice DESC, o_orderkey) LIMIT 100")
def adhoc_query(spark, sf):
    """A gated ad-hoc statement over the store; its row limit is the feature."""
    from fleetlens.sources.adhoc import run_readonly

    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return run_readonly(
        spark, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > :floor ORDER BY o_totalprice DESC, o_orderkey;",
        {"floor": 400000},
    )


ANSWERS = """answers AS (SELECT 'event' AS kind, event_id AS id, CASE event_id % 4 WHEN 0 THEN concat('Here you go: ```json', chr(10), props, chr(10), '```')
   WHEN 1 THEN concat('The result is ', props) WHEN 2 THEN concat('[1, ', props, ']') ELSE concat('broken ', substr(props, 1, 4)) END AS raw FROM events
 UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)"""


@query(f"""WITH {ANSWERS}, bare AS (SELECT *, regexp_replace(regexp_replace(raw, '```json\\s*', '', 'g'), '```\\s*', '', 'g') AS t FROM answers),
cut AS (SELECT *, CASE WHEN least(nullif(position('{{' IN t), 0), nullif(position('[' IN t), 0)) IS NOT NULL
  THEN trim(substr(t, least(nullif(position('{{' IN t), 0), nullif(position('[' IN t), 0)))) END AS j FROM bare)
SELECT kind, id, coalesce(json_valid(j), false) AS parsed, CASE WHEN json_valid(j) THEN coalesce(CAST(json_extract(j, '$.k') AS BIGINT), CAST(json_extract(j, '$[1].k') AS BIGINT)) END AS k FROM cut""")
def json_recovery(spark, sf):
    """JSON found in answers; prose stays prose."""
    i = F.col("event_id")
    props = F.col("props")
    wrapped = F.when(i % 4 == 0, F.concat(F.lit("Here you go: ```json\n"), props, F.lit("\n```"))).when(
        i % 4 == 1, F.concat(F.lit("The result is "), props)
    ).when(i % 4 == 2, F.concat(F.lit("[1, "), props, F.lit("]"))).otherwise(F.concat(F.lit("broken "), F.substring(props, 1, 4)))
    answers = table(spark, sf, "events").select(F.lit("event").alias("kind"), i.alias("id"), wrapped.alias("raw")).unionByName(
        table(spark, sf, "conversations").select(
            F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("raw"))
    )
    found = answers.withColumn("v", text.json_from_text(F.col("raw")))
    return found.select(
        "kind", "id", F.col("v").isNotNull().alias("parsed"),
        F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.try_variant_get("v", "$[1].k", "bigint")).alias("k"),
    )


QUESTIONS = """asked AS (SELECT conv_id, turn, concat(CASE (conv_id + turn) % 10 WHEN 0 THEN 'What are the top 12 slowest queries? ' WHEN 1 THEN 'How many active connections are there? '
  WHEN 2 THEN 'What is the cache hit ratio? ' WHEN 3 THEN 'Are there any lock waits or deadlocks? ' WHEN 4 THEN 'Give me a health summary '
  WHEN 5 THEN 'Any suspicious activity? ' WHEN 6 THEN 'List 300 alerts ' WHEN 7 THEN 'What if we add 0 replicas? ' ELSE '' END, text) AS q FROM conversations WHERE role = 'user')"""


@query(f"""WITH {QUESTIONS}, low AS (SELECT *, lower(q) AS l, regexp_extract(lower(q), '\\b(\\d+)\\b', 1) AS d FROM asked)
SELECT conv_id, turn, CASE WHEN (contains(l, 'slow') AND (contains(l, 'quer') OR contains(l, 'sql'))) OR contains(l, 'slowest') THEN 'slow_queries'
  WHEN contains(l, 'connection') THEN 'connections' WHEN contains(l, 'cache') THEN 'cache' WHEN contains(l, 'lock') THEN 'locks'
  WHEN regexp_matches(l, 'security|injection|suspicious') THEN 'security_alerts' WHEN regexp_matches(l, 'alert|anomal') THEN 'alerts'
  WHEN regexp_matches(l, 'health|summary|status|how is|overview') THEN 'health' ELSE 'none' END AS intent,
  regexp_matches(l, 'what would happen|what if|simulate|predict') AS what_if,
  CAST(CASE WHEN d = '' THEN 5 ELSE greatest(1, least(25, CAST(d AS HUGEINT))) END AS INTEGER) AS n FROM low""")
def question_intents(spark, sf):
    heads = ["What are the top 12 slowest queries? ", "How many active connections are there? ", "What is the cache hit ratio? ",
             "Are there any lock waits or deadlocks? ", "Give me a health summary ", "Any suspicious activity? ",
             "List 300 alerts ", "What if we add 0 replicas? ", "", ""]
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    head = F.get(F.array(*map(F.lit, heads)), ((F.col("conv_id") + F.col("turn")) % 10).cast("int"))
    q = F.concat(head, "text")
    return turns.select("conv_id", "turn", text.intent(q).alias("intent"), text.is_what_if(q).alias("what_if"), text.requested_rows(q).alias("n"))


@query("""SELECT conv_id, turn, md5(concat('sys:', text)) AS request_key, length(text) AS answer FROM conversations""")
def memoised_requests(spark, sf):
    """Each distinct request evaluated once, its answer given to all copies."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    out = conversation.evaluate_once(
        turns, F.lit("sys"), F.col("text"),
        lambda d: d.select("request_key", F.length("prompt").cast("bigint").alias("answer")),
    )
    return out.select("conv_id", "turn", "request_key", "answer")
