"""Fixed values. Results depend on them being exactly these."""

# --- statement normalisation and classification -------------------------------------------------
# Literal and comment patterns.
LINE_COMMENT = r"--[^\n]*"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
STRING_LITERAL = r"'[^']*'|\"[^\"]*\""
IN_LIST = r"(?iU)\bIN\s*\([^)]+\)"
NUMBER_LITERAL = r"(?U)\b\d+(\.\d+)?\b"

# Access-pattern names in label order.
ACCESS_PATTERNS = ["oltp_point", "olap_scan", "batch_insert", "ddl", "unknown"]

# Access-pattern rules.
DDL_HEAD = r"^(CREATE|DROP|ALTER|TRUNCATE|RENAME)\b"
INSERT_HEAD = r"^INSERT\b"
POINT_HEAD = r"^(SELECT|UPDATE|DELETE)\b"
WHERE_WORD = r"\bWHERE\b"
GROUPING_WORD = r"\b(GROUP BY|HAVING|DISTINCT)\b"
TWO_JOINS = r"\bJOIN\b.*\bJOIN\b"
AGGREGATE_WORD = r"\b(GROUP BY|HAVING|SUM\(|COUNT\(|AVG\(|MAX\(|MIN\()\b"

# --- security scan --------------------------------------------------------------------------------
# Injection patterns, all case-insensitive.
INJECTION_PATTERNS = {
    "always_true_predicate": r"WHERE\s+['\"]?\d+['\"]?\s*=\s*['\"]?\d+['\"]?",
    "comment_injection": r"WHERE\s+\w+\s*=\s*\w+\s*--",
    "union_null_injection": r"UNION\s+(ALL\s+)?SELECT\s+NULL",
    "union_int_injection": r"UNION\s+(ALL\s+)?SELECT\s+\d+,\d+",
    "stacked_query": r";\s*(DROP|DELETE|UPDATE|INSERT|CREATE)\s",
    "time_based_blind": r"SLEEP\s*\(",
    "time_based_blind_pg": r"pg_sleep\s*\(",
    "time_based_blind_mssql": r"WAITFOR\s+DELAY",
    "schema_probing": r"FROM\s+information_schema\.(tables|columns|user_privileges)",
    "pg_user_probing": r"FROM\s+pg_catalog\.(pg_user|pg_shadow|pg_authid)",
    "encoded_payload": r"(0x[0-9a-f]{8,}|CHAR\(\d+\))",
}

# Privilege patterns, all case-insensitive.
PRIVILEGE_PATTERNS = [
    r"\bGRANT\s+\w+\s+ON\b",
    r"\bCREATE\s+(USER|ROLE)\b",
    r"\bALTER\s+(USER|ROLE)\b",
    r"\bDROP\s+(USER|ROLE)\b",
    r"\bGRANT\s+ALL\b",
]

# Sensitive table names.
SENSITIVE_TABLES = [
    "users", "user", "accounts", "account", "passwords", "credentials", "credit_cards",
    "payment_methods", "tokens", "sessions", "secrets", "api_keys", "admin", "admins", "roles",
    "permissions",
]

# Prefixes of security alert types.
SECURITY_PREFIXES = ["sql_injection", "privilege_escalation", "sensitive_table"]

# --- statement gate, lint -------------------------------------------------------------------------
# Words a read-only statement must not hold.
FORBIDDEN_WORDS = [
    "insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke", "copy",
    "merge", "vacuum", "reindex", "call",
]

# Lint patterns, scores and texts.
LINT_FROM = r"\bfrom\s+([a-zA-Z_][\w\.]*)"
LINT_STAR = r"select\s+\*"
LINT_WHERE = r"(?s)\bwhere\b(.*?)(?:group by|order by|limit|$)"
LINT_COLUMN = r"([a-zA-Z_][\w]*)\s*(?:=|>|<|>=|<=|like|in)\b"
LINT_COLUMN_FIXED = r"([a-zA-Z_][\w]*)\s*(?:>=|<=|=|>|<|\b(?:like|in)\b)"
LINT_NOT_COLUMNS = ["and", "or", "not", "null"]
LINT_LEADING_WILDCARD = r"like\s+'%"
LINT_SCORES = {"select_star": 15, "index": 40, "order_by": 10, "wildcard": 10, "seq_scan": 20}
LINT_CAP = 95
LINT_CONFIDENCE = 0.4
LINT_IMPROVEMENT = 50
LINT_STAR_TEXT = "Query uses SELECT * which reads unnecessary columns and bloats I/O."
LINT_ORDER_TEXT = "ORDER BY without LIMIT may sort the entire result set; consider pagination."
LINT_WILDCARD_TEXT = (
    "Leading-wildcard LIKE ('%...') cannot use a b-tree index; consider trigram/GIN index."
)
LINT_SEQ_SCAN_TEXT = "Sequential scan detected in EXPLAIN plan; an index may eliminate it."
LINT_NOTHING_TEXT = "No obvious heuristic issues found; full LLM analysis recommended."

# --- plan corpus ----------------------------------------------------------------------------------
# Plan filter column pattern and excluded words.
PLAN_COLUMN = r"\b([a-z_][a-z0-9_]*)\s*(?:=|>|<|>=|<=|LIKE|IN)"
PLAN_COLUMN_FIXED = r"\b([a-z_][a-z0-9_]*)\s*(?:>=|<=|=|>|<|\b(?:LIKE|IN)\b)"
PLAN_NOT_COLUMNS = ["and", "or", "not", "null", "true", "false", "is"]

# --- alerts ---------------------------------------------------------------------------------------
# Severity to colour and delivery route.
SEVERITY_COLORS = {
    "p1": "#FF0000", "p2": "#FFA500", "p3": "#36A64F", "critical": "#FF0000", "high": "#FFA500",
    "medium": "#FFD700", "low": "#36A64F",
}
DEFAULT_COLOR = "#808080"
SEVERITY_ROUTES = {"p1": "page", "critical": "page", "p2": "chat", "high": "chat"}
DEFAULT_ROUTE = "digest"

# Proposal event labels.
PROPOSAL_MARKS = {
    "created": "🔍", "approved": "✅", "deployed": "🚀",
    "rolled_back": "⏮️", "rejected": "❌",
}
DEFAULT_MARK = "ℹ️"

# Metrics scored by the rolling detectors.
ZSCORE_METRICS = ["active_connections", "lock_waits", "deadlocks", "replication_lag_seconds"]

# --- capacity -------------------------------------------------------------------------------------
# Metrics that may be forecast, and the default fan-out.
FORECASTABLE = [
    "active_connections", "max_connections", "cache_hit_ratio", "qps", "p50_latency_ms",
    "p95_latency_ms", "p99_latency_ms", "replication_lag_seconds", "lock_waits", "deadlocks",
]
FORECAST_DEFAULT = ["active_connections", "p99_latency_ms", "qps", "cache_hit_ratio"]

# Capacity thresholds: (metric, absolute, growth, share, unit, recommendation).
CAPACITY_THRESHOLDS = [
    ("active_connections", None, None, 0.85, "connections",
     "Increase max_connections or add PgBouncer connection pooling"),
    ("disk_usage_bytes", None, None, 0.80, "bytes",
     "Provision additional storage or archive cold data to S3"),
    ("p99_latency_ms", 2000.0, None, None, "ms",
     "Review top slow queries and add missing indexes"),
    ("qps", None, 2.0, None, "queries/sec",
     "Consider read replicas or query caching layer"),
]
CAPACITY_WARNING_DAYS = 28

# --- workflow -------------------------------------------------------------------------------------
# Workflow states and legal (state, trigger) -> state moves.
STATES = [
    "proposed", "reviewed", "approved", "testing", "deploying", "monitoring", "completed",
    "rolled_back", "rejected",
]
CLOSED_STATES = ["completed", "rolled_back", "rejected"]
TRANSITIONS = {
    ("proposed", "review"): "reviewed",
    ("reviewed", "approve"): "approved",
    ("approved", "start_test"): "testing",
    ("testing", "deploy"): "deploying",
    ("deploying", "monitor"): "monitoring",
    ("monitoring", "complete"): "completed",
    ("reviewed", "reject"): "rejected",
    ("proposed", "reject"): "rejected",
    ("deploying", "rollback"): "rolled_back",
    ("monitoring", "rollback"): "rolled_back",
    ("testing", "deploy_and_monitor"): "monitoring",
}
