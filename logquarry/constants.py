"""Names, word lists and tables that results depend on."""

from __future__ import annotations

#: Statement keywords in matching order, with the prefix of a query id.
QUERY_PREFIXES = [
    ("SELECT", "se-"), ("INSERT", "in-"), ("UPDATE", "up-"), ("DELETE", "de-"), ("MERGE", "me-"), ("COPY", "co-"), ("WITH", "wi-"),
    ("CREATE", "cr-"), ("DROP", "dr-"), ("ALTER", "al-"), ("TRUNCATE", "tr-"), ("COMMENT", "cm-"), ("REFRESH", "mv-"),
    ("BEGIN", "be-"), ("COMMIT", "ct-"), ("ROLLBACK", "rb-"), ("SAVEPOINT", "sv-"), ("RELEASE", "rl-"), ("START", "st-"), ("END", "en-"),
    ("ABORT", "ab-"), ("PREPARE", "pr-"), ("DEALLOCATE", "dl-"), ("DECLARE", "dc-"), ("FETCH", "fe-"), ("CLOSE", "cl-"), ("MOVE", "mo-"),
    ("EXPLAIN", "ex-"), ("ANALYZE", "an-"), ("VACUUM", "va-"), ("REINDEX", "ri-"), ("CLUSTER", "cu-"), ("LOCK", "lk-"), ("UNLISTEN", "ul-"),
    ("LISTEN", "li-"), ("NOTIFY", "no-"), ("DISCARD", "di-"), ("RESET", "re-"), ("SET", "se-"), ("SHOW", "sh-"), ("LOAD", "lo-"),
    ("CALL", "ca-"), ("DO", "do-"), ("EXECUTE", "xe-"), ("GRANT", "gr-"), ("REVOKE", "rv-"),
]

#: Statement types of each category.
QUERY_CATEGORIES = {
    "DML": ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE"],
    "COPY": ["COPY"],
    "CTE": ["WITH"],
    "DDL": ["CREATE", "DROP", "ALTER", "TRUNCATE", "COMMENT", "REFRESH"],
    "TCL": ["BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE", "START", "END", "ABORT", "PREPARE", "DEALLOCATE"],
    "CURSOR": ["DECLARE", "FETCH", "CLOSE", "MOVE"],
    "UTILITY": [
        "EXPLAIN", "ANALYZE", "VACUUM", "REINDEX", "CLUSTER", "LOCK", "UNLISTEN", "LISTEN", "NOTIFY", "DISCARD",
        "RESET", "SHOW", "LOAD", "CALL", "DO", "EXECUTE", "GRANT", "REVOKE", "SET",
    ],
}

#: Severities in order of weight.
SEVERITIES = ["PANIC", "FATAL", "ERROR", "WARNING", "NOTICE", "LOG", "INFO", "DEBUG"]
#: Markers that a fingerprint starts after, in the order they are looked for, and those that end it.
EVENT_MARKERS = ["PANIC:", "FATAL:", "ERROR:", "WARNING:", "NOTICE:", "LOG:", "INFO:", "DEBUG:", "DETAIL:", "HINT:", "CONTEXT:", "STATEMENT:"]
EVENT_SUFFIXES = [" DETAIL:", " HINT:", " QUERY:", " STATEMENT:", " CONTEXT:", " SQLSTATE =", " LOCATION:"]
#: Markers that end a value that may hold spaces.
VALUE_ENDS = [" LOG:", " ERROR:", " WARNING:", " FATAL:", " PANIC:"]

#: SQLSTATE classes (PostgreSQL documentation, appendix A).
SQLSTATE_CLASSES = {
    "00": "Successful Completion", "01": "Warning", "02": "No Data", "03": "SQL Statement Not Yet Complete", "08": "Connection Exception",
    "09": "Triggered Action Exception", "0A": "Feature Not Supported", "0B": "Invalid Transaction Initiation", "0F": "Locator Exception",
    "0L": "Invalid Grantor", "0P": "Invalid Role Specification", "0Z": "Diagnostics Exception", "20": "Case Not Found",
    "21": "Cardinality Violation", "22": "Data Exception", "23": "Integrity Constraint Violation", "24": "Invalid Cursor State",
    "25": "Invalid Transaction State", "26": "Invalid SQL Statement Name", "27": "Triggered Data Change Violation",
    "28": "Invalid Authorization Specification", "2B": "Dependent Privilege Descriptors Still Exist", "2D": "Invalid Transaction Termination",
    "2F": "SQL Routine Exception", "34": "Invalid Cursor Name", "38": "External Routine Exception", "39": "External Routine Invocation Exception",
    "3B": "Savepoint Exception", "3D": "Invalid Catalog Name", "3F": "Invalid Schema Name", "40": "Transaction Rollback",
    "42": "Syntax Error or Access Rule Violation", "44": "WITH CHECK OPTION Violation", "53": "Insufficient Resources",
    "54": "Program Limit Exceeded", "55": "Object Not In Prerequisite State", "57": "Operator Intervention", "58": "System Error",
    "F0": "Configuration File Error", "HV": "Foreign Data Wrapper Error", "P0": "PL/pgSQL Error", "XX": "Internal Error",
}

#: Buckets of session and statement durations (upper bounds), and the page size.
SESSION_BUCKETS = [("< 1s", 1_000_000), ("1s - 1min", 60_000_000), ("1min - 30min", 1_800_000_000), ("30min - 2h", 7_200_000_000), ("2h - 5h", 18_000_000_000), ("> 5h", None)]
DURATION_BUCKETS = [("< 1 ms", 1.0), ("< 10 ms", 10.0), ("< 100 ms", 100.0), ("< 1 s", 1000.0), ("< 10 s", 10000.0), (">= 10 s", None)]
PAGE_BYTES = 8192

#: Report sections in their order.
SECTIONS = ["summary", "sql_performance", "events", "errors", "sql_summary", "tempfiles", "locks", "maintenance", "checkpoints", "connections", "clients", "sql_overview"]

#: Csvlog columns.
CSV_COLUMNS = [
    "log_time", "user_name", "database_name", "process_id", "connection_from", "session_id", "session_line_num", "command_tag",
    "session_start_time", "virtual_transaction_id", "transaction_id", "error_severity", "sql_state_code", "message", "detail", "hint",
    "internal_query", "internal_query_pos", "context", "query", "query_pos", "location", "application_name", "backend_type", "leader_pid", "query_id",
]
