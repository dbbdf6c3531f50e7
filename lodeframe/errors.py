"""Errors of queries, as kinds that a program can act on."""

from __future__ import annotations

import re

# The kinds of query errors and the hint that goes with each.
HINTS = {
    "empty": "Send one SELECT statement.",
    "too_long": "Send a shorter statement; at most {limit} characters are accepted.",
    "multiple_statements": "Send one statement at a time.",
    "not_read_only": "Only reading statements are accepted: SELECT, WITH, FROM, DESCRIBE, SHOW TABLES, SUMMARIZE.",
    "syntax": "Check the SQL syntax near the place that is named.",
    "unknown_table": "Use one of the tables: {tables}.",
    "unknown_column": "Use DESCRIBE <table> to see a table's columns.",
    "binder": "Check names, functions, their arguments, and GROUP BY.",
    "type_error": "Check literals and casts; try_cast gives null instead of an error.",
    "forbidden": "Files, functions that reach outside, and system objects can't be used; query the tables.",
    "timeout": "Narrow the query: filter early, aggregate, or take fewer rows.",
    "out_of_memory": "Narrow the query: fewer groups, fewer columns, or filters.",
    "execution": "The query failed while it ran; check values such as zero divisors.",
    "unavailable": "There is no data version to query; refresh first.",
}
MESSAGE_CHARS = 1500


class QueryError(Exception):
    def __init__(self, kind: str, message: str, sql: str = "", **hint: object):
        super().__init__(message)
        self.kind, self.sql = kind, sql
        self.message = message if len(message) <= MESSAGE_CHARS else message[: MESSAGE_CHARS - 1] + "…"
        self.hint = HINTS[kind].format(**({"limit": "?", "tables": "?"} | hint))

    @property
    def retryable(self) -> bool:
        """Whether another statement may do."""
        return self.kind != "unavailable"

    def to_llm(self) -> str:
        return f"Query error ({self.kind}): {self.message}\nHint: {self.hint}"

    def to_dict(self) -> dict:
        return {"kind": self.kind, "message": self.message, "hint": self.hint, "retryable": self.retryable, "sql": self.sql}


# Beginnings of Spark's error conditions and the kinds they mean.
CONDITIONS = (
    ("INVALID_TYPED_LITERAL", "type_error"), ("PARSE_", "syntax"), ("INVALID_IDENTIFIER", "syntax"), ("UNCLOSED_", "syntax"), ("INVALID_SQL_SYNTAX", "syntax"), ("TABLE_OR_VIEW_NOT_FOUND", "unknown_table"),
    ("UNRESOLVED_COLUMN", "unknown_column"), ("UNRESOLVED_FIELD", "unknown_column"), ("UNRESOLVED_USING_COLUMN_FOR_JOIN", "unknown_column"), ("FIELD_NOT_FOUND", "unknown_column"),
    ("UNRESOLVABLE_TABLE_VALUED_FUNCTION", "forbidden"), ("FAILED_READ_FILE", "execution"), ("UNSUPPORTED_DATASOURCE_FOR_DIRECT_QUERY", "forbidden"),
    ("CAST_", "type_error"), ("DATATYPE_MISMATCH", "type_error"), ("CANNOT_PARSE_", "type_error"), ("INVALID_FRACTION", "type_error"), ("NUMERIC_VALUE_OUT_OF_RANGE", "type_error"), ("CANNOT_UP_CAST", "type_error"),
    ("USER_RAISED_EXCEPTION", "execution"), ("DIVIDE_BY_ZERO", "execution"), ("ARITHMETIC_OVERFLOW", "execution"), ("INVALID_ARRAY_INDEX", "execution"), ("SCALAR_SUBQUERY_TOO_MANY_ROWS", "execution"),
)


def classified(error: BaseException, sql: str, tables: list[str]) -> QueryError:
    """The QueryError that a Spark error means."""
    from pyspark.errors import AnalysisException, ParseException, PySparkException

    if isinstance(error, QueryError):
        return error
    text = str(error)
    condition = (error.getCondition() if isinstance(error, PySparkException) else None) or (m[1] if (m := re.search(r"\[([A-Z][A-Z_.0-9]+)\]", text)) else "")
    message = re.sub(r"\s*;?\s*\n('?[A-Z]\w+ .*|[+:]- .*)(\n.*)*$", "", text.split("\nJVM stacktrace")[0]).strip()
    message = re.sub(r"^(?:An error occurred while calling \S+\s*:?|org\.apache\.spark\.\S+:)\s*", "", message)
    if "SPARK_JOB_CANCELLED" in text or "cancelled" in text and "job group" in text:
        return QueryError("timeout", "the query was cancelled at its time limit", sql)
    if "OutOfMemoryError" in text:
        return QueryError("out_of_memory", message, sql)
    kind = next((k for c, k in CONDITIONS if condition.startswith(c)), None)
    if kind is None:
        kind = "syntax" if isinstance(error, ParseException) else "binder" if isinstance(error, AnalysisException) else "execution"
    if kind == "unknown_table" and re.search(r"`(?:/|[a-z]+:/|[^`]*\.(?:parquet|csv|json|orc|yaml|txt)\b)|`(?:parquet|csv|json|orc|text|avro|binaryfile|jdbc)`\.`", text, re.IGNORECASE):
        kind = "forbidden"
    place = _place(error, sql)
    if kind == "unknown_column" and "Candidate" not in message and (m := re.search(r"\[(`[^\]]+)\]", message)):
        message += f" Candidate bindings: {m[1]}."
    if kind == "unknown_table":
        import difflib

        name = (re.search(r"(?:table or view|view) `([^`]+)`", message) or re.search(r"`([^`]+)`", message) or [None, ""])[1]
        close = difflib.get_close_matches(name, tables, 1, 0.6)
        message += f" Did you mean {close[0]}?" if close else ""
    return QueryError(kind, f"{place}{message}", sql, tables=", ".join(t for t in tables if not t.startswith("_")))


def _place(error: BaseException, sql: str) -> str:
    if m := re.search(r"\(line (\d+), pos (\d+)\)", str(error)):
        return f"LINE {m[1]}: "
    try:
        start = error.getQueryContext()[0].startIndex()
    except Exception:  # noqa: BLE001  not every error has a place
        return ""
    return f"LINE {sql[: max(0, start)].count(chr(10)) + 1}: "
