"""The query engine: one untrusted statement at a time, guarded, limited in rows and time, with structured errors."""

from __future__ import annotations

import logging
import re
import threading
import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from lodeframe import guard
from lodeframe.catalog import Catalog, CatalogError, Version
from lodeframe.contract import Contract, type_name
from lodeframe.errors import QueryError, classified
from lodeframe.operators.profile import summarize
from lodeframe.sources.files import register

log = logging.getLogger(__name__)
GRACE = 5.0  # seconds that a cancelled query is waited for


@dataclass(frozen=True)
class Limits:
    max_rows: int = 1000
    timeout_seconds: float = 30.0
    max_sql_chars: int = 20_000
    explain_before_execute: bool = True
    log_sql_max_chars: int = 4000


@dataclass(frozen=True)
class Result:
    columns: list[str]
    types: list[str]
    rows: list[tuple]
    truncated: bool
    max_rows: int
    duration_ms: float
    query_id: str
    data_version: Version
    sql: str

    @property
    def row_count(self) -> int:
        return len(self.rows)

    def to_records(self) -> list[dict[str, Any]]:
        return [dict(zip(self.columns, r, strict=True)) for r in self.rows]


class _Sandbox:
    """A session whose views are one version's tables."""

    def __init__(self, spark: SparkSession, catalog: Catalog, contract: Contract | None):
        self.version = catalog.required()
        self.spark = spark.newSession()
        # by settings of this session alone: no files by path in SQL, strict types, one time zone
        for k, v in (("spark.sql.runSQLOnFiles", "false"), ("spark.sql.ansi.enabled", "true"), ("spark.sql.session.timeZone", "UTC")):
            self.spark.conf.set(k, v)
        names = register(self.spark, self.version.uris(), contract)
        for name, df in catalog.state_frames(self.spark).items():
            df.createOrReplaceTempView(name)
            names.append(name)
        self.tables = sorted(names)
        self.files = {guard.plain_path(u) for us in self.version.uris().values() for u in us}
        registry = self.spark._jsparkSession.sessionState().functionRegistry()
        identifier = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        for f in sorted(guard.FUNCTIONS):
            registry.dropFunction(identifier(f))


_sandboxes: dict[tuple, _Sandbox] = {}
_lock = threading.Lock()


class QueryEngine:
    """Runs statements against the active version of a catalog. A refresh does not wait for queries, nor they for it."""

    def __init__(self, spark: SparkSession, catalog: Catalog, limits: Limits | None = None, contract: Contract | None = None):
        self.spark, self.catalog, self.limits, self.contract = spark, catalog, limits or Limits(), contract

    def _sandbox(self) -> _Sandbox:
        try:
            version = self.catalog.required()
            key = (id(self.spark), str(self.catalog.root.absolute()), version.id)
            with _lock:
                if key not in _sandboxes:
                    for old in [k for k in _sandboxes if k[:2] == key[:2]]:
                        del _sandboxes[old]
                    _sandboxes[key] = _Sandbox(self.spark, self.catalog, self.contract)
                return _sandboxes[key]
        except CatalogError as e:
            raise QueryError("unavailable", str(e)) from e

    def execute(self, sql: str, max_rows: int | None = None, timeout: float | None = None) -> Result:
        """The statement's rows, at most max_rows of them; limits can be lowered by a call and never raised."""
        rows, seconds, query_id = self._rows(max_rows), self._seconds(timeout), uuid.uuid4().hex[:12]
        began = time.monotonic()
        try:
            text = guard.check_statement(sql, self.limits.max_sql_chars)
            box = self._sandbox()

            def work():
                df = self._planned(box, text)
                if self.limits.explain_before_execute:
                    df._jdf.queryExecution().optimizedPlan()
                return df, [tuple(r) for r in df.limit(rows + 1).collect()]

            df, found = self._within(seconds, began, query_id, text, box, work)
        except QueryError as e:
            log.warning("query_failed id=%s kind=%s sql=%s", query_id, e.kind, sql[: self.limits.log_sql_max_chars])
            raise
        took = round(1000 * (time.monotonic() - began), 3)
        log.info("query_executed id=%s rows=%d ms=%s sql=%s", query_id, min(len(found), rows), took, sql[: self.limits.log_sql_max_chars])
        return Result(suffixed(df.columns), [type_name(f.dataType) for f in df.schema], found[:rows], len(found) > rows, rows, took, query_id, box.version, text)

    def validate(self, sql: str, timeout: float | None = None) -> QueryError | None:
        """What is wrong with the statement as far as planning tells; nothing is read."""
        seconds, query_id, began = self._seconds(timeout), uuid.uuid4().hex[:12], time.monotonic()
        try:
            text = guard.check_statement(sql, self.limits.max_sql_chars)
            box = self._sandbox()
            self._within(seconds, began, query_id, text, box, lambda: self._planned(box, text)._jdf.queryExecution().optimizedPlan())
        except QueryError as e:
            return e
        log.info("query_validated id=%s sql=%s", query_id, sql[: self.limits.log_sql_max_chars])
        return None

    def _rows(self, wanted: int | None) -> int:
        if wanted is not None and wanted < 0:
            raise ValueError("max_rows must not be negative")
        return min(wanted or self.limits.max_rows, self.limits.max_rows)

    def _seconds(self, wanted: float | None) -> float:
        if wanted is not None and wanted <= 0:
            raise ValueError("timeout must be positive")
        return min(wanted or self.limits.timeout_seconds, self.limits.timeout_seconds)

    @staticmethod
    def _planned(box: _Sandbox, text: str) -> DataFrame:
        words = guard.tokens(text)
        if words[0][0].upper() == "SUMMARIZE":
            body = text[words[0][2] :].strip()
            return summarize(QueryEngine._planned(box, f"select * from {body}" if re.fullmatch(r"[\w`]+", body) else body))
        guard.check_names(text)
        guard.parsed(box.spark, text, box.tables)
        df = box.spark.sql(text)
        guard.check_analysed(df, box.files, text)
        return df

    def _within(self, seconds: float, began: float, query_id: str, text: str, box: _Sandbox, work):
        """work()'s result; at the deadline its jobs are cancelled, and it is given some grace to end."""
        context, done = box.spark.sparkContext, {}

        def run():
            try:
                context.setJobGroup(query_id, text[:200], interruptOnCancel=True)
                done["result"] = work()
            except BaseException as e:  # noqa: BLE001
                done["error"] = e

        thread = InheritableThread(target=run, daemon=True)
        thread.start()
        thread.join(max(0.0, seconds - (time.monotonic() - began)))
        if thread.is_alive():
            context.cancelJobGroup(query_id)
            thread.join(GRACE)
            if thread.is_alive():
                log.error("query_stuck id=%s", query_id)
                # its thread keeps this session; later statements get one of their own
                with _lock:
                    for key in [k for k, other in _sandboxes.items() if other is box]:
                        del _sandboxes[key]
            raise QueryError("timeout", f"the query took more than {seconds:g} s", text)
        if "error" in done:
            raise classified(done["error"], text, box.tables) from None
        return done["result"]


def suffixed(names: list[str]) -> list[str]:
    """Names with _1, _2, ... where they repeat."""
    out: list[str] = []
    for n in names:
        k, name = 0, n
        while name in out:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out
