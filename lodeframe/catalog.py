"""Versions of the data as immutable manifests: the files each table has, their statistics, and a log of refreshes.

versions/v<n>.json is made whole under another name and then linked to its own, which fails if it exists: of two
refreshes that race, one wins and the other sees the winner. The active version is the highest one. Readers take
no lock; the log is appended to under a file lock with a deadline.
"""

from __future__ import annotations

import fcntl
import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class CatalogError(RuntimeError):
    """The catalog is missing, unreadable, or held by another process for too long."""


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class TableStats:
    table: str
    rows: int | None
    files: int
    bytes: int
    min_date: str | None = None
    max_date: str | None = None


@dataclass(frozen=True)
class Version:
    id: int
    label: str
    fingerprint: str
    created_at: str
    data_through: str | None
    validated: bool
    connector: str
    refresh_id: str
    files: dict[str, list[dict]] = field(default_factory=dict)
    stats: list[TableStats] = field(default_factory=list)

    def uris(self) -> dict[str, list[str]]:
        return {t: [f["uri"] for f in fs] for t, fs in self.files.items()}


@dataclass(frozen=True)
class LogEntry:
    refresh_id: str
    started_at: str
    duration_s: float
    status: str
    version: int | None
    message: str = ""
    issues: int = 0


class Catalog:
    def __init__(self, root: str | Path, busy_timeout: float = 10.0):
        self.root, self.busy_timeout = Path(root), busy_timeout

    @property
    def exists(self) -> bool:
        return (self.root / "versions").is_dir()

    def _ids(self) -> list[int]:
        return sorted(int(p.stem[1:]) for p in (self.root / "versions").glob("v*.json"))

    def active(self) -> Version | None:
        ids = self._ids()
        return self.version(ids[-1]) if ids else None

    def version(self, number: int) -> Version:
        try:
            found = json.loads((self.root / "versions" / f"v{number}.json").read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise CatalogError(f"version {number} can't be read: {e}") from e
        found["stats"] = [TableStats(**s) for s in found["stats"]]
        return Version(**found)

    def required(self) -> Version:
        version = self.active() if self.exists else None
        if version is None:
            raise CatalogError(f"no data version in {self.root}; run `lodeframe refresh` first")
        return version

    def activate(self, before: int, fingerprint: str, files: dict[str, list[dict]], stats: list[TableStats], data_through: date | None, validated: bool, connector: str, refresh_id: str) -> Version | None:
        """The new version, or None if another refresh has made one since version `before` was read."""
        number, now = before + 1, utc_now()
        version = Version(number, f"v{number} | {now:%Y-%m-%d %H:%M} UTC | {fingerprint[:8]}", fingerprint, now.isoformat(), data_through and str(data_through), validated, connector, refresh_id, files, stats)
        folder = self.root / "versions"
        folder.mkdir(parents=True, exist_ok=True)
        whole = folder / f".{uuid.uuid4().hex}.tmp"
        whole.write_text(json.dumps(asdict(version), indent=1), encoding="utf-8")
        try:
            os.link(whole, folder / f"v{number}.json")
        except FileExistsError:
            return None
        finally:
            whole.unlink()
        return version

    def record(self, entry: LogEntry) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        deadline, pause = time.monotonic() + self.busy_timeout, 0.05
        with (self.root / "refresh_log.jsonl").open("a", encoding="utf-8") as f:
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() > deadline:
                        raise CatalogError(f"another process has held the refresh log for {self.busy_timeout:g} s") from None
                    time.sleep(pause)
                    pause = min(1.0, 2 * pause)
            f.write(json.dumps(asdict(entry)) + "\n")

    def history(self, limit: int = 5) -> list[LogEntry]:
        """The latest refreshes, the last one first."""
        try:
            lines = (self.root / "refresh_log.jsonl").read_text(encoding="utf-8").splitlines()
        except FileNotFoundError:
            return []
        return [LogEntry(**json.loads(x)) for x in lines[::-1][:limit]]

    def state_frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """_data_version, _refresh_log, _table_stats and _files of the active version, for queries."""
        v = self.required()
        stamp = datetime.fromisoformat
        day = lambda s: s and date.fromisoformat(s)
        history = [(e.refresh_id, stamp(e.started_at), e.duration_s, e.status, e.version, e.message, e.issues) for e in self.history(1000)]
        files = [(t, f["uri"], f["size"], stamp(f["mtime"])) for t, fs in v.files.items() for f in fs]
        stats = [(s.table, s.rows, s.files, s.bytes, day(s.min_date), day(s.max_date)) for s in v.stats]
        return {
            "_data_version": spark.createDataFrame([(v.id, v.label, v.fingerprint, stamp(v.created_at), day(v.data_through), v.validated, v.connector, v.refresh_id)], "id int, label string, fingerprint string, created_at timestamp_ntz, data_through date, validated boolean, connector string, refresh_id string"),
            "_refresh_log": spark.createDataFrame(history, "refresh_id string, started_at timestamp_ntz, duration_s double, status string, version int, message string, issues int"),
            "_table_stats": spark.createDataFrame(stats, "table_name string, row_count long, file_count int, bytes long, min_date date, max_date date"),
            "_files": spark.createDataFrame(files, "table_name string, uri string, size long, mtime timestamp_ntz"),
        }
