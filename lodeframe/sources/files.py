"""Where a table's files lie: listings, connectors, datasets, and scans pinned to a list of files."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path, PurePosixPath
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from lodeframe.contract import Contract, Table


class SourceError(ValueError):
    """A storage or dataset setting that can't be used."""


@dataclass(frozen=True)
class FileInfo:
    uri: str
    size: int
    mtime: datetime  # UTC, without zone


@dataclass(frozen=True)
class Dataset:
    table: str
    path: str
    pattern: str


class Connector(Protocol):
    def configure(self, spark: SparkSession) -> None: ...

    def list_files(self, dataset: Dataset) -> list[FileInfo]: ...

    def describe(self) -> str: ...


class LocalConnector:
    """Files below a local folder, by URI; nothing where the folder is missing."""

    def __init__(self, root: str | Path):
        self.root = Path(root).absolute()

    def configure(self, spark: SparkSession) -> None:
        """Nothing to set for local files."""

    def list_files(self, dataset: Dataset) -> list[FileInfo]:
        folder = self.root / dataset.path
        found = [(p, p.stat()) for p in folder.glob(dataset.pattern) if p.is_file()] if folder.is_dir() else []
        return sorted((FileInfo(p.as_posix(), s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc).replace(tzinfo=None)) for p, s in found), key=lambda f: f.uri)

    def describe(self) -> str:
        return f"local ({self.root.as_posix()})"


class HadoopConnector:
    """Files of any file system that Spark's Hadoop libraries know, listed through the session."""

    def __init__(self, root: str, settings: dict[str, str] | None = None):
        self.root, self.settings, self.spark = root.rstrip("/"), settings or {}, None

    def configure(self, spark: SparkSession) -> None:
        self.spark = spark
        for k, v in self.settings.items():
            spark.sparkContext._jsc.hadoopConfiguration().set(k, v)

    def list_files(self, dataset: Dataset) -> list[FileInfo]:
        if self.spark is None:
            raise SourceError("configure(spark) comes first")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{dataset.path}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        out, listing, base = [], fs.listFiles(path, True), fs.makeQualified(path).toString()
        while listing.hasNext():
            s = listing.next()
            uri = s.getPath().toString()
            if _matches(uri[len(base) + 1 :], dataset.pattern):
                out.append(FileInfo(uri, s.getLen(), datetime.fromtimestamp(s.getModificationTime() / 1000, timezone.utc).replace(tzinfo=None)))
        return sorted(out, key=lambda f: f.uri)

    def describe(self) -> str:
        return f"hadoop ({self.root})"


def _matches(relative: str, pattern: str) -> bool:
    return PurePosixPath("/" + relative).match("/" + pattern) if "**" not in pattern else PurePosixPath(relative).match(pattern.split("/")[-1])


CONNECTORS = {"local": LocalConnector, "hadoop": HadoopConnector}


def connector(backend: str, root: str) -> Connector:
    if backend not in CONNECTORS:
        raise SourceError(f"unknown storage backend {backend!r}; known: {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[backend](root)


def datasets(contract: Contract, settings: dict | None = None) -> list[Dataset]:
    """A dataset for each table, in the contract's order: settings hold `defaults` and overrides by table."""
    settings = settings or {}
    defaults = {"path": "{table}", "pattern": "**/*.parquet"} | (settings.get("defaults") or {})
    own = settings.get("tables") or {}
    if unknown := sorted(set(own) - set(contract.tables)):
        raise SourceError(f"datasets for unknown tables: {', '.join(unknown)}")
    out = []
    for name in contract.tables:
        found = defaults | (own.get(name) or {})
        path = found["path"].format(table=name)
        if PurePosixPath(path).is_absolute() or ".." in PurePosixPath(path).parts:
            raise SourceError(f"{name}: the path {path!r} must lie below the storage root")
        out.append(Dataset(name, path, found["pattern"]))
    return out


def table_files(root: str | Path, table: str) -> list[Path]:
    """A table's Parquet files, sorted; none where its folder is missing."""
    folder = Path(root) / table
    return sorted(folder.rglob("*.parquet")) if folder.is_dir() else []


def pinned(spark: SparkSession, uris: list[str], table: Table | None = None, merge: bool = False) -> DataFrame:
    """A scan of exactly these files. Partition folders' names are no columns, as files and not folders are read.

    With a table, its declared schema is read and its columns are the result's, in order. merge: unites the files'
    schemas by name instead of taking the first file's.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if table is not None:
        return reader.schema(table.struct).parquet(*uris).select(*table.names)
    return reader.option("mergeSchema", str(merge).lower()).parquet(*uris)


def register(spark: SparkSession, files: dict[str, list[str]], contract: Contract | None = None) -> list[str]:
    """A temporary view for each table that has files; a table without any loses its view. Returns the views' names."""
    out = []
    for name, uris in files.items():
        if uris:
            pinned(spark, uris, contract.tables.get(name) if contract else None).createOrReplaceTempView(name)
            out.append(name)
        else:
            spark.catalog.dropTempView(name)
    return out
