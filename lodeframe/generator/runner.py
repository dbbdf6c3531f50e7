"""Writes the history and single days as Parquet files, and the ground truth beside them."""

from __future__ import annotations

import contextlib
import shutil
import uuid
from datetime import timedelta
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from lodeframe.contract import Contract, star_schema
from lodeframe.generator.patterns import measure, patterns
from lodeframe.generator.tables import Tables
from lodeframe.generator.world import World
from lodeframe.sources.files import pinned, table_files
from lodeframe.sources.sinks import row_count, write_table

TRUTH = "ground_truth.yaml"


class GeneratorError(RuntimeError):
    """Data that exists, does not exist, or was made with other settings."""


def frames(spark: SparkSession, root: str | Path, contract: Contract) -> dict[str, DataFrame]:
    """A DataFrame for each table that has files below root."""
    return {t: pinned(spark, [str(f) for f in files]) for t in contract.tables if (files := table_files(root, t))}


@contextlib.contextmanager
def _staging(root: Path):
    """A folder beside the data, where the executors can write it, that goes at the end."""
    folder = root / ".staging" / f"shared-{uuid.uuid4().hex}"
    try:
        yield str(folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        with contextlib.suppress(OSError):
            folder.parent.rmdir()


def _settings(w: World) -> dict:
    return {"preset": w.preset, "seed": w.seed, "vehicles": w.size["vehicles"], "dealers": w.size["dealers"], "end_date": str(w.end)}


def generate_history(spark: SparkSession, root: str | Path, world: World, overwrite: bool = False, contract: Contract | None = None) -> dict[str, int]:
    """All tables up to the end date; rows by table. Existing data is an error unless overwrite is set."""
    root, contract = Path(root), contract or star_schema()
    there = [t for t in contract.tables if table_files(root, t)]
    if there and not overwrite:
        raise GeneratorError(f"{root} holds data already ({', '.join(there[:3])}, ...); overwrite is needed")
    for t in there:
        shutil.rmtree(root / t)
    out: dict[str, int] = {}
    with _staging(root) as folder:
        tables = Tables(spark, world, folder)
        for name, t in contract.tables.items():
            fact = t.kind == "fact"
            files = write_table(tables.snapshot(name, world.end), t, root, "history" if fact else "", name in world.size["partitioned"], replace=True)
            out[name] = row_count(files)
    found = frames(spark, root, contract)
    truth = {"dataset": _settings(world), "history": {"start": str(world.start), "end": str(world.end)}, "rows": out, "patterns": {}}
    for p in patterns(world):
        truth["patterns"][p.key] = {"title": p.title, "expectation": p.expectation, "parameters": p.parameters, "measured": measure(p, found)}
    (root / TRUTH).write_text(yaml.safe_dump(truth, sort_keys=False, allow_unicode=True, width=120), encoding="utf-8")
    return out


def generate_day(spark: SparkSession, root: str | Path, world: World, n: int, contract: Contract | None = None) -> dict[str, int]:
    """Day n after the end date: facts' new rows as files of their own, dimensions anew; rows written by table."""
    root, contract = Path(root), contract or star_schema()
    if not 1 <= n <= world.s["day_horizon_days"]:
        raise GeneratorError(f"the day must be from 1 to {world.s['day_horizon_days']}")
    truth = root / TRUTH
    if not truth.is_file():
        raise GeneratorError(f"no history in {root}; generate it first")
    if (was := yaml.safe_load(truth.read_text(encoding="utf-8"))["dataset"]) != _settings(world):
        raise GeneratorError(f"the history was made with other settings: {was}")
    day = world.end + timedelta(days=n)
    out: dict[str, int] = {}
    with _staging(root) as folder:
        tables = Tables(spark, world, folder)
        for name, t in contract.tables.items():
            fact, parted = t.kind == "fact", name in world.size["partitioned"]
            df = tables.snapshot(name, day, only_day=fact)
            if fact and df.isEmpty():
                out[name] = 0
                continue
            out[name] = row_count(write_table(df, t, root, f"{'day_' if parted else ''}{day}" if fact else "", parted, replace=not fact))
    return out
