"""Parquet sinks: one sorted file, or folders by year and month; staged, then published by renaming."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.contract import Table


class SinkError(ValueError):
    """A table that can't be written as asked."""


def in_contract(df: DataFrame, table: Table) -> DataFrame:
    return df.select(*[F.col(c.name).cast(c.field.dataType).alias(c.name) for c in table.columns])


def write_table(df: DataFrame, table: Table, root: str | Path, label: str, partitioned: bool = False, replace: bool = False, row_group_bytes: int | None = None) -> list[Path]:
    """Write df as the table's columns below root/<table>, sorted by date (nulls last) and key; returns the files.

    label names the files (history, or a day). replace deletes the table's other files, as for full reloads. Rows
    go to a staging folder, then every file is renamed to its place, so that no reader sees half a file; old files go
    only when the new ones are there, so that a crash in between loses no row.
    """
    root = Path(root)
    staging = root / ".staging" / uuid.uuid4().hex
    target = root / table.name
    plain = in_contract(df, table)
    order = [F.col(c).asc_nulls_last() for c in dict.fromkeys([*filter(None, [table.date_column]), *table.primary_key])]
    options = {"compression": "zstd"} | ({"parquet.block.size": str(row_group_bytes)} if row_group_bytes else {})
    try:
        if partitioned:
            if not table.date_column:
                raise SinkError(f"{table.name} has no date column to partition by")
            d = F.col(table.date_column)
            parts = plain.withColumn("year", F.year(d)).withColumn("month", F.lpad(F.month(d).cast("string"), 2, "0"))
            parts.repartition("year", "month").sortWithinPartitions("year", "month", *order).write.options(**options).partitionBy("year", "month").parquet(str(staging))
        else:
            # one file a table is the layout that is asked for here; large tables are partitioned
            plain.repartition(1).sortWithinPartitions(*order).write.options(**options).parquet(str(staging))
        before = set(target.rglob("*.parquet")) if replace else set()
        out, counts = [], {}
        for part in sorted(staging.rglob("*.parquet")):
            folder = target / part.parent.relative_to(staging)
            folder.mkdir(parents=True, exist_ok=True)
            k = counts[folder] = counts.get(folder, -1) + 1
            name = f"{label}_{k}.parquet" if partitioned else f"{table.name}{'' if label == '' else '_' + label}.parquet"
            os.replace(part, folder / name)
            out.append(folder / name)
        for old in before.difference(out):
            old.unlink()
        return out
    finally:
        shutil.rmtree(staging, ignore_errors=True)
        if staging.parent.is_dir() and not any(staging.parent.iterdir()):
            staging.parent.rmdir()


def row_count(files: list[Path]) -> int:
    """Rows of Parquet files, from their footers."""
    import pyarrow.parquet as pq

    return sum(pq.ParquetFile(f).metadata.num_rows for f in files)
