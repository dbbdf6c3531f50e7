"""Validation of tables against a contract: one aggregate for all row rules of a table, one more for its key, an anti-join for each foreign key."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.contract import Contract, Table, type_name

SAMPLE = 3  # failing rows shown
PARALLEL = 8  # checks that run at a time


@dataclass(frozen=True)
class Issue:
    table: str
    check: str
    failing_rows: int
    detail: str = ""
    sample: tuple[str, ...] = ()


@dataclass
class Report:
    issues: list[Issue] = field(default_factory=list)
    checks_run: int = 0
    row_counts: dict[str, int] = field(default_factory=dict)
    date_ranges: dict[str, tuple] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.issues

    def render(self) -> str:
        lines = [f"{self.checks_run} checks on {len(self.row_counts)} tables: {'ok' if self.ok else f'{len(self.issues)} failed'}"]
        for i in self.issues:
            lines.append(f"  {i.table}.{i.check}: {i.failing_rows} failing" + (f" ({i.detail})" if i.detail else ""))
            lines += [f"    {s}" for s in i.sample]
        return "\n".join(lines)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i.table, i.check, i.failing_rows, i.detail, list(i.sample)) for i in self.issues]
        return spark.createDataFrame(rows, "table_name string, check string, failing_rows long, detail string, sample array<string>")


def row_rules(table: Table) -> dict[str, SparkColumn]:
    """What fails each row rule, by the check's name; null passes all but not_null."""
    out: dict[str, SparkColumn] = {}
    for c in table.columns:
        if not c.nullable or c.name in table.primary_key:
            out[f"not_null:{c.name}"] = F.col(c.name).isNull()
        if c.allowed_values:
            out[f"allowed_values:{c.name}"] = ~F.col(c.name).isin(*c.allowed_values)
        if c.min is not None:
            out[f"min:{c.name}"] = F.col(c.name) < F.lit(c.min)
        if c.max is not None:
            out[f"max:{c.name}"] = F.col(c.name) > F.lit(c.max)
    for k in table.checks:
        out[f"check:{k.name}"] = ~F.expr(f"({k.expr})")
    return out


def schema_problems(table: Table, df: DataFrame) -> list[str]:
    found = {f.name: f.dataType for f in df.schema}
    wanted = {c.name: c.field.dataType for c in table.columns}
    out = [f"missing column {c}" for c in wanted if c not in found] + [f"unexpected column {c}" for c in found if c not in wanted]
    return out + [f"{c} is {type_name(found[c])}, not {type_name(t)}" for c, t in wanted.items() if c in found and found[c] != t]


def rule_counts(table: Table, df: DataFrame) -> DataFrame:
    """One row: n_rows, failing rows of every row rule (r0, r1, ...), least and greatest date."""
    counts = [F.count_if(c).alias(f"r{k}") for k, c in enumerate(row_rules(table).values())]
    dates = [F.min(table.date_column).alias("low"), F.max(table.date_column).alias("high")] if table.date_column else []
    return df.agg(F.count("*").alias("n_rows"), *counts, *dates)


def duplicate_keys(table: Table, df: DataFrame) -> DataFrame:
    """The primary key's groups of more than one row."""
    return df.groupBy(*table.primary_key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(table: Table, key, df: DataFrame, parent: DataFrame) -> DataFrame:
    """Distinct foreign-key values without a parent; values with a null are none."""
    child = df.select(*key.columns).na.drop("any").distinct()
    parents = parent.select(*[F.col(c).alias(f"__{c}") for c in key.targets])
    return child.join(parents, [F.col(a) == F.col(f"__{b}") for a, b in zip(key.columns, key.targets, strict=True)], "left_anti")


def _shown(df: DataFrame) -> tuple[str, ...]:
    return tuple(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in df.limit(SAMPLE).collect())


def _checked(table: str, check: str, count: Callable[[], int], failing: DataFrame | None) -> Issue | None:
    try:
        n = count()
        return Issue(table, check, n, "", _shown(failing) if failing is not None else ()) if n else None
    except PySparkException as e:
        return Issue(table, check, 0, f"check could not run: {str(e).splitlines()[0][:300]}")


def _counts(table: Table, df: DataFrame):
    try:
        return rule_counts(table, df).first()
    except PySparkException:  # one rule's error is found again, by name, when each is run alone
        return None


def validate(contract: Contract, frames: dict[str, DataFrame]) -> Report:
    """Check every table of the contract; frames holds a DataFrame for each table that has files.

    A table without files, or whose columns or types differ, gets no further checks, and foreign keys to it report
    that it is missing or invalid. Failing rows are groups for the primary key, distinct values for foreign keys.
    """
    report, sound = Report(), {}
    for name, table in contract.tables.items():
        report.checks_run += 1
        if name not in frames:
            report.issues.append(Issue(name, "files", 0, "no files"))
        elif problems := schema_problems(table, frames[name]):
            report.issues.append(Issue(name, "schema", 0, "; ".join(problems)))
        else:
            sound[name] = frames[name]
    with ThreadPoolExecutor(PARALLEL) as pool:
        counted = dict(zip(sound, pool.map(lambda name: _counts(contract.tables[name], sound[name]), sound), strict=True))
        waiting: list[Issue | Future] = []
        for name, df in sound.items():
            table, row = contract.tables[name], counted[name]
            if row is not None:
                report.row_counts[name] = row.n_rows
                if table.date_column:
                    report.date_ranges[name] = (row.low, row.high)
            doubles = duplicate_keys(table, df)
            waiting.append(pool.submit(_checked, name, "primary_key_unique", doubles.count, doubles))
            for k, (check, fails) in enumerate(row_rules(table).items()):
                if row is not None and not row[f"r{k}"]:
                    report.checks_run += 1
                    continue
                failing = df.filter(fails)
                shown = failing if check.startswith("check:") else failing.select(*dict.fromkeys([*table.primary_key, check.split(":")[1]]))
                waiting.append(pool.submit(_checked, name, check, failing.count if row is None else (lambda n=row[f"r{k}"]: n), shown))
            for key in table.foreign_keys:
                check = f"foreign_key:{','.join(key.columns)}"
                if key.table in sound:
                    lost = orphans(table, key, df, sound[key.table])
                    waiting.append(pool.submit(_checked, name, check, lost.count, lost))
                else:
                    waiting.append(Issue(name, check, 0, f"{key.table} is missing or invalid"))
        report.checks_run += len(waiting)
        found = [w if isinstance(w, Issue) else w.result() for w in waiting]
    report.issues += [i for i in found if i is not None]
    return report


def report_frame(spark: SparkSession, contract: Contract, frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, check, failing_rows of every check of sound tables, as one lazy DataFrame."""
    out = None
    for name, df in frames.items():
        table = contract.tables[name]
        names = list(row_rules(table))
        if names:
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"r{k}").alias("failing_rows")) for k, c in enumerate(names)]))
            one = rule_counts(table, df).select(F.lit(name).alias("table_name"), pairs.alias("p")).select("table_name", "p.*")
            out = one if out is None else out.unionByName(one)
        counted = [("primary_key_unique", duplicate_keys(table, df))] + [(f"foreign_key:{','.join(k.columns)}", orphans(table, k, df, frames[k.table])) for k in table.foreign_keys if k.table in frames]
        for check, failing in counted:
            one = failing.agg(F.count("*").alias("failing_rows")).select(F.lit(name).alias("table_name"), F.lit(check).alias("check"), "failing_rows")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "table_name string, check string, failing_rows long")
