"""Queries through the whole platform: the driver's tables as a data version, refreshed and read by the guarded engine.

The catalog's manifests are the driver's own state, so a temporary folder of the driver holds them; no executor reads
it. Results are made of rows that the engine has limited already.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from datetime import timedelta
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.catalog import Catalog
from lodeframe.config import ConfigError, load_config, redacted
from lodeframe.contract import from_dict, star_schema
from lodeframe.engine import Limits, QueryEngine
from lodeframe.errors import QueryError
from lodeframe.generator.tables import Tables
from lodeframe.generator.world import World
from lodeframe.operators.profile import top_values
from lodeframe.operators.validate import validate
from lodeframe.refresh import Outcome, refresh
from lodeframe.sources.files import Dataset, HadoopConnector, register

TRADE = from_dict(
    {
        "tables": {
            "region": {"kind": "dimension", "primary_key": ["r_regionkey"], "columns": ["r_regionkey INTEGER", "r_name VARCHAR"]},
            "nation": {"kind": "dimension", "primary_key": ["n_nationkey"], "columns": ["n_nationkey INTEGER", "n_name VARCHAR", "n_regionkey INTEGER"], "foreign_keys": [{"columns": ["n_regionkey"], "references": "region.r_regionkey"}]},
            "customer": {"kind": "fact", "primary_key": ["c_custkey"], "columns": ["c_custkey BIGINT 0..", "c_name VARCHAR", "c_nationkey INTEGER", "c_acctbal DOUBLE", "c_mktsegment VARCHAR"], "foreign_keys": [{"columns": ["c_nationkey"], "references": "nation.n_nationkey"}]},
            "supplier": {"kind": "dimension", "primary_key": ["s_suppkey"], "columns": ["s_suppkey BIGINT", "s_name VARCHAR", "s_nationkey INTEGER", "s_acctbal DOUBLE"]},
            "part": {"kind": "dimension", "primary_key": ["p_partkey"], "columns": ["p_partkey BIGINT", "p_name VARCHAR", "p_brand VARCHAR", "p_type VARCHAR", "p_size INTEGER 1..", "p_retailprice DOUBLE"]},
        }
    }
)
WAIT = 600.0  # seconds that a statement may take

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def files_of(sf_dir: str) -> tuple[HadoopConnector, list[Dataset]]:
    return HadoopConnector(sf_dir), [Dataset(name, "", f"{name}.parquet") for name in TRADE.tables]


@contextmanager
def _catalog() -> Iterator[Catalog]:
    with tempfile.TemporaryDirectory(prefix="lodeframe-catalog-") as folder:
        yield Catalog(Path(folder) / "state")


def _refreshed(spark: SparkSession, sf_dir: str, catalog: Catalog, **how) -> Outcome:
    connector, datasets = files_of(sf_dir)
    return refresh(spark, TRADE, datasets, connector, catalog, **how)


# (name, statement of the engine with columns k and v, the same in standard SQL, most rows)
STATEMENTS = [
    ("closed by a comment", "select c_mktsegment as k, sum(c_custkey::bigint) as v from customer group by 1; -- by segment", "select c_mktsegment, sum(c_custkey) from customer group by 1", 50),
    ("from first", "from (select r_name as k, r_regionkey as v from region)", "select r_name, r_regionkey from region", 50),
    ("all columns but some", "select * except (n_nationkey) from (select n_nationkey, n_name as k, n_regionkey as v from nation)", "select n_name, n_regionkey from nation", 50),
    ("by position", "select p_brand as k, count(*) as v from part group by 1 having count(*) > 1 order by 2 desc, 1 limit 5", "select * from (select p_brand, count(*) as n from part group by p_brand having count(*) > 1 order by n desc, p_brand limit 5)", 50),
    ("cut to the limit", "select c_name as k, c_custkey as v from customer order by c_custkey desc", "select * from (select c_name, c_custkey from customer order by c_custkey desc limit 7)", 7),
    ("generated numbers", "select concat('n', id) as k, id * id as v from range(1, 6)", "select 'n' || i, i * i from generate_series(1, 5) as t(i)", 50),
    ("subqueries", "with rich as (select max(c_acctbal) as m, c_nationkey from customer group by all) select n_name as k, (select count(*) from supplier s where s.s_nationkey = n.n_nationkey) as v from nation n where n_nationkey in (select c_nationkey from rich where m > 0)", "select n_name, (select count(*) from supplier where s_nationkey = n_nationkey) from nation where n_nationkey in (select c_nationkey from customer group by 1 having max(c_acctbal) > 0)", 50),
    ("rows of the version", "select table_name as k, row_count as v from _table_stats", " union all ".join(f"select '{t}', count(*) from {t}" for t in TRADE.tables), 50),
    ("files of the version", "select table_name as k, count(*) as v from _files where size > 0 group by all", " union all ".join(f"select '{t}', 1" for t in TRADE.tables), 50),
    ("validated", "select connector like 'hadoop%' and validated as k, id as v from _data_version", "select 'true', 1", 50),
]


@query(" union all ".join(f"select '{name}' as statement, cast(k as varchar) as k, cast(v as bigint) as v, {'true' if most == 7 else 'false'} as truncated from ({sql}) as q(k, v)" for name, _, sql, most in STATEMENTS))
def engine_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of statements that the guarded engine runs on a version of the tables."""
    rows = []
    with _catalog() as catalog:
        _refreshed(spark, sf_dir, catalog)
        engine = QueryEngine(spark, catalog, Limits(max_rows=50, timeout_seconds=WAIT), TRADE)
        for name, statement, _, most in STATEMENTS:
            result = engine.execute(statement, max_rows=most)
            texts = [(str(k).lower() if isinstance(k, bool) else k, int(v)) for k, v in (tuple(r[c] for c in ("k", "v")) for r in result.to_records())]
            rows += [(name, k, v, result.truncated) for k, v in texts]
    return spark.createDataFrame(rows, "statement string, k string, v long, truncated boolean")


# (statement, kind of its error)
REFUSED = [
    ("", "empty"), ("-- nothing", "empty"), ("values (1); values (2)", "multiple_statements"), ("drop view region", "not_read_only"), ("with x as (select 1) insert into region select * from x", "not_read_only"),
    ("select transform(r_name) using 'cat' from region", "not_read_only"), ("select reflect('java.lang.System', 'nanoTime')", "forbidden"), ("select * from read_parquet('x')", "forbidden"), ("select * from regoin", "unknown_table"), ("select r_nmae from region", "unknown_column"),
    ("select r_name, count(*) from region", "binder"), ("select date '2023-02-29'", "type_error"), ("select cast(r_name as int) from region", "type_error"), ("select 1 / (r_regionkey - r_regionkey) from region", "execution"), ("selec 1", "syntax"),
]


@query("select * from (values " + ", ".join(f"""({k}, '{kind}', '{kind}')""" for k, (_, kind) in enumerate(REFUSED)) + ") as t(statement_no, found, planned) where found in ('empty', 'multiple_statements', 'not_read_only', 'forbidden', 'unknown_table', 'unknown_column', 'binder', 'syntax') union all select * from (values " + ", ".join(f"({k}, '{kind}', null)" for k, (s, kind) in enumerate(REFUSED) if kind in ("type_error", "execution")) + ")")
def engine_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of errors of statements that are refused or fail: when run, and when only planned."""
    rows = []
    with _catalog() as catalog:
        _refreshed(spark, sf_dir, catalog)
        engine = QueryEngine(spark, catalog, Limits(timeout_seconds=WAIT), TRADE)
        for k, (statement, kind) in enumerate(REFUSED):
            try:
                engine.execute(statement)
                found = None
            except QueryError as e:
                found = e.kind
            # what planning tells of values depends on constant folding, which is no part of the contract
            planned = None if kind in ("type_error", "execution") else getattr(engine.validate(statement), "kind", None)
            rows.append((k, found, planned))
    return spark.createDataFrame(rows, "statement_no int, found string, planned string")


_STEPS = [(1, "active", 1), (2, "no_change", 1), (3, "active", 2), (4, "no_change", 2)]


@query(f"select step, status, version, table_name, n_rows from (values {', '.join(map(str, _STEPS))}) as s(step, status, version), ({' union all '.join(f'''select '{t}' as table_name, count(*) as n_rows from {t}''' for t in TRADE.tables)}) as r")
def refresh_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, version and row counts of a first refresh, one of unchanged files, a forced one, and one after it."""
    rows = []
    with _catalog() as catalog:
        for step in range(1, 5):
            outcome = _refreshed(spark, sf_dir, catalog, force=step == 3)
            rows += [(step, outcome.status, outcome.version.id, s.table, s.rows) for s in outcome.version.stats]
        log = [(e.status, e.version) for e in catalog.history(9)][::-1]
        assert log == [r[1:3] for r in dict.fromkeys(r[:3] for r in rows)], log
    return spark.createDataFrame(rows, "step int, status string, version int, table_name string, n_rows long")


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n, cast(sum(hash_of) as bigint) as total from (select {c} as hash_of from {t})" for t, c in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))))
def listed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found by listing the storage, made views with declared columns in a session of their own."""
    connector, datasets = files_of(sf_dir)
    connector.configure(spark)
    session = spark.newSession()
    names = register(session, {d.table: [f.uri for f in connector.list_files(d)] for d in datasets}, TRADE)
    parts = [session.table(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n"), F.sum(F.col(TRADE.tables[n].primary_key[0]).cast("long")).alias("total")) for n in names]
    return reduce(DataFrame.unionByName, parts)


@query("select o_orderpriority as value, count(*) as n from orders where o_orderpriority is not null group by 1 order by 2 desc, 1 limit 3")
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_values(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", 3)


_KEYED = ("fact_sales", "fact_production", "fact_warranty_claim", "fact_recall_vehicle")


@query("select * from (values " + ", ".join(f"('{t}', cast(0 as bigint), cast(0 as bigint), cast(0 as bigint))" for t in _KEYED) + ") as t(table_name, repeated_keys, only_by_days, only_in_snapshot)")
def generated_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's history and two days after it against the snapshot of the second, for its smallest preset: keys that
    repeat, that only the days hold, or only the snapshot. No table is read."""
    world = World("tiny")
    tables, contract, later = Tables(spark, world), star_schema(), [world.end + timedelta(days=n) for n in (1, 2)]
    out = []
    for name in _KEYED:
        key = list(contract.tables[name].primary_key)
        by_days = tables.snapshot(name, world.end).select(*key).withColumn("source", F.lit(1))
        for day in later:
            by_days = by_days.unionByName(tables.snapshot(name, day, only_day=True).select(*key).withColumn("source", F.lit(1)))
        both = by_days.unionByName(tables.snapshot(name, later[-1]).select(*key).withColumn("source", F.lit(2)))
        per_key = both.groupBy(*key).agg(F.count_if(F.col("source") == 1).alias("a"), F.count_if(F.col("source") == 2).alias("b"))
        out.append(per_key.agg(F.lit(name).alias("table_name"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated_keys"), F.count_if(F.col("b") == 0).alias("only_by_days"), F.count_if(F.col("a") == 0).alias("only_in_snapshot")))
    return reduce(DataFrame.unionByName, out)


STRICT = from_dict(
    {
        "tables": {
            "region": {"kind": "dimension", "primary_key": ["r_name"], "columns": ["r_regionkey INTEGER 1..3", "r_name VARCHAR in AFRICA|ASIA|EUROPE"]},
            "nation": {"kind": "dimension", "primary_key": ["n_nationkey"], "columns": ["n_nationkey INTEGER", "n_name DATE", "n_regionkey INTEGER"]},
            "customer": {"kind": "fact", "primary_key": ["c_mktsegment"], "columns": ["c_custkey BIGINT", "c_nationkey INTEGER", "c_acctbal DOUBLE 0..", "c_mktsegment VARCHAR"], "foreign_keys": [{"columns": ["c_nationkey"], "references": "nation.n_nationkey"}]},
            "part": {"kind": "dimension", "primary_key": ["p_partkey"], "columns": ["p_partkey BIGINT", "p_size INTEGER"], "checks": [{"name": "small", "expr": "p_size <= 30"}]},
            "lineitem": {"kind": "fact", "primary_key": ["l_orderkey", "l_linenumber"], "columns": ["l_orderkey BIGINT", "l_linenumber INTEGER", "l_partkey BIGINT"], "foreign_keys": [{"columns": ["l_partkey"], "references": "part.p_partkey"}]},
            "warehouse": {"kind": "dimension", "primary_key": ["w_key"], "columns": ["w_key BIGINT"]},
        }
    }
)
_BROKEN = {
    ("region", "min:r_regionkey"): "select 1 from region where r_regionkey < 1",
    ("region", "max:r_regionkey"): "select 1 from region where r_regionkey > 3",
    ("region", "allowed_values:r_name"): "select 1 from region where r_name not in ('AFRICA', 'ASIA', 'EUROPE')",
    ("customer", "primary_key_unique"): "select 1 from customer group by c_mktsegment having count(*) > 1",
    ("customer", "min:c_acctbal"): "select 1 from customer where c_acctbal < 0",
    ("part", "check:small"): "select 1 from part where p_size > 30 and p_partkey % 2 = 0",
    ("lineitem", "primary_key_unique"): "select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
    ("lineitem", "foreign_key:l_partkey"): "select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 2 = 0)",
}


@query(
    " union all ".join(f"select * from (select '{t}' as table_name, '{c}' as check, count(*) as failing_rows, least(3, count(*)) as n_shown, '' as detail from ({sql})) where failing_rows > 0" for (t, c), sql in _BROKEN.items())
    + " union all select * from (values ('warehouse', 'files', 0, 0, 'no files'), ('nation', 'schema', 0, 0, 'n_name is VARCHAR, not DATE'), ('customer', 'foreign_key:c_nationkey', 0, 0, 'nation is missing or invalid'))"
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of a contract that the tables break in every way: a table without files, a wrong type, each kind of rule."""
    frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*t.names) for name, t in STRICT.tables.items() if name != "warehouse"}
    frames["part"] = frames["part"].filter("p_partkey % 2 = 0")  # so that every other part's lines are orphans
    issues = validate(STRICT, frames).frame(spark)
    return issues.select("table_name", "check", "failing_rows", F.size("sample").cast("long").alias("n_shown"), "detail")


# (setting, its value, the value that is shown)
_SETTINGS = [
    ("environment", "test", "test"), ("paths.data_root", "/from/local", "/from/local"), ("paths.docs", "docs of ada", "docs of ada"), ("query.max_rows", "77", "77"),
    ("catalog.history_limit", "9", "9"), ("logging.level", "WARNING", "WARNING"), ("storage.backend", "local", "local"), ("datasets.api_token", "abc", "***"), ("refused", "query.max_rows must be positive", ""),
]


@query("select * from (values " + ", ".join(map(str, _SETTINGS)) + ") as t(setting, value, displayed)")
def settings_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from a file, a local file over it, variables over both, variables put into values, and hidden secrets."""
    with tempfile.TemporaryDirectory(prefix="lodeframe-settings-") as folder:  # the driver's own; no executor reads it
        base = Path(folder) / "config"
        base.mkdir()
        (base / "app.yaml").write_text("environment: test\npaths: {data_root: /from/app, docs: 'docs of ${WHO}'}\nquery: {max_rows: 5}\ncatalog: {history_limit: '${MANY:-9}'}\n")
        (base / "local.yaml").write_text("paths: {data_root: /from/local}\nlogging: {level: INFO}\n")
        (base / "datasets.yaml").write_text("api_token: abc\n")
        (Path(folder) / ".env").write_text("WHO=ada\nLODE__LOGGING__LEVEL=WARNING\n")
        config = load_config(base, {"LODE__QUERY__MAX_ROWS": "77"})
        try:
            load_config(base, {"LODE__QUERY__MAX_ROWS": "0"})
            refused = ""
        except ConfigError as e:
            refused = str(e)
    found, seen = asdict(config), redacted(config)
    rows = [("refused", refused, "")]
    for setting, *_ in _SETTINGS[:-1]:
        section, _, key = setting.partition(".")
        rows.append((setting, *(str(c[section][key] if key else c[section]) for c in (found, seen))))
    return spark.createDataFrame(rows, "setting string, value string, displayed string")


@query(
    "select 'refreshes that made a version' as what, 2 as n union all select 'refreshes without a change', 1 union all select 'active version', 2 union all select 'files of version 1', " + str(len(TRADE.tables)) + " union all select 'versions made from an old one', 0"
    " union all select 'rows of both versions', 2 * (" + " + ".join(f"(select count(*) from {t})" for t in TRADE.tables) + ")"
)
def catalog_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after three refreshes: log, active version, older version, and what becomes of one that comes too late."""
    with _catalog() as catalog:
        for force in (False, False, True):
            _refreshed(spark, sf_dir, catalog, force=force)
        old, late = catalog.version(1), catalog.version(2)
        lost = catalog.activate(1, "late", late.files, late.stats, None, True, "hadoop", "late")
        state = catalog.state_frames(spark)
        log = state["_refresh_log"].agg(F.count_if(F.col("status") == "active"), F.count_if(F.col("status") == "no_change")).first()
        rows = [("refreshes that made a version", log[0]), ("refreshes without a change", log[1]), ("active version", state["_data_version"].first().id), ("files of version 1", sum(map(len, old.files.values()))), ("versions made from an old one", int(lost is not None)), ("rows of both versions", sum(s.rows for v in (old, late) for s in v.stats))]
    return spark.createDataFrame(rows, "what string, n long")


@query(
    "select * from (values ('describe', 's_suppkey', 'bigint'), ('describe', 's_name', 'string'), ('describe', 's_nationkey', 'int'), ('describe', 's_acctbal', 'double'), ('same names', 'r_name, r_name_1, r_regionkey', 'false'), ('cut', '3 rows', 'true')) as t(statement, k, v)"
    + " union all " + " union all ".join(f"select 'summarize', '{c}', concat_ws(' ', min({c}), max({c}), count(distinct {c}), count(*)) from supplier" for c in ("s_suppkey", "s_name", "s_nationkey"))
)
def engine_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guarded engine tells of tables and columns, and the shape of cut results and of those with equal names."""
    with _catalog() as catalog:
        _refreshed(spark, sf_dir, catalog)
        engine = QueryEngine(spark, catalog, Limits(max_rows=50, timeout_seconds=WAIT), TRADE)
        rows = [("describe", *map(str, r[:2])) for r in engine.execute("describe supplier").rows]
        told = engine.execute("summarize select s_suppkey, s_name, s_nationkey from supplier").to_records()
        rows += [("summarize", r["column_name"], " ".join(str(r[c]) for c in ("min", "max", "unique_values", "count"))) for r in told]
        same = engine.execute("select r_name, r_name, r_regionkey from region")
        cut = engine.execute("select * from customer", max_rows=3)
        rows += [("same names", ", ".join(same.columns), str(same.truncated).lower()), ("cut", f"{cut.row_count} rows", str(cut.truncated).lower())]
    return spark.createDataFrame(rows, "statement string, k string, v string")
