"""Contract, settings, sources, command line, logs, random draws and streams."""

import io
import json
import logging
from contextlib import redirect_stdout
from datetime import date

import pytest
from pyspark.sql import functions as F

from lodeframe import cli, config, contract, documents, logs
from lodeframe.functions import calendar
from lodeframe.generator.random import Draws
from lodeframe.sources import files
from lodeframe.streaming.arrivals import arrivals, on_arrival, windowed_counts

SMALL = {"tables": {"dim_a": {"kind": "dimension", "primary_key": ["a"], "columns": ["a INTEGER", "b VARCHAR? in x|y"]}, "fact_b": {"kind": "fact", "primary_key": ["k"], "columns": [{"name": "k", "type": "bigint", "nullable": False}, "a INTEGER", "d DATE", "m DECIMAL(12,2) 0.."], "date_column": "d", "foreign_keys": [{"columns": ["a"], "references": "dim_a.a"}]}}}


def changed(path, value):
    import copy

    out = copy.deepcopy(SMALL)
    at = out["tables"]
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


def test_contract():
    c = contract.from_dict(SMALL)
    assert [f.simpleString() for f in c.table("fact_b").struct] == ["k:bigint", "a:int", "d:date", "m:decimal(12,2)"]
    assert contract.type_name(contract.spark_type("decimal( 6, 4 )")) == "DECIMAL(6,4)"
    assert 'dim_a ||--o{ fact_b : "a"' in documents.mermaid(c) and "varchar b" not in documents.mermaid(c, full=False)
    assert "| `b` | VARCHAR | yes | values: `x`, `y` |" in documents.markdown(c)
    star = contract.star_schema()
    drawn = documents.mermaid(star)
    assert 'fact_production ||--|{ fact_vehicle_component : "vin"' in drawn and drawn.count("--") == 26
    assert (len(star.tables), sum(len(t.columns) for t in star.tables.values()), sum(len(t.foreign_keys) for t in star.tables.values())) == (15, 122, 26)


@pytest.mark.parametrize(("path", "value"), [(("fact_b", "foreign_keys"), [{"columns": ["a"], "references": "dim_z.a"}]), (("fact_b", "foreign_keys"), [{"columns": ["a"], "references": "dim_a.b"}]), (("dim_a", "columns"), ["a INTEGER", "a VARCHAR"]), (("dim_a", "columns"), ["a BLOB"]), (("dim_a", "primary_key"), ["z"]), (("dim_a", "date_column"), "z"), (("dim_a", "colour"), "red"), (("dim_a", "kind"), "cube")])
def test_contract_errors(path, value):
    with pytest.raises(contract.ContractError):
        contract.from_dict(changed(path, value))


def test_files(tmp_path):
    c = contract.from_dict(SMALL)
    (tmp_path / "dim_a" / "deep").mkdir(parents=True)
    for n in ("b.parquet", "deep/a.parquet", "notes.txt"):
        (tmp_path / "dim_a" / n).write_text("x")
    a, b = files.datasets(c)
    found = files.connector("local", str(tmp_path))
    assert [f.uri.rsplit("/", 1)[1] for f in found.list_files(a)] == ["b.parquet", "a.parquet"] and found.list_files(b) == []
    assert files.datasets(c, {"tables": {"fact_b": {"path": "f/{table}"}}})[1].path == "f/fact_b"
    for bad in ({"tables": {"z": {}}}, {"defaults": {"path": "/abs"}}, {"defaults": {"path": "../{table}"}}):
        with pytest.raises(files.SourceError):
            files.datasets(c, bad)
    with pytest.raises(files.SourceError):
        files.connector("cloud", "x")


def test_pinned_and_hadoop(spark, tmp_path):
    c = contract.from_dict(SMALL)
    root = tmp_path / "fact_b" / "year=2024"
    spark.createDataFrame([(1, 2, date(2024, 1, 1))], "k long, a int, d date").withColumn("m", F.lit(1).cast("decimal(12,2)")).coalesce(1).write.parquet(str(root))
    h = files.HadoopConnector(tmp_path.as_uri())
    h.configure(spark)
    uris = [f.uri for f in h.list_files(files.datasets(c)[1])]
    assert len(uris) == 1 and files.pinned(spark, uris, c.table("fact_b")).columns == ["k", "a", "d", "m"]
    session = spark.newSession()
    assert files.register(session, {"fact_b": uris, "dim_a": []}, c) == ["fact_b"]
    assert session.sql("select count(*) from fact_b").first()[0] == 1
    files.register(session, {"fact_b": []})
    assert not session.catalog.tableExists("fact_b")


def test_settings(tmp_path):
    folder = tmp_path / "config"
    folder.mkdir()
    (folder / "app.yaml").write_text("paths: {data_root: '${ROOT:-d}'}\nquery: {max_rows: '${N}'}\n")
    (folder / "local.yaml").write_text("query: {timeout_seconds: 5}\n")
    (tmp_path / ".env").write_text("N=7\nROOT='e'\n")
    c = config.load_config(folder, {"LODE__QUERY__MAX_SQL_CHARS": "99", "ROOT": "f"})
    assert (c.query.max_rows, c.query.timeout_seconds, c.query.max_sql_chars, c.paths.data_root) == (7, 5.0, 99, "f") and c.path("data_root") == tmp_path / "f"
    for env in ({"LODE__QUERY__MAX_ROWS": "many", "N": "1"}, {"LODE__NOPE": "1", "N": "1"}, {"LODE__QUERY": "3", "N": "1"}, {"LODE__QUERY__MAX_ROWS": "-1", "N": "1"}):
        with pytest.raises(config.ConfigError):
            config.load_config(folder, env)
    (tmp_path / ".env").unlink()
    with pytest.raises(config.ConfigError):
        config.load_config(folder, {})
    assert config.redacted({"a": {"api_key": "x", "b": 1}}) == {"a": {"api_key": "***", "b": 1}}


def test_logs(tmp_path, capsys):
    logger = logs.configure(config.Logging(format="json", file=str(tmp_path / "l.jsonl")))
    with logs.bound(query_id="q1"):
        logger.info("hello")
    logs.configure(config.Logging())
    out = capsys.readouterr()
    assert out.out == "" and json.loads(out.err)["query_id"] == "q1"
    assert json.loads((tmp_path / "l.jsonl").read_text())["event"] == "hello"
    for h in list(logging.getLogger("lodeframe").handlers):
        logging.getLogger("lodeframe").removeHandler(h)
    logging.getLogger("lodeframe").propagate = True


def test_command_line(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    out = io.StringIO()
    with redirect_stdout(out):
        assert cli.main(["config", "validate"]) == 0 and cli.main(["schema", "erd", "--keys"]) == 0
        assert cli.main(["catalog", "status"]) == 1 and cli.main(["storage", "check"]) == 1
    assert "erDiagram" in out.getvalue() and "refresh" in capsys.readouterr().err
    assert cli.ascii_table(["a", "b"], [(1, None)]).splitlines() == ["a | b", "--+-----", "1 | NULL"]
    monkeypatch.setenv("LODE__QUERY__MAX_ROWS", "x")
    assert cli.main(["config", "show"]) == 1


def test_calendar(spark):
    d = {str(r.calendar_date): r for r in calendar.date_dimension(spark, date(2025, 5, 1), date(2025, 6, 1)).collect()}
    assert min(d) == "2025-04-01" and max(d) == "2026-03-31" and len(d) == 365
    assert (d["2025-04-01"].fiscal_year, d["2025-04-01"].fiscal_quarter, d["2026-03-31"].fiscal_quarter, d["2026-03-31"].fiscal_year_label) == (2026, 1, 4, "FY2026")


def test_draws(spark):
    d = Draws(1, "id")
    r = spark.range(20000).select(F.avg(d.uniform("u")), F.avg(d.erlang("e", 2, 35.0)), F.stddev(d.normal("n")), F.avg(d.poisson("p", F.lit(0.7))), F.avg((d.choice("c", {"a": 0.3, "b": 0.7}) == "a").cast("int")), F.min(d.whole("w", 2, 4)), F.max(d.whole("w", 2, 4))).first()
    assert abs(r[0] - 0.5) < 0.01 and abs(r[1] - 35) < 1 and abs(r[2] - 1) < 0.03 and abs(r[3] - 0.7) < 0.03 and abs(r[4] - 0.3) < 0.02 and r[5:] == (2, 4)


def test_stream(spark, tmp_path):
    t = contract.from_dict(SMALL).table("fact_b")
    for k, d in enumerate((date(2024, 1, 1), date(2024, 1, 20), date(2024, 3, 9))):
        spark.createDataFrame([(k, 1, d)], "k long, a int, d date").withColumn("m", F.lit(1).cast("decimal(12,2)")).coalesce(1).write.mode("append").parquet(str(tmp_path / "fact_b"))
    seen = []
    on_arrival(arrivals(spark, tmp_path, t), lambda df, n: seen.append(df.count()), str(tmp_path / "c1")).awaitTermination()
    assert seen == [1, 1, 1]
    q = windowed_counts(arrivals(spark, tmp_path, t, 9), "d", "120 days", "30 days").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("counted").collect()) == 3


def test_settings_folder_by_variable(tmp_path):
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "app.yaml").write_text("catalog: {busy_timeout_seconds: 3}")
    assert config.load_config(env={"LODE_CONFIG": str(tmp_path / "own")}).catalog.busy_timeout_seconds == 3
    with pytest.raises(config.ConfigError, match="LODE_CONFIG"):
        config.load_config(env={"LODE_CONFIG": str(tmp_path / "nowhere")})
