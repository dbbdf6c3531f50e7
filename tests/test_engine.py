"""The engine's statements, results, limits and errors, over two tables of a few rows."""

import time
from datetime import date
from decimal import Decimal
from itertools import product

import pytest

from lodeframe import engine as engines
from lodeframe import guard
from lodeframe.catalog import Catalog
from lodeframe.contract import from_dict
from lodeframe.engine import Limits, QueryEngine, suffixed
from lodeframe.errors import QueryError
from lodeframe.refresh import refresh
from lodeframe.sources.files import LocalConnector, datasets
from lodeframe.sources.sinks import write_table

STALLS = from_dict(
    {
        "tables": {
            "stall": {"kind": "dimension", "primary_key": ["stall_no"], "columns": ["stall_no INTEGER", "square VARCHAR", "covered BOOLEAN"]},
            "receipt": {"kind": "fact", "primary_key": ["receipt_no"], "date_column": "day", "columns": ["receipt_no BIGINT", "stall_no INTEGER", "day DATE", "paid DECIMAL(8,2)?"], "foreign_keys": [{"columns": ["stall_no"], "references": "stall.stall_no"}]},
        }
    }
)
STALL = [(1, "harbour", True), (2, "harbour", False), (3, "old town", True)]
RECEIPT = [(n, 1 + n % 3, date(2024, 2, 27 + n % 3), None if n == 6 else Decimal(n) / 4) for n in range(1, 13)]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("market")
    for name, rows in (("stall", STALL), ("receipt", RECEIPT)):
        t = STALLS.table(name)
        write_table(spark.createDataFrame(rows, t.struct), t, root / "data", "")
    c = Catalog(root / "catalog")
    assert refresh(spark, STALLS, datasets(STALLS), LocalConnector(root / "data"), c).status == "active"
    return c


@pytest.fixture(scope="module")
def engine(spark, catalog):
    return QueryEngine(spark, catalog, Limits(max_rows=50), STALLS)


BODIES = ["VALUES (7)", "select square from stall", "select '; -- ' as quoted", "select `a;b` from t", "/* why */ select 2", "select 1 -- one\n + 1", "from receipt"]


@pytest.mark.parametrize(("body", "tail"), list(product(BODIES, ["", ";", " ;; ;", ";\n-- bye", "; /* the end */", "\n;\n"])))
def test_what_closes_a_statement_goes(body, tail):
    assert guard.check_statement(f"\n {body}{tail} ", 200) == body


def test_a_comment_stays_where_nothing_closes_the_statement():
    assert guard.check_statement("select 4 /* four */ -- 4", 200) == "select 4 /* four */ -- 4"


@pytest.mark.parametrize("verb", sorted(guard.REFUSED))
@pytest.mark.parametrize("form", ["{} stall", "-- look\n{} stall;", "/*+ x */{}(1)"])
def test_verbs_that_do_more_than_read(verb, form):
    with pytest.raises(QueryError) as e:
        guard.check_statement(form.format(verb.lower()), 200)
    assert e.value.kind == "not_read_only" and verb in e.value.message


@pytest.mark.parametrize(("kind", "texts"), {"empty": ["", "\t\n", "/* nothing */", "-- here", " ; ;", "; -- ;"], "multiple_statements": ["values (1); values (2)", "select 1;\n;select 2", "from stall; drop view stall", "select ';'; select ';'"], "syntax": ["select 'open", "select `open"]}.items())
def test_texts_that_are_no_statement(kind, texts):
    for text in texts:
        with pytest.raises(QueryError) as e:
            guard.check_statement(text, 200)
        assert e.value.kind == kind, text


def test_length_counts_without_outer_blanks():
    assert guard.check_statement("  values (100)  ", 12) == "values (100)"
    with pytest.raises(QueryError) as e:
        guard.check_statement("values (1000)", 12)
    assert e.value.kind == "too_long" and "12" in e.value.hint


def test_rows_types_and_version(engine, catalog):
    r = engine.execute("select square, day, sum(paid) as paid, count(*) as receipts, bool_and(covered) as dry from receipt join stall using (stall_no) group by all order by square desc, day")
    by_place = {n: (square, covered) for n, square, covered in STALL}
    want: dict = {}
    for _, stall, day, paid in RECEIPT:
        square, covered = by_place[stall]
        have = want.get((square, day), (None, 0, True))
        want[square, day] = (have[0] if paid is None else (have[0] or 0) + paid, have[1] + 1, have[2] and covered)
    assert r.rows == [(*k, *want[k]) for k in sorted(want, key=lambda k: ([-ord(x) for x in k[0]], k[1]))]
    assert dict(zip(r.columns, r.types)) == {"square": "VARCHAR", "day": "DATE", "paid": "DECIMAL(18,2)", "receipts": "BIGINT", "dry": "BOOLEAN"}
    assert not r.truncated and r.row_count == len(want) and [list(x.values()) for x in r.to_records()] == [list(x) for x in r.rows]
    assert r.data_version == catalog.active() and r.duration_ms > 0 and len({r.query_id, engine.execute("values (1)").query_id}) == 2


def test_names_that_repeat(engine):
    assert suffixed(["n", "n", "n_1", "n", "m"]) == ["n", "n_1", "n_1_1", "n_2", "m"]
    assert engine.execute("select a.stall_no, b.stall_no from stall a join stall b on a.stall_no + 1 = b.stall_no").columns == ["stall_no", "stall_no_1"]


FORMS = {
    "from stall order by stall_no": STALL,
    "table stall order by 1 desc limit 1": STALL[2:],
    "with wet as (select stall_no from stall where not covered) select count(*) from receipt where stall_no in (select * from wet)": [(4,)],
    "select square from stall except select 'harbour'": [("old town",)],
    "select id * id from range(1, 4)": [(1,), (4,), (9,)],
    "select s.stall_no, (select count(paid) from receipt r where r.stall_no = s.stall_no) from stall s order by 1": [(1, 3), (2, 4), (3, 4)],
    "select stall_no, rank() over (partition by square order by stall_no desc) from stall order by stall_no": [(1, 2), (2, 1), (3, 1)],
    "select n, upper(w) from values (1, 'a'), (2, 'b') as v(n, w) where n > 1": [(2, "B")],
    "select pos, col from (select posexplode(array(5, 6)))": [(0, 5), (1, 6)],
    "select max(paid) from receipt where day between date '2024-02-28' and date '2024-02-29'": [(Decimal("2.75"),)],
    "select table_name, row_count from _table_stats order by 1": [("receipt", 12), ("stall", 3)],
    "select data_through, validated from _data_version": [(date(2024, 2, 29), True)],
}


@pytest.mark.parametrize("sql", FORMS)
def test_forms_of_reading(engine, sql):
    assert engine.execute(sql).rows == FORMS[sql]


def test_descriptions(engine):
    assert [r[:2] for r in engine.execute("describe stall").rows] == [("stall_no", "int"), ("square", "string"), ("covered", "boolean")]
    told = {r["column_name"]: r for r in engine.execute("summarize receipt").to_records()}
    assert (told["paid"]["count"], told["paid"]["null_percentage"], told["paid"]["unique_values"], told["day"]["min"]) == (12, 8.33, 11, "2024-02-27")
    assert {"stall", "receipt", "_files"} <= {x for r in engine.execute("show tables").rows for x in r}


@pytest.mark.parametrize(("allowed", "asked"), list(product([1, 5, 12, 40], [None, 0, 1, 5, 11, 12, 13])))
def test_a_call_lowers_the_limit_only(spark, catalog, allowed, asked):
    r = QueryEngine(spark, catalog, Limits(max_rows=allowed), STALLS).execute("select receipt_no from receipt order by receipt_no desc", max_rows=asked)
    limit = min(asked or allowed, allowed)
    assert r.max_rows == limit and r.truncated == (limit < 12) and [x for (x,) in r.rows] == list(range(12, 0, -1))[:limit]


@pytest.mark.parametrize("how", [{"max_rows": -3}, {"timeout": 0}, {"timeout": -1.5}])
def test_limits_that_make_no_sense(engine, how):
    with pytest.raises(ValueError):
        engine.execute("values (1)", **how)


FAULTS = {
    "unknown_table": ["select * from stal", "select 1 from receipt join recipt using (receipt_no)"],
    "unknown_column": ["select sqare from stall", "select r.town from receipt r"],
    "binder": ["select stall_no from stall a, stall b", "select square, max(stall_no) from stall", "select getenv('HOME')", "select no_such(1)"],
    "type_error": ["select date '2024-02-30'", "select cast('four' as int)", "select timestamp 'noon'"],
    "execution": ["select stall_no / 0 from stall", "select raise_error('stop')"],
    "syntax": ["selct 1", "select (2", "select 1 +", "select * frm stall t u"],
}


@pytest.mark.parametrize(("kind", "sql"), [(k, s) for k, texts in FAULTS.items() for s in texts])
def test_faults_are_told_apart(engine, kind, sql):
    with pytest.raises(QueryError) as e:
        engine.execute(sql)
    told = e.value
    assert told.kind == kind and told.retryable and told.sql == sql, told.message
    assert told.to_llm().startswith(f"Query error ({kind}):") and told.to_dict()["kind"] == kind
    if kind == "unknown_table":
        assert "receipt, stall" in told.hint


def test_a_stuck_statement_keeps_its_session_to_itself(engine, monkeypatch):
    monkeypatch.setattr(engines, "GRACE", 0.1)
    box = engine._sandbox()
    assert engine._sandbox() is box
    with pytest.raises(QueryError) as e:
        engine._within(0.1, time.monotonic(), "stuck", "values (1)", box, lambda: time.sleep(2))
    assert e.value.kind == "timeout" and engine._sandbox() is not box
    assert engine.execute("values (5)").rows == [(5,)]
