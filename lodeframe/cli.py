"""The command line: config, generate, validate, profile, schema, refresh, catalog, storage and query. Errors end with code 1."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

import yaml

from lodeframe import logs
from lodeframe.catalog import Catalog, CatalogError
from lodeframe.config import Config, ConfigError, load_config, redacted
from lodeframe.contract import Contract, ContractError, load, star_schema
from lodeframe.documents import markdown, mermaid
from lodeframe.engine import QueryEngine
from lodeframe.errors import QueryError
from lodeframe.generator.runner import GeneratorError, frames, generate_day, generate_history
from lodeframe.generator.world import World
from lodeframe.operators.profile import profile
from lodeframe.operators.validate import validate
from lodeframe.refresh import refresh
from lodeframe.session import build_session
from lodeframe.sources.files import SourceError, connector, datasets, table_files


def ascii_table(columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    cells = [[str(c) for c in columns], *[["NULL" if v is None else str(v) for v in r] for r in rows]]
    wide = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    line = lambda r: " | ".join(c.ljust(n) for c, n in zip(r, wide, strict=True)).rstrip()
    return "\n".join([line(cells[0]), "-+-".join("-" * n for n in wide), *map(line, cells[1:])])


def contract_of(config: Config) -> Contract:
    own = Path(config.base) / "config" / "contract.yaml"
    return load(own) if own.is_file() else star_schema()


def _config(config: Config, a) -> int:
    print(yaml.safe_dump(redacted(config), sort_keys=False) if a.action == "show" else "the settings are valid")
    return 0


def _generate(config: Config, a) -> int:
    world, spark, root = World(a.preset, a.seed), build_session(), config.path("data_root")
    made = generate_history(spark, root, world, a.overwrite) if a.action == "history" else generate_day(spark, root, world, a.n)
    print(ascii_table(["table", "rows"], sorted(made.items())))
    return 0


def _validate(config: Config, a) -> int:
    contract = contract_of(config)
    report = validate(contract, frames(build_session(), config.path("data_root"), contract))
    print(report.render())
    return 0 if report.ok else 1


def _profile(config: Config, a) -> int:
    contract, root, spark = contract_of(config), config.path("data_root"), build_session()
    text = profile(spark, contract, frames(spark, root, contract), {t: len(table_files(root, t)) for t in contract.tables})
    out = Path(a.output) if a.output else config.path("docs") / "data_profile.md"
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(text + "\n", encoding="utf-8")
    print(f"wrote {out}")
    return 0


def _schema(config: Config, a) -> int:
    contract = contract_of(config)
    print(mermaid(contract, not a.keys) if a.action == "erd" else markdown(contract))
    return 0


def _refresh(config: Config, a) -> int:
    contract = contract_of(config)
    outcome = refresh(build_session(), contract, datasets(contract, config.datasets), connector(config.storage.backend, str(config.path("data_root"))), Catalog(config.path("catalog"), config.catalog.busy_timeout_seconds), a.force, a.allow_invalid)
    print(f"{outcome.status}: {outcome.version.label if outcome.version else 'no version'}" + (f" ({outcome.message})" if outcome.message else ""))
    if outcome.report and not outcome.report.ok:
        print(outcome.report.render())
    return 0 if outcome.status in ("active", "no_change") else 1


def _catalog(config: Config, a) -> int:
    catalog = Catalog(config.path("catalog"), config.catalog.busy_timeout_seconds)
    v = catalog.required()
    print(f"{v.label}\nfingerprint {v.fingerprint}\ndata through {v.data_through}; validated: {'yes' if v.validated else 'no'}; {v.connector}")
    print(ascii_table(["table", "rows", "files", "bytes", "from", "to"], [(s.table, s.rows, s.files, s.bytes, s.min_date, s.max_date) for s in v.stats]))
    print(ascii_table(["refresh", "started", "status", "version", "issues"], [(e.refresh_id, e.started_at[:19], e.status, e.version, e.issues) for e in catalog.history(config.catalog.history_limit)]))
    return 0


def _storage(config: Config, a) -> int:
    contract, c = contract_of(config), connector(config.storage.backend, str(config.path("data_root")))
    print(c.describe())
    found = [(d.table, c.list_files(d)) for d in datasets(contract, config.datasets)]
    print(ascii_table(["table", "files", "bytes"], [(t, len(fs), sum(f.size for f in fs)) for t, fs in found]))
    return 0 if all(fs for _, fs in found) else 1


def _query(config: Config, a) -> int:
    engine = QueryEngine(build_session(), Catalog(config.path("catalog")), config.query, contract_of(config))
    sql = sys.stdin.read() if a.sql == "-" else a.sql
    if a.explain:
        error = engine.validate(sql, a.timeout)
        if error:
            raise error
        print("the statement is valid")
        return 0
    r = engine.execute(sql, a.max_rows, a.timeout)
    if a.format == "json":
        print(json.dumps({"columns": r.columns, "types": r.types, "rows": r.rows, "truncated": r.truncated, "data_version": r.data_version.label}, default=str))
    else:
        print(ascii_table(r.columns, r.rows))
        print(f"({r.row_count} rows{', truncated' if r.truncated else ''}; {r.duration_ms:.0f} ms; {r.data_version.label})")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeframe", description=__doc__)
    p.add_argument("--config", help="folder of app.yaml")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *actions: str):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        if actions:
            c.add_argument("action", choices=actions)
        return c

    command("config", _config, "show", "validate")
    c = command("generate", _generate, "history", "day")
    c.add_argument("n", type=int, nargs="?", default=1)
    c.add_argument("--preset", default="small")
    c.add_argument("--seed", type=int)
    c.add_argument("--overwrite", action="store_true")
    command("validate", _validate)
    command("profile", _profile).add_argument("--output")
    command("schema", _schema, "erd", "markdown").add_argument("--keys", action="store_true")
    c = command("refresh", _refresh)
    c.add_argument("--force", action="store_true")
    c.add_argument("--allow-invalid", action="store_true")
    command("catalog", _catalog, "status")
    command("storage", _storage, "check")
    c = command("query", _query)
    c.add_argument("sql")
    c.add_argument("--max-rows", type=int)
    c.add_argument("--timeout", type=float)
    c.add_argument("--explain", action="store_true")
    c.add_argument("--format", choices=("table", "json"), default="table")
    return p


def main(args: Sequence[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        config = load_config(a.config)
        logs.configure(config.logging)
        return a.run(config, a)
    except QueryError as e:
        print(e.to_llm(), file=sys.stderr)
    except (ConfigError, ContractError, SourceError, GeneratorError, CatalogError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
