"""What a contract looks like on paper: an entity-relationship diagram and a Markdown description."""

from __future__ import annotations

from collections.abc import Iterator

from lodeframe.contract import Column, Contract, ForeignKey, Table

HEAD = "| Column | Type | Null | Notes |\n|---|---|---|---|"


def link(t: Table, key: ForeignKey) -> str:
    """One relation in crow's-foot notation. The parent may be missing where a column of the key is nullable; a child
    must exist where the contract says that the key covers its target; a key that is the child's own is one to one."""
    nullable = any(c.nullable for c in t.columns if c.name in key.columns)
    single = set(key.columns) == set(t.primary_key)
    parent = "|o" if nullable else "||"
    child = ("||" if single else "|{") if key.covers else ("o|" if single else "o{")
    return f'{key.table} {parent}--{child} {t.name} : "{", ".join(key.columns)}"'


def entity(t: Table, full: bool) -> Iterator[str]:
    roles: dict[str, list[str]] = {}
    for role, names in (("PK", t.primary_key), *(("FK", k.columns) for k in t.foreign_keys)):
        for name in names:
            if role not in roles.setdefault(name, []):
                roles[name].append(role)
    yield f"{t.name} {{"
    for c in t.columns:
        if full or c.name in roles:
            yield "    " + " ".join(filter(None, (c.type.partition("(")[0].lower(), c.name, ", ".join(roles.get(c.name, ())))))
    yield "}"


def mermaid(contract: Contract, full: bool = True) -> str:
    """An entity-relationship diagram; with full=False only key columns are listed."""
    body = [line for t in contract.tables.values() for line in entity(t, full)]
    body += [link(t, key) for t in contract.tables.values() for key in t.foreign_keys]
    return "erDiagram\n" + "\n".join("    " + line for line in body)


def notes(c: Column) -> str:
    """What a reader needs beyond the type: meaning, unit, limits, values."""
    limits = {(True, True): f"from {c.min} to {c.max}", (True, False): f"at least {c.min}", (False, True): f"at most {c.max}", (False, False): ""}[c.min is not None, c.max is not None]
    values = "values: " + ", ".join(f"`{v}`" for v in c.allowed_values) if c.allowed_values else ""
    return "; ".join(filter(None, (c.description, c.unit and f"in {c.unit}", limits, values)))


def chapter(t: Table) -> Iterator[str]:
    yield f"## `{t.name}`"
    yield f"A {t.kind} with {t.grain or 'no stated grain'}; its key is `{', '.join(t.primary_key)}`." + (f" {t.description}" if t.description else "")
    yield "\n".join([HEAD, *(f"| `{c.name}` | {c.type} | {'yes' if c.nullable else 'no'} | {notes(c)} |" for c in t.columns)])
    if t.foreign_keys:
        yield "\n".join(f"- `{', '.join(k.columns)}` points to `{k.references}`" for k in t.foreign_keys)
    if t.checks:
        yield "\n".join(f"- every row holds `{c.name}`: `{c.expr}`" for c in t.checks)


def markdown(contract: Contract) -> str:
    """The schema's documentation: the diagram and a chapter for each table."""
    parts = ["# Tables", f"Amounts of money are in {contract.currency}.", f"```mermaid\n{mermaid(contract)}\n```"]
    parts += [part for t in contract.tables.values() for part in chapter(t)]
    return "\n\n".join(parts) + "\n"
