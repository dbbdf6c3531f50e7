"""The guard of untrusted statements: a tokenizer and splitter, an allow-list of plan nodes, a deny-list of functions.

Spark runs commands as soon as it is given them, so nothing reaches spark.sql() before its parsed plan has been
found to consist of allowed nodes alone, in subqueries and common table expressions too. Analysed plans are checked
once more: functions that reach outside are refused, and every file read must be one of the version's.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from lodeframe.errors import QueryError, classified

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:''|\\.|[^'\\])*'|\"(?:\"\"|\\.|[^\"\\])*\"|`(?:``|[^`])*`|\s+|;|[A-Za-z_]\w*|\d[\w.]*|.", re.DOTALL)

# First words that write, command or control, and so are refused before parsing.
REFUSED = frozenset(
    "INSERT UPDATE DELETE MERGE CREATE DROP ALTER TRUNCATE COPY EXPORT IMPORT ATTACH DETACH INSTALL LOAD SET RESET PRAGMA CALL USE "
    "EXECUTE PREPARE DEALLOCATE BEGIN COMMIT ROLLBACK START CHECKPOINT VACUUM ANALYZE CACHE UNCACHE REFRESH MSCK ADD LIST REPAIR GRANT REVOKE EXPLAIN DECLARE REPLACE COMMENT CLEAR SYNC OPTIMIZE FORCE".split()
)

# Names of logical nodes (and of expressions that stand for plans) that a reading statement may consist of.
NODES = frozenset(
    "Project Filter Join LateralJoin Aggregate Sort GlobalLimit LocalLimit LimitAndOffset Offset Limit Tail Distinct Deduplicate Union Except Intersect SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedTVFAliases OneRowRelation "
    "LocalRelation Range Window WithWindowDefinition Generate Pivot Unpivot Expand UnresolvedHaving UnresolvedHint ResolvedHint AsOfJoin Sample View CTERelationDef CTERelationRef WithCTE "
    "LogicalRelation LogicalRDD UnresolvedOrdinal UnresolvedGroupBy InMemoryRelation ReturnAnswer EmptyRelation RebalancePartitions Repartition RepartitionByExpression "
    "UnionLoop UnionLoopRef UnresolvedSubquery PipeExpression PipeOperator UnresolvedPivot SerializeFromObject Aggregation".split()
)

# Functions that call code, read the environment, or tell paths and settings.
FUNCTIONS = frozenset(
    "reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user current_catalog current_database current_schema version "
    "spark_partition_id schema_of_xml xpath xpath_string from_avro to_avro from_protobuf to_protobuf assert_true_file getenv".split()
)
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode".split())


def tokens(sql: str) -> list[tuple[str, int, int]]:
    """(text, start, end) of the tokens that are neither blank nor comment."""
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(sql) if not m[0].isspace() and not m[0].startswith(("--", "/*"))]


def check_statement(sql: str, max_chars: int) -> str:
    """The one reading statement of sql, without closing semicolons and what follows them."""
    text = sql.strip()
    if not text:
        raise QueryError("empty", "the statement is empty", sql)
    if len(text) > max_chars:
        raise QueryError("too_long", f"the statement has {len(text)} characters", sql, limit=max_chars)
    found = tokens(text)
    words = [t for t in found if t[0] != ";"]
    if not words:
        raise QueryError("empty", "the statement holds nothing but comments", sql)
    first_end = next((k for k, t in enumerate(found) if t[0] == ";"), len(found))
    if any(t[0] != ";" for t in found[first_end:]) and any(t[0] != ";" for t in found[:first_end]):
        raise QueryError("multiple_statements", "more than one statement was given", sql)
    verb = words[0][0].upper()
    if verb in REFUSED:
        raise QueryError("not_read_only", f"{verb} is not a reading statement", sql)
    if any(t[0].startswith(("'", '"', "`")) and len(t[0]) == 1 for t in words):
        raise QueryError("syntax", "a quotation is not closed", sql)
    end = words[-1][2]
    # a comment after the last word stays, unless a semicolon stands before it
    return text[:end] if first_end < len(found) and found[first_end][1] >= end and _only_blank(text[end : found[first_end][1]]) else text if first_end == len(found) else text[: found[first_end][1]].rstrip()


def _only_blank(text: str) -> bool:
    return not text.strip()


def plan_nodes(plan) -> list[dict]:
    """Every logical node and expression of a JVM plan, subqueries included, as Spark's JSON has them."""
    out, stack = [], [json.loads(plan.toJSON())]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if "class" in x:
                out.append(x)
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
    return out


def _is_plan(name: str) -> bool:
    return ".plans.logical." in name or ".execution." in name or name.endswith(("UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedWith", "UnresolvedHaving", "LogicalRelation", "LogicalRDD")) or name.rpartition(".")[2].startswith(("UnresolvedSubqueryColumn", "UnresolvedTVF", "UnresolvedExecute"))


def parsed(spark: SparkSession, sql: str, tables: list[str]):
    """The parsed plan of a statement whose nodes are all allowed; DESCRIBE t and SHOW TABLES pass as they are."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001
        from pyspark.errors.exceptions.captured import convert_exception

        error = e if isinstance(e, ParseException) else convert_exception(e.java_exception) if hasattr(e, "java_exception") else e
        raise classified(error, sql, tables) from None
    root = plan.getClass().getSimpleName()
    if root in ("DescribeRelation", "ShowTables", "ShowTablesCommand"):
        return plan
    for node in _classes(plan):
        name = node.rpartition(".")[2].rstrip("$")
        if name in ("ScriptTransformation", "UnresolvedExecuteImmediate") or _is_plan(node) and name not in NODES:
            raise QueryError("not_read_only", f"{name} is not allowed in a reading statement", sql)
    return plan


def _classes(plan) -> set[str]:
    try:
        return {n["class"] for n in plan_nodes(plan)}
    except Exception:  # noqa: BLE001  some plans have no JSON; their tree is walked instead
        out, stack = set(), [plan]
        while stack:
            p = stack.pop()
            out.add(p.getClass().getName())
            for kids in (p.children(), p.innerChildren(), p.subqueries()):
                stack += [kids.apply(i) for i in range(kids.size())]
        return out


def check_names(sql: str) -> None:
    """Refuse functions that reach outside, and table functions other than the known ones, by name."""
    found = tokens(sql)
    for (a, *_), (b, *_) in zip(found, found[1:]):
        if b == "(" and a.lower().strip("`") in FUNCTIONS - {"getenv"}:
            raise QueryError("forbidden", f"the function {a} can't be used", sql)
    for k in range(len(found) - 2):
        if found[k][0].upper() in ("FROM", "JOIN", ",") and found[k + 2][0] == "(" and found[k][0] != "," and re.fullmatch(r"[A-Za-z_]\w*", found[k + 1][0]):
            name = found[k + 1][0].lower()
            if name not in TABLE_FUNCTIONS and name not in ("select", "lateral", "values", "unnest", "table"):
                raise QueryError("forbidden", f"the table function {name} can't be used", sql)


def check_analysed(df, allowed_files: set[str], sql: str) -> None:
    """Refuse calls by reflection that have got this far, and files that are none of the version's."""
    for node in _classes(df._jdf.queryExecution().analyzed()):
        name = node.rpartition(".")[2]
        if name in ("CallMethodViaReflection", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "ScriptTransformation", "PythonUDF", "ScalaUDF"):
            raise QueryError("forbidden", f"{name} can't be used", sql)
    for uri in df.inputFiles():
        if plain_path(uri) not in allowed_files:
            raise QueryError("forbidden", "the statement reads files that are not part of the data version", sql)


def plain_path(uri: str) -> str:
    from urllib.parse import unquote

    return unquote(re.sub(r"^file:/+", "/", uri))
