"""What SQL may run, and how its dialect becomes Spark's: one reading statement, judged by its tokens and by its parsed plan.

The text is cut into tokens by the rules of the users' dialect (no escapes in strings but doubled quotes; double quotes for names) and
written again for Spark, strings escaped and names in backquotes, so that Spark reads exactly the tokens that were judged.  Then
Spark's own parser makes a plan, and every node, relation and function in it must be one that only reads: this
refuses scripts, calls into the JVM, files and whatever else no list of words could.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidemark.model import Rejected

Token = tuple[str, str]

#: Words that a statement for users must not have as tokens.
FORBIDDEN = frozenset(
    "ALTER ATTACH CALL CHECKPOINT COMMENT COPY CREATE DELETE DETACH DROP EXPORT FORCE GRANT IMPORT INSERT INSTALL LOAD "
    "MERGE PRAGMA REPLACE RESET REVOKE SET TRUNCATE UPDATE USE VACUUM".split()
)
STARTS = ("SELECT", "WITH", "EXPLAIN")
MAX_BYTES = 64 * 1024

#: Kinds of Spark functions that compute from their arguments alone; of other kinds only those named.
PURE_GROUPS = frozenset(
    " predicate_funcs math_funcs bitwise_funcs datetime_funcs lambda_funcs agg_funcs array_funcs string_funcs conditional_funcs conversion_funcs "
    "collection_funcs generator_funcs hash_funcs window_funcs json_funcs csv_funcs map_funcs struct_funcs url_funcs".split(" ")
)
PURE_OTHERS = frozenset("raise_error typeof uuid".split())
IMPURE = frozenset("collations sql_keywords".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack generate_series".split())
#: Nodes of a parsed plan that only read.
PLAN_NODES = frozenset(
    "UnresolvedWith SubqueryAlias Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except UnresolvedRelation "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedSubqueryColumnAliases UnresolvedInlineTable LocalRelation OneRowRelation WithWindowDefinition UnresolvedHaving "
    "Pivot Unpivot Sample Generate UnionLoop Window ResolvedInlineTable".split()
)
#: Names of the dialect and Spark's for the same function.
RENAMED = {
    "to_timestamp": "timestamp_seconds", "error": "raise_error", "epoch_us": "unix_micros", "epoch_ms": "unix_millis", "starts_with": "startswith", "ends_with": "endswith",
    "arg_min": "min_by", "arg_max": "max_by", "list": "collect_list", "list_contains": "array_contains", "list_transform": "transform", "list_filter": "filter", "list_reduce": "reduce",
    "list_sort": "sort_array", "list_distinct": "array_distinct", "list_concat": "concat", "json_extract": "get_json_object", "json_extract_string": "get_json_object", "quantile_cont": "percentile",
    "regexp_matches": "regexp_like", "unnest": "explode", "approx_quantile": "approx_percentile", "map_keys": "map_keys", "cardinality": "cardinality",
}
#: Functions that Spark has no word for, as expressions of their arguments.
OWN_FUNCTIONS = {
    "time_bucket": "(width INTERVAL DAY TO SECOND, t TIMESTAMP) RETURNS TIMESTAMP RETURN "
    "timestamp_micros(unix_micros(t) - pmod(unix_micros(t) - 946857600000000, unix_micros(timestamp_micros(0) + width)))",
    "ts_date_diff": "(part STRING, a TIMESTAMP, b TIMESTAMP) RETURNS BIGINT RETURN CASE lower(part) "
    "WHEN 'microsecond' THEN unix_micros(b) - unix_micros(a) WHEN 'second' THEN unix_seconds(b) - unix_seconds(a) "
    "WHEN 'minute' THEN unix_seconds(date_trunc('minute', b)) / 60 - unix_seconds(date_trunc('minute', a)) / 60 "
    "WHEN 'hour' THEN unix_seconds(date_trunc('hour', b)) / 3600 - unix_seconds(date_trunc('hour', a)) / 3600 "
    "WHEN 'day' THEN unix_date(date(b)) - unix_date(date(a)) "
    "WHEN 'month' THEN 12 * (year(b) - year(a)) + month(b) - month(a) WHEN 'year' THEN year(b) - year(a) "
    "ELSE raise_error('unknown part of a date') END",
}
#: What current_setting tells; nothing of the host's.
SETTINGS = {
    "timezone": "'UTC'", "enable_external_access": "false", "lock_configuration": "true", "autoload_known_extensions": "false", "autoinstall_known_extensions": "false", "allow_community_extensions": "false",
}
#: Marks of a time's format, and Spark's letters.
TIME_MARKS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD"}


def tokens(sql: str) -> Iterator[Token]:
    """(kind, text) of words, strings, quoted names and other signs; comments and white space are left out."""
    at, n = 0, len(sql)
    while at < n:
        c = sql[at]
        if c.isspace():
            at += 1
        elif sql.startswith("--", at):
            end = sql.find("\n", at)
            at = n if end < 0 else end + 1
        elif sql.startswith("/*", at):
            depth, at = 1, at + 2
            while depth:
                if at >= n:
                    raise Rejected("a comment has no end")
                step = sql[at : at + 2]
                depth += {"/*": 1, "*/": -1}.get(step, 0)
                at += 2 if step in ("/*", "*/") else 1
        elif c in "'\"`":
            end = at + 1
            while True:
                end = sql.find(c, end)
                if end < 0:
                    raise Rejected("a quotation has no end")
                if sql[end : end + 2] != c + c:
                    break
                end += 2
            yield ("string" if c == "'" else "name", sql[at + 1 : end].replace(c + c, c))
            at = end + 1
        elif c.isalnum() or c == "_":
            end = at
            while end < n and (sql[end].isalnum() or sql[end] in "_$" or (sql[end] == "." and sql[at:end].isdigit())):
                end += 1
            yield ("word", sql[at:end])
            at = end
        else:
            two = sql[at : at + 2]
            size = 2 if two in ("||", "<=", ">=", "<>", "!=", "::", "->", "<<", ">>", "==", "=>") else 1
            yield ("sign", sql[at : at + size])
            at += size


def check_query(sql: str) -> list[Token]:
    """The statement's tokens without a last semicolon, if no word of it is refused."""
    if len(sql.encode()) > MAX_BYTES:
        raise Rejected("the statement is too long")
    if "\0" in sql:
        raise Rejected("the statement holds a zero character")
    found = list(tokens(sql))
    while found and found[-1] == ("sign", ";"):
        found.pop()
    if not found or found[0][0] != "word" or found[0][1].upper() not in STARTS:
        raise Rejected("only SELECT, WITH and EXPLAIN are allowed")
    if ("sign", ";") in found:
        raise Rejected("one statement only")
    for kind, text in found:
        if kind == "word" and text.upper() in FORBIDDEN:
            raise Rejected(f"{text.upper()} is not allowed")
    return found


def spark_text(found: list[Token]) -> str:
    """The tokens as Spark's parser reads them back."""

    def written(kind: str, text: str) -> str:
        if kind == "string":
            return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "`" + text.replace("`", "``") + "`" if kind == "name" else text

    return " ".join(written(kind, text) for kind, text in found)


def translated(found: list[Token], relations: set[str]) -> list[Token]:
    """The dialect's names as Spark's, and ``name()`` of the given relations as plain names."""
    out: list[Token] = []
    at = 0
    while at < len(found):
        kind, text = found[at]
        low, after = text.lower(), found[at + 1 : at + 4]
        called = kind == "word" and after[:1] == [("sign", "(")] and (not out or out[-1] != ("sign", "."))
        if called and low in relations and after[1:2] == [("sign", ")")]:
            out.append(("word", low))
            at += 3
        elif called and low == "current_setting":
            if len(after) < 3 or after[1][0] != "string" or after[2] != ("sign", ")") or after[1][1].lower() not in SETTINGS:
                raise Rejected("no such setting")
            out.append(("word", SETTINGS[after[1][1].lower()]))
            at += 4
        elif called and low == "strftime":
            stop = _closing(found, at + 1)
            if found[stop - 1][0] != "string" or found[stop - 2] != ("sign", ","):
                raise Rejected("strftime needs a literal format")
            out += [("word", "date_format"), *translated(found[at + 1 : stop - 1], relations), ("string", _time_format(found[stop - 1][1]))]
            at = stop
        elif called and low in ("date_diff", "datediff") and len(after) > 1 and after[1][0] == "string":
            out.append(("word", "ts_date_diff"))
            at += 1
        elif kind == "word" and low == "exclude" and after[:1] == [("sign", "(")] and out and out[-1] == ("sign", "*"):
            out.append(("word", "EXCEPT"))
            at += 1
        else:
            out.append(("word", RENAMED[low]) if called and low in RENAMED else (kind, text))
            at += 1
    return out


def _closing(found: list[Token], opened: int) -> int:
    depth = 0
    for at in range(opened, len(found)):
        depth += {("sign", "("): 1, ("sign", ")"): -1}.get(found[at], 0)
        if not depth:
            return at
    raise Rejected("a bracket has no end")


def _time_format(marks: str) -> str:
    out, parts = "", iter(marks)
    for c in parts:
        if c == "%":
            mark = next(parts, "")
            if mark not in TIME_MARKS and mark != "%":
                raise Rejected(f"unknown mark %{mark} of a time")
            out += TIME_MARKS.get(mark, "%")
        else:
            out += f"'{c}'" if c.isalpha() else c
    return out


def by_name_parts(found: list[Token]) -> tuple[list[Token], bool, list[Token]] | None:
    """Both sides of a last ``UNION [ALL] BY NAME`` outside brackets, and whether rows repeat."""
    depth, cut = 0, None
    for at, token in enumerate(found):
        depth += {("sign", "("): 1, ("sign", ")"): -1}.get(token, 0)
        words = [t.upper() for k, t in found[at : at + 4] if k == "word"]
        if not depth and words[:1] == ["UNION"] and (words[1:3] == ["BY", "NAME"] or words[1:4] == ["ALL", "BY", "NAME"]):
            cut = at, words[1] == "ALL"
    return None if cut is None else (found[: cut[0]], cut[1], found[cut[0] + 3 + cut[1] :])


@dataclass
class Names:
    """What a parsed statement reads."""

    relations: set[str]
    functions: set[str]


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def names_of(plan) -> Names:
    """Relations and functions of a parsed plan; refuses nodes that do more than read."""
    out = Names(set(), set())
    inside: set[str] = set()

    def walk(node, is_plan: bool) -> None:
        kind = node.getClass().getSimpleName()
        if is_plan:
            if kind.rstrip("$") not in PLAN_NODES:
                raise Rejected(f"{kind} is not allowed")
            if kind == "UnresolvedRelation":
                out.relations.add(".".join(p.lower() for p in _items(node.multipartIdentifier())))
            if kind == "UnresolvedTableValuedFunction":
                name = ".".join(p.lower() for p in _items(node.name()))
                if name not in TABLE_FUNCTIONS:
                    raise Rejected(f"{name} is not allowed")
            if kind == "UnresolvedWith":
                inside.update(x.alias().lower() for x in _items(node.innerChildren()))
            for x in _items(node.expressions()):
                walk(x, False)
        elif kind == "UnresolvedFunction":
            out.functions.add(".".join(p.lower() for p in _items(node.nameParts())))
        elif kind == "UnresolvedGenerator":
            out.functions.add(node.name().unquotedString().lower())
        elif kind.startswith(("CallMethod", "Invoke", "StaticInvoke", "PythonUDF", "ScalaUDF")):
            raise Rejected(f"{kind} is not allowed")
        for x in _items(node.innerChildren()):
            walk(x, _is_plan(x))
        for x in _items(node.children()):
            walk(x, is_plan)

    walk(plan, True)
    out.relations -= inside
    return out


def _is_plan(node) -> bool:
    kind = node.getClass()
    while kind is not None:
        if kind.getName() == "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan":
            return True
        kind = kind.getSuperclass()
    return False


def check_reads(df: DataFrame) -> None:
    """Refuses a statement that reads a table of Spark's own catalog, whatever name led there."""

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind in ("HiveTableRelation", "DataSourceV2Relation", "UnresolvedCatalogRelation") or (kind == "LogicalRelation" and node.catalogTable().isDefined()):
            raise Rejected("no such table")
        for x in [*_items(node.children()), *[y for y in _items(node.innerChildren()) if _is_plan(y)]]:
            walk(x)

    walk(df._jdf.queryExecution().analyzed())


def check_plan(session: SparkSession, text: str, relations: set[str]) -> None:
    """Refuses a text whose parsed plan does more than read the given relations by functions that only compute."""
    inner = session._jsparkSession.sessionState()
    try:
        names = names_of(inner.sqlParser().parsePlan(text))
    except PySparkException as failed:
        raise Rejected(f"the statement can't be read: {str(failed).strip()[:500]}") from None
    for name in names.relations - relations:
        raise Rejected(f"no table {name}")
    for name in names.functions - OWN_FUNCTIONS.keys():
        try:
            info = inner.catalog().lookupFunctionInfo(session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        except Exception:  # noqa: BLE001 - whatever py4j makes of it, there is no such function
            raise Rejected(f"no function {name}") from None
        if info.getSource() != "built-in" or name in IMPURE or (info.getGroup() not in PURE_GROUPS and name not in PURE_OTHERS):
            raise Rejected(f"the function {name} is not allowed")


def is_call(sql: str) -> bool:
    first = next(tokens(sql), None)
    return first is not None and first[0] == "word" and first[1].upper() == "CALL"


def parse_call(sql: str) -> tuple[str, list[str | int | bool | None]]:
    """Name and literal arguments of ``CALL name(...)``; anything but literals is refused."""
    found = list(tokens(sql))
    if found and found[-1] == ("sign", ";"):
        found.pop()
    if len(found) < 4 or found[1][0] != "word" or found[2] != ("sign", "(") or found[-1] != ("sign", ")"):
        raise Rejected("expected CALL name(literals)")
    args: list[str | int | bool | None] = []
    rest = found[3:-1]
    while rest:
        sign = 1
        if rest[0] == ("sign", "-"):
            sign, rest = -1, rest[1:]
        if not rest:
            raise Rejected("an argument is missing")
        kind, text = rest[0]
        word = text.upper()
        if kind == "string" and sign > 0:
            args.append(text)
        elif kind == "word" and text.isdigit():
            args.append(sign * int(text))
        elif kind == "word" and sign > 0 and word in ("TRUE", "FALSE", "NULL"):
            args.append({"TRUE": True, "FALSE": False, "NULL": None}[word])
        else:
            raise Rejected("arguments must be literals")
        rest = rest[1:]
        if rest:
            if rest[0] != ("sign", ",") or len(rest) == 1:
                raise Rejected("expected a comma between literals")
            rest = rest[1:]
    return found[1][1].lower(), args
