"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name`` with its checking SQL, if it can be given."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return add


# Fragments shared by the checking SQL.

def d_raw(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def d_norm(c: str) -> str:
    return f"lower({d_raw(c)})"


def d_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def d_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def d_array(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def d_map_case(c: str, table: dict, default: str | None = None) -> str:
    """Dictionary lookup as CASE."""
    arms = " ".join(
        f"WHEN '{k}' THEN " + (str(v) if isinstance(v, (int, float)) else f"'{v}'")
        for k, v in table.items())
    return f"CASE {c} {arms} ELSE {c if default is None else default} END"


def d_bounded(needle: str, text: str) -> str:
    """Literal between word boundaries; RE2 reads ASCII boundaries, the texts checked so are ASCII."""
    return rf"regexp_matches({text}, '\b' || regexp_replace({needle}, '([.+*?^$(){{}}|\[\]\\/-])', '\\\1', 'g') || '\b')"
