"""Where queries are registered with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import kb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, str] | None = None) -> DataFrame:
    return kb.frame(spark, sf_dir, sql, dealt)


# ---- pieces of DuckDB SQL ----


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def est(x: str) -> str:
    return f"greatest(1, floor(length({x}) / 3.7::DOUBLE))::BIGINT"


def parts(x: str, pattern: str, kept: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '{pattern}', {kept}, 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def sentences(x: str) -> str:
    return parts(x, r"([.!?])\s+([A-Z0-9])", r"'\1' || chr(1) || '\2'")


def windows(x: str, target: int = 320) -> str:
    """Sentence windows of the list of sentences x."""
    full = f"(a.tokens + {est('s')} > {target} AND len(a.win) > 0)"
    state = f"""list_reduce({x}, lambda a, s: {{'out': CASE WHEN {full} THEN list_append(a.out, array_to_string(a.win, ' ')) ELSE a.out END,
        'win': list_append(CASE WHEN {full} THEN a.win[-1:] ELSE a.win END, s), 'tokens': CASE WHEN {full} THEN {est('a.win[-1]')} ELSE a.tokens END + {est('s')}}},
        {{'out': []::VARCHAR[], 'win': []::VARCHAR[], 'tokens': 0::BIGINT}})"""
    return f"list_transform([{state}], lambda z: CASE WHEN len(z.win) > 0 THEN list_append(z.out, array_to_string(z.win, ' ')) ELSE z.out END)[1]"


def in_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"
