"""A small relational builder: one declaration, two renderings.

A Relation is a chain of steps (computed columns, filters, aggregations, joins, ...).
frame() builds it as a lazy Spark DataFrame, so Catalyst sees one declarative plan and
prunes, pushes down and reorders it; sql() renders the same chain as DuckDB SQL, which
the tests and the driver hold the results against. Expressions are written once in the
common dialect; functions with different names are translated by `_NAMES`, and an
expression that differs more is given as a pair (Spark, DuckDB).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark function names and what DuckDB calls them.
_NAMES = {
    "percentile": "quantile_cont", "bround": "round_even", "format_string": "printf", "size": "len", "array": "list_value", "collect_list": "list", "array_join": "array_to_string",
    "array_contains": "list_contains", "rlike": "regexp_matches", "explode": "unnest", "array_distinct": "list_distinct", "bool_and": "bool_and", "array_sort": "list_sort",
    "array_size": "len", "char_length": "length", "instr": "instr", "map_keys": "map_keys", "sha1": "sha1", "unix_seconds": "epoch", "pow": "pow", "median": "median",
}
_CALL = re.compile(r"\b(" + "|".join(_NAMES) + r")\(")


def spark_text(e) -> str:
    return e[0] if isinstance(e, tuple) else e


def _counted(e: str) -> str:
    """count_if as a count of a case, so that it is a 64-bit number in DuckDB too."""
    while (at := e.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(e[end], 0)
            end += 1
        e = f"{e[:at]}count(case when {e[at + len('count_if(') : end - 1]} then 1 end){e[end:]}"
    return e


def duck_text(e) -> str:
    if isinstance(e, tuple):
        return _counted(e[1])
    e = _counted(e)
    return _CALL.sub(lambda m: _NAMES[m[1]] + "(", e)


@dataclass(frozen=True)
class Relation:
    build: Callable[[SparkSession, str], DataFrame]
    text: Callable[[], str]
    columns: tuple[str, ...] = field(default=())

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir)

    def sql(self) -> str:
        return self.text()

    def _then(self, build: Callable[[DataFrame], DataFrame], text: Callable[[str], str]) -> Relation:
        return Relation(lambda s, d: build(self.build(s, d)), lambda: text(self.text()))

    def let(self, **cols) -> Relation:
        """Add columns under new names; all of them see the columns from before this step."""
        return self._then(
            lambda df: df.withColumns({k: F.expr(spark_text(e)) for k, e in cols.items()}),
            lambda q: f"SELECT *, {', '.join(f'{duck_text(e)} AS {k}' for k, e in cols.items())} FROM ({q})")

    def where(self, cond) -> Relation:
        return self._then(lambda df: df.where(F.expr(spark_text(cond))), lambda q: f"SELECT * FROM ({q}) WHERE {duck_text(cond)}")

    def select(self, *names: str, **cols) -> Relation:
        both = {n: n for n in names} | cols
        return self._then(
            lambda df: df.select(*[F.expr(spark_text(e)).alias(k) for k, e in both.items()]),
            lambda q: f"SELECT {', '.join(f'{duck_text(e)} AS {k}' for k, e in both.items())} FROM ({q})")

    def agg(self, keys: str, **cols) -> Relation:
        names = keys.split()
        return self._then(
            lambda df: df.groupBy(*names).agg(*[F.expr(spark_text(e)).alias(k) for k, e in cols.items()]),
            lambda q: f"SELECT {', '.join([*names, *(f'{duck_text(e)} AS {k}' for k, e in cols.items())])} FROM ({q})" + (f" GROUP BY {', '.join(names)}" if names else ""))

    def distinct(self) -> Relation:
        return self._then(lambda df: df.distinct(), lambda q: f"SELECT DISTINCT * FROM ({q})")

    def join(self, other: Relation, on: str, how: str = "inner") -> Relation:
        """Equi-join on columns of equal names (semi and anti included)."""
        names = on.split()
        word = {"inner": "JOIN", "left": "LEFT JOIN", "semi": "SEMI JOIN", "anti": "ANTI JOIN", "outer": "FULL JOIN"}[how]
        return Relation(
            lambda s, d: self.build(s, d).join(other.build(s, d), names, {"semi": "left_semi", "anti": "left_anti"}.get(how, how)),
            lambda: f"SELECT * FROM ({self.text()}) {word} ({other.text()}) USING ({', '.join(names)})")

    def union(self, other: Relation) -> Relation:
        return Relation(lambda s, d: self.build(s, d).unionByName(other.build(s, d)), lambda: f"{self.text()} UNION ALL BY NAME {other.text()}")

    def explode(self, name: str, array) -> Relation:
        return self._then(lambda df: df.withColumn(name, F.explode(F.expr(spark_text(array)))), lambda q: f"SELECT *, unnest({duck_text(array)}) AS {name} FROM ({q})")


#: Tables that stand in for the views of the test data while a query is built; see alphaloom.api.
BOUND: ContextVar[dict[str, DataFrame]] = ContextVar("bound", default={})


def slot(name: str, default: Relation, derive: Callable[[dict[str, DataFrame]], DataFrame | None] = lambda bound: None) -> Relation:
    """A relation that a caller's table of that name replaces, or one derived from the caller's other tables."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound = BOUND.get()
        if name in bound:
            return bound[name]
        derived = derive(bound)
        return default.build(spark, sf_dir) if derived is None else derived

    return Relation(build, default.text)


def isum(x: str) -> tuple[str, str]:
    """A sum of whole numbers as a 64-bit number in both engines."""
    return f"sum({x})", f"sum({x})::BIGINT"


def table(name: str, *columns: str) -> Relation:
    """An input table, with only the named columns if any are given."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return df.select(*columns) if columns else df

    return Relation(build, lambda: f"SELECT {', '.join(columns) or '*'} FROM {name}")


def rows(schema: str, *values: tuple) -> Relation:
    """A small literal table; schema as 'name type, ...' with types both engines know."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [c.split()[1] for c in schema.split(",")]
    lit = lambda v: "NULL" if v is None else ("TRUE" if v is True else "FALSE" if v is False else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v))
    duck = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    return Relation(
        lambda s, d: s.createDataFrame(list(values), schema.replace("timestamp", "string")).select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds)]),
        lambda: f"SELECT {', '.join(f'{n}::{duck[k]} AS {n}' for n, k in zip(names, kinds))} FROM (VALUES {', '.join('(' + ', '.join(map(lit, v)) + ')' for v in values)}) AS v({', '.join(names)})")
