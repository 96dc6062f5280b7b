"""Aggregates of the query language. They run over distinct tuples, so counts count rows, nulls included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import SPARK_TYPES, UNION, Val, number, sort_key

#: The column of random numbers, one a tuple, that draws need.
DRAW = "__draw"


def _whole(args) -> int:
    if len(args) != 2 or isinstance(args[0], bool) or not isinstance(args[0], int) or args[0] < 0:
        raise TypeError("this aggregate takes a count and a variable")
    return args[0]


def _extreme(args, v: Val, least: bool) -> tuple[Column, str]:
    if len(args) > 1:
        return F.slice(F.sort_array(F.collect_set(v.col), least), 1, _whole(args)), "list"
    if v.kind == "any":
        return (F.min_by if least else F.max_by)(v.col, sort_key(v)), "any"
    return (F.min if least else F.max)(v.col), v.kind


def _sum(args, v: Val):
    kind = "double" if v.kind in ("double", "any") else "long"
    return F.coalesce(F.sum(number(v)), F.lit(0).cast("double" if kind == "double" else "bigint")), kind


def _rand(args, v: Val):
    """Draws with repetition among all tuples: each draw is the tuple of the largest random number of its own (DRAW
    is a column that the compiler adds), so a group keeps one value a draw and never its rows."""
    draws = [F.max_by(F.struct(v.col.alias("x")), F.xxhash64(F.col(DRAW), F.lit(k)))["x"] for k in range(_whole(args))]
    return F.array(*draws) if draws else F.array().cast(f"array<{UNION if v.kind == 'any' else SPARK_TYPES.get(v.kind, 'string')}>"), "list"


#: name -> function of (arguments, value): (column, kind)
AGGREGATES = {
    "count": lambda a, v: (F.count(F.lit(1)), "long"),
    "count-distinct": lambda a, v: (F.count_distinct(v.col) + F.coalesce(F.max(v.col.isNull().cast("bigint")), F.lit(0)), "long"),
    "sum": _sum,
    "avg": lambda a, v: (F.avg(number(v)), "double"),
    "min": lambda a, v: _extreme(a, v, True),
    "max": lambda a, v: _extreme(a, v, False),
    "median": lambda a, v: (F.median(number(v)), "double"),
    "variance": lambda a, v: (F.var_pop(number(v)), "double"),
    "stddev": lambda a, v: (F.stddev_pop(number(v)), "double"),
    "distinct": lambda a, v: (F.sort_array(F.collect_set(v.col)), "list"),
    "sample": lambda a, v: (F.slice(F.shuffle(F.collect_set(v.col)), 1, _whole(a)), "list"),
    "rand": _rand,
}
