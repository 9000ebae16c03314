"""Scalar functions of the analytics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULE = "shop"


def tier(v: Column, warn: int, high: int) -> tuple[Column, Column, Column]:
    """Severity, limit passed and its word, for a value above `warn`."""
    over = v > high
    return F.when(over, 2).otherwise(1), F.when(over, high).otherwise(warn), F.when(over, "high limit").otherwise("limit")


def percent(f: Column) -> Column:
    return F.round(f * 100).cast("bigint")


def fixed2(v: Column) -> Column:
    """A number from 0 on with two digits after the point, rounded by its exact binary value and a tie to the even digit, as C and Go print it."""
    # halves of its bits times 200 are exact, so what stands above the middle of two hundredths is told without rounding
    high = F.floor(v * 2**26) / 2**26
    n = F.floor(v * 100)
    above = (high * 200 - (2 * n + 1)) + (v - high) * 200
    n = n + F.when((above > 0) | ((above == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def importable(pkg: Column, name: Column, module: str = MODULE) -> Column:
    """Whether code outside of the module may import a package; one that is unknown may be."""
    inner = F.concat(F.substr(pkg, F.lit(len(module) + 1)), F.lit("/"))
    return ~F.contains(inner, F.lit("/internal/")) & (F.coalesce(name, F.lit("")) != "main")


def rel_of(pkg: Column, module: str = MODULE) -> Column:
    return F.when(F.startswith(pkg, F.lit(module + "/")), F.substr(pkg, F.lit(len(module) + 2))).otherwise(pkg)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def band(v: Column, *thresholds: int) -> Column:
    """How many thresholds a value reaches, at most 5."""
    return F.least(sum((F.when(v >= t, 1).otherwise(0) for t in thresholds), F.lit(0)), F.lit(5)).cast("bigint")


def join_path(*parts: Column) -> Column:
    """Parts of a path in one text: `~` between them, `%` and `~` within them escaped."""
    escaped = [F.replace(F.replace(p, F.lit("%"), F.lit("%25")), F.lit("~"), F.lit("%7E")) for p in parts]
    return F.concat_ws("~", *escaped)


def split_path(joined: Column) -> Column:
    """The parts that `join_path` joined."""
    return F.transform(F.split(joined, "~"), lambda p: F.replace(F.replace(p, F.lit("%7E"), F.lit("~")), F.lit("%25"), F.lit("%")))
