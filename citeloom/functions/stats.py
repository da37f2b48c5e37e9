"""Statistics as column expressions: average ranks, p-values of slopes, Benjamini-Hochberg, choose-two sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """value to some places as DuckDB rounds: its product with the power of ten, halves away from 0. F.round takes the shortest decimal
    that reads as value, and so parts from it at halves that no double holds."""
    return F.round(value * float(10**places)) / float(10**places)


def natural_log(value: Column) -> Column:
    """The C library's logarithm, as DuckDB takes it; the JVM's own parts from it in the last bit, which is enough to undo a tie.
    The function goes to the workers whole, so that they needn't have this package."""

    def log(x: float) -> float:
        return None if x is None else math.log(x)

    return F.udf(log, "double", useArrow=False)(value)


def average_rank(value: Column, *by: str) -> Column:
    """Rank from 1, ties share the mean of theirs; computed over each group of `by`."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def rank_share(value: Column, *by: str) -> Column:
    """The average rank as a share of the group, to 4 places; 1 in a group of one."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.when(n < 2, 1.0).otherwise(rounded(average_rank(value, *by) / n, 4))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate; null where one side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def student_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r of n points, by the finite series for whole degrees of freedom (A&S 26.7.3-4), all n / 2 terms of it."""
    df = n - 2
    t = F.abs(r) * F.sqrt(df / F.greatest((1 - F.abs(r)) * (1 + F.abs(r)), F.lit(1e-300)))
    theta = F.atan(t / F.sqrt(df))
    c2 = F.pow(F.cos(theta), 2)
    odd = F.pmod(df, F.lit(2)) == 1
    # Terms k = 1.. of the series: each is the one before times c2 and a ratio that differs for odd and even df.
    start = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    count = F.greatest(F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2), F.lit(0)).cast("int")
    steps = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    ratio = lambda k: F.when(odd, 2.0 * k / (2 * k + 1)).otherwise((2.0 * k - 1) / (2 * k))
    total = F.aggregate(
        steps, F.struct(start.alias("s"), start.alias("x")),
        lambda a, k: F.struct((a["s"] + a["x"] * c2 * ratio(k)).alias("s"), (a["x"] * c2 * ratio(k)).alias("x")), lambda a: a["s"],
    )
    inside = F.when(df == 1, 2 * theta / math.pi).when(odd, 2 / math.pi * (theta + F.sin(theta) * total)).otherwise(F.sin(theta) * total)
    return F.when(r.isNull() | (df < 1), 1.0).when(F.abs(r) >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - inside))


def bh_rank(p: Column, tie: Column, *by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(p, tie))


def choose_threshold(clusters: int, fraction: float = 0.8) -> float:
    """The share of clusters from which a term is background: as given up to 50 clusters, then five clusters, a twentieth at least."""
    return fraction if clusters <= 50 else max(0.05, 5.0 / clusters)
