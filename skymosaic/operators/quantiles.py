"""Exact quantiles of large groups, without a buffer of a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of an octave: a bin holds values that differ by a 64th of an octave at most.
PER_OCTAVE = 64


def quantiles(rows: DataFrame, keys: Sequence[str], values: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(keys, name, q1, q2, ...): linearly interpolated quantiles of each column in `values` for each group; nulls and NaN do not count.

    Counts of logarithmic bins, made before the shuffle, tell which bins hold the wanted ranks; only those bins' values are
    counted one by one, so what a group sends on is bounded by its bins and by the distinct values of a few of them.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in values]))
    long = rows.select(*keys, pairs.alias("p")).select(*keys, "p.name", "p.v").filter("v is not null and not isnan(v)")
    # an order-preserving bin of any double: infinities and zero have their own
    size = F.least(F.greatest(F.floor(F.log2(F.abs("v")) * PER_OCTAVE), F.lit(-70_000)), F.lit(70_000)) + 70_001
    long = long.withColumn("bin", F.when(F.col("v") == 0, F.lit(0)).otherwise(F.signum("v").cast("int") * size).cast("int"))
    by = [*keys, "name"]
    counts = long.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumn("total", F.sum("n").over(whole)).withColumn("before", F.coalesce(F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = [(F.floor((F.col("total") - 1) * s), F.ceil((F.col("total") - 1) * s)) for s in shares]
    inside = lambda r, start, n: (r >= start) & (r < start + n)
    wanted = None
    for r in (r for pair in ranks for r in pair):
        here = inside(r, F.col("before"), F.col("n"))
        wanted = here if wanted is None else wanted | here
    picked = counts.filter(wanted).select(*[F.col(c).alias(f"__{c}") for c in (*by, "bin")], "total", "before")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "bin")]
    fine = long.join(picked, same).groupBy(*by, "bin", "total", "before", "v").agg(F.count("*").alias("n"))
    in_bin = Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(in_bin), F.lit(0)))
    at = lambda r: F.max(F.when(inside(r, F.col("start"), F.col("n")), F.col("v")))
    found = fine.groupBy(*by).agg(F.max("total").alias("total"), *[at(r).alias(f"{side}{k}") for k, pair in enumerate(ranks) for side, r in zip(("low", "high"), pair)])
    out = []
    for k, s in enumerate(shares):
        place = (F.col("total") - 1) * F.lit(float(s))
        low, high = F.col(f"low{k}"), F.col(f"high{k}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(f"q{k + 1}"))
    return found.select(*by, *out)
