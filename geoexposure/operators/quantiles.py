"""Exact quantiles by selection: no task holds the values of a group.

Equal values are counted first, so what is left are distinct values with their numbers. A group that has many of them is cut into bins at approximate
quantiles, a sketch of bounded size; the bins are counted, the one that holds the wanted rank is kept, and so on until it is small. The result is exact whatever
the sketch says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.sources.workspace import bounded, forget, keep

#: Distinct values of a group that are put in order in one task, bins that a larger group is cut into, and accuracy of the sketch.
FEW, BINS, ACCURACY = 50_000, 256, 4096


def exact_quantile(rows: DataFrame, by: list[str], value: Column, q: float = 0.5, few: int = FEW) -> DataFrame:
    """(``by``, quantile): the quantile ``q`` (0 to 1) of the values of each group, between two values in proportion. Null and NaN values don't count; groups without others give no row."""
    groups = [F.col(c) for c in by] or [F.lit(0)]  # without ``by`` all rows are one group
    names = [f"_g{k}" for k in range(len(groups))]
    whole = rows.select(*[c.alias(n) for c, n in zip(groups, names, strict=True)], value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    values = keep(whole.groupBy(*names, "_v").agg(F.count("*").alias("_n")), "quantile-values")
    place = (F.sum("_n") - 1) * F.lit(float(q))
    wanted = keep(values.groupBy(*names).agg(F.floor(place).alias("_rank"), (place - F.floor(place)).alias("_share")), "quantile-ranks")
    left, ranks, rounds = values, wanted.select(*names, "_rank"), []
    while True:
        sizes = left.groupBy(*names).agg(F.count("*").alias("_size")).where(F.col("_size") > few).select(*names)
        large = keep(sizes, "quantile-large")
        if large.isEmpty():
            break
        cuts = _on(left, large, names, "left_semi").groupBy(*names).agg(F.expr(f"array_distinct(approx_percentile(_v, {_steps()}, {ACCURACY}))").alias("_cuts"))
        binned = _on(left, keep(cuts, "quantile-cuts"), names, "left").withColumn("_bin", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col("_v")))).drop("_cuts")
        counts = binned.groupBy(*names, "_bin").agg(F.sum("_n").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_bin")) - F.col("_n")
        met = _on(counts.withColumn("_before", before), ranks, names, "inner").where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        ranks = keep(met.select(*names, "_bin", (F.col("_rank") - F.col("_before")).alias("_rank")), "quantile-bins")
        rounds.append(left)
        left = keep(_on(binned, ranks.select(*names, "_bin"), [*names, "_bin"], "left_semi").drop("_bin"), "quantile-values")
        ranks = ranks.drop("_bin")
    up_to = F.sum("_n").over(Window.partitionBy(*names).orderBy("_v"))
    met = _on(left.withColumn("_to", up_to), ranks, names, "inner").where((F.col("_to") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_to")))
    low = _on(met.select(*names, F.col("_v").alias("_low"), (F.col("_to") - 1 == F.col("_rank")).alias("_last")), wanted.select(*names, "_share"), names, "inner")
    low = keep(low, "quantile-low")
    # The next value counts where the rank lies between two values; it may be outside of the last bin.
    between = low.where("_last AND _share > 0").select(*names, "_low")
    high = _on(values, between, names, "inner").where("_v > _low").groupBy(*names).agg(F.min("_v").alias("_high"))
    out = _on(low, high, names, "left").withColumn("quantile", F.when(F.col("_high").isNull(), F.col("_low")).otherwise(F.col("_low") * (1 - F.col("_share")) + F.col("_high") * F.col("_share")))
    out = keep(out.select(*[F.col(n).alias(c) for c, n in zip(by, names)], "quantile"), "quantile")  # noqa: B905
    forget(*rounds, left)
    return out


def _steps() -> str:
    return f"array({', '.join(f'{k / BINS!r}D' for k in range(BINS + 1))})"


def _on(a: DataFrame, b: DataFrame, names: list[str], how: str) -> DataFrame:
    """``a`` joined with the few rows of ``b`` on equal names, nulls among them too."""
    b = bounded(b.select(*[F.col(c).alias(f"{c}_b") if c in names else F.col(c) for c in b.columns]))
    same = [a[c].eqNullSafe(b[f"{c}_b"]) for c in names]
    joined = a.join(b, same, how)
    return joined.drop(*[f"{c}_b" for c in names]) if how not in ("left_semi", "left_anti") else joined
