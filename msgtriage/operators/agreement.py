"""Agreement of two ordinal raters per dimension (K1-K7), all from one count table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

A, B = "rater_a", "rater_b"


def rating_counts(ratings: DataFrame, dimension: str = "dimension") -> DataFrame:
    """Rows per (dimension, a, b); at most scale x scale rows per dimension."""
    rated = ratings.where(F.col(A).isNotNull() & F.col(B).isNotNull())
    return rated.groupBy(F.col(dimension).alias("dimension"), A, B).agg(F.count("*").alias("n"))


def agreement_rates(counts: DataFrame) -> DataFrame:
    """K1, K2, K5: exact and adjacent agreement in percent, and the mean of b - a."""
    n, gap = F.col("n"), F.col(B) - F.col(A)

    def percent(test) -> object:
        return 100.0 * F.sum(F.when(test, n).otherwise(0)) / F.sum(n)

    return counts.groupBy("dimension").agg(
        percent(gap == 0).alias("exact_agreement_pct"),
        percent(F.abs(gap) <= 1).alias("adjacent_agreement_pct"),
        (F.sum(gap * n) / F.sum(n)).alias("mean_bias"),
        F.sum(n).alias("sample_size"),
    )


def weighted_kappa(counts: DataFrame) -> DataFrame:
    """K3: quadratic-weighted kappa; null if only one rating was ever given.

    The weights use the position of a rating among those observed. The expected
    disagreement is, with r and c the marginal positions, the sum over all cells
    of (i - j)^2 r_i c_j / n, which expands to sums over the marginals alone:
    sum r i^2 + sum c j^2 - 2 (sum r i)(sum c j) / n. No cell product is built.
    """
    scale = counts.select(
        "dimension", F.explode(F.array(A, B)).alias("rating")
    ).distinct().withColumn(
        "position", F.dense_rank().over(Window.partitionBy("dimension").orderBy("rating"))
    )
    placed = counts.join(
        scale.select("dimension", F.col("rating").alias(A), F.col("position").alias("i")), ["dimension", A]
    ).join(
        scale.select("dimension", F.col("rating").alias(B), F.col("position").alias("j")), ["dimension", B]
    )
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    sums = placed.groupBy("dimension").agg(
        F.sum(n).alias("total"), F.sum(n * (i - j) * (i - j)).alias("observed"),
        F.sum(n * i).alias("si"), F.sum(n * j).alias("sj"),
        F.sum(n * i * i).alias("sii"), F.sum(n * j * j).alias("sjj"),
    )
    expected = F.col("sii") + F.col("sjj") - 2.0 * F.col("si") * F.col("sj") / F.col("total")
    return sums.select(
        "dimension", (1.0 - F.col("observed") / F.nullif(expected, F.lit(0.0))).alias("kappa")
    )


def rater_pearson(counts: DataFrame) -> DataFrame:
    """K4: correlation of the two raters, weighted by the counts; null for a constant rater.

    Ratings are whole numbers, so all sums are, and the differences of their products are exact in
    decimals: a spread is zero for a constant rater only, however rare the other ratings are.
    """
    n, a, b = F.col("n"), F.col(A), F.col(B)
    sums = {"n": n, "a": n * a, "b": n * b, "aa": n * a * a, "bb": n * b * b, "ab": n * a * b}
    exact = counts.groupBy("dimension").agg(*[F.sum(v).cast("decimal(38,0)").alias(k) for k, v in sums.items()])
    spread_a, spread_b, common = (
        F.col("n") * F.col(x + y) - F.col(x) * F.col(y) for x, y in (("a", "a"), ("b", "b"), ("a", "b")))
    r = common.cast("double") / (F.sqrt(spread_a.cast("double")) * F.sqrt(spread_b.cast("double")))
    return exact.select("dimension", F.when((spread_a != 0) & (spread_b != 0), r).alias("pearson_r"))


def agreement(ratings: DataFrame, dimension: str = "dimension") -> DataFrame:
    """K1-K5 side by side, to the reported precision."""
    counts = rating_counts(ratings, dimension)
    joined = agreement_rates(counts).join(weighted_kappa(counts), "dimension").join(
        rater_pearson(counts), "dimension"
    )
    return joined.select(
        "dimension",
        F.round("exact_agreement_pct", 2).alias("exact_agreement_pct"),
        F.round("adjacent_agreement_pct", 2).alias("adjacent_agreement_pct"),
        F.round("kappa", 4).alias("kappa"), F.round("pearson_r", 4).alias("pearson_r"),
        F.round("mean_bias", 4).alias("mean_bias"), "sample_size",
    )


def agreement_macro(per_dimension: DataFrame) -> DataFrame:
    """K6: means over the dimensions of the already rounded values."""
    return per_dimension.agg(
        F.round(F.avg("kappa"), 4).alias("mean_kappa"),
        F.round(F.avg("exact_agreement_pct"), 2).alias("mean_exact_agreement_pct"),
        F.round(F.avg("adjacent_agreement_pct"), 2).alias("mean_adjacent_agreement_pct"),
    )
