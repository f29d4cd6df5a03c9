"""The stratified evaluation set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from msgtriage.operators.limits import number_rows

EVALUATION_SIZE = 200  # fixed value


def quota_table(seeds: DataFrame | None, quotas: Mapping[str, int], default: int, spark) -> DataFrame:
    """What is left of each class's quota once the seeds are counted."""
    table = spark.createDataFrame(sorted(quotas.items()), "intent string, target int")
    if seeds is None:
        return table.select("intent", F.col("target").alias("room"))
    used = seeds.groupBy("intent").agg(F.count("*").alias("used"))
    # A class without a stated target still gets the default one.
    joined = table.join(used, "intent", "full_outer")
    return joined.select(
        "intent",
        (F.coalesce("target", F.lit(default)) - F.coalesce("used", F.lit(0))).cast("int").alias("room"),
    )


def quota_sample(
    candidates: DataFrame, seeds: DataFrame | None, quotas: Mapping[str, int], key: str,
    size: int = EVALUATION_SIZE, default_quota: int = 20, first_id: int = 1,
) -> DataFrame:
    """Per class the first rows by key within its room, then the first ``size`` overall.

    A row's acceptance depends only on its own class, so walking the corpus in
    order equals ranking within classes. The constant bound on the rank lets
    Spark drop all but a quota's worth of rows per class in each partition
    before the shuffle, however large a class is.
    """
    spark = candidates.sparkSession
    room = quota_table(seeds, quotas, default_quota, spark)
    most = max([default_quota, *quotas.values()])
    ranked = candidates.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("intent").orderBy(key))
    ).where(F.col("_rank") <= most)
    accepted = ranked.join(F.broadcast(room), "intent", "left").where(
        F.col("_rank") <= F.coalesce("room", F.lit(default_quota))
    )
    n_seeds = 0 if seeds is None else seeds.count()
    chosen = accepted.orderBy(key).limit(max(size - n_seeds, 0))
    return number_rows(chosen.drop("_rank", "room"), key, "id", first_id + n_seeds)


def topup_fill(
    items: DataFrame, size: int, text_format: str, cycle: int, constants: Mapping[str, object],
    text: str = "customer_text",
) -> DataFrame:
    """Append templated rows until there are ``size``; the template cycles by position.

    The new rows' ids go on after the largest id there is.

    Off by default in the dataset builder: filler inflates every metric.
    """
    have, last = items.agg(F.count(F.lit(1)), F.coalesce(F.max("id"), F.lit(0))).first()
    missing = max(size - have, 0)
    position = F.col("id") + F.lit(have)
    filler = items.sparkSession.range(missing).select(
        (F.col("id") + F.lit(last + 1)).alias("id"),
        F.format_string(text_format, F.pmod(position, F.lit(cycle))).alias(text),
        *[F.lit(v).alias(name) for name, v in constants.items()],
    )
    return items.select("id", text, *constants).unionByName(filler)


def breakdown_counts(items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value of each column occurs, all in one pass."""
    cols = [F.col(c).cast("string").alias(c) for c in columns]
    sets = [[F.col(c)] for c in columns]
    names = [F.col(c) for c in columns]
    counted = items.select(*cols).groupingSets(sets, *names).agg(
        F.count("*").alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    facet = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in columns])
    return counted.select(facet.alias("facet"), F.coalesce(*columns).alias("value"), "n")
