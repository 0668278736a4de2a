"""One ranking from scores on unlike scales: robust z, logistic bound, weighted geometric mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.runtime import real_number, staged

#: A list with no spread says nothing about its items' order: they get the middle of the bounded range.
FLOOR, CEIL = 0.02, 0.98


def _median(c: str):
    """Median of a group: the mean of the two middle values, exact for groups of up to 10,000 rows."""
    p = F.percentile_approx(c, [0.5, 0.5 + 1e-9], 10_000)
    return (p[0] + p[1]) / 2


def bounded_scores(results: DataFrame) -> DataFrame:
    """(query_id, source, entity_id, u, n_list): each retriever's bounded score of each item.

    Scores are standardised within (query, source, confidence_method) by median and 1.4826 x median absolute
    deviation and squashed by the logistic function. Repeated deliveries and repeats in a list count once, with
    the best score; null, NaN and infinite scores are no scores. A spread of zero gives 0.5 to all. However far out a
    score is, the logistic function leaves it at FLOOR or CEIL.
    """
    keys = ["query_id", "source", "confidence_method"]
    items = (
        results.select("query_id", *[F.coalesce(k, F.lit("")).alias(k) for k in keys[1:]], "entity_id", real_number("score").alias("s"))
        .where("s IS NOT NULL AND query_id IS NOT NULL AND entity_id IS NOT NULL")
        .groupBy(*keys, "entity_id").agg(F.max("s").alias("s"))
    )
    # medians are mergeable sketches joined back, so a query with most of the rows is no single task
    med = items.groupBy(*keys).agg(_median("s").alias("med"), F.count("*").alias("n"))
    dev = items.join(med, keys).withColumn("d", F.abs(F.col("s") - F.col("med")))
    mad = dev.join(dev.groupBy(*keys).agg((1.4826 * _median("d")).alias("mad")), keys)
    z = F.when(F.col("mad") > 0, (F.col("s") - F.col("med")) / F.col("mad")).otherwise(F.lit(0.0))
    u = F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(FLOOR)), F.lit(CEIL))
    return mad.withColumn("u", u).groupBy("query_id", "source", "entity_id").agg(F.max("u").alias("u"), F.max("n").alias("n_list"))


def fused_ranking(results: DataFrame, missing: float = 0.3, least_weight: float = 0.1, first: int | None = None) -> DataFrame:
    """(query_id, entity_id, fused, n_sources, rank): weighted geometric mean over the query's retrievers.

    A retriever that lists an item not at all contributes ``missing``. A retriever's weight within a query is the
    correlation of its bounded scores with the mean of the other retrievers' on the query's items, at least
    ``least_weight``; so a list of little use counts little and none can decide by its range. Equal fused scores
    are ranked by entity_id. With ``first``, only so many of each query are returned, and the others are cut before
    they are shuffled.
    """
    u = staged(bounded_scores(results), "bounded")
    grid = u.select("query_id", "entity_id").distinct().join(u.select("query_id", "source").distinct(), "query_id")
    full = grid.join(u, ["query_id", "entity_id", "source"], "left").withColumn("listed", F.col("u").isNotNull()).fillna({"u": missing})
    wi = Window.partitionBy("query_id", "entity_id")
    full = full.withColumn("n", F.count("*").over(wi)).withColumn("lu", F.log("u"))
    full = full.withColumn("others", F.when(F.col("n") > 1, (F.sum("lu").over(wi) - F.col("lu")) / (F.col("n") - 1)))
    agree = full.groupBy("query_id", "source").agg(F.corr("lu", "others").alias("r"), F.sum(F.col("listed").cast("int")).alias("len"))
    weight = F.greatest(F.coalesce(F.nanvl(F.col("r"), F.lit(None)), F.lit(0.0)), F.lit(least_weight))
    full = full.join(agree.select("query_id", "source", weight.alias("w")), ["query_id", "source"])
    fused = full.groupBy("query_id", "entity_id").agg(
        F.exp(F.sum(F.col("w") * F.col("lu")) / F.sum("w")).alias("fused"), F.sum(F.col("listed").cast("int")).alias("n_sources")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "entity_id")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= first) if first is not None else ranked


def best_supported(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, entity_id): the first n_wanted of the fused ranking, entities and canonicals only.

    Queries without results, or with n_wanted null or below one, give no rows.
    """
    wanted = queries.groupBy("query_id").agg(F.max("n_wanted").alias("n_wanted"))
    most = wanted.agg(F.max("n_wanted")).first()[0] or 0
    ranked = fused_ranking(results.where(F.col("result_type").isin("Entity", "Canonical")), first=int(most))
    return ranked.join(wanted, "query_id").where(F.col("rank") <= F.col("n_wanted")).select("query_id", "entity_id")
