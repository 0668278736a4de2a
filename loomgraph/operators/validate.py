"""Rule checks that split rows into valid ones and errors with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.runtime import cut
from loomgraph.schema import ACTIONS, EDGE_TYPES, NODE_TYPES


def _when(cond: Column, reason: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(True)), F.lit(reason))


def _reasons(*cols: Column) -> Column:
    return F.filter(F.array(*cols), lambda x: x.isNotNull())


def _empty(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def common_reasons() -> list[Column]:
    c = F.col("confidence")
    return [
        _when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1), "confidence outside [0, 1]"),
        _when(_empty("extraction_source"), "missing extraction_source"), _when(_empty("extraction_method"), "missing extraction_method"),
    ]


def check_entities(entities: DataFrame, order: str = "ord") -> DataFrame:
    """Add reasons. Of rows with the same id that are right otherwise, all but the first are duplicates.

    A row whose id is missing is never a duplicate, nor does a wrong row make a later one a duplicate.
    """
    base = entities.withColumn("reasons", _reasons(_when(_empty("id"), "missing id"), _when(_empty("name"), "missing name"), _when(~F.col("type").isin(*NODE_TYPES), "unknown type"), *common_reasons()))
    right = F.size("reasons") == 0
    first = F.min(F.when(right, F.col(order))).over(Window.partitionBy("id"))
    dup = ~_empty("id") & (F.col(order) > first)
    return base.withColumn("reasons", F.concat("reasons", F.when(dup, F.array(F.lit("duplicate id"))).otherwise(F.array().cast("array<string>"))))


def split_checked(checked: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, (item_id, reason) errors)."""
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.select(F.col(item).alias("item_id"), F.explode("reasons").alias("reason"))


def check_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, expected: str | None = None, existing: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Add reasons: type, ends that are not among the known ids, self-loop, duplicate (also of ``existing`` edges)."""
    targets = sources if targets is None else targets
    s = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")).distinct()
    t = targets.select(F.col("id").alias("target_id"), F.lit(True).alias("_t")).distinct()
    e = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    wrong = (F.col("type") != expected) if expected else ~F.col("type").isin(*EDGE_TYPES)
    e = e.withColumn("reasons", _reasons(
        _when(wrong, "wrong type" if expected else "unknown type"), _when(F.col("_s").isNull(), "orphan source"), _when(F.col("_t").isNull(), "orphan target"),
        _when(F.col("source_id") == F.col("target_id"), "self-loop"), *common_reasons(),
    ))
    key = ["source_id", "type", "target_id"]
    first = F.min(F.when(F.size("reasons") == 0, F.col(order))).over(Window.partitionBy(*key))
    dup = F.col(order) > first
    if existing is not None:
        e = e.join(existing.select(*key, F.lit(True).alias("_x")).distinct(), key, "left")
        dup = dup | F.col("_x").isNotNull()
    dup = F.coalesce(dup, F.lit(False))
    e = e.withColumn("reasons", F.concat("reasons", F.when(dup, F.array(F.lit("duplicate edge"))).otherwise(F.array().cast("array<string>"))))
    return e.drop("_s", "_t", "_x")


def check_graph(entities: DataFrame, edges: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid entities, valid edges, errors); edges are held against valid entities only."""
    good, bad = split_checked(check_entities(entities, order), "id")
    good_e, bad_e = split_checked(check_edges(edges, good, order=order).withColumn("_k", F.concat_ws("->", "source_id", "target_id")), "_k")
    return good, good_e.drop("_k"), bad.unionByName(bad_e)


def check_decisions(decisions: DataFrame, known: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Add reasons to decisions. Row rules first; then, among rows right so far, repeated canonical ids and overlaps.

    Overlap is sequential: a cluster is wrong if a member is in an earlier cluster that stands. Clusters that share
    no member with any other are settled by one aggregation; the rest in rounds, where every cluster that is the
    first at all its members stands and those that it touches fall, so a round settles many clusters at once.
    """
    d = decisions
    ids = F.coalesce("source_ids", F.array().cast("array<string>"))
    none = F.col("action") == "NONE"
    rules = [
        _when(~F.col("action").isin(*ACTIONS), "unknown action"), _when(~F.col("entity_type").isin(*NODE_TYPES), "unknown type"),
        _when(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence outside [0, 1]"),
        _when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated member"),
        F.when(~none, _when(_empty("canonical_id") | F.contains("canonical_id", F.lit("__")), "canonical id missing or namespaced")),
        F.when(~none, _when(_empty("canonical_name"), "missing canonical name")), F.when(~none, _when(F.size(ids) < 2, "fewer than two members")),
    ]
    if known is not None:
        members = d.select(order, F.explode(ids).alias("id")).join(known.select("id").distinct(), "id", "left_anti").select(order).distinct().withColumn("_o", F.lit(True))
        d = d.join(members, order, "left")
        rules.append(F.when(F.col("_o"), F.lit("orphan member")))
    d = d.withColumn("reasons", _reasons(*rules)).drop("_o")
    right = (F.size("reasons") == 0) & (F.col("action") != "NONE")
    first = F.min(F.when(right, F.col(order))).over(Window.partitionBy("canonical_id"))
    d = cut(d.withColumn("reasons", F.when(right & (F.col(order) > first), F.array(F.lit("duplicate canonical id"))).otherwise(F.col("reasons"))))
    open_rows = d.where((F.size("reasons") == 0) & (F.col("action") != "NONE")).select(order, F.explode(F.array_distinct("source_ids")).alias("id"))
    shared = open_rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    claims = cut(open_rows.join(shared, "id"))
    fallen = None
    while not claims.isEmpty():
        head = claims.groupBy("id").agg(F.min(order).alias("m"))
        c = claims.join(head, "id")
        stand = c.groupBy(order).agg(F.bool_and(F.col(order) == F.col("m")).alias("ok")).where("ok").select(order)
        taken = claims.join(stand, order).select("id").distinct()
        lost = cut(claims.join(taken, "id").join(stand, order, "left_anti").select(order).distinct())
        fallen = lost if fallen is None else fallen.unionByName(lost)
        claims = cut(claims.join(stand, order, "left_anti").join(lost, order, "left_anti"))
    if fallen is None:
        return d
    d = d.join(fallen.distinct().withColumn("_f", F.lit(True)), order, "left")
    return d.withColumn("reasons", F.when(F.col("_f"), F.concat("reasons", F.array(F.lit("overlapping cluster")))).otherwise(F.col("reasons"))).drop("_f")
