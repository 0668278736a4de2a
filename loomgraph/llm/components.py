"""Groups from pairwise matches: deterministic Boruvka hooking with pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import cut, drop_staged, real_number


def accepted_edges(pairs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Undirected edges (u < v) of the pairs with a score of at least ``threshold``.

    Ids are trimmed of white space; null and blank ids, pairs of a record with itself, null, NaN and infinite
    scores are no pairs. Either order and repeats give one edge. Other columns are ignored.
    """
    space = r"^[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+|[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+$"
    a, b = (F.nullif(F.regexp_replace(F.col(c), space, ""), F.lit("")) for c in ("id_a", "id_b"))
    ok = pairs.where(real_number("score") >= threshold).select(a.alias("a"), b.alias("b")).where("a <> b")
    return ok.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _collapse(parent: DataFrame) -> DataFrame:
    """Pointer doubling of (c, p) until every p is a root; depth d takes log2(d) steps."""
    parent = cut(parent)
    while True:
        up = parent.select(F.col("c").alias("p"), F.col("p").alias("gp"))
        both = parent.join(up, "p", "left")
        nxt = cut(both.select("c", F.coalesce("gp", "p").alias("p"), (F.coalesce("gp", "p") != F.col("p")).alias("moved")), parent)
        if nxt.where("moved").isEmpty():
            return nxt
        parent = nxt


def boruvka_groups(edges: DataFrame) -> DataFrame:
    """(id, group_id) for every vertex of ``edges`` (u, v); group_id is the smallest id of the component.

    Each round every component picks its smallest outgoing edge (a total order on edges, so hooking makes trees
    with one mutual pair each), the trees collapse by pointer doubling, the edges are relabelled, loops dropped
    and repeats removed. At least half the components vanish per round. All steps are joins and map-side
    combined aggregates; nothing is gathered per group. No edges: no rows.
    """
    edges = cut(edges.select("u", "v"))
    label = cut(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("c")))
    while not edges.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o")), F.struct(F.col("v").alias("c"), F.col("u").alias("o")))).alias("x")
        # the smallest edge of c in the order of (smaller end, larger end)
        key = F.struct(F.least("x.c", "x.o"), F.greatest("x.c", "x.o"))
        hook = cut(edges.select(ends).groupBy("x.c").agg(F.min_by("x.o", key).alias("p")))
        # of two components that picked each other the smaller becomes the root
        back = hook.select(F.col("c").alias("p"), F.col("p").alias("gp"))
        rooted = hook.join(back, "p").select("c", F.when((F.col("gp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        parent = _collapse(rooted)
        drop_staged(hook)
        label = cut(label.join(parent.select("c", "p"), "c", "left").select("id", F.coalesce("p", "c").alias("c")), label)
        pu, pv = parent.select(F.col("c").alias("u"), F.col("p").alias("ru")), parent.select(F.col("c").alias("v"), F.col("p").alias("rv"))
        lifted = edges.join(pu, "u").join(pv, "v").where("ru <> rv")
        edges = cut(lifted.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), edges)
        drop_staged(parent)
    smallest = label.groupBy("c").agg(F.min("id").alias("group_id"))
    return label.join(smallest, "c").select("id", "group_id")


def consolidate(pairs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Group id for every record of an accepted pair; see :func:`accepted_edges` and :func:`boruvka_groups`."""
    return boruvka_groups(accepted_edges(pairs, threshold))
