"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane.llm.common import save


def _least(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _least(down)
    return down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(m.select("u", F.col("m").alias("v"))).distinct()


def contract(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges (u, v), u > v, that join what edges (u long, v long, u <> v) joins, after so many rounds: ever more of them lead to the least node.

    Each round is written to the shared folder, so a lost executor costs at most one round. edges is read several times.
    """
    for _ in range(rounds):
        edges = save(_small_star(_large_star(edges)), "edges")
    return edges


def nearest_roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every u of edges (u, v): its least neighbour, which is of the same component but need not be its least node."""
    return _least(edges).toDF("node", "root")


def _is_done(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    of_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of_node.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u long, v long, u <> v): root is the smallest node reachable.

    Only one row a round comes to the driver. An empty edge table gives no rows.
    """
    e = save(edges.select("u", "v").where("u <> v"), "edges")
    for _ in range(most_rounds):
        e = contract(e, 1)
        if _is_done(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"no fixed point within {most_rounds} rounds")


def first_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """docs with exactly one row of each component: the smallest doc_id, then the smallest hash of the text, nulls last.

    members: (doc_id, text_hash, root) of every row, text_hash being xxhash64 of the text, an empty one for null.
    """
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    key = ["__dedup_none", "__dedup_id", "__dedup_hash"]
    kept = first.select(F.col("f.none").alias(key[0]), F.coalesce("f.doc_id", F.lit(0)).cast("long").alias(key[1]), F.col("f.text_hash").alias(key[2]))
    rows = docs.withColumns(dict(zip(key, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce("text", F.lit("")))))))
    once = rows.join(kept, key, "left_semi").withColumn("__dedup_n", F.row_number().over(Window.partitionBy(*key).orderBy(key[2])))
    return once.where("__dedup_n = 1").select(*docs.columns)
