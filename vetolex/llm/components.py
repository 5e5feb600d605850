"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


#: Edges up to which a round is one task's work: its shuffles would cost far more than its rows.
FEW_EDGES = 100_000


def _pairs(rows: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """``(a, b)``: the named pairs of columns of each row, in the row's own partition (a union would add partitions)."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in columns])).alias("e")).select("e.a", "e.b")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool, few: bool = False) -> DataFrame:
    """Hang each node's larger (or else its smaller) neighbours on its smallest one.

    The minimum is pre-aggregated per task; the join back is on the node, whose hot values Spark
    may split, since only the smallest neighbour is on the other side.  ``few`` edges lie in one partition and stay there."""
    if large:
        near = _pairs(edges, ("a", "b"), ("b", "a"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    met = near.join(F.broadcast(low) if few else low, near["a"] == low["u"])
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = _pairs(met, ("b", "m"), ("a", "m"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges`` (columns ``a`` and ``b``); the label is the smallest node.

    Rounds end when the edges are stars that no step changes, after about log(nodes) rounds.
    Loops are ignored.  Each round's edges are written to the shared folder; few edges are one task's work."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _state(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        few = mark[0] <= FEW_EDGES
        near = now.coalesce(1) if few else now
        now = stash(_star(_star(near, True, few), False, few), "edges")
        seen, mark = mark, _state(now)
        if seen == mark:
            break
    else:
        raise ValueError(f"components: not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
