"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id of the edges (a, b); component is the smallest id reachable.

    In each round a vertex points to the smallest of its neighbours and itself,
    pointers are followed to their ends, and edges are drawn anew between
    those ends, once each. So edges inside what hangs together by then are gone
    after their first round, and later rounds work on what is left. Tables are
    written to the shared folder after each step. Edges with a null end are
    ignored.
    """
    one = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    one = common.staged(one.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    known = None
    while True:
        both = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = common.staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), name)
        moved = True
        while moved:
            further = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
            new = common.staged(labels.select("id", "label").join(further, "label").select("id", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), name)
            common.drop(labels)  # the new labels are written whole
            labels, moved = new, not new.where("moved").isEmpty()
        ends = labels.select("id", "label")
        if known is None:
            known = ends
        else:
            known = common.staged(known.join(ends.toDF("label", "end"), "label", "left").select("id", F.coalesce("end", "label").alias("label")), name)
        rest = one.where("a <> b").join(ends.toDF("a", "la"), "a").join(ends.toDF("b", "lb"), "b").where("la <> lb")
        rest = common.staged(rest.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct(), f"{name}-edges")
        if rest.isEmpty():
            return known.withColumnRenamed("label", "component")
        one = rest
