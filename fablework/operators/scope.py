"""Graphs that share a store: elements carry ``db`` and ``kg``, dummies ``_init``.

``nodes(db, kg, element_id, ...)``; ``edges(start_node_id, rel_type, end_node_id, ...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE, EDGE = "node", "relationship"


def is_dummy(flag: str = "_init") -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def same_scope(db: str, kg: str) -> Column:
    return (F.col("db") == db) & (F.col("kg") == kg)


def without_dummies(df: DataFrame, flag: str = "_init") -> DataFrame:
    """Rows that are no placeholders; the flag goes. Frames without the flag stay as they are."""
    return df.where(~is_dummy(flag)).drop(flag) if flag in df.columns else df


def in_database(df: DataFrame, db: str, flag: str = "_init") -> DataFrame:
    return without_dummies(df.where(F.col("db") == db), flag)


def scan(nodes: DataFrame, edges: DataFrame, db: str, kg: str) -> DataFrame:
    """Elements of one graph, one a row: its nodes, and the edges that begin or end at one of them, each once."""
    own = without_dummies(nodes.where(same_scope(db, kg)))
    ids = own.select("element_id").distinct()
    at = lambda c, hit: ids.select(F.col("element_id").alias(c), F.lit(True).alias(hit))
    met = edges.join(at("start_node_id", "__s"), "start_node_id", "left").join(at("end_node_id", "__e"), "end_node_id", "left")
    met = met.where("__s or __e").select(edges.columns)
    kind = lambda d, k: d.withColumn("element_type", F.lit(k))
    return kind(own, NODE).unionByName(kind(met, EDGE), allowMissingColumns=True).distinct()


def preview(nodes: DataFrame, edges: DataFrame, db: str, kg: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` edges inside one graph, ordered by their ends and type, with the names of both ends.

    Only the rows of a top-k leave each task. Edges with an end outside the graph or at a dummy are left out.
    """
    own = without_dummies(nodes.where(same_scope(db, kg))).select("element_id", "name")
    at = lambda c: own.select(F.col("element_id").alias(f"{c}_node_id"), F.col("name").alias(f"{c}_name"))
    met = edges.join(at("start"), "start_node_id").join(at("end"), "end_node_id")
    order = ["start_node_id", "rel_type", "end_node_id", "start_name", "end_name"]
    return met.select(order).orderBy(*order).limit(limit)


def split(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a scan, without the columns that say what and where an element is."""
    of = lambda k: elements.where(F.col("element_type") == k).drop("element_type", "db", "kg")
    return of(NODE), of(EDGE)


def retag(df: DataFrame, db: str) -> DataFrame:
    """Elements without a database belong to ``db``."""
    return df.withColumn("db", F.coalesce("db", F.lit(db)))


def drop_graph(df: DataFrame, db: str, kg: str) -> DataFrame:
    return df.where(~F.coalesce(same_scope(db, kg), F.lit(False)))


def graph_exists(nodes: DataFrame, kg: str) -> bool:
    """Whether any database has nodes of the graph."""
    return not nodes.where(F.col("kg") == kg).isEmpty()


def fetch(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Elements with the given ``element_id``, as they are now: one struct column ``element``, missing fields null."""
    every = nodes.unionByName(edges, allowMissingColumns=True)
    return every.join(ids.select("element_id").distinct(), "element_id", "left_semi").select(F.struct(*every.columns).alias("element"))


def value_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Nodes of two graphs whose properties agree: (left_id, right_id)."""
    a = left.select(F.col("element_id").alias("left_id"), F.col(left_col).alias("__v"))
    return a.join(right.select(F.col("element_id").alias("right_id"), F.col(right_col).alias("__v")), "__v").select("left_id", "right_id")
