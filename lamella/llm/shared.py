"""What several corpus operators need: tables in the shared folder, and connected components."""

from __future__ import annotations

import ctypes
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.sources.scratch import delete_path, new_path, scratch_scope, shared_folder, small_batches, written

__all__ = ["claim", "components", "delete_path", "fewer", "fresh", "give_back", "new_path", "others", "scratch_scope", "shared_folder", "small_batches", "written"]

_STORES: list[dict] = []


def claim(store: dict) -> dict:
    """``store``, one worker's memory of what it has encoded; the stores of other operators, which ran in the worker before, are emptied."""
    if not any(s is store for s in _STORES):
        _STORES.append(store)
    others = [s for s in _STORES if s is not store and s]
    for other in others:
        other.clear()
    if others:
        give_back()
    return store


def give_back() -> None:
    """Returns to the system what a reused worker's allocators hold but don't use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``df`` has no column of, in upper or lower case."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *names: str) -> list[str]:
    """``df``'s columns but those that ``names``, in upper or lower case, would repeat."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def fewer(df: DataFrame, rows: int, per_task: int = 200_000) -> DataFrame:
    """``df`` in a number of tasks that follows its known row count, without another shuffle."""
    return df.coalesce(max(8, rows // per_task))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph in columns ``a`` and ``b``.

    Returns ``node`` and ``root`` (the smallest node of its component) for each node that has an
    edge to another. Self loops and nulls are ignored; repeated edges are allowed; an empty
    table gives an empty table.

    Each round lets every node point at its smallest neighbour, follows the pointers to their
    ends by doubling, and contracts the edges to what those ends still link. A round removes
    every node that has a smaller neighbour, so few rounds are needed. All steps are joins and
    minima over columns; no group is collected, and what a round leaves is written to the shared
    folder.
    """
    spark = edges.sparkSession
    schema = edges.select("a", "b").schema
    left, path = written(edges.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while n := left.count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, up_path = written(fewer(both.groupBy("a").agg(F.min("b").alias("p")).selectExpr("a", "least(a, p) AS p"), n), "parents")
        while True:
            over = up.selectExpr("a AS p", "p AS q")
            jumped = up.join(over, "p").selectExpr("a", "q AS p", "q <> p AS moved")
            jumped, jumped_path = written(fewer(jumped, n), "parents")
            moved = not jumped.filter("moved").isEmpty()
            delete_path(spark, up_path)
            up, up_path = jumped.select("a", "p"), jumped_path
            if not moved:
                break
        rounds.append(up)
        ends = left.join(up.selectExpr("a", "p AS x"), "a").join(up.selectExpr("a AS b", "p AS y"), "b")
        rest = ends.filter("x <> y").selectExpr("least(x, y) AS a", "greatest(x, y) AS b").distinct()
        left, next_path = written(fewer(rest, n), "edges")
        delete_path(spark, path)
        path = next_path
    if not rounds:
        return spark.createDataFrame([], schema).selectExpr("a AS node", "b AS root")

    def follow(found: DataFrame, up: DataFrame) -> DataFrame:
        onward = up.selectExpr("a AS root", "p AS onward")
        return found.join(onward, "root", "left").selectExpr("node", "coalesce(onward, root) AS root")

    return reduce(follow, rounds[1:], rounds[0].selectExpr("a AS node", "p AS root"))
