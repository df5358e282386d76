"""Near-duplicate vectors, by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.shared import components, written


@dataclass(frozen=True)
class Settings:
    """``cosine``: least similarity of a link. ``recall``: of a pair at just that similarity,
    reached by the tables together. ``cell``: rows that a cell of a table should hold.
    ``block``: rows that are compared in one group; larger cells are cut along their sorted projection.
    ``projections``: whose collisions are counted. ``width``: half a window, in standard
    deviations of the difference of a pair at the least similarity."""

    cosine: float = 0.95
    recall: float = 0.97
    cell: int = 1024
    block: int = 6000
    projections: int = 16
    width: float = 2.0
    seed: int = 20

    @property
    def window(self) -> float:
        return self.width * math.sqrt(2 - 2 * self.cosine) + 1e-5

    @property
    def enough(self) -> int:
        """The largest count that a pair at the least similarity reaches with a probability of 0.99."""
        hit = math.erf(self.width / math.sqrt(2))
        n, tail = self.projections, 0.0
        for k in range(n, -1, -1):
            tail += math.comb(n, k) * hit**k * (1 - hit) ** (n - k)
            if tail >= 0.99:
                return k
        return 0

    def tables(self, rows: int) -> tuple[int, int]:
        """Sign bits of a cell, and tables, for so many rows."""
        bits = max(0, math.ceil(math.log2(max(1, rows) / self.cell)))
        same = 1 - math.acos(self.cosine) / math.pi
        one = same**bits * math.erf(self.width / math.sqrt(2)) * 0.99
        return bits, max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - one)))


@dataclass(frozen=True)
class _Directions:
    """The random directions of a dimension: they depend on the settings alone."""

    signs: np.ndarray
    sorts: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, dimension: int, bits: int, tables: int, s: Settings) -> _Directions:
        made = np.random.default_rng([s.seed, dimension]).standard_normal((dimension, tables * (bits + 1) + s.projections))
        return cls(made[:, : tables * bits], made[:, tables * bits : tables * (bits + 1)], made[:, tables * (bits + 1) :])

    def cells(self, unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
        on = (_project(unit, self.signs) > 0).reshape(len(unit), tables, bits)
        return on @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(unit), tables), np.int64)


def _project(unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The vectors along each direction, by sums that are the same for a vector in whatever company, which a matrix product doesn't promise."""
    across = np.ascontiguousarray(directions.T)[None]
    parts = [(unit[k : k + 256, None, :] * across).sum(axis=2) for k in range(0, len(unit), 256)]
    return np.concatenate(parts) if parts else np.empty((0, directions.shape[1]))


def _units(vectors: pd.Series) -> np.ndarray:
    """The vectors in double precision, scaled to length 1."""
    raw = np.stack(vectors.to_numpy()).astype(np.float64)
    # scaled first, so that squares of very large or small components stay finite
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _links(group: pd.DataFrame, table: int, bits: int, tables: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the linked pairs that this table and group are the first to find."""
    unit = _units(group["vec"])
    d = _Directions.of(unit.shape[1], bits, tables, s)
    sorts = _project(unit, d.sorts)
    order = np.argsort(sorts[:, table], kind="stable")
    unit, sorts = unit[order], sorts[order]
    cells = d.cells(unit, bits, tables)
    counts = _project(unit, d.counts).astype(np.float32)
    block = group["block"].to_numpy()[order]
    two = (group["low"] != group["high"]).to_numpy()[0] if len(group) else False
    line, n, w = sorts[:, table], len(unit), np.float32(s.window)
    until = np.searchsorted(line, line + s.window, side="right")
    found_a, found_b = [], []
    for start in range(0, n, 256):
        end = min(n, start + 256)
        last = until[end - 1]
        ahead = np.arange(start, last)
        hits = np.zeros((end - start, len(ahead)), np.uint8)
        for p in range(s.projections):
            hits += np.abs(counts[start:end, p, None] - counts[None, start:last, p]) <= w
        rows = np.arange(start, end)
        ok = (hits >= s.enough) & (ahead[None, :] > rows[:, None]) & (ahead[None, :] < until[rows][:, None])
        if two:
            ok &= block[rows][:, None] != block[ahead][None, :]
        i, j = np.nonzero(ok)
        i, j = i + start, j + start
        for at in range(0, len(i), 200_000):
            a, b = i[at : at + 200_000], j[at : at + 200_000]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= s.cosine
            a, b = a[near], b[near]
            if table:
                before = ((cells[a, :table] == cells[b, :table]) & (np.abs(sorts[a, :table] - sorts[b, :table]) <= s.window)).any(axis=1)
                a, b = a[~before], b[~before]
            found_a.append(a)
            found_b.append(b)
    a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.empty(0, np.int64)
    return order[a], order[b]


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``df``.

    Equal vectors are one class, linked to each other. Classes are sorted along one projection in
    each table, each looks at the window centred on it, the collisions in windows of
    further projections are counted for each pair there, and pairs with enough of them, as many as
    a pair at just the least similarity reaches with a probability of 0.99, are verified by their
    cosine in double precision. One projection alone leaves a third of all pairs in a window, so a
    table sorts within cells of signs of further projections; the number of signs follows the row count,
    so that cells keep their size, and the number of tables follows from the recall that the
    settings name, computed for a pair at just the least similarity (closer ones are found more
    surely). A pair is counted by the first table that finds it. No pair leaves its group: a group
    gives, per class, the number of links and one edge to its local root.

    A vector travels once per table, as it is stored. Cells over ``block`` rows are cut along their sorted
    projection into blocks, by counts of narrow bins that are aggregated before the shuffle, and
    only blocks with rows in one window are compared; a bin that is too full by itself is dealt by
    hash. So no task gets more than two blocks.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Vectors of different lengths are not compared. Rows with a null id count as links and get
    the component of their vector. An empty table gives an empty table.
    """
    s = settings
    given = F.col(f"`{embedding}`")
    vec = given if dict(df.dtypes)[embedding] == "array<float>" else given.cast("array<double>")
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(fine, vec).alias("vec")).withColumn("same", F.md5(F.col("vec").cast("string")))
    classes = rows.filter("same IS NOT NULL").groupBy("same", "vec").agg(F.min("vec_id").alias("lead"), F.count(F.lit(1)).alias("n"))
    classes, _ = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits, tables = s.tables(classes.count())
    place = "dim int, tab int, cell bigint, bin int"
    cell_keys, step = ["dim", "tab", "cell"], s.window / 8

    def cells(whole: bool):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for dimension, part in b.groupby(b["vec"].map(len)):
                    unit = _units(part["vec"])
                    d = _Directions.of(dimension, bits, tables, s)
                    own, bins = d.cells(unit, bits, tables), np.floor(_project(unit, d.sorts) / step).astype(np.int32)
                    for t in range(tables):
                        out = {"dim": dimension, "tab": t, "cell": own[:, t], "bin": bins[:, t]}
                        yield pd.DataFrame(out | {c: part[c].to_numpy() for c in ("cid", "n", "vec")} if whole else out)

        return of

    counts = classes.select("vec").mapInPandas(cells(False), place).groupBy(*cell_keys, "bin").agg(F.count(F.lit(1)).alias("rows"))
    by_cell = Window.partitionBy(*cell_keys)
    before = F.coalesce(F.sum("rows").over(by_cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = counts.withColumns({"total": F.sum("rows").over(by_cell), "part": F.floor(before / (s.block // 2)).cast("long")}).filter(F.col("total") > s.block)
    large, _ = written(large.select(*cell_keys, "bin", "rows", "part"), "bins")
    dealt = classes.select("cid", "n", "vec").mapInPandas(cells(True), f"{place}, cid bigint, n bigint, vec {classes.schema['vec'].dataType.simpleString()}")
    if large.isEmpty():
        paired = dealt.withColumns({c: F.lit(0).cast("long") for c in ("block", "low", "high")})
    else:
        parts = large.groupBy(*cell_keys, "part").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.sum("rows").alias("rows"))
        parts = parts.withColumn("subs", F.when(F.col("rows") > s.block, F.ceil(F.col("rows") / (s.block // 2))).otherwise(1))
        # at most some hundred parts of a cell have rows, as bins are an eighth of a window wide
        other = parts.select(*cell_keys, F.col("first").alias("_first"), F.col("last").alias("_last"), F.struct("part", "subs").alias("_other"))
        near = parts.join(other, cell_keys).filter("_first - last <= 9 AND first - _last <= 9").groupBy(*cell_keys, "part").agg(F.first("subs").alias("subs"), F.collect_list("_other").alias("others"))
        known, _ = written(large.select(*cell_keys, "bin", "part").join(near, [*cell_keys, "part"]), "parts")
        placed = dealt.join(known, [*cell_keys, "bin"], "left")
        code = lambda part, sub: part * (1 << 32) + sub
        placed = placed.withColumn("block", F.coalesce(code(F.col("part"), F.pmod(F.xxhash64("cid"), F.col("subs"))), F.lit(0)))
        blocks = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["subs"] - 1), lambda k: code(o["part"], k))))
        paired = placed.withColumn("_other", F.explode(F.coalesce(blocks, F.array(F.lit(0).cast("long")))))
        paired = paired.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")})

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = _links(group, int(key[1]), bits, tables, s)
        n, size = group["n"].to_numpy(), len(group)
        links = np.bincount(a, n[b], size) + np.bincount(b, n[a], size)
        root = np.arange(size)
        while len(a):
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        used = links > 0
        cid = group["cid"].to_numpy()
        return pd.DataFrame({"cid": cid[used], "links": links[used].astype(np.int64), "root": cid[root[used]]})

    found, _ = written(paired.select(*cell_keys, "low", "high", "block", "cid", "n", "vec").groupBy(*cell_keys, "low", "high").applyInPandas(compare, "cid bigint, links bigint, root bigint"), "links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    linked = classes.join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(roots, "cid", "left")
    linked = linked.select("same", "lead", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    least = linked.groupBy("root").agg(F.min("lead").alias("least"))
    per_class = linked.join(least, "root").select("same", (F.col("links") + F.col("n") - 1).alias("links"), "least")
    out = rows.select("vec_id", "same").join(per_class, "same", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
