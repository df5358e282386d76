"""Packing documents into fixed-length training sequences by vector best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.shared import fresh, others, written
from lamella.llm.wordbpe import whole_text

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold. ``attention`` bounds the sum of squared lengths (the cost of
    attention within documents); ``documents`` bounds the number of pieces. Left at None, both
    are as large as ``tokens`` allows anyway, so that they only weigh in the choice of a bin."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


def plan(counts: dict[int, int], capacity: Capacity, score: str = "dot", weights: tuple[float, float, float] = (1.0, 0.05, 0.2)) -> dict[str, np.ndarray]:
    """Vector best-fit decreasing over a histogram of piece lengths.

    Pieces of one length are alike (tokens, 1 document, tokens squared), and so are bins filled
    alike; both are handled as classes with a multiplicity, which makes the cost depend on the
    number of distinct lengths and not on the number of pieces. Lengths go from long to short.
    Each step looks at every open class of bins whose residuals hold the piece in all three
    dimensions, takes the best by score, and fills as many of its bins as there are pieces.

    ``score``: "dot" takes the smallest weighted dot-product of the bin's residual with the
    piece (both as fractions of capacity): the tightest bin, seen along the piece's direction.
    "norm" takes the smallest weighted norm of what would be left of the residual.

    Returns runs, one row each, ordered by length and first rank: the pieces of ``length`` with
    ranks from ``rank`` on go, ``per_bin`` to a sequence, to sequences from ``sequence`` on, at
    ``offset`` and following places. The number of runs depends on the capacity and lengths
    alone (at most lengths x classes of bins), so it is bounded however many pieces there are.
    """
    whole, weight = capacity.vector(), np.array(weights)
    residual = np.empty((1024, 3), dtype=np.int64)
    bins, first = np.empty(1024, dtype=np.int64), np.empty(1024, dtype=np.int64)
    classes = sequences = 0
    runs: list[tuple[int, int, int, int, int]] = []

    def open_class(left: np.ndarray, n: int, at: int) -> None:
        nonlocal residual, bins, first, classes
        if classes == len(bins):
            residual = np.concatenate([residual, np.empty_like(residual)])
            bins, first = np.concatenate([bins, bins]), np.concatenate([first, first])
        residual[classes], bins[classes], first[classes] = left, n, at
        classes += 1

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        piece = np.array([length, 1, length**2], dtype=np.int64)
        if (piece > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of one sequence")
        while left:
            fits = np.flatnonzero((residual[:classes] >= piece).all(axis=1))
            if len(fits):
                share = residual[fits] / whole
                if score == "dot":
                    cost = share @ (weight * piece / whole)
                else:
                    cost = ((share - piece / whole) ** 2) @ weight
                k = int(fits[np.argmin(cost)])
                per_bin = 1 if left <= bins[k] else int(min((residual[k] // piece).min(), -(-left // bins[k])))
            else:
                per_bin = int(min((whole // piece).min(), left))
                open_class(whole, left // per_bin, sequences)
                sequences += left // per_bin
                k = classes - 1
            used = int(min(bins[k], left // per_bin))
            runs.append((length, rank, per_bin, int(first[k]), int(whole[0] - residual[k, 0])))
            after = residual[k] - per_bin * piece
            if used < bins[k]:
                bins[k], at, first[k] = bins[k] - used, first[k], first[k] + used
                if after[0]:
                    open_class(after, used, at)
            elif after[0]:
                residual[k] = after
            else:
                classes -= 1
                residual[k], bins[k], first[k] = residual[classes], bins[classes], first[classes]
            rank, left = rank + used * per_bin, left - used * per_bin
    made = np.array(runs, dtype=np.int64).reshape(-1, 5)
    made = made[np.lexsort((made[:, 1], made[:, 0]))]
    return dict(zip(("length", "rank", "per_bin", "sequence", "offset"), made.T.copy(), strict=True)) | {"sequences": np.array(sequences)}


def token_pieces(df: DataFrame, tokenizer: str, text: str = "text", tokens: int = 4096, end_id: int = 1, ids: bool = False) -> DataFrame:
    """One row per piece: the columns of ``df`` but its text, then ``piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is its whole text's ids and ``end_id``; null is empty, so every row has at least
    one token. Only documents over ``tokens`` are cut, into pieces of just that many; the last
    piece may be shorter. Columns of ``df`` with one of the new names are left out.
    """
    fields = PIECES[:-2] + (",ids:array<int>>>" if ids else ">>")

    @F.pandas_udf(fields)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = whole_text(tokenizer)
        for texts in batches:
            out = []
            for t in texts:
                own = np.append(encoder.ids(t), np.uint32(end_id)).astype("<u4")
                parts = [(k, s, own[s : s + tokens]) for k, s in enumerate(range(0, len(own), tokens))]
                out.append([{"piece": k, "start": s, "length": len(p), "ids_crc32": zlib.crc32(p.tobytes())} | ({"ids": p.astype(np.int32)} if ids else {}) for k, s, p in parts])
            yield pd.Series(out)

    new = ["piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    kept = [F.col(f"`{c}`") for c in others(df, text, *new)]
    (made,) = fresh(df, "_piece")
    return df.select(*kept, F.explode(cut(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))).alias(made)).select(*kept, f"{made}.*")


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), score: str = "dot", order: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` (with a ``length``) and, for each, ``sequence_id`` and ``offset``.

    The lengths' histogram (at most ``capacity.tokens`` rows) goes to the driver, which plans
    over classes of equal pieces; the plan's size is bounded by the capacity and not by the data.
    A piece then needs only its rank among pieces of its length. Ranks are dealt over many
    sub-groups of each length, and sub-group sizes summed, so that a length that a third of all
    pieces share is still ranked by many tasks.

    ``order`` names columns that tell pieces of one length apart; it makes ranks repeatable when
    a task runs again, and defaults to all columns. Equal rows are interchangeable. An empty
    table gives an empty table. Columns of ``pieces`` called ``sequence_id`` or ``offset`` are
    replaced, all others pass through whatever their names. ``pieces`` is read more than once:
    pass a written table.
    """
    kept = others(pieces, "sequence_id", "offset")
    names = list(order) or [c for c in kept if c.lower() != "length"]
    group, n, before, rank, spot = fresh(pieces, "_group", "_n", "_before", "_rank", "_place")
    spark = pieces.sparkSession
    groups = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn(group, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(groups)))
    sizes, _ = written(dealt.groupBy("length", group).agg(F.count(F.lit(1)).alias(n)), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum(n).alias("n")).collect()}
    runs = plan(counts, capacity, score)
    earlier = Window.partitionBy("length").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", group, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy("length", group).orderBy(*[F.col(f"`{c}`") for c in names])
    ranked = dealt.withColumn(rank, F.row_number().over(within) - 1).join(starts, ["length", group]).withColumn(rank, F.col(rank) + F.col(before))
    shared = spark.sparkContext.broadcast(runs)

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = shared.value
        wide = np.int64(1) << 44
        at = np.searchsorted(r["length"] * wide + r["rank"], length.to_numpy(np.int64) * wide + rank.to_numpy(np.int64), side="right") - 1
        k = rank.to_numpy(np.int64) - r["rank"][at]
        return pd.DataFrame({"sequence_id": r["sequence"][at] + k // r["per_bin"][at], "offset": r["offset"][at] + k % r["per_bin"][at] * r["length"][at]})

    out = ranked.withColumn(spot, place("length", rank))
    return out.select(*[F.col(f"`{c}`") for c in kept], f"{spot}.*")


def pack_documents(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: Capacity = Capacity(), score: str = "dot") -> DataFrame:
    """Cuts and packs whole documents: per piece the ``keep`` columns, ``piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces, _ = written(token_pieces(df.select(*keep, text), tokenizer, text, capacity.tokens), "pieces")
    return pack(pieces, capacity, score)
