"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.shared import claim, fresh, give_back, others, written

EDGES = string.punctuation + string.whitespace + "«»“”„’‘…–—"


@dataclass(frozen=True)
class Settings:
    """``bits``: log2 of the number of coordinates. ``sample``: the bound on labelled rows that
    are learned from, ``sample_bytes`` that on their features, four bytes each, which one task
    holds. alpha, beta, l1 and l2 are the usual ones of FTRL-proximal; a large l1
    leaves few weights other than 0. ``epochs``: passes over the sample."""

    bits: int = 20
    sample: int = 12_000
    sample_bytes: int = 256 << 20
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 5


@dataclass(frozen=True)
class Model:
    """The bias and the weights other than 0; small enough to be broadcast at any corpus size,
    because at most ``2 ** bits`` coordinates exist."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, dtype=np.float32)
        out[self.index] = self.weight
        return out


class _Hashes(dict):
    """Word -> row of ``both``: 64-bit hashes of its lower-case form without punctuation at its ends and of that form's first letters; 0 for punctuation alone."""

    def __init__(self, stem: int = 5, limit: int = 200_000):
        super().__init__()
        self.stem, self.limit, self.both = stem, limit, array("Q")

    def __missing__(self, word: str) -> int:
        bare = word.strip(EDGES)
        self.both.append(xxhash.xxh64_intdigest(bare, 7) if bare else 0)
        self.both.append(xxhash.xxh64_intdigest(bare[: self.stem], 9) if bare else 0)
        self[word] = out = len(self.both) // 2 - 1
        return out

    def clear(self) -> None:
        super().clear()
        self.both = array("Q")

    def of(self, words: list[str]) -> np.ndarray:
        if len(claim(self)) > self.limit:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.frombuffer(self.both, dtype=np.uint64).reshape(-1, 2)[rows] if len(rows) else np.empty((0, 2), np.uint64)


_HASHES = _Hashes()


def coordinates(text: str | None, bits: int) -> np.ndarray:
    """Hashed coordinates of a whole text: words, words' first letters (inflected forms share them), word pairs and pairs with one word skipped, with repeats."""
    both = _HASHES.of((text or "").lower().split())
    both = both[both[:, 0] != 0]
    h = both[:, 0]
    shift = np.uint64(64 - bits)
    odd = np.uint64(0x9E3779B97F4A7C15)
    pairs = (h[:-1] * np.uint64(3) + h[1:]) * odd
    skips = (h[:-2] * np.uint64(5) + h[2:] * np.uint64(7)) * odd
    return (np.concatenate([h * odd, both[:, 1] * odd, pairs, skips]) >> shift).astype(np.int32)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, settings: Settings) -> tuple[float, np.ndarray]:
    """Per-coordinate FTRL-proximal over examples with binary features; returns the bias and all weights."""
    n, z = np.zeros(1 << settings.bits), np.zeros(1 << settings.bits)
    bias = bias_n = 0.0

    def weights(at) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        return np.where(np.abs(zs) <= settings.l1, 0.0, w)

    for _ in range(settings.epochs):
        for at, y in zip(examples, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum())))) - y
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - step * w
            n[at] += g * g
            bias_n += g * g
            bias -= settings.alpha / (settings.beta + math.sqrt(bias_n)) * g
    return bias, weights(slice(None))


def train(df: DataFrame, text: str = "text", label: str = "label", settings: Settings = Settings()) -> Model:
    """Learns from rows with a label of 0 or 1 and any text; others are ignored.

    ``df``'s rows must be bounded by the caller (see ``sampled_labels``). Features are made by all tasks;
    if they exceed ``settings.sample_bytes``, fewer rows are taken, by the hash of their text. One task
    then sorts the bounded sample by that hash, so that a repeated run gives the same model, and learns. Without rows of both labels the model is a constant: the share of ones,
    or one half of no rows.
    """
    bits = settings.bits

    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(coordinates(t, bits)).tobytes() for t in texts])

    def learn(batches):
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        all_rows = pd.concat(frames).sort_values(["_order", "_x", "_y"], kind="stable")
        y = all_rows["_y"].to_numpy(float)
        if y.min() == y.max():
            return
        bias, w = ftrl([np.frombuffer(x, dtype=np.int32) for x in all_rows["_x"]], y, settings)
        at = np.flatnonzero(w).astype(np.int32)
        yield pd.DataFrame({"bias": [bias], "index": [at.tobytes()], "weight": [w[at].astype("f4").tobytes()]})

    known = df.filter(F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{label}`").cast("int").alias("_y"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    rows, _ = written(known.select("_y", features("_t").alias("_x"), F.xxhash64("_t").alias("_order")), "features")
    size = rows.agg(F.sum(F.octet_length("_x").cast("long"))).first()[0] or 0
    if size > settings.sample_bytes:
        rows = rows.filter(F.pmod("_order", F.lit(1 << 24)) < int(0.95 * settings.sample_bytes / size * (1 << 24)))
    learned = rows.repartition(1).mapInPandas(learn, "bias double, index binary, weight binary").collect()
    if learned:
        r = learned[0]
        return Model(bits, r["bias"], np.frombuffer(r["index"], dtype=np.int32), np.frombuffer(r["weight"], dtype=np.float32))
    share = known.agg(F.avg("_y")).first()[0]
    share = 0.5 if share is None else min(max(share, 0.01), 0.99)
    return Model(bits, math.log(share / (1 - share)), np.empty(0, np.int32), np.empty(0, np.float32))


def sampled_labels(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """``key`` and ``label`` (0 or 1), one row per key (the larger label if they differ), at most ``rows`` by the key's hash.

    The bound makes the result safe to broadcast.
    """
    one = labels.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{key}`").alias(key)).agg(F.max(f"`{label}`").alias(label))
    there = one.count()
    share = 1.0 if there <= rows else 0.95 * rows / there  # the limit below is a bound that the sample by hash stays under
    return one.filter(F.pmod(F.xxhash64(F.lit(11), F.col(f"`{key}`")), F.lit(1 << 24)) < int(share * (1 << 24))).limit(rows)


def toxicity(text: Column, model: Model) -> Column:
    """The model's probability for a whole text. Null and empty texts get the bias alone."""
    # the sparse weights travel with the function; each worker unfolds them once per task

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = model.dense()
        for texts in batches:
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                at = coordinates(t, model.bits)
                used = np.unique(at[w[at] != 0])
                out[i] = model.bias + float(w[used].astype(np.float64).sum())
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))
        give_back()

    return score(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 on division by 3. Null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``.

    Learns from documents whose labels may be used, on at most ``settings.sample`` labelled ids
    (the least text of each, should ids repeat), and scores every document, repeated rows and
    rows without an id included. Only the text enters a score; null and empty texts get the bias
    alone. Columns of the new names are replaced, others pass through; an empty table gives an empty table.
    """
    usable = sampled_labels(labels.filter(~held_out(F.col(f"`{doc_id}`"))), doc_id, label, settings.sample)
    side = usable.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("_label"))
    known = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).join(F.broadcast(side), "_id")
    model = train(known.groupBy("_id", "_label").agg(F.min("_text").alias("_text")), "_text", "_label", settings)
    (id_, body), kept = fresh(docs, "_id", "_text"), others(docs, "held_out", "score", "predicted")
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{doc_id}`").alias(id_), F.col(f"`{text}`").alias(body))
    out = out.select(*[F.col(f"`{c}`") for c in kept], held_out(F.col(id_)).alias("held_out"), toxicity(F.col(body), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
