"""URL filters: host and path rules, and exact set membership by a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.shared import delete_path, fresh, others, written


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?`` or ``#``. Both empty if null or without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, shape, 1), upper, upper.lower()), F.regexp_extract(text, shape, 2)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """``rule, verdict`` of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Rules are a short
    list that is written into the expression, from the longest to the shortest.
    """
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules; list more keys in a cascade")
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.key), -len(r.host), r.key)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule = F.when(fits, r.key) if rule is None else rule.when(fits, r.key)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """One Bloom filter: ``bits`` places, of which a key sets ``probes``."""

    number: int
    bits: int
    probes: int
    words: np.ndarray | None = None

    @classmethod
    def sized(cls, number: int, keys: int, wrong: float) -> Level:
        return cls(number, max(64, math.ceil(keys * math.log2(1 / wrong) / math.log(2))), max(1, round(math.log2(1 / wrong))))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a = _mix(h1 + np.uint64((self.number * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        b = _mix(h2 ^ a) | np.uint64(1)
        return np.stack([(a + np.uint64(j) * b) % np.uint64(self.bits) for j in range(self.probes)])

    def set_words(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.places(h1, h2).ravel()
        words, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
        order = np.argsort(words, kind="stable")
        words, bit = words[order], bit[order]
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
        return words[first].astype(np.int64), np.bitwise_or.reduceat(bit, first) if len(first) else bit

    def fill(self, words: np.ndarray, bits: np.ndarray) -> None:
        self.words = np.zeros(-(-self.bits // 64), dtype=np.uint64)
        self.words[words] = bits

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def member(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: a key is decided by the first level that doesn't hold it."""
    out = np.zeros(len(h1), dtype=bool)
    left = np.arange(len(h1))
    for k, level in enumerate(levels):
        inside = level.holds(h1[left], h2[left])
        out[left[~inside]] = k % 2 == 1
        left = left[inside]
    out[left] = len(levels) % 2 == 1
    return out


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; the pair stands for the key."""
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


def _unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(np.uint64)


class Cascade:
    """The levels of each shard of a list, broadcast apart so that a task loads those that it meets."""

    def __init__(self, shards: int):
        self.shards, self.levels, self.sent = shards, [[] for _ in range(shards)], [None] * shards

    def send(self, spark: SparkSession, shard: int) -> None:
        if self.sent[shard] is not None:
            self.sent[shard].destroy()
        self.sent[shard] = spark.sparkContext.broadcast(self.levels[shard])
        if self.shards > 1:  # the driver holds one shard's bits at a time
            self.levels[shard] = None

    def added(self, spark: SparkSession, shard: int, level: Level) -> None:
        own = self.levels[shard] if self.levels[shard] is not None else list(self.sent[shard].value)
        _let_go(self.sent[shard], self.shards)
        self.levels[shard] = [*own, level]
        self.send(spark, shard)

    def test(self, of: Callable[[list[Level], np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """A function of shards and hashes that applies ``of`` to each shard's levels and keys; it holds one shard at a time if there are several."""
        sent, shards = list(self.sent), self.shards

        def run(shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
            out = np.zeros(len(h1), dtype=bool)
            for k in np.unique(shard).tolist():
                at = np.flatnonzero(shard == k)
                out[at] = of(sent[k].value, h1[at], h2[at])
                _let_go(sent[k], shards)
            return out

        return run


def _let_go(sent: Broadcast | None, shards: int) -> None:
    """Forgets the loaded value of one shard among several; it is loaded again from the worker's file when next asked for."""
    if sent is not None and shards > 1 and hasattr(sent, "_value"):
        del sent._value


def _last_holds(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return levels[-1].holds(h1, h2)


def _held(keys: DataFrame, cascade: Cascade) -> DataFrame:
    """The keys that the latest level of their shard holds."""
    test = cascade.test(_last_holds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[test(b["shard"].to_numpy(), _unsigned(b["h1"]), _unsigned(b["h2"]))]

    return keys.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields))


def _encode(keys: DataFrame, number: int, cascade: Cascade, wrong: float) -> None:
    """A further level, which holds ``keys``: tasks set bits and join them by word, and the driver takes one shard's words after another."""
    spark = keys.sparkSession
    sizes = {r["shard"]: r["n"] for r in keys.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = [Level.sized(number, max(1, sizes.get(k, 0)), wrong) for k in range(cascade.shards)]

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, part in b.groupby("shard"):
                at, bits = made[k].set_words(_unsigned(part["h1"]), _unsigned(part["h2"]))
                yield pd.DataFrame({"shard": np.int32(k), "word": at, "bits": bits.view(np.int64)})

    joined = keys.select("h1", "h2", "shard").mapInPandas(words, "shard int, word bigint, bits bigint").groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    joined, path = written(joined, "words")
    for k in range(cascade.shards):
        own = (joined.filter(F.col("shard") == k) if cascade.shards > 1 else joined).select("word", "bits").toPandas()
        made[k].fill(own["word"].to_numpy(np.int64), own["bits"].to_numpy(np.int64).view(np.uint64))
        cascade.added(spark, k, made[k])
        made[k] = Level(number, made[k].bits, made[k].probes)
    delete_path(spark, path)


def build_cascade(corpus: DataFrame, listed: DataFrame, shards: int = 1, first: float = 1 / 64, wrong: float = 1 / 8) -> Cascade:
    """The cascade that tells which keys (``h1, h2, shard``) of ``corpus`` are among those of ``listed``, for each of them.

    Level 0 encodes the list, without a look at the corpus. Only the corpus keys that it holds, the
    listed ones and a share ``first`` of the others, are made distinct and joined with the list to
    tell the two apart. Level 1 encodes the others that were held by mistake, level 2 the listed
    keys that level 1 holds, and so on, each with a share ``wrong`` of mistakes, until a level
    makes none: the result is exact on every key of the corpus. Every level, of any size, is
    built and tried by tasks.
    """
    spark = corpus.sparkSession
    cascade = Cascade(shards)
    _encode(listed, 0, cascade, first)
    inside = _held(corpus, cascade).distinct().join(listed.select("h1", "h2", F.lit(True).alias("yes")), ["h1", "h2"], "left")
    positives, path = written(inside.select("h1", "h2", "shard", F.coalesce("yes", F.lit(False)).alias("yes")), "positives")
    paths = [path]
    sides = {True: positives.filter("yes").select("h1", "h2", "shard"), False: positives.filter("NOT yes").select("h1", "h2", "shard")}
    side, number = False, 1
    while not sides[side].isEmpty():
        _encode(sides[side], number, cascade, wrong)
        side, number = not side, number + 1
        sides[side], path = written(_held(sides[side], cascade), "held")
        paths.append(path)
    for path in paths:
        delete_path(spark, path)
    return cascade


def in_list(df: DataFrame, key: Column, listed: DataFrame, out: str = "listed", most_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a boolean column ``out`` (replaced if there is one): whether ``key`` is among the first column of ``listed``; null keys are not.

    Exact without a join of ``df``'s rows: the cascade is built for the corpus's complete key
    universe, the distinct keys of ``df``, and looked up by each row. It is broadcast, so what is
    sent at a time is held below ``most_bytes``: a longer list is split by key into shards, and rows go
    to the tasks of their shard, salted so that a frequent key has many. ``df`` is read once to
    build and once to look up. An empty list lists nothing, an empty table gives an empty table.
    """
    spark = df.sparkSession
    k, a, b, s, salt = fresh(df, "_key", "_h1", "_h2", "_shard", "_salt")
    h1, h2 = key_hashes(key)
    own = listed.select(F.col(f"`{listed.columns[0]}`").alias("key")).filter("key IS NOT NULL")
    own, _ = written(own.select(*[c.alias(n) for c, n in zip(key_hashes(F.col("key")), ("h1", "h2"), strict=True)]).distinct(), "listed")
    bits = Level.sized(0, max(1, own.count()), 1 / 64).bits * 5 // 4  # later levels are a small part of the first
    shards = max(1, -(-bits // (8 * most_bytes)))
    dealt = lambda c: F.pmod(c, F.lit(shards)).cast("int")
    source = df.select(*[F.col(f"`{c}`") for c in others(df, out)], key.isNotNull().alias(k), h1.alias(a), h2.alias(b), dealt(h1).alias(s))
    corpus = source.filter(F.col(k)).select(F.col(a).alias("h1"), F.col(b).alias("h2"), F.col(s).alias("shard"))
    cascade = build_cascade(corpus, own.withColumn("shard", dealt(F.col("h1"))), shards)
    test = cascade.test(member)

    @F.pandas_udf("boolean")
    def found(shard: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(test(shard.to_numpy(), _unsigned(a), _unsigned(b)))

    if shards > 1:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salted = source.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(-(-parts // shards))))
        source = salted.repartition(max(parts, shards), s, salt).drop(salt)
    return source.withColumn(out, F.col(k) & found(s, a, b)).drop(k, a, b, s)


def judge(pages: DataFrame, rules: list[Rule], blocked_hosts: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row, in which the longest fitting rule decides, and the list of blocked hosts where none fits.

    Rows with a null id or url, and repeated rows, are judged like any other; an empty table gives an empty table.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    split = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    listed = in_list(split, F.col("host"), blocked_hosts, "_blocked")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return listed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"))
