"""Near-duplicates by SimHash, found with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.shared import components, give_back, written

BITS = 64


def simhash_of(text: bytes, words: int = 3) -> int:
    """The unsigned fingerprint of UTF-8 bytes: A-Z lower-cased, words are runs without the bytes 9-13 and 32."""
    split = text.lower().split()
    if not split:
        return 0
    if len(split) < words:
        shingles = [b" ".join(split)]
    else:
        shingles = map(b" ".join, zip(*(split[k:] for k in range(words))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(h), 1 << 16):
        part = h[start : start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def simhash(text: Column, words: int = 3) -> Column:
    """Fingerprint of a whole text as a (signed) long; null and texts without words give 0."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash_of(t, words) for t in texts], dtype=np.uint64).view(np.int64))
        give_back()

    return fingerprint(F.coalesce(text.cast("binary"), F.lit(b"")))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """``2 ** (radius + 1) - 1`` masks such that any ``radius`` positions are all blank in one of them.

    Position i stands for a vector of radius + 1 bits, v(i), taken in turn from all but zero; the
    mask of a vector a keeps the positions with an odd product a.v(i). ``radius`` positions span
    less than the whole space, so some a other than zero is orthogonal to all their vectors, and
    its mask keeps none of them.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if (a & (i % n + 1)).bit_count() & 1) for a in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_fingerprints(distinct: DataFrame, radius: int = 2, most: int = 64) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (column ``fp``, distinct) within ``radius`` bits.

    Each fingerprint goes to one bucket, its masked value, in every table of the covering family;
    two within the radius share a bucket in some table. Pairs are verified inside the buckets by
    the bits that differ, and only those within the radius leave them. That is for buckets of at
    most ``most`` fingerprints. What lies in a larger one is verified without its pairs: it goes to
    all values within half the radius of itself, and two fingerprints are within the radius exactly
    if they meet at such a value; those who meet at one number at most as many as that ball has
    points (65 for radius 2) and are within the radius of each other, so the smallest stands for
    them. So no pair is lost, whatever the sizes. An odd radius lets only one side of a large
    bucket's pairs move by the larger half.
    """
    tables = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    keyed = distinct.select("fp", F.posexplode(tables).alias("_table", "_mask")).select("fp", "_table", F.expr("fp & _mask").alias("_key"))
    shared, _ = written(keyed.groupBy("_table", "_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "buckets")
    held, _ = written(keyed.join(shared, ["_table", "_key"]), "held")
    small = held.filter(F.col("_n") <= most).groupBy("_table", "_key").agg(F.collect_list("fp").alias("_all"))
    near = lambda x: F.filter("_all", lambda y: (x < y) & (F.bit_count(x.bitwiseXOR(y)) <= radius))
    inside = F.flatten(F.transform("_all", lambda x: F.transform(near(x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    edges = small.select(F.explode(inside).alias("_edge")).select("_edge.a", "_edge.b").distinct()
    crowd = held.filter(F.col("_n") > most).select("fp").distinct()
    single = F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)])
    ball = F.array(F.col("fp"))
    for _ in range(radius // 2):
        ball = F.array_distinct(F.concat(ball, F.flatten(F.transform(ball, lambda x: F.transform(single, lambda m: x.bitwiseXOR(m))))))
    if radius % 2 == 0:
        met = crowd.select("fp", F.explode(ball).alias("_at")).groupBy("_at").agg(F.collect_list("fp").alias("_all")).filter("size(_all) > 1")
        return edges.union(met.select(F.array_min("_all").alias("a"), F.explode("_all").alias("b")).filter("a <> b"))
    wide = F.array_distinct(F.concat(ball, F.flatten(F.transform(ball, lambda x: F.transform(single, lambda m: x.bitwiseXOR(m))))))
    own = crowd.select("fp", F.explode(ball).alias("_at"))
    far = crowd.select(F.col("fp").alias("b"), F.explode(wide).alias("_at"))
    return edges.union(own.join(far, "_at").filter("fp < b").select(F.col("fp").alias("a"), "b").distinct())


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``df``.

    ``fingerprint`` has 16 lower-case hex digits. ``component_id`` is the smallest id reachable
    over links of ``radius`` differing bits or fewer, the row's own id included. Exact copies meet
    as one fingerprint, so a group of copies of any size costs one row after a map-side
    aggregation. Rows with a null id take part and get the smallest known id of their component,
    null if there is none. An empty table gives an empty table.
    """
    own, _ = written(df.select(F.col(f"`{doc_id}`").alias("doc_id"), simhash(F.col(f"`{text}`"), words).alias("fp")), "fingerprints")
    classes, _ = written(own.groupBy("fp").agg(F.min("doc_id").alias("lead")), "classes")
    found = components(linked_fingerprints(classes.select("fp"), radius))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    return own.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
