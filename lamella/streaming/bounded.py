"""Packing large inputs bucket by bucket."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from functools import reduce
from pathlib import Path
from typing import Literal

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lamella.operators.attributes import Attributes
from lamella.plans.naming import col
from lamella.sources.scratch import written

BUCKET, COUNT, PART, BEFORE = "__hier_bucket", "__hier_n", "__hier_part", "__hier_before"


#: Entities whose counts are fetched at a time, and buckets up to which rows compare keys.
FETCH, FEW = 1_000_000, 256


def _starts(sums: list[Row], counts_of: Callable[[list[int]], DataFrame], partitions: int) -> list[tuple[int, int]]:
    """Where buckets after the first start: the range, and the rows before the place within it.

    ``sums`` has each range's number, rows and entities, in order. Ranges that fit into the open bucket
    as a whole are passed over; others are fetched in runs.
    """
    share = max(1, -(-sum(r["rows"] for r in sums) // partitions))
    out: list[tuple[int, int]] = []
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    opened = begin = 0  # rows before the open bucket, and before the range
    for at, r in enumerate(sums):
        end = begin + r["rows"]
        if end > opened + share:
            if r[PART] not in known:
                run, n = [], 0
                for later in sums[at:]:
                    if run and n + later["n"] > FETCH:
                        break
                    run.append(later[PART])
                    n += later["n"]
                frame = counts_of(run).toPandas().sort_values([PART, BEFORE])
                known = {part: (own[BEFORE].to_numpy(np.int64), own[COUNT].to_numpy(np.int64)) for part, own in frame.groupby(PART)}
            before, counts = known[r[PART]]
            before = before + begin
            upto = before + counts
            while end > opened + share:
                # the first entity that would carry the bucket over its share, or the one after a bucket's first
                k = int(np.searchsorted(upto, opened + share, side="right"))
                k += int(before[k] == opened)
                if k == len(before):
                    break
                out.append((r[PART], int(before[k] - begin)))
                opened = int(before[k])
        begin = end
        if opened + share < begin and sums[at + 1 :]:
            # an entity over the share ends the range: the next range's first opens a bucket
            out.append((sums[at + 1][PART], 0))
            opened = begin
    return out


class Bounded(Attributes):
    def pack_streaming(
        self,
        source: DataFrame | str | Path,
        at_level: str,
        *,
        partitions: int = 16,
        tmp_dir: str | Path | None = None,
        defer: bool = True,
        extra_columns: Literal["preserve", "drop", "error"] = "preserve",
        partition_strategy: Literal["balanced", "hash"] = "balanced",
        spark: SparkSession | None = None,
    ) -> DataFrame:
        """``pack`` with whole root entities dealt over partitions, one shuffle for all folds.

        "balanced" deals by ``balanced_buckets``, each a partition, sorted by root key within and
        across partitions; "hash" deals keys by hash. A task holds one entity's list at a time and
        spills the rest. With ``defer=False`` the result is written now, to a new folder in
        ``tmp_dir``, and read again; else it is an ordinary plan.
        """
        if partitions < 1:
            raise ValueError(f"partitions must be at least 1, not {partitions}.")
        if partition_strategy not in ("balanced", "hash"):
            raise ValueError(f"partition_strategy must be 'balanced' or 'hash', not {partition_strategy!r}.")
        if not defer and tmp_dir is None:
            raise ValueError("defer=False writes its result; name a tmp_dir that all executors share.")
        self._level(at_level)
        df = source
        if not isinstance(source, DataFrame):
            df = (spark or SparkSession.active()).read.parquet(str(source))
        df = self._prepared(df)
        keys = [k for k in self.levels[self.spec.root].id_columns if k in df.columns]
        if not keys:
            raise ValueError("pack_streaming deals rows by the root's key columns, which the source lacks.")
        by = [col(k) for k in keys]
        if partition_strategy == "hash":
            packed = self.pack(df.repartition(partitions, *by), at_level, extra_columns=extra_columns)
        else:
            dealt, buckets = self._dealt(df, keys, partitions)
            packed = self.pack(dealt.repartitionByRange(buckets, col(BUCKET)), at_level, extra_columns=extra_columns).sortWithinPartitions(*by)
        if defer:
            return packed
        path = f"{tmp_dir}/packed-{uuid.uuid4().hex}"
        packed.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    def balanced_buckets(self, frame: DataFrame, partitions: int) -> DataFrame:
        """``frame`` with a bucket per row in ``__hier_bucket``.

        Entities are walked in the order of their root keys (nulls first). A bucket takes the next
        entity unless that would carry it over an even share of the rows, ``ceil(rows /
        partitions)``; it always takes one. So no entity is split, and there may be more than
        ``partitions`` buckets, but never twice as many and one.
        """
        df = self._prepared(frame)
        return self._dealt(df, [k for k in self.levels[self.spec.root].id_columns if k in df.columns], partitions)[0]

    def _dealt(self, df: DataFrame, keys: list[str], partitions: int) -> tuple[DataFrame, int]:
        """``df`` with its buckets, and how many there are.

        Entities' row counts are dealt over ranges of keys and summed within each; the walk then
        needs only the ranges in which a bucket ends, and of those only counts, at most ``FETCH`` at
        a time. With few buckets a row finds its own by comparing its key with their first keys; with
        many, by a join.
        """
        spark = df.sparkSession
        by = [col(k) for k in keys]
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(COUNT))
        # written, because a range shuffle samples anew each time it runs
        ranged = written(counts.repartitionByRange(*by).withColumn(PART, F.spark_partition_id()), "ranges")[0]
        within = Window.partitionBy(PART).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        ranged = written(ranged.withColumn(BEFORE, F.coalesce(F.sum(COUNT).over(within), F.lit(0))), "ranges")[0]
        sums = ranged.groupBy(PART).agg(F.sum(COUNT).alias("rows"), F.count(F.lit(1)).alias("n")).orderBy(PART).collect()
        starts = _starts(sums, lambda parts: ranged.filter(col(PART).isin(parts)).select(PART, BEFORE, COUNT), partitions)
        if len(starts) > FEW:
            marks = spark.createDataFrame([(part, before, 1) for part, before in starts], f"`{PART}` int, `{BEFORE}` long, mark int")
            per_part = Counter(part for part, _ in starts)
            above, number = [], 0
            for r in sums:
                above.append((r[PART], number))
                number += per_part[r[PART]]
            running = F.sum(F.coalesce("mark", F.lit(0))).over(Window.partitionBy(PART).orderBy(BEFORE))
            mapped = ranged.join(marks, [PART, BEFORE], "left").join(spark.createDataFrame(above, f"`{PART}` int, above long"), PART).withColumn(BUCKET, (running + F.col("above")).cast("int"))
            mapped = mapped.select(*[col(k).alias(f"__hier_k{i}") for i, k in enumerate(keys)], BUCKET)
            on = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"__hier_k{i}")) for i, k in enumerate(keys)])
            return df.join(mapped, on, "left").drop(*[f"__hier_k{i}" for i in range(len(keys))]), len(starts) + 1
        wanted = reduce(lambda a, b: a | b, [(col(PART) == part) & (col(BEFORE) == before) for part, before in starts], F.lit(False))
        types = {f.name: f.dataType for f in df.schema.fields}
        first_keys = [F.struct(*[F.lit(r[k]).cast(types[k]).alias(k) for k in keys]) for r in ranged.filter(wanted).select(*by).collect()]
        own = F.struct(*[col(k).alias(k) for k in keys])
        return df.withColumn(BUCKET, reduce(lambda a, b: a + b, [(own >= k).cast("int") for k in first_keys], F.lit(0))), len(starts) + 1

    def unpack_streaming(self, source: DataFrame | str | Path, at_level: str, *, sink_path: str | Path | None = None, spark: SparkSession | None = None) -> DataFrame:
        """``unpack`` of a frame or Parquet path, written to ``sink_path`` (replaced if it is there) and read again if given. Works on unbounded streams too when it is not."""
        df = source if isinstance(source, DataFrame) else (spark or SparkSession.active()).read.parquet(str(source))
        out = self.unpack(df, at_level)
        if sink_path is None:
            return out
        out.write.mode("overwrite").parquet(str(sink_path))
        return df.sparkSession.read.parquet(str(sink_path))
