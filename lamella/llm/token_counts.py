"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.shared import fresh, give_back, others, written
from lamella.llm.wordbpe import whole_text

BLOCKS = "bucket int, block bigint, tokens string, sizes binary, packed binary"
BLOCK_COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]


class _Index(dict):
    """Key -> its number, in order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = out = len(self)
        return out


def frequencies(texts: list[str], split, pre_tokens) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the texts, and for each the texts that hold it and how often.

    ``tokens, bounds, docs, times``: token k stands ``times[i]`` times in text ``docs[i]`` for each i
    from ``bounds[k]`` up to ``bounds[k + 1]``. A count over 255 takes several places of one text.
    """
    words, tokens = _Index(), _Index()
    rows = [np.fromiter(map(words.__getitem__, own), np.int64, len(own)) for own in map(split, texts)]
    if not words:
        return [], np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pair, n = np.unique(doc * len(words) + np.concatenate(rows), return_counts=True)
    doc, word = np.divmod(pair, len(words))
    parts = [[tokens[t] for t in pre_tokens(w)] for w in words]
    sizes = np.array([len(p) for p in parts])
    starts, flat = np.r_[0, np.cumsum(sizes)], np.fromiter((t for p in parts for t in p), np.int64)
    long = sizes[word]
    at = np.repeat(starts[word] - np.r_[0, np.cumsum(long)[:-1]], long) + np.arange(long.sum())
    key = flat[at] * len(rows) + np.repeat(doc, long)
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.repeat(n, long)[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    n = np.add.reduceat(n, first) if len(first) else n
    token, doc = np.divmod(key[first], len(rows))
    again = -(-n // 255)
    last = np.cumsum(again) - 1
    token, doc, times = np.repeat(token, again), np.repeat(doc, again), np.full(again.sum(), 255)
    if len(last):
        times[last] = n - 255 * (again - 1)
    return list(tokens), np.searchsorted(token, np.arange(len(tokens) + 1)), doc, times


def _blocks(texts: DataFrame, tokenizer: str, buckets: int, most_bytes: int = 4_000_000, most_texts: int = 60_000) -> DataFrame:
    """Frequencies of the texts (``digest, text``) by block, a bounded number of distinct texts each.

    A row per block and bucket of pre-tokens, which their hash decides: the ``tokens``, one to a line;
    in how many texts each stands, four bytes; which texts, by their place in the block, two bytes each;
    and how often, one byte each. One more row per block, without tokens, lists the texts' digests.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = whole_text(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        held: dict[bytes, str] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            nonlocal held, size, number
            tokens, bounds, docs, times = frequencies(list(held.values()), encoder.split, encoder.pre_tokens)
            bucket = np.array([xxhash.xxh64_intdigest(t, 5) % buckets for t in tokens], np.int64)
            order = np.argsort(bucket, kind="stable")
            sizes = np.diff(bounds)[order]
            ends = np.r_[0, np.cumsum(sizes)]
            at = np.repeat(bounds[:-1][order] - ends[:-1], sizes) + np.arange(len(docs))
            docs, times, sizes = docs[at].astype("<u2"), times[at].astype("u1"), sizes.astype("<u4")
            bucket = bucket[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
            block = (part << 32) + number
            out: list[tuple] = [(block % buckets, block, None, b"", b"".join(held))]
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x, y = int(ends[i]), int(ends[j])
                out.append((int(bucket[i]), block, "\n".join([tokens[k] for k in order[i:j].tolist()]), sizes[i:j].tobytes(), docs[x:y].tobytes() + times[x:y].tobytes()))
            held, size, number = {}, 0, number + 1
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=BLOCK_COLUMNS)

        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in held:
                    held[digest] = text.as_py()
                    size += len(held[digest])
                    if size >= most_bytes or len(held) >= most_texts:
                        yield rows()
        if held:
            yield rows()
        give_back()

    return texts.mapInArrow(of, BLOCKS)


class _Pieces(dict):
    """Pre-token -> the number of its pieces, counted when first asked for; forgotten beyond a limit."""

    def __init__(self, encoder, limit: int = 2_000_000):
        super().__init__()
        self.encoder, self.limit = encoder, limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[token] = out = len(self.encoder.piece_ids(token))
        return out


def text_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` of the distinct texts of ``digest, text`` (no nulls).

    A hash join of distinct pre-tokens with the texts' pre-token frequencies: the frequencies are
    exchanged by the pre-token's hash, so each distinct one meets all of its frequencies in one task,
    is counted there once, and multiplies them. What comes out goes back by block and is summed by
    text; no ids are made. Frequencies travel by block of texts, three bytes for a text and pre-token, so
    the exchanges move less than the texts, and a frequent pre-token has one place per block.
    Files whose texts don't fall into independent pre-tokens are counted by the library, text by text.
    """

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = whole_text(tokenizer)
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": [len(encoder.whole(t)) for t in b["text"]]})

    if not whole_text(tokenizer).by_word:
        counted = texts.mapInPandas(whole, "digest binary, n_tokens bigint")
        return written(counted.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")[0]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(whole_text(tokenizer))
        for batch in batches:
            docs_of, sums_of = [], []
            for tokens, sizes, packed in zip(batch.column("tokens"), batch.column("sizes"), batch.column("packed"), strict=True):
                if not tokens.is_valid:
                    docs_of.append(packed.as_py())
                    sums_of.append(None)
                    continue
                sizes, packed = np.frombuffer(sizes.as_buffer(), "<u4"), packed.as_buffer()
                long = int(sizes.sum())
                docs, times = np.frombuffer(packed, "<u2", long), np.frombuffer(packed, "u1", long, 2 * long)
                counts = np.fromiter(map(pieces.__getitem__, tokens.as_py().split("\n")), np.float64, len(sizes))
                total = np.bincount(docs, times * np.repeat(counts, sizes))
                some = np.flatnonzero(total)
                docs_of.append(some.astype("<u2").tobytes())
                sums_of.append(total[some].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(docs_of, pa.binary()), pa.array(sums_of, pa.binary())], names=["block", "docs", "sums"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows["sums"].isna()
        digests = rows["docs"][names].iloc[0]
        docs, sums = np.frombuffer(b"".join(rows["docs"][~names]), "<u2"), np.frombuffer(b"".join(rows["sums"][~names]), "<u4")
        total = np.bincount(docs, sums, len(digests) // 16)
        return pd.DataFrame({"digest": [digests[k : k + 16] for k in range(0, len(digests), 16)], "n_tokens": total.astype(np.int64)})

    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_token = _blocks(texts, tokenizer, buckets).repartitionById(buckets, F.col("bucket"))
    partial = by_token.mapInArrow(joined, "block bigint, docs binary, sums binary")
    counts = partial.groupBy("block").applyInPandas(summed, "digest binary, n_tokens bigint")
    return written(counts.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")[0]


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    One row per input row, repeated rows included; equal texts are counted once per block and meet
    by their MD5. Null and empty texts have 0 tokens; texts of any length are counted whole; an
    empty table gives an empty table. Columns of these names in ``df`` are replaced; all others
    pass through untouched. ``df`` is read twice.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digest, own = fresh(df, "_digest", "_own")
    counts = text_counts(df.select(F.unhex(F.md5(whole.cast("binary"))).alias("digest"), whole.alias("text")), tokenizer)
    kept = others(df, "n_bytes", "n_tokens", "over_limit")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.octet_length(whole).cast("long").alias("n_bytes"), F.unhex(F.md5(whole.cast("binary"))).alias(digest))
    out = rows.join(counts.withColumnRenamed("digest", own), F.col(digest) == F.col(own))
    return out.select(*[F.col(f"`{c}`") for c in kept], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
