"""Near-duplicate documents of a given similarity: SimHash groups, joined by verified links between documents that share min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import simhash
from lamella.llm.shared import components, delete_path, give_back, written
from lamella.llm.substring import mixed, shingles

ODD = np.uint64(0xD6E8FEB86659FD93)


class Sketches:
    """Min-hashes of a set of shingles in ``bands`` bands of ``rows`` functions each.

    Two sets of Jaccard index s share a band's key with probability s ** rows, so all keys differ
    with probability (1 - s ** rows) ** bands: 3 in a million for 0.8, whatever the length of the texts.
    """

    def __init__(self, bands: int = 24, rows: int = 4):
        self.bands, self.rows = bands, rows
        numbers = np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.salts, odd = np.split(mixed(numbers)[:, None], 2)
        self.factors = odd | np.uint64(1)

    def enough(self, similarity: float) -> int:
        """The number of equal minima that a pair of that similarity reaches but for 3 in a million: 4.5 standard deviations below its mean."""
        n = self.bands * self.rows
        return int(similarity * n - 4.5 * (similarity * (1 - similarity) * n) ** 0.5)

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each band, and all minima, 32 bits of each."""
        least = np.full(len(self.salts), ~np.uint64(0))
        for start in range(0, len(own), 1 << 11):
            least = np.minimum(least, ((own[start : start + (1 << 11)] ^ self.salts) * self.factors).min(axis=1))
        out = np.arange(self.bands, dtype=np.uint64)
        for column in least.reshape(self.bands, self.rows).T:
            out = mixed(out * ODD + column)
        return out, (least >> np.uint64(32)).astype(np.uint32)


def _sketch_rows(docs: DataFrame, words: int, sketches: Sketches) -> DataFrame:
    """``doc_id, mark, size, keys, minima`` of the texts that have a shingle; equal sets of shingles have equal marks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, sizes, keys, minima = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.unique(shingles(text.as_py(), words))
                if len(own):
                    ids.append(doc_id)
                    marks.append(mixed(own).sum(dtype=np.uint64))
                    sizes.append(len(own))
                    of_bands, least = sketches.of(own)
                    keys.append(of_bands)
                    minima.append(least.tobytes())
            if ids:
                flat = pa.array(np.concatenate(keys).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * sketches.bands), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, pa.array(minima, pa.binary())], names=["doc_id", "mark", "size", "keys", "minima"])
        give_back()

    return docs.mapInArrow(of, "doc_id bigint, mark bigint, size int, keys array<bigint>, minima binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _rooted(rows: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """``rows`` with column ``root`` moved on to what ``found`` says of ``node``."""
    to = found.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(to, F.col(node) == F.col("_node"), "left").withColumn("root", F.coalesce("_root", node)).drop("_node", "_root")


def overlaps(row: np.ndarray, element: np.ndarray, n: int, few: int = 16) -> np.ndarray:
    """How many elements each two of ``n`` sets share, given by pairs of a set's row and an element, each pair once.

    Elements of few sets add to each pair of them; those of many go by products of 0-1 matrices, some thousand elements at a time.
    """
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    first = np.flatnonzero(np.r_[True, element[1:] != element[:-1]]) if len(row) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(row)])
    out = np.zeros(n * n, np.int64)
    for d in range(2, few + 1):
        rows = row[first[sizes == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d) if len(rows) else ():
                out += np.bincount(rows[:, i] * n + rows[:, j], minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    many = np.flatnonzero(sizes > few)
    for k in range(0, len(many), 4096):
        some = many[k : k + 4096]
        held = np.zeros((n, len(some)), np.float32)
        for c, m in enumerate(some.tolist()):
            held[row[first[m] : first[m] + sizes[m]], c] = 1
        out += np.rint(held @ held.T).astype(np.int64)
    return out


def _apart(part: pd.DataFrame) -> np.ndarray:
    """Which two rows of a key may be compared: of different roots and, where a key is dealt over blocks, not of a block that has its own group."""
    root, block = part["root"].to_numpy(), part["block"].to_numpy()
    out = root[:, None] != root[None, :]
    if part["low"].iloc[0] != part["high"].iloc[0]:
        out &= block[:, None] != block[None, :]
    return out


def _by_key(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each key that has several roots."""
    group = group.sort_values("key", kind="stable", ignore_index=True)
    key = group["key"].to_numpy()
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    root = group["root"].to_numpy()
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if (root[i:j] != root[i]).any():
            yield group.iloc[i:j]


def _grouped(rows: DataFrame, most: int = 600, wide: str | None = None, most_bytes: int = 16 << 20):
    """The rows, dealt so that those of one key meet in groups of at most about ``most``: keys with few rows by the thousand, a key with many by pairs of its blocks.

    Where the column ``wide`` is given, which holds bytes, groups have at most about ``most_bytes`` of them too, or two rows.
    """
    held = F.coalesce(F.sum(F.length(wide)), F.lit(0)) if wide else F.lit(0)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), held.alias("_held"))
    sizes, _ = written(sizes.filter((F.col("_n") > most) | ((F.col("_held") > most_bytes) & (F.col("_n") > 2))), "sizes")
    blocks = F.greatest(F.ceil(F.col("_n") / (most // 2)), F.least("_n", F.ceil(F.col("_held") / (most_bytes // 2))))
    placed = rows.join(sizes, "key", "left").withColumn("_blocks", F.coalesce(blocks, F.lit(1)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    n, total = rows.agg(F.count(F.lit(1)), held).first()
    few = F.lit(max(1, n // 2000, total // most_bytes))
    placed = placed.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other"), "lot": F.when(F.col("_n").isNull(), F.pmod(F.xxhash64("key"), few)).otherwise(F.col("key")), "own": F.col("_n").isNotNull()})
    return placed.drop("_n", "_held", "_blocks", "_other").groupBy("own", "lot", "low", "high")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8, sketches: Sketches = Sketches()) -> DataFrame:
    """``doc_id, component_id``: documents linked by SimHash, or by a Jaccard index of their ``words``-word shingles of ``similarity`` or more.

    Fingerprints of near-copies with a few edits differ in more bits than covering masks can span
    (a pair of similarity 0.8 in about ten of 64), so a fingerprint alone groups copies that
    are all but exact. Other candidates share a key of ``sketches``; of texts with equal shingles
    the smallest id stands for all. Every two holders of a key are compared, unless they are in one
    component already, and linked by their whole sets of shingles:

    First one holder of each key, that with most company, is verified against all others, so a family of
    copies is linked by its base and needs no pairs. Keys whose holders are one component by then are
    done. Holders of the others meet in groups of bounded size, in which no pair leaves its task: their
    minima tell which may be alike at all, and those are compared exactly by what their sets of shingles have
    other than the first holder's, since two sets differ as much as these differences do.

    Documents of fewer words than a shingle are linked by SimHash alone. One row per id: repeated rows
    count once; rows without an id are left out; a null text is empty; an empty table gives an empty table.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    prints, _ = written(simhash.near_duplicates(docs.withColumn("text", F.col("text").cast("string"))).select("doc_id", "component_id").distinct(), "prints")
    sketched, _ = written(_sketch_rows(docs, words, sketches), "sketches")
    # grouped sides of joins are written, so that the joins are of two plain exchanges, which Spark splits where a key is hot
    leads, _ = written(sketched.groupBy("mark").agg(F.min("doc_id").alias("lead")), "leads")
    equal = sketched.select("doc_id", "mark").join(leads, "mark").filter("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    first, _ = written(components(prints.filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).union(equal)), "components")
    chosen = sketched.join(leads.select("mark", F.col("lead").alias("doc_id")), ["mark", "doc_id"])
    keyed, keyed_path = written(chosen.select("doc_id", "size", F.explode("keys").alias("key")), "keys")
    shared, _ = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    held, held_path = written(keyed.join(shared, "key"), "held")
    delete_path(spark, keyed_path)
    company, _ = written(held.groupBy("doc_id").agg((-F.sum("n")).alias("rank")), "company")
    live, live_path = written(_rooted(held.select("key", "doc_id", "size").join(company, "doc_id"), first, "doc_id"), "live")
    delete_path(spark, held_path)

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingles(t, words)).tobytes() for t in texts])
        give_back()

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(xs, ys, strict=True)], dtype=bool)
        give_back()

    @F.pandas_udf("binary")
    def unlike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).tobytes() for x, y in zip(xs, ys, strict=True)])
        give_back()

    def with_sets(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` with both sets; pairs grow with the corpus, so they are never broadcast."""
        own = pairs.hint("merge").join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("_x")), "a")
        return own.hint("merge").join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("_y")), "b")

    # one holder of each key against all others
    one = F.min(F.struct("rank", "doc_id", "size", "root")).alias("r")
    stand = live.groupBy("key").agg(one, F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high")
    stand, _ = written(stand.select("key", F.col("r.doc_id").alias("_id"), F.col("r.size").alias("_size"), F.col("r.root").alias("_root")), "stand")
    met, met_path = written(live.drop("rank").join(stand, "key"), "met")
    delete_path(spark, live_path)
    sets, _ = written(docs.join(met.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").distinct().select("doc_id", packed("text").alias("own")), "sets")
    near = met.filter("doc_id <> _id AND root <> _root").filter(F.least("size", "_size") >= similarity * F.greatest("size", "_size") - 1e-6)
    pairs, _ = written(near.select(F.col("doc_id").alias("a"), F.col("_id").alias("b"), F.col("root").alias("root_a"), F.col("_root").alias("root_b")).distinct(), "pairs")
    links = with_sets(pairs).filter(alike("_x", "_y"))
    found, _ = written(components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "components")

    # the others of keys that still have several components
    rest = _rooted(met.select("key", "doc_id", "size", "root", "_id"), found, "root")
    split, _ = written(rest.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("key"), "split")
    rest, _ = written(rest.join(split, "key"), "rest")
    delete_path(spark, met_path)
    minima = sketched.select("doc_id", "minima").join(rest.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").distinct()
    sketches_of, _ = written(rest.join(minima.hint("merge"), "doc_id"), "minima")
    least = sketches.enough(similarity)

    def likely(group: pd.DataFrame) -> pd.DataFrame:
        """The rows that may be alike with another by their minima and sizes."""
        out = []
        for part in _by_key(group):
            m = np.frombuffer(b"".join(part["minima"]), np.uint32).reshape(len(part), -1)
            size, ok = part["size"].to_numpy(), _apart(part)
            ok &= np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :]) - 1e-6
            for i in range(0, len(m), 32):
                ok[i : i + 32] &= (m[i : i + 32, None, :] == m[None, :, :]).sum(axis=2) >= least
            out.append(part.loc[ok.any(axis=1), ["key", "doc_id", "size", "root", "_id"]])
        give_back()
        return pd.concat(out) if out else group.iloc[:0][["key", "doc_id", "size", "root", "_id"]]

    maybe = _grouped(sketches_of).applyInPandas(likely, "key bigint, doc_id bigint, size int, root bigint, _id bigint")
    maybe, _ = written(maybe.distinct(), "likely")
    of_pairs, _ = written(with_sets(maybe.select(F.col("doc_id").alias("a"), F.col("_id").alias("b")).distinct()).select("a", "b", unlike("_x", "_y").alias("diff")), "differences")
    differing, _ = written(maybe.hint("merge").join(of_pairs.hint("merge"), (F.col("doc_id") == F.col("a")) & (F.col("_id") == F.col("b"))).select("key", "doc_id", "size", "root", "diff"), "differing")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        """Edges between roots that connect all whose rows are alike."""
        out: set[tuple[int, int]] = set()
        for part in _by_key(group):
            diffs = [np.frombuffer(d, np.uint64) for d in part["diff"]]
            sizes = np.array([len(d) for d in diffs])
            shared = overlaps(np.repeat(np.arange(len(diffs)), sizes), np.concatenate(diffs), len(diffs))
            apart = sizes[:, None] + sizes[None, :] - 2 * shared
            total = part["size"].to_numpy(np.int64)[:, None] + part["size"].to_numpy(np.int64)[None, :]
            i, j = np.nonzero(np.triu(_apart(part) & ((total - apart) / (total + apart) >= similarity)))
            root = part["root"].to_numpy()
            up: dict[int, int] = {}

            def end(x: int, up: dict[int, int] = up) -> int:
                while x in up:
                    x = up[x]
                return x

            for a, b in {(min(a, b), max(a, b)) for a, b in zip(root[i].tolist(), root[j].tolist(), strict=True)}:
                x, y = end(a), end(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.add((a, b))
        give_back()
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    last, _ = written(components(_grouped(differing, wide="diff").applyInPandas(linked, "a bigint, b bigint")), "components")
    out = _rooted(prints.select("doc_id").distinct(), first, "doc_id")
    for merge in (found, last):
        out = _rooted(out, merge, "root")
    return out.select("doc_id", F.col("root").alias("component_id"))
