"""Near-duplicate passages across documents, by compact windows of token min-hashes."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.shared import claim, delete_path, fresh, give_back, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Pairs with one source that are joined with one copy of its text.
GROUP = 400
SPANS = "array<struct<start:int,end:int,source_start:int,source_end:int,similarity:double>>"


@dataclass(frozen=True)
class Settings:
    """``words``: of a shingle, the token that is hashed. ``passage``: least words of a passage.
    ``hashes``: min-hash functions; ``enough``: how many of them must agree on one aligned
    window before a pair is verified. ``similarity``: least Jaccard index of the two passages'
    shingle sets."""

    words: int = 5
    passage: int = 50
    hashes: int = 4
    enough: int = 2
    similarity: float = 0.8

    @property
    def window(self) -> int:
        return self.passage - self.words + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A 64-bit value of each byte, the same for both cases of A-Z; none for what separates words.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_BYTES[[*range(9, 14), 32]] = 0
_BASE = 0xC4CEB9FE1A85EC53
#: Bytes of a text that are hashed at a time, if no word is longer.
SLICE = 1 << 17
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1 and maybe more, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, SLICE), base, np.uint64)
        out[0] = 1
        out = np.cumprod(out)
        if n > SLICE:
            return out
        _POWERS[base] = out
    return _POWERS[base]


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, whatever the case of A-Z: its bytes' values by powers of a base, for all words by one running sum."""
    text, at, out = text or b"", 0, []
    claim(_POWERS)
    while at < len(text):
        end = len(text)
        if end - at > SLICE:  # up to the end of a word
            cut = SPACE.search(text, at + SLICE)
            end = cut.start() if cut else end
        values = _BYTES[np.frombuffer(text, np.uint8, end - at, at)]
        inside = np.zeros(len(values) + 2, np.int8)
        inside[1:-1] = values != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, len(values))[: len(values)], out=sums[1:])
        starts, ends = edges[::2], edges[1::2]
        out.append(mixed((sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), len(values))[starts]))
        at = end
    return out[0] if len(out) == 1 else np.concatenate([np.empty(0, np.uint64), *out])


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """A 64-bit hash of the words from each place of a text on; empty if there are too few words."""
    h = word_hashes(text)
    n = len(h) - words + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mixed(out)


def placed(values: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """The values with their last bits replaced by their places, so that none are equal, and the mask of those bits: 24, more in texts of more places."""
    mask = np.uint64((1 << max(24, len(values).bit_length())) - 1)
    return (values & ~mask) | np.arange(len(values), dtype=np.uint64), mask


def running_least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // window) * window, ~np.uint64(0))
    padded[:n] = values
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - window + 1], ahead[window - 1 : n])


def compact_windows(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``centre, left, right`` of all compact windows that hold a subsequence of ``window`` places or more.

    All subsequences from within ``[left, centre]`` to within ``[centre, right]`` have their
    minimum at ``centre`` (the first place, of equal ones). They are the nodes of the Cartesian tree over
    ``values`` whose ranges are long enough: a place has such a range exactly if it is the
    minimum of some ``window`` places in a row, and the nearest smaller places that bound the
    range are then such minima too, so a running minimum finds the nodes and one pass with a
    stack over them finds the ranges.
    """
    n = len(values)
    if n < window:
        return (np.empty(0, np.int64),) * 3
    own, mask = placed(values)
    least = running_least(own, window)
    least = least[np.r_[True, least[1:] != least[:-1]]]
    centre = (least & mask).astype(np.int64)
    keys, at = least.tolist(), centre.tolist()
    left, right = [0] * len(at), [n - 1] * len(at)
    stack: list[int] = []
    for i, key in enumerate(keys):
        while stack and keys[stack[-1]] > key:
            right[stack.pop()] = at[i] - 1
        if stack:
            left[i] = at[stack[-1]] + 1
        stack.append(i)
    return centre, np.array(left), np.array(right)


def _salts(s: Settings) -> np.ndarray:
    """What makes one hash of a shingle into that of each hash function."""
    return mixed(np.arange(1, s.hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _windows(docs: DataFrame, s: Settings) -> DataFrame:
    """``key, doc_id, place``: a row per document, hash function and compact window.

    ``place`` holds the window's centre, how far it goes to the left and right (never more than
    needed for subsequences of the least length; the farthest of the document's windows with that key),
    and the number of the hash function.
    """
    salts, most = _salts(s), s.window - 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, places = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = shingles(text.as_py(), s.words)
                if len(own) < s.window:
                    continue
                repeats = len(np.unique(own)) < len(own)
                for j, salt in enumerate(salts):
                    values = mixed(own ^ salt)
                    c, left, right = compact_windows(values, s.window)
                    keys.append(values[c])
                    back, on = np.minimum(c - left, most), np.minimum(right - c, most)
                    if repeats:  # a key at several places goes as far as any of them
                        _, which = np.unique(values[c], return_inverse=True)
                        for reach in (back, on):
                            widest = np.zeros(which.max() + 1, reach.dtype)
                            np.maximum.at(widest, which, reach)
                            reach[:] = widest[which]
                    places.append(((c * 1024 + back) * 1024 + on) * 16 + j)
                    ids.append(np.full(len(c), doc_id))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(places).astype(np.int64))],
                    names=["key", "doc_id", "place"],
                )
        give_back()

    if s.hashes > 16 or s.window > 1024:
        raise ValueError("at most 16 hash functions and windows of 1024 shingles")
    return docs.mapInArrow(of, "key bigint, doc_id bigint, place bigint")


def _agreeing(pairs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, source`` of pairs in which enough hash functions agree on a window of ``doc_id``.

    Each element of ``found`` says which starts of windows have the same minimum in both
    documents, for one hash function. Those of one function don't overlap, so the depth of
    overlap at a start is the number of functions that agree there.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            first, last = flat.field("first").to_numpy(zero_copy_only=False), flat.field("last").to_numpy(zero_copy_only=False)
            pair = np.repeat(np.arange(len(sizes)), sizes)
            at = np.concatenate([first, last + 1])
            step = np.repeat([1, -1], len(first))
            order = np.lexsort((step, at, np.concatenate([pair, pair])))
            depth = np.cumsum(step[order])
            deepest = np.maximum.reduceat(depth, np.r_[0, np.cumsum(2 * sizes)[:-1]]) if len(sizes) else np.empty(0)
            yield batch.select(["doc_id", "source"]).filter(pa.array(deepest >= s.enough))

    return pairs.mapInArrow(sweep, "doc_id bigint, source bigint")


def _grams(crowded: DataFrame, s: Settings) -> DataFrame:
    """``gram, doc_id``: keys of the places of a text that may lack their first holder as a partner.

    Two documents with the same passage have the same minimum there for all functions, with an edited
    one for most. If fewer than ``enough`` of them made the pair meet, the others are also held by an
    earlier document, so the passage starts where that many windows with three holders or more overlap.
    The keys at such a start are the run of ``passage`` words there and, for each two functions, both
    minima of the window there: an earlier document that has one of the two lines that they come
    from does not have the key.
    """
    offsets = [*range(0, s.window - 1, s.words), s.window - 1]
    salts, odd = _salts(s), np.uint64(0xD6E8FEB86659FD93)
    twos = [(i, j) for j in range(s.hashes) for i in range(j)]

    def keys(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
        run = np.zeros(len(starts), np.uint64)
        for k in offsets:
            run = run * odd + own[starts + k]
        least = []
        for salt in salts:
            values = mixed(own ^ salt)
            with_place, mask = placed(values)
            least.append(values[(running_least(with_place, s.window)[starts] & mask).astype(np.int64)])
        # neighbouring starts mostly share their minima; what else repeats meets in the aggregation
        turns = [x[1:] != x[:-1] for x in (run, *least)]
        out = [mixed(run[np.r_[True, turns[0]]])]
        for i, j in twos:
            new = np.r_[True, turns[i + 1] | turns[j + 1]]
            out.append(mixed(mixed(least[i][new] * odd + least[j][new]) + np.uint64(i * s.hashes + j)))
        return np.concatenate(out)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams = [], []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = shingles(text.as_py(), s.words)
                n = len(own) - s.window + 1
                if n < 1:
                    continue
                steps = np.zeros(n + 1, np.int64)
                first, last = (found.values.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
                inside = (last >= 0) & (first < n) & (first <= last)
                np.add.at(steps, np.maximum(first[inside], 0), 1)
                np.add.at(steps, np.minimum(last[inside] + 1, n), -1)
                starts = np.flatnonzero(np.cumsum(steps[:n]) > s.hashes - s.enough)
                if len(starts):
                    grams.append(keys(own, starts))
                    ids.append(np.full(len(grams[-1]), doc_id))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64))], names=["gram", "doc_id"])
        give_back()

    return crowded.mapInArrow(of, "gram bigint, doc_id bigint")


def matching_passages(x: np.ndarray, y: np.ndarray, s: Settings, order: np.ndarray | None = None) -> list[dict]:
    """Spans of words in ``x`` that are near-duplicates of spans in ``y``, both given as shingle hashes.

    Places of x whose shingle is in y form runs, each pointing at a stretch of y. Runs join over
    gaps of up to a window. A joined span counts if it has enough words, its share of places
    found is what two passages of that Jaccard index have (2s / (1 + s)), the stretch of y is not
    shorter than ``similarity`` of the least passage (sets alone don't tell one word said ten times from a
    hundred), and the Jaccard index of both spans' shingles reaches ``similarity``; if not, it is split at its widest gap and both
    parts are tried, down to single runs. So every common stretch of enough words is found, alone or
    within a longer span. Ends are word numbers, exclusive. ``order`` sorts y, if that is known.
    """
    if not len(x) or not len(y):
        return []
    order = np.argsort(y, kind="stable") if order is None else order
    ranks = np.minimum(np.searchsorted(y, x, sorter=order), len(y) - 1)
    to = order[ranks]
    hit = y[to] == x
    ordered = y[order]
    several = hit & (ordered[np.minimum(ranks + 1, len(y) - 1)] == x) & (ranks + 1 < len(y))
    choices = np.flatnonzero(several[1:] & hit[:-1]) + 1
    if len(choices):  # of equal shingles, the one that goes on where the place before points
        follow, wanted, there = to.tolist(), x.tolist(), y.tolist()
        for i in choices.tolist():
            on = follow[i - 1] + 1
            if on < len(y) and there[on] == wanted[i]:
                follow[i] = on
        to = np.array(follow)
    turn = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1]) | hit[1:] & (to[1:] != to[:-1] + 1), True])
    runs = [(i, j) for i, j in zip(turn[:-1].tolist(), turn[1:].tolist(), strict=True) if hit[i]]
    share = 2 * s.similarity / (1 + s.similarity)
    hits = np.r_[0, np.cumsum(hit)]
    groups: list[list[tuple[int, int]]] = []
    for run in runs:
        if not groups or run[0] - groups[-1][-1][1] > s.window:
            groups.append([])
        groups[-1].append(run)
    out = []
    while groups:
        group = groups.pop()
        start, end = group[0][0], group[-1][1]
        if end - start < s.window:
            continue
        if hits[end] - hits[start] >= share * (end - start):
            places = np.flatnonzero(hit[start:end]) + start
            shift = to[places] - places
            near = places[np.abs(shift - np.sort(shift)[len(shift) // 2]) <= (end - start) // 4 + 4]
            low, high = int(to[near].min()), int(to[near].max()) + 1
            a, b = np.unique(x[start:end]), np.unique(y[low:high])
            both = len(np.intersect1d(a, b, assume_unique=True))
            similarity = both / (len(a) + len(b) - both)
            if similarity >= s.similarity and high - low >= s.similarity * s.window:
                out.append({"start": start, "end": end + s.words - 1, "source_start": low, "source_end": high + s.words - 1, "similarity": similarity})
                continue
        if len(group) > 1:
            edges = np.array(group)
            gaps = edges[1:, 0] - edges[:-1, 1]
            k = int(np.lexsort((np.abs(to[edges[1:, 0]] - to[edges[:-1, 1] - 1]), gaps))[-1]) + 1
            groups += [group[:k], group[k:]]
    return sorted(out, key=lambda o: o["start"])


def repeated_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, digest, source, spans``: documents with passages that a document of smaller id has too.

    Windows of all documents that share a min-hash meet; the document with the smallest id among
    them stands for the group, so a passage that thousands of documents share costs each of them
    one row and no pairs. A pair whose windows agree in enough hash functions is verified on both
    whole texts. The smallest holder of a passage never appears as ``doc_id`` for it, so cutting
    the spans leaves the first occurrence.

    ``spans`` are in words (runs without the bytes 9-13 and 32), ends exclusive; ``digest`` is the
    MD5 of the text that they belong to. Documents are compared with the first holder of each of
    their min-hashes and, where these have more holders, with the first holder of each run of
    ``passage`` words and of each two min-hashes of a window, which is how the work stays linear and no run
    of equal words is missed. A source that many documents share is dealt, with copies of its
    text, to several groups. Null ids, null and short texts have no
    passages; repeats within one id are no result; an empty table gives an empty table.
    """
    s = settings
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    windows, windows_path = written(_windows(docs.filter(F.octet_length("text") >= 2 * s.passage - 1), s), "windows")
    groups = windows.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_last"), F.min_by("place", "doc_id").alias("_place"), F.count(F.lit(1)).alias("_n"))
    # written, so that the join below is one of two plain exchanges, which Spark splits where a key is hot
    firsts, _ = written(groups.filter("source < _last").select("key", "source", "_place", "_n"), "firsts")
    centre = lambda p: F.shiftright(p, 24)
    back = lambda p: F.shiftright(p, 14).bitwiseAND(1023)
    on = lambda p: F.shiftright(p, 4).bitwiseAND(1023)
    met, _ = written(windows.join(firsts, "key").select("doc_id", "place", "source", "_place", "_n"), "met")
    delete_path(df.sparkSession, windows_path)
    aligned = (
        met.filter("doc_id <> source")
        .select(
            "doc_id",
            "source",
            (centre("place") - F.least(back("place"), back("_place"))).cast("int").alias("first"),
            (centre("place") + F.least(on("place"), on("_place")) - (s.window - 1)).cast("int").alias("last"),
        )
        .filter("first <= last")
    )
    agreeing, _ = written(_agreeing(aligned.groupBy("doc_id", "source").agg(F.collect_list(F.struct("first", "last")).alias("found")), s), "agreeing")
    reach = F.struct((centre("place") - back("place")).cast("int").alias("first"), (centre("place") + on("place") - (s.window - 1)).cast("int").alias("last"))
    crowds, _ = written(met.filter("_n > 2").groupBy("doc_id").agg(F.collect_list(reach).alias("found")), "crowds")
    grams, _ = written(_grams(docs.join(crowds.hint("merge"), "doc_id"), s), "grams")
    holders = grams.groupBy("gram").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_last"))
    held, _ = written(holders.filter("source < _last").select("gram", "source"), "holders")
    runs = grams.join(held, "gram").filter("doc_id <> source").select("doc_id", "source")
    pairs, _ = written(agreeing.union(runs).distinct(), "pairs")

    @F.pandas_udf(SPANS)
    def verify(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out, last, own, order = [], None, None, None
        for x, y in zip(xs, ys, strict=True):  # rows of one source follow each other, so its text is hashed and sorted once
            if y != last:
                last, own = y, shingles(y, s.words)
                order = np.argsort(own, kind="stable")
            out.append(matching_passages(shingles(x, s.words), own, s, order))
        return pd.Series(out)

    # pairs grow with the corpus, so they are never broadcast; a source is joined in groups of bounded size
    sources = pairs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("_groups"))
    sources, _ = written(sources, "sources")
    dealt = pairs.join(sources.hint("merge"), "source").select(F.col("doc_id").alias("_id"), "source", F.pmod(F.xxhash64("doc_id"), F.col("_groups")).cast("int").alias("_group"))
    copies = sources.hint("merge").join(docs, F.col("source") == F.col("doc_id")).select(F.col("source").alias("_source"), F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_copy"), F.col("text").alias("_y"))
    own = docs.join(dealt.hint("merge"), F.col("doc_id") == F.col("_id")).select("_id", "source", "_group", F.col("text").alias("_x"))
    both = own.hint("merge").join(copies.hint("merge"), (F.col("source") == F.col("_source")) & (F.col("_group") == F.col("_copy")))
    return both.select(F.col("_id").alias("doc_id"), F.md5("_x").alias("digest"), "source", verify("_x", "_y").alias("spans")).filter("size(spans) > 0")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the given spans of words; what separates words stays on the side it is on."""
    places = array("q")
    for m in WORD.finditer(text):
        places.extend(m.span())
    out, at = [], 0
    for start, end in sorted(spans):
        low, high = places[2 * start], places[2 * end - 1]
        if low > at:
            out.append(text[at:low])
        at = max(at, high)
    out.append(text[at:])
    return b"".join(out)


def without_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """``df`` with repeated passages cut from every document but the first that holds them.

    All rows and columns stay, whatever their names; texts without repeats, null ids and null texts are
    untouched; an empty table gives an empty table.
    """
    found = repeated_passages(df, text, doc_id, settings)
    (id_, digest, mine), body = fresh(df, "_id", "_digest", "_spans"), F.col(f"`{text}`")
    spans = found.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("all"))
    spans, _ = written(spans.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(mine)), "spans")

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        return pd.Series([t if x is None else cut(t.encode(), [(y["start"], y["end"]) for y in x]).decode() for t, x in zip(texts, all_spans, strict=True)])

    joined = df.join(spans, (F.col(f"`{doc_id}`").cast("long") == F.col(id_)) & (F.md5(body.cast("binary")) == F.col(digest)), "left")
    cut_text = F.when(F.col(mine).isNull(), body).otherwise(shorten(body, mine))
    return joined.select(*[cut_text.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
