"""SentencePiece models in numpy: words of equal length are encoded together."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Longer words are encoded one at a time; the tables of a batch grow with its words' length.
LONGEST = 192
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Word -> its number, in the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A ``.model`` file: pieces, scores, kind and normalizer, with encoding and decoding."""

    def __init__(self, path: str, limit: int = 400_000):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts, scores, kinds = [], [], []
        self.kind, self.dummy_prefix, self.trims, charsmap = UNIGRAM, True, True, b""
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.texts.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(fields(value))
                charsmap, self.dummy_prefix, self.trims = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        self.plain = not charsmap and not self.trims
        self.scores, self.kinds = np.array(scores, dtype=np.float32), np.array(kinds)
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        at = np.flatnonzero(self.kinds == BYTE)
        self.bytes = {int(self.texts[i][3:5], 16): int(i) for i in at}
        usable = np.flatnonzero(np.isin(self.kinds, (NORMAL, USER, UNUSED)))
        self.longest = max((len(self.texts[i]) for i in usable), default=1)
        self.by_text: dict[str, int] = {}
        for i in usable.tolist():
            self.by_text.setdefault(self.texts[i], i)
        self._plant()
        # the best sum's gains; byte-pair scores are ranks, whose sums single precision rounds in long words, and the library adds those of unigram models in single precision
        normal = self.scores[self.kinds == NORMAL]
        self.low = float((normal.min() if len(normal) else np.float32(0)) - np.float32(10))
        self.merits = np.append(self.scores, np.float32(-np.inf))  # the last one is that of no piece, -1
        self.gains = np.append(np.where(self.kinds == UNUSED, -np.inf, self.scores), -np.inf).astype(np.float32 if self.kind == UNIGRAM else np.float64)
        # words are independent if no piece holds a space mark after another character, and no piece is taken whole before merging
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", self.texts[i]) for i in usable) and not (self.kinds == USER).any() and not (self.kind == BPE and (self.kinds == UNUSED).any())
        self.limit = limit
        spelled = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL,) else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, kinds, strict=True)]
        self.spelled, self.spelled_at = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)])
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        # ids one word after another and where each begins, of the library's and of best sums; the same for unigram models
        self.stores = [(array("i"), array("q", [0])) for _ in range(2 if self.kind == BPE else 1)]

    def _plant(self) -> None:
        """A tree of all pieces' characters: its edges, keyed by node and character, in one open-addressed table."""
        edges: dict[int, int] = {}
        owner = [-1]
        for text, i in self.by_text.items():
            node = 0
            for c in text:
                key = node << 21 | ord(c)
                node = edges.get(key, -1)
                if node < 0:
                    edges[key] = node = len(owner)
                    owner.append(-1)
            if text:
                owner[node] = i
        bits = max(4, (4 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys, nodes = [-1] * (1 << bits), [-1] * (1 << bits)
        for key, node in edges.items():
            at = (key * int(SPREAD) & 2**64 - 1) >> 64 - bits
            while keys[at] >= 0:
                at = at + 1 & self.mask
            keys[at], nodes[at] = key, node
        self.edges, self.nodes, self.owner = np.array(keys, np.int64), np.array(nodes, np.int32), np.array(owner, np.int32)

    def _onward(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to, -1 for none."""
        keys = nodes.astype(np.int64) << 21 | codes
        at = (keys.view(np.uint64) * SPREAD >> self.shift).view(np.int64)
        found = self.edges[at]
        other = np.flatnonzero((found != keys) & (found >= 0))
        while len(other):
            at[other] = at[other] + 1 & self.mask
            found[other] = self.edges[at[other]]
            other = other[(found[other] != keys[other]) & (found[other] >= 0)]
        return np.where(found == keys, self.nodes[at], -1)

    def normalized(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def _substrings(self, codes: np.ndarray) -> np.ndarray:
        """The id of the piece that each substring is, -1 for none: lengths (from 1, up to the longest found) x starts x words. Only what begins some piece is followed further."""
        length, n = codes.shape
        flat, out = codes.ravel(), []
        at, node = np.arange(length * n), np.zeros(length * n, np.int32)
        for size in range(1, min(self.longest, length) + 1):
            node = self._onward(node, flat[at + (size - 1) * n])
            some = node >= 0
            at, node = at[some], node[some]
            if size > 1 and not len(at):
                break
            out.append(np.full(length * n, -1, np.int32))
            out[-1][at] = self.owner[node]
            some = at < (length - size) * n
            at, node = at[some], node[some]
        return np.concatenate(out).reshape(-1, length, n)

    def _viterbi(self, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and piece (-1: none) of the parts of all words, by best sums of scores. Every position takes, over all words at once, the best of the pieces that end there; the longest of equal ones counts."""
        most, length, n = sub.shape
        gains = self.gains[sub]
        gains[0][gains[0] == -np.inf] = self.low
        best = np.full((length + 1, n), -np.inf, dtype=gains.dtype)
        best[0] = 0
        size = np.ones((length + 1, n), np.int32)
        for end in range(1, length + 1):
            for k in range(min(most, end), 0, -1):
                score = best[end - k] + gains[k - 1, end - k]
                better = score > best[end]
                np.copyto(best[end], score, where=better)
                np.copyto(size[end], k, where=better)
        cuts = np.zeros((n, length + 1), dtype=bool)
        rows, at = np.arange(n), np.full(n, length)
        while len(rows):
            cuts[rows, at] = True
            at = at - size[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        row, end = np.nonzero(cuts)
        own = size[end, row]
        piece = sub[own - 1, end - own, row]
        return row, end - own, np.where(self.gains[piece] == -np.inf, -1, piece)

    def _merge(self, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and piece (-1: none) of the parts of all words, by byte-pair merges: in each step every word joins its best-scored pair of neighbours, the left one of equal pairs."""
        most, length, n = sub.shape
        wide = length + 2
        # by start of a symbol: its end (0: none starts here), the start before it, what joining it to the next one scores; the last column takes what has no place
        ends = np.tile(np.r_[np.arange(1, length + 1), 0, 0].astype(np.int32), (n, 1))
        before = np.tile(np.r_[wide - 1, np.arange(length), wide - 1].astype(np.int32), (n, 1))
        scores = np.full((n, wide), -np.inf, np.float32)
        if most > 1:
            scores[:, :length] = self.merits[sub[1].T]
        live, flat = np.arange(n), sub.ravel()

        def joined(start: np.ndarray, end: np.ndarray, ok: np.ndarray) -> np.ndarray:
            size = end - start
            ok = ok & (size <= most)
            at = ((np.where(ok, size, 1) - 1) * length + np.where(ok, start, 0)) * n + live
            return np.where(ok, self.merits[flat[at]], -np.inf)

        while len(live):
            best = scores[live].argmax(axis=1)
            some = scores[live, best] > -np.inf
            live, best = live[some], best[some]
            middle = ends[live, best]
            end = ends[live, middle]
            left, after = before[live, best], ends[live, end]
            ends[live, best], ends[live, middle] = end, 0
            before[live, end] = best
            scores[live, middle] = -np.inf
            scores[live, best] = joined(best, after, after > 0)
            scores[live, left] = joined(left, end, left < wide - 1)
        row, start = np.nonzero(ends)
        size = ends[row, start] - start
        return row, start, sub[size - 1, start, row]

    def _long(self, word: str, best: bool) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece (-1: none) of the parts of one word of any length: what ``_viterbi`` or ``_merge`` finds, from place to place and with memory that grows with the word only."""
        length, find = len(word), self.by_text.get
        if best:
            kind = "f" if self.gains.dtype == np.float32 else "d"
            gains, low, cell = self.gains.tolist(), self.low, array(kind, [0])
            sums, sizes, own = array(kind, [-np.inf]) * (length + 1), array("i", [1]) * (length + 1), array("i", [-1]) * (length + 1)
            sums[0] = 0
            for start in range(length):
                held = sums[start]
                for size in range(1, min(self.longest, length - start) + 1):
                    i = find(word[start : start + size], -1)
                    gain = gains[i]
                    if gain == -np.inf:
                        if size > 1:
                            continue
                        i, gain = -1, low
                    cell[0] = held + gain
                    if cell[0] > sums[start + size]:
                        sums[start + size], sizes[start + size], own[start + size] = cell[0], size, i
            starts, parts, at = [], [], length
            while at:
                parts.append(own[at])
                at -= sizes[at]
                starts.append(at)
            return np.array(starts[::-1], np.int64), np.array(parts[::-1], np.int32)
        merits, ends, before = self.merits.tolist(), array("i", range(1, length + 1)), array("i", range(-1, length))
        pairs: list[tuple[float, int, int, int]] = []

        def offer(start: int, middle: int, end: int) -> None:
            i = find(word[start:end], -1) if end - start <= self.longest else -1
            if i >= 0:
                heappush(pairs, (-merits[i], start, middle, end))

        for start in range(length - 1):
            offer(start, start + 1, start + 2)
        while pairs:
            _, start, middle, end = heappop(pairs)
            if ends[start] != middle or ends[middle] != end:
                continue
            ends[start], ends[middle], before[end] = end, 0, start
            if end < length:
                offer(start, end, ends[end])
            if start:
                offer(before[start], start, end)
        at = np.flatnonzero(np.frombuffer(ends, np.int32))
        return at, np.array([find(word[k : ends[k]], -1) for k in at.tolist()], np.int32)

    def _spelled(self, codes: np.ndarray, row: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and ids of parts that begin with ``codes``; characters without a piece (-1) become bytes, or one unknown for neighbours in a row."""
        odd = piece < 0
        if not odd.any():
            return row, piece
        if not self.bytes:
            kept = np.r_[True, ~(odd[1:] & odd[:-1] & (row[1:] == row[:-1]))]
            return row[kept], np.where(odd, self.unknown, piece)[kept]
        n = np.where(odd, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 1)
        at = np.repeat(np.arange(len(n)), n)
        k, n, c = np.arange(len(at)) - (np.cumsum(n) - n)[at], n[at], codes[at]
        lead = np.where(n == 1, c, (0xF00 >> n) & 0xFF | c >> 6 * (n - 1))
        byte = np.where(k == 0, lead, 0x80 | (c >> 6 * (n - 1 - k)) & 0x3F) & 0xFF
        return row[at], np.where(odd[at], np.array([self.bytes[b] for b in range(256)], np.int32)[byte], piece[at])

    def encode_words(self, words: list[str], kinds: tuple[bool, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of normalized words, one after another, and how many each has: for False the library's, for True those of the best sum of scores, which are the same for unigram models.

        Words of one length go together, and both ways share their pieces' lookup. The tables of a batch
        grow with its words' length, so words over ``LONGEST`` characters go one at a time by
        the same rules, with the same result.
        """
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in kinds]
        for length, at in by_length.items():
            if not length:
                continue
            step = max(1, 400_000 // (length * min(length, self.longest))) if length <= LONGEST else 1
            for k in range(0, len(at), step):
                some = np.array(at[k : k + step])
                codes = np.frombuffer("".join([words[i] for i in at[k : k + step]]).encode("utf-32-le"), dtype="<u4").reshape(len(some), length).astype(np.int64)
                sub = self._substrings(np.ascontiguousarray(codes.T)) if length <= LONGEST else None
                for best, out in zip(kinds, found, strict=True):
                    searched = best or self.kind != BPE
                    if sub is None:
                        start, piece = self._long(words[at[k]], searched)
                        row = np.zeros(len(start), np.int64)
                    else:
                        row, start, piece = self._viterbi(sub) if searched else self._merge(sub)
                    row, ids = self._spelled(codes[row, start], row, piece)
                    out.append((some[row], ids))
        made = []
        for out in found:
            word = np.concatenate([np.empty(0, np.int64), *(w for w, _ in out)])
            ids = np.concatenate([np.empty(0, np.int32), *(i for _, i in out)])
            made.append((ids[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))))
        return made

    def both(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of whole texts: the library's and those of the best sum of scores. Each distinct word of the batch is encoded once, and kept for later batches."""
        if not self.by_word:
            whole = [self.encode_words([self.normalized(t or "")], (True,))[0][0] for t in texts]
            return [(np.array(self.library.encode(t or ""), dtype=np.int32), ids) for t, ids in zip(texts, whole, strict=True)]
        if len(self.known) > self.limit or len(self.known) != len(self.stores[0][1]) - 1:  # full, or left by an error
            self.forget()
        split = [PIECE_WORD.findall(self.normalized(t or "")) for t in texts]
        before = len(self.known)
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        new = list(islice(self.known, before, None))
        if new:
            for (flat, starts), (ids, sizes) in zip(self.stores, self.encode_words(new, (False, True)[: len(self.stores)]), strict=True):
                flat.frombytes(ids.tobytes())
                starts.frombytes((starts[-1] + np.cumsum(sizes)).tobytes())
        cuts, made = np.cumsum([len(w) for w in split])[:-1], []
        for flat, starts in self.stores:
            ids, ends = _gathered(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32), np.frombuffer(starts, np.int64), rows)
            made.append(np.split(ids, np.r_[0, ends][cuts]) if split else [])
        return list(zip(made[0], made[-1], strict=True))

    def encode(self, texts: list[str | None], best: bool = False) -> list[np.ndarray]:
        """Ids of whole texts: the library's, or with ``best`` those of the best sum of scores."""
        return [pair[best] for pair in self.both(texts)]

    def decode(self, ids) -> str:
        """The text of ids: control pieces vanish, byte pieces join to characters, the dummy prefix goes."""
        data = _gathered(self.spelled, self.spelled_at, np.asarray(ids, dtype=np.int64))[0].tobytes()
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


PIECE_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _gathered(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``flat[starts[r]:starts[r + 1]]`` of all rows, one after another, and where each ends."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def by_size(texts: list[str | None], most: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts in runs of about ``most`` characters, which bounds the words that are split at a time."""
    run: list[str | None] = []
    held = 0
    for t in texts:
        run.append(t)
        held += len(t or "")
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


_OPEN: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _OPEN:
        _OPEN[path] = PieceModel(path)
    return _OPEN[path]


def encode(text: Column, model: str, best: bool = False) -> Column:
    """Ids of whole texts as the library gives them, without added pieces; null and empty texts have none.

    Unigram models are segmented by the batched Viterbi search. Byte-pair models define their
    ids by the order of merges, which a search for the best sum does not reproduce, so for them
    the same batches and piece lookups drive batched merges instead. With ``best`` the ids are those of the
    Viterbi search for models of either kind.
    """

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = piece_model(model)
        for texts in batches:
            out: list[np.ndarray] = []
            for some in by_size(list(texts)):
                out += own.encode(some, best)
            yield pd.Series(out, dtype=object)

    return run(F.coalesce(text, F.lit("")))


def decode(ids: Column, model: str) -> Column:
    """The text of an array of ids; null gives null, an empty array the empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = piece_model(model)
        for rows in batches:
            yield pd.Series([None if r is None else own.decode(r) for r in rows], dtype=object)

    return run(ids)


def crc32_of_ids(ids: Column) -> Column:
    """CRC-32, unsigned, of ids as little-endian unsigned 32-bit numbers."""

    @F.pandas_udf("long")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.asarray(r, dtype="<u4").tobytes()) for r in rows], dtype="int64")

    return run(F.coalesce(ids, F.array().cast("array<int>")))


def encoded_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole texts encoded, one row per row: ``doc_id, n_pieces, ids_crc32, n_best, best_crc32, round_trip``.

    ``n_pieces`` and ``ids_crc32`` are of the library's ids, ``n_best`` and ``best_crc32`` of those that the
    Viterbi search gives with the model's pieces and scores: the same for unigram models, another
    segmentation of some texts for byte-pair ones. ``round_trip`` says whether decoding either gives the
    text back. Null texts are empty; an empty table gives an empty table.
    """

    @F.pandas_udf("struct<n:int,crc:bigint,n_best:int,best_crc:bigint,same:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = piece_model(model)
        for texts in batches:
            out = []
            for some in by_size(list(texts)):
                for t, (ids, best) in zip(some, own.both(some), strict=True):
                    out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(best), zlib.crc32(best.astype("<u4").tobytes()), own.decode(ids) == t == own.decode(best)))
            yield pd.DataFrame(out, columns=["n", "crc", "n_best", "best_crc", "same"])

    made = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), run(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_made"))
    return made.select("doc_id", F.col("_made.n").alias("n_pieces"), F.col("_made.crc").alias("ids_crc32"), F.col("_made.n_best").alias("n_best"), F.col("_made.best_crc").alias("best_crc32"), F.col("_made.same").alias("round_trip"))
