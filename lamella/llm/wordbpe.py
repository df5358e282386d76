"""Token ids and counts of whole texts, equal to the tokenizer library's, without encoding the same word twice."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from lamella.llm.shared import claim

# The shape of the tokenizer file that may be split at white space.
WHITE_SPACE_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
PRE_TOKEN_REGEX = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LETTERS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The same pre-tokens in Latin-1 without white space.
LATIN_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼-¾]|[^A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+")

#: Latin-1 characters that Python and the library may not take alike as white space or text.
UNSAFE = bytes([*range(9), *range(14, 32), *range(127, 161)])


def latin(text: str) -> bool:
    """Whether Python's own lower case and split are the library's normalizer and white space: Latin-1 without ``UNSAFE`` characters."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(data.translate(None, UNSAFE)) == len(data)


class _Parts(dict):
    """Pre-token -> its ids as bytes, four each, for those that stand beside others in words; forgotten beyond a limit."""

    def __init__(self, owner: WholeText, limit: int):
        super().__init__()
        self.owner, self.limit = owner, limit

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[part] = out = array("I", self.owner.piece_ids(part)).tobytes()
        return out


class _Words(dict):
    """Word -> its ids as bytes, four each; a missing word is encoded once and kept."""

    def __init__(self, owner: WholeText, limit: int):
        super().__init__()
        self.owner, self.limit, self.parts = owner, limit, _Parts(owner, limit)

    def __missing__(self, word: str) -> bytes:
        parts = self.owner.pre_tokens(word)
        if len(parts) == 1:
            out = array("I", self.owner.piece_ids(parts[0])).tobytes()
        else:
            out = b"".join(map(self.parts.__getitem__, parts))
        self[word] = out
        return out

    def clear(self) -> None:
        super().clear()
        self.parts.clear()


class WholeText:
    """A tokenizer file (``.json`` for tokenizers, ``.model`` for sentencepiece), called as the library is by default, without added special tokens.

    For files of the white-space kind, words between white space are encoded independently of
    their neighbours by construction (white space is dropped and no pre-token contains any), in
    any script. A text is normalized once, by the file's own normalizer unless it is plain
    Latin-1, and split into words; each distinct word goes through the file's own pre-tokenizer
    and model once and is looked up after that. At most ``limit`` words are kept; beyond that the
    store is emptied and refilled. Texts go to the library whole for files of another kind only.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: pieces.encode(text)
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = made.get("added_tokens") or []
        plain = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        self.by_word = plain and (made.get("normalizer") or {}).get("normalizers") == WHITE_SPACE_NORMALIZER and (steps[0].get("pattern") or {}).get("Regex") == PRE_TOKEN_REGEX
        self.latin = self.by_word and steps == [{"type": "Split", "pattern": {"Regex": PRE_TOKEN_REGEX}, "behavior": "Removed", "invert": True}, BYTE_LETTERS]
        self.tokenizer, self.words = tokenizer, _Words(self, limit)
        self.letters = {c: "".join(part for part, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(161, 256)} if self.latin else {}
        self.special = {t["content"]: t["id"] for t in added}
        self.apart = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if added else None

    def split(self, text: str | None) -> list[str]:
        """The normalized words of a text; a special token's string is a word by itself, marked by a space before it."""
        text = text or ""
        parts = self.apart.split(text) if self.apart and any(t in text for t in self.special) else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(" " + part)
            elif latin(part):
                out += part.lower().split()
            else:
                out += filter(None, self.tokenizer.normalizer.normalize_str(part).split(" "))
        return out

    def pre_tokens(self, word: str) -> list[str]:
        """What the model sees of a word: its pre-tokens, in the letters that stand for bytes."""
        if self.latin and word[:1] != " ":
            if word.isascii() and word.isalpha():
                return [word]
            if latin(word):
                parts = LATIN_PRE_TOKEN.findall(word)
                return parts if word.isascii() else [part.translate(self.letters) for part in parts]
        return [word] if word[:1] == " " else [part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]

    def piece_ids(self, pre_token: str) -> list[int]:
        return [self.special[pre_token[1:]]] if pre_token[:1] == " " else [t.id for t in self.tokenizer.model.tokenize(pre_token)]

    def ids(self, text: str | None) -> np.ndarray:
        if not self.by_word:
            return np.array(self.whole(text or ""), dtype=np.uint32)
        if len(claim(self.words)) > self.words.limit:
            self.words.clear()
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), dtype=np.uint32)


_OPEN: dict[str, WholeText] = {}


def whole_text(path: str) -> WholeText:
    """One per Python worker; a worker that serves many tasks keeps what it has encoded."""
    if path not in _OPEN:
        _OPEN[path] = WholeText(path)
    return _OPEN[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
