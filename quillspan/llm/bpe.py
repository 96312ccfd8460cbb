"""BPE encoding and decoding (operator 6).

A word's pieces live in contiguous arrays: part boundaries, piece ids and the ranks of adjacent
pairs. The smallest rank is found by a scan (leftmost first), its boundary is deleted and the two
neighbouring ranks are looked up again. Words of over ``SHORT`` symbols, where repeated scans would
be quadratic, take a heap over the same ranks; both give the same pieces.

The vocabulary file (tokenizers format, byte-level symbols, word-end suffix) is read by each Python
worker from ``path``. Words repeat, so each worker keeps the results of up to ``CACHE`` words.

Defined results: a null text counts as empty: 0 tokens, empty decoded text. Repeated rows are encoded
each for itself; of equal ranks the leftmost pair merges; very long texts and words are encoded whole. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from quillspan.llm.common import apply_struct, bounded_batches, text_struct

SHORT = 64
#: Words that a worker keeps, and the longest that it keeps (characters).
CACHE, CACHED_CHARS = 600_000, 40
NONE = 1 << 60
_SPACE = r"\t-\r \x85\xa0  -     　"


def every_character() -> str:
    """All of the planes that have letters or digits."""
    return "".join(map(chr, (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000))))


def beyond(kind: str) -> str:
    """Ranges of characters that ``regex`` counts as of a kind, L or N, but the tokenizers library does not.

    Both have tables of their own version of Unicode; those of the library count, and it is asked for them.
    """
    asked = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(every_character())
    known = set().union(*(part for part, _ in asked))
    ranges: list[list[int]] = []
    for c in regex.findall(rf"\p{{{kind}}}", every_character()):
        if c not in known:
            if ranges and ord(c) == ranges[-1][1] + 1:
                ranges[-1][1] += 1
            else:
                ranges.append([ord(c), ord(c)])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) or r"\U0010ffff"


def other_lower_case() -> dict[int, str]:
    """Characters whose lower case is not the same for Python as for the tokenizers library."""
    lower, found, every = normalizers.Lowercase(), {}, every_character()
    for k in range(0, len(every), 4096):
        part = every[k : k + 4096]
        if lower.normalize_str(part) != "".join(map(str.lower, part)):
            found |= {ord(c): low for c in part if (low := lower.normalize_str(c)) != c.lower()}
    return found


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    table = dict(zip(own, own, strict=True)) | {b: 256 + k for k, b in enumerate(rest)}
    return [chr(table[b]) for b in range(256)]


def merge_scan(ids: list[int], rank: dict[int, int], made: list[int]) -> tuple[list[int], list[int]]:
    """Merge by repeated scans of the rank array; returns ids and part boundaries."""
    bounds = list(range(len(ids) + 1))
    ranks = [rank.get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
    while ranks:
        low = min(ranks)
        if low == NONE:
            break
        at = ranks.index(low)
        ids[at] = made[low]
        del ids[at + 1], bounds[at + 1], ranks[at]
        if at:
            ranks[at - 1] = rank.get(ids[at - 1] << 20 | ids[at], NONE)
        if at < len(ranks):
            ranks[at] = rank.get(ids[at] << 20 | ids[at + 1], NONE)
    return ids, bounds


def merge_heap(ids: list[int], rank: dict[int, int], made: list[int]) -> tuple[list[int], list[int]]:
    """The same merges for long words: a heap of (rank, place) over linked parts."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k) for k in range(n - 1) if (r := rank.get(ids[k] << 20 | ids[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        j = after[k] if ids[k] >= 0 else n
        if j >= n or rank.get(ids[k] << 20 | ids[j]) != r:
            continue
        ids[k], ids[j], after[k] = made[r], -1, after[j]
        if after[j] < n:
            before[after[j]] = k
            if (s := rank.get(ids[k] << 20 | ids[after[j]])) is not None:
                heapq.heappush(heap, (s, k))
        if before[k] >= 0 and (s := rank.get(ids[before[k]] << 20 | ids[k])) is not None:
            heapq.heappush(heap, (s, before[k]))
    kept = [k for k in range(n) if ids[k] >= 0]
    return [ids[k] for k in kept], [*kept, n]


class Codec(dict):
    """Maps a pre-token to its ids, joined by blanks; keeps what it has seen."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.vocab = model["vocab"]
        self.tokens = {v: k for k, v in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for a, b in pairs:
            self.rank[self.vocab[a] << 20 | self.vocab[b]] = len(self.made)
            self.made.append(self.vocab[a + b])
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        letter, digit = rf"[\p{{L}}--[{beyond('L')}]]", rf"[\p{{N}}--[{beyond('N')}]]"
        self.words = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|[^{_SPACE}{letter}{digit}]+")
        # The same for texts of ASCII and of Latin letters, among which both tables agree.
        self.words_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+")
        self.words_latin = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.lower = other_lower_case()
        self.lowered = regex.compile("[" + "".join(map(chr, self.lower or [0xFFFF])) + "]")
        self.odd = regex.compile(rf"[{_SPACE}]+")

    def pieces(self, word: str) -> tuple[list[int], list[int]]:
        """Ids of a word and its part boundaries in bytes."""
        raw = [self.symbols[b] for b in word.encode()]
        ids = [self.vocab[s] for s in raw[:-1]] + [self.vocab[raw[-1] + self.end]]
        return (merge_scan if len(ids) <= SHORT else merge_heap)(ids, self.rank, self.made)

    def __missing__(self, word: str) -> str:
        found = " ".join(map(str, self.pieces(word)[0]))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found

    def normal(self, text: str) -> str:
        """NFC, white space to one blank, each character to lower case by itself."""
        text = self.odd.sub(" ", unicodedata.normalize("NFC", text))
        if text.isascii():
            return text.lower()
        if self.lowered.search(text):
            text = text.translate(self.lower)
        return text.replace("Σ", "σ").lower()  # no final form of sigma

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, normalised."""
        text = self.normal(text)
        if text.isascii():
            return self.words_ascii.findall(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return self.words_latin.findall(text)

    def encode_text(self, text: str | None) -> str:
        """The ids of a whole text in decimal, joined by one blank."""
        out: list[str] = []
        at = 0
        for m in self.special_at.finditer(text or ""):
            out += map(self.__getitem__, self.split(text[at : m.start()]))
            out.append(str(self.special[m[0]]))
            at = m.end()
        out += map(self.__getitem__, self.split((text or "")[at:]))
        return " ".join(out)

    def decode_text(self, ids: str) -> str:
        """Without a decoder the file's tokens are joined by one blank."""
        return " ".join(map(self._names.__getitem__, ids.split()))

    @property
    def _names(self) -> dict[str, str]:
        names = self.__dict__.get("by_text")
        if names is None:
            names = self.__dict__["by_text"] = {str(k): v for k, v in self.tokens.items()}
        return names


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``, an array of the text's token ids."""
    bounded_batches(docs.sparkSession)
    path = path or default_path()

    def setup():
        c = codec(path)
        return lambda texts: [[list(map(int, c.encode_text(t).split())) for t in texts]]

    return apply_struct(docs, key, text_struct(setup, "ids array<int>"), F.col(text))


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text``, decoded from an array of ids (null: empty)."""
    bounded_batches(encoded.sparkSession)
    path = path or default_path()

    def setup():
        c = codec(path)
        return lambda rows: [[c.decode_text(" ".join(map(str, r or []))) for r in rows]]

    return apply_struct(encoded, key, text_struct(setup, "text string"), F.col(ids))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: token count and digests of the ids and of the text decoded from them."""
    bounded_batches(docs.sparkSession)
    path = path or default_path()

    def setup():
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def work(texts: list) -> list[list]:
            ids = [c.encode_text(t) for t in texts]
            return [
                [i.count(" ") + 1 if i else 0 for i in ids],
                [sha(i) for i in ids],
                [sha(c.decode_text(i)) for i in ids],
            ]

        return work

    udf = text_struct(setup, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return apply_struct(docs, "doc_id", udf, F.col("text"))
