"""Token counts (operator 2): unigram Viterbi that carries only best score and piece count.

The vocabulary is that of a SentencePiece file (``path``): pieces with scores and byte fallback. Text
is split as its tokenizer does: blanks become the word mark, one is put in front, and each mark begins
a word. In a word, an Aho-Corasick automaton over the pieces lists the matches that end at each place,
longest first. Tie rules of the tokenizer: a later candidate wins only with a strictly larger score,
candidates are tried by their beginning from left to right, and a character that is no piece itself
costs the lowest score less 10 and comes last. Unknown characters count one token for each UTF-8 byte.

Defined results: a null or empty text has 0 tokens; very long texts are counted whole, word by word; repeated rows are counted each for
itself; an empty table gives an empty one. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import apply_struct, bounded_batches, text_struct

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker keeps, and the longest that it keeps (characters).
CACHE, CACHED_CHARS = 600_000, 40


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces; control, unknown and byte pieces never match text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter(dict):
    """Maps a word (with its mark) to its number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]], lowest: float | None = None):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = (min(s for _, s in pieces) if lowest is None else lowest) - UNKNOWN_PENALTY
        self.split = regex.compile(f"{MARK}[^{MARK}]*")

    def viterbi(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        done = 0  # places up to here have seen all their candidates

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if word[done - 1] not in self.single:
                    score = best[done - 1] + self.unknown
                    if best[done] is None or score > best[done]:
                        best[done] = score
                        count[done] = count[done - 1] + len(word[done - 1].encode())

        for end, (size, gain) in self.automaton.iter(word):
            close(end)
            score = best[end + 1 - size] + gain
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1] = score
                count[end + 1] = count[end + 1 - size] + 1
        close(n)
        return count[n]

    def __missing__(self, word: str) -> int:
        n = self.viterbi(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        return sum(map(self.__getitem__, self.split.findall(text if text[0] == MARK else MARK + text)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Counter(vocabulary(path), min(model.get_score(i) for i in range(model.get_piece_size())))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars (code points of the text) and n_tokens."""
    bounded_batches(docs.sparkSession)
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def setup():
        c = counter(path)
        return lambda texts: [[len(t or "") for t in texts], [c.count(t) for t in texts]]

    return apply_struct(docs, "doc_id", text_struct(setup, "n_chars long, n_tokens long"), F.col("text"))
