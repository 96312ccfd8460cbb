"""Toxicity (operator 3): compression distance with zstandard dictionaries.

Two zstandard dictionaries are trained: one on the words of ordinary texts, one on those stretches of toxic texts that
no ordinary text of the sample has. Every window of a text (``WINDOW`` words, ``STEP`` words further each time, so that windows overlap) is
compressed with either; by how many bytes the toxic dictionary does better is the window's evidence. Counts
and rates of windows at fixed thresholds of that difference, weighted by a calibrated logistic model, give the score.

A window is a few dozen bytes, so what a dictionary is worth lies in its matches alone: the dictionaries are used for
their content, without their entropy tables, which would code the letters of either kind of text unequally; no match
starts in the last bytes of an input, so a window ends with ``TAIL``. Training takes pieces of eight bytes, about a
word's stem; the toxic dictionary is small, so only pieces that many toxic texts share get into it.

Fitting: at most ``TOXIC_ROWS`` + ``ORDINARY_ROWS`` labelled texts of at most ``FIT_CHARS`` characters,
picked by a hash of doc_id; each half of the toxic texts is scored with dictionaries trained on the other half. What is held of them in
the driver is 64-bit hashes of their stretches of ``STRETCH`` bytes. Scoring: whole texts of all rows, with no shuffle.

Defined results: a null, empty or blank text has no windows and gets the score of no evidence; without
labelled rows of both kinds every score is the share of toxic labels (0 without any). Of several labels of one
doc_id the largest counts; equal texts get equal scores, so ties and repeated rows are scored each for itself. Very long texts are
worked on window by window in slices. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, crc_mod, labelled_sample, text_struct

WINDOW, STEP, STRETCH, SLICE = 3, 2, 10, 4096
TAIL = b"\n" * 10
#: Rows and characters a row that fitting may take.
TOXIC_ROWS, ORDINARY_ROWS, FIT_CHARS = 1000, 2000, 10_000
#: Sizes of the dictionaries, their pieces, and samples for each.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_PIECE, PIECE, SAMPLES = 8000, 800, 16, 8, 200_000
MIN_MATCH = 6
#: Bytes by which the toxic dictionary must do better for a window to count.
THRESHOLDS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 18])
FOLDS = 5
_MUL = np.uint64(0x100000001B3)


def padded(words: list[str]) -> bytes:
    """Words between blanks, so that a short one fills a piece too."""
    return f"  {'  '.join(words)}  ".encode()


def windows(words: list[str]) -> list[bytes]:
    return [f" {' '.join(words[k : k + WINDOW])} ".encode() + TAIL for k in range(0, max(1, len(words) - WINDOW + STEP) if words else 0, STEP)]


def stretch_hashes(line: bytes) -> np.ndarray:
    """A hash of the ``STRETCH`` bytes from each place on."""
    a = np.frombuffer(line, np.uint8).astype(np.uint64)
    h = np.zeros(max(len(a) - STRETCH + 1, 0), np.uint64)
    for k in range(STRETCH if len(h) else 0):
        h = h * _MUL + a[k : len(h) + k]
    return h


def unseen(line: bytes, seen: np.ndarray) -> list[bytes]:
    """The distinct parts of a line all of whose stretches are not among the sorted ``seen``."""
    h = stretch_hashes(line)
    if len(seen) and len(h):
        new = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
    else:
        new = np.ones(len(h), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], new.astype(np.int8), [0]])))
    return list(dict.fromkeys(line[a : b + STRETCH - 1] for a, b in edges.reshape(-1, 2)))


def train(samples: list[bytes], size: int, piece: int) -> bytes:
    """A zstandard dictionary; with too little to train on, the samples themselves."""
    rows = sorted(samples)
    random.Random(0).shuffle(rows)
    rows = rows[:SAMPLES]
    try:
        return zstandard.train_dictionary(size, rows * -(-50 // len(rows)), k=piece, d=8).as_bytes()
    except (zstandard.ZstdError, ZeroDivisionError):
        return b" ".join(rows)[-size:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=16, search_log=4, strategy=zstandard.STRATEGY_GREEDY, min_match=MIN_MATCH,
        write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    known = zstandard.ZstdCompressionDict(dictionary.ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)


def evidence(toxic, ordinary, text: str | None) -> list[float]:
    """Counts and rates of the windows that the toxic dictionary shortens by each threshold, and the length."""
    words = (text or "").lower().split()
    counts, n = np.zeros(len(THRESHOLDS)), 0
    a, b = toxic.compress, ordinary.compress
    for at in range(0, len(words), SLICE):
        better = np.array([len(b(w)) - len(a(w)) for w in windows(words[at : at + SLICE + WINDOW - STEP])])
        counts += (better[:, None] >= THRESHOLDS).sum(0)
        n += len(better)
    return [1.0, *np.log1p(counts), *np.log1p(100 * counts / max(n, 1)), np.log(max(n, 1))]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def fit(toxic: list[str], ordinary: list[str], share: float) -> tuple:
    """(toxic dictionary, ordinary dictionary, weights) from labelled texts; ``share``: of toxic labels."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return b"", b"", [share]
    split = lambda texts: [(t or "").lower().split() for t in texts]

    def dictionaries(tox: list[str], plain: list[str]) -> tuple[bytes, bytes]:
        rows = split(plain)
        hashes = [np.unique(stretch_hashes(padded(r))) for r in rows]
        seen = np.unique(np.concatenate(hashes))
        fresh = [part for r in split(tox) for part in unseen(padded(r), seen)]
        words = [padded([w]) for r in rows for w in dict.fromkeys(r)]
        return train(fresh, TOXIC_BYTES, PIECE), train(words, ORDINARY_BYTES, ORDINARY_PIECE)

    x, y = [], []
    for k in (0, 1):  # what one half of the texts teaches judges the other
        pair = [compressor(d) for d in dictionaries(toxic[k::2], ordinary[k::2])]
        for label, texts in ((1.0, toxic[1 - k :: 2]), (0.0, ordinary[1 - k :: 2])):
            x += [evidence(*pair, t) for t in texts]
            y += [label] * len(texts)
    x, y = np.array(x), np.array(y)
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    mean[0], sd[0] = 0, 1
    w = logistic((x - mean) / sd, y, weight, 0.5) / sd
    w[0] -= float(mean[1:] @ w[1:])
    return *dictionaries(toxic, ordinary), w.tolist()


@lru_cache(maxsize=2)
def _compressors(toxic: bytes, ordinary: bytes):
    return compressor(toxic), compressor(ordinary)


def score(model: tuple, text: str | None) -> float:
    toxic, ordinary, w = model
    if len(w) == 1:
        return w[0]
    z = float(np.dot(evidence(*_compressors(toxic, ordinary), text), w))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_from(docs: DataFrame, labels: DataFrame) -> tuple:
    """Fit on a bounded sample of the rows that are not held out."""
    known = labels.filter((crc_mod("doc_id", FOLDS) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("label"))
    rows, counts = labelled_sample(docs, known, {1: TOXIC_ROWS, 0: ORDINARY_ROWS}, FIT_CHARS)
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return fit([t for y, t in rows if y == 1], [t for y, t in rows if y == 0], share)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(fit_from(docs, labels))

    def setup():
        model = shared.value
        return lambda texts: [[score(model, t) for t in texts]]

    r = text_struct(setup, "score double")(F.col("text"))
    return docs.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), r.alias("_r")).select(
        "doc_id", "held_out", "_r.score", F.when(F.col("_r.score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
