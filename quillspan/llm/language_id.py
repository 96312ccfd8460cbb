"""Language ID (operator 8): error-correcting output codes.

Each language gets a codeword; for every bit a binary classifier over hashed byte n-grams (lengths 1 to 4)
says which side a text is on. Decoding sums over bits the loss of the margin against each codeword,
weighted by how well the bit's classifier did on its sample, and takes the codeword with the
least loss; a text whose two best codewords are nearly as good is flagged as ambiguous.

Codes: all distinct splits of the languages into two sides for up to five languages, else random codewords of
ten bits for each doubling of the number of languages, from a fixed seed.

Fitting: every language with a labelled row is learned, from about ``ROWS`` labelled texts in all and ``LEAST`` of each
language at the least, picked by a hash of doc_id. Whole texts of any length count; their profiles are computed in the tasks, and only those
(16 KB each, compressed to 3 or so) reach the driver. Predicting: whole texts of all rows, with no shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0, as is any text where no
language could be learned; with one language learned every other text is that one; of equal losses the language that comes first by
name is predicted, and the text is flagged. Of several labels of one doc_id the largest counts. Repeated rows are
judged each for itself; very long texts are profiled in slices; other columns play no part, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import MOST_CHARS, bounded_batches, crc_mod, free_name, labelled_sample, text_struct

ROWS, LEAST = 2000, 5
BITS = 12  # of the n-gram hash
FOLDS = 5
#: Scores of the two best codewords that are no further apart leave a text ambiguous.
AMBIGUOUS = 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes that are worked on at once, to bound memory.
SLICE = 1 << 20


def profile(text: str) -> np.ndarray:
    """Square roots of the n-gram frequencies, of length 1."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_KEEP).split()) + b" ", np.uint8)
    total = np.zeros(1 << BITS)
    for at in range(0, len(raw), SLICE):
        b = raw[at : at + SLICE + 3].astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for n in range(4):
            if len(b) <= n:
                break
            h = h[: len(b) - n] * np.uint32(0x01000193) ^ b[n:] + np.uint32(n * 257)
            mixed = h * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
            total += np.bincount(mixed[:SLICE], minlength=1 << BITS)
    x = np.sqrt(total, out=total)
    return x / max(float(np.sqrt(np.dot(x, x))), 1e-12)


def codewords(n: int) -> np.ndarray:
    """One row of -1 and 1 for each language."""
    if n <= 5:
        sides = [(1, *s) for s in itertools.product((1, -1), repeat=n - 1)][1:] or [(1,) * n]
        return np.array(sides).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best = None
    for _ in range(50):
        code = rng.choice([-1, 1], size=(n, bits))
        far = (bits - (code @ code.T - 2 * bits * np.eye(n, dtype=int)).max()) // 2  # least distance of two codewords
        ok = (np.abs(code.sum(0)) < n).all()
        if ok and (best is None or far > best[0]):
            best = (far, code)
    return best[1]


def _centred(rows: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The profiles less their mean, and the mean."""
    c = np.empty((len(rows), 1 << BITS), dtype=np.float32)
    for k, (_, p) in enumerate(rows):
        c[k] = np.frombuffer(zlib.decompress(p), np.float32)
    mean = c.mean(0)
    c -= mean
    return c, mean


def fit(rows: list[tuple[str, bytes]]) -> dict | None:
    """From (language, compressed profile) rows: languages, code, weights of the bits' classifiers and of the bits."""
    names = sorted({y for y, _ in rows})
    if not names:
        return None
    if len(names) == 1:
        return {"names": names}
    place = {y: k for k, y in enumerate(names)}
    code = codewords(len(names))
    side = code[[place[y] for y, _ in rows]].astype(np.float32)
    # Ridge classifiers of all bits at once, in the dual; the same system gives leave-one-out margins.
    # The one large array (32 MB for 2000 rows) is made again for the weights, so that it isn't held beside the inversion.
    c, mean = _centred(rows)
    kernel = c @ c.T
    del c
    kernel[np.diag_indices(len(kernel))] += 0.5
    inverse = np.linalg.inv(kernel)
    del kernel
    centre = side.mean(0)
    alpha = inverse @ (side - centre)
    left_out = side - alpha / np.diag(inverse)[:, None]
    del inverse
    weights = _centred(rows)[0].T @ alpha
    right = (np.sign(left_out) == side).mean(0)
    trust = np.log(np.clip(right, 0.5 + 1e-3, 1 - 1e-3) / (1 - np.clip(right, 0.5 + 1e-3, 1 - 1e-3)))
    return {
        "names": names,
        "code": code.astype(np.float32),
        "weights": weights.astype(np.float32),
        "bias": (centre - mean @ weights).astype(np.float32),
        "trust": (trust / trust.sum()).astype(np.float32),
    }


def predict(model: dict | None, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    named, scores, close = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    rows = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
    if rows and len(model["names"]) == 1:
        for k in rows:
            named[k], scores[k] = model["names"][0], 1.0
    elif rows:
        margin = np.array([profile(texts[k]) @ model["weights"] for k in rows]) + model["bias"]
        # Exponential loss of each bit against each codeword, weighted by the bit's trust.
        loss = (np.exp(np.clip(-3 * margin[:, None, :] * model["code"], -30, 30)) * model["trust"]).sum(2)
        like = 1 / np.maximum(loss, 1e-12)
        like /= like.sum(1, keepdims=True)
        for k, p in zip(rows, like, strict=True):
            second, first = np.sort(p)[-2:].tolist()
            named[k], scores[k], close[k] = model["names"][int(p.argmax())], first, first - second <= AMBIGUOUS
    return named, scores, close


def _profiles():
    return lambda texts: [[zlib.compress(profile(t).astype(np.float32).tobytes(), 1) for t in texts]]


def fit_from(docs: DataFrame) -> dict | None:
    bounded_batches(docs.sparkSession)
    known = docs.select("doc_id", F.col("lang").alias("label")).filter((crc_mod("doc_id", FOLDS) != 0) & F.col("label").isNotNull())
    names = [r.label for r in known.select("label").distinct().collect()]
    most = dict.fromkeys(names, max(LEAST, ROWS // max(len(names), 1)))
    profiles = text_struct(_profiles, "p binary")(F.col("text"))["p"]
    return fit(labelled_sample(docs, known, most, MOST_CHARS, [profiles])[0]) if names else None


def with_language(docs: DataFrame, model: dict | None, out: str) -> DataFrame:
    """``docs`` with a struct column: lang_pred, score, ambiguous."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        model = shared.value
        return lambda texts: list(predict(model, texts))

    return docs.withColumn(out, text_struct(setup, "lang_pred string, score double, ambiguous boolean")(F.col("text")))


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    rows = docs.select("doc_id", "text", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"))
    return with_language(rows, fit_from(docs), "_r").select("doc_id", "held_out", "_r.*")


def kept(docs: DataFrame) -> DataFrame:
    """The documents in a language that was learned and not ambiguous, with all their columns."""
    mark = free_name("_lang", docs)
    r = with_language(docs, fit_from(docs), mark)
    return r.filter((F.col(f"{mark}.lang_pred") != UNKNOWN) & ~F.col(f"{mark}.ambiguous")).drop(mark)
