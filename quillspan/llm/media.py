"""Media columns (operator 7): telephony audio.

Bytes are stored as 8-bit telephony samples in a WAV file at 8 kHz: mu-law, A-law or IMA ADPCM (two
4-bit samples a byte, in blocks of 192 bytes behind a block header). Reading back gives the same bytes.
For use the samples are expanded (lookup tables for both laws; ADPCM with numpy across all blocks of
a batch, one step for each place in a block), resampled to 16 kHz and kept in a column of WAV files of 16-bit PCM.

Defined results: a null text counts as empty; a payload is padded with blanks to a positive multiple of
192 bytes; the codec of a row follows from its payload alone (crc32 modulo 3) unless one is named, so
equal texts and repeated rows have equal values; very long texts are stored whole, and a batch has a bounded number of
bytes; an empty table gives an empty one; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import bounded_batches, text_struct

BLOCK = 192
RATE, OUT_RATE = 8000, 16000
CODECS = ("mulaw", "alaw", "adpcm")
#: WAV format tags.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}

# Fixed values of IMA ADPCM: index changes by code, and the quantiser's steps.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
        107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
        4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
        22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    power, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(power == 0, low + 8, low + 264 << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (one a row: 4 header bytes, then two codes a byte, low half first)."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((blocks.shape[1] - 4, 2, len(blocks)), dtype=np.uint8)
    codes[:, 0], codes[:, 1] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    codes = codes.reshape(-1, len(blocks))
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        step = STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[k + 1] = value
    return out.T


def wav(tag: int, rate: int, bits: int, align: int, data: bytes, extra: bytes = b"") -> bytes:
    """A RIFF/WAVE file with one channel."""
    per_s = rate * align if tag != 0x11 else rate * align // (2 * (align - 4) + 1)
    kind = struct.pack("<HHIIHH", tag, 1, rate, per_s, align, bits) + struct.pack("<H", len(extra)) + extra
    chunks = b"fmt " + struct.pack("<I", len(kind)) + kind + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(file: bytes) -> tuple[int, int, bytes]:
    """Format tag, block size and data of a WAV file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, tag, align = 12, 0, 1
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            tag, align = struct.unpack_from("<H10xH", file, at + 8)
        elif name == b"data":
            return tag, align, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


def pad(payload: bytes) -> bytes:
    return payload.ljust(max(1, -(-len(payload) // BLOCK)) * BLOCK, b" ")


def store(payload: bytes, codec: str | None = None) -> bytes:
    """The payload, a positive multiple of 192 bytes, as a telephony WAV file."""
    codec = codec or CODECS[zlib.crc32(payload) % 3]
    if codec == "adpcm":
        rows = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        blocks = np.zeros((len(rows), BLOCK + 4), np.uint8)
        blocks[:, 4:] = rows
        return wav(TAGS[codec], RATE, 4, BLOCK + 4, blocks.tobytes(), struct.pack("<H", 2 * BLOCK + 1))
    return wav(TAGS[codec], RATE, 8, 1, payload)


def resample(x: np.ndarray) -> np.ndarray:
    """8 to 16 kHz by linear interpolation."""
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1:-1:2] = (x[:-1].astype(np.int32) + x[1:]) >> 1
    out[-1:] = x[-1:]
    return out


def expand(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Payload and 16 kHz samples of each file; the ADPCM blocks of all files are decoded together."""
    read = [read_wav(f) for f in files]
    grouped: dict[int, list[int]] = {}
    for k, (tag, align, _) in enumerate(read):
        if tag == TAGS["adpcm"]:
            grouped.setdefault(align, []).append(k)
    out: list = [None] * len(files)
    for align, rows in grouped.items():
        sizes = [len(read[k][2]) // align for k in rows]
        blocks = np.frombuffer(b"".join(read[k][2] for k in rows), np.uint8).reshape(-1, align)
        samples, at = adpcm_decode(blocks), 0
        for k, n in zip(rows, sizes, strict=True):
            out[k] = (blocks[at : at + n, 4:].tobytes(), resample(samples[at : at + n].ravel()))
            at += n
    for k, (tag, _, data) in enumerate(read):
        if out[k] is None:
            out[k] = (data, resample((MULAW if tag == TAGS["mulaw"] else ALAW)[np.frombuffer(data, np.uint8)]))
    return out


def stored(codec: str | None = None):
    """UDF: text to its telephony WAV file."""

    def setup():
        return lambda texts: [[store(pad((t or "").encode()), codec) for t in texts]]

    return text_struct(setup, "file binary")


def read_features():
    """UDF: telephony WAV file to what it holds, how it sounds, and a WAV file of 16-bit PCM at 16 kHz."""

    def setup():
        def work(files: list) -> list[list]:
            rows = []
            for file, (payload, pcm) in zip(files, expand(files), strict=True):
                big = np.abs(pcm.astype(np.int32))
                signs = np.signbit(pcm)
                rows.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(file),
                        hashlib.sha256(file).hexdigest(),
                        f"tag={read_wav(file)[0]};n={len(pcm)};peak={big.max()};mean_abs={int(big.sum()) // len(pcm)};"
                        f"crossings={int(np.count_nonzero(signs[1:] != signs[:-1]))};pcm_crc32={zlib.crc32(pcm.tobytes())}",
                        pcm_file(pcm),
                    )
                )
            return [list(c) for c in zip(*rows, strict=True)]

        return work

    return text_struct(
        setup,
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary",
    )


def pcm_file(pcm: np.ndarray) -> bytes:
    return wav(1, OUT_RATE, 16, 2, pcm.astype("<i2").tobytes())


def pcm_files():
    """UDF: telephony WAV file to a WAV file of 16-bit PCM at 16 kHz."""

    def setup():
        return lambda files: [[pcm_file(pcm) for _, pcm in expand(files)]]

    return text_struct(setup, "file binary")


def with_media(df: DataFrame, text: Column, out: str = "media", codec: str | None = None) -> DataFrame:
    """``df`` with a binary column of telephony WAV files made from ``text``."""
    bounded_batches(df.sparkSession)
    return df.withColumn(out, stored(codec)(text)["file"])


def with_pcm(docs: DataFrame, codec: str | None = None) -> DataFrame:
    """doc_id, n_bytes, what the stored telephony file holds, and the column ``pcm`` of resampled WAV files."""
    media = with_media(
        docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")),
        F.col("text"),
        codec=codec,
    )
    return media.select("doc_id", "n_bytes", read_features()(F.col("media")).alias("_r")).select("doc_id", "n_bytes", "_r.*")


def media_features(docs: DataFrame, codec: str | None = None) -> DataFrame:
    """One row per document: sizes, digests and features read from the stored media, and size and digest of its PCM."""
    return with_pcm(docs, codec).select(
        "*", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256")
    ).drop("pcm")
