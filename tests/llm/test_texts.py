"""Decontamination, tokens, media: against brute force and the tokenizers' own libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from quillspan.llm import bpe, decontaminate, media, token_counts

ITEMS = [(1, "six seven eight nine ten eleven"), (2, "one two three four five six seven eight nine ten eleven"), (2, "fox jumps"), (3, None), (4, "...")]


def brute_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_hits(text, items):
    words, hit, found = brute_words(text), set(), set()
    for item, t in items:
        ws = brute_words(t)
        size = min(10, len(ws))
        for a in range(len(ws) - size + 1 if ws else 0):
            for b in range(len(words) - size + 1):
                if words[b : b + size] == ws[a : a + size]:
                    hit.update(range(b, b + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.contamination(odd, bench).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        n, hit, items = brute_hits(texts[r.doc_id], ITEMS)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.filter("false")).filter("contaminated or n_hit > 0").count() == 0
    kept = decontaminate.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not r.contaminated for r in rows)


def test_spans_lead_back_to_the_original(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 7)  # several automata give the same
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, "Ü! One, TWO three FOUR -- Six seven; eight nine Ten eleven.")], "doc_id long, text string")
    r = decontaminate.with_hits(docs, bench).first()
    assert [r.text[s.begin : s.end] for s in r.hits.spans] == ["Six seven; eight nine Ten eleven"]
    assert r.hits["items"] == ["1"]


def test_windows_of_long_and_repetitive_items(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    few, many = ["a", "b"], [f"w{k}" for k in range(50)]
    items = [(k, text(rng.randint(1, 40), few if k % 2 else many)) for k in range(30)]
    docs = [text(rng.randint(0, 120), few if k % 2 else many) + " " + items[k % 30][1] + " " + text(9, many) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for pieces, block in ((5000, 500_000), (4, 60)):
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", pieces)
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        for r in decontaminate.contamination(df, bench).collect():
            n, hit, found = brute_hits(docs[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.items_sha256) == (n, hit, hashlib.sha256(",".join(found).encode()).hexdigest())


def test_a_block_fits_a_worker():
    """A million random words take some 250 MB, so a block of half a million fits beside all else in a worker."""
    import resource

    rng = random.Random(1)
    pieces = [(str(k), " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(5000))) for k in range(20)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    finder = decontaminate.Finder(pieces)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 60  # MB for 100,000 words
    assert finder.scan(pieces[3][1])[3] == ["3"]


FUZZ = "abcdeé ßΣ'\n\t12!?<|>中▁😀́ İ\x1c "


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(FUZZ) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_bpe_equals_the_library(odd, empty):
    own, library = bpe.Codec(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    for text in [*fuzz(800, 1), "a<|endoftext|> b<|startoftext|>", "don't I'LL we're"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode_text(text) == " ".join(map(str, ids))
        assert own.decode_text(own.encode_text(text)) == library.decode(ids, skip_special_tokens=False)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = bpe.digests(odd).collect()
    assert len(rows) == odd.count() and bpe.digests(empty).count() == 0
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_every_code_point_is_of_the_librarys_kind():
    own, library = bpe.Codec(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    lines = [" ".join(f"a{c}1{c}!" for c in every[k : k + 2000]) for k in range(0, len(every), 2000)]
    for line, found in zip(lines, library.encode_batch(lines, add_special_tokens=False), strict=True):
        if own.encode_text(line) != " ".join(map(str, found.ids)):
            wrong = [hex(ord(x[1])) for x in line.split(" ") if own.encode_text(x) != " ".join(map(str, library.encode(x, add_special_tokens=False).ids))]
            raise AssertionError(wrong[:20])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdelnorst", min_size=1, max_size=120))
def test_both_merge_loops_agree(word):
    c = bpe.codec(bpe.default_path())
    ids = [c.vocab[x] for x in word[:-1]] + [c.vocab[word[-1] + c.end]]
    assert bpe.merge_scan(list(ids), c.rank, c.made) == bpe.merge_heap(list(ids), c.rank, c.made)


def test_bpe_round_trip_of_arrays(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {1: "hello</w> world</w>", 2: ""}


def test_token_counts_equal_the_unigram_model(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = token_counts.counter(path)
    for text in fuzz(800, 2):
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == odd.count() and token_counts.token_counts(empty).count() == 0
    for r in rows:
        assert (r.n_chars, r.n_tokens) == (len(texts[r.doc_id]), len(library.encode(texts[r.doc_id], add_special_tokens=False).ids))


def test_ties_go_to_the_earlier_beginning():
    own = token_counts.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0), ("bc", -2.0)])
    library = Tokenizer(models.Unigram([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0), ("bc", -2.0)], unk_id=0, byte_fallback=False))
    for word in ("ab", "abc", "bc", "abab", "cbc"):
        assert own.viterbi(word) == len(library.encode(word).ids)


def test_media_round_trip(odd, empty):
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for codec in (None, *media.CODECS):
        rows = media.media_features(odd, codec).collect()
        assert len(rows) == odd.count() and media.media_features(empty, codec).count() == 0
        for r in rows:
            payload = texts[r.doc_id].ljust(max(1, -(-len(texts[r.doc_id]) // 192)) * 192, b" ")
            assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
            stored = media.store(payload, codec)
            pcm = media.pcm_file(media.expand([stored])[0][1])
            assert (r.pcm_bytes, r.pcm_sha256) == (len(pcm), hashlib.sha256(pcm).hexdigest())
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_law_tables_and_resampling():
    assert media.MULAW[0xFF] == 0 and media.MULAW[0x00] == -32124 and media.MULAW[0x80] == 32124
    assert media.ALAW[0xD5] == 8 and media.ALAW[0x55] == -8 and abs(int(media.ALAW[0x2A])) == 32256
    assert media.resample(np.array([0, 10, 20], np.int16)).tolist() == [0, 5, 10, 15, 20, 20]


def adpcm_by_sample(block):
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_STEP[code])))
            out.append(value)
    return out


def test_adpcm_across_blocks_equals_sample_by_sample():
    blocks = np.random.default_rng(3).integers(0, 256, (7, 40), dtype=np.uint8)
    decoded = media.adpcm_decode(blocks)
    for block, samples in zip(blocks, decoded, strict=True):
        assert adpcm_by_sample(block.tobytes()) == samples.tolist()


def test_pcm_files(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    with_media = media.with_media(docs, docs.text, codec="mulaw")
    for r in with_media.select("doc_id", media.pcm_files()(with_media.media).alias("p")).collect():
        tag, align, data = media.read_wav(r.p.file)
        assert (tag, align, len(data)) == (1, 2, 192 * 2 * 2)
