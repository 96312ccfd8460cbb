"""Fixed models against direct computations in plain Python."""

import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import html_text, language_id, quality, toxicity


def test_toxicity_of_a_fixed_model():
    """Every window by itself, counted by hand; slices change nothing."""
    rng = random.Random(3)
    words = ["the", "house", "by", "water", "grobble", "snark", "é", "x" * 40]
    toxic, ordinary = b"  grobble  snark  grobble ", b" the house by water the house "
    pair = toxicity.compressor(toxic), toxicity.compressor(ordinary)
    for n in (0, 1, 2, 3, 4, 5, 17, 9000):
        text = " ".join(rng.choice(words) for _ in range(n)).upper()
        tokens, better = text.lower().split(), []
        at = 0
        while tokens and (at == 0 or at + 1 < len(tokens)):
            window = (" " + " ".join(tokens[at : at + 3]) + " ").encode() + toxicity.TAIL
            better.append(len(pair[1].compress(window)) - len(pair[0].compress(window)))
            at += 2
        want = [1.0] + [math.log1p(sum(b >= t for b in better)) for t in toxicity.THRESHOLDS]
        want += [math.log1p(100 * sum(b >= t for b in better) / max(len(better), 1)) for t in toxicity.THRESHOLDS] + [math.log(max(len(better), 1))]
        assert toxicity.evidence(*pair, text) == pytest.approx(want), n


def test_unseen_stretches_by_hand():
    rng = random.Random(5)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))).encode() for _ in range(30)]
    known = {x[k : k + toxicity.STRETCH] for x in lines[:10] for k in range(len(x) - toxicity.STRETCH + 1)}
    seen = np.unique(np.concatenate([toxicity.stretch_hashes(x) for x in lines[:10]]))
    for line in lines:
        want, part = [], b""
        for k in range(len(line) - toxicity.STRETCH + 1):
            g = line[k : k + toxicity.STRETCH]
            if g in known:
                want, part = want + [part] * bool(part), b""
            else:
                part = part + g[-1:] if part else g
        want += [part] * bool(part)
        assert toxicity.unseen(line, seen) == list(dict.fromkeys(want))


def test_language_of_a_fixed_model():
    rng = np.random.default_rng(2)
    names, code = ["aa", "bb", "cc"], language_id.codewords(3)
    model = {
        "names": names, "code": code.astype(np.float32), "weights": rng.normal(size=(1 << language_id.BITS, code.shape[1])).astype(np.float32),
        "bias": np.array([0.1, -0.2, 0.0], np.float32), "trust": np.array([0.5, 0.3, 0.2], np.float32),
    }
    for text in ("Hello world", "Ça va? Été!", "x", "a b " * 400):
        got, score, _ = language_id.predict(model, [text])
        raw = b" " + b" ".join(bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()).split()) + b" "
        counts = {}
        for at in range(len(raw)):
            h = 0
            for n in range(min(4, len(raw) - at)):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (raw[at + n] + n * 257)
                place = (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language_id.BITS)
                counts[place] = counts.get(place, 0) + 1
        size = math.sqrt(sum(counts.values()))
        margin = [sum(math.sqrt(c) / size * model["weights"][p, b] for p, c in counts.items()) + model["bias"][b] for b in range(code.shape[1])]
        like = [1 / sum(model["trust"][b] * math.exp(-3 * margin[b] * code[k, b]) for b in range(code.shape[1])) for k in range(3)]
        assert got == [names[int(np.argmax(like))]] and score[0] == pytest.approx(max(like) / sum(like), rel=1e-4)


def test_more_languages_than_rows_for_each(spark):
    """Eighty languages, some with long texts only: all are learned."""
    rows, rng = [], random.Random(8)
    for k in range(80):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)]
        for j in range(15):
            rows.append((k * 100 + j, " ".join(rng.choice(own) for _ in range(3000 if k % 20 == 0 else 40)), f"l{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    right = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert right.select("lang_pred").distinct().count() == 80
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def statistics_by_hand(text):
    words, lines = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w], [x for x in text.split("\n") if x]
    over = lambda a, b: a / b if b else 0.0
    n = len(text)
    return [
        n, len(words), over(n, len(words)), over(len(re.findall(r"[#$%&*|!@^~=<>{}\[\]\\_+]", text)), n), over(sum(c.isupper() for c in text), n),
        over(len(re.findall(r"[.,;:?]", text)), len(words)), over(len(set(words)), len(words)), over(len(set(lines)), len(lines)), over(len(words), len(lines)),
    ]


def test_quality_of_a_fixed_model(spark):
    texts = ["", "One two. Three!", "A B C\nA B C\n\nlast line: #$%", "x" * 3000, "Été À la mode; oui? " * 50]
    model = (0.2, [(1.5, ((1, 3.0, True), (4, 0.1, False))), (-0.7, ((3, 0.01, True),)), (0.4, ((7, 0.9, False), (8, 2.0, True)))])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in quality.with_score(docs, model, "s").collect()}
    for k, text in enumerate(texts):
        x = statistics_by_hand(text)
        total = model[0] + sum(w for w, rule in model[1] if all((x[c] > cut) == above for c, cut, above in rule))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total))), text[:20]


def test_densities_by_hand():
    page = (
        "<body><div id=a><p>Some words and <a href=x>a link</a> here</p><p>More words without any</p></div>"
        "<ul><li><a href=y>one</a></li><li><a href=z>two</a></li></ul></body>"
    )
    root = html_text.parse(page)
    body = next(n for n in html_text.in_order(root) if n.tag == "body")
    nodes = html_text.measure(body)

    def counts(n):
        chars = tags = links = link_tags = 0
        for c in n.items:
            if isinstance(c, str):
                chars += sum(not x.isspace() for x in c)
            else:
                a, b, d, e = counts(c)
                chars, tags, links, link_tags = chars + a, tags + b + 1, links + d, link_tags + e + (c.tag == "a")
        return (chars, tags, chars, tags) if n.tag == "a" else (chars, tags, links, link_tags)

    whole = counts(body)
    for n in nodes:
        chars, tags, links, link_tags = counts(n)
        assert (n.chars, n.tags, n.link_chars, n.link_tags) == (chars, tags, links, link_tags), n.tag
        if chars:
            base = math.log(chars / max(chars - links, 1) * links + whole[2] / whole[0] * chars + math.e)
            want = chars / max(tags, 1) * math.log(max(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1), 1)) / math.log(max(base, math.e) if base <= 1.001 else base)
            assert n.density == pytest.approx(want)
        assert n.total == pytest.approx(sum(c.density for c in n.items if isinstance(c, html_text.Node) and c.block))
    assert html_text.main_text(page).split("\n") == ["Some words and a link here", "More words without any"]


def test_the_profiles_are_not_held_beside_the_inversion():
    rng = random.Random(5)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    text = lambda y: " ".join("".join(rng.choices(letters[y], k=rng.randint(2, 9))) for _ in range(60))
    labels = [rng.choice(list(letters)) for _ in range(language_id.ROWS)]
    rows = list(zip(labels, language_id._profiles()([text(y) for y in labels])[0], strict=True))
    assert sum(len(p) for _, p in rows) < (8 << 20)
    tracemalloc.start()
    model = language_id.fit(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20
    assert all(language_id.predict(model, [text(y)])[0] == [y] for y in letters)
