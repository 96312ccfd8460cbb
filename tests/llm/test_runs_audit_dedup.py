"""Operators 11 to 13 against brute force, with odd, repeated and empty tables."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest

from quillspan.llm import interaction, minhash, periodic


# --- periodic runs ------------------------------------------------------------------------------------------------------------


def all_runs(words):
    """Every period in turn: stretches in which each word is that of a period later."""
    found, codes = {}, np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0)
    for q in range(1, len(words) // 2 + 1):
        same = np.diff(np.r_[False, codes[q:] == codes[:-q], False].astype(np.int8))
        for s, e in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist(), strict=True):
            if e + q - s >= max(12, 2 * q):
                found.setdefault((s, e + q - s), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(rng):
    n, letters = rng.choice([0, 1, 11, 12, 40, 150]), rng.choice([1, 2, 3, 5, 20])
    words = [f"w{rng.randrange(letters)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 10)
            for i in range(a, rng.randint(a, n)):
                words[i] = words[a + (i - a) % p]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(12)
    for _ in range(400):
        documents = [repeating(rng) for _ in range(rng.randint(1, 4))]
        got = periodic._found([[w.encode() for w in d] for d in documents])
        for words, (runs, text) in zip(documents, got, strict=True):
            want = all_runs(words)
            assert runs == want
            assert text == collapsed(words, want)


def test_wavelet_tree_counts_and_selects():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1000, 300)
    tree = periodic.WaveletTree(values)
    low = rng.integers(0, 150, 200)
    high = low + rng.integers(1, 150, 200)
    value = rng.integers(0, 3000, 200)
    assert tree.before(low, high, value).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, value, strict=True)]
    n = rng.integers(0, high - low)
    assert tree.nth(low, high, n).tolist() == [sorted(values[a:b])[k] for a, b, k in zip(low, high, n, strict=True)]


def test_one_word_ten_thousand_times():
    ((runs, text),) = periodic._found([[b"la"] * 10_000])
    assert runs == [(0, 10_000, 1)] and text == "la"


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in (words if doc_id is None else planted(doc_id, words))]
    found = all_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    numbers = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *numbers, digest(lines), digest(collapsed(words, found)))


def test_periodic_query_on_odd_documents(odd):
    rows = periodic.query(odd).collect()
    want = [expected_runs(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_periodic_query_plants_and_finds(spark):
    rng = random.Random(5)
    rows = [(k, " \t".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([0, 3, 60, 300])))) for k in range(120)]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 5
    got = periodic.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(expected_runs(*r) for r in rows)
    assert any(r.n_runs for r in got)


def test_periodic_query_of_nothing(empty):
    assert periodic.query(empty).collect() == []


# --- filter interaction audit -------------------------------------------------------------------------------------------------


def failing(text, copy):
    words = text.encode().split()
    tests = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": copy,
    }
    return frozenset(f for f, failed in tests.items() if failed)


def expected_audit(docs, labels):
    least = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    rows = {}
    known = {}
    for doc, quality, toxic in labels:
        old = known.get(doc, (0, 0))
        known[doc] = (max(old[0], quality or 0), max(old[1], toxic or 0))
    for doc, text, part in docs:
        fails = failing(text or "", doc is not None and doc > least[text or ""])
        good, toxic = (0, 0) if doc is None else known.get(doc, (0, 0))
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out = rows.setdefault((part or "", "".join(order), step), [0] * 7)
                earlier = any(g in fails for g in order[: step - 1])
                removed = f in fails and not earlier
                out[0] += f not in fails and not earlier
                out[1] += removed
                out[2] += f in fails and earlier
                out[3] += fails == {f}
                out[4] += removed * good
                out[5] += removed * toxic
    shares = {}
    for (part, order, step), out in rows.items():
        shares[part, order[step - 1]] = shares.get((part, order[step - 1]), 0) + out[1]
    return sorted((*key, *out[:6], shares[key[0], key[1][key[2] - 1]]) for key, out in rows.items())


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [None, "", "a b c", "UPPER case", "cash $ here", "word " * 250, " ".join(f"w{k}" for k in range(220)), " ".join(f"w{k}" for k in range(220)) + " #"]
    large = (1 << 60) + 1  # ids beyond what a double tells apart
    docs = [(rng.choice([rng.randrange(200), large, large + 1]) if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(n)]
    labels = [(rng.choice([*range(200), large, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    return docs, labels


@pytest.fixture(scope="module")
def audited(spark, tmp_path_factory):
    """Files in descending order of ids, so that smaller ids arrive in later micro-batches."""
    docs, labels = corpus()
    path = str(tmp_path_factory.mktemp("audit") / "documents.parquet")
    rows = sorted(docs, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    for at in range(0, len(rows), 15):
        spark.createDataFrame([(*r, 1, "x") for r in rows[at : at + 15]], "doc_id long, text string, source string, least int, mask string").coalesce(1).write.mode("append").parquet(path)
    return path, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("files", [1, 3, None])
def test_audit_equals_brute_force_for_any_cut_into_batches(spark, audited, files):
    path, docs, labels, known = audited
    got = interaction.report(interaction.counters(spark, path, labels, files=files))
    assert sorted(map(tuple, got.collect())) == expected_audit(docs, known)


def test_audit_goes_on_where_it_was_left(spark, audited, tmp_path):
    path, docs, labels, known = audited
    home, more = str(tmp_path / "home"), [(-5, "a b c", "s"), (-6, None, "u")]
    kept = lambda: interaction.counters(spark, str(tmp_path / "documents.parquet"), labels, home)
    spark.read.parquet(path).write.parquet(str(tmp_path / "documents.parquet"))
    first = kept().collect()
    assert sorted(kept().collect()) == sorted(first)  # nothing new: nothing is counted again
    spark.createDataFrame([(*r, 1, "x") for r in more], spark.read.parquet(path).schema).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, interaction.report(kept()).collect())) == expected_audit(docs + more, known)


def test_audit_of_nothing_and_of_one_file(spark, audited, tmp_path):
    path, docs, labels, _ = audited
    spark.read.parquet(path).filter("false").coalesce(1).write.parquet(str(tmp_path / "none"))
    assert interaction.report(interaction.counters(spark, str(tmp_path / "none"), labels)).collect() == []
    one = spark.read.parquet(path).coalesce(1)
    one.write.parquet(str(tmp_path / "one"))
    file = str(next((tmp_path / "one").glob("part-*")))
    got = interaction.report(interaction.counters(spark, file, labels.filter("false")))
    assert sorted(map(tuple, got.collect())) == expected_audit(docs, [])


# --- near duplicates by signatures --------------------------------------------------------------------------------------------


def expected_components(rows):
    sets = []
    for doc, text in rows:
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        sets.append({tuple(words[k : k + 3]) for k in range(max(len(words) - 2, 1))} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((doc, len(sets[k]), component, doc == component))
    return sorted(out, key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def near_corpus(rng):
    """Families with a base, near copies, copies of copies, texts half alike, and a passage in all of them."""
    passage = [f"p{k}" for k in range(30)]
    texts = []
    for f in range(6):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 120, 300]))] + passage
        chain = base
        for _ in range(8):
            texts.append(edited(rng, base, rng.randrange(5)))
            chain = edited(rng, chain, rng.randrange(3))
            texts.append(chain)
        texts += [base, base + passage, base[: len(base) // 2]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rows += [rows[3], (None, rows[3][1]), (None, "no id at all here"), (None, "no id at all here"), (500, None), (501, "  "), (502, "One Two"), (503, "one two")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_equals_brute_force(spark, seed):
    rows = near_corpus(random.Random(seed))
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n int, fp string").repartition(3)
    assert sorted(map(tuple, minhash.classed(docs).collect()), key=repr) == expected_components(rows)


def test_near_dedup_on_odd_documents_and_nothing(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, minhash.classed(odd).collect()), key=repr) == expected_components(rows)
    assert minhash.classed(empty).collect() == []


def test_signatures_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 15), 1 << 15, minhash.MINIMA).astype(np.int16)
    rows = []
    for k in range(300):
        other = base.copy()
        wrong = rng.choice(minhash.MINIMA, minhash.DISTANCE, replace=False)
        other[wrong] ^= 1
        rows.append((k, [int(x) for x in other]))
    keyed = spark.createDataFrame(rows, "k int, sig array<smallint>").select("k", minhash._keys().alias("keys"))
    own = spark.createDataFrame([([int(x) for x in base],)], "sig array<smallint>").select(minhash._keys().alias("keys")).first()[0]
    assert len(set(own)) == len(own) == minhash.MINIMA
    assert all(set(r.keys) & set(own) for r in keyed.collect())


def test_minima_differ_as_often_as_sets_do():
    rng = np.random.default_rng(6)
    apart = []
    for _ in range(200):
        tokens = np.unique(rng.integers(-(1 << 62), 1 << 62, 400))
        a, b = tokens[:370], tokens[30:400]  # a similarity of 340 / 400
        apart.append(int((minhash.signature(a) != minhash.signature(b)).sum()))
    assert abs(np.mean(apart) / minhash.MINIMA - 0.15) < 0.015 and max(apart) <= minhash.DISTANCE


def test_near_copies_that_do_not_link_are_not_listed(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for doc in range(160):  # up to four words exchanged link with the base, more do not
        words = list(base)
        for at in rng.choice(len(base), rng.integers(1, 7), replace=False):
            words[at] = f"x{rng.integers(50)}"
        rows.append((doc, " ".join(words)))
    listed, verified = [], minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, tokens: (listed.append([(r.a, r.b) for r in pairs.collect()]), verified(pairs, tokens))[1])
    out = minhash.classed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, out.collect()), key=repr) == expected_components(rows)
    sets = {minhash.similarity.fingerprint(s): set(s.tolist()) for s in (minhash.shingles(t) for _, t in rows)}
    alike = [100 * len(sets[a] & sets[b]) // len(sets[a] | sets[b]) for a, b in listed[1]]
    assert len(rows) > len(alike) and min(alike, default=100) >= 78, (len(alike), min(alike))


def test_parities_never_differ_more_than_sets_do(spark):
    rng = np.random.default_rng(8)
    rows, apart = [], []
    for n in (1, 3, 40, 400, 5000):
        for _ in range(6):
            tokens = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
            x, y = tokens[: rng.integers(1, len(tokens) + 1)], tokens[rng.integers(len(tokens)) :]
            rows.append((len(rows), minhash.parity(x).tolist(), minhash.parity(y).tolist()))
            apart.append(len(np.setxor1d(x, y)))
    bound = spark.createDataFrame(rows, "k int, x array<long>, y array<long>").select("k", minhash._least_difference("x", "y").alias("d")).collect()
    assert all(r.d <= apart[r.k] and (r.d - apart[r.k]) % 2 == 0 for r in bound)
    assert any(r.d > 0.9 * apart[r.k] > 30 for r in bound)


def test_results_keep_their_columns(odd):
    assert [f.dataType.simpleString() for f in minhash.classed(odd).schema] == ["bigint", "bigint", "bigint", "boolean"]
    assert dict(periodic.query(odd).dtypes)["exponent_milli"] == "bigint"
