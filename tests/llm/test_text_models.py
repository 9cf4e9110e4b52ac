"""Language model scores, phrases and fill-in-the-middle: against brute force, and on rows nobody likes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import catalog, infill, language, lattice, oracles, phrases, simhash, subwordlm

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing names."""
    rows = [
        (1, None, None),
        (2, "", "en"),
        (3, " \t\n ", "en"),
        (4, "The cat and the dog. The cat and the dog!", "en"),
        (4, "The cat and the dog. The cat and the dog!", "en"),
        (4, "another text under the same id", "de"),
        (5, "the cat and the dog sat on the mat", None),
        (6, "x" * 150_000, "en"),
        (7, "der Hund und die Katze; " * 9_000, "de"),
        (8, " " * 20_000 + "a" + " " * 33, "de"),
        (9, "日本語の長い文に空白はない" * 60 + " é\x00\x1c\x85 a", "ja"),
        (10, "a <P> in the text", "en"),
        (11, "<", "en"),
        (-12, "ends with <", "en"),
        (None, "no id here, none at all", "en"),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("id", "word", "n", "phrase", "prefix", "row", "frames", "form", "score", "first", "held_out", "segment"):
        df = df.withColumn(name, F.lit("taken"))
    return df.repartition(3)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# The lattice

PIECES = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"ba", b"cab", b" a", b" ab", "é".encode(), b"bcabca"]


def summed(word, weight):
    """Probability of a word and expected use of each piece, position by position."""
    n = len(word)
    places = [(t, i) for t in range(n) for i, p in enumerate(PIECES) if word[t : t + len(p)] == p]
    ahead, after = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for t, i in places:
        ahead[t + len(PIECES[i])] += ahead[t] * weight[i]
    for t, i in reversed(places):
        after[t] += weight[i] * after[t + len(PIECES[i])]
    use = np.zeros(len(PIECES))
    for t, i in places:
        use[i] += ahead[t] * weight[i] * after[t + len(PIECES[i])] / ahead[n]
    return math.log(ahead[n]), use


@pytest.mark.parametrize(("long", "window"), [(256, 1 << 14), (5, 7), (0, 1)])
def test_lattice(monkeypatch, long, window):
    monkeypatch.setattr(lattice, "LONG", long)
    monkeypatch.setattr(lattice, "WINDOW", window)
    rng = random.Random(3)
    weight = np.array([rng.random() for _ in PIECES])
    weight /= weight.sum()
    words = [bytes(rng.choice(b" abc") for _ in range(rng.randrange(1, 40))) for _ in range(40)] + ["éabé".encode()]
    times, trie = np.arange(1.0, len(words) + 1), lattice.Trie(PIECES)
    known = [summed(w, weight) for w in words]
    found = lattice.forward(trie, words, np.log(weight)[:, None])[:, 0]
    assert np.allclose(found, [x for x, _ in known], rtol=1e-12)
    use = lattice.expected(trie, words, times, np.log(weight))
    assert np.allclose(use, sum(t * u for t, (_, u) in zip(times, known, strict=True)), rtol=1e-9)


def test_lattice_of_a_long_word():
    trie, weight = lattice.Trie(PIECES), np.full((len(PIECES), 1), -math.log(len(PIECES)))
    word = b"abc" * 2000
    whole = lattice.forward(trie, [word], weight)[0, 0]
    assert math.isfinite(whole) and whole < -3000
    halves = sum(lattice.forward(trie, [word[:3000], word[3000:]], weight)[:, 0])
    assert whole > halves  # segmentations across the middle count too


# Language model scores


def tokens_of(text):
    return [*re.findall("[^\x20\x09-\x0d]+", lowered(text)), None]


def base_scores(docs):
    """Per row: tokens, known ones and the score of the word model."""
    trained = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(x for t in trained for x in tokens_of(t))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, text in docs:
        tokens = tokens_of(text)
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens)
        out.append((i, len(tokens), sum(counts[x] > 0 for x in tokens), total, base))
    return out


def check_base(rows, docs):
    found = sorted(((r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
    known = sorted(base_scores(docs), key=str)
    assert [x[:4] for x in found] == [x[:4] for x in known]
    assert np.allclose([x[4] for x in found], [x[4] for x in known], rtol=1e-9)


@pytest.mark.parametrize("shares", [400_000, 300])
def test_language_model(spark, monkeypatch, shares):
    monkeypatch.setattr(subwordlm, "SHARES", shares)
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [r for r in QUERIES["op11_subword_lm"](spark, FOLDER).withColumnRenamed("doc_id", "id").collect()]
    docs = [(r.doc_id, r.text) for r in df.collect()]
    check_base(rows, docs)
    assert {r.id for r in rows if r.held_out} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}


def test_scores_are_log_probabilities(spark):
    docs = spark.createDataFrame([(i, "ab abc ba ab cab") for i in range(20)], "doc_id long, text string")
    model, counts = subwordlm.train(docs, "text", F.lit(True), catalog.PIECE_BPE)
    assert math.isclose(np.exp(model.weight).sum() + math.exp(model.end), 1)
    weight = dict(zip(model.pieces, np.exp(model.weight), strict=True))

    def chance(word):
        ahead = [1.0] + [0.0] * len(word)
        for t in range(1, len(word) + 1):
            ahead[t] = sum(ahead[s] * weight.get(word[s:t], 0.0) for s in range(t))
        return ahead[-1]

    text = "Ab zzz ab\tcab  été"
    other = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = subwordlm.score(other, "doc_id", "text", model, counts, F.lit(True)).first()
    expected = math.log10(math.exp(model.end)) + sum(math.log10(chance(b" " + w)) for w in lowered(text).encode().split())
    assert math.isclose(row.score, expected, rel_tol=1e-9)
    learnt = subwordlm.score(docs.limit(1), "doc_id", "text", model, counts, F.lit(True)).first()
    first = subwordlm.train(docs, "text", F.lit(True), catalog.PIECE_BPE, rounds=0)[0]
    untrained = subwordlm.score(docs.limit(1), "doc_id", "text", first, counts, F.lit(True)).first()
    assert learnt.score > untrained.score + 5


def test_language_model_on_odd_rows(odd):
    out = subwordlm.held_out(F.col("doc_id"))
    model, counts = subwordlm.train(odd, "text", ~out, catalog.PIECE_BPE)
    rows = subwordlm.score(odd, "doc_id", "text", model, counts, out).collect()
    check_base(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert all(r.held_out for r in rows if r.id is None)
    assert subwordlm.score(odd.limit(0), "doc_id", "text", model, counts, out).collect() == []
    model, counts = subwordlm.train(odd.limit(0), "text", ~out, catalog.PIECE_BPE)
    rows = subwordlm.score(odd, "doc_id", "text", model, counts, out).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in rows} == {(0, 0, 0.0)}
    assert all(r.score <= math.log10(0.5) + 1e-9 for r in rows)


# Phrases


def collocations(rows, first, least):
    """All phrases counted one by one."""
    found, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            listed = re.findall("[^ \t]+", piece)
            words[lang] += len(listed)
            for k in range(1, 5):
                found.update((lang, tuple(listed[i : i + k])) for i in range(len(listed) - k + 1))
    chosen = {p: a for p, a in found.items() if len(p[1]) >= 2 and a >= least}
    covered = set()
    for (lang, p), a in chosen.items():
        for k in range(2, len(p)):
            parts = [(lang, p[i : i + k]) for i in range(len(p) - k + 1)]
            covered.update(s for s in parts if 100 * a >= 80 * found[s])
    listed = {}
    for (lang, p), a in chosen.items():
        if (lang, p) not in covered:
            cuts = [(2_000_000 * a // (found[lang, p[:k]] + found[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            row = (-score, -a, " ".join(p).encode(), found[lang, p[:k]], found[lang, p[k:]])
            listed.setdefault(lang, []).append(row)
    return {
        (lang, place, p.decode(), -a, x, y, words[lang], -score)
        for lang, own in listed.items()
        for place, (score, a, p, x, y) in enumerate(sorted(own)[:first], 1)
    }


@pytest.mark.parametrize(("first", "least", "shares", "size"), [(2000, 30, 20_000, 12 << 20), (40, 5, 60, 50_000)])
def test_phrases(spark, first, least, shares, size):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)
    rows = phrases.collocations(df, "text", "lang", first, least, 4, shares, size).collect()
    known = collocations([(r.text, r.lang) for r in df.collect()], first, least)
    assert len(rows) == len(known) >= 40 and {tuple(r) for r in rows} == known


def test_phrases_of_odd_rows(odd):
    rows = phrases.collocations(odd, "text", "lang", 50, 2, 4, 10, 3_000).collect()
    known = collocations([(r.text, r.lang) for r in odd.collect()], 50, 2)
    assert {tuple(r) for r in rows} == known and {r.lang for r in rows} >= {"en", "de"}
    assert phrases.collocations(odd.limit(0), "text", "lang").collect() == []
    assert phrases.collocations(odd.filter("doc_id < 4"), "text", "lang").collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = spark.createDataFrame([(big, [big, big], [big, big])], "a long, lefts array<long>, rights array<long>")
    (row,) = phrases.scored(rows).collect()
    assert (row.score, row.l, row.r) == (1_000_000, big, big)


# Fill in the middle


def reopened(out):
    units, chars, sizes, inside, data = zip(*out.frames, strict=True) if out.frames else ((),) * 5
    return infill.Frames(units, chars, sizes, inside, list(data), (out.units, out.chars, out.bytes))


@pytest.mark.parametrize("size", [4, 7, 64, 1 << 16])
def test_frames(size):
    rng = random.Random(size)
    letters = ["a", "bc", "é", "日", ".", "<", " ", ">", "P", "S", "M", "xyz"]
    for _ in range(200):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 60)))
        if re.search("<[PSM]>", text):
            continue
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        packed = infill.pack_text(text.encode(), size)
        store = reopened(packed)
        assert (packed.units, packed.chars, b"".join(store).decode()) == (len(units), len(text), text)
        a, b = sorted(rng.randrange(len(units) + 1) for _ in range(2))
        prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        for form, whole in (
            ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}"),
            ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}"),
        ):
            out, prefix_chars, middle_chars = infill.marked_text(store, form, a, b, size)
            again = reopened(out)
            assert b"".join(again).decode() == whole and (prefix_chars, middle_chars) == (len(prefix), len(middle))
            assert (out.units, out.chars) == (len(re.findall("[A-Za-z]+|[^A-Za-z]", whole)), len(whole))
            assert b"".join(reopened(infill.plain_text(again, form, size))).decode() == text


def test_only_frames_with_a_cut_are_decompressed(monkeypatch):
    store, opened = reopened(infill.pack_text(b"word " * 100_000, 1 << 12)), []
    plain = infill.Frames.__getitem__
    monkeypatch.setattr(infill.Frames, "__getitem__", lambda self, k: opened.append(k) or plain(self, k))
    infill.marked_text(store, "psm", 50_001, 150_002, 1 << 12)
    assert len(store.data) > 100 and len(set(opened)) <= 3


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_of_odd_rows(odd):
    for size in (1 << 16, 50):
        marked = infill.rearrange(infill.place(infill.pack(odd, "doc_id", "text", size)), size)
        known = Counter(by_hand(r.doc_id, r.text) for r in odd.collect())
        found = Counter((r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in infill.texts(marked).collect())
        assert found == known
        back = infill.texts(infill.restore(marked, size)).collect()
        assert Counter((r.id, r.text) for r in back) == Counter((r.doc_id, r.text or "") for r in odd.collect())
        for r in infill.digests(marked, "hash").join(infill.round_trip(marked, size), "id").filter("id in (6, 7, 9)").collect():
            assert r["hash"] == r.output_sha256
    assert infill.round_trip(infill.rearrange(infill.place(infill.pack(odd.limit(0), "doc_id", "text")))).collect() == []


@pytest.mark.parametrize("name", ["op12_phrases", "op13_infill"])
def test_queries_equal_their_definitions(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    result = db.execute(oracles.ORACLES[name])
    names = [d[0] for d in result.description]
    rows = QUERIES[name](spark, FOLDER).select(*names).collect()
    assert rows and sorted(map(tuple, rows), key=str) == sorted(result.fetchall(), key=str)


# Long words and rows that share an id


def test_language_of_words_longer_than_a_stretch():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" ab", b"abab", b"ba", "語の".encode(), b"a" * 40})
    rng = np.random.default_rng(5)
    chance = rng.random((len(pieces), 2))
    chance /= chance.sum(axis=0)
    model = language.Model(["a", "b"], pieces, chance)
    words = [b" " + b"ab" * 16, b" " + b"ab" * 250, b" " + "日本語の".encode() * 40, b" " + b"a" * 333, b" short"]
    found = language.word_scores(model, words)
    for word, row in zip(words, found, strict=True):
        for k in range(2):
            known, scale = dict(zip(pieces, chance[:, k].tolist(), strict=True)), 0.0
            ahead = [1.0]
            for t in range(1, len(word) + 1):
                ahead.append(sum(ahead[s] * known.get(word[s:t], 0.0) for s in range(max(0, t - 40), t)))
                if ahead[-1] < 1e-200:
                    ahead, scale = [x * 1e200 for x in ahead], scale - 200 * math.log(10)
            assert math.isclose(row[k], math.log(ahead[-1]) + scale, rel_tol=1e-9)


def test_pieces_across_every_place_count():
    pieces = sorted({bytes([b]) for b in range(256)} | {b"zq"})
    chance = np.full((len(pieces), 2), 1 / len(pieces))
    chance[pieces.index(b"zq")] = [0.1, 0.0005]
    model = language.Model(["a", "b"], pieces, chance)
    for length in (20, 31, 32, 33, 64, 300):
        (row,) = language.word_scores(model, [b" " + b"x" * length + b"zq"])
        assert row[0] - row[1] > 4


def test_expected_use_of_long_words():
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"abc"})
    words, weights = [b" abc" * 4, b" abc" * 30, b" " + b"abc" * 200], np.array([2.0, 1.0, 3.0])
    counts = language.fit_words(words, weights, pieces, 3)
    assert math.isclose((counts * [len(p) for p in pieces]).sum(), sum(w * len(x) for w, x in zip(weights, words, strict=True)))


def test_near_duplicates_lose_no_row(spark, odd):
    text, other = "one two three four five six seven eight nine ten", "quite another text that shares no word at all with it"
    rows = [(1, text), (1, other), (2, text), (2, "a third one of its own kind here"), (None, text), (None, other + " but more")]
    rows += [(None, other + " but more"), (7, None), (8, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("taken")).withColumn("_row", F.lit(1))
    kept = simhash.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    expected = [(1, text), (1, other), (2, "a third one of its own kind here"), (7, None), (None, text)]
    expected += [(None, other + " but more")] * 2  # rows without an id cannot be named
    assert found == sorted(expected, key=str)
    assert simhash.keep_one(df.limit(0), "doc_id", "text").collect() == []
    again = simhash.keep_one(odd, "doc_id", "text").collect()
    assert {r.doc_id for r in again} >= {1, 4, 6, 7, 8, 9} and len(again) == len({(r.doc_id, r.text) for r in again})
    assert sorted(r.text for r in again if r.doc_id == 4) == sorted({r.text for r in odd.collect() if r.doc_id == 4})
