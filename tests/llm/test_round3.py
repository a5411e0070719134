"""Runs, phrases and the shingle join against plain versions; odd rows, hot groups and texts below the threshold."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, phrases, queries, runs
from tidemark.llm.common import read

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, node long, runs string, _k string, prefix string, n long, collapsed string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", "y", "z", 2, "w") for i, t, g in rows], CLASH)


# runs

def plain_runs(w):
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rnd):
    w = []
    for _ in range(rnd.randint(0, 6)):
        base = [rnd.randint(0, rnd.choice([1, 2, 3, 20])) for _ in range(rnd.randint(1, rnd.choice([3, 10, 40])))]
        if rnd.random() < 0.7:
            w += (base * rnd.randint(1, 9))[:rnd.randint(1, 400)]
        elif w:
            a = rnd.randrange(len(w))
            w += w[a:a + rnd.randint(1, 50)]
    return w


@pytest.mark.parametrize("appended", [1, 3, 64, 1 << 17])
def test_runs_caught_while_words_are_appended_equal_all_periods_tried(monkeypatch, appended):
    monkeypatch.setattr(runs, "APPENDED", appended)
    rnd = random.Random(appended)
    for _ in range(60):
        texts = [some_words(rnd) for _ in range(rnd.randint(1, 5))]
        assert runs.runs_of([np.array(w, np.int64) for w in texts]) == [plain_runs(w) for w in texts]


def test_runs_of_very_long_texts_take_linear_work():
    [same], [seven] = runs.runs_of([np.zeros(400_000, np.int64), np.arange(400_000) % 7 + 1])
    assert same == (0, 400_000, 1) and seven == (0, 400_000, 7)


def plain_op12(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_query_equals_a_plain_loop(spark):
    docs = read(spark, SF, "documents").collect()
    got = queries.op12(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(plain_op12(r.doc_id, r.text) for r in docs)
    assert any(r.n_runs for r in got)


def test_runs_of_odd_rows(spark):
    long = "a b c " * 40_000
    rows = [(1, None, None), (2, "", None), (3, " \t\n", None), (4, "x x x x x x y", None), (4, "x x x x x x y", None), (None, "q " * 6, None), (5, long, None)]
    got = runs.find(odd(spark, rows), "doc_id", "text").collect()
    by = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed[:9]) for r in got)
    assert by == Counter([(1, (), ""), (2, (), ""), (3, (), ""), (4, ((0, 6, 1),), "x y"), (4, ((0, 6, 1),), "x y"),
                          (None, ((0, 6, 1),), "q"), (5, ((0, 120_000, 3),), "a b c")])
    assert runs.find(odd(spark, []), "doc_id", "text").count() == 0


# phrases

def plain_phrases(rows, longest=3, least=10, cover=50):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    k = (lang, tuple(w[i:i + m]))
                    f[k] = f.get(k, 0) + 1
    out = set()
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        inside = [x for (k, x), c in f.items() if k == lang and len(x) > len(g) and c >= least and 100 * c >= cover * a
                  and any(x[i:i + len(g)] == g for i in range(len(x) - len(g) + 1))]
        if inside:
            continue
        cuts = [(10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.add((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    return out


def phrase_rows():
    rnd = random.Random(5)
    words = ["The", "cat", "sat,", "on", "mat.", "ÄÖ", "x\x0by", "the", " ", "end!"]
    rows = [(rnd.choice(["en", "de", None]), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for _ in range(60)]
    return [*rows, ("en", None), (None, ""), ("en", "new york city " * 40), ("xx", "one two")]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_equal_a_plain_count(spark, longest):
    rows = phrase_rows()
    df = odd(spark, [(i, t, g) for i, (g, t) in enumerate(rows)])
    got = phrases.collocations(df, "lang", "text", longest=longest).collect()
    assert {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == plain_phrases(rows, longest)
    assert len(got) == len(set(got))


def test_stripes_split_over_parts_and_tasks_merge_to_the_same_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "COUNTED", 50)
    monkeypatch.setattr(phrases, "PARTS", 7)  # every frequent prefix is split
    rows = phrase_rows()
    df = odd(spark, [(i, t, g) for i, (g, t) in enumerate(rows)])
    got = phrases.collocations(df, "lang", "text").collect()
    assert {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == plain_phrases(rows)


def test_a_full_filter_loses_no_phrase(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    rows = phrase_rows()
    df = odd(spark, [(i, t, g) for i, (g, t) in enumerate(rows)])
    got = phrases.collocations(df, "lang", "text").collect()
    assert {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == plain_phrases(rows)


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(odd(spark, []), "lang", "text").count() == 0
    assert phrases.collocations(odd(spark, [(1, None, "en"), (2, "", None)]), "lang", "text").count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_017
    df = spark.createDataFrame([(big, big + 6, big + 14)], "a long, l long, r long")
    exact = lambda x: f"cast({x} as decimal(16, 0))"
    got = df.selectExpr(f"(cast(1000000 as decimal(7, 0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')}) AS s").first()["s"]
    assert got == 10**6 * big * big // ((big + 6) * (big + 14))


# shingle join

def plain_sets(rows, words):
    out = []
    for key, text in rows:
        w = (text or "").encode().lower().split()
        out.append((key, {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()))
    return out


def plain_components(rows, words, over, under):
    sets = plain_sets(rows, words)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            both = len(x & y)
            if both and both * under >= over * (len(x) + len(y) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(sets))


def edited_texts(rnd, families, copies, length, vocabulary=400):
    rows = []
    for _ in range(families):
        base = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(1, length))]
        for _ in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(vocabulary)}"
            if rnd.random() < 0.3:
                w = w[:rnd.randint(1, len(w))]
            rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("words,over,under", [(4, 17, 20), (5, 4, 5)])
def test_components_equal_all_pairs(spark, words, over, under):
    rnd = random.Random(words)
    texts = edited_texts(rnd, 25, 9, 120)
    rows = [*enumerate(texts), (1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "one"),
            (3, texts[3]), (None, texts[5]), (None, "alone in the world of nulls"), (1006, "a b c d e " * 5000), (1007, "a b c d e " * 6000)]
    got = jaccard.near_copies(odd(spark, [(k, t, None) for k, t in rows]), "doc_id", "text", words, over, under).collect()
    assert Counter(map(tuple, got)) == plain_components(rows, words, over, under)


def test_templates_below_the_threshold_try_few_pairs(spark, monkeypatch):
    rnd = random.Random(1)
    template = [f"t{i}" for i in range(40)]
    texts = [" ".join([*(f"own{i}x{k}" for k in range(9)), *template]) for i in range(600)]
    texts += [" ".join([*(f"o{i}x{k}" for k in range(2)), *template]) for i in range(600)]  # alike: one component
    rnd.shuffle(texts)
    tried, check = [], jaccard.verified

    def counted(docs, pairs, *rest):
        tried.append(pairs.count())
        return check(docs, pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = jaccard.near_copies(odd(spark, [(i, t, None) for i, t in enumerate(texts)]), "doc_id", "text").collect()
    sizes = Counter(r.component_id for r in got)
    assert sorted(sizes.values())[-1] == 600 and len(sizes) == 601
    assert sum(tried) < 4 * len(texts)


def test_join_of_no_rows(spark):
    assert jaccard.near_copies(odd(spark, []), "doc_id", "text").count() == 0


# secrets

def test_many_matches_of_one_text_are_placed_in_linear_work(spark):
    from tidemark.llm import secrets

    pattern = r"[0-9]{4,}|\n+"
    for n in (0, 1, 127, 128, 129, 20_000):
        text = "é1234 x\n" * n
        df = spark.createDataFrame([(text,)], "t string").select(secrets.found(F.col("t"), 0, "edit", pattern, 0, 1).alias("f"))
        assert [(s.start, s.end, s.value) for s in df.first().f] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)]


# language

def test_training_windows_come_from_whole_texts(spark):
    from tidemark.llm import langid

    body = "".join(f"{i:05d} ключ " for i in range(3000))
    docs = spark.createDataFrame([(k, body if k % 2 else "короткий", "ru") for k in range(40)], "doc_id long, text string, lang string")
    got = langid.sample(docs, "doc_id", "text", "lang")
    held = {r.doc_id for r in docs.filter(langid.held_out("doc_id")).collect()}
    assert len(got) == 40 - len(held)
    raw = body.encode()
    for parts, _ in got:
        if parts == ["короткий".encode()]:
            continue
        at = [raw.find(w) for w in parts]
        assert len(at) == langid.SAMPLE_WINDOWS and all(a % langid.WINDOW == 0 for a in at) and max(at) > 0.8 * len(raw)
    assert langid.train(got).labels == ["ru"]


def test_fingerprints_link_documents_by_themselves_in_the_pipeline(spark):
    """Texts within two bits whose shingles are less alike than 0.8 are near copies of the pipeline's stage."""
    import random

    import corpus_pipeline
    from tidemark.llm import jaccard, simhash

    rng, known = random.Random(5), jaccard.WordHashes()
    while True:
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(40)]
        other = words[:20] + ["edited"] + words[21:]
        a, b = " ".join(words), " ".join(other)
        if (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() <= 2:
            break
    x, y = set(jaccard.shingles(a, 5, known).tolist()), set(jaccard.shingles(b, 5, known).tolist())
    assert len(x & y) < 0.8 * len(x | y)
    far = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(3, a), (1, b), (2, far), (4, far)], "doc_id long, text string")
    left = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in left) == [1, 2]


def test_copies_around_the_threshold_meet_their_hub(spark, monkeypatch):
    """Of copies whose pairs seldom link, the one with the fewest edits links most: few pairs are left to try."""
    rnd, rows = random.Random(8), []
    words = [f"w{i}" for i in range(600)]
    for i in range(250):
        own = list(words)
        for k in rnd.sample(range(600), 6 + i % 7 if i else 0):
            own[k] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    tried, check = [], jaccard.verified

    def counted(docs, pairs, *rest):
        tried.append(pairs.count())
        return check(docs, pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = jaccard.near_copies(odd(spark, [(k, t, None) for k, t in rows]), "doc_id", "text", 4, 17, 20).collect()
    assert Counter(map(tuple, got)) == plain_components(rows, 4, 17, 20)
    assert sum(tried) < 8 * len(rows)


def test_word_hashes_tell_words_apart():
    known, words = jaccard.WordHashes(), [f"{a}{b}{c}" for a in "abAé-" for b in "ab\x00ß1" for c in ("", "a", "b", "aa", " x")]
    hashes = {w: int(known.of(w.encode())[0]) for w in words}
    assert len({hashes[w] for w in words}) == len({w.encode().lower() for w in words})
    text = " \t" + "\x0b\n ".join(words) + "\r"
    assert known.of(text.encode()).tolist() == [hashes[w] for w in words]
    assert jaccard.shingles("A b  c", 2, known).tolist() == sorted(
        int(jaccard.shingles(t, 2, known)[0]) for t in ("a b", "b c"))
    assert not len(known.of(b" \n")) and not len(known.of(b""))
    long = "x" * 5000 + " " + "y " * 70000
    assert known.of(long.encode())[1:].tolist() == [int(known.of(b"Y")[0])] * 70000
