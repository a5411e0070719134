"""Cases of the second review: each failed before the change it belongs to."""

from __future__ import annotations

import itertools

import numpy as np

import corpus_pipeline
from tidemark.llm import jaccard, pagetext, secrets, simhash
from tests.llm.test_llm_operators import frame, plain_fingerprint


# near copies

def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_copies(rows):
    """Smallest key by all pairs of five-word similarity >= 0.8; equal sets are copies."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def edited_rows():
    """Groups of near copies by one to many edits, chains, a passage in every second text, short and empty texts."""
    rng = np.random.default_rng(3)
    passage = [f"common{i}" for i in range(30)]
    texts = [None, "", "one", "ONE", "a b c d e f", "a b c d e f g"]
    for g in range(12):
        words = [f"w{g}x{i}" for i in range(int(rng.integers(40, 200)))] + passage * (g % 2)
        for c in range(15):
            if g < 3:  # each text is near the one before only
                words = list(words)
            else:
                words = [f"w{g}x{i}" for i in range(100)] + passage * (g % 2)
            for e in rng.integers(0, len(words), 1 if g < 3 else int(rng.integers(0, 4))):
                words[e] = f"edit{g}_{c}_{e}"
            texts.append(" ".join(words))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def test_near_copies_equal_all_pairs(spark):
    rows = edited_rows()
    found = jaccard.near_copies(frame(spark, rows), "doc_id", "text", seeds=simhash.seed_pairs, empty=True)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == plain_copies(rows)


def test_the_stage_joins_copies_with_edited_words(spark):
    words = [f"word{i}" for i in range(300)]
    edited = [f"other{i}" if i in (40, 120, 200) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, "something else stands here and nowhere besides")]
    assert (plain_fingerprint(rows[0][1]) ^ plain_fingerprint(rows[1][1])).bit_count() > 2
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, frame(spark, rows), "").collect()) == [1, 3]


# secrets

def test_a_copied_text_does_not_make_its_secret_an_example(spark):
    live, example = "f0e1d2c3b4a5f6e7d8c9", "a1b2c3d4e5f6a7b8c9d0"
    before, after = [f"b{i}" for i in range(30)], [f"a{i}" for i in range(30)]
    rows = [(i, " ".join([*before, f"token={live}", *after]), f"o{i}") for i in range(5)]
    for i in range(5, 15):  # an edit on one side of the value
        words = [*before, f"token={live}", *after]
        words[28 if i % 2 else 32] = f"edit{i}"
        rows.append((i, " ".join(words), f"o{i}"))
    rows += [(20 + i, f"text {i} {i} says token={example} number {i} {i}", f"o{i}") for i in range(4)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    scanned = secrets.scan(docs, "doc_id", "text", "source", by_passage=True)
    by = {r["doc_id"]: (r["n_live"], r["n_shared"]) for r in scanned.collect()}
    assert by == {i: (1, 0) if i < 20 else (0, 1) for i in by} and len(by) == len(rows)
    marked = corpus_pipeline.secret_marks(spark, docs, "").collect()
    assert not any(live in r["text"] for r in marked) and sum(example in r["text"] for r in marked) == 4


# page text

def test_raw_names_end_at_the_name_and_unclosed_media_hide_nothing():
    for tag in ("svg-icon", "video-js", "audio-player", "select-menu", "template-x"):
        page = f'<article><p>One.</p><{tag} name="x"></{tag}><p>Two three.</p></article>'
        assert pagetext.blocks(page) == (True, ["One.", "Two three."]), tag
    for tag in ("video", "audio", "canvas", "select", "object"):
        assert pagetext.blocks(f"<article><p>One.</p><{tag} id=x><p>Two.</p></article>") == (True, ["One.", "Two."]), tag
        assert pagetext.blocks(f"<article><p>One.</p><{tag}>no</{tag} ><p>Two.</p></article>") == (True, ["One.", "Two."])
    assert pagetext.blocks("<article><p>One.</p><script>no <p>Two.</p>") == (True, ["One."])


def test_a_teaser_article_does_not_replace_the_body():
    body, card = "<p>The body of the page says one thing.</p>", "<article class=card><p>More here.</p></article>"
    text = "The body of the page says one thing."
    assert pagetext.blocks(f"<main>{body}{card}{body}</main>") == (True, [text, "More here.", text])
    assert pagetext.blocks(f"<main>{body}</main>{card}") == (True, [text])
    assert pagetext.blocks(f"<div>{body * 3}</div>{card}") == (False, [text] * 3 + ["More here."])
    assert pagetext.blocks(f"<main><p>More here.</p></main><article>{body}</article>") == (True, [text])
    assert pagetext.blocks(f"<div>unmarked</div><article>{body}</article>") == (True, [text])
