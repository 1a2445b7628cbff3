import random

import pytest

from lodestrata.llm import decontaminate as D


def brute_tiles(item, doc, least):
    """Greedy string tiling by trying all pairs of places."""
    a, b, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and a[i + n] and b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                best.append((n, -i, -j))
        n, i, j = max(best, default=(0, 0, 0))
        if n < least or n == 0:
            return total
        for k in range(n):
            a[-i + k] = b[-j + k] = False
        total += n


def texts(seed=4):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(8, 30)))) for k in range(15)] + [(50, "lone words here"), (51, ""), (52, None)]
    docs = []
    for n in range(60):
        said = rnd.choices(words, k=rnd.randint(5, 60))
        if n % 3 == 0:
            part = items[n % 15][1].split()
            if n % 2:
                half = len(part) // 2
                part = part[half:] + ["gap"] + part[:half]
            at = rnd.randrange(len(said))
            said[at:at] = part
        docs.append((n, " ".join(said)))
    return docs + [(90, "so Lone WORDS here are"), (91, None), (92, ""), (None, items[0][1]), (93, items[1][1] + " z" * 20_000), (93, items[1][1] + " z" * 20_000)], items


def test_tiles_cover_as_brute_force(spark, documents):
    docs, items = texts()
    held = D.Items([(i, t) for i, t in items if t])
    for _, text in docs[:62]:
        found = {i: n for i, _, n in held.covered(text)}
        for i, item in items:
            words, said = (item or "").split(), (text or "").lower().split()
            want = brute_tiles(words, said, min(5, len(words))) if words else 0
            assert found.get(i, 0) == want, (i, item, text)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_coverage_by_document(spark, documents, monkeypatch, block):
    """block 40: the benchmark is read in several blocks."""
    docs, items = texts()
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, coverage int")
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rows = D.contamination(documents(docs), bench).collect()
    assert len(rows) == len(docs)
    held = D.Items([(i, t) for i, t in items if t])
    for r in rows:
        if r.doc_id is None or r.doc_id == 93:
            assert r.contaminated
            continue
        found = held.covered(dict(docs)[r.doc_id])
        assert r.coverage == pytest.approx(max((c for _, c, _ in found), default=0.0))
        assert r.n_items == sum(c >= 0.75 for _, c, _ in found)
    clean = D.drop_contaminated(documents(docs), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in rows if not r.contaminated)


def test_reordered_halves_are_caught_and_clean_texts_left_alone(spark, documents):
    item = " ".join(f"q{k}" for k in range(20))
    swapped = " ".join([f"q{k}" for k in range(10, 20)] + ["filler"] * 7 + [f"q{k}" for k in range(10)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r.contaminated for r in D.contamination(documents([(1, swapped), (2, "q1 q2 q3 q4 q5 and nothing else"), (3, item.upper())]), bench).collect()}
    assert out == {1: True, 2: False, 3: True}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.coverage, r.contaminated) for r in D.contamination(documents([(1, "a b c")]), none).collect()] == [(0.0, False)]
    assert D.drop_contaminated(documents([(1, "a")]), none).count() == 1
    assert D.contamination(documents([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_ties_of_items(spark, documents, monkeypatch, block):
    """Equal coverage: the least id, one without an id last; among equal ids the one with most words in tiles."""
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    items = [(None, "a b c d e f"), (9, "a b c d e"), (7, "b c d e f"), (None, "a b c d e f"), (12, "u v w x y"), (12, "u v w x y z"), (None, "k l m n o"), (None, "l m n o p")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([(1, "a b c d e f"), (2, "u v w x y z"), (3, "k l m n o p"), (3, "k l m n o p"), (None, "a b c d e f")])
    out = sorted(((str(r.doc_id), r.item_id, r.coverage, r.n_items, r.tiled_words) for r in D.contamination(docs, bench).collect()))
    assert out == [("1", 7, 1.0, 3, 5), ("2", 12, 1.0, 2, 6), ("3", None, 1.0, 2, 5), ("3", None, 1.0, 2, 5), ("None", 7, 1.0, 3, 5)]
