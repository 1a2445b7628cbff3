import random
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm import near_dedup as M
from lodestrata.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """{doc_id: (size, component)} by comparing all pairs."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def told(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def corpus(seed=3, families=12, copies=9):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rnd.choices(words, k=30))
    rows = []
    for _ in range(families):
        base = rnd.choices(words, k=rnd.randint(20, 120))
        for c in range(copies):
            own = list(base)
            for _ in range(c % 5):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append(" ".join(own) + (" " + passage if c == 3 else ""))
    rows += [passage + " " + " ".join(rnd.choices(words, k=6)) for _ in range(60)]
    rows += ["", None, " \t\n", "One two", "ONE  two", "é É", "a b c d e", "a b c d e a b c d e", "w " * 3000]
    rnd.shuffle(rows)
    return list(enumerate(rows, 10))


def test_shingles_hash_like_word_tuples():
    shingler = M.Shingler()
    for text in ["a b c d e f g", "A  B\tc\x0bd\ne f", "x", "", None, " a b c d e f", "a b c d e " * 50, "w " * 20000]:
        assert len(shingler(text)) == len(shingles(text))
    assert np.intersect1d(shingler("a b c d e f"), shingler("z b c d e f")).size == 1


@pytest.mark.parametrize("most", [32, 0])
def test_same_as_all_pairs(spark, documents, monkeypatch, most):
    """most 0: every key with several components goes through the rarest shingles."""
    monkeypatch.setattr(M, "PAIRS_PER_MEMBER", most)
    rows = corpus()
    out = M.near_duplicates(documents(rows))
    assert told(out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_repeated_rows_null_ids_and_empty_table(spark, documents):
    text = " ".join(f"k{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (None, "other words of a text that nobody has"), (None, None), (7, text + " z"), (8, None)]
    out = sorted(M.near_duplicates(documents(rows)).collect(), key=str)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in out) == sorted(
        map(str, [(5, 36, 5, True), (5, 36, 5, True), (None, 36, 5, False), (None, 4, None, False), (None, 0, None, False), (7, 37, 5, False), (8, 0, 8, True)])
    )
    assert M.near_duplicates(documents([])).count() == 0


def test_keeps_one_row_of_each_group_with_its_columns(spark, documents):
    rows = corpus(5, 4, 6)
    docs = documents(rows)
    kept = M.drop_near_duplicates(docs)
    want = {i for i, (_, c) in brute(rows).items() if i == c}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = defaultdict(lambda: None, {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300})
    assert found == dict(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_largest_component_does_not_depend_on_order(spark):
    rows = [(1, 10, 1), (1, 30, 1), (1, 20, 1), (2, 5, 3), (2, 6, 1)]
    for seed in range(6):
        dealt = random.Random(seed).sample(rows, len(rows))
        found = M._largest(spark.createDataFrame(dealt, "key long, component long, members long").coalesce(1)).collect()
        assert sorted(map(tuple, found)) == [(1, 30, 3), (2, 5, 2)]
