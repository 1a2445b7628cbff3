import random
import zlib

import numpy as np

from lodestrata.llm import quality as Q


def make(n=800, seed=1):
    rnd = random.Random(seed)
    words = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(100)]
    docs, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        said = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        if not good:
            said = said[:3] * 25 if i % 2 else [w.upper() + "!!" for w in said]
        docs.append((i, " ".join(said)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark, documents):
    docs, labels = make()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.learn(documents(docs).select("doc_id", "text"), table)
    assert 0.6 <= model.prior <= 0.95
    good = {i: q for i, q, _ in labels}
    scores = {r.doc_id: r.score for r in Q.score_texts(documents(docs), model).collect()}
    held = [i for i in good if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scores[i] >= 0.3) == good[i] for i in held) >= 0.95 * len(held)


def test_risk_stays_non_negative_and_prior_is_found():
    rnd = np.random.default_rng(0)
    p = rnd.normal(2, 1, (2000, 2))
    u = np.concatenate([rnd.normal(2, 1, (1400, 2)), rnd.normal(-2, 1, (600, 2))])
    model = Q.fit(p, u)
    assert abs(model.prior - 0.7) < 0.08
    assert (model.score(rnd.normal(2, 1, (500, 2))) >= 0.5).mean() > 0.9 > 0.1 > (model.score(rnd.normal(-2, 1, (500, 2))) >= 0.5).mean()


def test_odd_rows(spark, documents):
    docs, labels = make(200)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.learn(documents(docs).select("doc_id", "text"), table)
    rows = [(1, None), (2, ""), (None, "x"), (3, "y " * 50_000), (3, "y " * 50_000), (4, "\u0000😀 漢字")]
    out = Q.score_texts(documents(rows), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert Q.learn(documents([]).select("doc_id", "text"), table) is None
    assert {r.score for r in Q.score_texts(documents(rows), None).collect()} == {1.0}


def plain_grams(text):
    """Shares of hashed trigrams, character by character."""
    said = f" {' '.join(text.lower().split())} "
    counts = [0] * (1 << Q.GRAM_BITS)
    for a, b, c in zip(said, said[1:], said[2:]):
        mixed = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % 2**32
        counts[((mixed ^ mixed >> 15) * 0x2C1B3C6D % 2**32) >> (32 - Q.GRAM_BITS)] += 1
    return [(n / sum(counts)) ** 0.5 for n in counts]


def test_trigrams_of_whole_texts_by_brute_force(monkeypatch):
    texts = ["a", "The quick brown fox", "😀 漢字\tÉÉ  x\n", "abc " * 300]
    for piece in (Q.PIECE, 7, 1):
        monkeypatch.setattr(Q, "PIECE", piece)
        for text in texts:
            assert np.allclose(Q.features(text)[Q.SURFACE :], plain_grams(text), atol=1e-6)


def test_scores_by_brute_force(spark, documents):
    """Every score of a learned model, computed anew from its weights, one number at a time."""
    docs, labels = make(300)
    model = Q.learn(documents(docs).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = docs + [(1000, None), (1001, "Something else entirely.\n" * 40)]
    scores = {r.doc_id: r.score for r in Q.score_texts(documents(rows), model).collect()}
    assert len(scores) == len(rows)
    for i, text in rows:
        x = [min(4.0, max(-4.0, (float(v) - m) / s)) for v, m, s in zip(Q.features(text), model.mean, model.scale, strict=True)]
        terms = [1.0, *x, *(v * v / 4 for v in x[: Q.SURFACE])]
        z = sum(w * t for w, t in zip(map(float, model.weights), terms, strict=True))
        assert abs(scores[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_direction_is_the_gradient_of_the_risk():
    rnd = np.random.default_rng(3)
    p, u = rnd.normal(1, 1, (40, 3)), rnd.normal(0, 1, (60, 3))

    def terms(w, prior):
        f = lambda x: 1 / (1 + np.exp(-(x @ w)))
        return prior * -np.log(f(p)).mean(), -np.log(1 - f(u)).mean() - prior * -np.log(1 - f(p)).mean()

    signs = set()
    for w, prior in ((np.array([0.1, -0.2, 0.3]), 0.4), (np.array([1.5, 1.0, 1.2]), 0.95)):
        rest, direction = Q.slope(p, u, prior, w)
        assert abs(rest - terms(w, prior)[1]) < 1e-9
        signs.add(rest >= 0)
        goal = (lambda w: sum(terms(w, prior))) if rest >= 0 else (lambda w: -terms(w, prior)[1])
        for k in range(3):
            step = np.eye(3)[k] * 1e-6
            assert abs((goal(w + step) - goal(w - step)) / 2e-6 - direction[k]) < 1e-5
    assert signs == {True, False}
