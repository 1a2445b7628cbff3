import random
import zlib

import pytest

from lodestrata.llm import toxicity as T

BAD = ["scumbag", "moronic", "dreadful"]


def make(n=600, seed=2):
    rnd = random.Random(seed)
    words = [f"plain{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        said = rnd.choices(words, k=rnd.randint(5, 80))
        if toxic:
            said[rnd.randrange(len(said))] = rnd.choice(BAD)
        docs.append((i, " ".join(said)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark, documents):
    docs, labels = make()
    return T.learn(documents(docs).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_folding():
    assert T.folded("ѕсum 5CUM s​cum ｓｃｕｍ") == ["scum"] * 4
    assert T.folded("1oser LOSER loser") == ["ioser"] * 3
    assert T.folded(None) == [] == T.folded("")


def test_lexicon_and_held_out_accuracy(spark, documents, learned):
    assert {T.folded(w)[0] for w in BAD} <= set(learned.weights)
    docs, labels = make(seed=9)
    toxic = {i: t for i, _, t in labels}
    scores = {r.doc_id: r.score for r in T.score_texts(documents(docs), learned).collect()}
    held = [i for i in toxic if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scores[i] >= 0.3) == toxic[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= s <= 1 for s in scores.values())


def test_disguises_and_exceptions(learned):
    automaton = learned.automaton()
    score = lambda text: T.weigh(T.folded(text), automaton)
    assert score("you m0r0nic thing") > 0 and score("you moronically") == 0
    spared = T.Lexicon({"trash": 2.0}, ("trash can",)).automaton()
    assert T.weigh(T.folded("a trash can here"), spared) == 0 and T.weigh(T.folded("such trash, can it"), spared) == 0
    assert T.weigh(T.folded("utter trash"), spared) == 2.0


def test_brute_force_agrees(spark, documents, learned):
    docs, _ = make(80, 4)
    found = {r.doc_id: r.raw for r in T.score_texts(documents(docs), learned).collect()}
    for i, text in docs:
        assert found[i] == pytest.approx(sum(learned.weights.get(w, 0.0) for w in T.folded(text)))


def test_odd_rows(spark, documents, learned):
    rows = [(1, None), (2, ""), (None, "scumbag"), (3, "scumbag " * 20_000), (3, "scumbag " * 20_000), (4, "fine words")]
    out = T.score_texts(documents(rows), learned).collect()
    assert len(out) == 6 and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    kept = T.drop_toxic(documents(rows), learned)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4} and "component_id" in kept.columns
    none = T.learn(documents(rows).select("doc_id", "text"), spark.createDataFrame([(4, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int"))
    assert {r.score for r in T.score_texts(documents(rows), none).collect()} == {0.0}
    assert T.score_texts(documents([]), learned).count() == 0


def test_folding_of_compatibility_capitals_accents_and_underscores():
    capitals = ["".join(chr(start + ord(c) - 65) for c in "IDIOT") for start in (0x1D400, 0x1D5D4, 0xFF21, 0x1F130, 0x24B6)]
    assert [T.folded(x) for x in capitals] == [["idiot"]] * 5
    assert T.folded("ïdïöt İDIOT ïdiot _idiot_ an_ıdea") == ["idiot"] * 4 + ["an", "ıdea"]
    assert T.folded("ガギ 한국 ёй") == ["ガギ", "한국", "eи"]


def test_exceptions_against_brute_force_and_in_long_texts():
    import time

    rnd = random.Random(8)
    lexicon = T.Lexicon({"a": 1.0, "b": 2.0, "c": 4.0, "d": 8.0}, ("a b", "b c d", "c", "x a"))
    automaton = lexicon.automaton()
    for _ in range(300):
        words = rnd.choices("abcdxyz", k=rnd.randint(0, 25))
        spared = {(i, i + len(p.split())) for p in lexicon.exceptions for i in range(len(words)) if words[i : i + len(p.split())] == p.split()}
        want = sum(lexicon.weights[w] for i, w in enumerate(words) if w in lexicon.weights and not any(x <= i < y for x, y in spared))
        assert T.weigh(words, automaton) == want
    start = time.perf_counter()
    assert T.weigh(["a", "b", "d"] * 200_000, automaton) == 200_000 * 8.0
    assert time.perf_counter() - start < 20
