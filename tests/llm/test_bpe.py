import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from lodestrata.llm import bpe  # noqa: E402

PATH = bpe.vocabulary()
CODEC = bpe.codec_of(PATH)
THEIRS = tokenizers.Tokenizer.from_file(PATH)


def theirs(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    return ids, THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="aAbt'sll 1٣\n\t\x1f\x85 é漢😀.,!<|>endoftext")))
def test_same_as_the_library(text):
    ids, again = theirs(text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == again


def test_long_words_by_heap_equal_the_scan():
    rnd = random.Random(1)
    for n in (2, 5, 50, 400):
        word = "".join(rnd.choices("thean oris", k=n)).encode()
        assert CODEC._by_heap(word) == CODEC._by_scan(word)
    ids, _ = theirs("ab" * 3000)
    assert CODEC.encode("ab" * 3000) == ids


def test_the_cache_keeps_its_bound_and_its_results():
    words = bpe.Words(CODEC.encode_word, limit=3)
    first = [words[w] for w in "abcdefg"]
    assert [words[w] for w in "abcdefg"] == first and len(words) <= 3


def test_columns(spark, documents):
    texts = [(1, "Hello there"), (2, None), (3, ""), (None, "x"), (1, "Hello there"), (4, "é" * 30_000), (5, "<|endoftext|> a")]
    out = bpe.digests(documents(texts), PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts:
        ids, again = theirs(t or "")
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(again)))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)
    coded = bpe.encode_texts(documents(texts), PATH, decoded=False)
    assert {r.doc_id: r.text_again for r in bpe.decode_ids(coded, PATH).collect()}[4] == "é" * 30_000
    assert bpe.digests(documents([]), PATH).count() == 0
