import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402

from lodestrata.llm import bpe  # noqa: E402
from tests.llm.test_near_dedup import brute  # noqa: E402


def make(seed=6):
    rnd = random.Random(seed)
    words = [f"term{k}" for k in range(500)]
    docs, labels = [], []
    for i in range(300):
        said = rnd.choices(words, k=rnd.randint(20, 60))
        toxic = i % 5 == 0
        if toxic:
            said[3] = "vilecreature"
        docs.append((i, " ".join(said)))
        labels.append((i, 1, int(toxic)))
    plain = [d for d in docs if d[0] % 5]
    item = " ".join(rnd.choices(words, k=25))
    docs += [(400, plain[0][1]), (401, plain[0][1]), (402, plain[1][1] + " more"), (403, plain[2][1] + " " + item), (404, None), (405, "")]
    return docs, labels, [(1, item)]


def test_stages_one_after_another(spark, documents, tmp_path):
    docs, labels, items = make()
    documents(docs).drop("component_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}

    texts = {i: t or "" for i, t in docs if "vilecreature" not in (t or "")}
    largest = {t: max(j for j in texts if texts[j] == t) for t in set(texts.values())}
    texts = {i: t for i, t in texts.items() if largest[t] == i}
    near = brute(list(texts.items()))
    texts = {i: t for i, t in texts.items() if near[i][1] == i}
    texts = {i: t for i, t in texts.items() if items[0][1] not in t}
    assert set(rows) == set(texts)
    codec = bpe.codec_of(bpe.vocabulary())
    assert all(rows[i].n_tokens == len(codec.encode(t)) for i, t in texts.items())


def test_stages_keep_the_columns(spark, documents, tmp_path):
    docs, labels, items = make()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = documents(docs).drop("component_id")
    assert len(P.STAGES) == 5
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
