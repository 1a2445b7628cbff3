import hashlib

from pyspark.sql import functions as F

from lodestrata.llm import exact_dedup as D


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (6, "x" * 100_000), (None, "a")]


def test_groups_keep_the_largest_id(spark, documents):
    out = D.new_index(spark).add(documents(ROWS)).collect()
    assert len(out) == len(ROWS)
    got = sorted(((str(r.doc_id), r.keep_id, r.group_size, bytes(r.digest).hex()) for r in out), key=str)
    want = []
    for i, t in ROWS:
        group = [j for j, u in ROWS if (u or "") == (t or "")]
        want.append((str(i), max([j for j in group if j is not None], default=None), len(group), sha(t)))
    assert [x for x in got if x[1] is not None] == sorted((x for x in want if x[1] is not None), key=str)
    assert sum(x[1] is None for x in got) == 2


def test_a_second_batch_meets_the_index(spark, documents):
    index = D.new_index(spark)
    index.add(documents([(1, "a"), (2, "b"), (3, "b")])).collect()
    second = {r.doc_id: (r.keep_id, r.group_size, r.seen_before) for r in index.add(documents([(9, "b"), (10, "c")])).collect()}
    assert second == {9: (3, 3, True), 10: (10, 1, False)}
    assert index.rows().count() == 3
    later = D.DigestIndex(spark.newSession(), index.location)  # knows nothing but the place
    assert later.rows().count() == 3
    assert {r.doc_id: r.seen_before for r in later.add(documents([(11, "c"), (12, "d")])).collect()} == {11: True, 12: False}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_run")]


def told(rows):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.seen_before) for r in rows.collect())


def test_a_batch_may_be_repeated(spark, documents, monkeypatch):
    index = D.new_index(spark)
    index.add(documents([(1, "a"), (2, "b")]), batch="one").collect()
    batch = documents([(3, "b"), (4, "c"), (5, "c")])
    first = told(index.add(batch, batch="two"))
    assert told(index.add(batch, batch="two")) == first == [(3, 2, 2, True), (4, 5, 2, False), (5, 5, 2, False)]
    index.add(documents([(6, "c"), (7, "d")]), batch="three").collect()
    assert told(index.add(batch, batch="two")) == first and index.rows().count() == 4
    assert [r.doc_id for r in D.drop_repeats(index, batch, batch="two").collect()] == [5]
    # a writer that fails before its list is published leaves no trace
    monkeypatch.setattr(D.DigestIndex, "_publish", lambda *_: 1 / 0)
    try:
        index.add(documents([(8, "e")]), batch="four")
    except ZeroDivisionError:
        monkeypatch.undo()
    assert index.rows().count() == 4
    assert told(index.add(documents([(8, "e")]), batch="four")) == [(8, 8, 1, False)]


def test_two_writers(spark, documents):
    import pytest

    index = D.new_index(spark)
    number, runs = index._state()
    index.add(documents([(1, "a")])).collect()
    with pytest.raises(RuntimeError):
        index._publish(number + 1, runs)


def test_many_runs_become_one(spark, documents, monkeypatch):
    monkeypatch.setattr(D, "MOST_RUNS", 2)
    monkeypatch.setattr(D, "ROWS_A_FILE", 3)
    index = D.new_index(spark)
    for k in range(4):
        index.add(documents([(i, f"t{i // 2}") for i in range(6 * k, 6 * k + 8)]), batch=f"b{k}").collect()
    _, runs = index._state()
    assert len(runs) < 3 and sum(r["rows"] for r in runs) == index.rows().count() == 13
    before = sorted(map(str, index.rows().collect()))
    index.compact()
    index.remove_old()
    assert len(index._state()[1]) == 1 and sorted(map(str, index.rows().collect())) == before
    assert told(index.add(documents([(0, "t0"), (1, "t0")]), batch="b0")) == [(0, 1, 2, False), (1, 1, 2, False)]


def test_merge_join_reads_a_run_as_it_lies(spark, documents):
    index = D.new_index(spark)
    index.add(documents([(i, f"t{i}") for i in range(50)])).collect()
    batch = documents([(i, f"t{i}") for i in range(40, 60)]).select(D.text_digest(F.col("text")).alias("digest"))
    with index._in_order():
        known = index._table(index._state()[1][0]).select("digest").hint("merge")
        plan = batch.join(known, "digest", "left_anti")
        told = plan._jdf.queryExecution().executedPlan().toString()
    known_side = told[told.index("FileScan parquet") - 200 :]
    assert "SortMergeJoin" in told and "Exchange" not in known_side and "Sort [" not in known_side
    assert plan.count() == 10


def test_rows_that_stay(spark, documents):
    docs = documents(ROWS)
    kept = D.drop_repeats(D.new_index(spark), docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("2", "a"), ("4", ""), ("5", "b"), ("None", "c"), ("6", "x" * 100_000)])
    assert D.drop_repeats(D.new_index(spark), documents([])).count() == 0
