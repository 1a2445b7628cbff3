import random

import duckdb
import pytest

from lodestrata.llm import url_filter as U

URLS = [
    "https://Example.ORG/es/1?utm_source=a", "http://www.example.org/en/1", "http://sub.example.org/en/12#x", "https://shop.com/fr/", "https://shop.com/de/a?b=2&a=1", "ftp://x.net", "no scheme", "",
    None, "://", "http:///path", "https://b.net/p/?ref=1", "https://www.b.net/p", "https://b.net/p?q=1", "http://notexample.org/es/", "http://example.org:80/es/", "http://a\nb.org/x",
]


def pages(spark, urls=URLS):
    return spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")


def brute(url, listed, rules=U.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([k for c in "?#" if (k := tail.find(c)) >= 0], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else ("block" if listed else "allow")


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("blocks", [1 << 20, 0])
def test_verdicts(spark, monkeypatch, joined, blocks):
    """blocks 0: the Bloom filter is joined by block; joined: rules as a table."""
    monkeypatch.setattr(U, "MAX_BROADCAST_BLOCKS", blocks)
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string") if joined else U.RULES
    listed = spark.createDataFrame([("http://b.net/p",), (None,), ("junk",), ("https://shop.com/fr/",)], "url string")
    out = {r.page_id: r for r in U.judge_urls(pages(spark), listed, rules).collect()}
    assert len(out) == len(URLS)
    for i, url in enumerate(URLS):
        on_list = i in (11, 12, 3)
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == brute(url, on_list), url
        assert out[i].listed == on_list, url


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    listed = spark.range(5000).select(F.concat(F.lit("site/"), "id").alias("canonical"))
    n = 5000 * 16 // 256
    bloom = U.bloom_blocks(listed, n).cache()
    asked = spark.range(20_000).select(F.concat(F.lit("site/"), "id").alias("canonical"), F.col("id"))
    hits = asked.withColumn("block", U._block(F.col("canonical"), n)).join(bloom, "block")
    for w, m in zip(U.WORDS, U._masks(F.col("canonical")), strict=True):
        hits = hits.filter(F.col(w).bitwiseAND(m) == m)
    ids = {r.id for r in hits.select("id").collect()}
    assert set(range(5000)) <= ids and len(ids) < 5000 + 15_000 * 0.02
    assert U.listed_urls(asked.select("canonical"), listed).count() == 5000


def test_sql_agrees_and_the_plan_is_native(spark, tmp_path):
    rnd = random.Random(3)
    hosts = ["example.org", "www.cheap-pills.example.net", "m.casino-win.example.net", "a.casino-win.example.net", "shop.com", "x.example.com"]
    urls = URLS + [f"https://{rnd.choice(hosts)}/{rnd.choice(['es', 'en', 'de'])}/{rnd.randrange(30)}{rnd.choice(['', '/', '.html', '.html?utm_source=x', '?page=2&ref=x', '#t'])}" for _ in range(400)] * 2
    pages(spark, urls).write.parquet(f"{tmp_path}/pages.parquet")
    df = U.op10_url_filter(spark, str(tmp_path))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = sorted(map(str, (tuple(r) for r in df.collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(map(str, con.execute(U.OP10_SQL).fetchall()))
    assert 5 < df.filter("listed").count() < 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string")
    assert U.judge_urls(pages(spark, []), none).count() == 0
    assert {r.listed for r in U.judge_urls(pages(spark), none).collect()} == {False}
