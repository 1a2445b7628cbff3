"""URL verdicts: host and path rules, then a blocked Bloom filter of listed canonical URLs with an exact join behind it.

Native: only DataFrame and SQL functions. A url that is null or has no '://' has an empty host and path, fits no
rule and is on no list, so it is allowed. Repeated rows get equal verdicts; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import hot_split_join, shared_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Rule sets up to this size become an expression; larger ones are joined on the suffixes of hosts.
MAX_INLINE_RULES = 256
#: The Bloom filter is broadcast up to this many blocks, of some 200 bytes each as rows of a hash relation, so 50 MB at
#: most; else it is joined by block.
MAX_BROADCAST_BLOCKS = 1 << 18
#: The odd multipliers that the Parquet format fixes for split-block Bloom filters, one for each word of a block.
#: They are halved below, so that a product with 32 bits of hash fits a long; each sets one of its word's 32 bits.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
#: Query parameters that do not change a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
WORDS = [f"w{i}" for i in range(8)]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """host without 'www.', path without a last '/', then the sorted query without tracking parameters; '' without a host."""
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    page = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""))
    return F.coalesce(F.when(host == "", F.lit("")).when(kept == "", page).otherwise(F.concat(page, F.lit("?"), kept)), F.lit(""))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def _longest(found: Column) -> Column:
    """Of an array of (size, host_size, rule, verdict), the greatest, or null."""
    return F.array_max(found)


def _rule_entry(host: Column, path: Column, verdict: Column) -> Column:
    return F.struct((F.length(host) + F.length(path)).alias("size"), F.length(host).alias("host_size"), F.concat(host, path).alias("rule"), verdict.alias("verdict"))


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (host, path, ...) with matched: the longest rule that fits, as a struct, else null.

    A list of up to MAX_INLINE_RULES rules is an expression. A DataFrame (host, path, verdict) is joined to the
    distinct hosts by each of their suffixes, and the hosts back to urls with hot hosts broadcast.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) > MAX_INLINE_RULES:
            rules = urls.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
        else:
            each = [F.when(_fits(F.col("host"), F.col("path"), F.lit(h), F.lit(p)), _rule_entry(F.lit(h), F.lit(p), F.lit(v))) for h, p, v in rules]
            none = F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
            return urls.withColumn("matched", _longest(F.array(*each, none)))
    folder = shared_dir(urls.sparkSession)
    urls = written(urls, folder, "urls")
    hosts = written(urls.groupBy("host").agg(F.count(F.lit(1)).alias("__rows")), folder, "hosts")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = rules.select(F.col("host").alias("__suffix"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).filter("__suffix IS NOT NULL AND rule_path IS NOT NULL")
    fitting = hosts.withColumn("__suffix", F.explode(suffixes)).join(rules, "__suffix").groupBy("host").agg(F.collect_list(F.struct("__suffix", "rule_path", "rule_verdict")).alias("__rules"))
    hosts = written(hosts.join(fitting, "host", "left"), folder, "host_rules")
    out = hot_split_join(urls, hosts, "host", "__rows")
    found = F.transform(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), lambda r: _rule_entry(r["__suffix"], r["rule_path"], r["rule_verdict"]))
    return out.withColumn("matched", _longest(found)).drop("__rules", "__rows")


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(url), 32), F.lit(blocks)).cast("long")


def _masks(url: Column) -> list[Column]:
    low = F.xxhash64(url).bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned((low * F.lit(s >> 1 | 1)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")) for s in SALTS]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """listed (canonical) as rows of blocks that have bits: block, w0..w7."""
    masked = listed.select(_block(F.col("canonical"), blocks).alias("block"), *[m.alias(w) for w, m in zip(WORDS, _masks(F.col("canonical")), strict=True)])
    return masked.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def listed_urls(urls: DataFrame, listed: DataFrame, bits_per_url: int = 16) -> DataFrame:
    """The distinct canonical URLs among urls (canonical) that are on the list (canonical).

    urls passes the blocked Bloom filter first; only possible hits are shuffled, made distinct before that,
    and joined exactly by hash. The filter is broadcast behind a check of its size, else joined by block.
    """
    folder = shared_dir(urls.sparkSession)
    listed = written(listed.select("canonical").filter("canonical <> ''").distinct(), folder, "listed")
    blocks = max(1, -(-listed.count() * bits_per_url // 256))
    bloom = bloom_blocks(listed, blocks)
    asked = urls.select("canonical", _block(F.col("canonical"), blocks).alias("block"), F.lit(1).cast("long").alias("n"))
    if blocks <= MAX_BROADCAST_BLOCKS:
        hits = asked.join(F.broadcast(bloom), "block")
    else:
        hits = asked.groupBy("canonical", "block").agg(F.sum("n").alias("n")).join(bloom, "block")
    for w, m in zip(WORDS, _masks(F.col("canonical")), strict=True):
        hits = hits.filter(F.col(w).bitwiseAND(m) == m)
    possible = hits.groupBy("canonical").agg(F.sum("n").alias("__rows"))
    return possible.join(listed.hint("shuffle_hash"), "canonical")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of pages; listed has a column url."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canonical"))
    urls = written(urls, folder, "urls")
    found = written(listed_urls(urls, listed.select(canonical_url(F.col("url").cast("string")).alias("canonical"))), folder, "found")
    marked = hot_split_join(urls, found.withColumn("listed", F.lit(True)), "canonical", "__rows", "left")
    ruled = with_rules(marked.drop("__rows"), rules)
    return ruled.select(
        "page_id", "host", "path", F.col("matched.rule").alias("rule"),
        F.coalesce(F.col("matched.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
    )


#: The feed that the query blocks: pages 0 to FEED_PAGES - 1 in each language of each shop, on each of its hosts, with
#: either ending.
FEED_SHOPS = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")
FEED_HOSTS, FEED_DOMAINS, FEED_LANGUAGES, FEED_ENDINGS, FEED_PAGES = ("", "m.", "blog."), ("com", "net", "org"), ("en", "de", "fr", "es"), ("", ".html"), 1000


def feed_urls(spark: SparkSession) -> DataFrame:
    """url of each page on the feed, whether anybody has seen it or not."""
    out = spark.range(FEED_PAGES).select("id")
    for name, values in (("shop", FEED_SHOPS), ("host", FEED_HOSTS), ("domain", FEED_DOMAINS), ("language", FEED_LANGUAGES), ("ending", FEED_ENDINGS)):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.select(F.format_string("http://%s%s.example.%s/%s/%d%s", "host", "shop", "domain", "language", "id", "ending").alias("url"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), feed_urls(spark))


_HOST = r"translate(regexp_extract(coalesce({u}, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce({u}, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1)"
OP10_SQL = rf"""
WITH p AS (
  SELECT page_id, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^?#]*\?([^#]*)', 1), '&'),
             lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[^=]*|ref|fbclid|gclid)(=.*)?'))), '&') AS q
  FROM pages),
c AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') = '' THEN '' ELSE regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical FROM p),
feed AS (SELECT h || shop || '.example.' || d || '/' || l || '/' || i || z AS canonical FROM unnest({list(FEED_SHOPS)}) a(shop), unnest({list(FEED_HOSTS)}) b(h), unnest({list(FEED_DOMAINS)}) c(d), unnest({list(FEED_LANGUAGES)}) e(l), unnest({list(FEED_ENDINGS)}) g(z), range({FEED_PAGES}) f(i)),
rules(rh, rp, rv) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
m AS (SELECT *, (SELECT max(struct_pack(n := length(rh) + length(rp), h := length(rh), r := rh || rp, v := rv)) FROM rules
      WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best, canonical IN (SELECT canonical FROM feed) AS listed FROM c)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM m
"""
