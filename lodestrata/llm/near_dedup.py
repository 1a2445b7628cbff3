"""MinHash near-duplicates by tensored banding, with every link confirmed on full shingle sets.

Each document has two small collections of HALVES half keys of ROWS minhashes each. A table's key is a pair of
half keys, one from each collection, so HALVES * HALVES tables of 2 * ROWS hashes cost only 2 * HALVES * ROWS
minhashes. Two sets of similarity s share a table unless they differ in all half keys of a collection; they are
missed with probability 1 - (1 - (1 - s**ROWS)**HALVES)**2: 5e-4 at s = 0.75, 2e-5 at 0.85.

Defined results: a text that is null, empty or blank has an empty set, n_shingles 0, and is linked with nothing.
Rows with equal sets are linked without hashing. Rows that share a doc_id are one document, with the set whose
digest is least. Rows whose doc_id is null take the component of an equal set, else null. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.components import components
from lodestrata.llm.shared import hot_split_join, map_rows, shared_dir, written

WORDS, HALVES, ROWS, PERCENT = 5, 10, 2, 75
#: Minhashes are taken over so many shingles at a time, which bounds the memory of a very long text.
CHUNK = 8192
#: A table key is compared pair by pair when its pairs are at most this many for each member.
PAIRS_PER_MEMBER = 32
#: Bits by which sets are compared before their shingles are.
BITS = 1024
#: Shares that proposed partners are dealt into, each of which proposes one to a set at a time.
SHARES = 4
#: Shingles that are known as frequent where members of such keys are compared by their rarest ones, at most.
OFTEN = 50_000

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULT = _random.integers(0, 2**64, 2 * HALVES * ROWS, np.uint64) | np.uint64(1)
_ADD = _random.integers(0, 2**64, 2 * HALVES * ROWS, np.uint64)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of a text's distinct word shingles, from one running sum over the normalised bytes."""

    def __init__(self, words: int = WORDS):
        self.words, self.up, self.down = words, _powers(1 << 14, _BASE), _powers(1 << 14, _INVERSE)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted. Words are runs of other than ASCII white space, A-Z lower-cased: what bytes.split and lower do."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        if len(joined) >= len(self.up):
            self.up, self.down = _powers(2 * len(joined), _BASE), _powers(2 * len(joined), _INVERSE)
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE[joined] * self.up[: len(joined)], out=sums[1:])
        ends = np.flatnonzero(joined == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        wide = min(self.words, len(words))
        starts, ends = starts[: len(starts) - wide + 1], ends[wide - 1 :]
        return np.unique(_mixed((sums[ends] - sums[starts]) * self.down[starts]))


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """2 * HALVES longs: the first half of them is one collection, the rest the other."""
    least = np.full(len(_MULT), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, (shingles[at : at + CHUNK, None] * _MULT + _ADD).min(axis=0), out=least)
    keys = least.reshape(2 * HALVES, ROWS)
    out = np.arange(1, 2 * HALVES + 1, dtype=np.uint64) * _BASE
    for k in range(ROWS):
        out = _mixed(out ^ keys[:, k])
    return out.view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        ids, sets, n, halves = batch.column("doc_id"), [], [], []
        for text in batch.column("text"):
            found = shingler(text.as_py())
            n.append(len(found))
            sets.append(_set_key(found) if len(found) else None)
            halves.append(half_keys(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "halves"])


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITS bits in longs: those that the shingles' hashes fall on."""
    out = np.zeros(BITS, np.uint8)
    out[(shingles % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the set that set_key asks for."""
    shingler = Shingler()
    longs = pa.list_(pa.int64())
    for batch in batches:
        sets = [shingler(text.as_py()) for text in batch.column("text")]
        wanted = [_set_key(x) == key.as_py() for x, key in zip(sets, batch.column("set_key"), strict=True)]
        sets = [x for x, w in zip(sets, wanted, strict=True) if w]
        reps = batch.column("doc_id").filter(pa.array(wanted, pa.bool_()))
        yield pa.RecordBatch.from_arrays([reps, pa.array([x.view(np.int64) for x in sets], longs), pa.array([half_keys(x) for x in sets], longs), pa.array([bitmap(x) for x in sets], longs)], ["rep", "shingles", "halves", "bits"])


def _shared_keys(reps: DataFrame, folder: str, rows: int) -> DataFrame:
    """(key, table, rep, n) for each table key of n members, over one. Only half keys that several sets have are paired."""
    halves = reps.select("rep", F.posexplode("halves").alias("at", "half"))
    often = halves.groupBy("at", "half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kept = halves.join(often, ["at", "half"])
    one = kept.filter(F.col("at") < HALVES).select("rep", F.col("at").alias("i"), F.col("half").alias("one"))
    other = kept.filter(F.col("at") >= HALVES).select("rep", F.col("at").alias("j"), F.col("half").alias("other"))
    members = one.join(other, "rep").select(F.xxhash64("i", "one", "j", "other").alias("key"), (F.col("i") * 2 * HALVES + F.col("j")).alias("table"), "rep")
    members = written(members, folder, "tables", 2 * HALVES * rows)
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return written(members.join(shared, "key"), folder, "members", members.count())


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= PERCENT * union. Bitmaps go first, as they are small."""
    told = sets.select("rep", F.struct("rep", F.size("shingles").alias("n"), "bits").alias("told"))
    x, y = told.select(F.col("rep").alias("a"), F.col("told").alias("x")), told.select(F.col("rep").alias("b"), F.col("told").alias("y"))
    near = pairs.join(x, "a").join(y, "b").filter(_may_link()).select("a", "b")
    both = near.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("joint")).filter(F.col("common") * 100 >= F.col("joint") * PERCENT).select("a", "b")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _to_centres(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each rep and, of each of SHARES, the centre that it meets most often.

    A key's members are dealt into shares, anew each turn; the centre of a share is the member with most neighbours
    over all its keys, which is nearest to the middle of a group of copies.
    """
    degree = members.groupBy("rep").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("degree"))
    share = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(SHARES))
    placed = members.select("key", "rep").join(degree, "rep")
    centres = placed.groupBy("key", share.alias("share")).agg(F.max_by("rep", "degree").alias("centre"))
    votes = members.select("key", "rep").join(centres, "key").filter("rep <> centre").groupBy("rep", "share", "centre").agg(F.count(F.lit(1)).alias("keys"))
    return _ordered(votes.groupBy("rep", "share").agg(F.max_by("centre", "keys").alias("b")).select(F.col("rep").alias("a"), "b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _to_neighbours(open_keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of different components that stand side by side when a key's members are sorted by
    their half keys, as similar sets do in most keys; of each of SHARES the neighbour that a rep meets most often.

    Range partitioning splits large keys; what stands on either side of a cut is not paired here.
    """
    order = ["key", *[F.col("halves")[i] for i in range(0, 2 * HALVES, 3)]]
    dealt = open_keys.select("key", "rep", "component", "halves").repartitionByRange(*order).sortWithinPartitions(*order).select("key", "rep", "component")
    pairs = map_rows(dealt, _side_by_side, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"))
    sides = pairs.union(pairs.select("b", "a", "keys")).withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES)))
    return _ordered(sides.groupBy("a", "share").agg(F.max_by("b", "keys").alias("b")))


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        key, rep, component = (batch.column(c).to_numpy() for c in ("key", "rep", "component"))
        if last is not None:
            key, rep, component = (np.concatenate(([x], y)) for x, y in zip(last, (key, rep, component), strict=True))
        last = (key[-1], rep[-1], component[-1]) if len(key) else last
        near = (key[1:] == key[:-1]) & (component[1:] != component[:-1])
        one, two = rep[:-1][near], rep[1:][near]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])


def _largest(sizes: DataFrame) -> DataFrame:
    """(key, most, kinds) of sizes (key, component, members): most is the same whatever the order of rows, as both sides
    of a join may work it out; of components of equal size it is the greatest."""
    return sizes.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("most"), F.count(F.lit(1)).alias("kinds"))


def _across(members: DataFrame, first: Column | None = None) -> DataFrame:
    """Pairs (a, b) of members (key, rep, component, n, bits) of one key and different components that may be links.

    A key's largest component is only ever compared with the others' members, never with itself, so a group
    of copies that is linked already makes no pairs. first: whether a key is the one at which to tell of a pair
    (x, y: the members' rows), where two members may share many keys.
    """
    most = _largest(members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))).filter("kinds > 1")
    mixed = members.join(most, "key")
    x, y = mixed.filter("component <> most").alias("x"), mixed.alias("y")
    other = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.most")) | (F.col("x.rep") < F.col("y.rep")))
    wanted = (F.col("x.key") == F.col("y.key")) & other & _may_link()
    pairs = x.join(y, wanted if first is None else wanted & first)
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _may_link() -> Column:
    """False only for pairs of too low a similarity, exactly. Sets of sizes n and m with intersection over union at
    PERCENT or more differ in at most (n + m) * (100 - PERCENT) / (100 + PERCENT) shingles, and in no fewer than
    there are bits in which their bitmaps differ."""
    n, m = F.col("x.n"), F.col("y.n")
    differ = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(BITS // 64)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (differ * (100 + PERCENT) <= (n + m) * (100 - PERCENT))


def _first_table() -> Column:
    """Whether the rows' table is the first that x and y share: of their first equal half keys on either side."""
    at = lambda start: F.array_position(F.zip_with(F.slice("x.halves", start, HALVES), F.slice("y.halves", start, HALVES), lambda p, q: p == q), True) + (start - 2)
    return F.col("x.table") == at(1) * 2 * HALVES + at(HALVES + 1)


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several sets of a batch have, with counts."""
    for batch in batches:
        sets = batch.column("shingles")
        found, n = np.unique(sets.flatten().to_numpy(), return_counts=True)
        often = n >= max(2, len(sets) // 100)
        yield pa.RecordBatch.from_arrays([pa.array(found[often]), pa.array(n[often].astype(np.int64))], ["key", "n"])


def _prefixes(often: np.ndarray, n: np.ndarray):
    """Of each set the rarest shingles: a set of k keeps k - ceil(PERCENT * k / 100) + 1 in an order that is the
    same for all sets, so that two sets similar enough share one of them. often: sorted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shingles in batch.column("shingles"):
                own = shingles.values.to_numpy()
                df = np.zeros(len(own), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    df = np.where(often[at] == own, n[at], 0)
                out.append(own[np.lexsort((own, df))][: len(own) - -(-len(own) * PERCENT // 100) + 1])
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out, pa.list_(pa.int64()))], ["rep", "rarest"])

    return rows


def _rare_first(sets: DataFrame) -> DataFrame:
    """(key, rep) for the rarest shingles of each set (rep, shingles).

    How often a shingle occurs only orders them, so rough counts do: of the shingles that batches hold several times,
    the OFTEN most frequent come to the driver.
    """
    counts = map_rows(sets.select("shingles"), _batch_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(OFTEN).orderBy("key").toArrow()
    rarest = map_rows(sets, _prefixes(top.column("key").to_numpy(), top.column("n").to_numpy()), "rep long, rarest array<long>")
    return rarest.select(F.explode("rarest").alias("key"), "rep")


def _open_keys(members: DataFrame, links: DataFrame, sets: DataFrame, folder: str, name: str) -> DataFrame:
    """(key, table, rep, component, hot, n, halves, bits) of members of keys that hold several components; hot: with
    many pairs."""
    n = members.count()
    labelled = written(_labelled(members.select("key", "table", "rep"), links), folder, f"{name}_labelled", n)
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    sizes = sizes.select("key", ((F.col("n") * F.col("n") - F.col("squares")) / 2 > F.col("n") * PAIRS_PER_MEMBER).alias("hot"))
    told = sets.select("rep", F.size("shingles").alias("n"), "halves", "bits")
    return written(labelled.join(sizes, "key").join(told, "rep").select("key", "table", "rep", "component", "hot", "n", "halves", "bits"), folder, name, 4 * n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    1. Rows are reduced to one representative for each distinct set (the least doc_id).
    2. Table keys are formed from half keys that more than one representative has.
    3. Each representative is compared with the centre it shares most keys with, then, across the components that
       this makes, with its nearest neighbours by sorted half keys. Both make a few pairs for each representative,
       and leave large groups of copies as one component.
    4. Where a key still holds several components, all their members are compared across components: pair by pair
       in keys with few such pairs, else through the rarest shingles of the members' whole sets, which is exact
       and makes no pairs among texts that only share common passages.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(map_rows(plain, signatures, "doc_id long, n_shingles long, set_key binary, halves array<long>"), folder, "signed")
    groups = signed.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    rows = signed.count()
    groups = written(groups, folder, "groups", rows)
    # one set for each representative, and one row of it
    own = groups.filter("rep IS NOT NULL").groupBy("rep").agg(F.min("set_key").alias("set_key"))
    reps = signed.select(F.col("doc_id").alias("rep"), "set_key", "halves").join(own, ["rep", "set_key"], "left_semi").dropDuplicates(["rep"])
    members = _shared_keys(reps.select("rep", "halves"), folder, rows)

    wanted = written(members.select("rep").distinct().join(own, "rep"), folder, "wanted", rows)
    texts = plain.join(wanted.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id")
    n = wanted.count()
    few = 100 * n  # rows that carry sets weigh more
    sets = written(map_rows(texts, full_sets, "rep long, shingles array<long>, halves array<long>, bits array<long>"), folder, "sets")
    if sets.count() != n:  # repeated rows
        sets = written(sets.dropDuplicates(["rep"]), folder, "sets_once", few)

    links = written(_confirmed(_to_centres(members, 0), sets), folder, "links0", few)
    open_keys = _open_keys(members, links, sets, folder, "open0")
    proposed = _to_neighbours(open_keys).union(_to_centres(members.join(open_keys.select("key").distinct(), "key", "left_semi"), 1)).distinct()
    links = links.union(written(_confirmed(proposed, sets), folder, "links1", few))
    open_keys = _open_keys(members, links, sets, folder, "open1")
    hot_reps = open_keys.filter("hot").select("rep", "component", "n", "bits").dropDuplicates(["rep"])
    rare = _rare_first(sets.select("rep", "shingles").join(hot_reps.select("rep"), "rep", "left_semi")).join(hot_reps, "rep")
    pairs = _across(open_keys.filter("NOT hot").drop("hot"), _first_table()).union(_across(rare)).distinct()
    pairs = written(pairs, folder, "pairs", members.count())
    more = written(_confirmed(pairs, sets), folder, "links2", 100 * pairs.count())

    found = components(links.union(more))
    classes = groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    classes = written(classes.select("set_key", "copies", "component_id"), folder, "classes", rows)
    filled = hot_split_join(signed.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_key"), classes, "set_key", "copies")
    blank = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.select("doc_id", "n_shingles", "component_id").union(blank).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not near-copies of a kept one; rows without an id stay."""
    gone = near_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, compared exactly; components by reachability.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
singles AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM singles a JOIN singles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
sides AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
least_of AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sets LEFT JOIN least_of ON a = doc_id
"""
