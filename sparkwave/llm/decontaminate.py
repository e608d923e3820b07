"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

An item's words are the runs of letters and digits of its lower-cased text, its shingles five words in a row
(all words of a shorter item).  A document is contaminated by an item when it holds at least 75 % of the
item's distinct shingles.

Items are partitioned by size (powers of two of their shingle count).  Items and documents are hashed by one MinHash
function.  An item of n shingles is sketched by its n - ceil(0.75 n) + r smallest hashes, with r = 1 + (least n of its
partition) // 8; a document with 75 % of an item misses n - ceil(0.75 n) of its hashes at most, and so has r of the sketch,
whatever its length (a signature of fixed size would tell nothing, as the Jaccard similarity of a short item and a long
document is near zero).  So the bound on the sketches is exact: a pair short of it is no match.  Pairs that reach it are
verified on the shingles as text.

A document keeps its hashes up to a common threshold, which most sketches lie below, and those of the FAR largest hashes of sketches that
lie beyond it: few outlying items don't raise the threshold for all.  One pass over the texts serves items of every width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_key, without

WORDS = 5
CONTAINMENT = 75  # per cent
BROADCAST_ROWS = 2_000_000  # of (hash, item, bound): 40 MB at most
BROADCAST_GRAMS = 500_000  # shingles of items as text
BROADCAST_IDS = 2_000_000
FAR = 4000  # hashes of sketches beyond the common threshold


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed_shingles(words: str, size: int) -> Column:
    """A hash for each run of `size` words; empty if there are fewer."""
    return F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(-1, size - 1)])),
    ).otherwise(F.array().cast("array<long>"))


def text_shingles(words: str, size: Column) -> Column:
    """Distinct shingles as text; `size` words each."""
    return F.when(
        F.size(words) >= size,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))),
    ).otherwise(F.array().cast("array<string>"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item (an internal number), item_id, width, shingles (text), n: items without words have no row; repeated rows are one."""
    words = benchmark.select("item_id", word_list(F.col("text")).alias("w")).where("size(w) > 0")
    words = words.withColumn("width", F.least(F.size("w"), F.lit(WORDS)))
    out = words.select("item_id", "width", text_shingles("w", F.col("width")).alias("shingles")).distinct()
    return checkpointed(out.withColumns({"item": F.monotonically_increasing_id(), "n": F.size("shingles")}))


def sketches(items: DataFrame) -> DataFrame:
    """hash, item, need: the sketches of all items, and how many of an item's hashes a document must have."""
    slack = F.col("n") - F.ceil(F.col("n") * CONTAINMENT / 100).cast("int")  # shingles that a match may miss
    part = F.floor(F.log2("n"))
    size = slack + 1 + F.floor(F.pow(F.lit(2), part) / 8).cast("int")
    parts = lambda s: F.split(s, " ")
    hashes = F.transform("shingles", lambda s: F.xxhash64(F.col("width"), *[F.get(parts(s), F.lit(j)) for j in range(WORDS)]))
    sized = items.select("item", part.alias("part"), slack.alias("slack"), F.array_sort(F.array_distinct(hashes)).alias("hashes"), size.alias("size"))
    sketch = sized.select("item", "slack", F.slice("hashes", F.lit(1), F.greatest(F.lit(1), F.least("size", F.size("hashes")))).alias("s"))
    return sketch.select("item", F.greatest(F.lit(1), F.size("s") - F.col("slack")).alias("need"), F.explode("s").alias("hash"))


def kept_hashes(sketch: DataFrame) -> tuple[int, list[int]]:
    """The common threshold, and the FAR largest hashes of sketches at most, which lie beyond it."""
    far = [r["hash"] for r in sketch.select("hash").distinct().orderBy(F.desc("hash")).limit(FAR).collect()]
    common = sketch.where(F.col("hash") < far[-1]).agg(F.max("hash")).first()[0]
    return (-(2**63) if common is None else common), far


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key (of the text), item_id, n_item, n_shared: every text that holds an item, with repeated rows as one."""
    items = _items(benchmark)
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most 1 to 5
    if not widths:
        return docs.select("doc_id", text_key(F.col("text")).alias("key"), F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("n_item"), F.lit(0).alias("n_shared")).limit(0)
    sketch = checkpointed(sketches(items))
    common, far = kept_hashes(sketch)
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    words = docs.select("doc_id", text_key(F.col("text")).alias("key"), word_list(F.col("text")).alias("w"))
    hashes = F.concat(*[hashed_shingles("w", width) for width in widths])
    own = F.array_distinct(F.filter(hashes, lambda h: (h <= common) | h.isin(far)))
    seen = words.select("doc_id", "key", F.explode(own).alias("hash")).join(sketch, "hash")
    near = seen.groupBy("doc_id", "key", "item").agg(F.count("*").alias("hits"), F.first("need").alias("need")).where("hits >= need")
    ids = checkpointed(near.select("doc_id", "key").distinct())
    # texts are read again for the candidates only; each is cut into shingles once, however many items it may hold
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = docs.select("doc_id", "text").join(some.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    chosen = chosen.select("doc_id", text_key(F.col("text")).alias("key"), word_list(F.col("text")).alias("w")).dropDuplicates(["doc_id", "key"])
    grams = F.concat(*[text_shingles("w", F.lit(width)) for width in widths])  # widths differ in the number of blanks
    wanted = checkpointed(items.select("item", "item_id", F.col("n").alias("n_item"), F.explode("shingles").alias("gram")))
    if wanted.count() <= BROADCAST_GRAMS:
        wanted = F.broadcast(wanted)
    shared = chosen.select("doc_id", "key", F.explode(grams).alias("gram")).join(wanted, "gram")
    shared = shared.groupBy("doc_id", "key", "item", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n_item") * CONTAINMENT).select("doc_id", "key", "item_id", "n_item", "n_shared")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: one row for each contaminated document and item.

    Null or empty texts, and items without words, match nothing; repeated rows of a document or an item give one
    row (repeated doc_ids or item_ids with different texts: the larger share, then the larger item).  Null ids are ids like
    others.  Texts of any length are read whole.  Empty tables give an empty result; extra columns are ignored.
    """
    best = _matches(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_item").cast("long").alias("n_item"), F.col("m.n_shared").cast("long").alias("n_shared"),
                       F.round(F.col("m.n_shared") / F.col("m.n_item"), 6).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without contaminated documents; rows are told apart by doc_id and text, and columns stay as they are."""
    return without(docs, _matches(docs, benchmark), text_key(F.col("text")))
