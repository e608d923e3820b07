"""Exact deduplication by deterministic block naming (Karp-Miller-Rosenberg), in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, cut, once, text_key, without

BLOCK_CHARS = 4096


def _named(values: DataFrame, keys: list[str], out: list) -> DataFrame:
    """Distinct rows of `values`, sorted within hash partitions, numbered: integer names, equal only for equal rows."""
    return values.select(*keys).distinct().sortWithinPartitions(*keys).select(*out, F.monotonically_increasing_id().alias("name"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are cut into blocks of `block_chars`; distinct blocks are sorted and numbered; adjacent names are
    paired, distinct pairs are numbered, and so on until every text has one name.  (blocks, last name) is
    equal for equal texts only.  The texts are shuffled once, after map-side `distinct`, which folds hot
    blocks.  Names come back over two 64-bit hashes of the block, after a check over all distinct blocks
    that these hashes are one-to-one (otherwise the join is on the block itself).  Rows of one doc_id are told apart by the
    SHA-256 of their text; no other choice rests on a hash.

    Null text counts as empty; all empty texts are one group.  Repeated rows each count in group_size, and
    one of them stays.  Null ids never win against others.  An empty table gives an empty result; extra
    columns are ignored.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("t"))
    parts = F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    )
    only = text.select(F.explode(parts).alias("block"))
    hashes = [F.xxhash64("block").alias("h1"), F.xxhash64(F.lit(1), "block").alias("h2")]
    names = checkpointed(_named(only, ["block"], hashes))
    by = ["h1", "h2"]
    if names.groupBy(by).count().where("count > 1").limit(1).count():
        by, names = ["block"], _named(only, ["block"], ["block"])
    blocks = text.select("doc_id", F.sha2("t", 256).alias("sha"), F.posexplode(parts).alias("pos", "block"))
    blocks = blocks.select("doc_id", "sha", "pos", *(hashes if by == ["h1", "h2"] else ["block"]))
    named = blocks.join(names, by)
    level = checkpointed(
        named.groupBy("doc_id", "sha")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "name"))).alias("at"), F.count_if(F.col("pos") == 0).alias("copies"))
        .select("doc_id", "sha", "copies", F.size("at").alias("n_blocks"), F.col("at.name").alias("names"))
    )
    most = level.agg(F.max("n_blocks")).first()[0] or 0
    done = level.where("n_blocks = 1").select("doc_id", "sha", "copies", "n_blocks", F.col("names")[0].alias("name"))
    level = level.where("n_blocks > 1")
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        pair = F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1),
            lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")),
        )
        pairs = level.select("doc_id", "sha", F.posexplode(pair).alias("pos", "p")).select("doc_id", "sha", "pos", "p.a", "p.b")
        joined = pairs.join(checkpointed(_named(pairs, ["a", "b"], ["a", "b"])), ["a", "b"])
        again = joined.groupBy("doc_id", "sha").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("at"))
        rest = level.select(F.col("doc_id").alias("d"), F.col("sha").alias("s"), "copies", "n_blocks")
        level = checkpointed(
            again.join(rest, again.doc_id.eqNullSafe(rest.d) & (again.sha == rest.s))
            .select("doc_id", "sha", "copies", "n_blocks", F.col("at.name").alias("names"))
        )
        done = done.unionByName(level.where(F.size("names") == 1).select("doc_id", "sha", "copies", "n_blocks", F.col("names")[0].alias("name")))
        level = level.where(F.size("names") > 1)
    # written out, so that the join has a plain exchange on either side and AQE may split a hot group
    groups = checkpointed(done.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    return (
        done.join(groups, ["n_blocks", "name"])
        .select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of equal texts, the one with the largest doc_id; its columns stay as they are.

    Rows are told apart by doc_id and text, so repeated doc_ids don't matter; of rows equal in both one stays.
    """
    rows = exact_dedup(docs).groupBy("doc_id", F.col("text_sha256").alias("key")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    rows = cut(rows.where("not kept or n > 1"))
    key = text_key(ascii_lower(F.col("text")))
    return once(without(docs, rows.where("not kept"), key), rows.where("kept"), key)
