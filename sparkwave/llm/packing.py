"""Packing into optimal length buckets.

Texts become token ids and are cut into segments of at most `max_len` ids.  The global histogram of segment lengths (at most
`max_len` rows, whatever the corpus) goes to the driver, where dynamic programming finds the bucket boundaries
that minimise padding.  Inside each bucket, batches of `token_budget // boundary` slots are filled in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_dir, small_batches, text_groups
from .token_files import END_ID, WordEncoder
from .token_files import encoder as worker_encoder

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 16384
SHARD_ROWS = 50_000  # segments that are numbered together, about
SHARDS = 1024  # at least
BROADCAST_ROWS = 1_000_000  # of (bucket, shard, offset): 24 MB at most
MEMORY = 50_000  # words, and pieces of words, that a task remembers


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper boundaries of at most `buckets` buckets with the least padding; ties take the earliest split."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    count = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum([int(x) * histogram[int(x)] for x in lengths])]).astype(np.float64)
    n = len(lengths)
    best = lengths[np.arange(n)] * count[1:] - total[1:]  # padding of lengths 0..i in one bucket
    choice = []
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.full(n, -1)
        for i in range(1, n):
            cost = best[:i] + lengths[i] * (count[i + 1] - count[1 : i + 1]) - (total[i + 1] - total[1 : i + 1])
            j = int(np.argmin(cost))
            if cost[j] < new[i]:
                new[i], cut[i] = cost[j], j
        choice.append(cut)
        best = new
    out, i = [int(lengths[-1])], n - 1
    for cut in reversed(choice):
        if cut[i] >= 0:
            i = int(cut[i])
            out.append(int(lengths[i]))
    return out[::-1]


def segments(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = END_ID, keep_encoder: bool = False) -> DataFrame:
    """doc_id, seg, start, length, ids: the ids of the whole text and the end id, no part dropped.

    A task's encoder, with the words it remembers, is given back at its end, as other stages may need the memory, or is kept for
    the worker's next tasks, which saves time.

    `ids` holds little-endian unsigned integers, octet_length(ids) / length bytes each.  Null texts, and those without a
    token, give no segment.
    """

    kind = pa.struct([("width", pa.int32()), ("parts", pa.list_(pa.binary()))])

    @F.arrow_udf("struct<width int, parts array<binary>>")
    def cut_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_encoder(tokenizer) if keep_encoder else WordEncoder(tokenizer, MEMORY)
        width = np.dtype(encoder.dtype).itemsize
        for texts in batches:
            rows = []
            for text in (t for group in text_groups(texts) for t in group):
                ids = encoder.encode(text) if text else np.zeros(0, encoder.dtype)
                data = np.append(ids, ids.dtype.type(end_id)).tobytes() if len(ids) else b""
                rows.append({"width": width, "parts": [data[at : at + max_len * width] for at in range(0, len(data), max_len * width)]})
            yield pa.array(rows, kind)

    parts = docs.select("doc_id", cut_up("text").alias("s")).select("doc_id", "s.width", F.posexplode("s.parts").alias("seg", "ids"))
    return parts.select("doc_id", F.col("seg").cast("long").alias("seg"), (F.col("seg").cast("long") * max_len).alias("start"),
                        (F.octet_length("ids") / F.col("width")).cast("long").alias("length"), "ids")


def pack(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, shards: int | None = None,
         keep_encoder: bool = False) -> DataFrame:
    """doc_id, seg, start, length, bucket (its boundary), batch, slot, padding, ids: one row per segment; the rows of one (bucket,
    batch) by slot, each with `padding` ids of padding after its own, are the batch.

    Segments are numbered in each bucket by (shard, doc_id, seg, ids), the shard by a hash of the latter three: numbering runs
    within (bucket, shard), and shard offsets come from a table of at most buckets * shards rows, so neither a bucket nor a
    doc_id of very many rows is sorted in one task.  There are as many shards as give each some 50,000 segments, 1,024 at least.  Repeated rows each get a slot of their own (ties among them don't
    matter); a null doc_id is packed like others; a text of any length gives as many segments as it needs.
    An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    path = fresh_dir(spark, "segments")
    with small_batches(spark):
        segments(docs, tokenizer, max_len, keep_encoder=keep_encoder).withColumn("hash", F.xxhash64("doc_id", "seg", "ids")).write.parquet(path)  # encoded once
    seg = spark.read.parquet(path)
    histogram = {r["length"]: r["count"] for r in seg.groupBy("length").count().collect()}  # at most max_len rows
    shards = shards or max(SHARDS, -(-sum(histogram.values()) // SHARD_ROWS))
    seg = seg.withColumn("shard", F.pmod("hash", F.lit(shards)))
    bounds = optimal_boundaries(histogram, buckets) or [max_len]
    bucket = F.element_at(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= F.col("length")), 1).cast("long")
    placed = seg.withColumn("bucket", bucket)
    sizes = placed.groupBy("bucket", "shard").count()
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "seg", "ids")
    offsets = F.broadcast(offsets) if len(bounds) * shards <= BROADCAST_ROWS else offsets
    numbered = placed.withColumn("rn", F.row_number().over(inside) - 1).join(offsets, ["bucket", "shard"])
    place = F.col("offset") + F.col("rn")
    slots = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket")))
    return numbered.select(
        "doc_id", "seg", "start", "length", "bucket",
        F.floor(place / slots).alias("batch"), (place % slots).alias("slot"), (F.col("bucket") - F.col("length")).alias("padding"), "ids",
    )
