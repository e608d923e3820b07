"""N-gram Jaccard self-join as a T-occurrence search (DivideSkip) over an inverted index.

A text's set holds its distinct five-word shingles.  Two sets of sizes s, t link when 100*overlap >= 75*union,
so that they share at least T = ceil(75*(s+t)/175) shingles.

1. Statistics: shingle counts of the whole corpus go into one sketch of fixed size (2**21 counters, 8 MB, the
   only thing broadcast).  It gives one global order of shingles, rare first; its errors cost time, not results.
2. Divide: a set's long inverted lists are those of its commonest shingles.  Leaving out the L = T - k commonest
   of them, a partner must still occur k times in the remaining short lists (k = 1 + s // 40).  Only those
   short-list entries are shuffled, by shingle.  Identical sets share one 64-bit name (with their size) and so one entry.
3. Merge: a list of up to SHORT sets gives its pairs; pairs that occur k times are candidates.  A longer
   list makes all its sets members of the family of its first set (the one with the commonest shingles, a hub).
   A set that occurs in shared lists less often than any partner of fitting size would have to is no member.
4. Families: every member is compared with its hub.  Members linked to the hub are one class already, so only
   pairs with a member that is not linked to it remain, and of those only pairs whose distances to the hub
   differ by at most 0.25 (Jaccard distance is a metric).  Members are dealt into bounded blocks by that distance; a
   block pair is searched in one task with DivideSkip: short lists are merged (by counting, which gives the same occurrences as
   a heap and takes 20 to 220 times less), long lists are probed by binary search.
5. Links feed a distributed connected-components job.

No cap, sample or prefix of texts is used; every pair that could link is decided on the two whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, cut, once, over_texts, small_batches, text_groups, text_key, without
from .shingles import fingerprint, shingle_lists

NUM, DEN = 75, 100
SHORT = 6  # sets of an inverted list whose pairs are written out
SKETCH_BITS = 21
BLOCK_SHINGLES = 1_500_000  # of one side of a block pair: 12 MB
BLOCK_ROWS = 1024  # sets of one side of a block pair
KNOWN = 500_000  # names that a task remembers, to give out each set's lists once
STEP = 20  # distance buckets
LONG = 4096  # sets of an inverted list that is probed rather than merged


def needed(s, t):
    """Least overlap of linked sets of sizes s and t."""
    return -(-NUM * (s + t) // (NUM + DEN))


def occurrences(n):
    """k: how often a partner must occur in the short lists."""
    return 1 + n // 40


def short_lists(n: int) -> int:
    """Number of a set's short lists: n - ceil(0.75 n) + k."""
    return min(n, n - -(-NUM * n // DEN) + int(occurrences(n)))


def _sketch(docs: DataFrame) -> np.ndarray:
    """Counts of all shingle occurrences by the low bits of their hash; blocks of counters are summed on executors."""
    width, block = 1 << SKETCH_BITS, 1 << 15

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(width, np.int64), [], 0
        for pdf in batches:
            for h in shingle_lists(pdf["text"].tolist()):
                held.append((h & np.uint64(width - 1)).astype(np.uint32))
                size += len(h)
                if size > 1 << 21:
                    total += np.bincount(np.concatenate(held), minlength=width)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=width)
        if total.any():
            cells = np.minimum(total, 65535).astype(np.uint16).reshape(-1, block)
            yield pd.DataFrame({"block": np.arange(len(cells)), "cells": [c.tobytes() for c in cells]})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(block, np.int64)
        for pdf in batches:
            for c in pdf["cells"]:
                total += np.frombuffer(c, np.uint16)
        yield pd.DataFrame({"block": [key[0]], "cells": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    schema = "block int, cells binary"
    found = over_texts(docs.select("text"), count, schema).groupBy("block").applyInPandas(add, schema).collect()
    out = np.zeros((width // block, block), np.int32)
    for row in found:  # 64 rows of 128 kB, whatever the input
        out[row["block"]] = np.frombuffer(row["cells"], np.int32)
    return out.reshape(-1)


def _sets(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for k, h in enumerate(shingle_lists(pdf["text"].tolist())):
        yield k, np.unique(h)


def shingle_names(docs: DataFrame, salt: int = 0, keyed: bool = False) -> DataFrame:
    """doc_id, key (of the text, if asked for), n_shingles, set_id, proof (both null for an empty set)."""

    @F.arrow_udf("n long, a long, b long")
    def name(texts: pa.Array) -> pa.Array:
        rows = [(len(s), *fingerprint(s, salt)) for group in text_groups(texts) for s in map(np.unique, shingle_lists(group))]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["n", "a", "b"])

    key = [text_key(F.col("text")).alias("key")] if keyed else []
    named = docs.select("doc_id", *key, name("text").alias("s"))
    some = lambda c: F.when(F.col("s.n") > 0, F.col(c))
    return named.select("doc_id", *(["key"] if keyed else []), F.col("s.n").alias("n_shingles"), some("s.a").alias("set_id"), some("s.b").alias("proof"))


def _postings(docs: DataFrame, sketch, salt: int) -> DataFrame:
    """h, set_id, n, weight: the short-list entries of every set; weight is larger for sets of common shingles.

    A task gives out a set once, so that a large group of copies is folded before the shuffle.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sketch.value
        mask = np.uint64(len(counts) - 1)
        known: set[tuple[int, int]] = set()
        for pdf in batches:
            out: list[tuple] = []
            size = 0
            for _, s in _sets(pdf):
                if not len(s):
                    continue
                name = fingerprint(s, salt)
                if name in known:
                    continue
                if len(known) >= KNOWN:
                    known.clear()
                known.add(name)
                seen = counts[(s & mask).astype(np.int64)]
                first = s[np.lexsort((s, seen))[: short_lists(len(s))]]
                out.append((first, name[0], len(s), int(100 * np.log2(1.0 + seen).mean())))
                size += len(first)
                if size > 200_000:
                    yield _entries(out)
                    out, size = [], 0
            if out:
                yield _entries(out)

    return over_texts(docs.select("text"), emit, "h long, set_id long, n int, weight int")


def _entries(rows: list[tuple]) -> pd.DataFrame:
    each = [len(r[0]) for r in rows]
    return pd.DataFrame({
        "h": np.concatenate([r[0] for r in rows]).view(np.int64),
        "set_id": np.repeat(np.array([r[1] for r in rows], np.int64), each),
        "n": np.repeat(np.array([r[2] for r in rows], np.int32), each),
        "weight": np.repeat(np.array([r[3] for r in rows], np.int32), each),
    })


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by list, then hub first.  Gives kind 0: a pair of a short list; kind 1: (hub, member) of a long one.

    A list may run over many batches: only its first SHORT rows are held.
    """
    key, head, last, length = None, [], None, 0
    for pdf in batches:
        h, sid, n = pdf["h"].to_numpy(), pdf["set_id"].to_numpy(), pdf["n"].to_numpy()
        kind, a, na, b, nb = [], [], [], [], []

        def put(k, x, y):
            kind.append(k), a.append(x[0]), na.append(x[1]), b.append(y[0]), nb.append(y[1])

        same = np.empty(len(h), bool)  # rows whose list has another row beside them
        same[1:] = h[1:] == h[:-1]
        same[:1] = key is not None and len(h) > 0 and h[0] == key
        alone = ~same
        alone[:-1] &= ~same[1:]
        alone[-1:] = False
        for i in np.flatnonzero(~alone):
            if h[i] != key:
                _close(head, length, put)
                key, head, last, length = h[i], [], None, 0
            x = (sid[i], n[i])
            if x == last:
                continue
            last = x
            length += 1
            if length <= SHORT:
                head.append(x)
            else:
                if length == SHORT + 1:
                    for y in head[1:]:
                        put(1, head[0], y)
                put(1, head[0], x)
        yield pd.DataFrame({"kind": kind, "a": a, "na": na, "b": b, "nb": nb})
    kind, a, na, b, nb = [], [], [], [], []
    _close(head, length, lambda k, x, y: (kind.append(k), a.append(x[0]), na.append(x[1]), b.append(y[0]), nb.append(y[1])))
    yield pd.DataFrame({"kind": kind, "a": a, "na": na, "b": b, "nb": nb})


def _close(head: list, length: int, put) -> None:
    if 1 < length <= SHORT:
        for j, y in enumerate(head):
            for x in head[:j]:
                s, t = sorted((int(x[1]), int(y[1])))
                if DEN * s >= NUM * t:
                    put(0, *sorted((x, y)))


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Overlaps of pairs of whole sets."""
    for pdf in batches:
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
        size = pdf["na"].to_numpy() + pdf["nb"].to_numpy()
        yield pdf[["a", "na", "b", "nb"]].assign(overlap=np.array(both, np.int64), total=size)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, na, b, nb, overlap, union of the given pairs."""
    x = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("items").alias("x"))
    y = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("y"))
    joined = pairs.join(x, ["a", "na"]).join(y, ["b", "nb"]).select("a", "na", "b", "nb", "x", "y")
    found = joined.mapInPandas(_links, "a long, na int, b long, nb int, overlap long, total long")
    return found.select("a", "na", "b", "nb", "overlap", (F.col("total") - F.col("overlap")).alias("union"))


def divide_skip(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """All (i, j) with left[i] and right[j] linked: T-occurrence search of every right set in an index over the left."""
    sizes = np.array([len(s) for s in left], np.int64)
    items = np.concatenate(left)
    owner = np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]  # inverted lists, each sorted by set number
    for j, query in enumerate(right):
        q = len(query)
        lo, hi = np.searchsorted(items, query), np.searchsorted(items, query, side="right")
        least = -(-NUM * q // DEN)
        by_length = np.argsort(hi - lo, kind="stable")
        n_short = max(q - least + 1, int(((hi - lo) <= LONG).sum()))
        short, long = by_length[:n_short], by_length[n_short:]
        merged = np.bincount(np.concatenate([owner[lo[k] : hi[k]] for k in short]), minlength=len(left))
        found = np.flatnonzero(merged)
        count = merged[found]
        fits = (DEN * np.minimum(sizes[found], q) >= NUM * np.maximum(sizes[found], q))
        found, count = found[fits], count[fits]
        bound = needed(sizes[found], q)
        for done, k in enumerate(long):
            able = count + (len(long) - done) >= bound
            if not able.all():
                found, count, bound = found[able], count[able], bound[able]
            if not len(found):
                break
            inverted = owner[lo[k] : hi[k]]
            if len(inverted):
                at = np.searchsorted(inverted, found)
                count = count + (inverted[np.minimum(at, len(inverted) - 1)] == found)
        for i in found[count >= bound]:
            yield int(i), j


def _family_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, na, b, nb) inside families; members: hub, nhub, set_id, n, overlap with the hub, union."""
    far = F.least(F.floor((1 - F.col("overlap") / F.col("union")) * STEP), F.lit(STEP - 1)).cast("int")
    linked = DEN * F.col("overlap") >= NUM * F.col("union")
    members = members.withColumn("far", F.when(linked, F.least(far, F.lit(4))).otherwise(F.greatest(far, F.lit(5))))
    blocks_of = F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_ROWS)
    counts = cut(members.groupBy("hub", "nhub", "far").agg(blocks_of.alias("size")))
    whole = counts.groupBy("hub", "nhub").agg(F.sum("size").alias("all"), F.max("far").alias("farthest"))
    plan = counts.join(whole.where("farthest >= 5"), ["hub", "nhub"])  # a family whose members all link to the hub is done
    plan = cut(plan.select(
        "hub", "nhub", "far",
        F.when(F.col("all") <= 1, -1).otherwise(F.col("far")).alias("ring"),
        F.when(F.col("all") <= 1, 1).otherwise(F.ceil("size")).cast("int").alias("cuts"),
    ))
    blocks = members.join(plan, ["hub", "nhub", "far"]).withColumn("cut", F.pmod(F.xxhash64("set_id"), F.col("cuts")).cast("int"))
    tiles = plan.select("hub", "nhub", "ring", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")).distinct()
    other = tiles.select("hub", "nhub", F.col("ring").alias("ring2"), F.col("cut").alias("cut2"))
    pairs = cut(tiles.join(other, ["hub", "nhub"]).where(
        "(ring2 > ring or (ring2 = ring and cut2 >= cut)) and (ring2 >= 5 or ring2 = -1) and ring2 - ring <= 6"
    ))
    first = pairs.select("hub", "nhub", "ring", "cut", F.struct("ring", "cut", "ring2", "cut2").alias("tile"), F.lit(0).alias("side"))
    second = pairs.where("ring <> ring2 or cut <> cut2").select(
        "hub", "nhub", F.col("ring2").alias("ring"), F.col("cut2").alias("cut"), F.struct("ring", "cut", "ring2", "cut2").alias("tile"), F.lit(1).alias("side")
    )
    dealt = (
        blocks.join(first.unionByName(second), ["hub", "nhub", "ring", "cut"])
        .select("hub", "nhub", "tile", "side", "set_id", "n", "far")
        .join(sets, ["set_id", "n"])
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        two = one if two.empty else two
        out = []
        if not one.empty:
            near = one["far"].to_numpy() < 5, two["far"].to_numpy() < 5
            keep = ~near[1] | (not near[0].all())
            two = two[keep]
            near = near[0], near[1][keep]
            a, na = one["set_id"].to_numpy(), one["n"].to_numpy()
            b, nb = two["set_id"].to_numpy(), two["n"].to_numpy()
            seen = set()
            for i, j in divide_skip(list(one["items"]), list(two["items"])) if len(two) else ():
                if (near[0][i] and near[1][j]) or (a[i], na[i]) == (b[j], nb[j]):
                    continue
                link = (a[i], na[i], b[j], nb[j]) if (a[i], na[i]) < (b[j], nb[j]) else (b[j], nb[j], a[i], na[i])
                if link not in seen:
                    seen.add(link)
                    out.append(link)
        return pd.DataFrame(_forest(out), columns=["a", "na", "b", "nb"]).astype({"a": "int64", "na": "int32", "b": "int64", "nb": "int32"})

    return dealt.groupBy("hub", "nhub", "tile").applyInPandas(search, "a long, na int, b long, nb int")


def _forest(links: list[tuple]) -> list[tuple]:
    """The links that join two classes not joined by earlier ones: at most one per set."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for link in links:
        x, y = root(link[:2]), root(link[2:])
        if x != y:
            up[x] = y
            out.append(link)
    return out


def _named(docs: DataFrame, keyed: bool) -> tuple[int, DataFrame, DataFrame]:
    """The salt that makes names one-to-one, the rows with their names, and the smallest doc_id of each set."""
    for salt in range(8):
        names = cut(shingle_names(docs, salt, keyed))
        first = cut(
            names.where("n_shingles > 0 and doc_id is not null").groupBy("set_id", F.col("n_shingles").cast("int").alias("n"))
            .agg(F.min("doc_id").alias("doc_id"), (F.min("proof") != F.max("proof")).alias("twice"))
        )
        if first.where("twice").isEmpty():
            return salt, names, first.drop("twice")
    raise RuntimeError("sets of shingles have no one-to-one names")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Null, empty or blank texts have no set and link with nothing.  Texts of fewer than five words have one
    shingle.  Rows with equal sets link; repeated rows are kept.  A row without doc_id has no name to link by: it stays
    alone.  Texts of any length are read whole.  Extra columns are ignored; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):  # all that reads texts is stored inside
        return _classes(docs, False)


def _classes(docs: DataFrame, keyed: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    salt, names, first = _named(docs, keyed)
    docs = docs.where("doc_id is not null")
    sketch = spark.sparkContext.broadcast(_sketch(docs))
    lists = _postings(docs, sketch, salt).repartition("h").sortWithinPartitions("h", F.desc("weight"), "set_id", "n")
    merged = cut(
        lists.mapInPandas(_merge, "kind int, a long, na int, b long, nb int")
        .groupBy("kind", "a", "na", "b", "nb").agg(F.count("*").alias("times"))
    )
    sketch.destroy()  # nothing that follows reads it
    k = occurrences_column(F.least("na", "nb"))
    pairs = merged.where((F.col("kind") == 0) & (F.col("times") >= k)).select("a", "na", "b", "nb")
    fits = DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb")
    shared = merged.select(F.explode(F.array(
        F.struct(F.col("a").alias("b"), F.col("na").alias("nb"), "times"), F.struct("b", "nb", "times")
    )).alias("r")).select("r.*").groupBy("b", "nb").agg(F.sum("times").alias("shared"))
    able = shared.where(F.col("shared") >= occurrences_column(F.ceil(F.col("nb") * NUM / DEN)))
    family = cut(merged.where("kind = 1").join(able, ["b", "nb"], "left_semi").select("a", "na", "b", "nb"))
    merged = merged.where((F.col("kind") == 0) & (F.col("times") >= k)).select("a", "na", "b", "nb").unionByName(family)
    ends = merged.select(F.col("a").alias("set_id"), F.col("na").alias("n")).unionByName(merged.select(F.col("b").alias("set_id"), F.col("nb").alias("n"))).distinct()
    wanted = cut(first.join(ends, ["set_id", "n"]))
    sets = _load(docs, wanted, salt)
    hubs = cut(_overlaps(family.unionByName(pairs.where(fits)).distinct(), sets))
    star = hubs.where(DEN * F.col("overlap") >= NUM * F.col("union")).select("a", "na", "b", "nb")
    members = cut(hubs.join(family, ["a", "na", "b", "nb"], "left_semi").select(
        F.col("a").alias("hub"), F.col("na").alias("nhub"), F.col("b").alias("set_id"), F.col("nb").alias("n"), "overlap", "union"
    ))
    links = cut(star.unionByName(_family_links(members, sets)))  # as one plan with what follows, the driver would hold some twenty stages at once
    one = first.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("doc_id").alias("da"))
    two = first.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("doc_id").alias("db"))
    edges = links.join(one, ["a", "na"]).join(two, ["b", "nb"]).select(F.col("da").alias("a"), F.col("db").alias("b"))
    roots = components(edges)
    classes = cut(first.join(roots, first["doc_id"] == roots["node"], "left").select(
        "set_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")
    ))
    return names.join(classes, ["set_id", "n_shingles"], "left").select(
        "doc_id", *(["key"] if keyed else []), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def occurrences_column(n):
    return F.lit(1) + F.floor(n / 40).cast("int")


def _load(docs: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """set_id, n, items of the wanted sets, each read from one document that has it."""
    n_wanted = wanted.count()
    text = docs.join(F.broadcast(wanted) if n_wanted <= 1_000_000 else wanted, "doc_id")  # 24 MB at most

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(sid, n, s.view(np.int64)) for (k, s), sid, n in zip(_sets(pdf), pdf["set_id"], pdf["n"], strict=True) if len(s) == n and fingerprint(s, salt)[0] == sid]
            yield pd.DataFrame(rows, columns=["set_id", "n", "items"])

    sets = checkpointed(over_texts(text.select("set_id", "n", "text"), emit, "set_id long, n int, items array<long>"))
    return sets if sets.count() <= n_wanted else checkpointed(sets.dropDuplicates(["set_id", "n"]))  # doc_ids may repeat


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class, one with the smallest doc_id; its columns stay as they are.

    Rows are told apart by doc_id and text, so repeated doc_ids don't matter.  Rows without doc_id or words all stay.
    """
    with small_batches(docs.sparkSession):
        rows = _classes(docs, True)
    rows = cut(rows.where("n_shingles > 0 and doc_id is not null").groupBy("component_id", "doc_id", "key").agg(F.count("*").alias("n")))
    stays = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1)
    rows = cut(rows.join(stays, "component_id").withColumn("stays", F.struct("doc_id", "key") == F.col("first")))
    key = text_key(F.col("text"))
    return once(without(docs, rows.where("not stays"), key), rows.where("stays and n > 1"), key)
