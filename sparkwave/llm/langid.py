"""Language identification by word-first backoff.

A word (run of letters, lower-cased) that the model knows is scored by its log relative frequency in each
language; an unseen word falls back to its character n-grams, n = 5 down to 1, at the largest n of which the
model knows at least one, and takes the mean of the known ones.  A text's score in a language is the sum over its words.

The model is fitted on a bounded sample: about SAMPLE_ROWS labelled rows per language, and SAMPLE_TOTAL in all, chosen by a hash of
the doc_id among the rows allowed for learning.  Every word and n-gram of the sample is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, cut, small_batches, text_groups, text_key, without
from .shingles import mix

SAMPLE_ROWS = 2000  # per language, on average
SAMPLE_TOTAL = 40_000  # of all languages, on average
SAMPLE_CHARS = 400_000_000  # code points of the sample, on average
LONGEST = 5
SLICE_CHARS = 400_000
GROUP_CHARS = 2_000_000  # of texts that are joined; a longer text is a group of its own
ENTRIES = pa.schema([("n", pa.int32()), ("key", pa.string()), ("lang", pa.string()), ("count", pa.int64())])
_PRIME = np.uint64(0x100000001B3)
_letters: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    out = _letters[0][np.minimum(codes, 0xFFFF)]
    for k in np.flatnonzero(codes > 0xFFFF):
        out[k] = chr(codes[k]).isalpha()
    return out


def _gram_hash(codes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(start), n, np.uint64)
    for k in range(n):
        h = (h * _PRIME) ^ codes[start + k]
        h = h * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def _word_hash(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.full(len(start), 77, np.uint64)
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    h = out[order]
    live = len(s)
    k = 0
    while live:
        while live and n[live - 1] <= k:
            live = int(np.searchsorted(-n[:live], -k, side="left"))
        if not live:
            break
        h[:live] = ((h[:live] * _PRIME) ^ codes[s[:live] + k]) * np.uint64(0x9E3779B97F4A7C15)
        k += 1
    out[order] = h
    return mix(out)


class Model:
    """Sorted key hashes, and for each key the languages it was seen in.

    The score of a key in a language is log10 of its share of the level's occurrences (words, or n-grams of one length); a key
    of other languages only counts as a tenth of one occurrence.  So a level has one base score per language, and
    an entry adds log10(10 * count) to it.
    """

    def __init__(self, langs: list[str], entries: pa.Table):
        """entries: n (0 for a word), key, lang and count."""
        self.langs = langs
        self.base = np.zeros((LONGEST + 1, len(langs)))
        hashes, added, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        levels, count = entries["n"].to_numpy(), entries["count"].to_numpy()
        lang = pc.index_in(entries["lang"], pa.array(langs, pa.string())).to_numpy().astype(np.int64)
        for n in range(LONGEST + 1):
            at = np.flatnonzero(levels == n)
            total = np.bincount(lang[at], count[at], minlength=len(langs))
            self.base[n] = np.log10(0.1 / np.maximum(total, 1))
            keys = entries["key"].take(pa.array(at))
            length = pc.utf8_length(keys).to_numpy().astype(np.int64)
            start = np.cumsum(length) - length
            codes = _codes("".join(keys.to_pylist()))
            if len(at):
                hashes.append(_gram_hash(codes, start, n) if n else _word_hash(codes, start, length))
                added.append(lang[at])
                counts.append(count[at])
        h, added, counts = np.concatenate(hashes), np.concatenate(added), np.concatenate(counts)
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.ends = np.append(first, len(h))
        self.lang, self.gain = added[order].astype(np.int32), np.log10(10.0 * counts[order]).astype(np.float32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row numbers, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def _add(self, total: np.ndarray, owner: np.ndarray, row: np.ndarray, weight: np.ndarray) -> None:
        """Add the gains of keys (row) to the totals of their texts (owner)."""
        each = self.ends[row + 1] - self.ends[row]
        which = np.repeat(np.arange(len(row)), each)
        entry = np.arange(len(which)) + np.repeat(self.ends[row] - (np.cumsum(each) - each), each)
        cell = owner[which] * len(self.langs) + self.lang[entry]
        total += np.bincount(cell, self.gain[entry] * weight[which], minlength=total.size).reshape(total.shape)

    def add_words(self, total: np.ndarray, owner: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Add the words' scores to their texts (rows of total)."""
        row = self.find(_word_hash(codes, start, length))
        known = row >= 0
        self._add(total, owner[known], row[known], np.ones(int(known.sum())))
        total += np.bincount(owner[known], minlength=len(total))[:, None] * self.base[0]
        for n in range(LONGEST, 0, -1):
            todo = np.flatnonzero(~known & (length >= n))
            if not len(todo):
                continue
            each = length[todo] - n + 1
            which = np.repeat(np.arange(len(todo)), each)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            row = self.find(_gram_hash(codes, start[todo][which] + offset, n))
            which, row = which[row >= 0], row[row >= 0]
            hits = np.bincount(which, minlength=len(todo))
            got = todo[hits > 0]
            self._add(total, owner[todo[which]], row, 1 / hits[which])
            total += np.bincount(owner[got], minlength=len(total))[:, None] * self.base[n]
            known[got] = True

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; `und` and 0 without letters, or without a model.  The score is the language's share
        of the likelihood of all words."""
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= GROUP_CHARS):
                size += len(texts[to] or "")
                to += 1
            out += self._predict(texts[at:to])
            at = to
        return out

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The texts are joined and read in slices that end between words, so that memory stays bounded."""
        lowered = [(t or "").lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in lowered])
        total = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts), bool)
        codes = _codes("\n".join(lowered))
        at = 0
        while at < len(codes):
            to = min(at + SLICE_CHARS, len(codes))
            letter = _is_letter(codes[at:to])
            while to < len(codes) and letter[-1]:
                more = _is_letter(codes[to : to + 4096])
                stop = np.flatnonzero(~more)
                grow = int(stop[0]) + 1 if len(stop) else len(more)
                letter = np.concatenate([letter, more[:grow]])
                to += grow
            edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            start, length = edge[::2], edge[1::2] - edge[::2]
            if len(start):
                owner = np.searchsorted(ends, start + at, side="right")
                letters[owner] = True
                if self.langs:
                    self.add_words(total, owner, codes[at:to], start, length)
            at = to
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        weight = np.exp(np.log(10) * (total - total.max(axis=1, keepdims=True)))
        best = weight.argmax(axis=1)
        score = weight.max(axis=1) / weight.sum(axis=1)
        return [(self.langs[k], float(x)) if seen else ("und", 0.0) for k, x, seen in zip(best, score, letters, strict=True)]


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length("key") - (n - 1)), lambda i: F.substring("key", i, n))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_total: int = SAMPLE_TOTAL, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from rows with a doc_id, a language and a text that are not held out; see the bounds above, which hold rows and text."""
    allowed = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    found = allowed.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    sizes = {r["lang"]: r["n"] for r in found}
    chars = {r["lang"]: sample_chars / len(sizes) / max(1, r["chars"]) for r in found}  # share of a language's text that fits
    if not sizes:
        return Model([], ENTRIES.empty_table())
    rows = min(sample_rows, sample_total / len(sizes))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, rows / n, chars[lang]))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    sample = allowed.where(chance < share[F.col("lang")])
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("key")).where("key <> ''")
    words = checkpointed(words.groupBy("lang", "key").count())
    entries = words.select(F.lit(0).alias("n"), "key", "lang", "count")
    for n in range(1, LONGEST + 1):
        gram = _grams(n)
        grams = words.where(F.length("key") >= n).select("lang", "count", F.explode(gram).alias("key"))
        entries = entries.unionByName(grams.groupBy("lang", "key").agg(F.sum("count").alias("count")).select(F.lit(n).alias("n"), "key", "lang", "count"))
    found = entries.select("n", "key", "lang", "count").toArrow()  # what the bounded sample holds
    return Model(sorted(sizes), found)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row.

    A null text or one without a letter gives `und` and 0; so does every text when nothing could be learned.
    Texts are read whole.  Repeated rows are kept; a null doc_id stays null and is not held out, but nothing is learned from its
    row either; extra columns are ignored; ties take the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [x for group in text_groups(texts) for x in shared.value.predict(group)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


LEAST_SCORE = 0.3  # with four languages or more, hardly better than chance


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """`docs` without those that have no recognisable language (`und`, or a score under `least_score`).

    The score of a text of one or two words is often low though its words are sound, so the bound is close to chance.
    Which rows go (by doc_id and text) is found and stored at once; columns stay as they are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs))

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        return pa.array([x[0] != "und" and x[1] >= least_score for group in text_groups(texts) for x in shared.value.predict(group)], pa.bool_())

    key = text_key(F.col("text"))
    with small_batches(spark):
        gone = cut(docs.select("doc_id", key.alias("key"), accepted("text").alias("fine")).where("not fine").select("doc_id", "key"))
    return without(docs, gone, key)
