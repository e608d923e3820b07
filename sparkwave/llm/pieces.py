"""SentencePiece encoding and decoding: byte-pair merges in vectorised rounds.

The distinct words of a group of texts lie one behind the other in flat numpy arrays of symbols.  A round takes the
minimum rank of each word's pairs by one segmented reduction, merges all leftmost pairs of that rank in all words at once, and
compacts the arrays; words without a pair left leave them.  Rounds end when no pair remains.

One by one, the best pair of a word is merged first, and of equal ones the leftmost.  Merging all pairs of the least rank r in
one round is the same as long as no merge makes a new pair of rank r or less.  Where one does (runs of white space, whose
pieces have one score), the word's pairs of rank r are gone through from the left, following the new ones, for that round.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in a model file
WIDE = 22  # bits of a symbol's number: pieces, then single characters that are none
NONE = np.iinfo(np.int64).max


class PieceModel:
    """Pieces, pairs and decoding table of a model file; encodes and decodes groups of texts.

    Serves byte-pair models with byte fallback and a dummy prefix.  Models of another kind, or with user-defined
    or unused pieces, are refused with ValueError rather than encoded wrongly.
    """

    MEMORY = 150_000  # words whose ids a worker remembers: about 25 MB
    LONGEST = 64  # code points of a remembered word
    slot_bits = 20

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        kinds = [p.type for p in spec.pieces]
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not {NORMAL, BYTE} <= set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair models with byte fallback and plain pieces are served")
        if not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep white space and put a dummy prefix are served")
        self.plain = not norm.precompiled_charsmap and not norm.normalization_rule_tsv
        names = [p.piece for p in spec.pieces]
        self.size, self.unknown = len(names), spec.trainer_spec.unk_surface
        self.kinds = np.array(kinds)
        self.known = {p: i for i, p in enumerate(names) if kinds[i] == NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(names[i][3:5], 16)] = i
        self._pairs({p: spec.pieces[i].score for p, i in self.known.items()})
        shown = [self._shown(p, k) for p, k in zip(names, kinds, strict=True)]
        self.blob = np.frombuffer(b"".join(shown), np.uint8)
        self.widths = np.array([len(s) for s in shown])
        self.offsets = np.cumsum(self.widths) - self.widths
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(names, kinds, strict=True)])
        inside = {c for p in self.known for c in p}
        #: Where no piece holds a character before a space sign, texts can be cut in front of such signs, and around lines' ends.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.known)
        ends = "" if "\n" in inside else "\n"
        self.words = re.compile(f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+" + (f"|{ends}" if ends else ""))
        self.memory: dict[str, bytes] = {}

    def _shown(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else (self.unknown if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    def _symbol(self, part: str) -> int | None:
        return self.known.get(part, self.size + ord(part) if len(part) == 1 else None)

    def _pairs(self, scores: dict[str, float]) -> None:
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rows = [
            (a << WIDE | b, ranks[scores[p]], i)
            for p, i in self.known.items() for k in range(1, len(p))
            if (a := self._symbol(p[:k])) is not None and (b := self._symbol(p[k:])) is not None
        ]
        self.keys = np.array([r[0] for r in rows] + [NONE])  # the last entry stands for: no pair
        self.ranks = np.array([r[1] for r in rows] + [NONE])
        self.made = np.array([r[2] for r in rows] + [-1])
        self.no_pair = len(rows)
        # A hash table with open addressing: the places of keys, no_pair where a slot is free.
        self.slots = np.full(1 << self.slot_bits, self.no_pair)
        left = np.arange(len(rows))
        slot = self._slot(self.keys[left])
        while len(left):
            free = self.slots[slot] == self.no_pair
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) % len(self.slots)
        self.single = np.arange(self.size, self.size + 0x110000)
        for p, i in self.known.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.bigrams = np.array(sorted({ord(a) << 21 | ord(b) for p in self.known for a, b in itertools.pairwise(p)}))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        # Fixed value: 2^64 divided by the golden ratio, as in Fibonacci hashing.
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; no_pair where the two make no piece."""
        want = left << WIDE | right
        slot = self._slot(want)
        at = self.slots[slot]
        odd = np.flatnonzero((self.keys[at] != want) & (at != self.no_pair))
        while len(odd):
            slot[odd] = (slot[odd] + 1) % len(self.slots)
            at[odd] = self.slots[slot[odd]]
            odd = odd[(self.keys[at[odd]] != want[odd]) & (at[odd] != self.no_pair)]
        return at

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each normalised word, as little-endian 32-bit integers."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words])
        new = np.zeros(len(chars), bool)
        new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        # No merge crosses two characters that stand side by side in no piece: what lies between is a word of its own.
        near = chars[:-1] << 21 | chars[1:]
        new[1:] |= self.bigrams[np.minimum(np.searchsorted(self.bigrams, near), len(self.bigrams) - 1)] != near
        at, sym = self._rounds(self.single[chars], np.cumsum(new))
        plain = sym < self.size
        raw = [chr(c - self.size).encode() for c in sym[~plain].tolist()]
        width = np.ones(len(sym), np.int64)
        width[~plain] = [len(b) for b in raw]
        ids = np.repeat(sym, width).astype("<i4")
        ids[np.repeat(~plain, width)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.concatenate(([0], np.cumsum(width)))[np.searchsorted(at, np.cumsum(sizes))]
        data = ids.tobytes()
        return [data[a * 4 : b * 4] for a, b in itertools.pairwise([0, *ends.tolist()])]

    def _rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, finished = np.arange(len(sym)), []
        pair = np.full(len(sym), self.no_pair)
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        pair[inner] = self._pair(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
            sizes = np.diff(starts, append=len(sym))
            rank = self.ranks[pair]
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = least != NONE
            if not live.all():
                finished.append((at[~live], sym[~live]))
                at, sym, seg, pair, rank, least = (x[live] for x in (at, sym, seg, pair, rank, least))
                if not len(sym):
                    break
            sym, kept = self._merged(sym, seg, pair, rank, least)
            fresh = np.flatnonzero(np.concatenate((~kept, [False]))[1:] & kept)  # survivors whose next symbols were merged into them
            index = np.cumsum(kept) - 1
            at, sym, seg, pair = (x[kept] for x in (at, sym, seg, pair))
            touched = np.zeros(len(sym) + 1, bool)
            touched[index[fresh]] = touched[index[fresh] - 1] = True  # -1 is the entry past the end
            again = np.flatnonzero(touched[:-1])
            pair[again] = self.no_pair
            inner = again[seg[again] == seg[np.minimum(again + 1, len(sym) - 1)]]
            inner = inner[inner + 1 < len(sym)]
            pair[inner] = self._pair(sym[inner], sym[inner + 1])
        if not finished:
            return at, sym
        at, sym = (np.concatenate(x) for x in zip(*finished, strict=True))
        order = np.argsort(at)
        return at[order], sym[order]

    def _merged(self, sym, seg, pair, rank, least) -> tuple[np.ndarray, np.ndarray]:
        """The symbols after one round, in place of their first parts, and which places are kept."""
        hits = np.flatnonzero(rank == least)
        number = np.arange(len(hits))
        first = np.diff(hits, prepend=-2) != 1
        take = hits[(number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0]
        made = self.made[pair[take]]
        # New pairs, as they are when each merge is done: to the left all is merged, to the right nothing yet.
        before = np.where(np.diff(take, prepend=-9) == 2, np.concatenate(([0], made[:-1])), sym[take - 1])
        has_left = (take > 0) & (seg[take - 1] == seg[take])
        after = np.minimum(take + 2, len(sym) - 1)
        has_right = (take + 2 < len(sym)) & (seg[after] == seg[take])
        low = least[take]
        early = has_left & (self.ranks[self._pair(before, made)] <= low) | has_right & (self.ranks[self._pair(made, sym[after])] <= low)
        kept = np.ones(len(sym), bool)
        sym = sym.copy()
        if early.any():
            odd = np.unique(seg[take[early]])
            slow = np.isin(seg[take], odd)
            for s in odd.tolist():
                a, b = np.searchsorted(seg, [s, s + 1]).tolist()
                x, y = np.searchsorted(hits, [a, b]).tolist()
                self._walk(sym, kept, a, b, hits[x:y].tolist(), int(least[a]))
            take, made = take[~slow], made[~slow]
        sym[take] = made
        kept[take + 1] = False
        return sym, kept

    @functools.cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def _walk(self, sym: np.ndarray, kept: np.ndarray, start: int, end: int, hits: list[int], low: int) -> None:
        """One word's merges of rank `low` from the left, with those that they make of that rank; ends before a better pair."""
        symbols, alive, none = sym[start:end].tolist(), [True] * (end - start), (NONE, -1)

        def step(i: int, by: int) -> int:
            i += by
            while 0 <= i < len(alive) and not alive[i]:
                i += by
            return i

        def pair(i: int, k: int) -> tuple[int, int]:
            return self.table.get(symbols[i] << WIDE | symbols[k], none) if i >= 0 and k < len(alive) else none

        def merges() -> None:
            for i in hits:
                i -= start
                k = step(i, 1)
                rank, made = pair(i, k) if alive[i] else none
                while rank == low:
                    symbols[i], alive[k] = made, False
                    h, k = step(i, -1), step(k, 1)
                    left, right = pair(h, i), pair(i, k)
                    if min(left, right)[0] < low:
                        return
                    (rank, made), i, k = (left, h, i) if left[0] == low else (right, i, k)

        merges()
        sym[start:end], kept[start:end] = symbols, alive

    def normalise(self, text: str) -> str:
        return (SPACE + text.replace(" ", SPACE) if text else "") if self.plain else self.library.normalize(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library's encode gives them."""
        cut = [self.words.findall(t) if self.cuts else [t] for t in map(self.normalise, texts)]
        fresh = list(set().union(*cut).difference(self.memory))
        if fresh:
            self.memory.update(zip(fresh, self.merge(fresh), strict=True))
        ids = [np.frombuffer(b"".join(map(self.memory.__getitem__, words)), "<i4") for words in cut]
        room = self.MEMORY - len(self.memory) + len(fresh)
        for w in fresh:
            if len(w) <= self.LONGEST and room > 0:
                room -= 1
            else:
                del self.memory[w]
        return ids

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """The text of each list of ids, as the library's decode gives it; ids outside the model raise IndexError, as there."""
        flat = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        if len(flat) and not 0 <= flat.min() <= flat.max() < self.size:
            raise IndexError("piece id is out of range")
        width = self.widths[flat]
        ends = np.cumsum(width)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[flat] - (ends - width), width)
        data = self.blob[places].tobytes()
        out, at, a = [], 0, 0
        for ids in lists:
            b = int(ends[at + len(ids) - 1]) if len(ids) else a
            head = next((i for i in ids[:64].tolist() if self.kinds[i] != CONTROL), None) if len(ids) else None
            if head is None and len(ids) > 64:
                head = next((i for i in ids.tolist() if self.kinds[i] != CONTROL), None)
            skip = int(head is not None and bool(self.spaced[head]))
            split = CONTROL in self.kinds[ids]  # control pieces show nothing, but part bytes
            try:
                out.append(self._lenient(ids.tolist())[skip:] if split else data[a + skip : b].decode())
            except UnicodeDecodeError:
                out.append(self._lenient(ids.tolist())[skip:])
            at, a = at + len(ids), b
        return out

    def _lenient(self, ids: list[int]) -> str:
        """Byte pieces that make no character each stand for a replacement sign."""
        parts = []
        for is_byte, run in itertools.groupby(ids, lambda i: self.kinds[i] == BYTE):
            data, i = b"".join(self.blob[self.offsets[x] : self.offsets[x] + self.widths[x]].tobytes() for x in run), 0
            while is_byte and i < len(data):
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(data[i : i + n].decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    i += 1
            if not is_byte:
                parts.append(data.decode())
        return "".join(parts)


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of this Python worker: the words it remembers serve all tasks that the worker runs."""
    return PieceModel(path)


GROUP_CHARS = 500_000  # code points of texts, or ids, that are cut into words at a time


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` in all; a larger row is a run of its own."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _added(df: DataFrame, column: str, name: str, kind, of) -> DataFrame:
    """`df` with a column made from groups of rows of `column`; a column that has the name already (in any case) is replaced."""
    names = [f.name for f in df.schema.fields]
    source = next(i for i, n in enumerate(names) if n.lower() == column.lower())
    kept = [i for i, n in enumerate(names) if n.lower() != name.lower()]
    schema = StructType([*(df.schema.fields[i] for i in kept), StructField(name, kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, made in of(batch.column(source)):
                part = batch.slice(first, len(made))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), made], names=schema.names)

    return df.mapInArrow(work, schema)


def encode(df: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """`df` with the token ids (array<int>) of its `column`, without begin or end ids; null counts as empty, an empty text has no ids.

    Other columns stay as they are, repeated rows and null ids too; an existing column `out`, `column` itself included, is
    replaced.  Each row's whole text is encoded; a very long one is a group of its own.
    """

    def of(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        texts = texts.fill_null("")
        for a, b in _groups(pc.utf8_length(texts).to_pylist(), GROUP_CHARS):
            ids = model(path).encode(texts.slice(a, b - a).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield a, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

    return _added(df, column, out, ArrayType(IntegerType()), of)


def decode(df: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of the ids in `column`; null counts as no ids, whose text is empty.  Otherwise as `encode`."""

    def of(lists: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        for a, b in _groups(lists.value_lengths().fill_null(0).to_pylist(), GROUP_CHARS):
            part = lists.slice(a, b - a)
            flat, sizes = part.flatten().to_numpy(zero_copy_only=False), part.value_lengths().fill_null(0)
            yield a, pa.array(model(path).decode(np.split(flat, np.cumsum(sizes.to_numpy(zero_copy_only=False))[:-1])), pa.string())

    return _added(df, column, out, StringType(), of)
