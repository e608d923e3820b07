"""Token-id files with Elias-Fano document boundaries.

A file holds: magic, version, number of documents n, number of ids u, bytes of the upper bits, then the ids
(little-endian unsigned 16- or 32-bit), and the Elias-Fano code of the n ends: the low l = floor(log2(u / n)) bits of each
end, packed; the high parts in unary, as n ones in n + (u >> l) + 1 bits; a sample of every 256th one's position.
About l + 2 bits a document instead of 64; the select structure returns any offset.
"""

from __future__ import annotations

import array
import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

MAGIC = b"SWIDS\x00\x00\x01"
SAMPLE = 256
END_ID = 2


class EliasFano:
    """Non-decreasing integers with select in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, u = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(n + (u >> bits) + 1, np.uint8)
        unary[at] = 1
        planes = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, bits, np.packbits(planes.reshape(-1), bitorder="little"), np.packbits(unary, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value: from the sampled one before it, counted on by bytes."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        bits = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= (ones := bits.bit_count()):
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return ((byte * 8 + (bits & -bits).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        window = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return (window >> (first % 8)) & ((1 << self.low_bits) - 1)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b, c = struct.unpack_from("<QQQQQ", data)
        low = np.frombuffer(data, np.uint8, a, 40)
        high = np.frombuffer(data, np.uint8, b, 40 + a)
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", c, 40 + a + b))


class _Memory(dict):
    """Values made on first use; beyond `most` entries new ones are made again each time."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


# The steps before the model of a tokenizer file whose words can be encoded one by one.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(settings: dict) -> bool:
    """Whether a tokenizer file normalises and splits texts as the word path does, so that a word's ids don't depend on its neighbours."""
    plain = all("<|" in t["content"] for t in settings["added_tokens"])
    model = settings["model"]
    fixed = model["type"] == "BPE" and not model["dropout"] and not settings["truncation"] and not settings["padding"]
    return plain and fixed and settings["normalizer"] == WORD_NORMALIZER and settings["pre_tokenizer"] == WORD_PRE_TOKENIZER


class WordEncoder:
    """Token ids of whole texts by the tokenizers library, remembering the ids of words where the file allows it.

    Files with the normaliser and splitting of `by_words` part texts at white space and then into runs of letters, single digits
    and runs of other signs; for texts of plain Latin characters a word's ids therefore don't depend on its neighbours, and each
    distinct piece is given to the library's model once.  Other texts, and all texts with any other file, go to the library whole.
    """

    MEMORY = 200_000  # words, and pieces of words, that a worker remembers: about 60 MB

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.by_words = by_words(json.loads(self.whole.to_str()))
        wide = max(self.whole.get_vocab().values()) > 0xFFFF
        self.code, self.dtype = ("I", "<u4") if wide else ("H", "<u2")
        # Fixed value: the splitting pattern above, for the characters of plain texts.
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
        self.odd = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-¬®-ÿ]")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words = _Memory(self.word, memory)
        self.known = _Memory(self.piece, memory)

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(self.shown[b] for b in piece.encode())
        return array.array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        word = word.lower()
        if word.isascii() and word.isalpha():
            return self.known[word]
        return b"".join(map(self.known.__getitem__, self.pieces.findall(word)))

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words or "<|" in text or self.odd.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), self.dtype)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker: the words it remembers serve all tasks that the worker runs."""
    return WordEncoder(path)


def _store(path: str):
    import pyarrow.fs

    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path)


def pack_file(ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u2")
    wide = len(flat) > 0 and int(flat.max()) > 0xFFFF
    ends = EliasFano.of(np.cumsum([len(x) for x in ids])).to_bytes()
    body = flat.astype("<u4" if wide else "<u2").tobytes()
    return MAGIC + struct.pack("<QQQQ", len(ids), len(flat), 4 if wide else 2, len(ends)) + ends + body


def unpack_file(data: bytes) -> tuple[EliasFano, np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    _, total, width, size = struct.unpack_from("<QQQQ", data, 8)
    return EliasFano.from_bytes(data[40 : 40 + size]), np.frombuffer(data, f"<u{width}", total, 40 + size)


FILE_IDS = 8_000_000  # ids in a file, about


def write_files(docs: DataFrame, tokenizer: str, out: str, end_id: int = END_ID, partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write files in ascending doc_id order; returns the table of files, written beside them.

    Rows are range-partitioned by doc_id and sorted inside; a partition writes files of about `file_ids` ids.  A
    task's files have names of its own, and only those of finished tasks are in the table, so that lost
    executors and repeated tasks leave no wrong data.  The table has one row a file, with its doc_ids but for the
    null ones, which come first.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id", F.xxhash64("text"))
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text")).select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part, number = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        ids, names, size = [], [], 0
        end = np.array([end_id], "<u4" if end_id > 0xFFFF else encoder(tokenizer).dtype)
        fs, root = _store(out)
        fs.create_dir(root, recursive=True)

        def flush() -> pd.DataFrame:
            name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(pack_file(ids))
            return pd.DataFrame({"part": [part], "number": [number], "name": [name], "n_docs": [len(ids)], "n_ids": [size], "doc_ids": [np.array(names, np.int64)]})

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids.append(np.append(encode(text), end))
                if doc_id is not None:
                    names.append(int(doc_id))
                size += len(ids[-1])
                if size >= file_ids:
                    yield flush()
                    ids, names, size, number = [], [], 0, number + 1
        if ids:
            yield flush()

    table = rows.mapInPandas(write, "part int, number int, name string, n_docs long, n_ids long, doc_ids array<long>")
    table.write.parquet(f"{out}-table")
    return spark.read.schema(table.schema).parquet(f"{out}-table")


def read_files(spark: SparkSession, table: DataFrame, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Starts of files are sums over the narrow table of files, cumulated in one task (a row per 8 million ids).  Documents without
    doc_id come first, and keep their null; repeated rows each have an entry; an empty text has its end id only.
    """
    from pyspark.sql.window import Window

    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = table.select("part", "number", "name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    files = spread(table.select("name", "n_docs", "doc_ids").join(base, "name"), table.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _store(out)
        for pdf in batches:
            for name, base, n_docs, doc_ids in zip(pdf["name"], pdf["base"], pdf["n_docs"], pdf["doc_ids"], strict=True):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    ends, ids = unpack_file(f.read())
                at, rows = 0, []
                for doc_id in [*[None] * (n_docs - len(doc_ids)), *map(str, doc_ids.tolist())]:
                    to = ends.select(len(rows))
                    rows.append((doc_id, int(base) + at, to - at, zlib.crc32(ids[at:to].astype("<u4").tobytes())))
                    at = to
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    out_rows = files.mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return out_rows.withColumn("doc_id", F.col("doc_id").cast("long"))
