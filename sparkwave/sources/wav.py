"""WAV export: sample encoders by position, channel interleaving, size plans, and one RIFF value per clip."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.functions import shaping as S

# Bits per sample and format code of each encoding.
FORMATS = {"u8": (8, 1), "i16": (16, 1), "i24": (24, 1), "i32": (32, 1), "f32": (32, 3), "f64": (64, 3), "alaw": (8, 6), "mulaw": (8, 7)}


def interleave(df: DataFrame, channels: int) -> DataFrame:
    """(clip_id, pos, x): L0, R0, L1, R1 ..."""
    return df.select("clip_id", (F.col("idx") * channels + F.col("channel")).alias("pos"), "x")


def pack_u12(df: DataFrame) -> DataFrame:
    """(clip_id, channel, g, b0, b1, b2): two unsigned 12-bit codes in three bytes; a missing second code is 0."""
    code = S.to_u12(F.col("x"))
    g = df.groupBy("clip_id", "channel", F.floor(F.col("idx") / 2).alias("g")).agg(
        F.max(F.when(F.col("idx") % 2 == 0, code)).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, code)), F.lit(0)).alias("b"))
    return g.select("clip_id", "channel", "g", (F.col("a") % 256).alias("b0"), (F.floor(F.col("a") / 256) + (F.col("b") % 16) * 16).alias("b1"), F.floor(F.col("b") / 16).alias("b2"))


def wav_size_plan(clips: DataFrame) -> DataFrame:
    """Adds data_bytes, list_bytes, riff_bytes, byte_rate; clips: n_samples, n_channels, bits, sample_rate, metadata (map)."""
    data = F.col("n_samples") * F.col("n_channels") * F.floor(F.col("bits") / 8)
    entries = F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    body = F.aggregate(entries, F.lit(0), lambda acc, e: acc + 8 + F.octet_length(e["value"]) + 1 + (F.octet_length(e["value"]) + 1) % 2)
    listed = F.when(F.size(entries) > 0, body + 12).otherwise(0)
    return clips.withColumns({
        "data_bytes": data.cast("long"), "list_bytes": listed.cast("long"), "riff_bytes": (F.lit(36) + data + data % 2 + listed).cast("long"),
        "byte_rate": (F.col("sample_rate") * F.col("n_channels") * F.floor(F.col("bits") / 8)).cast("long"),
    })


def _encode(x: np.ndarray, encoding: str) -> bytes:
    if encoding == "u8":
        return np.clip(np.trunc((x + 1) * 127.5), 0, 255).astype(np.uint8).tobytes()
    if encoding in ("f32", "f64"):
        return x.astype("<f4" if encoding == "f32" else "<f8").tobytes()
    if encoding == "i16":
        return np.clip(np.trunc(x * 32767), -32768, 32767).astype("<i2").tobytes()
    if encoding == "i24":
        v = np.clip(np.trunc(x * 8388607), -8388608, 8388607).astype("<i4")
        return v.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    if encoding == "i32":
        return np.clip(np.floor(x * 2147483647 + 0.5), -(2**31), 2**31 - 1).astype("<i4").tobytes()
    return x.astype(np.uint8).tobytes()  # codes of alaw and mulaw, made by column expressions


PART_FRAMES = 1 << 22  # positions of one part


def pack_wav(samples: DataFrame, clips: DataFrame, encoding: str = "i16", part_frames: int = PART_FRAMES) -> DataFrame:
    """(clip_id, part, wav BINARY): the parts of a clip in order are its file.

    A part holds the samples of `part_frames` positions, so a clip of any length is dealt over tasks and no value gets too large;
    part 0 begins with the header and the last one ends with padding and the INFO list.  Clips without samples have their header.
    A file of 4 GB or more does not fit the format's 32-bit sizes; it gets the largest size there, as streamed files do.
    """
    bits, code = FORMATS[encoding]
    plan = wav_size_plan(clips.withColumn("bits", F.lit(bits)))
    last = F.greatest(F.lit(0), F.ceil(F.col("n_samples") / part_frames) - 1).cast("long")
    plan = plan.select("clip_id", "sample_rate", "n_channels", "metadata", "data_bytes", "riff_bytes", last.alias("last"))
    x = {"alaw": S.to_alaw_byte, "mulaw": S.to_mulaw_byte}.get(encoding, lambda c: c)(F.col("x")).cast("double")
    parts = samples.withColumn("x", x).groupBy("clip_id", F.floor(F.col("idx") / part_frames).cast("long").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "channel", "x"))).alias("s"))
    every = plan.select("clip_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part")).drop("last")
    rows = every.join(parts.select("clip_id", "part", F.col("s.x").alias("x")), ["clip_id", "part"], "left").join(plan, "clip_id")

    @F.pandas_udf("binary")
    def pack(x: pd.Series, part: pd.Series, last: pd.Series, rate: pd.Series, channels: pd.Series, size: pd.Series, riff: pd.Series, meta: pd.Series) -> pd.Series:
        out = []
        for x_, part_, last_, rate_, channels_, size_, riff_, meta_ in zip(x, part, last, rate, channels, size, riff, meta, strict=True):
            data = _encode(np.asarray(x_, float), encoding) if x_ is not None else b""
            if part_ == 0:
                block = channels_ * bits // 8
                head = struct.pack("<IHHIIHH", 16, code, channels_, rate_, rate_ * block, block, bits)
                data = b"RIFF" + struct.pack("<I", min(riff_, 2**32 - 1)) + b"WAVEfmt " + head + b"data" + struct.pack("<I", min(size_, 2**32 - 1)) + data
            if part_ == last_:
                data += b"\0" * (size_ % 2) + _info(meta_)
            out.append(data)
        return pd.Series(out)

    value = pack("x", "part", "last", "sample_rate", "n_channels", "data_bytes", "riff_bytes", F.map_entries("metadata"))
    return rows.select("clip_id", "part", value.alias("wav"))


def _info(entries) -> bytes:
    info = b""
    for entry in entries if entries is not None else ():
        text = entry["value"].encode() + b"\0"
        info += entry["key"].encode()[:4].ljust(4) + struct.pack("<I", len(text)) + text + b"\0" * (len(text) % 2)
    return b"LIST" + struct.pack("<I", len(info) + 4) + b"INFO" + info if info else b""
