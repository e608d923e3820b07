"""All registered queries of the signal and cue library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.functions import shaping as S
from sparkwave.operators import chain, cues, effects, filters, levels, spectral, vocoder
from sparkwave.plans import views as V
from sparkwave.sources import signals, storage, wav
from sparkwave.streaming import signals as streaming

Q: dict = {}
SQL: dict[str, str] = {}


def r6(name: str):
    return (F.round(F.col(name), 6) + 0.0).alias(name)


def samples(df: DataFrame) -> DataFrame:
    """The compared form of a samples table."""
    return df.select("clip_id", F.col("channel").cast("int").alias("channel"), F.col("idx").cast("long").alias("idx"), r6("x"))


def add(name: str, fn, sql: str | None = None) -> None:
    Q[name] = fn
    if sql:
        SQL[name] = sql


def on_sig(name: str, fn, sql: str | None = None, view=V.sig) -> None:
    add(name, lambda spark, d: samples(fn(view(spark, d))), sql)


def pick(x: str, source: str = "sig", ctes: str = "", base: str = V.SIG, idx: str = "idx", channel: str = "channel") -> str:
    return f"WITH RECURSIVE {base}{', ' + ctes if ctes else ''} SELECT clip_id, CAST({channel} AS INTEGER) AS channel, CAST({idx} AS BIGINT) AS idx, round({x}, 6) + 0.0 AS x FROM {source}"


def per_sample(name: str, expr, sql: str) -> None:
    on_sig(name, lambda df: effects.put(df, expr(F.col("x"))), pick(sql))


def codes(name: str, expr, sql: str) -> None:
    add(name, lambda spark, d: V.sig(spark, d).select("clip_id", "idx", expr(F.col("x")).cast("long").alias("code")),
        f"WITH {V.SIG} SELECT clip_id, idx, CAST({sql} AS BIGINT) AS code FROM sig")


def flagship(spark, sf_dir: str) -> DataFrame:
    """Levels to six digits.  A mean is first taken to twelve: a mean of few digits may lie half way between two of six, and then goes away from
    zero, whatever the order of the sum."""
    x = levels.normalize(effects.gain_clip(V.sig(spark, sf_dir), 1.7, mode="clamp"))
    return x.groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.round(F.avg("x"), 12), 6).alias("mean"), F.round(F.max(F.abs("x")), 6).alias("peak"))


# -- A: sources and framing ----------------------------------------------------------------------------------------------
add("flagship_levels", flagship, f"""WITH {V.SIG}, c AS (SELECT *, greatest(-1.0, least(1.0, x * 1.7)) AS y FROM sig),
m AS (SELECT clip_id, max(abs(y)) AS m FROM c GROUP BY clip_id)
SELECT clip_id, count(*) AS n, CAST(round(CAST(avg(y * (0.9 / m)) AS DECIMAL(18, 12)), 6) AS DOUBLE) AS mean, round(max(abs(y * (0.9 / m))), 6) AS peak FROM c JOIN m USING (clip_id) GROUP BY clip_id""")
on_sig("a1_index_signal", lambda df: df, pick("x"))
on_sig("a1_index_signal_bucketed", lambda df: df, pick("x", base=V.LONG), V.sig_long)
FRAME_SQL = """f AS (SELECT clip_id, channel, idx // {s} AS frame_no, list(x ORDER BY idx) AS data, count(*) AS c FROM sig GROUP BY ALL)"""


def frame_rows(frames: DataFrame) -> DataFrame:
    total = F.aggregate("data", F.lit(0.0), lambda a, b: a + b)
    return frames.select("clip_id", "frame_no", "start_idx", F.size("data").cast("long").alias("size"), F.round(F.get("data", F.lit(0)), 6).alias("first"), (F.round(total, 6) + 0.0).alias("total"))


FRAME_OUT = " SELECT clip_id, frame_no, frame_no * {h} AS start_idx, CAST(len(data) AS BIGINT) AS size, round(data[1], 6) AS first, round(list_sum(data), 6) + 0.0 AS total FROM f"
add("a2_frames_drop", lambda s, d: frame_rows(signals.to_frames(V.sig(s, d), 16)), f"WITH {V.SIG}, {FRAME_SQL.format(s=16)}" + FRAME_OUT.format(h=16) + " WHERE c = 16")
add("a2_frames_pad", lambda s, d: frame_rows(signals.to_frames(V.sig(s, d), 16, tail="pad")),
    f"WITH {V.SIG}, f AS (SELECT clip_id, idx // 16 AS frame_no, list_resize(list(x ORDER BY idx), 16, 0.0) AS data FROM sig GROUP BY ALL)" + FRAME_OUT.format(h=16))
add("a2_frames_overlap", lambda s, d: frame_rows(signals.to_frames(V.sig(s, d), 16, 4, "drop")),
    f"""WITH {V.SIG}, e AS (SELECT *, unnest(range(greatest(0, CAST(floor((idx - 16) / 4.0) AS BIGINT) + 1), idx // 4 + 1)) AS frame_no FROM sig),
    f AS (SELECT clip_id, frame_no, list(x ORDER BY idx) AS data FROM e GROUP BY ALL HAVING count(*) = 16)""" + FRAME_OUT.format(h=4))
on_sig("a3_from_frames", lambda df: signals.from_frames(signals.to_frames(df, 16, tail="keep")), pick("x"))
add("a4_pair_stereo", lambda s, d: signals.pair_stereo(V.sig_stereo(s, d)).select("clip_id", "idx", r6("l"), r6("r")),
    f"WITH {V.SIG}, {V.LR} SELECT clip_id, idx, round(l, 6) + 0.0 AS l, round(r, 6) + 0.0 AS r FROM lr")
on_sig("a4_unpair_stereo", lambda df: signals.unpair_stereo(signals.pair_stereo(df)), pick("x", "st", f"{V.LR}, {V.STEREO}"), V.sig_stereo)
LABELS = ", ".join(f"({c}, '{n}', {str(i).lower()})" for c, n, i in signals.LAYOUT)
add("a5_label_channels", lambda s, d: signals.label_channels(V.sig(s, d).withColumn("channel", (F.col("idx") % 8).cast("int")), True).select("clip_id", "idx", "channel", "label"),
    f"WITH {V.SIG}, lay(channel, label, often) AS (VALUES {LABELS}) SELECT clip_id, idx, CAST(lay.channel AS INTEGER) AS channel, label FROM sig JOIN lay ON sig.idx % 8 = lay.channel WHERE NOT often")


def clips(spark, d) -> DataFrame:
    n = V.sig(spark, d).groupBy("clip_id").agg(F.count("*").alias("n_samples"))
    meta = F.create_map(F.lit("INAM"), F.concat(F.lit("user "), F.col("clip_id").cast("string")))
    return n.select("clip_id", F.lit(8000).alias("sample_rate"), "n_samples", F.lit(1).alias("n_channels"), F.lit("pcm").alias("encoding"), F.lit(16).alias("bits"), meta.alias("metadata"))


def le(v: str, size: int) -> str:
    """Hex of a little-endian unsigned integer."""
    return " || ".join(f"lpad(to_hex((CAST({v} AS BIGINT) >> {8 * k}) & 255), 2, '0')" for k in range(size))


add("a8_pack_wav", lambda s, d: wav.pack_wav(V.sig(s, d), clips(s, d)).select("clip_id", "part", F.hex("wav").alias("wav")),
    f"""WITH {V.SIG}, v AS (SELECT clip_id, idx, CAST(greatest(-32768, least(32767, trunc(x * 32767))) AS BIGINT) & 65535 AS u FROM sig),
    p AS (SELECT clip_id, count(*) * 2 AS data, strlen('user ' || clip_id) + 1 AS t, string_agg({le("u", 2)}, '' ORDER BY idx) AS body FROM v GROUP BY clip_id)
    SELECT clip_id, CAST(0 AS BIGINT) AS part, upper(hex('RIFF') || {le("36 + data + 20 + t + t % 2", 4)} || hex('WAVEfmt ') || {le("16", 4)} || {le("1", 2)} || {le("1", 2)} || {le("8000", 4)} || {le("16000", 4)} || {le("2", 2)} || {le("16", 2)}
     || hex('data') || {le("data", 4)} || body || hex('LIST') || {le("12 + t + t % 2", 4)} || hex('INFO') || hex('INAM') || {le("t", 4)} || hex('user ' || clip_id) || '00' || repeat('00', t % 2)) AS wav FROM p""")
add("a9_wav_size_plan", lambda s, d: wav.wav_size_plan(clips(s, d)).select("clip_id", "data_bytes", "list_bytes", "riff_bytes", "byte_rate"),
    f"""WITH {V.SIG}, p AS (SELECT clip_id, n * 2 AS data, strlen('user ' || clip_id) + 1 AS t FROM len)
    SELECT clip_id, CAST(data AS BIGINT) AS data_bytes, CAST(20 + t + t % 2 AS BIGINT) AS list_bytes, CAST(36 + data + 20 + t + t % 2 AS BIGINT) AS riff_bytes, CAST(16000 AS BIGINT) AS byte_rate FROM p""")

# -- B: one sample ---------------------------------------------------------------------------------------------------------
per_sample("b1_gain", lambda x: x * 1.3, "x * 1.3")
per_sample("b2_gain_clip", lambda x: S.gain_clip(x, 1.7, "clamp", dc=0.13, dc_before=True), "greatest(-1.0, least(1.0, (x + 0.13) * 1.7))")
per_sample("b3_clamp", lambda x: S.gain_clip(x, 2.1, "clamp", -0.7, 0.9, dc=0.05), "greatest(-0.7, least(0.9, x * 2.1)) + 0.05")
per_sample("b4_wrap", lambda x: S.clip(x * 2.3, "wrap", -0.8, 1.1), "CASE WHEN x * 2.3 >= -0.8 AND x * 2.3 < 1.1 THEN x * 2.3 ELSE x * 2.3 - floor((x * 2.3 + 0.8) / 1.9) * 1.9 END")
per_sample("b5_bounce", lambda x: S.clip(x * 2.3, "bounce"),
           "CASE WHEN x * 2.3 BETWEEN -1 AND 1 THEN x * 2.3 ELSE -1 + least((x * 2.3 + 1) - floor((x * 2.3 + 1) / 4) * 4, 4 - ((x * 2.3 + 1) - floor((x * 2.3 + 1) / 4) * 4)) END")
for how, sql in {"round": "floor(x * 128 + 0.5)", "floor": "floor(x * 128)", "ceil": "ceil(x * 128)", "trunc": "trunc(x * 128)"}.items():
    per_sample(f"b6_quantize_{how}", lambda x, how=how: S.quantize(x, 8, how), f"{sql} / 128")
HALF = "pow(2e0, greatest(-14e0, floor(log2(CASE WHEN x = 0 THEN 1 ELSE abs(x) END))) - 10)"
on_sig("b7_quantize_half", effects.quantize_half, pick(f"sign(x) * round_even(abs(x) / {HALF}, 0) * {HALF}"))
per_sample("b8_mulaw", lambda x: S.quantize_mulaw(x),
           "sign(floor(sign(x) * ln(1 + 255 * abs(x)) / ln(256.0) * 128 + 0.5)) * (pow(256.0, abs(floor(sign(x) * ln(1 + 255 * abs(x)) / ln(256.0) * 128 + 0.5) / 128)) - 1) / 255")
for how, sql in {
    "sqrt": "sign(x) * sqrt(abs(x))", "cbrt": "cbrt(x)", "square": "sign(x) * x * x",
    "step8": "CASE WHEN x = 0 THEN 0.0 WHEN floor(8 * abs(x)) = 0 THEN sign(x) ELSE x / (floor(8 * abs(x)) / 8) END",
    "selfpow": "CASE WHEN x = 0 THEN 0.0 ELSE sign(x) * pow(abs(x), abs(x)) END", "sin": "sin(x * (pi() / 2))",
}.items():
    per_sample(f"b9_distort_{how}", lambda x, how=how: S.distort(x, 70, how), f"x + ({sql} - x) * 0.7")
on_sig("b10_slope_sign", lambda df: effects.distort(df, 70, "slope_sign"), pick("x + (sign(x - lag(x, 1, 0.0) OVER (PARTITION BY clip_id ORDER BY idx)) - x) * 0.7"))
for easing, sql in {"linear": "t", "ease_in": "1 - cos(t * (pi() / 2))", "ease_out": "sin(t * (pi() / 2))", "cubic": "t * t * (3 - 2 * t)"}.items():
    on_sig(f"b11_fade_{easing}", lambda df, e=easing: effects.fade(df, "out", e, 0.1234567, 0.9123457), pick(f"x * (0.9123457 - 0.788889 * ({sql}))", "t", "t AS (SELECT *, idx / n AS t FROM sig JOIN len USING (clip_id))"))
on_sig("b11_fade_in", lambda df: effects.fade(df, "in", "linear", 0.0, 0.987654321), pick("x * (0.987654321 * (idx / n))", "sig JOIN len USING (clip_id)"))
MS = f"{V.LR}, m AS (SELECT clip_id, 0 AS channel, idx, {{a}} AS x FROM lr UNION ALL SELECT clip_id, 1, idx, {{b}} FROM lr)"
on_sig("b12_mid_side", effects.mid_side, pick("x", "m", MS.format(a="(l + r) / 2", b="(l - r) / 2")), V.sig_stereo)
on_sig("b12_mid_side_inverse", effects.mid_side_inverse, pick("x", "m", MS.format(a="l + r", b="l - r")), V.sig_stereo)
on_sig("b13_stereo_widen", lambda df: effects.stereo_widen(df, 1.6), pick("x", "m", MS.format(a="(l + r) / 2 + (l - r) / 2 * 1.6", b="(l + r) / 2 - (l - r) / 2 * 1.6")), V.sig_stereo)

# -- C: positions ------------------------------------------------------------------------------------------------------------
W = "OVER (PARTITION BY clip_id ORDER BY idx)"
on_sig("c1_reverse", effects.reverse, pick("x", "sig JOIN len USING (clip_id)", idx="n - 1 - idx"))
on_sig("c2_repeat", lambda df: effects.repeat(df, 2.5), pick("x", "r", "r AS (SELECT clip_id, channel, k * n + idx AS idx, x, n FROM sig JOIN len USING (clip_id), range(0, 4) t(k) WHERE k * n + idx < trunc(n * 2.5))"))
for at in ("start", "end"):
    on_sig(f"c3_pad_silence_{at}", lambda df, at=at: effects.pad_silence(df, 0.001, 8000, at), pick(
        "x", "p", f"p AS (SELECT clip_id, channel, idx{' + 8' if at == 'start' else ''} AS idx, x FROM sig UNION ALL SELECT clip_id, 0, k{'' if at == 'start' else ' + n'}, 0.0 FROM len, range(0, 8) t(k))"))
GRID = """g AS (SELECT clip_id, 0 AS channel, n, CAST(floor(n / {s} + 0.5) AS BIGINT) AS m, unnest(range(0, CAST(floor(n / {s} + 0.5) AS BIGINT))) AS j FROM len),
o AS (SELECT g.clip_id, g.channel, j AS idx, CASE WHEN j = m - 1 THEN 0.0 ELSE {v} END AS x FROM g
 JOIN sig a ON a.clip_id = g.clip_id AND a.idx = least(n - 1, CAST(floor(j * {s}) AS BIGINT)) JOIN sig b ON b.clip_id = g.clip_id AND b.idx = least(n - 1, CAST(floor(j * {s}) AS BIGINT) + 1))"""
on_sig("c4_speed_nearest", lambda df: effects.speed(df, 1.5), pick("x", "o", GRID.format(s="1.5", v="a.x")))
on_sig("c4_speed_smooth", lambda df: effects.speed(df, 0.75, True), pick("x", "o", GRID.format(s="0.75", v="a.x + (b.x - a.x) * (j * 0.75 - a.idx)")))
on_sig("c4_speed_whole", lambda df: effects.speed(df, 2, True), pick("x", "o", GRID.format(s="2.0", v="a.x")))
add("c5_resample", lambda s, d: samples(effects.resample(V.sig(s, d), clips(s, d), 8000, 16000, True)[0]), pick("x", "o", GRID.format(s="0.5", v="a.x + (b.x - a.x) * (j * 0.5 - a.idx)")))
add("c5_resample_clips", lambda s, d: effects.resample(V.sig(s, d), clips(s, d), 8000, 11025, True)[1].select("clip_id", "sample_rate", F.col("n_samples").cast("long").alias("n_samples")),
    f"WITH {V.SIG} SELECT clip_id, 11025 AS sample_rate, CAST(floor(n * (11025 / 8000) + 0.5) AS BIGINT) AS n_samples FROM len")
on_sig("c6_hold", lambda df: effects.hold(df, 5), pick("first_value(x) OVER (PARTITION BY clip_id, idx // 5 ORDER BY idx)"))
ANCHOR = """q AS (SELECT s.*, a.x AS a, b.x AS b, z.x AS z FROM sig s JOIN len USING (clip_id) JOIN sig a ON a.clip_id = s.clip_id AND a.idx = s.idx // 8 * 8
 LEFT JOIN sig b ON b.clip_id = s.clip_id AND b.idx = s.idx // 8 * 8 + 8 JOIN sig z ON z.clip_id = s.clip_id AND z.idx = n - 1)"""
on_sig("c7_smooth_linear", lambda df: effects.smooth_linear(df, 7), pick("a + (coalesce(b, 0.0) - a) * ((idx % 7) / 7)", "q", ANCHOR.replace("8", "7")))
on_sig("c8_smooth_ease", lambda df: effects.smooth_ease(df, 8), pick("a + (coalesce(b, z) - a) * (1 - cos((idx % 8) / 8 * pi())) / 2", "q", ANCHOR))
ECHO = " + ".join(["x", *[f"0.6 * pow(0.5, {k - 1}) * lag(x, {k * 4}, 0.0) {W}" for k in (1, 2, 3)]])
on_sig("c9_echo", lambda df: effects.echo(df, 0.6, 3, 0.0005, 0.5, 8000), pick(ECHO))
on_sig("c9_echo_far", lambda df: effects.echo(df, 0.6, 3, 0.0005, 0.5, 8000, near=8), pick(ECHO))
CHORUS = """d AS (SELECT *, idx - (sin(pi() / 2 + idx * (2 * pi() * 40.0 / 8000)) * 0.5 + 0.5) * (0.001 * 8000) AS p FROM sig),
o AS (SELECT d.clip_id, d.channel, d.idx, d.x + 0.7 * CASE WHEN p < 0 THEN 0.0 ELSE coalesce(a.x, 0.0) + (coalesce(b.x, a.x, 0.0) - coalesce(a.x, 0.0)) * (p - floor(p)) END AS x
 FROM d LEFT JOIN sig a ON a.clip_id = d.clip_id AND a.idx = CAST(floor(p) AS BIGINT) LEFT JOIN sig b ON b.clip_id = d.clip_id AND b.idx = CAST(floor(p) AS BIGINT) + 1)"""
on_sig("c10_chorus", lambda df: effects.chorus(df, 0.7, 40.0, 0.001, 8000), pick("x", "o", CHORUS))
on_sig("c11_difference", lambda df: effects.difference(df, 80), pick(f"coalesce(x - lag(x) {W} * 0.8, 0.0)"))


def points(df: DataFrame) -> DataFrame:
    return df.where("idx % 16 = 0").select("clip_id", F.col("idx").alias("pos"), (F.col("x") * 100 + 250).alias("freq"))


ASOF = """a AS (SELECT s.clip_id, s.channel, s.idx, s.idx // 16 * 16 AS p, s.idx // 16 * 16 + 16 AS q FROM sig s),
o AS (SELECT a.clip_id, a.channel, a.idx, l.x * 100 + 250 + (coalesce(r.x, l.x) - l.x) * 100 * (a.idx - p) / 16 AS x FROM a
 JOIN sig l ON l.clip_id = a.clip_id AND l.idx = p LEFT JOIN sig r ON r.clip_id = a.clip_id AND r.idx = q)"""
on_sig("c12_asof_points", lambda df: effects.asof_points(df, points(df)).withColumn("x", F.col("freq")), pick("x", "o", ASOF))
on_sig("c13_local_peaks", effects.local_peaks, pick("x", f"(SELECT *, lag(x) {W} AS p, lead(x) {W} AS q FROM sig JOIN len USING (clip_id)) WHERE idx BETWEEN 1 AND n - 3 AND x > p AND x > q"))

# -- D: levels -----------------------------------------------------------------------------------------------------------------
on_sig("d1_normalize", levels.normalize, pick("x * (0.9 / m)", "sig JOIN (SELECT clip_id, max(abs(x)) AS m FROM sig GROUP BY clip_id) USING (clip_id)"))
LEVEL = f"""c AS (SELECT clip_id, idx // {{z}} AS chunk, CASE WHEN count(*) < {{z}} THEN 2.0 WHEN sum(abs(x)) = 0 THEN 1.0 ELSE sum(abs(x)) / ({{z}} / 4) END AS raw FROM sig GROUP BY ALL),
v AS (SELECT clip_id, chunk, CASE WHEN lead(raw) OVER w > raw THEN (raw + lead(raw) OVER w) / 2 ELSE raw END AS level FROM c WINDOW w AS (PARTITION BY clip_id ORDER BY chunk))"""
add("d2_chunk_level", lambda s, d: levels.chunk_level(V.sig_long(s, d)).select("clip_id", "chunk", r6("level")),
    f"WITH {V.LONG}, {LEVEL.format(z=512)} SELECT clip_id, chunk, round(level, 6) + 0.0 AS level FROM v")
on_sig("d3_dynamic_normalize", lambda df: levels.dynamic_normalize(df), pick(
    "x / (v.level + (coalesce(w.level, 2.0) - v.level) * (idx % 512) / 512)",
    "(SELECT *, idx // 512 AS chunk FROM sig) JOIN v USING (clip_id, chunk) LEFT JOIN (SELECT clip_id, chunk - 1 AS chunk, level FROM v) w USING (clip_id, chunk)", LEVEL.format(z=512), V.LONG), V.sig_long)
EDGE = """e AS (SELECT clip_id, n, (SELECT 1) AS one FROM len),
f AS (SELECT sig.clip_id, n, max(x) FILTER (WHERE idx = 0) AS fx, max(x) FILTER (WHERE idx = n - 1) AS lx FROM sig JOIN len USING (clip_id) GROUP BY sig.clip_id, n),
h AS (SELECT sig.clip_id, f.n, min(idx) FILTER (WHERE abs(x - fx) {op} {t}) AS a, max(idx) FILTER (WHERE abs(x - lx) {op} {t}) AS b FROM sig JOIN f USING (clip_id) GROUP BY sig.clip_id, f.n),
k AS (SELECT clip_id, {s} AS s, {e} AS e FROM h)"""


def edge_sql(op: str, t: float, where: str) -> str:
    s = "coalesce(a, 0)" if where in ("start", "both") else "0"
    e = "coalesce(b, 0)" if where in ("end", "both") else "n - 1"
    s = f"least({s}, {e})" if where == "both" else s
    return pick("x", "sig JOIN k USING (clip_id) WHERE idx BETWEEN s AND e", EDGE.format(op=op, t=t, s=s, e=e), idx="idx - s")


for where in ("start", "end", "both"):
    on_sig(f"d4_trim_{where}", lambda df, w=where: levels.trim_silence(df, w, 0.305), edge_sql(">", 0.305, where))
    on_sig(f"d7_keep_{where}", lambda df, w=where: levels.keep_silence(df, w, 0.055), edge_sql("<=", 0.055, where))
def runs_sql(near: str, ctes: str, values: list[str], base: str) -> str:
    """Anchor and count along the clip, one position a step; `near` compares r.a_<value> with s.<value>."""
    anchors = ", ".join(f"{v} AS a_{v}" for v in values)
    moved = ", ".join(f"CASE WHEN {near} THEN r.a_{v} ELSE s.{v} END" for v in values)
    columns, own = ", ".join(values), ", ".join(f"s.{v}" for v in values)
    return f"""{ctes}, rec AS (SELECT clip_id, idx, {columns}, {anchors}, CASE WHEN {near.replace('r.a_', 's.')} THEN 1 ELSE 0 END AS c, true AS stay, false AS ended FROM {base} s WHERE idx = 0
 UNION ALL SELECT s.clip_id, s.idx, {own}, {moved}, CASE WHEN NOT ({near}) THEN 0 WHEN r.c >= 128 THEN r.c ELSE r.c + 1 END, NOT (r.c >= 128 AND ({near})), r.c >= 128 AND NOT ({near})
 FROM rec r JOIN {base} s ON s.clip_id = r.clip_id AND s.idx = r.idx + 1),
k AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY idx) - 1 AS idx, {columns} FROM rec JOIN len USING (clip_id) WHERE stay AND NOT (ended AND idx = n - 1))"""


FLAT_PART = "fl AS (SELECT clip_id, idx, CASE WHEN idx % 1000 < 400 THEN 0.1 ELSE x END AS x FROM sig)"


def flattened(df: DataFrame) -> DataFrame:
    return effects.put(df, F.when(F.col("idx") % 1000 < 400, F.lit(0.1)).otherwise(F.col("x")))


for name, fn, inverse in (("d5_trim_all", levels.trim_silence, ""), ("d8_keep_all", levels.keep_silence, "NOT ")):
    on_sig(name, lambda df, f=fn: f(flattened(df), "all", 0.01), pick("x", "k", runs_sql(f"{inverse}(abs(r.a_x - s.x) <= 0.01)", FLAT_PART, ["x"], "fl"), V.LONG, channel="0"), V.sig_long)
TWO = f"{V.LR}, f AS (SELECT lr.clip_id, n, max(l) FILTER (WHERE idx = 0) AS fl, max(r) FILTER (WHERE idx = 0) AS fr, max(l) FILTER (WHERE idx = n - 1) AS ll, max(r) FILTER (WHERE idx = n - 1) AS rr FROM lr JOIN len USING (clip_id) GROUP BY lr.clip_id, n), " \
      "h AS (SELECT lr.clip_id, min(idx) FILTER (WHERE abs(l - fl) > 0.305 AND abs(r - fr) > 0.305) AS a, max(idx) FILTER (WHERE abs(l - ll) > 0.305 AND abs(r - rr) > 0.305) AS b FROM lr JOIN f USING (clip_id) GROUP BY lr.clip_id), " \
      f"k AS (SELECT clip_id, least(coalesce(a, 0), coalesce(b, 0)) AS s, coalesce(b, 0) AS e FROM h), {V.STEREO}"
on_sig("d6_trim_stereo", lambda df: levels.trim_silence_stereo(df, "both", 0.305), pick("x", "st JOIN k USING (clip_id) WHERE idx BETWEEN s AND e", TWO, idx="idx - s"), V.sig_stereo)
for name, near, inverse in (("d6_trim_stereo_all", False, ""), ("d8_keep_stereo_all", True, "NOT ")):
    on_sig(name, lambda df, n=near: levels.trim_silence_stereo(V.stereo(flattened(df)), "all", 0.01, near=n),
           pick("x", "(SELECT clip_id, 0 AS channel, idx, l AS x FROM k UNION ALL SELECT clip_id, 1, idx, r FROM k)",
                runs_sql(f"{inverse}(abs(r.a_l - s.l) <= 0.01 AND abs(r.a_r - s.r) <= 0.01)", f"{FLAT_PART}, {V.LR.replace('FROM sig', 'FROM fl')}", ["l", "r"], "lr"), V.LONG), V.sig_long)
FIRST = f"{V.U8}, g AS (SELECT data, min((clip_id, frame_no)) AS first FROM u8 GROUP BY data), dict AS (SELECT data, row_number() OVER (ORDER BY first) - 1 AS dict_id FROM g)"
add("d9_frame_dedup", lambda s, d: levels.frame_dedup(V.frames64_u8(s, d))[1], f"WITH {FIRST} SELECT clip_id, frame_no, dict_id FROM u8 JOIN dict USING (data)")
FINGERPRINT = "lower(to_hex(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(data, lambda v: CAST(v AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296)))"
add("d10_fingerprint", lambda s, d: levels.fingerprint(V.frames64_u8(s, d)).select("clip_id", "frame_no", "fingerprint"),
    f"WITH {V.U8} SELECT clip_id, frame_no, {FINGERPRINT} AS fingerprint FROM u8")
add("d11_dedup_stats", lambda s, d: levels.dedup_stats(V.frames64_u8(s, d)).select("clip_id", "n_unique", "n_frames", "bytes", r6("ratio")),
    f"WITH {V.U8} SELECT clip_id, count(DISTINCT data) AS n_unique, count(*) AS n_frames, 16 + 64 * count(DISTINCT data) + 2 * count(*) AS bytes, round((16 + 64 * count(DISTINCT data) + 2 * count(*)) / (64 * count(*)), 6) + 0.0 AS ratio FROM u8 GROUP BY clip_id")
G4 = """u AS (SELECT *, CAST(floor((greatest(-1.0, least(1.0, x)) + 1) * 127.5 + 0.5) AS BIGINT) & 255 AS u FROM sig),
g AS (SELECT clip_id, idx // 4 AS g, max(u) FILTER (WHERE idx % 4 = 0) AS u0, max(u) FILTER (WHERE idx % 4 = 1) AS u1, max(u) FILTER (WHERE idx % 4 = 2) AS u2, max(u) FILTER (WHERE idx % 4 = 3) AS u3 FROM u GROUP BY ALL),
e AS (SELECT clip_id, g, CAST(coalesce(least(floor((u0 + u1 + u2 + u3) / 16 + 0.5), 63) + CASE WHEN abs(u0 - u1) > abs(u1 - u2) AND abs(u0 - u1) > abs(u2 - u3) THEN 64
 WHEN abs(u1 - u2) > abs(u0 - u1) AND abs(u1 - u2) > abs(u2 - u3) THEN 128 WHEN abs(u2 - u3) > abs(u0 - u1) AND abs(u2 - u3) > abs(u1 - u2) THEN 192 ELSE 0 END, 0) AS INTEGER) AS byte FROM g)"""


def coded(s, d) -> DataFrame:
    return V.sig(s, d).withColumn("u", S.to_u8_round(S.clip(F.col("x"), "clamp")))


add("d12_group4_encode", lambda s, d: levels.group4_encode(coded(s, d)).select("clip_id", "g", "byte"), f"WITH {V.SIG}, {G4} SELECT clip_id, g, byte FROM e")
add("d13_group4_decode", lambda s, d: levels.group4_decode(levels.group4_encode(coded(s, d))).select("clip_id", "idx", F.col("u").cast("int").alias("u")),
    f"""WITH {V.SIG}, {G4}, p AS (SELECT clip_id, g, byte // 64 AS f, (byte % 64) * 4 AS a, greatest(4.0, (byte % 64) * 4 * 0.1) / 2 AS h FROM e)
    SELECT clip_id, g * 4 + k AS idx, CAST(least(255, greatest(0, floor(a + CASE WHEN f = k + 1 THEN -h WHEN f = k AND f > 0 THEN h ELSE 0 END + 0.5))) AS INTEGER) AS u FROM p, range(0, 4) t(k)""")


def rebuilt(s, d) -> DataFrame:
    table, refs = levels.frame_dedup(V.frames64_u8(s, d))
    return levels.undictionary(refs, table).select("clip_id", "idx", F.col("x").cast("int").alias("x"))


add("d14_undictionary", rebuilt, f"WITH {V.U8} SELECT clip_id, frame_no * 64 + k AS idx, CAST(data[k + 1] AS INTEGER) AS x FROM u8, range(0, 64) t(k)")

# -- E: feedback -----------------------------------------------------------------------------------------------------------------


def recursive(name: str, fn, start: str, step: str, out: str = "y", state: str = "y", lag: int = 1) -> None:
    """SQL by a recursive query over positions; start and step give the state columns."""
    ctes = f"rec AS (SELECT clip_id, channel, idx, x, {start} FROM sig WHERE idx < {lag} UNION ALL SELECT s.clip_id, s.channel, s.idx, s.x, {step} FROM rec r JOIN sig s ON s.clip_id = r.clip_id AND s.idx = r.idx + {lag})"
    on_sig(name, fn, pick(out, "rec", ctes))


recursive("e1_ema_first", lambda df: filters.ema(df, 31.415927, chunk=16), "x AS y", "r.y + (s.x - r.y) * 0.31415927")
recursive("e1_ema_zero", lambda df: filters.ema(df, 31.415927, "zero", chunk=16), "x * 0.31415927 AS y", "r.y + (s.x - r.y) * 0.31415927")
recursive("e2_echo_infinite", lambda df: filters.echo_infinite(df, 0.6, 0.001, 8000, chunk=4), "x AS y", "s.x + 0.6 * r.y", lag=8)
recursive("e3_comb_low", lambda df: filters.comb(df, 0.5123457, 4, "low", chunk=4), "x AS y", "s.x + 0.5123457 * r.y", lag=4)
recursive("e3_comb_high", lambda df: filters.comb(df, 0.5123457, 3, "high", chunk=4), "x AS y", "s.x - 0.5123457 * r.y", lag=3)
recursive("e4_alternating_difference", effects.alternating_difference, "x AS y", "s.x - r.y")
recursive("e5_leaky_difference_own", lambda df: filters.leaky_difference(df, -100, 0.41234567, chunk=16), "0e0 AS acc, x AS y", "r.acc + (r.y - r.acc) * 0.41234567, s.x - (r.acc + (r.y - r.acc) * 0.41234567)")
recursive("e5_leaky_difference", lambda df: filters.leaky_difference(df, 90, 0.41234567, chunk=16), "0e0 AS acc, 0e0 AS y", "r.acc + (r.x - r.acc) * 0.41234567, s.x - 0.9 * (r.acc + (r.x - r.acc) * 0.41234567)")


#: Second-order filters in SQL: b0, b1, b2, a0, a1, a2 from c = cos w, s = sin w, al = s / 2q, g = 10^(dB / 40), k = tan(w / 2).
ROOT = "2 * sqrt(g) * al"
FORMS = {
    "low": "(1 - c) / 2, 1 - c, (1 - c) / 2, 1 + al, -2 * c, 1 - al",
    "high": "(1 + c) / 2, -(1 + c), (1 + c) / 2, 1 + al, -2 * c, 1 - al",
    "bandpass": "al, 0e0, -al, 1 + al, -2 * c, 1 - al",
    "peak": "1 + al * g, -2 * c, 1 - al * g, 1 + al / g, -2 * c, 1 - al / g",
    "notch": "1e0, -2 * c, 1e0, 1e0, -2 * 0.95 * c, 0.95 * 0.95",
    "lowshelf": f"g * (g + 1 - (g - 1) * c + {ROOT}), 2 * g * (g - 1 - (g + 1) * c), g * (g + 1 - (g - 1) * c - {ROOT}), g + 1 + (g - 1) * c + {ROOT}, -2 * (g - 1 + (g + 1) * c), g + 1 + (g - 1) * c - {ROOT}",
    "highshelf": f"g * (g + 1 + (g - 1) * c + {ROOT}), -2 * g * (g - 1 + (g + 1) * c), g * (g + 1 + (g - 1) * c - {ROOT}), g + 1 - (g - 1) * c + {ROOT}, 2 * (g - 1 - (g + 1) * c), g + 1 - (g - 1) * c - {ROOT}",
    "allpass": "1 - al, -2 * c, 1 + al, 1 + al, -2 * c, 1 - al",
    "butter_low": "k * k, 2 * k * k, k * k, 1 + sqrt(2) * k + k * k, 2 * (k * k - 1), 1 - sqrt(2) * k + k * k",
    "butter_high": "1e0, -2e0, 1e0, 1 + sqrt(2) * k + k * k, 2 * (k * k - 1), 1 - sqrt(2) * k + k * k",
}


def form_sql(kind: str, source: str, w: str, q: str, keep: str = "", gain_db: float = 0.0) -> str:
    """Normalized coefficients for each row of `source`; w and q are expressions over it."""
    names = [f"{v} AS {n}" for n, v in zip(("n0", "n1", "n2", "d0", "d1", "d2"), FORMS[kind].split(", "), strict=True)]
    trig = f"(SELECT *, cos(w) AS c, sin(w) AS s, sin(w) / (2 * q) AS al, pow(10e0, {gain_db} / 40) AS g, tan(w / 2) AS k FROM (SELECT *, {w} AS w, {q} AS q FROM {source}))"
    return f"SELECT {keep}n0 / d0 AS b0, n1 / d0 AS b1, n2 / d0 AS b2, d1 / d0 AS a1, d2 / d0 AS a2 FROM (SELECT *, {', '.join(names)} FROM {trig})"


FIXED = "(SELECT 1 AS one)"


def biquad_rec(name: str, kind: str, q: float = 0.8, chunk: int = filters.CHUNK, **options) -> None:
    co = f"co AS ({form_sql(kind, FIXED, '2 * pi() * 700 / 8000', str(q), gain_db=options.get('gain_db', 0.0))})"
    start = "b0 * x AS y, 0e0 AS x1, 0e0 AS y1"
    step = "co.b0 * s.x + co.b1 * r.x + co.b2 * r.x1 - co.a1 * r.y - co.a2 * r.y1, r.x, r.y"
    ctes = f"{co}, rec AS (SELECT clip_id, channel, idx, x, {start} FROM sig, co WHERE idx = 0 UNION ALL SELECT s.clip_id, s.channel, s.idx, s.x, {step} FROM rec r JOIN sig s ON s.clip_id = r.clip_id AND s.idx = r.idx + 1, co)"
    on_sig(name, lambda df: filters.biquad(df, kind, 700.0, q, 8000, chunk=chunk, **options), pick("y", "rec", ctes))


for kind in ("low", "high", "bandpass"):
    biquad_rec(f"e7_{kind}", kind)
biquad_rec("e6_biquad", "low", 0.7, chunk=16, form="df2t")
def by_clip(df: DataFrame) -> DataFrame:
    """A sample rate and a quality of its own for each clip."""
    return df.select("clip_id").distinct().select("clip_id", (8000 + F.col("clip_id") % 5 * 1000).alias("sample_rate"), (0.5 + F.col("clip_id") % 3 * 0.2).alias("q"))


on_sig("e6_biquad_by_clip", lambda df: filters.biquad(df, "low", 700.0, 0.7, by_clip(df), chunk=16), pick("y", "rec", f"""co AS ({form_sql("low", "(SELECT clip_id, 8000 + clip_id % 5 * 1000 AS rate, 0.5e0 + clip_id % 3 * 0.2e0 AS q0 FROM len)", "2 * pi() * 700 / rate", "q0", keep="clip_id, ")}),
rec AS (SELECT sig.clip_id, channel, idx, x, b0 * x AS y, 0e0 AS x1, 0e0 AS y1 FROM sig JOIN co ON co.clip_id = sig.clip_id WHERE idx = 0
 UNION ALL SELECT s.clip_id, s.channel, s.idx, s.x, co.b0 * s.x + co.b1 * r.x + co.b2 * r.x1 - co.a1 * r.y - co.a2 * r.y1, r.x, r.y FROM rec r JOIN sig s ON s.clip_id = r.clip_id AND s.idx = r.idx + 1 JOIN co ON co.clip_id = s.clip_id)"""))
for kind in ("peak", "notch"):
    biquad_rec(f"e8_{kind}", kind, gain_db=6.0)
for kind in ("lowshelf", "highshelf"):
    biquad_rec(f"e9_{kind}", kind, gain_db=6.0)
biquad_rec("e10_allpass", "allpass")
for kind in ("butter_low", "butter_high"):
    biquad_rec(f"e11_{kind}", kind)
biquad_rec("e12_forms", "low", 0.8, form="df1t")
REC = f"""co AS ({form_sql("low", FIXED, "2 * pi() * 700 / 8000", "0.8")}),
rec AS (SELECT clip_id, channel, idx, x, {{x0}} AS fed, b0 * {{x0}} AS y, 0e0 AS x1, 0e0 AS y1 FROM sig, co WHERE idx = 0
 UNION ALL SELECT s.clip_id, s.channel, s.idx, s.x, s.x, co.b0 * s.x + co.b1 * r.fed + co.b2 * r.x1 - co.a1 * r.y - co.a2 * r.y1, r.fed, r.y FROM rec r JOIN sig s ON s.clip_id = r.clip_id AND s.idx = r.idx + 1, co)"""
on_sig("e13_crossfade", lambda df: filters.biquad(df, "low", 700.0, 0.8, 8000, crossfade=True, chunk=16),
       pick("x + (y - x) * least(idx / 32, (n - 1 - idx) / 32, 1.0)", "rec JOIN len USING (clip_id)", REC.format(x0="0e0")))
on_sig("e14_biquad_mix", lambda df: filters.biquad_mix(df, "low", 700.0, 0.8, 8000, 0.4, 0.7, chunk=16), pick("0.4 * x + 0.7 * y", "rec", REC.format(x0="x")))
def varying(kind: str, source: str, w: str, q: str) -> str:
    """co: coefficients of each sample; rec: the transposed form over them."""
    return f"""co AS ({form_sql(kind, source, w, q, "clip_id, channel, idx, x, ")}),
rec AS (SELECT clip_id, channel, idx, x, b0 * x AS y, b1 * x - a1 * (b0 * x) AS s1, b2 * x - a2 * (b0 * x) AS s2 FROM co WHERE idx = 0
 UNION ALL SELECT c.clip_id, c.channel, c.idx, c.x, c.b0 * c.x + r.s1, c.b1 * c.x - c.a1 * (c.b0 * c.x + r.s1) + r.s2, c.b2 * c.x - c.a2 * (c.b0 * c.x + r.s1)
 FROM rec r JOIN co c ON c.clip_id = r.clip_id AND c.idx = r.idx + 1)"""


on_sig("e15_biquad_sweep", lambda df: filters.biquad_sweep(df, "low", 300.0, 1500.0, 0.7, 1.2, 0.2, 0.4, 0.8, 0.6, 8000, chunk=16),
       pick("(0.2 + 0.2 * idx / n) * x + (0.8 - 0.2 * idx / n) * y", "rec JOIN len USING (clip_id)",
            varying("low", "(SELECT * FROM sig JOIN len USING (clip_id))", "2 * pi() * (300 + 1200 * idx / n) / 8000", "0.7 + 0.5 * idx / n")))
for kind in ("low", "high"):
    on_sig(f"e16_biquad_automation{'' if kind == 'low' else '_' + kind}", lambda df, k=kind: filters.biquad_automation(df, points(df), k, 0.8, 8000, chunk=16),
           pick("y", "rec", ASOF + ", f AS (SELECT o.clip_id, o.channel, o.idx, sig.x, o.x AS freq FROM o JOIN sig ON sig.clip_id = o.clip_id AND sig.idx = o.idx), " + varying(kind, "f", "2 * pi() * freq / 8000", "0.8")))
PRED = f"""a AS (SELECT *, lead(x, 2, 0.0) {W} AS x2 FROM sig),
rec AS (SELECT clip_id, idx, x, 0e0 AS before, 0.5 * x2 AS p FROM a WHERE idx = 0 UNION ALL SELECT a.clip_id, a.idx, a.x, r.p, r.p + 0.5 * (a.x2 - r.p) FROM rec r JOIN a ON a.clip_id = r.clip_id AND a.idx = r.idx + 1),
b AS (SELECT clip_id, idx, p, x - before AS diff FROM rec), c AS (SELECT *, lag(diff, 1, 0.0) {W} AS last FROM b)"""
add("e17_delta_predict", lambda s, d: filters.delta_predict(V.sig(s, d), chunk=16).select("clip_id", "idx", F.col("byte").cast("long").alias("byte")),
    f"WITH RECURSIVE {V.SIG}, {PRED} SELECT clip_id, idx, (CAST(greatest(0, least(3, 3 - floor(abs(diff - last) * 3 + 0.5))) AS BIGINT) | (CAST(trunc((p + 1) * 31) AS BIGINT) * 4)) & 255 AS byte FROM c")

# -- F: in order ---------------------------------------------------------------------------------------------------------------------
recursive("f1_smooth_adaptive", lambda df: filters.smooth_adaptive(effects.gain(df, 0.1), 61.2345), "x * 0.1 AS y", "s.x * 0.1 + (r.y - s.x * 0.1) * 0.612345 * pow(1 - abs(s.x * 0.1 - r.y), 2)")
add("f2_delta_encode", lambda s, d: filters.delta_encode(V.sig(s, d)).select("clip_id", "idx", "code"),
    f"""WITH RECURSIVE {V.SIG}, v AS (SELECT clip_id, idx, CAST(floor(x * 127 + 0.5) AS BIGINT) AS v FROM sig),
    rec AS (SELECT clip_id, idx, greatest(-128, least(127, v)) AS code, greatest(-128, least(127, v)) AS p FROM v WHERE idx = 0
    UNION ALL SELECT v.clip_id, v.idx, greatest(-128, least(127, v.v - r.p)), r.p + greatest(-128, least(127, v.v - r.p)) FROM rec r JOIN v ON v.clip_id = r.clip_id AND v.idx = r.idx + 1)
    SELECT clip_id, idx, CAST(code AS BIGINT) AS code FROM rec""")
ONE_BIT = """rec AS (SELECT clip_id, idx, CASE WHEN 0 > v THEN 1 ELSE 0 END AS bit, CASE WHEN 0 > v THEN 1 ELSE -1 END AS c FROM v WHERE idx = 0
    UNION ALL SELECT v.clip_id, v.idx, CASE WHEN r.c > v.v THEN 1 ELSE 0 END, r.c + CASE WHEN r.c > v.v THEN 1 ELSE -1 END FROM rec r JOIN v ON v.clip_id = r.clip_id AND v.idx = r.idx + 1)
    SELECT clip_id, idx // 8 AS b, CAST(sum(bit << CAST(idx % 8 AS INTEGER)) AS BIGINT) AS byte FROM rec GROUP BY ALL"""


def one_bit(df: DataFrame, stereo: bool = False) -> DataFrame:
    return filters.delta_1bit(df, stereo).select("clip_id", F.col("b").cast("long").alias("b"), F.col("byte").cast("long").alias("byte"))


add("f3_delta_1bit", lambda s, d: one_bit(V.sig(s, d)), f"WITH RECURSIVE {V.SIG}, v AS (SELECT clip_id, idx, CAST(floor((x + 1) * 8 + 0.5) AS BIGINT) AS v FROM sig), {ONE_BIT}")
add("f3_delta_1bit_stereo", lambda s, d: one_bit(V.sig_stereo(s, d), True),
    f"WITH RECURSIVE {V.SIG}, {V.LR}, {V.STEREO}, v AS (SELECT clip_id, idx * 2 + channel AS idx, CAST(floor((x + 1) * 8 + 0.5) AS BIGINT) AS v FROM st), {ONE_BIT}")
# The code tables again, for the SQL side.
STEPS = {
    3: "[0, 1, 2, 3, 6, 10, 15, 21]",
    7: """[0, 8, 16, 32, 48, 64, 80, 96, 112, 128, 144, 160, 176, 192, 208, 224, 240, 256, 272, 288, 304, 320, 336, 352, 368, 384, 400, 416,
    432, 448, 464, 480, 496, 512, 520, 528, 536, 544, 552, 560, 568, 576, 584, 592, 600, 608, 616, 624, 632, 640, 648, 656, 664, 672,
    680, 688, 696, 704, 712, 720, 728, 736, 744, 752, 760, 768, 776, 784, 792, 800, 808, 816, 824, 832, 840, 848, 856, 864, 872, 880,
    888, 896, 904, 912, 920, 928, 936, 944, 952, 960, 968, 976, 984, 992, 1000, 1008, 1016, 1024, 1088, 1152, 1216, 1280, 1344, 1408,
    1472, 1536, 1600, 1664, 1728, 1792, 1856, 1920, 1984, 2048, 2304, 2560, 2816, 3072, 3328, 3584, 3840, 4096, 5120, 6144, 7168,
    8192, 12288, 16384]""",
}
for bits, old in ((3, False), (3, True), (7, False)):
    t, scale = STEPS[bits], {3: "127.0", 7: "32767.0"}[bits]
    ind = f"CASE WHEN d = 0 THEN 0 ELSE coalesce(list_position(list_transform({t}, lambda e: e > abs(d)), true) - 1, len({t}) - 1) END"
    sign = f"{2 ** (bits + 1) - 1} - ({ind})" if old else f"({ind}) + {2 ** bits}"
    add(f"f4_codebook_{bits}{'_old' if old else ''}", lambda s, d, b=bits, o=old: filters.delta_codebook(V.sig(s, d), b, old=o).select("clip_id", "idx", "code"),
        f"WITH {V.SIG}, p AS (SELECT clip_id, idx, (x + 1) * {scale} - lag((x + 1) * {scale}, 1, 0.0) {W} AS d FROM sig) SELECT clip_id, idx, CAST(CASE WHEN d < 0 THEN {sign} ELSE {ind} END AS BIGINT) AS code FROM p")

# -- G: encoders -----------------------------------------------------------------------------------------------------------------------
codes("g1_to_u8", S.to_u8, "CAST(trunc((x + 1) * 127.5) AS BIGINT) & 255")
codes("g1_to_u8_round", S.to_u8_round, "CAST(floor((x + 1) * 127.5 + 0.5) AS BIGINT) & 255")
per_sample("g1_from_u8", lambda x: S.from_u8(S.to_u8_round(x)), "(CAST(floor((x + 1) * 127.5 + 0.5) AS BIGINT) & 255) / 127.5 - 1")
codes("g2_to_i16", S.to_i16, "trunc(x * 32767)")
codes("g3_to_i12", S.to_i12, "floor(x * 2047 + 0.5)")
add("g3_pack_u12", lambda s, d: wav.pack_u12(V.sig(s, d).withColumn("x", S.clip(F.col("x"), "clamp"))).select("clip_id", "g", *[F.col(c).cast("long").alias(c) for c in ("b0", "b1", "b2")]),
    f"""WITH {V.SIG}, c AS (SELECT clip_id, idx, CAST(floor((greatest(-1.0, least(1.0, x)) + 1) * 2047.5 + 0.5) AS BIGINT) AS c FROM sig),
    g AS (SELECT clip_id, idx // 2 AS g, max(c) FILTER (WHERE idx % 2 = 0) AS a, coalesce(max(c) FILTER (WHERE idx % 2 = 1), 0) AS b FROM c GROUP BY ALL)
    SELECT clip_id, g, a % 256 AS b0, a // 256 + b % 16 * 16 AS b1, b // 16 AS b2 FROM g""")
codes("g4_to_i24", S.to_i24, "trunc(x * 8388607)")
codes("g4_to_i32", S.to_i32, "floor(x * 2147483647 + 0.5)")
MU = "least(abs(CAST(trunc(x * 32767) AS BIGINT)), 32635) + 132"
EXPO = f"CASE {' '.join(f'WHEN {MU} >= {1 << (k + 7)} THEN {k}' for k in range(7, 0, -1))} ELSE 0 END"
codes("g5_to_mulaw_byte", S.to_mulaw_byte, f"255 - (CASE WHEN trunc(x * 32767) < 0 THEN 128 ELSE 0 END + ({EXPO}) * 16 + (({MU}) >> (({EXPO}) + 3) & 15))")
AL = "least(abs(floor(floor(x * 65536 + 0.5) / 65536 * 4096 * 0.99975586)), 4095)"
SEG = f"CASE {' '.join(f'WHEN {AL} >= {32 << k} THEN {k + 1}' for k in range(6, -1, -1))} ELSE 0 END"
codes("g6_to_alaw_byte", S.to_alaw_byte,
      f"xor(CAST(CASE WHEN floor(floor(x * 65536 + 0.5) / 65536 * 4096 * 0.99975586) >= 0 THEN 128 ELSE 0 END + ({SEG}) * 16 + (CAST(floor({AL} / pow(2, greatest({SEG}, 1))) AS BIGINT) & 15) AS BIGINT), 85)")
per_sample("g7_to_alaw", S.to_alaw, "sign(x) * CASE WHEN abs(x) < 1 / 87.6 THEN 87.6 * abs(x) / (1 + ln(87.6)) ELSE (1 + ln(87.6 * abs(x))) / (1 + ln(87.6)) END")
per_sample("g8_to_float", lambda x: x.cast("float").cast("double"), "CAST(CAST(x AS FLOAT) AS DOUBLE)")
add("g9_interleave", lambda s, d: wav.interleave(V.sig_stereo(s, d), 2).select("clip_id", "pos", r6("x")), f"WITH {V.SIG}, {V.LR}, {V.STEREO} SELECT clip_id, idx * 2 + channel AS pos, round(x, 6) + 0.0 AS x FROM st")

# -- H: spectra ---------------------------------------------------------------------------------------------------------------------------


def framed(fn):
    def run(s, d) -> DataFrame:
        out = fn(V.frames64(s, d)).select("clip_id", "frame_no", F.posexplode("data").alias("k", "x"))
        return out.select("clip_id", "frame_no", F.col("k").cast("long").alias("k"), r6("x"))

    return run


FLAT = f"WITH {V.FRAMES}"
DFT = V.FRAMES + """, p AS (SELECT clip_id, frame_no, t, data[t + 1] AS x FROM fr, range(0, 64) r(t)),
b AS (SELECT clip_id, frame_no, k, sum(x * cos(2 * pi() * ((k * t) % 64) / 64)) AS re, -sum(x * sin(2 * pi() * ((k * t) % 64) / 64)) AS im FROM p, range(0, 64) q(k) GROUP BY ALL)"""
BACK = ", i AS (SELECT clip_id, frame_no, t AS k, sum(re * cos(2 * pi() * ((k * t) % 64) / 64) - im * sin(2 * pi() * ((k * t) % 64) / 64)) / 64 AS x FROM z, range(0, 64) r(t) GROUP BY ALL)"
OUT = " SELECT clip_id, frame_no, k, round(x, 6) + 0.0 AS x FROM i"


def spec_rows(s, d) -> DataFrame:
    f = spectral.spectrum(V.frames64(s, d)).select("clip_id", "frame_no", F.posexplode(F.arrays_zip("re", "im", "mag")).alias("k", "z"))
    return f.select("clip_id", "frame_no", F.col("k").cast("long").alias("k"), *[(F.round(F.col(f"z.{c}"), 6) + 0.0).alias(c) for c in ("re", "im", "mag")])


add("h1_spectrum", spec_rows, f"WITH {DFT} SELECT clip_id, frame_no, k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(sqrt(re * re + im * im), 6) + 0.0 AS mag FROM b")
add("h2_fft_roundtrip", framed(spectral.fft_roundtrip), f"{FLAT} SELECT clip_id, frame_no, k, round(data[k + 1], 6) + 0.0 AS x FROM fr, range(0, 64) t(k)")
add("h3_fft_morph", framed(spectral.fft_morph), f"""{FLAT}, e AS (SELECT clip_id, arg_min(data, frame_no) AS a, arg_max(data, frame_no) AS b, count(*) AS n FROM fr GROUP BY clip_id)
 SELECT clip_id, frame_no, k, round(a[k + 1] + (b[k + 1] - a[k + 1]) * (frame_no / n), 6) + 0.0 AS x FROM fr JOIN e USING (clip_id), range(0, 64) t(k)""")
add("h4_fft_quantize_mag", framed(lambda f: spectral.fft_quantize_mag(f, 7.3)), f"WITH {DFT}, z AS (SELECT clip_id, frame_no, k, re * floor(sqrt(re * re + im * im) * 7.3 + 0.5) / 7.3 / sqrt(re * re + im * im) AS re, im * floor(sqrt(re * re + im * im) * 7.3 + 0.5) / 7.3 / sqrt(re * re + im * im) AS im FROM b){BACK}{OUT}")
add("h5_fft_quantize_phase", framed(lambda f: spectral.fft_quantize_phase(f, 8)), f"""WITH {DFT}, m AS (SELECT *, sqrt(re * re + im * im) AS mag, floor(atan2(im, re) / (pi() / 4) + 0.5) * (pi() / 4) AS ph FROM b),
 z AS (SELECT clip_id, frame_no, k, mag * cos(ph) AS re, mag * sin(ph) AS im FROM m){BACK}{OUT}""")
add("h6_fft_smear", framed(lambda f: spectral.fft_smear(f, 2)), f"""WITH {DFT}, m AS (SELECT *, sqrt(re * re + im * im) AS mag FROM b),
 s AS (SELECT *, avg(mag) OVER (PARTITION BY clip_id, frame_no ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM m),
 z AS (SELECT clip_id, frame_no, k, re * sm / mag AS re, im * sm / mag AS im FROM s){BACK}{OUT}""")
add("h6_fft_smear_hann", framed(lambda f: spectral.fft_smear(f, 3, True)), f"""WITH {DFT}, m AS (SELECT *, sqrt(re * re + im * im) AS mag FROM b),
 s AS (SELECT a.clip_id, a.frame_no, a.k, any_value(a.re / a.mag) AS re, any_value(a.im / a.mag) AS im, sum(n.mag * (0.5 + 0.5 * cos(pi() * (n.k - a.k) / 3))) / sum(0.5 + 0.5 * cos(pi() * (n.k - a.k) / 3)) AS sm
  FROM m a JOIN m n ON n.clip_id = a.clip_id AND n.frame_no = a.frame_no AND n.k BETWEEN a.k - 3 AND a.k + 3 GROUP BY a.clip_id, a.frame_no, a.k),
 z AS (SELECT clip_id, frame_no, k, re * sm AS re, im * sm AS im FROM s){BACK}{OUT}""")
for direction, before in (("up", "n.k <= a.k"), ("down", "n.k >= a.k")):
    add(f"h7_fft_saturate{'' if direction == 'up' else '_down'}", framed(lambda f, d=direction: spectral.fft_saturate(f, 0.6, d)), f"""WITH {DFT}, m AS (SELECT *, sqrt(re * re + im * im) AS mag FROM b),
 s AS (SELECT a.clip_id, a.frame_no, a.k, any_value(a.re / a.mag) AS re, any_value(a.im / a.mag) AS im, sum(n.mag * 0.4 * pow(0.6, abs(a.k - n.k))) AS sm
  FROM m a JOIN m n ON n.clip_id = a.clip_id AND n.frame_no = a.frame_no AND {before} GROUP BY a.clip_id, a.frame_no, a.k),
 z AS (SELECT clip_id, frame_no, k, re * sm AS re, im * sm AS im FROM s){BACK}{OUT}""")
# bin k of the mirrored spectrum: h is the bin of the lower half it comes from, v the sign of its imaginary part
HALF = "h AS (SELECT clip_id, frame_no, data, k, least(k, 64 - k) AS h, CASE WHEN k > 32 THEN -1 ELSE 1 END AS v FROM fr, range(0, 64) q(k))"
for mode, (re, im) in {
    "copytwice": ("data[CASE WHEN h = 32 THEN 1 ELSE 2 * h + 1 END]", "v * data[CASE WHEN h = 32 THEN 2 ELSE 2 * h + 2 END]"),
    "copyonce": ("CASE WHEN h = 32 THEN 0 ELSE data[2 * h + 1] END", "CASE WHEN h = 32 THEN 0 ELSE v * data[2 * h + 2] END"),
    "filltwice": ("data[h + 1]", "v * data[h + 1]"), "fillonce": ("data[h + 1]", "0e0"),
}.items():
    add(f"h8_as_raw_{mode}", framed(lambda f, m=mode: spectral.fft_as_raw(f, m)), f"WITH {V.FRAMES}, {HALF}, z AS (SELECT clip_id, frame_no, k, {re} AS re, {im} AS im FROM h){BACK}{OUT}")
HANN = "(0.5 - 0.5 * cos(2 * pi() * {t} / 64))"
add("h9_pitch_naive", framed(lambda f: spectral.fft_pitch_naive(f, 1.3)), f"""WITH {DFT.replace("data[t + 1] AS x", f"data[t + 1] * {HANN.format(t='t')} AS x")}, {HALF.replace("data, ", "")},
 z AS (SELECT h.clip_id, h.frame_no, h.k, coalesce(b.re, 0) AS re, coalesce(v * b.im, 0) AS im FROM h LEFT JOIN b ON b.clip_id = h.clip_id AND b.frame_no = h.frame_no AND b.k = CAST(floor(h.h / 1.3) AS BIGINT)){BACK}
 SELECT clip_id, frame_no, k, round(x * {HANN.format(t='k')}, 6) + 0.0 AS x FROM i""")
add("h10_dct_roundtrip", framed(spectral.dct_roundtrip), SQL["h2_fft_roundtrip"])
add("h10_dct_reverse", framed(spectral.dct_reverse), f"""WITH {V.FRAMES}, p AS (SELECT clip_id, frame_no, t, data[t + 1] AS x FROM fr, range(0, 64) r(t)),
 c AS (SELECT clip_id, frame_no, k, sum(x * cos(pi() * (2 * t + 1) * k / 128) * CASE WHEN k = 0 THEN sqrt(1 / 64) ELSE sqrt(2 / 64) END) AS c FROM p, range(0, 64) q(k) GROUP BY ALL),
 i AS (SELECT clip_id, frame_no, t AS k, sum(c * cos(pi() * (2 * t + 1) * (63 - k) / 128) * CASE WHEN k = 63 THEN sqrt(1 / 64) ELSE sqrt(2 / 64) END) AS x FROM c, range(0, 64) r(t) GROUP BY ALL){OUT}""")
on_sig("h11_reverb", lambda df: spectral.reverb(df, spectral.impulse(400, 2.0, "damped"), 0.8, 0.3, 256), view=V.sig_long)
on_sig("h12_vocoder_mono", lambda df: vocoder.vocoder_mono(df, 1.2), view=V.sig_long)
on_sig("h13_vocoder_polished", lambda df: vocoder.vocoder_mono(df, 1.2, True), view=V.sig_long)
on_sig("h14_vocoder_stereo", lambda df: vocoder.vocoder_stereo(df, 1.2), view=V.sig_stereo)
on_sig("h14_vocoder_stereo_basic", lambda df: vocoder.vocoder_stereo(df, 1.2, peak_lock=False), view=V.sig_stereo)

# -- I: generators ---------------------------------------------------------------------------------------------------------------------------
TURN = "(idx * (440 * pow(2e0, (61 - 69) / 12e0)) / 8000)"
PART = f"({TURN} - floor({TURN}))"
for kind, sql in {"sine": f"sin({TURN} * (2 * pi()))", "saw": f"2 * ({PART} - 0.5)", "triangle": f"abs({PART} - 0.5) * 4 - 1", "square": f"sign({PART} - 0.5)"}.items():
    on_sig(f"i{['sine', 'saw', 'triangle', 'square'].index(kind) + 1}_{kind}", lambda df, k=kind: effects.add_tone(df, k, 61, 0.3, 8000), pick(f"x + 0.3 * ({sql})"))
#: Noise whose draws are the broken parts of the given values, so that SQL has the same; the tests hold hashed draws against loops.
DRAWS = """dr AS (SELECT *, (x + 0.5) * 100 - floor((x + 0.5) * 100) AS u, (x + 0.5) * 700 - floor((x + 0.5) * 700) AS u2 FROM sig)"""


def drawn(df: DataFrame) -> DataFrame:
    part = lambda k: (F.col("x") + 0.5) * k - F.floor((F.col("x") + 0.5) * k)
    return df.withColumns({"u": part(100), "u2": part(700)})


LAST = "(CASE WHEN idx = 0 THEN 0 ELSE lag(u - 0.5) OVER (PARTITION BY clip_id ORDER BY idx) END)"
on_sig("i5_white", lambda df: effects.add_noise(drawn(df), "white", 0.5, draws="u"), pick("x + (u - 0.5) * 0.01", "dr", DRAWS))
for kind, sql in (("violet", f"(u - 0.5 - {LAST}) / 2"), ("blue", f"(2 * (u - 0.5) - {LAST}) / 4")):
    on_sig(f"i6_{kind}", lambda df, k=kind: effects.add_noise(drawn(df), k, 0.5, draws="u"), pick(f"x + {sql} * 0.01", "dr", DRAWS))


def walk_sql(step: float) -> str:
    return f"""{DRAWS}, w AS (SELECT clip_id, channel, idx, x, u2, greatest(-1.0, least(1.0, (u - 0.5) * {step})) AS y FROM dr WHERE idx = 0
 UNION ALL SELECT d.clip_id, d.channel, d.idx, d.x, d.u2, greatest(-1.0, least(1.0, w.y + (d.u - 0.5) * {step})) FROM w JOIN dr d ON d.clip_id = w.clip_id AND d.idx = w.idx + 1)"""


for kind, step in (("brown", 0.2), ("pink_acc", 0.34), ("orange", 0.06)):
    on_sig(f"i7_{kind}", lambda df, k=kind: filters.walk_noise(drawn(df), k, 0.5, draws=("u",), chunk=16), pick("x + 0.5 * (y / 2)", "w", walk_sql(step)))
on_sig("i8_gray", lambda df: filters.walk_noise(drawn(df), "gray", 0.5, draws=("u", "u2"), chunk=16),
       pick("x + 0.5 * 0.25 * (y + 0.5 * (2 * (u2 - 0.5) - coalesce(lag(u2 - 0.5) OVER (PARTITION BY clip_id ORDER BY idx), 0)))", "w", walk_sql(0.3)))
for kind in ("green", "yellow"):
    on_sig(f"i9_{kind}", lambda df, k=kind: filters.walk_noise(df, k, 0.5, chunk=16))
on_sig("i11_black", lambda df: filters.walk_noise(drawn(df), "black", 0.5, draws=("u",), chunk=16))
for kind, longest in (("hold", 20), ("hold_pink", 6), ("hold_orange", 66)):
    on_sig(f"i12_{kind}", lambda df, k=kind: filters.walk_noise(drawn(df), k, 0.5, draws=("u",), chunk=16),
           pick("dr.x + 0.5 * (h.u - 0.5)", "dr ASOF JOIN h ON dr.clip_id = h.clip_id AND dr.idx >= h.start",
                f"{DRAWS}, h AS (SELECT clip_id, u, coalesce(sum(1 + floor(abs(u - 0.5) * {longest})) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM dr)",
                idx="dr.idx", channel="dr.channel").replace("SELECT clip_id, CAST(dr", "SELECT dr.clip_id, CAST(dr"))
# Decay and gain of each sum, written here again so that the two sides are independent.
PINK = [(0.99886, 0.0555179), (0.99332, 0.0750759), (0.969, 0.153852), (0.8665, 0.3104856), (0.55, 0.5329522), (-0.7616, -0.016898)]
on_sig("i10_pink", lambda df: filters.pink_noise(drawn(df), 0.5, chunk=32, draws="u"),
       pick("x + 0.5 * 0.11 * (b0 + b1 + b2 + b3 + b4 + b5 + last * 0.115926 + (2 * u - 1) * 0.5362)", "p",
            f"""{DRAWS}, p AS (SELECT clip_id, channel, idx, x, u, {", ".join(f"(2 * u - 1) * {g} AS b{i}" for i, (_, g) in enumerate(PINK))}, 0e0 AS last FROM dr WHERE idx = 0
 UNION ALL SELECT d.clip_id, d.channel, d.idx, d.x, d.u, {", ".join(f"p.b{i} * {k} + (2 * d.u - 1) * {g}" for i, (k, g) in enumerate(PINK))}, 2 * p.u - 1 FROM p JOIN dr d ON d.clip_id = p.clip_id AND d.idx = p.idx + 1)"""))
on_sig("i13_sample_hold", lambda df: effects.add_sample_hold(df, 7, 0.1, 0.5))
on_sig("i14_gradient_noise", lambda df: effects.add_gradient_noise(df, 60, 120, 200, 0.5))

# -- J: cues -------------------------------------------------------------------------------------------------------------------------------------
TIME_SQL = "lpad(CAST(({t}) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({t}) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({t}) // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(({t}) % 1000 AS VARCHAR), 3, '0')"


def clock(s: str) -> str:
    return TIME_SQL.format(t=f"CAST(floor({s} * 1000 + 0.000001) AS BIGINT)")


CLEAN = f"{V.CUES}, ok AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_s, cue_no) - 1 AS no, start_s, end_s, text FROM cue WHERE text <> '')"
SRT_BODY = f"SELECT file_id, string_agg(CAST(no + 1 AS VARCHAR) || chr(10) || {clock('start_s')} || ' --> ' || {clock('end_s')} || chr(10) || text, chr(10) || chr(10) ORDER BY no) AS body FROM ok GROUP BY file_id"
FRAMES_SQL = "CASE WHEN {v} = floor({v}) THEN CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"
SUB_BODY = f"SELECT file_id, string_agg('{{' || {FRAMES_SQL.format(v='round(CAST(start_s AS DOUBLE) * 25, 3)')} || '}}{{' || {FRAMES_SQL.format(v='round(CAST(end_s AS DOUBLE) * 25, 3)')} || '}}' || text, chr(10) ORDER BY no) AS body FROM ok GROUP BY file_id"


def ordered(s, d) -> DataFrame:
    return cues.order_cues(cues.clean_cues(V.cue_src(s, d)))


def cue_rows(df: DataFrame) -> DataFrame:
    return df.select("file_id", F.col("cue_no").cast("long").alias("cue_no"), (F.round(F.col("start_s").cast("double"), 3) + 0.0).alias("start_s"), (F.round(F.col("end_s").cast("double"), 3) + 0.0).alias("end_s"), "text")


CUE_OUT = f"WITH {CLEAN} SELECT file_id, no AS cue_no, round(CAST(start_s AS DOUBLE), 3) + 0.0 AS start_s, round(CAST(end_s AS DOUBLE), 3) + 0.0 AS end_s, text FROM ok"


def vtt_files(s, d) -> DataFrame:
    tagged = ordered(s, d).withColumn("text", F.concat(F.lit("<v "), "role", F.lit(">"), "text", F.lit("</v>")))
    return cues.to_srt(tagged).select("file_id", F.concat(F.lit("WEBVTT\n\nNOTE made from turns\n\n"), F.regexp_replace("body", r"(\d),(\d\d\d)", "$1.$2")).alias("body"))


add("j1_parse_srt", lambda s, d: cue_rows(cues.parse_srt(cues.to_srt(ordered(s, d)))), CUE_OUT)
add("j2_parse_time", lambda s, d: V.cue_src(s, d).select("file_id", "cue_no", (F.round(cues.parse_time(cues.format_time(F.col("start_s"))), 3) + 0.0).alias("s")),
    f"WITH {V.CUES} SELECT file_id, cue_no, round(CAST(start_s AS DOUBLE), 3) + 0.0 AS s FROM cue")
add("j3_parse_sub", lambda s, d: cue_rows(cues.parse_sub(cues.to_sub(ordered(s, d)))), CUE_OUT)
add("j4_parse_vtt", lambda s, d: cue_rows(cues.parse_vtt(vtt_files(s, d))), CUE_OUT)
NAMED = """f AS (SELECT file_id, role AS name, min(start_s) AS first FROM cue WHERE text <> '' GROUP BY ALL),
    p AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY first, name) - 1 AS INTEGER) AS speaker_id, name FROM f)"""
add("j5_vtt_nodes", lambda s, d: cues.vtt_nodes(cues.parse_vtt(vtt_files(s, d))).select("file_id", "cue_no", F.explode("nodes").alias("n")).select("file_id", "cue_no", "n.type", "n.speaker", "n.text"),
    f"""WITH {V.CUES}, {NAMED} SELECT cue.file_id, CAST(row_number() OVER (PARTITION BY cue.file_id ORDER BY start_s, cue_no) - 1 AS INTEGER) AS cue_no, 'v' AS type, speaker_id AS speaker, text
    FROM cue JOIN p ON p.file_id = cue.file_id AND p.name = cue.role WHERE text <> ''""")
def spanned(s, d) -> DataFrame:
    """Each text in parts below tags of every kind, one of them inside another."""
    third = F.floor(F.length("text") / 3).cast("int")
    parts = F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", third * 2 + 1, F.length("text"))
    tagged = F.concat(F.lit("<b>"), parts[0], F.lit("<i>"), parts[1], F.lit("</i></b><c.red.big>"), parts[2], F.lit("</c><u>.</u><s>!</s>"))
    return cues.to_srt(ordered(s, d).withColumn("text", tagged)).select("file_id", F.concat(F.lit("WEBVTT\n\n"), F.regexp_replace("body", r"(\d),(\d\d\d)", "$1.$2")).alias("body"))


add("j5_vtt_spans", lambda s, d: cues.vtt_nodes(cues.parse_vtt(spanned(s, d))).select("file_id", "cue_no", F.posexplode("nodes").alias("at", "n")).select(
    "file_id", "cue_no", "at", "n.type", "n.text", F.array_join("n.classes", ".").alias("classes")),
    f"""WITH {V.CUES}, t AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_s, cue_no) - 1 AS cue_no, text, length(text) // 3 AS k FROM cue WHERE text <> ''),
    p AS (SELECT file_id, cue_no, unnest([{{'o': 1, 'type': 'b', 'text': substr(text, 1, k), 'classes': ''}}, {{'o': 2, 'type': 'i', 'text': substr(text, k + 1, k), 'classes': ''}},
      {{'o': 3, 'type': 'c', 'text': substr(text, 2 * k + 1), 'classes': 'red.big'}}, {{'o': 4, 'type': 'u', 'text': '.', 'classes': ''}}, {{'o': 5, 'type': 's', 'text': '!', 'classes': ''}}]) AS n FROM t)
    SELECT file_id, CAST(cue_no AS INTEGER) AS cue_no, CAST(row_number() OVER (PARTITION BY file_id, cue_no ORDER BY n.o) - 1 AS INTEGER) AS at, n.type AS type, n.text AS text, n.classes AS classes FROM p WHERE n.text <> ''""")
add("j6_vtt_speakers", lambda s, d: cues.vtt_speakers(cues.parse_vtt(vtt_files(s, d))),
    f"WITH {V.CUES}, {NAMED} SELECT * FROM p")
add("j7_clean_cues", lambda s, d: cue_rows(cues.clean_cues(V.cue_src(s, d).selectExpr("file_id", "cue_no", "end_s AS start_s", "start_s AS end_s", "text"))),
    f"WITH {V.CUES} SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, round(CAST(start_s AS DOUBLE), 3) + 0.0 AS start_s, round(CAST(end_s AS DOUBLE), 3) + 0.0 AS end_s, text FROM cue WHERE text <> ''")
add("j8_order_cues", lambda s, d: cue_rows(ordered(s, d)), CUE_OUT)
add("j9_format_time", lambda s, d: V.cue_src(s, d).select("file_id", "cue_no", cues.format_time(F.col("end_s") * 401).alias("t")),
    f"WITH {V.CUES} SELECT file_id, cue_no, {clock('(end_s * 401)')} AS t FROM cue")
add("j10_to_srt", lambda s, d: cues.to_srt(ordered(s, d)), f"WITH {CLEAN} {SRT_BODY}")
add("j10_to_sub", lambda s, d: cues.to_sub(ordered(s, d)), f"WITH {CLEAN} {SUB_BODY}")
def stored_cues(s, d) -> DataFrame:
    path = storage.work_dir(s, "cues")
    cues.write_cues(ordered(s, d), "srt", path)
    return s.read.schema("file_id long, body string").parquet(path)


def cue_folder(s, d) -> DataFrame:
    """One text file a conversation, read back."""
    path = storage.work_dir(s, "cue-files")
    cues.write_cue_files(ordered(s, d), "srt", path)
    return cues.read_cues(s, path).select(F.regexp_extract("path", "file_id=([0-9]+)/", 1).cast("long").alias("file_id"), "body")


add("a7_write_cues", stored_cues, f"WITH {CLEAN} {SRT_BODY}")
add("a6_read_cues", cue_folder, f"WITH {CLEAN}, w AS ({SRT_BODY}) SELECT file_id, body || chr(10) AS body FROM w")
add("j11_convert_vtt_sub", lambda s, d: cues.convert_cues(vtt_files(s, d), "vtt", "sub"), f"WITH {CLEAN} {SUB_BODY}")
add("j11_convert_sub_srt", lambda s, d: cues.convert_cues(cues.to_sub(ordered(s, d)), "sub", "srt"), f"WITH {CLEAN} {SRT_BODY}")

# -- L: chains --------------------------------------------------------------------------------------------------------------------------------------
on_sig("l1_apply_chain", lambda df: chain.apply_chain(df, [("gain", {"m": "1.3"}), ("clip", {"gain": 1, "mode": "clamp"}), ("reverse", {}), ("normalize", {})]),
       pick("y * (0.9 / m)", "c JOIN (SELECT clip_id, max(abs(y)) AS m FROM c GROUP BY clip_id) USING (clip_id)", "c AS (SELECT clip_id, channel, n - 1 - idx AS idx, greatest(-1.0, least(1.0, x * 1.3)) AS y FROM sig JOIN len USING (clip_id))"))
on_sig("l2_coerce_params", lambda df: chain.apply_chain(df, [("quantize", {"bits": "6"}), ("noise", {"vol": "0", "kind": "white"}), ("fft_roundtrip", {"size": "16"})]),
       pick("floor(x * 32 + 0.5) / 32", "sig JOIN len USING (clip_id) WHERE idx < n // 16 * 16"))


def with_own_effect(df: DataFrame) -> DataFrame:
    if "halve_then_add" not in chain.EFFECTS:
        chain.register_effect("halve_then_add", lambda d, add: effects.put(d, F.col("x") / 2 + add), {"add": chain.percent})
    return chain.apply_chain(df, [("halve_then_add", {"add": "12.5%"}), ("reverse", {})])


on_sig("l3_register_effect", with_own_effect, pick("x / 2 + 0.125", "sig JOIN len USING (clip_id)", idx="n - 1 - idx"))


# -- storage and streams ----------------------------------------------------------------------------------------------------------------------------


def stored(df: DataFrame) -> DataFrame:
    path = storage.work_dir(df.sparkSession, "signal")
    signals.write_signal(df, path)
    return signals.read_signal(df.sparkSession, path)


on_sig("a10_write_read_signal", stored, pick("x"))


def timed(df: DataFrame) -> DataFrame:
    """A sample a second."""
    return df.withColumn("ts", F.timestamp_seconds("idx"))


def streamed(s, d) -> DataFrame:
    """The signal as a stream; at its end a row of another clip moves the watermark past all others."""
    end = s.range(1).select(F.lit(-1).cast("long").alias("clip_id"), F.lit(0).alias("channel"), F.lit(10**9).cast("long").alias("idx"), F.lit(0.0).alias("x"))
    rows = V.sig(s, d).select("clip_id", F.col("channel").cast("int").alias("channel"), "idx", "x")
    return storage.replay(timed(rows), timed(end))


FAR = "1000 days"  # no row is late, however the files are dealt
add("k1_stream_levels", lambda s, d: storage.drain(streaming.stream_levels(streamed(s, d), "16 seconds", FAR)).select("clip_id", (F.col("w.start").cast("long") / 16).cast("long").alias("chunk"), r6("total"), "n", r6("peak")),
    f"WITH {V.SIG} SELECT clip_id, idx // 16 AS chunk, round(sum(abs(x)), 6) + 0.0 AS total, count(*) AS n, round(max(abs(x)), 6) + 0.0 AS peak FROM sig GROUP BY ALL")
add("k2_stream_overlap_frames", lambda s, d: storage.drain(streaming.stream_overlap_frames(streamed(s, d), "16 seconds", "4 seconds", FAR)).where(F.size("data") == 16).select(
    "clip_id", F.col("w.start").cast("long").alias("start_idx"), F.round(F.get("data", F.lit(0)), 6).alias("first"), (F.round(F.aggregate("data", F.lit(0.0), lambda a, b: a + b), 6) + 0.0).alias("total")),
    f"""WITH {V.SIG}, e AS (SELECT *, unnest(range(greatest(0, CAST(floor((idx - 16) / 4.0) AS BIGINT) + 1), idx // 4 + 1)) AS f FROM sig), g AS (SELECT clip_id, f, list(x ORDER BY idx) AS data FROM e GROUP BY ALL HAVING count(*) = 16)
    SELECT clip_id, f * 4 AS start_idx, round(data[1], 6) AS first, round(list_sum(data), 6) + 0.0 AS total FROM g""")
for name, fresh, like in (("biquad", lambda: streaming.Biquad(*filters.coefficients("low", 700.0, 0.8, 8000)), "e7_low"), ("ema", lambda: streaming.Ema(31.415927), "e1_ema_first"), ("delta", streaming.Delta, "f2_delta_encode")):
    out = (lambda df: df.select("clip_id", "idx", F.col("y").cast("long").alias("code"))) if name == "delta" else (lambda df: samples(df.withColumnRenamed("y", "x")))
    add(f"k3_stream_{name}", lambda s, d, f=fresh, o=out: o(storage.drain(streaming.stream_filter(streamed(s, d), f)).where("clip_id >= 0")), SQL[like])
add("k4_stream_vocoder", lambda s, d: samples(storage.drain(streaming.stream_vocoder(streamed(s, d), 1.2)).where("clip_id >= 0").withColumnRenamed("y", "x")))
add("k4_stream_vocoder_retuned", lambda s, d: samples(storage.drain(streaming.stream_vocoder(streamed(s, d).withColumn("shift", F.when(F.col("idx") < 1000, 1.2).otherwise(0.8)))).where("clip_id >= 0").withColumnRenamed("y", "x")))
add("k5_stream_dedup_frames", lambda s, d: levels.fingerprint(storage.drain(streaming.stream_dedup_frames(storage.replay(V.frames64_u8(s, d).select("data"))))).select("fingerprint"),
    f"WITH {V.U8} SELECT {FINGERPRINT} AS fingerprint FROM (SELECT DISTINCT data FROM u8)")  # a row a frame: two frames may share 32 bits


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
