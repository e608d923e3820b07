"""Subtitle cues: parsing, cleaning, ordering and writing files of SRT, SUB and VTT text.

files(file_id, body) -> cues(file_id, cue_no, start_s, end_s, text).  Everything is string and array expressions; only
ordering shuffles, by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS = r"[:;.,]"  # any of these parts hours, minutes, seconds, milliseconds
TIME = r"[0-9]+(?:[:;.,][0-9]+)*"
ARROW = rf"({TIME})\s*-->\s*({TIME})"


def parse_time(text: Column) -> Column:
    """h*3600 + m*60 + s + ms/1000 from the last four units; missing hours and minutes count as 0; null if unreadable."""
    parts = F.split(F.trim(text), UNITS)
    unit = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-k)).cast("double"), F.lit(0.0))
    return F.when(F.trim(text).rlike(rf"^{TIME}$"), unit(4) * 3600 + unit(3) * 60 + unit(2) + unit(1) / 1000)


def _blocks(files: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n?", "\n")
    return files.select("file_id", F.posexplode(F.split(body, r"\n[ \t]*\n\s*")).alias("pos", "block"))


def _timed(blocks: DataFrame) -> DataFrame:
    arrow = F.regexp_extract("block", ARROW, 0)
    text = F.regexp_extract("block", rf"(?s){ARROW}[^\n]*\n?(.*)", 3)
    return blocks.where(arrow != "").select(
        "file_id", "pos", parse_time(F.regexp_extract("block", ARROW, 1)).alias("start_s"),
        parse_time(F.regexp_extract("block", ARROW, 2)).alias("end_s"), F.regexp_replace(text, r"\s+$", "").alias("text"))


def _numbered(cues: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("pos")) - 1
    return cues.select("file_id", number.alias("cue_no"), "start_s", "end_s", "text")


def parse_srt(files: DataFrame, drop_blank: bool = True) -> DataFrame:
    """Blocks between blank lines; the number line is optional; an empty file has no cue."""
    cues = _timed(_blocks(files))
    return _numbered(cues.where(F.trim("text") != "") if drop_blank else cues)


def parse_sub(files: DataFrame, fps: float = 25.0) -> DataFrame:
    """{from}{to}text lines, in frames (decimals allowed)."""
    line = r"^\{([0-9]+(?:\.[0-9]+)?)\}\{([0-9]+(?:\.[0-9]+)?)\}(.*)$"
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n?", "\n")
    lines = files.select("file_id", F.posexplode(F.split(body, "\n")).alias("pos", "line")).where(F.col("line").rlike(line))
    part = lambda k: F.regexp_extract("line", line, k)
    return _numbered(lines.select("file_id", "pos", (part(1).cast("double") / fps).alias("start_s"), (part(2).cast("double") / fps).alias("end_s"), part(3).alias("text")))


TAG = r"<(/?)([a-z]+)((?:\.[^\s.>]+)*)(?:\s+([^>]*))?>"


def parse_vtt(files: DataFrame) -> DataFrame:
    """As SRT, header and other blocks without a time line skipped; `raw` keeps the tags, `text` has none."""
    cues = _numbered(_timed(_blocks(files)).where(F.trim("text") != ""))
    return cues.withColumn("raw", F.col("text")).withColumn("text", F.regexp_replace("text", r"<[^>]*>", ""))


NODE = "struct<type:string,text:string,speaker:string,classes:array<string>>"


def vtt_nodes(cues: DataFrame) -> DataFrame:
    """Adds nodes array<struct<type, text, speaker, classes>>: a span has the innermost tag that is open (normal if none is).

    `speaker` is the number of a voice span's speaker, as in vtt_speakers.  An end tag closes the last open tag of its name and
    those inside it; without one it does nothing.
    """
    piece = F.regexp_extract_all("raw", F.lit(rf"({TAG})?([^<]*)"), F.lit(0))
    tag = lambda p, k: F.regexp_extract(p, TAG, k)
    empty = F.array().cast(f"array<{NODE}>")

    def read(acc, p):
        name, opened = tag(p, 2), acc["open"]
        node = F.struct(
            name.alias("type"), F.lit("").alias("text"), F.when(name == "v", F.trim(tag(p, 4))).alias("speaker"),
            F.filter(F.split(tag(p, 3), r"\."), lambda c: c != "").alias("classes"))
        depth = F.array_position(F.reverse(F.transform(opened, lambda n: n["type"])), name).cast("int")
        closed = F.when(depth > 0, F.slice(opened, F.lit(1), F.size(opened) - depth)).otherwise(opened)
        now = F.when(name == "", opened).when(tag(p, 1) == "/", closed).otherwise(F.concat(opened, F.array(node)))
        return F.struct(now.alias("open"), acc["nodes"].alias("nodes"), F.regexp_replace(p, r"<[^>]*>", "").alias("text"))

    def write(acc):
        plain = F.struct(F.lit("normal").alias("type"), acc["text"].alias("text"), F.lit(None).cast("string").alias("speaker"), F.array().cast("array<string>").alias("classes"))
        node = F.when(F.size(acc["open"]) == 0, plain).otherwise(F.try_element_at(F.transform(acc["open"], lambda n: F.struct(
            n["type"].alias("type"), acc["text"].alias("text"), n["speaker"].alias("speaker"), n["classes"].alias("classes"))), F.lit(-1)))
        return F.struct(acc["open"].alias("open"), F.when(acc["text"] == "", acc["nodes"]).otherwise(F.concat(acc["nodes"], F.array(node))).alias("nodes"), acc["text"].alias("text"))

    start = F.struct(empty.alias("open"), empty.alias("nodes"), F.lit("").alias("text"))
    found = cues.withColumn("nodes", F.aggregate(piece, start, lambda acc, p: write(read(acc, p)))["nodes"])
    ids = vtt_speakers(cues).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "speaker_id"))).alias("ids"))
    numbered = F.transform("nodes", lambda n: F.struct(
        n["type"].alias("type"), n["text"].alias("text"), F.try_element_at(F.col("ids"), n["speaker"]).alias("speaker"), n["classes"].alias("classes")))
    return found.join(ids, "file_id", "left").withColumn("nodes", numbered).drop("ids")


def vtt_speakers(cues: DataFrame) -> DataFrame:
    """(file_id, speaker_id, name): dense ids by first appearance in the file."""
    names = F.regexp_extract_all("raw", F.lit(r"<v(?:\.[^\s.>]+)*\s+([^>]*)>"), F.lit(1))
    seen = cues.select("file_id", "cue_no", F.posexplode(names).alias("at", "name")).groupBy("file_id", F.trim("name").alias("name")).agg(F.min(F.struct("cue_no", "at")).alias("first"))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("first", "name")) - 1
    return seen.select("file_id", number.alias("speaker_id"), "name")


def clean_cues(cues: DataFrame) -> DataFrame:
    """Swap reversed times, drop blank text and cues without times."""
    usable = cues.where("trim(text) <> '' and start_s is not null and end_s is not null and not isnan(start_s) and not isnan(end_s)")
    return usable.withColumns({"start_s": F.least("start_s", "end_s"), "end_s": F.greatest("start_s", "end_s")})


def order_cues(cues: DataFrame) -> DataFrame:
    """Stable order by start, renumbered from 0."""
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("start_s", "cue_no")) - 1
    return cues.withColumn("cue_no", number)


def format_time(s: Column) -> Column:
    """HH:MM:SS,mmm; floors, hours unbounded."""
    ms = F.floor(s * 1000 + 1e-6)
    pad = lambda v, n: F.when(F.length(v.cast("string")) < n, F.lpad(v.cast("string"), n, "0")).otherwise(v.cast("string"))
    return F.concat(pad(F.floor(ms / 3600000), 2), F.lit(":"), pad(F.floor(ms / 60000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit(","), pad(ms % 1000, 3))


def _number(v: Column) -> Column:
    """Frames without a needless fraction."""
    r = F.round(v, 3)
    return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string"))


def to_srt(cues: DataFrame) -> DataFrame:
    """(file_id, body)."""
    block = F.concat((F.col("cue_no") + 1).cast("string"), F.lit("\n"), format_time(F.col("start_s")), F.lit(" --> "), format_time(F.col("end_s")), F.lit("\n"), F.col("text"))
    return _joined(cues, block, "\n\n")


def to_sub(cues: DataFrame, fps: float = 25.0) -> DataFrame:
    line = F.concat(F.lit("{"), _number(F.col("start_s") * fps), F.lit("}{"), _number(F.col("end_s") * fps), F.lit("}"), F.regexp_replace("text", "\n", "|"))
    return _joined(cues, line, "\n")


def _joined(cues: DataFrame, piece: Column, mark: str) -> DataFrame:
    parts = cues.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("cue_no", piece.alias("p")))).alias("s"))
    return parts.select("file_id", F.array_join("s.p", mark).alias("body"))


PARSERS = {"srt": parse_srt, "sub": parse_sub, "vtt": parse_vtt}
WRITERS = {"srt": to_srt, "sub": to_sub}


def convert_cues(files: DataFrame, source: str, target: str) -> DataFrame:
    """Parse, clean, order, write."""
    cues = PARSERS[source](files).select("file_id", "cue_no", "start_s", "end_s", "text")
    return WRITERS[target](order_cues(clean_cues(cues)))


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, body) of a folder of text files, at any depth; file_id is a hash of the path."""
    read = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return read.select(F.xxhash64("path").alias("file_id"), "path", "body")


def write_cues(cues: DataFrame, fmt: str, path: str) -> None:
    """Rendered files as rows (file_id, body) of Parquet, spread by file."""
    WRITERS[fmt](cues).write.parquet(path)


def write_cue_files(cues: DataFrame, fmt: str, path: str) -> None:
    """One text file each, in a folder by file_id.

    Time goes by files, not bytes, which AQE doesn't see: so the number of tasks is stated, and each task moves its own files to their place (the
    folder is a fresh one), where otherwise the driver moves them all, one by one.
    """
    tasks = 4 * cues.sparkSession.sparkContext.defaultParallelism
    files = WRITERS[fmt](cues).repartition(tasks, "file_id")
    files.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("file_id").text(path)
