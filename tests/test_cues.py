import pytest
from pyspark.sql import functions as F

from sparkwave.operators import cues


def files(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "file_id long, body string")


def rows(df):
    return [(r["file_id"], r["start_s"], r["end_s"], r["text"]) for r in df.orderBy("file_id", "cue_no").collect()]


def test_srt(spark):
    body = "1\r\n00:00:01,500 --> 00:00:02.250\r\nHello\r\nworld\r\n\r\n01:02;500 --> 01:03:500\nno number\n\n3\n00:00:05,000 --> 00:00:04,000\n \n"
    got = rows(cues.parse_srt(files(spark, body, "", None, "junk only")))
    assert got == [(0, 1.5, 2.25, "Hello\nworld"), (0, 62.5, 63.5, "no number")]
    assert cues.parse_srt(files(spark, body), drop_blank=False).count() == 3


def test_clean_and_order(spark):
    df = spark.createDataFrame([(1, 0, 9.0, 8.0, "b"), (1, 1, 2.0, 3.0, "a"), (1, 2, 1.0, 2.0, "  "), (1, 3, None, 2.0, "x"), (1, 4, 2.0, 2.5, "c")], "file_id long, cue_no int, start_s double, end_s double, text string")
    assert rows(cues.order_cues(cues.clean_cues(df))) == [(1, 2.0, 3.0, "a"), (1, 2.0, 2.5, "c"), (1, 8.0, 9.0, "b")]


def test_times_round_trip(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((0.0, 0.001, 59.999, 3600.0, 86399.5, 400000.25))], "i int, s double")
    for r in df.select("s", cues.parse_time(cues.format_time(F.col("s"))).alias("t"), cues.format_time(F.col("s")).alias("f")).collect():
        assert r["t"] == pytest.approx(r["s"], abs=1e-9)
    assert df.where("s > 100000").select(cues.format_time(F.col("s"))).first()[0] == "111:06:40,250"


def test_sub(spark):
    got = rows(cues.parse_sub(files(spark, "{25}{50}one\r\n{62.5}{75}two|lines\njunk\n")))
    assert got == [(0, 1.0, 2.0, "one"), (0, 2.5, 3.0, "two|lines")]


def test_vtt(spark):
    body = "WEBVTT - title\n\nNOTE skipped\n\n00:01.000 --> 00:02.000 line:0\n<v Ann>Hi <i>you</i></v> all\n\n00:03.000 --> 00:04.000\n<c.red.big>text</c><v Bob>yes</v>\n\n00:05.000 --> 00:06.000\n<v Ann>again</v>"
    parsed = cues.parse_vtt(files(spark, body))
    assert rows(parsed)[0] == (0, 1.0, 2.0, "Hi you all")
    nodes = [(r["cue_no"], n["type"], n["text"], n["speaker"], n["classes"]) for r in cues.vtt_nodes(parsed).orderBy("cue_no").collect() for n in r["nodes"]]
    assert nodes[:3] == [(0, "v", "Hi ", 0, []), (0, "i", "you", None, []), (0, "normal", " all", None, [])]
    nested = "WEBVTT\n\n00:01.000 --> 00:02.000\na<b>b<i>c</i>d</u>e<u>f</b>g<v Zed>h<c.x>i</c>j"
    found = cues.vtt_nodes(cues.parse_vtt(files(spark, nested))).first()["nodes"]
    assert [(n["type"], n["text"], n["speaker"], n["classes"]) for n in found] == [
        ("normal", "a", None, []), ("b", "b", None, []), ("i", "c", None, []), ("b", "d", None, []), ("b", "e", None, []), ("u", "f", None, []),
        ("normal", "g", None, []), ("v", "h", 0, []), ("c", "i", None, ["x"]), ("v", "j", 0, [])]
    assert nodes[3] == (1, "c", "text", None, ["red", "big"])
    assert [(r["speaker_id"], r["name"]) for r in cues.vtt_speakers(parsed).orderBy("speaker_id").collect()] == [(0, "Ann"), (1, "Bob")]


def test_convert_and_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    read = cues.read_cues(spark, str(tmp_path))
    assert cues.convert_cues(read, "srt", "sub").first()["body"] == "{25}{50}x"
    cues.write_cues(cues.parse_srt(read), "srt", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["body"] == "1\n00:00:01,000 --> 00:00:02,000\nx"


def test_files_of_cues_are_dealt_over_tasks_and_come_back(spark, tmp_path):
    rows = [(f, k, k * 1.5, k * 1.5 + 1, f"cue {k} of {f}") for f in range(200) for k in range(3)]
    df = spark.createDataFrame(rows, "file_id long, cue_no int, start_s double, end_s double, text string")
    spark.sparkContext.setJobGroup("cue-files", "writes")
    cues.write_cue_files(df, "srt", str(tmp_path / "out"))
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("cue-files") for i in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) == 4 * spark.sparkContext.defaultParallelism
    (tmp_path / "out" / "deeper" / "still").mkdir(parents=True)
    (tmp_path / "out" / "deeper" / "still" / "a.srt").write_text("1\n")
    read = {r["path"].split("/")[-2]: r["body"].rstrip("\n") for r in cues.read_cues(spark, str(tmp_path / "out")).collect()}
    want = {f"file_id={r['file_id']}": r["body"] for r in cues.to_srt(df).collect()}
    assert read == want | {"still": "1"}
