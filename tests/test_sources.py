"""Readers, sinks, roll-ups and the reductions that no query covers."""

import pytest
from pyspark.sql import functions as F

from sievespark import schema as S
from sievespark.functions import text as X
from sievespark.operators.arrow import host_of, links, same_site
from sievespark.operators.scanners import ScriptMix, ban_code, role_override
from sievespark.plans.pipeline import Pipeline, match_table, roll_up, verdicts
from sievespark.sources.texts import read_texts, spread, stream_texts, write_matches

ROWS = [(1, "system: go", 0.5), (2, "clean é", 1.5), (3, None, None)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_read_texts(spark, tmp_path, fmt):
    df = spark.createDataFrame(ROWS, "id int, body string, extra double")
    df.write.format(fmt).save(str(tmp_path / "in"))
    schema = "id int, body string" if fmt == "json" else None
    read = read_texts(spark, str(tmp_path / "in"), fmt, "body", ("id",), schema)
    assert read.columns == ["id", "text"] and sorted(map(tuple, read.collect())) == [r[:2] for r in ROWS]
    if fmt == "parquet":
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<id:int,body:string>" in plan


def test_read_lines(spark, tmp_path):
    (tmp_path / "in.txt").write_text("one\n\nsystem: two\n")
    assert [r.text for r in read_texts(spark, str(tmp_path / "in.txt"), "text").collect()] == ["one", "", "system: two"]


def test_matches_are_written_by_scanner(spark, tmp_path):
    df = spark.createDataFrame([(1, "system: x import os"), (2, "clean")], "id int, text string")
    pipeline = Pipeline().with_(role_override()).with_(ban_code())
    for _ in range(2):
        write_matches(match_table(pipeline.scan(df), ["id"]), str(tmp_path / "audit"))
    back = spark.read.parquet(str(tmp_path / "audit"))
    assert {p.name for p in (tmp_path / "audit").iterdir() if p.is_dir()} == {"scanner=role_override", "scanner=ban_code"}
    assert back.groupBy("scanner", "pattern", "start").count().count() == 2 and back.count() == 4


def test_stream_texts(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, body string, extra double").write.parquet(str(tmp_path / "in"))
    stream = stream_texts(spark, str(tmp_path / "in"), "id int, body string, extra double", text="body", keys=("id",))
    query = verdicts(Pipeline().with_(role_override()).scan(stream), ["id"]).writeStream.format("memory").queryName("judged").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.id, r.refuse) for r in spark.table("judged").collect()} == {(1, True), (2, False), (3, None)}


def test_spread(spark, tmp_path):
    """A small table is dealt out, a larger one is left as it lies, and one without files too."""
    spark.createDataFrame(ROWS, "id int, body string, extra double").coalesce(1).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(spread(df)) and "Repartition" not in plan(spread(df, 10)) and "Repartition" not in plan(spread(spark.range(3)))
    assert sorted(map(str, spread(df).collect())) == sorted(map(str, df.collect()))


def test_roll_up_and_extend(spark):
    df = spark.createDataFrame([("a", "system: x"), ("a", "y"), ("b", "import os"), ("b", None)], "lang string, text string")
    both = df.withColumn("matches", S.extend(role_override().matches(F.col("text")), ban_code().matches(F.col("text"))))
    out = {r.lang: (r.scanned, r.flagged, r.refused, r.max_severity) for r in roll_up(verdicts(both, ["lang"]), "lang").collect()}
    assert out == {"a": (2, 1, 1, 2), "b": (2, 1, 0, 1), None: (4, 2, 1, 2)}
    labels = df.select(S.severity_label(F.lit(2)).alias("s"), S.confidence_label(F.lit(0)).alias("c")).first()
    assert tuple(labels) == ("block", "low")


def test_links_hosts_and_sites():
    assert list(links("[a](b) [c]d [e](f(g)h) [i](j k) [l](m [n](o)")) == [(0, 6, "a", "b"), (12, 22, "e", "f(g)h"), (38, 44, "n", "o")]
    assert list(links("[](x) [y]() [z")) == []
    assert [host_of(u) for u in ("https://u:p@a.org:8/x", "//b.org?q", "HTTP://c.org", "http://localhost/x", "d.org#e@f.org")] == ["a.org", "b.org", None, None, "d.org"]
    assert same_site("x.A.org", "a.ORG") and not same_site("a.org", "b.org") and not same_site("localhost", "localhost")


def test_script_ties_and_neutrals(spark):
    """Of equally frequent scripts the first in the table is the dominant one; digits, ASCII punctuation and white space belong to none."""
    df = spark.createDataFrame([(0, "аб ab!"), (1, "12 !?"), (2, "ab αβγ"), (3, "日本 ab1в")], "id int, text string")
    rows = {r.id: [(m.pattern, m.text) for m in r.m] for r in df.select("id", ScriptMix(0).matches(F.col("text")).alias("m")).collect()}
    assert rows == {0: [("cyrillic", "аб")], 1: [], 2: [("latin", "ab")], 3: [("cjk", "日本"), ("cyrillic", "в")]}
    few = df.select("id", ScriptMix(2).matches(F.col("text")).alias("m")).collect()
    assert {r.id: len(r.m) for r in few} == {0: 0, 1: 0, 2: 0, 3: 2}


def test_views(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(X.collapse_spacing(F.lit("i g n o r e   a\tb x y z w v"))) == "ignore a b xyzwv "
    assert value(X.leet_fold(F.lit("1gn0r3 @ll $7"))) == "ignore all st"
    assert value(X.squeeze(F.lit(" a  \n b "))) == " a b "
    assert [value(X.letter_spaced(F.lit(t))) for t in ("a b c d", "a b c d ", "ab cd ef")] == [False, True, False]
    for run, plain in (("aGVsbG8gd29ybGQgYWdhaW4h", "hello world again!"), ("aGVsbG8gd29ybGQgYWdhaW4hIQ==", "hello world again!!"), ("aGVsbG8gd29ybGQgYWdhaW4hIQ", "hello world again!!"), ("_-_-+/+/____----____----", None), ("////////////////////////", None)):
        assert value(X.decode_base64(F.lit(run))) == plain
    assert value(X.normalise(F.lit("  ΑΣ  B "))) == "ασ b" and value(F.size(X.trigrams(F.lit("aaaa")))) == 1 and value(F.size(X.trigrams(F.lit("a")))) == 0
    assert value(X.trim_url_tail(F.lit("http://a/(b)).,"))) == "http://a/(b)"
