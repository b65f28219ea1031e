"""Run logs, caches and tables as they lie in folders: torn files, defaults, batch against stream."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from strophe.functions import phonetics, text
from strophe.sources import corpora, runs
from strophe.streaming.early_stopping import since_best


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def streamed(df, where):
    """All rows that the stream gives from what is there now."""
    q = df.writeStream.outputMode("append").option("checkpointLocation", f"{where}/ck").trigger(availableNow=True).format("parquet").start(f"{where}/out")
    assert q.awaitTermination(240) and q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{where}/out")


def put(folder, name, body):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(body)


def test_run_logs(spark, tmp_path):
    root = tmp_path / "logs"
    body = '{"step": 1, "time": 0.5, "loss": 2.5, "note": "warm up"}\n\n   \n{"step": 2, "time": 1.5, "loss": NaN, "lr": null}\n[1, 2]\nnot json\n{"step": 1.5, "loss": 9}\n{"time": 9, "loss": 9}\n{"step": 3, "ti'
    put(root / "run a+b", "metrics.jsonl", body)
    put(root / "other", "metrics.jsonl", '{"step": 7, "time": 1, "loss": 1}\n{"step": 8}\n')
    put(root / "empty", "metrics.jsonl", "")
    put(root / "other", "samples.jsonl", '{"step": 7, "text": "a line", "temperature": 0.8}\n{"step": 8, "te')
    got = runs.run_metrics(spark, str(root))
    want = [("other", 7, 1.0, "loss", 1.0, "1"), ("run a+b", 1, 0.5, "loss", 2.5, "2.5"), ("run a+b", 1, 0.5, "note", None, "warm up"), ("run a+b", 2, 1.5, "lr", None, None)]
    assert [r for r in rows_of(got) if not (r[4] and math.isnan(r[4]))] == want and got.where("isnan(value)").count() == 1
    assert str(rows_of(streamed(runs.run_metrics(spark, str(root), stream=True), tmp_path / "m"))) == str(rows_of(got))
    samples = runs.run_samples(spark, str(root))
    assert [(r.run, r.step, r.text, r.meta) for r in samples.collect()] == [("other", 7, "a line", {"temperature": "0.8"})]
    assert rows_of(runs.run_metrics(spark, str(tmp_path / "none"))) == [] and runs.run_metrics(spark, str(tmp_path / "none")).schema == got.schema


def test_a_filter_on_run_prunes_files(spark, tmp_path):
    for k in range(6):
        put(tmp_path / f"r{k}", "metrics.jsonl", json.dumps({"step": 1, "time": 0, "loss": k}) + "\n")
    df = runs.run_metrics(spark, str(tmp_path)).where("run = 'r3'")
    assert [r.value for r in df.collect()] == [3.0]
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1


def test_song_cache(spark, tmp_path):
    put(tmp_path, "a.json", '[{"artist": "A", "title": "T", "lyrics": "la la"},\n {"lyrics": "no names"}, {"artist": "A", "title": "no text"}]')
    put(tmp_path, "torn.json", '[{"artist": "B", "title": "whole", "lyrics": "x"},\n {"artist": "B", "ti')
    put(tmp_path, "none.json", "[]")
    got = corpora.read_songs(spark, f"{tmp_path}/*.json")
    assert rows_of(got) == [("A", "T", "la la"), ("A", "no text", ""), ("Unknown", "Untitled", "no names")]
    assert rows_of(streamed(corpora.read_songs(spark, f"{tmp_path}/*.json", stream=True), tmp_path / "s")) == rows_of(got)


def test_a_cache_is_never_overwritten(spark, tmp_path):
    songs = lambda n: spark.createDataFrame([("A", f"t{i}", "x") for i in range(n)], corpora.SONG)

    def fetch(artist):  # another driver fetches meanwhile
        first.append(corpora.cached_songs(spark, artist, str(tmp_path), lambda _: songs(2)))
        return songs(3)

    first = []
    mine = corpora.cached_songs(spark, "A", str(tmp_path), fetch)
    assert (first[0].count(), mine.count()) == (2, 3)
    kept = corpora.cached_songs(spark, "a", str(tmp_path), lambda _: pytest.fail("fetched again"))
    assert kept.count() in (2, 3)


def test_index_rows_and_existing_songs(spark, tmp_path):
    long = "a line that goes on for quite a while, over fifty characters"
    table = spark.createDataFrame([("A", long, "T1"), (None, long, None), ("B", "short", "T3"), ("B", long + "\nof \"two\"", "T4"), ("C", None, "T5")], "artist string, lyrics_clean string, name string").coalesce(1)
    corpora.write_lyrics(table, str(tmp_path / "csv"))
    got = corpora.read_index_rows(spark, str(tmp_path / "csv"))
    assert sorted((r.artist, r.title) for r in got.collect()) == [("A", "Track 0"), ("B", "Track 3"), ("Unknown", "Track 1")]
    assert sorted(r.title for r in corpora.read_index_rows(spark, str(tmp_path / "csv"), title="name").collect()) == ["", "T1", "T4"]
    assert {r.artist for r in corpora.read_index_rows(spark, str(tmp_path / "csv"), artist="who").collect()} == {"Unknown"}
    assert [r.artist for r in corpora.read_cleaned(spark, str(tmp_path / "csv")).orderBy("artist").collect()] == ["A", "B", "B"]
    corpora.write_lyrics(spark.createDataFrame([("A", long), ("A", "short"), ("A", None)], "artist string, artist_verses string"), str(tmp_path / "raw"))
    assert corpora.read_training_lyrics(spark, str(tmp_path / "raw")).count() == 1
    body = "first line here\n" + "words and words " * 8
    clean = spark.createDataFrame([("Ann", body, 1)], "artist string, text string, pos long")
    raw = spark.createDataFrame([("ann", body, 1), ("Bob", body, 2), ("bob", body, 1)], "artist string, text string, pos long")
    found = lambda a: sorted(r.title for r in corpora.existing_songs(a, clean, raw, order="pos").collect())
    assert found("ANN") == ["Track 1"] and found("Bob") == ["Track 1", "Track 2"] and found("nobody") == []


def test_index_and_profiles_come_back(spark, tmp_path):
    chunks = spark.createDataFrame([("A", "T", "x", 0)], "artist string, title string, text string, chunk_id int")
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "chunk_id int, vector array<double>")
    corpora.write_index(chunks, vectors, str(tmp_path / "i"))
    c, v = corpora.read_index(spark, str(tmp_path / "i"))
    assert (c.first().rhyme_scheme, c.first().end_suffixes) == ("unknown", None) and rows_of(v) == rows_of(vectors)
    p = spark.createDataFrame([("A", "AABB", {"AABB": 1.0}, 3)], "artist string, dominant_scheme string, scheme_distribution map<string,double>, total_lines int")
    corpora.write_profiles(p, str(tmp_path / "p"))
    got = corpora.read_profiles(spark, str(tmp_path / "p")).first()
    assert (got.artist, got.scheme_distribution, got.total_lines, got.avg_syllables) == ("A", {"AABB": 1.0}, 3, None)


def test_small_text_rules(spark):
    d = spark.createDataFrame([("AH1", "mark<|verse|>\n one\n\n two \nthree<|end|>four")], "p string, t string")
    assert d.select(phonetics.strip_stress(F.col("p")).alias("x")).first().x == "AH"
    assert d.select(text.first_generated_lines(F.col("t"), 2).alias("x")).first().x == "one\ntwo"


@pytest.mark.parametrize("seed", [1, 2])
def test_early_stopping_on_a_stream(spark, tmp_path, seed):
    """Events in any order inside the watermark give the rows of the batch; files are batches of the stream."""
    r = random.Random(seed)
    events = [(f"r{r.randrange(4)}", 1_700_000_000 + 20 * i, i, r.choice([None, math.nan, math.inf, 0.0, r.random(), 5 - i / 100])) for i in range(240)]
    events += [("r0", events[9][1], events[9][2], 0.25)] * 2 + [(None, events[0][1], 1, 1.0), ("r1", None, 1, 1.0)]
    events.sort(key=lambda e: (e[1] or 0) + r.uniform(0, 500))  # under ten minutes out of order
    events.append(("end", 1_800_000_000, 0, 1.0))
    files = [events[i : i + 60] for i in range(0, len(events), 60)] + [[("end", 1_800_000_001 + k, k, 2.0)] for k in (1, 2)]
    schema = "run string, at long, step long, loss double"
    for k, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*.parquet"):
            if os.path.getmtime(f) > 1_000_001_000:
                os.utime(f, (1_000_000_000 + k, 1_000_000_000 + k))
    time = F.timestamp_seconds("at")
    batch = since_best(spark.read.schema(schema).parquet(str(tmp_path / "in")).withColumn("time", time), "run")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("time", time)
    got = streamed(since_best(source, "run"), tmp_path)
    want = rows_of(batch.where("run <> 'end'"))
    assert len(want) == 242 and rows_of(got.where("run <> 'end'")) == want
