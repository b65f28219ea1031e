"""Run logs as JSON lines: appended to, read with what schema they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC = "run string, step long, time double, metric string, value double"
SAMPLE = "run string, step long, text string, meta map<string,string>"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run, step, time, metric, value); blank lines are skipped, a missing folder is an empty log."""
    return _read(spark, path, METRIC)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SAMPLE)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def run_metrics(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """(run, step, time, metric, value, raw) of ``root``/<run>/metrics.jsonl, whose lines are objects of step, time and any metrics by name.

    A row for each metric: value where it is a number, raw as written. Lines that are blank, torn, no object or without a whole step leave.
    A missing folder is an empty log; a stream needs the folder and takes each file once. A filter on ``run`` prunes files.
    """
    rows = _entries(spark, root, "metrics.jsonl", stream)
    each = rows.select("run", "step", F.expr("try_cast(entry['time'] as double)").alias("time"), F.explode(F.map_filter("entry", lambda k, _: ~k.isin("step", "time"))).alias("metric", "raw"))
    each = each.withColumn("raw", F.regexp_replace("raw", '^"([+-]?(?:NaN|Infinity))"$', "$1"))  # the parser quotes these
    return each.select("run", "step", "time", "metric", F.expr("try_cast(raw as double)").alias("value"), "raw")


def run_samples(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """(run, step, text, meta) of ``root``/<run>/samples.jsonl; meta holds all but step and text. Otherwise as ``run_metrics``."""
    rows = _entries(spark, root, "samples.jsonl", stream)
    return rows.select("run", "step", F.col("entry")["text"].alias("text"), F.map_filter("entry", lambda k, _: ~k.isin("step", "text")).alias("meta"))


def _entries(spark: SparkSession, root: str, name: str, stream: bool) -> DataFrame:
    """(run, step, entry): a file a run, its name that of the folder."""
    pattern = f"{root.rstrip('/')}/*/{name}"
    if not stream:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop):
            return spark.createDataFrame([], "run string, step long, entry map<string,string>")
    lines = (spark.readStream if stream else spark.read).text(pattern)
    run = F.url_decode(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -2), r"\+", "%2B"))
    rows = lines.select(run.alias("run"), F.from_json("value", "map<string,string>").alias("entry"))
    return rows.select("run", F.expr("try_cast(entry['step'] as long)").alias("step"), "entry").where("step is not null")


def write_results(summary: DataFrame, runs: DataFrame, path: str) -> None:
    """The sink of a comparison: its summary and the runs that it sums up, as JSON lines."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    runs.write.mode("overwrite").json(f"{path}/runs")


def last_metrics(log: DataFrame, run: str = "run", metric: str = "metric", order: str = "step", value: str = "value") -> DataFrame:
    """(run, metric, last_value, n): the value of the last row of each run and metric."""
    return log.groupBy(run, metric).agg(F.max_by(value, order).alias("last_value"), F.count("*").alias("n"))
