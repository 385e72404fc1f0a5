"""Running evaluations as Structured Streaming queries.

Sources are folders of files; each batch goes through the same operators as a whole table. State is
one row for each run (or one id within the watermark); sinks can be written again after a failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score as s
from ..operators.aggregate import ERROR_SHARE
from ..sources.io import complete_only, hadoop_path

LEAST_ROWS = 8


def read(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; ``_file`` tells a row's file."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("_file", F.md5(F.col("_metadata.file_path")))


def _drain(writer, checkpoint: str, name: str | None = None):
    writer = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.queryName(name).start() if name else writer.start()
    query.awaitTermination()
    return query


def health(rows: DataFrame, run: str, failed: Column) -> DataFrame:
    """Streaming aggregate: rows and errors of each run."""
    return rows.groupBy(run).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))


def alarm(rows: DataFrame, run: str, failed: Column, out: str, checkpoint: str) -> None:
    """Writes the first state of each run with at least 8 rows and 20 % errors, once."""
    spark = rows.sparkSession

    def put(batch: DataFrame, _: int) -> None:
        bad = batch.filter((F.col("n") >= LEAST_ROWS) & (F.col("errors") >= ERROR_SHARE * F.col("n")))
        if exists(spark, out):
            bad = bad.join(spark.read.parquet(out).select(run), run, "left_anti")
        bad.write.mode("append").parquet(out)

    _drain(health(rows, run, failed).writeStream.outputMode("update").foreachBatch(put), checkpoint)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet folder is there with anything in it."""
    where, system = hadoop_path(spark, path)
    return system.exists(where) and any(f.getPath().getName().startswith("part-") for f in system.listStatus(where))


def progress(rows: DataFrame, run: str, found: Column, seconds: str, total: int) -> DataFrame:
    """Streaming aggregate: done, found, median seconds, rate, and the seconds left for a known total."""
    one = rows.groupBy(run).agg(F.count("*").alias("done"), F.count_if(found).alias("found"), F.percentile_approx(seconds, 0.5).alias("median"), F.sum(seconds).alias("_s"))
    rate = F.col("done") / F.nullif(F.col("_s"), F.lit(0.0))
    return one.select(run, "done", "found", "median", rate.alias("rate"), (F.greatest(F.lit(total) - F.col("done"), F.lit(0)) / rate).alias("eta"))


#: Folders of batches that a sink keeps apart; more are written as one.
FOLDERS = 16


def _log(spark: SparkSession, out: str) -> DataFrame:
    """version, folders, added: one row for each commit of a sink: its folders from then on, and what was added."""
    schema = "version long, folders array<string>, added array<string>"
    return spark.read.schema(schema).parquet(f"{out}/log") if exists(spark, f"{out}/log") else spark.createDataFrame([], schema)


def commit(rows: DataFrame, out: str, added: DataFrame, merge: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Adds rows to a sink as one folder, and then a row to its log: what isn't in the log isn't there.

    added (one column) says what the rows stand for, so it can be told later. With more than ``FOLDERS`` folders all are
    written anew as one, through ``merge``. So a sink has files by batches, not by input files. One writer at a time.
    """
    spark = rows.sparkSession
    last = _log(spark, out).agg(F.max("version").alias("v"), F.max_by("folders", "version").alias("f")).first()
    folders, name = list(last["f"] or []), f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{out}/{name}")
    folders.append(name)
    if len(folders) > FOLDERS:
        name = f"data/{uuid.uuid4().hex}"
        merge(spark.read.parquet(*(f"{out}/{f}" for f in folders))).write.parquet(f"{out}/{name}")
        folders = [name]
    entry = added.agg(F.collect_set(added.columns[0]).alias("added"))  # a batch's files, or one token
    entry = entry.select(F.lit((last["v"] or 0) + 1).cast("long").alias("version"), F.array(*(F.lit(f) for f in folders)).alias("folders"), "added")
    entry.coalesce(1).write.mode("append").parquet(f"{out}/log")


def committed(spark: SparkSession, out: str) -> DataFrame:
    """The rows of a sink's committed batches."""
    folders = _log(spark, out).agg(F.max_by("folders", "version")).first()[0]
    return spark.read.parquet(*(f"{out}/{f}" for f in folders))


def _new_files(batch: DataFrame, out: str) -> DataFrame:
    """The batch without files that are in the sink: a file that comes again, in a repeated batch or after a lost checkpoint, counts once."""
    seen = _log(batch.sparkSession, out).select(F.explode("added").alias("_file"))
    return batch.join(seen, "_file", "left_anti")


def grow_pool(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Keeps all rows that have arrived, with their shard; rows come from read(). See pool()."""

    def put(batch: DataFrame, _: int) -> None:
        new = _new_files(batch, out)
        commit(new, out, new.select("_file").distinct())

    _drain(rows.writeStream.foreachBatch(put), checkpoint)


def pool(spark: SparkSession, out: str, markers: str, shard: str) -> DataFrame:
    """Rows of the shards that are finished by now, whenever their rows came."""
    return complete_only(committed(spark, out).drop("_file"), spark.read.parquet(markers), shard)


def epoch_of(pool: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """An epoch of a fixed size from whatever the pool holds."""
    from ..operators.sample import fixed_size

    return fixed_size(pool, size, seed, key)


def resume(rows: DataFrame, key: str, out: str, checkpoint: str) -> None:
    """Adds rows whose key isn't in the output yet; read with committed().

    Keys that have come are kept as the query's state, so a batch costs the same whatever the output's size; a batch that is
    repeated after a failure is known by its number. From an older checkpoint, or none, the state is built anew from the
    source, and only in that run batches are compared with the output.
    """
    spark = rows.sparkSession
    where, system = hadoop_path(spark, checkpoint)
    lost = not system.exists(where) and exists(spark, f"{out}/log")

    def put(batch: DataFrame, number: int) -> None:
        token = spark.range(1).select(F.lit(f"{checkpoint} {number}").alias("token"))
        if not token.join(_log(spark, out).select(F.explode("added").alias("token")), "token", "left_semi").isEmpty():
            return
        new = batch.join(committed(spark, out).select(key), key, "left_anti") if lost else batch
        commit(new, out, token)

    _drain(rows.dropDuplicates([key]).writeStream.foreachBatch(put), checkpoint)


def score_stream(rows: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """Keeps the additive score histogram of each batch; their sum is the state. Read with scored().

    rows come from measured(read()).
    """

    def put(batch: DataFrame, _: int) -> None:
        new = _new_files(batch, out)
        commit(s.histogram(new, keys), out, new.select("_file").distinct(), lambda old: s.histogram(old, keys))

    _drain(rows.writeStream.foreachBatch(put), checkpoint)


def scored(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The histogram of everything scored so far, with accuracy and its standard error for each key."""
    hist = committed(spark, out).groupBy(*keys, "score").agg(*(F.sum(m).alias(m) for m in s.MEASURES))
    p = F.sum("correct") / F.nullif(F.sum("present"), F.lit(0))
    return hist.groupBy(*keys).agg(F.sum("n").alias("n"), p.alias("acc"), F.sqrt(p * (1 - p) / F.sum("present")).alias("se"))


def unique(rows: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Streaming rows without repeated ids within the watermark, which bounds the state."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drained(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over what is there and gives its result: rows appended, or the last complete table."""
    spark = rows.sparkSession
    if mode == "append":
        _drain(rows.writeStream.format("parquet").option("path", out), checkpoint)
        return spark.read.schema(rows.schema).parquet(out)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    _drain(rows.writeStream.outputMode("complete").foreachBatch(put), checkpoint)
    return spark.read.schema(rows.schema).parquet(out)
