"""Readers and writers with strict schemas, and the checks of what they read and write."""

from __future__ import annotations

import csv
import io
import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c

# fixed values: columns of the two manifests and of predictions
PAIRS3 = ("pair_id", "search_path", "reference_gds_path", "search_gds_path", "reference_sem_path", "params_json_path")
WITHHELD = ("reference_sem_path", "params_json_path")
PREDICTIONS = ("pair_id", "x", "y", "theta", "scale", "found", "score")
PARAMS = "schema_version int, architecture string, num_layers int, layer_intensities map<string,int>, observable_layers array<int>, present boolean, rotation_deg double, scale double"


class SchemaError(ValueError):
    """A file's columns are not what is asked for."""


def _plain(name: str) -> str:
    return "".join(name.split()).lower()


def pick_column(columns: Sequence[str], candidates: Sequence[str], role: str) -> str:
    """The column of a role: an exact match of a candidate (case and spaces aside), else the only one that holds a candidate's first word."""
    for want in candidates:
        hits = [f for f in columns if _plain(f) == _plain(want)]
        if len(hits) == 1:
            return hits[0]
        if hits:
            raise SchemaError(f"{role}: columns {hits} are the same")
    hits = [f for f in columns if any(_plain(w).split("_")[0] in _plain(f) for w in candidates)]
    if len(hits) != 1:
        raise SchemaError(f"{role}: {len(hits)} of the columns {list(columns)} could be meant by {list(candidates)}")
    return hits[0]


def resolve_schema(columns: Sequence[str], wanted: Sequence[str] = PAIRS3, mapping: Mapping[str, str] | None = None) -> dict[str, str]:
    """Canonical name -> column; a mapping overrides names but must name columns that exist."""
    mapping = dict(mapping or {})
    if unknown := [k for k in mapping if k not in wanted]:
        raise SchemaError(f"no such canonical columns: {unknown}")
    out = {}
    for name in wanted:
        source = mapping.get(name, name)
        if source not in columns:
            near = [f for f in columns if _plain(f) == _plain(source)]
            raise SchemaError(f"no column {source!r} for {name}" + (f"; near: {near}" if near else ""))
        out[name] = source
    return out


def _bare(path: str) -> str:
    """A path without the local scheme, as both Spark and users write it."""
    return re.sub(r"^file:/+", "/", path).rstrip("/")


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """The header of each path, a CSV file or a folder of such; repeated names, and files of a folder that differ, are an error.

    One job for all paths: each file is a task's, which ends after the first line that is no comment, so no file is read
    to its end; the later blocks of large files are left at once.
    """

    def first(it):
        for batch in it:
            for value, file, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at:
                    return
                if not value.startswith("#"):
                    yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([file])], ["value", "file"])
                    return

    setting, limit = "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k) for k in (setting, limit)}
    # opening a file counts as much as a whole task's bytes, so no task gets a second one; and few lines make a batch
    spark.conf.set(setting, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    spark.conf.set(limit, 64)
    try:
        lines = spark.read.text(list(paths)).select("value", "_metadata.file_path", "_metadata.file_block_start")
        found = lines.mapInArrow(first, "value string, file string").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = {}
    for path in paths:
        own = {r["value"] for r in found if unquote(_bare(r["file"])) == _bare(path) or unquote(_bare(r["file"])).startswith(_bare(path) + "/")}
        if len(own) > 1:
            raise SchemaError(f"files with different headers: {sorted(own)}")
        names = next(csv.reader(io.StringIO(own.pop()))) if own else []
        if len(set(names)) != len(names):
            raise SchemaError(f"repeated columns in {names}")
        out[path] = names
    return out


def header(spark: SparkSession, path: str) -> list[str]:
    return headers(spark, [path])[path]


def key_faults(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row: empty keys, and keys that occur more than once."""
    one = rows.groupBy(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    return one.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("empty"), F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("repeated"))


def read_pairs(spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None, base: str | None = None) -> DataFrame:
    """A manifest with canonical string columns; paths resolved against base; empty or repeated ids are an error."""
    names = resolve_schema(header(spark, path), PAIRS3, mapping)
    rows = spark.read.option("comment", "#").csv(path, header=True).select(*(F.col(f"`{s}`").alias(n) for n, s in names.items()))
    bad = key_faults(rows).first()
    if bad["empty"] or bad["repeated"]:
        raise SchemaError(f"pair_id: {bad['empty']} empty, {bad['repeated']} repeated")
    if base:
        rows = rows.withColumns({n: F.when(F.col(n).isNotNull(), c.resolved(n, base)) for n in PAIRS3 if n.endswith("_path")})
    return rows


def blind(rows: DataFrame, withheld: Sequence[str] = WITHHELD) -> DataFrame:
    return rows.drop(*withheld)


def withheld(rows: DataFrame, columns: Sequence[str] = WITHHELD, key: str = "pair_id") -> DataFrame:
    """The withheld columns, on rows that have all of them filled; else null."""
    filled = F.lit(True)
    for x in columns:
        filled = filled & (F.coalesce(F.trim(x), F.lit("")) != "")
    return rows.select(key, *(F.when(filled, F.col(x)).alias(x) for x in columns))


def with_ordinal(rows: DataFrame, key: str, name: str = "ordinal", buckets: int = 64, within: Sequence[str] = ()) -> DataFrame:
    """rows with their place in the order of a numeric key, from 0, among all or those with the same ``within``.

    No task sorts more than a bucket. Bounds of about even buckets are literals, so the places don't change
    when a task is repeated.
    """
    cuts = rows.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    cuts = F.array(*(F.lit(x).cast("double") for x in sorted(set(cuts))))
    some = rows.withColumn("_bucket", F.coalesce(F.size(F.filter(cuts, lambda b: b <= F.col(key))), F.lit(0)))
    # one row for each bucket
    before = Window.partitionBy(*within, F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy(*within, "_bucket").agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"_w{i}") for i, k in enumerate(within)), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(within):
        on = on & F.col(k).eqNullSafe(F.col(f"_w{i}"))
    own = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(key)) - 1
    return some.withColumn("_own", own).join(starts, on).select(*rows.columns, (F.col("_start") + F.col("_own")).alias(name))


def scan_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV manifests with differing columns, and the file and shard (its folder) of each row.

    Folders with the same header are one read, so the plan grows with the headers, not with the shards.
    """
    by_header: dict[tuple, list[str]] = {}
    for p, names in headers(spark, paths).items():
        by_header.setdefault(tuple(names), []).append(p)
    out = None
    for names, same in by_header.items():
        schema = ", ".join(f"`{n}` string" for n in names)
        one = spark.read.schema(schema).option("comment", "#").csv(same, header=True).withColumn("file", F.col("_metadata.file_path"))
        one = one.withColumn("shard", F.element_at(F.split("file", "/"), -2))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def complete_only(rows: DataFrame, markers: DataFrame, shard: str = "shard") -> DataFrame:
    """Rows of shards whose marker is there."""
    return rows.join(markers.select(shard).distinct(), shard, "left_semi")


def merge_shards(rows: DataFrame, shard: str, order: str, paths: Sequence[str] = (), key: str = "id") -> DataFrame:
    """A new id over all shards, the old place (by a numeric order) as shard_id, and paths below their shard's folder."""
    before = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    starts = rows.groupBy(shard).agg(F.count("*").alias("_n")).select(shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = with_ordinal(rows, order, "shard_id", within=[shard]).withColumn("shard_id", F.col("shard_id").cast("long")).join(starts, shard)
    out = out.withColumn(key, F.col("_start") + F.col("shard_id")).drop("_start")
    return out.withColumns({p: F.concat_ws("/", F.col(shard).cast("string"), F.col(p)) for p in paths})


def merge_check(given: DataFrame, returned: DataFrame, chunk: int) -> DataFrame:
    """chunk, n, ok: whether each chunk of the input came back whole and in its order (both have ordinal and pair_id)."""
    x = given.select("ordinal", F.col("pair_id").alias("a"))
    y = returned.select("ordinal", F.col("pair_id").alias("b"))
    both = x.join(y, "ordinal", "full")
    return both.groupBy(F.floor(F.col("ordinal") / chunk).alias("chunk")).agg(F.count("a").alias("n"), F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("ok"))


def prediction_text(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows as they are written: 4 decimals for poses, 6 for scores (ties to even), zeros where refused."""
    d = c.decide(threshold)
    pose = [F.format_string("%.4f", F.bround(d[k], 4)).alias(k) for k in ("x", "y", "theta", "scale")]
    return rows.select("pair_id", *pose, d["found"].alias("found"), F.format_string("%.6f", F.bround(F.coalesce(c.finite("score"), F.lit(0.0)), 6)).alias("score"))


def write_predictions(rows: DataFrame, path: str, order: str = "ordinal") -> None:
    """One CSV folder in input order; parts are ranges of the order, so no task has them all."""
    rows.repartitionByRange(order).sortWithinPartitions(order).select(*PREDICTIONS).write.option("header", True).csv(path)


def contract_faults(manifest: DataFrame, output: DataFrame) -> DataFrame:
    """rule, n: how often an output breaks each rule. Both have ordinal and pair_id; output's columns are text."""
    y = output.select("ordinal", *(F.col(k).alias(f"o_{k}") for k in PREDICTIONS))
    both = manifest.select("ordinal", "pair_id").join(y, "ordinal", "full")
    number = {k: F.expr(f"try_cast(o_{k} as double)") for k in ("x", "y", "theta", "scale", "score")}
    here, zero = F.col("o_pair_id").isNotNull(), F.lit(True)
    for k in ("x", "y", "theta", "scale"):
        zero = zero & (number[k] == 0)
    parsed = F.lit(True)
    for e in number.values():
        parsed = parsed & e.isNotNull()
    rules = {
        "ids": ~F.coalesce(F.col("pair_id") == F.col("o_pair_id"), F.lit(False)),
        "found": here & ~F.coalesce(F.col("o_found").cast("string").isin("0", "1"), F.lit(False)),
        "numbers": here & ~parsed,
        "zeros": here & parsed & (F.col("o_found").cast("string") == "0") & ~zero,
    }
    one = both.agg(*(F.count_if(e).alias(k) for k, e in rules.items()))
    again = output.groupBy("pair_id").count().filter("count > 1").agg(F.count("*").alias("repeated"))
    return one.crossJoin(again).select(c.stacked({k: F.col(k) for k in (*rules, "repeated")}, "rule", "n")).withColumn("n", F.col("n").cast("long"))


def params_faults(text: Column) -> Column:
    """Names of the rules that a parameter JSON breaks, in order."""
    p = F.from_json(text, PARAMS)
    has = lambda k: F.get_json_object(text, f"$.{k}").isNotNull()
    values = F.map_values(p["layer_intensities"])
    keys = F.map_keys(p["layer_intensities"])
    ok = lambda e: F.coalesce(e, F.lit(False))
    rules = {
        "version": ok(p["schema_version"] == 1), "architecture": has("architecture"), "layers": ok(F.size(p["layer_intensities"]) > 0),
        "range": ok(F.forall(values, lambda v: v.between(0, 255))), "keys": ok(F.forall(keys, lambda k: k.rlike("^[0-9]+$"))),
    }
    return F.array_compact(F.array(*(F.when(~e, F.lit(k)) for k, e in rules.items())))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row for each split of a results file, whether a bare list or {provenance, splits}: name, errors."""
    split = "struct<name:string,errors:array<double>>"
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"provenance struct<commit:string,utc:string>, splits array<{split}>")
    bare = F.from_json("value", f"array<{split}>")
    splits = F.when(F.ltrim("value").startswith("["), bare).otherwise(whole["splits"])
    return text.select(F.inline(splits))


def paired_files(files: DataFrame, left: str, right: str) -> DataFrame:
    """stem, left, right: files of a flat folder paired by their endings; a missing partner is null. files has path."""
    name = F.element_at(F.split("path", "/"), -1)
    of = lambda end, n: files.filter(name.endswith(end)).select(F.substring(name, 1, F.length(name) - len(end)).alias("stem"), name.alias(n))
    return of(left, "left").join(of(right, "right"), "stem", "full")


def overlaid(rows: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """rows with the truth's values where it has any."""
    some = [x for x in truth.columns if x != key]
    out = rows.join(truth.select(key, *(F.col(x).alias(f"_t_{x}") for x in some)), key, "left")
    return out.select(key, *(F.coalesce(f"_t_{x}", x).alias(x) if x in some else F.col(x) for x in rows.columns if x != key))


def blind_export(rows: DataFrame, emptied: Sequence[str], present: str = "present", pose: Sequence[str] = ("x", "y", "theta", "scale"), meta: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(pairs with emptied columns, ground truth with zeros for absent rows and the meta columns)."""
    pairs = rows.select("pair_id", *(F.lit("").alias(x) for x in emptied))
    truth = rows.select("pair_id", c.truthy(present).cast("int").alias(present), *(F.when(c.truthy(present), F.col(k)).otherwise(0.0).alias(k) for k in pose), *meta)
    return pairs, truth


def remaining(work: DataFrame, ledger: DataFrame, key: str = "key") -> DataFrame:
    """Work whose key's last ledger entry isn't done."""
    last = ledger.groupBy(key).agg(F.max_by("status", "ts").alias("status")).filter("status = 'done'")
    return work.join(last, key, "left_anti")


def shard_keys(names: DataFrame, column: str = "name") -> DataFrame:
    """shard, name: ``(test_)?[ABCD]_n`` as split_set_0000; others skipped, of several the least name."""
    form = r"^(test_)?([ABCD])_(\d+)$"
    some = names.filter(F.col(column).rlike(form))
    split = F.when(F.regexp_extract(column, form, 1) != "", "test").otherwise("train")
    shard = F.concat_ws("_", split, F.regexp_extract(column, form, 2), F.lpad(F.regexp_extract(column, form, 3), 4, "0"))
    return some.groupBy(shard.alias("shard")).agg(F.min(column).alias(column))


def payload_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of each file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def stamped(rows: DataFrame, name: str = "utc") -> DataFrame:
    """rows with the query's time as a UTC text, whatever the session's time zone."""
    return rows.withColumn(name, c.utc_text(F.current_timestamp()))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir).

    Without that setting a local session uses a temporary folder; on a cluster that is an error, for
    executors would write where nobody else reads.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="pairlens-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system as Spark sees them, whatever the store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def passing_folder(spark: SparkSession, name: str) -> str:
    """A shared_folder that goes when the session's JVM ends."""
    path = shared_folder(spark, name)
    where, system = hadoop_path(spark, path)
    system.deleteOnExit(where)
    return path


def stored(rows: DataFrame, name: str = "table") -> DataFrame:
    """rows from a table in a passing folder: computed once, lineage cut, its size known to what reads it."""
    path = passing_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_commented(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV files with comment lines (#) anywhere; their header each, or none and a schema."""
    reader = spark.read.option("comment", "#")
    return reader.schema(schema).csv(path) if schema else reader.csv(path, header=True)
