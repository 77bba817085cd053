"""Sources and sinks (S1-S6) and the row-level preparation steps."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscore.functions.text import WHITESPACE_CLASS, join_tokens

# Review record as its token arrays are used (other columns pass through when
# a wider schema is given).
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("code_tokens", T.ArrayType(T.StringType())),
        T.StructField("docstring_tokens", T.ArrayType(T.StringType())),
    ]
)

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "multiLine": "true",
}


# ----------------------------------------------------------------- S1, S2, S3
def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """JSON Lines with an explicit schema; a malformed line fails the load.
    Empty and whitespace-only lines give no row."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)


def read_jsonl_strict(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """S1 with the reference's blank-line rule: a line that is empty after
    stripping *Unicode* whitespace (e.g. only a no-break space) is skipped;
    every other line must be one JSON value or the job fails."""
    ws = WHITESPACE_CLASS
    line = F.regexp_replace(F.col("value"), f"^{ws}+|{ws}+$", "")
    lines = spark.read.text(path).select(line.alias("_line")).where(F.col("_line") != "")
    return lines.select(F.from_json("_line", schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, non-ASCII kept as is, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_splits(
    spark: SparkSession,
    paths: Mapping[str, str],
    schema: T.StructType | str,
    split_col: str = "split",
    reader: Callable[[SparkSession, str, T.StructType | str], DataFrame] = read_jsonl,
) -> DataFrame:
    """S3: several split files as one DataFrame with a ``split`` label."""
    frames = [reader(spark, p, schema).withColumn(split_col, F.lit(name)) for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet", mode: str = "overwrite") -> None:
    """S3 sink: one folder per split (``split=<name>``)."""
    w = df.write.mode(mode).partitionBy(split_col)
    if fmt == "json":
        w.option("ignoreNullFields", "false").json(path)
    else:
        w.parquet(path)


# ---------------------------------------------------------------------- S4
def write_predictions_csv(df: DataFrame, path: str, id_col: str = "id", mode: str = "overwrite", rows_per_file: int = 200_000) -> None:
    """(id, actual_comments, generated_comments) with a header; edge
    whitespace and embedded newlines survive.

    A quoted newline keeps a reader from splitting a file, so each file is one task
    when read: a file gets ``rows_per_file`` rows at most, however many a task writes.
    """
    out = df.select(id_col, "actual_comments", "generated_comments")
    out.write.mode(mode).options(**CSV_OPTIONS).option("maxRecordsPerFile", rows_per_file).csv(path)


def read_predictions_csv(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    schema = f"{id_col} long, actual_comments string, generated_comments string"
    df = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    # CSV cannot tell an empty string from a missing one: both read back as ''
    return df.select(
        id_col,
        F.coalesce("actual_comments", F.lit("")).alias("actual_comments"),
        F.coalesce("generated_comments", F.lit("")).alias("generated_comments"),
    )


# ---------------------------------------------------------------------- S5
def data_version(df: DataFrame) -> list | None:
    """Names, sizes and times of the files that ``df`` reads, as one number each of
    them and of all (null where it reads no files).

    The files are listed and hashed by tasks; their contents are not read.
    """
    folders = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    if not folders:
        return None
    listed = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    one = listed.select("length", F.xxhash64("path", F.unix_micros("modificationTime"), "length").alias("h"))
    return list(one.agg(F.count("h"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor("h"), F.lit(0))).first())


def fingerprint(params: Mapping[str, object], df: DataFrame | None = None) -> str:
    """Key of a materialized result: its parameters, the input's schema and the
    version of the files it reads."""
    source = None if df is None else [df.schema.json(), data_version(df)]
    blob = json.dumps({"params": params, "source": source}, sort_keys=True, default=str)
    return hashlib.sha256(blob.encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def materialize(
    spark: SparkSession,
    base_path: str,
    params: Mapping[str, object],
    build: Callable[[], DataFrame],
    source: DataFrame | None = None,
    partition_cols: Sequence[str] = (),
) -> DataFrame:
    """Load ``base_path/<fingerprint>`` when it is complete, else build, write
    and load it.  The fingerprint covers the parameters, the input schema and the
    input's files, so neither changed parameters nor changed data return a stale result.  Reading back the
    written table also cuts the lineage."""
    path = f"{base_path.rstrip('/')}/{fingerprint(params, source)}"
    if not _exists(spark, path):
        w = build().write.mode("overwrite")
        if partition_cols:
            w = w.partitionBy(*partition_cols)
        w.parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------------- S6
METRIC_LOG_SCHEMA = "step long, metric string, value double, log string, run string, epoch int, write string"


def _next_write(spark: SparkSession, path: str) -> str:
    """Folder name of a new write: a number above those found, and a unique end."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [e.getPath().getName() for e in fs.listStatus(root)] if fs.exists(root) else []
    last = max((int(n.removeprefix("write=").split("-")[0]) for n in names if n.startswith("write=")), default=-1)
    return f"write={last + 1:012d}-{uuid.uuid4().hex}"


def log_metrics(df: DataFrame, path: str, run_col: str = "run", epoch_col: str = "epoch", step_col: str = "step", log: str = "metrics") -> None:
    """Per-epoch metrics in long form ``(run, epoch, step, metric, value)``.

    Idempotent: of a (log, run, epoch) the last write that names it counts, so a rerun
    replaces its metrics; other epochs, runs and logs (``log`` names the writer, as
    "train") stay.  A call appends one folder, so its files follow the tasks that
    write, not the number of runs and epochs.
    """
    metrics = [c for c in df.columns if c not in (run_col, epoch_col, step_col)]
    long = df.select(
        F.col(run_col).cast("string").alias("run"),
        F.col(epoch_col).cast("int").alias("epoch"),
        F.col(step_col).cast("long").alias("step"),
        *[F.col(c).cast("double").alias(c) for c in metrics],
    ).unpivot(["run", "epoch", "step"], metrics, "metric", "value")
    long.withColumn("log", F.lit(log)).write.parquet(f"{path.rstrip('/')}/{_next_write(df.sparkSession, path)}")


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of every (log, run, epoch) as its last write has them."""
    rows = spark.read.schema(METRIC_LOG_SCHEMA).parquet(path)
    newest = F.rank().over(Window.partitionBy("log", "run", "epoch").orderBy(F.desc("write")))
    return rows.withColumn("_newest", newest).where(F.col("_newest") == 1).select("run", "epoch", "step", "metric", "value")


# ------------------------------------------------------------------ P1-P4
def join_token_columns(df: DataFrame, cols: Sequence[str] = ("code_tokens", "docstring_tokens"), on_null: str = "raise") -> DataFrame:
    """Replace each token-array column by its tokens joined with one space."""
    return df.withColumns({c: join_tokens(c, " ", on_null) for c in cols})


def to_encoded_layout(df: DataFrame, renames: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Rename and drop to the encoded layout."""
    out = df.drop(*drop)
    return out.withColumnsRenamed(dict(renames or {}))


def head(df: DataFrame, n: int, order_cols: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` records by a file-order key (a top-n, not a full sort)."""
    return df.orderBy(*order_cols).limit(n)


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
