"""Derived inputs over the given tables, each as a Spark plan and as the DuckDB
CTE the oracle queries use.

PAIRS  user turn and the next assistant turn of a conversation
       (``id = conv_id * 100 + turn``, pred = assistant text, ref = user text).
NEAR   ref = document text, pred = the text with every 7th space-separated
       word removed.
MULTI  per conversation the first assistant turn is the prediction and the
       later assistant turns are its references (long form).
RUNLOG events as a training log: run = user_id % 20, step = 1-based position
       by event_id within the run, epoch = (step - 1) div 25, loss = value / 100
       (kept in a realistic range so exp(loss) stays far from overflow);
       epoch metrics bleu / em = mean value / 100 of click / view events,
       rounded half-up to 6 decimals in integer arithmetic (0 when none), so
       both engines produce the same doubles.
LOGITS embeddings as logits (64 wide) with label as target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.operators.ordering import row_number_by
from textscore.session import table_path

STEPS_PER_EPOCH = 25
NUM_RUNS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.

    Files of one row group are read by one task.  A caller who wants such scans
    dealt out sets ``textscore.input.partitions``; every table is then
    repartitioned to that many, whatever its size.  It is not set by default.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    n = spark.conf.get("textscore.input.partitions", None)
    return df.repartition(int(n)) if n else df


# ----------------------------------------------------------------- PAIRS
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ref"))
    asst = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred")
    )
    # equi-join on (conv_id, turn): unique keys, so no conversation is a hot key
    return user.join(asst, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "turn", "pred", "ref"
    )


PAIRS_SQL = """pairs AS (
  SELECT u.conv_id * 100 + u.turn AS id, u.conv_id, u.turn, a.text AS pred, u.text AS ref
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


# ------------------------------------------------------------------ NEAR
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.split(F.col("text"), " ")
    kept = F.filter(words, lambda w, i: (i + 1) % 7 != 0)
    return docs.select(
        F.col("doc_id").alias("id"), "lang", "source", F.array_join(kept, " ").alias("pred"), F.col("text").alias("ref")
    )


NEAR_SQL = """near AS (
  SELECT doc_id AS id, lang, source,
         array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 7 <> 0), ' ') AS pred,
         text AS ref
  FROM documents)"""


# ----------------------------------------------------------------- MULTI
def multi(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    conv = table(spark, sf_dir, "conversations")
    asst = conv.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    first = asst.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    # a conversation with very many turns is a skewed key here; AQE's skew-join
    # handling splits it (the per-conversation side has one row per key)
    tagged = asst.join(first, "conv_id")
    preds = tagged.where(F.col("turn") == F.col("first_turn")).select(F.col("conv_id").alias("id"), F.col("text").alias("pred"))
    refs = tagged.where(F.col("turn") > F.col("first_turn")).select(
        F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("_ref_no"), F.col("text").alias("ref")
    )
    return preds, refs


MULTI_SQL = """asst AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
first_turn AS (SELECT conv_id, min(turn) AS first_turn FROM asst GROUP BY conv_id),
mpreds AS (SELECT a.conv_id AS id, a.text AS pred FROM asst a JOIN first_turn f USING (conv_id) WHERE a.turn = f.first_turn),
mrefs AS (SELECT a.conv_id AS id, a.turn AS ref_no, a.text AS ref FROM asst a JOIN first_turn f USING (conv_id) WHERE a.turn > f.first_turn)"""


# ---------------------------------------------------------------- RUNLOG
def runlog_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    ev = ev.withColumn("run", (F.col("user_id") % NUM_RUNS).cast("long"))
    numbered = row_number_by(ev, ["event_id"], ["run"], out_col="step")
    return numbered.select(
        "run",
        F.floor((F.col("step") - 1) / STEPS_PER_EPOCH).cast("int").alias("epoch"),
        "step",
        (F.col("value") / 100.0).alias("loss"),
        "event_type",
        "value",
        "event_id",
    )


def exact_loss(steps: DataFrame) -> DataFrame:
    """RUNLOG loss as an exact decimal (value has two decimals), so means rounded
    to 5 decimals are exact half-up results rather than float tie noise."""
    return steps.withColumn("loss", F.col("value").cast("decimal(12,2)") / F.lit(100))


# SQL for a running or grouped mean of the exact loss rounded half-up to 5
# decimals: with c = value in hundredths, mean * 1e5 = 10 * sum(c) / n.
def exact_mean5_sql(sum_c: str, n: str) -> str:
    return f"CAST((20 * ({sum_c}) + ({n})) // (2 * ({n})) AS DOUBLE) / 100000.0"


CENTS_SQL = "CAST(round(value * 100) AS BIGINT)"


def _exact_mean6(sum_c: str, n: str):
    # mean of c / 10000 rounded half-up to 6 decimals: (200 * sum_c + n) div (2 * n) / 1e6
    return F.coalesce(F.expr(f"CAST((200 * {sum_c} + {n}) div (2 * {n}) AS DOUBLE) / 1000000.0"), F.lit(0.0))


def runlog_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = runlog_steps(spark, sf_dir)
    cents = F.round(F.col("value") * 100).cast("long")
    sums = steps.groupBy("run", "epoch").agg(
        F.sum(F.when(F.col("event_type") == "click", cents)).alias("_bc"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("_bn"),
        F.sum(F.when(F.col("event_type") == "view", cents)).alias("_ec"),
        F.count(F.when(F.col("event_type") == "view", 1)).alias("_en"),
    )
    return sums.select(
        "run", "epoch", _exact_mean6("_bc", "nullif(_bn, 0)").alias("bleu"), _exact_mean6("_ec", "nullif(_en, 0)").alias("em")
    )


RUNLOG_SQL = f"""steps AS (
  SELECT user_id % {NUM_RUNS} AS run,
         CAST(floor((row_number() OVER (PARTITION BY user_id % {NUM_RUNS} ORDER BY event_id) - 1) / {STEPS_PER_EPOCH}) AS INTEGER) AS epoch,
         row_number() OVER (PARTITION BY user_id % {NUM_RUNS} ORDER BY event_id) AS step,
         value / 100.0 AS loss, event_type, value, event_id
  FROM events),
epoch_sums AS (
  SELECT run, epoch,
         sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'click') AS bc,
         nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS bn,
         sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'view') AS ec,
         nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS en
  FROM steps GROUP BY run, epoch),
epochs AS (
  SELECT run, epoch,
         coalesce(CAST((200 * bc + bn) // (2 * bn) AS DOUBLE) / 1000000.0, 0.0) AS bleu,
         coalesce(CAST((200 * ec + en) // (2 * en) AS DOUBLE) / 1000000.0, 0.0) AS em
  FROM epoch_sums)"""


# ---------------------------------------------------------------- LOGITS
def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("id"), F.col("embedding").alias("logits"), F.col("label").alias("target"))


LOGITS_SQL = """logits AS (SELECT vec_id AS id, embedding AS logits, label AS target FROM embeddings)"""


# ---------------------------------------------------------------- splits
def split_of(id_col: str):
    """S3 split rule over documents: id % 10 = 0 test, 1 validation, else train."""
    m = F.col(id_col) % 10
    return F.when(m == 0, "test").when(m == 1, "validation").otherwise("train")


def split_sql(id_col: str) -> str:
    return f"CASE WHEN {id_col} % 10 = 0 THEN 'test' WHEN {id_col} % 10 = 1 THEN 'validation' ELSE 'train' END"
