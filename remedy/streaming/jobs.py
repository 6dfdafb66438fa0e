"""Structured Streaming jobs (H1-H3).

The reference runs its loop one question at a time; here traces and passages
arrive as files. Diagnosis and indexing are row-local (append mode, no state);
the additive policies keep per-arm sums as streaming aggregation state (one row
per arm). Every job checkpoints under the shared checkpoint folder, so a restarted
query resumes from its last committed micro-batch; lost tasks are retried by Spark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedy.operators import retrieve as R
from remedy.operators import reward as RW
from remedy.plans.diagnosis import chosen_outcomes, diagnose_rows, failed_with_choice
from remedy.session import cut_lineage, scratch_path

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
DOCS_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def read_table_stream(spark: SparkSession, folder: str, table: str, schema: str,
                      files_per_trigger: int = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream over one table's parquet files in a folder; a table may also be a
    folder of files. The pattern is part of the path: a name filter would be put to the files
    inside such a folder, which have names of their own. A micro-batch takes so many files, or,
    where bytes are named, files of about so many bytes together (one at least)."""
    size = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    return spark.readStream.schema(schema).option(*size).parquet(f"{folder.rstrip('/')}/{table}*.parquet")


def diagnose_stream(events: DataFrame) -> DataFrame:
    """H3: failure label, verified label and reward of each arriving trace with the
    batch expressions, per row (stateless, append mode)."""
    d = RW.default_reward(diagnose_rows(events))
    return d.select("q", "failure_label", "verified_label", F.col("reward.total_reward").alias("total_reward"))


def outcome_stream(events: DataFrame) -> DataFrame:
    """Failed traces re-asked under their chosen arm (the logged arm restricted to
    the retriever arms when UNVERIFIED): (arm, reward) per failed trace."""
    return chosen_outcomes(failed_with_choice(events)).select("arm", F.col("reward.total_reward").alias("r"))


def outcome_stream_with_context(events: DataFrame) -> DataFrame:
    """Like ``outcome_stream`` plus the pre-repair 18-d diagnosis context ``x`` and
    the log order ``step`` (the event id)."""
    from remedy.plans.policies import diag_features

    post = chosen_outcomes(diag_features(failed_with_choice(events)), ("x",))
    return post.select(F.col("q").alias("step"), "arm", "x", F.col("reward.total_reward").alias("r"))


def epsgreedy_batch(events: DataFrame, out: str, epoch: int, d: int = 18, lr: float = 0.01, block_rows: int = 4096) -> None:
    """H1 (order-dependent learner), one micro-batch: blocks of its outcomes become maps of the
    weights in parallel under (arm, block) and are composed to one map per arm; the state of
    the batch before takes that map. Written to the batch's own folder, which a retry
    overwrites; events arrive in the order of their ids."""
    from remedy.operators import policy as PO

    spark = events.sparkSession
    o = cut_lineage(outcome_stream_with_context(events))
    maps = PO.epsgreedy_maps(o, d, lr, block_rows).join(o.groupBy("arm").agg(F.count(F.lit(1)).alias("n")), "arm")
    if epoch:
        state = spark.read.parquet(f"{out}/batch={epoch - 1}")
    else:
        state = spark.createDataFrame([], "arm long, pulls long, w array<double>")
    _write_batch(PO.advance(state, maps.select("arm", "n", "m", "c"), d), out, epoch)


def run_epsgreedy(spark: SparkSession, events: DataFrame, path: str | None = None, block_rows: int = 4096) -> DataFrame:
    """Learn from a stream of events; the weights (arm, pulls, w) after all batches so far. A
    second run on the same ``path`` resumes from the last batch."""
    out = path or scratch_path(spark, f"stream-epsgreedy-{uuid.uuid4().hex[:12]}")
    q = (events.writeStream.foreachBatch(lambda b, e: epsgreedy_batch(b, out, e, block_rows=block_rows))
               .option("checkpointLocation", out.rstrip("/") + "-checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    all_ = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    last = all_.agg(F.max("batch")).first()[0]
    return all_.filter(F.col("batch") == last).drop("batch")


def policy_stream(events: DataFrame) -> DataFrame:
    """H1: additive per-arm state (UCB pulls and reward sums, Thompson alpha/beta)
    advanced by each micro-batch of outcomes; complete-mode aggregation."""
    o = outcome_stream(events)
    rb = RW.binarize(F.col("r"))
    return o.groupBy("arm").agg(F.count(F.lit(1)).alias("pulls"), F.sum("r").alias("sum_reward"),
                                (1 + F.sum(rb)).alias("alpha"), (1 + F.sum(1 - rb)).alias("beta"))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
                 key: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Run a streaming query over all available input (availableNow) into a parquet table
    and return it. ``path`` names the table and, beside it, the checkpoint; a second run
    on the same path resumes and adds nothing for input already read. Without it each
    call gets a table of its own under the checkpoint folder.

    append: the file sink (exactly-once through its commit log). complete and update:
    each micro-batch overwrites the partition of its own batch id, so a retried batch
    leaves no duplicates; complete returns the last snapshot, update the latest row per
    ``key``."""
    out = path or scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    ckpt = out.rstrip("/") + "-checkpoint"
    if mode == "append":
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
                   .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(out)
    q = (stream.writeStream.foreachBatch(lambda b, epoch: _write_batch(b, out, epoch)).option("checkpointLocation", ckpt)
               .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    if mode == "complete":
        last = res.agg(F.max("batch")).first()[0]
        return res.filter(F.col("batch") == last).drop("batch")
    from pyspark.sql import Window as W
    w = W.partitionBy(*key).orderBy(F.col("batch").desc())
    return res.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "batch")


def _write_batch(rows: DataFrame, out: str, epoch: int) -> None:
    """One folder per micro-batch, overwritten when the batch is retried."""
    rows.write.mode("overwrite").parquet(f"{out}/batch={epoch}")


def reindex_batch(batch: DataFrame, out: str, epoch: int) -> None:
    """H2 micro-batch: postings of the new passages' chunks, and the number of chunks and
    of terms they add, so that df, N and the average length follow from the tables. Passages are
    dealt to all tasks first: a file may be one row group."""
    n = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    idx = R.bm25_index(R.chunk_windows(batch.select("doc_id", "text").repartition(n)), keep=False)
    _write_batch(idx.postings.select("doc_id", "pos", "term", "tf", "dl"), f"{out}/postings", epoch)
    _write_batch(idx.stats.select("n_chunks", (F.col("avgdl") * F.col("n_chunks")).alias("n_terms")), f"{out}/stats", epoch)


def run_reindex(spark: SparkSession, docs: DataFrame, path: str | None = None) -> R.BM25Index:
    """Index a stream of passages and return the index over all batches so far."""
    out = path or scratch_path(spark, f"stream-reindex-{uuid.uuid4().hex[:12]}")
    q = (docs.writeStream.foreachBatch(lambda b, e: reindex_batch(b, out, e))
             .option("checkpointLocation", out.rstrip("/") + "-checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    postings = spark.read.parquet(f"{out}/postings").drop("batch")
    stats = spark.read.parquet(f"{out}/stats").agg(
        F.sum("n_chunks").alias("n_chunks"), (F.sum("n_terms") / F.sum("n_chunks")).alias("avgdl"))
    return R.BM25Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats)
