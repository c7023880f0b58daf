"""A campaign's ledger as a stream: ingest once per key, and live views of progress.

Campaigns are finite, so keys are remembered for the whole campaign without a watermark;
the state store holds one entry per condition. Checkpoints and sinks belong in the folder
shared by the cluster (``session.work_folder``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from effectlab.operators.audit import remaining
from effectlab.operators.describe import missingness
from effectlab.schema import LEDGER_SCHEMA, Names
from effectlab.sources.ledger import LEDGER_ORDER


def stream_ledger(
    spark: SparkSession, source: str, schema: T.StructType = LEDGER_SCHEMA, file_format: str = "json", pattern: str = "*", files_per_batch: int | None = None, placed: bool = False
) -> DataFrame:
    """Ledger files below ``source`` as a stream, also in folders that appear later; if
    ``placed``, with the columns of the ledger order."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.format(file_format).load(source)
    return _placed(rows) if placed else rows


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of a file stream with the columns of the ledger order: file, block, and the turn
    of the row in its task, which reads a block from its begin to its end."""
    told = rows.select("*", F.col("_metadata.file_path").alias(LEDGER_ORDER[0]), F.col("_metadata.file_block_start").alias(LEDGER_ORDER[1]))
    names = [*told.columns, LEDGER_ORDER[2]]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(at, at + batch.num_rows), pa.int64())], names)
            at += batch.num_rows

    return told.mapInArrow(number, T.StructType([*told.schema.fields, T.StructField(LEDGER_ORDER[2], T.LongType())]))


def first_arrivals(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first arrival of every key of a stream, in update mode: the least row in ``order``,
    nulls first, of the first batch that has the key. The state holds a row per key and the
    first and last time of the batches that had it: a key is new if both are this batch's, also
    after the clock was set back. Batches are told apart by their start in milliseconds."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    now = F.current_timestamp()  # one value in all of a batch, also when it is run again
    least = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order]))
    told = rows.withColumn("_came", now).groupBy(*keys).agg(least.alias("_row"), F.min("_came").alias("_since"), F.max("_came").alias("_until"))
    return told.where((F.col("_since") == now) & (F.col("_until") == now)).select("_row.*")


def ingest(rows: DataFrame, destination: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = (), available_now: bool = True) -> StreamingQuery:
    """Append rows to a Parquet table, the first arrival of every key only. Rows that a batch
    has of a new key are told apart by ``order``, by default the ledger order. Each batch writes
    a folder of its own, so a repeated batch replaces only itself; read back, the table has the
    number of the ``batch`` as one more column."""
    order = list(order) or [c for c in LEDGER_ORDER if c in rows.columns]
    if not order:
        raise ValueError("first arrivals need an order of the rows")

    def publish(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{destination}/batch={batch}")

    writer = first_arrivals(rows, keys, order).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_ledger(
    spark: SparkSession, source: str, destination: str, checkpoint: str, names: Names = Names.ledger(), pattern: str = "results.jsonl"
) -> StreamingQuery:
    """Ingest everything that is there now, exactly once per condition; run again to go on."""
    return ingest(stream_ledger(spark, source, pattern=pattern, placed=True), destination, checkpoint, names.key)


def live_missingness(
    rows: DataFrame, destination: str, checkpoint: str, names: Names = Names(), available_now: bool = True
) -> StreamingQuery:
    """Keep the missingness table of a running campaign up to date at ``destination``.

    The table has one row per arm and dose. Each batch writes a folder of its own, so a
    repeated batch replaces only itself; read the latest with :func:`latest_version`.
    """

    def publish(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{destination}/version={batch}")

    writer = missingness(rows, names).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_remaining(
    rows: DataFrame, plan: DataFrame, destination: str, checkpoint: str, keys: Sequence[str], available_now: bool = True, compact_every: int = 20
) -> StreamingQuery:
    """Keep the planned conditions that have not arrived yet at ``destination``.

    The plan is written once and never again: a batch appends the keys that it brought to a
    log, so it costs what has arrived. Every ``compact_every`` batches the log's parts since
    the last time are made into one table of distinct keys. A repeated batch writes its own
    part again. Read the result with :func:`still_open`.
    """
    spark, keys = rows.sparkSession, list(keys)
    try:
        spark.read.schema(plan.schema).parquet(f"{destination}/plan").take(1)
    except AnalysisException:
        plan.write.mode("overwrite").parquet(f"{destination}/plan")
    kinds = ", ".join(f"`{c}` {plan.schema[c].dataType.simpleString()}" for c in keys)

    def publish(batch_rows: DataFrame, batch: int) -> None:
        session = batch_rows.sparkSession
        came = batch_rows.select(*[F.col(c).cast(plan.schema[c].dataType) for c in keys]).distinct()
        came.write.mode("overwrite").parquet(f"{destination}/arrived/batch={batch}")
        if (batch + 1) % compact_every == 0:
            parts = [f"{destination}/arrived/batch={i}" for i in range(batch + 1 - compact_every, batch + 1)]
            session.read.schema(kinds).parquet(*parts).distinct().write.mode("overwrite").parquet(f"{destination}/compact/upto={batch}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def still_open(spark: SparkSession, destination: str, keys: Sequence[str]) -> DataFrame:
    """Planned conditions less all arrivals: the compacted tables and the log after them."""
    plan, keys = spark.read.parquet(f"{destination}/plan"), list(keys)
    kinds = ", ".join(f"`{c}` {plan.schema[c].dataType.simpleString()}" for c in keys)

    def table(part: str, number: str) -> DataFrame | None:
        try:
            return spark.read.schema(f"{kinds}, {number} bigint").parquet(f"{destination}/{part}")
        except AnalysisException:
            return None

    compact, log = table("compact", "upto"), table("arrived", "batch")
    if log is None:
        return plan
    if compact is not None:
        done = compact.agg(F.coalesce(F.max("upto"), F.lit(-1)))
        log = log.where(F.col("batch") > done.scalar()).drop("batch").unionByName(compact.drop("upto"))
    return remaining(plan, log.select(*keys), keys)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The last table published below ``path``."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("v"))
    return versions.withColumn("_newest", newest.scalar()).where(F.col("version") == F.col("_newest")).drop("_newest", "version")
