"""Result ledgers: append-only JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectlab.schema import ATTESTATION_SCHEMA, LEDGER_SCHEMA

LEDGER_FILE = "results.jsonl"
BAD = "_corrupt_record"

# The position of a line in its ledger: block offset within the file, then the order in
# which the lines of a block are read.
LEDGER_ORDER = ("source_file", "block_start", "seq")


def _lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Every line below ``root`` with its place. Files are split as usual, so a ledger of
    any size is read in parallel and its order is still known."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    if not root.endswith((".jsonl", ".json")):
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(root).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return lines.where(F.trim("value") != "").withColumn("_row", F.from_json("value", full, options))


def _tails(lines: DataFrame) -> DataFrame:
    """Files whose last line has no line break, with the place of that line.

    Every line but such a last one is followed by one byte, so the bytes of the lines and
    their breaks exceed the file size by one exactly when the last break is missing.
    """
    per_file = lines.groupBy("source_file").agg(
        F.sum(F.octet_length("value").cast("bigint") + 1).alias("_bytes"),
        F.max("_size").alias("_file_size"),
        F.max(F.struct("block_start", "seq")).alias("_last"),
    )
    return per_file.where(F.col("_bytes") == F.col("_file_size") + 1).select("source_file", "_last")


def malformed_lines(spark: SparkSession, root: str, pattern: str = LEDGER_FILE, schema: T.StructType = LEDGER_SCHEMA) -> DataFrame:
    """Lines that are not valid rows: ``source_file, block_start, seq, value,
    is_tail_fragment``; only the unterminated end of a file is a tail fragment."""
    lines = _lines(spark, root, pattern)
    bad = _parsed(lines, schema).where(F.col(f"_row.{BAD}").isNotNull() | F.col("_row").isNull()).drop("_row", "_size")
    joined = bad.join(_tails(lines), "source_file", "left")
    place = F.struct("block_start", "seq")
    return joined.withColumn("is_tail_fragment", F.coalesce(place == F.col("_last"), F.lit(False))).drop("_last")


def read_ledger(
    spark: SparkSession,
    root: str,
    repair_tail: bool = True,
    pattern: str = LEDGER_FILE,
    schema: T.StructType = LEDGER_SCHEMA,
) -> DataFrame:
    """All ledger rows below a file or folder, tagged with their ``run`` (the folder).

    A malformed line is an error when it is read, except an unterminated last fragment
    (an interrupted write), which is left out when ``repair_tail`` is set. The columns
    of ``LEDGER_ORDER`` give the ledger order; no files give an empty table.
    """
    lines = _lines(spark, root, pattern)
    parsed = _parsed(lines, schema)
    bad = F.col("_row").isNull() | F.col(f"_row.{BAD}").isNotNull()
    if repair_tail:
        parsed = parsed.join(_tails(lines), "source_file", "left")
        fragment = F.coalesce(F.struct("block_start", "seq") == F.col("_last"), F.lit(False))
    else:
        fragment = F.lit(False)
    message = F.concat(F.lit("malformed result row in "), F.col("source_file"), F.lit(": "), F.substring("value", 1, 200))
    keep = F.when(~bad, F.lit(True)).when(fragment, F.lit(False)).otherwise(F.raise_error(message).cast("boolean"))
    return parsed.where(keep).select(
        *[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields],
        F.regexp_replace("source_file", "/[^/]*$", "").alias("run"),
        *LEDGER_ORDER,
    )


def read_attestations(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Attestation records in ledger order (see ``latest_attestation``)."""
    return read_ledger(spark, root, False, pattern, ATTESTATION_SCHEMA)
