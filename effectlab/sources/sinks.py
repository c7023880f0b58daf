"""Sinks: evidence tables, strict audits, attestations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectlab.functions.keys import content_sha256
from effectlab.functions.numeric import json_safe


def write_analysis(tables: Mapping[str, DataFrame], audit: DataFrame, out: str, file_format: str = "csv") -> dict[str, str]:
    """One folder per table below ``out``, and the audit as JSON without NaN or infinity.

    The audit is written last: its presence says that the tables are whole.
    """
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{out}/{name}"
        writer = df.write.mode("errorifexists")
        if file_format == "csv":
            writer.option("header", True).csv(paths[name])
        else:
            writer.format(file_format).save(paths[name])
    paths["audit"] = f"{out}/audit"
    json_safe(audit).repartition(1).write.mode("errorifexists").option("ignoreNullFields", False).json(paths["audit"])
    return paths


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An evidence table with its declared types; an absent or empty one has no rows."""
    try:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise


def attest(items: DataFrame, ledger: str, content: str = "content") -> DataFrame:
    """Append one attestation per item: its columns, the hash of its content, the time.

    The content is already durable where it was read from. Returns what was appended.
    """
    rows = items.withColumn("sha256", content_sha256(content)).drop(content).withColumns(
        {"schema_version": F.lit("1.0"), "generated_at_utc": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")}
    )
    rows.write.mode("append").option("ignoreNullFields", False).json(ledger)
    return rows
