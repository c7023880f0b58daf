"""Manifests: paired items, runs and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectlab.schema import PAIR_MANIFEST_SCHEMA, RUN_MANIFEST_SCHEMA, RUN_METADATA_SCHEMA, RUN_METRICS


def read_pair_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_MANIFEST_SCHEMA).option("multiLine", True).json(path)


def read_run_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_MANIFEST_SCHEMA).option("multiLine", True).json(path)


def run_units(manifest: DataFrame, unit: str = "seed") -> DataFrame:
    """The units a run manifest lists, one per row."""
    return manifest.select(F.explode("execution_seeds").alias(unit))


def explode_pairs(df: DataFrame, n_train: int, n_holdout: int) -> DataFrame:
    """One row per pair, in manifest order, split by position: the first ``n_train`` are
    for training, the next ``n_holdout`` are held out; later pairs are not used."""
    others = [c for c in df.columns if c != "pairs"]
    rows = df.select(*others, F.posexplode("pairs").alias("position", "pair")).where(F.col("position") < n_train + n_holdout)
    split = F.when(F.col("position") < n_train, F.lit("train")).otherwise(F.lit("holdout"))
    return rows.select(
        *others,
        "position",
        F.col("pair.pair_id").alias("pair_id"),
        F.col("pair.seed").alias("seed"),
        *[F.col(f"pair.{g}.{f}").alias(f"{g}_{f}") for g in ("light", "dark") for f in ("descriptor", "path", "sha256")],
        split.alias("split"),
    )


def pair_images(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: ``group`` light and dark with path, descriptor and hash."""
    groups = [
        F.struct(
            F.lit(g).alias("group"), F.col(f"{g}_path").alias("path"),
            F.col(f"{g}_descriptor").alias("descriptor"), F.col(f"{g}_sha256").alias("sha256"),
        )
        for g in ("light", "dark")
    ]
    kept = [c for c in pairs.columns if not c.startswith(("light_", "dark_"))]
    return pairs.select(*kept, F.inline(F.array(*groups)))


def read_run_metadata(
    spark: SparkSession, root: str, default_method: str = "stepwise_masked", pattern: str = "metadata.json"
) -> DataFrame:
    """One row per entry of ``results`` in every metadata file below ``root``.

    The method of an entry falls back to the run's and then to the default.
    """
    runs = (
        spark.read.schema(RUN_METADATA_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(root)
        .withColumn("run", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))
    )
    rows = runs.select("run", "seed", F.col("method").alias("_run_method"), F.explode("results").alias("r"))
    return rows.select(
        "run",
        "seed",
        F.coalesce(F.col("r.method"), F.col("_run_method"), F.lit(default_method)).alias("method"),
        F.col("r.alpha").alias("alpha"),
        F.coalesce(F.col("r.evaluation_complete"), F.lit(False)).alias("evaluation_complete"),
        *[F.col(f"r.{m}").alias(m) for m in RUN_METRICS],
    )
