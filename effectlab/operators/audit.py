"""Audits of a ledger against its plan, its manifest and the objects it refers to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.functions.numeric import flag
from effectlab.functions.ordering import first_per_key
from effectlab.schema import Names
from effectlab.session import written


def condition_matrix(units: DataFrame, doses: Mapping[str, Sequence[float]], names: Names = Names()) -> DataFrame:
    """Every unit at every dose of every arm. The dose lists are design parameters and
    are expanded inside each unit's row, without a join."""
    cells = [
        F.struct(F.lit(arm).alias(names.arm), F.lit(dose).alias(names.dose)) for arm, grid in doses.items() for dose in grid
    ]
    return units.select(names.unit).distinct().select(names.unit, F.inline(F.array(*cells)))


def key_audit(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are ``missing``, ``extra`` or ``duplicate``, with their row counts.

    Both sides are reduced to one row per key before a single full join.
    """
    seen = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    planned = expected.select(*keys).distinct().withColumn("_planned", F.lit(True))
    both = seen.join(planned, list(keys), "full")
    problems = F.array_compact(
        F.array(
            F.when(F.col("n_rows").isNull(), F.lit("missing")),
            F.when(F.col("_planned").isNull(), F.lit("extra")),
            F.when(F.col("n_rows") > 1, F.lit("duplicate")),
        )
    )
    return both.select(
        *keys, F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), F.explode(problems).alias("problem")
    )


def remaining(plan: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned conditions the ledger does not have yet."""
    return plan.join(ledger.select(*keys), list(keys), "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Units present on both sides, which a disjoint design does not allow."""
    return a.select(key).intersect(b.select(key))


def missing_refs(ledger: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Distinct referenced paths that the listing lacks; a null reference is missing."""
    present = listing.select(F.col(path).alias("_present"))
    gone = ledger.select(path).join(present, F.col(path) == F.col("_present"), "left_anti")
    return gone.distinct()


def hash_mismatches(recorded: DataFrame, observed: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """Recorded content hashes that are absent, or differ from the observed content."""
    found = observed.select(key, F.col(digest).alias("_found"))
    joined = recorded.select(key, digest).join(found, key, "left")
    reason = (
        F.when(F.col(digest).isNull() | (F.col(digest) == ""), F.lit("no_recorded_hash"))
        .when(F.col("_found").isNull(), F.lit("object_missing"))
        .when(F.col(digest) != F.col("_found"), F.lit("hash_mismatch"))
    )
    return joined.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


def metadata_mismatches(observed: DataFrame, expected: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``(key, field, observed, expected)`` for every field that differs, null-safely."""

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields]
        return df.select(key, F.inline(F.array(*cells)))

    joined = long(expected, "expected").join(long(observed, "observed"), [key, "field"], "left")
    return joined.where(~F.col("observed").eqNullSafe(F.col("expected"))).select(key, "field", "observed", "expected")


def with_baseline(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("unit",), names: Names = Names()
) -> DataFrame:
    """Attach ``baseline_<column>`` of the group's dose-0 row to every other row."""
    base = df.where(F.col(names.dose) == 0).select(*keys, *[F.col(c).alias(f"baseline_{c}") for c in columns])
    one = first_per_key(base, list(keys), [f"baseline_{c}" for c in columns])
    return df.where(F.col(names.dose) != 0).join(one, list(keys))


def fingerprint_audit(df: DataFrame, expected: str | Column, column: str = "config_fingerprint") -> DataFrame:
    """Whether the fingerprints of a ledger are exactly the expected one."""
    wanted = F.lit(expected) if isinstance(expected, str) else expected
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    foreign = ~F.col(column).eqNullSafe(wanted)
    facts = counted.agg(
        F.count(F.lit(1)).alias("n_fingerprints"),
        F.coalesce(F.sum(F.when(foreign, F.col("n"))), F.lit(0)).alias("foreign_rows"),
        F.count_if(~foreign).alias("_own"),
    )
    return facts.select(
        "n_fingerprints", "foreign_rows", ((F.col("_own") == 1) & (F.col("n_fingerprints") == 1)).alias("passed")
    )


def analysis_audit(
    ledger: DataFrame, expected: DataFrame, matched: DataFrame, contrasts: DataFrame, names: Names = Names()
) -> DataFrame:
    """One row of counts over the tables of an analysis."""

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    counts = ledger.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_distinct(names.unit).alias("unique_units")
    )
    return (
        counts.withColumn("expected_conditions", size(expected, "n").scalar())
        .withColumn("matched_rows", size(matched, "n").scalar())
        .withColumn("contrast_rows", size(contrasts, "n").scalar())
    )


# The checks of a run, in the order of the report.
RUN_CHECKS = (
    "exact_condition_keys", "row_count", "result_fingerprint", "result_study_id", "all_generations_complete",
    "manifest_rows", "manifest_fingerprint", "manifest_study_id", "manifest_study_status", "manifest_execution_mode",
    "manifest_condition_count", "manifest_seed_set", "all_referenced_images_present", "direction_tensors_present",
    "archived_config_fingerprint",
)
_FACT = "kind string, key string, detail string, here bigint, there bigint"


def _fact(kind: str, key: Column, detail: Column | None = None, here: int = 1, there: int = 0) -> Column:
    """One entry of the table of facts; ``here`` and ``there`` count its two sides."""
    text = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), text.alias("detail"), F.lit(here).cast("bigint").alias("here"), F.lit(there).cast("bigint").alias("there"))


def _facts(df: DataFrame, *entries: Column) -> DataFrame:
    """The entries of every row that are not null."""
    return df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def _run_facts(
    ledger: DataFrame, plan: DataFrame, manifest: DataFrame, manifest_units: DataFrame, expected: Mapping[str, str],
    listing: DataFrame, directions: DataFrame, names: Names, path: str,
) -> DataFrame:
    """Every input read once: its keys, paths and units to be matched, and what its rows
    violate by themselves, counted by (kind, key, detail) before anything is moved."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in names.key]
    key = F.to_json(F.array(*texts))
    fits = lambda c: F.col(c).eqNullSafe(F.lit(expected[c]))
    found = _facts(
        ledger,
        _fact("key", key),
        F.when(F.col(path).isNotNull(), _fact("path", F.col(path))),
        F.when(F.col(path).isNull(), _fact("all_referenced_images_present", key, F.lit("no path"))),
        F.when(~fits("config_fingerprint"), _fact("result_fingerprint", key, F.col("config_fingerprint"))),
        F.when(~fits("study_id"), _fact("result_study_id", key, F.col("study_id"))),
        F.when(~flag(names.generated), _fact("all_generations_complete", key)),
    )
    unit = F.coalesce(F.col(names.unit).cast("string"), F.lit("null"))
    differs = lambda check, c, wanted: F.when(~F.col(c).eqNullSafe(F.lit(wanted)), _fact(check, F.lit("manifest"), F.col(c)))
    parts = (
        found,
        _facts(plan, _fact("key", key, None, 0, 1), _fact("unit", unit)),
        _facts(manifest_units, _fact("unit", unit, None, 0, 1)),
        _facts(listing, F.when(F.col(path).isNotNull(), _fact("path", F.col(path), None, 0, 1))),
        _facts(
            manifest,
            _fact("manifest_rows", F.lit("manifest")),
            _fact("manifest_condition_count", F.lit("manifest"), F.col("condition_count")),
            differs("manifest_fingerprint", "config_fingerprint", expected["config_fingerprint"]),
            differs("manifest_study_id", "study_id", expected["study_id"]),
            differs("manifest_study_status", "study_status", expected["study_status"]),
            differs("manifest_execution_mode", "execution_mode", "confirmatory"),
        ),
        _facts(directions, _fact("direction_tensors_present", F.lit("directions"))),
    )
    facts = reduce(DataFrame.unionByName, parts)
    return facts.groupBy("kind", "key", "detail").agg(F.sum("here").alias("here"), F.sum("there").alias("there"))


def _judged(facts: DataFrame) -> DataFrame:
    """Offenders ``check, key, detail, n`` of the counted facts. What is known only of whole
    tables (their sizes) is in rows of the check ``_size``."""
    here, there = F.col("here"), F.col("there")
    by_key = ("key", "all_referenced_images_present", "result_fingerprint", "result_study_id", "all_generations_complete")
    shown = F.when(F.col("kind").isin(*by_key), F.array_join(F.from_json("key", "array<string>"), "/")).otherwise(F.col("key"))

    def entry(check: str | Column, detail: Column | str, n: Column, key: Column = shown) -> Column:
        name = F.lit(check) if isinstance(check, str) else check
        text = F.lit(detail) if isinstance(detail, str) else detail
        return F.struct(name.alias("check"), key.alias("key"), text.cast("string").alias("detail"), n.cast("bigint").alias("n"))

    one, of = F.lit(1), lambda kind: F.col("kind") == kind
    entries = (
        F.when(of("key") & (here == 0), entry("exact_condition_keys", "missing", one)),
        F.when(of("key") & (there == 0), entry("exact_condition_keys", "extra", one)),
        F.when(of("key") & (here > 1), entry("exact_condition_keys", "repeated", one)),
        F.when(of("key"), entry("_size", "rows", here, F.lit("rows"))),
        F.when(of("key") & (there > 0), entry("_size", "planned", one, F.lit("planned"))),
        F.when(of("unit") & (here == 0), entry("manifest_seed_set", "not planned", one)),
        F.when(of("unit") & (there == 0), entry("manifest_seed_set", "not in the manifest", one)),
        F.when(of("path") & (here > 0) & (there == 0), entry("all_referenced_images_present", "absent", one)),
        F.when(of("manifest_rows") | of("direction_tensors_present"), entry("_size", F.col("kind"), here, F.col("kind"))),
        F.when(of("manifest_condition_count"), entry("_count", F.col("detail"), here)),
        F.when(~F.col("kind").isin("key", "unit", "path", "manifest_rows", "manifest_condition_count", "direction_tensors_present"), entry(F.col("kind"), F.col("detail"), here)),
    )
    return facts.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def _whole(judged: DataFrame, expected: Mapping[str, str], archived_fingerprint: str, n_directions: int) -> DataFrame:
    """Offenders that follow from the sizes of whole tables, from one row of sums."""
    size = lambda name: F.coalesce(F.sum(F.when((F.col("check") == "_size") & (F.col("key") == name), F.col("n"))), F.lit(0))
    counts = F.collect_set(F.when(F.col("check") == "_count", F.struct(F.col("detail").alias("value"), F.col("n").alias("n"))))
    sums = judged.where("check IN ('_size', '_count')").agg(*[size(c).alias(c) for c in ("rows", "planned", "manifest_rows", "direction_tensors_present")], counts.alias("counts"))
    c = F.col

    def entry(check: str, key: Column | str, detail: Column | str | None, n: Column) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(check).alias("check"), lit(key).cast("string").alias("key"), lit(detail).cast("string").alias("detail"), n.cast("bigint").alias("n"))

    wrong = F.filter("counts", lambda x: ~x["value"].eqNullSafe(c("planned").cast("string")))
    entries = F.array(
        F.when(c("rows") != c("planned"), entry("row_count", "ledger", F.concat(c("rows").cast("string"), F.lit(" of "), c("planned").cast("string")), F.abs(c("rows") - c("planned")))),
        F.when(c("rows") == 0, entry("result_fingerprint", "ledger", "no rows", F.lit(1))),
        F.when(c("rows") == 0, entry("result_study_id", "ledger", "no rows", F.lit(1))),
        F.when(c("manifest_rows") != 1, entry("manifest_rows", "manifest", c("manifest_rows"), F.abs(c("manifest_rows") - 1))),
        F.when(c("direction_tensors_present") != n_directions, entry("direction_tensors_present", "directions", c("direction_tensors_present"), F.abs(c("direction_tensors_present") - n_directions))),
        F.when(F.lit(archived_fingerprint != expected["config_fingerprint"]), entry("archived_config_fingerprint", "archived", archived_fingerprint, F.lit(1))),
    )
    counted = F.transform(wrong, lambda x: entry("manifest_condition_count", "manifest", x["value"], x["n"]))
    return sums.select(F.inline(F.filter(F.concat(entries, counted), lambda e: e.isNotNull())))


def run_offenders(
    ledger: DataFrame,
    plan: DataFrame,
    manifest: DataFrame,
    manifest_units: DataFrame,
    expected: Mapping[str, str],
    listing: DataFrame,
    directions: DataFrame,
    archived_fingerprint: str,
    names: Names = Names(),
    path: str = "image_path",
    n_directions: int = 2,
) -> DataFrame:
    """Every violation of a run's integrity: ``check, key, detail, n``.

    ``plan`` is the planned condition matrix, ``manifest`` the run's manifest rows (one is
    right, and each is checked), ``manifest_units`` the units it lists, one per row
    (``sources.manifest.run_units``), ``expected`` names ``config_fingerprint, study_id,
    study_status``, ``listing`` holds the paths of present objects, ``directions`` those of
    direction tensors. A key is the condition, path or unit that offends, the detail how or
    with what value, and ``n`` the rows that do. Each input is scanned once; the counted
    facts are kept as a table, since lists and sizes are read from them.
    """
    facts = written(_run_facts(ledger, plan, manifest, manifest_units, expected, listing, directions, names, path), "run-facts")
    judged = _judged(facts)
    return judged.where("check NOT IN ('_size', '_count')").unionByName(_whole(judged, expected, archived_fingerprint, n_directions))


def run_audit(
    ledger: DataFrame,
    plan: DataFrame,
    manifest: DataFrame,
    manifest_units: DataFrame,
    expected: Mapping[str, str],
    listing: DataFrame,
    directions: DataFrame,
    archived_fingerprint: str,
    names: Names = Names(),
    path: str = "image_path",
    n_directions: int = 2,
) -> DataFrame:
    """The integrity checks of one run: ``check, passed, n_violations, sample``, one row for
    each of ``RUN_CHECKS``; arguments as in :func:`run_offenders`, which lists all."""
    return checks_of(run_offenders(ledger, plan, manifest, manifest_units, expected, listing, directions, archived_fingerprint, names, path, n_directions))


def checks_of(offenders: DataFrame) -> DataFrame:
    """The verdict of every check over a table of offenders. A sample is the least value that
    offends, or the least key where there is none but the kind of offence."""
    by_value = F.col("check").isin("result_fingerprint", "result_study_id", "manifest_rows", "manifest_fingerprint", "manifest_study_id", "manifest_study_status", "manifest_execution_mode", "manifest_condition_count", "direction_tensors_present")
    sums = offenders.groupBy("check").agg(F.sum("n").alias("n_violations"), F.min(F.when(by_value, F.col("detail")).otherwise(F.col("key"))).alias("sample"))
    listed = offenders.sparkSession.createDataFrame([(c,) for c in RUN_CHECKS], "check string")
    joined = listed.join(sums, "check", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
    return joined.select("check", (F.col("n_violations") == 0).alias("passed"), "n_violations", "sample")


def run_passed(checks: DataFrame) -> DataFrame:
    """One row: how many checks there are, how many fail, and the verdict."""
    return checks.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("passed")
    )


def source_profile(rows: DataFrame, contents: DataFrame, path: str = "source_path", fingerprint: str = "config_fingerprint") -> DataFrame:
    """Per input file: content hash, row count and number of distinct fingerprints."""
    counted = rows.groupBy(path).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(fingerprint).alias("n_fingerprints")
    )
    hashed = contents.select(path, F.sha2(F.col("content"), 256).alias("sha256"))
    return hashed.join(counted, path, "left").select(
        path, "sha256",
        F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        F.coalesce("n_fingerprints", F.lit(0).cast("bigint")).alias("n_fingerprints"),
    )


def source_fingerprints(rows: DataFrame, path: str = "source_path", fingerprint: str = "config_fingerprint") -> DataFrame:
    """The distinct fingerprints of each input file, one per row, with their counts."""
    return rows.where(F.col(fingerprint).isNotNull()).groupBy(path, fingerprint).agg(F.count(F.lit(1)).alias("rows"))
