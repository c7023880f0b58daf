"""Design contracts as data: one row per study and broken rule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.functions.keys import CYCLE_STEP, ZERO_DOSE

# Study states, metrics every study must require, and gate names.
STATUSES = ("pilot", "planned", "calibration", "preregistered")
REQUIRED_METRICS = ("skin_tone_change", "face_similarity")
GATES = (
    "min_detection_rate",
    "min_pair_order_accuracy",
    "min_median_pair_gap_ita",
    "max_median_abs_ita_shift",
    "max_p95_abs_ita_shift",
)
MUTABLE_REVISIONS = ("main", "latest", "null", "none")


@dataclass(frozen=True)
class DesignTables:
    """A design in normal form, many studies side by side; all tables have ``study``.

    studies: status, height, width, inference_steps, train_pairs, held_out_pairs,
      resamples, confidence, tolerance, reference_arm
    units: unit; data_units: position, unit (the base schedule of direction data)
    doses: arm, dose; roles: arm, role ('matched' or 'feasibility')
    levels: level_key; metrics: metric; gates: gate, value; perturbations: name
    """

    studies: DataFrame
    units: DataFrame
    data_units: DataFrame
    doses: DataFrame
    roles: DataFrame
    levels: DataFrame
    metrics: DataFrame
    gates: DataFrame
    perturbations: DataFrame


def extended_data_units(t: DesignTables) -> DataFrame:
    """The base schedule continued to the number of pairs: cycle c adds c * 10000."""
    sized = t.data_units.groupBy("study").agg(F.count(F.lit(1)).alias("n"))
    pairs = t.studies.select("study", (F.col("train_pairs") + F.col("held_out_pairs")).alias("pairs"))
    joined = t.data_units.join(sized, "study").join(pairs, "study").where(F.col("position") < F.col("pairs"))
    steps = F.explode(F.sequence(F.col("position").cast("bigint"), F.col("pairs").cast("bigint") - 1, F.col("n")))
    return joined.select("study", "unit", "n", steps.alias("i")).select(
        "study", (F.col("unit") + F.floor(F.col("i") / F.col("n")) * CYCLE_STEP).alias("unit")
    )


def _entry(kind: str, a: Column, b: Column | None = None, here: int = 1, there: int = 0) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), a.cast("string").alias("a"), (none if b is None else b.cast("string")).alias("b"),
        F.lit(here).cast("bigint").alias("here"), F.lit(there).cast("bigint").alias("there"),
    )


def _design_facts(t: DesignTables, target_arm: str) -> DataFrame:
    """The rows of all tables as counted (study, kind, a, b), each table read once. ``there``
    counts what must be matched by the same entry of another table."""
    c = F.col
    level = F.when((c("arm") == target_arm) & (F.abs("dose") >= ZERO_DOSE), _entry("level", c("dose").cast("decimal(9,4)"), None, 0, 1))
    tables = (
        (t.units, [_entry("unit", c("unit"))]),
        (t.data_units, [_entry("data", c("unit"))]),
        (t.doses, [_entry("dose", c("arm"), c("dose").cast("double")), level]),
        (t.roles, [_entry("role", c("arm"), c("role"))]),
        (t.studies, [_entry("reference", c("reference_arm"))]),
        (t.levels, [_entry("level", c("level_key").try_cast("decimal(9,4)"))]),
        (t.metrics, [_entry("metric", c("metric"))]),
        (t.gates, [_entry("gate", c("gate"), c("value").cast("double"))]),
        (t.perturbations, [_entry("perturbation", c("name"))]),
    )
    parts = [df.select("study", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))) for df, entries in tables]
    return reduce(DataFrame.unionByName, parts).groupBy("study", "kind", "a", "b").agg(F.sum("here").alias("here"), F.sum("there").alias("there"))


def design_report(t: DesignTables, arms: Sequence[str], target_arm: str) -> DataFrame:
    """``(study, rule, violations)`` for every broken rule of every study.

    One union of all tables is folded by (study, kind, entry), then by (study, kind, arm or
    name), then by study; each rule is a count of that fold. Only the overlap of units with
    the schedule of direction data, which has to be continued first, is a join of its own.
    """
    c = F.col
    facts = _design_facts(t, target_arm)
    dose = F.when(c("kind") == "dose", c("b").cast("double"))
    role = F.when(c("kind") == "role", c("b"))
    named = facts.groupBy("study", F.when(c("kind") == "reference", F.lit("role")).otherwise(c("kind")).alias("kind"), "a").agg(
        F.sum("here").alias("n"),
        F.count_if((c("here") > 0) & (c("kind") != "reference")).alias("entries"),
        F.count_if((c("here") > 1) & (c("kind") != "reference")).alias("repeated"),
        F.sum(F.when(c("here") == 0, c("there")).otherwise(0)).alias("unmatched"),
        F.sum(F.when((c("kind") == "gate") & (c("b").cast("double") < 0), c("here")).otherwise(0)).alias("negative"),
        F.bool_or(dose == 0).alias("zero"), F.bool_or(dose < 0).alias("below"), F.bool_or(dose > 0).alias("above"),
        F.count(role).alias("roles"), F.bool_or(role == "matched").alias("matched"), F.bool_or(c("kind") == "reference").alias("reference"),
    )
    of = lambda kind: c("kind") == kind
    yes = lambda flag: F.coalesce(c(flag), F.lit(False))
    planned = c("a").isin(*arms)
    has_role = of("role") & (c("entries") > 0)
    n = {
        "units": F.count_if(of("unit")),
        "units_repeated": F.count_if(of("unit") & (c("n") > 1)),
        "data_units_repeated": F.count_if(of("data") & (c("n") > 1)),
        "arm_unsupported": F.count_if(of("dose") & ~planned),
        "arms_with_doses": F.count_if(of("dose") & planned),
        "doses_without_zero": F.count_if(of("dose") & ~yes("zero")),
        "one_sided": F.count_if(of("dose") & ~(yes("below") & yes("above"))),
        "doses_repeated": F.count_if(of("dose") & (c("n") > c("entries"))),
        "matched_arms": F.count_if(of("role") & yes("matched")),
        "roles_repeated": F.coalesce(F.sum(F.when(of("role"), c("repeated"))), F.lit(0)),
        "roles_overlap": F.count_if(of("role") & (c("roles") > 1)),
        "roles_unknown_arm": F.count_if(has_role & ~planned),
        "arms_with_roles": F.count_if(has_role & planned),
        "reference_matched": F.count_if(of("role") & yes("matched") & yes("reference")),
        "label_missing": F.coalesce(F.sum(F.when(of("level"), c("unmatched"))), F.lit(0)),
        "metrics": F.count_if(of("metric") & c("a").isin(*REQUIRED_METRICS)),
        "gates": F.count_if(of("gate") & c("a").isin(*GATES)),
        "gate_negative": F.coalesce(F.sum("negative"), F.lit(0)),
        "perturbations": F.count_if(of("perturbation")),
    }
    folded = named.groupBy("study").agg(*[count.alias(f"n_{name}") for name, count in n.items()])
    overlap = t.units.distinct().join(extended_data_units(t), ["study", "unit"], "left_semi").groupBy("study").agg(F.count(F.lit(1)).alias("n_overlap"))
    joined = t.studies.join(folded, "study", "left").join(overlap, "study", "left")
    count = lambda name: F.coalesce(c(f"n_{name}"), F.lit(0)).cast("bigint")
    flagged = lambda condition: F.when(condition, 1).otherwise(0).cast("bigint")
    rules: dict[str, Column] = {
        "status_unknown": flagged(~c("status").isin(*STATUSES) | c("status").isNull()),
        "sides_not_divisible_by_8": flagged((c("height") % 8 != 0) | (c("width") % 8 != 0)),
        "inference_steps_below_1": flagged(c("inference_steps") < 1),
        "pair_split_too_small": flagged((c("train_pairs") < 2) | (c("held_out_pairs") < 1)),
        "resamples_below_1000": flagged(c("resamples") < 1000),
        "confidence_out_of_range": flagged(~((c("confidence") > 0.5) & (c("confidence") < 1.0))),
        "tolerance_not_positive": flagged(~(c("tolerance") > 0) | c("tolerance").isNull()),
        "units_empty": flagged(count("units") == 0),
        "units_overlap_data": count("overlap"),
        "arm_without_doses": len(arms) - count("arms_with_doses"),
        "doses_one_sided": F.when(c("status") == "calibration", 0).otherwise(count("one_sided")).cast("bigint"),
        "roles_empty": flagged(count("matched_arms") == 0),
        "roles_incomplete": len(arms) - count("arms_with_roles"),
        "reference_not_matched": 1 - count("reference_matched"),
        "metric_not_required": len(REQUIRED_METRICS) - count("metrics"),
        "gate_missing": len(GATES) - count("gates"),
        "perturbations_empty": flagged(count("perturbations") == 0),
    }
    direct = ("units_repeated", "data_units_repeated", "arm_unsupported", "doses_without_zero", "doses_repeated", "roles_repeated", "roles_overlap", "roles_unknown_arm", "label_missing", "gate_negative")
    rules |= {name: count(name) for name in direct}
    cells = F.array(*[F.struct(F.lit(rule).alias("rule"), broken.alias("violations")) for rule, broken in rules.items()])
    return joined.select("study", F.inline(F.filter(cells, lambda cell: cell["violations"] > 0)))


def _report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(rule)) for rule, cond in rules.items()]))
    return df.select("study", F.explode(broken).alias("rule"))


def readiness_report(studies: DataFrame) -> DataFrame:
    """``(study, rule)`` for what keeps a study from a confirmatory run.

    ``studies``: status, n_targets, revision, report_sha256, manifest_sha256.
    """
    c = F.col
    return _report(
        studies,
        {
            "status_not_preregistered": c("status") != "preregistered",
            "no_matched_targets": ~(c("n_targets") > 0),
            "revision_mutable": c("revision").isNull() | (c("revision") == "") | F.lower("revision").isin(*MUTABLE_REVISIONS),
            "report_hash_not_frozen": c("report_sha256").isNull() | (F.length("report_sha256") != 64),
            "manifest_hash_not_frozen": c("manifest_sha256").isNull() | (F.length("manifest_sha256") != 64),
        },
    )


METADATA_FIELDS = ("model_id", "model_revision", "inference_steps", "guidance_scale", "height", "width")


def freeze_report(design: DataFrame, manifest: DataFrame, report: DataFrame, ledgers: DataFrame) -> DataFrame:
    """``(study, rule)`` for what forbids freezing a planned design.

    design: status, train_pairs, held_out_pairs, metric, and the metadata fields;
    manifest: n_pairs, observed_in_campaign, observed_in_run, ledger_path, ledger_sha256
    and the same fields; report: passed, metric, split, study_id;
    ledgers: path, sha256 of the ledgers that are present.
    """
    c = F.col
    m = manifest.select("study", *[c(x).alias(f"m_{x}") for x in manifest.columns if x != "study"])
    r = report.select("study", *[c(x).alias(f"r_{x}") for x in report.columns if x != "study"])
    found = ledgers.select(c("path").alias("m_ledger_path"), c("sha256").alias("l_sha256"))
    joined = design.join(m, "study", "left").join(r, "study", "left").join(found, "m_ledger_path", "left")
    rules = {
        "status_not_planned": c("status") != "planned",
        "pair_count_differs": c("m_n_pairs") != c("train_pairs") + c("held_out_pairs"),
        "generation_not_attested": ~(c("m_observed_in_campaign") & c("m_observed_in_run")),
        "ledger_missing": c("l_sha256").isNull(),
        "ledger_hash_differs": ~c("l_sha256").eqNullSafe(c("m_ledger_sha256")),
        "report_not_passed": ~c("r_passed"),
        "report_study_differs": c("r_study_id") != c("study").cast("string"),
        "report_metric_differs": c("r_metric") != c("metric"),
        "report_split_wrong": c("r_split") != "held_out_direction_pairs",
    }
    rules |= {f"metadata_{f}_differs": ~c(f"m_{f}").eqNullSafe(c(f)) for f in METADATA_FIELDS}
    return _report(joined, rules)
