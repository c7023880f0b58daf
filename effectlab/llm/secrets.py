"""Secret scans over a history of contents, with a ledger of what was scanned before.

Every version of a file or document is addressed by the SHA-256 of its text. A blob is
scanned once however many paths and versions hold it, and only by the (rule, version)
pairs that the ledger doesn't list for it; the findings are then joined back to all paths.
The work is DataFrame functions only: a pattern's matches and the text between them give
the spans as running sums of their lengths.

Shuffles: the distinct contents once, by address (copies are combined before it), then
addresses and findings, never texts. Joins back to paths are on an address that a hot
group of copies shares; they are plain joins, whose skewed side Spark splits.

Defined results: a null text is an empty one; repeated (path, version) rows each get their
findings; ties in a start are ordered by the rule's place in the list; a rule that is
absent from a text has no rows; an empty table gives no rows; other columns of the input
are kept by :func:`by_path` and :func:`redact`, except those named like one they add.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` whose ``group``
    has ``least`` characters or more. A changed rule needs a new ``version``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(pattern: str) -> str:
    """``pattern`` with every ASCII letter standing for both its cases."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in pattern)


ASSIGN = "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base rules, in the order of ties. Runs of one character class are maximal, so a least length can be part of their pattern.
BASE = (
    Rule("assign", ASSIGN, group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)

FINDINGS = "blob string, kind string, place int, start bigint, end bigint"


def address(text: str = "text") -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _pieces(rule: Rule, place: int, unseen: Column) -> Column:
    """For each match in order: characters before it since the last match, in it, and in its group."""
    pattern = F.lit(rule.pattern)
    gaps, whole = F.split("text", rule.pattern, -1), F.regexp_extract_all("text", pattern, F.lit(0))
    group = whole if rule.group == 0 else F.regexp_extract_all("text", pattern, F.lit(rule.group))
    measured = F.zip_with(
        F.zip_with(gaps, whole, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("match"))),
        group,
        lambda pair, value: F.struct(F.lit(place).alias("place"), pair["gap"].alias("gap"), pair["match"].alias("match"), F.length(value).alias("value")),
    )
    return F.when(unseen & F.col("text").rlike(rule.pattern), F.filter(measured, lambda m: m["match"].isNotNull()))


def scan(contents: DataFrame, rules: Sequence[Rule] = BASE, ledger: DataFrame | None = None) -> DataFrame:
    """Findings (blob, kind, place, start, end) of the rules not yet run on each blob.

    ``contents`` has ``blob`` and ``text``, repeats allowed; ``ledger`` has ``blob`` and
    ``rule`` (:attr:`Rule.key`). Positions count code points, the end is exclusive.
    """
    blobs = contents.select("blob", "text").groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is not None:
        past = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("past"))
        blobs = blobs.join(past, "blob", "left")
    todo = lambda rule: F.lit(True) if ledger is None else ~F.coalesce(F.array_contains("past", rule.key), F.lit(False))
    found = [F.coalesce(_pieces(rule, place, todo(rule)), F.array().cast("array<struct<place:int,gap:int,match:int,value:int>>")) for place, rule in enumerate(rules)]
    rows = blobs.select("blob", F.posexplode(F.concat(*found)).alias("n", "piece")).select("blob", "n", "piece.*")
    so_far = Window.partitionBy("blob", "place").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("place") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("place") + 1)
    end = F.sum(F.col("gap") + F.col("match")).over(so_far)
    spans = rows.withColumn("end", end).where(F.col("value") >= least)
    return spans.select("blob", kind.alias("kind"), "place", (F.col("end") - F.col("match")).alias("start"), "end")


def record(contents: DataFrame, rules: Sequence[Rule] = BASE, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after a scan of ``contents``: every (blob, rule) pair that has been run."""
    pairs = contents.select("blob").distinct().select("blob", F.explode(F.array(*[F.lit(r.key) for r in rules])).alias("rule"))
    return pairs if ledger is None else ledger.select("blob", "rule").union(pairs).distinct()


def update(contents: DataFrame, store: str, delivery: int, rules: Sequence[Rule] = BASE) -> DataFrame:
    """Scan what a delivery brings and the ledger in ``store`` lacks, and keep the outcome there.

    ``store`` holds the ledger and the findings as tables with one folder a delivery (numbered
    from 0); earlier deliveries are read, this one's folders are written, so a repeated
    delivery replaces only itself. Findings are written before the ledger says that a blob was
    scanned. Returns the findings of all blobs in the store, old and new.
    """
    spark = contents.sparkSession
    past = [f"{store}/ledger/delivery={i}" for i in range(delivery)]
    ledger = spark.read.schema("blob string, rule string").parquet(*past) if past else None
    scan(contents, rules, ledger).write.mode("overwrite").parquet(f"{store}/findings/delivery={delivery}")
    fresh = record(contents, rules)
    fresh = fresh if ledger is None else fresh.join(ledger, ["blob", "rule"], "left_anti")
    fresh.write.mode("overwrite").parquet(f"{store}/ledger/delivery={delivery}")
    return spark.read.schema(FINDINGS).parquet(*(f"{store}/findings/delivery={i}" for i in range(delivery + 1)))


def by_path(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each finding in each version that holds the blob (column ``blob``)."""
    added = [c for c in findings.columns if c != "blob"]
    return versions.drop(*added).join(findings, "blob")


def redact(docs: DataFrame, findings: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span, and spans that touch or overlap as one, replaced by ``mark``."""
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(0))
    islands = findings.select("blob", "start", "end", fresh.alias("_new")).withColumn("_island", F.sum("_new").over(upto))
    spans = islands.groupBy("blob", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = spans.groupBy(F.col("blob").alias("_blob")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    joined = docs.withColumn("_blob", address(text)).join(cuts, "_blob", "left")
    body, n = F.col(text), F.size("_cuts")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_cuts", i - 1)["end"])
    stop = lambda i: F.when(i == n, F.length(body)).otherwise(F.get("_cuts", i)["start"])
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(body, (begin(i) + 1).cast("int"), (stop(i) - begin(i)).cast("int")))
    return joined.withColumn(text, F.when(F.col("_cuts").isNull(), body).otherwise(F.array_join(kept, mark))).drop("_blob", "_cuts")


def digest(findings: DataFrame, rules: Sequence[Rule] = BASE) -> DataFrame:
    """One row a blob: counts ``n_<kind>`` and ``spans``, kind:start:end in order, comma-joined."""
    spans = F.array_sort(F.collect_list(F.struct("start", "place", "kind", "end")))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules]
    return findings.groupBy("blob").agg(*counts, text.alias("spans"))


def _sql_rule(rule: Rule, place: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, i, len(gaps[i]) AS gap, len(found[i]) AS found, len(vals[i]) AS val
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS found,
                     regexp_extract_all(t, '{pattern}', {rule.group}) AS vals FROM d))"""


#: The digest of the base rules in SQL.
SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), pieces AS ("
    + reduce(lambda a, b: f"{a} UNION ALL {b}", [_sql_rule(r, i) for i, r in enumerate(BASE)])
    + """
), ends AS (
  SELECT *, sum(gap + found) OVER (PARTITION BY doc_id, place ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM pieces
), spans AS (
  SELECT doc_id, place, kind, CAST(stop - found AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM ends WHERE place > 0 OR val >= 6
), told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)"""
)
