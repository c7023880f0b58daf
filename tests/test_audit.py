"""Keys, scalars, sources, evidence and design rules on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlab.functions import keys as k
from effectlab.functions.numeric import json_safe, missing_required
from effectlab.operators import attest, audit, evidence
from effectlab.schema import CONTRAST_SCHEMA, Names
from effectlab.sources import images, ledger, manifest, sinks
from effectlab.streaming import ledger as live

LEDGER = Names.ledger()


def test_dose_slugs(spark):
    df = spark.createDataFrame([(0.75,), (-0.75,), (0.0,)], "d double")
    assert [r[0] for r in df.select(k.dose_slug("d")).collect()] == ["p0p750", "m0p750", "p0p000"]
    assert df.select(k.condition_path(F.lit(7), F.lit("m"), "d")).first()[0] == "images/seed_7/m/alpha_p0p750.png"


def test_units_extend_without_repeats(spark):
    got = [r[0] for r in spark.range(4).select(k.extend_units("id", [42, 137])).collect()]
    assert got == [42, 137, 10042, 10137]


def test_fingerprint_ignores_column_order(spark):
    df = spark.createDataFrame([(1, "x", None)], "b int, a string, c string")
    one, two = df.select(k.fingerprint(["a", "b", "c"]), k.fingerprint(["c", "b", "a"])).first()
    assert one == two and len(one) == 12


def test_missing_metrics_use_the_alias(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("inf"))], "skin_tone_change double, lpips double, total_pose_diff double")
    row = missing_required(df, ["skin_tone_change", "face_similarity", "lpips", "pose_difference"]).first()
    assert row.missing_required_metrics == ["face_similarity", "pose_difference"] and not row.evaluation_complete


def test_json_safe_is_recursive(spark):
    schema = "a double, b array<double>, c map<string, double>, d struct<x: double, y: array<struct<z: double>>>"
    nan, inf = float("nan"), float("inf")
    row = json_safe(spark.createDataFrame([(nan, [1.0, inf], {"k": -inf, "m": 2.0}, (nan, [(inf,), (3.0,)]))], schema)).first()
    assert row.a is None and row.b == [1.0, None] and row.c == {"k": None, "m": 2.0}
    assert row.d.x is None and [z.z for z in row.d.y] == [None, 3.0]


def ledger_line(seed, method="m", alpha=0.5, **more):
    return json.dumps({"seed": seed, "method": method, "alpha": alpha, "generation_complete": True, **more})


def test_ledger_keeps_file_order_and_runs(spark, tmp_path):
    for run in ("one", "two"):
        folder = tmp_path / run
        folder.mkdir()
        (folder / "results.jsonl").write_text("\n".join(ledger_line(i, alpha=-i / 4) for i in range(20)) + "\n\n")
    (tmp_path / "one" / "other.jsonl").write_text("not a ledger")
    rows = ledger.read_ledger(spark, str(tmp_path)).orderBy(*ledger.LEDGER_ORDER).collect()
    assert [r.seed for r in rows] == list(range(20)) * 2
    assert {r.run.rsplit("/", 1)[1] for r in rows} == {"one", "two"}


def test_empty_ledger_folder(spark, tmp_path):
    assert ledger.read_ledger(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text, kept", [
    (ledger_line(1) + "\n" + '{"seed": 2, "meth', 1),
    (ledger_line(1) + "\n" + ledger_line(2), 2),
    (ledger_line(1) + "\r\n" + ledger_line(2, note="é") + "\n", 2),
])
def test_only_an_unterminated_fragment_is_left_out(spark, tmp_path, text, kept):
    (tmp_path / "results.jsonl").write_bytes(text.encode())
    assert ledger.read_ledger(spark, str(tmp_path)).count() == kept


@pytest.mark.parametrize("text", ['{"seed": 2, "meth\n' + ledger_line(1) + "\n", ledger_line(1) + "\n" + '{"seed": 2, "meth\n'])
def test_other_malformed_lines_are_errors(spark, tmp_path, text):
    (tmp_path / "results.jsonl").write_text(text)
    with pytest.raises(Exception, match="malformed result row"):
        ledger.read_ledger(spark, str(tmp_path)).collect()
    assert [r.is_tail_fragment for r in ledger.malformed_lines(spark, str(tmp_path)).collect()] == [False]


def test_strict_reading_refuses_a_fragment(spark, tmp_path):
    (tmp_path / "results.jsonl").write_text(ledger_line(1) + "\n" + '{"seed"')
    with pytest.raises(Exception, match="malformed result row"):
        ledger.read_ledger(spark, str(tmp_path), repair_tail=False).collect()


def test_long_ledger_is_split_and_repaired(spark, tmp_path):
    lines = [ledger_line(i, image_path="x" * 200) for i in range(3000)]
    (tmp_path / "results.jsonl").write_text("\n".join(lines) + '\n{"seed": 1')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = ledger.read_ledger(spark, str(tmp_path))
        assert [r.seed for r in df.orderBy(*ledger.LEDGER_ORDER).collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_run_metadata_falls_back(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "metadata.json").write_text(json.dumps({"seed": 3, "results": [{"alpha": 1.0, "lpips": 0.2}, {"alpha": 2.0, "method": "own"}]}))
    rows = manifest.read_run_metadata(spark, str(tmp_path)).orderBy("alpha").collect()
    assert [(r.seed, r.method, r.evaluation_complete, r.lpips) for r in rows] == [(3, "stepwise_masked", False, 0.2), (3, "own", False, None)]


def complete_run(spark):
    units = spark.createDataFrame([(i,) for i in range(30)], "seed bigint")
    doses = {"a": [-1.0, 0.0, 1.0], "b": [float(x) for x in range(-8, 8)]}
    plan = audit.condition_matrix(units, doses, LEDGER)
    rows = plan.select(
        "*", F.lit("fp").alias("config_fingerprint"), F.lit("s").alias("study_id"), F.lit(True).alias("generation_complete"),
        k.condition_path("seed", "method", "alpha").alias("image_path"),
    )
    run = spark.createDataFrame([("fp", "s", "preregistered", "confirmatory", 570, list(range(30)))],
        "config_fingerprint string, study_id string, study_status string, execution_mode string, condition_count bigint, execution_seeds array<bigint>")
    return plan, rows, run


def run_checks(spark, plan, rows, run, listing):
    expected = {"config_fingerprint": "fp", "study_id": "s", "study_status": "preregistered"}
    tensors = spark.createDataFrame([("raw",), ("masked",)], "path string")
    return audit.run_audit(rows, plan, run, manifest.run_units(run), expected, listing.select("image_path"), tensors, "fp", LEDGER)


def test_complete_run_passes_every_check(spark):
    plan, rows, run = complete_run(spark)
    assert plan.count() == 570
    checks = run_checks(spark, plan, rows, run, rows)
    assert tuple(audit.run_passed(checks).first()) == (15, 0, True)


def test_one_missing_condition_fails_the_run(spark):
    plan, rows, run = complete_run(spark)
    short = rows.where("not (seed = 3 and method = 'a' and alpha = 0)")
    failed = {r["check"] for r in run_checks(spark, plan, short, run, rows).where("not passed").collect()}
    assert failed == {"exact_condition_keys", "row_count"}


def test_every_offender_is_listed(spark):
    plan, rows, run = complete_run(spark)
    bad = rows.where("not (seed = 3 and method = 'a' and alpha = 0)").unionAll(rows.where("seed = 4 and method = 'a' and alpha = 1"))
    bad = bad.withColumn("config_fingerprint", F.when(F.col("seed") == 5, F.lit(None)).when(F.col("seed") == 6, "x").otherwise(F.col("config_fingerprint")))
    bad = bad.unionByName(rows.limit(1).withColumn("method", F.lit("[new]")).withColumn("image_path", F.lit(None).cast("string")))
    runs = run.unionAll(run.withColumn("study_status", F.lit("draft")).withColumn("execution_seeds", F.array(F.lit(1).cast("bigint"), F.lit(99).cast("bigint"))))
    tensors = spark.createDataFrame([("raw",)], "path string")
    expected = {"config_fingerprint": "fp", "study_id": "s", "study_status": "preregistered"}
    listing = rows.where("seed <> 7 or method = 'b'").select("image_path")
    found = audit.run_offenders(bad, plan, runs, manifest.run_units(runs), expected, listing, tensors, "fp", LEDGER)
    got = {}
    for r in found.collect():
        got.setdefault(r["check"], []).append((r.key, r.detail, r.n))
    assert sorted(r for r in got["exact_condition_keys"] if "[" not in r[0]) == [("3/a/0.0", "missing", 1), ("4/a/1.0", "repeated", 1)]
    assert len(got["exact_condition_keys"]) == 3 and [r[1] for r in got["exact_condition_keys"] if "[new]" in r[0]] == ["extra"]
    assert len(got["result_fingerprint"]) == 38 and {r[1] for r in got["result_fingerprint"]} == {None, "x"}
    assert got["manifest_rows"] == [("manifest", "2", 1)] and got["manifest_study_status"] == [("manifest", "draft", 1)]
    assert got["manifest_seed_set"] == [("99", "not planned", 1)]
    assert sorted(r[1] for r in got["all_referenced_images_present"]) == ["absent"] * 3 + ["no path"]
    assert got["direction_tensors_present"] == [("directions", "1", 1)] and got["row_count"] == [("ledger", "571 of 570", 1)]
    assert set(got) == {"exact_condition_keys", "row_count", "result_fingerprint", "manifest_rows", "manifest_study_status", "manifest_seed_set", "all_referenced_images_present", "direction_tensors_present"}


def test_resume_skips_what_is_there(spark):
    plan, rows, _ = complete_run(spark)
    assert audit.remaining(plan, rows.where("seed < 29"), LEDGER.key).count() == 19


def test_attestation_needs_every_field(spark):
    items = spark.createDataFrame([("p1", 5, "h1"), ("p2", 6, "h2"), ("p3", 7, "h3")], "path string, seed int, sha256 string")
    records = spark.createDataFrame([("p1", 5, "old", 1), ("p1", 5, "h1", 2), ("p2", 9, "h2", 3)], "path string, seed int, sha256 string, line int")
    checked = attest.attestation_check(items, attest.latest_attestation(records, ["line"]), ["seed", "sha256"])
    assert {r.path: r.valid for r in checked.collect()} == {"p1": True, "p2": False, "p3": False}
    assert not attest.campaign_complete(checked, 1).first().campaign_complete
    assert attest.campaign_complete(checked.where("valid").unionAll(checked.where("valid")), 1).first().campaign_complete


def test_evidence_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    words = ["ab", "abc", "b", "cab", "bca", "xyz", "a", "yz"]
    docs = [" ".join(rng.choice(words, rng.integers(1, 60))).replace(" b ", "  b\n") for _ in range(40)]
    snippets = [" ".join(rng.choice(words, n)) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 7)] + ["", "c", "zz", "b ca", "  xyz \t ab "]
    snippets += [" ".join(docs[3].split())[5:40], " ".join(docs[4].split())[2:12]]
    s = spark.createDataFrame(list(enumerate(snippets)), "sid int, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "did int, text string")
    got = {tuple(r) for r in evidence.evidence_pairs(s, d, "sid", "did").select("sid", "did").collect()}
    flat = lambda t: " ".join(t.split())
    want = {(i, j) for i, x in enumerate(snippets) for j, y in enumerate(docs) if flat(x) in flat(y)}
    assert got == want
    pairs = evidence.evidence_pairs(s, d, "sid", "did")
    required = spark.createDataFrame([(0, 0), (12, 0)], "sid int, did int")
    missing = {tuple(r) for r in evidence.missing_evidence(required, pairs, "sid", "did").collect()}
    assert missing == {p for p in [(0, 0), (12, 0)] if p not in want}


def test_sink_round_trip_and_empty_table(spark, tmp_path):
    table = spark.createDataFrame([("r", "c", -1, 5.0, "lpips", 6, 0.1, 0.1, 0.0, 0.2, 0.03, 0.3)], CONTRAST_SCHEMA)
    audit_row = spark.createDataFrame([(1, float("nan"))], "rows int, share double")
    paths = sinks.write_analysis({"paired_contrasts": table}, audit_row, str(tmp_path / "out"))
    assert sinks.read_table(spark, paths["paired_contrasts"], CONTRAST_SCHEMA).collect() == table.collect()
    assert sinks.read_table(spark, str(tmp_path / "none"), CONTRAST_SCHEMA).count() == 0
    text = next((tmp_path / "out" / "audit").glob("*.json")).read_text()
    assert json.loads(text) == {"rows": 1, "share": None}


def png(width, height, rgb):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + b"".join(bytes(rgb(x, y)) for x in range(width)) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files_become_pixels(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(5, 3, lambda x, y: (x * 10, y * 20, 255)))
    px = images.read_pixels(spark, str(tmp_path))
    rows = {(r.x, r.y): (r.r, r.g, r.b) for r in px.collect()}
    assert len(rows) == 15 and rows[(4, 2)] == (40, 40, 255) and rows[(0, 0)] == (0, 0, 255)
    assert tuple(images.image_sizes(px).first())[1:] == (5, 3)


def test_grey_pixels_are_repeated(spark):
    df = spark.createDataFrame([(1, 2, 1, 1, bytearray([7, 9]))], "image_id int, width int, height int, nChannels int, data binary")
    assert [tuple(r) for r in images.pixels_of(df).collect()] == [(1, 0, 0, 7, 7, 7), (1, 1, 0, 9, 9, 9)]


def test_stream_ingests_once_and_resumes(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    for part, seeds in (("s0", (1, 2, 2)), ("s1", (2, 3))):
        folder = tmp_path / "in" / part
        folder.mkdir(parents=True)
        (folder / "results.jsonl").write_text("".join(ledger_line(s) + "\n" for s in seeds))
        live.ingest_ledger(spark, source, table, checkpoint).awaitTermination()
        got = sorted(r.seed for r in spark.read.parquet(table).collect())
        assert got == [1, 2] if part == "s0" else got == [1, 2, 3]


def test_a_key_keeps_its_first_arrival_over_batches_and_restarts(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    kept, rows = {}, [(k, v, o) for o, (k, v) in enumerate([("a", 9), ("b", 5), ("a", 1), (None, 4), ("c", 2**60 + 1), ("b", 3), (None, 7), ("d", None), ("a", 0)])]
    for start in (0, 4, 6):
        part = [rows[:4], rows[4:6], rows[6:]][(0, 4, 6).index(start)]
        spark.createDataFrame(part[::-1], "k string, v bigint, o int").write.mode("append").parquet(source)
        for k, v, _ in part:
            kept.setdefault(k, v)
        stream = spark.readStream.schema("k string, v bigint, o int").parquet(source)
        live.ingest(stream, table, checkpoint, ["k"], ["o"]).awaitTermination()
        assert {r.k: r.v for r in spark.read.parquet(table).collect()} == kept
        assert spark.read.parquet(table).count() == len(kept)
    with pytest.raises(ValueError):
        live.ingest(stream.select("k"), table, checkpoint, ["k"])


def test_first_arrivals_ask_python_for_no_key(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    for turn in range(3):
        spark.range(turn * 1000, turn * 1000 + 2000).selectExpr("id % 2500 as k", f"id + {turn} as v", "-id as o").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k bigint, v bigint, o bigint").parquet(source)
        plan = live.first_arrivals(stream, ["k"], ["o"])._jdf.queryExecution().analyzed().toString()
        assert "Aggregate" in plan and "TransformWithState" not in plan and "Python" not in plan
        live.ingest(stream, table, checkpoint, ["k"], ["o"]).awaitTermination()
    rows = spark.read.parquet(table)
    # Keys from 0 to 1999 came first, then those to 2499 with ids of their own or wrapped ones.
    assert rows.count() == rows.select("k").distinct().count() == 2500
    assert {r.batch: r.n for r in rows.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {0: 2000, 1: 500}
    assert rows.where("v <> k + batch").count() == 0


def test_remaining_is_the_plan_less_a_log_that_is_compacted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    plan = spark.range(40).selectExpr("id as k", "cast(null as string) as note").union(spark.sql("select cast(null as bigint), 'x'"))
    for turn in range(5):
        spark.range(turn * 7, turn * 7 + 9).selectExpr("id as k").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k bigint").parquet(source)
        live.live_remaining(stream, plan, out, checkpoint, ["k"], compact_every=2).awaitTermination()
        left = {r.k for r in live.still_open(spark, out, ["k"]).collect()}
        assert left == {None, *range(turn * 7 + 9, 40)}
    assert spark.read.parquet(f"{out}/plan").count() == 41
    sizes = [spark.read.parquet(f"{out}/arrived/batch={i}").count() for i in range(5)]
    assert sizes == [9] * 5 and spark.read.parquet(f"{out}/compact").select("upto").distinct().count() == 2


def test_live_views_follow_the_campaign(spark, tmp_path):
    source = str(tmp_path / "in")
    plan = spark.createDataFrame([(s, "m", 0.5) for s in (1, 2, 3)], "seed bigint, method string, alpha double")
    for part, seed in (("s0", 1), ("s1", 3)):
        folder = tmp_path / "in" / part
        folder.mkdir(parents=True)
        (folder / "results.jsonl").write_text(ledger_line(seed) + "\n")
        rows = live.stream_ledger(spark, source, pattern="results.jsonl")
        live.live_remaining(rows, plan, str(tmp_path / "left"), str(tmp_path / "c1"), LEDGER.key).awaitTermination()
        rows = live.stream_ledger(spark, source, pattern="results.jsonl")
        live.live_missingness(rows, str(tmp_path / "miss"), str(tmp_path / "c2"), LEDGER).awaitTermination()
    left = live.still_open(spark, str(tmp_path / "left"), LEDGER.key)
    assert [r.seed for r in left.collect()] == [2]
    row = live.latest_version(spark, str(tmp_path / "miss")).first()
    assert (row.attempted, row.generated, row.evaluation_complete) == (2, 2, 0)


def test_thousands_of_anchors_are_not_hashed_for_every_document(spark, monkeypatch):
    from effectlab.operators import evidence

    words = [f"w{i}" for i in range(4_000)]
    docs = spark.createDataFrame([(i, " ".join(words[20 * i : 20 * i + 40])) for i in range(190)], "doc int, text string")
    items = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 12])) for i in range(300)], "item int, text string")
    used = []
    monkeypatch.setattr(evidence.F, "array_intersect", lambda *args: used.append(args))
    got = {r.item: r.n_present for r in evidence.evidence_presence(items, docs, "item", "doc").collect()}
    assert not used
    assert got == {i: sum(20 * j <= 10 * i and 10 * i + 12 <= 20 * j + 40 for j in range(190)) for i in range(300)}
