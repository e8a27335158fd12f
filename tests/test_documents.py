import json
import threading

import pytest
from pyspark.sql import functions as F

from disparity_spark import cli, functions, sources, streaming
from disparity_spark.operators import gate_run, provenance, regulatory, reports
from disparity_spark.operators.disparity import AuditSpec


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data") / "d.csv"
    sources.generate_dispatch(spark, 600, 0.5).toPandas().to_csv(path, index=False)
    return str(path)


def test_command_line_round_trip(spark, table, tmp_path, capsys):
    stem = str(tmp_path / "report")
    assert cli.main(["audit", table, "--truth", "on_time", "--pred", "priority_route", "--group", "group", "--bootstrap", "20", "--out", stem]) == 0
    assert cli.main(["gate", f"{stem}.json"]) == 1
    assert cli.main(["verify", f"{stem}.json", table]) == 0
    assert cli.main(["signoff", f"{stem}.json", "--reviewer", "R", "--decision", "reject"]) == 0
    assert cli.main(["verify", f"{stem}.json", table]) == 0
    changed = json.loads((tmp_path / "report.json").read_text()) | {"tpr_gap": 0.0}
    (tmp_path / "report.json").write_text(json.dumps(changed))
    assert cli.main(["verify", f"{stem}.json", table]) == 1
    with pytest.raises(SystemExit):
        cli.main(["signoff", f"{stem}.json", "--reviewer", "R", "--decision", "approve"])
    assert "<script" not in (tmp_path / "report.html").read_text() and "| group |" in (tmp_path / "report.md").read_text()


def test_gate_run(spark, table, tmp_path):
    config = tmp_path / "gate.yml"
    config.write_text(f"version: 1\naudit:\n  data: {table}\n  truth: on_time\n  pred: priority_route\n  groups: [group]\n")
    assert cli.main(["gate-run", str(config), "--out-dir", str(tmp_path / "out")]) == 1
    verdict = json.loads((tmp_path / "out" / "verdict.json").read_text())
    assert verdict["status"] == "fail" and len((tmp_path / "out" / "verdicts.jsonl").read_text().splitlines()) == 1
    for body in ("[]", "audit: 1", "audit: {data: x, truth: t}", "audit: {data: x, truth: t, groups: []}", "audit: {data: x, truth: t, groups: [g], min_group_n: 0}", "version: 2\naudit: {data: x, truth: t, groups: [g]}", "audit: {data: x, truth: t, groups: [g]}\nthresholds: {x: {min: 1}}", "audit: {data: x, truth: t, groups: [g]}\ngate: {fail_mode: z}", "audit: {data: x, truth: t, groups: [g], z: 1}"):
        config.write_text(body)
        with pytest.raises(ValueError):
            gate_run.load_gate_config(str(config))


def test_synthetic_command(spark, table, tmp_path):
    config = tmp_path / "s.yml"
    config.write_text("truth: on_time\npred: priority_route\ngroups: [group]\nexclude: [driver_id]\n")
    assert cli.main(["audit-synthetic", table, table, "--config", str(config), "--bootstrap", "10", "--out", str(tmp_path / "s.json")]) in (0, 1, 2)
    assert provenance.Ledger(json.loads((tmp_path / "s.json").read_text())).body_breaks() == []


def test_generate_command(spark, tmp_path):
    assert cli.main(["generate", "staffing", "--n", "50", "--out", str(tmp_path / "s.parquet")]) == 0
    assert sources.read_table(spark, str(tmp_path / "s.parquet")).count() == 50
    assert json.loads((tmp_path / "s.provenance.json").read_text())["input"]["rows"] == 50


def test_signoff_chain():
    d = provenance.Ledger(provenance.Ledger({"a": "ä"}).sealed()).signed("x", "approve")
    d = provenance.Ledger(d).signed("y", "reject")
    ledger = provenance.Ledger(d)
    assert ledger.chain_breaks() == [] == ledger.body_breaks() and d["signoffs"][1]["prev_hash"] == provenance.canonical_hash(d["signoffs"][0])
    changed = provenance.Ledger(d | {"signoffs": [d["signoffs"][0] | {"note": "changed"}, d["signoffs"][1]]})
    assert changed.chain_breaks() == ["sign-off 1 was changed after signing", "sign-off 2 doesn't follow from what stands before it"]
    assert provenance.Ledger(d | {"a": "b"}).body_breaks()[0].startswith("the body was changed") and provenance.Ledger({}).body_breaks() == ["there is no provenance"]
    assert provenance.Ledger(d | {"signoffs": [{"reviewer": "z"}]}).chain_breaks() == ["sign-off 1 lacks decision, timestamp_utc, prev_hash, record_hash"]
    with pytest.raises(ValueError, match="sign-off 1"):
        changed.signed("z", "approve")


def test_content_digest_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert provenance.content_digest(df) == provenance.content_digest(df.orderBy(F.desc("id")).repartition(3))
    assert provenance.content_digest(df) != provenance.content_digest(df.withColumn("x", F.col("x") + 1))


def test_evidence_log_threads(spark, tmp_path):
    log = provenance.EvidenceLog(str(tmp_path / "e.jsonl"), {"type": "t"})
    threads = [threading.Thread(target=lambda: [log.record("k", i=i) for i in range(25)]) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert [e["seq"] for e in log.read()] == list(range(200))
    assert sources.read_events(spark, str(tmp_path / "e.jsonl")).count() == 200
    with pytest.raises(ValueError):
        log.record("k", seq=1)


@pytest.mark.parametrize(("cases", "tier"), [(["employment_recruitment"], "high_risk"), (["social_scoring", "credit_scoring"], "prohibited"), (["conversational_ai"], "transparency"), ([], "minimal")])
def test_tiers(cases, tier):
    c = regulatory.classify_system({"use_cases": cases})
    assert c.tier == tier
    checks = {s: regulatory.cross_check_gate(s, c).verdict for s in ("pass", "fail", "review")}
    assert checks == {"high_risk": {"pass": "conditional_pass", "fail": "blocked", "review": "blocked"}, "prohibited": dict.fromkeys(checks, "hard_stop")}.get(tier, {"pass": "pass", "fail": "blocked", "review": "blocked"})


def test_unknown_use_case_and_status():
    with pytest.raises(ValueError):
        regulatory.classify_system({"use_cases": ["x"]})
    with pytest.raises(ValueError):
        regulatory.cross_check_gate("maybe", regulatory.classify_system({"use_cases": []}))
    assert len(regulatory.mappings_for_report(False)) == len(regulatory.mappings_for_report(True)) - 1


def test_campaign_report(tmp_path):
    campaign = {"brief": {}, "seed": 1, "rounds": 1, "probes_used": 6, "stop_reason": "x|y", "findings": [{"round": 1, "generator": "counterfactual", "n_probes": 6, "strength": 0.2, "details": {"gaps": {"<g>": 0.2}}}], "best_strength": 0.2, "evidence_path": "e", "n_events": 3}
    d = reports.build_report(campaign, {"type": "t"})
    assert d["verdict"] == "disparity_found"
    out = reports.save_campaign_report(d, str(tmp_path / "r.v1"))
    assert out["md"].name == "r.v1.md" and "x\\|y" in out["md"].read_text() and "&lt;g&gt;" in out["html"].read_text()


def test_context():
    assert sources.normalize_context({"a": 1, "b": None, "c": " "}) == {"a": "1"}
    with pytest.raises(ValueError):
        sources.normalize_context({"a": [1]})


def test_scalar_rules(spark):
    one = spark.createDataFrame([("a  b", 'x{"k": 1}y', "nan", "7")], "t string, j string, a string, b string").select(functions.spaced_once(F.col("t")).alias("t"), functions.json_object(F.col("j")).alias("j"), functions.confidence(F.col("a")).alias("a"), functions.confidence(F.col("b")).alias("b"), functions.truncated(F.lit("abcdef"), 3).alias("c")).first()
    assert tuple(one) == ("a b", '{"k": 1}', 0.0, 1.0, "abc...[truncated]")


def test_stream_and_batch_agree(spark, tmp_path):
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).cast("int").alias("t"), (F.col("id") % 3 == 0).cast("int").alias("p"), F.when(F.col("id") % 5 < 2, "A").otherwise("B").alias("g"))
    rows.write.parquet(str(tmp_path / "in"))
    spec, got = AuditSpec("t", ("g",), "p"), []
    q = streaming.start_gate(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), spec, "ts", "1 hour", "0 seconds", lambda batch, n: got.extend(batch.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    expected = {r.window_start: r.status for r in streaming.gate_windows(streaming.windowed_confusion(rows, spec, "ts", "1 hour")).collect()}
    assert got and all(expected[r.window_start] == r.status for r in got) and len(got) >= len(expected) - 2
