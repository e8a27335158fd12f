import json

import pytest
from pyspark.sql import functions as F

from disparity_spark.operators import campaign as C
from disparity_spark.operators import judges as J
from disparity_spark.operators import probes as P
from disparity_spark.operators import targets as T


@pytest.fixture
def base(spark):
    rows = spark.createDataFrame([("k", 6, 4, "FT")], "key string, tenure_months int, shifts_requested int, group string")
    return P.base_rows(rows, "key", ["tenure_months", "shifts_requested", "group"])


class Planted(T.Target):
    def predict(self, rows):
        return [0 if r["group"] == "temp" and int(float(r["tenure_months"])) < 24 else 1 for r in rows]


def test_counterfactuals(spark, base):
    batch = P.generate_counterfactuals(base, {"group": ["FT", "PT", "temp", "FT"]})
    assert batch.count() == 6 and P.check_symmetry(batch) == (True, [])
    out = T.run_target(batch, Planted())
    assert P.attribute_gaps(batch, out).agg(F.max("gap")).first()[0] == 1.0
    with pytest.raises(ValueError):
        P.generate_counterfactuals(base, {"group": ["FT", "FT"]})


def test_symmetry_finds_orphans_and_drift(spark, base):
    batch = P.generate_counterfactuals(base, {"group": ["FT", "PT", "temp"]})
    drifted = batch.withColumn("payload_row", F.when(F.col("id") == "cf-k-group-0-1-a", P.with_field(F.col("payload_row"), "tenure_months", F.lit("99"))).otherwise(F.col("payload_row")))
    ok, bad = P.check_symmetry(drifted.filter("id <> 'cf-k-group-1-2-b'"))
    assert not ok and {b["pair_id"]: b["problems"] for b in bad} == {"cf-k-group-0-1": ["other_fields_differ"], "cf-k-group-1-2": ["not_two_mirrors"]}


def test_text_templates(spark):
    batch = P.generate_text_counterfactuals(spark, "{{Rate}} {who} of {city}", {"who": ["Ann", "Bo"]}, {"city": "Rome"})
    assert [r.payload_text for r in batch.orderBy("id").collect()] == ["{Rate} Ann of Rome", "{Rate} Bo of Rome"]
    assert P.check_symmetry(batch)[0]
    with pytest.raises(ValueError):
        P.generate_text_counterfactuals(spark, "no placeholder", {"who": ["a", "b"]})


def test_adversarial(spark, base):
    rows = P.adversarial_rows(base, ["tenure_months"], ["group"])
    assert {r.strategy: r["count"] for r in rows.select(F.col("meta")["strategy"].alias("strategy")).groupBy("strategy").count().collect()} == {"extreme_value": 4, "unseen_category": 2, "null_row": 1}
    whole = T.TabularTarget(lambda f: (_ for _ in ()).throw(RuntimeError("too many")) if len(f) > 1 else [1])
    assert P.error_rate(T.run_target(rows, whole)).first().n_errors == 0  # a batch that fails is tried probe by probe
    strict = T.TabularTarget(lambda f: [int(float(v)) for v in f["tenure_months"]])
    assert P.error_rate(T.run_target(rows, strict)).first().n_errors == 1
    prompts = P.adversarial_prompts(spark, 500)
    assert prompts.count() == 6 and prompts.select(F.max(F.length("payload_text"))).first()[0] == 500


def test_metamorphic(spark):
    inputs = spark.createDataFrame([("k", "Due 2026-01-05,  not 2026-02-31")], "key string, payload_text string")
    batch = P.generate_metamorphic(inputs)
    texts = {r.id: r.payload_text for r in batch.collect()}
    assert texts["mm-date_format-k-followup"] == "Due Jan 5, 2026,  not 2026-02-31"
    assert texts["mm-whitespace_normalize-k-followup"] == "Due 2026-01-05, not 2026-02-31"
    outputs = T.run_target(batch, T.RagTarget(lambda q: str(len(q))))
    found = {r.relation: r.verdict for r in P.evaluate_metamorphic(batch, outputs).collect()}
    assert found == {"date_format": False, "case_fold": True, "neutral_prefix": None, "whitespace_normalize": False}
    none = P.evaluate_metamorphic(batch, outputs.limit(0)).filter("relation = 'case_fold'").first()
    assert none.verdict is False
    row = P.base_rows(spark.createDataFrame([("k", 1, 2)], "key string, a int, b int"), "key", ["a", "b"])
    turned = P.generate_metamorphic(row, ["reorder_fields"]).filter("id like '%followup'").first().payload_row
    assert [x.name for x in turned] == ["b", "a"]


def test_caps_keep_pairs_whole(spark, base):
    assert P.capped(P.generate_counterfactuals(base, {"group": ["FT", "PT", "temp"]}), 5).count() == 4


def test_proposals():
    rows = [{"row": {"g": "a", "n": 1}, "attribute": "g"}, {"row": {"g": "b", "n": 1}, "attribute": "g"}, {"row": {"g": "b", "n": 2}, "attribute": "g"}, {"row": {"g": "z", "n": 2}, "attribute": "g"}, 3]
    kept, dropped = P.generate_llm_assisted("```json\n" + json.dumps(rows) + "\n```", {"g": ["a", "b"]}, ["g", "n"])
    assert len(kept) == 1 and sorted(d["reason"] for d in dropped) == ["malformed", "no_mirror", "undeclared_value"]
    assert P.generate_llm_assisted("nothing", {}, []) == ([], [])


def test_proposals_of_a_target(spark):
    rows = [{"row": {"g": g, "n": 1}, "attribute": "g"} for g in ("a", "b", "z")]
    replies = iter(["", "Here: " + json.dumps(rows)])
    batch, report = P.propose_probes(spark, T.RagTarget(lambda q: next(replies)), "a loan desk", {"g": ["a", "b"]}, ["g", "n"], n=3, seed=4)
    assert report == {"requested": 3, "kept": 2, "discarded": 1, "reasons": {"undeclared_value": 1}, "asked": 2, "seed": 4}
    assert [(r.id, r.kind, r.attributes["g"]) for r in batch.orderBy("id").collect()] == [("llm-g-0-a", "llm_assisted", "a"), ("llm-g-0-b", "llm_assisted", "b")]
    assert P.chosen(batch, attribute="g", value="b").count() == 1 and P.chosen(batch, kind="x").count() == 0
    assert [r.ids for r in P.pair_groups(batch).collect()] == [["llm-g-0-a", "llm-g-0-b"]] and json.loads(P.told(batch).first().event)["kind"] == "llm_assisted"
    none, report = P.propose_probes(spark, T.RagTarget(lambda q: ""), "x", {"g": ["a", "b"]}, ["g"])
    assert none.count() == 0 and report["reasons"] == {"empty_reply": 1}
    with pytest.raises(RuntimeError):
        P.propose_probes(spark, None, "x", {}, [])


def test_judges(spark):
    scores = spark.createDataFrame([("A", "warm", False), ("A", "warm", False), ("B", "warm", False), ("B", "cold", False), ("B", "cold", False), ("B", "cold", False), ("A", "unscored", True)], "group string, label string, unscored boolean").withColumn("judge_id", F.lit("tone-v1"))
    out = J.aggregate_judge_findings(scores, J.TONE_SCALE)
    assert out["rates"] == {"A": {"warm": 1.0, "cold": 0.0}, "B": {"warm": 0.25, "cold": 0.75}} and out["gaps"] == {"warm": 0.75, "cold": 0.75}
    assert out["strongest_label"] == "cold" and out["unscored_rate"] == 0.1429 and out["ordinal_gap"] == 1.5


def test_llm_judge_never_invents_labels(spark):
    replies = {"ok": '{"label": "refusal", "confidence": 7}', "odd": "no json", "bad": '{"label": "maybe"}'}
    judge = J.LLMJudge("refusal", lambda p: next(v for k, v in replies.items() if f'"{k}"' in p))
    got = {r.text: (r.label, r.confidence, r.unscored) for r in J.judged(spark.createDataFrame([(k,) for k in replies], "text string"), judge).collect()}
    assert got == {"ok": ("refusal", 1.0, False), "odd": ("unscored", 0.0, True), "bad": ("unscored", 0.0, True)}
    assert J.parse_label("stereotype", {"label": 1, "severity": 0}) is None and J.parse_label("stereotype", {"label": "1", "severity": 2}) == ("stereotype", {"severity": 2})


@pytest.mark.parametrize(("human", "judge", "kappa"), [("aabb", "abbb", 0.5), ("ab", "ab", 1.0), ("aa", "aa", 1.0), ("", "", 0.0)])
def test_kappa(spark, human, judge, kappa):
    pairs = spark.createDataFrame(list(zip(human, judge, strict=True)), "human string, judge string")
    assert round(J.kappa(J.label_confusion(pairs)).first().kappa, 9) == kappa


def test_calibration(spark):
    pairs = spark.createDataFrame([("refuse it", "refusal"), ("do it", "compliance")], "text string, human string")
    good = J.CalibrationHarness(J.RuleJudge("refusal", lambda t: "refusal" if "refuse" in t else "compliance")).run(pairs)
    assert good["passed"] and good["kappa"] == 1.0
    assert not J.CalibrationHarness(J.RuleJudge("refusal", lambda t: "?")).run(pairs)["passed"]


BRIEF = {"target_type": "tabular", "protected_attributes": {"group": ["FT", "PT", "temp"]}, "base_input": {"tenure_months": 6, "group": "FT"}}


def test_campaign(spark, tmp_path):
    replies = iter(["", json.dumps({"action": "probe", "generator": "counterfactual", "params": {"attributes": {"group": ["FT", "temp"]}}}), json.dumps({"action": "probe", "generator": "adversarial"}), '{"action": "stop", "reason": "enough"}'])
    run = C.AuditCampaign(spark, C.AuditPlanner(lambda p: next(replies), BRIEF), Planted(), str(tmp_path / "log.jsonl"))
    report = run.run()
    assert report.stop_reason == "planner_stop:enough" and report.best_strength == 1.0 and report.rounds == 2
    kinds = [e["kind"] for e in run.log.read()]
    assert kinds[0] == "campaign_start" and kinds[-1] == "campaign_end" and report.n_events == len(kinds)
    with pytest.raises(ValueError):
        C.AuditCampaign(spark, C.AuditPlanner(lambda p: "", BRIEF), Planted(), str(tmp_path / "x.jsonl"), judges=[(J.RuleJudge("tone", str), {"passed": False})])


@pytest.mark.parametrize("reply", ["", "text", '{"action": "probe", "generator": "x"}', '{"action": "probe", "generator": "counterfactual", "params": {"attributes": {"group": ["FT"]}}}', '{"action": "probe", "generator": "counterfactual", "params": {"attributes": {"age": [1, 2]}}}', '{"action": "probe", "generator": "metamorphic", "params": {"relations": ["x"]}}'])
def test_bad_plans_stop(reply):
    spec, _ = C.AuditPlanner(lambda p: reply, BRIEF).propose([], 10, 10)
    assert spec.action == "stop" and spec.reason.startswith("planner_")


def test_standing():
    rounds = [{"n_probes": 1, "strength": s} for s in (0.5, 0.5, 0.4)]
    now = C.standing(C.Budget(max_probes=5, max_rounds=3), rounds)
    assert now == {"best": 0.5, "used": 3, "probes": 2, "rounds": 0, "cap": "max_rounds", "flat": True}
    assert C.standing(C.Budget(max_probes=3, max_rounds=3), rounds)["cap"] == "max_probes"
    assert C.standing(C.Budget(max_cost=2.0, cost_per_probe=0.5, cost_per_plan=0.25), rounds, plans=2)["cap"] == "max_cost"
    assert not C.standing(C.Budget(), rounds[:2])["flat"] and not C.standing(C.Budget(flat_rounds=0), rounds)["flat"] and C.standing(C.Budget(), [])["best"] == 0.0


def test_standing_agrees_with_the_table_form(spark):
    strengths = [0.0, 0.2, 0.2, 0.1, 0.3, 0.3, 0.25, 0.3]
    table = spark.createDataFrame([("c", i, s) for i, s in enumerate(strengths, 1)], "campaign string, round int, strength double")
    for k in (1, 2, 3):
        got = [r.flat for r in C.flat_rounds(table, k).orderBy("round").collect()]
        assert got == [C.standing(C.Budget(flat_rounds=k), [{"n_probes": 0, "strength": s} for s in strengths[:i]])["flat"] for i in range(1, 9)]


def test_replies(spark, tmp_path):
    path = tmp_path / "c" / "replies.jsonl"
    replies = C.Replies(str(path))
    replies[{"a": 1}], replies[["b"]], replies[{"a": 1}] = "x", "y", "z"
    with path.open("a") as f:
        f.write('{"key": "torn')
    again = C.Replies(str(path))
    assert again[{"a": 1}] == "z" and ["b"] in again and ["c"] not in again and len(again) == 2
    again["d"] = "w"  # after the torn line
    assert C.Replies(str(path))["d"] == "w"
    del again["d"]
    assert len(path.read_text().splitlines()) == 2 and C.Replies(str(path)).table(spark).count() == 2


def test_cached_runs(spark, base):
    batch = P.generate_counterfactuals(base, {"group": ["FT", "PT", "temp"]})
    empty = spark.createDataFrame([], "key string, output string")
    out, fresh = C.run_cached(batch, Planted(), empty)
    assert out.count() == 6 and fresh.count() == 3
    assert C.run_cached(batch, Planted(), fresh)[1].count() == 0


def test_malformed_replies_are_errors(spark):
    sent = []

    def post(url, body, headers):
        sent.append(body)
        return {"choices": [{"message": {"content": None}}]} if "fine" in body["messages"][0]["content"] else {"odd": 1}

    target = T.ChatCompletionsTarget("http://x", "m", transport=post, extra={"seed": 7})
    assert target.generate(["fine"]) == [""] and sent[0]["seed"] == 7
    for bad in (target, T.LocalChatTarget("http://x", "m", transport=post)):
        with pytest.raises(ValueError, match="malformed"):
            bad.generate(["broken"])
