"""Queries of probes, judges, calibration, campaigns, logs, generators and streaming."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources, streaming
from ..operators import campaign as C
from ..operators import judges as J
from ..operators import probes as P
from ..operators import provenance, targets
from ..operators.disparity import AuditSpec
from ..session import load
from . import bindings as B

BRANDS = ["FT", "PT", "temp"]


def _base(spark, sf_dir):
    return P.base_rows(load(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_size"])


def _shown(batch):
    return batch.select("id", F.array_join(F.transform("payload_row", lambda x: F.concat_ws("=", x["name"], F.coalesce(x["value"], F.lit("null")))), ";").alias("payload"))


def _mirrors(spark, sf_dir):
    return P.generate_counterfactuals(_base(spark, sf_dir), {"p_brand": BRANDS})


def counterfactual_pairs(spark, sf_dir):
    return _shown(_mirrors(spark, sf_dir))


def _answers(batch):
    """A rule as the target: temp is refused for small sizes."""
    brand, size = P.field_of(F.col("payload_row"), "p_brand"), P.field_of(F.col("payload_row"), "p_size").try_cast("double")
    return batch.select("id", F.when((brand == "temp") & (size < 24), 0).otherwise(1).alias("output"))


def counterfactual_gap(spark, sf_dir):
    batch = _mirrors(spark, sf_dir)
    return P.attribute_gaps(batch, _answers(batch)).select("attribute", "value", F.round("outcome_rate", 9).alias("outcome_rate"), F.round("gap", 9).alias("gap"))


def symmetry_problems(spark, sf_dir):
    """Mirrors of which some lost their partner and some another field."""
    key = F.regexp_extract("id", r"^cf-(\d+)-", 1).cast("long")
    batch = _mirrors(spark, sf_dir).filter(~((key % 10 == 0) & F.col("id").endswith("-b")))
    broken = batch.withColumn("payload_row", F.when((key % 10 == 1) & F.col("id").endswith("-a"), P.with_field(F.col("payload_row"), "p_size", F.lit("-5"))).otherwise(F.col("payload_row")))
    return P.symmetry_problems(broken).select("pair_id", "n_mirrors", F.array_join("problems", ",").alias("problems"))


def _hostile(spark, sf_dir):
    return P.adversarial_rows(_base(spark, sf_dir), ["p_size"], ["p_brand"])


def adversarial_rows(spark, sf_dir):
    return _shown(_hostile(spark, sf_dir))


def adversarial_error_rate(spark, sf_dir):
    """A target that fails on unknown categories and missing values."""
    brand = P.field_of(F.col("payload_row"), "p_brand")
    outputs = _hostile(spark, sf_dir).select("id", F.when(brand.isNull() | (brand == P.UNSEEN) | (brand == ""), "ValueError").alias("error"))
    return P.error_rate(outputs).withColumn("error_rate", F.round("error_rate", 9))


def _texts(spark, sf_dir):
    """Conversation turns with a date and doubled spaces put in."""
    turns = load(spark, sf_dir, "conversations")
    day = F.format_string("%04d-%02d-%02d", F.lit(2020) + F.col("conv_id") % 6, F.col("turn") % 14 + 1, (F.col("conv_id") * 7) % 31 + 1)
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.concat(F.lit(" On "), day, F.lit("  "), F.col("text"), F.lit(" ")).alias("payload_text"))


def _followup(spark, sf_dir, relation):
    return P.generate_metamorphic(_texts(spark, sf_dir), [relation]).filter("meta['role'] = 'followup'").select("id", F.md5("payload_text").alias("text_md5"))


def metamorphic_date_format(spark, sf_dir):
    return _followup(spark, sf_dir, "date_format")


def metamorphic_case_fold(spark, sf_dir):
    return _followup(spark, sf_dir, "case_fold")


def metamorphic_whitespace(spark, sf_dir):
    return _followup(spark, sf_dir, "whitespace_normalize")


def metamorphic_violation_rate(spark, sf_dir):
    """A target that answers with the length of the text."""
    batch = P.generate_metamorphic(_texts(spark, sf_dir), ["case_fold", "whitespace_normalize", "neutral_prefix"])
    outputs = batch.select("id", F.length("payload_text").cast("string").alias("output"))
    return P.violation_rate(P.evaluate_metamorphic(batch, outputs)).withColumn("violation_rate", F.round("violation_rate", 9))


def _tones(spark, sf_dir):
    """Turns by role with a rule as the judge: length tells the tone; very short texts stay unscored."""
    n = F.length("text")
    label = F.when(n < 20, J.UNSCORED).when(n < 150, "cold").when(n < 600, "neutral").otherwise("warm")
    return load(spark, sf_dir, "conversations").select(F.col("role").alias("group"), label.alias("label"), (label == J.UNSCORED).alias("unscored"))


def judge_label_rates(spark, sf_dir):
    return J.group_label_rates(_tones(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


def judge_label_gaps(spark, sf_dir):
    return J.label_rate_gaps(J.group_label_rates(_tones(spark, sf_dir))).withColumn("gap", F.round("gap", 9))


def strongest_label(spark, sf_dir):
    return J.strongest_label(J.label_rate_gaps(J.group_label_rates(_tones(spark, sf_dir)))).withColumn("strength", F.round("strength", 9))


def ordinal_means(spark, sf_dir):
    return J.ordinal_means(_tones(spark, sf_dir)).select("group", F.round("mean", 9).alias("mean"), F.round("gap", 9).alias("gap"))


def unscored_rate(spark, sf_dir):
    return J.unscored_rate(_tones(spark, sf_dir)).withColumn("unscored_rate", F.round("unscored_rate", 9))


def _pairs(spark, sf_dir):
    return B.labelled(spark, sf_dir).select(F.col("quality").cast("string").alias("human"), (F.col("n_chars") >= 200).cast("int").cast("string").alias("judge"))


def calibration_confusion(spark, sf_dir):
    return J.label_confusion(_pairs(spark, sf_dir))


def cohen_kappa(spark, sf_dir):
    return J.kappa(J.label_confusion(_pairs(spark, sf_dir))).select("n", F.round("accuracy", 9).alias("accuracy"), F.round("kappa", 9).alias("kappa"))


def per_label_pr(spark, sf_dir):
    return J.label_scores(J.label_confusion(_pairs(spark, sf_dir))).select("label", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "support")


def round_strengths_flat(spark, sf_dir):
    """Campaigns: users of the event table; rounds: their events in order; strength: the value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rounds = load(spark, sf_dir, "events").select(F.col("user_id").alias("campaign"), F.row_number().over(w).alias("round"), F.round("value", 6).alias("strength"))
    return C.flat_rounds(rounds, 2)


def evidence_log_by_kind(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq"), F.sum(k).alias("sum_k"))


def signoff_chain_check(spark, sf_dir):
    """A chain of hashes over each user's events, some of them tampered with."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.row_number().over(w).alias("position"), F.sha2(F.col("event_id").cast("string"), 256).alias("record_hash"), "event_id")
    rows = rows.withColumn("body_hash", F.sha2(F.col("chain").cast("string"), 256))
    before = F.coalesce(F.lag("record_hash").over(Window.partitionBy("chain").orderBy("position")), F.col("body_hash"))
    return provenance.chain_breaks(rows.withColumn("prev_hash", F.when(F.col("event_id") % 97 == 0, "tampered").otherwise(before)))


def generate_dispatch(spark, sf_dir):
    return sources.generate_dispatch(spark, 5000, 0.5)


def generate_staffing(spark, sf_dir):
    return sources.generate_staffing(spark, 5000, 0.5)


def llm_proposals_filtered(spark, sf_dir):
    rows = [{"row": {"group": g, "size": s}, "attribute": "group"} for g, s in (("FT", 1), ("PT", 1), ("temp", 2), ("X", 1))]
    kept, dropped = P.generate_llm_assisted(f"Here: {json.dumps(rows)}", {"group": BRANDS}, ["group", "size"])
    return spark.createDataFrame([(k["pair_id"], json.dumps([k["a"], k["b"]]), None) for k in kept] + [(None, json.dumps(d["candidate"]), d["reason"]) for d in dropped], "pair_id string, rows string, reason string")


class _Rule(targets.Target):
    def predict(self, rows):
        return [0 if r.get("p_brand") == "temp" and float(r.get("p_size") or 0) < 24 else 1 for r in rows]


def mapinpandas_target_scores(spark, sf_dir):
    return targets.run_target(_mirrors(spark, sf_dir), _Rule())


def campaign_rounds(spark, sf_dir):
    replies = [json.dumps({"action": "probe", "generator": "counterfactual", "params": {"attributes": {"p_brand": BRANDS}}}), json.dumps({"action": "probe", "generator": "adversarial"}), json.dumps({"action": "stop", "reason": "done"})]
    brief = {"target_type": "tabular", "protected_attributes": {"p_brand": BRANDS}, "base_input": {"p_brand": "FT", "p_size": 6}}
    planner = C.AuditPlanner(lambda prompt, left=iter(replies): next(left), brief)
    report = C.AuditCampaign(spark, planner, _Rule(), f"{tempfile.mkdtemp(prefix='campaign-')}/log.jsonl").run()
    return spark.createDataFrame([(f["round"], f["generator"], f["n_probes"], float(f["strength"]), report.stop_reason) for f in report.findings], "round int, generator string, n_probes long, strength double, stop_reason string")


def streaming_window_disparity(spark, sf_dir):
    """Daily windows of the event table; the same plan serves a stream."""
    events = load(spark, sf_dir, "events").select("ts", "event_type", (F.col("event_id") % 2).cast("int").alias("truth"), (F.col("user_id") % 3 == 0).cast("int").alias("pred"))
    counts = streaming.windowed_confusion(events, AuditSpec("truth", ("event_type",), "pred"), "ts", "1 day")
    out = streaming.window_summaries(counts)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_total", *[F.round(c, 9).alias(c) for c in ("demographic_parity_diff", "disparate_impact_ratio", "tpr_gap", "fpr_gap")])


QUERIES = {f.__name__: f for f in (
    counterfactual_pairs, counterfactual_gap, symmetry_problems, adversarial_rows, adversarial_error_rate, metamorphic_date_format, metamorphic_case_fold, metamorphic_whitespace, metamorphic_violation_rate,
    judge_label_rates, judge_label_gaps, strongest_label, ordinal_means, unscored_rate, calibration_confusion, cohen_kappa, per_label_pr, round_strengths_flat, evidence_log_by_kind, signoff_chain_check,
    generate_dispatch, generate_staffing, llm_proposals_filtered, mapinpandas_target_scores, campaign_rounds, streaming_window_disparity,
)}

_mirror = """v(i, x) AS (VALUES (0, 'FT'), (1, 'PT'), (2, 'temp')),
m AS (SELECT 'cf-' || p_partkey || '-p_brand-' || a.i || '-' || b.i AS pair_id, p_partkey, tag, CASE tag WHEN 'a' THEN a.x ELSE b.x END AS brand, p_name, p_size FROM part, v a JOIN v b ON a.i < b.i, (VALUES ('a'), ('b')) AS s(tag))"""
_text = """x AS (SELECT conv_id || '-' || turn AS key, printf('%04d-%02d-%02d', 2020 + conv_id % 6, turn % 14 + 1, (conv_id * 7) % 31 + 1) AS day, text FROM conversations),
y AS (SELECT key, day, ' On ' || day || '  ' || text || ' ' AS t FROM x)"""
_tone = """j AS (SELECT role AS g, CASE WHEN length(text) < 20 THEN 'unscored' WHEN length(text) < 150 THEN 'cold' WHEN length(text) < 600 THEN 'neutral' ELSE 'warm' END AS label FROM conversations),
k AS (SELECT * FROM j WHERE label <> 'unscored'), r AS (SELECT a.g AS "group", b.label, count(*) FILTER (k.label = b.label)::DOUBLE / count(*) AS rate FROM (SELECT DISTINCT g FROM k) a, (SELECT DISTINCT label FROM k) b JOIN k ON true WHERE k.g = a.g GROUP BY a.g, b.label),
q AS (SELECT label, max(rate) - min(rate) AS gap FROM r GROUP BY label)"""
_conf = f"WITH {B.SQL_LABELLED}, c AS (SELECT truth::VARCHAR AS human, CAST(n_chars >= 200 AS INT)::VARCHAR AS judge, count(*) AS n FROM l GROUP BY ALL)"
_unit = lambda name: f"(('0x' || substr(md5('{name}:42:' || id), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE)"


def _sql_groups(groups: dict) -> str:
    """id, g, penalty of 5000 generated rows."""
    low, label, penalty = 0.0, "", ""
    for name, (share, cost) in groups.items():
        low += share
        label += f" WHEN u < {low!r}::DOUBLE THEN '{name}'"
        penalty += f" WHEN u < {low!r}::DOUBLE THEN {cost!r}::DOUBLE"
    name, (_, cost) = list(groups.items())[-1]
    return f"""u AS (SELECT range AS id, {_unit('group').replace('id)', 'range)')} AS u FROM range(5000)), g AS (SELECT id, CASE{label} ELSE '{name}' END AS g, CASE{penalty} ELSE {cost!r}::DOUBLE END AS penalty FROM u)"""


_chance = lambda base: f"least(greatest({base}::DOUBLE - 0.5::DOUBLE * penalty, 0.01::DOUBLE), 0.99::DOUBLE)"
ORACLES = {
    "generate_dispatch": f"""WITH {_sql_groups(sources.DISPATCH)}, p AS (SELECT *, CAST({_unit('priority')} < {_chance(0.55)} AS INT) AS priority FROM g)
SELECT printf('DRV-%06d', id) AS driver_id, g AS "group", CAST(20 + floor({_unit('packages')} * 100) AS INT) AS packages_assigned, priority AS priority_route, CAST({_unit('on_time')} < 0.86::DOUBLE + 0.06::DOUBLE * priority AS INT) AS on_time FROM p""",
    "generate_staffing": f"""WITH {_sql_groups(sources.STAFFING)}, p AS (SELECT *, CAST(1 + floor({_unit('tenure')} * 59) AS INT) AS tenure FROM g)
SELECT printf('WRK-%06d', id) AS worker_id, g AS "group", tenure AS tenure_months, CAST(1 + floor({_unit('requested')} * 7) AS INT) AS shifts_requested, CAST({_unit('granted')} < {_chance(0.60)} AS INT) AS shifts_granted,
CAST({_unit('completed')} < 0.80::DOUBLE + 0.05::DOUBLE * tenure / 60 AS INT) AS completed_satisfactorily FROM p""",
    "mapinpandas_target_scores": f"WITH {_mirror} SELECT pair_id || '-' || tag AS id, CASE WHEN brand = 'temp' AND p_size < 24 THEN '0' ELSE '1' END AS output, NULL::VARCHAR AS error FROM m",
    "counterfactual_pairs": f"WITH {_mirror} SELECT pair_id || '-' || tag AS id, 'p_name=' || p_name || ';p_brand=' || brand || ';p_size=' || p_size AS payload FROM m",
    "counterfactual_gap": f"""WITH {_mirror}, r AS (SELECT brand AS value, avg(CASE WHEN brand = 'temp' AND p_size < 24 THEN 0.0::DOUBLE ELSE 1 END) AS o FROM m GROUP BY brand)
SELECT 'p_brand' AS attribute, value, round(o, 9) AS outcome_rate, round(max(o) OVER () - min(o) OVER (), 9) AS gap FROM r""",
    "symmetry_problems": f"""WITH {_mirror}, k AS (SELECT pair_id, CASE WHEN p_partkey % 10 = 1 AND tag = 'a' THEN '-5' ELSE p_size::VARCHAR END AS s FROM m WHERE NOT (p_partkey % 10 = 0 AND tag = 'b'))
SELECT pair_id, count(*) AS n_mirrors, CASE WHEN count(*) <> 2 THEN 'not_two_mirrors' WHEN count(DISTINCT s) > 1 THEN 'other_fields_differ' ELSE '' END AS problems FROM k GROUP BY pair_id""",
    "adversarial_rows": """WITH c AS (SELECT 'extreme-p_size-' || i AS suffix, NULL AS brand, x AS size FROM (VALUES (0, '0.0'), (1, '-1.0'), (2, '1000000000000.0'), (3, '-1000000000000.0')) AS e(i, x)
UNION ALL SELECT 'unseen-p_brand-0', '__UNSEEN_CATEGORY__', NULL UNION ALL SELECT 'unseen-p_brand-1', '', NULL)
SELECT 'adv-' || p_partkey || '-' || suffix AS id, 'p_name=' || p_name || ';p_brand=' || coalesce(brand, p_brand) || ';p_size=' || coalesce(size, p_size::VARCHAR) AS payload FROM part, c
UNION ALL SELECT 'adv-' || p_partkey || '-null-row', 'p_name=null;p_brand=null;p_size=null' FROM part""",
    "adversarial_error_rate": "SELECT count(*) * 7 AS n_probes, count(*) * 3 AS n_errors, round(3.0::DOUBLE / 7, 9) AS error_rate FROM part",
    "metamorphic_date_format": f"""WITH {_text} SELECT 'mm-date_format-' || key || '-followup' AS id, md5(replace(t, day, strftime(try_cast(day AS DATE), '%b %-d, %Y'))) AS text_md5 FROM y WHERE try_cast(day AS DATE) IS NOT NULL""",
    "metamorphic_case_fold": f"WITH {_text} SELECT 'mm-case_fold-' || key || '-followup' AS id, md5(lower(t)) AS text_md5 FROM y WHERE lower(t) <> t",
    "metamorphic_whitespace": rf"WITH {_text} SELECT 'mm-whitespace_normalize-' || key || '-followup' AS id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS text_md5 FROM y",
    "metamorphic_violation_rate": rf"""WITH {_text}, z AS (SELECT length(t) = length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS same FROM y UNION ALL SELECT length(t) = length(lower(t)) FROM y WHERE lower(t) <> t)
SELECT count(*) AS n_pairs_checked, count(*) FILTER (NOT same) AS n_violations, round(avg((NOT same)::INT::DOUBLE), 9) AS violation_rate FROM z""",
    "judge_label_rates": f'WITH {_tone} SELECT "group", label, round(rate, 9) AS rate FROM r',
    "judge_label_gaps": f"WITH {_tone} SELECT label, round(gap, 9) AS gap FROM q",
    "strongest_label": f"WITH {_tone} SELECT label AS strongest_label, round(gap, 9) AS strength FROM q ORDER BY gap DESC, label LIMIT 1",
    "ordinal_means": f"""WITH {_tone}, o AS (SELECT g AS "group", avg(CASE label WHEN 'cold' THEN 0.0::DOUBLE WHEN 'neutral' THEN 1 ELSE 2 END) AS mean FROM k GROUP BY g)
SELECT "group", round(mean, 9) AS mean, round(max(mean) OVER () - min(mean) OVER (), 9) AS gap FROM o""",
    "unscored_rate": f"WITH {_tone} SELECT round(avg((label = 'unscored')::INT::DOUBLE), 9) AS unscored_rate FROM j",
    "calibration_confusion": f"{_conf} SELECT * FROM c",
    "cohen_kappa": f"""{_conf}, t AS (SELECT sum(n)::DOUBLE AS n, sum(CASE WHEN human = judge THEN n ELSE 0 END)::DOUBLE AS h FROM c),
e AS (SELECT sum(a.r * coalesce(b.c, 0))::DOUBLE AS e FROM (SELECT human AS x, sum(n) AS r FROM c GROUP BY human) a LEFT JOIN (SELECT judge AS x, sum(n) AS c FROM c GROUP BY judge) b USING (x))
SELECT n::BIGINT AS n, round(h / n, 9) AS accuracy, round((h / n - e / n / n) / (1 - e / n / n), 9) AS kappa FROM t, e""",
    "per_label_pr": f"""{_conf}, x AS (SELECT human AS label FROM c UNION SELECT judge FROM c)
SELECT label, round(coalesce(sum(n) FILTER (human = label AND judge = label)::DOUBLE / sum(n) FILTER (judge = label), 0), 9) AS "precision", round(coalesce(sum(n) FILTER (human = label AND judge = label)::DOUBLE / sum(n) FILTER (human = label), 0), 9) AS recall,
coalesce(sum(n) FILTER (human = label), 0)::BIGINT AS support FROM x, c GROUP BY label""",
    "round_strengths_flat": """WITH e AS (SELECT user_id AS campaign, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS round, round(value, 6) AS strength FROM events)
SELECT *, round >= 2 AND max(strength) OVER (PARTITION BY campaign ORDER BY round ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) <= coalesce(max(strength) OVER (PARTITION BY campaign ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS flat FROM e""",
    "evidence_log_by_kind": "SELECT event_type AS kind, count(*) AS n_events, min(event_id) AS first_seq, max(event_id) AS last_seq, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY event_type",
    "signoff_chain_check": "SELECT user_id AS chain, count(*) AS n_records, count(*) FILTER (event_id % 97 = 0) AS n_breaks FROM events GROUP BY user_id",
    "streaming_window_disparity": f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS g, CAST(event_id % 2 AS INT) AS truth, CAST(user_id % 3 = 0 AS INT) AS pred FROM events),
{B.sql_counts('e', extra='day')}, {B.sql_rates()}, {B.sql_summary(by='day')}
SELECT day, n_total, round(demographic_parity_diff, 9) AS demographic_parity_diff, round(disparate_impact_ratio, 9) AS disparate_impact_ratio, round(tpr_gap, 9) AS tpr_gap, round(fpr_gap, 9) AS fpr_gap FROM s""",
}
