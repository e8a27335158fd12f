"""Regulatory lookups: risk tiers, their cross-check with the gate, and the mapping to a risk framework."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Use-case keys with their tier and article, in order.
PROHIBITED = ("social_scoring", "realtime_remote_biometric_id_public", "biometric_categorization_sensitive", "emotion_inference_work_education", "predictive_policing_profiling", "untargeted_facial_scraping", "manipulative_subliminal", "vulnerability_exploitation")
HIGH_RISK = {
    "biometric_id_verification": 1, "critical_infrastructure": 2, "education_admissions": 3, "education_evaluation": 3, "employment_recruitment": 4, "employment_management": 4,
    "credit_scoring": 5, "public_benefits_eligibility": 5, "insurance_pricing": 5, "emergency_dispatch": 5, "law_enforcement_risk": 6, "law_enforcement_evidence": 6,
    "migration_asylum_border": 7, "justice_recidivism": 8, "democratic_process": 8,
}
TRANSPARENCY = ("conversational_ai", "emotion_recognition", "biometric_categorization", "ai_generated_content")
TIERS = ("prohibited", "high_risk", "transparency", "minimal")
VERDICTS = ("hard_stop", "conditional_pass", "blocked", "pass")

OBLIGATIONS = {
    "prohibited": ["The practice may not be placed on the market, put into service or used."],
    "high_risk": ["Keep a risk management system (Art. 9).", "Govern training and test data (Art. 10).", "Keep technical documentation and logs (Arts. 11-12).", "Inform deployers and provide human oversight (Arts. 13-14).", "Ensure accuracy, robustness and security (Art. 15).", "Assess conformity and register before deployment (Arts. 43, 49)."],
    "transparency": ["Tell people that they deal with an AI system or with generated content (Art. 50)."],
    "minimal": [],
}


def use_cases() -> list[tuple[str, str, int, str]]:
    """key, tier, rank (0 is the strictest), article."""
    out = [(k, "prohibited", 0, "Art. 5") for k in PROHIBITED]
    out += [(k, "high_risk", 1, f"Art. 6 / Annex III({n})") for k, n in HIGH_RISK.items()]
    return out + [(k, "transparency", 2, "Art. 50") for k in TRANSPARENCY]


def tier_table(spark: SparkSession) -> DataFrame:
    """27 fixed rows, for broadcast joins."""
    return spark.createDataFrame(use_cases(), "use_case string, tier string, tier_rank int, article string")


@dataclass(frozen=True)
class SystemProfile:
    name: str = ""
    use_cases: tuple[str, ...] = ()
    deploys_in_eu: bool = True


@dataclass(frozen=True)
class Classification:
    tier: str
    matches: list[dict] = field(default_factory=list)
    obligations: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class CrossCheck:
    gate_status: str
    tier: str
    verdict: str
    rationale: str
    obligations: list[str]


def classify_system(profile: SystemProfile | dict) -> Classification:
    """The strictest tier of the use cases, with the matches and duties of every tier that applies."""
    keys = profile["use_cases"] if isinstance(profile, dict) else profile.use_cases
    known = {k: (tier, rank, article) for k, tier, rank, article in use_cases()}
    if unknown := [k for k in keys if k not in known]:
        raise ValueError(f"unknown use cases: {', '.join(map(str, unknown))}")
    matches = [{"use_case": k, "tier": known[k][0], "article": known[k][2]} for k in keys]
    tier = TIERS[min((known[k][1] for k in keys), default=3)]
    applying = ["prohibited"] if tier == "prohibited" else [t for t in TIERS if t == tier or any(m["tier"] == t for m in matches)]
    return Classification(tier, matches, [o for t in applying for o in OBLIGATIONS[t]])


def classify_systems(profiles: DataFrame, spark: SparkSession) -> DataFrame:
    """system, tier, unknown (keys that aren't in the vocabulary) for rows (system, use_case)."""
    joined = profiles.join(F.broadcast(tier_table(spark)), "use_case", "left")
    one = joined.groupBy("system").agg(F.min("tier_rank").alias("rank"), F.count_if(F.col("use_case").isNotNull() & F.col("tier").isNull()).alias("unknown"))
    return one.select("system", F.element_at(F.array(*map(F.lit, TIERS)), F.coalesce("rank", F.lit(3)) + 1).alias("tier"), "unknown")


def cross_check(gate_status: Column, tier: Column) -> Column:
    passed = gate_status == "pass"
    return F.when(tier == "prohibited", "hard_stop").when(~passed, "blocked").when(tier == "high_risk", "conditional_pass").otherwise("pass")


def cross_check_gate(gate_status: str, classification: Classification) -> CrossCheck:
    """The stricter of the statistical gate and the legal tier."""
    if gate_status not in ("pass", "fail", "review"):
        raise ValueError(f"unknown gate status {gate_status!r}")
    tier = classification.tier
    if tier == "prohibited":
        verdict, why = "hard_stop", "The practice is prohibited, whatever the gate says."
    elif gate_status != "pass":
        verdict, why = "blocked", f"The gate's status is {gate_status}."
    elif tier == "high_risk":
        verdict, why = "conditional_pass", "The gate passed; the duties of the high-risk tier come before deployment."
    else:
        verdict, why = "pass", "The gate passed, and only notices to users are due." if tier == "transparency" else "The gate passed, and the tier asks for nothing more."
    return CrossCheck(gate_status, tier, verdict, why, classification.obligations)


def eu_ai_act_section(profile: SystemProfile | dict, gate_status: str | None = None) -> dict:
    """The section of a report on risk tiers."""
    found = classify_system(profile)
    out = {"tier": found.tier, "matches": found.matches, "obligations": found.obligations}
    if gate_status:
        checked = cross_check_gate(gate_status, found)
        out |= {"verdict": checked.verdict, "rationale": checked.rationale}
    return out


# The four functions of the risk framework, by what an audit provides.
RMF_MAPPING = {
    "demographic_parity_diff": ("Measure", "How far selection rates lie apart between groups."),
    "disparate_impact_ratio": ("Measure", "Whether a group is selected at less than four fifths of another's rate."),
    "tpr_gap": ("Measure", "Whether deserving cases are found equally often in all groups."),
    "fpr_gap": ("Measure", "Whether wrong positives burden groups unequally."),
    "synthetic_data_generators": ("Map", "Scenarios that describe the context of use before real data exist."),
    "deployment_gate": ("Manage", "A release decision that rests on measured disparity."),
    "audit_report": ("Govern", "A durable record for those who oversee the system."),
}
#: aspect: (function, subcategory, needs judges, what it rests on, what it doesn't show)
AGENTIC_RMF_MAPPING = {
    "adaptive_disparity_measurement": ("MEASURE", "MEASURE 2.11", False, "Probe campaigns compare outcomes across protected attributes.", "Only probed scenarios are covered."),
    "probe_batteries_as_test_sets": ("MEASURE", "MEASURE 2.1", False, "Probe batches are generated deterministically and logged.", "It documents this audit alone."),
    "deployment_context_drills": ("MEASURE", "MEASURE 2.3", False, "Probes start from a base input of the context of use.", "It is not a field test."),
    "robustness_probing": ("MEASURE", "MEASURE 2.7", False, "Extreme and hostile inputs count unhandled errors.", "It is not a security review."),
    "judge_calibration": ("MEASURE", "MEASURE 2.13", True, "Judges are held against human labels before use.", "The labelled sets are small."),
    "append_only_evidence": ("GOVERN", "GOVERN 1.4", False, "Every event is logged in order.", "The log doesn't attest who ran it."),
    "risk_tracking": ("MANAGE", "MANAGE 2.2", False, "Findings carry a strength that can be followed over time.", "No monitoring follows from it."),
    "scope_statement": ("MAP", "MAP 1.1", False, "The brief states attributes, risks and limits.", "It repeats what its author wrote."),
}


def mappings_for_report(judges_used: bool) -> list[dict]:
    return [{"aspect": k, "function": f, "subcategory": s, "rationale": why, "limits": limits} for k, (f, s, judged, why, limits) in AGENTIC_RMF_MAPPING.items() if judges_used or not judged]


def rmf_section(checks=None) -> list[dict]:
    return [{"aspect": k, "function": f, "rationale": why} for k, (f, why) in RMF_MAPPING.items() if checks is None or k in checks]
