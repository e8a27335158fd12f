"""The gate in continuous integration: a configuration file in, a verdict document out."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from .. import __version__
from ..sources import load_context, load_yaml, read_table
from .disparity import METRICS, AuditSpec, audit_disparities, merged_thresholds
from .gate import decide_exit, evaluate_gate_status
from .provenance import build_provenance, sha256_file, utc_now
from .reports import md_table, save_report

SCHEMA = "disparity-gate-verdict/1"


@dataclass(frozen=True)
class GateConfig:
    data: str
    spec: AuditSpec
    min_group_n: int | None = None
    bootstrap: int = 0
    bootstrap_seed: int = 42
    context: str | None = None
    thresholds: dict | None = None
    fail_mode: str = "block"
    review: str = "block"


def _whole(value, name: str, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")
    return value


def load_gate_config(path: str) -> GateConfig:
    """Version 1: audit (data, truth, pred, groups, ...), thresholds, gate (fail_mode, review). Unknown keys are refused."""
    document = load_yaml(path)
    audit, gate = document.get("audit"), document.get("gate") or {}
    if document.get("version", 1) != 1:
        raise ValueError("only version 1 is known")
    if not isinstance(audit, dict) or not isinstance(gate, dict):
        raise ValueError("audit and gate must be mappings")
    allowed = {"": ({"version", "audit", "thresholds", "gate"}, document), "audit": ({"data", "truth", "pred", "groups", "min_group_n", "bootstrap", "bootstrap_seed", "context"}, audit), "gate": ({"fail_mode", "review"}, gate)}
    for where, (keys, part) in allowed.items():
        if unknown := set(part) - keys:
            raise ValueError(f"unknown keys {where}: {', '.join(sorted(map(str, unknown)))}")
    groups = audit.get("groups")
    if not isinstance(groups, list) or not groups or not all(isinstance(g, str) for g in groups):
        raise ValueError("audit.groups must be a list of column names")
    for key, needed in (("data", True), ("truth", True), ("pred", False), ("context", False)):
        if (needed or audit.get(key) is not None) and not (isinstance(audit.get(key), str) and audit[key]):
            raise ValueError(f"audit.{key} must be a string")
    if gate.get("fail_mode", "block") not in ("block", "advisory") or gate.get("review", "block") not in ("block", "pass"):
        raise ValueError("gate.fail_mode is block or advisory, gate.review is block or pass")
    merged_thresholds(document.get("thresholds"))
    least = audit.get("min_group_n")
    return GateConfig(audit["data"], AuditSpec(audit["truth"], tuple(groups), audit.get("pred")), None if least is None else _whole(least, "min_group_n", 1), _whole(audit.get("bootstrap", 0), "bootstrap", 0), _whole(audit.get("bootstrap_seed", 42), "bootstrap_seed", 0), audit.get("context"), document.get("thresholds"), gate.get("fail_mode", "block"), gate.get("review", "block"))


def run_gate(spark: SparkSession, config: GateConfig, commit_sha: str | None = None) -> tuple[dict, object]:
    """(verdict document, audit result): the table is read and audited once."""
    result = audit_disparities(read_table(spark, config.data), config.spec, config.thresholds, config.min_group_n, config.bootstrap, config.bootstrap_seed, load_context(config.context))
    gate = evaluate_gate_status(result)
    groups = [{k: v for k, v in vars(g).items() if k != "precision"} for g in result.groups]
    data = Path(config.data)
    return {
        "schema": SCHEMA, "timestamp_utc": utc_now(), "commit_sha": commit_sha, "version": __version__, "config": {"data": config.data, "truth": config.spec.truth, "pred": config.spec.pred, "groups": list(config.spec.groups), "fail_mode": config.fail_mode, "review": config.review},
        "thresholds": result.thresholds, "status": gate["status"], "exit_code": decide_exit(gate["status"], config.fail_mode, config.review), "findings": gate["findings"], "metrics": {m: getattr(result, m) for m in METRICS}, "groups": groups,
        "review_reasons": result.review_reasons, "warnings": result.warnings, "data_sha256": sha256_file(config.data) if data.is_file() else None,
    }, result


def render_verdict_markdown(verdict: dict, run_url: str | None = None) -> str:
    slices = sorted(verdict["groups"], key=lambda g: (g["selection_rate"], g["group"]))
    parts = [f"## Disparity gate: {verdict['status'].upper()}", md_table(["check", "value", "status"], [[f["check"], f["value"], f["status"]] for f in verdict["findings"]]), md_table(["group", "n", "selection rate"], [[g["group"], g["n"], g["selection_rate"]] for g in slices])]
    if verdict["warnings"]:
        parts.append("\n".join(f"- {w}" for w in verdict["warnings"]))
    return "\n\n".join([*parts, *([f"[run]({run_url})"] if run_url else [])]) + "\n"


def append_verdict_log(verdict: dict, path: str) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(verdict, ensure_ascii=False) + "\n")


def write_gate_outputs(verdict: dict, result, out_dir: str, run_url: str | None = None) -> None:
    """verdict.json, verdict.md, a line in verdicts.jsonl, and the audit report with its provenance."""
    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    (out / "verdict.json").write_text(json.dumps(verdict, indent=2, ensure_ascii=False), encoding="utf-8")
    (out / "verdict.md").write_text(render_verdict_markdown(verdict, run_url), encoding="utf-8")
    append_verdict_log(verdict, str(out / "verdicts.jsonl"))
    inputs = {"path": verdict["config"]["data"], "sha256": verdict["data_sha256"], "rows": result.n_total}
    save_report(result, str(out / "report"), build_provenance("gate-run", verdict["config"], None, inputs, {"status": verdict["status"], "thresholds": verdict["thresholds"]}))
