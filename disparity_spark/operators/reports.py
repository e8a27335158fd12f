"""Report documents in Markdown, HTML and JSON. Their inputs are small aggregates; everything here runs on the driver."""

from __future__ import annotations

import html
import json
from pathlib import Path

from .disparity import METRICS, AuditResult
from .gate import evaluate_gate_status
from .. import __version__
from .provenance import Ledger, git_info, utc_now
from .regulatory import mappings_for_report, rmf_section

CONFIRMED = 0.2


def fmt(value) -> str:
    return "n/a" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def cell(value) -> str:
    return fmt(value).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def md_table(head: list[str], rows: list[list]) -> str:
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])


def html_table(head: list[str], rows: list[list]) -> str:
    line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(fmt(v))}</{tag}>" for v in r) + "</tr>"
    return "<table>" + line("th", head) + "".join(line("td", r) for r in rows) + "</table>"


def _sections(result: AuditResult) -> list[tuple[str, list[str], list[list]]]:
    gate = evaluate_gate_status(result)
    ends = lambda m: "{lower:.4f} to {upper:.4f}".format(**result.confidence_intervals[m]) if m in result.confidence_intervals else None
    return [
        ("Gate", ["check", "value", "status"], [["overall", None, gate["status"]], *[[f["check"], f["value"], f["status"]] for f in gate["findings"]]]),
        ("Disparity", ["metric", "value", "interval"], [[m, getattr(result, m), ends(m)] for m in METRICS]),
        ("Groups", ["group", "n", "selection rate", "TPR", "FPR", "precision", "accuracy"], [[g.group, g.n, g.selection_rate, g.tpr, g.fpr, g.precision, g.accuracy] for g in result.groups]),
        ("Review", ["reason", "detail"], [[r["code"], r.get("detail", "")] for r in result.review_reasons]),
        ("Context", ["key", "value"], [[k, v] for k, v in result.context.items()]),
        ("Risk framework", ["aspect", "function", "rationale"], [[r["aspect"], r["function"], r["rationale"]] for r in rmf_section()]),
    ]


def _written(title: str, sections) -> tuple[str, str]:
    shown = [s for s in sections if s[2]]
    md = f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{md_table(head, rows)}" for name, head, rows in shown) + "\n"
    body = "".join(f"<h2>{html.escape(name)}</h2>{html_table(head, rows)}" for name, head, rows in shown)
    return md, f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def to_markdown(result: AuditResult, title: str = "Disparity audit") -> str:
    return _written(title, _sections(result))[0]


def to_html(result: AuditResult, title: str = "Disparity audit") -> str:
    return _written(title, _sections(result))[1]


def _save(stem: str, document: dict, md: str, page: str) -> dict[str, Path]:
    out = {s: Path(f"{stem}.{s}") for s in ("md", "html", "json")}
    out["md"].parent.mkdir(parents=True, exist_ok=True)
    out["md"].write_text(md, encoding="utf-8")
    out["html"].write_text(page, encoding="utf-8")
    out["json"].write_text(json.dumps(Ledger(document).sealed(), indent=2, ensure_ascii=False), encoding="utf-8")
    return out


def save_report(result: AuditResult, stem: str, provenance: dict | None = None, title: str = "Disparity audit") -> dict[str, Path]:
    """stem.md, stem.html and stem.json, the last with the hash of its body."""
    return _save(stem, result.to_dict() | {"provenance": provenance or {}}, to_markdown(result, title), to_html(result, title))


def build_report(campaign: dict, target: dict, judges: list[dict] = (), provenance: dict | None = None) -> dict:
    """The document of a campaign: verdict, summary, method, findings and limits."""
    best = campaign["best_strength"]
    top = max(campaign["findings"], key=lambda f: f["strength"], default=None)  # the first wins ties
    verdict = "disparity_found" if best >= CONFIRMED else "no_material_disparity"
    summary = f"{campaign['probes_used']} probes in {campaign['rounds']} rounds; the strongest signal is {best:.4f}" + (f" ({top['generator']}, round {top['round']})." if top else ".")
    cards = [{k: j.get(k) for k in ("judge_id", "model_id", "kappa", "accuracy", "n_paired", "passed", "per_label")} for j in judges]
    how = {"generators": sorted({f["generator"] for f in campaign["findings"]}), "statistics": "computed by aggregation over all probes of a round, never by a model", "judges": cards}
    again = {"seed": campaign["seed"], "brief": campaign["brief"], "evidence": campaign["evidence_path"]}
    return {
        "title": "Probe campaign", "generated_utc": utc_now(), "package_version": __version__, "git_commit": git_info()["git_sha"], "verdict": verdict, "flag_threshold": CONFIRMED, "executive_summary": summary,
        "target": target, "target_name": target.get("name") or target.get("model") or target.get("type", ""), "methodology": how, "reproducibility": again, "brief": campaign["brief"], "seed": campaign["seed"],
        "rounds": campaign["rounds"], "probes_used": campaign["probes_used"], "stop_reason": campaign["stop_reason"], "findings": campaign["findings"], "best_strength": best, "judges": cards,
        "evidence": {"path": campaign["evidence_path"], "n_events": campaign["n_events"]}, "risk_framework": mappings_for_report(bool(cards)),
        "limits": "Only the probed scenarios are covered; findings call for confirmation on decision data.", "provenance": provenance or {},
    }


def _campaign_sections(d: dict):
    signal = lambda f: ", ".join(f"{k} {v:.4f}" for k, v in (f["details"].get("gaps") or {}).items()) or fmt(f["strength"])
    return [
        ("Summary", ["item", "value"], [["verdict", d["verdict"]], ["summary", d["executive_summary"]], ["stopped by", d["stop_reason"]], ["limits", d["limits"]]]),
        ("Findings", ["round", "generator", "probes", "strength", "signal"], [[f["round"], f["generator"], f["n_probes"], f["strength"], signal(f)] for f in d["findings"]]),
        ("Judges", ["judge", "kappa", "accuracy", "passed"], [[j["judge_id"], j["kappa"], j["accuracy"], j["passed"]] for j in d["judges"]]),
        ("Risk framework", ["aspect", "function", "rationale", "limits"], [[r["aspect"], r["function"], r["rationale"], r["limits"]] for r in d["risk_framework"]]),
    ]


def campaign_markdown(document: dict) -> str:
    return _written(document["title"], _campaign_sections(document))[0]


def campaign_html(document: dict) -> str:
    return _written(document["title"], _campaign_sections(document))[1]


def save_campaign_report(document: dict, stem: str) -> dict[str, Path]:
    return _save(stem, document, campaign_markdown(document), campaign_html(document))
