"""Command line: generate, audit, gate, gate-run, verify, signoff, audit-synthetic. Exit codes: 0 pass, 1 fail, 2 review."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from . import sources
from .operators import gate, gate_run, provenance, reports, synthetic
from .operators.disparity import METRICS, AuditResult, AuditSpec, audit_disparities
from .session import get_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="disparity-spark", description=__doc__)
    p.add_argument("--master", help="Spark master URL")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("generate")
    c.add_argument("scenario", choices=("dispatch", "staffing")), c.add_argument("--n", type=int, default=5000), c.add_argument("--bias", type=float, default=0.0), c.add_argument("--seed", type=int, default=42), c.add_argument("--out", required=True)
    c = sub.add_parser("audit")
    c.add_argument("data"), c.add_argument("--truth", required=True), c.add_argument("--pred"), c.add_argument("--group", action="append", required=True), c.add_argument("--context"), c.add_argument("--min-group-n", type=int), c.add_argument("--bootstrap", type=int, default=0), c.add_argument("--bootstrap-seed", type=int, default=42), c.add_argument("--out", required=True)
    c = sub.add_parser("gate")
    c.add_argument("report"), c.add_argument("--thresholds")
    c = sub.add_parser("gate-run")
    c.add_argument("config"), c.add_argument("--sha"), c.add_argument("--run-url"), c.add_argument("--out-dir", default="gate-out")
    c = sub.add_parser("verify")
    c.add_argument("report"), c.add_argument("data"), c.add_argument("--thresholds")
    c = sub.add_parser("signoff")
    c.add_argument("report"), c.add_argument("--reviewer", required=True), c.add_argument("--decision", choices=provenance.DECISIONS, required=True), c.add_argument("--note", default="")
    c = sub.add_parser("audit-synthetic")
    c.add_argument("source"), c.add_argument("synthetic"), c.add_argument("--config", required=True), c.add_argument("--bootstrap", type=int, default=200), c.add_argument("--bootstrap-seed", type=int, default=42), c.add_argument("--out", required=True)
    return p


def _inputs(spark, path: str, rows: int) -> dict:
    return {"path": path, "rows": rows, "sha256": provenance.sha256_file(path)} if Path(path).is_file() else {"path": path} | provenance.content_digest(sources.read_table(spark, path))


def _audited(spark, data: str, args: dict) -> AuditResult:
    spec = AuditSpec(args["truth"], tuple(args["group"]), args["pred"])
    return audit_disparities(sources.read_table(spark, data), spec, None, args["min_group_n"], args["bootstrap"], args["bootstrap_seed"], sources.load_context(args["context"]))


def verify(spark, report: dict, data: str, thresholds: dict | None = None) -> dict:
    """Seven checks of a report against its data."""
    found = report.get("provenance") or {}
    known, ledger = found.get("input") or {}, provenance.Ledger(report)
    rerun, failed = None, "the report wasn't made by an audit"
    if found.get("run", {}).get("command") == "audit":
        try:
            rerun = _audited(spark, data, found["run"]["args"])
        except (ValueError, KeyError) as e:
            failed = f"the audit can't be run again: {e}"
    differ = [failed] if rerun is None else [m for m in METRICS if getattr(rerun, m) != report.get(m)] + ["groups"] * (rerun.to_dict()["groups"] != report["groups"]) + ["confidence_intervals"] * (rerun.confidence_intervals != report.get("confidence_intervals", {}))
    status = gate.evaluate_gate_status(AuditResult.from_dict(report), thresholds)["status"]
    recorded = (found.get("gate") or {}).get("status")
    now = _inputs(spark, data, known.get("rows"))
    #: check -> what is wrong; empty if nothing is.
    wrong = {
        "provenance_present": "" if found else "the report has no provenance",
        "data_hash": "no input is recorded" if not known else "" if now == known | {"path": data} else f"the data was changed after the audit: {', '.join(k for k in now if k != 'path' and now[k] != known.get(k))}",
        "row_count": failed if rerun is None else "" if rerun.n_total == known.get("rows") else f"{rerun.n_total} rows, {known.get('rows')} recorded",
        "body_hash": "; ".join(ledger.body_breaks()),
        "signoff_chain": "; ".join(ledger.chain_breaks()),
        "deterministic_rerun": f"a new run differs: {', '.join(differ)}" if differ else "",
        "gate_status": "" if thresholds is not None or status == recorded else f"the status is {status}, {recorded} recorded",
    }
    return {"verified": not any(wrong.values()), "checks": [{"check": k, "passed": not v, "detail": v or ("status " + status if k == "gate_status" else "holds")} for k, v in wrong.items()]}


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    try:
        return run(a)
    except (ValueError, OSError) as e:
        p.exit(2, f"error: {e}\n")


def run(a: argparse.Namespace) -> int:
    needs_spark = a.command not in ("gate", "signoff")
    spark = get_session(a.master) if needs_spark else None
    overrides = sources.load_yaml(a.thresholds) if getattr(a, "thresholds", None) else None
    if a.command == "generate":
        df = getattr(sources, f"generate_{a.scenario}")(spark, a.n, a.bias, a.seed)
        kind = sources.FORMATS.get(Path(a.out).suffix, "csv")
        df.write.mode("overwrite").format(kind).options(**({"header": True} if kind == "csv" else {})).save(a.out)
        side = provenance.build_provenance("generate", {"scenario": a.scenario, "n": a.n, "bias": a.bias}, a.seed, provenance.content_digest(df))
        Path(a.out).with_suffix(".provenance.json").write_text(json.dumps(side, indent=2), encoding="utf-8")
        return 0
    if a.command == "audit":
        args = {k: getattr(a, k) for k in ("truth", "pred", "group", "context", "min_group_n", "bootstrap", "bootstrap_seed")}
        result = _audited(spark, a.data, args)
        state = gate.evaluate_gate_status(result)["status"]
        made = provenance.build_provenance("audit", args, a.bootstrap_seed, _inputs(spark, a.data, result.n_total), {"status": state, "thresholds": result.thresholds})
        reports.save_report(result, a.out, made)
        print(json.dumps({"status": state} | {m: getattr(result, m) for m in METRICS}))
        return 0
    if a.command == "gate":
        out = gate.evaluate_gate_status(AuditResult.from_dict(sources.load_report(a.report)), overrides)
        print(json.dumps(out, indent=2))
        return gate.EXIT[out["status"]]
    if a.command == "gate-run":
        verdict, result = gate_run.run_gate(spark, gate_run.load_gate_config(a.config), a.sha)
        gate_run.write_gate_outputs(verdict, result, a.out_dir, a.run_url)
        print(gate_run.render_verdict_markdown(verdict, a.run_url))
        return verdict["exit_code"]
    if a.command == "verify":
        out = verify(spark, sources.load_report(a.report), a.data, overrides)
        print(json.dumps(out, indent=2))
        return 0 if out["verified"] else 1
    if a.command == "signoff":
        signed = provenance.Ledger(sources.load_report(a.report)).signed(a.reviewer, a.decision, a.note)
        Path(a.report).write_text(json.dumps(signed, indent=2, ensure_ascii=False), encoding="utf-8")
        return 0
    config = synthetic.SyntheticAuditConfig.from_dict(sources.load_yaml(a.config))
    frames = [sources.read_table(spark, path) for path in (a.source, a.synthetic)]
    document = synthetic.audit_synthetic(*frames, config, a.bootstrap, a.bootstrap_seed)
    inputs = {name: _inputs(spark, path, document[f"n_{name}"]) for name, path in (("source", a.source), ("synthetic", a.synthetic))}
    document["provenance"] = provenance.build_provenance("audit-synthetic", {"config": a.config, "bootstrap": a.bootstrap}, a.bootstrap_seed, inputs)
    Path(a.out).write_text(json.dumps(provenance.Ledger(document).sealed(), indent=2, ensure_ascii=False), encoding="utf-8")
    return gate.EXIT[document["verdict"]]


if __name__ == "__main__":
    raise SystemExit(main())
