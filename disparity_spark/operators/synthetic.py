"""The whole synthetic-data audit: three axes, the worst wins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .. import __version__
from . import amplification, fidelity, privacy
from .disparity import AuditSpec

ORDER = ("pass", "review", "fail")
#: The limits of each axis under the names that a configuration uses.
LIMITS = {"fidelity": {"pass_score": fidelity.PASS, "review_score": fidelity.REVIEW}, "privacy": {"pass_risk": privacy.LOW_RISK, "review_risk": privacy.REVIEW_RISK}, "bias": amplification.LIMITS}


@dataclass(frozen=True)
class SyntheticAuditConfig:
    truth: str
    groups: tuple[str, ...]
    pred: str | None = None
    numeric: tuple[str, ...] | None = None
    categorical: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    seed: int = 42
    thresholds: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, document: dict) -> SyntheticAuditConfig:
        if not isinstance(document, dict):
            raise ValueError("the configuration must be a mapping")
        unknown = set(document) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        if not isinstance(document.get("truth"), str) or not document.get("groups"):
            raise ValueError("the configuration needs truth and groups")
        for axis, limits in (document.get("thresholds") or {}).items():
            if axis not in LIMITS or not isinstance(limits, dict) or not set(limits) <= set(LIMITS[axis]):
                raise ValueError(f"unknown threshold in {axis!r}")
            if wrong := [k for k, v in limits.items() if isinstance(v, bool) or not isinstance(v, (int, float))]:
                raise ValueError(f"thresholds must be numbers: {', '.join(wrong)}")
        tupled = {k: tuple(v) if isinstance(v, list) else v for k, v in document.items()}
        return cls(**tupled | {"thresholds": document.get("thresholds") or {}})

    @property
    def spec(self) -> AuditSpec:
        return AuditSpec(self.truth, tuple(self.groups), self.pred)


def _judged(axis: dict, name: str, limits: dict) -> dict:
    """The fidelity or privacy axis under its limits."""
    if name == "fidelity":
        score = axis["fidelity_score"]
        major = any(f["code"] == "vanished_categories" and f["source_support"] >= fidelity.MAJOR_SHARE for f in axis["findings"])
        return axis | {"verdict": ("review" if major else "pass") if score >= limits["pass_score"] else "review" if score >= limits["review_score"] else "fail"}
    risk = axis["privacy_risk"]
    return axis | {"verdict": "pass" if risk <= limits["pass_risk"] else "review" if risk <= limits["review_risk"] else "fail"}


def audit_synthetic(source: DataFrame, synthetic: DataFrame, config: SyntheticAuditConfig, bootstrap: int = 200, bootstrap_seed: int = 42) -> dict:
    """The document of all axes; raises ValueError for an empty table or missing columns."""
    counts = source.count(), synthetic.count()
    if not all(counts):
        raise ValueError("both tables need rows")
    numeric, categorical = fidelity.resolve_columns(source, synthetic, config.numeric, config.categorical, config.exclude)
    limits = {name: known | (config.thresholds.get(name) or {}) for name, known in LIMITS.items()}
    axes = {
        "fidelity": fidelity.audit_fidelity(source, synthetic, numeric, categorical),
        "privacy": privacy.audit_privacy(source, synthetic, numeric, categorical, seed=config.seed),
        "bias": amplification.audit_bias_amplification(source, synthetic, config.spec, bootstrap, bootstrap_seed, limits["bias"]),
    }
    axes |= {k: _judged(axes[k], k, limits[k]) for k in ("fidelity", "privacy")}
    return {"verdict": max((a["verdict"] for a in axes.values()), key=ORDER.index), "version": __version__, "axes": axes, "columns": {"numeric": numeric, "categorical": categorical}, "n_source": counts[0], "n_synthetic": counts[1]}
