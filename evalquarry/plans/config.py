"""Release policies and experiments from YAML: strict parsing, resolution, differences.

Policies, manifests and configurations are documents of a few kilobytes, handled on the driver.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from evalquarry.functions.identity import digest

DIRECTIONS = ("higher_is_better", "lower_is_better")
TARGETS = ("query", "final_retrieval")


class ConfigError(ValueError):
    """A document that doesn't say what it must."""


@dataclass(frozen=True)
class Check:
    id: str
    metric: str
    target: str = "final_retrieval"
    direction: str = "higher_is_better"
    max_regression: float = 0.0
    min_paired_n: int = 20
    estimator: str = "mean"
    k: int = 10
    pipeline: str | None = None


@dataclass(frozen=True)
class Slice:
    id: str
    field: str
    value: Any
    checks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    id: str
    version: int
    checks: tuple[Check, ...]
    slices: tuple[Slice, ...] = ()
    confidence: float = 0.95
    alpha: float = 0.05
    resamples: int = 1000
    seed: int = 42
    min_coverage: float = 0.95
    max_failure_rate: float = 0.0
    expected_changes: tuple[str, ...] = ()
    digest: str = ""

    @property
    def family(self) -> int:
        """Declared checks, and those of each slice (all where it names none)."""
        return len(self.checks) + sum(len(s.checks) or len(self.checks) for s in self.slices)

    @property
    def adjusted(self) -> float:
        return max(self.confidence, 1 - self.alpha / max(self.family, 1))


def _only(raw: Mapping, known: set[str], what: str) -> None:
    if extra := set(raw) - known:
        raise ConfigError(f"{what} has unknown fields {sorted(extra)}")


def least_resamples(adjusted: float) -> int:
    return math.ceil(40 / (1 - adjusted) - 1e-9)


def policy(text: str) -> Policy:
    """A policy of schema 3, or of schema 2, whose guards name positions (see converted)."""
    import yaml

    raw = yaml.safe_load(text)
    if not isinstance(raw, Mapping):
        raise ConfigError("a policy is a mapping")
    if raw.get("schema_version") == 2:
        raw = converted(raw)
    _only(raw, {"schema_version", "id", "metrics", "slices", "statistics", "execution", "intervention"}, "the policy")
    if raw.get("schema_version") != 3 or not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", str(raw.get("id", ""))):
        raise ConfigError("a policy has schema_version 3 and an id of lower-case letters, digits and ._-")
    checks = []
    for m in raw.get("metrics") or ():
        _only(m, set(Check.__dataclass_fields__), f"check {m.get('id')}")
        c = Check(**m)
        if c.direction not in DIRECTIONS or not (c.target in TARGETS or c.target.startswith("operator:")) or c.max_regression < 0:
            raise ConfigError(f"check {c.id} has a wrong direction, target or margin")
        checks.append(c)
    if not checks or len({c.id for c in checks}) < len(checks):
        raise ConfigError("a policy has checks with ids of their own")
    slices = tuple(Slice(s["id"], s["field"], s["value"], tuple(s.get("checks", ()))) for s in raw.get("slices") or ())
    if unknown := {c for s in slices for c in s.checks} - {c.id for c in checks}:
        raise ConfigError(f"slices name unknown checks {sorted(unknown)}")
    s = raw.get("statistics") or {}
    _only(s, {"confidence", "alpha", "resamples", "seed", "min_coverage"}, "statistics")
    out = Policy(
        raw["id"], 3, tuple(checks), slices, **s, max_failure_rate=float((raw.get("execution") or {}).get("max_failure_rate", 0.0)),
        expected_changes=tuple((raw.get("intervention") or {}).get("expected_changes", ())), digest=digest(raw),
    )
    if out.resamples * (1 - out.adjusted) / 2 < 20:
        raise ConfigError(f"{out.resamples} resamples can't resolve {out.family} checks; {least_resamples(out.adjusted)} can")
    return out


def converted(raw: Mapping) -> dict:
    """Schema 2, whose guards are keys pipeline|stageN|metric@k, as schema 3: stage -1 becomes
    the final answer or, for what queries have as a whole, the query."""
    checks = []
    for n, g in enumerate(raw.get("metrics") or (), 1):
        found = re.fullmatch(r"([^|]+)\|stage(-?\d+)\|([a-z_]+)@(\d+)(?:\|branch=(.+))?", str(g.get("metric", "")))
        if not found:
            raise ConfigError(f"guard {n} names no metric key")
        pipeline, stage, metric, k, branch = found.groups()
        whole = metric in ("latency_ms", "failure_rate")
        if int(stage) >= 0 and not branch:
            raise ConfigError(f"guard {n}: stage {stage} is a position; name an operator")
        target = f"operator:{branch}" if branch else "query" if whole else "final_retrieval"
        name = re.sub(r"[^a-z0-9._-]+", "-", f"{pipeline}-{metric}-{k}-{target}".lower()).strip("-")
        checks.append({"id": name, "metric": metric, "target": target, "k": int(k), "pipeline": pipeline} | {x: g[x] for x in ("direction", "max_regression", "min_paired_n", "estimator") if x in g})
    return {x: raw[x] for x in ("id", "slices", "statistics", "execution", "intervention") if x in raw} | {"schema_version": 3, "metrics": checks}


@dataclass(frozen=True)
class Resolved:
    check: Check
    keys: dict[str, str | None]
    status: str
    detail: str = ""


def metric_key(pipeline: str, stage: int, metric: str, k: int, branch: str | None) -> str:
    return f"{pipeline}|stage{stage}|{metric}@{k}" + (f"|branch={branch}" if branch else "")


STORED = {"latency_ms": "latency_ms", "failure_rate": "failure"}
WITHOUT_CUTOFF = ("mrr", "map", "latency_ms", "failure_rate")


def resolve_in_run(check: Check, keys: set[tuple[str, int, str, int, str | None]], layout: Mapping[str, tuple[int, str | None]] | None = None) -> tuple[str | None, str, str]:
    """(key, status, detail) of a check among a run's metric keys (pipeline, stage, metric, k,
    branch): resolved, absent, ambiguous or unsupported."""
    pipelines = sorted({x[0] for x in keys})
    if check.pipeline is None and len(pipelines) > 1:
        return None, "ambiguous", f"several pipelines ({', '.join(pipelines)})"
    pipeline = check.pipeline or (pipelines[0] if pipelines else None)
    if pipeline not in pipelines:
        return None, "absent", f"no pipeline {pipeline}"
    k = 0 if check.metric in WITHOUT_CUTOFF else check.k
    if check.target == "query":
        at = (pipeline, -1, STORED.get(check.metric, check.metric), 0, None)
        return (metric_key(*at), "resolved", "") if at in keys else (None, "absent", f"{metric_key(*at)} is not recorded")
    if check.target == "final_retrieval":
        stages = [s for p, s, m, n, b in keys if (p, m, n, b) == (pipeline, check.metric, k, None)]
        if not stages:
            return None, "absent", f"no {check.metric}@{k}"
        stage = -1 if -1 in stages else max(stages)
        return metric_key(pipeline, stage, check.metric, k, None), "resolved", f"stage {stage}"
    if layout is None:
        return None, "unsupported", "no traces"
    name = check.target.removeprefix("operator:")
    slots = sorted({s for op, s in layout.items() if op == name or op.startswith((f"{name}#", f"{name}@"))}, key=str)
    if len(slots) != 1:
        return None, "ambiguous" if slots else "absent", f"{len(slots)} invocations of {name}"
    at = (pipeline, slots[0][0], check.metric, k, slots[0][1])
    return (metric_key(*at), "resolved", "") if at in keys else (None, "absent", f"{metric_key(*at)} is not recorded")


def resolve(policy_: Policy, runs: Mapping[str, set], layouts: Mapping[str, Mapping] | None = None) -> list[Resolved]:
    """Every check in every run; the gravest status of the runs is the check's."""
    order = ("resolved", "absent", "ambiguous", "unsupported")
    out = []
    for c in policy_.checks:
        each = {r: resolve_in_run(c, keys, (layouts or {}).get(r)) for r, keys in runs.items()}
        worst = max(each.values(), key=lambda x: order.index(x[1]))
        out.append(Resolved(c, {r: x[0] for r, x in each.items()}, worst[1], worst[2]))
    return out


@dataclass(frozen=True)
class Experiment:
    name: str
    dataset: dict
    pipelines: dict[str, list[dict]]
    costs: dict[str, float] = field(default_factory=dict)


def experiment(text: str) -> Experiment:
    """An experiment; `combine` expands to ordered subsequences of its stages, `include` keeps some."""
    import yaml

    raw = yaml.safe_load(text)
    _only(raw, {"name", "dataset", "pipelines", "combine", "include", "costs"}, "the experiment")
    pipelines = {p["id"]: list(p["stages"]) for p in raw.get("pipelines") or ()}
    stages = raw.get("combine") or []
    if stages:
        names = [s["type"] for s in stages]
        chosen = raw.get("include") or ["__".join(c) for n in range(1, len(names) + 1) for c in itertools.combinations(names, n)]
        for name in chosen:
            parts = name.split("__")
            if any(p not in names for p in parts) or sorted(parts, key=names.index) != parts:
                raise ConfigError(f"{name} is no ordered subsequence of {names}")
            pipelines[name] = [stages[names.index(p)] for p in parts]
    if not pipelines:
        raise ConfigError("an experiment has pipelines")
    return Experiment(raw["name"], raw.get("dataset") or {}, pipelines, {k: float(v) for k, v in (raw.get("costs") or {}).items()})


def config_diff(before: Mapping[str, list[dict]], after: Mapping[str, list[dict]]) -> list[tuple[str, int, str]]:
    """(pipeline, stage or -1 for the pipeline itself, added / removed / changed / unchanged)."""
    out = []
    for p in sorted(before.keys() | after.keys()):
        if p not in before or p not in after:
            out.append((p, -1, "added" if p not in before else "removed"))
            continue
        each = []
        for i, (b, a) in enumerate(itertools.zip_longest(before[p], after[p])):
            each.append((p, i, "added" if b is None else "removed" if a is None else "unchanged" if a == b else "changed"))
        out += [(p, -1, "unchanged" if all(x[2] == "unchanged" for x in each) else "changed"), *each]
    return out


def at_path(document: Mapping, path: str) -> Any:
    value: Any = document
    for part in path.split("."):
        if not isinstance(value, Mapping) or part not in value:
            return None
        value = value[part]
    return value


#: What two comparable runs must agree on, and what they had better agree on.
REQUIRED_AXES = ("dataset.query_hash", "dataset.qrel_hash", "dataset.corpus_hash", "labeling.method")
OPTIONAL_AXES = {"execution.seed": "low", "execution.cache": "medium", "execution.timeout_ms": "medium", "git_commit": "low", "models": "medium", "packages": "low"}


def validity(manifests: list[Mapping]) -> list[tuple[str, str, str]]:
    """(axis, severity, status) of all differences: a required axis that differs is invalid, one
    that is missing unknown; an optional one is a warning or unknown."""
    out = []
    for axis in REQUIRED_AXES:
        values = [at_path(m, axis) for m in manifests]
        if any(v is None for v in values):
            out.append((axis, "high", "unknown"))
        elif len({repr(v) for v in values}) > 1:
            out.append((axis, "high", "invalid"))
    for axis, severity in OPTIONAL_AXES.items():
        values = [at_path(m, axis) for m in manifests]
        if any(v in (None, {}, []) for v in values):
            out.append((axis, "low", "unknown"))
        elif len({repr(v) for v in values}) > 1:
            out.append((axis, severity, "warning"))
    return out


def outcome(differences: list[tuple[str, str, str]]) -> str:
    bad = any(axis in REQUIRED_AXES and status in ("invalid", "unknown") for axis, _, status in differences)
    return "invalid" if bad else "warning" if differences else "valid"


#: What an evaluation must keep still, and the provenance that a change may touch.
INVARIANTS = {"query_set_mismatch": "dataset.query_hash", "judgments_mismatch": "dataset.qrel_hash", "corpus_mismatch": "dataset.corpus_hash", "labeling_mismatch": "labeling.method", "metric_implementation_mismatch": "metric_versions", "evaluation_semantics_mismatch": "evaluation"}
PROVENANCE = ("index_build_id", "embedding_model_revision", "reranker_revision", "prompt_revision", "code_revision", "config_digest")


def invariants(before: Mapping, after: Mapping) -> list[tuple[str, str, str]]:
    """(field, invariant / evidence_invalid / unknown, finding)."""
    out = []
    for code, path in INVARIANTS.items():
        a, b = at_path(before, path), at_path(after, path)
        known = a is not None and b is not None
        out.append((path, "unknown" if not known else "invariant" if a == b else "evidence_invalid", "required_manifest_field_missing" if not known else "" if a == b else code))
    return out


def encoder_consistency(manifest: Mapping, required: bool) -> tuple[str, str]:
    """(status, finding) of a run's index and query encoders."""
    block = manifest.get("index_encoder")
    if not isinstance(block, Mapping):
        return ("BLOCK", "index_encoder_compatibility_required") if required else ("PASS", "")
    said, pair = block.get("compatible"), (block.get("index_revision"), block.get("query_revision"))
    if said is True or (said is None and None not in pair and pair[0] == pair[1]):
        return "PASS", ""
    if said is False:
        return "BLOCK", "index_encoder_incompatible"
    return ("BLOCK", "index_encoder_compatibility_required") if required else ("HOLD", "index_encoder_unverified")


def report(config: Experiment) -> list[tuple[str, str, str]]:
    """(item, ok / warning / error, detail) of an experiment."""
    out = [("dataset", "ok" if config.dataset.get("name") else "error", str(config.dataset.get("name", "")))]
    for p, stages in sorted(config.pipelines.items()):
        out.append((p, "ok" if stages else "error", f"{len(stages)} stages"))
        priced = [s["type"] for s in stages if s["type"] in config.costs]
        out.append((f"{p}.costs", "ok" if len(priced) == len(stages) else "warning", f"{len(priced)} of {len(stages)} stages priced"))
    return out
