"""Study specifications: a strict JSON document, all of whose faults are reported together."""

from __future__ import annotations

import hashlib
import json
import math
import struct
from dataclasses import dataclass, field
from functools import lru_cache

from stratamill.functions.expr import Expression, ExpressionError
from stratamill.plans.space import Boolean, Categorical, Integer, Real, Space
from stratamill.sources.bars import timeframe
from stratamill.sources.trials import loads_strict
from stratamill.types import Refusal

#: Names of the format (fixed values).
SAMPLERS = ("grid", "random", "sobol", "tpe", "candidates")
ROOT = ("schema_version", "mode", "strategies", "datasets", "objective", "sampler", "execution", "symbol_feeds")
STRATEGY = ("id", "source", "datasets", "fixed_inputs", "strategy_overrides", "search_space")
DATASET = ("id", "ohlcv", "input_tf", "script_tf", "chart_timezone", "syminfo")
OBJECTIVE = ("kind", "direction", "expression", "constraints", "nan_policy", "division_by_zero")
SAMPLER = ("kind", "seed", "trials", "candidate_policy", "scramble")
EXECUTION = ("workers", "isolation", "batch_size", "lag", "patience", "wall_seconds", "trial_seconds")
DIMENSION = {"integer": ("kind", "low", "high", "step", "log"), "real": ("kind", "low", "high", "step", "log"), "boolean": ("kind",), "categorical": ("kind", "choices")}


@dataclass
class Spec:
    strategy: str
    dataset: dict
    space: Space
    declared: dict
    objective: dict
    sampler: dict
    execution: dict
    fixed: dict = field(default_factory=dict)

    def canonical(self) -> dict:
        """What identifies the search: parameters and objective; reals by their bits, integers as text, constraints sorted."""

        def bits(v):
            return None if v is None else struct.pack(">d", float(v) + 0.0).hex()

        def choice(c):
            if type(c) is bool:
                return ["boolean", c]
            return ["integer", str(c)] if type(c) is int else ["real", bits(c)] if type(c) is float else ["string", c]

        parameters = {}
        for name, d in self.declared.items():
            kind = d["kind"]
            if kind == "integer":
                parameters[name] = {"kind": kind, "low": str(d["low"]), "high": str(d["high"]), "step": str(d.get("step", 1)), "log": d.get("log", False)}
            elif kind == "real":
                parameters[name] = {"kind": kind, "low": bits(d["low"]), "high": bits(d["high"]), "step": bits(d.get("step")), "log": d.get("log", False)}
            elif kind == "categorical":
                parameters[name] = {"kind": kind, "choices": [choice(c) for c in d["choices"]]}
            else:
                parameters[name] = {"kind": kind}
        goal = {"expression": self.objective["expression"], "direction": self.objective["direction"], "constraints": sorted(self.objective.get("constraints", []))}
        return {"space_hash_version": 1, "parameters": parameters, "objective": goal}

    def space_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.canonical(), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _whole(v) -> bool:
    return type(v) is int


def dimension(name: str, raw: dict, issues: list[str]):
    kind = raw.get("kind") if type(raw) is dict else None
    if kind not in DIMENSION:
        issues.append(f"search_space.{name}: kind")
        return None
    if unknown := set(raw) - set(DIMENSION[kind]):
        issues.append(f"search_space.{name}: unknown {sorted(unknown)}")
    try:
        if kind == "boolean":
            return Boolean(name)
        if kind == "categorical":
            return Categorical(name, tuple(raw["choices"]))
        number = _whole if kind == "integer" else lambda v: type(v) in (int, float)
        if not all(number(raw[k]) for k in ("low", "high", "step") if raw.get(k) is not None):
            raise Refusal("dimension", name)
        if kind == "integer":
            return Integer(name, raw["low"], raw["high"], raw.get("step", 1), raw.get("log", False))
        return Real(name, float(raw["low"]), float(raw["high"]), None if raw.get("step") is None else float(raw["step"]), raw.get("log", False))
    except (Refusal, KeyError, TypeError) as e:
        issues.append(f"search_space.{name}: {e}")
        return None


def injective(d: Real) -> bool:
    """Whether a stepped real's values are all different: looked at one by one up to a million, proved by the spacing of numbers beyond."""
    n = d.count
    if n is None or n <= 1:
        return True
    if n > 1 << 53:
        return False
    if n <= 1_000_000:
        last = -math.inf
        for i in range(n):
            v = min(math.fma(i, d.step, d.low), d.high)
            if v <= last:
                return False
            last = v
        return True
    return d.step > math.ulp(max(abs(d.low), abs(d.high)))


@lru_cache(1024)
def _fault(text: str) -> str | None:
    """What an expression's reader says against it; specifications of one kind repeat their expressions."""
    try:
        Expression(text)
    except ExpressionError as x:
        return str(x)


def parse(text: str) -> Spec:
    raw, issues = loads_strict(text), []
    if type(raw) is not dict:
        raise Refusal("spec", "not an object")

    def fields(what: str, obj, allowed) -> dict:
        if type(obj) is not dict:
            issues.append(f"{what}: not an object")
            return {}
        if unknown := set(obj) - set(allowed):
            issues.append(f"{what}: unknown {sorted(unknown)}")
        return obj

    fields("root", raw, ROOT)
    if raw.get("schema_version") != 1:
        issues.append("schema_version")
    if raw.get("mode") != "single_strategy":
        issues.append("mode")
    one = {}
    for what, allowed in (("strategies", STRATEGY), ("datasets", DATASET)):
        held = raw.get(what)
        if type(held) is not list or len(held) != 1:
            issues.append(f"{what}: exactly one")
            held = [{}]
        one[what] = fields(what, held[0], allowed)
    strategy, dataset = one["strategies"], one["datasets"]
    if strategy.get("datasets") != [dataset.get("id")]:
        issues.append("strategies: datasets")
    for k in ("input_tf", "script_tf"):
        try:
            timeframe(str(dataset.get(k)))
        except Refusal:
            issues.append(f"datasets: {k}")
    declared = strategy.get("search_space")
    if type(declared) is not dict or not declared:
        issues.append("search_space")
        declared = {}
    dims = [dimension(n, d, issues) for n, d in declared.items()]
    issues += [f"search_space.{d.name}: values coincide" for d in dims if isinstance(d, Real) and d.step is not None and not injective(d)]
    if both := set(strategy.get("fixed_inputs", {})) & set(declared):
        issues.append(f"fixed_inputs: searched {sorted(both)}")
    goal = fields("objective", raw.get("objective"), OBJECTIVE)
    if goal.get("kind") != "expression" or goal.get("direction") not in ("maximize", "minimize"):
        issues.append("objective")
    for what, e in [("objective", goal.get("expression")), *(("constraint", c) for c in goal.get("constraints", []))]:
        if fault := _fault(e if type(e) is str else ""):
            issues.append(f"{what}: {fault}")
    sampler = fields("sampler", raw.get("sampler"), SAMPLER)
    if sampler.get("kind") not in SAMPLERS:
        issues.append(f"sampler: {sampler.get('kind')!r} isn't one of {SAMPLERS}")
    if not _whole(sampler.get("trials", 1)) or sampler.get("trials", 1) < 1:
        issues.append("sampler: trials")
    if sampler.get("kind") == "grid" and any(d is not None and d.count is None for d in dims):
        issues.append("sampler: a grid of continuous dimensions")
    execution = fields("execution", raw.get("execution", {}), EXECUTION)
    if issues:
        raise Refusal("spec", "; ".join(issues), issues=issues)
    return Spec(strategy["id"], dataset, Space(tuple(dims)), declared, goal, sampler, execution, strategy.get("fixed_inputs", {}))
