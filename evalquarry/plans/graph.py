"""Pipeline graphs: parsing, checks, order, ablations, and running one over all queries.

A graph has tens of nodes, so it is handled on the driver; what a node computes is a
DataFrame over all queries at once, and Spark schedules the branches.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from evalquarry.plans.storage import saved

#: Operator types and how many inputs each takes (least, most).
ARITY = {"SOURCE": (0, 0), "FUSE": (2, None), "RERANK": (1, 1), "FILTER": (1, 1), "GATE": (1, 1), "BOOST": (1, 1), "EXPAND": (1, None), "TRANSFORM": (1, None), "GENERATE": (1, 1)}


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    inputs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict, hash=False)


class GraphError(ValueError):
    """A graph that can't run."""


def parse(raw: list[dict]) -> list[Node]:
    nodes = [Node(str(n["id"]), n.get("type") or infer_type(n), tuple(n.get("inputs", ())), dict(n.get("params", {}))) for n in raw]
    check(nodes)
    return nodes


def infer_type(raw: dict) -> str:
    """What a node without a type is: fusion by its method, a source without inputs, else a transform."""
    return "FUSE" if raw.get("fuse") else "SOURCE" if not raw.get("inputs") else "RERANK" if raw.get("reranker") else "TRANSFORM"


def check(nodes: list[Node]) -> None:
    ids = Counter(n.id for n in nodes)
    for id_, times in ids.items():
        if times > 1:
            raise GraphError(f"operator {id_} occurs {times} times")
    for n in nodes:
        if n.type not in ARITY:
            raise GraphError(f"operator {n.id} has the unknown type {n.type}")
        least, most = ARITY[n.type]
        if len(n.inputs) < least or (most is not None and len(n.inputs) > most):
            raise GraphError(f"operator {n.id} of type {n.type} has {len(n.inputs)} inputs")
        for i in n.inputs:
            if i not in ids:
                raise GraphError(f"operator {n.id} reads the unknown operator {i}")
    order(nodes)


def order(nodes: list[Node]) -> list[Node]:
    """Inputs before readers; of several ready nodes the one declared first."""
    done, out, left = set(), [], list(nodes)
    while left:
        ready = next((n for n in left if done.issuperset(n.inputs)), None)
        if ready is None:
            raise GraphError("the graph has a cycle through " + ", ".join(n.id for n in left))
        left.remove(ready)
        done.add(ready.id)
        out.append(ready)
    return out


def depths(nodes: list[Node]) -> dict[str, int]:
    """Length of the longest path to each node: its stage."""
    at: dict[str, int] = {}
    for n in order(nodes):
        at[n.id] = 1 + max((at[i] for i in n.inputs), default=-1)
    return at


def layout(nodes: list[Node]) -> dict[str, tuple[int, str | None]]:
    """(stage, branch) of each node; the branch is its id where several share a stage."""
    at = depths(nodes)
    shared = Counter(at.values())
    return {n: (d, n if shared[d] > 1 else None) for n, d in at.items()}


def sinks(nodes: list[Node]) -> list[str]:
    read = {i for n in nodes for i in n.inputs}
    return [n.id for n in nodes if n.id not in read and n.type != "GATE"]


def ablations(stages: list[str], include: list[list[str]] | None = None) -> dict[str, list[str]]:
    """Ordered subsequences of stages, named by their parts; or only those given."""
    chosen = include or [list(c) for k in range(1, len(stages) + 1) for c in itertools.combinations(stages, k)]
    return {"__".join(c): sorted(c, key=stages.index) for c in chosen}


def invocation_ids(operators: list[str]) -> list[str]:
    """The n-th use of an operator is op#n from the second on."""
    seen: Counter[str] = Counter()
    out = []
    for op in operators:
        seen[op] += 1
        out.append(op if seen[op] == 1 else f"{op}#{seen[op]}")
    return out


Operator = Callable[[list[DataFrame], dict], DataFrame]


def run(nodes: list[Node], registry: dict[str, Operator]) -> dict[str, DataFrame]:
    """The output of every node over all queries, by id. An output that several nodes read is
    written to the shared folder, so none of them works it out again."""
    readers = Counter(i for n in nodes for i in n.inputs)
    out: dict[str, DataFrame] = {}
    for n in order(nodes):
        got = registry[n.params.get("operator", n.type)]([out[i] for i in n.inputs], n.params)
        out[n.id] = saved(got) if readers[n.id] > 1 else got
    return out


def fused(sources: list[str], top_k: int | None = None, method: str = "rrf") -> Callable[[dict[str, Operator]], DataFrame]:
    """A fan-in of two or more sources: given a registry, their fused lists."""
    if len(sources) < 2 or method != "rrf":
        raise GraphError("a fusion has two sources at least and the method rrf")
    nodes = parse([{"id": s, "type": "SOURCE", "params": {"operator": s}} for s in sources] + [{"id": "fused", "type": "FUSE", "inputs": sources, "params": {"top_k": top_k}}])
    return lambda registry: run(nodes, registry)["fused"]
