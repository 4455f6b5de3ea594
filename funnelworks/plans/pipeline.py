"""Pipelines: functions tied together by the names of what they read and write."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target

from ..sources.catalog import Catalog

log = logging.getLogger(__name__)
PARAMS = "params:"
#: Spark's local properties of a job: its scheduler pool and how it is described.
POOL, DESCRIPTION = "spark.scheduler.pool", "spark.job.description"


@dataclass(frozen=True)
class Node:
    """``func`` over datasets and ``params:key`` inputs; several outputs take a tuple of results."""

    func: Callable[..., Any]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    name: str

    @classmethod
    def of(cls, func: Callable[..., Any], inputs: str | Iterable[str], outputs: str | Iterable[str], name: str) -> Node:
        listed = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return cls(func, listed(inputs), listed(outputs), name)


class Pipeline:
    """A set of nodes.  Adding pipelines unites them; each dataset has one node that makes it."""

    def __init__(self, nodes: Iterable[Node]):
        self.nodes = tuple(dict.fromkeys(nodes))
        makers: dict[str, str] = {}
        for n in self.nodes:
            for out in n.outputs:
                if out in makers:
                    raise ValueError(f"{makers[out]} and {n.name} both make {out}")
                makers[out] = n.name
        names = [n.name for n in self.nodes]
        if len(set(names)) < len(names):
            raise ValueError(f"nodes of one name: {sorted({x for x in names if names.count(x) > 1})}")

    def __add__(self, other: Pipeline) -> Pipeline:
        return Pipeline((*self.nodes, *other.nodes))

    __or__ = __add__

    def __len__(self) -> int:
        return len(self.nodes)

    def outputs(self) -> set[str]:
        return {x for n in self.nodes for x in n.outputs}

    def inputs(self) -> set[str]:
        """What must be there before: datasets that no node makes, and parameters."""
        return {x for n in self.nodes for x in n.inputs} - self.outputs()

    def needs(self) -> dict[str, set[str]]:
        """For each node, by name, the nodes that make its inputs."""
        maker = {out: n.name for n in self.nodes for out in n.outputs}
        return {n.name: {maker[x] for x in n.inputs if x in maker} for n in self.nodes}

    def ordered(self) -> list[Node]:
        """Every node after those that it needs, else as given; a cycle is a ValueError."""
        needs, left, out, done = self.needs(), list(self.nodes), [], set()
        while left:
            ready = next((n for n in left if needs[n.name] <= done), None)
            if ready is None:
                raise ValueError(f"nodes in a cycle: {sorted(n.name for n in left)}")
            out.append(ready)
            done.add(ready.name)
            left.remove(ready)
        return out


def run_node(node: Node, catalog: Catalog, parameters: Mapping[str, Any]) -> None:
    began = time.monotonic()
    given = []
    for x in node.inputs:
        if x.startswith(PARAMS):
            if x[len(PARAMS) :] not in parameters:
                raise KeyError(f"{node.name} needs the parameter {x[len(PARAMS):]!r}")
            given.append(parameters[x[len(PARAMS) :]])
        else:
            given.append(catalog.load(x))
    made = node.func(*given)
    results = (made,) if len(node.outputs) == 1 else tuple(made)
    if len(results) != len(node.outputs):
        raise ValueError(f"{node.name} made {len(results)} results for {len(node.outputs)} outputs")
    for name, data in zip(node.outputs, results, strict=True):
        catalog.save(name, data)
    log.info("%s: %.1f s", node.name, time.monotonic() - began)


def _run_in_pool(node: Node, catalog: Catalog, parameters: Mapping[str, Any]) -> None:
    """``run_node`` with its jobs in a scheduler pool of the node's name; the thread serves other nodes afterwards."""
    context = catalog.spark.sparkContext
    context.setLocalProperty(POOL, node.name)
    context.setLocalProperty(DESCRIPTION, node.name)
    try:
        run_node(node, catalog, parameters)
    finally:
        context.setLocalProperty(POOL, None)
        context.setLocalProperty(DESCRIPTION, None)


def run(pipeline: Pipeline, catalog: Catalog, parameters: Mapping[str, Any], threads: int = 1) -> None:
    """All nodes in order; with more threads, nodes that do not wait for each other at the same time.

    Each node that runs beside others has a scheduler pool of its own, by its name: in
    a session with FAIR scheduling, nodes share the executors evenly, where in one pool
    the first node's tasks would all come first.  A node that only declares a plan has
    no jobs; they run in the pool of the node that writes.  The caller's local properties hold in
    all threads.  When a node fails, what already runs ends and then the error is raised.
    """
    if threads <= 1:
        for node in pipeline.ordered():
            run_node(node, catalog, parameters)
        return
    needs, left = pipeline.needs(), pipeline.ordered()
    done: set[str] = set()
    running: dict[Future, str] = {}
    with ThreadPoolExecutor(threads) as pool:
        while left or running:
            for node in [n for n in left if needs[n.name] <= done]:
                left.remove(node)
                target = inheritable_thread_target(catalog.spark)(_run_in_pool)
                running[pool.submit(target, node, catalog, parameters)] = node.name
            finished, _ = wait(running, return_when=FIRST_COMPLETED)
            for f in finished:
                name = running.pop(f)
                f.result()
                done.add(name)
