"""Workflows: a document of steps becomes one lazy plan.

A document has ``doc``, ``inputs``, ``outputs`` and ``steps``; a step names an operation (``run``) and its
arguments (``in``), where ``inputs/<name>`` and ``<step>/output`` refer to tables.  Nothing is written
between steps, so Spark moves later selections into earlier scans.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from gridloom.operators import aggregate, ensemble, polygon, regrid, select

REQUIRED = ("doc", "inputs", "outputs", "steps")
#: Arguments that only a service needs.
BOOKKEEPING = ("output_type", "split_method", "file_namer", "original_files", "pre_checked", "apply_fixes")


def _average(df: DataFrame, dims=(), **p) -> DataFrame:
    return aggregate.average(df, dims.split(",") if isinstance(dims, str) else dims, **p)


def _regrid(df: DataFrame, grid="auto", custom_grid=None, **p) -> DataFrame:
    return regrid.regrid(df, custom_grid if grid == "custom" else grid, **p)


OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "subset": select.subset,
    "average": _average,
    "average_time": aggregate.average_time,
    "average_shape": lambda df, shape: polygon.average_shape(df, shape),
    "weighted_average": aggregate.weighted_average,
    "regrid": _regrid,
    "concat": lambda *members, **p: ensemble.concat(members, **p),
}


def run(name: str, *tables: DataFrame, **params) -> DataFrame:
    """One operation by name, without the arguments that say nothing about the result."""
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation {name}")
    return OPERATIONS[name](*tables, **{k: v for k, v in params.items() if k not in BOOKKEEPING and v is not None})


def load(document: str | dict) -> dict:
    doc = json.loads(document) if isinstance(document, str) else document
    if missing := [k for k in REQUIRED if k not in doc]:
        raise ValueError(f"a workflow needs {', '.join(missing)}")
    return doc


def execute(document: str | dict, tables: dict[str, DataFrame], all_outputs: bool = False) -> DataFrame | dict[str, DataFrame]:
    """The first output's table (or all).  ``tables`` holds the named inputs."""
    doc, done = load(document), {}

    def table(ref: str, trail: tuple[str, ...] = ()) -> DataFrame:
        head, _, tail = ref.partition("/")
        if head == "inputs":
            if tail not in doc["inputs"]:
                raise ValueError(f"unknown input {tail}")
            value = doc["inputs"][tail]
            return tables[value[0] if isinstance(value, list) else value] if not isinstance(value, DataFrame) else value
        if head not in doc["steps"] or head in trail:
            raise ValueError(f"unknown or circular step {head}")
        if head not in done:
            step = doc["steps"][head]
            params = dict(step.get("in", {}))
            refs = params.pop("collection")
            done[head] = run(step["run"], *[table(r, (*trail, head)) for r in ([refs] if isinstance(refs, str) else refs)], **params)
        return done[head]

    out = {k: table(v) for k, v in doc["outputs"].items()}
    return out if all_outputs else next(iter(out.values()))
