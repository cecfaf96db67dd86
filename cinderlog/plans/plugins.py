"""Registering extra statistics and metrics.

A statistic is a set of aggregate columns merged into the summary. A metric is a job that returns metric columns per key and takes
part in rule evaluation. Metrics form a graph: a job that takes a fourth argument gets the tables of the metrics it depends on, each
worked out once, in order of the graph, and written, so that no dependant works it out again. A failing plug-in raises.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..functions.fields import Fields
from ..operators import security, sessions, statistics
from ..operators.context import AnalysisContext
from ..operators.grouping import Keys
from ..operators.metrics import SELECTORS, to_long
from ..operators.statistics import stats_summary
from ..session import through_table

StatsFactory = Callable[[Fields], dict[str, Column]]
Tables = Mapping[str, DataFrame]
#: ``job(records, keys, ctx)`` or ``job(records, keys, ctx, tables)``.
MetricJob = Callable[..., DataFrame]

#: Metrics that come with the library, in the order their dependencies ask for.
BUILTIN_METRICS = {
    "traffic": (), "error": (), "status": (), "endpoint": (), "latency": (), "distribution": (),
    "bandwidth": ("traffic",), "traffic_burst": ("traffic",), "session": (), "journey": ("session",),
    "security": ("session",),
}

#: The table that each of them hands to its dependants: the rows its measures are read from.
BUILTIN_TABLES: dict[str, Callable[[DataFrame, Keys, AnalysisContext, Tables], DataFrame]] = {
    "traffic": lambda records, keys, ctx, tables: statistics.traffic_volume(records, keys),
    "error": lambda records, keys, ctx, tables: statistics.error_levels(records, keys),
    "status": lambda records, keys, ctx, tables: statistics.status_codes(records, keys),
    "endpoint": lambda records, keys, ctx, tables: statistics.endpoint_counts(records, keys),
    "latency": lambda records, keys, ctx, tables: statistics.latency_percentiles(records, keys, ctx.percentiles),
    "distribution": lambda records, keys, ctx, tables: statistics.size_histogram(records, keys, width=ctx.histogram_bucket_size),
    "bandwidth": lambda records, keys, ctx, tables: statistics.bandwidth_summary(records, keys, ctx),
    "traffic_burst": lambda records, keys, ctx, tables: statistics.requests_per_second(records, keys),
    "session": lambda records, keys, ctx, tables: sessions.sessions_with_paths(records, keys, ctx),
    "journey": lambda records, keys, ctx, tables: sessions.funnel_reach(tables["session"], keys),
    "security": lambda records, keys, ctx, tables: security.failed_logins_per_ip(tables["session"], keys),
}


@dataclass(frozen=True)
class Metric:
    name: str
    version: str
    dependencies: tuple[str, ...]
    produces: tuple[str, ...]
    job: MetricJob

    @property
    def takes_tables(self) -> bool:
        given = inspect.signature(self.job).parameters.values()
        return len([p for p in given if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]) > 3


_stats: dict[str, StatsFactory] = {}
_metrics: dict[str, Metric] = {}


def register_stats(name: str, factory: StatsFactory) -> None:
    """Add aggregate columns to the summary. ``factory`` gets the record fields and returns named aggregates."""
    _stats[name] = factory


def unregister_stats(name: str) -> None:
    _stats.pop(name, None)


def stats(records: DataFrame, keys: Keys = []) -> DataFrame:
    """``stats_summary`` with the registered statistics, all from one aggregate."""
    fields = Fields(records)
    extra = [column.alias(name) for factory in _stats.values() for name, column in factory(fields).items()]
    return stats_summary(records, keys, extra)


def register_metric(
    name: str,
    job: MetricJob,
    produces: tuple[str, ...],
    version: str = "1.0",
    dependencies: tuple[str, ...] = (),
) -> Metric:
    """Register a metric job; ``produces`` names its selectors. A taken name is refused."""
    if not name or not name.strip():
        raise ValueError("Metric name must be a non-empty string.")
    if not version or not version.strip():
        raise ValueError("Metric version must be a non-empty string.")
    if not produces:
        raise ValueError(f"Metric '{name}' must declare the selectors it produces.")
    if any(not d or not d.strip() for d in dependencies):
        raise ValueError("Metric dependencies must contain non-empty names.")
    if name in _metrics or name in BUILTIN_METRICS:
        raise ValueError(f"Metric '{name}' is already registered.")
    taken = set(SELECTORS) & set(produces)
    if taken:
        raise ValueError(f"Metric '{name}' would replace the selectors {sorted(taken)}.")
    _metrics[name] = Metric(name, version, tuple(dependencies), tuple(produces), job)
    return _metrics[name]


def unregister_metric(name: str) -> None:
    _metrics.pop(name, None)


def list_metrics() -> list[str]:
    return sorted([*BUILTIN_METRICS, *_metrics])


def metric_order(names: list[str] | None = None) -> list[str]:
    """Names with their dependencies first. A missing or circular dependency is an error."""
    needs = {**BUILTIN_METRICS, **{m.name: m.dependencies for m in _metrics.values()}}
    done: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in done:
            return
        if name in open_:
            raise ValueError(f"Circular metric dependency detected at '{name}'.")
        if name not in needs:
            raise ValueError(f"Metric dependency '{name}' is not registered.")
        open_.add(name)
        for dependency in needs[name]:
            visit(dependency)
        open_.discard(name)
        done.append(name)

    for name in names if names is not None else list(needs):
        visit(name)
    return done


def wanted_tables() -> list[str]:
    """Names whose tables some registered job takes, with what they are made from, dependencies first."""
    taken = {d for m in _metrics.values() if m.takes_tables for d in m.dependencies}
    return metric_order(sorted(taken)) if taken else []


def builtin_tables(records: DataFrame, keys: Keys, ctx: AnalysisContext) -> dict[str, DataFrame]:
    """The tables of built-in metrics that registered jobs take, each worked out once and written. Most often there are none."""
    needed = {"session"} if {"journey", "security"} & set(wanted_tables()) else set()
    direct = {d for m in _metrics.values() if m.takes_tables for d in m.dependencies}
    out: dict[str, DataFrame] = {}
    for name in wanted_tables():
        if name in BUILTIN_TABLES and name in direct | needed:
            out[name] = through_table(BUILTIN_TABLES[name](records, keys, ctx, out), f"table-{name}")
    return out


def extra_metrics(
    records: DataFrame, keys: Keys, ctx: AnalysisContext, tables: Tables | None = None
) -> list[DataFrame]:
    """Long tables of the registered metrics, in dependency order, each limited to what it declares.

    ``tables``: those of :func:`builtin_tables` where the caller has them already.
    """
    known = dict(builtin_tables(records, keys, ctx) if tables is None else tables)
    handed_on = set(wanted_tables())
    out = []
    for name in metric_order():
        metric = _metrics.get(name)
        if metric is None:
            continue
        own = [{d: known[d] for d in metric.dependencies}] if metric.takes_tables else []
        found = metric.job(records, keys, ctx, *own)
        undeclared = [c for c in found.columns if c not in keys and c not in metric.produces]
        if undeclared:
            raise ValueError(f"Metric '{name}' returned the undeclared selectors {undeclared}.")
        if name in handed_on:
            found = known[name] = through_table(found, "table-extra")
        out.append(to_long(found, keys, {c: c for c in metric.produces}))
    return out
