"""Report routes: which results trigger which report, and where reports go.

Routes are configuration, a short list held by the driver. They become column
expressions, so matching them costs no join, whatever the size of the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maps import tags_match
from ..functions.status import is_failed, is_successful
from ..functions.times import whole_seconds
from .windows import join_null_safe, trailing_counts

# Names of the built-in channels.
CHANNELS = ("email", "slack", "file", "terminal")


@dataclass(frozen=True)
class Filters:
    workflow_status: Sequence[str] | None = None
    task_status: Sequence[str] | None = None
    workflow_names: Sequence[str] | None = None
    task_types: Sequence[str] | None = None
    min_duration_seconds: int | None = None
    max_duration_seconds: int | None = None
    tags: Mapping[str, str] | None = None


@dataclass(frozen=True)
class Channel:
    channel_type: str
    target: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class Route:
    name: str
    generator_type: str = "summary"
    enabled: bool = True
    trigger_on_workflow_completion: bool = False
    trigger_on_task_failure: bool = False
    period: str | None = None
    channels: Sequence[Channel] = ()
    variables: Mapping[str, str] = field(default_factory=dict)
    filters: Filters = Filters()
    template_content: str | None = None
    template_file: str | None = None


@dataclass(frozen=True)
class Switches:
    """Which completions are reported at all."""

    workflow_completion_reports: bool = True
    task_completion_reports: bool = True

    def of(self, data: str) -> bool:
        return {"run": self.workflow_completion_reports, "task": self.task_completion_reports}.get(data, True)


def _canonical(names: Iterable[str]) -> list[str]:
    return ["".join("_" + c.lower() if c.isupper() and i else c.lower() for i, c in enumerate(n)) for n in names]


def task_filter(f: Filters, of: Callable[[str], Column] = F.col) -> Column:
    """Tasks a report shows. Durations count in whole seconds; an unknown one passes. ``of`` finds a field of the task."""
    keep = F.lit(True)
    if f.task_status is not None:
        keep = keep & of("status").isin(*_canonical(f.task_status))
    if f.task_types is not None:
        keep = keep & of("task_type").isin(*f.task_types)
    if f.min_duration_seconds is not None:
        keep = keep & F.coalesce(whole_seconds(of("duration_ms")) >= f.min_duration_seconds, F.lit(True))
    if f.max_duration_seconds is not None:
        keep = keep & F.coalesce(whole_seconds(of("duration_ms")) <= f.max_duration_seconds, F.lit(True))
    if f.tags:
        keep = keep & tags_match(of("metadata"), f.tags)
    return keep


def apply_filters(tasks: DataFrame, f: Filters) -> DataFrame:
    return tasks.filter(task_filter(f))


def outcome_filter(status: Column | str, successful: bool = False, failed: bool = False) -> Column:
    """Keep successes, failures, or both; with neither asked for, everything."""
    if not successful and not failed:
        return F.lit(True)
    return (is_successful(status) & successful) | (is_failed(status) & failed)


def filter_tasks_by_outcome(tasks: DataFrame, successful: bool = False, failed: bool = False) -> DataFrame:
    return tasks.filter(outcome_filter("status", successful, failed))


def _matching(df: DataFrame, tests: Sequence[tuple[Route, Column]]) -> DataFrame:
    hits = [F.when(test, F.lit(route.name)) for route, test in tests]
    if not hits:
        return df.withColumn("route", F.lit(None).cast("string")).filter(F.lit(False))
    return df.withColumn("route", F.explode(F.array_compact(F.array(*hits))))


def runs_triggering(runs: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """Finished runs with every route they trigger, one row per (run, route). Runs still going trigger nothing."""
    tests = []
    for r in routes:
        if not (r.enabled and r.trigger_on_workflow_completion):
            continue
        test = F.lit(True)
        if r.filters.workflow_names is not None:
            test = test & F.col("workflow_name").isin(*r.filters.workflow_names)
        if r.filters.workflow_status is not None:
            test = test & F.col("status").isin(*_canonical(r.filters.workflow_status))
        tests.append((r, test))
    going = F.coalesce(F.col("status").isin("running", "pending"), F.lit(False))
    return _matching(runs.filter(~going), tests)


def tasks_triggering(tasks: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """Failed tasks with every route they trigger."""
    tests = []
    for r in routes:
        if not (r.enabled and r.trigger_on_task_failure):
            continue
        test = F.lit(True)
        if r.filters.task_types is not None:
            test = test & F.col("task_type").isin(*r.filters.task_types)
        if r.filters.task_status is not None:
            test = test & F.col("status").isin(*_canonical(r.filters.task_status))
        tests.append((r, test))
    return _matching(tasks.filter(is_failed("status")), tests)


def reportable_tasks(tasks: DataFrame, include_successful: bool = False) -> DataFrame:
    return tasks if include_successful else tasks.filter(is_failed("status"))


def routes_for_period(routes: Sequence[Route], period: str) -> list[Route]:
    return [r for r in routes if r.period == period]


def periods_triggering(periods: DataFrame, routes: Sequence[Route], period: str) -> DataFrame:
    """Metrics of periods of one length with every enabled route for that length, one row per (period, route)."""
    return _matching(periods, [(r, F.lit(True)) for r in routes_for_period(routes, period) if r.enabled])


def check_channels(routes: Sequence[Route], known: Iterable[str] = CHANNELS) -> None:
    """Raise when a route names a channel nobody delivers to."""
    names = set(known)
    for r in routes:
        for c in r.channels:
            if c.channel_type not in names:
                raise ValueError(f"no deliverer for channel {c.channel_type!r} of route {r.name!r}")


def route_reports(reports: DataFrame, routes: Sequence[Route], known: Iterable[str] = CHANNELS) -> DataFrame:
    """One row per report and enabled channel of its route."""
    check_channels(routes, known)
    targets = None
    for r in routes:
        live = [F.struct(F.lit(c.channel_type).alias("channel"), F.lit(c.target).alias("target")) for c in r.channels if c.enabled]
        if live:
            test = F.col("route") == r.name
            targets = F.when(test, F.array(*live)) if targets is None else targets.when(test, F.array(*live))
    if targets is None:
        return reports.select("*", F.lit(None).cast("string").alias("channel"), F.lit("").alias("target")).limit(0)
    return reports.withColumn("__to", F.explode(targets)).select("*", "__to.channel", "__to.target").drop("__to")


def resolve_templates(routes: DataFrame, by_name: DataFrame, by_file: DataFrame) -> DataFrame:
    """Template text of every route: its own, else the one of its name, else its file's.

    ``routes`` has (name, template_content, template_file), ``by_name`` (name, content),
    ``by_file`` (path, content). ``resolved`` is false where there is none.
    """
    named = by_name.select("name", F.col("content").alias("__named"))
    filed = by_file.select(F.col("path").alias("template_file"), F.col("content").alias("__filed"))
    text = F.coalesce("template_content", "__named", "__filed")
    return routes.join(named, "name", "left").join(filed, "template_file", "left").select(
        "name", text.alias("content"), text.isNotNull().alias("resolved")
    )


@dataclass(frozen=True)
class RateLimits:
    per_minute: int | None = None
    per_hour: int | None = None
    per_day: int | None = None

    def spans(self) -> list[tuple[int, int]]:
        limits = ((60, self.per_minute), (3600, self.per_hour), (86400, self.per_day))
        return [(span, limit) for span, limit in limits if limit is not None]


def rate_limited(
    reports: DataFrame, limits: RateLimits, keys: Sequence[str] = ("channel",), at: str = "generated_at",
    per_key: Mapping[str, RateLimits] | None = None,
) -> DataFrame:
    """Flag the reports that come when a limit is already used up.

    A report is allowed when the reports of its key in the last minute, hour and day, its
    own second included, are within the limits. Reports are counted per second first, so
    a key with most of the reports is one short row per second. ``per_key`` has the limits
    of single values of the first key, as of channels; ``limits`` hold for all others.
    """
    own = {value: dict(of.spans()) for value, of in (per_key or {}).items()}
    common = dict(limits.spans())
    keys, spans = list(keys), sorted({*common, *(span for of in own.values() for span in of)})
    if not spans:
        return reports.withColumn("allowed", F.lit(True))
    stamped = reports.withColumn("__second", F.unix_seconds(F.col(at)))
    ticks = stamped.groupBy(*keys, "__second").agg(F.count("*").alias("__n"))
    counted = trailing_counts(ticks, keys, "__second", "__n", spans)

    def within(span: int) -> Column:
        used = F.col(f"last_{span}s")
        test = lambda of: used <= of[span] if span in of else F.lit(True)
        out = test(common)
        for value, of in own.items():
            out = F.when(F.col(keys[0]) == value, test(of)).otherwise(out)
        return out

    allowed = F.lit(True)
    for span in spans:
        allowed = allowed & within(span)
    # Null keys are a key like any other; a report without a time is kept, undecided.
    return join_null_safe(stamped, counted, [*keys, "__second"]).select(
        *reports.columns, *[f"last_{span}s" for span in spans], allowed.alias("allowed")
    )
