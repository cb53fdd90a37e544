"""Task and run status: predicates, names, icons and rates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

# Status names and the icons of the text reports.
TASK_STATUSES = ("pending", "running", "success", "failed", "skipped", "timeout", "cancelled")
RUN_STATUSES = ("running", "success", "failed", "partial_success", "cancelled", "timeout")
FAILED_STATUSES = ("failed", "timeout", "cancelled")
UNFINISHED_STATUSES = ("pending", "running")
RETRYABLE_STATUSES = ("failed", "timeout")

RUN_ICONS = {"success": "✅", "failed": "❌", "cancelled": "⚠️"}
TASK_ICONS = {"success": "✅", "failed": "❌", "timeout": "❌", "cancelled": "❌", "skipped": "⚠️"}
TASK_DETAIL_ICONS = {**TASK_ICONS, "pending": "⏳", "running": "🔄"}
OTHER_ICON = "ℹ️"
LISTING_ICONS = {
    "success": "✓", "failed": "✗", "timeout": "✗", "cancelled": "✗",
    "skipped": "⊘", "pending": "⧖", "running": "⟳",
}
REPORT_TYPE_ICONS = {"summary": "📋", "detailed": "📊", "metrics": "📈"}
OTHER_REPORT_ICON = "📄"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_successful(status: Column | str) -> Column:
    return col(status) == "success"


def is_failed(status: Column | str) -> Column:
    return col(status).isin(*FAILED_STATUSES)


def is_finished(status: Column | str) -> Column:
    return ~col(status).isin(*UNFINISHED_STATUSES)


def can_retry(status: Column | str, retry_count: Column | str, max_retries: Column | int) -> Column:
    return (col(retry_count) < max_retries) & col(status).isin(*RETRYABLE_STATUSES)


def normalize_status(status: Column | str) -> Column:
    """``PartialSuccess`` and ``partial_success`` both become ``partial_success``."""
    return F.lower(F.regexp_replace(col(status), "(?<=[a-z])(?=[A-Z])", "_"))


def icon(status: Column | str, icons: Mapping[str, str], other: str = OTHER_ICON) -> Column:
    by_icon: dict[str, list[str]] = {}
    for name, symbol in icons.items():
        by_icon.setdefault(symbol, []).append(name)
    chain = None
    for symbol, names in by_icon.items():
        test = col(status).isin(*names)
        chain = F.when(test, symbol) if chain is None else chain.when(test, symbol)
    return F.lit(other) if chain is None else chain.otherwise(other)


def success_rate(successful: Column | str, total: Column | str) -> Column:
    """Percentage of successes, 0 when there is nothing to count."""
    ok, n = col(successful), col(total)
    return F.when(n > 0, ok.cast("double") / n * F.lit(100.0)).otherwise(F.lit(0.0))


def utilization(active: Column | str, capacity: Column | str) -> Column:
    """Share of the capacity in use, in percent; 0 without capacity."""
    return success_rate(active, capacity)


def exit_code_ok(metadata: Column | str, expected: Iterable[int] = ()) -> Column:
    """Exit code accepted: anything when no code is expected, else one of them.

    A row without a recorded code counts as -1.
    """
    codes = list(expected)
    if not codes:
        return F.lit(True)
    code = F.coalesce(F.try_element_at(col(metadata), F.lit("exit_code")).try_cast("int"), F.lit(-1))
    return code.isin(*codes)
