"""Texts for the owner: the catalogue of kinds, joined lists, a report whose severity follows from its flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of messages.
KINDS = (
    "recommendation", "fill", "limit_breach", "kill", "budget_warning", "daily_summary", "weekly_summary", "engine_started", "engine_stopped", "startup_report", "trade_window_changed",
    "login_prompt", "feed_stale", "rec_fill_suspected",
)


def joined(items: Column, by: str = ", ", none: str = "none") -> Column:
    """The items of a list as text, or a word if there are none."""
    return F.coalesce(F.nullif(F.array_join(items, by), F.lit("")), F.lit(none))


def report(killed: Column, integrity: Column, crashed: Column, prior: Column, frozen: Column, deferred: Column) -> tuple[Column, Column]:
    """(severity, body) of a start: critical if killed, tampered with or crashed before."""
    severity = F.when(killed | ~integrity | crashed, "critical").otherwise("info")
    lead = F.when(crashed, F.concat(F.lit("recovered from "), prior, F.lit("; "))).otherwise("")
    state = F.concat(lead, F.lit("killed="), killed.cast("string"), F.lit(" integrity_ok="), integrity.cast("string"))
    return severity, F.concat_ws("\n", state, F.concat(F.lit("frozen: "), joined(frozen)), F.concat(F.lit("deferred: "), joined(deferred)))
