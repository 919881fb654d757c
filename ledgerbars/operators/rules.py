"""The risk rules as a table and as check rows (rule_id, passed, value, limit, headroom).

Each rule is a value column, a limit and a direction; all rules of a frame are evaluated in one pass and
unfolded to long form from the row itself, so no join with the rule table takes place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import OPEN
from ..sources.config import limits, minutes


@dataclass(frozen=True)
class Rule:
    rule_id: str
    value: str
    limit: float
    most: bool = True  # the value may be at most the limit; else at least
    strict: bool = False


L = limits()
#: The rules whose answer is one value against one limit, and the value's column. Rules with more than one limit have a query of their own each.
RULES = (
    Rule("capital_cap", "deployed", L["capital_cap"]["max_deployed_capital_inr"]), Rule("per_trade_risk", "risk_pct", L["per_trade_risk"]["intraday_pct"]), Rule("daily_loss_soft", "day_pct", L["daily_loss_soft"]["day_mtm_pct"], False, True),
    Rule("daily_loss_hard", "day_pct", L["daily_loss_hard"]["day_mtm_pct"], False, True), Rule("weekly_drawdown", "drawdown_pct", L["weekly_drawdown"]["drawdown_pct"], True, True), Rule("equity_floor_rung", "equity_pct", L["equity_floor_rung"]["equity_pct_of_base"], False, True),
    Rule("cumulative_floor", "equity_pct", L["cumulative_floor"]["equity_pct_of_base"], False), Rule("consecutive_losses", "losses", L["consecutive_losses"]["max_per_session"], True, True), Rule("max_new_trades_day", "trades_day", L["max_new_trades_day"]["count"]),
    Rule("max_open_positions", "open_total", L["max_open_positions"]["total"]), Rule("per_stock_exposure", "symbol_notional", L["per_stock_exposure"]["cnc_notional_inr"]), Rule("per_sector_exposure", "sector_positions", L["per_sector_exposure"]["max_positions_per_sector"]),
    Rule("co_movement_cap", "corr", L["co_movement_cap"]["corr_max"]), Rule("max_leverage", "leverage", L["max_leverage"]["platform_cap_x"]), Rule("no_trade_windows", "minute_from_open", minutes(L["no_trade_windows"]["mis_entry_start"]) - OPEN, False),
    Rule("catalyst_guard", "domains", L["catalyst_guard"]["min_source_domains"], False), Rule("trade_window", "window_minutes", 0, False, True), Rule("stale_data_guard", "tick_age_s", L["stale_data_guard"]["max_tick_age_s"]), Rule("warmup_ready", "bars", L["choices"]["warmup_bars"], False),
    Rule("regime_data_ready", "regime_days", L["choices"]["regime_days"], False), Rule("clock_skew", "skew_s", L["clock_skew"]["max_skew_s"]), Rule("entry_sanity_band", "band_pct", L["entry_sanity_band"]["mis_pct"]), Rule("circuit_proximity", "circuit_pct", L["circuit_proximity"]["band_proximity_pct"], False, True),
    Rule("max_holding", "held_sessions", L["max_holding"]["swing_trading_days"]), Rule("min_residual_window", "residual_min", L["min_residual_window"]["min_hold_min"], False), Rule("order_rate", "entry_calls", L["order_rate"]["entry_calls_per_day"]),
    Rule("order_modifications", "modifications", L["order_modifications"]["self_cap"]), Rule("margin_buffer", "margin_ratio", L["margin_buffer"]["min_ratio"], False), Rule("min_viable_size", "edge_multiple", L["min_viable_size"]["edge_multiple_min_default"], False),
    Rule("analyst_confidence", "confidence", L["analyst_confidence_min"], False),
)


def check(rule: Rule, value: Column) -> Column:
    """One check as a struct; an unknown value fails."""
    limit = F.lit(float(rule.limit))
    v = value.cast("double")
    ok = {(True, False): v <= limit, (True, True): v < limit, (False, False): v >= limit, (False, True): v > limit}[rule.most, rule.strict]
    room = (limit - v) if rule.most else (v - limit)
    return F.struct(F.lit(rule.rule_id).alias("rule_id"), F.coalesce(ok, F.lit(False)).alias("passed"), v.alias("value"), limit.alias("limit"), room.alias("headroom"))


def check_rows(df: DataFrame, keys: list[str], rules=RULES) -> DataFrame:
    """A row for each of ``df`` and each rule whose value column it has."""
    have = [r for r in rules if r.value in df.columns]
    return df.select(*keys, F.explode(F.array(*(check(r, F.col(r.value)) for r in have))).alias("c")).select(*keys, "c.*")
