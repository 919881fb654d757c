"""The action union: five kinds of proposal in one flat struct, each with its own keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of every action, those of them that the platform writes, keys by action (required, optional), and closed word lists.
COMMON = ("action", "schema_version", "proposal_id", "agent_id", "thesis", "confidence", "valid_until", "inputs_digest")
PLATFORM = ("proposal_id", "agent_id", "valid_until", "inputs_digest")
ACTIONS = {
    "enter": (("tradingsymbol", "exchange", "side", "style", "entry_type", "stop_price", "quantity", "signal_id", "strategy_id", "features_snapshot_id"), ("entry_price", "target_price")),
    "exit": (("position_id", "exit_type", "reason"), ("limit_price",)),
    "modify-stop": (("position_id", "new_stop"), ()),
    "modify-target": (("position_id",), ("new_target",)),
    "cancel": (("order_id",), ()),
}
WORDS = {"exchange": ("NSE",), "side": ("BUY", "SELL"), "style": ("intraday", "swing", "position"), "entry_type": ("LIMIT", "MARKET"), "exit_type": ("MARKET", "LIMIT"), "reason": ("thesis_invalidated", "target_neared", "risk_event", "time_stop", "other")}
NUMBERS = ("stop_price", "entry_price", "target_price", "limit_price", "new_stop", "new_target")


def validate_actions(df: DataFrame, body: str) -> DataFrame:
    """``df`` with ``problem``: the first of a fixed order of checks that fails, null if the proposal is valid."""
    keys = F.json_object_keys(body)
    get = lambda k: F.get_json_object(body, f"$.{k}")
    action = get("action")
    of = lambda f: F.coalesce(*(F.when(action == a, f(a)) for a in ACTIONS))
    allowed = of(lambda a: F.size(F.array_except(keys, F.array(*map(F.lit, (*COMMON, *ACTIONS[a][0], *ACTIONS[a][1]))))) == 0)
    complete = of(lambda a: F.size(F.array_except(F.array(*map(F.lit, ACTIONS[a][0])), keys)) == 0)
    n, c = F.length(get("thesis")), get("confidence").try_cast("double")
    bad_word = F.lit(False)
    for k, words in WORDS.items():
        bad_word = bad_word | (get(k).isNotNull() & ~get(k).isin(*words))
    bad_number = F.lit(False)
    for k in NUMBERS:
        bad_number = bad_number | (get(k).isNotNull() & get(k).try_cast("decimal(18,4)").isNull())
    q = get("quantity")
    bad_number = bad_number | (q.isNotNull() & ~F.coalesce(q.try_cast("long") > 0, F.lit(False)))
    ok = lambda x: F.coalesce(x, F.lit(False))
    # A time without a zone is no instant.
    until = get("valid_until")
    naive = until.isNotNull() & ~F.coalesce(until.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"), F.lit(False))
    problem = (
        F.when(keys.isNull(), "not an object").when(~ok(action.isin(*ACTIONS)), "unknown action").when(~ok(allowed), "unknown key").when(~ok(n.between(20, 600)), "thesis")
        .when(~ok(c.between(0, 1)), "confidence").when(~ok(complete), "missing key").when(bad_word, "word").when(bad_number, "number").when(naive, "valid_until")
    )
    return df.withColumn("problem", problem)


def stamp(body: Column, proposal_id: Column, agent_id: Column, valid_until: Column, inputs_digest: Column) -> Column:
    """The proposal with the platform's four keys written over whatever it brought; null if it is no object. Other keys keep their values,
    which are read as text and written as they were: numbers, lists and objects unquoted."""
    keys = F.json_object_keys(body)
    parts = F.from_json(body, "map<string,string>")
    own = F.create_map(F.lit(PLATFORM[0]), proposal_id, F.lit(PLATFORM[1]), agent_id, F.lit(PLATFORM[2]), valid_until, F.lit(PLATFORM[3]), inputs_digest)
    rest = F.filter(keys, lambda k: ~k.isin(*PLATFORM))
    raw = lambda k: F.when(F.coalesce(F.element_at(parts, k).rlike(r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|[\[{].*)$"), F.lit(False)), F.element_at(parts, k)).otherwise(F.to_json(F.array(F.element_at(parts, k))))
    plain = lambda k: F.regexp_replace(raw(k), r'^\["(.*)"\]$', '"$1"')
    kept = F.transform(rest, lambda k: F.concat(F.lit('"'), k, F.lit('":'), plain(k)))
    over = F.transform(F.map_entries(own), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"')))
    return F.when(keys.isNotNull(), F.concat(F.lit("{"), F.array_join(F.concat(kept, over), ","), F.lit("}")))
