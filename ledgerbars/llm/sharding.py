"""Balanced sharding by label propagation under capacity quotas; law `rows`: shard counts are at most one apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut, join_back, prefix_sum


def of(xs: list[int], at: Column) -> Column:
    """The item of a list of a few numbers that a column names."""
    return F.array(*(F.lit(x).cast("long") for x in xs))[at]


def propagate(groups: DataFrame, rooms: list[int], buckets: int) -> tuple[DataFrame | None, list[int], list]:
    """Rounds of propagation over ``groups`` (gid, n, c: members by label): (gid, home, start), the room left by shard, and
    the groups that fit no shard whole.

    In a round the members of a group wish for the label that most of their neighbours have, of the shards whose room takes all
    of them; ties go by a hash, so that no shard is preferred. A shard admits wishes in a pseudorandom order while there
    is room. Who is not admitted keeps its labels and wishes again, until nothing moves. Each round admits the first group of each
    shard that is wished for; a shard's rows to the driver are one.
    """
    todo, placed, shards, base = groups, None, len(rooms), [0] * len(rooms)
    while True:
        wishes = [F.when(F.col("n") <= F.lit(room), F.struct(F.coalesce(F.col("c")[s], F.lit(0)).alias("near"), F.xxhash64("gid", F.lit(s)).alias("tie"), F.lit(s).alias("to"))) for s, room in enumerate(rooms)]
        asked = todo.withColumn("to", (F.greatest(*wishes) if shards > 1 else wishes[0])["to"])
        lined = cut(prefix_sum(asked.filter("`to` is not null"), ["to"], ["gid"], F.col("n"), "before", buckets).withColumn("in", F.col("before") + F.col("n") <= of(rooms, F.col("to"))))
        admitted = {r["to"]: r["n"] for r in lined.filter("in").groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not admitted:
            return placed, rooms, todo.collect()
        now = lined.filter("in").select("gid", F.col("to").alias("home"), (F.col("before") + of(base, F.col("to"))).alias("start"))
        placed = now if placed is None else placed.union(now)
        left = lined.filter("not in").select("gid", "n", "c").union(asked.filter("`to` is null").select("gid", "n", "c"))
        base = [b + admitted.get(s, 0) for s, b in enumerate(base)]
        rooms = [r - admitted.get(s, 0) for s, r in enumerate(rooms)]
        todo = cut(left)
        if todo.isEmpty():
            return placed, rooms, []


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    Documents of equal texts are linked. All begin with a pseudorandom label; linked ones move in rounds to the shard where
    most of their neighbours are (``propagate``), under quotas that keep counts even, until nothing moves. Only
    linked documents take part, as one row a group with its members by label, as members of one label act alike. At the end
    fewer groups than shards are left that no shard has room for; those and groups larger than a shard are cut over as few shards as the
    room allows, and unlinked documents fill the rest. Only a few rows a shard reach the driver.

    Counts differ by one at most, at any input; slots are gapless from 0 in each shard; law is ``rows``
    and grown_shard null. A null text has size 1 and crc32 0 and is linked with other null texts, not
    with empty ones. Groups are told apart by a 64-bit hash: should two texts share one, they share a home. Ids may be null or repeat,
    each row gets a slot of its own. An empty table gives no rows.
    """
    t = docs[text_col].cast("string")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(t.isNull(), t).alias("gid"),
    )
    rows = cut(rows)  # the texts are read once
    by_label = rows.groupBy("gid", F.pmod(F.xxhash64(F.lit(7), "doc_id", "size"), F.lit(shards)).cast("int").alias("label")).agg(F.count("*").alias("k"))
    groups = by_label.groupBy("gid").agg(F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "k"))).alias("c")).filter("n > 1")
    groups = cut(groups)  # one row for each group of linked documents, at most ``shards`` labels in each
    total, linked = rows.count(), groups.agg(F.sum("n")).first()[0] or 0
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    rooms, pieces = capacity[:], []

    def deal(group) -> None:
        """Cut one group over the shards where most of it is, those with room for most first."""
        turn, n = 0, group["n"]
        for s in sorted(range(shards), key=lambda s: (-min(rooms[s], n), -group["c"].get(s, 0))):
            k = min(rooms[s], n - turn)
            if k:
                pieces.append((group["gid"], turn, turn + k, s, capacity[s] - rooms[s]))
                rooms[s], turn = rooms[s] - k, turn + k

    large = F.col("n") > capacity[-1]
    for g in sorted(groups.filter(large).collect(), key=lambda g: (-g["n"], g["gid"])):  # fewer than shards
        deal(g)
    first = [c - r for c, r in zip(capacity, rooms, strict=True)]
    placed, rooms, left = propagate(groups.filter(~large), rooms, buckets_for(linked))
    for g in sorted(left, key=lambda g: (-g["n"], g["gid"])):  # fewer than shards: each is larger than any room
        deal(g)
    homes = groups.select("gid", "n")
    if placed is not None:
        homes = homes.join(placed.withColumn("start", F.col("start") + of(first, F.col("home"))), "gid", "left")
    else:
        homes = homes.withColumns({"home": F.lit(None).cast("int"), "start": F.lit(None).cast("long")})
    # A document's turn within its group, or among all that are not linked; a hot group is spread over many sorts.
    d = join_back(rows, homes, ["gid"], ["doc_id", "size"], "n", total, how="left")
    d = d.withColumns({"linked": F.col("n").isNotNull(), "key": F.when(F.col("n").isNotNull(), F.col("gid")).otherwise(F.lit(0))})
    d = prefix_sum(d, ["linked", "key"], ["doc_id", "size", "gid"], None, "turn", buckets_for(total))
    names = ("gid", "lo", "hi", "to", "at")
    literal = [F.struct(*(F.lit(x).cast("long").alias(n) for n, x in zip(names, p, strict=True))) for p in pieces or [(None,) * 5]]
    cuts = F.broadcast(d.sparkSession.range(1).select(F.inline(F.array(*literal)))).alias("p")  # at most shards rows for each of 2 * shards groups
    d = d.alias("d").join(cuts, (F.col("d.gid") == F.col("p.gid")) & F.col("linked") & (F.col("turn") >= F.col("lo")) & (F.col("turn") < F.col("hi")), "left")
    # The queue of unlinked documents fills the room of shard 0, then of shard 1, ...
    before = [sum(rooms[:s]) for s in range(shards)]
    fill = sum(((F.col("turn") >= x).cast("int") for x in before[1:]), F.lit(0))
    last = [c - r for c, r in zip(capacity, rooms, strict=True)]
    shard = F.when(~F.col("linked"), fill).otherwise(F.coalesce("to", "home"))
    slot = F.when(~F.col("linked"), F.col("turn") - of(before, fill) + of(last, fill)).when(F.col("to").isNotNull(), F.col("turn") - F.col("lo") + F.col("at")).otherwise(F.col("start") + F.col("turn"))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
