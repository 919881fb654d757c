"""Mixing sources to target weights: fixed-length blocks, drawn counts, permuted slots, joins by index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, buckets_for, cut, prefix_sum, same

#: Cells of the range from which slots draw their source; rounds of the permutation.
CELLS, ROUNDS = 1024, 24
#: Up to so many sources their tables are broadcast; more are joined by a shuffle.
FEW = 10_000


def permuted(df: DataFrame, x: str, n: str, *salts: Column | int) -> DataFrame:
    """Index ``x`` becomes its place in a pseudorandom permutation of 0 .. n - 1, for each list of salts another one.

    Swap or not: in each round x and its mirror image by a round key change places if a hash of the larger one is odd, which is
    a bijection of any n numbers. No sort, no table: a slot's block is computed from its index, in generated code.
    """
    by = [s if isinstance(s, Column) else F.lit(s) for s in salts]
    for r in range(ROUNDS):
        df = df.withColumn("_mirror", F.pmod(F.pmod(F.xxhash64(*by, F.lit(r)), n) - F.col(x), n))
        df = df.withColumn(x, F.when(F.xxhash64(*by, F.lit(r), F.greatest(x, "_mirror")).bitwiseAND(1) == 1, F.col("_mirror")).otherwise(F.col(x)))
    # A generator's output takes no filter of a later join below it, where the rounds' expressions would be nested and double each time.
    return df.drop("_mirror").withColumn(x, F.explode(F.array(x)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) -> with sid, weight and target; one row a source.

    Sources in order of code point, null last, take ``weights`` in turn. Targets share ``share`` of all
    sizes by weight, stop at ``most`` times their source's size, and what is above goes to the others by
    weight until none is above: target = min(most * size, level * weight). A source stops where filling
    all to its own level would not use the whole.
    """
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("sid", k).withColumn("weight", F.array(*(F.lit(float(w)) for w in weights))[F.col("sid") % len(weights)])
    s = s.withColumn("stop", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("stop") / F.col("weight"))
    all_, upto = Window.partitionBy(), Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("budget", F.sum("source_size").over(all_) * F.lit(float(share))).withColumn("above", F.sum("weight").over(all_) - F.sum("weight").over(upto))
    s = s.withColumn("full", F.sum("stop").over(upto) + F.col("ratio") * F.col("above") <= F.col("budget"))
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_)
    level = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("stop"))).over(all_), F.lit(0.0))) / rest
    return s.select(*sizes.columns, "sid", "weight", F.when(F.col("full"), F.col("stop")).otherwise(F.least(F.col("stop"), level * F.col("weight"))).alias("target"))


class Mix:
    """The parts of a mix, each a frame: ``docs`` with sid and start, ``drawn`` and corrected counts, ``slots`` and ``segments``."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, shard_blocks: int = 4096, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 0):
        self.block, spark = block, docs.sparkSession
        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        rows = cut(rows)
        # Sources are few: their windows are one task's, as they are one row each.
        sources = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, share).coalesce(1))
        seen = sources.agg(F.count("*").alias("sources"), F.sum("n_rows").alias("rows")).first()
        few = F.broadcast(sources) if seen["sources"] <= FEW else sources
        rows = rows.join(few, same(rows, few, ["source"])).select("doc_id", rows["source"], "sid", "size", "source_size", "target")
        # Where each document begins in its source's stream of words; cut, so that ties are broken once.
        self.docs = cut(prefix_sum(rows, ["sid"], ["doc_id", "size"], F.col("size"), "start", buckets_for(seen["rows"] or 0)))
        last = F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
        first = F.floor(F.col("start") / block).cast("long")
        seg = self.docs.filter("size > 0").select("sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        lo, hi = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
        self.segments = seg.select("sid", "block", "start", (lo - F.col("start")).alias("from"), (hi - F.col("start")).alias("to"))
        # Slots of each source: whole blocks, so many that their words come nearest to the target.
        n = F.ceil(F.col("source_size") / block).cast("long")
        once, rest = F.round(F.col("target") / block).cast("long"), F.round((F.col("target") - F.col("source_size")) / block).cast("long")
        c = F.when(F.col("target") >= 2 * F.col("source_size"), 2 * n).when(F.col("target") >= F.col("source_size"), n + F.least(n, rest)).otherwise(F.least(n, once))
        plan = sources.filter("source_size > 0").select("sid", n.alias("n"), c.alias("c")).filter("c > 0")
        upto = F.sum("c").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
        plan = cut(plan.withColumn("upto", upto).coalesce(1))
        total = plan.agg(F.max("upto")).first()[0] or 0
        shards = -(-total // shard_blocks)
        # The draw: each slot of an output shard draws a source with the sources' share of all slots as chances, which makes the
        # shard's counts by source one multinomial draw. A draw falls into a cell, and the sources of that cell are compared.
        wide = max(1, -(-total // CELLS))
        cells = plan.select("sid", (F.col("upto") - F.col("c")).alias("lo"), F.col("upto").alias("hi"), F.explode(F.sequence(F.floor((F.col("upto") - F.col("c")) / wide), F.floor((F.col("upto") - 1) / wide))).alias("cell"))
        cells = F.broadcast(cells) if seen["sources"] <= FEW else cells  # at most a row for each cell and source
        places = F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard_blocks), F.lit(total) - F.col("id") * shard_blocks) - 1)
        draws = spark.range(shards).select(F.col("id").alias("shard"), F.explode(places).alias("at")).select("shard", F.pmod(F.xxhash64(F.lit(seed), "shard", "at"), F.lit(max(1, total))).alias("u"))
        draws = draws.withColumn("cell", F.floor(F.col("u") / wide)).join(cells, "cell").filter("u >= lo and u < hi")
        self.drawn = cut(draws.groupBy("shard", "sid").agg(F.count("*").alias("blocks")))
        self._counts = cut(corrected(self.drawn, plan, buckets_for(shards)))
        # A source's slots are numbered over the shards; the number's place in the permutation of its pass is the block.
        some = F.broadcast(plan) if seen["sources"] <= FEW else plan
        laid = prefix_sum(self._counts, ["sid"], ["shard"], F.col("blocks"), "base", buckets_for(shards)).join(some.select("sid", "n"), "sid")
        laid = laid.withColumn("from", F.coalesce(F.sum("blocks").over(Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        slots = laid.select("shard", "sid", "n", "base", "from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
        slots = slots.select("shard", "sid", "n", (F.col("from") + F.col("i")).alias("at"), F.floor((F.col("base") + F.col("i")) / F.col("n")).cast("int").alias("pass"), F.pmod(F.col("base") + F.col("i"), F.col("n")).alias("index"))
        self.slots = permuted(slots.withColumnRenamed("index", "block"), "block", "n", seed + 1, F.col("sid"), F.col("pass")).select("sid", "pass", "block", "shard", "at")

    def counts(self) -> DataFrame:
        """(shard, sid, blocks): the source counts of each output shard: drawn, then corrected to the totals."""
        return self._counts

    def pieces(self) -> DataFrame:
        """(shard, at, pass, sid, block, start, from, to): the spans of words, within the document that starts there, of each output block."""
        return self.slots.join(self.segments.hint("merge"), ["sid", "block"])

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken): one row a document row."""
        times = self.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
        words = self.segments.join(times.hint("merge"), ["sid", "block"]).groupBy("sid", "start").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("words"))
        full = self.docs.filter("size > 0").join(words, ["sid", "start"], "left")
        cols = ["doc_id", "source", "size", "source_size", "target"]
        return full.select(*cols, F.coalesce("words", F.lit(0).cast("long")).alias("taken")).union(self.docs.filter("size = 0").select(*cols, F.lit(0).cast("long")))


def corrected(drawn: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """Drawn counts (shard, sid, blocks) made to sum to ``c`` of ``plan`` (sid, c) for each source; shards keep their size.

    Over the shards in a pseudorandom order a source's draws count until they reach its total; what the last shards drew
    beyond it goes, slot by slot, to the sources that were drawn too seldom. All but the last shards keep what they drew.
    """
    run = prefix_sum(drawn, ["sid"], ["shard"], F.col("blocks"), "before", buckets).join(plan.select("sid", "c"), "sid")
    kept = F.least("blocks", F.greatest(F.col("c") - F.col("before"), F.lit(0)))
    run = run.select("shard", "sid", "c", kept.alias("kept"), (F.col("blocks") - kept).alias("lost"), F.lit(0).alias("one"))
    lost = prefix_sum(run.filter("lost > 0"), ["one"], ["shard", "sid"], F.col("lost"), "at", buckets)
    lost = lost.select("shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("lost") - 1)).alias("k"))
    short = plan.join(run.groupBy("sid").agg(F.sum("kept").alias("kept")), "sid", "left").select("sid", (F.col("c") - F.coalesce("kept", F.lit(0))).alias("lack"), F.lit(0).alias("one")).filter("lack > 0")
    short = prefix_sum(short, ["one"], ["sid"], F.col("lack"), "at")
    short = short.select("sid", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("lack") - 1)).alias("k"))
    given = lost.join(short.hint("merge"), "k").groupBy("shard", "sid").agg(F.count("*").alias("blocks"))
    return run.filter("kept > 0").select("shard", "sid", F.col("kept").alias("blocks")).union(given.select("shard", "sid", "blocks")).groupBy("shard", "sid").agg(F.sum("blocks").alias("blocks"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs``.

    The size of a text is its number of words; null and empty texts have none and nothing of them is
    taken. Each source's words form one stream in a fixed order, packed into blocks. Each output shard draws its
    counts by source from one multinomial; the last shards are corrected so that sources get their totals. A block is taken at
    most once a pass and there are two passes, so of no document more than twice its size is taken. A
    source's taken words are within two blocks of its target. Reruns agree: all order comes from hashes
    of ids. Rows that repeat an id are documents of their own. Null ids and null sources are values like
    others. A source that holds a third of all rows is spread over hash buckets in every step. An empty
    table gives no rows; a table without words takes nothing.
    """
    return Mix(docs, **options).taken()


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: for each pass that takes words of a document, a row with the columns of
    ``docs`` and the words taken, joined by spaces; the text as it was if all its words are taken.
    Documents of which nothing is taken are gone. ``chars_col``, if there, becomes the new length.
    """
    m = Mix(docs, id_col, text_col, source_col, **options)
    # Rows that repeat an id: the nth row of an id and size goes with the nth place of it.
    starts = m.docs.filter("size > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "sid", "start")
    starts = starts.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("start")))
    runs = m.pieces().groupBy("sid", "start", "pass").agg(F.sort_array(F.collect_list(F.struct(F.col("from").cast("int").alias("a"), F.col("to").cast("int").alias("b")))).alias("runs"), F.sum(F.col("to") - F.col("from")).alias("n"))
    runs = starts.join(runs, ["sid", "start"]).select("_id", "_source", "_size", "_nth", "pass", "runs", "n")
    d = docs.select(F.struct("*").alias("_row"), docs[id_col].cast("long").alias("_id"), docs[source_col].cast("string").alias("_source"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    d = d.filter("_size > 0").withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64(F.col("_row")[text_col]))))
    j = d.join(runs, same(d, runs, ["_id", "_source", "_size", "_nth"])).select(d["_row"], d["_size"], "runs", "n")
    text = F.col("_row")[text_col]
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    part = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("_words", r["a"] + 1, r["b"] - r["a"]))), " ")
    j = j.withColumn("_words", F.when(F.col("n") < F.col("_size"), words)).withColumn("_text", F.when(F.col("n") < F.col("_size"), part).otherwise(text))
    made = {text_col: F.col("_text"), chars_col: F.length("_text").cast("long")}
    return j.select(*(made.get(c, F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
