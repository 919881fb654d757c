"""Line dedup: overlapping windows of three lines; later occurrences of a repeated window go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_back

#: Where a null doc_id sorts: before every long.
NOWHERE = str(-(2**63) - 1)


def tie(text: Column) -> Column:
    """30 bits of a text's MD5, which order rows that repeat a doc_id."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(2**30 - 1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_removed, text), one row for each row of ``docs``: ``text`` without the lines that a later window covers.

    A text's lines are what ``\\n`` separates. Every ``width`` consecutive lines form a window; windows
    are equal when a 128-bit hash of their lines is. Over all documents the first occurrence, by
    (doc_id, line), stays; each later one covers its lines, and covered lines are removed, runs of
    overlapping windows merged. Occurrences are judged on the input, not on what is left.

    A null text has no lines, gives n_lines 0 and a null text; an empty text has one empty line. A text
    of fewer lines than ``width`` is unchanged. A null doc_id sorts before all others. Rows that repeat a doc_id, or have none, are
    documents of their own, in the order of 30 bits of the text's MD5; rows equal in both are in the same place: neither
    takes lines from the other. An empty table gives no rows. Other columns are ignored. A very long text is one
    row of an unfolding, not one group; a window that a third of all rows hold is split in the join back.
    """
    text = docs[text_col].cast("string")
    key = F.coalesce(docs[id_col].cast("long").cast("decimal(20,0)"), F.lit(NOWHERE).cast("decimal(20,0)"))
    # One number orders occurrences, so that the aggregation stays a hash aggregation.
    place = (key * F.lit(2**30).cast("decimal(11,0)")).cast("decimal(30,0)") + F.coalesce(tie(text), F.lit(0))
    d = docs.select(place.cast("decimal(30,0)").alias("key"), docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    lines = F.split("text", "\n", -1)
    last = F.size("lines") - width
    part = lambda i, *extra: F.xxhash64(*extra, *(F.col("lines")[i + k] for k in range(width)))
    pair = lambda i: F.struct(i.cast("int").alias("at"), part(i).alias("h"), part(i, F.lit("2"), F.reverse(F.col("lines")[i])).alias("g"))
    w = d.filter(F.col("text").isNotNull()).select("key", lines.alias("lines")).filter(last >= 0)
    w = w.select("key", F.explode(F.transform(F.sequence(F.lit(0), last), pair)).alias("w")).select("key", "w.*")
    w = w.withColumn("place", (F.col("key") * F.lit(2**31).cast("decimal(11,0)") + F.col("at")).cast("decimal(38,0)"))
    first = cut(w.groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    total = first.agg(F.sum("n")).first()[0] or 0
    later = join_back(w, first, ["h", "g"], ["key", "at"], "n", total).filter("place > first")
    later = later.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (x > F.col("p")[F.greatest(i - 1, F.lit(0))] + width))
    ends = F.transform(F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.col("p")[F.least(i + 1, F.size("p") - 1)] > x + width)), lambda x: x + width)
    j = d.join(later.select("key", starts.alias("s"), ends.alias("e")), "key", "left")
    n = F.size(lines)
    j = j.withColumns({"lines": lines, "froms": F.concat(F.array(F.lit(0)), "e"), "tos": F.concat("s", F.array(n))})
    kept = F.flatten(F.transform(F.arrays_zip("froms", "tos"), lambda r: F.slice("lines", r["froms"] + 1, r["tos"] - r["froms"])))
    removed = F.aggregate(F.arrays_zip("s", "e"), F.lit(0), lambda a, r: a + r["e"] - r["s"])
    return j.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"),
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.when(F.col("s").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text, ('0x' || md5(text)[1:8])::BIGINT & 1073741823 AS tie FROM documents),
l AS (SELECT row_id, doc_id, tie, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL),
e AS (SELECT row_id, doc_id, tie, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l),
t AS (SELECT row_id, doc_id, tie, pos, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, count(*) OVER (PARTITION BY row_id) AS n
      FROM e WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
f AS (SELECT row_id, pos, rank() OVER (PARTITION BY line, b, c ORDER BY doc_id NULLS FIRST, tie, pos) AS nth FROM t WHERE pos <= n - 2),
r AS (SELECT DISTINCT row_id, pos + k AS pos FROM f, (VALUES (0), (1), (2)) v(k) WHERE nth > 1),
k AS (SELECT e.row_id, count(*)::INT AS n_lines, count(r.pos)::INT AS n_removed,
             coalesce(string_agg(CASE WHEN r.pos IS NULL THEN line END, chr(10) ORDER BY e.pos), '') AS text
      FROM e LEFT JOIN r ON e.row_id = r.row_id AND e.pos = r.pos GROUP BY e.row_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, k.text AS text
FROM d LEFT JOIN k ON d.row_id = k.row_id
"""
