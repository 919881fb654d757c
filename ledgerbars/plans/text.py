"""Strings, JSON, hashes, regular expressions, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.similarity import similar
from ..registry import query
from ..sources.tables import load

#: Keywords by theme, taken from what the test texts hold; whole words, any case.
THEMES = {"definite": ("the", "that"), "plural": ("les", "des"), "german": ("und", "der")}


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN '[!!] ' WHEN 'signup' THEN '[!] ' ELSE '[i] ' END || upper(event_type) || ' | user ' || user_id || ' | value ' || coalesce(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), 'none') AS message FROM events""")
def render_messages(spark: SparkSession, sf: str) -> DataFrame:
    glyph = F.when(F.col("event_type") == "error", "[!!] ").when(F.col("event_type") == "signup", "[!] ").otherwise("[i] ")
    body = F.concat_ws(" | ", F.concat(glyph, F.upper("event_type")), F.concat(F.lit("user "), "user_id"), F.concat(F.lit("value "), F.coalesce(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("none"))))
    return load(spark, sf, "events").select("event_id", F.substring(body, 1, 256).alias("message"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def props_extract(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("SELECT doc_id, sha256(text) AS sha, length(text) AS n, sha256(text) = sha256(trim(text, ' ')) AS intact FROM documents")
def content_integrity(spark: SparkSession, sf: str) -> DataFrame:
    h = F.sha2("text", 256)
    return load(spark, sf, "documents").select("doc_id", h.alias("sha"), F.length("text").alias("n"), (h == F.sha2(F.trim("text"), 256)).alias("intact"))


def whole_words(words: tuple[str, ...]) -> str:
    """A pattern that Java and RE2 read alike: any case by ASCII letters, words bounded by what is no letter, mark, digit or _."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    any_case = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in words)
    return f"(^|{edge})({any_case})({edge}|$)"


@query(f"""WITH t AS (SELECT unnest([{", ".join(f"'{t}'" for t in THEMES)}]) AS theme, unnest([{", ".join(f"regexp_matches(text, '{whole_words(k)}')" for k in THEMES.values())}]) AS hit FROM documents)
SELECT theme, count(*) AS n_docs FROM t WHERE hit GROUP BY theme""")
def theme_tagging(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-word keywords in all documents, of any language or none."""
    hits = F.array(*(F.struct(F.lit(t).alias("theme"), F.col("text").rlike(whole_words(k)).alias("hit")) for t, k in THEMES.items()))
    d = load(spark, sf, "documents").select(F.explode(hits).alias("h")).filter("h.hit")
    return d.groupBy("h.theme").agg(F.count("*").alias("n_docs"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@query("""WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), k AS (SELECT label, list(m ORDER BY i) AS centre FROM c GROUP BY 1),
s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre) AS cos FROM embeddings JOIN k USING (label)) SELECT vec_id, label, round(cos, 4) AS cos, round(cos, 4) >= 0.75 AS in_cluster FROM s""")
def cluster_centroid_075(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each vector with the centre of its cluster, at least 0.75 to belong: linear in the vectors,
    where comparing all pairs would grow with the square of a cluster."""
    e = load(spark, sf, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    j = e.join(c, "label")
    cos = F.try_divide(dot(F.col("embedding"), F.col("centre")), F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("centre"), F.col("centre"))))
    return j.select("vec_id", "label", F.round(cos, 4).alias("cos"), (F.round(cos, 4) >= 0.75).alias("in_cluster"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, count(b.vec_id) AS n_links FROM e a LEFT JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.75 GROUP BY 1""")
def cluster_links_075(spark: SparkSession, sf: str) -> DataFrame:
    """How many other vectors are at cosine 0.75 or more, of any label or none."""
    return similar(load(spark, sf, "embeddings"), "vec_id", "embedding", 0.75).select(F.col("id").alias("vec_id"), "n_links")


@query()
def cluster_pairs_075(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, n_links, cluster_id): a cluster is what links at cosine 0.75 join, named by its smallest vec_id."""
    return similar(load(spark, sf, "embeddings"), "vec_id", "embedding", 0.75).select(F.col("id").alias("vec_id"), "n_links", "cluster_id")


@query("""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(replace(p_name, ' ', ',,') || ', 7, ' || p_size, ','), lambda x: try_cast(trim(x) AS INT) IS NOT NULL), lambda x: CAST(trim(x) AS INT)), ',') AS numbers FROM part""")
def csv_integers(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated integers; blanks and what is no number are skipped."""
    csv = F.concat(F.replace("p_name", F.lit(" "), F.lit(",,")), F.lit(", 7, "), F.col("p_size").cast("string"))
    n = F.transform(F.split(csv, ","), lambda x: F.trim(x).try_cast("int"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(F.filter(n, lambda x: x.isNotNull()), ",").alias("numbers"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1) || '<i>"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS title FROM pages""")
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit('<i>"'))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return load(spark, sf, "pages").select("page_id", t.alias("title"))


@query("""WITH s AS (SELECT event_id, CAST(event_id % 30 AS VARCHAR) || ':' || CAST((event_id * 7) % 75 AS VARCHAR) AS s FROM events), p AS (SELECT *, TRY_CAST(regexp_extract(s, '^(\\d{1,2}):(\\d{2})$', 1) AS INT) AS h, TRY_CAST(regexp_extract(s, '^(\\d{1,2}):(\\d{2})$', 2) AS INT) AS m FROM s)
SELECT event_id, CASE WHEN h <= 23 AND m <= 59 THEN h * 60 + m END AS strict_minutes, CAST(string_split(s, ':')[1] AS INT) * 60 + CAST(string_split(s, ':')[2] AS INT) AS lax_minutes FROM p""")
def parse_hhmm(spark: SparkSession, sf: str) -> DataFrame:
    """HH:MM, strict (null unless a time of day) and lax (whatever stands around the colon)."""
    s = F.concat_ws(":", (F.col("event_id") % 30).cast("string"), ((F.col("event_id") * 7) % 75).cast("string"))
    h, m = (F.regexp_extract(s, r"^(\d{1,2}):(\d{2})$", k).try_cast("int") for k in (1, 2))
    lax = F.split(s, ":")
    return load(spark, sf, "events").select("event_id", F.when((h <= 23) & (m <= 59), h * 60 + m).alias("strict_minutes"), (lax[0].cast("int") * 60 + lax[1].cast("int")).alias("lax_minutes"))


HEADERS = "CASE event_id % 4 WHEN 0 THEN 'Bearer ' || user_id WHEN 1 THEN 'bEaReR tok' || event_id WHEN 2 THEN 'Basic x' ELSE 'Bearer  ' END"


@query(f"SELECT event_id, nullif(regexp_extract({HEADERS}, '^(?i:bearer)\\s+(\\S+)\\s*$', 1), '') AS token, length({HEADERS}) AS redacted FROM events")
def bearer_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The second part of a two-part header of the right scheme; null otherwise. Secrets show by length alone."""
    k = F.col("event_id") % 4
    h = F.when(k == 0, F.concat(F.lit("Bearer "), "user_id")).when(k == 1, F.concat(F.lit("bEaReR tok"), "event_id")).when(k == 2, "Basic x").otherwise("Bearer  ")
    return load(spark, sf, "events").select("event_id", F.nullif(F.regexp_extract(h, r"^(?i:bearer)\s+(\S+)\s*$", 1), F.lit("")).alias("token"), F.length(h).alias("redacted"))


@query("""WITH c AS (SELECT event_id, CAST((event_id % 7) * -1073741819 AS BIGINT) AS code FROM events), u AS (SELECT *, ((code % 4294967296) + 4294967296) % 4294967296 AS raw FROM c)
SELECT event_id, raw, CASE WHEN raw = 0 THEN 'ok' WHEN raw = 3221225477 THEN 'access violation' WHEN code < 0 THEN 'signal' ELSE 'exit' END AS meaning FROM u""")
def exit_codes(spark: SparkSession, sf: str) -> DataFrame:
    code = (F.col("event_id") % 7) * F.lit(-1073741819).cast("long")
    raw = code.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return load(spark, sf, "events").select("event_id", raw.alias("raw"), F.when(raw == 0, "ok").when(raw == 0xC0000005, "access violation").when(code < 0, "signal").otherwise("exit").alias("meaning"))


@query("""SELECT conv_id, turn, lower(left(trim(text, ' '), 12)) AS head, split_part(text, ' ', 1) AS first_word, starts_with(text, 'T') AS starts_t, length(text) AS n, role || '_' || turn AS tag FROM conversations""")
def string_scalars(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf, "conversations").select("conv_id", "turn", F.lower(F.left(F.trim(t), F.lit(12))).alias("head"), F.split_part(t, F.lit(" "), F.lit(1)).alias("first_word"), t.startswith("T").alias("starts_t"), F.length(t).alias("n"), F.concat_ws("_", "role", "turn").alias("tag"))


@query("""SELECT event_id, array_to_string(map_keys(m), ',') AS keys, array_to_string(map_values(m), ',') AS values FROM (SELECT event_id, MAP {'level': 'info', 'key_name': event_type, 'user': CAST(user_id AS VARCHAR)} AS m FROM events)""")
def reserved_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Overlay of maps, the right one wins; reserved keys get a prefix."""
    base = F.create_map(F.lit("level"), F.lit("info"), F.lit("name"), F.col("event_type"))
    over = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    m = F.transform_keys(F.map_concat(base, over), lambda k, v: F.when(k.isin("name", "msg", "args"), F.concat(F.lit("key_"), k)).otherwise(k))
    return load(spark, sf, "events").select("event_id", F.array_join(F.map_keys(m), ",").alias("keys"), F.array_join(F.map_values(m), ",").alias("values"))
