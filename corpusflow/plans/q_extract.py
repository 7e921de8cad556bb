"""Queries on fields of cleaned text, nested records, rebuilt collections, source links and defaults."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import html as H
from ..functions import text as T
from ..operators import chunks as K
from ..operators import embed as M
from ..operators import records as R
from ..operators import search as S
from ..streaming import stream as ST
from . import sql_surface
from .q_search import _DIM, DOCS, QUESTIONS
from .registry import query, spread, table

# Rule-driven extraction: a text is made of each part's columns and read back.

_TEXT = """'<h1>' || p_name || '</h1> ' || CASE p_size % 3 WHEN 0 THEN 'direct growth equity fund ' WHEN 1 THEN 'a hybrid fund ' ELSE 'large cap ' END
 || CASE WHEN p_size % 4 = 0 THEN '' ELSE 'expense ratio: ' || p_size || '.25 % ' END || CASE WHEN p_size % 5 = 0 THEN 'no exit load ' ELSE 'exit load: 1% ' END
 || 'min sip: ₹' || p_size * 100 || ' nav: ₹' || (p_partkey % 1000 + 50) || ' 1Y: ' || p_size * 9 || ' % 3 year return: -' || p_size || ' % risk level: ' || (['very high', 'low', 'odd'])[p_size % 3 + 1]
 || ' ; equity: ' || (p_size + 20) || ' % debt: 40 % cash: 3 benchmark: ' || p_type"""


def _rule_text(spark, d):
    p, n, s = spread(table(spark, d, "part"), "p_partkey"), F.col("p_size"), lambda *parts: F.concat(*(x if hasattr(x, "alias") else F.lit(x) for x in parts))
    kind = F.when(n % 3 == 0, "direct growth equity fund ").when(n % 3 == 1, "a hybrid fund ").otherwise("large cap ")
    ratio, load = F.when(n % 4 == 0, "").otherwise(s("expense ratio: ", n, ".25 % ")), F.when(n % 5 == 0, "no exit load ").otherwise("exit load: 1% ")
    risk = F.element_at(F.array(F.lit("very high"), F.lit("low"), F.lit("odd")), n % 3 + 1)
    text = s("<h1>", F.col("p_name"), "</h1> ", kind, ratio, load, "min sip: ₹", n * 100, " nav: ₹", F.col("p_partkey") % 1000 + 50, " 1Y: ", n * 9, " % 3 year return: -", n, " % risk level: ", risk, " ; equity: ", n + 20, " % debt: 40 % cash: 3 benchmark: ", F.col("p_type"))
    return p.select("p_partkey", T.tidied(text).alias("text"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_TYPED = {
    "percentage": "CASE WHEN regexp_matches({0}, '[0-9]') THEN regexp_extract({0}, '([0-9]+\\.?[0-9]*)', 1) || '%' ELSE {0} END",
    "currency": "CASE WHEN regexp_matches({0}, '[0-9,]') THEN '₹' || regexp_extract({0}, '([0-9,]+)', 1) ELSE {0} END",
    "label": _TITLE, "text": "trim(regexp_replace({0}, '\\s+', ' ', 'g'))",
}
_PCT = "coalesce(TRY_CAST(regexp_extract({0}, '([0-9]+\\.?[0-9]*)%', 1) AS DOUBLE) BETWEEN 0 AND {1}, false)"
_CHECK = {
    "name": "length({0}) BETWEEN 3 AND 200", "text": "length({0}) BETWEEN 3 AND 500", "type": "{0} IN " + str(E.TYPES), "category": "{0} IN " + str(E.CATEGORIES), "risk": "{0} IN " + str(E.LEVELS),
    "percentage": _PCT.replace("{1}", "100"), "load": "(lower({0}) IN ('no exit load', 'nil exit load', 'nil', '0%') OR " + _PCT.replace("{1}", "10") + ")",
    "amount": "coalesce(TRY_CAST(replace(regexp_extract({0}, '₹?\\s*([0-9,]+)', 1), ',', '') AS DOUBLE) BETWEEN 100 AND 1000000, false)",
}


def _field_sql(field: str) -> str:
    """The same rules of a field, one CASE each."""
    tries = []
    for r in E.TEXT_RULES:
        if r.field == field and not r.generic:
            raw = f"trim(regexp_extract(t, {_sql_text('(?i)' + r.pattern)}, {min(1, re.compile(r.pattern).groups)}))"
            value = _TYPED[r.kind].format(raw)
            tries.append(f"CASE WHEN {raw} <> '' AND {_CHECK[r.check].format('(' + value + ')')} THEN {value} END")
    return f"coalesce({', '.join(tries)}) AS {field}"


_FIELDS = tuple(dict.fromkeys(r.field for r in E.TEXT_RULES))
_EXTRACTED = f"""x AS (SELECT p_partkey, p_size, {_TEXT} AS t FROM part), f AS (SELECT p_partkey, p_size, {', '.join(map(_field_sql, _FIELDS))},
 CASE WHEN p_size * 9 <= 200 THEN p_size * 9 || '%' END AS return_1y, '-' || p_size || '%' AS return_3y, (p_size + 60)::DOUBLE AS total FROM x),
a AS (SELECT *, CASE WHEN abs(total - 100) <= 5 THEN printf('%.1f', (p_size + 20) * 100 / total) || '%' ELSE (p_size + 20) || '.0%' END AS equity, '3' AS cash FROM f),
n AS (SELECT *, (name IS NOT NULL)::INTEGER AS r, {' + '.join(f'({f} IS NOT NULL)::INTEGER' for f in _FIELDS if f != 'name')} + 2 AS o FROM a)"""


@query(f"""WITH {_EXTRACTED} SELECT p_partkey, {', '.join(_FIELDS)}, return_1y, return_3y, equity, cash, round(least(100, (r + o) / 11 * 100 + 30 * r + 20 * o - 5 * (11 - r - o)), 1)::DOUBLE AS extraction_confidence,
 CASE WHEN name IS NOT NULL AND abs(total - 100) <= 5 THEN 'passed' ELSE 'failed' END AS validation_status FROM n""")
def text_extraction(spark, d):
    found = E.extracted(_rule_text(spark, d), F.col("text"))
    maps = (F.col("returns")["1Y"].alias("return_1y"), F.col("returns")["3Y"].alias("return_3y"), F.col("allocation")["equity"].alias("equity"), F.col("allocation")["cash"].alias("cash"))
    return found.select("p_partkey", *_FIELDS, *maps, "extraction_confidence", "validation_status")


_SHARES = "SELECT l_suppkey, round(sum(l_quantity) FILTER (l_returnflag = 'A') * 100 / sum(l_quantity), 1) AS a, round(sum(l_quantity) FILTER (l_returnflag = 'N') * 100 / sum(l_quantity), 1) AS b FROM lineitem GROUP BY 1"


@query(f"SELECT l_suppkey, a AS equity, CASE WHEN l_suppkey % 3 > 0 THEN b END AS debt, NULL::DOUBLE AS cash FROM ({_SHARES})")
def allocation_rows(spark, d):
    """Shares written into table rows or blocks of a page, and read back."""
    part = lambda flag: F.round(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))) * 100 / F.sum("l_quantity"), 1).cast("string")
    shares = table(spark, d, "lineitem").groupBy("l_suppkey").agg(part("A").alias("a"), part("N").alias("b"))
    one = F.concat(F.lit('<table class="allocation"><tr><td>Equity</td><td>'), "a", F.lit("%</td></tr><tr><td>Cash</td><td>none</td></tr></table>"))
    two = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("<div><b>Debt</b> "), "b", F.lit(" %</div>"))).otherwise("<div>Debt</div>")
    held = E.allocation(F.concat(F.lit("<body>"), one, two, F.lit("</body>")))
    return shares.select("l_suppkey", *(F.try_element_at(held, F.lit(c)).alias(c) for c in ("equity", "debt", "cash")))


_AD = "trim(regexp_replace(regexp_extract(html, '(?is)<[^>]*\\bclass=\"[^\"]*ad[^\"]*\"[^>]*>([^<]*)', 1), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"""SELECT page_id, CASE WHEN length({_AD}) > 40 THEN {_AD} END AS description, CASE WHEN regexp_extract(url, '^https://([^/]*)', 1) = '' THEN 'missing_required_fields' WHEN page_id % 101 < 50 THEN 'low_confidence' WHEN page_id % 101 < 80 THEN 'medium_confidence' ELSE 'valid' END AS status FROM pages""")
def page_descriptions(spark, d):
    site = F.nullif(F.regexp_extract("url", "^https://([^/]*)", 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", H.described(F.col("html"), ("none", "ad"), 40).alias("description"), E.status(F.col("page_id") % 101, (site,)).alias("status"))


_LEVELS = "CASE " + " ".join(f"WHEN contains(t, '{v.lower()}') THEN '{v}'" for v in E.RISK_LEVELS) + " END"
_COMPAT = "CASE " + " ".join(f"WHEN contains(t, '{v.lower()}') THEN '{v}'" for v in E.RISK_LEVELS_COMPAT) + " END"


@query(f"SELECT p_partkey, {_LEVELS} AS level, {_COMPAT} AS compat FROM (SELECT p_partkey, lower('Risk: ' || (['Moderately Low', 'High', 'Very High', 'Moderate', 'none'])[p_size % 5 + 1] || ' ' || p_type) AS t FROM part)")
def risk_levels(spark, d):
    t = F.concat(F.lit("Risk: "), F.element_at(F.array(*map(F.lit, ("Moderately Low", "High", "Very High", "Moderate", "none"))), F.col("p_size") % 5 + 1), F.lit(" "), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", E.first_contained(t).alias("level"), E.first_contained(t, E.RISK_LEVELS_COMPAT).alias("compat"))


# Records


@query(f"""WITH v AS (SELECT id, count(DISTINCT {_DIM}) AS dims FROM ({QUESTIONS}) GROUP BY 1)
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 1 ELSE coalesce(dims, 0) END AS dims, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS entries FROM benchmark LEFT JOIN v ON id = item_id""")
def default_fill(spark, d):
    """Metadata and vectors of added documents, where they are null."""
    own = F.when(F.col("item_id") % 3 == 0, F.array(F.lit(1.0)))
    docs = table(spark, d, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("v"))).alias("metadata"), own.alias("embedding"))
    filled = R.filled(docs, "text", M.dense_vector)
    return filled.select("item_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("dims"), F.size("metadata").alias("entries"))


@query("SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS kind, 'https://c' || c_custkey AS url FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0")
def unwrapped_records(spark, d):
    """Records out of a container that holds them, or only the metadata of their processing."""
    c = F.col
    known, named = c("c_custkey") % 3 > 0, c("c_custkey") % 2 == 0
    url = F.concat(F.lit("https://c"), c("c_custkey").cast("string"))
    record = F.when(known, F.struct(c("c_name").alias("name"), c("c_mktsegment").alias("kind"), url.alias("url")))
    held = table(spark, d, "customer").select("c_custkey", record.alias("record"), F.struct(F.when(named, c("c_name")).alias("name"), url.alias("source_url")).alias("processing"))
    return R.unwrapped(held, "record", {"name": c("processing.name"), "url": c("processing.source_url")}, "name").drop("processing")


@query("""SELECT p_partkey, nullif(CASE WHEN p_size % 3 = 0 THEN 'Not available' ELSE p_name END, 'Not available') AS known, coalesce(CASE WHEN p_size % 3 > 0 THEN p_name END, 'Not available') AS shown FROM part""")
def sentinel_round_trip(spark, d):
    shown = F.when(F.col("p_size") % 3 == 0, T.SENTINEL).otherwise(F.col("p_name"))
    known = table(spark, d, "part").select("p_partkey", T.to_null(shown).alias("known"))
    return known.select("p_partkey", "known", T.to_sentinel(F.col("known")).alias("shown"))


@query("SELECT p_partkey, 'new' AS a, p_brand AS b, CASE WHEN p_size % 2 = 0 THEN p_type END AS c FROM part")
def map_overlay(spark, d):
    """A map of parsed values with the extracted ones over it."""
    first = F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_brand"))
    second = F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    m = R.merged_maps(first, second)
    return table(spark, d, "part").select("p_partkey", *(m[k].alias(k) for k in "abc"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '[^\pL\pN\p{Mn}\p{Pc}\s\-.,%₹()]', '', 'g'), '\s*-\s*', ' - ', 'g'), '\s*\.\s*', '. ', 'g')) AS spaced FROM documents""")
def text_spaced(spark, d):
    return table(spark, d, "documents").select("doc_id", T.spaced(F.col("text")).alias("spaced"))


@query("SELECT o_orderkey, 'doc_' || (row_number() OVER (ORDER BY o_orderkey) - 1 + 7) AS new_id FROM orders")
def dense_ids(spark, d):
    return R.numbered(table(spark, d, "orders").select("o_orderkey"), "doc_", "o_orderkey", 7)


# Chunks


@query("""SELECT p_partkey, 'Details:' || chr(10) || 'P Name: ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Brand Line: ' || p_brand ELSE '' END AS content FROM part""")
def overview_chunks(spark, d):
    """One chunk from a free map; entries that are not available are left out."""
    values = F.create_map(F.lit("p_name"), F.col("p_name"), F.lit("brand_line"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(T.SENTINEL))
    return table(spark, d, "part").select("p_partkey", K.map_chunk("Details", values).alias("content"))


@query("""WITH w AS (SELECT conv_id, turn, text, lag(text) OVER o AS p, lead(text) OVER o AS f FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, list_filter(string_split_regex(p, '[ \\t\\n\\r]+'), lambda x: x <> '') AS pw, list_filter(string_split_regex(f, '[ \\t\\n\\r]+'), lambda x: x <> '') AS fw FROM w)
SELECT conv_id, turn, coalesce('Context: ' || nullif(CASE WHEN len(pw) <= 9 THEN p ELSE array_to_string(pw[-9:], ' ') END, '') || chr(10) || chr(10), '') || text || coalesce(chr(10) || chr(10) || 'Related: ' || nullif(CASE WHEN len(fw) <= 4 THEN f ELSE array_to_string(fw[1:4], ' ') END, ''), '') AS with_context FROM s""")
def neighbour_tail(spark, d):
    """Context from the end of the turn before."""
    return K.with_neighbours(table(spark, d, "conversations"), "conv_id", "turn", 9, "text", tail=True).select("conv_id", "turn", "with_context")


@query("""SELECT p_partkey, 'primary_001' AS chunk_id, p_brand AS brand, 'Not available' AS risk_level, p_size > 25 AS overlap_applied, length(p_name) // 4 AS token_count, 1 AS source_field_count, 'https://p' || p_partkey AS source_url FROM part""")
def chunk_metadata(spark, d):
    c = F.col
    rows = table(spark, d, "part").select(
        "p_partkey", "p_brand", F.lit("primary_001").alias("chunk_id"), F.lit("primary").alias("chunk_type"), F.lit("high").alias("priority"), c("p_name").alias("content"), F.when(c("p_size") > 25, F.concat(F.lit("Context: "), "p_name")).otherwise(c("p_name")).alias("with_context"),
        T.token_estimate(c("p_name")).cast("long").alias("token_count"), F.array(F.lit("name")).alias("source_fields"), F.lit(100.0).alias("completeness"), F.lit(90.0).alias("relevance"),
    )
    page = {"brand": c("p_brand"), "risk_level": T.to_sentinel(F.lit(None).cast("string"))}
    m = K.with_metadata(rows, page, {"source_url": F.concat(F.lit("https://p"), c("p_partkey").cast("string"))})
    return m.select("p_partkey", "chunking_metadata.chunk_id", "page_metadata.brand", "page_metadata.risk_level", "chunking_metadata.overlap_applied", "quality_metadata.token_count", "quality_metadata.source_field_count", "source_metadata.source_url")


@query("""WITH o AS (SELECT 'p' || p_partkey AS id, p_name AS content FROM part WHERE p_size % 9 > 0), e AS (SELECT 'p' || l_partkey AS id, 'held ' || count(*) AS content FROM lineitem WHERE l_discount > 0.08 GROUP BY l_partkey)
SELECT * FROM e UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM e)""")
def rebuilt_collection(spark, d):
    """A collection made anew from old chunks, some of them empty, and enriched ones."""
    old = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 9 > 0, F.col("p_name")).otherwise("").alias("content"))
    lines = table(spark, d, "lineitem").where("l_discount > 0.08").groupBy("l_partkey").agg(F.count("*").alias("n"))
    enriched = lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.concat(F.lit("held "), F.col("n").cast("string")).alias("content"))
    return R.rebuilt(old, enriched, "id", "content")


# Links, SQL, deliveries


@query("""WITH u AS (SELECT l_orderkey, l_extendedprice AS rank, CASE WHEN l_quantity > 35 THEN 'https://s' || l_suppkey WHEN l_quantity > 30 THEN '' END AS url FROM lineitem),
g AS (SELECT l_orderkey, arg_min(coalesce(url, ''), rank) AS top, arg_min(url, rank) FILTER (url <> '') AS first_url FROM u GROUP BY 1)
SELECT o_orderkey, coalesce(nullif(top, ''), first_url, CASE WHEN o_custkey % 2 = 0 THEN 'https://c' || o_custkey END, 'https://example.org/') AS url FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def source_urls(spark, d):
    """The link that goes with an answer: of its first chunk, else of the first one that has any, else of its entity, else a default."""
    n = F.col("l_quantity")
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("rank"), F.when(n > 35, F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"))).when(n > 30, "").alias("url"))
    there = F.when(F.length("url") > 0, F.struct("rank", "url"))
    links = chunks.groupBy("o_orderkey").agg(F.min_by(F.coalesce("url", F.lit("")), "rank").alias("top"), F.min(there)["url"].alias("some"))
    entities = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("https://c"), F.col("c_custkey").cast("string")).alias("own"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(links, "o_orderkey", "left").join(entities, "o_custkey", "left")
    return rows.select("o_orderkey", S.source_url(F.col("top"), F.col("some"), F.col("own"), "https://example.org/").alias("url"))


@query(f"SELECT id AS doc_id, count(DISTINCT {_DIM}) AS dims FROM ({DOCS}) GROUP BY 1")
def sql_vectors(spark, d):
    """The vectors of a table of texts as a view, asked in SQL."""
    sql_surface.vector_view(table(spark, d, "documents"), "doc_id", "text", "corpusflow_vectors")
    return spark.sql("SELECT doc_id, count(*) AS dims FROM corpusflow_vectors GROUP BY doc_id")


@query("SELECT url, epoch_us(ts) // 1000000 AS at, 1::BIGINT AS kept FROM (SELECT DISTINCT url, ts FROM pages JOIN events ON event_id % (SELECT max(page_id) + 1 FROM pages) = page_id)")
def delivered_pages(spark, d):
    """Pages that are delivered again and again: one delivery of each (url, time) is kept."""
    pages, events = table(spark, d, "pages").select("page_id", "url"), table(spark, d, "events")
    n = pages.agg(F.max("page_id") + 1).first()[0]
    sent = events.select((F.col("event_id") % n).alias("page_id"), F.col("ts").cast("timestamp").alias("at")).join(pages, "page_id").drop("page_id")
    kept = ST.deduplicated(sent.union(sent), ["url", "at"], "at").withColumn("n", F.count("*").over(W.partitionBy("url", "at")))
    return kept.select("url", F.unix_timestamp("at").alias("at"), F.col("n").alias("kept"))


@query("""WITH l AS (SELECT s_nationkey, list(x ORDER BY s_suppkey, n) AS ls FROM (SELECT s_nationkey, s_suppkey, 1 AS n, 'S Suppkey: ' || s_suppkey AS x FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 2, 'S Name: ' || s_name FROM supplier) GROUP BY s_nationkey),
p AS (SELECT s_nationkey, list_reduce(list_prepend({'done': []::VARCHAR[], 'cur': NULL::VARCHAR, 'x': NULL::VARCHAR}, list_transform(ls, lambda y: {'done': []::VARCHAR[], 'cur': NULL::VARCHAR, 'x': y})),
 lambda a, b: CASE WHEN a.cur IS NOT NULL AND (length(a.cur) + 1 + length(b.x)) // 4 > 40 THEN {'done': list_append(a.done, a.cur), 'cur': b.x, 'x': NULL::VARCHAR} ELSE {'done': a.done, 'cur': concat_ws(chr(10), a.cur, b.x), 'x': NULL::VARCHAR} END) AS r FROM l),
c AS (SELECT s_nationkey, list_append(r.done, r.cur) AS cs FROM p)
SELECT s_nationkey, i::INTEGER AS chunk_no, cs[i] AS content, len(string_split(cs[i], chr(10)))::INTEGER AS n_lines, greatest(1, length(cs[i]) // 4)::INTEGER AS token_count FROM (SELECT s_nationkey, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)""")
def entity_chunks(spark, d):
    """Chunks of each nation's suppliers, by a table function called from SQL text."""
    sql_surface.register(spark)
    table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name").createOrReplaceTempView("corpusflow_suppliers")
    return spark.sql("SELECT * FROM entity_chunks(TABLE(corpusflow_suppliers) PARTITION BY s_nationkey ORDER BY (s_suppkey), 's_nationkey', 40)")
