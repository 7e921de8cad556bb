"""Queries on text and HTML columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import markup as U
from ..functions import text as T
from .registry import query, table

WS = r"[ \t\n\x0B\f\r]+"
COLLAPSED = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '[\r\n]+', ' ', 'g')) AS squeezed FROM documents""")
def text_squeeze(spark, d):
    return table(spark, d, "documents").select("doc_id", T.squeeze(F.col("text")).alias("squeezed"))


@query(f"SELECT doc_id, {COLLAPSED.format('text')} AS collapsed, {COLLAPSED.format('lower(text)')} AS normalised FROM documents")
def text_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("collapsed"), T.normalise(F.col("text")).alias("normalised"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b', '[EMAIL]', 'g'), 'https?://[^\s<>"'')]+', '[URL]', 'g') AS redacted FROM documents""")
def text_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


#: A word character and a blank, as Unicode has them.
_W, _B = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]", r"[\s\x{0B}\x{85}\p{Z}]"


@query(rf"""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, c, min(i) AS i, count(*) AS n FROM g GROUP BY doc_id, c, run),
a AS (SELECT doc_id, string_agg(CASE WHEN n >= 4 AND c NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)) THEN c ELSE repeat(c, n) END, '' ORDER BY i) AS characters FROM r GROUP BY doc_id),
t AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_W}+|[^{_W[1:-1]}]+') AS ts FROM documents)),
w AS (SELECT *, regexp_matches(t, '^{_W}') AS is_word, lag(t, 2) OVER o AS before, regexp_matches(lag(t) OVER o, '^{_B}+$') AS joined FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT *, is_word AND NOT coalesce(joined AND before = t, false) AS head FROM w),
n AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h),
m AS (SELECT *, count(*) FILTER (is_word) OVER (PARTITION BY doc_id, k) AS words, max(CASE WHEN is_word THEN i END) OVER (PARTITION BY doc_id, k) AS last FROM n),
b AS (SELECT doc_id, string_agg(t, '' ORDER BY i) FILTER (NOT (words >= 3 AND k > 0 AND NOT head AND i <= last)) AS words FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN text = '' THEN '' ELSE characters END AS characters, CASE WHEN text = '' THEN '' ELSE words END AS words FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def text_squash(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.squash_characters(t).alias("characters"), T.squash_words(t).alias("words"))


@query(r"""SELECT doc_id, regexp_replace(text, '[^\pL\pN\p{Mn}\p{Pc}\s\-.,%₹()]', '', 'g') AS stripped FROM documents""")
def text_strip_special(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_special(F.col("text")).alias("stripped"))


@query(r"""
WITH m AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, 'https?://\S+', '', 'g')), '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g') AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(trim(t), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1:3], ' ') AS three FROM m""")
def text_first_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_sentences(T.strip_urls(F.col("text"))).alias("three"))


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS estimate,
  len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))::INTEGER AS n_words FROM documents""".replace("\\\\", "\\"))
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("estimate"), F.size(T.words(F.col("text"))).alias("n_words"))


def _cut_sql(most: int) -> str:
    est = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"
    tries = []
    for p in T.BOUNDARIES:
        head = f"string_split_regex(text, '{p}')"
        tries.append(f"CASE WHEN len({head}) > 1 AND {est.format(head + '[1]')} <= {most} THEN {head}[1] END")
    words = f"array_to_string(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')[1:{most}], ' ')"
    return f"SELECT doc_id, CASE WHEN {est.format('text')} <= {most} THEN text ELSE coalesce({', '.join(tries)}, {words}) END AS cut FROM documents"


@query(_cut_sql(60))
def boundary_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", T.boundary_cut(F.col("text"), 60).alias("cut"))


@query("""SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\r%.-]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda x: length(x) >= 3), ' ') AS tokens FROM documents""")
def query_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


@query("""SELECT doc_id, text IS NOT NULL AND trim(text) NOT IN ('Not available', '', 'N/A', 'null', 'None') AS text_there, coalesce(nullif(lang, 'en'), 'Not available') AS foreign_lang FROM documents""")
def availability(spark, d):
    return table(spark, d, "documents").select("doc_id", T.available(F.col("text")).alias("text_there"), T.to_sentinel(F.nullif(F.col("lang"), F.lit("en"))).alias("foreign_lang"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_extract(price, '(\d+(?:,\d{3})*(?:\.\d+)?)', 1), ',', '', 'g') AS n, '₹' || regexp_replace(regexp_extract(price, '(\d+(?:,\d{3})*(?:\.\d+)?)', 1), ',', '', 'g') AS amount,
  p_size || '%' AS percent FROM (SELECT *, format('{:,}', p_partkey * 1000 + p_size) || '.5' AS price FROM part)""")
def numeric_clean(spark, d):
    p = table(spark, d, "part").withColumn("price", F.concat(F.format_number(F.col("p_partkey") * 1000 + F.col("p_size"), 0), F.lit(".5")))
    return p.select("p_partkey", T.clean_number(F.col("price")).alias("n"), T.clean_number(F.concat(F.lit("₹ "), "price")).alias("amount"), T.clean_number(F.concat(F.col("p_size").cast("string"), F.lit(" %"))).alias("percent"))


@query("""WITH c AS (SELECT p_partkey, trim(regexp_replace(p_name, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS name, '₹' || p_size AS price, p_size || '%' AS ratio FROM part)
SELECT p_partkey, name, price, ratio, ((name <> p0.p_name)::INTEGER + 2)::INTEGER AS changed FROM c JOIN part p0 USING (p_partkey)""")
def record_cleaning(spark, d):
    p = table(spark, d, "part")
    raw = {"name": F.col("p_name"), "price": F.concat(F.lit("  ₹"), F.col("p_size").cast("string"), F.lit(" ")), "ratio": F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" % "))}
    clean = {k: T.clean_field(k, v, (*T.FIELD_KINDS, ("price", "amount"))) for k, v in raw.items()}
    changed = sum(((raw[k] != clean[k]).cast("int") for k in raw), F.lit(0))
    return p.select("p_partkey", *(c.alias(k) for k, c in clean.items()), changed.alias("changed"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\bnav\b', 'net asset value', 'g'), '\baum\b', 'assets under management', 'g'), '\bsip\b', 'systematic investment plan', 'g'),
 '\belss\b', 'equity linked savings scheme', 'g'), '\bnfo\b', 'new fund offer', 'g') AS expanded FROM documents""")
def abbreviations(spark, d):
    return table(spark, d, "documents").select("doc_id", T.expand_abbreviations(F.col("text")).alias("expanded"))


@query("""WITH t AS (SELECT conv_id, turn, lower(text) AS low, text FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(low, 'system_error') OR contains(low, 'sorry, i encountered an error') THEN 'error' WHEN contains(low, 'compliance') OR contains(low, 'recommend') OR contains(low, 'investment advice') OR contains(low, 'advisor') THEN 'compliance' ELSE 'informational' END AS variant,
  regexp_replace(text, '(?i)(the|and)', '<b>\\1</b>', 'g') AS highlighted, trim(string_split(text, '. ')[1]) AS body, CASE WHEN contains(text, '. ') THEN trim(substr(text, strpos(text, '. ') + 2)) END AS footer FROM t""")
def message_display(spark, d):
    t = F.col("text")
    body, footer = T.body_and_footer(t, r"\. ")
    return table(spark, d, "conversations").select("conv_id", "turn", T.message_variant(t).alias("variant"), T.highlighted(t, ("the", "and")).alias("highlighted"), body.alias("body"), footer.alias("footer"))


@query("SELECT event_id, strftime(ts, '%d.%m.%Y') AS shown, strftime(to_timestamp(user_id % 86400) AT TIME ZONE 'UTC', '%H:%M:%S') AS duration FROM events")
def date_display(spark, d):
    s = F.col("user_id") % 86_400
    return table(spark, d, "events").select("event_id", F.date_format("ts", "dd.MM.yyyy").alias("shown"), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60).alias("duration"))


def _visible_sql() -> str:
    h = "html"
    for t in H.BOILERPLATE:
        h = f"regexp_replace({h}, '{H.element(t)}', ' ', 'g')"
    h = f"regexp_replace(regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    return COLLAPSED.format(f"regexp_replace({h}, '&[a-zA-Z0-9#]+;', ' ', 'g')")


@query(f"SELECT page_id, {_visible_sql()} AS text FROM pages")
def html_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", H.visible_text(F.col("html")).alias("text"))


_COUNTS = ", ".join(f"CASE WHEN len(regexp_extract_all(html, '{H.element(t)}')) > 0 THEN '{t}:' || len(regexp_extract_all(html, '{H.element(t)}')) END" for t in H.BOILERPLATE)


@query(f"SELECT page_id, array_to_string(list_filter([{_COUNTS}], lambda x: x IS NOT NULL), ',') AS removed FROM pages")
def html_boilerplate(spark, d):
    return table(spark, d, "pages").select("page_id", H.removed_counts(F.col("html")).alias("removed"))


_PRUNED = H.attribute_pattern().replace("'", "''")
_PIECES = f"regexp_extract_all(html, '{H.PIECES}')"


@query(f"SELECT page_id, array_to_string(list_transform({_PIECES}, lambda p: CASE WHEN regexp_matches(p, '^<[^!]') THEN regexp_replace(p, '{_PRUNED}', '\\1', 'g') ELSE p END), '') AS html FROM pages")
def html_attributes(spark, d):
    return table(spark, d, "pages").select("page_id", H.pruned_attributes(F.col("html")).alias("html"))


@query()  # a parser, not a pattern
def html_parsed_text(spark, d):
    return table(spark, d, "pages").select("page_id", H.parsed_text("html").alias("text"))


_INNER = "nullif(" + COLLAPSED.format("regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{0}\\b[^>]*>(.*?)</{0}>', 1), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')").replace("{{", "{") + ", '')"


@query(f"""WITH e AS (SELECT page_id, html, {_INNER.replace('{0}', 'h1')} AS h1, {_INNER.replace('{0}', 'title')} AS title FROM pages)
SELECT page_id, coalesce(CASE WHEN length(h1) > 3 THEN h1 END, nullif(trim(regexp_replace(title, '\\s*[-|]\\s*[^-|]*$', '')), ''), title, 'Untitled') AS heading,
 nullif(regexp_extract(html, '(?is)<html\\b[^>]*\\blang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, '(?is)<a\\b[^>]*\\bhref="([^"]*)"', 1), '') AS first_link,
 nullif({COLLAPSED.format("regexp_extract(html, '(?is)<[^>]*\\bclass=" + chr(34) + "ad" + chr(34) + "[^>]*>([^<]*)', 1)")}, '') AS ad FROM e""")
def html_fields(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", H.heading(h).alias("heading"), H.attribute(h, "html", "lang").alias("lang"), H.attribute(h, "a", "href").alias("first_link"), H.first_of(h, (("data-none", "x"), ("class", "ad"))).alias("ad"))


_NOISE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), '^(?:Loading|Please wait|404|Error|Access denied).*', ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b', '[EMAIL]', 'g'), 'https?://[^\s<>"'')]+', '[URL]', 'g'))"""


@query(f"""WITH v AS (SELECT page_id, html, {_visible_sql()} AS text FROM pages), c AS (SELECT page_id, length(html) AS a, length({_NOISE}) AS b FROM v)
SELECT page_id, a::INTEGER AS original_length, b::INTEGER AS cleaned_length, round(CASE WHEN a = 0 THEN 0 WHEN (a - b) / a * 100 BETWEEN 10 AND 50 THEN 100 - abs((a - b) / a * 100 - 30) * 2 WHEN (a - b) / a * 100 < 10 THEN 70 ELSE 50 END, 6)::DOUBLE AS score FROM c""")
def html_clean_step(spark, d):
    c = table(spark, d, "pages").select("page_id", H.clean_page(F.col("html")).alias("c")).select("page_id", "c.*")
    return c.select("page_id", "original_length", "cleaned_length", F.round(T.cleaning_score(F.col("original_length"), F.col("cleaned_length")), 6).alias("score"))


#: Phrases of error pages. Fixed values.
ERROR_PHRASES = ("404 not found", "page not found", "access denied", "rate limit", "captcha", "bot detection")


@query(f"""WITH v AS (SELECT page_id, {_visible_sql()} AS text FROM pages)
SELECT page_id, CASE WHEN regexp_matches(lower(text), '{'|'.join(ERROR_PHRASES)}') THEN 'error page' WHEN length(text) < 900 THEN 'too short' ELSE 'ok' END AS reason FROM v""")
def bad_pages(spark, d):
    t = H.visible_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.when(F.lower("t").rlike("|".join(ERROR_PHRASES)), "error page").when(F.length("t") < 900, "too short").otherwise("ok").alias("reason"))


@query()  # SQL here has no compatibility form
def text_nfkc(spark, d):
    return table(spark, d, "documents").select("doc_id", T.nfkc(F.col("text")).alias("nfkc"))


@query()  # capitals after any character that is no letter
def title_words(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.title_words(F.lower("p_name"), ("red", "steel")).alias("named"), T.title_case(F.lower("p_type")).alias("title"))


_RAW = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|''[^'']*''|[^''\">])*)>"
_ELEMENTS = rf"""h AS (SELECT page_id, regexp_replace(html, '{_RAW}', '', 'g') AS t FROM pages),
g AS (SELECT page_id, t, regexp_extract_all(t, '{_TAG}', 0) AS tags, string_split_regex(t, '{_TAG}') AS gaps FROM h),
i AS (SELECT page_id, t, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS tag, unnest(list_transform(range(1, len(tags) + 1), lambda n: list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(tags[1:n - 1], lambda x: length(x))), 0))) AS s FROM g),
k AS (SELECT page_id, t, i, tag, s::BIGINT AS s, (s + length(tag))::BIGINT AS e, lower(regexp_extract(tag, '{_TAG}', 2)) AS name, tag[2] = '/' AS closing FROM i),
l AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY i) + closing::INT AS level FROM k WHERE name NOT IN ('{"', '".join(U.VOID)}') AND tag[-2] <> '/'),
m AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY page_id, name, level ORDER BY i), length(t)) AS z FROM l),
elements AS (SELECT page_id, name, s, e, z, tag, t[e + 1:z] AS inside FROM m WHERE NOT closing)"""


@query(f"""WITH {_ELEMENTS},
p AS (SELECT page_id, count(*) AS paragraphs, sum(length(inside))::BIGINT AS chars FROM elements x WHERE name = 'p' AND EXISTS (SELECT 1 FROM elements a WHERE a.page_id = x.page_id AND a.name = 'article' AND a.s < x.s AND a.z > x.s) GROUP BY page_id),
a AS (SELECT page_id, arg_min(inside, s) AS first_link, count(*) AS links FROM elements x WHERE name = 'a' AND EXISTS (SELECT 1 FROM elements n JOIN elements i ON n.page_id = i.page_id AND n.name = 'nav' AND i.name = 'li' AND n.s < i.s AND n.z > i.s WHERE n.page_id = x.page_id AND i.s < x.s AND i.z > x.s) GROUP BY page_id),
n AS (SELECT page_id, string_agg(regexp_extract(tag, 'href="([^"]*)"', 1), ' ' ORDER BY s) AS urls FROM elements WHERE name = 'a' AND contains(tag, 'href=') GROUP BY page_id)
SELECT page_id, coalesce(paragraphs, 0) AS paragraphs, coalesce(chars, 0) AS chars, {COLLAPSED.format("regexp_replace(first_link, '<[^>]*>', ' ', 'g')")} AS first_link, coalesce(links, 0) AS links, coalesce(urls, '') AS urls
FROM pages LEFT JOIN p USING (page_id) LEFT JOIN a USING (page_id) LEFT JOIN n USING (page_id)""")
def selected_elements(spark, d):
    """Nested elements by selectors: paragraphs of the article, links of the navigation, targets of all links."""
    paragraphs, links = U.selected(F.col("html"), "article p"), U.selected_text(F.col("html"), "nav li a")
    return table(spark, d, "pages").select("page_id", paragraphs.alias("p"), links.alias("a"), F.array_join(U.selected_attribute(F.col("html"), "a[href]", "href"), " ").alias("urls")).select(
        "page_id", F.size("p").cast("long").alias("paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"), F.get("a", F.lit(0)).alias("first_link"), F.size("a").cast("long").alias("links"), "urls"
    )
