"""Queries on vectors, retrieval and policy."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embed as M
from ..operators import guard as G
from ..operators import matching as X
from ..operators import records as R
from ..operators import search as S
from ..sources.scratch import written
from ..streaming import stream as ST
from .registry import query, table

_TOKENS = "unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda x: x <> ''))"
_TF = "SELECT id, term, count(*) AS tf FROM (SELECT {0} AS id, " + _TOKENS + " AS term FROM {1}) GROUP BY ALL"
_DIM = "('0x' || substr(md5(term), 1, 8))::BIGINT % 384"
_VECTOR = "SELECT id, dim, w / CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY id)) = 0 THEN 1 ELSE sqrt(sum(w * w) OVER (PARTITION BY id)) END AS v FROM (SELECT id, " + _DIM + " AS dim, sum(ln(1 + tf)) AS w FROM ({0}) GROUP BY ALL)"
DOCS, QUESTIONS = _TF.format("doc_id", "documents"), _TF.format("item_id", "benchmark")


@query("SELECT id AS doc_id, term, tf FROM (" + DOCS + ")")
def term_frequencies(spark, d):
    return M.term_frequencies(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT id AS doc_id, dim, round(v, 6) AS value FROM (" + _VECTOR.format(DOCS) + ")")
def hashed_vectors(spark, d):
    return M.sparse_vectors(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "dim", F.round("value", 6).alias("value"))


@query("SELECT id AS item_id, sum(dim)::BIGINT AS dims, round(sum(v * (dim + 1)), 4) AS weighted FROM (" + _VECTOR.format(QUESTIONS) + ") GROUP BY 1")
def dense_vectors(spark, d):
    v = M.dense_vectors(table(spark, d, "benchmark"), "item_id", "text")
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    dims = F.aggregate(F.transform("embedding", lambda x, i: F.when(x != 0, i.cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    return v.select("item_id", dims.alias("dims"), F.round(weighted, 4).alias("weighted"))


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _corpus(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang")


_NEAREST = f"""q AS ({_VECTOR.format(QUESTIONS)}), c AS ({_VECTOR.format(DOCS)}),
dist AS (SELECT q.id AS query_id, c.id AS doc_id, round(1 - sum(q.v * c.v), 6) AS distance FROM q JOIN c ON q.dim = c.dim GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM dist) WHERE rank <= 30)"""


def nearest(queries, corpus):
    """The 30 nearest documents of each query that share a dimension with it."""
    return S.nearest_texts(queries, corpus, S.FETCHED, overlapping=True)


@query(f"WITH {_NEAREST} SELECT query_id, doc_id, distance, rank::INTEGER AS rank FROM near")
def nearest_documents(spark, d):
    return nearest(_queries(spark, d), _corpus(spark, d))


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(1 - array_inner_product(q.e, c.e) / (sqrt(array_inner_product(q.e, q.e)) * sqrt(array_inner_product(c.e, c.e))), 6) + 0 AS distance FROM n q, n c)
SELECT query_id, doc_id, distance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM p) WHERE rank <= 5""")
def nearest_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return S.nearest_dense(e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), 5)


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(1 - array_inner_product(q.e, c.e) / (sqrt(array_inner_product(q.e, q.e)) * sqrt(array_inner_product(c.e, c.e))), 6) + 0 AS distance FROM n q, n c WHERE q.vec_id % 20 = 0)
SELECT query_id, doc_id, distance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM p) WHERE rank <= 10""")
def nearest_indexed(spark, d):
    """Every twentieth vector against an index of all."""
    e = table(spark, d, "embeddings")
    corpus = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    pivots = S.pivots_of(corpus)
    index = written(S.vector_index(corpus, pivots, 128), "vector-index")
    return S.nearest_indexed(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), index, pivots)


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, greatest(0, round(list_inner_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6)) AS similarity FROM embeddings")
def vector_products(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(M.norm(v), 6).alias("norm"), F.greatest(F.lit(0.0), F.round(M.dot(v, F.reverse(v)), 6)).alias("similarity"))


@query("""SELECT count(*) AS vectors, array_to_string(list_sort(list(DISTINCT len(embedding))), ',') AS dimensions, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std,
 CASE WHEN avg(n) BETWEEN 0.5 AND 2 AND stddev_pop(n) <= 0.5 THEN 85.0 WHEN avg(n) BETWEEN 0.3 AND 3 AND stddev_pop(n) <= 1 THEN 70.0 ELSE 50.0 END::DOUBLE AS quality
FROM (SELECT embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def vector_statistics(spark, d):
    return M.norm_statistics(table(spark, d, "embeddings"), "embedding")


@query("SELECT label, count(*) AS stored, round(sum(len(embedding)) * 4 / 1048576, 4) AS megabytes, round(avg((len(embedding) = 64)::INTEGER) * 100, 4) AS consistent FROM embeddings WHERE len(embedding) > 0 AND label IS NOT NULL GROUP BY label")
def vector_storage(spark, d):
    good, _ = R.split_by(table(spark, d, "embeddings"), (F.size("embedding") > 0) & F.col("label").isNotNull())
    return good.groupBy("label").agg(F.count("*").alias("stored"), F.round(F.sum(F.size("embedding")) * 4 / 1_048_576, 4).alias("megabytes"), F.round(F.avg((F.size("embedding") == 64).cast("int")) * 100, 4).alias("consistent"))


_QTOK = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\r%.-]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda x: length(x) >= 3))"
_LEX = f"""lq AS (SELECT item_id AS query_id, len({_QTOK}) AS n, unnest({_QTOK}) AS token FROM benchmark), ld AS (SELECT doc_id, unnest({_QTOK}) AS token FROM documents),
lex AS (SELECT query_id, doc_id, round(count(*) / n, 6) AS overlap FROM lq JOIN ld USING (token) GROUP BY query_id, doc_id, n)"""


@query(f"WITH {_LEX} SELECT * FROM lex")
def lexical_overlap(spark, d):
    return S.lexical_overlap(_queries(spark, d), _corpus(spark, d))


@query(f"""WITH {_LEX}, r AS (SELECT *, round(overlap * 0.9 + 0.000000001, 6) AS score FROM lex), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT query_id, doc_id, score, rank::INTEGER AS rank, max(score) OVER (PARTITION BY query_id) >= 0.10 AS enough FROM t WHERE rank <= 6""")
def retrieve_lexical(spark, d):
    index = written(S.token_index(_corpus(spark, d)), "token-index")
    rows = S.lexical_top(_queries(spark, d), index, S.FINAL).withColumn("score", S.hybrid_score(F.lit(None).cast("double"), F.col("overlap"), F.lit(0.0)))
    top = S.top_k(rows, "query_id", S.FINAL, F.desc("score"), F.col("doc_id"))
    best = F.max("score").over(W.partitionBy("query_id"))
    return top.select("query_id", "doc_id", "score", "rank", S.sufficient(best, F.lit(False)).alias("enough"))


def retrieved(queries, corpus):
    """Fetch 30 by vector, keep the requested entity's where there are any, rescore, keep 6.

    Texts stay out of the vector join: candidates carry ids, and the few that are left fetch their texts by an equi-join."""
    near = nearest(queries, corpus)
    wanted = queries.select("query_id", F.col("text").alias("query"), F.concat(F.lit("src"), F.pmod("query_id", F.lit(20)).cast("string")).alias("entity"), F.lit("en").alias("kind"))
    n = queries.count()
    rows = S.fetched(near, corpus.select("doc_id", "text", "source", "lang"), n * S.FETCHED).join(F.broadcast(wanted) if n <= S.BROADCAST_QUERIES else wanted, "query_id")
    q, t = F.array_distinct(T.query_tokens(F.col("query"))), T.query_tokens(F.col("text"))
    overlap = F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6))
    boosted = S.boost(F.col("source") == F.col("entity"), F.col("lang") == F.col("kind"), F.lit("metric"), F.col("query"), F.col("text"), ("the", "and"))
    # Scored where the text is; what goes on to the windows is ids and numbers.
    scored = rows.select("query_id", "doc_id", "source", "distance", F.col("rank").alias("fetched"), (F.col("source") == F.col("entity")).alias("match"), S.hybrid_score(F.col("distance"), overlap, boosted).alias("score"))
    scored = S.keep_matching(scored, "query_id", F.col("match"))
    top = S.top_k(scored, "query_id", S.FINAL, F.desc("score"), F.col("fetched"))
    best = F.max("score").over(W.partitionBy("query_id"))
    return top.withColumn("enough", S.sufficient(best, F.lit(True)))


_RETRIEVED = f"""{_NEAREST}, cand AS (SELECT n.query_id, n.doc_id, n.distance, n.rank AS fetched, b.text AS query, doc.text, doc.lang, doc.source, doc.source = 'src' || (n.query_id % 20) AS hit FROM near n JOIN benchmark b ON b.item_id = n.query_id JOIN documents doc ON doc.doc_id = n.doc_id),
kept AS (SELECT * FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM cand) WHERE hit OR NOT any_hit),
tok AS (SELECT *, {_QTOK.replace('text', 'query')} AS qt, {_QTOK} AS dt FROM kept),
sc AS (SELECT *, round(greatest(0, 1 - distance) * 0.75 + CASE WHEN len(qt) = 0 THEN 0 ELSE round(len(list_intersect(qt, dt)) / len(qt), 6) END * 0.20
  + (CASE WHEN hit THEN 0.10 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.12 ELSE 0 END
  + CASE WHEN (contains(lower(query), 'the') AND contains(lower(text), 'the')) OR (contains(lower(query), 'and') AND contains(lower(text), 'and')) THEN 0.05 ELSE 0 END) + 0.000000001, 6) AS score FROM tok),
ret AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fetched) AS rank FROM sc) WHERE rank <= 6)"""


@query(f"WITH {_RETRIEVED} SELECT query_id, doc_id, distance, score, rank::INTEGER AS rank, max(score) OVER (PARTITION BY query_id) >= 0.35 AS enough FROM ret")
def retrieve(spark, d):
    return retrieved(_queries(spark, d), _corpus(spark, d)).select("query_id", "doc_id", "distance", "score", "rank", "enough")


@query(f"""WITH {_RETRIEVED} SELECT query_id, string_agg('- ' || text, chr(10) ORDER BY rank) AS context, first(query ORDER BY rank) AS question,
 'Context:' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || first(query ORDER BY rank) || chr(10) || chr(10) || 'Answer in at most three sentences.' AS prompt,
 coalesce('https://' || first(source ORDER BY rank) || '.example/', 'https://example.org/') AS url FROM ret GROUP BY 1""")
def prompts(spark, d):
    queries, corpus = _queries(spark, d), _corpus(spark, d)
    few = written(retrieved(queries, corpus).select("query_id", "doc_id", "rank", "source"), "retrieved")
    rows = S.fetched(few, corpus.select("doc_id", "text"), queries.count() * S.FINAL).join(queries.withColumnRenamed("text", "query"), "query_id")
    first = rows.groupBy("query_id").agg(S.context(F.col("rank"), F.col("text")).alias("context"), F.min_by("query", "rank").alias("question"), F.min_by("source", "rank").alias("top"))
    url = S.source_url(F.concat(F.lit("https://"), "top", F.lit(".example/")), F.lit(None).cast("string"), F.lit(None).cast("string"), "https://example.org/")
    return first.select("query_id", "context", "question", S.prompt(F.col("question"), F.col("context")).alias("prompt"), url.alias("url"))


# Policy. The test prose has no finance words: these rules use tokens that occur in it.

RULES = G.Policy(personal=(r"@", r"\d{9}"), advisory=(r" from ", r" pour "), factual=(r" with ", r" der "), performance=(r" that ", r" que "))
HINTS = ((r" for ", "metric"), (r" was ", "primary"), (r" die | los ", "performance"))
_ANY = lambda ps: "regexp_matches(q, '" + "|".join(f"(?:{p})" for p in ps) + "')"
_CATEGORY = f"CASE WHEN {_ANY(RULES.personal)} THEN 'personal_info' WHEN {_ANY(RULES.advisory)} THEN 'advisory' WHEN {_ANY(RULES.performance)} AND NOT {_ANY(RULES.factual)} THEN 'performance' ELSE 'factual' END"


@query(f"""WITH c AS (SELECT conv_id, turn, lower(trim(text)) AS q, trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS n FROM conversations WHERE role = 'user'), p AS (SELECT *, {_CATEGORY} AS category FROM c)
SELECT conv_id, turn, category, CASE category WHEN 'personal_info' THEN 'personal_or_sensitive_information' WHEN 'advisory' THEN 'investment_advice_request' WHEN 'performance' THEN 'performance_or_return_query' END AS reason,
 CASE WHEN regexp_matches(n, ' for ') THEN 'metric' WHEN regexp_matches(n, ' was ') THEN 'primary' WHEN regexp_matches(n, ' die | los ') THEN 'performance' END AS preferred,
 CASE WHEN category <> 'factual' THEN category WHEN regexp_matches(n, ' her | und ') THEN 'out_of_scope' WHEN length(q) < 200 THEN 'insufficient' ELSE 'answer' END AS route, contains(q, 'this') OR contains(q, 'sich') AS advisory FROM p""")
def policy_routes(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").where("role = 'user'").select(
        "conv_id", "turn", G.category(t, RULES).alias("category"), G.reason(G.category(t, RULES)).alias("reason"), G.preferred_type(t, HINTS).alias("preferred"),
        G.route(t, G.out_of_scope(t, (" her ", " und ")), F.length(F.trim(t)) >= 200, RULES).alias("route"), G.is_advisory(t, ("this", "sich")).alias("advisory"),
    )


@query("""WITH a AS (SELECT word AS alias, upper(word) AS entity, p AS priority, p % 2 = 0 AS free FROM (VALUES ('the', 4), ('sur', 3), ('oder', 2), ('von der', 0), ('ü', 5), ('ch', 1)) v(word, p)),
q AS (SELECT conv_id * 1000 + turn AS query_id, trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS q FROM conversations)
SELECT query_id, arg_min(entity, priority) AS entity FROM q JOIN a ON contains(q, alias) AND (free OR contains(q, 'and')) GROUP BY 1""")
def entity_aliases(spark, d):
    names = (("the", 4), ("sur", 3), ("oder", 2), ("von der", 0), ("ü", 5), ("ch", 1))
    aliases = spark.createDataFrame([(w, w.upper(), p, p % 2 == 0) for w, p in names], "alias string, entity string, priority int, free boolean")
    questions = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return G.resolve_entities(questions, aliases, "and")


@query("""WITH r AS (SELECT 'c' || item_id % 7 AS category, regexp_extract(lower(text), '^[a-z]+ [a-z]{2}') AS pattern, item_id AS priority FROM benchmark)
SELECT doc_id, arg_min(category, priority) AS category FROM documents JOIN r ON pattern <> '' AND regexp_matches(lower(text), '(^|[^a-z])' || pattern || '([^a-z]|$)') GROUP BY doc_id""")
def rule_table(spark, d):
    """Rules as rows, one for each benchmark item that starts with two words of letters."""
    start = F.regexp_extract(F.lower("text"), "^[a-z]+ [a-z]{2}", 0)
    rules = table(spark, d, "benchmark").where(start != "").select(F.concat(F.lit("c"), (F.col("item_id") % 7).cast("string")).alias("category"), F.concat(F.lit("(^|[^a-z])"), start, F.lit("([^a-z]|$)")).alias("pattern"), F.col("item_id").alias("priority"))
    return X.first_rule(table(spark, d, "documents").withColumn("low", F.lower("text")), "doc_id", "low", rules)


@query("""WITH m AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, 'https?://\\S+', '', 'g')), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g') AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(trim(t), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1:3], ' ') || chr(10) || chr(10) || 'Source: https://example.org/' || conv_id || chr(10) || 'Last updated: 1998-08-02' AS answer FROM m""")
def finished_answers(spark, d):
    url = F.concat(F.lit("https://example.org/"), F.col("conv_id").cast("string"))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", G.finished_answer(F.col("text"), url, F.to_timestamp(F.lit("1998-08-02"))).alias("answer"))


@query("SELECT conv_id, turn, length(text) BETWEEN 1 AND 500 AS accepted, left(text, 100) AS shown FROM conversations")
def input_limits(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.length("text").between(1, 500).alias("accepted"), F.left("text", F.lit(100)).alias("shown"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) <= 1 AS allowed FROM events""")
def request_limits(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return G.limited(rows, "user_id", "ts", 3600, 1).select("event_id", "allowed")


@query("""WITH RECURSIVE e AS (SELECT user_id AS client, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
w(client, began) AS (SELECT client, min(t) FROM e GROUP BY client UNION ALL SELECT w.client, min(e.t) FROM w JOIN e ON e.client = w.client AND e.t >= w.began + INTERVAL 86400 SECOND GROUP BY w.client, w.began),
i AS (SELECT e.client, e.t, e.n, max(w.began) AS began FROM e JOIN w ON w.client = e.client AND w.began <= e.t GROUP BY ALL)
SELECT client, t AS "at", row_number() OVER (PARTITION BY client, began ORDER BY n) <= 3 AS allowed FROM i""")
def request_limits_anchored(spark, d):
    return ST.limit_batch(table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at")), 86_400, 3)


@query("SELECT user_id, (epoch_us(ts) // 3600000000) * 3600 AS start_s, count(*) AS requests FROM events GROUP BY ALL")
def window_counts(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.counts_per_window(rows, "user_id", "ts", "1 hour").select("user_id", F.unix_timestamp("window_start").alias("start_s"), "requests")

