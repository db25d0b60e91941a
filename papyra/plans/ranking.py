"""Keyword and vector retrieval, fusion, pairs, text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import tables
from papyra.functions import text as T
from papyra.functions import vocabulary as Y
from papyra.operators import chunking as C
from papyra.operators import citations as X
from papyra.operators import graph as G
from papyra.operators import resolution as Z
from papyra.operators import retrieval as R
from papyra.operators import vectors as V
from papyra.plans.registry import query, r, rows, values

K = 10

ASKED_SQL = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a question."""
    return tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


TOKENS = "list_filter(string_split_regex(lower({}), '[ \\t\\n\\r]+'), lambda t: t <> '')"
BM25_CTES = f"""{ASKED_SQL},
d AS (SELECT doc_id AS id, {TOKENS.format("coalesce(text, '')")} AS t FROM documents), st AS (SELECT count(*) AS docs, avg(len(t)) AS mean_length FROM d),
tf AS (SELECT id, len(t) AS length, unnest(t) AS term FROM d), tfc AS (SELECT id, length, term, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS n, ln((docs - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tfc, st GROUP BY term, docs),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM asked) GROUP BY ALL),
bm AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score FROM tfc JOIN idf USING (term) JOIN q USING (term), st GROUP BY query_id, id)"""
TOP = "SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT) AS rank, id, score FROM {} WHERE score > 0) WHERE rank <= {}"
ROUNDED = "SELECT query_id, rank, id, round(score, 6) AS score FROM {}"


def rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "id", r("score").alias("score"))


# IR-01, TK-04, SRC-09: the flagship
@query(f"WITH {BM25_CTES}, top AS ({TOP.format('bm', K)}) {ROUNDED.format('top')}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.bm25(tables.read(spark, sf_dir, "documents"), asked(spark, sf_dir), K))


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
WORDS = f"list_filter(regexp_extract_all(lower({{}}), '[\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"
PAIRED = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
TFIDF_CTES = f"""dw AS (SELECT doc_id AS id, {WORDS.format("coalesce(text, '')")} AS w FROM documents), dt AS (SELECT id, unnest({PAIRED}) AS term FROM dw),
dtf AS (SELECT id, term, count(*) AS tf FROM dt GROUP BY ALL), voc AS (SELECT term, sum(tf) AS total, count(*) AS df FROM dtf GROUP BY term ORDER BY total DESC, term LIMIT 10000),
widf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM voc), ww AS (SELECT id, term, tf * idf AS w FROM dtf JOIN widf USING (term)),
wl AS (SELECT id, sqrt(sum(w * w)) AS length FROM ww GROUP BY id), qw AS (SELECT query_id, {WORDS.format("query")} AS w FROM asked),
qt AS (SELECT query_id, term, count(*) * any_value(idf) AS q FROM (SELECT query_id, unnest({PAIRED}) AS term FROM qw) JOIN widf USING (term) GROUP BY ALL),
ql AS (SELECT query_id, sqrt(sum(q * q)) AS q_length FROM qt GROUP BY 1),
ti AS (SELECT query_id, id, sum(w * q) / any_value(length) / any_value(q_length) AS score FROM ww JOIN qt USING (term) JOIN wl USING (id) JOIN ql USING (query_id) GROUP BY query_id, id)"""


# IR-02
@query(f"WITH {ASKED_SQL}, {TFIDF_CTES}, top AS ({TOP.format('ti', K)}) {ROUNDED.format('top')}")
def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.tfidf(tables.read(spark, sf_dir, "documents"), asked(spark, sf_dir), K))


# IR-07, JN-19, WN-12
@query(f"""WITH {BM25_CTES}, {TFIDF_CTES}, a AS ({TOP.format('ti', 2 * K)}), b AS ({TOP.format('bm', 2 * K)}),
na AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM a WINDOW w AS (PARTITION BY query_id)),
nb AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM b WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT coalesce(na.query_id, nb.query_id) AS query_id, coalesce(na.id, nb.id) AS id, 0.7 * coalesce(na.s, 0) + 0.3 * coalesce(nb.s, 0) AS score FROM na FULL JOIN nb ON na.query_id = nb.query_id AND na.id = nb.id),
top AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT) AS rank, id, score FROM f) WHERE rank <= {K}) {ROUNDED.format('top')}""")
def hybrid_minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, q = tables.read(spark, sf_dir, "documents"), asked(spark, sf_dir)
    return rounded(R.fuse(R.tfidf(docs, q, 2 * K), R.bm25(docs, q, 2 * K), K))


# IR-08: papers are sources
@query(f"""WITH {BM25_CTES}, {TFIDF_CTES}, a AS ({TOP.format('ti', 2 * K)}), b AS ({TOP.format('bm', 2 * K)}), h AS (SELECT query_id, id, score, 'dense' AS method FROM a UNION ALL SELECT query_id, id, score / 100, 'sparse' FROM b),
g AS (SELECT query_id, source AS id, (0.6 * max(score) + 0.4 * avg(score)) * 1.2 AS score, max(CASE WHEN method = 'dense' THEN score END) AS best_dense, max(CASE WHEN method = 'sparse' THEN score END) AS best_sparse
  FROM h JOIN documents ON doc_id = id GROUP BY query_id, source),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT) AS rank FROM g) SELECT query_id, rank, id, round(score, 6) AS score, round(best_dense, 6) AS best_dense, round(best_sparse, 6) AS best_sparse FROM t WHERE rank <= 5""")
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, q = tables.read(spark, sf_dir, "documents"), asked(spark, sf_dir)
    hits = R.tfidf(docs, q, 2 * K).withColumn("method", F.lit("dense")).unionByName(R.bm25(docs, q, 2 * K).withColumn("method", F.lit("sparse")).withColumn("score", F.col("score") / 100))
    hits = hits.join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("paper_id")), "id")
    out = R.rerank_by_paper(hits, 5, 1.2)
    return out.select("query_id", "rank", "id", *[r(c).alias(c) for c in ("score", "best_dense", "best_sparse")])


# IR-09, IR-10, FLT-11
@query(f"""WITH good AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), {BM25_CTES.replace('FROM documents', 'FROM good')}, top AS ({TOP.format('bm', K)}) {ROUNDED.format('top')}""")
def restricted_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = tables.read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rounded(R.bm25(tables.read(spark, sf_dir, "documents").join(good, "doc_id", "left_semi"), asked(spark, sf_dir), K))


# WN-13, IR-31 as the length, PRJ-06
@query(f"""WITH {BM25_CTES}, top AS ({TOP.format('bm', K)}), u AS (SELECT query_id, rank, id, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM top JOIN documents ON doc_id = id),
o AS (SELECT *, used <= 8000 AS in_context, sum(CASE WHEN used > 8000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS over FROM u)
SELECT query_id, rank, id, CAST(used AS BIGINT) AS used, in_context FROM o WHERE over <= 1""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    ranked = R.bm25(docs, asked(spark, sf_dir), K).join(docs.select(F.col("doc_id").alias("id"), F.length("text").alias("n")), "id")
    return R.context_budget(ranked, F.col("n"), 8000).select("query_id", "rank", "id", "used", "in_context")


VQ = "vec_id % 100 = 0"
VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def vector_sql(score: str, order: str, where: str = "true", k: int = K) -> str:
    return f"""WITH {VEC}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {score} AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND {where} WHERE q.{VQ}),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS INT) AS rank, id, score FROM s) SELECT query_id, rank, id, round(score, 5) AS score FROM t WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = tables.read(spark, sf_dir, "embeddings")
    return v.where(VQ), v


def _scored(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "id", r("score", 5).alias("score"))


# IR-03, IR-11, IR-17, TK-05, JN-18, SF-36
@query(vector_sql("list_cosine_similarity(q.e, c.e)", "DESC"))
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(V.search(*_vectors(spark, sf_dir), K))


# IR-05, SF-37
@query(vector_sql("list_distance(q.e, c.e)", "ASC"))
def dense_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(V.search(*_vectors(spark, sf_dir), K, "l2"))


# IR-05, FLT-08/09, TK-06: the filter goes before the search
@query(vector_sql("list_cosine_similarity(q.e, c.e)", "DESC", "c.label IN (1, 3, 5) AND list_cosine_similarity(q.e, c.e) >= 0.1"))
def vector_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return _scored(V.search(q, v.where(F.col("label").isin(1, 3, 5)), K, least=0.1))


# IR-06
@query(f"""WITH {VEC}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label AS label, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.{VQ}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s), l AS (SELECT k.*, o.label AS own FROM k JOIN v o ON o.vec_id = query_id WHERE n <= 50),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS m FROM l WHERE label <> own),
t AS (SELECT query_id, label, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM g WHERE m = 1) SELECT query_id, rank, label, id, round(score, 5) AS score FROM t WHERE rank <= 5""")
def similar_one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    return V.search_groups(q, v, 5).select("query_id", "rank", "label", "id", r("score", 5).alias("score"))


PAIRS = f"{VEC}, pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3)"


# IR-12, IR-13, JN-16, ST-06
@query(f"WITH {PAIRS} SELECT a, b, round(score, 5) AS score FROM pairs")
def pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similar_pairs(tables.read(spark, sf_dir, "embeddings"), 0.3).select("a", "b", r("score", 5).alias("score"))


# IR-14, GR-09, GR-16
@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT x AS node, x AS far FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.far = e.x),
c AS (SELECT node, min(far) AS component FROM r GROUP BY node) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def topic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.communities(V.similar_links(tables.read(spark, sf_dir, "embeddings"), 0.3).select(F.col("a").alias("src"), F.col("b").alias("dst")))


# GR-21: the five nearest of every vector above a score
@query(f"""WITH {VEC}, s AS (SELECT q.vec_id AS src, c.vec_id AS dst, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM s) SELECT src, dst, round(score, 5) AS weight FROM t WHERE n <= 5 AND score > 0.3""")
def knowledge_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.read(spark, sf_dir, "embeddings")
    return V.search(v, v, 5, least=0.3).where("score > 0.3").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), r("score", 5).alias("weight"))


# IR-15: labels depend on the start, so rows only
@query()
def kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.kmeans(tables.read(spark, sf_dir, "embeddings"), 10)


# IR-04: approximate, rows only
@query()
def lsh_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lsh_pairs(tables.read(spark, sf_dir, "embeddings"), 1.1)


# IR-16 with the hashing stand-in; unit length or zero
@query()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.embed(tables.read(spark, sf_dir, "benchmark"), T.words(F.col("text")), 32).select("item_id", "embedding")


QUESTIONS = [
    (1, "How does a Transformer improve NLP on the data set"), (2, "compare machine learning methods versus a baseline"), (3, "What is the state of the art"), (4, "Give an overview of deep learning model performance"),
    (5, "tell me something"), (6, "method and result with BERT"),
]
QUESTION_ROWS = f"{values('q', QUESTIONS, 'id, query')}, asked_all AS (SELECT CAST(id AS VARCHAR) AS id, query FROM q UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations WHERE role = 'user' AND text IS NOT NULL)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few questions with known terms, and every user turn."""
    turns = tables.read(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    turns = turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("query"))
    return rows(spark, [(str(i), q) for i, q in QUESTIONS], "id string, query string").union(turns)


def _when(test: str, terms: tuple[str, ...]) -> str:
    return f"CASE WHEN {test} THEN {list(terms)!r} ELSE [] END"


DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
PHRASED = "lower(query)"
for _pattern, _form in Y.PHRASES:
    PHRASED = f"regexp_replace({PHRASED}, '{_pattern}', '{_form}', 'gi')"


# IR-18, SF-09, SF-10
@query(f"""WITH {QUESTION_ROWS}, t AS (SELECT id, query, lower(query) AS q, list_filter(string_split_regex(lower(query), '[ \\t\\n\\r]+'), lambda w: w <> '') AS own FROM asked_all),
a AS (SELECT *, flatten([{', '.join(_when(f"contains(q, '{p}')", t) for p, t in Y.DOMAIN_TERMS.items())}]) AS d, flatten([{', '.join(_when(f"list_contains(own, '{w}')", t) for w, t in Y.SYNONYMS.items())}]) AS s FROM t),
u AS (SELECT *, list_filter({DISTINCT.format('d')}, lambda x: NOT contains(q, lower(x)) AND NOT list_has_any(own, string_split(x, ' '))) AS dd, list_filter({DISTINCT.format('s')}, lambda x: NOT list_contains(own, x)) AS ss FROM a),
v AS (SELECT *, list_concat(dd, ss)[1:8] AS added FROM u) SELECT id, array_to_string(list_concat([{PHRASED}], added), ' ') AS rewritten, CAST(len(added) AS INT) AS n_added FROM v""")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rewrite(questions(spark, sf_dir)).select("id", "rewritten", F.size("added").alias("n_added"))


KEYS = f"list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 2 AND t NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}))"


# IR-19
@query(f"""WITH {QUESTION_ROWS}, t AS (SELECT id, query, lower(query) AS q, {KEYS} AS own FROM asked_all),
a AS (SELECT *, flatten([{', '.join([_when(f"contains(q, '{p}')", t) for p, t in Y.CONCEPTS.items()] + [_when(f"list_contains(own, '{w}')", t) for w, t in Y.KEYWORD_SYNONYMS.items()])}]) AS l FROM t)
SELECT id, array_to_string(list_concat([query], list_sort(list_distinct(l))), ' ') AS expanded FROM a""")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expand(questions(spark, sf_dir)).select("id", "expanded")


def _intent_sql() -> str:
    return " ".join(f"WHEN {' OR '.join(f"contains(lower(query), '{t}')" for t in terms)} THEN '{name}'" for name, terms in Y.INTENTS)


# IR-20, SF-12, SF-13
@query(f"""WITH {QUESTION_ROWS} SELECT id, CASE {' '.join(f"WHEN regexp_matches(lower(query), '{p}') THEN '{n}'" for n, p in Y.QUESTION_TYPES)} ELSE 'factual' END AS kind, CASE {_intent_sql()} ELSE 'find' END AS intent FROM asked_all""")
def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", R.classify(F.col("query")).alias("kind"), R.intent(F.col("query")).alias("intent"))


# SF-14, SF-15
@query(f"""WITH {QUESTION_ROWS}, t AS (SELECT id, query, {KEYS} AS k, list_filter(string_split_regex(query, '[ \\t\\n\\r]+'), lambda w: w <> '') AS own FROM asked_all)
SELECT id, array_to_string(k, ' ') AS keywords, array_to_string(flatten(list_transform(own, lambda w: list_concat(CASE WHEN length(w) > 1 AND regexp_matches(w, '^\\p{{L}}') AND upper(w[1]) = w[1] THEN [w] ELSE [] END,
CASE WHEN lower(w) IN ({', '.join(repr(w) for w in T.TECHNICAL)}) THEN [upper(w)] ELSE [] END))), ' ') AS entities FROM t""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    return q.select("id", F.array_join(T.keywords(F.col("query")), " ").alias("keywords"), F.array_join(T.entities(F.col("query")), " ").alias("entities"))


# SF-16, ST-05, JN-12: for each benchmark item the document most like it, by Jaccard of long words
@query("""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) > 3)) AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) > 3)) AS w FROM benchmark),
m AS (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(w) AS t FROM b) JOIN (SELECT doc_id, unnest(w) AS t FROM d) USING (t) GROUP BY ALL),
s AS (SELECT item_id, doc_id, n / (len(b.w) + len(d.w) - n) AS score FROM m JOIN b USING (item_id) JOIN d USING (doc_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS k FROM s) SELECT item_id, doc_id, round(score, 6) AS score FROM t WHERE k = 1""")
def title_jaccard_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: F.array_distinct(F.filter(T.words(c), lambda t: F.length(t) > 3))
    d = tables.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", long(F.col("text")).alias("w"))
    b = tables.read(spark, sf_dir, "benchmark").select("item_id", long(F.col("text")).alias("w"))
    n = b.select("item_id", F.size("w").alias("nb"), F.explode("w").alias("t")).join(d.select("doc_id", F.size("w").alias("nd"), F.explode("w").alias("t")), "t").groupBy("item_id", "doc_id", "nb", "nd").agg(F.count("*").alias("n"))
    s = n.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), (F.col("n") / (F.col("nb") + F.col("nd") - F.col("n"))).alias("score"))
    return R.top(s, 1).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), r("score").alias("score"))


# IR-31
@query("""WITH s AS (SELECT doc_id, list_filter(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x) > 20) AS s FROM documents),
u AS (SELECT doc_id, s, generate_subscripts(s, 1) AS i, unnest(list_transform(s, lambda x: len(string_split_regex(x, '[ \\t\\n\\r]+')))) AS n FROM s),
c AS (SELECT doc_id, s, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM u), k AS (SELECT doc_id, any_value(s) AS s, count_if(used <= 100) AS k, max(CASE WHEN used <= 100 THEN used END) AS words FROM c GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(k, 0) AS INT) AS sentences, CAST(coalesce(words, 0) AS INT) AS words, array_to_string(s.s[1:coalesce(k, 0)], '. ') AS summary FROM s LEFT JOIN k USING (doc_id)""")
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extractive_summary(tables.read(spark, sf_dir, "documents"), 100)


CUES = ("therefore", "because", "the", "und", "que")


# IR-33
@query(f"""WITH s AS (SELECT doc_id, list_filter(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> ''),
lambda x: list_has_any(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+'), {list(CUES)!r})) AS p FROM documents) SELECT doc_id, array_to_string(p[1:5], '|') AS points FROM s WHERE len(p) > 0""")
def cue_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cue_sentences(tables.read(spark, sf_dir, "documents"), CUES, 5).select("doc_id", F.array_join("points", "|").alias("points"))


# IR-21, AG-07, WN-14
@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM documents),
w AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(ceil((len(t) - 20) / 180), 1) AS BIGINT))) AS i FROM t WHERE len(t) > 0), c AS (SELECT doc_id, i, len(t[i * 180 + 1:i * 180 + 200]) AS n, len(t) AS all_n FROM w)
SELECT 'token_based' AS chunk_type, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avg_tokens, CAST(min(n) AS INT) AS min_tokens, CAST(max(n) AS INT) AS max_tokens FROM c WHERE n >= 50 OR all_n < 50""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_statistics(C.token_windows(tables.read(spark, sf_dir, "documents"), 200, 20)).withColumn("avg_tokens", r("avg_tokens"))


# IR-22: a greedy fold, tested against a plain version
@query()
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pack_sentences(tables.read(spark, sf_dir, "documents"), 1000)


# IR-23, SF-28
@query("""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, trim(unnest(x)) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
h AS (SELECT *, regexp_matches(line, '^(\\p{Lu}\\p{Ll}+)( \\p{Lu}\\p{Ll}+)*$') OR regexp_matches(line, '^[\\p{Lu}][\\p{Lu} ]+$') OR regexp_matches(line, '^([0-9]+(?:\\.[0-9]+)*)\\.? +\\p{Lu}') AS pat FROM l WHERE line <> ''),
g AS (SELECT *, pat AND length(line) BETWEEN 3 AND 80 AND NOT regexp_matches(line, '[.,;:!?]$') AS head FROM h), s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM g)
SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(max(CASE WHEN head THEN line END), 'Full Document') AS title, coalesce(string_agg(CASE WHEN NOT head THEN line END, ' ' ORDER BY pos), '') AS content FROM s GROUP BY doc_id, section""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sections(tables.read(spark, sf_dir, "documents"), "doc_id").drop("level")


CITED_SQL = """b AS (SELECT item_id AS i, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
p AS (SELECT i, 'p' || i AS paper_id, array_to_string(w[1:8], ' ') AS title, w[9] || ', a.; ' || w[10] || ', b.' AS authors, CAST(1990 + i % 30 AS INT) AS year,
  CASE WHEN i % 3 = 0 THEN '10.1000/' || i END AS doi, CASE WHEN i % 3 = 1 THEN '2301.' || lpad(CAST(i AS VARCHAR), 5, '0') END AS arxiv_id, w[11] AS venue FROM b),
c AS (SELECT i AS citation_id, CASE i % 5 WHEN 1 THEN substr(title, 2) WHEN 3 THEN regexp_replace(title, '^[a-z0-9]+ ', '') END AS title, CASE WHEN i % 5 IN (0, 4) THEN upper(doi) END AS doi, CASE WHEN i % 5 IN (0, 4) THEN arxiv_id END AS arxiv_id FROM p)"""


def cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Citations and papers made of every benchmark item: a paper, and a citation by identifier, by a title with a slip, by authors and year, or by what is left."""
    b = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    i, word = F.col("i"), lambda k: F.get("w", F.lit(k))
    p = b.select(
        "i", F.concat(F.lit("p"), i.cast("string")).alias("paper_id"), F.array_join(F.slice("w", 1, 8), " ").alias("title"), F.concat(word(8), F.lit(", a.; "), word(9), F.lit(", b.")).alias("authors"),
        (1990 + i % 30).cast("int").alias("year"), F.when(i % 3 == 0, F.concat(F.lit("10.1000/"), i.cast("string"))).alias("doi"),
        F.when(i % 3 == 1, F.concat(F.lit("2301."), F.lpad(i.cast("string"), 5, "0"))).alias("arxiv_id"), word(10).alias("venue"),
    )
    k = i % 5
    c = p.select(
        i.alias("citation_id"), F.when(k == 1, F.substr("title", F.lit(2))).when(k == 3, F.regexp_replace("title", "^[a-z0-9]+ ", "")).alias("title"), F.when(k.isin(2, 3), F.col("authors")).alias("authors"),
        F.when(k == 2, F.col("year")).when(k == 3, F.col("year") + 1).alias("year"), F.when(k.isin(0, 4), F.upper("doi")).alias("doi"), F.when(k.isin(0, 4), F.col("arxiv_id")).alias("arxiv_id"), F.when(k == 3, F.col("venue")).alias("venue"),
    )
    return c, p.drop("i")


# JN-07..11, SF-17..22; single stages have SQL below, the others hand values
@query()
def cascade_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.resolve(*cited(spark, sf_dir)).withColumn("confidence", r("confidence"))


# JN-07
@query(f"""WITH {CITED_SQL}
SELECT citation_id, paper_id, 'doi' AS match_type, 0.95::DOUBLE AS confidence FROM c JOIN p ON lower(c.doi) = lower(p.doi) UNION ALL SELECT citation_id, paper_id, 'arxiv', 0.95::DOUBLE FROM c JOIN p ON lower(c.arxiv_id) = lower(p.arxiv_id)""")
def exact_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.resolve(*cited(spark, sf_dir)).where("match_type in ('doi', 'arxiv')").drop("alternatives")


# JN-08, SF-01, SF-17 in its form of built-ins: every pair of titles in SQL
@query(f"""WITH {CITED_SQL}, ct AS (SELECT citation_id, regexp_replace(trim(title), '^(the|a|an) ', '') AS t FROM c WHERE title IS NOT NULL), pt AS (SELECT paper_id, regexp_replace(title, '^(the|a|an) ', '') AS u FROM p WHERE title IS NOT NULL),
x AS (SELECT citation_id, paper_id, t, u, array_to_string(list_sort(string_split(t, ' ')), ' ') AS st, array_to_string(list_sort(string_split(u, ' ')), ' ') AS su, greatest(length(t), length(u)) AS n FROM ct, pt WHERE length(t) >= 10),
s AS (SELECT *, 0.5 * (1 - levenshtein(t, u) / n) + 0.5 * (1 - levenshtein(st, su) / n) AS s FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY round(0.9 * s, 9) DESC, paper_id) AS k, count(*) OVER (PARTITION BY citation_id) - 1 AS others FROM s WHERE s > 0.8)
SELECT citation_id, paper_id, round(0.9 * s, 6) AS confidence, CAST(others AS INT) AS others FROM k WHERE k = 1""")
def title_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Z.resolve(*cited(spark, sf_dir)).where("match_type = 'title'")
    return found.select("citation_id", "paper_id", r("confidence").alias("confidence"), F.size("alternatives").alias("others"))


# JN-12, JN-23
@query()
def best_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = cited(spark, sf_dir)
    return Z.best_of_all(c, p).withColumn("how", F.lit("best")).unionByName(Z.simple(c, p).withColumn("how", F.lit("simple"))).withColumn("confidence", r("confidence"))


# AG-14
@query()
def resolution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = cited(spark, sf_dir)
    return Z.resolution_statistics(c, Z.resolve(c, p)).withColumn("avg_confidence", r("avg_confidence"))
