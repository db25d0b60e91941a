"""Queries over passages of documents: chunks by meaning, summaries in levels, ranked full text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import tables
from papyra.functions import text as T
from papyra.functions.stems import stem_sql
from papyra.operators import chunking as C
from papyra.operators import citations as X
from papyra.operators import summaries as M
from papyra.operators.fulltext import TextIndex
from papyra.plans.ranking import K, rounded, section_split
from papyra.plans.registry import SQL, query
from papyra.session import fresh_folder, kept

WORDS = 40


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sections(tables.read(spark, sf_dir, "documents"), "doc_id")


# IR-21: boundaries by similarity, tested against all cuts
@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.semantic_chunks(sections(spark, sf_dir), "doc_id", 200, 50)


# IR-21: whole sections where they fit, else by similarity, else windows; numbers of chunks and tokens of fitting sections have SQL
@query(f"""WITH s AS ({SQL["section_split"]}), t AS (SELECT doc_id, section, title, len(list_filter(string_split_regex(content, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n FROM s)
SELECT doc_id, section, title, CAST(n AS INT) AS token_count FROM t WHERE n BETWEEN 1 AND 200""")
def hybrid_whole_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.size(F.filter(F.split("content", T.GAP), lambda w: w != ""))
    chunks = C.semantic_chunks(section_split(spark, sf_dir).where(whole <= 200), "doc_id", 200, 50, hybrid=True, overlap=20)
    one = chunks.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.first("title").alias("title"), F.sum("token_count").cast("int").alias("token_count"))
    return one.where("n = 1 and token_count <= 200").select("doc_id", "section", "title", "token_count")


# IR-32: the reduction has as many levels as the number of chunks asks for; tested against a plain version
@query()
def map_reduce_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = C.token_windows(tables.read(spark, sf_dir, "documents"), 200, 20)
    return M.summarize(chunks, words=WORDS, budget=5 * WORDS)


# IR-32: sections by title
@query(f"""WITH s AS ({SQL["section_split"]}), n AS (SELECT doc_id, section, content, lower(title) AS t FROM s)
SELECT doc_id, {", ".join(f"coalesce(min_by(substr(content, 1, 500) || '...', section) FILTER (WHERE {' OR '.join(f"contains(t, '{x}')" for x in terms)}), '') AS {name}" for name, terms in M.PARTS.items())} FROM n GROUP BY doc_id""")
def summary_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.components(section_split(spark, sf_dir))


ASKED = 2
STEMMED = f"""words_ AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)),
st AS (SELECT * FROM ({stem_sql("word")}) WHERE word NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)})),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
tf AS (SELECT doc_id, len_ AS words, stem, count(*) AS tf FROM (SELECT doc_id, len(w) AS len_, unnest(w) AS word FROM dw) JOIN st USING (word) GROUP BY ALL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id AS query_id, stem FROM (SELECT item_id, unnest(list_filter(w, lambda x: length(x) > 3)[1:{ASKED}]) AS word FROM b) JOIN st USING (word)),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
s AS (SELECT query_id, doc_id AS id, sum(tf / (1 + ln(words))) AS score, count(*) AS held FROM q JOIN tf USING (stem) GROUP BY 1, 2),
t AS (SELECT s.query_id, id, score, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 9) DESC, id) AS INT) AS rank FROM s JOIN n ON n.query_id = s.query_id AND held = n)"""


# FLT-06, TK-04: questions are the first words of every benchmark item
@query(f"WITH {STEMMED} SELECT query_id, rank, id, round(score, 6) AS score FROM t WHERE rank <= {K}")
def fulltext_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "fulltext")
    index = TextIndex.build(tables.read(spark, sf_dir, "documents"), path)
    long = F.filter(T.words(F.col("text")), lambda w: F.length(w) > 3)
    asked = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(long, 1, ASKED), " ").alias("query"))
    return kept(rounded(index.search(asked, K)), path)
