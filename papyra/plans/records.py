"""Source records, index and export tables, paper views, and streams run to their end."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import tables
from papyra.functions import scores as S
from papyra.functions import text as T
from papyra.operators import aggregates as A
from papyra.operators import citations as X
from papyra.operators import filters as P
from papyra.operators import graph as G
from papyra.operators import retrieval as R
from papyra.operators import upserts as U
from papyra.operators import windows as W
from papyra.plans import series  # noqa: F401  its SQL is used again
from papyra.plans.registry import SQL, query, r, rows, values
from papyra.session import shared_folder
from papyra.sources import feeds, sinks
from papyra.streaming import key_index
from papyra.streaming import operators as M


# SRC-09, SRC-11, SRC-12
@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE props IS NOT NULL")
def json_column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").where("props is not null").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# SRC-13, SRC-14, SF-30: text of a web page, and whether it has too little of it
@query("""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages)
SELECT page_id, length(text) AS n_chars, length(text) / 1000 < 0.1 AS needs_ocr FROM t""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))
    t = tables.read(spark, sf_dir, "pages").select("page_id", c.alias("text"))
    return t.select("page_id", F.length("text").cast("long").alias("n_chars"), feeds.needs_ocr(F.col("text"), F.lit(1)).alias("needs_ocr"))


# SNK-20: the postings and the statistics of an index
@query("""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda t: t <> '')) AS term FROM documents) GROUP BY ALL""")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are dealt by document, so the rows of their terms are counted where they are
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return R.exploded(docs, ["doc_id"], T.split_tokens(F.coalesce("text", F.lit(""))), "term").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


# SNK-11, SNK-19
@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables.read(spark, sf_dir, "nation")
    return sinks.json_rows(nation).select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("n_nationkey"), "value")


# SNK-13, SNK-16
@query(f"WITH {tables.NATION_EDGES_SQL}, t AS (SELECT src AS source, dst AS target, CASE WHEN src < dst THEN 'up' ELSE 'down' END AS relation, weight FROM edges) SELECT * FROM t WHERE relation = 'up'")
def edge_list_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.nation_edges(spark, sf_dir).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.when(F.col("src") < F.col("dst"), "up").otherwise("down").alias("relation"), "weight")
    return sinks.edge_list(e, "up")


# SNK-17, GR-22
@query(f"WITH {tables.NATION_EDGES_SQL}, k AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1) SELECT src AS source, dst AS target FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def subgraph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey")
    edges = tables.nation_edges(spark, sf_dir).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return sinks.subgraph(nodes, edges, nodes.where("n_regionkey = 1"))[1]


# JN-17, SF-16: pairs of benchmark items by Jaccard of their words, met over a shared word
@query("""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark), u AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM w),
m AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.t = b.t AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (na + nb - shared), 6) AS overlap FROM m WHERE shared / (na + nb - shared) > 0.05""")
def text_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("t"))
    return G.shared_pairs(items, "item_id", "t", 0.05).withColumn("overlap", r("overlap"))


# JN-22, WN-16
@query(f"WITH {tables.SNAPSHOTS_SQL} SELECT paper_id, max(ts) AS ts, max_by(citation_count, ts) AS citation_count FROM snaps GROUP BY paper_id")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.latest_per_key(tables.snapshots(spark, sf_dir), ["paper_id"], [F.desc("ts")])


# AG-17
@query(f"WITH {tables.PART_EDGES_SQL}, e AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT count(DISTINCT node) AS connected, count(*) / count(DISTINCT node) AS avg_relations FROM e")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = A.endpoints(tables.part_edges(spark, sf_dir), "src", "dst")
    return ends.agg(F.countDistinct("node").alias("connected"), (F.count("*") / F.countDistinct("node")).alias("avg_relations"))


# AG-27, IR-32: sources are papers, their documents chunks
@query("""WITH w AS (SELECT source, count(*) AS chunks, CAST(sum(len(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'))) AS BIGINT) AS words FROM documents GROUP BY source)
SELECT source, chunks, words, round(least(0.5 * least(chunks / 10, 1.0) + 0.5 * least(100 * 10 / words, 1.0), 1.0), 6) AS confidence FROM w""")
def summary_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), T.GAP))).alias("words"))
    return g.withColumn("confidence", r(S.summary_confidence(F.col("chunks"), F.lit(100), F.col("words"))))


# AG-29: of the second half of the ids, what a load would add and skip
@query("""WITH d AS (SELECT doc_id, md5(text) AS hash, doc_id % 2 AS late FROM documents) SELECT count(*) AS found, CAST(count_if(hash NOT IN (SELECT hash FROM d WHERE late = 0)) AS BIGINT) AS added,
CAST(count_if(hash IN (SELECT hash FROM d WHERE late = 0)) AS BIGINT) AS skipped FROM d WHERE late = 1""")
def ingestion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select(F.md5("text").alias("hash"), (F.col("doc_id") % 2).alias("late"))
    seen = P.exists_by_any_key(d.where("late = 1"), d.where("late = 0"), ["hash"])
    return seen.agg(F.count("*").alias("found"), F.count_if(~F.col("exists")).alias("added"), F.count_if("exists").alias("skipped"))


# SF-40
@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'unhealthy' WHEN n_nationkey < 15 THEN 'degraded' ELSE 'healthy' END AS health FROM nation")
def health_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "nation").select("n_nationkey", S.health_class(F.col("n_nationkey"), 5, 15).alias("health"))


# SF-04, SF-05: the first line as a title and as a name list, the text as a citation
@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[ \\t\\n\\r]+', ' ', 'g')) AS line, regexp_replace(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')), '[^\\p{L}\\p{N}_ \\-.:]', ' ', 'g') AS low FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(line, '^(?:title:|paper:|article:) *', '', 'i'), ' *\\([^)]*\\)$', '') AS title, regexp_replace(line, '[,. ]+$', '') AS authors,
md5(trim(regexp_replace(regexp_replace(regexp_replace(low, '^ *[0-9]+ *', ''), 'doi:? *', 'doi:', 'g'), ' +', ' ', 'g'))) AS citation_md5 FROM d""")
def cleaned_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    return tables.read(spark, sf_dir, "documents").select("doc_id", T.clean_title(line).alias("title"), T.clean_authors(line).alias("authors"), F.md5(T.normalize_citation(F.col("text"))).alias("citation_md5"))


HEAD_WS = "' ' || chr(9) || chr(10) || chr(13)"
AUTHOR_PARTS = "[line]"
for _mark in (",", " and ", " & ", ";"):
    AUTHOR_PARTS = f"flatten(list_transform({AUTHOR_PARTS}, lambda p: list_transform(string_split(p, '{_mark}'), lambda y: trim(y))))"


# IR-24, SF-29, SF-27
@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(trim(coalesce(text, ''), {HEAD_WS}), chr(10))[1:10], lambda x: trim(x, {HEAD_WS})), lambda x: x <> '' AND NOT regexp_matches(lower(x), 'arxiv:|preprint|submitted|conference')) AS l FROM documents),
t AS (SELECT doc_id, l, list_filter(l, lambda x: length(x) BETWEEN 11 AND 199)[1] AS title FROM l),
a AS (SELECT doc_id, title, CASE WHEN title IS NOT NULL THEN list_filter(l[list_position(l, title) + 1:], lambda x: regexp_matches(x, '{X.NAMES}'))[1] END AS line FROM t)
SELECT doc_id, title, CASE WHEN line IS NOT NULL THEN array_to_string(list_filter({AUTHOR_PARTS}, lambda x: length(x) BETWEEN 3 AND 99 AND NOT regexp_matches(lower(x), 'university|department|email|@'))[1:10], ';') END AS authors FROM a""")
def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.head_lines(F.col("text"))
    return tables.read(spark, sf_dir, "documents").select("doc_id", X.page_title(lines).alias("title"), F.array_join(X.page_authors(lines), ";").alias("authors"))


# GR-01, GR-03, PRJ-06
@query(f"WITH {tables.NATION_EDGES_SQL}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, n_name FROM n LEFT JOIN nation ON n_nationkey = node")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_metadata(tables.nation_edges(spark, sf_dir), tables.read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


# GR-18, GR-20, §2.14 get_paper_centrality: one row for each node, zeros where it is absent
@query(f"""WITH {tables.NATION_EDGES_SQL}, e AS (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges), d AS (SELECT node, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o FROM e GROUP BY node)
SELECT n_nationkey AS node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, CAST(row_number() OVER (ORDER BY coalesce(i, 0) DESC, n_nationkey) AS INT) AS rank FROM nation LEFT JOIN d ON node = n_nationkey""")
def node_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    d = nodes.join(G.degrees(tables.nation_edges(spark, sf_dir)), "node", "left").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")])
    return d.join(W.rank_metrics(d, "node", ["in_degree"]).select("node", "rank"), "node")


# IR-33: points unlike each other, tested by hand values
@query()
def distinct_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = R.cue_sentences(tables.read(spark, sf_dir, "documents"), ["the", "und", "que"], 10)
    return points.select("doc_id", F.array_join(R.distinct_points(F.col("points")), "|").alias("points"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


# SM-01 as a stream: as many rows of the day as the batch query gives
@query("SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS requests, count(*) <= 1 AS allowed FROM events GROUP BY 1, 2")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, limits = _folder(spark), M.rate_limit(_events(spark, sf_dir), 1)
    write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/rows")  # noqa: E731  complete mode: a batch holds all
    q = limits.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumn("minute", F.col("minute").cast("timestamp_ntz"))


# SM-07: keys of all events once, over two runs of the whole stream
@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, stream = _folder(spark), _events(spark, sf_dir).select("user_id", "event_type", "event_id")
    for run in ("first", "again"):
        key_index.ingest_by_bucket(stream, f"{out}/table", f"{out}/index", ["user_id", "event_type"], f"{out}/{run}").awaitTermination()
    return spark.read.schema("user_id bigint, event_type string, event_id bigint").parquet(f"{out}/table").select("user_id", "event_type")


# SM-06 as a stream with state for each user: the rows of the batch query
@query(SQL["snapshot_rates"])
def stream_snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark)
    tables.snapshots(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{out}/in")
    stream = spark.readStream.schema("paper_id bigint, ts timestamp, citation_count bigint").parquet(f"{out}/in")
    q = M.snapshot_rates(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "rate": r("rate"), "acceleration": r("acceleration")})


# AG-24: counts that a trigger would keep, as one recomputation
@query(f"WITH {tables.PART_EDGES_SQL} SELECT dst AS paper_id, count(*) AS citation_count, TIMESTAMP '2024-02-01' AS as_of FROM edges GROUP BY dst")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz")
    return tables.part_edges(spark, sf_dir).groupBy(F.col("dst").alias("paper_id")).agg(F.count("*").alias("citation_count")).withColumn("as_of", as_of)
