"""Filters, joins, aggregates, set operations and upserts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra import tables
from papyra.functions import scores as S
from papyra.functions import text as T
from papyra.operators import aggregates as A
from papyra.operators import filters as P
from papyra.operators import graph as G
from papyra.operators import upserts as U
from papyra.operators import windows as W
from papyra.plans.registry import query, r

AS_OF = "2024-01-31 00:00:00"


# FLT-03, TK-01
@query("""SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'license')
ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5""")
def like_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    hits = P.like_search(docs, "idiot", ["text"]).unionByName(P.like_search(docs, "license", ["text"]).where(~F.contains(F.lower("text"), F.lit("idiot"))))
    return P.page(hits.select("doc_id", "lang", "source", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 20, 5)


# FLT-04
@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'trash') OR contains(lower(text), 'pathetic') OR contains(lower(source), 'trash') OR contains(lower(source), 'pathetic')")
def multi_term_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.any_term(tables.read(spark, sf_dir, "documents"), ["trash", "pathetic"], ["text", "source"]).select("doc_id", "source")


# FLT-05
@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), '3') THEN 'p_name' WHEN contains(lower(p_brand), '3') THEN 'p_brand' WHEN contains(lower(p_type), '3') THEN 'p_type' END AS match_field
FROM part WHERE contains(lower(p_name), '3') OR contains(lower(p_brand), '3') OR contains(lower(p_type), '3')""")
def field_priority_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_matching_field(tables.read(spark, sf_dir, "part"), "3", ["p_name", "p_brand", "p_type"]).select("p_partkey", "match_field")


FULLTEXT = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
h AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'worthless')) AS b, len(w) AS n FROM w)
SELECT doc_id, round((a + b) / (1 + ln(n)), 6) AS rank FROM h WHERE a > 0 {} b > 0"""


# FLT-06
@query(FULLTEXT.format("AND"))
def fulltext_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fulltext(tables.read(spark, sf_dir, "documents"), ["the", "worthless"]).select("doc_id", r("rank").alias("rank"))


# FLT-07, SF-41
@query(FULLTEXT.format("OR"))
def fulltext_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fulltext(tables.read(spark, sf_dir, "documents"), ["the", "worthless"], every=False).select("doc_id", r("rank").alias("rank"))


# FLT-08, FLT-11, FLT-02
@query("SELECT p_partkey, p_brand, p_size FROM part WHERE contains(lower(p_brand), 'brand#1') AND p_size IN (1, 2, 3, 5, 8, 13)")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.metadata_filter(tables.read(spark, sf_dir, "part"), {"p_brand": "Brand#1", "p_size": [1, 2, 3, 5, 8, 13], "unknown": 1}).select("p_partkey", "p_brand", "p_size")


# FLT-10
@query(f"""WITH {tables.PART_EDGES_SQL} SELECT src AS source_id, dst AS target_id, 'cites' AS relation, CAST(1 AS DOUBLE) AS score FROM edges WHERE src = 7 OR dst = 7""")
def relationships_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.part_edges(spark, sf_dir).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit("cites").alias("relation"), F.lit(1.0).alias("score"))
    return P.related(edges, 7, "cites")


# FLT-12, FLT-15
@query("""SELECT conv_id, turn, length(trim(text)) BETWEEN 3 AND 1000 AND NOT (contains(lower(text), 'drop table') OR contains(lower(text), '<script')) AS valid FROM conversations WHERE role = 'user' AND text IS NOT NULL""")
def question_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.read(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    return turns.select("conv_id", "turn", P.valid_question(F.col("text"), ["drop table", "<script"]).alias("valid"))


# FLT-13, AG-01, AG-03
@query(f"""SELECT count(*) AS events, CAST(count_if(ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND ts <= TIMESTAMP '{AS_OF}') AS BIGINT) AS last_day,
CAST(count_if(ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}') AS BIGINT) AS last_week, count(DISTINCT user_id) AS users FROM events""")
def storage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = lambda d: F.count_if(F.col("ts").between(F.to_timestamp_ntz(F.lit(AS_OF)) - F.expr(f"INTERVAL {d} DAY"), F.to_timestamp_ntz(F.lit(AS_OF))))
    return tables.read(spark, sf_dir, "events").agg(F.count("*").alias("events"), since(1).alias("last_day"), since(7).alias("last_week"), F.countDistinct("user_id").alias("users"))


# FLT-14
@query("""SELECT 'dangling_l_orderkey' AS issue, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'dangling_l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'dangling_l_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'range_l_discount', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0.01 AND 0.09""")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: tables.read(spark, sf_dir, n)
    keys = {"l_orderkey": (t("orders"), "o_orderkey"), "l_partkey": (t("part"), "p_partkey"), "l_suppkey": (t("supplier"), "s_suppkey")}
    return P.integrity_issues(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount"), keys, "l_discount", 0.01, 0.09)


# FLT-17
@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus FROM orders WHERE year(o_orderdate) = 1995 AND o_orderstatus = 'F'")
def orders_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderstatus")
    return orders.where("year = 1995 and o_orderstatus = 'F'")


# PRJ-01..06
@query("""SELECT doc_id, lang || '. ' || coalesce(source, '') AS title_line, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short,
CASE WHEN n_chars / 5000 >= 0.7 THEN 'high' WHEN n_chars / 5000 >= 0.4 THEN 'medium' ELSE 'low' END AS band, 'paper_' || doc_id AS ref FROM documents""")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id", F.concat("lang", F.lit(". "), F.coalesce("source", F.lit(""))).alias("title_line"), P.shorten(F.col("text"), 200).alias("short"),
        S.confidence_band(F.col("n_chars") / 5000).alias("band"), T.cite_id(none, none, F.col("doc_id")).alias("ref"),
    )


# PRJ-02, PRJ-03, SF-23
@query("""SELECT o_orderkey, CASE WHEN trim(o_orderstatus) <> '' THEN trim(o_orderstatus) WHEN trim(o_orderpriority) <> '' THEN trim(o_orderpriority) END AS text,
TRY_CAST(substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS INT) AS year FROM orders""")
def text_and_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", P.text_of(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("text"), P.first_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


# FLT-01, SNK-01, JN-14, SNK-07
@query("""WITH d AS (SELECT doc_id, source, md5(text) AS hash, doc_id % 2 AS batch FROM documents),
f AS (SELECT * FROM d WHERE batch = 1 AND hash NOT IN (SELECT hash FROM d WHERE batch = 0))
SELECT min(doc_id) AS doc_id, hash FROM f GROUP BY hash""")
def dedupe_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"), (F.col("doc_id") % 2).alias("batch"))  # two batches of one table
    return U.insert_if_new(docs.where("batch = 1"), docs.where("batch = 0"), ["hash", "doc_id"], [F.col("doc_id")]).select("doc_id", "hash")


# SNK-04, SNK-05, WN-16, ST-09
@query("""WITH o AS (SELECT *, struct_pack(n := CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 1 ELSE 0 END, d := o_orderdate, k := o_orderkey) AS place FROM orders)
SELECT o_custkey, max_by(o_orderkey, place) AS o_orderkey, max_by(o_totalprice, place) AS o_totalprice FROM o GROUP BY o_custkey""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    late = F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00"))  # old orders come in late and replace those that are there
    return U.upsert(orders.where(~late), orders.where(late), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


# SNK-02, JN-21
@query("""WITH u AS (SELECT n_nationkey AS k, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
SELECT n_nationkey, coalesce(r_name, n_name) AS n_name FROM nation LEFT JOIN u ON k = n_nationkey""")
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = tables.read(spark, sf_dir, "nation"), tables.read(spark, sf_dir, "region")
    new = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select("n_nationkey", F.col("r_name").alias("n_name"))
    return U.update_columns(nation.select("n_nationkey", "n_name"), new, "n_nationkey")


# SNK-06, ST-06
@query(f"""WITH {tables.PART_EDGES_SQL}, p AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM edges) SELECT x AS a, y AS b FROM p UNION ALL SELECT y, x FROM p""")
def bidirectional_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.both_ways(tables.part_edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")))


# SNK-08
@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = tables.read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return U.delete_keys(tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, "l_orderkey")


# SNK-09, TK-10
@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' UNION SELECT * FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)""")
def retention_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return U.retain(orders, "o_orderdate", F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), 10, [F.desc("o_orderdate"), F.col("o_orderkey")])


# SRC-21
@query("""WITH b AS (SELECT s_suppkey AS k, 'first' AS s, 0 AS o FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_custkey, 'second', 1 FROM customer)
SELECT k, s FROM b ORDER BY o, k LIMIT 60""")
def fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables.read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"), F.lit("first").alias("s"))
    b = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("second").alias("s"))
    return U.fill_from(a, b, 60, ["k"])


# JN-01, JN-20
@query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(o_orderstatus, 'unknown') AS status FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("o_orderstatus", F.lit("unknown")).alias("status"))


# JN-02, AG-05, AG-24, ST-02
@query(f"""WITH {tables.PART_EDGES_SQL}, ends AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges)
SELECT p_partkey, coalesce(a.n, 0) AS cites, coalesce(b.n, 0) AS cited_by, coalesce(c.n, 0) AS relations, coalesce(d.q, 0) AS lines, round(coalesce(d.m, 0), 6) AS avg_quantity FROM part
LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) a ON a.src = p_partkey LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) b ON b.dst = p_partkey
LEFT JOIN (SELECT node, count(*) AS n FROM ends GROUP BY 1) c ON c.node = p_partkey LEFT JOIN (SELECT l_partkey, count(*) AS q, avg(l_quantity) AS m FROM lineitem GROUP BY 1) d ON d.l_partkey = p_partkey""")
def paper_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.part_edges(spark, sf_dir)
    d = G.degrees(edges)
    lines = tables.read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"), F.avg("l_quantity").alias("m"))
    out = tables.read(spark, sf_dir, "part").select("p_partkey").join(d, F.col("p_partkey") == F.col("node"), "left").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("p_partkey", zero("out_degree").alias("cites"), zero("in_degree").alias("cited_by"), zero("degree").alias("relations"), zero("lines").alias("lines"), r(F.coalesce("m", F.lit(0.0))).alias("avg_quantity"))


# ST-01, SRC-10
@query(f"""WITH {tables.PART_EDGES_SQL} SELECT 'cites' AS relation, 'p' || src AS a, 'p' || dst AS b, CAST(1 AS DOUBLE) AS score FROM edges
UNION ALL SELECT 'supplied_by', 'p' || l_partkey, 's' || l_suppkey, CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY l_partkey, l_suppkey
UNION ALL SELECT 'in_nation', 's' || s_suppkey, 'n' || s_nationkey, CAST(1 AS DOUBLE) FROM supplier""")
def all_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    cites = tables.part_edges(spark, sf_dir).select(F.lit("cites").alias("relation"), tag("p", "src").alias("a"), tag("p", "dst").alias("b"), F.lit(1.0).alias("score"))
    by = tables.read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("score")).select(F.lit("supplied_by").alias("relation"), tag("p", "l_partkey").alias("a"), tag("s", "l_suppkey").alias("b"), "score")
    nation = tables.read(spark, sf_dir, "supplier").select(F.lit("in_nation").alias("relation"), tag("s", "s_suppkey").alias("a"), tag("n", "s_nationkey").alias("b"), F.lit(1.0).alias("score"))
    return U.merge([cites, by, nation])


# JN-03, AG-06: the OR of two equalities is an unpivot and one equi-join
@query(f"""WITH {tables.PART_EDGES_SQL} SELECT p_brand, count(DISTINCT p_partkey) AS papers, count(src) AS relations, round(avg(p_retailprice), 6) AS avg_price
FROM part LEFT JOIN (SELECT src, dst, src AS node FROM edges UNION ALL SELECT src, dst, dst FROM edges) e ON e.node = p_partkey GROUP BY p_brand ORDER BY papers DESC, p_brand LIMIT 10""")
def cluster_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = A.endpoints(tables.part_edges(spark, sf_dir), "src", "dst", "src")
    part = tables.read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    g = part.join(ends, F.col("p_partkey") == F.col("node"), "left").groupBy("p_brand").agg(F.countDistinct("p_partkey").alias("papers"), F.count("src").alias("relations"), r(F.avg("p_retailprice")).alias("avg_price"))
    return g.orderBy(F.desc("papers"), "p_brand").limit(10)


# JN-04
@query(f"""WITH {tables.NATION_EDGES_SQL} SELECT CASE WHEN src = 3 THEN dst ELSE src END AS other, n_name, weight FROM edges JOIN nation ON n_nationkey = CASE WHEN src = 3 THEN dst ELSE src END WHERE src = 3 OR dst = 3""")
def other_endpoint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.nation_edges(spark, sf_dir).where("src = 3 or dst = 3").select(F.when(F.col("src") == 3, F.col("dst")).otherwise(F.col("src")).alias("other"), "weight")
    return e.join(tables.read(spark, sf_dir, "nation"), F.col("other") == F.col("n_nationkey")).select("other", "n_name", "weight")


# JN-06
@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.07 ORDER BY o_totalprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50""")
def join_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.read(spark, sf_dir, "lineitem").where("l_discount > 0.07").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    j = lines.join(tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return j.orderBy(F.desc("o_totalprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(50)


# JN-13
@query(f"""WITH {tables.PART_EDGES_SQL}, k AS (SELECT p_partkey FROM part WHERE p_size <= 25) SELECT src, dst FROM edges WHERE src IN (SELECT * FROM k) AND dst IN (SELECT * FROM k)""")
def admitted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.admitted(tables.part_edges(spark, sf_dir), tables.read(spark, sf_dir, "part").where("p_size <= 25"), "p_partkey")


# JN-15
@query("""WITH s AS (SELECT DISTINCT o_custkey AS c, n_nationkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
t AS (SELECT c_mktsegment || '/' || c_nationkey AS g, s FROM s JOIN customer ON c_custkey = c GROUP BY 1, 2),
n AS (SELECT g, count(*) AS n FROM t GROUP BY 1), m AS (SELECT a.g AS a, b.g AS b, count(*) AS shared FROM t a JOIN t b ON a.s = b.s AND a.g < b.g GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS overlap FROM m JOIN n x ON x.g = a JOIN n y ON y.g = b WHERE shared / (x.n + y.n - shared) > 0.1""")
def author_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: tables.read(spark, sf_dir, n)
    bought = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    groups = bought.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("g"), F.col("s_nationkey").alias("s"))
    return G.shared_pairs(groups, "g", "s", 0.1).withColumn("overlap", r("overlap"))


# AG-01, AG-02, AG-16
@query("""SELECT 'total' AS kind, 'all' AS key, count(*) AS n FROM documents UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counts_by(tables.read(spark, sf_dir, "documents").select("lang", "source"), ["lang", "source"])


# AG-02, AG-10, AG-17
@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value, round(min(value), 6) AS min_value FROM events GROUP BY event_type""")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.read(spark, sf_dir, "events").groupBy("event_type")
    return g.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), r(F.avg("value")).alias("avg_value"), r(F.max("value")).alias("max_value"), r(F.min("value")).alias("min_value"))


# AG-04: rows and columns of every table
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST({WIDTHS[t]} AS INT) AS columns FROM {t}" for t in TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: (d := tables.read(spark, sf_dir, t)).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", F.lit(len(d.columns)).alias("columns"))
    return U.merge([one(t) for t in TABLES])


# AG-08, AG-09
@query("""SELECT count(*) AS vectors, count(DISTINCT label) AS labels, min(len(embedding)) AS dims FROM embeddings""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"), F.countDistinct("label").alias("labels"), F.min(F.size("embedding")).cast("long").alias("dims"))


# AG-09, AG-13
@query("""SELECT count(*) AS orders, min(year(o_orderdate)) AS min_year, max(year(o_orderdate)) AS max_year, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, round(max(o_totalprice), 2) AS most,
max(year(o_orderdate)) - min(year(o_orderdate)) AS span FROM orders""")
def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate").cast("long")
    return tables.read(spark, sf_dir, "orders").agg(
        F.count("*").alias("orders"), F.min(y).alias("min_year"), F.max(y).alias("max_year"), F.countDistinct("o_custkey").alias("customers"),
        r(F.sum("o_totalprice"), 2).alias("total"), r(F.max("o_totalprice"), 2).alias("most"), (F.max(y) - F.min(y)).alias("span"),
    )


# AG-12, WN-17
@query("""WITH o AS (SELECT n_name, o_orderkey, o_totalprice, year(o_orderdate) AS y FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
t AS (SELECT n_name, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM o)
SELECT n_name, count(*) AS papers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, string_agg(DISTINCT CAST(y AS VARCHAR), ',' ORDER BY CAST(y AS VARCHAR)) AS years,
(SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rank) FROM t WHERE t.n_name = o.n_name AND rank <= 5) AS top FROM o GROUP BY n_name""")
def venue_stats_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: tables.read(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "o_orderkey", "o_totalprice", F.year("o_orderdate").cast("string").alias("y"))
    top = A.top_within(o, ["n_name"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).groupBy("n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("top"))
    g = o.groupBy("n_name").agg(F.count("*").alias("papers"), r(F.sum("o_totalprice"), 2).alias("total"), r(F.avg("o_totalprice"), 2).alias("mean"), F.array_join(F.array_sort(F.collect_set("y")), ",").alias("years"))
    return g.join(top, "n_name")


# AG-11
@query(f"""WITH {tables.PART_EDGES_SQL}, d AS (SELECT dst, count(*) AS d FROM edges GROUP BY 1), s AS (SELECT list(d ORDER BY d) AS l FROM d)
SELECT l[len(l) // 2 + 1] AS median, round(list_avg(l), 6) AS mean, list_max(l) AS most FROM s""")
def upper_median_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.part_edges(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("d"))
    return A.upper_median(d, "d").withColumn("mean", r("mean"))


# AG-16, TK-11
@query("""SELECT item, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS item FROM documents) GROUP BY item ORDER BY n DESC, item LIMIT 25""")
def explode_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram_top(tables.read(spark, sf_dir, "documents"), T.words(F.col("text")), 25)


# AG-18
@query(f"""WITH {tables.PART_EDGES_SQL}, e AS (SELECT src AS node, 1 AS cites, 0 AS cited FROM edges UNION ALL SELECT dst, 0, 1 FROM edges),
s AS (SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT e.node, CAST(sum(cites) AS BIGINT) AS cites, CAST(sum(cited) AS BIGINT) AS cited_by, round(CAST(2.0 * sum(cited) + sum(cites) + 0.3 * max(s.n) AS DOUBLE), 6) AS impact FROM e JOIN s ON s.node = e.node GROUP BY e.node""")
def impact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.degrees(tables.part_edges(spark, sf_dir))
    s = tables.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.countDistinct("l_suppkey").alias("n"))
    j = d.join(s, "node")
    return j.select("node", F.col("out_degree").alias("cites"), F.col("in_degree").alias("cited_by"), r(S.impact(F.col("in_degree"), F.col("out_degree"), F.lit(0.0), F.col("n"))).alias("impact"))


# AG-19, AG-20, AG-21
@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_duration, round(max(value), 6) AS max_duration, round(min(value), 6) AS min_duration,
round(avg(CASE WHEN 1000 / nullif(value, 0) > 0 THEN 1000 / nullif(value, 0) END), 6) AS avg_throughput, round(sum(value), 4) AS total_duration FROM events GROUP BY event_type""")
def operation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.operation_metrics(tables.read(spark, sf_dir, "events"), "event_type", F.col("value"), F.try_divide(F.lit(1000.0), F.col("value")))
    return m.select("event_type", "n", *[r(c).alias(c) for c in ("avg_duration", "max_duration", "min_duration", "avg_throughput")], r("total_duration", 4).alias("total_duration"))


# AG-20, WN-19, TK-03: the newest 100 of each user
@query("""WITH w AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events)
SELECT user_id, count(*) AS n, CAST(count_if(value > 50) AS BIGINT) AS high, round(avg(value), 6) AS mean FROM w WHERE n <= 100 GROUP BY user_id""")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = A.top_within(tables.read(spark, sf_dir, "events").select("user_id", "value", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.col("event_id")], 100)
    return top.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), r(F.avg("value")).alias("mean"))


# AG-22
@query("""SELECT event_type, round(count_if(value > 20) / count(*), 6) AS hit_rate, CAST(rank() OVER (ORDER BY count_if(value > 20) / count(*) DESC, event_type) AS INT) AS place FROM events GROUP BY event_type""")
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.read(spark, sf_dir, "events").groupBy("event_type").agg(F.try_divide(F.count_if(F.col("value") > 20), F.count("*")).alias("rate"))
    return g.select("event_type", r("rate").alias("hit_rate"), F.rank().over(Window.orderBy(F.desc("rate"), "event_type")).alias("place"))


# AG-23
@query("""SELECT o_custkey, string_agg(o_orderstatus || ':' || o_orderkey, ',' ORDER BY o_orderstatus, o_orderkey) AS orders FROM orders GROUP BY o_custkey""")
def grouped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.array_sort(F.collect_list(F.struct("o_orderstatus", "o_orderkey")))
    return tables.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(lists, lambda x: F.concat(x["o_orderstatus"], F.lit(":"), x["o_orderkey"].cast("string"))), ",").alias("orders"))


# AG-25, AG-26, AG-30
@query("""SELECT l_orderkey, round(0.4 * avg(l_discount) * 10 + 0.3 * least(count(*) / 3, 1.0) + 0.3 * least(sum(l_quantity) / 500, 1.0), 6) AS rag,
round(least(avg(l_discount) * 10 * least(count(*) / 3, 1.0) * greatest(0.5, 1 - stddev_pop(l_discount)), 1.0), 6) AS qa FROM lineitem GROUP BY l_orderkey""")
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.stddev_pop("l_discount").alias("sd"))
    return g.select("l_orderkey", r(S.rag_confidence(F.col("m") * 10, F.col("n"), F.col("q"))).alias("rag"), r(S.qa_confidence(F.col("m") * 10, F.col("n"), F.col("sd"))).alias("qa"))


# AG-15
@query(f"""WITH {tables.SNAPSHOTS_SQL}, p AS (SELECT paper_id, count(*) AS n FROM snaps GROUP BY 1) SELECT count(*) AS papers, CAST(sum(n) AS BIGINT) AS measurements, round(avg(n), 6) AS mean FROM p""")
def temporal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.snapshots(spark, sf_dir).groupBy("paper_id").agg(F.count("*").alias("n"))
    return p.agg(F.count("*").alias("papers"), F.sum("n").alias("measurements"), r(F.avg("n")).alias("mean"))


# TK-02
@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 100")
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page(tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 100, 100)


# ST-03..05, extensions: set operations of SQL
@query("""SELECT 'both' AS side, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL
SELECT 'left', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), tables.read(spark, sf_dir, "customer")
    ids = c.select(F.col("c_custkey").alias("k"))
    both = o.intersect(c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))).select(F.lit("both").alias("side"), "k")
    return both.unionByName(ids.subtract(o).select(F.lit("left").alias("side"), "k"))


# Extension
@query("""SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
    return g.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "total")


# WN-18, SM-05, SF-39, SF-40
@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events""")
def rolling_mean_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rolling_mean(tables.read(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"), "event_type", ["ts", "event_id"], "value").select("event_id", r("rolling").alias("rolling"))
