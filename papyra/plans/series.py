"""Time series of snapshots, graphs, exports and the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import tables
from papyra.functions import text as T
from papyra.operators import graph as G
from papyra.operators import windows as W
from papyra.plans.registry import query, r
from papyra.sources import sinks as K
from papyra.streaming import operators as S

AS_OF = "2024-01-31 00:00:00"

RATES = f"""{tables.SNAPSHOTS_SQL}, lagged AS (SELECT *, lag(ts) OVER w AS pts, lag(citation_count) OVER w AS pc, row_number() OVER w AS i FROM snaps WINDOW w AS (PARTITION BY paper_id ORDER BY ts)),
days AS (SELECT *, CAST(coalesce(floor(epoch(ts - pts) / 86400), 0) AS BIGINT) AS days FROM lagged),
rated AS (SELECT *, CASE WHEN days > 0 THEN citation_count - pc ELSE 0 END AS new_citations, CASE WHEN days > 0 THEN (citation_count - pc) / days ELSE 0.0 END AS rate FROM days),
rates AS (SELECT *, CASE WHEN days > 0 AND i >= 3 THEN (rate - lag(rate) OVER (PARTITION BY paper_id ORDER BY ts)) / days ELSE 0.0 END AS acceleration FROM rated)"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.snapshot_rates(tables.snapshots(spark, sf_dir))


# WN-01, WN-02, JN-22, SM-06
@query(f"WITH {RATES} SELECT paper_id, ts, citation_count, days, new_citations, round(rate, 6) AS rate, round(acceleration, 6) AS acceleration FROM rates")
def snapshot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir).select("paper_id", "ts", "citation_count", "days", "new_citations", r("rate").alias("rate"), r("acceleration").alias("acceleration"))


# WN-03..10, TK-09, SNK-10
@query(f"""WITH {RATES}, s AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ts DESC) AS back, epoch(ts - lag(ts) OVER (PARTITION BY paper_id ORDER BY ts)) / 86400 AS gap,
CASE WHEN rate > 0 THEN rate END AS pos FROM rates WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY), x AS (SELECT *, CASE WHEN pos IS NOT NULL THEN count(pos) OVER (PARTITION BY paper_id ORDER BY ts) - 1 END AS k FROM s),
p AS (SELECT paper_id, count(*) AS points, min_by(citation_count, ts) AS c0, max_by(citation_count, ts) AS c1, epoch(max(ts) - min(ts)) / 86400 AS span, avg(pos) AS mean_rate,
  avg(CASE WHEN back <= 3 AND acceleration <> 0 THEN acceleration END) AS last_acc, regr_slope(pos, k) AS slope, avg(gap) AS gap FROM x GROUP BY paper_id HAVING count(*) >= 2),
q AS (SELECT *, c1 - c0 AS growth, CASE WHEN c0 > 0 THEN (c1 - c0) / c0 * 100 ELSE 0.0 END AS growth_rate, coalesce(mean_rate, CASE WHEN span > 0 THEN (c1 - c0) / span END, 0.0) AS velocity,
  CASE WHEN points >= 3 THEN coalesce(last_acc, CASE WHEN isnan(slope) THEN NULL ELSE slope END, 0.0) ELSE 0.0 END AS acceleration FROM p)
SELECT paper_id, points, c1 AS last_count, growth, round(growth_rate, 6) AS growth_rate, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration,
round(greatest(0.3 * least(growth / 10, 10) + 0.25 * least(growth_rate / 50, 5) + 0.25 * least(velocity * 10, 5) + 0.2 * least(acceleration * 100, 3) + least(ln(c1 + 1) / 5, 2), 0), 5) AS score,
CASE WHEN acceleration > 0.5 THEN 'burst' WHEN growth_rate > 20 AND velocity > 0.1 THEN 'rising' WHEN growth_rate < -10 OR velocity < -0.05 THEN 'declining' WHEN abs(growth_rate) < 5 AND abs(velocity) < 0.02 THEN 'stable' ELSE 'fluctuating' END AS trend,
round(CAST(least(0.5 + CASE WHEN points >= 5 THEN 0.2 WHEN points >= 3 THEN 0.1 ELSE 0 END + CASE WHEN gap <= 7 THEN 0.2 WHEN gap <= 30 THEN 0.1 ELSE 0 END, 1.0) AS DOUBLE), 6) AS confidence FROM q WHERE c1 >= 5""")
def trend_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.to_timestamp_ntz(F.lit(AS_OF)) - F.expr("INTERVAL 14 DAY")
    t = W.trends(rates(spark, sf_dir), since, 14)
    return t.select("paper_id", "points", "last_count", "growth", *[r(c).alias(c) for c in ("growth_rate", "velocity", "acceleration")], r("score", 5).alias("score"), "trend", r("confidence").alias("confidence"))


# WN-06
@query(f"""WITH {RATES}, z AS (SELECT paper_id, ts, rate, count(*) OVER w AS points, count(CASE WHEN rate > 0 THEN 1 END) OVER w AS n, avg(CASE WHEN rate > 0 THEN rate END) OVER w AS m, stddev_samp(CASE WHEN rate > 0 THEN rate END) OVER w AS sd
FROM rates WINDOW w AS (PARTITION BY paper_id)) SELECT paper_id, ts, round(rate, 6) AS rate, round((rate - m) / sd, 5) AS z_score, round(least((rate - m) / sd / 3, 5), 5) AS intensity FROM z WHERE points >= 5 AND n >= 3 AND sd > 0 AND (rate - m) / sd > 1.5""")
def burst_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.bursts(rates(spark, sf_dir), 1.5).select("paper_id", "ts", r("rate").alias("rate"), r("z_score", 5).alias("z_score"), r("intensity", 5).alias("intensity"))


# WN-11
@query(f"""WITH {RATES}, p AS (SELECT paper_id, count(*) AS points, max_by(citation_count, ts) AS current, coalesce(avg(CASE WHEN rate > 0 THEN rate END), 0.0) AS rate, coalesce(avg(CASE WHEN acceleration <> 0 THEN acceleration END), 0.0) AS a,
coalesce(stddev_samp(rate), 0.0) AS sd FROM rates GROUP BY paper_id HAVING count(*) >= 3)
SELECT paper_id, current, current + CAST(floor(round(greatest((rate + a * 30 / 2) * 30, 0.0), 6)) AS BIGINT) AS predicted, CASE WHEN points < 10 THEN 'low' ELSE 'medium' END AS confidence, round(sd * 30, 5) AS margin,
CASE WHEN a > 0 THEN 'up' WHEN a < 0 THEN 'down' ELSE 'flat' END AS trend FROM p""")
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.forecast(rates(spark, sf_dir), 30).withColumn("margin", r("margin", 5))


# Tests' demands: distribution and trending items
@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY event_type""")
def citation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.distribution(tables.read(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", *[r(c).alias(c) for c in ("mean", "median", "deviation")])


@query("""SELECT item, after, before, after - before AS gain FROM (SELECT event_type AS item, CAST(count_if(ts >= TIMESTAMP '2024-01-16') AS BIGINT) AS after, CAST(count_if(ts < TIMESTAMP '2024-01-16') AS BIGINT) AS before FROM events GROUP BY 1) ORDER BY gain DESC, item LIMIT 10""")
def trending_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trending_items(tables.read(spark, sf_dir, "events"), F.array("event_type"), "ts", F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00")), 10)


E = tables.PART_EDGES_SQL
N = tables.NATION_EDGES_SQL


# GR-01..04, WN-15, TK-07
@query(f"""WITH {E}, e AS (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM e GROUP BY node""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(tables.part_edges(spark, sf_dir))


# WN-15, GR-18
@query(f"""WITH {E}, e AS (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges), d AS (SELECT node, sum(i) AS in_degree, sum(o) AS out_degree FROM e GROUP BY node),
l AS (SELECT node, 'in_degree' AS metric, CAST(in_degree AS DOUBLE) AS value FROM d UNION ALL SELECT node, 'out_degree', out_degree FROM d) SELECT node, metric, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, node) AS INT) AS rank FROM l""")
def metric_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rank_metrics(G.degrees(tables.part_edges(spark, sf_dir)), "node", ["in_degree", "out_degree"])


# GR-11, AG-28
@query(f"""WITH {E}, e AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT node, count(*) AS d FROM e GROUP BY node)
SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, round(avg(d), 6) AS avg_degree, max(d) AS max_degree, min(d) AS min_degree, round((SELECT count(*) FROM edges) / (count(*) * (count(*) - 1)), 8) AS density FROM d""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_statistics(tables.part_edges(spark, sf_dir)).withColumns({"avg_degree": r("avg_degree"), "density": r("density", 8)})


# GR-08
@query(f"""WITH {E}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node),
t AS (SELECT x.a AS p, x.b AS q, y.b AS s FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), c AS (SELECT node, count(*) AS triangles FROM (SELECT p AS node FROM t UNION ALL SELECT q FROM t UNION ALL SELECT s FROM t) GROUP BY node)
SELECT d.node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN c ON c.node = d.node""")
def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clustering(tables.part_edges(spark, sf_dir)).withColumn("coefficient", r("coefficient"))


def pagerank_sql(iterations: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"]
    for i in range(1, iterations + 1):
        p = f"r{i - 1}"
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM {p} WHERE node NOT IN (SELECT src FROM edges)) / (SELECT count(*) FROM n)) AS rank "
            f"FROM n LEFT JOIN (SELECT dst, sum(rank / o) AS got FROM edges JOIN {p} ON node = src JOIN od USING (src) GROUP BY dst) g ON g.dst = n.node)"
        )
    return f"WITH {E}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), od AS (SELECT src, count(*) AS o FROM edges GROUP BY src), {', '.join(steps)} SELECT node, round(rank, 9) AS rank FROM r{iterations}"


# GR-05
@query(pagerank_sql(10))
def pagerank_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(tables.part_edges(spark, sf_dir), 10).withColumn("rank", r("rank", 9))


# GR-09
@query(f"""WITH RECURSIVE {E}, e AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT (SELECT min(x) FROM e) AS node UNION SELECT e.y FROM r JOIN e ON r.node = e.x)
SELECT node, (SELECT min(x) FROM e) AS component FROM r""")
def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connected(tables.part_edges(spark, sf_dir))


DIST = f"""{N}, r AS (SELECT DISTINCT src AS seed, src AS node, 0 AS hops FROM (SELECT src FROM edges UNION SELECT dst FROM edges) UNION SELECT r.seed, e.dst, r.hops + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.hops < 24),
d AS (SELECT seed, node, min(hops) AS hops FROM r GROUP BY seed, node)"""


# GR-10
@query(f"WITH RECURSIVE {DIST} SELECT a.node, min(a.seed) AS component FROM d a JOIN d b ON a.seed = b.node AND a.node = b.seed GROUP BY a.node")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strong_components(tables.nation_edges(spark, sf_dir))


# GR-07
@query(f"""WITH RECURSIVE {DIST}, n AS (SELECT count(DISTINCT node) AS n FROM d) SELECT node, round(CASE WHEN count(*) FILTER (hops > 0) = 0 THEN 0 ELSE (count(*) FILTER (hops > 0)) ** 2 / sum(hops) / (SELECT n - 1 FROM n) END, 6) AS closeness FROM d GROUP BY node""")
def closeness_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closeness(tables.nation_edges(spark, sf_dir)).withColumn("closeness", r("closeness"))


# GR-06
@query(f"""WITH RECURSIVE {DIST}, p AS (SELECT seed, node, 0 AS hops, CAST(1 AS DOUBLE) AS paths FROM d WHERE hops = 0
  UNION ALL SELECT p.seed, e.dst, any_value(p.hops) + 1, sum(p.paths) FROM p JOIN edges e ON e.src = p.node JOIN d ON d.seed = p.seed AND d.node = e.dst AND d.hops = p.hops + 1 GROUP BY p.seed, e.dst),
b AS (SELECT v.node, sum(sv.paths * vt.paths / st.paths) AS s FROM (SELECT DISTINCT node FROM d) v JOIN p sv ON sv.node = v.node AND sv.seed <> v.node JOIN p vt ON vt.seed = v.node AND vt.node <> v.node JOIN p st ON st.seed = sv.seed AND st.node = vt.node AND st.hops = sv.hops + vt.hops
  WHERE sv.seed <> vt.node GROUP BY v.node), n AS (SELECT count(DISTINCT node) AS n FROM d)
SELECT x.node, round(coalesce(s, 0) / (SELECT (n - 1) * (n - 2) FROM n), 6) AS betweenness FROM (SELECT DISTINCT node FROM d) x LEFT JOIN b ON b.node = x.node""")
def betweenness_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.betweenness(tables.nation_edges(spark, sf_dir)).withColumn("betweenness", r("betweenness"))


# GR-07 at scale: estimates, tested against exact values
@query()
def closeness_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sketched_closeness(tables.part_edges(spark, sf_dir)).withColumn("closeness", r("closeness"))


# GR-06 at scale: estimates, tested against exact values
@query()
def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sampled_betweenness(tables.part_edges(spark, sf_dir), error=0.3, batch=128).withColumn("betweenness", r("betweenness"))


# GR-12, GR-22
@query(f"""WITH RECURSIVE {N}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT 3 AS node, 0 AS h UNION SELECT u.dst, h + 1 FROM r JOIN u ON u.src = r.node WHERE h < 1)
SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)""")
def ego_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ego_network(tables.nation_edges(spark, sf_dir), 3, 1)


@query(f"""WITH RECURSIVE {N}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT 3 AS node, 0 AS h UNION SELECT u.dst, h + 1 FROM r JOIN u ON u.src = r.node WHERE h < 2)
SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)""")
def ego_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ego_network(tables.nation_edges(spark, sf_dir), 3, 2)


# GR-14
@query(f"""WITH {N}, one AS (SELECT src AS seed, dst AS node FROM edges), two AS (SELECT DISTINCT a.src AS seed, b.dst AS node FROM edges a JOIN edges b ON a.dst = b.src)
SELECT seed, node, 1 AS depth FROM one UNION ALL SELECT seed, node, 2 FROM two WHERE seed <> node AND (seed, node) NOT IN (SELECT (seed, node) FROM one)""")
def related_depth12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.nation_edges(spark, sf_dir)
    return G.related(e, G.nodes(e))


# GR-13
@query(f"""WITH RECURSIVE {N}, p AS (SELECT [9] AS path UNION ALL SELECT list_append(path, e.dst) FROM p JOIN edges e ON e.src = path[-1] WHERE len(path) <= 4 AND path[-1] <> 11 AND NOT list_contains(path, e.dst))
SELECT array_to_string(path, '>') AS path FROM p WHERE path[-1] = 11""")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.simple_paths(tables.nation_edges(spark, sf_dir), 9, 11, 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


# GR-15, JN-05
@query(f"""WITH RECURSIVE {N}, c AS (SELECT n AS root, n AS node, 0 AS level FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT root, e.dst, level + 1 FROM c JOIN edges e ON e.src = c.node WHERE level < 2)
SELECT root, node, level, count(*) AS ways FROM c GROUP BY ALL""")
def citation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.nation_edges(spark, sf_dir)
    return G.chain(e, G.nodes(e), 3).groupBy("root", "node", "level").agg(F.count("*").alias("ways"))


# TK-08, GR-17
@query()
def influence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.nation_edges(spark, sf_dir)
    n = G.pagerank(e, 100, tolerance=1e-6).withColumnRenamed("rank", "pagerank").join(G.degrees(e).select("node", "in_degree"), "node").join(G.betweenness(e), "node")
    return G.influence(n, 10).select("node", r("influence").alias("influence"))


# SNK-11, SNK-16, SNK-18: export lines
@query(f"""WITH {N} SELECT 'nodes' AS "group", '{{"data":{{"id":"' || n_nationkey || '","label":"' || n_name || '"}}}}' AS value FROM nation
UNION ALL SELECT 'edges', '{{"data":{{"source":"' || src || '","target":"' || dst || '","label":"trades"}}}}' FROM edges""")
def cytoscape_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    edges = tables.nation_edges(spark, sf_dir).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("trades").alias("relation"))
    return K.cytoscape(nodes, edges)


# SNK-12
@query(f"""WITH {N} SELECT 1 AS part, '<node id="' || n_nationkey || '"><data key="title">' || n_name || '</data></node>' AS value FROM nation UNION ALL SELECT 2, '<edge source="' || src || '" target="' || dst || '"/>' FROM edges""")
def graphml_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    edges = tables.nation_edges(spark, sf_dir).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return K.graphml_lines(nodes, edges, attributes=["title"]).where("part in (1, 2)")


# SNK-15
@query(f"""WITH {N} SELECT src AS ":START_ID", dst AS ":END_ID", 'TRADES' AS ":TYPE", CAST(weight AS DOUBLE) AS "weight:float" FROM edges""")
def neo4j_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.nation_edges(spark, sf_dir)
    return K.neo4j_edges(edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("trades").alias("relation"), F.col("weight").cast("double").alias("weight")))


# SM-01
@query("SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS requests, count(*) <= 1 AS allowed FROM events GROUP BY 1, 2")
def rate_limit_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rate_limit(tables.read(spark, sf_dir, "events"), 1)


# SM-05, SF-39
@query("SELECT event_id, value, CASE WHEN value >= 90 THEN 'critical' ELSE 'warning' END AS level FROM events WHERE value >= 75")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.alerts(tables.read(spark, sf_dir, "events"), 75, 90).select("event_id", "value", "level")


# Extension: sliding windows
@query("""SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE,
time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts)]) AS start FROM events) GROUP BY start, event_type""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding_counts(tables.read(spark, sf_dir, "events")).withColumn("total", r("total", 4))


# Extension: sessions
@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(tables.read(spark, sf_dir, "events")).withColumn("total", r("total", 4))


# GR-19: words of sources' most frequent long terms
@query("""WITH t AS (SELECT source, item, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS item FROM documents) WHERE length(item) > 8 GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, item) AS INT) AS rank FROM t) SELECT source, rank, item, n FROM k WHERE rank <= 10""")
def related_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.operators.aggregates import top_within

    items = tables.read(spark, sf_dir, "documents").select("source", F.explode(F.filter(T.words(F.col("text")), lambda t: F.length(t) > 8)).alias("item")).groupBy("source", "item").agg(F.count("*").alias("n"))
    return top_within(items, ["source"], [F.desc("n"), F.col("item")], 10).select("source", "rank", "item", "n")
