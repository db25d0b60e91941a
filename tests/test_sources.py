"""Sources and sinks against small files."""

from __future__ import annotations

import json

import pytest

from papyra.sources import feeds, sinks

FEED = """<?xml version="1.0"?><feed><entry><id>http://arxiv.org/abs/2301.00001v1</id><title>A  title
over lines</title><summary>Text.</summary><published>2023-01-02T03:04:05Z</published><updated>2023-01-03T00:00:00Z</updated>
<author><name>Ann Lee</name></author><author><name>Bo Fox</name></author><link href="http://arxiv.org/pdf/2301.00001v1" title="pdf" type="application/pdf"/><category term="cs.AI"/></entry>
<entry><id></id><title>no id</title></entry></feed>"""


def fetch(start: int, size: int):
    return [(f"id{i}", f"title {i}") for i in range(start, start + size)]


def test_feed(spark, tmp_path):
    (tmp_path / "page.xml").write_text(FEED)
    r = feeds.read_feed(spark, str(tmp_path)).collect()
    assert len(r) == 1
    assert (r[0].id, r[0].title, r[0].authors, r[0].categories, r[0].year) == ("2301.00001v1", "A title over lines", ["Ann Lee", "Bo Fox"], ["cs.AI"], 2023)
    assert r[0].pdf_url.endswith("2301.00001v1") and len(r[0].hash) == 32


def test_empty_feed(spark, tmp_path):
    (tmp_path / "page.xml").write_text("<feed></feed>")
    assert feeds.read_feed(spark, str(tmp_path)).count() == 0


def test_search_needs_a_condition(spark):
    papers = spark.createDataFrame([], feeds.PAPER)
    with pytest.raises(ValueError):
        feeds.advanced(papers)
    assert feeds.advanced(papers, title="x", author="y").count() == 0


def test_second_source_in_the_same_schema(spark):
    rows = spark.createDataFrame([("A Title", "Ann Lee and Bo Fox", 2020, None, "V", "u")], "title string, authors string, year int, abstract string, venue string, url string")
    r = feeds.from_scholar(rows).first()
    assert r.id.startswith("scholar_") and len(r.id) == 20 and r.authors == ["Ann Lee", "Bo Fox"] and r.published_date.year == 2020


def test_json_sources(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"p1": {"title": "T", "year": 2020}}))
    assert tuple(feeds.read_map(spark, str(tmp_path / "map.json"), "struct<title: string, year: int>").first()) == ("p1", "T", 2020)
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}]}))
    nodes, edges = feeds.read_graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and tuple(edges.first()) == ("a", "b")


def test_paged_source_reads_every_page(spark):
    spark.dataSource.register(feeds.PagedSource)
    df = spark.read.format("paged").option("total", 25).option("page", 10).option("fetch", "tests.test_sources.fetch").load()
    assert df.count() == 25 and df.rdd.getNumPartitions() == 3


def test_graphml_goes_round(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A & B"), ("b", "<C>")], "id string, title string")
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    sinks.write_graphml(sinks.graphml_lines(nodes, edges, attributes=["title"]), str(tmp_path / "g"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    (tmp_path / "one.graphml").write_text(text)
    n, e = feeds.read_graphml(spark, str(tmp_path / "one.graphml"))
    assert sorted(r.id for r in n.collect()) == ["a", "b"] and tuple(e.first()) == ("a", "b")


def test_batches_for_a_store(spark):
    b = sinks.merge_batches(spark.range(25).coalesce(1), 10).collect()
    assert sorted(len(r["rows"]) for r in b) == [5, 10, 10]


def test_subgraph_keeps_inner_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    n, e = sinks.subgraph(nodes, edges, nodes.where("id <> 'c'"))
    assert n.count() == 2 and [tuple(r) for r in e.collect()] == [("a", "b")]


def test_csv_and_json_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.copy_table(spark, str(_parquet(df, tmp_path / "p")), str(tmp_path / "q"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "q")).count() == 1


def _parquet(df, path):
    df.write.parquet(str(path))
    return path


def test_logs_grow_and_stages_are_exported(spark, tmp_path):
    for i in range(2):
        sinks.append_log(spark.createDataFrame([(f"q{i}", i)], "query string, found int"), f"{tmp_path}/log")
    assert sorted(r.query for r in spark.read.parquet(f"{tmp_path}/log").collect()) == ["q0", "q1"]
    sinks.export_stages(str(tmp_path), chunks=spark.createDataFrame([(1, None)], "id int, text string"))
    assert [r.id for r in spark.read.json(f"{tmp_path}/chunks").collect()] == [1]


def test_feed_entries_split_a_text_once(spark, capsys):
    """The entry's conditions aren't evaluated on expressions that split the text again for each word."""
    from papyra.plans.bibliography import feed_entry

    rows = feed_entry(spark, "/root/testdata/sf0.001")
    capsys.readouterr()
    rows.explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_extract_all") == 1 and plan.count("from_xml") == 1
