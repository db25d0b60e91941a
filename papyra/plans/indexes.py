"""Queries through stored vector indexes; the index is built for the query and removed after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.indexes import GraphIndex, ListIndex
from papyra.plans.ranking import K, _scored, _vectors, vector_sql
from papyra.plans.registry import query
from papyra.session import fresh_folder, kept

LISTS = 32
TARGET = 0.95


# IR-04, SRC-19: inverted lists, all of them probed, are the exact scan
@query(vector_sql("list_cosine_similarity(q.e, c.e)", "DESC"))
def ivf_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    path = fresh_folder(spark, "ivf")
    index = ListIndex.build(v, path, LISTS)
    return kept(_scored(index.search(q, K, LISTS)), path)


# IR-04: as many lists as find TARGET of a sample's hits; tests measure the recall
@query()
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    path = fresh_folder(spark, "ivf")
    index = ListIndex.build(v, path, LISTS, sample=64 * LISTS)
    probes = index.probes_for(v.orderBy(F.xxhash64(F.lit("probe"), "vec_id")).limit(100), K, TARGET)
    return kept(_scored(index.search(q, K, probes)), path)


# IR-04: neighbour graph; tests measure the recall
@query()
def graph_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _vectors(spark, sf_dir)
    path = fresh_folder(spark, "graph")
    index = GraphIndex.build(v, path, degree=32)
    return kept(_scored(index.search(q, K)), path)
