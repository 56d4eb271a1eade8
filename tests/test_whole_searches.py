"""Neighbour queries ask for every row, and hold one chunk of asked rows at a time."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from faultline.operators import similarity as sim
from faultline.operators.search import nearest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table, key", [("c18_knn_documents", "documents", "doc_id"), ("d30_neighbor_entropy", "documents", "doc_id"), ("c18_knn_embeddings", "embeddings", "vec_id"), ("c20_topk_similar", "embeddings", "vec_id")])
def test_every_row_is_asked(spark, name, table, key):
    found = {r["id"] for r in queries()[name](spark, SF).select("id").distinct().collect()}
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert found <= ids and len(found) > 0.9 * len(ids) and "% 100" not in oracle_sql()[name]


def test_queue_figures_are_of_all_tickets(spark):
    tickets = queries()["d31_queue_ambiguity"](spark, SF).agg(F.sum("tickets")).first()[0]
    assert tickets > 0.9 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_chunks_are_given_back(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(90)], "id long, e array<double>")
    v = sim.dense_vectors(df, "id", "e").select("id", "idx", "val")
    held, given, send = [], [], spark.sparkContext.broadcast

    def counted(value):
        one = send(value)
        held.append(len(held) - len(given))
        destroy = one.destroy
        one.destroy = lambda *a: (given.append(1), destroy(*a))
        return one

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    assert nearest(v, v, 3, at_once=20).count() == 270
    assert len(given) == len(held) > 3 and max(held) == 0
