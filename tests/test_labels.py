"""Label studies on documents without terms, and the choice of feature columns."""

from faultline.operators import similarity as sim
from faultline.operators.quality import profile_columns, select_base_metrics


def test_documents_without_terms_keep_a_row(spark):
    labels = spark.createDataFrame([(1, "b"), (2, "c"), (3, "b")], "id long, label string")
    scores = spark.createDataFrame([(1, "b", 0.5), (1, "c", 0.9), (3, "c", 0.05)], "id long, label string, similarity double")
    rows = {r["id"]: r for r in sim.label_consistency(scores, labels, "id").collect()}
    assert rows.keys() == {1, 2, 3}
    assert rows[1]["best_label"] == "c" and rows[1]["potentially_inconsistent"] and abs(rows[1]["margin"] - 0.4) < 1e-12
    assert (rows[2]["best_label"], rows[2]["assigned_similarity"], rows[2]["margin"], rows[2]["potentially_inconsistent"]) == ("b", 0.0, 0.0, False)
    assert rows[3]["assigned_similarity"] == 0.0 and not rows[3]["potentially_inconsistent"]
    assert [r["id"] for r in sim.suspicious_labels(sim.label_consistency(scores, labels, "id"), "id").collect()] == [1]


def test_mean_columns_come_first(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", 3, 4.0, 5, 6)], "load_max double, cpu_mean_lag double, name_mean string, MEM_MEAN int, net__mean double, incident_now int, y int")
    assert select_base_metrics(df, 115, ["y"]) == ["cpu_mean_lag", "MEM_MEAN", "net__mean", "load_max"]
    assert select_base_metrics(df, 2, ["y"]) == ["cpu_mean_lag", "MEM_MEAN"]


def test_profile_with_nulls_and_no_rows(spark):
    shape = "a int, b string, c double"
    rows = {r["column_name"]: r for r in profile_columns(spark.createDataFrame([(1, "x", None), (3, None, None), (3, "x", None)], shape)).collect()}
    assert (rows["a"]["unique_values"], rows["a"]["missing"], rows["a"]["q50"], rows["a"]["min"]) == (2, 0, 3.0, 1.0) and abs(rows["a"]["std"] - 4 / 12**0.5) < 1e-12
    assert (rows["b"]["unique_values"], rows["b"]["missing"], rows["b"]["mean"]) == (1, 1, None)
    assert (rows["c"]["unique_values"], rows["c"]["missing"], rows["c"]["std"]) == (0, 3, None)
    assert {r["column_name"] for r in profile_columns(spark.createDataFrame([], shape)).collect()} == {"a", "b", "c"}
