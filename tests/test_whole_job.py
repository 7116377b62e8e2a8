"""Queries do the whole job where the driver's small tables would not show a cut."""

import pytest

import __spark_entry__ as engine
from callweave.operators import search


def test_ord_distinct_keeps_long_conversations(spark, tmp_path):
    said = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(25)] + [(1, 12, "bot", "late"), (2, 0, "user", "a"), (2, 0, "assistant", "b")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.roles for r in engine.queries()["ord_distinct"](spark, str(tmp_path)).collect()}
    assert got == {1: "assistant,user,bot", 2: "assistant,user"}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_vec_ann_recall_with_its_own_parameters(spark, sf):
    path = f"/root/testdata/{sf}"
    vectors = spark.read.parquet(f"{path}/embeddings.parquet")
    exact = search.top(search.against(vectors, vectors.filter("vec_id % 100 = 0"), search.cosine), 10, "query_id", tie="vec_id")
    want = {(r.query_id, r.vec_id) for r in exact.collect()}
    found = [(r.query_id, r.vec_id) for r in engine.queries()["vec_ann"](spark, path).collect()]
    assert len(found) == len(set(found)) and len(want & set(found)) >= 0.9 * len(want)
