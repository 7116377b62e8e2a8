"""The pipeline's stages on the smallest tables, each against what its operator says of the same input."""

import duckdb
import pytest

import corpus_pipeline
from callweave.llm import exact_dedup, jaccard, mixing, registry
from callweave.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return {n: (a, b) for n, a, b in out}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_decisions(spark, outputs):
    columns = table(spark, SF, "documents").columns
    for name, (_, after) in outputs.items():
        assert name == "packing" or after.columns == columns
    before, after = outputs["quality"]
    good = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()}
    assert len(good & set(ids(after))) >= 0.95 * len(good & set(ids(before)))
    before, after = outputs["exact_dedup"]
    assert ids(after) == ids(exact_dedup.exact_duplicates(before).filter("kept"))
    before, after = outputs["jaccard"]
    assert ids(after) == sorted({r.component_id for r in jaccard.near_classes(before).collect()})
    before, after = outputs["mixing"]
    assert ids(after) == ids(mixing.sampled(before).filter("kept").select("row.*"))
    before, after = outputs["packing"]
    rows = after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert sorted(r.doc_id for r in rows) == ids(before) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in rows)


def test_run_gives_the_last_stage(spark, outputs):
    assert corpus_pipeline.run(spark, SF).count() == outputs["packing"][1].count()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    order = [c[0] for c in want.description]
    assert sorted(str(tuple(r[c] for c in order)) for r in got.collect()) == sorted(str(r) for r in want.fetchall())
