"""The corpus pipeline, stage by stage, over a small corpus with planted cases."""

import numpy as np
import pytest

import corpus_pipeline as cp

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_act(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10_000_001, "12345 67890 !!!", None, "src0", 15), (10_000_002, None, "en", None, 0)], docs.schema)
    copy = docs.where("doc_id = 1").selectExpr("doc_id + 20000000 AS doc_id", "text", "lang", "source", "n_chars")
    names = ["size", "lang_pred", "toxic_score", "_id", "taken"]
    d, ids = docs.union(odd).union(copy).selectExpr("*", *[f"cast(doc_id as string) AS `{n}`" for n in names]), []
    columns = d.columns
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, d, DATA)
        assert out.columns == columns and not out.where("not (size <=> cast(doc_id as string)) or not (lang_pred <=> size) or not (taken <=> size)").count(), name
        path = str(tmp_path / name)
        out.write.parquet(path)
        d = spark.read.parquet(path)
        ids.append({r.doc_id for r in d.select("doc_id").distinct().collect()})
    assert not ids[0] & {10_000_001, 10_000_002} and 20_000_001 in ids[0]
    assert 20_000_001 not in ids[2] and 1 in ids[2]
    assert ids[3] <= ids[2] <= ids[1] <= ids[0]
    pieces = cp.STAGES[-1][1](spark, d, DATA).toPandas()
    assert set(pieces.doc_id) == ids[3]
    sizes = pieces.groupby("sequence_id").length.sum()
    assert (np.bitwise_and(sizes, sizes - 1) == 0).all() and sizes.max() <= 2048


def test_run(spark):
    assert cp.run(spark, DATA).count() > 0


@pytest.mark.parametrize("k", range(5))
def test_stage_names(k):
    assert len(cp.STAGES) == 5 and callable(cp.STAGES[k][1])
