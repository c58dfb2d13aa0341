"""Held-out accuracy of the classifiers, and that nothing but the training fold and the text counts."""

import pytest
from pyspark.sql import functions as F

from footfall.llm import quality_gbt, toxic_passages
from footfall.llm.toxic_passages import COST, passages


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


@pytest.mark.parametrize(("module", "label", "least"), [(quality_gbt, "quality", 0.97), (toxic_passages, "toxic", 0.96)])
def test_held_out_accuracy(tables, module, label, least):
    docs, labels = tables
    rows = module.classify(docs, labels).join(labels, "doc_id").where(F.col("held_out") & F.col(label).isNotNull())
    right = rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


@pytest.mark.parametrize(("module", "label", "fold"), [(quality_gbt, "quality", (5, 0)), (toxic_passages, "toxic", (4, 2))])
def test_held_out_labels_and_other_columns_do_not_count(spark, module, label, fold):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold[0])) == fold[1]
    turned = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    bare = docs.withColumn("lang", F.lit(None)).withColumn("source", F.lit("x"))
    a = sorted(map(tuple, module.classify(docs, labels).select("doc_id", "score").collect()))
    b = sorted(map(tuple, module.classify(bare, turned).select("doc_id", "score").collect()))
    assert a == b


def test_passages_are_the_maximal_segments():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(50):
        scores = np.where(rng.random(40) < 0.3, rng.random(40) * 2, -COST)
        found = passages(scores)
        best = max((scores[a:b].sum() for a in range(40) for b in range(a + 1, 41)), default=0)
        assert max(s for _, _, s in found) == pytest.approx(best)
        for a, b, s in found:
            assert s == pytest.approx(scores[a:b].sum())
            assert all(scores[a:k].sum() > 0 for k in range(a + 1, b + 1)) and all(scores[k:b].sum() > 0 for k in range(a, b))
