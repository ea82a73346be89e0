"""Places in a total order, over parts."""

import pytest
from pyspark.sql import functions as F

from veilwork.operators import ranks


@pytest.mark.parametrize("part_rows", [500_000, 7])
def test_numbered(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ranks, "PART_ROWS", part_rows)
    rows = [(i, (i * 7919) % 13) for i in range(200)] + [(None, 3), (5, None)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    out = ranks.numbered(df, [F.col("v").desc(), F.col("id").asc()], "place").collect()
    assert sorted(r["place"] for r in out) == list(range(1, len(rows) + 1))
    expected = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or 0))
    assert [(r["id"], r["v"]) for r in sorted(out, key=lambda r: r["place"])] == expected


def test_numbered_ties_and_nothing(spark):
    same = spark.createDataFrame([("a",)] * 50, "v string").repartition(4)
    assert sorted(r["rank"] for r in ranks.numbered(same, [F.col("v")]).collect()) == list(range(1, 51))
    assert ranks.numbered(same.limit(0), [F.col("v")]).collect() == []
