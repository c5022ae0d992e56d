from collections import Counter

import pytest
from karstline.llm import common
from pyspark.sql import functions as F


@pytest.mark.parametrize("parts", [1, 4, 1000])
def test_looked_up_joins_hot_and_cold_keys_alike(spark, monkeypatch, parts):
    monkeypatch.setattr(common, "HOT_PARTS", parts)
    rows = [(1, -2, i) for i in range(50)] + [(i % 7, i, i) for i in range(60)] + [(99, 99, 0)]
    table = [(a, b, f"{a}:{b}", n) for (a, b), n in Counter((a, b) for a, b, _ in rows if a != 99).items()]
    frame = spark.createDataFrame(rows, "a long, b long, x long")
    found = common.looked_up(frame, spark.createDataFrame(table, "a long, b long, name string, times long"), ["a", "b"], len(rows))
    assert sorted(map(tuple, found.select("a", "b", "x", "name").collect())) == sorted((a, b, x, f"{a}:{b}") for a, b, x in rows if a != 99)


def test_names():
    assert common.free_names(["a", "Score", "score_1"], "score", "a", "b") == ["score_2", "a_1", "b"]
    assert common.fresh_name("x") != common.fresh_name("x")


def test_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, 2, 3)], ["a.b", "c`d", "e f"])
    assert tuple(frame.select(*map(common.named, frame.columns)).first()) == (1, 2, 3)
    assert common.numbered(frame).columns == ["c0", "c1", "c2"]


def test_freed_passes_all_batches_on(spark):
    def run(batches):
        yield from batches

    assert spark.range(100).mapInArrow(common.freed(run), "id long").agg(F.sum("id")).first()[0] == 4950
    common.tidy(spark)
