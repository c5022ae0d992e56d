import pytest
from karstline import operators as ops
from karstline.errors import InvalidInput
from karstline.plans.expr import Add, Column, int32
from karstline.plans.types import Schema
from karstline.sources import from_rows, write_parquet
from karstline.streaming import read_stream, start


def test_filter_and_projection_over_a_stream(spark, tmp_path):
    schema = Schema.of(("a", "int32"), ("b", "int32"))
    write_parquet(from_rows(spark, schema, [(1, 10), (None, 20), (3, None)]), str(tmp_path / "in"))
    t = ops.filter_not_null(read_stream(spark, str(tmp_path / "in"), schema), 0)
    out = ops.project(t, [("s", Add(Column(0), int32(1))), ("b", Column(1))])
    for more in range(2):
        query = start(out, str(tmp_path / "out"), str(tmp_path / "state"))
        query.processAllAvailable()
        query.stop()
        assert sorted((r.s, r.b or 0) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(2, 10), (4, 0)] + [(8, 70)] * more
        if not more:
            write_parquet(from_rows(spark, schema, [(7, 70)]), str(tmp_path / "in"), "append")
    with pytest.raises(InvalidInput):
        start(from_rows(spark, schema), "x", "y")
