import pytest

from quillgraph.operators.prefix import prefix_sums
from quillgraph.scratch import Table


@pytest.mark.parametrize("parts", [1, 5])
def test_a_group_over_many_partitions(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = Table(spark.range(400).selectExpr("id", "if(id < 300, 'hot', concat('g', id % 7)) g", "id * 7919 % 401 o", "id % 5 v"), "rows").df
        got, _ = prefix_sums(rows, ["g"], ["o"], "v", ["id"])
        before = {r.id: r.before for r in got.collect()}
        sums: dict[str, int] = {}
        for r in sorted(rows.collect(), key=lambda r: (r.g, r.o)):
            assert before[r.id] == sums.get(r.g, 0)
            sums[r.g] = sums.get(r.g, 0) + r.v
        assert len(before) == 400
        assert prefix_sums(rows.where("id < 0"), ["g"], ["o"], "v", ["id"])[0].count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
