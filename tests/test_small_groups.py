"""Small groups: ordered whole, their cells counted once for all folds, and Python work spread whatever its bytes."""

import pytest
from pyspark.sql import functions as F

from voxelspark.operators import ranking as R, sampling as P, spatial as S
from voxelspark.operators.columns import spread
from voxelspark.operators.grid import Grid


def test_groups_ordered_whole_give_the_same_choice_in_one_exchange(spark):
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("g"), (5 + F.col("id") % 7 * 40).alias("n"))
    sliced, whole = R.choose(rows, ["g"], "id", F.col("n"), 9), R.choose(rows, ["g"], "id", F.col("n"), 9, largest=700)
    assert whole.columns == sliced.columns and sorted(map(tuple, whole.collect())) == sorted(map(tuple, sliced.collect()))
    assert whole.count() == sum(5 + 40 * g for g in range(1, 7))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(whole).count("Exchange") < plan(sliced).count("Exchange")
    above = R.choose(rows, ["g"], "id", F.col("n"), 9, largest=R.SORTED_ROWS + 1)
    assert plan(above).count("Join") > 0 == plan(whole).count("Join")


@pytest.fixture(scope="module")
def pools(spark):
    cells = [(p, i, i // 100, i // 10 % 10, i % 10) for p in (1, 2, None) for i in range(1000)]
    rows = spark.createDataFrame(cells, "patient int, flat_idx long, x int, y int, z int")
    return rows.withColumn("target", ((F.hash("flat_idx") % 5 == 0) & ((F.col("patient") == 1) | (F.col("x") < 2))).cast("int"))


def test_cells_counted_once_serve_all_folds(spark, pools):
    folds, by, spacing = P.with_folds(pools, 3), ["patient", "fold"], (2.0, 2.0, 2.0)
    plain = P.grid_ladder(folds, by, spacing, 6.0, 2.0, F.col("fold_seed"))
    once = P.grid_ladder(folds, by, spacing, 6.0, 2.0, F.col("fold_seed"), copies="fold")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, plain.collect())) and once.count() >= 3
    assert once.columns == plain.columns
    alone = folds.where("patient = 1").drop("patient")
    a, b = (sorted(map(tuple, P.grid_ladder(alone, ["fold"], spacing, 6.0, 2.0, F.col("fold_seed"), copies=c).collect())) for c in (None, "fold"))
    assert a == b and len(a) == 3
    split = [P.adaptive_split(folds.where("patient > 0"), by, Grid(10, 10, 10), spacing, 6.0, 2.0, F.col("fold_seed"), n_per_class=30, copies=c) for c in (None, "fold")]
    a, b = (sorted(map(tuple, s.select(*by, "flat_idx", "role", "target", "mode").where("role IS NOT NULL").collect())) for s in split)
    assert a == b and len(a) > 100


def test_small_groups_of_python_work_are_not_merged_into_one_task(spark, pools):
    """Adaptive execution made one task of them, by their bytes."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda d: d.select(F.spark_partition_id().alias("t")).distinct().count()
    many = spark.range(64).select(F.col("id").cast("int").alias("patient"), *[F.lit(v).alias(a) for v, a in zip((1, 2, 3), "xyz")])
    assert tasks(spread(many, "patient")) > wanted // 2
    assert tasks(S.connected_components(many, ["patient"], Grid(5, 5, 5))) > wanted // 2
    far = S.euclidean_distance(many, many.withColumn("x", F.lit(3)), ["patient"], (2.0, 1.0, 1.0))
    assert tasks(far) > wanted // 2 and {r["dist"] for r in far.collect()} == {4.0}
