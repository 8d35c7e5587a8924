import pytest
from pyspark.sql import functions as F

from fluxweave.operators import intersect, repair
from fluxweave.plans.remap import Options, Remapper
from fluxweave.sources import meshes


@pytest.fixture(scope="module")
def two(spark):
    """Four parts in quadrants whose borders differ, one of them constant, on meshes that overlap in part."""
    s = meshes.box_mesh(spark, [0, 0], [1, 1], [8, 8])
    s = s.withColumn("part", F.when(F.col("ix") < 4, 0).otherwise(1) + F.when(F.col("iy") < 4, 0).otherwise(2))
    s = s.withColumn("f", F.when(F.col("part") == 0, 3.0).otherwise(1 + F.sin(9 * F.col("cx")) + F.col("cy") + F.col("part"))).cache()
    t = meshes.box_mesh(spark, [0.15, 0.05], [1.25, 1.1], [9, 9])
    t = t.withColumn("part", F.when(F.col("ix") < 5, 0).otherwise(1) + F.when(F.col("iy") < 3, 0).otherwise(2)).cache()
    r = Remapper(s, t, 2, part="part", options=Options(order=1, check_mismatch=False))
    return s, t, r.interpolate(["f"]).cache(), r.weights(), meshes.box_adjacency(t, [9, 9]).cache()


@pytest.mark.parametrize("partial", ["constant", "locally_conservative", "globally_conservative"])
@pytest.mark.parametrize("empty", ["leave_empty", "extrapolate"])
def test_one_plan_repairs_like_part_after_part(two, partial, empty):
    s, t, v, w, near = two
    got, errors = repair.repair_parts(v, t, s, w, near, "f", partial=partial, empty=empty)
    pairs = [(v.join(t.where(f"part = {k}").select("id"), "id"), t.where(f"part = {k}"), s.where(f"part = {k}"), w.where(f"part = {k}")) for k in range(4)]
    want = repair.part_repair(pairs, "f", near, partial=partial, empty=empty)
    both = got.join(want.withColumnRenamed("f", "g"), "id", "full")
    assert both.count() == 81 and both.where("f is null or g is null").count() == 0
    assert both.agg(F.max(F.abs(F.col("f") - F.col("g")))).first()[0] < 1e-12
    assert errors.count() == 4
    if partial == "globally_conservative":
        lo, hi = s.agg(F.min("f"), F.max("f")).first()
        assert got.where((F.col("f") < 0.5 * lo) | (F.col("f") > 1.5 * hi)).where("f <> 0").count() == 0


def test_parts_that_match_stay(spark):
    s = meshes.box_mesh(spark, [0, 0], [1, 1], [4, 4]).withColumn("part", F.when(F.col("ix") < 2, 0).otherwise(1)).withColumn("f", F.col("cx"))
    t = meshes.box_mesh(spark, [0, 0], [1, 1], [8, 8]).withColumn("part", F.when(F.col("ix") < 4, 0).otherwise(1))
    t = t.where("not (part = 1 and iy = 7)")  # the second part misses a row of cells
    r = Remapper(s, t, 2, part="part", options=Options(order=1, check_mismatch=False))
    v = r.interpolate(["f"])
    got, errors = repair.repair_parts(v, t, s, r.weights(), meshes.box_adjacency(t, [8, 8]), "f")
    assert {x.part: x.found for x in errors.collect()} == {0: False, 1: True}
    same = got.join(v.withColumnRenamed("f", "g"), "id").join(t.select("id", "part"), "id")
    assert same.where("part = 0 and f <> g").count() == 0 and same.where("part = 1 and f <> g").count() > 0


def test_a_part_without_source(spark):
    s = meshes.box_mesh(spark, [0, 0], [1, 1], [4, 4]).withColumn("part", F.lit(0)).withColumn("f", F.lit(2.0))
    t = meshes.box_mesh(spark, [0, 0], [1, 1], [4, 4]).withColumn("part", F.when(F.col("ix") < 2, 0).otherwise(9))
    w = intersect.intersect_boxes(t, s, 2, equal=("part",))
    got, _ = repair.repair_parts(t.select("id", F.when(F.col("part") == 0, 2.0).otherwise(0.0).alias("f")), t, s, w, meshes.box_adjacency(t, [4, 4]), "f")
    assert got.count() == 16 and got.where("f is null").count() == 0
