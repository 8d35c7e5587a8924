"""Sources, sinks, jobs, streams and the geometry helpers."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from fluxweave.functions import geometry
from fluxweave.functions.tolerances import PARTIAL_FIXUPS, one_of
from fluxweave.operators import intersect
from fluxweave.sources import files, jobs, meshes, particles
from fluxweave.streaming.fields import remap_stream


def test_formulas(spark):
    m = meshes.box_mesh(spark, [0, 0], [1, 1], [2, 2])
    got = meshes.with_field(m, "v", "if (sqrt(x*x + y*y) < 0.5 && x < 2) x^2; else 1;", 2).orderBy("id").collect()
    assert [r.v for r in got] == [0.0625, 1.0, 1.0, 1.0]
    assert meshes.translate("a^b + 2^3") == "pow(a, b) + pow(2, 3)"


def test_material_files_round_trip(spark, tmp_path):
    cells = meshes.box_mesh(spark, [0, 0], [1, 1], [2, 1])
    data = files.format_materials(2, [[(7, 1.0, [0, 0])], [(7, 0.25, [0.6, 0.5]), (9, 0.75, [0.8, 0.5])]])
    assert struct.unpack_from("<2i", data) == (2, 2)
    (tmp_path / "m.bin").write_bytes(data)
    got = files.read_materials(spark, str(tmp_path / "m.bin"), cells).orderBy("id", "mat").collect()
    assert [tuple(r) for r in got] == [(0, 7, 1.0, 0.25, 0.5), (1, 7, 0.25, 0.6, 0.5), (1, 9, 0.75, 0.8, 0.5)]


def test_meshes_fields_and_swarms_round_trip(spark, tmp_path):
    m = meshes.box_mesh(spark, [0, 0], [1, 1], [3, 3]).withColumn("v", F.col("cx") / 3)
    files.write_mesh(m, meshes.box_adjacency(m, [3, 3]), str(tmp_path / "mesh"))
    cells, near = files.read_mesh(spark, str(tmp_path / "mesh"))
    assert (cells.count(), near.count()) == (9, 40)
    files.write_field(m, "v", str(tmp_path / "field"))
    back = files.read_field(spark, str(tmp_path / "field"), "w").join(m, "id")
    assert back.where("v <> w").count() == 0
    assert back.count() == 9
    particles.write_csv(m.select(F.col("cx").alias("x"), F.col("cy").alias("y"), "v"), str(tmp_path / "swarm"))
    assert particles.read_csv(spark, str(tmp_path / "swarm"), 2, ["v"]).agg(F.sum("v")).first()[0] == pytest.approx(1.5)
    assert files.as_wkt(meshes.box_rings(m)).first().wkt.startswith("POLYGON ((0.0")


def test_swarm_generators(spark):
    r = particles.radial(spark, [0, 0], (1.0, 2.0), (0.0, math.pi / 2), (3, 4))
    assert r.count() == 12
    assert r.agg(F.min(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)), F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).first()[:] == pytest.approx((1, 2))
    p = particles.random(spark, [0, 0, 0], [1, 2, 3], 50)
    assert p.where("x between 0 and 1 and y between 0 and 2 and z between 0 and 3").count() == 50


def test_jobs_run_part_by_part(spark):
    spec = {
        "mesh": {"dimension": 2, "source": "s", "target": "t"},
        "remap": {"order": 1, "limiter": False, "fixup": {"partial": "shifted_conservative", "empty": "extrapolate", "max-iter": 5}, "fields": [{"name": "rho", "expr": "if (x < 0.5) 100; else 1;"}, {"name": "t", "expr": "x"}]},
        "parts": [{"field": "rho", "pairs": [{"uid": 1, "source": "x < 0.5", "target": "x < 0.5"}, {"uid": 2, "source": "x > 0.5", "target": "x > 0.5"}]}],
    }
    job = jobs.parse(json.dumps(spec))
    assert job.options.partial == "globally_conservative"

    def load(name):
        n = {"s": 6, "t": 4}[name]
        m = meshes.box_mesh(spark, [0, 0], [1, 1], [n, n])
        return m, meshes.box_adjacency(m, [n, n])

    got = jobs.run(job, load)
    assert {round(r.rho, 9) for r in got.collect()} == {100.0, 1.0}
    assert got.agg(F.sum("t")).first()[0] / 16 == pytest.approx(0.5)


def test_streaming_remap(spark, tmp_path):
    s, t = meshes.box_mesh(spark, [0], [1], [4]), meshes.box_mesh(spark, [0], [1], [2])
    w = intersect.intersect_boxes(t, s, 1)
    for hour in (1, 2, 5):
        s.select(F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp").alias("ts"), "id", (F.col("id") * hour).cast("double").alias("v")).write.mode("append").parquet(str(tmp_path / "in"))
    updates = spark.readStream.schema("ts timestamp, id long, v double").parquet(str(tmp_path / "in"))
    q = remap_stream(updates, w, ["v"]).writeStream.outputMode("append").format("memory").queryName("remapped").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = sorted((r.ts.hour, r.tgt_id, r.v) for r in spark.table("remapped").collect())
    assert rows == [(1, 0, 0.5), (1, 1, 2.5), (2, 0, 1.0), (2, 1, 5.0)]


def test_box_algebra(spark):
    b = spark.createDataFrame([(0.0, 2.0, 0.0, 1.0, 5.0, 5.0)], "xlo double, xhi double, ylo double, yhi double, x double, y double")
    enter, leave = geometry.ray_interval(None, [F.lit(-1.0), F.lit(0.5)], [F.lit(1.0), F.lit(0.0)])
    r = geometry.bulge(b, 2, 0.0).select(geometry.box_volume(None, 2).alias("v"), geometry.radius(None, 2).alias("r"), geometry.long_axis(None, 2).alias("a"), enter.alias("i"), leave.alias("o")).first()
    assert (r.v, r.r, r.a, r.i, r.o) == (2.0, pytest.approx(5**0.5 / 2), 0, 1.0, 3.0)
    ring = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 0.5D, 'y', 0.5D), named_struct('x', 0D, 'y', 2D))")
    r = b.select(geometry.polygon_moments(ring).alias("m"), geometry.is_convex(ring, 1e-12).alias("c")).first()
    assert r.m.m0 == pytest.approx(1.0)
    assert not r.c


def test_names_are_checked():
    assert one_of("Shifted_Conservative", PARTIAL_FIXUPS) == "globally_conservative"
    with pytest.raises(ValueError):
        one_of("nothing", PARTIAL_FIXUPS)
