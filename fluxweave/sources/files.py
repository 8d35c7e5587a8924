"""File sources and sinks: stored meshes, material files, field text, polygons as WKT.

Binary mesh formats that need a mesh library are out of scope: convert them once to the Parquet tables ``cells`` and
``adjacency`` that ``write_mesh`` lays down.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_mesh(cells: DataFrame, adjacency: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    adjacency.write.mode("overwrite").parquet(f"{path}/adjacency")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/adjacency")


def parse_materials(data: bytes) -> Iterator[tuple[int, int, float, list[float] | None]]:
    """(cell, material, fraction, centroid) of the little-endian layout: dim, cells; counts and ids; fractions; centroids.

    Pure cells store neither fraction nor centroid (their centroid is the cell's: None).
    """
    at = 0

    def take(kind: str, n: int) -> tuple:
        nonlocal at
        got = struct.unpack_from(f"<{n}{kind}", data, at)
        at += struct.calcsize(f"<{n}{kind}")
        return got

    dim, cells = take("i", 2)
    mats = [list(take("i", take("i", 1)[0])) for _ in range(cells)]
    fractions = [list(take("d", len(m))) if len(m) != 1 else [1.0] for m in mats]
    middles = [[list(take("d", dim)) for _ in m] if len(m) != 1 else [None] for m in mats]
    for c in range(cells):
        yield from ((c, m, f, x) for m, f, x in zip(mats[c], fractions[c], middles[c], strict=True))


def format_materials(dim: int, cells: list[list[tuple[int, float, list[float]]]]) -> bytes:
    out = [struct.pack("<2i", dim, len(cells))]
    out += [struct.pack(f"<{len(c) + 1}i", len(c), *(m for m, _, _ in c)) for c in cells]
    out += [struct.pack(f"<{len(c)}d", *(f for _, f, _ in c)) for c in cells if len(c) != 1]
    out += [struct.pack(f"<{dim}d", *x) for c in cells if len(c) != 1 for _, _, x in c]
    return b"".join(out)


def read_materials(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """(id, mat, volfrac, cx, cy[, cz]) from material files (one task a file), centroids of pure cells from the mesh."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = list(parse_materials(data))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], ["id", "mat", "volfrac", "c"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "id long, mat int, volfrac double, c array<double>")
    names = [c for c in ("cx", "cy", "cz") if c in cells.columns]
    met = raw.join(cells.select("id", *[F.col(c).alias("_" + c) for c in names]), "id")
    return met.select("id", "mat", "volfrac", *[F.coalesce(F.get("c", F.lit(k)), F.col("_" + c)).alias(c) for k, c in enumerate(names)])


def write_field(values: DataFrame, field: str, path: str, material: str | None = None) -> None:
    """``id value`` (or ``id mat value``) lines in id order, 17 digits."""
    keys = ["id", *([material] if material else [])]
    line = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys], F.format_string("%.17g", F.col(field)))
    values.orderBy(*keys).select(line.alias("value")).write.mode("overwrite").text(path)


def read_field(spark: SparkSession, path: str, field: str = "value", material: bool = False) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    cols = [F.get(part, F.lit(0)).cast("long").alias("id")]
    if material:
        cols.append(F.get(part, F.lit(1)).cast("int").alias("mat"))
    return spark.read.text(path).where(F.trim("value") != "").select(*cols, F.get(part, F.lit(2 if material else 1)).cast("double").alias(field))


def as_wkt(cells: DataFrame) -> DataFrame:
    """Polygons as WKT for viewers."""
    point = lambda p: F.concat_ws(" ", F.format_string("%.17g", p["x"]), F.format_string("%.17g", p["y"]))
    ring = F.concat("ring", F.slice("ring", 1, 1))
    return cells.withColumn("wkt", F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, point), ", "), F.lit("))")))
