"""Meshes, swarms and fields derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .meshes import box_mesh

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_cells(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """lineitem with the id of its cell in the n x n grid over quantity [1, 50] and discount [0, 0.1]."""
    ix = F.least(F.floor((F.col("l_quantity") - 1) / 49 * n), F.lit(n - 1))
    iy = F.least(F.floor(F.col("l_discount") / 0.1 * n), F.lit(n - 1))
    return table(spark, sf_dir, "lineitem").withColumn("id", (ix + iy * n).cast("long"))


def lineitem_grid(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Unit square of n x n cells with qty (sum of quantities) and price (whole mean price)."""
    sums = lineitem_cells(spark, sf_dir, n).groupBy("id").agg(F.sum("l_quantity").alias("qty"), F.floor(F.avg("l_extendedprice")).cast("double").alias("price"))
    return box_mesh(spark, [0, 0], [1, 1], [n, n]).join(sums, "id", "left").fillna(0.0, subset=["qty", "price"])


def _in_blocks(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    at = lambda c: F.least(F.floor(c * n), F.lit(n - 1))
    cell = at((F.col("l_quantity") - 1) / 49) + at(F.col("l_discount") / 0.1) * n + at(F.col("l_tax") / 0.08) * n * n
    return table(spark, sf_dir, "lineitem").withColumn("id", cell.cast("long"))


def material_blocks(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(id, mat, volfrac) of the same cells: the return flags of each cell's rows as materials."""
    rows = _in_blocks(spark, sf_dir, n).withColumn("mat", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3))
    each, whole = rows.groupBy("id", "mat").agg(F.count("*").alias("k")), rows.groupBy("id").agg(F.count("*").alias("t"))
    return each.join(whole, "id").select("id", "mat", (F.col("k") / F.col("t")).alias("volfrac"))


def lineitem_blocks(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Unit cube of n^3 cells over quantity, discount and tax [0, 0.08], with the whole mean price."""
    sums = _in_blocks(spark, sf_dir, n).groupBy("id").agg(F.floor(F.avg("l_extendedprice")).cast("double").alias("price"))
    return box_mesh(spark, [0, 0, 0], [1, 1, 1], [n, n, n]).join(sums, "id", "left").fillna(0.0, subset=["price"])


def lineitem_polygons(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, DataFrame]:
    """A polygon mesh of the unit square from lineitem: nodes (id, x, y, v) and cells (id, nodes).

    The nodes of the n x n grid move by the count and the summed quantity of their cell's rows, those at the boundary stay;
    ``v`` is the whole mean price there.  Every cell whose count is a multiple of three is two triangles.
    """
    rows = lineitem_cells(spark, sf_dir, n).groupBy("id").agg(F.count("*").alias("k"), F.sum("l_quantity").alias("q"), F.floor(F.avg("l_extendedprice")).cast("double").alias("v"))
    grid = spark.range((n + 1) * (n + 1)).select(F.col("id"), (F.col("id") % (n + 1)).alias("i"), F.floor(F.col("id") / (n + 1)).alias("j"))
    own = grid.withColumn("cell", F.least("i", F.lit(n - 1)) + F.least("j", F.lit(n - 1)) * n).join(rows.withColumnRenamed("id", "cell"), "cell", "left").fillna(0, subset=["k", "q", "v"])
    inner = (F.col("i") > 0) & (F.col("i") < n) & (F.col("j") > 0) & (F.col("j") < n)
    moved = lambda at, by: (F.col(at) + F.when(inner, by).otherwise(0.0)) / n
    nodes = own.select("id", moved("i", (F.col("k") % 7 - 3) / 20).alias("x"), moved("j", (F.floor("q") % 5 - 2) / 20).alias("y"), F.col("v").cast("double").alias("v"))
    low = F.col("cell") % n + F.floor(F.col("cell") / n) * (n + 1)
    square = spark.range(n * n).withColumnRenamed("id", "cell").join(rows.select(F.col("id").alias("cell"), "k"), "cell", "left").fillna(0, subset=["k"]).withColumn("low", low.cast("long"))
    ring = lambda *steps: F.array(*[F.col("low") + s for s in steps])
    parts = F.when(F.col("k") % 3 == 0, F.array(ring(0, 1, n + 2), ring(0, n + 2, n + 1))).otherwise(F.array(ring(0, 1, n + 2, n + 1)))
    return nodes, square.select("cell", F.posexplode(parts).alias("p", "nodes")).select((F.col("cell") * 2 + F.col("p")).alias("id"), "nodes")


def material_cells(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(id, mat, volfrac, price): the return flags of each cell's rows as materials."""
    rows = lineitem_cells(spark, sf_dir, n).withColumn("mat", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3))
    each = rows.groupBy("id", "mat").agg(F.count("*").alias("k"), F.floor(F.avg("l_extendedprice")).cast("double").alias("price"))
    whole = rows.groupBy("id").agg(F.count("*").alias("t"))
    return each.join(whole, "id").select("id", "mat", (F.col("k") / F.col("t")).alias("volfrac"), "price")


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-D cells of a day: id (days since 1970), xlo, xhi in days, n events."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY_US)
    return table(spark, sf_dir, "events").groupBy(day.cast("long").alias("id")).agg(F.count("*").cast("double").alias("n")).withColumns({"xlo": F.col("id").cast("double"), "xhi": F.col("id") + 1.0, "vol": F.lit(1.0)})


def customer_swarm(spark: SparkSession, sf_dir: str, h: float) -> DataFrame:
    """Customers in the unit square by key and balance; v is the whole balance."""
    x, y = (F.col("c_custkey") % 64 + 0.5) / 64, (F.floor(F.col("c_acctbal")) % 128 + 128) % 128 / 128
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), x.alias("x"), y.alias("y"), F.lit(h).alias("hx"), F.lit(h).alias("hy"), F.floor("c_acctbal").cast("double").alias("v"))


def supplier_swarm(spark: SparkSession, sf_dir: str, h: float) -> DataFrame:
    x, y = (F.col("s_suppkey") % 32 + 0.5) / 32, (F.floor(F.col("s_acctbal")) % 64 + 64) % 64 / 64
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), x.alias("x"), y.alias("y"), F.lit(h).alias("hx"), F.lit(h).alias("hy"), F.floor("s_acctbal").cast("double").alias("v"))
