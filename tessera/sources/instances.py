"""Instance and solution files: JSON in, JSON and SVG out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import ring as P


def read_strips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.STRIP_INSTANCE).option("multiLine", True).json(path)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.BIN_INSTANCE).option("multiLine", True).json(path)


def read_multi_strips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.MULTI_STRIP_INSTANCE).option("multiLine", True).json(path)


def _points(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def outer_ring(shape: Column) -> Column:
    """The outline of a shape of any type, open and counter-clockwise; null for unions of polygons."""
    kind, data = shape["type"], shape["data"]
    box = F.from_json(data, "x_min double, y_min double, width double, height double")
    corners = F.array(*[F.array(box["x_min"] + box["width"] * i, box["y_min"] + box["height"] * j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    pairs = F.when(kind == "rectangle", corners).when(kind == "simple_polygon", F.from_json(data, "array<array<double>>")).when(kind == "polygon", F.from_json(data, "outer array<array<double>>")["outer"])
    return P.counter_clockwise(P.without_repeats(_points(pairs)))


def inner_rings(shape: Column) -> Column:
    """Holes of a polygon; empty for other types."""
    rings = F.from_json(shape["data"], "inner array<array<array<double>>>")["inner"]
    return F.when(shape["type"] == "polygon", F.transform(F.coalesce(rings, F.array()), _points)).otherwise(F.array().cast(f"array<{S.RING}>"))


def problem_of(ring: Column) -> Column:
    """Why a ring is no simple polygon; null if it is one."""
    return F.when(ring.isNull(), "unsupported shape").when(F.size(ring) < 3, "fewer than three vertices").when(F.size(F.array_distinct(ring)) < F.size(ring), "repeated vertices").when(P.signed_area(ring) == 0, "no area").when(F.size(P.crossings(ring)) > 0, "crosses itself")


def items(instances: DataFrame) -> DataFrame:
    """A row an item that is asked for: ring centred on its centroid, allowed rotations in radians (null: any), problem."""
    rows = instances.select("name", F.explode("items").alias("i")).where("i.demand > 0").withColumn("ring", outer_ring(F.col("i.shape")))
    cx, cy = P.centroid(F.col("ring"))
    turns = F.when(F.col("i.allowed_orientations").isNull(), None).when(F.size("i.allowed_orientations") == 0, F.array(F.lit(0.0))).otherwise(F.transform("i.allowed_orientations", lambda d: F.radians(d)))
    rows = rows.select("name", "i.id", "i.demand", "i.min_quality", turns.alias("rotations"), "ring", cx.alias("cx"), cy.alias("cy"), problem_of(F.col("ring")).alias("problem"))
    centred = F.transform("ring", lambda p: F.struct((p["x"] - F.col("cx")).alias("x"), (p["y"] - F.col("cy")).alias("y")))
    place = F.row_number().over(Window.partitionBy("name").orderBy("id")) - 1
    return rows.withColumn("centred", centred).withColumn("area", P.signed_area(F.col("ring"))).withColumn("problem", F.coalesce("problem", F.when(place != F.col("id"), "ids are not dense")))


def containers(instances: DataFrame) -> DataFrame:
    """A row a bin with stock: outline and its area without holes."""
    rows = instances.select("name", F.explode("bins").alias("b")).where("b.stock > 0")
    rows = rows.select("name", "b.id", "b.stock", "b.cost", outer_ring(F.col("b.shape")).alias("ring"), inner_rings(F.col("b.shape")).alias("holes"))
    gone = F.aggregate(F.transform("holes", lambda h: F.abs(P.signed_area(h))), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("area", P.signed_area(F.col("ring")) - gone).withColumn("problem", problem_of(F.col("ring")))


def zones(instances: DataFrame) -> DataFrame:
    """Regions of lower quality of each bin; its holes have quality 0."""
    rows = instances.select("name", F.explode("bins").alias("b")).where("b.stock > 0")
    own = rows.select("name", F.col("b.id").alias("bin"), F.explode(F.coalesce("b.zones", F.array())).alias("z")).select("name", "bin", "z.quality", outer_ring(F.col("z.shape")).alias("ring"))
    holes = rows.select("name", F.col("b.id").alias("bin"), F.lit(0).alias("quality"), F.explode(inner_rings(F.col("b.shape"))).alias("ring"))
    return own.unionByName(holes)


def strips(instances: DataFrame) -> DataFrame:
    """Initial width of a strip: the items' area by its height."""
    area = items(instances).groupBy("name").agg(F.sum(F.col("area") * F.col("demand")).alias("area"))
    return instances.select("name", F.col("strip_height").alias("height")).join(area, "name").withColumn("width", F.col("area") / F.col("height"))


def _layouts(placed: DataFrame, density: DataFrame) -> DataFrame:
    """(layout, l): each layout as a struct, its items in order."""
    each = F.struct("item_id", F.struct(F.degrees("rot").alias("rotation"), F.array("tx", "ty").alias("translation")).alias("transformation"))
    rows = placed.groupBy("layout", "container_id").agg(F.sort_array(F.collect_list(each)).alias("placed_items")).join(density, "layout")
    return rows.select("layout", F.struct("container_id", "placed_items", "density").alias("l"))


def layouts_json(placed: DataFrame, density: DataFrame) -> DataFrame:
    """placed (layout, container_id, item_id, rot in radians, tx, ty), density (layout, density) -> one JSON text a layout."""
    return _layouts(placed, density).select("layout", F.to_json("l").alias("value"))


def solutions_json(placed: DataFrame, density: DataFrame, solutions: DataFrame, problem: str) -> DataFrame:
    """One JSON text a solution. solutions: (solution, layout, density, run_time_sec, and cost of "bins" or strip_width of a "strip"), a row a layout.

    "bins" and "strips" have layouts, "strips" also their containers once each; a "strip" has its one layout.
    """
    rows = solutions.withColumnRenamed("density", "whole").join(_layouts(placed, density), "layout")
    own = {"bins": "cost", "strip": "strip_width"}.get(problem)
    per = rows.groupBy("solution").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("layout", "l"))), lambda r: r["l"]).alias("layouts"), F.max("whole").alias("density"), F.max("run_time_sec").alias("run_time_sec"),
        F.array_sort(F.collect_set("l.container_id")).alias("containers"), *([F.max(own).alias(own)] if own else []),
    )
    parts = {"bins": ["cost", "layouts"], "strip": ["strip_width", F.col("layouts")[0].alias("layout")], "strips": ["layouts", "containers"]}[problem]
    return per.select("solution", F.to_json(F.struct(*parts, "density", "run_time_sec")).alias("value"))


def read_solutions(texts: DataFrame) -> DataFrame:
    """The inverse of solutions_json for all three problems: (solution, layout: its place, container_id, item_id, rot, tx, ty)."""
    got = F.from_json("value", f"layout {S.LAYOUT}, layouts array<{S.LAYOUT}>")
    rows = texts.select("solution", got.alias("s")).select("solution", F.posexplode(F.coalesce("s.layouts", F.array("s.layout"))).alias("layout", "l"))
    rows = rows.select("solution", "layout", "l.container_id", F.explode("l.placed_items").alias("p"))
    move = F.col("p.transformation")
    return rows.select("solution", "layout", "container_id", "p.item_id", F.radians(move["rotation"]).alias("rot"), move["translation"][0].alias("tx"), move["translation"][1].alias("ty"))


def read_layouts(texts: DataFrame) -> DataFrame:
    """The inverse of layouts_json."""
    rows = texts.select("layout", F.from_json("value", S.LAYOUT).alias("l")).select("layout", "l.container_id", "l.density", F.explode("l.placed_items").alias("p"))
    move = F.col("p.transformation")
    return rows.select("layout", "container_id", "density", "p.item_id", F.radians(move["rotation"]).alias("rot"), move["translation"][0].alias("tx"), move["translation"][1].alias("ty"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One row a document or line."""
    df.select(F.col(column).alias("value")).write.text(path)


def object_place(url: Column) -> tuple[Column, Column]:
    """(bucket, key) of s3://, virtual-hosted and path-style addresses."""
    direct = F.regexp_extract(url, r"^s3a?://([^/]+)/(.+)$", 1)
    hosted = F.regexp_extract(url, r"^https?://([^./]+)\.s3[.-][^/]*/(.+)$", 1)
    path_style = r"^https?://[^/]+/([^/]+)/(.+)$"
    pick = lambda k: F.when(direct != "", F.regexp_extract(url, r"^s3a?://([^/]+)/(.+)$", k)).when(hosted != "", F.regexp_extract(url, r"^https?://([^./]+)\.s3[.-][^/]*/(.+)$", k)).otherwise(F.regexp_extract(url, path_style, k))
    return F.nullif(pick(1), F.lit("")), F.nullif(pick(2), F.lit(""))


def read_svgs(spark: SparkSession, path: str) -> DataFrame:
    """(path, svg) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.svg").load(path).select("path", F.decode("content", "UTF-8").alias("svg"))


def decoded(base64: Column) -> Column:
    return F.decode(F.unbase64(base64), "UTF-8")
