"""Entities, uploads and requests as tables: admission, validation, upserts, look-ups, cached banks."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfix.functions import geo

from skyfix.functions.text import suffix

# Limits of uploads.
MAX_BYTES = 200 * 1024 * 1024
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")
MIN_EDGE, MAX_EDGE = 256, 8000


def upload_error(path: Column, length: Column, allowed: tuple[str, ...] = IMAGE_SUFFIXES, most: int = MAX_BYTES) -> Column:
    """unsupported_type, too_large, empty or null."""
    return F.when(~suffix(path).isin(*allowed), "unsupported_type").when(length > most, "too_large").when(F.coalesce(length, F.lit(0)) == 0, "empty")


def map_size(width: Column, height: Column, most: int = MAX_EDGE) -> tuple[Column, Column]:
    """A map's size after it is shrunk to the longest edge allowed."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.greatest(F.lit(1), F.rint(width * scale)).cast("int"), F.greatest(F.lit(1), F.rint(height * scale)).cast("int")


def work_scale(width: Column, height: Column, edge: int = 960) -> Column:
    """The factor to the working size; images are never enlarged."""
    return F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))


def frame_larger_than_map(frame_w: Column, frame_h: Column, map_w: Column, map_h: Column) -> Column:
    return frame_w.cast("long") * frame_h > map_w.cast("long") * map_h


def upsert(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def unknown(requests: DataFrame, key: str, entities: DataFrame) -> DataFrame:
    """Requests whose key is not null and names no entity."""
    return requests.filter(F.col(key).isNotNull()).join(entities.select(key).distinct(), key, "left_anti")


def request_error(requests: DataFrame, maps: DataFrame, frames: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds error to requests (map_id, frame_id, plan_id, matcher, region as a string map): the first fault, or null."""
    out = requests
    for key, table in (("map_id", maps), ("frame_id", frames), ("plan_id", plans)):
        out = out.join(table.select(key, F.lit(True).alias(f"_{key}")).distinct(), key, "left")
    number = lambda k: F.try_element_at("region", F.lit(k)).try_cast("double")
    bad_region = F.col("region").isNotNull() & (number("x").isNull() | number("y").isNull() | number("width").isNull() | number("height").isNull())
    error = F.when(F.col("_map_id").isNull(), "unknown_map").when(F.col("_frame_id").isNull(), "unknown_frame").when(F.col("plan_id").isNotNull() & F.col("_plan_id").isNull(), "unknown_plan")
    error = error.when(F.col("matcher").isNotNull() & ~F.lower("matcher").isin("lightglue", "sift", ""), "unknown_matcher").when(bad_region, "region_not_numeric")
    return out.withColumn("error", error).drop("_map_id", "_frame_id", "_plan_id")


def job_state(log: DataFrame) -> DataFrame:
    """job_id, state, finished_at, elapsed of a log of state changes (job_id, state, ts as seconds)."""
    done = F.col("state").isin("done", "error")
    out = log.groupBy("job_id").agg(F.max_by("state", "ts").alias("state"), F.max(F.when(done, F.col("ts"))).alias("finished_at"), F.min("ts").alias("started_at"), F.max("ts").alias("_last"))
    return out.withColumn("elapsed", F.round(F.coalesce("finished_at", "_last") - F.col("started_at"), 2)).drop("_last")


def result_status(jobs: DataFrame) -> DataFrame:
    """Adds code: 404 for an unknown job (null state), 500 for a failed one, 409 until it is done, else 200."""
    return jobs.withColumn("code", F.when(F.col("state").isNull(), 404).when(F.col("state") == "error", 500).when(F.col("state") != "done", 409).otherwise(200))


def counts(**tables: DataFrame) -> DataFrame:
    """entity, n of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def new_id(prefix: str, *of: Column) -> Column:
    """An id from what the row is known by: a task that runs again gives the same one. Null counts as a value of its own."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.to_json(F.struct(*of)), 256), 1, 12))


def save_bank(bank: DataFrame, path: str) -> None:
    """Tile embeddings, one folder for each map, so that a job reads its own map's files alone."""
    bank.write.mode("overwrite").partitionBy("map_id").parquet(path)


def load_bank(spark: SparkSession, path: str, map_id, rebuild) -> DataFrame:
    """A map's cached bank; rebuild() where there is none or its files cannot be read. Any other failure is raised."""
    try:
        bank = spark.read.parquet(path).filter(F.col("map_id") == map_id)
        return rebuild() if bank.isEmpty() else bank
    except (PySparkException, Py4JJavaError) as error:
        if not isinstance(error, AnalysisException) and "FAILED_READ_FILE" not in str(error):
            raise
        return rebuild()


BUCKETS = 200


def save_bucketed(rows: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows (map_id, tile_id, ...) as a table of the catalog, dealt by map and tile into `buckets` files at path and sorted inside.

    Two tables of equally many buckets join by map_id and tile_id without a shuffle of either: tiles and their
    embeddings are written once and joined for every frame. A map of many tiles lies in many buckets. Buckets do not grow in number with the
    maps; choose them for the largest table.
    """
    rows.repartition(buckets, "map_id", "tile_id").write.mode("overwrite").bucketBy(buckets, "map_id", "tile_id").sortBy("map_id", "tile_id").option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def tiles_with_bank(tiles: DataFrame, bank: DataFrame) -> DataFrame:
    """Tiles with their embeddings, of bucketed tables without an exchange."""
    return tiles.join(bank, ["map_id", "tile_id"])


def calibration(raw: Column) -> Column:
    """A struct of nine doubles from a string map; null if a given value is not a number or a required one is missing."""
    names = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")
    value = lambda k: F.try_element_at(raw, F.lit(k))
    faulty = F.lit(False)
    for i, k in enumerate(names):
        bad = value(k).isNotNull() & value(k).try_cast("double").isNull()
        faulty = faulty | F.coalesce(bad | value(k).isNull() if i < 4 else bad, F.lit(True))
    return F.when(~faulty, F.struct(*[F.coalesce(value(k).try_cast("double"), F.lit(0.0)).alias(k) for k in names]))


def drag_region(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A dragged rectangle inside the map, or null if a side is at most a hundredth of the short edge."""
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    ax, bx, ay, by = inside(x1, width), inside(x2, width), inside(y1, height), inside(y2, height)
    least = F.least(width, height) * 0.01
    w, h = F.abs(bx - ax), F.abs(by - ay)
    return F.when((w > least) & (h > least), F.struct(F.least(ax, bx).alias("x"), F.least(ay, by).alias("y"), w.alias("width"), h.alias("height")))


def settings(spark: SparkSession, defaults: dict[str, str], prefix: str = "skyfix.") -> dict[str, str]:
    """Defaults overridden by the session's settings of the same name."""
    return {k: spark.conf.get(f"{prefix}{k}", v) for k, v in defaults.items()}


# Feature parameters by default and of the efficient preset.
FEATURES = {"max_keypoints": (4096, 1500), "superpoint_detection_threshold": (0.0005, 0.005), "superpoint_nms_radius": (4, 6), "sift_contrast_threshold": (0.04, 0.08), "sift_edge_threshold": (10.0, 8.0)}


def feature_params(efficient: Column) -> Column:
    """The feature parameters of a request: a value of its own, so that one request never changes another's. Null counts as the default."""
    chosen = F.coalesce(efficient, F.lit(False))
    return F.struct(*(F.when(chosen, F.lit(few)).otherwise(F.lit(many)).alias(name) for name, (many, few) in FEATURES.items()))


def set_georeference(maps: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, map_id, status (200, 400, 404), error and georeference of every request to set or clear one.

    maps: map_id, width, height. requests: request_id, map_id, clear, north, south, west, east, corners (which win
    over the box). An unknown map is 404, an invalid georeference 400; a cleared one is null.
    """
    known = requests.join(maps.select("map_id", "width", "height", F.lit(True).alias("_known")), "map_id", "left")
    by_corners = F.coalesce(F.size("corners") > 0, F.lit(False))
    made = F.struct(F.when(by_corners, "corners").otherwise("bbox").alias("kind"), "north", "south", "west", "east", "corners", "width", "height")
    box = geo.bbox_error(*map(F.col, ("north", "south", "west", "east", "width", "height")))
    error = F.when(F.col("_known").isNull(), "unknown_map").when(~F.coalesce("clear", F.lit(False)), F.when(by_corners, geo.corners_error(F.col("corners"), F.col("width"), F.col("height"))).otherwise(box))
    status = F.when(F.col("_known").isNull(), 404).when(error.isNotNull(), 400).otherwise(200)
    return known.select("request_id", "map_id", status.alias("status"), error.alias("error"), F.when((status == 200) & ~F.coalesce("clear", F.lit(False)), made).alias("georeference"))


def map_record(maps: DataFrame) -> DataFrame:
    """The document of a map: status, sizes, index state, georeference and preview path."""
    name = F.element_at(F.split("path", "/"), -1)
    return maps.select(
        F.when(F.col("embedding_status") == "failed", "error").otherwise("success").alias("status"), "map_id", "filename", "width", "height", "file_size", "tiles_generated", "embedding_status",
        "embedding_backend", F.round("index_seconds", 2).alias("index_seconds"), F.col("georeference").isNotNull().alias("georeferenced"), "georeference", F.concat(F.lit("/files/uploads/"), name).alias("preview_url"), "error",
    )


def frame_record(frames: DataFrame) -> DataFrame:
    """The document of a frame; an unknown height gives an aspect ratio of 0."""
    ratio = F.coalesce(F.round(F.try_divide(F.col("width"), F.col("height")), 4), F.lit(0.0))
    return frames.select(F.lit("success").alias("status"), "drone_id", "filename", "width", "height", "file_size", ratio.alias("aspect_ratio"), F.concat(F.lit("/files/uploads/"), F.element_at(F.split("path", "/"), -1)).alias("preview_url"))
