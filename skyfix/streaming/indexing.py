"""Indexing of uploaded maps as a stream, and requests that wait for it.

IndexService is a foreachBatch sink: it cuts each new map into tiles, writes their embeddings and then one status row a map. Both go to
a folder of the batch's own, which a replay overwrites, and readers only see tiles whose status row is there. So a batch that failed half-way and ran
again leaves one row for each map, and the latest batch that has a map is the one that counts.

wait() joins requests with index events: the state of the map when the request came, or else the first time within
`timeout` at which it became ready or failed. As a stream it is an outer join inside that bound, in batch a scan in time order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfix.operators import raster, tiling
from skyfix.sources import images

TIMEOUT = "900 seconds"
#: How long a status is remembered for requests that come after it.
MEMORY = "1 day"
SETTLED = ("ready", "failed")
# Messages of requests whose map has no index.
NOT_READY, FAILED = "Reference map is still indexing - try again shortly.", "Reference map indexing failed."

_TILES = "map_id long, tile_id int, x int, y int, width int, height int, scale double, embedding array<float>, error string"


# ---------------------------------------------------------------- requests that wait


def _outcome(before: Column, after: Column) -> list[Column]:
    """status, error, waited of a request, from the last event before it and the first settled one after it (structs of at, status, error)."""
    seen = F.coalesce(before["status"].isin(*SETTLED), F.lit(False))
    event = F.when(seen, before).otherwise(after)
    status = F.coalesce(event["status"], F.lit("timeout"))
    error = F.when(status == "failed", F.coalesce(F.nullif(event["error"], F.lit("")), F.lit(FAILED))).when(status == "timeout", NOT_READY)
    waited = F.when(seen, F.lit(0.0)).otherwise((F.unix_micros(after["at"]) - F.unix_micros(F.col("asked"))) / 1e6)
    return [status.alias("status"), error.alias("error"), F.round(waited, 3).alias("waited")]


def _sides(requests: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = requests.select("request_id", "map_id", F.col("ts").cast("timestamp").alias("asked"))
    told = events.select(F.col("map_id").alias("of"), "status", "error", F.col("ts").cast("timestamp").alias("at"))
    return asked.filter("request_id IS NOT NULL AND asked IS NOT NULL"), told.filter("of IS NOT NULL AND at IS NOT NULL")


def stream_wait(requests: DataFrame, events: DataFrame, timeout: str = TIMEOUT, memory: str = MEMORY, late: str = "10 minutes") -> DataFrame:
    """request_id, map_id, asked, status (ready, failed, timeout), error, waited of each request (request_id, map_id, ts), once it can no longer change.

    events: map_id, status, error, ts. State is held for events of the last `memory` and requests of the last `timeout`.
    Append mode. Of events at the same time the largest by status and error counts before a request, the smallest after it.
    """
    asked, told = _sides(requests, events)
    asked, told = asked.withWatermark("asked", late), told.withWatermark("at", late)
    near = (F.col("map_id") == F.col("of")) & (F.col("at") >= F.col("asked") - F.expr(f"INTERVAL {memory}")) & (F.col("at") <= F.col("asked") + F.expr(f"INTERVAL {timeout}"))
    met = asked.join(told, near, "left")
    event = F.struct("at", "status", "error")
    out = met.groupBy("request_id", "map_id", "asked").agg(
        F.max(F.when(F.col("at") <= F.col("asked"), event)).alias("before"),
        F.min(F.when((F.col("at") > F.col("asked")) & F.col("status").isin(*SETTLED), event)).alias("after"),
    )
    return out.select("request_id", "map_id", "asked", *_outcome(F.col("before"), F.col("after")))


def wait(requests: DataFrame, events: DataFrame, timeout: str = TIMEOUT, memory: str = MEMORY) -> DataFrame:
    """stream_wait() over whole tables: one shuffle by map, each map's rows read in time order, whatever the number of its requests and events."""
    asked, told = _sides(requests, events)
    event = F.struct("at", "status", "error")
    rows = told.select(F.col("of").alias("map_id"), F.col("at").alias("time"), event.alias("event"), F.lit(None).cast("long").alias("request_id"), F.lit(0).alias("turn"))
    rows = rows.unionByName(asked.select("map_id", F.col("asked").alias("time"), F.lit(None).cast("struct<at:timestamp,status:string,error:string>").alias("event"), "request_id", F.lit(1).alias("turn")))
    by_time = Window.partitionBy("map_id").orderBy("time", "turn", "event")
    settled = F.when(F.col("event.status").isin(*SETTLED), F.col("event"))
    rows = rows.withColumn("before", F.last("event", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the first one from here on is the last one so far when time is read backwards; a frame that reaches to the end would be read anew for every row
    back = Window.partitionBy("map_id").orderBy(F.desc("time"), F.desc("turn"), F.desc("event"))
    rows = rows.withColumn("after", F.last(settled, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.filter("turn = 1").withColumnRenamed("time", "asked")
    before = F.when(F.col("before.at") >= F.col("asked") - F.expr(f"INTERVAL {memory}"), F.col("before"))
    after = F.when(F.col("after.at") <= F.col("asked") + F.expr(f"INTERVAL {timeout}"), F.col("after"))
    return rows.select("request_id", "map_id", "asked", *_outcome(before, after)).distinct()


# ---------------------------------------------------------------- the index


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles of each map; a map that cannot be embedded gives one row with its error."""
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.float64(), pa.list_(pa.float32()), pa.string()]
    names = ["map_id", "tile_id", "x", "y", "width", "height", "scale", "embedding", "error"]
    for batch in batches:
        for row in batch.to_pylist():  # one map at a time: its tiles share its pixels
            try:
                if row["px"] is None:
                    raise ValueError("not an image that can be read")
                image = np.frombuffer(row["px"], np.uint8).reshape(row["h"], row["w"], row["channels"])
                rows = []
                for t in row["tiles"]:
                    crop = image[t["y"] : t["y"] + t["height"], t["x"] : t["x"] + t["width"]]
                    vector = raster.descriptor(crop if crop.size else np.zeros((8, 8, 3), np.uint8))
                    rows.append((row["map_id"], *(t[c] for c in names[1:7]), vector.astype(np.float32), None))
            except Exception as error:  # any map's failure becomes its status; the others go on
                rows = [(row["map_id"], *[None] * 7, f"{error}" or type(error).__name__)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def embedded(maps: DataFrame, scales: tuple[float, ...] = tiling.SCALES, max_tiles: int = tiling.MAX_TILES) -> DataFrame:
    """Tiles with embeddings, or one row with an error, of each map (map_id, content: the encoded image)."""
    rasters = images.decode(maps.select(F.col("map_id").cast("string").alias("path"), "content")).withColumnRenamed("path", "map_id")
    rasters = rasters.select(F.col("map_id").cast("long"), F.col("height").alias("h"), F.col("width").alias("w"), "channels", "px")
    sizes = rasters.filter("px IS NOT NULL AND h > 0 AND w > 0").selectExpr("map_id", "w AS map_w", "h AS map_h")
    tiles = tiling.tile_grid(sizes, scales, max_tiles=max_tiles)
    listed = tiles.groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("tile_id", "x", "y", "width", "height", "scale"))).alias("tiles"))  # max_tiles at most
    return rasters.join(listed, "map_id", "left").mapInArrow(_embed, _TILES)


class IndexService:
    """foreachBatch sink of maps (map_id, content, seq): `stream.writeStream.foreachBatch(IndexService(root))`. root: a folder that the cluster shares.

    Of several rows of one map in a batch the one with the largest seq counts. between, if given, runs after the tiles are written and before
    the status is (tests plant failures there).
    """

    def __init__(self, root: str, scales: tuple[float, ...] = tiling.SCALES, max_tiles: int = tiling.MAX_TILES, between: Callable[[int], None] | None = None):
        self.root, self.scales, self.max_tiles, self.between = root, scales, max_tiles, between

    def __call__(self, maps: DataFrame, batch: int) -> None:
        spark = maps.sparkSession
        latest = maps.filter("map_id IS NOT NULL").groupBy("map_id").agg(F.max_by("content", F.struct("seq", "content")).alias("content"))
        rows = embedded(latest, self.scales, self.max_tiles)
        rows.write.mode("overwrite").parquet(f"{self.root}/tiles/batch={batch}")
        if self.between:
            self.between(batch)
        rows = spark.read.schema(_TILES).parquet(f"{self.root}/tiles/batch={batch}")
        status = rows.groupBy("map_id").agg(F.max("error").alias("error"), F.count("tile_id").alias("tiles"), F.current_timestamp().alias("ts"))
        status.withColumn("status", F.when(F.col("error").isNull(), "ready").otherwise("failed")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/status/batch={batch}")

    def status(self, spark: SparkSession) -> DataFrame:
        """map_id, status, error, tiles, ts, batch: the latest of every map."""
        rows = spark.read.schema("map_id long, error string, tiles long, ts timestamp, status string, batch long").parquet(f"{self.root}/status")
        return rows.groupBy("map_id").agg(F.max_by(F.struct("status", "error", "tiles", "ts", "batch"), "batch").alias("s")).select("map_id", "s.*")

    def bank(self, spark: SparkSession) -> DataFrame:
        """map_id, tile_id, box, scale and embedding of the tiles of all maps that are ready."""
        tiles = spark.read.schema(f"{_TILES}, batch long").parquet(f"{self.root}/tiles")
        ready = self.status(spark).filter("status = 'ready'").select("map_id", "batch")
        return tiles.join(ready, ["map_id", "batch"]).drop("error", "batch")
