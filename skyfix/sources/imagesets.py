"""Sets of images as a data source and as a sink.

`image_pairs` reads a data set of image pairs that is stored as Parquet, a folder or files for each split: root/<split>/*.parquet or
root/<split>-*.parquet. An image column holds the encoded bytes, or a struct of bytes and path (the path is looked up
below root if there are no bytes). Each row group is a partition; a limit is met by the row counts in the
files' footers, so no row group beyond it is opened.

`image_files` writes encoded images to files. Tasks write below a folder of the job's own; the driver moves the files to their names when all
tasks have ended, and removes the folder when one has failed, so a failed write leaves no file and a task that ran twice leaves one.

    spark.dataSource.register(ImagePairs); spark.read.format("image_pairs").option("limit", 100).load(root)
    spark.dataSource.register(ImageFiles); frame.select("name", "content").write.format("image_files").mode("append").save(root)
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from skyfix.sources import images

PAIR_SCHEMA = "split string, number long, aerial binary, map binary, error string"
FILE_SCHEMA = "name string, content binary"


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if re.match(r"[a-z][a-z0-9+.-]*:", root) else posixpath.abspath(root))


@dataclass
class RowGroup(InputPartition):
    """The first `take` rows of a row group; the first of them has the number `first`."""

    split: str
    file: str
    group: int
    first: int
    take: int


def _splits(files: fs.FileSystem, root: str) -> dict[str, list[str]]:
    """Each split's Parquet files, both in the order of their names."""
    found: dict[str, list[str]] = {}
    for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
        inside = posixpath.relpath(info.path, root)
        if info.type == fs.FileType.File and inside.endswith(".parquet") and not any(part[0] in "._" for part in inside.split("/")):
            split = inside.split("/")[0] if "/" in inside else re.split(r"[-.]", inside)[0]
            found.setdefault(split, []).append(info.path)
    return {split: sorted(paths) for split, paths in sorted(found.items())}


def row_groups(root: str, limit: int = 0, splits: list[str] | None = None) -> list[RowGroup]:
    """What to read: at most `limit` rows of each split (0: all), numbered through; once a split has ended with `limit` rows or more in all, no other
    split is begun."""
    files, base = _opened(root)
    out: list[RowGroup] = []
    number, of = 0, _splits(files, base)
    for split in splits or of:
        left = limit or -1
        for path in of.get(split, []):
            with files.open_input_file(path) as source:
                meta = pq.ParquetFile(source).metadata
            for group in range(meta.num_row_groups):
                take = meta.row_group(group).num_rows if left < 0 else min(left, meta.row_group(group).num_rows)
                if take:
                    out.append(RowGroup(split, path, group, number, take))
                    number += take
                    left -= take if left > 0 else 0
            if not left:
                break
        if limit and number >= limit:
            break
    return out


def _encoded(value, files: fs.FileSystem, base: str) -> bytes:
    if isinstance(value, dict):
        if value.get("bytes"):
            return value["bytes"]
        if value.get("path"):
            inside = posixpath.normpath(value["path"])
            if inside.startswith(("/", "..")):
                raise ValueError(f"path outside the set: {value['path']}")
            with files.open_input_file(posixpath.join(base, inside)) as source:
                return source.read()
        raise ValueError(f"cannot decode image dict: keys={sorted(value)}")
    if not value:
        raise ValueError("no image")
    return value


class _PairReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.limit = options["path"], int(options.get("limit", "0"))
        self.splits = [s for s in options.get("splits", "").split(",") if s] or None
        self.columns = options.get("aerial", "imageA"), options.get("map", "imageB")

    def partitions(self) -> list[RowGroup]:
        return row_groups(self.root, self.limit, self.splits)

    def read(self, part: RowGroup) -> Iterator[tuple]:
        if not isinstance(part, RowGroup):  # no rows at all
            return
        files, base = _opened(self.root)
        with files.open_input_file(part.file) as source:
            done = 0
            for batch in pq.ParquetFile(source).iter_batches(batch_size=16, row_groups=[part.group], columns=[*self.columns]):
                for row in batch.to_pylist():
                    if done == part.take:
                        return
                    try:
                        pair, error = [_encoded(row[c], files, base) for c in self.columns], None
                    except (ValueError, OSError) as e:
                        pair, error = [None, None], str(e)
                    yield part.split, part.first + done, *pair, error
                    done += 1


class ImagePairs(DataSource):
    """Options: path, limit (rows of each split; 0: all), splits (comma-separated; default: all, by name), aerial and map (column names)."""

    @classmethod
    def name(cls) -> str:
        return "image_pairs"

    def schema(self) -> str:
        return PAIR_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PairReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they lie, and where they belong."""

    moves: list[tuple[str, str]]


class _FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite, self.job = options["path"], overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        files, base = _opened(self.root)
        mine = posixpath.join(base, self.job, uuid.uuid4().hex)  # an attempt's own folder
        files.create_dir(mine)
        moves = []
        for i, row in enumerate(rows):
            name = posixpath.normpath(row.name or "")
            if name in ("", ".") or name.startswith(("/", "..")) or name[0] in "._":
                raise ValueError(f"not a file name: {row.name!r}")
            if row.content is None:
                raise ValueError(f"no content: {row.name!r}")
            with files.open_output_stream(posixpath.join(mine, str(i))) as sink:
                sink.write(row.content)
            moves.append((posixpath.join(mine, str(i)), posixpath.join(base, name)))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _opened(self.root)
        moves = [move for m in messages if m is not None for move in m.moves]
        targets = {target for _, target in moves}
        if len(targets) < len(moves):
            self.abort(messages)
            raise ValueError("two images have one name")
        files.create_dir(base)
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(base)):
                if posixpath.basename(info.path)[0] not in "._":
                    files.delete_dir(info.path) if info.type == fs.FileType.Directory else files.delete_file(info.path)
        for folder in sorted({posixpath.dirname(t) for t in targets}):
            files.create_dir(folder)
        for source, target in moves:
            files.move(source, target)
        self._clear(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.root))

    def _clear(self, files: fs.FileSystem, base: str) -> None:
        if files.get_file_info(posixpath.join(base, self.job)).type == fs.FileType.Directory:
            files.delete_dir(posixpath.join(base, self.job))


class ImageFiles(DataSource):
    """Sink of rows (name, content); option path. A name may have folders; append replaces files of the same name, overwrite all there were."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return FILE_SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(dict(self.options), overwrite)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, contents, errors = [], [], []
        for row in batch.to_pylist():
            try:
                pixels = np.frombuffer(row["px"], np.uint8).reshape(row["height"], row["width"], row["channels"])
                content, error = images.encode_png(np.repeat(pixels, 3, axis=2) if row["channels"] == 1 and row["colour"] else pixels), None
            except (KeyError, TypeError, ValueError) as e:
                content, error = None, str(e) or type(e).__name__
            names.append(row["name"])
            contents.append(content)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["name", "content", "error"])


def encoded(rasters: DataFrame, colour: bool = False) -> DataFrame:
    """name, content (PNG), error of rasters (name, height, width, channels, px); colour: grey ones become RGB. What cannot be encoded has an error
    instead of a content."""
    rows = rasters.select("name", "height", "width", "channels", "px", F.lit(colour).alias("colour"))
    return rows.mapInArrow(_encode, "name string, content binary, error string")


def save_renders(renders: DataFrame, root: str) -> DataFrame:
    """Writes renders (job_id, name, height, width, channels, px) as root/<job_id>/<name>.png, grey ones as RGB, and returns job_id, name, path below
    root, error of each: a render that cannot be encoded does not fail the others. Renders without pixels are skipped."""
    renders.sparkSession.dataSource.register(ImageFiles)
    asked = renders.filter("px IS NOT NULL").withColumn("name", F.concat(F.col("job_id").cast("string"), F.lit("/"), "name", F.lit(".png")))
    rows = encoded(asked, colour=True)
    rows.filter("error IS NULL").select("name", "content").write.format("image_files").mode("append").save(root)
    path = F.when(F.col("error").isNull(), F.col("name"))
    parts = F.split("name", "/")
    return rows.select(F.get(parts, F.lit(0)).alias("job_id"), F.regexp_replace(F.get(parts, F.lit(1)), r"\.png$", "").alias("name"), path.alias("path"), "error")


def numbered(images_: DataFrame, number: str = "number") -> DataFrame:
    """name, content of images (number, content): six digits and more, as a prepared set has them."""
    return images_.select(F.concat(F.lpad(F.col(number).cast("string"), F.greatest(F.lit(6), F.length(F.col(number).cast("string"))), F.lit("0")), F.lit(".png")).alias("name"), "content")
