"""Media columns: documents stored as progressive JPEGs, read back as coefficients and RGB tensors.

Defined cases: a null or empty text has the least payload (one unit of 576 bytes 255); equal texts
have equal media and features; media that is null or no progressive JPEG gives null tensors in
rgb_tensors(). The doc_id passes through, null and repeated ones too; bytes that are not UTF-8
are stored as they are. A text's coefficients and planes (some 60 bytes a byte: 1.1 GB for a text of 20 MB) are held by the task that reads it.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import as_bytes
from skyfix.llm.jpeg import JpegError, decode_coefficients, encode_payload, read_payload, samples

UNIT = 576
#: Rows of a result batch, so that media and tensors of few documents are held at once.
_ROWS = 256


def payload_of(text: bytes | None) -> tuple[int, bytes]:
    raw = text or b""
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def feature(rgb) -> str:
    h, w, _ = rgb.shape
    means = rgb.reshape(-1, 3).sum(axis=0, dtype="int64") // (h * w)
    return f"{w}x{h}:" + "-".join(str(int(m)) for m in means)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored JPEG) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                done = []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    n, payload = payload_of(text.as_py())
                    done.append((i, n, encode_payload(payload)))
                yield _table(done, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def rgb_tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width, rgb (row-major bytes) of every row with columns doc_id and media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                done = []
                for i, stored in zip(part.column("doc_id").to_pylist(), part.column("media"), strict=True):
                    try:
                        rgb = samples(decode_coefficients(stored.as_py() or b""))
                        done.append((i, rgb.shape[0], rgb.shape[1], rgb.tobytes()))
                    except (JpegError, IndexError, KeyError):
                        done.append((i, None, None, None))
                yield _table(done, schema)

    return media.selectExpr("cast(doc_id as long) doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame) -> DataFrame:
    """Reads a media column (of encode_media()) back, and digests its payload, its bytes and its RGB tensor.

    The media column is a column like any other: it may come straight from encode_media(), in the same
    stage, or from a table that holds it. It is about 2.3 times as large as the text's Parquet. What is no whole JPEG has nulls instead of what would be
    read from it, a null media instead of its bytes' figures too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        text = ("payload_sha256", "media_sha256", "feature")
        schema = pa.schema([(c, pa.string() if c in text else pa.int64()) for c in names])
        for batch in batches:
            done = []
            for i, n, value in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                stored = value.as_py()
                try:
                    image = decode_coefficients(stored or b"")
                    back = read_payload(image)
                    read = len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), feature(samples(image))
                except (JpegError, IndexError, KeyError):
                    read = (None,) * 4
                own = (None, None) if stored is None else (len(stored), hashlib.sha256(stored).hexdigest())
                done.append((i, n, *read[:3], *own, read[3]))
            if done:
                yield _table(done, schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
