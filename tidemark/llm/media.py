"""Media columns: texts stored as lossless WebP images, read back as pixel arrays with features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm import webp

BLOCK = 64


def to_webp(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the text's UTF-8 bytes (null: none), padded with zero bytes to a positive multiple of 64,
    as one lossless WebP file 16 pixels wide, or several, one after another, beyond 1 MiB. Equal texts give equal
    files. Rows are kept as they are, repeated ones too; other columns are left out."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, media = None, b""
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                stored = []
                for raw in part.column(1):
                    raw = raw.as_buffer().to_pybytes()
                    if raw != last:
                        last, media = raw, webp.encode_payload(raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)))
                    stored.append(media)
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(stored, pa.binary())], names=[key, "n_bytes", "media"])

    return rows.mapInArrow(tb.lean(run), schema)


def features(images: list[tuple[int, int, np.ndarray]]) -> str:
    """Sizes, mean of each channel (alpha, red, green, blue; rounded down) and number of distinct pixels."""
    pixels = np.concatenate([p for _, _, p in images])
    channel = pixels.view(np.uint8).reshape(-1, 4)
    means = channel.sum(0, dtype=np.int64) // len(pixels)
    shape = "+".join(f"{w}x{h}" for w, h, _ in images)
    return f"{shape};mean={means[3]},{means[2]},{means[1]},{means[0]};distinct={len(np.unique(pixels))}"


def read_webp(media: DataFrame, key: str = "doc_id", column: str = "media", pixels: bool = False, max_bytes: int = 8 << 20) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), decoded from the
    stored files; with pixels also the pixel array: images, an array of (width, height, argb as 32-bit integers)."""
    rows = media.select(key, "n_bytes", column)
    schema = f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", images array<struct<width:int,height:int,argb:array<int>>>" if pixels else ""
    image_type = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_buffer().to_pybytes() for x in batch.column(2)]
            first = 0
            while first < len(raw):
                end, held = first, 0
                while end < len(raw) and (end == first or held + len(raw[end]) <= max_bytes):
                    held += len(raw[end])
                    end += 1
                group = {x: list(webp.files(x)) for x in raw[first:end]}  # equal files are decoded once
                decoded = iter(webp.decode([f for files in group.values() for f in files]))
                known = {}
                for x, files in group.items():
                    images = [next(decoded) for _ in files]
                    payload = webp.payload_of(images)
                    known[x] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(x), hashlib.sha256(x).hexdigest(), features(images))
                    if pixels:
                        known[x] += ([{"width": w, "height": h, "argb": p.view(np.int32)} for w, h, p in images],)
                columns = list(zip(*(known[x] for x in raw[first:end]), strict=True))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), image_type]
                arrays = [pa.array(c, t) for c, t in zip(columns, types[: len(columns)], strict=True)]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "images"][: len(columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), *arrays], names=[key, "n_bytes", *names])
                first = end

    return rows.mapInArrow(tb.lean(run), schema)
