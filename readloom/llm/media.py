"""Media columns: payloads stored as progressive JPEG files and read back as coefficients, payload and RGB tensor.

The bytes of a text, filled with zero bytes to a multiple of 64, are the coefficients of 8x8 blocks in zigzag
order (a byte b is the coefficient b - 128), the format's own unit: samples would pass through a rounded
transform and lose bits. The number of bytes stands in the file's comment. Reading decodes all scans of the
stored file, takes the payload from the coefficient arrays, and computes the tensor from the same arrays.

Defined results: null and empty texts are one block of zero bytes; equal texts give equal files, tensors and
features; repeated rows give a row each; an empty table gives no rows; a text of up to 6 GB fits an image; a file
that can't be read raises ValueError; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm import common
from readloom.llm import progressive_jpeg as jpeg

#: Bytes of payload that a worker has in hand at once.
CHUNK_BYTES = 1 << 20
#: MCUs of 16 by 16 pixels across an image at most (the format's limit of 65,535 pixels).
MOST_ACROSS = 4095
BLOCK = 64


def store(payloads: list[bytes]) -> list[bytes]:
    """The file of each payload, a positive multiple of 64 bytes."""
    values, shapes = [], []
    for payload in payloads:
        mcus = -(-len(payload) // (6 * BLOCK))
        across = min(mcus, MOST_ACROSS)
        down = -(-mcus // across)
        body = np.full(across * down * 6 * BLOCK, 128, np.uint8)
        body[: len(payload)] = np.frombuffer(payload, np.uint8)
        values.append(body.astype(np.int16).reshape(-1, BLOCK) - 128)
        shapes.append((across, down))
    return jpeg.write(values, shapes, [b"payload %d" % len(p) for p in payloads])


def load(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """The payload and the RGB tensor of each file."""
    images, values, origin = jpeg.coefficients(files)
    bodies = (values + 128).astype(np.uint8)
    tensors = jpeg.tensors(images, values, origin)
    out = []
    for image, at, rgb in zip(images, origin, tensors, strict=True):
        n = int(image.comment.rpartition(b" ")[2])
        out.append((bodies[at : at + n // BLOCK].tobytes(), rgb))
    return out


def feature(rgb: np.ndarray) -> str:
    """Size and, of each channel, mean and share of saturated pixels; whole numbers throughout."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    mean = flat.sum(0, dtype=np.int64) * 1000 // n
    ends = ((flat == 0) | (flat == 255)).sum(0) * 1000 // n
    return f"{rgb.shape[1]}x{rgb.shape[0]};mean " + ",".join(map(str, mean)) + ";saturated " + ",".join(map(str, ends))


#: Columns that the operator can give. rgb_crc32 is that of rgb.
COLUMNS = {"rgb_crc32": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "payload": pa.binary(), "width": pa.int32(), "height": pa.int32(), "rgb": pa.binary(), "feature": pa.string()}
_SQL = {"rgb_crc32": "long", "n_bytes": "long", "media": "binary", "payload": "binary", "width": "int", "height": "int", "rgb": "binary", "feature": "string"}


def media_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """One row per document: doc_id and the columns named in keep (rgb: rows of 3-byte pixels)."""
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", CHUNK_BYTES):
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            payloads = [t + b"\0" * (max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t)) for t in raw]
            files = store(payloads)
            rows: dict[str, list] = {c: [] for c in keep}
            for text_bytes, file, (payload, rgb) in zip(raw, files, load(files), strict=True):
                have = {"n_bytes": len(text_bytes), "media": file, "payload": payload, "width": rgb.shape[1], "height": rgb.shape[0]}
                for c, column in rows.items():
                    column.append(rgb.tobytes() if c == "rgb" else feature(rgb) if c == "feature" else zlib.crc32(np.ascontiguousarray(rgb)) if c == "rgb_crc32" else have[c])
            yield pa.record_batch([batch.column(0), *(pa.array(v, COLUMNS[c]) for c, v in rows.items())], ["doc_id", *keep])

    return narrow.mapInArrow(common.freed(run), "doc_id long, " + ", ".join(f"{c} {_SQL[c]}" for c in keep))
