"""Text batches, word boundaries and hashes shared by the operators of this subpackage.

Texts arrive as Arrow batches and are worked on as one byte buffer with offsets, so that word
boundaries, word hashes and shingle hashes cost a few numpy passes a byte and no Python call a word.
A *word* here is a run of bytes that are ASCII letters, ASCII digits or part of a non-ASCII code point; a code
point of a script that is written without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word of its own.
Hashes ignore the case of A-Z and of the accented capitals U+00C0..U+00DE.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at once in a Python worker.
CHUNK_BYTES = 1 << 20
#: Bytes of text of which the arrays (8 bytes a byte) stay in a core's cache.
CACHE_BYTES = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def small_batches(spark: SparkSession) -> None:
    """Send a thousand rows and 8 MB at once to Python, not ten thousand and 64 MB: texts are long, and workers share an executor's memory."""
    for key, usual, wanted in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8388608b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", wanted) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", wanted)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names, else (on one machine only) a new one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def steady(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a bounded number of rows, made without Python workers. schema: `name type, ...` of long, int, double and string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The checkpoints and written tables of one call of an operator, deleted once its result is at rest."""

    def __init__(self) -> None:
        self.files: list[tuple[SparkSession, str]] = []

    def table(self, df: DataFrame) -> DataFrame:
        """df as a table written to the shared folder: packed, and of known size, so that small ones may be broadcast. The exchanges behind it are let go of: Spark deletes them once the driver's collector has met them."""
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.files.append((spark, path))
        spark.sparkContext._jvm.System.gc()
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that is read by nobody any more."""
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for spark, file in [f for f in self.files if name.endswith(f[1].rsplit("/", 1)[1])]:
                delete(spark, file)
                self.files.remove((spark, file))

    def steady(self, df: DataFrame) -> DataFrame:
        out = steady(df)
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            self.files.append((df.sparkSession, file.get()))
        return out

    def result(self, df: DataFrame) -> DataFrame:
        """df at rest in a checkpoint of its own; the others go, and exchanges that were held on to when the last table was written."""
        out = steady(df)
        for spark, file in self.files:
            delete(spark, file)
        self.files.clear()
        df.sparkSession.sparkContext._jvm.System.gc()
        return out


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def give_back() -> None:
    """Return freed memory to the system. Workers are used again for other stages, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Iterable) -> Iterator:
    """The batches, and when they end, freed memory given back."""
    try:
        yield from batches
    finally:
        give_back()


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a generator over batches, with freed memory given back when it is through and its variables are gone."""

    @functools.wraps(run)
    def through(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most `most` bytes in the column, or one row; freed memory is given back at the end."""
    for batch in tidy(batches):
        yield from pieces(batch, column, most)


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """One batch, cut like that."""
    sizes = np.cumsum(lengths(batch.column(batch.schema.get_field_index(column))))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value; 0 for nulls."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Texts:
    """The bytes of a column of texts (null: empty) with the offset of each."""

    def __init__(self, column: pa.Array | list):
        if isinstance(column, list):
            column = pa.array(column, pa.string())
        column = column.fill_null("")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        raw = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)
        offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if not len(offsets):
            offsets = np.zeros(1, np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1


@functools.lru_cache(1)
def _byte_tables() -> tuple[bytes, bytes]:
    """For bytes.translate(), which needs no index a byte: whether a byte is part of a word, and its lower case."""
    codes = np.arange(256)
    letters = ((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 48) & (codes <= 57)) | (codes >= 128)
    return letters.astype(np.uint8).tobytes(), np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint8).tobytes()


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and byte lengths of the code points that are words of their own."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return lead, lead
    a, b = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    alone = (a >= 0xE3) & (a <= 0xE9)  # kana and Han
    alone |= (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)  # Thai, Lao
    alone |= (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b >= 0x9E) & (b <= 0x9F))  # Burmese, Khmer
    alone |= (a == 0xEF) & ((b >= 0xA4) & (b <= 0xAB) | (b >= 0xBC) & (b <= 0xBE))  # compatibility and full-width forms
    alone |= (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)  # rare Han
    return lead[alone], np.where(a[alone] == 0xF0, 4, 3)


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, kept between batches."""
    global _powers
    if len(_powers[0]) < n:
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        if n > 4 * CHUNK_BYTES:
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of Texts: byte start and end in the buffer, the text each belongs to, and a 64-bit hash."""

    def __init__(self, texts: Texts):
        data, offsets = texts.data, texts.offsets
        self.texts = texts
        letter, lower = _byte_tables()
        raw = data.tobytes()
        inside = np.frombuffer(raw.translate(letter), bool)
        n = len(data)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        bounds = offsets[:-1][offsets[:-1] < n]
        first[bounds] |= inside[bounds]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] |= inside[ends]
        at, size = _characters(data)
        if len(at):
            first[at] = last[at + size - 1] = True
            before, behind = at[at > 0] - 1, (at + size)[at + size < n]
            last[before] |= inside[before]
            first[behind] |= inside[behind]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.counts = np.searchsorted(self.start, offsets[1:]) - np.searchsorted(self.start, offsets[:-1])
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        if not n:
            self.hash = np.zeros(0, np.uint64)
            return
        small = np.frombuffer(raw.translate(lower), np.uint8).astype(np.uint64)
        accented = np.flatnonzero(data[:-1] == 0xC3) + 1
        behind = data[accented]
        small[accented[(behind >= 0x80) & (behind <= 0x9E) & (behind != 0x97)]] += np.uint64(32)
        up, down = _power_tables(n + 1)
        with np.errstate(over="ignore"):
            small += np.uint64(1)
            small *= up[:n]
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(small, out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of k words in a row: (hash, index of the first word, text). short: a text of 1 to k-1 words gives one, of all its words."""
        n = len(self.hash)
        with np.errstate(over="ignore"):
            rows = max(0, n - k + 1)
            value = np.zeros(rows, np.uint64)
            for j in range(k):
                value *= _SHINGLE
                value += self.hash[j : j + rows]
            at = np.flatnonzero(self.text[:rows] == self.text[k - 1 :]) if rows else np.zeros(0, np.int64)
            value, owner = mix(value[at]), self.text[at]
            if short and (few := np.flatnonzero((self.counts > 0) & (self.counts < k))).size:
                extra = np.zeros(len(few), np.uint64)
                for i, t in enumerate(few):
                    for h in self.hash[self.first[t] : self.first[t + 1]]:
                        extra[i] = extra[i] * _SHINGLE + h
                value = np.concatenate([value, mix(extra ^ np.uint64(k))])
                at, owner = np.concatenate([at, self.first[few]]), np.concatenate([owner, few])
                order = np.argsort(owner, kind="stable")
                value, at, owner = value[order], at[order], owner[order]
        return value, at, owner


def unique_grams(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text with their counts, sorted by text and hash."""
    if not len(value):
        return value, owner, np.zeros(0, np.int64)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return value[at], owner[at], np.diff(np.append(at, len(value)))
