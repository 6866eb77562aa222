"""What the text operators share: reading, stored steps, words as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchkeep.session import checkpoint_folder, tune

U64 = np.uint64
# White space of the word pattern [^\x20\x09-\x0D]+.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
# Constants of the splitmix64 finaliser, and an odd multiplier for rolling hashes.
MIX_A, MIX_B, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
BASE = U64(0x5851F42D4C957F2D)
BASE_INVERSE = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
CHUNK_BYTES = 2_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the text operators: small Arrow batches, as texts can be long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows, read from a table written to the shared folder.

    The plan is cut there, and lost executors take nothing of it along.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


_powers = {"n": 0, "up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            row = np.full(size, base, U64)
            row[0] = 1
            _powers[key] = np.cumprod(row, dtype=U64)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BYTE_CODE = mix((np.arange(256, dtype=U64) + U64(1)) * GOLDEN)


class Words:
    """Words of consecutive texts: hashes, and where each text's words begin.

    ``first[i]:first[i + 1]`` are the words of text i; A-Z is lower-cased.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        inside = ~_IS_SPACE[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        before[cut] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``most`` bytes.

    Texts stay whole: a longer one makes a chunk of its own.  Nulls are empty.
    """
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    count = len(array)
    if not count:
        return
    _, places, content = array.buffers()
    offsets = np.frombuffer(places, np.int64)[array.offset: array.offset + count + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    row = 0
    while row < count:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together until they have ``least`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def arrow(fn: Callable, df: DataFrame, schema: str, least: int = 0) -> DataFrame:
    """Apply ``fn(batch)``, which yields dictionaries of columns, to every batch, of ``least`` bytes if there are as many."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        for batch in merged(batches, least):
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays([_array(columns[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _array(values) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values
    if isinstance(values, np.ndarray) and values.dtype == U64:
        values = values.view(np.int64)
    return pa.array(values)
