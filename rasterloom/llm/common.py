"""Helpers shared by the operators: lineage cuts, text kernels, 64-bit mixing."""

from __future__ import annotations

import ctypes
import gc
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rasterloom.plans.cache import cut, shared_folder  # noqa: F401

U64 = np.uint64
#: Odd multipliers of the 64-bit finaliser.
M1, M2, M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_counting(df: DataFrame, condition: Column | None = None, **known: int) -> tuple[DataFrame, int]:
    """``cut`` (with what is ``known`` for it), and how many rows there are (that meet a condition), counted on the way."""
    seen = Observation()
    out = cut(df.observe(seen, (F.count("*") if condition is None else F.count_if(condition)).alias("n")), **known)
    return out, seen.get["n"]


def limited(df: DataFrame, n: int, most: int) -> DataFrame:
    """Marked for broadcast if its ``n`` counted rows are few enough."""
    return F.broadcast(df) if n <= most else df


_held: dict = {"owner": None, "made": {}}


def held(key, make: Callable):
    """What ``make`` gives, kept in this worker for the next tasks of the same operator."""
    made = _held["made"]
    if key not in made:
        made[key] = make()
    return made[key]


def trim() -> None:
    """Gives freed memory back to the system; workers live as long as the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def enter(owner: str) -> None:
    """Drops what another operator's tasks have kept in this worker."""
    if _held["owner"] != owner:
        _held.update(owner=owner, made={})
        trim()


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` that holds little memory.

    Batches have 4 MB at most where the session keeps Spark's 64 MB, and a
    worker drops what another operator's tasks have kept in it.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name).rstrip("b") == str(64 << 20):
        conf.set(name, 4 << 20)
    owner = f.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)  # by its name: what is shipped with a task is a copy, and so is what it refers to
        yield from f(batches)
        trim()

    return df.mapInArrow(run, schema)


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= M1
    x ^= x >> U64(27)
    x *= M2
    x ^= x >> U64(31)
    return x


def salt(n: int) -> np.uint64:
    """A 64-bit constant for each number."""
    return U64((n * int(M3)) & 0xFFFFFFFFFFFFFFFF)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def small(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` has near ``most`` bytes, so that a task's memory doesn't grow with the length of texts."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(total):
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most)) + 1
            yield b.slice(begin, end - begin)
            begin = end


def strings(column) -> list[str]:
    """Column of an Arrow batch as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def emit(schema: pa.Schema, columns: dict) -> Iterable[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text begins (plus the end)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4"), ends


_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point to its lower-case code point if it can stand in a word (letter, digit, mark), else 0."""
    global _fold
    if _fold is None:
        out = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(0x32000):
            c = chr(i)
            if c.isalnum() or (i >= 0x300 and unicodedata.category(c)[0] == "M"):
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _fold = out
    return _fold


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (maximal run of letters, digits and marks, lower-cased) and the words' bounds by text."""
    code, ends = codepoints(texts)
    folded = fold_table()[code]
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = ends[:-1][ends[:-1] < len(code)]
    first[at] = inside[at]
    begins = np.flatnonzero(first)
    bounds = np.searchsorted(begins, ends)
    if not len(begins):
        return np.zeros(0, U64), bounds
    chars = folded[inside].astype(U64)
    starts = np.flatnonzero(first[inside])
    lengths = np.diff(starts, append=len(chars))
    place = (np.arange(len(chars)) - np.repeat(starts, lengths)).astype(U64)
    chars *= M3
    chars += place * M2
    chars ^= chars >> U64(29)
    chars *= M1
    chars ^= chars >> U64(32)
    return mix(np.add.reduceat(chars, starts) + lengths.astype(U64)), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words and the runs' bounds by text.

    A text with fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(bounds)
    out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    to = np.zeros(len(out) + 1, np.int64)
    np.cumsum(out, out=to[1:])
    text = np.repeat(np.arange(len(out)), out)
    at = np.arange(to[-1]) - to[text] + bounds[:-1][text]
    limit = bounds[1:][text]
    value = np.zeros(len(at), U64)
    for k in range(width):
        here = at + k
        there = here < limit
        part = np.zeros(len(at), U64)
        part[there] = hashes[here[there]]
        value = (value ^ part) * M3
        value ^= value >> U64(32)
    return mix(value), to
