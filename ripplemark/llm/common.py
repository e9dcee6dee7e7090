"""Shared helpers: durable intermediates, byte-level text kernels, components.

The kernels work on whole Arrow batches with numpy: text columns are viewed as
one UTF-8 byte buffer with document offsets, so no per-word Python objects are
made.  A batch is cut into slices of at most ``SLICE_BYTES``; one longer
document is a slice of its own, whose words are hashed piece by piece.

Hashes only bring candidates together.  Wherever equality decides a result,
bytes are compared (``same_bytes``, ``representatives``) or a cryptographic
digest stands for them.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sieve import Sieve  # noqa: F401

SLICE_BYTES = 1 << 22
_FOLDERS: dict[int, str] = {}
_SCRATCH: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, where it is unset, a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = id(spark.sparkContext)
    if key not in _FOLDERS:
        _FOLDERS[key] = "file://" + tempfile.mkdtemp(prefix="ripplemark-")
    return _FOLDERS[key]


def _delete(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the JVM is gone
        pass


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder through the cluster's own file system when this process ends."""
    atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside go when it ends, but for those written with keep; those written with out go with the one around it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def give_back() -> None:
    """Freed memory of this process back to the system: a worker that waits for its next task else holds the most that it ever used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What runs inside sends Python at most so many rows at once: a batch of whole texts is held several times, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, keep: bool = False, out: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ripplemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    if _SCRATCH and not keep:
        _SCRATCH[max(0, len(_SCRATCH) - (2 if out else 1))].append(path)
    return spark.read.schema(df.schema).parquet(path)


def rebalance(df: DataFrame, *cols: str) -> DataFrame:
    """Repartition by keys into the session's shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


# ---------------------------------------------------------------- byte kernels

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashes are polynomials modulo this prime, at two bases that no text can be made for in advance to collide often.
_PRIME = (1 << 31) - 1
_BASES = (0x4B7E3A59, 0x2C9F61D3)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) % np.uint64(_PRIME)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any x below 2^64; in place."""
    for _ in range(2):
        high = x >> np.uint64(31)
        x &= np.uint64(_PRIME)
        x += high
    x[x >= _PRIME] -= np.uint64(_PRIME)
    high = x >> np.uint64(31)
    x &= np.uint64(_PRIME)
    x += high
    x[x >= _PRIME] -= np.uint64(_PRIME)
    return x


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers 0 to n - 1 and those of its inverse."""
    if not _POWERS or _POWERS[0][0].size < n:
        size = max(n, 1 << 16)
        out = []
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, _PRIME)):
                have = np.ones(1, np.uint64)
                while have.size < size:  # twice as many from those known
                    have = np.concatenate([have, _reduced(have * np.uint64(pow(b, have.size, _PRIME)))])
                both.append(have[:size].astype(np.uint32))
            out.append(tuple(both))
        _POWERS[:] = out
    return _POWERS


class Hasher:
    """62-bit hashes of any byte ranges of one buffer, from two prefix sums."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        table = (_LOWER if lower else _BYTE)[data]
        self.parts = []
        for power, inverse in _powers(data.size + 1):
            terms = table * power[: data.size]
            high = terms >> np.uint64(31)
            terms &= np.uint64(_PRIME)
            terms += high  # below 2^32, so that sums of 2^32 of them are exact
            sums = np.zeros(data.size + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.parts.append((sums, inverse))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        (a, a_back), (b, b_back) = self.parts
        x = _reduced(_reduced(a[ends] - a[starts]) * a_back[starts])
        y = _reduced(_reduced(b[ends] - b[starts]) * b_back[starts])
        return mix64((x << np.uint64(32) | y) ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """For each pair of places, whether sizes bytes of data at left equal those of other (data, if None) at right."""
    other = data if other is None else other
    out = np.ones(sizes.size, bool)
    upto = np.cumsum(sizes)
    low = 0
    while low < sizes.size:
        before = upto[low] - sizes[low]
        high = max(low + 1, int(np.searchsorted(upto, before + (1 << 20), "right")))
        s, some = sizes[low:high], slice(low, high)
        if high == low + 1:
            out[low] = bool((data[left[low] : left[low] + s[0]] == other[right[low] : right[low] + s[0]]).all())
        else:
            begin = upto[some] - s - before
            step = np.arange(int(s.sum())) - np.repeat(begin, s)
            differ = data[np.repeat(left[some], s) + step] != other[np.repeat(right[some], s) + step]
            sums = np.concatenate([[0], np.cumsum(differ)])
            out[some] = sums[begin + s] == sums[begin]
        low = high
    return out


def representatives(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct string, number of each string): exact, whatever the keys (their hashes) say."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    lead = first[back]
    look = np.flatnonzero(lead != np.arange(keys.size))
    equal = ends[look] - starts[look] == ends[lead[look]] - starts[lead[look]]
    text = data
    if lower:
        text = data.copy()
        text[(data >= 65) & (data <= 90)] += 32
    at = look[equal]
    equal[equal] = same_bytes(text, starts[at], starts[lead[at]], ends[at] - starts[at])
    odd = look[~equal]
    if odd.size:  # strings of one hash that differ: by their bytes
        known: dict[bytes, int] = {}
        extra = []
        for i in odd.tolist():
            raw = text[starts[i] : ends[i]].tobytes()
            if raw not in known:
                known[raw] = first.size + len(extra)
                extra.append(i)
            back[i] = known[raw]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, back


def byte_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low, n = 0, len(column)
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of other than ASCII white space), and each document's word offsets."""
    n = data.size
    inside = ~_SPACES[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    border[0] = border[n] = True
    left = inside.copy()
    left[1:] &= ~inside[:-1] | border[1:n]
    right = inside.copy()
    right[:-1] &= ~inside[1:] | border[1:n]
    starts = np.flatnonzero(left)
    return starts, np.flatnonzero(right) + 1, np.searchsorted(starts, offsets)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, most: int = SLICE_BYTES) -> np.ndarray:
    """Hashes of ranges that follow one another, in pieces of about most bytes; a longer range is digested."""
    out = np.empty(starts.size, np.uint64)
    low = 0
    while low < starts.size:
        if ends[low] - starts[low] > most:
            raw = data[starts[low] : ends[low]].tobytes()
            out[low] = int.from_bytes(hashlib.blake2b(raw.lower() if lower else raw, digest_size=8).digest(), "little")
            low += 1
            continue
        high = int(np.searchsorted(ends, starts[low] + most, "right"))
        a, b = starts[low], ends[high - 1]
        out[low:high] = Hasher(data[a:b], lower)(starts[low:high] - a, ends[low:high] - a)
        low = high
    return out


def shingles(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k-word shingle; a document of fewer words has its whole sequence as one."""
    n = words.size
    document = np.repeat(np.arange(firsts.size - 1), np.diff(firsts))
    if n == 0:
        return np.zeros(0, np.uint64), document
    factor = np.uint64(0xC2B2AE3D27D4EB4F)
    total, out = np.zeros(n, np.uint64), None
    for j in range(k):
        if j < n:
            total[: n - j] = total[: n - j] * factor + words[j:]
    full = np.zeros(n, bool)
    if n >= k:
        full[: n - k + 1] = document[: n - k + 1] == document[k - 1 :]
    counts = np.diff(firsts)
    out, owner = mix64(total[full] ^ np.uint64(k)), document[full]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if short.size:
        extra = np.zeros(short.size, np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] = extra[has] * factor + words[firsts[short[has]] + j]
        extra = mix64(extra ^ (counts[short].astype(np.uint64) + np.uint64(1 << 32)))
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


# ------------------------------------------------------------------ components


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the least node reached.

    Alternating large-star and small-star contraction: every round is two
    shuffles keyed on a node, each with map-side minima, and ends when no edge
    changes.  Nothing but a changed flag and a count reaches the driver.
    Empty input gives an empty result; loops and repeated edges are harmless;
    edges with a null end are ignored.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(now.filter("a is not null and b is not null and a > b").distinct(), name)
    while True:
        # large star: larger neighbours of u point to u's least neighbour (or u)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = materialize(small.filter("a > b").distinct(), name)
        same = now.count() == after.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        now = after
        if same:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
