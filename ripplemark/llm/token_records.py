"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard is two files in the shared folder: ``tokens-<part>.rec`` and
``tokens-<part>.idx``.  A record is

    length u64 | masked checksum of these 8 bytes u32 | payload | masked checksum of the payload u32

(little-endian) and its payload is ``has_id u8 | doc_id i64 | ids``, where ids
are u16 if the vocabulary has at most 65,536 entries and u32 otherwise.  The
index has a ``offset u64 | length u64 | n_tokens u64`` for each record.  Shards
are ranges of doc_id in order, and a shard's records are in order of doc_id.
Files are written under another name and renamed, so a task that runs twice
leaves one whole file.  There is a shard for every ``PART_ROWS`` rows, and one
a shuffle partition at least.

A null text is empty: its record holds only the end id.  Null ids come first;
rows with equal ids are in order of their texts' hashes, and if there are many
of them they are dealt over several shards; an empty table has no shard; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, delete_at_exit, hash_ranges, representatives, same_bytes, shared_dir

END_ID = 2
PART_ROWS = 500_000
#: Distinct pieces that an encoder keeps between slices.
MOST_PIECES = 1_000_000
_ENCODERS: dict[str, BatchEncoder] = {}
_INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8")])


def masked(raw: bytes) -> int:
    """Checksum turned by 15 bits and shifted by a constant, so that data that hold checksums stay checkable."""
    crc = zlib.crc32(raw)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(raw: bytes) -> bytes:
    """The payload of one record; ValueError if a length or checksum is wrong."""
    if len(raw) < 16 or masked(raw[:8]) != struct.unpack_from("<I", raw, 8)[0]:
        raise ValueError("the record's length is damaged")
    (size,) = struct.unpack_from("<Q", raw)
    payload = raw[12 : 12 + size]
    if len(raw) != size + 16 or masked(payload) != struct.unpack_from("<I", raw, 12 + size)[0]:
        raise ValueError("the record's payload is damaged")
    return payload


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), urlsplit(uri).path) if urlsplit(uri).scheme in ("", "file") else fs.FileSystem.from_uri(uri)


# -------------------------------------------------------------------- encoding


class BatchEncoder:
    """Ids of many texts at once with a byte-level vocabulary file of the tokenizers library.

    Before a blank that follows a character other than white space and is
    followed by one, a pre-token always begins.  Texts are cut there; each
    distinct piece of a slice is encoded once, in one long text of pieces, and
    the ids are dealt out by the pieces' byte lengths.  Pieces are the same if
    their bytes are; hashes only find them.  The library matches the
    vocabulary's added tokens before it makes pre-tokens, so a text that holds
    one is not cut but encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        if any(b" " in t for t in self.added):
            raise ValueError("an added token holds a blank, where texts are cut")
        size = self.library.get_vocab_size()
        self.lengths = np.array([len(self.library.id_to_token(k) or "") for k in range(size)], np.int64)
        self.size = size
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.size_of, self.spot, self.raw, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint8), 0

    def _library(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, the ids), from one text of all pieces in a row."""
        sizes = ends - starts
        upto = np.cumsum(sizes)
        where = np.arange(upto[-1]) + np.repeat(starts - (upto - sizes), sizes)
        long = self.library.encode_batch_fast(["x" + data[where].tobytes().decode()], add_special_tokens=False)[0].ids
        found = np.array(long, np.int32)[1:]
        covered = np.cumsum(self.lengths[found])
        last = np.searchsorted(covered, upto)  # token that ends each piece
        if (covered[last] != upto).any():
            raise AssertionError("a token crosses pieces")
        return np.diff(np.concatenate([[-1], last])), found

    def _pieces(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, place in the pool) of different pieces with their hashes; new ones are encoded and kept."""
        if self.keys.size > MOST_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        old = np.flatnonzero(at < self.keys.size)
        old = old[self.keys[at[old]] == keys[old]]
        same = self.size_of[at[old]] == ends[old] - starts[old]
        same[same] = same_bytes(data, starts[old[same]], self.spot[at[old[same]]], ends[old[same]] - starts[old[same]], self.raw)
        number, place = np.zeros(keys.size, np.int64), np.zeros(keys.size, np.int64)
        number[old[same]], place[old[same]] = self.count[at[old[same]]], self.place[at[old[same]]]
        new = np.ones(keys.size, bool)
        new[old[same]] = False
        pick = np.flatnonzero(new)
        if pick.size:
            counts, found = self._library(data, starts[pick], ends[pick])
            number[pick], place[pick] = counts, np.cumsum(counts) - counts + self.pool.size
            self.pool = np.concatenate([self.pool, found])
            # one piece of each hash is kept
            fresh = np.ones(keys.size, bool)
            fresh[old] = False
            keep = pick[fresh[pick]]
            keep = keep[np.unique(keys[keep], return_index=True)[1]]
            sizes = ends[keep] - starts[keep]
            upto = np.cumsum(sizes)
            total = int(upto[-1]) if keep.size else 0
            while self.used + total > self.raw.size:
                self.raw = np.concatenate([self.raw, np.zeros(self.raw.size, np.uint8)])
            self.raw[self.used : self.used + total] = data[np.arange(total) + np.repeat(starts[keep] - (upto - sizes), sizes)]
            spot = np.searchsorted(self.keys, keys[keep])
            for name, values in (("keys", keys[keep]), ("place", place[keep]), ("count", number[keep]), ("size_of", sizes), ("spot", self.used + upto - sizes)):
                setattr(self, name, np.insert(getattr(self, name), spot, values))
            self.used += total
        return number, place

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each text's offset in them)."""
        n = data.size
        if not n:
            return np.zeros(0, np.int64), np.zeros(offsets.size, np.int64)
        # by bytes: white space here is any ASCII space or control, or a lead byte that may begin Unicode white space
        dull = (data <= 0x20) | (data == 0x7F) | (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        tail = (data & 0xC0) == 0x80
        cut = np.zeros(n + 1, bool)
        cut[1 : n - 1] = (data[1 : n - 1] == 0x20) & ~dull[:-2] & ~tail[:-2] & ~dull[2:]
        # after a letter of two bytes that is no white space (lead bytes C3 to DF)
        if n > 3:
            cut[2 : n - 1] |= (data[2 : n - 1] == 0x20) & tail[1:-2] & (data[:-3] >= 0xC3) & (data[:-3] <= 0xDF) & ~dull[3:]
        ends_doc = np.zeros(n + 1, bool)
        ends_doc[offsets] = True
        cut[:-1] &= ~ends_doc[1:]  # a blank at the end of a text is no cut
        cut |= ends_doc
        cut[0], cut[n] = True, True
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[row + 1]  # else the end of one text and the begin of the next
                if inside:
                    cut[offsets[row] + 1 : offsets[row + 1]] = False
                at = raw.find(token, int(offsets[row + 1]) if inside else at + 1)
        marks = np.flatnonzero(cut)
        starts, ends = marks[:-1], marks[1:]
        # a piece without a blank before it (a text's first) may not follow another one in the long text
        fresh = data[starts] != 0x20
        fresh |= ends_doc[starts]
        ids = [np.zeros(0, np.int32)]
        counts = np.zeros(starts.size, np.int64)
        begin = np.zeros(starts.size, np.int64)
        at = 0
        whole = np.flatnonzero(fresh)
        if whole.size:
            got = self.library.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True)], add_special_tokens=False)
            parts = [e.ids for e in got]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            counts[whole], begin[whole] = sizes, np.cumsum(sizes) - sizes
            ids.append(np.array([i for p in parts for i in p], np.int32))
            at = int(sizes.sum())
        rest = np.flatnonzero(~fresh)
        if rest.size:
            keys = hash_ranges(data, starts[rest], ends[rest])
            first, back = representatives(data, starts[rest], ends[rest], keys)
            sizes, places = self._pieces(keys[first], data, starts[rest[first]], ends[rest[first]])
            counts[rest], begin[rest] = sizes[back], places[back] + at
            ids.append(self.pool)
        pool = np.concatenate(ids)
        after = np.cumsum(counts)
        out = pool[np.arange(after[-1]) + np.repeat(begin - (after - counts), counts)]
        return out, np.concatenate([[0], after])[np.searchsorted(starts, offsets)]


def encoder_of(path: str) -> BatchEncoder:
    """A worker's encoder, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


# --------------------------------------------------------------------- writing


def _range_parts(docs: DataFrame, id_col: str, least: int) -> tuple[int, int, list[float], dict[int, int]]:
    """(parts, those of null ids, bounds between the others, for each part a number that hash partitioning sends there).

    Bounds are quantiles; an id that many rows have is a bound several times.
    """
    spark = docs.sparkSession
    rows, known = docs.agg(F.count("*"), F.count(id_col)).first()
    n = max(least, -(-rows // PART_ROWS))
    empty = (rows - known) * n // max(rows, 1)
    bounds = sorted(docs.select(F.col(id_col).cast("double").alias("v")).approxQuantile("v", [k / (n - empty) for k in range(1, n - empty)], 0.2 / n)) if n - empty > 1 and known else []
    place: dict[int, int] = {}
    for k, p in spark.range(40 * n).select("id", F.pmod(F.hash("id"), F.lit(n))).collect():
        place.setdefault(p, k)
    return n, empty, bounds, place


def write_records(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode docs and write their shards; (part, records, tokens) of each shard. One job runs when it is used."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, empty, bounds, place = _range_parts(docs, "id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rows of one id that is a bound several times are dealt over its parts in order of their texts' hashes
    share = F.xxhash64("text") / F.lit(2.0**64) + 0.5
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    before, upto = (F.size(F.filter(edges, t)) for t in (lambda b: b < F.col("id").cast("double"), lambda b: b <= F.col("id").cast("double")))
    part = F.when(F.col("id").isNull(), F.floor(share * (empty + 1))).otherwise(empty + before + F.floor(share * (upto - before + 1)))
    keys = F.array(*[F.lit(place.get(k, k)).cast("long") for k in range(n)])
    dealt = docs.withColumn("part", F.least(part, F.lit(n - 1)).cast("int")).withColumn("deal", F.element_at(keys, F.col("part") + 1)).repartition(n, "deal")
    dealt = dealt.sortWithinPartitions(F.col("part"), F.col("id").asc_nulls_first(), F.xxhash64("text"), "text").select("part", "id", "text")

    def write(batches):
        encoder = encoder_of(tokenizer)
        kind = np.dtype("<u2" if encoder.size <= 1 << 16 else "<u4")
        tail = np.array([end_id], kind).tobytes()
        files, sums = None, None

        def close():
            (system, name), out, index, stamp = files
            out.close()
            with system.open_output_stream(f"{name}.idx.{stamp}") as f:
                f.write(np.array(index, _INDEX).tobytes())
            for end in ("idx", "rec"):
                system.move(f"{name}.{end}.{stamp}", f"{name}.{end}")
            return pa.RecordBatch.from_pydict({"part": pa.array([sums[0]], pa.int32()), "records": [sums[1]], "tokens": [sums[2]]})

        for batch in batches:
            parts, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for low, _, data, offsets in byte_slices(batch.column(2), 1 << 22):
                ids, upto = encoder.encode(data, offsets)
                raw = memoryview(ids.astype(kind).tobytes())
                for row in range(offsets.size - 1):
                    own = int(parts[low + row])
                    if files is None or sums[0] != own:
                        if files is not None:
                            yield close()
                        system, name = _opened(f"{folder}/tokens-{own:06d}")
                        stamp = uuid.uuid4().hex
                        files, sums = ((system, name), system.open_output_stream(f"{name}.rec.{stamp}"), [], stamp), [own, 0, 0]
                        offset = 0
                    key = keys[low + row]
                    a, b = int(upto[row]), int(upto[row + 1])
                    record = frame(struct.pack("<Bq", key is not None, key or 0) + bytes(raw[a * kind.itemsize : b * kind.itemsize]) + tail)
                    files[1].write(record)
                    files[2].append((offset, len(record), b - a + 1))
                    offset += len(record)
                    sums[1] += 1
                    sums[2] += b - a + 1
        if files is not None:
            yield close()

    system, name = _opened(folder)
    system.create_dir(name, recursive=True)
    return dealt.mapInArrow(write, "part int, records long, tokens long")


def read_index(folder: str, part: int) -> np.ndarray:
    system, name = _opened(f"{folder}/tokens-{part:06d}.idx")
    with system.open_input_stream(name) as f:
        return np.frombuffer(f.read(), _INDEX)


def read_records(folder: str, part: int, vocabulary: int, which: list[int] | None = None):
    """(id or None, ids) of a shard's records, in the order of which (all, in order, by default)."""
    index = read_index(folder, part)
    system, name = _opened(f"{folder}/tokens-{part:06d}.rec")
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    with system.open_input_file(name) if which is not None else system.open_input_stream(name, buffer_size=1 << 20) as f:
        for k in range(len(index)) if which is None else which:
            size = int(index[k]["length"])
            if which is not None:
                f.seek(int(index[k]["offset"]))
            payload = unframe(f.read(size))
            known, key = struct.unpack_from("<Bq", payload)
            yield (key if known else None), np.frombuffer(payload, kind, offset=9)


def token_records(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write docs as records and read them back: id, start, n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    if folder is None:
        folder = f"{shared_dir(spark)}/ripplemark/records-{uuid.uuid4().hex}"
        delete_at_exit(spark, folder)
    shards = write_records(docs, folder, tokenizer, id_col, text_col, end_id).collect()  # a row a shard
    if not shards:
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long")
    before, rows = 0, []
    for part, _, tokens in sorted(tuple(r) for r in shards):
        rows.append((part, before))
        before += tokens
    vocabulary = encoder_of(tokenizer).size

    def read(batches):
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = ([], [], [], [])
                for key, ids in read_records(folder, part, vocabulary):
                    for column, value in zip(out, (key, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(value)
                    start += ids.size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[id_col, "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "part int, start long")
    return listed.mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
