"""SentencePiece encoding and decoding with a max-plus scan over giant documents.

A document longer than ``CHUNK`` characters is cut into chunks.  The state at a
cut is the place, among so many places after it as the longest piece has
characters, where a token ends.  A chunk's transfer matrix holds, for each
(place it begins, place it ends), the best score of its tokens with the first
and the last of them; the product of two matrices is max-plus, with minus
infinity where the two tokens that meet would be merged.  Products are
associative; the scan gives each cut's place, and every chunk's ids are then
put together on their own.

This equals encoding the whole: a sequence of pieces is the encoding of its
text exactly if each two neighbours encode to themselves, so there is one path
of finite weight.  For the same reason a chunk is encoded once, and for other
places at its ends only as far as the encodings run together again.  Models
that normalise text, lack byte pieces, or have pieces across a blank that
follows another character, are encoded uncut.

A null or empty text has no tokens and decodes to an empty text; rows with
equal ids (or null ones) are encoded one by one; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CHUNK = 65_536
WINDOW = 256
DECODED = 1 << 16
_CODECS: dict[str, Codec] = {}


class Codec:
    """A model file, with and without the blank that it puts before a text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        self.prefix = spec.add_dummy_prefix
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        proto.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = [p.piece for p in proto.pieces]
        self.longest = max(map(len, pieces))
        self.scores = np.array([p.score for p in proto.pieces])
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.cuttable = plain and self.apart and proto.trainer_spec.byte_fallback
        self.pieces = pieces
        value = np.array([int(p[3:5], 16) if self.inner.is_byte(i) else 0 for i, p in enumerate(pieces)])
        #: Whether a piece is a byte inside a character; characters that end with a piece, of which a byte's count at its first.
        self.later = (value & 0xC0) == 0x80
        self.lengths = np.array([0 if c else 1 if self.inner.is_byte(i) else len(p) for i, (p, c) in enumerate(zip(pieces, self.later, strict=True))], np.int64)
        self.bytes_or_unknown = np.array([self.inner.is_byte(i) or self.inner.is_unknown(i) for i in range(len(pieces))])
        self.meets = lru_cache(1 << 16)(self._meets)

    def _meets(self, a: int, b: int) -> bool:
        """Whether b may follow a: neither merges into the other."""
        if self.bytes_or_unknown[a] or self.bytes_or_unknown[b]:
            return True
        return self.inner.encode((self.pieces[a] + self.pieces[b]).replace("▁", " ")) == [a, b]

    def encode(self, text: str, first: bool = True) -> list[int]:
        return (self.whole if first else self.inner).encode(text)

    def tokens(self, text: str, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, the place in text where each ends, whether a character ends there)."""
        ids = np.array(self.encode(text, first), np.int32)
        ends = np.cumsum(self.lengths[ids]) - (first and self.prefix)
        if len(text) and ends[-1] != len(text):
            raise AssertionError("pieces do not cover the text")
        fine = np.ones(ids.size, bool)
        fine[:-1] = ~self.later[ids[1:]]
        return ids, ends, fine

    def decode(self, ids: np.ndarray, most: int = DECODED) -> str:
        """The text of ids, of many of them piece by piece."""
        cuts = [0]
        while len(ids) - cuts[-1] > most:
            at = cuts[-1] + most
            while at < len(ids) and self.bytes_or_unknown[ids[at]]:
                at += 1
            cuts.append(at)
        parts = zip(cuts, [*cuts[1:], len(ids)], strict=True)
        return "".join((self.inner if a else self.whole).decode(ids[a:b].tolist()) for a, b in parts)


def codec_of(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


@dataclass(frozen=True)
class Entry:
    """A matrix cell: score, first and last token, and the places chosen inside."""

    score: float
    first: int
    last: int
    inside: tuple[int, ...] = ()


def cut_states(text: str, codec: Codec, size: int = CHUNK) -> list[list[int]]:
    """The places of each cut, with [0] and [len(text)] at the ends."""
    states, n, at = [[0]], len(text), size
    while codec.cuttable and at + codec.longest < n:
        # a token ends among any `longest` places in a row; inside a run of blanks none is tried
        inside = [q for q in range(at, at + codec.longest) if text[q] in " ▁" and text[q - 1] in " ▁"]
        if inside:
            at = inside[0] + 1
            while at < n and text[at] in " ▁":
                at += 1
            continue
        states.append(list(range(at, at + codec.longest)))
        at += codec.longest - 1 + size
    return [*states, [n]]


class Chunk:
    """The encodings of a chunk for all places it may begin and end at; text starts at place begin of the document."""

    def __init__(self, text: str, begin: int, ins: list[int], outs: list[int], codec: Codec, window: int = WINDOW):
        at = lambda p, q: codec.tokens(text[p - begin : q - begin], p == 0)
        low, high = ins[0], outs[-1]
        self.base, ends, fine = at(low, high)
        fine &= ends > 0
        places, follows = ends[fine] + low, np.flatnonzero(fine) + 1  # of places where a token ends: the next token

        def from_place(p: int) -> tuple[np.ndarray, int]:
            """(ids up to where the encodings meet, the base's next token)."""
            size = window
            while True:
                q = min(p + size, high)
                ids, ends, fine = at(p, q)
                _, i, j = np.intersect1d(np.where(fine & (ends > 0), ends + p, -1), places, return_indices=True)
                for x, y in zip(i.tolist(), follows[j].tolist(), strict=True):
                    if y == self.base.size or codec.meets(int(ids[x]), int(self.base[y])):
                        return ids[: x + 1], y
                if q == high:
                    return ids, self.base.size
                size *= 2

        def up_to_place(q: int) -> tuple[int, np.ndarray]:
            """(number of the base's tokens that stay, ids from there on)."""
            size = window
            while True:
                p = max(q - size, low)
                ids, ends, fine = at(p, q)
                if p == low:
                    return 0, ids
                _, i, j = np.intersect1d(np.where(fine & (ends > 0), ends + p, -1), places, return_indices=True)
                for x, y in zip(i[::-1].tolist(), follows[j[::-1]].tolist(), strict=True):
                    if x + 1 == ids.size or codec.meets(int(self.base[y - 1]), int(ids[x + 1])):
                        return y, ids[x + 1 :]
                size *= 2

        nothing = np.zeros(0, np.int32)
        self.left = {p: (nothing, 0) if p == low else from_place(p) for p in ins}
        self.right = {q: (self.base.size, nothing) if q == high else up_to_place(q) for q in outs}
        # where the two ends overlap, or don't fit together, the whole is encoded
        self.whole = {}
        for p, (head, j) in self.left.items():
            for q, (m, tail) in self.right.items():
                if p < q and (j > m or j == m and head.size and tail.size and not codec.meets(int(head[-1]), int(tail[0]))):
                    self.whole[p, q] = at(p, q)[0]

    def ids(self, p: int, q: int) -> np.ndarray:
        if (p, q) in self.whole:
            return self.whole[p, q]
        (head, j), (m, tail) = self.left[p], self.right[q]
        return np.concatenate([head, self.base[j:m], tail])

    def entries(self, codec: Codec) -> dict[tuple[int, int], Entry]:
        """The transfer matrix."""
        sums = np.concatenate([[0.0], np.cumsum(codec.scores[self.base])])
        score = lambda ids: float(codec.scores[ids].sum())
        out = {}
        for p, (head, j) in self.left.items():
            for q, (m, tail) in self.right.items():
                if p >= q:
                    continue
                if (p, q) in self.whole:
                    ids = self.whole[p, q]
                    out[p, q] = Entry(score(ids), int(ids[0]), int(ids[-1]))
                    continue
                parts = [x for x in (head, self.base[j:m], tail) if x.size]
                out[p, q] = Entry(score(head) + float(sums[m] - sums[j]) + score(tail), int(parts[0][0]), int(parts[-1][-1]))
        return out


def matrix(text: str, begin: int, ins: list[int], outs: list[int], codec: Codec) -> dict[tuple[int, int], Entry]:
    """Transfer matrix of a chunk."""
    return Chunk(text, begin, ins, outs, codec).entries(codec)


def combine(a: dict, b: dict, codec: Codec) -> dict:
    """Max-plus product of two matrices."""
    out: dict = {}
    for (p, q), x in a.items():
        for (q2, r), y in b.items():
            if q == q2 and codec.meets(x.last, y.first):
                joined = Entry(x.score + y.score, x.first, y.last, (*x.inside, q, *y.inside))
                if (p, r) not in out or out[p, r].score < joined.score:
                    out[p, r] = joined
    return out


def scan(matrices: list[dict], codec: Codec) -> list[int]:
    """Places of all cuts, by a balanced product."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2], codec) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    (entry,) = matrices[0].values()
    return list(entry.inside)


def _packed(ids) -> bytes:
    return np.asarray(ids, "<i4").tobytes()


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """id, n_chunks and ids (i32, little-endian, packed in binary) of every document."""
    docs = docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    long = F.coalesce(F.char_length(text_col), F.lit(0)) > size

    def short(batches):
        codec = codec_of(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = codec.whole.encode([t or "" for t in part.column(1).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([1] * len(found), pa.int64()), pa.array([_packed(x) for x in found], pa.binary())], names=[id_col, "n_chunks", "ids"])

    def chunks(batches):
        codec = codec_of(model)
        for batch in batches:
            for key, row, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                states = cut_states(text, codec, size)
                for k, (ins, outs) in enumerate(zip(states, states[1:], strict=False)):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.array([row]), pa.array([k], pa.int64()), pa.array([ins], pa.list_(pa.int64())), pa.array([outs], pa.list_(pa.int64())), pa.array([text[ins[0] : outs[-1]]])], names=["id", "row", "chunk", "ins", "outs", "text"])

    def cells(batches):
        codec = codec_of(model)
        for batch in batches:
            for i, (row, k, ins, outs, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                chunk = Chunk(text, ins[0], ins, outs, codec)
                found = chunk.entries(codec)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([row]), pa.array([k]), pa.array([[[p, q, e.first, e.last] for (p, q), e in found.items()]], pa.list_(pa.list_(pa.int64()))), pa.array([[e.score for e in found.values()]], pa.list_(pa.float64())), pa.array([pickle.dumps(chunk)], pa.binary())], names=["id", "row", "chunk", "cells", "scores", "held"])

    def places(table: pa.Table) -> pa.Table:
        codec = codec_of(model)
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        inside = scan([{(p, q): Entry(s, a, b) for (p, q, a, b), s in zip(r["cells"], r["scores"], strict=True)} for r in rows], codec)
        first = [rows[0]["cells"][0][0], *inside]
        last = [*inside, rows[-1]["cells"][0][1]]
        return pa.table({"row2": [r["row"] for r in rows], "chunk2": [r["chunk"] for r in rows], "p": pa.array(first, pa.int64()), "q": pa.array(last, pa.int64())})

    def chosen(batches):
        for batch in batches:
            got = [_packed(pickle.loads(held).ids(p, q)) for held, p, q in zip(*(batch[c].to_pylist() for c in ("held", "p", "q")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["row"], batch["chunk"], pa.array(got, pa.binary())], names=["id", "row", "chunk", "ids"])

    def in_a_row(batches):
        for batch in batches:
            got = [b"".join(x["ids"] for x in sorted(parts, key=lambda x: x["chunk"])) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column(1)], pa.int64()), pa.array(got, pa.binary())], names=[id_col, "n_chunks", "ids"])

    # a row's key: rows alike in id and text are numbered
    giant = docs.filter(long).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    giant = giant.groupBy("id", "text").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    key = F.to_json(F.struct("id", F.xxhash64("text").alias("h"), "k"), {"ignoreNullFields": "false"})
    cut = giant.select("id", key.alias("row"), "text").mapInArrow(chunks, f"id {kind}, row string, chunk long, ins array<long>, outs array<long>, text string")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.repartition(n, "row", "chunk")
    found = materialize(cut.mapInArrow(cells, f"id {kind}, row string, chunk long, cells array<array<long>>, scores array<double>, held binary"), "sentencepiece-cells")
    place = found.select("row", "chunk", "cells", "scores").groupBy("row").applyInArrow(places, "row2 string, chunk2 long, p long, q long")
    parts = found.join(place, (F.col("row") == F.col("row2")) & (F.col("chunk") == F.col("chunk2"))).select("id", "row", "chunk", "held", "p", "q")
    parts = parts.mapInArrow(chosen, f"id {kind}, row string, chunk long, ids binary")
    whole = parts.groupBy("row", "id").agg(F.collect_list(F.struct("chunk", "ids")).alias("parts")).select("id", "parts").mapInArrow(in_a_row, f"{id_col} {kind}, n_chunks long, ids binary")
    small = docs.filter(~long).mapInArrow(short, f"{id_col} {kind}, n_chunks long, ids binary")
    return small.unionByName(whole)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of encoded documents."""
    encoded = encoded.select(id_col, ids_col)

    def rows(batches):
        codec = codec_of(model)
        for batch in batches:
            texts = [codec.decode(np.frombuffer(b or b"", "<i4")) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.mapInArrow(rows, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string")


def digest(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_chunks, n_tokens, ids_crc32 (of the ids as u32), decoded_bytes and decoded_crc32 of encoded documents."""

    def rows(batches):
        codec = codec_of(model)
        for batch in batches:
            raw = batch.column(2).to_pylist()
            texts = [codec.decode(np.frombuffer(b, "<i4")).encode() for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in ([len(b) // 4 for b in raw], [zlib.crc32(b) for b in raw], list(map(len, texts)), list(map(zlib.crc32, texts))))], names=[id_col, "n_chunks", "n_tokens", "ids_crc32", "decoded_bytes", "decoded_crc32"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "n_chunks", "ids").mapInArrow(rows, f"{id_col} {kind}, n_chunks long, n_tokens long, ids_crc32 long, decoded_bytes long, decoded_crc32 long")
