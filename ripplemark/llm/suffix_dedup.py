"""Suffix-array deduplication: remove the bytes of strings that also start earlier.

A window is ``length`` bytes of a document; it is removed if an equal one
starts earlier (smaller id, or same document and earlier start).

1. Winnowing: each window picks the least hash among its ``GRAM``-byte grams,
   a choice that depends on the window alone, so equal windows pick equal
   grams.  Runs of windows with one pick are segments.
2. Picks are counted over all documents; those met once are dropped.  A bit
   table of the others (of bounded size) goes to all tasks and only spares
   work: what it lets through is compared in full.
3. Segments meet by pick.  Equal ones (by hash, then by their bytes) are
   reduced to the earliest within each task, before the shuffle; all windows of
   the others are removed.  A pick that very many windows share is split into
   bands that also hash the bytes common to the band's windows.
4. Each shard of segments gets a suffix array: suffixes are classified, the
   leftmost-smaller substrings are sorted by induction, named, and sorted by the
   same method on their names until names differ, and all suffixes are induced
   from them in linear time.  With permuted common prefixes, suffixes in a row
   that agree on ``length`` bytes are one window, and all but the earliest are
   removed.
5. A key whose segments exceed ``KEY_BYTES`` is not brought to one task: its
   windows are grouped by a cryptographic digest, each minimum found with
   map-side combining.

A null text is empty and matches never cross documents; a document longer than
a slice is read in pieces that overlap by a window; rows with equal id and text
are one document, and of rows with equal ids the text's hash decides who is
earlier; null ids come last; an empty table gives an empty result; other
columns, whatever their names, are kept by ``without_repeats`` (``n_chars``
follows the new text) and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Sieve, byte_slices, materialize, mix64, same_bytes, scratch

LENGTH = 100
GRAM = 32
HOT = 256
MOST_HOT = 1 << 16
BAND = 8
SHARD_BYTES = 1 << 21
KEY_BYTES = 32 << 20
SHARD_ROWS = 50_000
MOST_BITS = 1 << 30
FLUSH_BYTES = 48 << 20
PIECE = 1 << 20
_LAST = (1 << 63) - 1


# --------------------------------------------------------------- suffix arrays


def _s_types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last (the sentinel) is."""
    step = np.sign(np.diff(t.astype(np.int64)))
    where = np.where(step != 0, np.arange(step.size), step.size)
    following = np.minimum.accumulate(where[::-1])[::-1] if step.size else where
    out = np.ones(t.size, bool)
    out[:-1] = np.append(step, 0)[following] > 0
    return out


def _appended(ends: np.ndarray, chars: np.ndarray, direction: int) -> np.ndarray:
    """Places of items appended to the buckets of their chars, in order; ends move on."""
    order = np.argsort(chars.astype(np.uint16), kind="stable")  # by counting, as keys have 16 bits
    ranked = chars[order]
    rank = np.arange(chars.size) - np.searchsorted(ranked, ranked)
    places = np.empty(chars.size, np.int64)
    places[order] = ends[ranked] + direction * rank
    ends += direction * np.bincount(chars, minlength=ends.size)
    return places


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix order induced from the leftmost-smaller suffixes in the order given.

    A bucket's suffixes are taken in waves, each all that the one before put
    into the same bucket, so each wave is a few array operations.
    """
    n = t.size
    counts = np.bincount(t, minlength=sigma)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa = np.full(n, -1, np.int64)
    slot = tails - 1
    sa[_appended(slot, t[lms[::-1]], -1)] = lms[::-1]
    lms_from = slot + 1
    upto = heads.copy()
    for c in range(sigma):
        at = heads[c]
        while at < upto[c]:
            chunk, at = sa[at : upto[c]], upto[c]
            j = chunk[chunk > 0] - 1
            j = j[~s_type[j]]
            if j.size:
                sa[_appended(upto, t[j], 1)] = j
        j = sa[lms_from[c] : tails[c]]
        j = j[j > 0] - 1
        j = j[~s_type[j]]
        if j.size:
            sa[_appended(upto, t[j], 1)] = j
    downto = tails - 1
    for c in range(sigma - 1, -1, -1):
        at = tails[c] - 1
        while at > downto[c]:
            chunk, at = sa[downto[c] + 1 : at + 1][::-1], downto[c]
            j = chunk[chunk > 0] - 1
            j = j[s_type[j]]
            if j.size:
                sa[_appended(downto, t[j], -1)] = j
        j = sa[heads[c] : upto[c]][::-1]
        j = j[j > 0] - 1
        j = j[s_type[j]]
        if j.size:
            sa[_appended(downto, t[j], -1)] = j
    sa[0] = n - 1
    return sa


def _induce_names(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same for an alphabet of names, where most buckets hold few suffixes: one suffix a step."""
    counts = np.bincount(t, minlength=sigma)
    ends = np.cumsum(counts)
    head, tail = (ends - counts).tolist(), ends.tolist()
    chars, small = t.tolist(), s_type.tolist()
    sa = [-1] * len(chars)
    for j in reversed(lms.tolist()):
        c = chars[j]
        tail[c] -= 1
        sa[tail[c]] = j
    for j in sa:
        if j > 0 and not small[j - 1]:
            c = chars[j - 1]
            sa[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    for i in range(len(sa) - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = chars[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = len(chars) - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, sigma: int, levels: list[int] | None = None) -> np.ndarray:
    """Suffix array of t (values 0 to sigma - 1) whose last value, 0, stands nowhere else.

    levels, if given, gets the length of the string at each level of the recursion.
    """
    n = t.size
    if levels is not None:
        levels.append(n)
    if n < 3:
        return np.arange(n)[::-1].copy()
    induce = _induce if sigma <= 512 else _induce_names
    s_type = _s_types(t)
    mark = np.zeros(n, bool)
    mark[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(mark)
    first = induce(t, s_type, lms, sigma)
    ordered = first[mark[first]]
    # names: neighbours in order that agree from one leftmost-smaller place to the next have one name
    until = np.zeros(n, np.int64)
    until[lms] = np.append(lms[1:], n - 1)
    size = until[ordered] - ordered + 1
    same = size[1:] == size[:-1]
    same[same] = same_bytes(t, ordered[:-1][same], ordered[1:][same], size[1:][same])
    names = np.zeros(n, np.int64)
    names[ordered] = np.cumsum(np.concatenate([[True], ~same])) - 1
    reduced = names[lms]
    if not same.any():
        return induce(t, s_type, ordered, sigma)
    order = lms[suffix_array(reduced, int(reduced.max()) + 1, levels)]
    return induce(t, s_type, order, sigma)


def permuted_lcp(data: np.ndarray, left: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, how many bytes its suffix shares with the one before it in the array.

    left: bytes to the end of a place's segment, at which prefixes end.  Where
    a place and its partner follow equal bytes the value is one less than that
    of the place before; only the others are compared, eight bytes a step.
    """
    n = sa.size
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    known = phi >= 0
    follows = np.zeros(n, bool)
    i = np.flatnonzero(known[1:] & (phi[1:] > 0)) + 1
    i = i[(data[i - 1] == data[phi[i] - 1]) & (phi[i - 1] == phi[i] - 1) & (left[i - 1] > 0) & (left[phi[i] - 1] > 0)]
    follows[i] = True
    word = np.zeros(n + 16, np.uint64)
    word[:n] = data
    for shift in (1, 2, 4):
        word[: n + 16 - shift] |= word[shift:] << np.uint64(8 * shift)
    out = np.zeros(n, np.int64)
    todo = np.flatnonzero(known & ~follows)
    most = np.minimum(left[todo], left[phi[todo]])
    got, live = np.zeros(todo.size, np.int64), np.flatnonzero(most > 0)
    while live.size:
        a = todo[live] + got[live]
        b = phi[todo[live]] + got[live]
        x = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        got[live] += same
        live = live[(same == 8) & (got[live] < most[live])]
    out[todo] = np.minimum(got, most)
    anchor = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.where(follows, np.maximum(out[anchor] - (np.arange(n) - anchor), 0), out)


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, group) of the windows of the segments of data that have an equal one; places in suffix order."""
    k = offsets.size - 1
    sizes = np.diff(offsets)
    t = np.zeros(data.size + k, np.int64)
    shifted = np.arange(data.size) + np.repeat(np.arange(k), sizes)
    t[shifted] = data.astype(np.int64) + 1
    raw = np.zeros(t.size, np.uint8)
    raw[shifted] = data
    end = offsets[1:] + np.arange(k)
    left = np.repeat(end, sizes + 1) - np.arange(t.size)
    # segments end with the symbol 0, of which the last is the sentinel
    sa = suffix_array(t, 257)
    lcp = permuted_lcp(raw, left, sa)[sa]
    joined = lcp >= length
    group = np.cumsum(~joined)
    many = joined.copy()
    many[:-1] |= joined[1:]
    place = sa[many]
    return place - np.searchsorted(end, place), group[many]


# ------------------------------------------------------------------- winnowing


_GRAM_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes (a power of two) from each place on, from those of half as many; it only picks places."""
    out, factor, span = _GRAM_BYTE[data], np.uint64(0x9E3779B97F4A7C15), 1
    while span < gram:
        out = out[: out.size - span] * factor + out[span:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        span *= 2
    return mix64(out)


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, begin): slices of whole rows, and of a longer row its pieces, from begin on."""
    for low, _, data, offsets in byte_slices(column, PIECE):
        if data.size <= 2 * PIECE:
            yield low, data, offsets, 0
            continue
        for begin in range(0, data.size, PIECE):
            part = data[begin : begin + PIECE + length - 1]
            yield low, part, np.array([0, part.size]), begin


def picks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place of the gram, hash of the gram) of each segment, by place."""
    none = np.zeros(0, np.int64)
    n = data.size
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return none, none, none, none.astype(np.uint64)
    full = gram_hashes(data, gram)
    h = (full >> np.uint64(32)).astype(np.uint32)
    wide = length - gram + 1
    least, span = h, 1
    while 2 * span <= wide:
        least = np.minimum(least[: least.size - span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: least.size - (wide - span)], least[wide - span :])
    # least[s] is that of the window at s; windows within a document only
    count = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(n + 1, np.int64)
    has = count > 0
    valid[offsets[:-1][has]] += 1
    np.subtract.at(valid, offsets[:-1][has] + count[has], 1)
    valid = np.cumsum(valid)[: least.size] > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | (h[: least.size - 1] == least[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new)
    new[offsets[:-1][has]] = True
    starts = np.flatnonzero(new)
    owner = np.searchsorted(offsets, starts, "right") - 1
    last = offsets[owner] + count[owner]
    ends = np.minimum(np.append(starts[1:], n), last)
    place = np.empty(starts.size, np.int64)
    for low in range(0, starts.size, 1 << 14):
        s = starts[low : low + (1 << 14)]
        place[low : low + s.size] = s + h[s[:, None] + np.arange(wide)].argmin(axis=1)
    return starts, ends - starts, place, full[place]


def _bits_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys & np.uint64(bits - 1)).astype(np.int64), ((keys >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _count_picks(docs: DataFrame, length: int) -> DataFrame:
    """(g, n) of the picks met more than once."""

    def local(batches):
        pending, size = [], 0

        def flush():
            found, n = np.unique(np.concatenate(pending), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["g", "n"])

        for batch in batches:
            for _, data, offsets, _ in pieces(batch.column(0), length):
                pending.append(picks(data, offsets, length)[3])
                size += pending[-1].size
                if size > 4_000_000:
                    yield flush()
                    pending, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(local, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1")


def _bit_table(counts: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the repeated picks, at most MOST_BITS of them, brought together in blocks."""
    n = counts.count()
    bits = 1 << 16
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    block = min(bits, 1 << 19)

    def spread(batches):
        for batch in batches:
            keys = mix64(batch.column(0).to_numpy().view(np.uint64))
            at = np.unique(np.concatenate(_bits_of(keys, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at // block).astype(np.int32)), pa.array((at % block).astype(np.int32))], names=["block", "bit"])

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(block, np.uint8)
        flags[table["bit"].to_numpy()] = 1
        return pa.table({"block": table["block"][:1], "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    table = np.zeros(bits // 8, np.uint8)
    for row in counts.select("g").mapInArrow(spread, "block int, bit int").groupBy("block").applyInArrow(pack, "block int, bits binary").toLocalIterator():
        table[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


# -------------------------------------------------------------------- segments


def _merged(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals (doc, tie, start, end) with those that touch made one."""
    if not doc.size:
        return doc, tie, start, end
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    other = np.ones(doc.size, bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    # ends so far within a document: shift each document beyond the one before
    number = np.cumsum(other) - 1
    wide = int(end.max()) + 2
    upto = np.maximum.accumulate(end + number * wide) - number * wide
    fresh = other.copy()
    fresh[1:] |= start[1:] > upto[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], doc.size) - 1
    return doc[first], tie[first], start[first], upto[last]


def _earliest(arrays: dict[str, np.ndarray], data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal segments: (the earliest of each, the others); a document's own place met again is neither.

    A segment's bytes are in data from arrays["at"] on.  Two of one hash whose
    bytes differ stay both; the suffix array tells them apart.
    """
    order = np.lexsort((arrays["s"], arrays["tie"], arrays["doc"], arrays["n"], arrays["sid"], arrays["key"]))
    same = np.zeros(order.size, bool)
    a, b = order[1:], order[:-1]
    alike = (arrays["key"][a] == arrays["key"][b]) & (arrays["sid"][a] == arrays["sid"][b]) & (arrays["n"][a] == arrays["n"][b])
    alike[alike] = same_bytes(data, arrays["at"][a[alike]], arrays["at"][b[alike]], arrays["n"][a[alike]] + length - 1)
    same[1:] = alike
    again = np.zeros(order.size, bool)
    again[1:] = same[1:] & (arrays["doc"][a] == arrays["doc"][b]) & (arrays["tie"][a] == arrays["tie"][b]) & (arrays["s"][a] == arrays["s"][b])
    return order[~same], order[same & ~again]


_SEGMENTS = "gone boolean, hot boolean, key long, sid long, doc long, tie long, s long, n long, seg binary"
_NAMES = ["key", "sid", "doc", "tie", "s", "n"]


def _out(arrays: dict[str, np.ndarray], rows: np.ndarray, data: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of segments with their bytes."""
    size = arrays["n"][rows] + length - 1
    upto = np.cumsum(size)
    place = np.arange(upto[-1] if upto.size else 0) + np.repeat(arrays["at"][rows] - (upto - size), size)
    segs = pa.Array.from_buffers(pa.binary(), rows.size, [None, pa.py_buffer(np.concatenate([[0], upto]).astype(np.int32)), pa.py_buffer(data[place].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(rows.size, bool)), pa.array(arrays["hot"][rows]), *(pa.array(arrays[c][rows]) for c in _NAMES), segs], names=["gone", "hot", *_NAMES, "seg"])


def _gone(doc, tie, start, end) -> pa.RecordBatch:
    doc, tie, start, end = _merged(doc, tie, start, end)
    zero, yes = pa.array(np.zeros(doc.size, np.int64)), pa.array(np.ones(doc.size, bool))
    return pa.RecordBatch.from_arrays([yes, yes, zero, zero, pa.array(doc), pa.array(tie), pa.array(start), pa.array(end), pa.nulls(doc.size, pa.binary())], names=["gone", "hot", *_NAMES, "seg"])


def _segments(docs: DataFrame, counts: DataFrame, length: int) -> DataFrame:
    """Rows of segments to compare, and (gone) of intervals that are known to repeat: s and n are start and end."""
    spark = docs.sparkSession
    table, bits = _bit_table(counts)
    hot = counts.filter(F.col("n") > HOT).orderBy(F.desc("n"), "g").limit(MOST_HOT).select("g").toArrow()["g"].to_numpy()
    # of at most MOST_BITS bits and MOST_HOT picks
    sent = spark.sparkContext.broadcast((table, bits, np.sort(hot.view(np.uint64))))

    def rows(batches):
        table, bits, hot = sent.value
        kept: list[dict] = []
        buffers: list[np.ndarray] = []
        held = 0

        def flush():
            arrays = {c: np.concatenate([k[c] for k in kept]) for c in [*_NAMES, "hot", "at"]}
            data = np.concatenate(buffers)
            first, others = _earliest(arrays, data, length)
            doc, tie, s = (arrays[c][others] for c in ("doc", "tie", "s"))
            yield _gone(doc, tie, s, s + arrays["n"][others] + length - 1)
            for low in range(0, first.size, 20_000):
                yield _out(arrays, first[low : low + 20_000], data, length)

        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, data, offsets, skipped in pieces(batch.column(2), length):
                start, number, place, g = picks(data, offsets, length)
                if not start.size:
                    continue
                a, b = _bits_of(mix64(g), bits)
                may = ((table[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (table[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool)
                start, number, place, g = start[may], number[may], place[may], g[may]
                if not start.size:
                    continue
                hasher = Hasher(data)
                many = np.zeros(g.size, bool)
                if hot.size:
                    many = hot[np.minimum(np.searchsorted(hot, g), hot.size - 1)] == g
                key, banded = g.copy(), np.zeros(g.size, bool)
                if many.any():
                    # bands by distance from the window's start to the gram; all windows of a band hold its core
                    s, c, p, gg = start[many], number[many], place[many], g[many]
                    far, near = (p - s) // BAND, (p - (s + c - 1)) // BAND
                    reps = far - near + 1
                    band = np.repeat(far, reps) - (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
                    s, c, p, gg = (np.repeat(x, reps) for x in (s, c, p, gg))
                    first = np.maximum(s, p - band * BAND - (BAND - 1))
                    after = np.minimum(s + c, p - band * BAND + 1)
                    core = hasher(p - band * BAND, p - band * BAND - (BAND - 1) + length)
                    start, number = np.concatenate([start[~many], first]), np.concatenate([number[~many], after - first])
                    key = np.concatenate([g[~many], mix64(core ^ mix64(gg + band.astype(np.uint64)))])
                    banded = np.concatenate([np.zeros((~many).sum(), bool), np.ones(first.size, bool)])
                owner = np.searchsorted(offsets, start, "right") - 1
                sid = hasher(start, start + number + length - 1)
                arrays = {"key": key.view(np.int64), "sid": sid.view(np.int64), "doc": ids[low + owner], "tie": ties[low + owner], "s": start - offsets[owner] + skipped, "n": number, "hot": banded, "at": start}
                first, others = _earliest(arrays, data, length)
                if others.size:
                    doc, tie, s = (arrays[c][others] for c in ("doc", "tie", "s"))
                    yield _gone(doc, tie, s, s + number[others] + length - 1)
                arrays = {c: v[first] for c, v in arrays.items()}
                size = arrays["n"] + length - 1
                upto = np.cumsum(size)
                buffers.append(data[np.arange(upto[-1]) + np.repeat(arrays["at"] - (upto - size), size)])
                arrays["at"] = held + upto - size
                kept.append(arrays)
                held += int(upto[-1])
                if held > FLUSH_BYTES:
                    yield from flush()
                    kept, buffers, held = [], [], 0
        if kept:
            yield from flush()

    return docs.select("doc", "tie", "text").mapInArrow(rows, _SEGMENTS)


def _windows(segments: DataFrame, length: int) -> DataFrame:
    """(doc, tie, start, end) of the windows of segments, of whatever key, that another one comes before."""

    def rows(batches):
        for batch in batches:
            keep = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc", "tie", "s", "n")}
            for low in range(0, batch.num_rows, 10_000):
                part = {c: v[low : low + 10_000] for c, v in keep.items()}
                step = np.arange(part["n"].sum()) - np.repeat(np.cumsum(part["n"]) - part["n"], part["n"])
                segs = batch.column(batch.schema.get_field_index("seg")).slice(low, 10_000).to_pylist()
                digests = [hashlib.blake2b(seg[i : i + length], digest_size=16).digest() for seg, n in zip(segs, part["n"].tolist(), strict=True) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *(pa.array(np.repeat(part[c], part["n"])) for c in ("doc", "tie")), pa.array(np.repeat(part["s"], part["n"]) + step)], names=["digest", "doc", "tie", "start"])

    found = materialize(segments.mapInArrow(rows, "digest binary, doc long, tie long, start long"), "suffix-windows")
    place = F.struct("doc", "tie", "start")
    first = found.groupBy("digest").agg(F.min(place).alias("first"))
    return found.join(first, "digest").filter(place > F.col("first")).select("doc", "tie", "start", (F.col("start") + length).alias("end"))


def _compare(segments: DataFrame, length: int, banded_only: bool) -> DataFrame:
    """(doc, tie, start, end) of what the segments of equal keys repeat.

    banded_only: whether only keys of bands can hold more than KEY_BYTES.
    """
    wide = segments.filter("hot") if banded_only else segments
    wide = wide.groupBy("key").agg(F.sum(F.col("n") + (length - 1)).alias("bytes")).filter(F.col("bytes") > KEY_BYTES).select("key")
    wide = materialize(wide, "suffix-wide-keys")
    if wide.isEmpty():
        return _compare_shards(segments, length)
    known = _windows(segments.join(wide, "key", "left_semi"), length)
    return known.unionByName(_compare_shards(segments.join(wide, "key", "left_anti"), length))


def _compare_shards(segments: DataFrame, length: int) -> DataFrame:
    """The same by suffix arrays, for keys that fit in memory."""
    n = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments.count() // SHARD_ROWS)
    dealt = segments.select(*_NAMES, "seg").repartition(n, "key").sortWithinPartitions("key")

    def shard(table: pa.Table):
        segs = table["seg"].combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(segs.buffers()[1], np.int64)[segs.offset : segs.offset + len(segs) + 1]
        data = np.frombuffer(segs.buffers()[2], np.uint8)
        arrays = {c: table[c].to_numpy() for c in _NAMES} | {"at": offsets[:-1]}
        first, others = _earliest(arrays, data, length)
        doc, tie, s = (arrays[c][others] for c in ("doc", "tie", "s"))
        parts = [(doc, tie, s, s + arrays["n"][others] + length - 1)]
        # a segment alone under its key has no partner
        keys, back, number = np.unique(arrays["key"][first], return_inverse=True, return_counts=True)
        first = first[number[back] > 1]
        if first.size:
            size = arrays["n"][first] + length - 1
            upto = np.concatenate([[0], np.cumsum(size)])
            own = data[np.arange(upto[-1]) + np.repeat(arrays["at"][first] - upto[:-1], size)]
            place, group = repeated_windows(own, upto, length)
            if place.size:
                seg = np.searchsorted(upto, place, "right") - 1
                row = first[seg]
                doc, tie, s = arrays["doc"][row], arrays["tie"][row], arrays["s"][row] + place - upto[seg]
                order = np.lexsort((s, tie, doc, group))
                later = order[1:][group[order][1:] == group[order][:-1]]
                parts.append((doc[later], tie[later], s[later], s[later] + length))
        doc, tie, s, e = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, tie, s, e)], names=["doc", "tie", "start", "end"])

    def rows(batches):
        pending: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            pending.append(batch)
            held += batch.nbytes
            if held < SHARD_BYTES:
                continue
            table = pa.Table.from_batches(pending).combine_chunks()
            keys = table["key"].to_numpy()
            cut = int(np.searchsorted(keys == keys[-1], True))  # the last key may go on
            if cut:
                done = table.slice(0, cut).combine_chunks()
                yield shard(done)
                pending = table.slice(cut).to_batches()
                held = sum(b.nbytes for b in pending)
        if pending:
            done = pa.Table.from_batches(pending).combine_chunks()
            if done.num_rows:
                yield shard(done)

    return dealt.mapInArrow(rows, "doc long, tie long, start long, end long")


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, tie, spans): the bytes to remove of each document, as maximal runs in order; doc is the id, tie the text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    counts = materialize(_count_picks(rows, length), "suffix-picks")
    found = materialize(_segments(rows, counts, length), "suffix-segments")
    known = found.filter("gone").select("doc", "tie", F.col("s").alias("start"), F.col("n").alias("end"))
    # a pick that is not banded is met at most HOT times, unless there were more hot ones than are banded
    banded_only = counts.filter(F.col("n") > HOT).count() <= MOST_HOT
    every = known.unionByName(_compare(found.filter("not gone"), length, banded_only))
    lists = every.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("parts"))

    def merge(batches):
        for batch in batches:
            parts = batch.column(2)
            flat = parts.flatten()
            owner = np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy())
            row, _, start, end = _merged(owner, np.zeros(owner.size, np.int64), flat.field("start").to_numpy(), flat.field("end").to_numpy())
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], names=["doc", "tie", "spans"])

    return lists.mapInArrow(merge, "doc long, tie long, spans array<struct<start: long, end: long>>")


def _joined(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(row, spans): the rows of docs as structs, and their spans (null for none)."""
    with scratch(docs.sparkSession):
        spans = materialize(repeated_intervals(docs, id_col, text_col, length), "suffix-spans", keep=True)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    sieve = Sieve(spans.select("doc", "tie"))
    met = sieve.met(rows, "k", "h").join(spans, (F.col("k") == F.col("doc")) & (F.col("h") == F.col("tie")), "left").select("row", "spans")
    return met.unionByName(sieve.unmet(rows, "k", "h").select("row", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))


def _kept(raw: bytes, spans) -> bytes:
    out, at = [], 0
    for span in spans:
        out.append(raw[at : span["start"]])
        at = span["end"]
    out.append(raw[at:])
    return b"".join(out)


def repeats_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    joined = _joined(docs.select(id_col, text_col), id_col, text_col, length).select(F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"), "spans")

    def rows(batches):
        for batch in batches:
            out = ([], [], [], [])
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                for column, value in zip(out, (len(raw), sum(x["end"] - x["start"] for x in spans or ()), len(spans or ()), hashlib.sha256(_kept(raw, spans or ())).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(rows, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut out of their texts; where a cut splits a character, its rest goes too."""
    joined = _joined(docs, id_col, text_col, length)
    columns = docs.columns
    at = columns.index(text_col)

    def cut(batches):
        for batch in batches:
            values = batch.column(0).flatten()
            texts, spans = values[at].to_pylist(), batch.column(1).to_pylist()
            values[at] = pa.array([_kept(t.encode(), s).decode("utf-8", "ignore") if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(values, names=columns)

    out = joined.mapInArrow(cut, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length(F.col(text_col)).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*columns)
