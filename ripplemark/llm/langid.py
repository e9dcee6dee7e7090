"""Language identification of mixed-language text.

A word's script (by code-point ranges) narrows the languages it may be in; its
character n-grams give a log-score for each of those; Viterbi over the words of
a document, with a penalty for every switch, labels spans.  A document's
language is the one whose spans hold most letters.

Learned from at most about ``PER_LANGUAGE`` documents of each language: n-gram
counts are summed on the executors, hashed into a table of fixed size.
A document that is null or has no letter is ``und`` with score 0; ties go to
the smaller code; without any training row everything is ``und``; rows with
equal ids are labelled alike; other columns, whatever their names, are not
read; an empty table gives an empty result.  Words are scored piece by piece, so
that neither a very long text nor many languages make large temporaries; what
is kept of a text is a row of scores for each word.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

PER_LANGUAGE = 600
BITS = 15
SWITCH = 12.0
#: First code points of the scripts told apart; 0 is Latin and what has no letters of its own script.
SCRIPTS = ((0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0900, 6), (0x0E00, 7), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 8), (0x4E00, 9), (0xAC00, 10), (0xD800, 0))
#: Bytes of text whose words are cut out at once, and scores of letters made at once.
PIECE = 1 << 20
CELLS = 1 << 23
_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code point of each letter below 0x30000, 0 for what is no letter."""
    if not _TABLES:
        table = np.zeros(0x30000, np.int32)
        for k in range(0x30000):
            c = chr(k)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()
                table[k] = ord(low) if len(low) == 1 else k
        _TABLES.append(table)
    return _TABLES[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the documents' offsets in them."""
    first = (data & 0xC0) != 0x80
    sums = np.zeros(data.size + 1, np.int64)
    np.cumsum(first, out=sums[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, sums[offsets]


@dataclass
class Words:
    """Letter runs of a slice: n-gram table slots of each letter, each word's first letter, letters, document and script."""

    slots: list[np.ndarray]
    firsts: np.ndarray
    sizes: np.ndarray
    documents: np.ndarray
    scripts: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    points, begins = code_points(data, offsets)
    table = _letters()
    letter = table[np.minimum(points, len(table) - 1)]
    letter[points >= len(table)] = 0
    place = np.flatnonzero(letter)
    chars = letter[place].astype(np.uint32)
    owner = np.searchsorted(begins, place, "right") - 1
    new = np.ones(place.size, bool)
    new[1:] = (np.diff(place) > 1) | (np.diff(owner) > 0)
    firsts = np.flatnonzero(new)
    last = np.zeros(place.size, bool)
    if place.size:
        last[np.append(firsts[1:] - 1, place.size - 1)] = True
    before = np.zeros_like(chars)
    before[1:] = chars[:-1]
    before[new] = 1
    after = np.zeros_like(chars)
    after[:-1] = chars[1:]
    after[last] = 2
    mask, shift = np.uint32((1 << BITS) - 1), np.uint32(32 - BITS)
    slots = []
    for order, parts in enumerate(((chars,), (before, chars), (before, chars, after))):
        h = np.full(chars.size, 0x811C9DC5 + order, np.uint32)
        for p in parts:
            h = (h ^ p) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        slots.append(((h * np.uint32(0x85EBCA6B)) >> shift) & mask)
    bounds, kinds = np.array([s[0] for s in SCRIPTS]), np.array([s[1] for s in SCRIPTS])
    scripts = kinds[np.searchsorted(bounds, chars[firsts], "right") - 1] if place.size else np.zeros(0, int)
    sizes = np.diff(np.append(firsts, place.size))
    return Words(slots, firsts, sizes, owner[firsts], scripts)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: tuple[np.ndarray, ...]  # for each n-gram order: slots x languages, log-probabilities
    allowed: np.ndarray  # scripts x languages


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Log-score of each word in each language; excluded ones far below any other."""
    k = len(model.languages)
    if not words.firsts.size:
        return np.zeros((0, k), np.float32)
    out = np.empty((words.firsts.size, k), np.float32)
    ends = np.append(words.firsts[1:], words.slots[0].size)
    low = 0
    while low < words.firsts.size:
        begin = words.firsts[low]
        high = max(low + 1, int(np.searchsorted(ends, begin + CELLS // k, "right")))
        some = slice(begin, ends[high - 1])
        total = model.scores[0][words.slots[0][some]]
        for table, slots in zip(model.scores[1:], words.slots[1:], strict=True):
            total += table[slots[some]]
        out[low:high] = np.add.reduceat(total, words.firsts[low:high] - begin, axis=0)
        low = high
    out[~model.allowed[words.scripts]] -= np.float32(1e4)
    return out


@dataclass
class Scored:
    """Words of a slice without their letters: document, letters and scores of each."""

    documents: np.ndarray
    sizes: np.ndarray
    scores: np.ndarray


def scored_words(data: np.ndarray, offsets: np.ndarray, model: Model) -> Scored:
    """Words and their scores, from pieces of the slice that end at ASCII characters other than letters."""
    cuts = [0]
    while data.size - cuts[-1] > 2 * PIECE:
        at = cuts[-1] + PIECE
        while at < data.size:
            near = data[at : at + 4096]
            blank = np.flatnonzero((near < 65) | (near > 90) & (near < 97) | (near > 122) & (near < 128))
            if blank.size:
                at += int(blank[0])
                break
            at += near.size
        if at >= data.size:
            break
        cuts.append(at)
    parts = []
    for a, b in zip(cuts, [*cuts[1:], data.size], strict=True):
        low, high = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        w = words_of(data[a:b], np.clip(offsets[low : high + 1] - a, 0, b - a))
        scores = word_scores(w, model) if model.languages else np.zeros((w.firsts.size, 1), np.float32)
        parts.append((w.documents + low, w.sizes, scores))
    return Scored(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def viterbi(scores: np.ndarray, firsts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word; documents (words firsts[i] to firsts[i + 1]) advance together, one word a step."""
    sizes = np.diff(firsts)
    n, k = scores.shape
    path = np.zeros(n, np.int32)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not order.size:
        return path
    base, length = firsts[:-1][order], sizes[order]
    alive = np.searchsorted(-length, -np.arange(length[0]), "left")  # documents with more than t words
    back = np.zeros((n, k), bool)  # switched to this language at this word
    best = np.zeros(n, np.int32)  # from which language, if so
    now = scores[base].copy()
    for t in range(1, length[0]):
        a = alive[t]
        at = base[:a] + t
        live = now[:a]
        top = live.argmax(axis=1)
        jump = live[np.arange(a), top] - np.float32(switch)
        turned = live < jump[:, None]
        back[at] = turned
        best[at] = top
        live[:] = np.where(turned, jump[:, None], live) + scores[at]
        live -= live.max(axis=1)[:, None]
    label = now.argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        a = alive[t]
        at = base[:a] + t
        own = label[:a]
        path[at] = own
        if t:
            label[:a] = np.where(back[at, own], best[at], own)
    return path


def train(docs: DataFrame, lang_col: str, text_col: str, usable, id_col: str, per_language: int = PER_LANGUAGE) -> Model:
    """Count n-grams and scripts of the sample; the driver gets sums in a table of fixed width."""
    rows = docs.select(id_col, F.col(lang_col).alias("_lang"), text_col).filter(usable & F.col("_lang").isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    names = tuple(sorted(sizes))
    if not names:
        return Model((), (), np.zeros((16, 0), bool))
    spread = F.pmod(F.xxhash64(F.col(id_col), F.lit(23)), F.lit(1_000_003))
    keep = F.lit(False)
    for name in names:
        keep = keep | ((F.col("_lang") == name) & (spread < int(1_000_003 * min(1.0, per_language / sizes[name]))))
    width = 3 << BITS

    def count(batches):
        sums = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for low, high, data, offsets in byte_slices(batch.column(0)):
                w = words_of(data, offsets)
                owner = np.repeat(langs[low:high][w.documents], w.sizes) if w.firsts.size else np.zeros(0, object)
                for name in set(langs[low:high]):
                    mine = owner == name
                    got = sums.setdefault(name, np.zeros(width + 16, np.int64))
                    for i, slots in enumerate(w.slots):
                        got[i << BITS : (i + 1) << BITS] += np.bincount(slots[mine], minlength=1 << BITS)
                    got[width:] += np.bincount(w.scripts[langs[low:high][w.documents] == name], minlength=16) if w.firsts.size else 0
        for name, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * at.size), pa.array(at), pa.array(got[at])], names=["lang", "slot", "n"])

    summed = rows.filter(keep).select(text_col, "_lang").mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = np.zeros((width + 16, len(names)))
    for batch in summed.toArrow().to_batches():
        table[batch["slot"].to_numpy(), [names.index(x) for x in batch["lang"].to_pylist()]] = batch["n"].to_numpy()
    scores = []
    for i in range(3):
        part = table[i << BITS : (i + 1) << BITS] + 0.5
        scores.append((np.log(part / part.sum(axis=0)) / 3).astype(np.float32))
    scripts = table[width:]
    allowed = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True  # a script that no language has excludes none
    return Model(names, tuple(scores), allowed)


def _label(data: np.ndarray, offsets: np.ndarray, model: Model, switch: float) -> tuple[Scored, np.ndarray, np.ndarray]:
    """The slice's words, the language of each, and each document's letters in each language."""
    n, k = offsets.size - 1, max(1, len(model.languages))
    w = scored_words(data, offsets, model)
    path = viterbi(w.scores, np.searchsorted(w.documents, np.arange(n + 1)), switch)
    return w, path, np.bincount(w.documents * k + path, weights=w.sizes, minlength=n * k).reshape(n, k)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """id, lang_pred, score (share of the letters that are in spans of lang_pred) and n_spans."""
    docs = docs.select(id_col, text_col)
    names = np.array([*model.languages, "und"], object)

    def rows(batches):
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(1), 1 << 21):
                w, path, held = _label(data, offsets, model, switch)
                letters = held.sum(axis=1)
                top = held.argmax(axis=1)
                score = held[np.arange(high - low), top] / np.maximum(1, letters)
                known = (letters > 0) & bool(model.languages)
                turns = np.ones(w.documents.size, bool)
                turns[1:] = (np.diff(path) != 0) | (np.diff(w.documents) != 0)
                spans = np.bincount(w.documents[turns], minlength=high - low)
                pred = names[np.where(known, top, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(pred.tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(spans.astype(np.int64))], names=[id_col, "lang_pred", "score", "n_spans"])

    return docs.mapInArrow(rows, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, n_spans long")


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """id, span number, language, first word and number of words (letter runs) of every span; none for ``und``."""
    docs = docs.select(id_col, text_col)
    names = np.array([*model.languages, "und"], object)

    def rows(batches):
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(1)):
                w, path, _ = _label(data, offsets, model, switch)
                if not w.documents.size or not model.languages:
                    continue
                turns = np.ones(w.documents.size, bool)
                turns[1:] = (np.diff(path) != 0) | (np.diff(w.documents) != 0)
                at = np.flatnonzero(turns)
                owner = w.documents[at]
                begins = np.searchsorted(w.documents, np.arange(high - low))
                number = np.arange(at.size) - np.searchsorted(owner, owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(owner)), pa.array(number), pa.array(names[path[at]].tolist(), pa.string()), pa.array(at - begins[owner]), pa.array(np.diff(np.append(at, w.documents.size)))], names=[id_col, "span", "lang", "first_word", "n_words"])

    return docs.mapInArrow(rows, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, span long, lang string, first_word long, n_words long")
