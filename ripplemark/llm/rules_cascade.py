"""Quality rules as a short-circuit cascade.

Every statistic's cost and every rule's selectivity are measured on a hashed
sample (summed on the executors).  Rules are ordered by rejections per second,
where a rule costs the statistics that nothing before it has made, and each
document runs down that order only until a rule rejects it.  Statistics are
made for the documents still in the run, once each; those that the caller wants
as output, or the base needs, are made for all.  The order changes the work,
never the verdict.

Equal lines, words and windows are found by hashes and confirmed by bytes.
Null text counts as empty; a document without words fails the base; rows with
equal ids are judged each on their own; an empty table gives an empty result;
columns other than the id and the text are not read, whatever their names.  A
text longer than a slice is judged alone, its words and lines hashed in pieces.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACES, byte_slices, hash_ranges, representatives, word_bounds

SAMPLE_ROWS = 2000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def running(mask: np.ndarray) -> np.ndarray:
    """How many positions before each one (and the end) are marked."""
    sums = np.zeros(mask.size + 1, np.int32 if mask.size < 1 << 31 else np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums


def per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the marked positions each document has."""
    sums = running(mask)
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)


def twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys have an equal one; which have an equal one before."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    many, later = np.zeros(keys.size, bool), np.zeros(keys.size, bool)
    many[order[1:][equal]] = many[order[:-1][equal]] = later[order[1:][equal]] = True
    return many, later


def joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers from 0 on, equal for equal pairs only."""
    if not left.size:
        return left
    wide = int(right.max()) + 1
    if (int(left.max()) + 1) * wide >= 1 << 62:
        left = np.unique(left, return_inverse=True)[1]
    return left * wide + right


class Statistics:
    """Counts of each document of one slice, each made when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.firsts = word_bounds(data, offsets)
        self.n_words = np.diff(self.firsts)
        self._made: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made.update(STATISTICS[name](self))
        return self._made[name]

    def owners(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(self.n_words.size), self.n_words)

    def word_ids(self) -> np.ndarray:
        """A number for each word, equal for equal words only."""
        if "_ids" not in self._made:
            self._made["_ids"] = representatives(self.data, self.starts, self.ends, hash_ranges(self.data, self.starts, self.ends))[1]
        return self._made["_ids"]


def _words(s: Statistics) -> dict[str, np.ndarray]:
    return {"n_words": s.n_words}


def _word_chars(s: Statistics) -> dict[str, np.ndarray]:
    return {"word_chars": per_document(~_SPACES[s.data] & ((s.data & 0xC0) != 0x80), s.offsets)}


def _n_symbols(s: Statistics) -> dict[str, np.ndarray]:
    return {"n_symbols": per_document(_SYMBOL[s.data], s.offsets)}


def _line_counts(s: Statistics) -> dict[str, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier one."""
    count = s.offsets.size - 1
    breaks = np.flatnonzero(s.data == 0x0A)
    begin = np.concatenate([s.offsets[:-1], breaks + 1])
    end = np.concatenate([s.offsets[1:], breaks])
    begin.sort()
    end.sort()
    filled = running(~_SPACES[s.data])
    has = (end > begin) & (filled[end] > filled[begin])
    begin, end = begin[has], end[has]
    owner = np.searchsorted(s.offsets, begin, "right") - 1
    _, ids = representatives(s.data, begin, end, hash_ranges(s.data, begin, end))
    _, later = twice(joint(ids, owner))
    return {"n_lines": np.bincount(owner, minlength=count), "n_dup_lines": np.bincount(owner[later], minlength=count)}


def _repeat_words(s: Statistics) -> dict[str, np.ndarray]:
    """Words inside a 3-word window that its document has twice or more."""
    words = s.word_ids()
    covered = np.zeros(words.size, bool)
    if words.size >= 3:
        owner = s.owners()
        whole = np.flatnonzero(owner[:-2] == owner[2:])
        pair = joint(words[whole], words[whole + 1])
        _, pair = np.unique(pair, return_inverse=True)
        many, _ = twice(joint(joint(pair, words[whole + 2]), owner[whole]))
        for j in range(3):
            covered[whole[many] + j] = True
    return {"n_repeat_words": per_document(covered, s.firsts)}


def _distinct_words(s: Statistics) -> dict[str, np.ndarray]:
    _, later = twice(joint(s.word_ids(), s.owners()))
    return {"distinct_words": s.n_words - per_document(later, s.firsts)}


def _letters(s: Statistics) -> dict[str, np.ndarray]:
    return {name: per_document((s.data >= a) & (s.data <= b), s.offsets) for name, a, b in (("upper", 65, 90), ("lower", 97, 122))}


def _worded(s: Statistics) -> dict[str, np.ndarray]:
    """Words with a letter: a-z, A-Z or any code point beyond ASCII."""
    letter = running(((s.data | 32) >= 97) & ((s.data | 32) <= 122) | (s.data >= 128))
    return {"worded": per_document(letter[s.ends] > letter[s.starts], s.firsts)}


#: name of a statistic -> what makes it (and others with it).
STATISTICS = {"n_words": _words, "word_chars": _word_chars, "n_symbols": _n_symbols, "n_lines": _line_counts, "n_dup_lines": _line_counts, "n_repeat_words": _repeat_words, "distinct_words": _distinct_words, "upper": _letters, "lower": _letters, "worded": _worded}


@dataclass(frozen=True)
class Rule:
    """rejects(values of the needed statistics by name): a mask over documents."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, np.ndarray]], np.ndarray]


RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda c: 10 * c["n_symbols"] > c["n_words"]),
    Rule("lines", ("n_dup_lines", "n_lines"), lambda c: 10 * c["n_dup_lines"] > 6 * c["n_lines"]),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda c: 100 * c["n_repeat_words"] > 40 * c["n_words"]),
    Rule("lengths", ("word_chars", "n_words"), lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"])),
    Rule("shouting", ("upper", "lower"), lambda c: 2 * c["upper"] > c["upper"] + c["lower"]),
    Rule("letterless", ("worded", "n_words"), lambda c: 10 * c["worded"] < 7 * c["n_words"]),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


BASE = (
    Rule("base words", ("n_words",), lambda c: c["n_words"] < 50),
    Rule("base repeats", ("n_repeat_words", "n_words"), lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"]),
)


def base_failed(s: Statistics) -> np.ndarray:
    return np.logical_or.reduce([rule.rejects(s) for rule in BASE])


def _subset(s: Statistics, rows: np.ndarray) -> Statistics:
    """The statistics of some documents alone."""
    sizes = s.offsets[rows + 1] - s.offsets[rows]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    pick = np.arange(offsets[-1]) + np.repeat(s.offsets[rows] - offsets[:-1], sizes)
    out = Statistics(s.data[pick], offsets)
    out._made.update({k: v[rows] for k, v in s._made.items() if k in STATISTICS})
    return out


def cascade(s: Statistics, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which documents pass the base and all rules; what a rule needs is made for those that the rules before it left."""
    kept = np.ones(s.n_words.size, bool)
    left = held = np.arange(kept.size)  # inner has the statistics of those held
    inner = s
    for rule in (*BASE, *rules):
        if not left.size:
            break
        if 2 * left.size < held.size and any(n not in inner._made for n in rule.needs):
            inner, held = _subset(inner, np.searchsorted(held, left)), left
        at = np.searchsorted(held, left)
        bad = rule.rejects({n: inner[n][at] for n in rule.needs})
        kept[left[bad]] = False
        left = left[~bad]
    return kept


def measure(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample_rows: int) -> tuple[dict[str, float], dict[str, float]]:
    """({statistic: seconds a document}, {rule: share rejected}) on about sample_rows hashed documents."""
    total = docs.count()
    names = sorted({n for r in rules for n in r.needs})
    if not total:
        return dict.fromkeys(names, 0.0), dict.fromkeys((r.name for r in rules), 0.0)
    share = min(1.0, sample_rows / total)
    sample = docs.select(text_col) if share == 1.0 else docs.filter(F.abs(F.xxhash64(text_col) % 1_000_003) < share * 1_000_003).select(text_col)

    def spent(batches):
        for batch in batches:
            for _, _, data, offsets in byte_slices(batch.column(0)):
                s = Statistics(data, offsets)
                for name in names:
                    fresh = Statistics(data, offsets)  # else a statistic made along with another one would seem free
                    began = time.perf_counter()
                    s._made[name] = fresh[name]
                    yield pa.RecordBatch.from_pydict({"what": [name], "n": [s.n_words.size], "bad": [0], "s": [time.perf_counter() - began]})
                for rule in rules:
                    yield pa.RecordBatch.from_pydict({"what": ["rule " + rule.name], "n": [s.n_words.size], "bad": [int(rule.rejects({n: s[n] for n in rule.needs}).sum())], "s": [0.0]})

    sums = sample.mapInArrow(spent, "what string, n long, bad long, s double").groupBy("what").agg(F.sum("n"), F.sum("bad"), F.sum("s")).collect()
    found = {r[0]: (r[3] / max(r[1], 1), r[2] / max(r[1], 1)) for r in sums}
    return {n: found.get(n, (0.0, 0.0))[0] for n in names}, {r.name: found.get("rule " + r.name, (0.0, 0.0))[1] for r in rules}


def order_rules(costs: dict[str, float], shares: dict[str, float], rules: tuple[Rule, ...], made: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Most rejections per second first, where statistics already made are free; ties by name."""
    have, left, out = set(made), list(rules), []
    while left:
        price = lambda r: sum(costs[n] for n in r.needs if n not in have) + 1e-9
        best = min(left, key=lambda r: (-shares[r.name] / price(r), r.name))
        out.append(best)
        left.remove(best)
        have.update(best.needs)
    return tuple(out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, counts: tuple[str, ...] = COUNTS) -> DataFrame:
    """id, the statistics named in counts, base_failed and kept of every document.

    Without counts the cascade alone decides what is made.
    """
    docs = docs.select(id_col, text_col)
    costs, shares = measure(docs, text_col, rules, sample_rows)
    # base_failed is in the output, so what it needs is made anyway
    ordered = order_rules(costs, shares, rules, (*counts, "n_words", "n_repeat_words"))

    def judge(batches):
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(1)):
                s = Statistics(data, offsets)
                values = [pa.array(s[k].astype(np.int64)) for k in counts]
                failed = base_failed(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *values, pa.array(failed), pa.array(cascade(s, ordered))], names=[id_col, *counts, "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(judge, f"{id_col} {kind}, " + "".join(f"{k} long, " for k in counts) + "base_failed boolean, kept boolean")


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that pass, with all their columns; nothing is counted that no verdict needs."""
    costs, shares = measure(docs.select(text_col), text_col, rules, sample_rows)
    ordered = order_rules(costs, shares, rules, ("n_words", "n_repeat_words"))
    at = docs.columns.index(text_col)

    def judge(batches):
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(at)):
                yield batch.slice(low, high - low).filter(pa.array(cascade(Statistics(data, offsets), ordered)))

    return docs.mapInArrow(judge, docs.schema)
