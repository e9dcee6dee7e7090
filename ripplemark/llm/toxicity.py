"""Toxicity by a weighted finite-state pattern grammar.

A clause's tokens are classes: insult, threat verb, target, negation, report,
or other.  Five transducers read them one after the other, composed into one
machine: insults are taken literally, piled up, or as mere mentions; a threat
verb is a threat only with a target close by; a target close to an insult aims
it (if it follows, the machine has guessed that it will); a negation shortly
before a hit and a report before it mark it.  Arcs carry labels, and a label's
weight is learned from labelled documents; the best path's weight is the
clause's score, and the document's is the logistic of a base and all its
clauses.  A lone insult that is neither aimed nor a threat stays below 0.5, a
threat does not.

Learned from at most about ``PER_CLASS`` labelled documents of class 0 and 1:
which words (and word beginnings) are insults, and the weights of the labels.
Targets, negations, reports and threat verbs are fixed lists.

Null and empty text and text without any match get the base score; labels
that are null or neither 0 nor 1 are left out; without labels only threats
match; rows with equal ids are scored alike; an empty table gives an empty
result; other columns, whatever their names, are kept by ``without_toxic`` and
not read otherwise; texts and clauses are read whole, however long.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality_qda import pick_labelled

PER_CLASS = (6000, 3000)
LEAST_SUPPORT = 5
#: Labels of arcs: base, insult, piled-up insult, threat, aimed, negated, reported; and their weights before any learning.
LABELS = "0IJTANQ"
PRIOR = (-3.0, 1.6, 1.6, 3.6, 0.6, -1.2, -1.0)
#: How firmly weights are held to those: as if by so many documents each.
FIRMNESS = (0.1, 0.5, 0.5, 1.0, 1.0, 1.0, 1.0)
#: A lone insult stays so far below the threshold, and a threat so far above, in log-odds.
MARGIN = 0.5
#: Function words of the grammar, by class, in English, German, French and Spanish.
TARGETS = frozenset("you your yours he she they them him her we us du ihr euch sie er dich dir tu toi vous te il elle ils tú usted ustedes él ella ellos ti".split())
OBJECTS = frozenset("dich euch dir ihn ihm te vous ti os lo lui".split())
NEGATIONS = frozenset("not no never isn aren wasn don doesn neither nor nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset("said says say called calls quoted quote wrote writes reported reports alleged claimed sagte sagt nannte zitierte schrieb dit disait appelé cité dijo dice llamó citó escribió".split())
THREATS = frozenset("kill murder hurt destroy stab shoot strangle umbringen töten verletzen erschießen tuer étrangler poignarder matar matarte matarlos apuñalar".split())
_TOKEN = re.compile(r"[^\W\d_]+")
_BORDER = re.compile(r"[.!?;\n]")


# ------------------------------------------------------------- the transducers


@dataclass(frozen=True)
class Transducer:
    """arcs: {(state, in class): ((next state, out class, labels), ...)}; state 0 starts, finals accept."""

    arcs: dict
    finals: frozenset

    def then(self, other: Transducer) -> Transducer:
        """Composition: what self puts out goes into other; labels of both add up."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        classes = sorted({c for _, c in self.arcs})
        while todo:
            a, b = todo.pop()
            for c in classes:
                got = []
                for a2, mid, x in self.arcs.get((a, c), ()):
                    for b2, out, y in other.arcs.get((b, mid), ()):
                        if (a2, b2) not in number:
                            number[a2, b2] = len(number)
                            todo.append((a2, b2))
                        got.append((number[a2, b2], out, x + y))
                if got:
                    arcs[number[a, b], c] = tuple(got)
        return Transducer(arcs, frozenset(n for (a, b), n in number.items() if a in self.finals and b in other.finals))

    def best(self, classes: str, weights: dict[str, float]) -> tuple[float, str]:
        """Weight and labels of the best path over a clause; of equal ones that with the least labels."""
        states: dict[int, tuple[float, str]] = {0: (0.0, "")}
        for c in classes:
            after: dict[int, tuple[float, str]] = {}
            for state, (value, labels) in states.items():
                for state2, _, more in self.arcs.get((state, c), ()):
                    new = (value + sum(weights[x] for x in more), labels + more)
                    old = after.get(state2)
                    if old is None or new[0] > old[0] or new[0] == old[0] and new[1] < old[1]:
                        after[state2] = new
            states = after
        return max((v for k, v in states.items() if k in self.finals), key=lambda v: (v[0], [-ord(x) for x in v[1]]), default=(0.0, ""))


#: Classes of tokens: other word, insult, threat verb, target, target in the form of an object before a verb, negation, report.
TOKENS = "wivgonr"
#: How many tokens apart a target and its hit, a target and its threat verb, a negation, a report may be.
AIM, GRIP, DENIAL, REPORT = 3, 3, 3, 6
REACH = max(AIM, GRIP, DENIAL, REPORT)


def insult_transducer() -> Transducer:
    """An insult is literal (I), piled on the one just before (J), or mentioned (an ordinary word)."""
    arcs = {}
    for state in (0, 1):
        for c in TOKENS:
            arcs[state, c] = ((0, c, ""),)
        arcs[state, "i"] = ((1, "J" if state else "I", "J" if state else "I"), (1, "w", ""))
    return Transducer(arcs, frozenset((0, 1)))


def threat_transducer() -> Transducer:
    """A threat verb is a threat (T) with a target in the GRIP tokens after it, or one in object form before it; else a word."""
    arcs, number = {}, {}
    at = lambda before, after: number.setdefault((before, after), len(number))
    at(0, 0)
    for before in range(GRIP + 1):
        for after in range(GRIP + 1):  # a threat was read, and its target must come within so many tokens
            for c in "wIJvgonr":
                b = GRIP if c == "o" else max(0, before - 1)
                if c not in "go" and after == 1:
                    continue  # it did not come
                a = 0 if c in "go" else max(0, after - 1)
                here = [(at(b, a), {"v": "w", "o": "g"}.get(c, c), "")]
                if c == "v" and before:
                    here = [(at(b, a), "T", "T")]
                elif c == "v" and not after:
                    here.append((at(b, GRIP), "T", "T"))
                arcs[at(before, after), c] = tuple(here)
    return Transducer(arcs, frozenset(n for (_, after), n in number.items() if not after))


def target_transducer() -> Transducer:
    """A hit with a target in the AIM tokens before it, or in those after it, is aimed (A)."""
    arcs, number = {}, {}
    at = lambda before, after: number.setdefault((before, after), len(number))
    at(0, 0)
    for before in range(AIM + 1):
        for after in range(AIM + 1):
            for c in "wIJTgnr":
                if c != "g" and after == 1:
                    continue
                b, a = AIM if c == "g" else max(0, before - 1), 0 if c == "g" else max(0, after - 1)
                here = [(at(b, a), c, "")]
                if c in "IJ" and (before or after):
                    here = [(at(b, a), c, "A")]
                elif c in "IJ":
                    here.append((at(b, AIM), c, "A"))
                arcs[at(before, after), c] = tuple(here)
    return Transducer(arcs, frozenset(n for (_, after), n in number.items() if not after))


def marking_transducer(opens: str, reach: int, label: str) -> Transducer:
    """Hits among the reach tokens after one of opens get the label."""
    arcs = {}
    for left in range(reach + 1):
        for c in "wIJTgnr":
            arcs[left, c] = ((reach if c in opens else max(0, left - 1), c, label if left and c in "IJT" else ""),)
    return Transducer(arcs, frozenset(range(reach + 1)))


def transducers() -> tuple[Transducer, ...]:
    """Insult, threat, target, negation, reported speech."""
    return insult_transducer(), threat_transducer(), target_transducer(), marking_transducer("n", DENIAL, "N"), marking_transducer("r", REPORT, "Q")


@cache
def grammar() -> Transducer:
    return reduce(Transducer.then, transducers())


# -------------------------------------------------------------------- the model


@dataclass(frozen=True)
class Model:
    """Odds of insult words, and of beginnings of words; weights of the grammar's labels."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: dict[str, float] = field(default_factory=lambda: dict(zip(LABELS, PRIOR, strict=True)))

    @property
    def automaton(self):
        machine = ahocorasick.Automaton()
        for kind, found in (("i", self.words), ("s", self.stems), ("v", THREATS)):
            for text in found:
                if text not in machine or kind == "v":
                    machine.add_word(text, (kind, len(text)))
        if len(machine):
            machine.make_automaton()
        return machine


def hits_of(low: str, machine) -> dict[int, tuple[int, str]]:
    """{start: (end, class)} of insults and threat verbs at word borders; the longest at a place."""
    found: dict[int, tuple[int, str]] = {}
    for end, (kind, size) in machine.iter(low):
        start, end = end + 1 - size, end + 1
        if start and low[start - 1].isalpha() or kind != "s" and end < len(low) and low[end].isalpha():
            continue
        if start not in found or found[start][0] < end:
            found[start] = (end, "v" if kind == "v" else "i")
    return found


def clauses(text: str, machine) -> list[str]:
    """Token classes of the clauses that hold an insult or a threat verb.

    Of a run of other words so many stay as the grammar looks back or ahead;
    more would change no path.
    """
    low = text.lower()
    found = hits_of(low, machine)
    if not found:
        return []
    borders = [m.start() for m in _BORDER.finditer(low)]
    out, upto = [], -1
    for at in sorted(found):
        if at < upto:
            continue
        k = bisect_left(borders, at)
        begin, upto = borders[k - 1] + 1 if k else 0, borders[k] if k < len(borders) else len(low)
        classes, plain = [], 0
        for m in _TOKEN.finditer(low, begin, upto):
            word, hit = m[0], found.get(m.start())
            c = hit[1] if hit else "n" if word in NEGATIONS else "r" if word in REPORTS else "o" if word in OBJECTS else "g" if word in TARGETS else "w"
            plain = plain + 1 if c == "w" else 0
            if plain <= REACH + 1:
                classes.append(c)
        out.append("".join(classes))
    return out


def score_text(text: str | None, machine, weights: dict[str, float]) -> float:
    """Logistic of the base and the clauses' weights; 0 to 1."""
    total = weights["0"]
    if text and len(machine):
        total += sum(grammar().best(c, weights)[0] for c in clauses(text, machine))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def label_counts(text: str | None, machine, weights: dict[str, float]) -> tuple[int, ...]:
    """How often the best paths use each label, the base once."""
    labels = "".join(grammar().best(c, weights)[1] for c in clauses(text, machine)) if text and len(machine) else ""
    return (1, *(labels.count(x) for x in LABELS[1:]))


def fit(rows: list[tuple[tuple[int, ...], int, int]]) -> dict[str, float]:
    """Weights of the labels from (counts, 0 or 1, documents): logistic regression held to the prior."""
    x, y, n = (np.array([r[i] for r in rows], float) for i in range(3))
    prior, firm = np.array(PRIOR), np.array(FIRMNESS)
    w = prior.copy()

    def loss(v):
        z = x @ v
        return (n * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (firm * (v - prior) ** 2).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + firm * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(firm), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-12:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    out = dict(zip(LABELS, w.tolist(), strict=True))
    out["I"] = min(out["I"], -out["0"] - MARGIN)
    out["T"] = max(out["T"], -out["0"] + MARGIN)
    return out


def _features(text: str) -> dict[str, int]:
    """{word or beginning of a word: hash of the words around its first place}."""
    out: dict[str, int] = {}
    words = _TOKEN.findall(text.lower())
    for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        if w not in out:
            around = zlib.crc32(f"{before} {after}".encode())
            out[w] = around
            for k in range(3, min(8, len(w))):
                out.setdefault(w[:k] + "*", around)
    return out


def choose(counts: list[tuple[str, int, int]], n: tuple[int, int], least: int = LEAST_SUPPORT) -> Model:
    """Words and beginnings of words whose documents are toxic far beyond chance.

    counts: (feature, clean documents, toxic contexts).  A word of so many
    documents would be in toxic ones alone by chance with the toxic share's
    power; the support asked for makes that rare over all features.  A
    beginning is taken only if it stands in clearly more contexts than any one
    of its words.
    """
    share = n[1] / (n[0] + n[1])
    rivals = sum(toxic >= least for _, _, toxic in counts)
    least = max(least, math.ceil(math.log(100 * max(rivals, 1)) / -math.log(share)))
    scored = {}
    for f, clean, toxic in counts:
        if toxic >= least:
            odds = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))
            if odds > 3.0:
                scored[f] = (min(odds, 8.0), toxic)
    words = {f: w for f, (w, _) in scored.items() if f[-1] != "*"}
    most: dict[str, int] = {}
    for f in words:
        for k in range(3, 8):
            if len(f) > k:
                most[f[:k]] = max(most.get(f[:k], 0), scored[f][1])
    stems: dict[str, float] = {}
    for f, (w, support) in sorted(scored.items(), key=lambda x: (len(x[0]), x[0])):
        if f[-1] == "*" and support > 1.1 * most.get(f[:-1], 0) and not any(f[:k] in stems for k in range(3, len(f) - 1)):
            stems[f[:-1]] = w
    return Model(words, stems)


def train(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Model:
    """The insults, from words and beginnings of words of the labelled sample, then the weights, from its best paths.

    Support is the number of different contexts, so copies of one document
    count once.  The driver gets the features that enough toxic documents of
    the sample hold, which the sample's size bounds, and label counts.
    """
    picked = pick_labelled(labels, id_col, label_col, per_class, held_out)

    def rows(batches):
        clean: dict[str, int] = {}
        n = [0, 0]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(clean), pa.string()), pa.nulls(len(clean), pa.int64()), pa.array(list(clean.values()), pa.int64())], names=["f", "around", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _features(text or "")
                n[label] += 1
                if label:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([0] * len(found), pa.int64())], names=["f", "around", "clean"])
                else:
                    for f in found:
                        clean[f] = clean.get(f, 0) + 1
                if len(clean) > 1_000_000:
                    yield flush()
                    clean.clear()
        if clean:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array(["", " "]), pa.nulls(2, pa.int64()), pa.array(n, pa.int64())], names=["f", "around", "clean"])

    # picked holds at most 4 * (6000 + 3000) rows
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.select(F.col(id_col).alias("id"), "_label")), "id").select("text", "_label")
    sample = chosen.mapInArrow(rows, "f string, around long, clean long")
    sums = materialize(sample.groupBy("f", "around").agg(F.sum("clean").alias("clean")).groupBy("f").agg(F.sum("clean").alias("clean"), F.count("around").alias("toxic")), "toxic-features")
    total = {r["f"]: r["clean"] for r in sums.filter(F.col("f").isin("", " ")).collect()}
    n = (total.get("", 0), total.get(" ", 0))
    if not all(n):
        return Model({}, {})
    best = sums.filter((F.length(F.trim("f")) > 0) & (F.col("toxic") >= LEAST_SUPPORT) & (F.col("clean") * n[1] <= F.col("toxic") * n[0] * 0.05))
    model = choose([(r["f"], r["clean"], r["toxic"]) for r in best.collect()], n)

    def paths(batches):
        machine = model.automaton
        for batch in batches:
            counts = [label_counts(t, machine, model.weights) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.list_(pa.int64())), batch.column(1)], names=["counts", "y"])

    seen = chosen.mapInArrow(paths, "counts array<long>, y int").groupBy("counts", "y").agg(F.count("*").alias("n")).collect()
    return Model(model.words, model.stems, fit(sorted((tuple(r["counts"]), r["y"], r["n"]) for r in seen)))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every document."""
    docs = docs.select(id_col, text_col)

    def rows(batches):
        machine = model.automaton
        for batch in batches:
            scores = [score_text(t, machine, model.weights) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[id_col, "score", "predicted"])

    return docs.mapInArrow(rows, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below threshold."""
    at = docs.columns.index(text_col)

    def rows(batches):
        machine = model.automaton
        for batch in batches:
            yield batch.filter(pa.array([score_text(t, machine, model.weights) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
