"""Plain versions of the operators, one row or pair at a time."""

import collections
import hashlib
import math
import re
import unicodedata
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, length):
    """rows: (id, text); {id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def components(rows, k, num, den):
    """rows: (id, text); {id: (n_shingles, component)}, over all pairs."""
    sets = {key: shingle_set(text, k) for key, text in rows}
    parent = {key: key for key in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {key: (len(sets[key]), root(key)) for key in keys}


def targets(sizes, weights, share, times):
    """sizes: {source: words}; {source: target}, by filling again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        rest = [s for s in order if s not in stopped]
        level = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if level[s] > times * sizes[s]]
        if not over:
            return stopped | level
        stopped |= {s: float(times * sizes[s]) for s in over}


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def repeated_lines_and_words(text):
    """(lines with a word equal to an earlier one, words in 3-word windows found twice or more)."""
    text = text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 500 else {x for x, n in collections.Counter(windows).items() if n > 1}
    return len(lines) - len(set(lines)), len({i + j for i, x in enumerate(windows) if x in twice for j in range(3)})


def rules(text):
    """(base_failed, kept)."""
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    again, repeated = repeated_lines_and_words(text)
    failed = len(w) < 50 or 100 * repeated > 50 * len(w)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    chars = sum(map(len, w))
    bad = 10 * sum(c in "#*$%&|<>" for c in text) > len(w) or 10 * again > 6 * len(lines) or 100 * repeated > 40 * len(w)
    bad = bad or chars < 2 * len(w) or chars > 20 * len(w) or 2 * upper > upper + lower
    bad = bad or 10 * sum(bool(re.search("[a-zA-Z]|[^\0-\x7f]", x)) for x in w) < 7 * len(w)
    return failed, not failed and not bad


def language(text, model, switch=12.0):
    """(language, share of its letters) by a plain Viterbi over words, whose scores are looked up n-gram by n-gram."""
    from ripplemark.llm import langid

    words, run = [], []
    for c in [*(text or ""), None]:
        if c is not None and unicodedata.category(c)[0] == "L" and ord(c) < 0x30000:
            run.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif run:
            words.append(run)
            run = []
    if not words:
        return "und", 0.0

    def slot(order, parts):
        h = (0x811C9DC5 + order) & 0xFFFFFFFF
        for p in parts:
            h = ((h ^ p) * 0x9E3779B1) & 0xFFFFFFFF
            h ^= h >> 15
        return ((h * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - langid.BITS)

    def scores(w):
        total = [0.0] * len(model.languages)
        for i, c in enumerate(w):
            before, after = w[i - 1] if i else 1, w[i + 1] if i + 1 < len(w) else 2
            for order, parts in enumerate(((c,), (before, c), (before, c, after))):
                total = [t + float(x) for t, x in zip(total, model.scores[order][slot(order, parts)], strict=True)]
        script = [kind for first, kind in langid.SCRIPTS if first <= w[0]][-1]
        return [t - (0 if fine else 1e4) for t, fine in zip(total, model.allowed[script], strict=True)]

    best, back = scores(words[0]), []
    for w in words[1:]:
        top = max(range(len(best)), key=lambda k: (best[k], -k))
        came = [k if best[k] >= best[top] - switch else top for k in range(len(best))]
        best = [best[c] - (switch if c != k else 0) + x for k, (c, x) in enumerate(zip(came, scores(w), strict=True))]
        back.append(came)
    path = [max(range(len(best)), key=lambda k: (best[k], -k))]
    for came in reversed(back):
        path.append(came[path[-1]])
    held = [0] * len(model.languages)
    for w, k in zip(words, reversed(path), strict=True):
        held[k] += len(w)
    top = max(range(len(held)), key=lambda k: (held[k], -k))
    return model.languages[top], held[top] / sum(held)


def kept_texts(rows, length):
    """rows: (id, text); {id: the text without what repeats}; what a cut leaves of a character goes too."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out[key] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else text
    return out


def toxic_score(text, model):
    """The grammar's score hit by hit; weights of aimed hits are not negative, and no two threat verbs share a target."""
    from ripplemark.llm import toxicity as T

    w, total = model.weights, model.weights["0"]
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        insult = [x not in T.THREATS and (x in model.words or any(x.startswith(s) for s in model.stems)) for x in words]
        target = [x in T.TARGETS or x in T.OBJECTS for x in words]
        for i, x in enumerate(words):
            if not insult[i] and x not in T.THREATS:
                continue
            around = lambda n: range(max(0, i - n), i)  # noqa: B023,E731
            value = w["N"] * any(words[j] in T.NEGATIONS and not insult[j] for j in around(T.DENIAL)) + w["Q"] * any(words[j] in T.REPORTS and not insult[j] for j in around(T.REPORT))
            if insult[i]:
                near = any(target[j] and not insult[j] for j in [*around(T.AIM), *range(i + 1, min(len(words), i + 1 + T.AIM))])
                total += max(0.0, value + w["J" if i and insult[i - 1] else "I"] + w["A"] * near)
            elif any(words[j] in T.OBJECTS and not insult[j] for j in around(T.GRIP)):
                total += value + w["T"]
            elif any(target[j] and not insult[j] for j in range(i + 1, min(len(words), i + 1 + T.GRIP))):
                total += max(0.0, value + w["T"])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def quality_features(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    again, repeated = repeated_lines_and_words(text)
    n, chars = len(w), sum(map(len, w))
    count = lambda chars_: sum(c in chars_ for c in text)
    upper, lower, digits = (sum(a <= c <= b for c in text) for a, b in ("AZ", "az", "09"))
    ratio = lambda a, b, e=0.01: math.log((a + e) / (b + 1))
    worded = sum(bool(re.search("[a-zA-Z]|[^\0-\x7f]", x)) for x in w)
    return [math.log1p(n), math.log((chars + 5) / (n + 1)), ratio(count("#*$%&|<>"), n), ratio(count("!?"), n), ratio(count(".,;:'\"()-"), n, 0.1), ratio(again, len(lines)), ratio(repeated, n), (len(set(w)) + 1) / (n + 1), (upper + 1) / (upper + lower + 2), ratio(digits, chars), (worded + 1) / (n + 1), math.log((len(lines) + 1) / (n + 1))]
