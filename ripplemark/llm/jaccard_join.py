"""N-gram Jaccard join: rare-first prefix filtering, then one check a pair.

Documents with the same words in the same order are one class, by a
cryptographic digest.  A class's shingles are put in one order, rarest first;
two sets of similarity t share one of the first n - ceil(t n) + 1 of either, so
classes meet on those prefix shingles.  A pair that passes the length,
positional and suffix filters is checked once, on the words of both texts.
Documents linked directly or through others are one component.

Order of rarity: shingles that a task meets often get their count over all
documents.  A shingle that turns out common in prefixes all the same gets its
count over all classes, and the classes that hold it in their prefix get new
ones.  Any order is right; this one keeps what many documents share out of
prefixes.

A prefix shingle of more than ``LOT`` classes is not paired in full at first:
each class meets the one at whose set's begin the shingle stands earliest, which
of a group of near copies is the one with the fewest shingles of its own.  When
components of those links are known, a shingle whose classes lie in several of
them is paired across components, within bands of set sizes that can link.  So
no link between different texts is lost, and groups of near copies do not grow
as squares.

A null text, or one without words, has an empty set and is alone; one of fewer
than k words has its whole sequence as its one shingle; rows with equal ids are
members of their own, each with its text's links; rows with a null id are each
alone, with a null component; an empty table gives an empty result; a text
longer than a slice is cut into words piece by piece; other columns, whatever
their names, are kept by ``keep_one`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACES, Sieve, batches_of, byte_slices, connected_components, give_back, hash_ranges, materialize, scratch, shingles, word_bounds

LOT = 24
FREQUENT = 1 << 18
LEAST_LOCAL = 6
#: Classes from which on a prefix shingle counts as common, and how often prefixes are made anew for such.
COMMON = 4 * LOT
ROUNDS = 3
SKETCH = 128
#: Rows that go to Python at once, and bytes of text that are cut into shingles at once: both bound what a task holds.
BATCH = 500
SLICE = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
Counts = tuple[np.ndarray, np.ndarray]


def shingle_set(text: str | None, k: int) -> set:
    """The distinct k-word shingles of one text, as strings."""
    words = _WORD.findall((text or "").translate(_FOLD))
    if len(words) < k:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def linked(a: set, b: set, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union; sets are not empty."""
    if not a or not b:
        return False
    both = len(a & b)
    return den * both >= num * (len(a) + len(b) - both)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """A cryptographic digest of each document's words, folded, joined by blanks."""
    keep = ~_SPACES[data]
    text = data.copy()
    text[(data >= 65) & (data <= 90)] += 32
    between = np.ones(starts.size, bool)
    between[firsts[1:][np.diff(firsts) > 0] - 1] = False  # not after a document's last word
    keep[ends[between]] = True
    text[ends[between]] = 0x20
    raw, sums = text[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])
    # white space before a document's first word or after its last one is not kept, so documents begin and end at words
    has = np.flatnonzero(np.diff(firsts) > 0)
    out = [hashlib.blake2b(b"", digest_size=16).digest()] * (firsts.size - 1)
    for i, a, b in zip(has.tolist(), sums[starts[firsts[has]]].tolist(), sums[ends[firsts[has + 1] - 1]].tolist(), strict=True):
        out[i] = hashlib.blake2b(raw[a:b], digest_size=16).digest()
    return out


def _sets(data: np.ndarray, k: int, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, in order of document and hash."""
    starts, ends, firsts = words
    found, owner = shingles(hash_ranges(data, starts, ends, True), firsts, k)
    order = np.lexsort((found, owner)) if found.size else np.zeros(0, int)
    found, owner = found[order], owner[order]
    new = np.ones(found.size, bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], found[new]


def _sorted_counts(table: pa.Table) -> Counts:
    hashes, counts = table["g"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def frequent_shingles(rows: DataFrame, k: int, most: int = FREQUENT) -> Counts:
    """(hashes, counts) of the at most `most` commonest of the shingles that some task meets often; only rarity's order depends on it."""

    def local(batches):
        got, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []

        def merge():
            nonlocal got, counts, pending
            found, n = np.unique(np.concatenate(pending), return_counts=True) if pending else (got[:0], counts[:0])
            keep = n >= 2
            both = np.concatenate([got, found[keep]])
            got, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n[keep]]), minlength=got.size).astype(np.int64)
            pending = []

        size = 0
        for batch in batches:
            for _, _, data, offsets in byte_slices(batch.column(0), SLICE):
                pending.append(_sets(data, k, word_bounds(data, offsets))[1])
                size += pending[-1].size
                if size > 1_000_000:
                    merge()
                    size = 0
        merge()
        keep = counts >= LEAST_LOCAL
        yield pa.RecordBatch.from_arrays([pa.array(got[keep].view(np.int64)), pa.array(counts[keep])], names=["g", "n"])
        give_back()

    sums = rows.select("text").mapInArrow(local, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return _sorted_counts(sums.orderBy(F.desc("n"), "g").limit(most).toArrow())


def signatures(rows: DataFrame, common: Counts, k: int, num: int, den: int) -> DataFrame:
    """(id, h, digest, n, prefix, sketch) of rows (id, h, text): digest of the words, set size, prefix shingles rarest first, shingles by bin."""
    sent = rows.sparkSession.sparkContext.broadcast(common)  # at most FREQUENT pairs a round: 4 MB

    def make(batches):
        hashes, counts = sent.value
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(2), SLICE):
                words = word_bounds(data, offsets)
                owner, found = _sets(data, k, words)
                docs_ = high - low
                n = np.bincount(owner, minlength=docs_)
                rank = np.zeros(found.size, np.int64)
                if hashes.size and found.size:
                    at = np.minimum(np.searchsorted(hashes, found), hashes.size - 1)
                    rank = np.where(hashes[at] == found, counts[at], 0)
                order = np.lexsort((found, rank, owner))
                begin = np.concatenate([[0], np.cumsum(n)])
                place = np.arange(found.size) - begin[owner]
                length = n - -(-n * num // den) + 1
                length[n == 0] = 0
                keep = place < length[owner]
                prefix = found[order][keep].view(np.int64)
                bins = np.bincount(owner * SKETCH + (found >> np.uint64(57)).astype(np.int64), minlength=docs_ * SKETCH).reshape(docs_, SKETCH)
                sketch = [r.tobytes() for r in np.minimum(bins, 65535).astype("<u2")]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(prefix))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, docs_), batch.column(1).slice(low, docs_), pa.array(digests(data, *words), pa.binary()), pa.array(n), lists, pa.array(sketch, pa.binary())], names=["id", "h", "digest", "n", "prefix", "sketch"])
        give_back()

    return rows.select("id", "h", "text").mapInArrow(make, "id long, h long, digest binary, n long, prefix array<long>, sketch binary")


def _may_link(a, b, num: int, den: int):
    """Length and positional filters on rows (n, pos) that share a shingle at their places pos.

    The bound takes the shingle for the first that both share, as it is once
    for every pair; where it is a later one the pair may be left out.
    """
    least = F.ceil(F.lit(num) * (a["n"] + b["n"]) / F.lit(num + den))  # intersection needed
    left = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    return (F.lit(den) * F.least(a["n"], b["n"]) >= F.lit(num) * F.greatest(a["n"], b["n"])) & (left >= least)


def _some_of(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Those of texts (id, h, text) that may be among members (i, j, ...): only they are moved to meet them."""
    return Sieve(members.select("i", "j")).met(texts, "id", "h")


def _check(pairs: DataFrame, texts: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) of classes that link: suffix filter by bins first, then on the texts' words.

    texts: (id, h, text); reps: (c, id, h, n, sketch) of the classes.
    """

    def bound(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SKETCH).astype(np.int64) for i in (2, 3))
            most = np.where((x == 65535) | (y == 65535), np.maximum(x, y), np.minimum(x, y)).sum(axis=1)
            n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            open_ = ((x == 65535) & (y == 65535)).any(axis=1)  # a bin full on both sides bounds nothing
            yield batch.filter(pa.array(open_ | (den * most >= num * (n + m - most)))).select(["a", "b"])

    p = pairs.join(reps.select(F.col("c").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a")
    p = p.join(reps.select(F.col("c").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b").select("a", "b", "sa", "sb", "na", "nb")
    p = materialize(p.mapInArrow(bound, "a binary, b binary"), "jaccard-pairs")
    members = p.select(F.col("a").alias("c")).union(p.select(F.col("b").alias("c"))).distinct()
    members = materialize(reps.select("c", F.col("id").alias("i"), F.col("h").alias("j")).join(members, "c", "left_semi"), "jaccard-members")
    for x in ("a", "b"):
        p = p.join(members.select(F.col("c").alias(x), F.col("i").alias(f"i{x}"), F.col("j").alias(f"j{x}")), x)
    some = _some_of(texts, members)  # one shuffle of these serves both joins
    ta, tb = some.alias("ta"), some.alias("tb")
    with_a = p.join(ta, (F.col("ia") == F.col("ta.id")) & (F.col("ja") == F.col("ta.h"))).select("a", "b", "ib", "jb", F.col("ta.text").alias("first"))
    both = with_a.join(tb, (F.col("ib") == F.col("tb.id")) & (F.col("jb") == F.col("tb.h"))).select("a", "b", "first", F.col("tb.text").alias("second"))

    def verify(batches):
        last: dict = {}
        for batch in batches:
            a_ids, b_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (a, b) in enumerate(zip(a_ids, b_ids, strict=True)):
                sets = []
                for key, column in ((a, 2), (b, 3)):
                    if key not in last:
                        if len(last) > 64:
                            last.clear()
                        last[key] = shingle_set(batch.column(column)[i].as_py(), k)
                    sets.append(last[key])
                keep.append(linked(*sets, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        last.clear()
        give_back()

    return both.mapInArrow(verify, "a binary, b binary")


def name_of(id_: Column, digest: Column) -> Column:
    """A member's name: its id, in bytes that sort as ids do, and its digest."""
    return F.concat(F.unhex(F.lpad(F.hex(id_.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), digest)


def id_of(name: Column) -> Column:
    return (F.conv(F.hex(F.substring(name, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def members_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text) of the rows; h is a hash of the text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))


def _shared(rows: DataFrame) -> DataFrame:
    """(g, m) of the shingles of rows that several classes have."""
    return rows.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")


def _reordered(reps: DataFrame, texts: DataFrame, common: Counts, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(prefix shingles that several classes have: g, c, n, pos, m; reps), after new prefixes for classes whose prefix holds what only turned out common over all classes."""
    prefixes = lambda of: of.select("c", "n", F.posexplode("prefix").alias("pos", "g"))
    counts = materialize(_shared(prefixes(reps)), "jaccard-shared")
    for _ in range(ROUNDS):
        known = materialize(counts.filter(F.col("m") >= COMMON), "jaccard-common")
        table = known.orderBy(F.desc("m"), "g").limit(FREQUENT).select("g", F.col("m").alias("n")).toArrow()
        hashes = table["g"].to_numpy().view(np.uint64)
        new = np.isin(hashes, common[0], invert=True)
        if not new.any():
            break
        found = np.concatenate([common[0], hashes[new]])
        order = np.argsort(found)
        common = found[order], np.concatenate([common[1], table["n"].to_numpy()[new]])[order]
        held = prefixes(reps).join(F.broadcast(reps.sparkSession.createDataFrame(pa.table({"g": hashes[new].view(np.int64)}))), "g").select("c").distinct()  # at most FREQUENT
        held = materialize(reps.select("c", F.col("id").alias("i"), F.col("h").alias("j")).join(held, "c", "left_semi"), "jaccard-held")
        again = _some_of(texts, held).join(held, (F.col("id") == F.col("i")) & (F.col("h") == F.col("j"))).select("id", "h", "text")
        fresh = signatures(again, common, k, num, den).select(F.col("id").alias("i"), F.col("h").alias("j"), F.col("prefix").alias("other"))
        fresh = materialize(fresh, "jaccard-fresh")
        sieve = Sieve(held.select("c"))
        some = sieve.met(reps, "c").join(fresh, (F.col("id") == F.col("i")) & (F.col("h") == F.col("j")), "left")
        some = materialize(some.select("c", "id", "h", "n", "prefix", "other", "sketch"), "jaccard-changed")
        after = some.select("c", "id", "h", "n", F.coalesce("other", "prefix").alias("prefix"), "sketch")
        # counts change for shingles in the prefixes that went or came; the others stand
        turned = some.filter("other is not null").select(F.explode(F.concat("prefix", "other")).alias("g")).distinct()
        reps = sieve.unmet(reps, "c").unionByName(after)
        turned = Sieve(turned)
        counts = materialize(turned.unmet(counts, "g").unionByName(_shared(turned.met(prefixes(reps), "g"))), "jaccard-shared")
    shared = Sieve(counts.select("g")).met(prefixes(reps), "g")
    return materialize(shared.join(counts, "g"), "jaccard-prefixes", out=True), reps


def _across(big: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs, other than pairs, of classes (g, c, n, pos, comp) that share a shingle, may link, and lie apart.

    Sets that link differ in size by den / num at most, so each class meets
    those of its own band of sizes and of the next.
    """
    wide = math.log(1.001 * den / num)
    band = F.floor(F.log(F.col("n").cast("double")) / wide)
    big = big.withColumn("band", band)
    x = big.withColumn("next", F.explode(F.array(F.col("band"), F.col("band") + 1))).select("g", "next", *(F.col(c).alias(f"{c}_x") for c in ("c", "n", "pos", "comp")))
    y = big.select(F.col("g").alias("g2"), "band", *(F.col(c).alias(f"{c}_y") for c in ("c", "n", "pos", "comp")))
    cross = x.join(y, (F.col("g") == F.col("g2")) & (F.col("next") == F.col("band")))
    cross = cross.filter((F.struct("n_x", "c_x") < F.struct("n_y", "c_y")) & (F.col("comp_x") != F.col("comp_y")))
    at = lambda s: {c: F.col(f"{c}_{s}") for c in ("n", "pos")}
    cross = cross.filter(_may_link(at("x"), at("y"), num, den)).select(F.least("c_x", "c_y").alias("a"), F.greatest("c_x", "c_y").alias("b")).distinct()
    return cross.join(pairs, ["a", "b"], "left_anti")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(id, h, digest, n of all rows; (digest, name) of all classes with their component's least member)."""
    with scratch(docs.sparkSession), batches_of(docs.sparkSession, BATCH):
        return _links(docs, id_col, text_col, k, num, den)


def _classes(texts: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, ...]:
    """texts (id, h, text), each once; (id, h, digest, n) of all; (digest, c, i, j) of the classes; their prefix shingles as of _reordered; (c, id, h, n, sketch)."""
    common = frequent_shingles(texts, k)
    sigs = materialize(signatures(texts, common, k, num, den), "jaccard-signatures")
    sets = sigs.filter("n > 0 and id is not null")
    classes = sets.groupBy("digest").agg(F.min(F.struct("id", "h")).alias("m"), F.count("*").alias("copies"))
    classes = materialize(classes.select("digest", name_of(F.col("m.id"), F.col("digest")).alias("c"), F.col("m.id").alias("i"), F.col("m.h").alias("j"), "copies"), "jaccard-classes", out=True)
    # a document without copies is its own class's member; only the others meet their classes
    columns = ["c", "id", "h", "n", "prefix", "sketch"]
    copied = Sieve(classes.filter("copies > 1").select("digest"))
    firsts = copied.met(sets, "digest").join(classes, "digest").filter((F.col("id") == F.col("i")) & (F.col("h") == F.col("j"))).dropDuplicates(["digest"])
    alone = copied.unmet(sets, "digest").withColumn("c", name_of(F.col("id"), F.col("digest")))
    reps = materialize(alone.select(columns).unionByName(firsts.select(columns)), "jaccard-reps")  # read several times a round
    sigs = materialize(sigs.select("id", "h", "digest", "n"), "jaccard-rows", keep=True)
    narrow = sigs.select("id", "h")
    if narrow.distinct().count() < sigs.count():  # whole rows that repeat are one text
        texts = materialize(texts.dropDuplicates(["id", "h"]), "jaccard-distinct", out=True)
    rows, reps = _reordered(reps, texts, common, k, num, den)
    return texts, sigs, classes, rows, materialize(reps.select("c", "id", "h", "n", "sketch"), "jaccard-sketches", out=True)


def _links(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    with scratch(docs.sparkSession):  # whole prefixes go when those that classes share are known
        texts, sigs, classes, rows, reps = _classes(members_of(docs, id_col, text_col), k, num, den)
    # of a rare shingle, all classes meet; of a common one, each meets the one with the fewest shingles of its own
    small = rows.filter(F.col("m") <= LOT).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("c", "n", "pos"))).alias("all"))
    meets = small.select(F.explode(F.flatten(F.transform("all", lambda x, i: F.transform(F.filter(F.slice("all", i + 2, F.lit(LOT)), lambda y: _may_link(x, y, num, den)), lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b")))))).alias("p")).select("p.a", "p.b")
    big = rows.filter(F.col("m") > LOT)
    hubs = materialize(big.groupBy("g").agg(F.min(F.struct("pos", "c", "n")).alias("x")), "jaccard-hubs")
    star = big.join(hubs, "g").filter(F.col("x.c") != F.col("c"))
    star = star.filter(_may_link(F.col("x"), F.struct("n", "pos"), num, den)).select(F.least("x.c", "c").alias("a"), F.greatest("x.c", "c").alias("b"))
    pairs = materialize(meets.union(star).distinct(), "jaccard-candidates")
    links = materialize(_check(pairs, texts, reps, k, num, den), "jaccard-links")
    components = connected_components(links, "jaccard-components")
    # what the hubs left out: classes of one common shingle that are not yet in one component
    big = big.select("g", "c", "n", "pos").join(components, F.col("c") == F.col("node"), "left")
    big = materialize(big.select("g", "c", "n", "pos", F.coalesce("component", "c").alias("comp")), "jaccard-placed")  # read twice
    apart = big.groupBy("g").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select("g")
    big = materialize(big.join(materialize(apart, "jaccard-split"), "g"), "jaccard-apart")
    if not big.isEmpty():
        cross = materialize(_across(big, pairs, num, den), "jaccard-cross")
        if not cross.isEmpty():
            more = materialize(_check(cross, texts, reps, k, num, den), "jaccard-more")
            if not more.isEmpty():
                components = connected_components(links.union(more), "jaccard-components")
    named = classes.select("digest", "c").join(components, F.col("c") == F.col("node"), "left").select("digest", F.coalesce("component", "c").alias("name"))
    return sigs, materialize(named, "jaccard-named", keep=True)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """id, n_shingles and component_id (the least id linked, directly or not) of every row."""
    sigs, named = jaccard_links(docs, id_col, text_col, k, num, den)
    out = sigs.join(named, "digest", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, id_of(F.col("name"))), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without those linked to a member before them (of smaller id, or digest); of rows with equal ids and words one stays, those without words or id all stay."""
    sigs, named = jaccard_links(docs, id_col, text_col, k, num, den)
    judged = sigs.filter("n > 0 and id is not null").join(named, "digest").select("id", "h", "digest", (F.col("name") == name_of(F.col("id"), F.col("digest"))).alias("first"))
    judged = materialize(judged, "jaccard-judged")
    gone = materialize(judged.filter("not first").select(F.col("id").alias("i"), F.col("h").alias("j")).distinct(), "jaccard-gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    sieve = Sieve(gone)
    kept = sieve.unmet(rows, "id", "h").unionByName(sieve.met(rows, "id", "h").join(gone, (F.col("id") == F.col("i")) & (F.col("h") == F.col("j")), "left_anti"))
    # rows of one id and the same words
    twice = judged.filter("first").groupBy("id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("id", "digest")
    twice = materialize(judged.filter("first").join(twice, ["id", "digest"]).select(F.col("id").alias("i"), F.col("h").alias("j"), "digest").distinct(), "jaccard-repeated")
    own = (F.col("id") == F.col("i")) & (F.col("h") == F.col("j"))
    if not twice.isEmpty():
        again = kept.join(twice, own).groupBy("id", "digest").agg(F.min_by("row", F.struct("text", F.xxhash64("row"))).alias("row"))
        kept = kept.join(twice, own, "left_anti").select("row").unionByName(again.select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
