"""Operators against brute force on small fixtures and on the smallest tables."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ripplemark.llm import common, cover_tree, jaccard_join, langid, mixture, quality_qda, queries, rules_cascade, sentencepiece_scan, suffix_dedup, token_records, toxicity

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
PIECES = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


def words(rng, n, pool=60):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def odd_rows(seed=1):
    """Nulls, empty and short texts, ties, copies, near copies, shared passages, one long text."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(20, 120), 500) for _ in range(30)]
    passage = words(rng, 60, 900)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)]
    for i in range(30):
        w = base[i % 6].split()
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{words(rng, 15, 900)} {passage}\n{words(rng, 9, 900)}") for i in range(12)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "a"), (404, "A b"), (405, "a B"), (406, "ab" * 300), (407, "é" * 260), (408, words(rng, 4000, 700)), (409, "日本語" * 90)]
    rng.shuffle(rows)
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ----------------------------------------------------------------------- kernels


def test_words_and_shingles():
    texts = ["", "a", "  a b\x0bc ", None, "é\x1cx y z y z", " \n"]
    for _, _, data, offsets in common.byte_slices(pa.array(texts)):
        starts, ends, firsts = common.word_bounds(data, offsets)
        got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
        want = [brute.WORD.findall(t or "") for t in texts]
        assert got == sum(want, [])
        assert np.diff(firsts).tolist() == list(map(len, want))
        found, owner = common.shingles(common.Hasher(data)(starts, ends), firsts, 3)
        assert np.bincount(owner, minlength=6).tolist() == [max(len(w) - 2, min(1, len(w))) for w in want]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50}
    assert common.connected_components(edges.limit(0)).isEmpty()


# ------------------------------------------------------------------- op 1, op 8


def test_sentencepiece_equals_the_library(spark, odd):
    codec = sentencepiece_scan.codec_of(PIECES)
    for size in (1 << 16, 64):
        got = {r["doc_id"]: r for r in sentencepiece_scan.encode_documents(odd, PIECES, size=size).collect()}
        for r in odd.collect():
            ids = np.frombuffer(got[r["doc_id"]]["ids"], "<i4").tolist()
            assert ids == codec.whole.encode(r["text"] or ""), (size, r["doc_id"])
        assert max(r["n_chunks"] for r in got.values()) > (size == 64)
        texts = {r["doc_id"]: r["text"] for r in sentencepiece_scan.decode_documents(sentencepiece_scan.encode_documents(odd, PIECES, size=size), PIECES).collect()}
        assert texts == {r["doc_id"]: r["text"] or "" for r in odd.collect()}


def test_sentencepiece_scan_without_blanks():
    codec, rng = sentencepiece_scan.codec_of(PIECES), random.Random(2)
    for turn in range(60):
        text = "".join(rng.choice(["the", "tion", "a", "é", "日", "x", "ing", "  ", "\n", "th", "Œ", "1"] if turn % 2 else ["a", "b", "th", "er"]) for _ in range(rng.randrange(1, 200)))
        states = sentencepiece_scan.cut_states(text, codec, 20)
        chunks = [sentencepiece_scan.Chunk(text, 0, a, b, codec, 1 + turn % 9) for a, b in zip(states, states[1:], strict=False)]
        inside = sentencepiece_scan.scan([c.entries(codec) for c in chunks], codec)
        places = [0, *inside, len(text)]
        assert np.concatenate([c.ids(p, q) for c, p, q in zip(chunks, places, places[1:], strict=False)]).tolist() == codec.whole.encode(text)
        for c, ins, outs in zip(chunks, states, states[1:], strict=False):  # each cell is the encoding of its own part
            for (p, q), e in c.entries(codec).items():
                want = codec.encode(text[p:q], first=p == 0)
                assert c.ids(p, q).tolist() == want and e.score == pytest.approx(float(codec.scores[want].sum())) and (e.first, e.last) == (want[0], want[-1])


def test_sentencepiece_of_documents_in_small_chunks(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents").withColumn("row", F.lit(1)).withColumn("chunk", F.lit(2)).withColumn("id", F.lit(3))
    codec = sentencepiece_scan.codec_of(PIECES)
    encoded = sentencepiece_scan.encode_documents(docs, PIECES, size=500)
    got = {r["doc_id"]: r for r in encoded.collect()}
    assert max(r["n_chunks"] for r in got.values()) > 20
    for r in docs.collect():
        ids = np.frombuffer(got[r["doc_id"]]["ids"], "<i4")
        assert ids.tolist() == codec.whole.encode(r["text"] or "") and codec.decode(ids, 100) == codec.whole.decode(ids.tolist()) == (r["text"] or "")


def test_sentencepiece_of_a_giant_text_without_blanks(spark, empty):
    rng = random.Random(17)
    text = "".join(rng.choice(["the", "tion", "a", "é", "日本", "x", "ing", "Œ", "1", "qu"]) for _ in range(200_000))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[:70_000]), (2, None)], "doc_id long, text string")
    codec = sentencepiece_scan.codec_of(PIECES)
    got = [(r["doc_id"], r["n_chunks"], np.frombuffer(r["ids"], "<i4").tolist()) for r in sentencepiece_scan.encode_documents(docs, PIECES).collect()]
    want = codec.whole.encode(text)
    assert sorted(n for _, n, _ in got) == [1, 2, 1 + len(text) // 65_540, 1 + len(text) // 65_540]
    assert all(ids == (want if key == 1 else codec.whole.encode(text[:70_000]) if key is None else []) for key, _, ids in got)
    # only the ends of a chunk are encoded for each place
    states, spent = sentencepiece_scan.cut_states(text, codec), []
    tokens = codec.tokens
    codec.tokens = lambda t, first: (spent.append(len(t)), tokens(t, first))[1]
    sentencepiece_scan.Chunk(text, 0, states[1], states[2], codec)
    del codec.tokens
    assert sum(spent) < 1.5 * 65_536
    assert sentencepiece_scan.encode_documents(empty, PIECES).isEmpty()


def test_max_plus_product_is_associative():
    codec, text = sentencepiece_scan.codec_of(PIECES), "thetionerthing" * 8
    states = [[0], [30, 31, 32, 33, 34], [60, 61, 62, 63, 64], [len(text)]]
    a, b, c = (sentencepiece_scan.matrix(text, 0, p, q, codec) for p, q in zip(states, states[1:], strict=False))
    join = lambda x, y: sentencepiece_scan.combine(x, y, codec)
    assert {k: (e.first, e.last, e.inside) for k, e in join(join(a, b), c).items()} == {k: (e.first, e.last, e.inside) for k, e in join(a, join(b, c)).items()}


def test_token_records(spark, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/r"
    got = {r["doc_id"]: r for r in token_records.token_records(odd, BPE, folder=folder).collect()}
    library = Tokenizer.from_file(BPE)
    start = 0
    for r in sorted(odd.collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(got[r["doc_id"]])[1:] == (start, len(ids), brute.crc(ids))
        start += len(ids)
    part = max(range(8), key=lambda p: len(token_records.read_index(folder, p)) if (tmp_path / f"r/tokens-{p:06d}.idx").exists() else 0)
    plain = list(token_records.read_records(folder, part, 50257))
    order = random.Random(3).sample(range(len(plain)), len(plain))
    for k, (key, ids) in zip(order, token_records.read_records(folder, part, 50257, order), strict=True):
        assert key == plain[k][0] and (ids == plain[k][1]).all()
    record = token_records.frame(b"abc")
    assert token_records.unframe(record) == b"abc"
    for i in range(len(record)):
        with pytest.raises(ValueError):
            token_records.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])
    assert token_records.token_records(empty, BPE).isEmpty()
    twice = spark.createDataFrame([(None, "b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert token_records.token_records(twice, BPE).count() == 4


def test_batch_encoder_on_odd_blanks():
    rng, encoder, fresh = random.Random(4), token_records.BatchEncoder(BPE), Tokenizer.from_file(BPE)
    texts = ["".join(rng.choice([" ", "  ", "a", "é", " b", "'s", "\n", "　", " ", "1", "!", "日", " ß", " ", "\x85", "\x1c", "<|endoftext|>"]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    for _ in range(2):  # the second time from what it has kept
        for low, _, data, offsets in common.byte_slices(pa.array(texts), 4000):
            ids, upto = encoder.encode(data, offsets)
            for i in range(offsets.size - 1):
                assert ids[upto[i] : upto[i + 1]].tolist() == fresh.encode(texts[low + i], add_special_tokens=False).ids, texts[low + i]


def alike_words(n):
    """Two words of Thue-Morse shape: hashes modulo a power of two take long ones of them for equal."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_made_to_collide(spark, size):
    x, y = alike_words(size)
    fresh, encoder = Tokenizer.from_file(BPE), token_records.BatchEncoder(BPE)
    for texts in ([f"a {x} {y}"], [f"b {y} {x} {x}"]):
        for _, _, data, offsets in common.byte_slices(pa.array(texts)):
            assert encoder.encode(data, offsets)[0].tolist() == fresh.encode(texts[0], add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x}\n{y}\n{x}"), (4, f"{x} {x} {x} {y} {x} {x}")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard_join.jaccard_components(docs.filter("doc_id < 3")).orderBy("doc_id").collect()] == [(1, 1, 1), (2, 1, 2)]
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in rules_cascade.quality_rules(docs).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (0, 0)}


def test_equality_is_by_bytes(monkeypatch):
    """With a hash that takes nearly all for equal, the same results."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "b", "cc", "d\n", "e e e", "\n"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    fresh, encoder = Tokenizer.from_file(BPE), token_records.BatchEncoder(BPE)
    for module in (rules_cascade, token_records):
        monkeypatch.setattr(module, "hash_ranges", lambda data, starts, ends, *_: (ends - starts).astype(np.uint64) % np.uint64(2))
    for _, _, data, offsets in common.byte_slices(pa.array(texts)):
        s = rules_cascade.Statistics(data, offsets)
        for i, t in enumerate(texts):
            assert (s["n_dup_lines"][i], s["n_repeat_words"][i]) == brute.repeated_lines_and_words(t)
        for _ in range(2):
            ids, upto = encoder.encode(data, offsets)
            assert [ids[upto[i] : upto[i + 1]].tolist() for i in range(len(texts))] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_of_repeated_and_null_ids(spark):
    rows = [(None, f"n{i}") for i in range(60)] + [(7, f"r{i}") for i in range(90)] + [(i, "x y") for i in range(40)] + [(7, "r1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = sorted((tuple(r) for r in token_records.token_records(docs, BPE).collect()), key=lambda r: r[1])
    fresh, at = Tokenizer.from_file(BPE), 0
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = sorted((-1 if key is None else key, brute.crc([*fresh.encode(t, add_special_tokens=False).ids, 2])) for key, t in rows)
    assert sorted((-1 if r[0] is None else r[0], r[3]) for r in got) == want


def test_batch_encoder_matches_added_tokens():
    fresh, encoder = Tokenizer.from_file(BPE), token_records.BatchEncoder(BPE)
    assert fresh.encode("a b <|endoftext|> c", add_special_tokens=False).ids == [64, 275, 220, 50256, 269]
    rng = random.Random(6)
    texts = ["a b <|endoftext|> c", "x y<|endof", "text|> z", "<|endoftext|>", "", "<|endoftext|><|endoftext|> the end <|endoftext", "é <|endoftext|>\n w"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|endof", "text|>", " ", " word", "a", "é", "\n"]) for _ in range(rng.randrange(12))) for _ in range(1000)]
    for _ in range(2):  # the second time from what it has kept
        for low, _, data, offsets in common.byte_slices(pa.array(texts), 4000):
            ids, upto = encoder.encode(data, offsets)
            for i in range(offsets.size - 1):
                assert ids[upto[i] : upto[i + 1]].tolist() == fresh.encode(texts[low + i], add_special_tokens=False).ids, texts[low + i]


# ------------------------------------------------------------------------- op 2


def test_language_of_held_out_documents(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    got = queries.op2_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_spans_and_odd_rows(spark, sf_dir):
    rows = [(i, "the quick thing and that other thing " * 3, "en") for i in range(30)] + [(100 + i, "der schnelle und nicht der andere für " * 3, "de") for i in range(30)] + [(200 + i, "это просто слова и ещё слова " * 3, "ru") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, "lang", "text", F.lit(True), "doc_id")
    assert model.languages == ("de", "en", "ru")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the quick thing and that " * 4 + "der schnelle und nicht der andere " * 4), (5, "слова"), (5, "слова"), (6, "the " * 30000)], "doc_id long, text string")
    got = [tuple(r) for r in langid.identify(odd, model).collect()]
    assert [r[1] for r in got[:3]] == ["und"] * 3 and got[3][3] == 2 and [r[1] for r in got[4:6]] == ["ru", "ru"] and got[6][1] == "en"
    spans = langid.language_spans(odd.filter("doc_id = 4"), model).collect()
    assert [(r["lang"], r["first_word"], r["n_words"]) for r in spans] == [("en", 0, 20), ("de", 20, 24)]
    none = langid.train(docs.limit(0), "lang", "text", F.lit(True), "doc_id")
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).isEmpty()


def test_hundreds_of_languages(spark, monkeypatch):
    """A letter pair of its own for each language: all are told apart, and pieces change nothing."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, " ".join([letters[k // 26 % 26] + letters[k % 26] * 2 + str(k // 676)] * 12), f"l{k:03d}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, "lang", "text", F.lit(True), "doc_id")
    clash = docs.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit("y"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(clash, model).collect()}
    assert len(set(got.values())) > 200 and sum(got[k] == lang for k, _, lang in rows) > 250
    text = (" ".join(t for _, t, _ in rows) + " éà ") * 3
    for _, _, data, offsets in common.byte_slices(pa.array([text, None, "ab", text])):
        whole = langid._label(data, offsets, model, 12.0)
        monkeypatch.setattr(langid, "PIECE", 700)
        monkeypatch.setattr(langid, "CELLS", 9000)
        parts = langid._label(data, offsets, model, 12.0)
    assert (whole[0].documents == parts[0].documents).all() and (whole[1] == parts[1]).all() and np.allclose(whole[0].scores, parts[0].scores, atol=1e-3)


def test_language_of_documents_equals_plain_version(spark, sf_dir):
    """Words, scores and the best path, one word at a time."""
    docs = common.read_table(spark, sf_dir, "documents")
    model = langid.train(docs, "lang", "text", queries.remainder("doc_id", 5) != 0, "doc_id")
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, sf_dir).collect()}
    for r in docs.limit(60).collect():
        if len(r["text"] or "") > 20_000:
            continue
        want = brute.language(r["text"], model)
        assert got[r["doc_id"]]["lang_pred"] == want[0] and got[r["doc_id"]]["score"] == pytest.approx(want[1])


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(5)
    firsts = np.array([0, 0, 5, 6, 12])
    scores = rng.normal(0, 6, (12, 3)).astype(np.float32)
    got = langid.viterbi(scores, firsts, 4.0)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if a == b:
            continue
        value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 4.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert value(tuple(got[a:b])) == pytest.approx(value(best), abs=1e-4)


# ------------------------------------------------------------------------- op 3


@pytest.mark.parametrize(("spread", "block"), [(0.0, 4096), (1.0, 40), (1e7, 40), (2.0**40, 40), (1e300, 4096)])
def test_top_k_equals_brute_force(spark, monkeypatch, spread, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "GROUP", 10)
    monkeypatch.setattr(cover_tree, "SALT_ROWS", 100)
    monkeypatch.setattr(cover_tree, "LEAF", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1 + spread, (700, 8)).astype(float)
    x[100:300] = x[100]
    x[301] = 0
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (704, []), (None, [1.0] * 8), (705, [1.0, 2.0]), (706, [2.0**41, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("other")).withColumn("node", F.lit(1))
    got = [tuple(r) for r in cover_tree.top_k(table, F.col("id") % 20 == 0, k=7).orderBy("query_id", "rank").collect()]
    y = {i: np.array([math.floor(64 * v) for v in [*r, *[0.0] * (8 - len(r))]], object) for i, r in rows if i is not None and (i < 700 or i > 704)}
    end = (1 << 63) - 1
    want = []
    for q in sorted(i for i in y if i % 20 == 0):
        best = sorted((-max(-end, min(end, int(y[q] @ v))), i) for i, v in y.items() if i != q)[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    assert cover_tree.top_k(table.limit(0), F.col("id") % 20 == 0).isEmpty()
    assert cover_tree.top_k(table.filter("vec_id < 3"), F.col("id") % 20 == 0, k=20).count() == 2


def test_levels_cover_their_vectors(spark):
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(c, 1, (200, 4)) for c in range(0, 100, 10)] + [np.zeros((90, 4))])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    leaves, levels = cover_tree.grow(rows, 30, 4, 1.0, "test")
    assert len(levels) > 1
    nodes = {r["node"]: r for level in levels for r in level.collect()}
    parts = {}
    for r in leaves.collect():
        node = nodes[r["node"]]
        assert not node["open"] and np.sqrt(np.square(np.array(r["v"]) - node["centre"]).sum()) <= node["radius"] + 1e-9
        parts[r["node"], r["part"]] = parts.get((r["node"], r["part"]), 0) + 1
    assert sum(parts.values()) == len(x) and all(n <= 30 or nodes[node]["radius"] == 0 for (node, _), n in parts.items())
    # far clusters are not met
    groups = spark.createDataFrame([(1, [90.0] * 4, 0.5, 30_000)], "g long, centre array<double>, radius double, worst long")
    met = cover_tree._reached(groups, levels, cover_tree.Space(4, 100.0)).collect()
    assert 0 < len(met) < len({r["node"] for r in leaves.collect()}) / 3
    assert all(sum(90.0 * v for v in r["v"]) < 30_000 for r in leaves.collect() if r["node"] not in {m["node"] for m in met})


# -------------------------------------------------------------------- op 4, op 5


def _auc(rows):
    pos, neg = ([r["score"] for r in rows if r["y"] == k] for k in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, sf).join(common.read_table(spark, sf, "labels").withColumnRenamed("toxic", "y"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert _auc(held) > 0.9  # some of the labels are wrong
    assert sum(r["predicted"] == r["y"] for r in held) >= 0.97 * len(held)


def test_grammar_weighs_clauses():
    model = toxicity.Model({"moron": 5.0, "scum": 4.0}, {"lowei": 5.0})
    m, w = model.automaton, model.weights
    score = lambda t: toxicity.score_text(t, m, w)
    plain, before, after, negated, told = map(score, ("Such a moron.", "You are a moron.", "A moron, that is you.", "That is not a moron.", "They wrote that such a moron."))
    assert score("") < negated < plain < before == after and score("") < told < plain < 0.5
    assert score("a moron here. and there a moron") > 0.5 > plain  # two clauses
    assert toxicity.clauses("Loweischaft. oxymoron moronic", m) == ["i"]
    assert toxicity.clauses("a moron; a moron\nfine words", m) == ["wi", "wi"]
    assert score("I will kill you") > 0.5 and score("they kill time") < 0.5 and score("never will I kill you") < score("I will kill you")
    assert score("dich werde ich umbringen") > 0.5 and score("il va te tuer") > 0.5
    assert toxicity.score_text(None, m, w) == score("") == score("nothing here") < 0.05
    # a target, a negation or a report far off in an endless clause, and hits at both its ends
    far = "word " * 3000
    assert score(f"you {far} moron") == plain and score(f"moron {far} you are a moron") == score("moron. you are a moron")
    assert score(f"{far} not a moron {far}") == negated


def test_transducers_equal_brute_force():
    """The composed machine's best path is the best over all paths through the five transducers, one after the other."""
    parts, rng = toxicity.transducers(), random.Random(13)

    def runs(machine, symbols, state=0):
        if not symbols:
            if state in machine.finals:
                yield "", ""
            return
        for after, out, labels in machine.arcs.get((state, symbols[0]), ()):
            for rest, more in runs(machine, symbols[1:], after):
                yield out + rest, labels + more

    for turn in range(300):
        classes = "".join(rng.choice("wivgonri") for _ in range(rng.randrange(1, 8)))
        weights = dict(zip(toxicity.LABELS, toxicity.PRIOR if turn % 2 else [rng.uniform(-2, 2) for _ in toxicity.LABELS], strict=True))
        paths = {(classes, "")}
        for part in parts:
            paths = {(out, labels + more) for symbols, labels in paths for out, more in runs(part, symbols)}
        values = [sum(weights[x] for x in labels) for _, labels in paths]
        got, labels = toxicity.grammar().best(classes, weights)
        assert got == pytest.approx(max(values)) and sum(weights[x] for x in labels) == pytest.approx(got)
    assert len({labels for c in ("ig", "nig", "rig", "vg", "ii", "w") for _, labels in [toxicity.grammar().best(c, dict(zip(toxicity.LABELS, toxicity.PRIOR, strict=True)))]}) == 6


def test_toxicity_equals_plain_version(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.read_table(spark, sf_dir, "labels"), queries.remainder("doc_id", 5) == 0)
    machine, rng = model.automaton, random.Random(19)
    assert model.weights["A"] >= 0
    texts = [r["text"] for r in docs.collect()]
    pool = [*list(model.words)[:4], "you", "dich", "not", "said", "a", "b", "the", ".", "x1"]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ["I will kill you", "kill the time", "dich nicht töten", "he said he would never hurt you. you"]
    for t in texts:
        assert toxicity.score_text(t, machine, model.weights) == pytest.approx(brute.toxic_score(t, model), abs=1e-9), t


def test_weights_are_learned():
    rows = [((1, 0, 0, 0, 0, 0, 0), 0, 900), ((1, 1, 0, 0, 0, 0, 0), 0, 30), ((1, 2, 0, 0, 0, 0, 0), 1, 100), ((1, 1, 0, 0, 1, 0, 0), 1, 20), ((1, 2, 0, 0, 0, 2, 0), 0, 40)]
    w = toxicity.fit(rows)
    odds = lambda counts: sum(w[x] * c for x, c in zip(toxicity.LABELS, counts, strict=True))
    assert all((odds(c) > 0) == bool(y) for c, y, _ in rows) and w["A"] > 0 > w["N"]
    assert odds((1, 0, 0, 1, 0, 0, 0)) >= toxicity.MARGIN - 1e-9
    only = toxicity.fit([((1, 1, 0, 0, 0, 0, 0), 1, 500), ((1, 0, 0, 0, 0, 0, 0), 0, 500)])
    assert only["0"] + only["I"] <= -toxicity.MARGIN + 1e-9  # a lone word is not enough, whatever the labels say


def test_grammar_beats_the_word_list(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.read_table(spark, sf, "documents"), common.read_table(spark, sf, "labels")
    model = toxicity.train(docs, labels, queries.remainder("doc_id", 5) == 0)
    machine, wrong = model.automaton, [0, 0]
    for r in docs.join(labels, "doc_id").filter((queries.remainder("doc_id", 5) == 0) & F.col("toxic").isNotNull()).collect():
        found = any(c == "i" for _, c in toxicity.hits_of((r["text"] or "").lower(), machine).values())
        wrong[0] += (toxicity.score_text(r["text"], machine, model.weights) >= 0.5) != r["toxic"]
        wrong[1] += found != r["toxic"]
    assert wrong[0] < wrong[1]


def test_toxicity_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([(i, f"you awful {chr(97 + i % 26) * (2 + i // 26)} blorg here" if i % 2 else f"fine {chr(97 + i % 26) * 2} words here") for i in range(40)] + [(None, None), (41, ""), (42, "blorg " * 5000)], "doc_id long, text string").withColumn("_label", F.lit("x")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None), (3, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(False))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, model).collect()}
    assert got[3] == 1 and got[4] == 0 and got[41] == 0 and got[None] == 0 and got[42] == 1
    kept = toxicity.without_toxic(docs, model)
    assert kept.count() == 22 and kept.columns == docs.columns
    assert toxicity.train(docs, labels.limit(0), F.lit(False)) == toxicity.Model({}, {})
    assert toxicity.score_documents(empty, model).isEmpty()


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_quality(spark, sf).join(common.read_table(spark, sf, "labels").withColumnRenamed("quality", "y"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert _auc(held) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_qda_density_equals_the_formula():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, (80, 3)), rng.normal(1, 2, (120, 3))])
    y = np.repeat([0, 1], [80, 120])
    model = quality_qda.fit(x, y)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    logs = []
    for k in (0, 1):
        own = z[y == k]
        cov = 0.9 * np.cov(own, rowvar=False, bias=True) + 0.1 * np.diag(own.var(axis=0)) + 0.01 * np.eye(3)
        d = z - own.mean(axis=0)
        logs.append(np.log(len(own) / 200) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)
    assert quality_qda.fit(x, np.zeros(200)) is None


def test_quality_features_equal_plain_version(odd):
    texts = [r["text"] for r in odd.collect()] + ["THE End! a-b (c) 12 # $\n\nx x x x\nx x x x\n", "é 1 2 3"]
    for _, _, data, offsets in common.byte_slices(pa.array(texts)):
        got = quality_qda.features(data, offsets)
        assert got == pytest.approx(np.array([brute.quality_features(t) for t in texts]), abs=1e-9)


def test_quality_odd_rows(spark, odd, empty):
    none = quality_qda.classify(odd, None).collect()
    assert len(none) == odd.count() and {r["score"] for r in none} == {0.5}
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(1).alias("text"))
    model = quality_qda.train(odd, labels, F.lit(False))
    got = quality_qda.classify(odd, model).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality_qda.train(empty, labels.limit(0), F.lit(False)) is None
    assert quality_qda.classify(empty, model).isEmpty()


# ------------------------------------------------------------------------- op 6


def _check_mix(docs, block):
    rows = docs.collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    got = mixture.mix_digest(docs, block=block).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in got) == sorted((r["doc_id"] if r["doc_id"] is not None else -1, size(r["text"])) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    want = brute.targets(sizes, (3, 1, 2), 1.5, 2)
    source = {r["doc_id"]: r["source"] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5 + 1e-6 or t == 1 > want[s] > 0, (s, t, want[s])
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixture.mix_digest(docs, block=block).collect()), key=repr)
    return got


def test_mixture(spark, odd, empty, sf_dir):
    _check_mix(odd, 16)
    _check_mix(common.read_table(spark, sf_dir, "documents"), mixture.BLOCK)
    assert mixture.mix_digest(empty).isEmpty()
    one = spark.createDataFrame([(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (2, None, "en", "y", 0)], DOCS)
    assert sum(r["taken"] for r in mixture.mix_digest(one, block=1).collect()) == 9


def test_mixed_documents(spark, odd):
    taken = {r["doc_id"]: r["taken"] for r in mixture.mix_digest(odd, block=16).collect()}
    got = {}
    whole = {r["doc_id"]: r["text"] for r in odd.collect()}
    mixed = mixture.mixed_documents(odd, block=16)
    assert mixed.columns == odd.columns
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(brute.WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and set(brute.WORD.findall(r["text"])) <= set(brute.WORD.findall(whole[r["doc_id"]]))
    assert got == {k: v for k, v in taken.items() if v}


def test_mix_is_dealt_to_shards(spark, odd, monkeypatch):
    monkeypatch.setattr(mixture, "CHUNK", 16)
    got = mixture.mix_shards(odd, block=16).collect()
    taken, dealt, blocks = {}, {}, {}
    for r in got:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["words"]
        dealt.setdefault((r["rank"], r["slot"]), set()).add((r["shard"], r["order"], r["pass"], r["block"]))
        blocks.setdefault((r["rank"], r["slot"]), []).append((r["at"], r["words"]))
    assert taken == {r["doc_id"]: r["taken"] for r in mixture.mix_digest(odd, block=16).collect() if r["taken"]}
    assert all(len(x) == 1 for x in dealt.values())  # a slot has one place
    for x in blocks.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 16
    counts = {}
    for (rank, _), ((shard, *_),) in dealt.items():
        counts[shard, rank] = counts.get((shard, rank), 0) + 1
    shards = {s for s, _ in counts}
    assert shards == set(range(len(dealt) // 16)) and len({counts.get((s, 0), 0) for s in shards}) > 1


def test_small_sources_reach_their_targets(spark):
    rows = [(0, "w " * 4000, "en", "big", 8000), *((i, "a b c", "en", f"tiny{i}", 5) for i in range(1, 6)), (9, "", "en", "none", 0)]
    rows += [(10 + n, "x " * n, "en", f"of{n}", 2 * n) for n in (1, 40, 129, 150)]
    docs = spark.createDataFrame(rows, DOCS)
    _check_mix(docs, mixture.BLOCK)
    assert {r["doc_id"] for r in mixture.mixed_documents(docs).collect()} == {r[0] for r in rows} - {9}


def test_shard_counts_are_drawn(spark):
    targets = spark.createDataFrame([(0, 64_000, 96_000.0), (1, 3_200, 6_400.0), (2, 50, 0.0)], "rank long, source_size long, target double")
    numbers = mixture.slot_numbers(targets, 16)
    assert {r["rank"]: r["slots"] for r in numbers.collect()} == {0: 6000, 1: 400}
    counts = mixture.shard_counts(numbers, 20).collect()
    for rank, total in ((0, 6000), (1, 400)):
        got = np.array([sum(r["n"] for r in counts if (r["rank"], r["shard"]) == (rank, s)) for s in range(20)])
        p = 1 / 20
        spread = ((got - total * p) ** 2).sum() / (total * p)  # chi-square with 19 degrees of freedom
        assert got.sum() == total and 5 < spread < 45 and np.unique(got).size > 3
    # a shard's slots are the next so many of the source
    at = {}
    for r in sorted(mixture.slots(targets, 16, 20).collect(), key=lambda r: (r["rank"], r["slot"])):
        assert r["shard"] >= at.get(r["rank"], (0, -1))[0] and r["slot"] == at.get(r["rank"], (0, -1))[1] + 1
        at[r["rank"]] = (r["shard"], r["slot"])


def test_mix_keeps_clashing_names(spark, odd):
    extra = {"_size": 77777, "_pass": 5, "_key": "k", "_taken": 1.5, "size": 3, "place": 4, "bucket": 6, "row": "r", "_i": 7}
    docs = odd
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value))
    mixed = mixture.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    assert all({k: r[k] for k in extra} == extra for r in mixed.collect())
    assert mixture.mix_digest(docs, block=16).count() == odd.count()


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(mixture.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))
        one = F.lit(n).cast("long"), F.lit(5).cast("long")
        there = spark.range(n).select("id", mixture.permuted(mixture.permuted(F.col("id"), *one), *one, back=True).alias("p"))
        assert all(r["id"] == r["p"] for r in there.collect())


# ------------------------------------------------------------------------- op 7


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(8)
    for turn in range(60):
        n, sigma = int(rng.integers(1, 200)), int(rng.choice([2, 3, 5, 250]))
        t = np.append(rng.integers(1, sigma + 1, n), 0)
        if turn % 3 == 0:
            t[:-1] = np.resize(t[: max(1, n // 7)], n)
        got = suffix_dedup.suffix_array(t, 257)
        assert got.tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
        data = t.astype(np.uint8)
        left = n - np.arange(n + 1)
        lcp = suffix_dedup.permuted_lcp(data, left, got)[got]
        for a, b, c in zip(got, got[1:], lcp[1:], strict=False):
            x, y = data[a:n], data[b:n]
            k = 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert c == k


def test_suffix_array_recurses_at_every_size():
    rng = np.random.default_rng(18)
    text = "".join(rng.choice(["the ", "of ", "and ", "ing ", "tion", "er", "a", " "], 40_000)).encode()
    data = np.frombuffer(text + text[: len(text) // 2], np.uint8).astype(np.int64)
    levels = []
    got = suffix_dedup.suffix_array(np.append(data, 0), 257, levels)
    assert len(levels) >= 4 and levels == sorted(levels, reverse=True) and all(b <= a // 2 for a, b in zip(levels, levels[1:], strict=False))
    raw = bytes(data.astype(np.uint8)) + b"\0"
    assert got.size == len(raw) and (np.sort(got) == np.arange(len(raw))).all()
    assert all(raw[a : a + 400] <= raw[b : b + 400] for a, b in zip(got.tolist(), got[1:].tolist(), strict=False))
    names = rng.integers(1, 3000, 20_000)  # a large alphabet from the start
    names[10_000:15_000] = names[2_000:7_000]
    t = np.append(names, 0)
    got = suffix_dedup.suffix_array(t, 3000).tolist()
    assert sorted(got) == list(range(t.size)) and all(t[a : a + 5001].tolist() <= t[b : b + 5001].tolist() for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize(("hot", "most_hot", "key_bytes", "piece"), [(256, 1 << 16, 1 << 25, 1 << 20), (3, 1 << 16, 1 << 25, 900), (3, 1 << 16, 300, 1 << 20), (3, 2, 500, 1500)])
def test_repeats_equal_brute_force(spark, odd, monkeypatch, hot, most_hot, key_bytes, piece):
    for name, value in (("HOT", hot), ("MOST_HOT", most_hot), ("KEY_BYTES", key_bytes), ("PIECE", piece)):
        monkeypatch.setattr(suffix_dedup, name, value)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeats_digest(odd).collect()}
    assert got == brute.repeats([(r["doc_id"], r["text"]) for r in odd.collect()], 100)


def test_equal_segments_are_compared():
    data = np.frombuffer(b"abcdefabcdeXabcdef", np.uint8)
    arrays = {"key": np.ones(3, int), "sid": np.ones(3, int), "n": np.full(3, 2), "doc": np.array([1, 2, 3]), "tie": np.zeros(3, int), "s": np.zeros(3, int), "at": np.array([0, 6, 12])}
    first, others = suffix_dedup._earliest(arrays, data, 5)
    assert not others.size and sorted(first.tolist()) == [0, 1, 2]  # one hash, other bytes: kept for the suffix array
    arrays["doc"] = np.array([1, 3, 2])
    first, others = suffix_dedup._earliest(arrays, data, 5)
    assert others.tolist() == [2] and sorted(first.tolist()) == [0, 1]


def test_repeats_on_documents(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeats_digest(docs).collect()}
    assert got == brute.repeats([(r["doc_id"], r["text"]) for r in docs.collect()], 100)


def test_repeats_odd_rows(spark, empty):
    assert suffix_dedup.repeats_digest(empty).isEmpty()
    long = "x" * 150
    rows = spark.createDataFrame([(1, "a" * 120, "en", "s", 1), (1, "a" * 120, "en", "s", 1), (None, long, None, None, None), (5, long, "en", "s", 1), (6, None, "en", "s", None)], DOCS).withColumn("doc", F.lit("clash"))
    got = sorted(map(tuple, suffix_dedup.repeats_digest(rows).collect()), key=repr)
    assert [(r[0], r[2]) for r in got] == [(1, 119), (1, 119), (5, 149), (6, 0), (None, 150)]
    rows = rows.withColumn("_spans", F.lit(1)).withColumn("_doc", F.lit(2)).withColumn("tie", F.lit(3)).withColumn("spans", F.lit(4)).withColumn("row", F.lit(5))
    cut = suffix_dedup.without_repeats(rows)
    assert cut.columns == rows.columns and {(r["_spans"], r["_doc"], r["tie"], r["spans"], r["row"]) for r in cut.collect()} == {(1, 2, 3, 4, 5)}
    assert sorted((r["doc_id"] or -1, r["text"]) for r in cut.collect() if r["text"] is not None) == [(-1, ""), (1, "a"), (1, "a"), (5, "x")]


# ------------------------------------------------------------------------- op 9


@pytest.mark.parametrize(("k", "num", "lot", "common"), [(3, 90, 24, 96), (5, 80, 24, 4), (3, 90, 2, 3), (3, 60, 2, 96)])
def test_jaccard_equals_brute_force(spark, odd, monkeypatch, k, num, lot, common):
    monkeypatch.setattr(jaccard_join, "LOT", lot)
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rows = odd.unionByName(spark.createDataFrame([(500 + i, "x y z", None, None, None) for i in range(9)], DOCS))
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.jaccard_components(rows, k=k, num=num).collect()}
    assert got == brute.components([(r["doc_id"], r["text"]) for r in rows.collect()], k, num, 100)


def test_jaccard_odd_rows(spark, empty):
    assert jaccard_join.jaccard_components(empty).isEmpty() and jaccard_join.keep_one(empty).isEmpty()
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a B c"), (3, None), (3, None), (4, "zz"), (4, "other words here"), (-5, " OTHER words\nhere ")], "doc_id long, text string")
    for name in ("g", "_gone", "_turn", "_c", "_id", "id", "h", "digest", "row", "name", "i"):
        rows = rows.withColumn(name, F.lit(7))
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(rows).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 0, 3), (4, 1, 4), (4, 1, -5), (-5, 1, -5), (None, 1, None)], key=repr)
    kept = jaccard_join.keep_one(rows)
    assert kept.columns == rows.columns and {r["_gone"] for r in kept.collect()} == {7}
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())) == [(-5, " OTHER words\nhere "), (0, "a b c"), (1, "a b c"), (3, ""), (3, ""), (4, "zz")]


def test_names_sort_as_ids(spark):
    ids = [-(1 << 63), -5, -1, 0, 1, 1 << 40, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, bytes([k] * 16)) for k, i in enumerate(reversed(ids))], "id long, digest binary")
    got = docs.select("id", jaccard_join.name_of(F.col("id"), F.col("digest")).alias("name")).orderBy("name").select("id", jaccard_join.id_of(F.col("name")).alias("back")).collect()
    assert [r["id"] for r in got] == ids == [r["back"] for r in got]


def test_full_bins_go_to_the_check(spark):
    texts = spark.createDataFrame([(1, 0, "a b c d"), (2, 0, "A b c d"), (3, 0, "x y z")], "id long, h long, text string")
    full, some = (np.full(jaccard_join.SKETCH, n, "<u2").tobytes() for n in (65535, 9))
    reps = spark.createDataFrame([(b"1", 1, 0, 20_000_000, full), (b"2", 2, 0, 20_000_000, full), (b"3", 3, 0, 20_000_000, some)], "c binary, id long, h long, n long, sketch binary")
    pairs = spark.createDataFrame([(b"1", b"2"), (b"1", b"3")], "a binary, b binary")
    got = jaccard_join._check(pairs, texts, reps, 3, 90, 100).collect()
    assert [tuple(r) for r in got] == [(b"1", b"2")]


def test_jaccard_on_documents(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_jaccard_join(spark, sf_dir).collect()}
    assert got == brute.components([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 90, 100)


# ------------------------------------------------------------------------ op 10


def test_rules_do_not_depend_on_their_order(spark, odd, empty):
    first = {r["doc_id"]: tuple(r) for r in rules_cascade.quality_rules(odd).collect()}
    for r in odd.collect():
        w = brute.WORD.findall(r["text"] or "")
        assert first[r["doc_id"]][1:3] == (len(w), sum(map(len, w)))
        assert first[r["doc_id"]][4:6] == brute.repeated_lines_and_words(r["text"])
        assert first[r["doc_id"]][6:] == brute.rules(r["text"])
    for _, _, data, offsets in common.byte_slices(pa.array([r["text"] for r in odd.collect()])):
        a, b = (rules_cascade.cascade(rules_cascade.Statistics(data, offsets), o) for o in (rules_cascade.RULES, rules_cascade.RULES[::-1]))
        assert (a == b).all()
    assert rules_cascade.quality_rules(empty).isEmpty()
    clash = odd.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y"))
    assert {r["doc_id"]: r["kept"] for r in rules_cascade.quality_rules(clash).collect()} == {k: v[-1] for k, v in first.items()}
    kept = rules_cascade.kept_documents(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in first.items() if v[-1])


def test_rules_are_ordered_by_rejections_per_cost():
    costs = {"n_words": 0.0, "n_symbols": 1.0, "n_dup_lines": 4.0, "n_lines": 4.0, "n_repeat_words": 8.0, "word_chars": 1.0, "upper": 1.0, "lower": 1.0, "worded": 2.0}
    shares = {"symbols": 0.1, "lines": 0.4, "repeats": 0.2, "lengths": 0.3, "shouting": 0.0, "letterless": 0.5}
    names = lambda made: [r.name for r in rules_cascade.order_rules(costs, shares, rules_cascade.RULES, made)]
    assert names(()) == ["lengths", "letterless", "symbols", "lines", "repeats", "shouting"]
    assert names(("n_repeat_words", "n_dup_lines"))[:2] == ["repeats", "lengths"]  # what is made anyway is free


def test_the_cascade_skips_what_it_need_not_make(monkeypatch):
    made = []
    for name, make in list(rules_cascade.STATISTICS.items()):
        monkeypatch.setitem(rules_cascade.STATISTICS, name, lambda s, make=make, name=name: (made.append((name, s.n_words.size)), make(s))[1])
    texts = ["few words"] * 6 + ["# " * 60] * 3 + [" ".join(f"word{i}" for i in range(60))]
    for _, _, data, offsets in common.byte_slices(pa.array(texts)):
        assert rules_cascade.cascade(rules_cascade.Statistics(data, offsets), rules_cascade.RULES).tolist() == [False] * 9 + [True]
    assert ("n_repeat_words", 4) in made and ("worded", 1) in made and not any(n == 10 and name != "n_words" for name, n in made)


def test_long_texts_go_in_pieces():
    rng = random.Random(9)
    text = "\n".join(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(12))) for _ in range(300)) + " " + "z" * 900
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = common.word_bounds(data, np.array([0, data.size]))
    whole, parts = common.hash_ranges(data, starts, ends), common.hash_ranges(data, starts, ends, most=1000)
    assert (whole == parts).all() and np.unique(whole).size == len(set(brute.WORD.findall(text)))
    assert (common.hash_ranges(data, starts, ends, True, 500) == common.hash_ranges(data, starts, ends, True, 899)).all()


# --------------------------------------------------------------------- pipeline


def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = common.read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.read_table(spark, sf_dir, "labels"), queries.remainder("doc_id", 5) == 0)
    left = [r for r in docs.collect() if brute.toxic_score(r["text"], model) < 0.5]
    kept = common.materialize(corpus_pipeline.drop_toxic(spark, docs, sf_dir), "t")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in left)
    groups = brute.components([(r["doc_id"], r["text"]) for r in left], 5, 80, 100)
    left = [r for r in left if groups[r["doc_id"]][1] == r["doc_id"]]
    kept = common.materialize(corpus_pipeline.keep_one_of_each_group(spark, kept, sf_dir), "t")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in left)
    cut = common.materialize(corpus_pipeline.cut_repeats(spark, kept, sf_dir), "t")
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == brute.kept_texts([(r["doc_id"], r["text"]) for r in left], 100)
    mixed = common.materialize(corpus_pipeline.mix_sources(spark, cut, sf_dir), "t")
    assert mixed.columns == docs.columns
    out = corpus_pipeline.encode(spark, mixed, sf_dir).collect()
    codec = sentencepiece_scan.codec_of(PIECES)
    assert sorted((r["doc_id"], zlib.crc32(r["ids"])) for r in out) == sorted((r["doc_id"], brute.crc(codec.whole.encode(r["text"]))) for r in mixed.collect())
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_jaccard_join_sends_python_small_batches(spark, monkeypatch):
    """Its Python stages get at most BATCH whole texts at once; the session's own setting is back afterwards."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    keep = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, *a, **b: seen.append(int(spark.conf.get(key))) or keep(df, *a, **b))
    before = spark.conf.get(key)
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " x"), (3, "other text")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert seen and max(seen) <= 500 and spark.conf.get(key) == before


# ------------------------------------------------------------------ what is moved


def moved(spark, run) -> int:
    """Bytes that go through shuffles while run does."""
    context = spark.sparkContext
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def written() -> int:
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = context._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    spark.conf.set(key, "-1")
    try:
        start = written()
        run()
        return written() - start
    finally:
        spark.conf.set(key, before)


@pytest.fixture(scope="module")
def long_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000)), None, "ab"[i % 2], None) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " more", None, "a", None) for i in range(3)] + [(300 + i, rows[i][1], None, "a", None) for i in range(3)]
    return common.materialize(spark.createDataFrame(rows, DOCS), "t"), sum(len(r[1]) for r in rows)


def test_sieve(spark):
    keys = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id") * 7).alias("k"), F.col("id").cast("string").alias("s"))
    sieve = common.Sieve(keys)
    rows = spark.range(100_000).select(F.when(F.col("id") > 0, F.col("id") * 7).alias("a"), F.col("id").cast("string").alias("b"), F.lit("x").alias("k"))
    met, unmet = sieve.met(rows, "a", "b"), sieve.unmet(rows, "a", "b")
    assert met.columns == rows.columns and met.count() + unmet.count() == 100_000
    assert met.filter("a is null or a < 35000").count() == 5000 and 5000 <= met.count() < 10_000
    assert common.Sieve(keys.filter("false")).met(rows, "a", "b").isEmpty()
    assert common.Sieve(keys).unmet(keys, "k", "s").isEmpty()


def test_jaccard_join_moves_only_texts_that_may_link(spark, long_texts):
    docs, size = long_texts
    kept = []
    assert moved(spark, lambda: kept.extend(r["doc_id"] for r in jaccard_join.keep_one(docs).select("doc_id", "text").collect())) < size / 2
    assert sorted(kept) == list(range(120))


def test_jaccard_join_keeps_no_prefixes(spark, long_texts, monkeypatch):
    keep, kept = jaccard_join.materialize, []
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name, **b: kept.extend(df.columns * b.get("keep", False)) or keep(df, name, **b))
    jaccard_join.jaccard_components(long_texts[0]).collect()
    assert "digest" in kept and not {"prefix", "sketch", "text"} & set(kept)


def test_repeats_move_only_texts_that_have_some(spark, long_texts):
    docs, size = long_texts
    got = {}
    assert moved(spark, lambda: got.update(tuple(r) for r in suffix_dedup.without_repeats(docs).select("doc_id", "text").collect())) < 0.9 * size  # with picks and segments
    assert got == brute.kept_texts([(r["doc_id"], r["text"]) for r in docs.collect()], 100)


def test_mix_moves_a_text_once(spark, long_texts):
    docs, size = long_texts
    rows = []
    assert moved(spark, lambda: rows.extend(mixture.mixed_documents(docs).collect())) < 1.5 * size
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_classes_are_told_from_copies_once(spark, long_texts, monkeypatch):
    """Rounds of new prefixes read the classes as written, not the documents' filter again."""
    met = []
    keep = common.Sieve._kept

    def kept(self, rows, columns, hit):
        met.append((columns, hit, "_bits" in rows._jdf.queryExecution().optimizedPlan().toString()))
        return keep(self, rows, columns, hit)

    monkeypatch.setattr(common.Sieve, "_kept", kept)
    jaccard_join.jaccard_components(long_texts[0]).collect()
    assert [x for x in met if x[0] == ("digest",)] == [(("digest",), True, False), (("digest",), False, False)]
    assert [x for x in met if x[0] == ("g",)][0] == (("g",), True, False)
