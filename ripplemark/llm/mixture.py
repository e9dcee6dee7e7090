"""Mixing sources to target weights, with DataFrame operations only.

The words of each source are one long sequence, packed into blocks of
``BLOCK`` words.  A source's target, rounded to words, fixes its slots: whole
passes over its blocks, then as many blocks as reach it, of which the last one
is cut.  For every output shard the number of slots of each source is drawn,
multinomially given the sources' totals; these counts decide which slots a
shard has: the next so many of each source, in the order of shards.  Slot j of a
source takes block permutation(j modulo its blocks) of its pass, blocks are
joined to the slots by index, and the mix is written as the shards' blocks;
digest and documents are read from these.  No pass goes beyond the second, so
no document is taken more than twice, and every source's words are its target,
rounded (one word at least, where the target is above 0).

A null text has no words; a null source is a source of its own, last in order;
a source without words has target 0; rows with equal ids are packed one by one
and summed in the digest; an empty table gives an empty result; other columns,
whatever their names, are kept by ``mixed_documents`` (``n_chars`` follows the
new text) and not read otherwise.  A very long text is spread over blocks like
any other.  All draws are hashes, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 128
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = MOST_TIMES) -> DataFrame:
    """sizes (source, source_size) with rank, weight and target added.

    Weights repeat over sources in order of code points, null last.  Targets
    share ``share`` of all words by weight; one beyond ``times`` its source's
    words stops there and the rest is shared anew: with sources in order of
    cap / weight, the first ones stop and the others get level * weight.
    One row a source goes through this, after map-side sums.
    """
    w = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(w).cast("long") - 1).withColumn("weight", cycle.cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(times)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    upto = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    filled = ranked.withColumns({"_all": F.sum("source_size").over(every) * F.lit(share), "_w": F.sum("weight").over(every), "_cap_before": F.sum("cap").over(upto) - F.col("cap"), "_w_before": F.sum("weight").over(upto) - F.col("weight")})
    # the level if this source and all after it do not stop
    filled = filled.withColumn("_level", (F.col("_all") - F.col("_cap_before")) / (F.col("_w") - F.col("_w_before")))
    fits = F.col("_level") * F.col("weight") <= F.col("cap")
    level = F.max(F.when(fits, F.col("_level"))).over(every)  # those after the first that fits have lower levels
    filled = filled.withColumn("_final", F.coalesce(level, F.lit(float("inf"))))
    return filled.select("source", "source_size", "rank", "weight", F.least(F.col("cap"), F.col("_final") * F.col("weight")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def permuted(j: Column, n: Column, key: Column, rounds: int = 12, back: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 at j, or its inverse: swap-or-not.

    In each round x and its partner (k - x) modulo n trade places if a hash of
    the larger of them says so; both see the same hash, so a round undoes
    itself, and the rounds in reverse order are the inverse.
    """

    def turn(x, r):
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) + n - x, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, partner)), F.lit(2)) == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(rounds), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(rounds)), j, turn)


def running_total(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before, by keys; rows are summed in buckets, so no task holds a key's rows.

    bucket orders like order; keys may be null.
    """
    df = df.withColumn("bucket", bucket)
    sums = df.groupBy(*keys, "bucket").agg(F.sum(value).alias("s"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("begin", F.sum("s").over(upto) - F.col("s")).select(*(F.col(k).alias(f"{k}_2") for k in [*keys, "bucket"]), F.col("begin").alias("bucket_begin"))
    inner = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("inner", F.sum(value).over(inner) - F.col(value))
    same = F.col("bucket") == F.col("bucket_2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    return df.join(sums, same).withColumn(name, F.col("bucket_begin") + F.col("inner")).drop("bucket_begin", "inner", "bucket", "bucket_2", *(f"{k}_2" for k in keys))


def packed(docs: DataFrame, id_col: str, source_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows with size, source rank and place in the source's sequence; sources with targets)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    rows = materialize(rows, "mixture-sizes")
    targets = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).drop("n")), "mixture-targets")
    buckets = max(1, math.isqrt(rows.count()))  # as many as there are rows in each
    rows = running_total(rows, ["source"], ["id", "h"], F.pmod(F.xxhash64("id", "h", F.lit(5)), F.lit(buckets)), "size", "place")
    rows = rows.join(targets.select(F.col("source").alias("s3"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("s3")))
    return rows.select("id", "h", "source", "rank", "size", "place", "source_size", "target"), targets


def slot_numbers(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rank, blocks, slots, cut): a source's blocks, its slots, and the words that its last slot takes of its block."""
    t = targets.filter("target > 0").select("rank", F.col("source_size").alias("size"), F.greatest(F.round("target"), F.lit(1.0)).cast("long").alias("goal"))
    t = t.withColumn("blocks", F.ceil(F.col("size") / block).cast("long"))
    t = t.withColumn("whole", F.floor(F.col("goal") / F.col("size")))
    t = t.withColumn("rest", F.col("goal") - F.col("whole") * F.col("size"))
    # the source's last block may be short; where it stands in the pass that is not whole
    t = t.withColumn("lack", F.col("blocks") * block - F.col("size"))
    t = t.withColumn("short", permuted(F.col("blocks") - 1, F.col("blocks"), F.xxhash64("rank", "whole"), back=True))
    words = lambda n: n * block - F.when(F.col("short") < n, F.col("lack")).otherwise(0)  # noqa: E731  of the pass's first n slots
    least = F.ceil(F.col("rest") / block).cast("long")
    t = t.withColumn("more", F.when(words(least) >= F.col("rest"), least).otherwise(least + 1))
    cut = F.when(F.col("more") > 0, F.col("rest") - words(F.col("more") - 1)).otherwise(block)
    return t.select("rank", "blocks", (F.col("whole") * F.col("blocks") + F.col("more")).alias("slots"), cut.cast("long").alias("cut"))


def shard_counts(numbers: DataFrame, shards: int) -> DataFrame:
    """(shard, rank, n): how many slots of each source a shard gets; every slot of a source draws one of the shards."""
    t = numbers.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))))
    n = max(1, int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = t.select("rank", "slots", "chunk").repartition(n, "rank", "chunk")
    t = t.select("rank", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + CHUNK, F.col("slots")) - 1)).alias("draw"))
    return t.groupBy(F.floor(_uniform(F.col("rank"), F.col("draw"), F.lit(31)) * shards).alias("shard"), "rank").agg(F.count("*").alias("n"))


def slots(targets: DataFrame, block: int = BLOCK, shards: int | None = None) -> DataFrame:
    """(rank, slot, shard, order in the shard, block, pass, limit): every slot of the mix.

    The shards' drawn counts decide which slots are theirs; a slot takes the
    first ``limit`` words of its block.
    """
    numbers = slot_numbers(targets, block)
    if shards is None:
        shards = max(1, int(numbers.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]) // CHUNK)
    counts = materialize(shard_counts(numbers, shards), "mixture-counts")
    counts = running_total(counts, ["rank"], ["shard"], F.floor(F.col("shard") / max(1, math.isqrt(shards))), "n", "begin")
    t = counts.join(numbers.withColumnRenamed("rank", "r2"), F.col("rank") == F.col("r2"))
    # few rows, of which each becomes many: dealt anew, as their bytes alone would leave them in one task
    t = t.repartition(max(1, int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "rank", "shard")
    t = t.withColumn("slot", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    return t.select(
        "rank",
        "slot",
        "shard",
        _uniform(F.col("rank"), F.col("slot"), F.lit(37)).alias("order"),
        permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.xxhash64(F.col("rank"), turn)).alias("block"),
        turn.alias("pass"),
        F.when(F.col("slot") == F.col("slots") - 1, F.col("cut")).otherwise(block).alias("limit"),
    )


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, h, rank, block, at, first, words): a document's part of each of its blocks; at counts from the block's begin, first from the document's."""
    spans = rows.filter("size > 0").select("id", "h", "rank", "size", "place", F.explode(F.sequence(F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block))).alias("block"))
    first = F.greatest(F.col("block") * block - F.col("place"), F.lit(0))
    at = F.greatest(F.col("place") - F.col("block") * block, F.lit(0))
    return spans.select("id", "h", "rank", "block", at.alias("at"), first.alias("first"), (F.least((F.col("block") + 1) * block - F.col("place"), F.col("size")) - first).alias("words"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(packed rows; the mix as written: every slot's pieces, with its shard, order and pass)."""
    rows, targets = packed(docs, id_col, source_col, text_col, block)
    dealt = pieces(rows, block).join(slots(targets, block).hint("merge"), ["rank", "block"])
    dealt = dealt.withColumn("words", F.least("words", F.col("limit") - F.col("at"))).filter("words > 0").drop("limit")
    return rows, materialize(dealt, "mixture-shards")


def mix_shards(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The output shards: shard, order, rank, slot, pass, block, at, id, first and words of each piece.

    A shard's blocks stand in order of (order, rank, slot), a block's pieces in
    order of at; a piece is so many words of its document from first on.
    """
    dealt = mix_plan(docs, id_col, source_col, text_col, block)[1]
    return dealt.select("shard", "order", "rank", "slot", "pass", "block", "at", F.col("id").alias(id_col), "first", "words")


def mix_digest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id, size, source_size, target and taken of every row."""
    rows, taken = mix_plan(docs, id_col, source_col, text_col, block)
    sums = taken.groupBy("id", "h").agg(F.sum("words").alias("taken"))
    sums = sums.select(F.col("id").alias("i2"), F.col("h").alias("h2"), "taken")
    # of rows alike in id and text, each takes an equal share of the whole
    alike = rows.groupBy("id", "h", "rank", "size", "source_size", "target").agg(F.count("*").alias("n"))
    alike = alike.join(sums, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left")
    alike = alike.withColumn("taken", F.coalesce("taken", F.lit(0)))
    out = alike.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    share = F.floor(F.col("taken") * F.col("k") / F.col("n")) - F.floor(F.col("taken") * (F.col("k") - 1) / F.col("n"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", share.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The mix as rows of docs: a document's words of the first pass, and again those taken twice.

    Where all its words are taken, a row has the whole text; else the taken
    words, joined by blanks.  Documents of which nothing is taken are absent.
    """
    rows, taken = mix_plan(docs, id_col, source_col, text_col, block)
    words_of = lambda k: F.sum(F.when(F.col("pass") == k, F.col("words")).otherwise(0))
    marks = taken.groupBy("id", "h").agg(F.collect_list(F.struct("first", "words", "pass")).alias("_taken"), words_of(0).alias("_words"), words_of(1).alias("_again"))
    marks = marks.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "_taken", "_words", "_again")
    # columns of docs go in one struct, so no name of theirs meets one of ours
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    out = out.join(marks, F.col("i").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_h")))
    out = out.withColumn("text", F.col("row").getField(text_col))  # after the join, through which a text goes once
    out = out.withColumn("size", F.regexp_count("text", F.lit(WORD)))
    out = out.withColumn("turn", F.explode(F.when(F.col("_again") > 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    whole = F.when(F.col("turn") == 1, F.col("_words")).otherwise(F.col("_again")) >= F.col("size")
    ranges = F.array_sort(F.filter("_taken", lambda x: x["pass"] == F.col("turn") - 1))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform(ranges, lambda x: F.slice(words, (x["first"] + 1).cast("int"), x["words"].cast("int")))), " ")
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    kept = {c: F.col("row").getField(c) for c in docs.columns} | {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.filter("text != ''").select(*(v.alias(c) for c, v in kept.items()))
