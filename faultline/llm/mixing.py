"""Mixing sources to target weights by whole blocks of words.

Each source's documents are laid end to end in a hash order and cut into blocks of a fixed number of words. The mix is
a row of slots in shards. Every slot draws a source, so a shard's source counts are one multinomial draw; slots that a
source draws beyond its quota go, in order, to the sources that fell short, so the whole mix meets its targets. The
``k``-th slot of a source is epoch ``k div n`` of its ``n`` blocks at the place ``k mod n`` of that epoch's
pseudorandom permutation; no block repeats within an epoch. Slots and blocks then join by source and block number.

Everything is derived from hashes of ids, slots and the seed, so reruns and retried tasks agree. The rows of one source
are spread over hash buckets and slots over shards; sums within buckets and shards come first, then sums of those sums.
Only the list of sources (a row each) is ordered as a whole.

Null texts and ids are allowed (a null text has no words), a null source is a source of its own and comes last. Documents
without words belong to no block and are never taken. Repeated rows are documents of their own. An empty table gives
an empty mix. Sources without words have target 0. Further columns are kept out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.session import settle

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
BUCKETS = 1024
CELLS = 4096
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and number of words, written once."""
    return settle(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                              F.xxhash64("text").alias("text_hash")), "sizes")


def targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: rank, weight 1, 2, 3, 1, ..., size, target words, number of blocks and quota of slots.

    Targets share all words by weight, but none is above ``MAX_REPEATS`` times its source: with sources ordered by cap
    over weight, those before the first whose fair share of the rest fits get their caps.
    """
    by_code_point, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fit", "rank")
    sources = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
               .withColumn("rank", F.row_number().over(by_code_point)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
               .withColumn("cap", (MAX_REPEATS * F.col("source_size")).cast("double")).withColumn("fit", F.col("cap") / F.col("weight")))
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    shared = sources.withColumn("level", (total - before) / left).withColumn("capped", F.col("level") > F.col("fit"))
    level = F.min(F.when(~F.col("capped"), F.struct("fit", "rank", "level"))).over(Window.partitionBy())["level"]
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.coalesce(F.round(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")) * F.col("n_blocks")).cast("long"), F.lit(0))
    ordered = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    out = (shared.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level)))
           .withColumn("n_blocks", blocks).withColumn("quota", quota).withColumn("quota_before", F.coalesce(F.sum("quota").over(ordered), F.lit(0))))
    return settle(out.select("source", "rank", "weight", "source_size", "target", "n_blocks", "quota", "quota_before"), "sources")


def _by_cell(ranges: DataFrame, low: str, length: str, width: int) -> DataFrame:
    """Each range once for every cell of ``width`` numbers that it touches, so that a number finds it by an equi-join."""
    return ranges.filter(F.col(length) > 0).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(low) + F.col(length) - 1) / width))))


def _permuted(source: pd.Series, k: pd.Series, n: pd.Series, seed: int) -> pd.Series:
    """Place of slot ``k`` among ``n`` blocks: a keyed Feistel network on the next power of four, walked until it is below ``n``."""
    from faultline.llm.lexing import mix

    n, k = n.to_numpy(np.int64), k.to_numpy(np.int64)
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = mix(source.to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix((k // n).astype(np.uint64) + np.uint64(seed)))
    out, todo = (k % n).astype(np.uint64), np.arange(len(n))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(6):
            left, right = right, left ^ (mix(right + mix(key[todo] + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return pd.Series(out.astype(np.int64))


def slots(sources: DataFrame, seed: int = 5, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: ``shard``, ``slot``, ``rank`` of its source, ``epoch`` and ``block``."""
    spark = sources.sparkSession
    n = int(sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])
    width = max(1, -(-n // CELLS))
    numbers = spark.range(n).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"),
                                    F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("draw"))
    chances = _by_cell(sources, "quota_before", "quota", width).select("cell", "rank", "quota_before", "quota")
    drawn = (numbers.withColumn("cell", F.floor(F.col("draw") / width)).join(chances, "cell")
             .filter((F.col("draw") >= F.col("quota_before")) & (F.col("draw") < F.col("quota_before") + F.col("quota"))).select("shard", "slot", "rank"))
    in_shard = settle(drawn.groupBy("rank", "shard").count(), "shard-counts")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = in_shard.select("rank", "shard", before.alias("before"))
    placed = (drawn.withColumn("within", F.row_number().over(Window.partitionBy("rank", "shard").orderBy("slot")) - 1)
              .join(starts, ["rank", "shard"]).select("shard", "slot", "rank", (F.col("before") + F.col("within")).alias("k")))
    ordered = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    balance = (sources.select("rank", "quota", "n_blocks").join(in_shard.groupBy("rank").agg(F.sum("count").alias("drawn")), "rank", "left")
               .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
               .withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
               .withColumn("over_before", F.coalesce(F.sum("over").over(ordered), F.lit(0))).withColumn("short_before", F.coalesce(F.sum("short").over(ordered), F.lit(0))))
    balance = settle(balance, "balance")
    known = settle(placed.join(balance.select("rank", "quota", "n_blocks", "over_before"), "rank"), "drawn-slots")
    kept = known.filter("k < quota").select("shard", "slot", "rank", "k", "n_blocks")
    moved = (known.filter("k >= quota").select("shard", "slot", (F.col("over_before") + F.col("k") - F.col("quota")).alias("spare"))
             .withColumn("cell", F.floor(F.col("spare") / 1024)))
    room = _by_cell(balance, "short_before", "short", 1024).select("cell", "rank", "drawn", "short_before", "short", "n_blocks")
    moved = (moved.join(room, "cell").filter((F.col("spare") >= F.col("short_before")) & (F.col("spare") < F.col("short_before") + F.col("short")))
             .select("shard", "slot", "rank", (F.col("drawn") + F.col("spare") - F.col("short_before")).alias("k"), "n_blocks"))
    place = F.pandas_udf(lambda rank, k, n_blocks: _permuted(rank, k, n_blocks, seed), "long")
    return settle(kept.unionByName(moved).select("shard", "slot", "rank", F.floor(F.col("k") / F.col("n_blocks")).alias("epoch"),
                                                 place("rank", "k", "n_blocks").alias("block")), "mix")


def laid_out(sizes: DataFrame, sources: DataFrame, seed: int = 5) -> DataFrame:
    """Documents with their source's figures and ``at``: the words of the source before them."""
    ranked = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("draw", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    bucketed = ranked.withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)))
    order = Window.partitionBy("rank", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("rank", "bucket", before.alias("bucket_at"))
    return (bucketed.withColumn("own", F.coalesce(F.sum("size").over(order), F.lit(0))).join(sums, ["rank", "bucket"])
            .withColumn("at", F.col("bucket_at") + F.col("own")))


def in_blocks(laid: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and block it reaches into: words ``from`` up to ``to`` of the document."""
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    return (laid.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
            .withColumn("from", F.greatest(F.col("block") * block_words - F.col("at"), F.lit(0)))
            .withColumn("to", F.least((F.col("block") + 1) * block_words - F.col("at"), F.col("size"))))


def taken(docs: DataFrame, seed: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes of it, repeats counted."""
    sizes = sized(docs)
    sources = targets(sizes, block_words)
    laid = settle(laid_out(sizes, sources, seed).select("doc_id", "size", "source_size", "target", "rank", "at"), "laid-out")
    copies = slots(sources, seed).groupBy("rank", "block").agg(F.count("*").alias("copies"))
    used = (in_blocks(laid, block_words).join(copies, ["rank", "block"], "left")
            .groupBy("doc_id", "size", "source_size", "target", "rank", "at")
            .agg(F.sum(F.coalesce("copies", F.lit(0)) * (F.col("to") - F.col("from"))).alias("taken")))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return used.select(columns).unionByName(laid.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def _cut(text: str, spans: Column) -> Column:
    words = F.regexp_extract_all(F.col(text), F.lit(WORD + r"[\x20\x09-\x0D]*"), 0)
    return F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(words, s["from"].cast("int") + 1, (s["to"] - s["from"]).cast("int")))), "")


def mixed_documents(docs: DataFrame, seed: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The words of the mix as documents: a row for each document and epoch that takes some of it, in the columns of ``docs``.

    A document that an epoch takes whole keeps its text; otherwise the text holds the words of the taken blocks in
    their order. ``n_chars``, if present, is counted anew. Further columns keep their values, whatever their names.
    """
    # no helper column may have the name of a column of docs
    lead = "piece_"
    while any(c.lower().startswith(lead) for c in docs.columns):
        lead += "_"
    sizes = sized(docs)
    sources = targets(sizes, block_words)
    laid = settle(laid_out(sizes, sources, seed).select("doc_id", "text_hash", sizes["source"], "size", "rank", "at"), "laid-out")
    pieces = (in_blocks(laid, block_words).join(slots(sources, seed).select("rank", "block", "epoch"), ["rank", "block"])
              .groupBy("doc_id", "text_hash", "source", "size", "rank", "at", "epoch")
              .agg(F.sum(F.col("to") - F.col("from")).alias("n"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans")))
    pieces = pieces.select(*(F.col(c).alias(f"{lead}{c}") for c in ("doc_id", "text_hash", "source", "size", "n", "spans")))
    keys = [("doc_id", f"{lead}doc_id"), (f"{lead}own_hash", f"{lead}text_hash"), ("source", f"{lead}source")]
    texts = docs.withColumn(f"{lead}own_hash", F.xxhash64("text")).dropDuplicates(["doc_id", f"{lead}own_hash", "source"])
    same = F.lit(True)
    for left, right in keys:
        same = same & F.col(left).eqNullSafe(F.col(right))
    both = texts.join(pieces, same).withColumn("text", F.when(F.col(f"{lead}n") == F.col(f"{lead}size"), F.col("text")).otherwise(_cut("text", F.col(f"{lead}spans"))))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(docs.columns)
