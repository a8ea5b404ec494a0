"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its weight's share of all words, at most ``most`` times its own
size; the excess is shared again by weight until no target is above. The mix is made of
blocks of ``block`` words. Blocks are given to the sources by highest quotients (target
over 1, 3, 5, ...), then within a source to its shards by size in the same way, never
more than ``most`` times a shard's blocks. A shard is a seeded hash share of a source's
documents (about ``SHARD_WORDS`` words, at most ``SHARDS`` shards a source), so a
source with a third of all rows is spread. What whole blocks leave of a source's target,
or take beyond it (a stream's last block may be short, and a source smaller than a
block), is handed to or taken from its shards in words, so a source's taken words are
its target, rounded.

Inside a shard the documents stand in seeded order as one stream. The words due take the
whole stream as often as they hold it and, of the rest, the blocks that a seeded affine
permutation puts first, the last of them in part. The short block at the end of a stream
comes after all others.

Every draw is a hash of seed and ids, so reruns agree. Null text: size 0; null source: a
source of its own, last. Equal rows are taken each on their own. Further columns may have
any name: ``mixed_texts`` keeps them all; ``mix_plan`` leaves out those that bear the name of one of
its own (``mix_...``). An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import in_shared_folder, tidy

WEIGHTS, MOST, BLOCK, SEED = (1, 2, 3), 3, 16, 11
SHARD_WORDS, SHARDS, GROUPS = 65_536, 4096, 4096
#: A prime above any number of blocks of a shard, so multiplying by it permutes them.
_PRIME = 1_500_450_271
_OWN = {f"mix_{n}" for n in ("size", "source", "source_size", "target", "place", "shards", "shard", "order", "words", "due", "passes", "rest", "full",
                             "whole", "part", "start", "ranges", "taken")}


def sainte_lague(weight: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / 1, 3, 5, ..., at most ``most`` each; ties go to the first."""
    seats = int(min(seats, most.sum()))
    got = np.zeros(len(weight), np.int64)
    if not seats:
        return got
    at = lambda divisor: np.minimum(most, np.floor(weight / divisor + 0.5).astype(np.int64))
    low, high = weight[weight > 0].min() / (2.0 * most.max() + 2), 2.0 * weight.max() + 1
    for _ in range(200):  # the divisor from which on no more than the seats are given
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() > seats else (low, middle)
    got = at(high)
    while (left := seats - int(got.sum())) > 0:
        quotient = np.where(got < most, weight / (2 * got + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[:left]
        got[best[quotient[best] >= 0]] += 1
    return got


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, place (by code point, null last), target. ``sizes``: source, source_size."""
    # Ids that rise through the sorted partitions: the partition above 33 bits, the row in it below. No Python worker is started for them.
    ordered = in_shared_folder(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()), "ordered-sources")
    ordered = ordered.withColumn("part", F.shiftright("id", 33)).withColumn("row", F.col("id").bitwiseAND((1 << 33) - 1))
    before, first = 0, {}
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        first[r.part], before = before, before + r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in first.items() for x in kv]), F.col("part")) if first else F.lit(0)
    ordered = ordered.select("source", "source_size", (offset + F.col("row")).cast("bigint").alias("place"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = in_shared_folder(ordered.withColumn("weight", weight), "sources")
    top, capped, share = F.lit(float(most)) * F.col("source_size"), -1, 0.0
    while True:
        above = (F.col("weight") * share > top) if capped >= 0 else F.lit(False)
        now = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, top).otherwise(0.0)).alias("held"),
                          F.sum("source_size").alias("all"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if now.n == capped or not now.open:
            return sources.withColumn("target", F.least(top, F.col("weight") * share))
        capped, share = now.n, (now.all - now.held) / now.open


def _quotas(table: DataFrame, within: str, seats: str, weight: str, most: str) -> DataFrame:
    """Add ``quota``: the group's ``seats`` dealt over its rows, by ``place``. A lot has about sources / GROUPS rows."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
        return rows.assign(quota=sainte_lague(rows[weight].to_numpy(np.float64), int(rows[seats].iloc[0]), rows[most].to_numpy(np.int64)))

    fields = ", ".join(f"{n} {t}" for n, t in table.dtypes)
    return table.groupBy(within).applyInPandas(deal, f"{fields}, quota bigint")


def _words_due(streams: DataFrame, block: int, most: int) -> DataFrame:
    """Add ``due``, the words that each shard gives: its source's blocks dealt over the shards, then what is left of the
    source's target in words, to the first shards that have room. A source has at most SHARDS rows."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
        words, blocks = rows["words"].to_numpy(np.int64), rows["blocks"].to_numpy(np.int64)
        quota = sainte_lague(words.astype(np.float64), int(rows["seats"].iloc[0]), most * blocks)
        due = np.minimum(block * quota, most * words)
        left = int(np.floor(rows["target"].iloc[0] + 0.5)) - int(due.sum())
        room = most * words - due if left > 0 else due
        step = np.clip(abs(left) - (np.cumsum(room) - room), 0, room)
        return rows.assign(due=due + np.sign(left) * step)

    fields = ", ".join(f"{n} {t}" for n, t in streams.dtypes)
    return streams.groupBy("source_place").applyInPandas(deal, f"{fields}, due bigint")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED,
             texts: bool = True) -> DataFrame:
    """The columns of ``docs`` (doc_id, source, text needed; text left out unless ``texts``) with
    mix_size, mix_source_size, mix_target, mix_passes (whole copies), mix_ranges (further words, from - to), mix_taken."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    kept = [c for c in docs.columns if c.lower() not in _OWN and (texts or c != "text")]
    rows = docs.withColumn("mix_size", size).select(*kept, "mix_size")
    per_source = in_shared_folder(rows.groupBy("source").agg(F.sum("mix_size").alias("source_size")), "source-sizes")
    targets = in_shared_folder(source_targets(per_source, weights, most), "targets")

    shards = F.least(F.lit(SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("int")
    known = targets.select(F.col("source").alias("mix_source"), F.col("place").alias("mix_place"), F.col("source_size").alias("mix_source_size"),
                           F.col("target").alias("mix_target"), shards.alias("mix_shards"))
    dealt = (rows.join(known, rows.source.eqNullSafe(known.mix_source), "left").drop("mix_source")
             .withColumn("mix_order", F.xxhash64(F.lit(seed), "doc_id"))
             .withColumn("mix_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), "mix_shards").cast("int")))
    streams = in_shared_folder(dealt.groupBy(F.col("mix_place").alias("source_place"), F.col("mix_shard").alias("place")).agg(F.sum("mix_size").alias("words"))
                               .withColumn("blocks", F.ceil(F.col("words") / block).cast("bigint")), "streams")

    # Blocks to groups of sources, to sources, to shards: each deal sees a bounded number of rows.
    room = streams.groupBy("source_place").agg((most * F.sum("blocks")).alias("most")).withColumnRenamed("source_place", "place")
    sources = in_shared_folder(targets.join(room, "place").select("place", "target", "most").withColumn("lot", F.pmod("place", F.lit(GROUPS))), "rooms")
    lots = sources.groupBy("lot").agg(F.sum("target").alias("target"), F.sum("most").alias("most")).orderBy("lot").collect()  # GROUPS rows at most
    weight = np.array([r.target for r in lots], np.float64)
    seats = sainte_lague(weight, round(weight.sum() / block), np.array([r.most for r in lots], np.int64)) if lots else []
    by_lot = docs.sparkSession.createDataFrame([(int(r.lot), int(n)) for r, n in zip(lots, seats, strict=True)], "lot bigint, seats bigint")
    sources = _quotas(sources.join(F.broadcast(by_lot), "lot"), "lot", "seats", "target", "most")
    streams = streams.join(sources.select(F.col("place").alias("source_place"), F.col("quota").alias("seats"), "target"), "source_place")
    due = in_shared_folder(_words_due(streams, block, most), "due").select(
        F.col("source_place").alias("mix_place"), F.col("place").alias("mix_shard"), F.col("words").alias("mix_words"), F.col("due").alias("mix_due"))

    place = ["mix_place", "mix_shard"]
    ties = [F.xxhash64("text")] if texts else []  # without texts, rows of one id and size are alike
    stream = Window.partitionBy(*place).orderBy("mix_order", "doc_id", "mix_size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.join(due, place).withColumn("mix_start", F.coalesce(F.sum("mix_size").over(stream), F.lit(0)))
    words, full, whole, part = F.greatest(F.col("mix_words"), F.lit(1)), F.col("mix_full"), F.col("mix_whole"), F.col("mix_part")
    laid = laid.withColumns({"mix_passes": F.floor(F.col("mix_due") / words), "mix_rest": F.pmod("mix_due", words), "mix_full": F.floor(words / block)})
    laid = laid.withColumn("mix_whole", F.least(F.floor(F.col("mix_rest") / block), full))
    laid = laid.withColumn("mix_part", F.col("mix_rest") - F.col("mix_whole") * block)
    start, end = F.col("mix_start"), F.col("mix_start") + F.col("mix_size")
    turn = F.xxhash64(F.lit(seed + 2), *place)

    def taken(k):
        """The words that block k gives beside the whole passes."""
        rank = F.pmod(k * _PRIME + F.pmod(turn, F.greatest(full, F.lit(1))), F.greatest(full, F.lit(1)))
        return F.when(k < full, F.when(rank < whole, F.lit(block)).when(rank == whole, part).otherwise(0)).otherwise(
            F.when(whole == full, part).otherwise(0))

    touched = F.when(F.col("mix_size") > 0, F.sequence(F.floor(start / block), F.floor((end - 1) / block)))
    ranges = F.transform(F.coalesce(touched, F.array().cast("array<bigint>")), lambda k: F.struct(
        (F.greatest(k * block, start) - start).alias("from"), (F.least(k * block + taken(k), end) - start).alias("to")))
    laid = laid.withColumn("mix_ranges", F.filter(ranges, lambda r: r["to"] > r["from"]))
    further = F.aggregate("mix_ranges", F.lit(0).cast("bigint"), lambda total, r: total + r["to"] - r["from"])
    return laid.withColumn("mix_taken", F.col("mix_passes") * F.col("mix_size") + further).drop(
        "mix_order", "mix_shard", "mix_shards", "mix_place", "mix_words", "mix_due", "mix_rest", "mix_full", "mix_whole", "mix_part", "mix_start")


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies of a document, and one row of its further words
    (joined by one space) if it has any. n_chars, where present, follows the text."""
    own = docs.toDF(*[c if c in ("doc_id", "source", "text") else f"extra_{i}" for i, c in enumerate(docs.columns)])
    plan, columns = mix_plan(own, **settings), own.columns
    at = columns.index("text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, passes, ranges = (b.column(i).to_pylist() for i in (at, len(columns), len(columns) + 1))
            further = [i for i, r in enumerate(ranges) if r]
            rest = []
            for i in further:
                words = texts[i].encode().split()  # bytes split at the same six characters
                rest.append(b" ".join(w for r in ranges[i] for w in words[r["from"]:r["to"]]).decode())
            own_columns = b.select(range(len(columns)))
            whole = np.repeat(np.arange(b.num_rows), passes)
            for low in range(0, len(whole), 2000):  # copies would make a batch three times as large
                yield own_columns.take(pa.array(whole[low:low + 2000], pa.int64()))
            if further:
                out = own_columns.take(pa.array(further, pa.int64()))
                yield out.set_column(at, out.schema.field(at), pa.array(rest, out.schema.field(at).type))

    out = plan.where("mix_taken > 0").select(*columns, "mix_passes", "mix_ranges").mapInArrow(tidy(expand), own.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
