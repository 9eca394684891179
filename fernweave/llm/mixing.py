"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source, its documents in a seeded order, form one stream that is cut into blocks of ``block_words``.  The
blocks of the mix are apportioned to sources by highest quotients ``target / (2 * seats + 1)``; the method is house
monotone, so the first seats of the sequence are the quota of the first output shard, and so on.  The blocks of a source stand
in a ring; from a seeded place on, each output shard takes as many as its quota says and the next goes on behind it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from fractions import Fraction
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, join_groups, let, text_or_empty, words

#: Per-source figures come to the driver; a mix has no more sources than this.
MAX_SOURCES = 100_000


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), cap: float = 3) -> dict[str | None, float]:
    """Words that each source gives: weights repeat over the sources by code point (null last), all sizes are shared out,
    and what lies above ``cap`` times a source's size is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        unit = rest / sum(weight[s] for s in free)
        if not (above := [s for s in free if unit * weight[s] > cap * sizes[s]]):
            out |= {s: unit * weight[s] for s in free}
            break
        for s in above:
            out[s] = float(cap * sizes[s])
            rest -= out[s]
        free = [s for s in free if s not in out]
    return {s: out[s] for s in order}


def seats(targets: dict[str | None, float], house: int, most: dict[str | None, int]) -> dict[str | None, int]:
    """Sainte-Laguë: ``house`` seats by highest quotient, none beyond ``most``; ties go to the source that sorts first.

    Every source starts from a number of seats that the method surely gives it, so that the heap only deals the last few.
    """
    order, total = list(targets), sum(map(Fraction, targets.values()))
    if not total or house <= 0:
        return dict.fromkeys(order, 0)
    sure = total / house + total / house * len(order) / house  # a divisor that seats too few
    given = {s: min(most[s], max(0, int(Fraction(targets[s]) / sure - Fraction(1, 2)))) for s in order}
    left = house - sum(given.values())
    heap = [(-Fraction(targets[s]) / (2 * given[s] + 1), i, s) for i, s in enumerate(order) if given[s] < most[s] and targets[s] > 0]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i, s = heapq.heappop(heap)
        given[s] += 1
        left -= 1
        if given[s] < most[s]:
            heapq.heappush(heap, (-Fraction(targets[s]) / (2 * given[s] + 1), i, s))
    return given


@dataclass(frozen=True)
class MixPlan:
    """``quotas[k][source]``: blocks of the source in output shard k.  ``rows``: for each source its size and target, and ``runs``
    (shard, low, high): the stretches of its stream, in words, that the shards take, one after another."""

    rows: DataFrame
    n_sources: int
    targets: dict[str | None, float]
    quotas: list[dict[str | None, int]] = field(default_factory=list)


def shard_runs(quotas: list[int], n_blocks: int, start: int, block_words: int, size: int) -> list[tuple[int, int, int]]:
    """(shard, low, high) in words: what each shard's blocks are in a ring of ``n_blocks``, the last of which may be short."""
    out, at = [], start
    for shard, quota in enumerate(quotas):
        end = at + quota
        while at < end:
            upto = min(end, (at // n_blocks + 1) * n_blocks)  # a run ends where the ring does
            low = at % n_blocks
            out.append((shard, low * block_words, min(size, (low + upto - at) * block_words)))
            at = upto
    return out


def plan_mix(sized: DataFrame, block_words: int, weights: tuple[int, ...], cap: int, seed: int, n_shards: int) -> MixPlan:
    """Quotas from a table with ``source`` and ``size``."""
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: int(r["n"]) for r in found}
    targets = source_targets(sizes, weights, cap)
    blocks = {s: -(-sizes[s] // block_words) for s in targets}
    most = {s: cap * blocks[s] for s in targets}
    house = round(sum(sizes.values()) / block_words)
    upto = [seats(targets, house * k // n_shards, most) for k in range(n_shards + 1)]
    quotas = [{s: b[s] - a[s] for s in targets} for a, b in zip(upto, upto[1:], strict=False)]
    rows = []
    for s, n in blocks.items():
        start = int.from_bytes(sha256(f"{seed}:{s is None}:{s}".encode("utf-8", "surrogatepass")).digest()[:8]) % n if n else 0
        rows.append((s, sizes[s], float(targets[s]), shard_runs([q[s] for q in quotas], n, start, block_words, sizes[s])))
    schema = "source string, source_size long, target double, runs array<struct<shard:int,low:long,high:long>>"
    return MixPlan(sized.sparkSession.createDataFrame(rows, schema), len(rows), targets, quotas)


def _taken(docs: DataFrame, texts: bool, block_words: int = 32, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, n_shards: int = 8) -> DataFrame:
    """For each row of ``docs``: the row itself as ``row``, or without ``texts`` its other columns, text_key, size, source_size, target and ``takes`` (shard, low, high): the
    stretches of its words that the output shards take."""
    space, text, others = Workspace(docs.sparkSession, "mix"), text_or_empty(), [c for c in docs.columns if c != "text"]
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in (docs.columns if texts else others))).alias("row"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_key"), F.size(words(text)).cast("bigint").alias("size"))
    sized = sized.withColumn("at", F.xxhash64(F.lit(seed), "text_key", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(-1))))
    narrow = space.table(sized.select("source", "at", "size") if texts else sized, "sizes")
    sized = sized if texts else narrow
    plan = plan_mix(narrow, block_words, weights, cap, seed, n_shards)

    # a stream is summed up in two levels of about as many rows each: within a bucket, and over the buckets of a source
    most = narrow.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    bits = int(most).bit_length() // 2
    dealt = lambda df: df.withColumn("bucket", F.shiftrightunsigned(F.col("at"), 64 - bits) if bits else F.lit(0).cast("bigint"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt(narrow).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = space.table(sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before")), "sums")
    space.drop(but=("sums",) if texts else ("sums", "sizes"))
    ties = F.xxhash64(*(F.col("row")[c] for c in others)) if others else F.lit(0)
    inside = Window.partitionBy("source", "bucket").orderBy("at", "text_key", ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = join_groups(dealt(sized), sums, ["source", "bucket"], sums.count(), salt_by=["at"])
    placed = placed.withColumn("first", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = join_groups(placed, plan.rows, ["source"], plan.n_sources, salt_by=["at"])
    own = F.transform("runs", lambda r: F.struct(r["shard"].alias("shard"), F.greatest(r["low"] - F.col("first"), F.lit(0)).alias("low"), F.least(r["high"] - F.col("first"), F.col("size")).alias("high")))
    return out.select("row", "text_key", "size", "source_size", "target", F.filter(own, lambda t: t["high"] > t["low"]).alias("takes"))


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, size, source_size, target, taken, and ``takes`` (shard, low, high), the stretches of its
    words that each output shard takes.

    Parameters and defaults: block_words 32, weights (1, 2, 3), cap 3, seed 7, n_shards 8.  Size: words of the text, none for
    null.  The seeded order is by hash of text and doc_id, so reruns and other partitionings agree; repeated rows stand one after
    another and have each its own words taken.  Null sources form one source, the last.  Documents without words take nothing.
    An empty table gives no rows.  Only doc_id, source and text of ``docs`` are read.
    """
    found = _taken(docs.select("doc_id", "source", "text"), False, **parameters)
    taken = F.aggregate("takes", F.lit(0).cast("bigint"), lambda n, t: n + t["high"] - t["low"])
    return found.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "text_key", "size", "source_size", "target", taken.alias("taken"), "takes")


def mixed_texts(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each stretch of a document that an output shard takes, with the text
    unchanged where that is all of it, and else with its words joined by blanks.  ``n_chars``, if there, follows the text.

    Parameters as for :func:`mix_documents`.  Repeated rows are rows of their own, and other columns stay whatever their
    names.  Documents without words don't appear.  An empty table gives no rows.
    """
    found = _taken(docs, True, **parameters).select("row", "size", F.explode("takes").alias("take"))
    part = let(words(F.col("row.text")), lambda w: F.concat_ws(" ", F.slice(w, F.col("take.low").cast("int") + 1, (F.col("take.high") - F.col("take.low")).cast("int"))))
    made = found.withColumn("text", F.when(F.col("take.high") - F.col("take.low") == F.col("size"), F.col("row.text")).otherwise(part))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        return F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c)

    return made.select(*map(column, docs.columns))
