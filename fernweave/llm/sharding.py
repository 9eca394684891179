"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters fit.

Rows are put in the order of a composite key of 64-bit integers.  Each round counts, in one aggregation with map-side
combining, the bytes in the cells of a radix histogram over the key ranges that still hold an unsettled splitter; only the
counts (at most ``2**bits`` cells for each unsettled splitter) reach the driver.  A splitter is settled when the bytes
below it are within the tolerance of its target, or when its range is one key.  After that the rows move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, join_groups, text_or_empty, utf8_crc32

_SIGN = 1 << 63


@dataclass(frozen=True)
class Cell:
    """A range of keys, with the bytes below it and in it; ``low`` and ``high`` are inclusive, per level of the key."""

    prefix: tuple[int, ...]  # settled values of the levels above
    low: int
    high: int
    below: int
    weight: int


def _ordered(value: Column) -> Column:
    """Null keys sort first, with the smallest value."""
    return F.coalesce(value.cast("bigint"), F.lit(-_SIGN))


def find_splitters(rows: DataFrame, keys: list[str], weight: str, n_shards: int, tolerance: float, bits: int = 10, cut: float = 0.1) -> tuple[list[tuple[int, ...]], int]:
    """Composite keys that begin shards 1 to ``n_shards - 1``, and the total weight.

    ``rows`` has non-null bigint columns ``keys`` and ``weight``.  A splitter may stand ``tolerance`` times a shard's
    mean weight away from its target; where a single key is heavier than that, it takes the nearer side of the key.  Rows alike
    in an upper key are parted by the next one only where they weigh more than ``cut`` times a shard's mean.
    An empty table gives no splitters.
    """
    first = rows.agg(F.sum(weight), F.min(keys[0]), F.max(keys[0])).first()
    if first[0] is None:
        return [], 0
    total = int(first[0])
    slack, heavy = int(tolerance * total / n_shards), int(cut * total / n_shards)
    open_: dict[int, Cell] = {k: Cell((), first[1], first[2], 0, total) for k in range(1, n_shards)}
    done: dict[int, tuple[int, ...]] = {}
    least = (-_SIGN,) * len(keys)

    def padded(prefix: tuple[int, ...], low: int) -> tuple[int, ...]:
        return (*prefix, low, *least[len(prefix) + 1 :])

    while open_:
        cells = sorted(set(open_.values()), key=lambda c: (c.prefix, c.low))
        level = min(len(c.prefix) for c in cells)  # upper levels first, so that a round looks at one level
        cells = [c for c in cells if len(c.prefix) == level]
        column, number, step, low = F.col(keys[level]), F.lit(None), F.lit(None), F.lit(None)
        for i, c in enumerate(cells):
            width = max(1, -(-(c.high - c.low + 1) >> bits))
            here = column.between(c.low, c.high)
            for k, v in zip(keys, c.prefix, strict=False):
                here = here & (F.col(k) == v)
            number, step, low = F.when(here, i).otherwise(number), F.when(here, F.lit(width).cast("decimal(20,0)")).otherwise(step), F.when(here, F.lit(c.low).cast("decimal(20,0)")).otherwise(low)
        at = rows.select(number.cast("int").alias("cell"), ((column.cast("decimal(20,0)") - low) / step).alias("q"), column.alias("key"), F.col(weight).alias("w")).where("cell is not null")
        counted = at.groupBy("cell", F.floor("q").cast("int").alias("slot")).agg(F.sum("w").alias("w"), F.min("key").alias("low"), F.max("key").alias("high"))
        parts: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["cell"], r["slot"])):
            parts.setdefault(r["cell"], []).append(r)
        for i, c in enumerate(cells):
            for k in [k for k, x in open_.items() if x == c]:
                goal, below = total * k // n_shards, c.below
                for r in parts[i]:
                    w = int(r["w"])
                    if below + w >= goal:
                        break
                    below += w
                over = below + w - goal
                start, end = goal - below <= slack, over <= slack
                if start and (not end or goal - below <= over):
                    done[k] = padded(c.prefix, r["low"])
                elif end:
                    done[k] = padded(c.prefix, r["high"] + 1) if r["high"] < _SIGN - 1 else padded(c.prefix, r["high"])
                elif r["low"] < r["high"]:
                    open_[k] = Cell(c.prefix, r["low"], r["high"], below, w)
                    continue
                elif level + 1 < len(keys) and w > heavy:  # look at the next level within the key
                    inner = rows.where(F.col(keys[level]) == r["low"])
                    for name, v in zip(keys, c.prefix, strict=False):
                        inner = inner.where(F.col(name) == v)
                    low_, high_ = inner.agg(F.min(keys[level + 1]), F.max(keys[level + 1])).first()
                    open_[k] = Cell((*c.prefix, r["low"]), low_, high_, below, w)
                    continue
                else:
                    done[k] = padded(c.prefix, r["low"]) if goal - below <= over or r["low"] == _SIGN - 1 else padded(c.prefix, r["low"] + 1)
                del open_[k]
    out: list[tuple[int, ...]] = []
    for k in range(1, n_shards):
        out.append(max([done[k], *out[-1:]]))
    return out, total


def shard_of(keys: list[str], splitters: list[tuple[int, ...]]) -> Column:
    """Number of splitters at or below a row's key, by a balanced tree of comparisons."""

    def at_least(splitter: tuple[int, ...]) -> Column:
        out = F.col(keys[-1]) >= splitter[-1]
        for k, v in list(zip(keys, splitter, strict=True))[-2::-1]:
            out = (F.col(k) > v) | ((F.col(k) == v) & out)
        return out

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(at_least(splitters[mid - 1]), tree(mid, high)).otherwise(tree(low, mid - 1))

    return tree(0, len(splitters)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.002, cut: float = 0.1) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``: shards of near-equal bytes, gapless slots from 0.

    A document's size is its text's UTF-8 bytes plus 16; a null text has none.  Shards follow the order of the text's hash
    and then of doc_id, so that equal texts stand together: a group of copies is cut only where it alone outweighs ``cut`` times
    a shard's mean size.  Rows alike in text and doc_id are one unit.  Null doc_ids sort first.  An empty table gives no rows.
    Columns of ``docs`` that bear one of the new names are replaced.
    """
    space, text, keys = Workspace(docs.sparkSession, "shards"), text_or_empty(), ["__text", "__doc"]
    docs = docs.drop("size", "text_crc32", "shard", "slot", "bucket", *keys)
    sized = docs.withColumns({"size": F.octet_length(text).cast("bigint") + 16, "__text": F.xxhash64(text), "__doc": _ordered(F.col("doc_id"))})
    narrow = space.table(sized.select(*keys, "size"), "sizes")
    splitters, _ = find_splitters(narrow, keys, "size", n_shards, tolerance, cut=cut)
    # slots are numbered in two levels of about as many rows each: within a bucket, and over the buckets of a shard
    bits = (narrow.count() // n_shards).bit_length() // 2
    bucket = F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits) if bits else F.lit(0).cast("bigint")
    placed = lambda df: df.withColumns({"shard": shard_of(keys, splitters), "bucket": bucket})
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed(narrow).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    counts = space.table(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")), "counts")
    space.drop(but=("counts",))
    joined = join_groups(placed(sized.withColumn("text_crc32", utf8_crc32(text))), counts, ["shard", "bucket"], counts.count(), salt_by=keys)
    inside = Window.partitionBy("shard", "bucket").orderBy(*keys)
    return joined.withColumn("slot", F.col("__before") + F.row_number().over(inside) - 1).drop(*keys, "bucket", "__before")
