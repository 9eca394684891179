"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import checkpointed, shared_dir  # noqa: F401  the operators take them from here

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A small table is broadcast only when it has been counted and has at most so many rows.
BROADCAST_ROWS = 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a vocabulary file: in ``folder``, or where the installed package of public tokenizers has it."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def forget_others(name: str | None = None) -> None:
    """Drop what operators keep in this Python worker, but for that by ``name``: Spark hands workers on from query to query, and
    what one has left would stand in memory beside what the next one needs."""
    kept = vars(sys.modules.setdefault("_fernweave_worker", types.ModuleType("_fernweave_worker")))
    if others := [n for n in kept if n != name and not n.startswith("__")]:
        for n in others:
            del kept[n]
        with suppress(OSError, AttributeError):  # where the C library can give free memory back
            ctypes.CDLL(None).malloc_trim(0)


def kept_in_worker(name: str, key: object, make: Callable):
    """What ``make()`` gave in this Python worker for ``key``, the latest one; what is kept by other names goes.

    Code comes to a worker by value with each task, so what is to outlive one is kept in a module made for it."""
    forget_others(name)
    kept = vars(sys.modules["_fernweave_worker"])
    if name not in kept or kept[name][0] != key:
        kept[name] = key, make()
    return kept[name][1]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for a text without any."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def utf8_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.encode(text, "UTF-8"))


class Workspace:
    """A folder of one run in the shared one, with tables that are written once and read as plain Parquet, so that Spark knows
    their sizes, and that outlive any executor."""

    made: ClassVar[list[list[Workspace]]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self._names = spark, f"{shared_dir(spark).rstrip('/')}/fernweave-{name}-{uuid.uuid4().hex}", []
        for some in self.made:
            some.append(self)

    @classmethod
    @contextmanager
    def cleared(cls) -> Iterator[None]:
        """What operators write within the block is deleted at its end: their results must have been written by then."""
        cls.made.append([])
        try:
            yield
        finally:
            for space in cls.made.pop():
                space.drop()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        self._names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, but: tuple[str, ...] = ()) -> None:
        """Delete the tables, but for those that some frame is still to be read from."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        files = place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in self._names if but else [""]:
            if name not in but or not name:
                files.delete(place(f"{self.path}/{name}".rstrip("/")), True)
        self._names = [n for n in self._names if n in but]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n_groups: int, how: str = "left", salts: int = 32, salt_by: list[str] | None = None) -> DataFrame:
    """Give each row what a table with one row for each key says of its key; keys may be null.

    ``n_groups`` is the counted size of ``groups``: up to BROADCAST_ROWS rows it is broadcast.  Beyond that both sides are
    shuffled on the key and a salt from ``salt_by`` (by default all columns), so that a key with a third of all rows is dealt
    over ``salts`` tasks.
    """
    inner = groups.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [rows[k].eqNullSafe(inner[f"__{k}"]) for k in keys]
    if n_groups <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(inner), same, how)
        return out.drop(*(f"__{k}" for k in keys))
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*(salt_by or rows.columns)), F.lit(salts)))
    right = inner.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    same = [left[k].eqNullSafe(right[f"__{k}"]) for k in keys] + [left["__salt"] == right["__other"]]
    return left.join(right, same, how).drop("__salt", "__other", *(f"__{k}" for k in keys))


def join_skewed(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, size: str | None = None, share: int = 1000, most_bytes: int = 64 << 20) -> DataFrame:
    """Inner join of ``rows`` to a table with one row for each key; ``count`` there is how many rows the key has.

    Keys with over 1/``share`` of all counted rows are at most ``share`` in number: these are broadcast, if their bytes
    (column ``size``, dropped; 64 a row without it) add up to at most ``most_bytes``, and joined on a salt otherwise.  No
    other key weighs more than 1/``share`` of the rows in the task that it falls to.  Both tables should be checkpointed.
    """
    total, kept = groups.agg(F.sum(count)).first()[0] or 0, [c for c in groups.columns if c not in (count, size)]
    hot = groups.where(F.col(count) > max(1000, total // share))
    n_hot, n_bytes = hot.agg(F.count("*"), F.sum(size) if size else F.count("*") * 64).first()
    if not n_hot:
        return rows.join(groups.select(*kept), keys)
    cold = groups.where(F.col(count) <= max(1000, total // share)).select(*kept)
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    some, rest = marked.where("__hot").drop("__hot"), marked.where("__hot is null").drop("__hot")
    if n_bytes <= most_bytes:
        return some.join(F.broadcast(hot.select(*kept)), keys).unionByName(rest.join(cold, keys))
    salts = 64
    some = some.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    spread = hot.select(*kept).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return some.join(spread, [*keys, "__salt"]).drop("__salt").unionByName(rest.join(cold, keys))
