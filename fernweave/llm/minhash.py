"""MinHash near-dedup with DartMinHash signatures of word shingles, banded joining and exact verification.

A text is the multiset of its five-word shingles; a shingle found w times is an element of weight w, and the similarity of
two texts is their weighted Jaccard index.  The region of an element, weight by rank, is cut into cells of unit weight; in
each, darts fall along the rank axis as a Poisson process of rate one whose gaps and coordinates are hashes of the cell.
For each of ``k`` coordinates a text keeps its dart of least rank.  Ranks are looked at up to t / weight, with t = k ln k +
2 k darts expected whatever the text's length, and further for the few texts that leave a coordinate empty.

Texts that share a band are of the group of the band's pivot, its text that meets the most others.  A group is dealt in blocks
of bounded size, the pivot to each, and what the texts of a block have in common is counted at once, by their words; nothing is
made for each pair.  Only in groups of several blocks can a link be missed so far: there, texts outside the largest class found
are compared with those of other classes in other blocks, again block by block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, forget_others, text_or_empty, words

WIDTH = 5
BANDS, ROWS = 30, 5
SIMILARITY = 0.8
#: Texts and words of a block, about.
BLOCK_TEXTS, BLOCK_WORDS = 256, 1 << 17
#: Words that are signed at once in a task.
SIGN_WORDS = 1 << 17

_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def shingles(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each shingle; a text with fewer than five words is one shingle, one without words none."""
    ends = np.cumsum(lengths)
    n = np.where(lengths >= WIDTH, lengths - WIDTH + 1, (lengths > 0).astype(np.int64))
    row = np.repeat(np.arange(len(lengths)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - lengths, n)
    padded = np.concatenate([hashes, np.zeros(WIDTH, np.uint64)])
    size = np.minimum(lengths, WIDTH)[row]
    out = np.zeros(len(row), np.uint64)
    for j in range(WIDTH):
        out += np.where(j < size, _mix(padded[at + j] ^ _MULTIPLIERS[j]) * _MULTIPLIERS[j], _U(0))
    return row, _mix(out)


def unit_cells(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of each cell: the c-th time that a row has a shingle is the cell c of that element."""
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    return row, _mix(shingle + (np.arange(len(row)) - start).astype(np.uint64) * _MULTIPLIERS[1])


def dart_signatures(row: np.ndarray, cells: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """``k`` dart identifiers for each row; rows without cells get zeros."""
    out = np.zeros((n_rows, k), np.uint64)
    weight = np.bincount(row, minlength=n_rows)
    darts = k * np.log(k) + 2 * k
    todo = weight > 0
    while todo.any():
        mine = todo[row]
        at, key = row[mine], cells[mine]
        best = np.full(n_rows * k, np.inf)
        limit = (darts / np.maximum(weight, 1))[at]
        rank = np.zeros(len(at))
        found = out.reshape(-1)
        number = 0
        while len(at):
            number += 1
            h = _mix(key + _U(number * int(_MULTIPLIERS[0]) % 2**64))
            rank = rank - np.log1p(-((h >> _U(24)).astype(np.float64) * 2.0**-40))
            near = rank <= limit
            if not near.all():
                at, key, rank, limit, h = at[near], key[near], rank[near], limit[near], h[near]
            slot = at * k + ((h & _U(0xFFFFFF)) % _U(k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            won = rank == best[slot]
            found[slot[won]] = _mix(h[won])
        todo &= np.isinf(best.reshape(n_rows, k)).any(axis=1)
        darts *= 2
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), np.uint64)
    for j in range(rows):
        out = _mix(out * _MULTIPLIERS[2] + signatures[:, j : bands * rows : rows] + _U(1))
    return _mix(out + np.arange(bands, dtype=np.uint64) * _MULTIPLIERS[3])


def _sign(batches: Iterator, bands: int, rows: int) -> Iterator:
    import pyarrow as pa

    forget_others()
    for batch in batches:
        ids, lists = [batch.column(c) for c in ("doc_id", "tid", "tid2")], batch.column("w")
        lengths = np.diff(lists.offsets.to_numpy().astype(np.int64))
        hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends, low = np.cumsum(lengths), 0
        while low < len(lengths):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + SIGN_WORDS, side="right")))
            row, shingle = shingles(hashes[before : int(ends[high - 1])], lengths[low:high])
            signed = band_hashes(dart_signatures(*unit_cells(row, shingle), high - low, bands * rows), bands, rows)
            values = pa.array(signed[lengths[low:high] > 0].reshape(-1).view(np.int64))
            n = np.where(lengths[low:high] > 0, bands, 0)
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.record_batch([*(c.slice(low, high - low) for c in ids), pa.ListArray.from_arrays(pa.array(at), values)], names=["doc_id", "tid", "tid2", "bands"])
            low = high
        del batch, ids, lists, hashes  # before the next one is read


def _coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """The shingles of a few texts by the words themselves: row and cell number of each cell that two rows or more have, how many
    such cells there are, and the number of shingles of each text.  The c-th time that a text has a shingle is cell c of it."""
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)), 1)}
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    n = np.where(lengths >= WIDTH, lengths - WIDTH + 1, (lengths > 0).astype(np.int64))
    row = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - lengths, n)
    padded, most = np.concatenate([codes, np.zeros(WIDTH, np.int64)]), np.minimum(lengths, WIDTH)[row]
    base, key, span = len(number) + 1, padded[at], len(number) + 1
    for j in range(1, WIDTH):
        if span >= (1 << 62) // base:
            found, key = np.unique(key, return_inverse=True)
            span = len(found)
        key, span = key * base + np.where(j < most, padded[at + j], 0), span * base
    key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(row * (int(key.max(initial=0)) + 1) + key, kind="stable")
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    nth = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    cell, count = np.unique(key * (int(nth.max(initial=0)) + 1) + nth, return_inverse=True, return_counts=True)[1:]
    common = count[cell] > 1
    return row[common], (np.cumsum(count > 1) - 1)[cell[common]], int((count > 1).sum()), n


def overlaps(texts: list[bytes], first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that each of the ``first`` texts (by default of all) has in common with each text, and the number each text has."""
    row, cell, n_cells, sizes = _coded(texts)
    first = len(texts) if first is None else first
    out = np.zeros((first, len(texts)), np.int64)
    order = np.argsort(cell, kind="stable")
    row, cell = row[order], cell[order]
    for low in range(0, n_cells, 4096):  # so that a block's matrix stays small whatever its texts
        a, b = np.searchsorted(cell, (low, low + 4096))
        holds = np.zeros((len(texts), min(4096, n_cells - low)), np.float32)
        holds[row[a:b], cell[a:b] - low] = 1
        out += (holds[:first] @ holds.T).astype(np.int64)
    return out, sizes


def _alike(common: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    first = len(common)
    return (common > 0) & (common >= least * (sizes[:first, None] + sizes[None, :] - common) - 1e-9)


def _least_of_class(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n numbers, the least one that the links u - v connect it to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard index of the shingles; 0 where either text has none."""
    common, sizes = overlaps([t.encode("utf-8", "surrogatepass") for t in (a, b)])
    return int(common[0, 1]) / int(sizes.sum() - common[0, 1]) if common[0, 1] else 0.0


def text_shingles(text: str | bytes) -> Counter:
    """Shingles as tuples of words."""
    w = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()
    return Counter(tuple(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))) if w else Counter()


def _blocks(batches: Iterator, keys: list[str], values: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Key and rows of each block, from batches that are sorted by the keys."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        held = [batch.column(v).cast("binary" if v == "text" else "int64").to_pylist() for v in values]
        for now, row in zip(zip(*columns, strict=True), zip(*held, strict=True), strict=True):
            if now != key:
                if rows:
                    yield key, rows
                key, rows = now, []
            rows.append(row)
    if rows:
        yield key, rows


def _sent(rows: Iterator[tuple], names: list[str]) -> Iterator:
    import pyarrow as pa

    while some := list(islice(rows, 10_000)):
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=names)


def _linked(batches: Iterator, least: float) -> Iterator:
    """Links of each text in a block to the least of those that it is connected to; where its group has several blocks, also what
    each text (``a``) has in common with the pivot (``p``)."""

    def rows() -> Iterator[tuple]:
        forget_others()
        for (p, _, n_blocks), block in _blocks(batches, ["p", "block", "n_blocks"], ["tid", "text"]):
            block.sort()
            ids = [i for i, _ in block]
            common, sizes = overlaps([t for _, t in block])
            label = _least_of_class(len(ids), *np.nonzero(np.triu(_alike(common, sizes, least), 1)))
            yield from ((ids[i], ids[k], None, None, None) for i, k in enumerate(label.tolist()) if i != k)
            if n_blocks > 1:
                yield from ((i, None, p, c, s) for i, c, s in zip(ids, common[ids.index(p)].tolist(), sizes.tolist(), strict=True))

    return _sent(rows(), ["a", "b", "p", "common", "size"])


def _linked_classes(batches: Iterator, least: float) -> Iterator:
    """Links between the classes of similar texts in a block, where one text at least is of the block's minor part."""

    def rows() -> Iterator[tuple]:
        forget_others()
        for (_, _, part), block in _blocks(batches, ["p", "block", "part"], ["minor", "class", "text"]):
            block.sort(key=lambda r: -r[0])
            first = sum(r[0] for r in block)
            if not first:
                continue
            classes, of = np.unique(np.array([r[1] for r in block], np.int64), return_inverse=True)
            alike = _alike(*overlaps([r[2] for r in block], first), least) & (of[:first, None] != of[None, :])
            if part:
                alike[:, :first] = False  # compared in part 0
            u, v = np.nonzero(alike)
            label = _least_of_class(len(classes), of[u], of[v])
            yield from ((int(classes[i]), int(classes[k])) for i, k in enumerate(label.tolist()) if i != k)

    return _sent(rows(), ["a", "b"])


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(tid, label) for each end of an edge (a, b): the least tid of its connected component.

    Each text is put on its least neighbour, and the links between what is left are looked at again, until there are none.  The
    largest text of a component goes each time, and with ids that are hashes a good part of all, so rounds are few.
    """
    rest, labels, at = space.table(edges.distinct(), f"{name}-links-0"), None, 0
    while not rest.isEmpty():
        both = rest.select("a", "b").union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        put = space.table(both.groupBy(F.col("a").alias("tid")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{name}-put-{at}")
        for end in "ab":
            of = put.select(F.col("tid").alias(end), F.col("label").alias(f"{end}_on"))
            rest = rest.join(of, end)
        rest = space.table(rest.where("a_on <> b_on").select(F.col("a_on").alias("a"), F.col("b_on").alias("b")).distinct(), f"{name}-links-{at + 1}")
        if labels is None:
            labels = put
        else:
            on = put.select(F.col("tid").alias("label"), F.col("label").alias("to"))
            labels = space.table(labels.join(on, "label", "left").select("tid", F.coalesce("to", "label").alias("label")), f"{name}-labels-{at}")
        at += 1
    return labels if labels is not None else rest.select(F.col("a").alias("tid"), F.col("b").alias("label"))


def _dealt(rows: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their texts, each block of equal ``keys`` side by side in one partition."""
    return rows.join(texts.select("tid", "text"), "tid").repartition(*keys).sortWithinPartitions(*keys)


def _second_look(met: DataFrame, labels: DataFrame, texts: DataFrame, space: Workspace, least: float) -> DataFrame:
    """Links between classes that lie in different blocks of a group, where each text was compared with its block and the pivot.

    Per group, the texts outside its largest class are compared with all texts of other classes, block by block, but for those
    that are too large, too small or too near to the pivot to be similar to any of them: 1 - similarity is a metric.
    """
    once = met.groupBy("p", F.col("a").alias("tid")).agg(F.max("common").alias("common"), F.max("size").alias("size"))
    of = space.table(once.join(labels, "tid", "left").select("p", "tid", F.coalesce("label", "tid").alias("class"), "common", "size"), "classes-met")
    counts = of.groupBy("p", "class").agg(F.count("*").alias("n"), F.max(F.when(F.col("tid") == F.col("p"), F.col("size"))).alias("size"))
    main = counts.groupBy("p").agg(F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("classes"), F.max("size").alias("pivot_size"))
    main = space.table(main.where("classes > 1").select("p", F.col("top.class").alias("main"), "pivot_size"), "main")
    far = 1 - F.col("common") / (F.col("size") + F.col("pivot_size") - F.col("common"))
    marked = space.table(of.join(main, "p").select("p", "tid", "class", "size", far.alias("far"), (F.col("class") != F.col("main")).cast("int").alias("minor")), "marked")
    minors = marked.where("minor = 1").groupBy("p").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("far").alias("nearest"), F.min("size").alias("least"), F.max("size").alias("most"))
    minors = space.table(minors.withColumn("blocks", _n_blocks(F.col("n"), F.col("words"))).drop("n", "words"), "minors")
    able = (F.col("far") >= F.col("nearest") - (1 - least) - 1e-9) & (F.col("size") >= least * F.col("least") - 1e-6) & (F.col("size") * least <= F.col("most") + 1e-6)
    kept = marked.join(minors, "p").where((F.col("minor") == 1) | able)
    # the other texts of a group are dealt in parts; a block of minor ones goes to each part
    kept = space.table(kept, "kept")
    parts = space.table(kept.groupBy("p").agg(_n_blocks(F.count("*"), F.sum("size")).alias("parts")), "parts")
    both = space.table(kept.join(parts, "p").select("p", "tid", "class", "minor", "blocks", "parts"), "to-compare")
    own, part = F.pmod(F.xxhash64("tid"), F.col("blocks")), F.pmod(F.xxhash64("tid", F.lit(1)), F.col("parts"))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    first = both.where("minor = 1").select("p", "tid", "class", "minor", own.alias("block"), F.explode(upto(F.col("parts"))).alias("part"))
    below = F.when(F.col("minor") == 0, upto(F.col("blocks"))).otherwise(F.filter(upto(F.col("blocks")), lambda i: i < own))
    second = both.select("p", "tid", "class", F.lit(0).alias("minor"), F.explode(below).alias("block"), part.alias("part"))
    dealt = _dealt(first.unionByName(second), texts, ["p", "block", "part"])
    return space.table(dealt.mapInArrow(lambda it: _linked_classes(it, least), "a long, b long").distinct(), "links-between")


def _n_blocks(n: Column, n_words: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK_TEXTS, n_words / BLOCK_WORDS, F.lit(1)))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id and text are read): doc_id, text_key, class_id, class_size (rows), representative.

    Classes are the connected components of texts with similarity of at least ``least``; equal texts are of one class.  The
    class_id is the least doc_id of the class, null if all are null, and ``representative`` marks the rows with that doc_id
    and one text.  Null texts count as empty; texts without words are alike only if equal.  A text of fewer than five words is
    one shingle.  Repeated rows are judged alike.  Texts of at least that similarity share a band with a probability of
    1 - 7e-6 or more, and texts are told apart by 128 bits of hash, their pairs by 64.  An empty table gives no rows.
    Columns besides doc_id and text, whatever their names, are not read.
    """
    # Figures of a group are written before they are joined to its rows, so that Spark can split the rows of a hot key.
    space, text = Workspace(docs.sparkSession, "minhash"), text_or_empty()
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    key = [F.xxhash64("text").alias("tid"), F.xxhash64(F.lit(1), "text").alias("tid2")]
    hashed = plain.select("doc_id", *key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    signed = space.table(hashed.mapInArrow(lambda it: _sign(it, bands, rows), "doc_id long, tid long, tid2 long, bands array<long>"), "signed")
    distinct = space.table(signed.groupBy("tid", "tid2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "distinct")

    every = distinct.select("tid", F.explode("bands").alias("band"))
    shared = space.table(every.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = space.table(every.join(shared, "band"), "members")
    met = members.groupBy("tid").agg(F.sum("n").alias("met"))  # a band's pivot is its text that meets the most others
    pivots = space.table(members.join(met, "tid").groupBy("band").agg(F.max(F.struct("met", "tid")).alias("top")), "pivots")
    placed = space.table(members.join(pivots, "band").select(F.col("top.tid").alias("p"), "tid").distinct(), "placed")

    least_id = F.lit(-(1 << 63))
    wanted = distinct.join(placed.select("tid").distinct(), "tid", "left_semi").groupBy("tid").agg(F.min(F.coalesce("first", least_id)).alias("first"))
    found = plain.select(key[0], F.coalesce("doc_id", least_id).alias("first"), "text").join(wanted, ["tid", "first"]).dropDuplicates(["tid"])
    texts = space.table(found.select("tid", "text", F.size(words(F.col("text"))).alias("n_words")), "texts")

    groups = placed.join(texts.select("tid", "n_words"), "tid").groupBy("p").agg(_n_blocks(F.count("*"), F.sum("n_words")).alias("n_blocks"))
    groups = space.table(groups, "groups")
    own = F.array(F.pmod(F.xxhash64("tid"), F.col("n_blocks")))
    block = F.when(F.col("tid") == F.col("p"), F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).otherwise(own)
    dealt = _dealt(placed.join(groups, "p").select("p", "tid", "n_blocks", F.explode(block).alias("block")), texts, ["p", "block"])
    compared = space.table(dealt.mapInArrow(lambda it: _linked(it, least), "a long, b long, p long, common long, size long"), "compared")
    labels = components(compared.where("p is null").select("a", "b"), space, "texts")
    met = compared.where("p is not null").select("a", "p", "common", "size")
    if not met.isEmpty():
        joined = components(_second_look(met, labels, texts, space, least), space, "classes").select(F.col("tid").alias("label"), F.col("label").alias("to"))
        every = labels.unionByName(joined.select(F.col("label").alias("tid"), "label").join(labels.select("tid"), "tid", "left_anti"))
        labels = every.join(joined, "label", "left").select("tid", F.coalesce("to", "label").alias("label"))

    of = distinct.drop("bands").join(labels, "tid", "left").withColumn("alone", F.col("label").isNull()).withColumn("label", F.coalesce("label", "tid"))
    of = space.table(of, "labelled")
    one = F.min(F.struct(F.col("first").isNull(), "first", "tid", "tid2")).alias("one")
    classes = space.table(of.where("not alone").groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), one), "classes")
    main = (F.col("tid") == F.col("one.tid")) & (F.col("tid2") == F.col("one.tid2"))
    own = lambda name, alone: F.when(F.col("alone"), alone).otherwise(F.col(name)).alias(name)
    classed = of.join(classes, "label", "left").select("tid", "tid2", own("class_id", F.col("first")), own("class_size", F.col("copies")), (F.col("alone") | main).alias("main"))
    classed = space.table(classed, "classed")
    space.drop(but=("signed", "classed"))  # which the result reads
    out = signed.drop("bands").join(classed, ["tid", "tid2"])
    representative = F.col("main") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return out.select("doc_id", F.col("tid").alias("text_key"), "class_id", "class_size", representative.alias("representative"))
