"""Token ids in binary files: patched frame-of-reference blocks.

A file holds the ids of a run of documents.  Each block of 256 ids stores its minimum, the differences packed at the bit
width that 90 % of them need, and an exception list (positions and high bits) for the rest; an index has the block starts,
so that any range of ids is read by touching its blocks alone.  The files are binary values of a Parquet table in the
shared folder, so that Spark writes, commits and reads them in whatever store that folder is.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_in_worker, shared_dir

BLOCK = 256
#: A file has about so many characters of text, or so many documents.
FILE_CHARS, FILE_DOCS = 1 << 22, 1 << 16
#: Bytes of new units that are tokenized at once, and the units whose ids a worker remembers.
JOINED_BYTES, KEPT_UNITS = 1 << 14, 1_000_000
#: Units of fewer bytes than this are remembered; marks that are cut from a unit's end are so many bytes at most.
KEY_BYTES, TAIL_BYTES = 24, 8
#: A single blank between two characters that aren't white space always begins a pre-token, so texts may be cut there, and a line
#: feed is one by itself unless it ends a text or a run of three.  Texts with any of this go to the library whole:
_ODD = "^ |  | $| \n|\n |\n\n\n|\n\n$|[\t\v\f\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: By byte: the ASCII characters that are no letter, digit, white space or control character; letters and digits; the numbers with as many low bytes set.
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_SURE = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_HEAD = "<4sHHIQI"
_MAGIC = b"FWPF"
_POWERS = 1 << np.arange(32, dtype=np.uint64)
#: Bits that each number below 65,536 needs.
_BITS = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each of a row's values, one after another from the lowest bit on."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view(np.uint8).reshape(len(values), -1)
    columns = np.ascontiguousarray(values.T).astype(np.uint64) & np.uint64((1 << width) - 1)
    out = np.zeros((width * BLOCK // 64 + 1, len(values)), np.uint64)
    for i, column in enumerate(columns):
        word, shift = divmod(i * width, 64)
        out[word] |= column << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[:-1].T).astype("<u8").view(np.uint8)


def _unpacked(data: np.ndarray, width: int) -> np.ndarray:
    """What ``_packed`` was given, below 2 ** ``width``."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(data).view(f"<u{width // 8}").astype(np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(data).view("<u8").T)
    out, mask = np.empty((BLOCK, len(data)), np.uint32), np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        out[i] = value & mask
    return out.T


def pack(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks (one more than there are blocks), and the blocks."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, np.uint32), b""
    grid = np.full(n * BLOCK, ids[-1], np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, BLOCK)
    base = grid.min(axis=1)
    delta = grid - base[:, None]
    bits = _BITS[delta] if int(delta.max()) < len(_BITS) else np.searchsorted(_POWERS, delta.astype(np.uint64), side="right").astype(np.uint8)
    at = int(percentile * (BLOCK - 1))
    width = np.partition(bits, at, axis=1)[:, at]
    row, position = np.nonzero(bits > width[:, None])
    values = (delta[row, position].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
    n_high = np.bincount(row, minlength=n).astype(np.uint16)
    at = np.concatenate([[0], np.cumsum(n_high, dtype=np.int64)])
    position = position.astype(np.uint8)
    packed: dict[int, bytes] = {}
    for w in map(int, np.unique(width)):
        if w:
            which = np.nonzero(width == w)[0]
            packed.update(zip(which.tolist(), map(bytes, _packed(delta[which], w)), strict=True))
    parts = [struct.pack("<IBH", base[i], width[i], n_high[i]) + packed.get(i, b"") + position[at[i] : at[i + 1]].tobytes() + values[at[i] : at[i + 1]].tobytes() for i in range(n)]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<u4"), b"".join(parts)


def unpack(starts: np.ndarray, blocks: np.ndarray, first: int, last: int) -> np.ndarray:
    """Ids of blocks ``first`` to ``last - 1``; ``blocks``: the bytes of all."""
    n = last - first
    if n <= 0:
        return np.zeros(0, np.uint32)
    at = starts[first:last].astype(np.int64)
    take = lambda where, size: blocks[where[:, None] + np.arange(size)]
    base, width, n_high = (np.ascontiguousarray(take(at + o, s)).view(t)[:, 0] for o, s, t in ((0, 4, "<u4"), (4, 1, "u1"), (5, 2, "<u2")))
    out = np.repeat(base[:, None], BLOCK, axis=1)
    for w in map(int, np.unique(width)):
        if w:
            which = np.nonzero(width == w)[0]
            out[which] += _unpacked(take(at[which] + 7, BLOCK * w // 8), w)
    n_high = n_high.astype(np.int64)
    total = int(n_high.sum())
    if total:
        row = np.repeat(np.arange(n), n_high)
        nth = np.arange(total) - np.repeat(np.cumsum(n_high) - n_high, n_high)
        lists = at + 7 + BLOCK * width.astype(np.int64) // 8
        position = blocks[lists[row] + nth]
        values = np.ascontiguousarray(take((lists + n_high)[row] + 4 * nth, 4)).view("<u4")[:, 0]
        out[row, position] += (values.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return out.reshape(-1)


def write_file(doc_ids: list[int | None], lengths: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    starts, blocks = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([
        struct.pack(_HEAD, _MAGIC, 1, BLOCK, len(doc_ids), len(ids), len(starts) - 1), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(),
        np.asarray(lengths, "<u4").tobytes(), starts.astype("<u4").tobytes(), blocks,
    ])


class File:
    """A file's documents, and its ids by range."""

    def __init__(self, data: bytes) -> None:
        magic, version, block, n, self.n_ids, n_blocks = struct.unpack_from(_HEAD, data)
        if (magic, version, block) != (_MAGIC, 1, BLOCK):
            raise ValueError("not a file of token ids")
        at = struct.calcsize(_HEAD)
        take = lambda kind, count: np.frombuffer(data, kind, count, at)
        ids, at = take("<i8", n), at + 8 * n
        known, at = take("u1", n), at + n
        self.lengths, at = take("<u4", n), at + 4 * n
        self._starts, at = take("<u4", n_blocks + 1), at + 4 * (n_blocks + 1)
        self._blocks = np.frombuffer(data, "u1", offset=at)
        self.doc_ids = [d if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        first = start // BLOCK
        return unpack(self._starts, self._blocks, first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]


class _Units:
    """A tokenizer and the ids of units: those of unit i are ``ids[ends[i] : ends[i + 1]]``.

    A unit's key is its bytes in three numbers, the last of which also has their count and whether the unit is a tail; ``slots`` is a
    hash table of the keys, probed for all units of a file at once.  Longer units aren't remembered.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks use the cores
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)  # byte-level: a character for each byte
        self.slots, self.keys = np.full(1 << (4 * KEPT_UNITS - 1).bit_length(), -1, np.int32), np.zeros((1 << 18, 3), np.uint64)
        self.ids, self.ends, self.n = np.zeros(1 << 20, "<u4"), np.zeros(1 << 18, np.int64), 0
        self.again = np.zeros(1 << 18, bool)  # met since it was learnt, or since the last sweep

    def sweep(self) -> None:
        """Forget the units that weren't met again, or all if that leaves too many."""
        if np.count_nonzero(self.again) > KEPT_UNITS // 2:
            self.again[:] = False
        at = np.nonzero(self.again[: self.n])[0]
        size = (self.ends[1:] - self.ends[:-1])[at]
        keys, ids = self.keys[at], _joined(self.ids, self.ends[at], size)
        self.slots[:], self.again[:], self.n = -1, False, 0
        self.add(keys, ids, size)

    def encoded(self, texts: list[str], added_tokens: bool = False) -> list[np.ndarray]:
        self.tokenizer.encode_special_tokens = not added_tokens  # their strings are then ordinary text
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = int(self.ends[self.n]), len(keys)
        self.ids, self.ends, self.again, self.keys = _grown(self.ids, first + len(ids)), _grown(self.ends, self.n + n + 1), _grown(self.again, self.n + n), _grown(self.keys, self.n + n)
        self.ids[first : first + len(ids)], self.ends[self.n + 1 : self.n + n + 1] = ids, first + np.cumsum(sizes)
        self.keys[self.n : self.n + n] = keys
        number, slot = np.arange(self.n, self.n + n, dtype=np.int32), self._slot(keys)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            rest = self.slots[slot] != number
            number, slot = number[rest], (slot[rest] + 1) % len(self.slots)
        self.n += n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the units with these keys; -1 for those that aren't known."""
        out, which, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(which):
            number = self.slots[slot]
            known = number >= 0
            which, slot, number = which[known], slot[known], number[known]
            same = (self.keys[number] == keys[which]).all(axis=1)
            out[which[same]] = number[same]
            which, slot = which[~same], (slot[~same] + 1) % len(self.slots)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), np.uint64)
        for column in keys.T:
            h = (h + column) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - (len(self.slots) - 1).bit_length())).astype(np.int64)

    def learnt(self, units: list[str], tails: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units, each with the blank before it unless it begins with a line feed, or of tails, and how many each has.  Units
        are joined for the library, so that it makes few results, and told apart by the bytes of each id."""
        if tails or not units:
            each = self.encoded(units)
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([*map(len, each)], np.int64)
        joined = f" {' '.join(units)}".replace(" \n", "\n")  # units have line feeds at their begin alone, and no blanks
        data = np.frombuffer(joined.encode(), np.uint8)
        ids = self.encoded([joined])[0]
        begin, ends = np.nonzero((data == 32) | (data == 10))[0], np.cumsum(self.size[ids])
        at = np.concatenate([[0], np.searchsorted(ends, begin[1:]) + 1, [len(ids)]])
        if len(begin) != len(units) or (ends[at[1:-1] - 1] != begin[1:]).any():
            each = self.encoded([u if u[0] == "\n" else f" {u}" for u in units])
            ids, at = np.concatenate(each), np.cumsum([0, *map(len, each)])
        return ids, np.diff(at)

    def lists(self, units, n_whole: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each unit, of an Arrow array of distinct ones, begin in ``ids`` and how many they are, until the next call;
        those from ``n_whole`` on are tails."""
        begin, data = _strings(units)
        size = np.diff(begin)
        keys, short = _keys(begin[:-1], size, data, n_whole), np.nonzero(size < KEY_BYTES)[0]
        number = np.full(len(units), -1, np.int64)
        number[short] = self.find(keys[short])
        self.again[number[number >= 0]] = True
        if self.n and self.n + np.count_nonzero(number[short] < 0) > KEPT_UNITS:
            self.sweep()
            number[short] = self.find(keys[short])
        new = short[number[short] < 0][: KEPT_UNITS - self.n]
        self.add(keys[new], *self._of(units, size, new, n_whole))
        number[new] = np.arange(self.n - len(new), self.n)
        known = number >= 0
        start, count = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        start[known], count[known] = self.ends[number[known]], self.ends[number[known] + 1] - self.ends[number[known]]
        rest, after = np.nonzero(~known)[0], int(self.ends[self.n])
        ids, count[rest] = self._of(units, size, rest, n_whole)
        start[rest] = after + np.cumsum(count[rest]) - count[rest]
        self.ids = _grown(self.ids, after + len(ids))
        self.ids[after : after + len(ids)] = ids  # behind those of the units, until the next are added
        return start, count

    def _of(self, units, size: np.ndarray, at: np.ndarray, n_whole: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units at these ascending places, and how many each has."""
        parts, low, whole = [], 0, int(np.searchsorted(at, n_whole))
        upto, names = np.cumsum(size[at]), units.take(at).to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist()
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + JOINED_BYTES, side="right")))
            high = min(high, whole) if low < whole else high
            parts.append(self.learnt(names[low:high], low >= whole))
            low = high
        return tuple(np.concatenate([np.zeros(0, kind), *some]) for kind, some in zip(("<u4", np.int64), zip(*parts, strict=True) if parts else ((), ()), strict=True))


def _strings(array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string of an Arrow array of large strings begins, with the end of the last, and the bytes, with some behind."""
    _, begin, data = array.buffers()
    bytes_ = np.zeros((len(data) if data else 0) + KEY_BYTES, np.uint8)
    if data:
        bytes_[:-KEY_BYTES] = np.frombuffer(data, np.uint8)
    return np.frombuffer(begin, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64), bytes_


def _keys(begin: np.ndarray, size: np.ndarray, data: np.ndarray, n_whole: int) -> np.ndarray:
    at_any = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = np.empty((len(begin), KEY_BYTES // 8), np.uint64)
    for j in range(KEY_BYTES // 8):
        out[:, j] = at_any[np.minimum(begin + 8 * j, len(at_any) - 1)] & _LOW_BYTES[np.clip(size - 8 * j, 0, 8)]
    out[:, -1] |= size.astype(np.uint64) << np.uint64(56)  # below KEY_BYTES, where the key is used
    out[n_whole:, -1] |= np.uint64(1 << 63)
    return out


def _joined(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The lists of these starts and sizes in ``pool``, one after another."""
    upto = np.cumsum(size)
    return pool[np.repeat(start - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate([array, np.zeros((max(n, 2 * len(array)) - len(array), *array.shape[1:]), array.dtype)])


class UnitEncoder:
    """Encodes texts cut at blanks and line feeds; the tokenizers library sees each distinct unit once, until too many are remembered.

    With ``added_tokens``, the strings of the vocabulary's added tokens get the ids of these, as the library gives them by
    default, and a text that holds one goes to it whole; otherwise they are ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        self.units, self.added_tokens = kept_in_worker("units", path, lambda: _Units(path)), added_tokens
        self.odd = "|".join([_ODD, *(map(re.escape, self.units.added) if added_tokens else [])])

    def _distinct(self, units) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of distinct units, and how many each has.  Marks that end a unit, behind a letter or digit, are
        pre-tokens of their own, so units that differ in these alone are looked up once."""
        import pyarrow as pa

        units = units.cast(pa.large_string())
        (bounds, data), n = _strings(units), len(units)
        begin, cut = bounds[:-1], bounds[1:].copy()
        some = np.nonzero(cut > begin)[0]
        for _ in range(TAIL_BYTES):
            some = some[_MARK[data[cut[some] - 1]]]
            cut[some] -= 1
            some = some[cut[some] > begin[some]]
        last, before = data[cut - 1], data[cut - 2]
        sure = _SURE[last] | (last >= 0x80) & (before == 0xC3) & (last != 0x97) & (last != 0xB7)  # U+00C0 to U+00FF but U+00D7 and U+00F7
        cut = np.where(sure & (cut > begin), cut, bounds[1:])
        tailed = np.nonzero(cut < bounds[1:])[0]
        both = np.empty(2 * n + 1, np.int64)
        both[0::2], both[1::2] = bounds, cut
        pieces = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(both), pa.py_buffer(data))
        whole, tails = (pieces.take(pa.array(at)).dictionary_encode() for at in (np.arange(0, 2 * n, 2), 2 * tailed + 1))
        start, size = self.units.lists(pa.concat_arrays([whole.dictionary, tails.dictionary]), len(whole.dictionary))
        row = np.zeros((n, 2), np.int64)
        row[:, 0], row[tailed, 1] = whole.indices.to_numpy(), len(whole.dictionary) + tails.indices.to_numpy()
        taken = size[row]
        taken[cut == bounds[1:], 1] = 0
        return _joined(self.units.ids, start[row].ravel(), taken.ravel()), taken.sum(axis=1)

    def encode(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, an Arrow array of strings without nulls, and all ids; each text's end with ``end_id``."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        broken = texts.filter(pa.array(odd)).to_pylist()
        split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        n, flat = np.diff(split.offsets.to_numpy()), split.flatten()
        rest = np.ones(len(flat), bool)
        rest[np.cumsum(n) - n] = False  # a text's first unit has no blank before it
        whole = self.units.encoded(flat.filter(pa.array(~rest)).to_pylist())
        coded = flat.filter(pa.array(rest)).dictionary_encode()
        whole += self.units.encoded(broken, self.added_tokens)
        whole.append(np.array([] if end_id is None else [end_id], "<u4"))

        # lists of ids: those of the distinct units, then those of first units, of whole texts, and the end
        ids, size = self._distinct(coded.dictionary)
        n_units, size = len(size), np.concatenate([size, [*map(len, whole)]])
        ends = 4 * np.concatenate([[0], np.cumsum(size)])
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([ids, *whole]).astype("<u4", copy=False))])
        # for each text, whether of units or whole, the lists that it is made of, and the end
        of = np.zeros(len(texts), np.int64)
        of[~odd], of[odd] = n + 1, 2
        last = np.cumsum(of)
        row = np.full(int(of.sum()), len(size) - 1)
        first = last - of
        row[first[~odd]], row[first[odd]] = n_units + np.arange(len(n)), n_units + len(n) + np.arange(len(broken))
        inner = np.ones(len(row), bool)
        inner[first] = inner[last - 1] = False
        row[inner] = coded.indices.to_numpy()
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        _, ends, data = lists.take(pa.array(row)).buffers()
        n_bytes = int(np.frombuffer(ends, np.int64)[len(row)])
        return np.add.reduceat(size[row], first), np.frombuffer(data, "<u4", n_bytes // 4) if n_bytes else np.zeros(0, "<u4")


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, added_tokens: bool = False) -> None:
    """Encode the whole texts of ``docs`` and write the files to ``path``, in ascending doc_id order.

    Rows are dealt by ranges of doc_id and then of the text's hash, which splits a doc_id of very many rows; null doc_ids
    come first, null texts count as empty and get the end id alone.  Rows alike in both stand in any order.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encoder, part, seq, before = UnitEncoder(tokenizer, added_tokens), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            chars = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
            low = 0
            while low < len(chars):
                high = int(np.searchsorted(chars, (chars[low - 1] if low else 0) + FILE_CHARS, side="right"))
                high = max(low + 1, min(high, low + FILE_DOCS))
                lengths, ids = encoder.encode(batch.column("text").slice(low, high - low), end_id)
                data = write_file(batch.column("doc_id").slice(low, high - low).to_pylist(), lengths, ids)
                yield pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (before, pa.int64()), (len(ids), pa.int64()), (data, pa.binary()))], names=["part", "seq", "before", "n_ids", "data"])
                low, seq, before = high, seq + 1, before + len(ids)
                pa.default_memory_pool().release_unused()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_ = read.repartitionByRange(n, *order).sortWithinPartitions(*order)
    sorted_.mapInArrow(run, "part int, seq int, before long, n_ids long, data binary").write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that wrote
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
                file = File(data.as_py())
                ends = np.cumsum(file.lengths, dtype=np.int64)
                ids = memoryview(file.ids(0, file.n_ids).astype("<u4")).cast("B")
                bounds = [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch([pa.array(file.doc_ids, pa.int64()), pa.array(start + ends - file.lengths), pa.array(file.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = files.join(F.broadcast(parts), F.col("part") == F.col("p"))  # as many rows as write_ids() had partitions
    return joined.select((F.col("base") + F.col("before")).alias("start"), "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str, added_tokens: bool = False) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back; see :func:`write_ids` and :func:`read_ids`.

    Null and empty texts get the end id alone, and repeated rows stand one after another.  An empty table gives no rows.  Only doc_id
    and text are read, whatever other columns there are.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fernweave-ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer, path, added_tokens=added_tokens)
    return read_ids(spark, path)
