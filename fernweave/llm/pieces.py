"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of blanks with the characters up to the next blank or line feed, which no piece
crosses) are joined to one text.  Its suffixes are sorted as far as the longest piece reaches, every piece is found by
binary search as a range of suffixes, and the resulting edges are sorted by the place where they end and relaxed in that
order, for all units side by side.

The vocabulary is a BPE model, where the best path isn't the one of greatest score.  An edge is therefore relaxed only if its
piece may follow the last piece of the best path to its start: two pieces may stand together if the merges that made them
would not have joined anything across their border.  Exactly one path passes, and it is what the merges give.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker

_UNIT = re.compile("\n| *[^ \n]+| +")
#: Codes in the joined text: between units, and for characters that no piece has.
_GAP, _OTHER = 0, 1
#: Bytes of texts that are looked at together, characters of new units that are indexed at once, units that a worker remembers and
#: their characters, besides those of the texts that it looks at, and pairs whose verdict it remembers.
TEXT_BYTES, BATCH_CHARS, KEPT_UNITS, KEPT_CHARS, KEPT_PAIRS = 1 << 20, 1 << 17, 400_000, 1 << 22, 1_000_000


@dataclass
class Vocabulary:
    """Pieces by rank: single characters first, then merges, the earliest first."""

    pieces: list[str]
    ids: np.ndarray
    left: np.ndarray  # the two pieces that a merge joins; a character's are itself
    right: np.ndarray
    pair_keys: np.ndarray  # left * size + right of the merges, sorted, and what they make
    pair_ranks: np.ndarray
    byte_ids: np.ndarray
    table: list[bytes]  # of each id, for decoding
    chars: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.chars = np.unique(np.array([ord(c) for p in self.pieces for c in p], np.uint32))


def load_vocabulary(path: str) -> Vocabulary:
    """Read a BPE model file with byte fallback, and find the last merge of every piece that merges can reach."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual, byte_ids, table = [], np.zeros(256, np.int64), []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            table.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            table.append(b"")
        else:
            table.append(piece.replace("▁", " ").encode())
            usual.append((len(piece) > 1, -model.get_score(i) if len(piece) > 1 else 0, piece.replace("▁", " "), i))
    usual.sort(key=lambda x: x[:2])
    rank = {p: r for r, (_, _, p, _) in enumerate(usual)}
    left, right, reached = list(range(len(usual))), list(range(len(usual))), np.ones(len(usual), bool)
    for r, (merged, _, piece, _) in enumerate(usual):
        if not merged:
            continue
        parts = list(piece)
        while len(parts) > 2:
            best, at = min((rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and all(p in rank for p in parts):
            left[r], right[r] = rank[parts[0]], rank[parts[1]]
        else:
            reached[r] = False
    n = len(usual)
    made = np.array([r for r in range(n) if left[r] != r], np.int64)
    left_, right_ = np.array(left + [n]), np.array(right + [n])  # one more for characters without a piece
    keys = left_[made] * (n + 1) + right_[made]
    order = np.argsort(keys)
    pieces = [p if reached[r] else "" for r, (_, _, p, _) in enumerate(usual)]
    return Vocabulary(pieces, np.array([i for *_, i in usual]), left_, right_, keys[order], made[order], byte_ids, table)


def may_follow(v: Vocabulary, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether merges would leave the border between two pieces: both are taken apart, the later merge first, and no pair
    that meets at the border may have been joined before the pieces there were made."""
    n = len(v.pieces) + 1
    a, b = first.astype(np.int64), second.astype(np.int64)
    limit, out, live = np.full(len(a), n, np.int64), np.ones(len(a), bool), np.arange(len(a))
    while len(live):
        key = a * n + b
        at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        joined = (v.pair_keys[at] == key) & (v.pair_ranks[at] < limit)
        out[live[joined]] = False
        whole_a, whole_b = v.right[a] == a, v.left[b] == b
        split_a = ~whole_a & ((a > b) | whole_b)
        go = ~joined & ~(whole_a & whole_b)
        limit = np.where(split_a, a, b + 1)
        a, b = np.where(split_a, v.right[a], a), np.where(split_a, b, v.left[b])
        a, b, limit, live = a[go], b[go], limit[go], live[go]
    return out


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` codes, by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, size = np.argsort(rank, kind="stable"), 1
    while size < depth:
        key = rank * (len(rank) + 1)
        key[:-size] += rank[size:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        size *= 2
    return order


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        usable = [(r, p) for r, p in enumerate(vocabulary.pieces) if p]
        self.ranks = np.array([r for r, _ in usable])
        self.depth = max(len(p) for _, p in usable)
        self.low = np.array([p for _, p in usable], f"U{self.depth}")
        self.high = np.array([p.ljust(self.depth, "\U0010ffff") for _, p in usable], f"U{self.depth}")
        self.sizes = np.array([len(p) for _, p in usable])
        self.known: dict[str, bytes] = {}  # units met lately
        self.known_chars = 0
        self.older: dict[str, bytes] = {}  # those before, of which the ones that are met again move up
        self.pair_keys, self.pair_values = np.zeros(0, np.int64), np.zeros(0, bool)

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and rank of every occurrence of a piece."""
        order = suffix_array(codes, self.depth)
        padded = np.concatenate([codes, np.zeros(self.depth, np.uint32)])
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.depth)[: len(codes)][order]).view(f"U{self.depth}")[:, 0]
        first, last = np.searchsorted(windows, self.low, "left"), np.searchsorted(windows, self.high, "right")
        n = last - first
        which = np.repeat(np.arange(len(n)), n)
        start = order[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        return start, start + self.sizes[which], self.ranks[which]

    def _fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys, back = np.unique(first * (len(self.v.pieces) + 1) + second, return_inverse=True)
        at = np.searchsorted(self.pair_keys, keys)
        seen = np.zeros(len(keys), bool)
        if len(self.pair_keys):
            seen = self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == keys
        verdict = np.zeros(len(keys), bool)
        verdict[seen] = self.pair_values[at[seen]]
        if not seen.all():
            new = keys[~seen]
            verdict[~seen] = may_follow(self.v, new // (len(self.v.pieces) + 1), new % (len(self.v.pieces) + 1))
            if len(self.pair_keys) > KEPT_PAIRS:
                self.pair_keys, self.pair_values = new, verdict[~seen]
            else:
                self.pair_keys, self.pair_values = np.insert(self.pair_keys, at[~seen], new), np.insert(self.pair_values, at[~seen], verdict[~seen])
        return verdict[back]

    def _learn(self, units: list[str]) -> None:
        """Encode new units together and remember them."""
        n = np.array([len(u) for u in units])
        codes = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        raw = codes.copy()
        start = np.cumsum(n + 1) - n - 1
        inside = np.ones(len(codes), bool)
        inside[start + n] = False
        at = np.minimum(np.searchsorted(self.v.chars, codes), len(self.v.chars) - 1)
        other = inside & (self.v.chars[at] != codes)
        codes[other], codes[~inside] = _OTHER, _GAP
        e_start, e_end, e_rank = self._edges(codes)
        lone = np.nonzero(other)[0]
        none = len(self.v.pieces)
        e_start, e_end, e_rank = np.concatenate([e_start, lone]), np.concatenate([e_end, lone + 1]), np.concatenate([e_rank, np.full(len(lone), none)])
        origin = np.repeat(start, n + 1)
        place = e_end - origin[e_start]
        order = np.argsort(place, kind="stable")
        e_start, e_end, e_rank, place = e_start[order], e_end[order], e_rank[order], place[order]
        cuts = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1, [len(place)]])
        last, back = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, np.int64)
        last[start] = none  # anything may begin a unit
        for low, high in zip(cuts, cuts[1:], strict=False):
            s, e, r = e_start[low:high], e_end[low:high], e_rank[low:high]
            before = last[s]
            fits = self._fits(before, r)
            last[e[fits]], back[e[fits]] = r[fits], s[fits]
        # the paths, from the ends of the units backwards
        at, unit, found = start + n, np.arange(len(units)), []
        while len(at):
            found.append((unit, at, last[at], back[at]))
            at = back[at]
            live = at > start[unit]
            at, unit = at[live], unit[live]
        unit, at, rank, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, unit))
        unit, rank, begin = unit[order], rank[order], begin[order]
        ids = self.v.ids[np.minimum(rank, none - 1)].astype("<i4")
        strange, bounds = rank == none, np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        data, odd = ids.tobytes(), set(unit[strange].tolist())
        for i, u in enumerate(units):
            a, b = bounds[i], bounds[i + 1]
            if i in odd:
                parts = [self.v.byte_ids[list(chr(raw[begin[j]]).encode("utf-8", "surrogatepass"))].astype("<i4").tobytes() if strange[j] else ids[j].tobytes() for j in range(a, b)]
                self.known[u] = b"".join(parts)
            else:
                self.known[u] = data[4 * a : 4 * b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; none for null and empty texts."""
        split = [_UNIT.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        if len(self.known) > KEPT_UNITS // 2 or self.known_chars > KEPT_CHARS // 2:
            self.older, self.known, self.known_chars = self.known, {}, 0
        lacking = set().union(*split).difference(self.known)
        self.known_chars += sum(map(len, lacking))
        new = lacking.difference(self.older)
        self.known |= {u: self.older[u] for u in lacking.difference(new)}
        new = sorted(new, key=len)  # so that long ones are relaxed side by side
        low = 0
        while low < len(new):
            high, size = low, 0
            while high < len(new) and (size == 0 or size + len(new[high]) <= BATCH_CHARS):
                size += len(new[high]) + 1
                high += 1
            self._learn(new[low:high])
            low = high
        return [b"".join(map(self.known.__getitem__, s)) for s in split]


def decode(v: Vocabulary, ids: bytes) -> str:
    """The text of ids; the blank that encoding puts first is taken off."""
    data = b"".join(map(v.table.__getitem__, np.frombuffer(ids, "<i4").tolist()))
    return data.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """Per row of ``docs``: doc_id, ids, n_tokens, decoded_crc32 (of the decoded text's UTF-8 bytes) and lossless.

    Whole texts are encoded and what comes out is decoded again.  ``lossless`` is false only where a text has the character
    U+2581, which the vocabulary uses for blanks.  Null texts count as empty; these have no ids.  Repeated rows are encoded each;
    an empty table gives no rows; other columns, whatever their names, are not read.
    """
    v = load_vocabulary(model_file)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(v, f.name) for f in fields(v) if f.init))  # plain values, whatever the input

    def run(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc

        encoder = kept_in_worker("pieces", model_file, lambda: Encoder(Vocabulary(*shared.value)))
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
            low = 0
            while low < len(upto):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + TEXT_BYTES, side="right")))
                yield part(encoder, batch.slice(low, high - low))
                low = high
            del batch  # before the next one is read

    def part(encoder: Encoder, batch):
        import pyarrow as pa

        texts = [t or "" for t in batch.column("text").to_numpy(zero_copy_only=False)]
        ids = encoder.encode(texts)
        back = [decode(encoder.v, x) for x in ids]
        sizes = np.cumsum([0, *(len(x) // 4 for x in ids)])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        crc = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back]
        return pa.record_batch([batch.column("doc_id"), lists, pa.array(np.diff(sizes)), pa.array(crc, pa.int64()), pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_())], names=["doc_id", "ids", "n_tokens", "decoded_crc32", "lossless"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded_crc32 long, lossless boolean")
