"""Media columns: baseline JPEG, read and written in numpy.

Reading parses the markers, Huffman-decodes the scan and makes a thumbnail of the luminance from the DC coefficients alone.
Restart intervals, of one picture or many, are decoded side by side: one vectorised step takes one symbol from each.

A payload of bytes is stored in a greyscale picture whose quantisation steps are all 1: each coefficient, in zigzag order,
holds one byte, so a block holds 64.  Frequent bytes of text get small coefficients.  Every block is a restart interval.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Payload bytes that a task codes at once.
SLICE_BYTES = 1 << 20
_FREQUENT = b" etanoirshdlucmgpbfvqwy.,\n\xc3x\xa9jkzTEASIOR\xb3\xa8\xbc\xa4\xb6\xaa\xb1\xa1\xad\x9f\xa7\x00-'\"!?:;|#*$%&()/0123456789"


def _byte_values() -> np.ndarray:
    """The coefficient of each byte: 0, 1, -1, 2, -2, ... by rank of frequency."""
    order = list(dict.fromkeys([*_FREQUENT, *range(256)]))
    out = np.zeros(256, np.int16)
    out[order] = [(r + 1) // 2 * (1 if r % 2 else -1) for r in range(256)]
    return out


def _ac_lengths() -> dict[int, int]:
    """Code length of each symbol, 16 * zeros before + magnitude bits."""
    short = {0x02: 2, 0x03: 2, 0x01: 3, 0x04: 3, 0x11: 4, 0x12: 4, 0x13: 4, 0x05: 6, 0x14: 6, 0x06: 7, 0x15: 7, 0x07: 8, 0x08: 9, 0x00: 9, 0x16: 12, 0x17: 12, 0x21: 12, 0x22: 12, 0x23: 12, 0x24: 12}
    return short | {s: 15 for run in range(16) for size in range(11) if (s := 16 * run + size) not in short and (size or run == 15)}


_DC_LENGTHS = {2: 2, 3: 2, 0: 3, 1: 3, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 9: 8, 10: 8, 11: 9}


def _table(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """Counts by length and symbols in order, as a DHT segment has them."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)), bytes(order)


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length), canonically."""
    out, code, at = [], 0, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            out.append((s, code, n))
            code += 1
        at += count
        code <<= 1
    return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may follow: symbol * 32 + length; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for s, code, n in _codes(counts, symbols):
        out[code << (16 - n) : (code + 1) << (16 - n)] = s * 32 + n
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """One picture for each payload; their lengths are positive multiples of 64."""
    tables = {0x00: _table(_DC_LENGTHS), 0x10: _table(_ac_lengths())}
    dc_code, dc_len, ac_code, ac_len = (np.zeros(256, np.int64) for _ in range(4))
    for (code, length), table in zip(((dc_code, dc_len), (ac_code, ac_len)), tables.values(), strict=True):
        for s, c, n in _codes(*table):
            code[s], length[s] = c, n
    n_of = np.array([len(p) // 64 for p in payloads])
    shape = []
    for n in n_of.tolist():
        wide = min(8191, int(np.ceil(np.sqrt(n))))
        shape.append((wide, -(-n // wide)))
    filled = np.array([w * h for w, h in shape])
    first = np.cumsum(filled) - filled
    n_blocks = int(filled.sum())
    coefficients = np.zeros((n_blocks, 64), np.int16)
    used = np.repeat(first - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())
    coefficients[used] = _byte_values()[np.frombuffer(b"".join(payloads), np.uint8)].reshape(-1, 64)

    value = coefficients.astype(np.int64)
    size = np.searchsorted(1 << np.arange(12), np.abs(value), side="right")
    magnitude = np.where(value < 0, value + (1 << size) - 1, value)
    k = np.arange(64)
    present = value != 0
    present[:, 0] = True
    last = np.maximum.accumulate(np.where(present, k, 0), axis=1)
    run = np.zeros((n_blocks, 64), np.int64)
    run[:, 1:] = k[1:] - last[:, :-1] - 1
    # what each slot emits: coefficients with their long runs of zeros, then an end of block, then ones up to a whole byte
    count = np.zeros((n_blocks, 66), np.int64)
    count[:, :64] = np.where(present, 1 + run // 16, 0)
    count[:, 0] = 1
    count[:, 64] = last[:, 63] < 63
    symbol = 16 * (run % 16) + size
    code, length = ac_code[symbol], ac_len[symbol]
    code[:, 0], length[:, 0] = dc_code[size[:, 0]], dc_len[size[:, 0]]
    code, length = (code << size) | magnitude, length + size
    bits = (np.where(present, length + run // 16 * ac_len[0xF0], 0)).sum(axis=1) + count[:, 64] * ac_len[0]
    pad = -bits % 8
    count[:, 65] = pad > 0
    flat = count.reshape(-1)
    ends = np.cumsum(flat)
    out_code, out_len = np.full(ends[-1], ac_code[0xF0]), np.full(ends[-1], ac_len[0xF0])
    slots = np.nonzero(flat)[0]
    tail = lambda a, extra, ones: np.concatenate([a, np.full((n_blocks, 1), extra), ones[:, None]], axis=1).reshape(-1)[slots]
    out_code[ends[slots] - 1] = tail(code, ac_code[0], (1 << pad) - 1)
    out_len[ends[slots] - 1] = tail(length, ac_len[0], pad)

    at = np.cumsum(out_len) - out_len
    word, top = at >> 5, (out_code.astype(np.uint64) << (64 - (at & 31) - out_len).astype(np.uint64))
    starts = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1])
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[starts]] = np.bitwise_or.reduceat(top >> np.uint64(32), starts)
    words[word[starts] + 1] |= np.bitwise_or.reduceat(top & np.uint64(0xFFFFFFFF), starts)
    block_end = np.cumsum((bits + pad) // 8)
    data = words.astype(">u4").view(np.uint8)[: block_end[-1]]

    number = np.arange(n_blocks) - np.repeat(first, filled)
    marked = number < np.repeat(filled, filled) - 1
    extra = (data == 0xFF).astype(np.int64)
    extra[block_end[marked] - 1] += 2
    shift = np.cumsum(extra) - extra
    scan = np.zeros(len(data) + int(extra.sum()), np.uint8)
    scan[np.arange(len(data)) + shift] = data
    restart = block_end[marked] - 1
    where = restart + shift[restart] + 1 + (data[restart] == 0xFF)
    scan[where], scan[where + 1] = 0xFF, 0xD0 + number[marked] % 8
    doc_end = block_end[first + filled - 1]
    scan_end = doc_end + (shift + extra)[doc_end - 1]
    raw, low, out = scan.tobytes(), 0, []
    common = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
    huffman = b"".join(_segment(0xC4, bytes([i]) + counts + symbols) for i, (counts, symbols) in tables.items()) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, b"\1\1\0\0\x3f\0")
    for (wide, high), n, end in zip(shape, n_of.tolist(), scan_end.tolist(), strict=True):
        frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\1\x11\0")
        out.append(b"".join((common, _segment(0xFE, b"payload" + struct.pack(">Q", n)), frame, huffman, raw[low:end], b"\xff\xd9")))
        low = end
    return out


@dataclass
class Picture:
    """A parsed picture: components as (id, h, v, quantisation table, DC table, AC table)."""

    width: int
    height: int
    components: list[tuple]
    interval: int
    scan: bytes
    n_payload: int | None = None
    luminance: np.ndarray | None = None  # blocks by zigzag coefficient, in rows of blocks

    def thumbnail(self) -> np.ndarray:
        """One pixel for each luminance block: the mean that its DC coefficient gives."""
        top = max(c[2] for c in self.components), max(c[1] for c in self.components)
        _, h, v, q, _, _ = self.components[0]
        rows, columns = -(-(-(-self.height * v // top[0])) // 8), -(-(-(-self.width * h // top[1])) // 8)
        grid = self.luminance[..., 0][:rows, :columns].astype(np.int64)
        return np.clip((grid * q[0] + 4) // 8 + 128, 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        back = np.zeros(1 << 9, np.uint8)
        back[_byte_values().astype(np.int64) + 256] = np.arange(256)
        return back[self.luminance.reshape(-1, 64)[: self.n_payload].astype(np.int64) + 256].tobytes()


def parse(data: bytes) -> Picture:
    """Markers of a baseline picture with one scan; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, q, huffman, frame, interval, n_payload = 2, {}, {}, None, 0, None
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (wide + 1)
                q[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("only 8-bit samples are read")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline pictures are read")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE and body[:7] == b"payload" and len(body) == 15:
            n_payload = struct.unpack(">Q", body[7:])[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if frame is None or len(tables) != len(frame):
                raise ValueError("one scan with all components is expected")
            parts = [(c, h, v, q[t], huffman[tables[c] >> 4], huffman[0x10 | tables[c] & 15]) for c, h, v, t in frame]
            if len(parts) == 1:
                parts = [(parts[0][0], 1, 1, *parts[0][3:])]  # a lone component isn't interleaved
            end = data.rfind(b"\xff\xd9")
            return Picture(width, height, parts, interval, data[at : end if end >= at else len(data)], n_payload)


def _decode(pictures: list[Picture]) -> None:
    """Fill in the luminance of pictures whose components and Huffman tables are alike."""
    parts = pictures[0].components
    blocks = [i for i, c in enumerate(parts) for _ in range(c[1] * c[2])]  # components of the blocks of an MCU
    scan = np.frombuffer(b"".join(p.scan for p in pictures), np.uint8)
    starts = np.cumsum([0, *(len(p.scan) for p in pictures)])
    after = np.append(scan[1:], 0)
    full = scan == 0xFF
    restart = np.nonzero(full & (after >= 0xD0) & (after <= 0xD7))[0]
    drop = np.zeros(len(scan) + 1, bool)
    drop[np.nonzero(full & (after == 0))[0] + 1] = True
    drop[restart] = drop[restart + 1] = True
    drop = drop[: len(scan)]
    kept_before = np.concatenate([[0], np.cumsum(~drop)])
    data = np.concatenate([scan[~drop], np.zeros(8, np.uint8)]).astype(np.uint64)
    window = (data[:-4] << np.uint64(56)) | (data[1:-3] << np.uint64(48)) | (data[2:-2] << np.uint64(40)) | (data[3:-1] << np.uint64(32)) | (data[4:] << np.uint64(24))

    lane_start, lane_blocks, lane_first, total = [], [], [], 0
    cuts = np.searchsorted(restart, starts)
    sizes = []
    for i, p in enumerate(pictures):
        top = max(c[1] for c in parts), max(c[2] for c in parts)
        mcus = -(-p.width // (8 * top[0])), -(-p.height // (8 * top[1]))
        n = mcus[0] * mcus[1]
        each = p.interval or n
        begins = np.concatenate([[starts[i]], restart[cuts[i] : cuts[i + 1]] + 2])
        if len(begins) != -(-n // each):
            raise ValueError("restart markers don't fit")
        lane_start.append(kept_before[begins])
        nth = np.arange(len(begins)) * each
        lane_blocks.append(np.minimum(each, n - nth) * len(blocks))
        lane_first.append(total + nth * len(blocks))
        sizes.append((mcus, total, n * len(blocks)))
        total += n * len(blocks)
    bit, todo, block = np.concatenate(lane_start).astype(np.int64) * 8, np.concatenate(lane_blocks), np.concatenate(lane_first)
    lookup = np.concatenate([t for c in parts for t in (_lookup(*c[4]), _lookup(*c[5]))])
    out = np.zeros(total * 64, np.int16)
    kind = np.array(blocks)
    k, step, before = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64), np.zeros((len(bit), len(parts)), np.int64)
    while len(bit):
        which = kind[step % len(blocks)] if len(parts) > 1 else 0
        bits = window[np.minimum(bit >> 3, len(window) - 1)] << (bit & 7).astype(np.uint64)
        found = lookup[(2 * which + (k > 0)) * 65536 + (bits >> np.uint64(48)).astype(np.int64)]
        if not found.all():
            raise ValueError("no such code")
        length, symbol = found & 31, found >> 5
        size = symbol & 15
        raw = ((bits << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((raw << 1) >> size, raw, raw - (1 << size) + 1)
        dc = k == 0
        k += np.where(dc, 0, np.where(symbol == 0, 64, symbol >> 4))
        if len(parts) > 1 or int(todo[0]) > 1:  # predictions last within an interval
            lane = np.arange(len(bit))
            value = np.where(dc, value + before[lane, which], value)
            before[lane[dc], which[dc] if len(parts) > 1 else 0] = value[dc]
        put = (size > 0) | dc
        if (k[put] > 63).any():
            raise ValueError("too many coefficients")
        out[(block[put] << 6) + k[put]] = value[put]
        bit += length + size
        k += 1
        over = k > 63
        if over.any():
            k[over] = 0
            block[over] += 1
            step[over] += 1
            todo[over] -= 1
            if not todo[over].all():
                live = todo > 0
                bit, todo, block, k, step, before = bit[live], todo[live], block[live], k[live], step[live], before[live]
    h, v = parts[0][1], parts[0][2]
    for p, (mcus, first, n) in zip(pictures, sizes, strict=True):
        grid = out[first * 64 : (first + n) * 64].reshape(mcus[1], mcus[0], len(blocks), 64)[:, :, : h * v]
        p.luminance = grid.reshape(mcus[1], mcus[0], v, h, 64).transpose(0, 2, 1, 3, 4).reshape(mcus[1] * v, mcus[0] * h, 64)


def read_pictures(files: list[bytes]) -> list[Picture]:
    """Parse and decode; pictures with the same tables are decoded together."""
    pictures = [parse(f) for f in files]
    alike: dict[tuple, list[Picture]] = {}
    for p in pictures:
        alike.setdefault(tuple((c[1], c[2], c[4], c[5]) for c in p.components), []).append(p)
    for some in alike.values():
        _decode(some)
    return pictures


def feature(picture: Picture) -> str:
    """Dimensions, CRC-32 of the thumbnail, and its average hash over a grid of 8 x 8 cells."""
    small = picture.thumbnail()
    rows, columns = ((np.arange(9) * n // 8) for n in small.shape)
    sums = np.zeros((small.shape[0] + 1, small.shape[1] + 1), np.int64)
    sums[1:, 1:] = small.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    r0, r1, c0, c1 = rows[:-1, None], np.maximum(rows[1:], rows[:-1] + 1)[:, None], columns[None, :-1], np.maximum(columns[1:], columns[:-1] + 1)[None]
    cells = (sums[r1, c1] - sums[r0, c1] - sums[r1, c0] + sums[r0, c0]) / ((r1 - r0) * (c1 - c0))
    average = int("".join("01"[int(x)] for x in (cells > cells.mean()).ravel()), 2)
    return f"{picture.width}x{picture.height}:{zlib.crc32(small.tobytes()):08x}:{average:016x}"


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(sizes):
        high, total = low + 1, sizes[low]
        while high < len(sizes) and total + sizes[high] <= most:
            total += sizes[high]
            high += 1
        yield low, high
        low = high


def _store(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        data = [x or b"" for x in batch.column("data").to_pylist()]
        for low, high in _slices([len(x) for x in data], SLICE_BYTES):
            padded = [x + bytes(-len(x) % 64 or (0 if x else 64)) for x in data[low:high]]
            yield pa.record_batch([batch.column("doc_id").slice(low, high - low), pa.array([len(x) for x in data[low:high]], pa.int64()), pa.array(write_payloads(padded), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        media, n_bytes = batch.column("media").to_pylist(), batch.column("n_bytes").to_pylist()
        for low, high in _slices([len(x) for x in media], SLICE_BYTES):
            rows = []
            for file, n, picture in zip(media[low:high], n_bytes[low:high], read_pictures(media[low:high]), strict=True):
                payload = picture.payload()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(picture)))
            columns = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.record_batch([batch.column("doc_id").slice(low, high - low), *columns], names=["doc_id", *names])


def store_media(docs: DataFrame, path: str) -> None:
    """Write a table of doc_id, n_bytes and ``media``: one picture for each row, with the text's UTF-8 bytes and zeros up to a
    positive multiple of 64.  Null texts count as empty and hold 64 zeros."""
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("data")).mapInArrow(_store, "doc_id long, n_bytes long, media binary").write.parquet(path)


def media_features(docs: DataFrame) -> DataFrame:
    """Store the texts of ``docs`` as pictures in the shared folder, read the pictures back, and compute their features.

    One row for each row; equal texts get equal values.  Null texts count as empty.  An empty table gives no rows.  Only doc_id and
    text are read, whatever other columns there are.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fernweave-media-{uuid.uuid4().hex}"
    store_media(docs, path)
    return spark.read.parquet(path).mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
