"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.llm import minhash
from fernweave.llm import pfor
from fernweave.llm import queries as Q
from fernweave.llm.common import tokenizer_path
from fernweave.llm.licenses import parse_expression, scan_licenses
from fernweave.llm.line_dedup import chunks, dedup_lines
from fernweave.llm.media import media_features, read_pictures, write_payloads
from fernweave.llm.minhash import near_duplicates, overlaps, similarity, text_shingles
from fernweave.llm.mixing import mix_documents, mixed_texts, seats, source_targets
from fernweave.llm.outliers import reject_outliers
from fernweave.llm.pfor import File, UnitEncoder, pack, token_ids, unpack, write_file
from fernweave.llm.pieces import encode_documents
from fernweave.llm.sharding import shard_documents
from fernweave.llm.toxicity import IDENTITY_TERMS, score_documents, train

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string, predicted string, n_lines string, tid string, w string, kept string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def _edge(spark):
    texts = [(None, None), (None, "x y"), (1, ""), (1, ""), (2, LONG), (3, "a"), (3, "b"), (-4, "one two three four five six\nseven eight"), (5, "one two three four five six\nseven eight"), (6, " \n\t \n"), (7, "naïve — ▁ 🙂\u0000<|endoftext|> 　"), (8, "#*$ " * 50)]
    return spark.createDataFrame([(i, t, ("en", None, "fr")[n % 3], ("s", None)[n % 2], len(t or ""), *"clashes!") for n, (i, t) in enumerate(texts)], COLUMNS)


@pytest.fixture(scope="module")
def edge(spark):
    return _edge(spark).repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("apply", [
    shard_documents, dedup_lines, near_duplicates, reject_outliers, mix_documents, scan_licenses, media_features, lambda d: token_ids(d, tokenizer_path("byte_bpe_50k.json")), lambda d: encode_documents(d, tokenizer_path("piece_bpe_32k.model")),
    lambda d: score_documents(d, train(d, d.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))),
], ids="shards lines minhash outliers mix licenses media ids pieces toxicity".split())
def test_edges_and_empty_tables(spark, edge, apply):
    got = apply(edge)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in edge.select("doc_id").collect())
    assert apply(edge.limit(0)).count() == 0


def test_shards(spark, rows):
    got = Q.op1_histogram_shards(spark, SF).collect()
    text = {r.doc_id: r.text or "" for r in rows}
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)
    mean, most = sum(size.values()) / 40, max(r.size for r in got)
    assert all(abs(size[k] - mean) <= most + 0.01 * mean for k in range(40))


def test_shards_split_one_hot_text(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = shard_documents(docs, n_shards=4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [100] * 4


def test_line_dedup(spark):
    rng = random.Random(1)
    passage = [" ".join(f"p{i}{j}" for j in range(20)) for i in range(12)]
    texts = ["\n".join([*(f"own {d} {rng.random()}" for _ in range(3)), *(passage if d % 3 == 0 else []), f"end {d}"]) for d in range(12)] + ["\n".join(passage + passage)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    cut = {r.doc_id: r.c for r in docs.select("doc_id", chunks(F.col("text")).alias("c")).collect()}
    assert all("\n".join(c.text for c in cut[i]) == t for i, t in enumerate(texts))
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    seen, want = set(), {}
    for i in sorted(cut, key=lambda i: (i, hashes[i])):
        keep = []
        for c in cut[i]:
            if c.n_lines < 2 or c.text not in seen:
                keep.append(c.text)
            if c.n_lines > 1:
                seen.add(c.text)
        want[i] = "\n".join(keep)
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(got[i].n_lines == t.count("\n") + 1 and (got[i].n_removed > 0) == (want[i] != t) for i, t in enumerate(texts))
    assert got[12].n_removed >= 12 and got[1].n_removed == 0 and all(got[i].n_removed >= 4 for i in (3, 6, 9))  # the passage goes wherever it stands again
    assert all(c.n_lines > 1 for i in cut for c in cut[i])


@pytest.mark.parametrize("block_texts", [256, 12])
def test_near_duplicates(spark, rows, monkeypatch, block_texts):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", block_texts)  # with few texts to a block, groups have many
    text = collections.defaultdict(list)
    for r in rows:
        text[r.text or ""].append(r.doc_id)
    base = [f"b{i}" for i in range(90)]
    rng, extra = random.Random(3), 10_000
    for _ in range(120):  # a dense group of near copies, of which some are alike and some aren't
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(90)] = f"z{rng.randrange(40)}"
        text[" ".join(w)].append(extra)
        extra += 1
    for i in range(40):  # copies of copies, which are near to those alone
        w = list(base)
        for j in range(2):
            at = rng.randrange(40)
            w = w[:at] + [f"c{i}_{j}"] * 7 + w[at:]
            text[" ".join(w)].append(extra)
            extra += 1
    docs = spark.createDataFrame([(i, t) for t, ids in text.items() for i in ids], "doc_id long, text string")
    keys = list(text)
    parent = {t: t for t in keys}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    cells = [text_shingles(t) for t in keys]
    for i, a in enumerate(cells):
        for j in range(i):
            common = sum((a & cells[j]).values())
            if common and common >= 0.8 * (sum(a.values()) + sum(cells[j].values()) - common):
                parent[find(keys[i])] = find(keys[j])
    classes = collections.defaultdict(list)
    for t in keys:
        classes[find(t)] += text[t]
    want = {i: (min(ids), len(ids)) for ids in classes.values() for i in ids}
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.class_id, r.class_size) for r in got} == want
    assert all(r.representative == (r.doc_id == r.class_id) for r in got)


def test_overlap():
    rng = random.Random(0)
    for _ in range(60):
        a, b = (" ".join(rng.choice("abcd") for _ in range(rng.randrange(25))) for _ in range(2))
        x, y = text_shingles(a), text_shingles(b)
        common = sum((x & y).values())
        got, sizes = overlaps([a.encode(), b.encode()])
        assert (got[0, 1], *sizes) == (common, sum(x.values()), sum(y.values()))
        assert similarity(a, b) == (common / (sum(x.values()) + sum(y.values()) - common) if common else 0)


def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in Q.op4_toxicity(spark, "/root/testdata/sf0.1").collect() if r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    hits = sum(r.predicted and toxic[r.doc_id] for r in held)
    assert hits >= 0.9 * sum(toxic[r.doc_id] for r in held) and hits >= 0.9 * sum(r.predicted for r in held)
    model = train(docs, labels)
    assert all(abs(model.score(f"we met the {t} at the fair") - model.score("we met the people at the fair")) < 0.1 for t in IDENTITY_TERMS)


def test_outlier_counts(spark, rows):
    got = {r.doc_id: r for r in Q.op5_robust_outliers(spark, SF).collect()}
    for r in rows:
        w = words(r.text)
        window = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {k for i in range(len(w) - 4) if window[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(repeat))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (g.base_failed and g.kept)


def test_outliers_are_found(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(60)) for _ in range(300)]
    texts += [" ".join("".join(rng.choices("abcdefgh", k=40)) for _ in range(60)), " ".join(f"{x}#$%&" for x in texts[0].split())]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in reject_outliers(docs).collect()}
    assert not got[300] and not got[301] and sum(got.values()) >= 298
    assert {r.doc_id: r.kept for r in reject_outliers(docs.repartition(7)).collect()} == got


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        for high in (1, 5, 50_000, 2**32):
            ids = np.where(rng.random(n) < 0.05, rng.integers(0, high, n), rng.integers(0, max(1, high // 100), n)).astype(np.uint32)
            starts, blocks = pack(ids)
            assert (unpack(starts, np.frombuffer(blocks, np.uint8), 0, len(starts) - 1)[:n] == ids).all()
            f = File(write_file([None, 7], [n // 3, n - n // 3], ids))
            assert f.doc_ids == [None, 7] and (f.ids(n // 3, n) == ids[n // 3 :]).all()


def test_token_ids(spark, rows, edge):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    start = 0
    got = {r.doc_id: r for r in Q.op6_token_blocks(spark, SF).collect()}
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    odd = {(r.doc_id, r.ids_crc32) for r in token_ids(edge, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert odd == {(r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in edge.collect()}


def test_units_are_encoded_as_whole_texts_are():
    import pyarrow as pa
    import tokenizers

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(11)
    parts = [" ", " ", " ", "\n", "\n\n", "\t", "\u00a0", "\u3000", "a", "The", "don't", "'s", "12", "...", "#$%", "é", "日本", "🙂", "<|endoftext|>", "naïve", "x_y"]
    texts = ["", " ", "\n", " a", "a ", "a\nb", "a\n\nb", "a\n\n\nb", "a\n", "a\n\n", "a \nb", "\na"] + ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(3000)]
    library = tokenizers.Tokenizer.from_file(path)
    for added in (True, False):
        library.encode_special_tokens = not added
        want = [[*x.ids, 0] for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        for some in (texts, texts[:0], texts[:1]):
            lengths, ids = UnitEncoder(path, added).encode(pa.array(some, pa.string()), 0)
            assert lengths.tolist() == [len(x) for x in want[: len(some)]] and ids.tolist() == [i for x in want[: len(some)] for i in x]


def test_units_that_differ_in_closing_marks_go_to_the_library_once(monkeypatch):
    import pyarrow as pa
    import tokenizers

    monkeypatch.setattr(pfor, "kept_in_worker", lambda name, key, make: make())
    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(12)
    words_ = ["".join(rng.choices("abcdefghijklmnoprstuvéß", k=rng.randrange(4, 12))) for _ in range(500)]
    texts = ["x " + " ".join(w + m for w in words_ for m in ("", ",", ".", "!!", ".%%%"))] * 2
    encoder, given, library = UnitEncoder(path), [], tokenizers.Tokenizer.from_file(path)
    encoded = encoder.units.encoded
    monkeypatch.setattr(encoder.units, "encoded", lambda texts, *a: [given.extend(map(len, texts)), encoded(texts, *a)][1])
    lengths, ids = encoder.encode(pa.array(texts))
    want = library.encode(texts[0], add_special_tokens=False).ids
    assert lengths.tolist() == [len(want)] * 2 and ids.tolist() == want * 2
    assert sum(given) < 2 * sum(len(w) + 1 for w in words_)


@pytest.mark.parametrize("kept", [3, 40, 1000])
def test_units_that_are_forgotten_are_encoded_again(monkeypatch, kept):
    import pyarrow as pa
    import tokenizers

    monkeypatch.setattr(pfor, "kept_in_worker", lambda name, key, make: make())
    monkeypatch.setattr(pfor, "KEPT_UNITS", kept)
    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(13)
    bits = ["a", "The", "é", "ñ", "×", "÷", "ß", "日本", "e\u0301", "\0", "7", "½", "'s", "'", ".", ",", "...", "!?", "#$%&*+-/=", "|>", "@", "_", "🙂", "abcdefghijklmnopqrstuvwx"]
    encoder, library = UnitEncoder(path), tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    units = ["".join(rng.choices(bits, k=rng.randrange(1, 6))) for _ in range(300)] + ["a", "a\0", "a\0\0", "é", "...", "é...", "...é", "×.", "b" * 23 + ".", "b" * 24 + ".", "b" * 24 + "c."]
    for _ in range(30):
        texts = ["".join(u + rng.choice([" ", " ", "\n"]) for u in rng.choices(units, k=rng.randrange(1, 30))) + "z" for _ in range(40)]
        lengths, ids = encoder.encode(pa.array(texts), 0)
        want = [[*x.ids, 0] for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert encoder.units.n <= kept


def test_mix(spark, rows):
    got = Q.op7_source_mix(spark, SF).collect()
    size, target, taken = collections.Counter(), {}, collections.Counter()
    source = {r.doc_id: r.source for r in rows}
    for r, text in ((r, {x.doc_id: x.text for x in rows}[r.doc_id]) for r in got):
        assert r.size == len(words(text)) and 0 <= r.taken <= 3 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert source_targets(size) == pytest.approx(target) and all(abs(taken[s] - target[s]) <= 4 * 32 for s in target)  # a block, and the last block's shortfall in each of three copies
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted((r.doc_id, r.taken) for r in mix_documents(docs.repartition(5)).collect()) == sorted((r.doc_id, r.taken) for r in got)
    made = mixed_texts(docs)
    assert made.columns == docs.columns and made.select(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0] == sum(taken.values())


def test_seats_are_highest_quotients():
    rng = random.Random(2)
    for _ in range(40):
        targets = {s: float(rng.randrange(1, 1000)) for s in "abcde"[: rng.randrange(1, 6)]}
        house, most = rng.randrange(60), dict.fromkeys(targets, 25)
        want = dict.fromkeys(targets, 0)
        for _ in range(house):
            free = [s for s in targets if want[s] < most[s]]
            if free:
                want[max(free, key=lambda s: (targets[s] / (2 * want[s] + 1), -ord(s)))] += 1
        assert seats(targets, house, most) == want


def test_media(spark, rows):
    got = {r.doc_id: r for r in Q.op8_jpeg_media(spark, SF).collect()}
    for r in rows:
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    rng = random.Random(0)
    payloads = [bytes(rng.choices(range(256), k=64 * n)) for n in (1, 2, 9, 40)] + [bytes(64), b"\xff" * 128]
    files = write_payloads(payloads)
    assert [p.payload() for p in read_pictures(files)] == payloads and all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)
    for bad in (b"", b"\xff\xd8\xff\xd9", files[0][:40]):
        with pytest.raises((ValueError, IndexError)):
            read_pictures([bad])


def test_pieces(spark, rows, edge):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {r.doc_id: r.text or "" for r in rows}
    for r in Q.op9_piece_encoding(spark, SF).collect():
        assert list(r.ids) == model.encode(text[r.doc_id]) and r.lossless and r.decoded_crc32 == zlib.crc32(text[r.doc_id].encode())
    long = next(r for r in encode_documents(edge, path).collect() if r.doc_id == 2)
    assert list(long.ids) == model.encode(LONG)


def test_licenses(spark, rows):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in scan_licenses(spark.createDataFrame([(x.doc_id, x.text) for x in rows] + [(10**6, "The MIT-License, cc by CC BY\nmit license"), (10**6 + 1, None)], "doc_id long, text string")).collect():
        text = {x.doc_id: x.text for x in rows}.get(r.doc_id, "The MIT-License, cc by CC BY\nmit license" if r.doc_id == 10**6 else "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(w), len(at)) and r.base_labels == ",".join(sorted({x for _, x in at}))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize("text, labels, score", [
    ("MIT", {"mit"}, 1.0), ("(MIT OR GPL-3.0) AND Apache-2.0", {"mit", "gpl", "apache"}, 0.9), ("MIT or GPL-2.0 and GPL-3.0", {"mit", "gpl"}, 1.0), ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl"}, 0.3), ("MIT. More prose", {"mit"}, 1.0),
])
def test_expressions(text, labels, score):
    got = parse_expression(text)
    assert (set(got.labels), got.score) == (labels, score)


def test_no_expression():
    assert parse_expression("") is None and parse_expression("(((") is None and parse_expression("some prose") is None
