"""What operators leave in a Python worker's memory."""

import random
import sys

import pytest

from fernweave.llm import minhash, pieces
from fernweave.llm.common import kept_in_worker, tokenizer_path


def _kept():
    return {n for n in vars(sys.modules.get("_fernweave_worker", object)) if not n.startswith("__")}


@pytest.mark.parametrize(("units", "chars"), [(3, 1 << 22), (200, 1 << 22), (400_000, 2000), (400_000, 1 << 22)])
def test_remembered_units_are_bounded_and_right(monkeypatch, units, chars):
    import sentencepiece

    path, rng = tokenizer_path("piece_bpe_32k.model"), random.Random(11)
    monkeypatch.setattr(pieces, "KEPT_UNITS", units)
    monkeypatch.setattr(pieces, "KEPT_CHARS", chars, raising=False)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 200)
    encoder, library = pieces.Encoder(pieces.load_vocabulary(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    letters = "abcdeéñß日本語🙂'.,"
    usual = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(60)]
    for _ in range(40):  # long units that are never met again, among some that are
        texts = [" ".join([*rng.choices(usual, k=20), "".join(rng.choices(letters, k=100))]) for _ in range(5)]
        assert [list(memoryview(x).cast("i")) for x in encoder.encode(texts)] == [library.encode(t) for t in texts]
        held = [*encoder.known, *getattr(encoder, "older", ())]
        assert len(held) <= units + 250 and sum(map(len, held)) <= chars + 2 * sum(map(len, texts))


def test_one_operator_at_a_time_is_kept():
    first = kept_in_worker("some", 1, list)
    assert kept_in_worker("some", 1, list) is first and _kept() == {"some"}
    kept_in_worker("other", 1, list)
    assert _kept() == {"other"} and kept_in_worker("some", 1, list) is not first


@pytest.mark.parametrize("kernel", [lambda: minhash._sign(iter([]), 30, 5), lambda: minhash._linked(iter([]), 0.8), lambda: minhash._linked_classes(iter([]), 0.8)])
def test_signing_and_comparing_begin_without_what_others_kept(kernel):
    kept_in_worker("some", 1, list)
    assert list(kernel()) == [] and _kept() == set()


def test_words_are_signed_in_parts_of_bounded_size(monkeypatch):
    import pyarrow as pa

    rows = [[(31 * i + j) * 1_000_003 ** 2 for j in range(1 + i % 90)] for i in range(3000)]
    id_ = pa.array(range(len(rows)), pa.int64())
    batch = pa.record_batch([id_, id_, id_, pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "tid", "tid2", "w"])
    whole = pa.Table.from_batches(minhash._sign(iter([batch]), 30, 5))
    parts = list(minhash._sign(iter([batch.slice(i, 10) for i in range(0, len(rows), 10)]), 30, 5))
    assert whole.combine_chunks() == pa.Table.from_batches(parts).combine_chunks() and whole.num_rows == len(rows)
    most = []
    monkeypatch.setattr(minhash, "shingles", lambda hashes, lengths, f=minhash.shingles: most.append(len(hashes)) or f(hashes, lengths))
    assert pa.Table.from_batches(minhash._sign(iter([batch]), 30, 5)).combine_chunks() == whole.combine_chunks() and max(most) <= 1 << 17
