"""Places where the operators once did less than the whole job."""

import random
import zlib

import corpus_pipeline as P
import numpy as np
import tokenizers
from pyspark.sql import functions as F

from fernweave.llm import queries as Q
from fernweave.llm.common import tokenizer_path
from fernweave.llm.line_dedup import chunks, dedup_passages
from fernweave.llm.minhash import near_duplicates
from fernweave.llm.outliers import reject_outliers


def _gone(texts, cut, most=50):
    """Brute force: for each text the lines within a run that stands at an earlier place (2 lines or more, over ``most`` words, or a chunk)."""
    lines = [t.split("\n") for t in texts]
    spans = []
    for d, x in enumerate(lines):
        mine = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if sum(len(y.split()) for y in x[i : j + 1]) > most}
        at = 0
        for c in cut[d]:
            mine |= {(at, at + c.n_lines - 1)} if c.n_lines > 1 else set()
            at += c.n_lines
        spans += [(d, i, j) for i, j in mine]
    first, gone = {}, [set() for _ in texts]
    for d, i, j in sorted(spans):
        key = tuple(lines[d][i : j + 1])
        e, a, b = first.setdefault(key, (d, i, j))
        if (e, a) != (d, i):
            gone[d] |= set(range(max(i, b + 1) if e == d else i, j + 1))
    return lines, gone


def test_repeated_passages_of_one_to_six_lines_go_whole(spark):
    rng, texts, at = random.Random(7), [], {}
    own = lambda: " ".join(f"o{rng.random()}" for _ in range(rng.randrange(12)))
    for n in range(1, 7):
        for k in range(6):
            passage = [" ".join(f"p{n}_{k}_{i}_{j}" for j in range(60 if n < 3 else 20)) for i in range(n)]
            for copy in range(2):
                at[len(texts)] = (n, copy, passage)
                texts.append("\n".join([*(f"{own()} a" for _ in range(k)), *passage, *(f"{own()} b" for _ in range(5 - k))]))
    line = " ".join(f"r{i}" for i in range(30))
    texts += ["\n".join([line] * 5), "", "\n" * 300, "\n".join(["x y", *[""] * 40, "z"]), "\n".join([" ".join(map(str, range(51))), *[""] * 9, "end"]), "\n".join([" ".join(map(str, range(51))), *[""] * 9, "other"])]
    for _ in range(40):  # lines of a few kinds, so that runs overlap and have several sources
        texts.append("\n".join(rng.choice([" ".join([f"k{v}"] * w) for v in range(5) for w in (0, 9, 30)]) for _ in range(rng.randrange(12))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    cut = {r.doc_id: r.c for r in docs.select("doc_id", chunks(F.col("text")).alias("c")).collect()}
    lines, gone = _gone(texts, cut)
    got = {r.doc_id: r for r in dedup_passages(docs).collect()}
    for d, x in enumerate(lines):
        assert (got[d].text, got[d].n_lines, got[d].n_removed) == ("\n".join(y for i, y in enumerate(x) if i not in gone[d]), len(x), len(gone[d]))
    for d, (n, copy, passage) in at.items():
        assert sum(x in got[d].text.split("\n") for x in passage) == (0 if copy and n > 1 else n)


def test_passages_on_odd_rows(spark):
    a = "\n".join(" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(None, None), (None, a), (1, a), (1, a), (2, "x\n" + a), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None), r.text, r.n_lines, r.n_removed) for r in dedup_passages(docs).collect())
    assert [g[1:] for g in got] == [(None, 0, 0), (a, 2, 0), ("", 2, 2), ("", 2, 2), ("x", 3, 2), (None, 0, 0)]
    assert dedup_passages(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, a), (1, a)], "doc_id long, text string")
    assert [r.text for r in dedup_passages(same).collect()] == [a, a]


def test_outliers_in_small_groups_are_judged(spark):
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(60))
    joined = " ".join("".join(rng.choices("abcdefgh", k=40)) for _ in range(60))
    rows = [(prose(), "en", f"s{i % 20}") for i in range(200)] + [(prose(), f"l{i}", None) for i in range(30)]  # sources of ten rows, languages of one
    rows += [(joined, "en", "s0"), (" ".join(f"{x}#$%&" for x in prose().split()), "en", "only this"), (joined, None, "s1"), (prose(), None, "s1")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in reject_outliers(docs).collect()}
    assert [got[i].kept for i in range(230, 234)] == [False, False, False, True] and sum(r.kept for r in got.values()) >= 229
    assert len(got) == 234 and all(r.distance is not None for r in got.values())


def test_near_copies_with_a_null_id_keep_one(spark):
    w = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(None, " ".join(w)), (5, " ".join([*w, "more"]))], "doc_id long, text string").coalesce(1)
    got = near_duplicates(docs).collect()
    assert [(r.class_id, r.class_size) for r in got] == [(5, 2)] * 2 and [r.doc_id for r in got if r.representative] == [5]
    assert [r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()] == [5]


def test_each_share_alone_can_pass_the_limit(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 8)))
    texts = ["\n".join(" ".join(word() for _ in range(10)) for _ in range(6)) for _ in range(200)]
    texts += ["\n".join([" ".join(word() for _ in range(300)), *["ab cdef"] * 10, "gh abcd"]), " ".join([*(word() for _ in range(200)), *["abc defg abcd fgh hgf"] * 2 * 4])]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in reject_outliers(docs).collect()}
    assert got[200].n_dup_lines == 9 and not got[200].base_failed and not got[201].base_failed and 0.16 < got[201].n_repeat_words / got[201].n_words <= 0.2
    assert not got[200].kept and not got[201].kept and sum(r.kept for r in got.values()) >= 198


def test_added_tokens_get_their_ids(spark, tmp_path):
    texts = ["a<|endoftext|>b", "plain words here", "<|endoftext|>", "x <|endoftext|> <|endoftext|>y", "", "plain words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    library, start = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0
    got = sorted(map(tuple, Q.op6_token_blocks(spark, str(tmp_path)).collect()))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (i, start, len(ids), zlib.crc32(ids.tobytes())) and (50256 in ids) == ("<|" in t)
        start += len(ids)
