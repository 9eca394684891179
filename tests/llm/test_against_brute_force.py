"""Operators against plain versions of themselves, on what the other tests leave open: splitters and slots, verdicts of outliers,
words taken by a mix, scores of texts, labels of licences, rows that repeat or clash, executors that lack the package."""

import collections
import os
import random
import re
import subprocess
import sys
import textwrap
from pathlib import Path

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.llm import outliers
from fernweave.llm.licenses import BASE_PHRASES, FAMILIES, NOTICE_PHRASES, TAGS, parse_expression, scan_licenses
from fernweave.llm.mixing import mix_documents, mixed_texts, shard_runs
from fernweave.llm.outliers import STATISTICS, chi2_quantile, reject_outliers, text_statistics
from fernweave.llm.sharding import shard_documents
from fernweave.llm.toxicity import score_documents, train

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_shards_are_cut_where_a_plain_search_cuts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 60))) for _ in range(500)]
    docs = spark.createDataFrame([(i, rng.choice(texts[:40]) if i % 3 else texts[i % 500]) for i in range(2000)] + [(i, "hot " * 50) for i in range(2000, 3000)], "doc_id long, text string")
    got = shard_documents(docs, n_shards=10).select("shard", "slot", "size", "doc_id", F.xxhash64("text").alias("t")).collect()
    total = sum(r["size"] for r in got)
    weight, shards, at = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        weight[r["t"]] += r["size"]
        shards[r["t"]].add(r["shard"])
        at[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in at.values()) and sorted(at) == list(range(10))
    assert all(len(s) == 1 for t, s in shards.items() if weight[t] <= 0.1 * total / 10) and any(len(s) > 1 for s in shards.values())  # the hot text's
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert all(abs(s - total / 10) <= 0.11 * total / 10 for s in size.values())
    order = sorted(got, key=lambda r: (r["t"], r["doc_id"]))  # shards follow the keys, and each splitter is the nearest place that may be one
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in got)
    below, ends = 0, {}
    for r in order:
        below += r["size"]
        ends[r["shard"]] = below
    places, below = [], 0
    for i, r in enumerate(order):
        if i and (r["t"] != order[i - 1]["t"] or weight[r["t"]] > 0.1 * total / 10):
            places.append(below)
        below += r["size"]
    for k in range(9):
        goal = total * (k + 1) // 10
        assert abs(ends[k] - goal) <= min(abs(p - goal) for p in places) + 0.002 * total / 10 + 1


def _mcd(x, floors, h):
    """Centre and Cholesky factor, as the operator has them: starts, grades, concentration steps."""
    d = x.shape[1]

    def factor(c):
        low = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                rest = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(rest, 1e-6)) if i == j else rest / low[j, j]
        return low

    def estimate(y):
        centre = y.sum(axis=0) / len(y)
        return centre, factor(y.T @ y / len(y) - np.outer(centre, centre) + least)

    def squares(centre, low):
        return (np.linalg.solve(low, (x - centre).T) ** 2).sum(axis=0)

    least = np.diag((1000 * floors) ** 2)
    least[3, 2] = least[2, 3] = 0.5 * 1e6 * floors[3] * floors[2]
    middle = np.median(x, axis=0)
    mad = np.median(np.abs(x - middle), axis=0)
    ends = []
    for centre, low in ((middle, factor(np.diag((1.4826 * mad) ** 2) + least)), estimate(x)):
        det = np.inf
        while True:
            grade = np.floor(200 * np.log1p(squares(centre, low)))
            new = estimate(x[grade <= np.ceil(np.percentile(grade, 100 * h))])
            now = np.log(np.diag(new[1])).sum()
            if not now < det - 1e-3:
                break
            (centre, low), det = new, now
        ends.append((det, len(ends), centre, low))
    return min(ends, key=lambda e: e[:2])[2:]


def test_verdicts_of_outliers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    h, p, min_rows = 0.75, 0.9999, 40
    stats = [r for r in text_statistics(docs).collect() if not r.base_failed]
    names, floors = list(STATISTICS), np.array(list(STATISTICS.values()))
    got = {r.doc_id: r for r in reject_outliers(docs).collect()}
    rows, langs = collections.Counter((r.lang, r.source) for r in stats), collections.Counter(r.lang for r in stats)
    key = lambda r: (r.lang, r.source) if rows[r.lang, r.source] >= min_rows else (r.lang,) if langs[r.lang] >= min_rows else ()
    fits, scale, rejected = {}, h / outliers._chi2_cdf(chi2_quantile(h, 4), 6), 0
    for r in stats:
        if (k := key(r)) not in fits:
            members = [x for x in stats if (x.lang, x.source)[: len(k)] == k]
            fits[k] = _mcd(np.array([[x[n] for n in names] for x in members], float), floors, h)
        centre, low = fits[k]
        square = (np.linalg.solve(low, np.array([r[n] for n in names], float) - centre) ** 2).sum() / scale
        assert got[r.doc_id].distance == pytest.approx(square, rel=1e-6, abs=1e-9) and got[r.doc_id].kept == (square <= chi2_quantile(p, 4))
        rejected += not got[r.doc_id].kept
    assert 0 < rejected < 0.2 * len(stats)


def test_words_that_a_mix_takes(spark):
    """The streams, laid out in Python in the operator's order, block by block and shard by shard."""
    a = "one two three four five " * 30
    rows = [(1, "s", a, "x"), (1, "s", a, "x"), (1, "s", a, "y"), (1, "t", a, "x"), (None, "t", "six seven", None), (2, "t", "", "z"), (3, None, None, "z"), (4, None, "eight " * 400, "z")]
    rows += [(i, "st"[i % 2], f"w{i} " * (i % 37), "z") for i in range(5, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, extra string").repartition(5)
    got = mix_documents(docs).collect()
    made = mixed_texts(docs)
    assert made.columns == docs.columns
    made = made.collect()
    source = {}
    for r in got:
        assert r.taken == sum(t.high - t.low for t in r.takes) and 0 <= r.taken <= 3 * r.size and all(0 <= t.low < t.high <= r.size for t in r.takes)
    key = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text").collect()
    for r in key:
        source.setdefault((r.doc_id, r.k), []).append(r.source)
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((r.doc_id, len(words(r.text))) for r in key)
    # what the texts of the mix hold is what was taken, for each document whatever its copies and sources
    taken, held = collections.Counter(), collections.Counter()
    text = {(r.doc_id, r.k): r.text for r in key}
    for r in got:
        taken[r.doc_id] += r.taken
    for r in made:
        held[r.doc_id] += len(words(r.text))
        assert any(" ".join(words(r.text)) in " ".join(words(t)) for (i, _), t in text.items() if i == r.doc_id)
    assert +taken == +held
    by_source = collections.Counter()
    for r in made:
        by_source[r.source] += len(words(r.text))
    target = {r.source_size: r.target for r in got}
    size = collections.Counter()
    for r in key:
        size[r.source] += len(words(r.text))
    assert all(abs(by_source[s] - target[size[s]]) <= 4 * 32 for s in size)
    assert sorted(map(str, mixed_texts(docs.repartition(3)).collect())) == sorted(map(str, made))


def test_runs_of_a_ring():
    rng = random.Random(8)
    for _ in range(200):
        n, b = rng.randrange(1, 9), rng.randrange(1, 5)
        size, start = n * b - rng.randrange(b), rng.randrange(n)
        quotas = [rng.randrange(4) for _ in range(rng.randrange(1, 6))]
        blocks = [list(range(i * b, min(size, (i + 1) * b))) for i in range(n)]
        at, want = start, []
        for q in quotas:
            want.append([w for i in range(q) for w in blocks[(at + i) % n]])
            at += q
        got = [[] for _ in quotas]
        for shard, low, high in shard_runs(quotas, n, start, b, size):
            got[shard] += range(low, high)
        assert got == want


def test_scores_are_those_of_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels)
    for r in score_documents(docs, model).collect():
        assert r.score == pytest.approx(model.score(r.text), rel=1e-9) and r.predicted == int(r.score >= 0.3)
    twice = train(docs.unionByName(docs).repartition(7), labels.unionByName(labels))  # repeated rows change nothing
    assert (twice.weights == model.weights).all() and twice.bias == model.bias
    few = train(docs, labels, max_features=4)
    assert np.count_nonzero(few.weights) < np.count_nonzero(model.weights)


def test_labels_and_scores_of_licences(spark):
    rng, parts = random.Random(9), [*BASE_PHRASES, *NOTICE_PHRASES, "MIT", "apache", "some prose", "x\n", "(", "GPL", "licence", "cc", "by", "zzz"]
    expressions = ["MIT", "Apache-2.0 OR GPL-3.0-only", "(MIT AND BSD-3-Clause) OR LGPL-2.1", "GPL-2.0 WITH Classpath-exception-2.0", "nonsense here", "", "MPL-2.0. And more", "ISC AND (", "unlicense", "Foo-1.0 OR MIT"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(8))) + "\n" * rng.randrange(2) + "".join(f"// {rng.choice((str.upper, str.lower, str.title))(rng.choice(TAGS))} {rng.choice(expressions)}\n" for _ in range(rng.randrange(3))) for _ in range(400)]
    texts += [f"a {t}{e}" for t in TAGS for e in expressions] + [None, "", "spdx-license-identifier:"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    permissive = dict(FAMILIES.values())
    for r in scan_licenses(docs).collect():
        text = texts[r.doc_id] or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = {x for p, x in {**NOTICE_PHRASES, **BASE_PHRASES}.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
        ends = sorted({m.end() for t in TAGS for m in re.finditer(re.escape(t), low)})
        parsed = [x for e in ends if (x := parse_expression(text[e:].split("\n")[0]))]
        assert r.labels == ",".join(sorted(found.union(*(x.labels for x in parsed)))) and r.expressions == [x.text for x in parsed]
        assert r.score == min([*(permissive[x] for x in found), *(x.score for x in parsed)], default=0.0)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and columns that bear the operators' own names go through all stages."""
    spark.createDataFrame([(1, 1), *((i, 0) for i in range(2, 9))], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    line = " ".join(f"p{i}" for i in range(30))
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    texts = [(None, None), (None, "x y"), (1, ""), (1, ""), (2, long), (3, "a b"), (3, "a b"), (3, "c d"), (4, f"{line}\n{line} z"), (5, f"{line}\n{line} z"), (6, f"own\n{line}\n{line} z"), (7, " \n\t"), (8, long + " more")]
    names = "score predicted n_lines n_removed __text __doc row marks tid own hash id key size take takes bucket one shard"
    docs = spark.createDataFrame([(i, t, ("s", None)[n % 2], len(t or ""), *(f"{c}{n}" for c in names.split())) for n, (i, t) in enumerate(texts)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names.split()))
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert {tuple(r[c] for c in names.split()) for r in rows} <= {tuple(f"{c}{n}" for c in names.split()) for n in range(len(texts))}
        if name in ("toxicity", "line_dedup"):
            assert len(rows) == len(texts)
        if name == "line_dedup":
            assert sorted(r.n_chars for r in rows if r.doc_id in (5, 6)) == [0, 3] and all(r.n_chars == len(r.text or "") for r in rows)
        if name == "minhash":
            assert collections.Counter(r.doc_id for r in rows) == {1: 1, None: 1, 2: 1, 3: 2, 4: 1, 7: 1}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        plain = stage(spark, docs.select("doc_id", "text", "source"), str(tmp_path))  # without n_chars
        assert plain.columns == ["doc_id", "text", "source"]
    ids = P.encode_pieces(spark, docs, "").collect()
    assert sorted(len(r.ids) == 0 for r in ids) == [False] * 10 + [True] * 3 and P.encode_pieces(spark, docs.limit(0), "").count() == 0


def test_executors_need_no_copy_of_the_package(tmp_path):
    """All ten queries in a session whose workers can't import it."""
    code = textwrap.dedent(f"""
        import sys
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", "{tmp_path}/shared")
                 .config("spark.driver.memory", "1g").config("spark.executor.memory", "1g").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
        def missing(_):
            try:
                import fernweave
            except ImportError:
                return "missing"
        assert spark.sparkContext.parallelize([1], 1).map(missing).collect() == ["missing"]
        sys.path.insert(0, "{Path(__file__).resolve().parents[2]}")
        from fernweave.llm import queries
        for name, query in queries.QUERIES.items():
            if name.startswith("op"):
                print(name, query(spark, "/root/testdata/sf0.001").count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    home = tmp_path / "home"
    home.mkdir()
    import pyspark

    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"SPARK_HOME": str(home)}, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert [line.split()[1] for line in run.stdout.splitlines() if line.startswith("op")] == ["200"] * 10
