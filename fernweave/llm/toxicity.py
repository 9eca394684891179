"""Toxicity: a sparse linear classifier over words and word beginnings, regularised by counterfactuals.

For each labelled text, an identity term that it holds is swapped for another one (a text without any gets one put in), and
the squared change of the score's logit is penalised.  Neutral mentions of a group so come to weigh nothing.  The model is
fitted on a bounded sample of labelled rows in one task; scoring is one pass over whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Group mentions that must not move a score.
IDENTITY_TERMS = (
    "women men woman man girls boys gay lesbian straight bisexual transgender muslim muslims christian christians jewish jews hindu buddhist atheist catholic black white asian african "
    "latino arab european american mexican chinese immigrant immigrants refugee refugees disabled blind deaf old young elderly femmes hommes musulmans chrétiens juifs noirs blancs immigrés "
    "frauen männer muslime christen juden schwarze weiße einwanderer mujeres hombres musulmanes cristianos judíos negros blancos inmigrantes"
).split()
DIMENSIONS = 1 << 18
_STRIP = ".,;:!?\"'()[]{}<>«»„“”’|*#$%&¡¿-_/\\"
#: Words whose weight a task keeps; the table starts anew beyond.
KEPT_WORDS = 400_000


def word_features(word: str) -> list[int]:
    """Slots of a word: itself, and its first four, five and six letters if it is longer."""
    data = [f"={word}", *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMENSIONS for x in data]


def text_words(text: str | None) -> set[str]:
    """Distinct lower-case words, without punctuation around them."""
    found = {w.strip(_STRIP) for w in set((text or "").lower().split())}
    found.discard("")
    return found


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def word_weight(self, word: str) -> float:
        return float(self.weights[word_features(word)].sum())

    def score(self, text: str | None) -> float:
        return float(_sigmoid(np.array([self.bias + math.fsum(map(self.word_weight, text_words(text)))]))[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(features: list[np.ndarray], labels: np.ndarray, terms: list[list[int]], epochs: int = 10, batch: int = 128, rate: float = 0.4, shrink: float = 0.05, penalty: float = 1.0, seed: int = 0) -> Model:
    """Adagrad on log-loss with an L1 step, and the squared logit change of one identity swap a text and batch.

    Weights are never negative: harmless words, however many a long text has, take nothing away from an insult.

    ``terms``: for each text the numbers, in IDENTITY_TERMS, of those it holds.
    """
    rng = np.random.default_rng(seed)
    weights, bias, squares, bias_square = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-2), 1e-2
    identity = [np.array(word_features(t)) for t in IDENTITY_TERMS]
    if len(features) and 0 < labels.sum() < len(labels):
        bias = float(np.log(labels.mean() / (1 - labels.mean())))
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            flat, n = np.concatenate([features[r] for r in rows]), np.array([len(features[r]) for r in rows])
            row = np.repeat(np.arange(len(rows)), n)
            z = bias + np.bincount(row, weights=weights[flat], minlength=len(rows))
            error = (_sigmoid(z) - labels[rows]) / len(rows)
            gradient = np.bincount(flat, weights=error[row], minlength=DIMENSIONS)
            for r in rows:  # the counterfactual of each text: a term swapped, or put in where there is none
                new = identity[rng.integers(len(identity))]
                old = identity[terms[r][rng.integers(len(terms[r]))]] if terms[r] else np.zeros(0, np.int64)
                change = weights[new].sum() - weights[old].sum()
                np.add.at(gradient, new, 2 * penalty * change / len(rows))
                np.add.at(gradient, old, -2 * penalty * change / len(rows))
            squares += gradient**2
            weights = np.maximum(weights - rate * gradient / np.sqrt(squares), 0)
            bias_square += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias_square)
        weights = np.maximum(weights - shrink, 0)
    return Model(weights.astype(np.float32), float(bias))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: CRC-32 of doc_id as text, modulo 4, is 2.  A null doc_id isn't held out."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_negative: int = 6000, max_features: int = 1 << 14) -> Model:
    """Fit on at most so many labelled rows of each kind, those of least hash; held-out rows and null labels don't count.

    A document with several labels counts as toxic if one says so; one with several texts is learnt by that of least hash, and a
    text of more than ``max_features`` features by so many of them.  Without rows of both kinds all scores are one value.
    Only doc_id and text of ``docs``, doc_id and toxic of ``labels`` are read; either may be empty.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in ((1, max_positive), (0, max_negative))]
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some[0].unionByName(some[1])), F.col("doc_id") == F.col("id"))  # at most max_positive + max_negative rows

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = {t: i for i, t in enumerate(IDENTITY_TERMS)}
        for batch in batches:
            found = [text_words(t.as_py()) for t in batch.column("text")]
            features = [np.unique(np.array([f for w in s for f in word_features(w)], np.int32)) for s in found]
            features = [(x if len(x) <= max_features else np.sort(x[np.argsort(x * np.int32(0x61C88647))[:max_features]])).tobytes() for x in features]
            terms = [np.array(sorted(number[w] for w in s if w in number), np.int32).tobytes() for s in found]
            yield pa.record_batch([batch.column("doc_id"), pa.array([zlib.crc32(f) for f in features], pa.int64()), batch.column("toxic"), pa.array(features, pa.binary()), pa.array(terms, pa.binary())], names=["doc_id", "crc", "toxic", "features", "terms"])

    def learn(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["doc_id"])  # in no other order, whatever the order of arrival
        features, terms = ([np.frombuffer(r[c], np.int32) for r in rows] for c in ("features", "terms"))
        model = fit(features, np.array([r["toxic"] for r in rows], float), [t.tolist() for t in terms])
        yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(read, "doc_id long, crc long, toxic int, features binary, terms binary")
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "features", "terms"), F.struct("crc", "features")).alias("r")).select("doc_id", "r.*")
    found = one.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"])


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), from the whole text alone.

    Null and empty texts get the score of the bias; equal texts, and so repeated rows, get equal scores.  An empty table gives
    no rows.  Columns of ``docs`` that bear the new names are replaced; ``names`` may give others.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # DIMENSIONS weights, whatever the input
    kept = docs.drop(*names)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, weight = Model(*shared.value), {}
        for batch in batches:
            z = []
            for text in batch.column("text"):
                heavy: dict[str, float] = {}
                for w in set((text.as_py() or "").lower().split()):
                    got = weight.get(w)
                    if got is None:
                        if len(weight) >= KEPT_WORDS:
                            weight.clear()
                        bare = w.strip(_STRIP)
                        got = weight[w] = (bare, model.word_weight(bare) if bare else 0.0)
                    if got[1]:
                        heavy[got[0]] = got[1]  # forms that differ by punctuation alone count once
                z.append(math.fsum(heavy.values()))
            score = _sigmoid(model.bias + np.array(z, float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, _with(kept, f"`{names[0]}` double, `{names[1]}` int"))


def _with(docs: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])
