"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded: shape statistics
(letter case, digits, symbols, repetition, word lengths) and hashed word
endings, through a learnt layer. Gated attention (Ilse, Tomczak and
Welling 2018) weighs the passages' codes, and the weighted code is scored. Only
document labels are needed: the attention learns which passages tell.

The model is fitted on the driver to a bounded sample of labelled documents
(``SAMPLE``, by a hash of the id); its few thousand weights go to every task,
which encodes each whole text passage by passage.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import crc_mod, fresh_name, ship, table

PASSAGE_WORDS = 80
HASHED = 64
#: Labelled documents that the model is fitted to, at most.
SAMPLE = 4000
CODE, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 64, 0.01, 1e-4, 7
#: Passages encoded or scored at a time.
BLOCK = 4096

_letters = re.compile(r"[^\W\d_]+")
N_SHAPE = 18


def passages(text: str | None, size: int = PASSAGE_WORDS) -> Iterator[list[str]]:
    """Runs of ``size`` words; the last may be shorter. A text without words is one empty passage."""
    words = text.split() if text else []
    if not words:
        yield []
    for at in range(0, len(words), size):
        yield words[at : at + size]


def encode(words: list[str]) -> np.ndarray:
    """A passage's features, all within a few units of 0."""
    out = np.zeros(N_SHAPE + HASHED, np.float32)
    if not words:
        out[0] = 1.0
        return out
    n = len(words)
    joined = " ".join(words)
    chars = len(joined)
    upper = sum(map(str.isupper, words)) / n
    title = sum(w[0].isupper() for w in words) / n
    alpha = sum(map(str.isalpha, words)) / n
    digits = sum(c.isdigit() for c in joined) / chars
    letters = sum(map(len, _letters.findall(joined))) / chars
    symbols = 1 - letters - digits - (n - 1) / chars
    odd = sum(joined.count(c) for c in "#$%&*|!<>{}[]=~^_\\/@") / chars
    stops = sum(joined.count(c) for c in ".?") / n
    commas = (joined.count(",") + joined.count(";")) / n
    lower = [w.lower() for w in words]
    kinds = len(set(lower)) / n
    top = max(map(lower.count, set(lower[:8]))) / n
    pairs = len(set(zip(lower, lower[1:], strict=False))) / max(1, n - 1)
    lengths = np.fromiter(map(len, words), float, n)
    ends = len({w[-1] for w in words if not w[-1].isalnum()}) / 8
    out[:N_SHAPE] = (
        0.0, upper, title, alpha, 4 * digits, letters, 4 * symbols, 8 * odd, 4 * stops, 2 * commas, kinds, top, pairs,
        lengths.mean() / 8, lengths.std() / 8, min(1.0, lengths.max() / 40), ends, math.log1p(n) / 5,
    )
    for word in set(lower):
        out[N_SHAPE + zlib.crc32(word[-3:].encode()) % HASHED] += 1 / n
    return out


def encode_all(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, each passage's text number)."""
    rows, of = [], []
    for k, text in enumerate(texts):
        for words in passages(text):
            rows.append(encode(words))
            of.append(k)
    return np.array(rows, np.float32).reshape(len(rows), N_SHAPE + HASHED), np.array(of, np.int64)


class AttentionModel:
    """code = tanh(x E + e); weight ~ exp(w . (tanh(code V) * sigmoid(code U))); score = sigmoid(c . sum(weight code) + b)."""

    def __init__(self, features: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        scale = lambda *s: rng.normal(0, 1 / math.sqrt(s[0]), s)
        self.p = {"E": scale(features, CODE), "e": np.zeros(CODE), "V": scale(CODE, ATTENTION), "U": scale(CODE, ATTENTION), "w": scale(ATTENTION), "c": scale(CODE), "b": np.zeros(1)}
        self.mean, self.std = np.zeros(features), np.ones(features)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, tanh gate, sigmoid gate, attention logits) of passages."""
        p = self.p
        code = np.tanh(((x - self.mean) / self.std) @ p["E"] + p["e"])
        t, g = np.tanh(code @ p["V"]), 1 / (1 + np.exp(-np.clip(code @ p["U"], -30, 30)))
        return code, t, g, np.clip((t * g) @ p["w"], -30, 30)

    def scores(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def _step(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over a batch of bags; ``of`` is sorted and has every bag."""
        p = self.p
        code, t, g, logits = self.forward(x)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        e = np.exp(logits)
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * code, starts)
        d_logit = (self.scores(z @ p["c"] + p["b"][0]) - y) * weight / weight.sum()
        d_z = d_logit[:, None] * p["c"]
        d_a = (code * d_z[of]).sum(axis=1)
        d_s = a * (d_a - np.add.reduceat(a * d_a, starts)[of])
        d_tg = d_s[:, None] * p["w"]
        d_v, d_u = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_code = (a[:, None] * d_z[of] + d_v @ p["V"].T + d_u @ p["U"].T) * (1 - code * code)
        return {"E": ((x - self.mean) / self.std).T @ d_code, "e": d_code.sum(axis=0), "V": code.T @ d_v, "U": code.T @ d_u, "w": (t * g).T @ d_s, "c": z.T @ d_logit, "b": np.array([d_logit.sum()])}

    def fit(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, seed: int = SEED) -> AttentionModel:
        """Adam over shuffled bags; rare labels weigh more, by the square root of their share."""
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        starts = np.searchsorted(of, np.arange(len(y) + 1))
        share = y.mean()
        # halfway between the labels' own shares and equal ones
        weight = np.where(y > 0.5, 1 / math.sqrt(share), 1 / math.sqrt(1 - share))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * 0.5 * (1 + math.cos(math.pi * epoch / EPOCHS))
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                bags = order[at : at + BATCH]
                rows = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in bags])
                inside = np.repeat(np.arange(len(bags)), [starts[b + 1] - starts[b] for b in bags])
                step += 1
                for k, gradient in self._step(x[rows], inside, y[bags], weight[bags]).items():
                    gradient = gradient + DECAY * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * gradient
                    second[k] = 0.999 * second[k] + 0.001 * gradient * gradient
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts, in memory bounded by BLOCK passages."""
        pending: list[np.ndarray] = []
        owner: list[int] = []
        top, mass, total = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), CODE))

        def flush() -> None:
            if not pending:
                return
            code, _, _, logits = self.forward(np.array(pending, np.float32))
            own = np.array(owner)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            texts_here = own[starts]
            high = np.maximum(top[texts_here], np.maximum.reduceat(logits, starts))
            keep = np.where(mass[texts_here] > 0, np.exp(np.maximum(top[texts_here] - high, -60)), 0.0)
            e = np.exp(logits - np.repeat(high, np.diff(np.append(starts, len(own)))))
            mass[texts_here] = mass[texts_here] * keep + np.add.reduceat(e, starts)
            total[texts_here] = total[texts_here] * keep[:, None] + np.add.reduceat(e[:, None] * code, starts)
            top[texts_here] = high
            pending.clear()
            owner.clear()

        for k, text in enumerate(texts):
            for words in passages(text):
                pending.append(encode(words))
                owner.append(k)
                if len(pending) >= BLOCK:
                    flush()
        flush()
        return self.scores((total / mass[:, None]) @ self.p["c"] + self.p["b"][0])


class ConstantModel:
    """Where labels are missing or all alike."""

    def __init__(self, value: float):
        self.value = value

    def predict(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.value)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_fold: int = 1, sample: int = SAMPLE) -> AttentionModel | ConstantModel:
    """A model of ``labels`` (doc_id, quality), fitted to at most ``sample`` documents outside the held-out fold.

    Rows with a null id or label aren't used; of an id labelled more than once
    the largest label counts, and of an id that repeats in ``docs`` each text.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).dropna().where(crc_mod("id", folds) != held_fold)
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the chosen rows are at most ``sample``, so their broadcast is bounded
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, of = encode_all(batch.column(2).to_pylist())
            bags = [x[of == k].tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["id", "y", "x"])

    bags = sorted(rows.mapInArrow(encoded, "id long, y double, x binary").toArrow().to_pylist(), key=lambda r: (r["id"], r["x"]))
    y = np.array([float(r["y"] > 0.5) for r in bags])
    if not len(y) or y.min() == y.max():
        return ConstantModel(float(y.mean()) if len(y) else 0.5)
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, N_SHAPE + HASHED) for r in bags]
    of = np.repeat(np.arange(len(x)), [len(b) for b in x])
    return AttentionModel(N_SHAPE + HASHED).fit(np.concatenate(x).astype(np.float64), of, y)


def _scores(texts: pa.Array, model: AttentionModel | ConstantModel) -> pa.Array:
    """Scores of a batch's texts, of which few are Python strings at a time."""
    return pa.array([x for at in range(0, len(texts), 256) for x in model.predict(texts.slice(at, 256).to_pylist())], pa.float64())


def _scored(batches: Iterator[pa.RecordBatch], model: AttentionModel | ConstantModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.predict(part.column(1).to_pylist()))], ["doc_id", "score"])


def quality_scores(docs: DataFrame, model: AttentionModel | ConstantModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), one row for each row of ``docs``; null and empty texts have a score, too."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(lambda b: _scored(b, held.value), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_fold: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    ``held_out``: crc32(doc_id as text) modulo ``folds`` is ``held_fold``; false
    for a null id. Without usable labels all scores are 0.5, with one class only
    they are that class. Repeated rows give repeated rows; an empty table gives
    an empty one. Other columns aren't read.
    """
    scores = quality_scores(docs, fit_quality(docs, labels, id_col, text_col, folds=folds, held_fold=held_fold), id_col, text_col)
    held = F.coalesce(crc_mod("doc_id", folds) == held_fold, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject; columns stay as they are."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_col, text_col))
    name = fresh_name(docs.columns, "quality_score")
    score = F.arrow_udf(lambda texts: _scores(texts, held.value), "double")
    return docs.withColumn(name, score(F.col(text_col))).where(F.col(name) >= 0.5).drop(name)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the whole ``documents`` table, learnt from ``labels``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
