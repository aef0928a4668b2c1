"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j> x_i x_j): besides a weight for each term the model learns a short
factor vector, so that pairs of terms (an insult with the mention of a group) count beyond their sum. Terms are the
distinct words of the whole text, lower case and without punctuation at their ends, and the words' first four letters;
they are hashed into 2^bits places. Terms whose class shares differ by Z_MIN standard errors get a weight, these and all terms on
PAIR_ROWS training rows get factors, and the others don't count: they were met too seldom to learn from. x is 1 for a term with
a weight, so that a telling pair counts the same in a text of any length, and 1/sqrt(n) for the n others of a text.

Training takes at most `per_class` labelled documents of each class (a documented bound; those with the least hash of
their id), drawn from rows that are not held out. Their term lists are made on the executors; one task fits the
model, which holds the terms that count alone. All documents are scored on the executors.

Edge cases: a null or empty text has no terms and scores sigmoid(w0); repeated labels of one id count as toxic if any is;
labels other than 0 and 1 (or null) are ignored; without training rows of both classes the model is constant (the share of toxic
rows, 0.5 without any rows); an input column named like an output column (held_out, score, predicted) is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _Index
from .common import add_column, free_names

BITS, FACTORS, PER_CLASS = 63, 4, 8_000  # so many bits that distinct terms don't meet
EPOCHS, BATCH, RATE, L2_W, L2_V, SEED = 8, 64, 0.1, 1e-5, 1e-4, 7
Z_MIN, PAIR_ROWS = 4.0, 5
STEPS = 1500  # of the optimiser at least: few training rows are passed more often
EDGES = ".,;:!?\"'()[]{}<>*%$#&-_/\\|~`^+=…“”„»«¿¡"
PREFIX = 4
MAX_WORDS = 300_000  # cached distinct words of a task; the cache starts anew beyond


def held_out(id_col: str, folds: int = 5) -> Column:
    """True for the rows whose label the model must not see."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == 0, F.lit(False))


class Terms:
    """Hashed terms of texts; a word is looked at once by a task."""

    def __init__(self, bits: int):
        self.bits = bits
        self._reset()

    def _reset(self):
        self.words = _Index()
        self.places = np.empty((0, 2), np.int64)

    def _place(self, word: str) -> tuple[int, int]:
        w = word.lower().strip(EDGES)
        if not w:
            return -1, -1
        return self._hash("w" + w), self._hash("p" + w[:PREFIX]) if len(w) > PREFIX else -1

    def _hash(self, term: str) -> int:
        return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "replace"), digest_size=8).digest(), "little") & (1 << self.bits) - 1

    def of(self, texts) -> list[np.ndarray]:
        """Distinct places of each text, in order."""
        if len(self.words) > MAX_WORDS:
            self._reset()
        rows = [np.fromiter(map(self.words.__getitem__, set(t.split())), np.int64) if isinstance(t, str) else np.empty(0, np.int64) for t in texts]
        if self.words.fresh:
            self.places = np.concatenate([self.places, np.array([self._place(w) for w in self.words.fresh], np.int64).reshape(-1, 2)])
            self.words.fresh = []
        out = []
        for r in rows:
            p = np.unique(self.places[r])
            out.append(p[p >= 0])
        return out


class Model:
    """w0, and for each term that counts its place (`keys`, in order), w, v (factors) and whether it has a weight (`told`)."""

    def __init__(self, w0: float, keys: np.ndarray, w: np.ndarray, v: np.ndarray, told: np.ndarray):
        self.w0, self.keys, self.w, self.v, self.told = w0, keys, w, v, told

    def at(self, places: np.ndarray) -> np.ndarray:
        """Where the places that count stand in `keys`."""
        i = np.searchsorted(self.keys, places)
        known = i < len(self.keys)
        return i[known][self.keys[i[known]] == places[known]]

    def raw(self, places: np.ndarray) -> float:
        at = self.at(places)
        if not len(at):
            return self.w0
        told = self.told[at]
        v = self.v[at] * np.where(told, 1, 1 / np.sqrt(max((~told).sum(), 1)))[:, None]
        s = v.sum(axis=0)
        return self.w0 + float(self.w[at].sum()) + 0.5 * float(s @ s - (v * v).sum())

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.raw(r) for r in rows], np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def evidence(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, told, rows): the places that count in order, whether their class shares differ beyond chance (they get a
    weight of their own), and the rows as positions in keys; the others are on PAIR_ROWS rows, enough to learn pairs from."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    keys, back = np.unique(np.concatenate(rows), return_inverse=True)
    toxic = labels[doc] == 1
    c1, c0 = np.bincount(back[toxic], minlength=len(keys)), np.bincount(back[~toxic], minlength=len(keys))
    p = (c1 + c0 + 0.5) / (n1 + n0 + 1)
    told = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) >= Z_MIN
    used = told | (c1 + c0 >= PAIR_ROWS)
    at = np.where(used, np.cumsum(used) - 1, -1).astype(np.int32)[back]
    ends = np.cumsum(np.bincount(doc[at >= 0], minlength=len(rows)))
    return keys[used], told[used], np.split(at[at >= 0], ends[:-1])


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Mini-batch AdaGrad on the logistic loss; classes weigh the same."""
    rng = np.random.default_rng(seed)
    n1 = int(labels.sum())
    if n1 in (0, len(labels)):
        share = np.clip((n1 + 0.5) / (len(labels) + 1), 0.01, 0.99)
        return Model(float(np.log(share / (1 - share))), np.empty(0, np.int64), np.empty(0), np.empty((0, factors)), np.empty(0, bool))
    keys, told, rows = evidence(rows, labels)
    size = len(keys)
    w, v = np.zeros(size), rng.normal(0, 0.2, (size, factors))
    gw, gv, w0, g0 = np.full(size, 1e-6), np.full((size, factors), 1e-6), 0.0, 1e-6
    weight = np.where(labels == 1, len(labels) / (2 * n1), len(labels) / (2 * (len(labels) - n1)))
    for _ in range(max(epochs, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            batch = order[s:s + BATCH]
            lens = np.array([len(rows[i]) for i in batch])
            flat = np.concatenate([rows[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), lens)
            x = np.where(told[flat], 1, 1 / np.sqrt(np.maximum(np.bincount(doc, ~told[flat], len(batch)), 1))[doc])[:, None]
            vf = v[flat] * x
            sums = np.zeros((len(batch), factors))
            np.add.at(sums, doc, vf)
            squares = np.bincount(doc, (vf * vf).sum(axis=1), len(batch))
            z = w0 + np.bincount(doc, w[flat], len(batch)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[batch]) * weight[batch] / len(batch)
            # gradients, summed by place
            at, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, err[doc], len(at)) + L2_W * w[at]
            part = err[doc][:, None] * x * (sums[doc] - vf)
            dv = np.stack([np.bincount(back, part[:, f], len(at)) for f in range(factors)], axis=1) + L2_V * v[at]
            gw[at] += dw * dw
            gv[at] += dv * dv
            w[at] -= RATE * told[at] * dw / np.sqrt(gw[at])
            v[at] -= RATE * dv / np.sqrt(gv[at])
            d0 = err.sum()
            g0 += d0 * d0
            w0 -= RATE * d0 / np.sqrt(g0)
    return Model(w0, keys, w, v, told)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int) -> DataFrame:
    """(text, toxic) of at most per_class documents of each class; labels are (doc_id, toxic)."""
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .where("id is not null and toxic in (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic")))
    drawn = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "id").select("id", "text", "toxic")  # 2 * per_class rows at most


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS,
          bits: int = BITS, factors: int = FACTORS) -> Model:
    """Fits the model in one task on the drawn documents' term lists and brings the parameters to the driver."""
    def terms(batches):
        maker = Terms(bits)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "toxic": pdf["toxic"], "places": [r.tolist() for r in maker.of(pdf["text"])]})

    drawn = training_rows(docs, labels, id_col, text_col, per_class).mapInPandas(terms, "id long, toxic int, places array<long>")

    def learn(batches):
        pdf = pd.concat([pd.DataFrame({"id": [], "toxic": [], "places": []}), *batches], ignore_index=True)
        pdf["key"] = [hashlib.blake2b(np.asarray(p, np.int64).tobytes()).digest() for p in pdf["places"]]
        pdf = pdf.sort_values(["id", "toxic", "key"])  # any order of arrival gives the same model
        rows = [np.array(p, np.int64) for p in pdf["places"]]
        m = fit(rows, pdf["toxic"].to_numpy(np.int64), bits, factors)
        yield pd.DataFrame({"w0": [m.w0], "keys": [m.keys.tobytes()], "w": [m.w.astype(np.float32).tobytes()], "v": [m.v.astype(np.float32).tobytes()], "told": [m.told.tobytes()]})

    # at most 2 * per_class rows (and repeats of their ids): one bounded task
    row = drawn.repartition(1).mapInPandas(learn, "w0 double, keys binary, w binary, v binary, told binary").collect()
    if not row:
        return fit([], np.empty(0, np.int64), bits, factors)
    m = row[0]
    return Model(m["w0"], np.frombuffer(m["keys"], np.int64), np.frombuffer(m["w"], np.float32), np.frombuffer(m["v"], np.float32).reshape(-1, factors), np.frombuffer(m["told"], bool))


def add_score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score", bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """df with the model's score of each whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # (factors + 2) numbers for each term that counts

    def start():
        terms, model = Terms(bits), sent.value
        return lambda texts: pa.array(model.scores(terms.of(texts.to_pylist())))

    return add_column(df, out, T.DoubleType(), text_col, start, keep)


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    per_class: int = PER_CLASS, bits: int = BITS, factors: int = FACTORS, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in `keep`) with held_out, score (0 to 1) and predicted (1 if score >= 0.5)."""
    model = train(df, labels, id_col, text_col, per_class, bits, factors)
    cols = [c for c in (keep or df.columns) if c not in ("held_out", "score", "predicted")]
    scored = add_score(df, model, text_col, "score", bits, list(dict.fromkeys([*cols, id_col])))
    return scored.select(*[F.col(f"`{c}`") for c in cols], held_out(id_col).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
               per_class: int = PER_CLASS, bits: int = BITS, factors: int = FACTORS) -> DataFrame:
    """The rows of df that score below the threshold, with df's columns."""
    model = train(df, labels, id_col, text_col, per_class, bits, factors)
    score, = free_names(df.columns, "score")
    return add_score(df, model, text_col, score, bits).where(F.col(score) < threshold).drop(score)
