"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words in a text. For every labelled sentence that
holds an identity term, the term is swapped for each other one, and the squared change of
the log-odds is added to the loss. The weights of identity terms are so drawn together and
to zero: a neutral mention of a group does not raise a score, whatever the labels say.

The fit uses at most ``sample_rows`` labelled rows, those with the smallest hash of their
id. Words are counted by Spark, and the driver gets only the chosen words' presence in these rows. Scoring runs
over all rows and whole texts. Words are runs of ASCII letters and digits and of all other
characters' bytes, with A-Z in lower case.

Defined results: null and empty texts get the score of a text without known words; repeated
rows get equal scores; without labels of both kinds every score is the constant 0; nulls
among labels or their ids are left out of the fit; an empty table gives an empty table.
Added columns replace columns of the same name, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.llm.bytetext import LOWER, WORDY, run_keys, runs, text_slices
from wardlake.llm.tables import kept

SAMPLE_ROWS = 16_384
FEATURES = 2_048
THRESHOLD = 0.3
#: Rows of a batch that a filter gives back at once, so that texts are not held twice.
OUT_ROWS = 1_000

#: Terms that name groups of people without judging them.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "black", "white", "asian", "african",
    "european", "american", "arab", "latino", "gay", "lesbian", "straight", "transgender", "immigrants", "refugees", "disabled", "deaf", "blind",
    "old", "young", "muslim", "christian", "jewish", "hindu", "woman", "man",
)


def _keys_of(terms: tuple[str, ...]) -> np.ndarray:
    column = pa.array(list(terms), pa.string())
    return np.concatenate([k for _, _, k, _ in _word_keys(column)])


def _word_keys(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of texts: row range, word keys, and the row of each word within the slice."""
    for i, j, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, owner = runs(data, offsets, WORDY)
        yield i, j, run_keys(data, starts, ends), owner


def _distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], owner[new]


@dataclass
class Model:
    """Sorted word keys, their weights, and the log-odds of a text without any."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias, float)
        if len(self.keys):
            for i, j, keys, owner in _word_keys(column):
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                hit = self.keys[at] == keys
                pair = np.unique(owner[hit] * np.int64(len(self.keys)) + at[hit])
                out[i:j] += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], j - i)
        return 1 / (1 + np.exp(-np.clip(out, -700, 700))) if np.isfinite(self.bias) else np.zeros(len(column))


def _sample(docs: DataFrame, labels: DataFrame, allowed: Column, sample_rows: int, text: str) -> DataFrame:
    """(toxic, text) of the labelled rows that the fit uses."""
    chosen = (
        labels.where(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # One text of each id, so that an id with very many rows neither fills the driver nor outweighs the others.
    one = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return one.select("toxic", "text")


def _counts(sample: DataFrame) -> DataFrame:
    """(word, texts, toxic) of every word key: in how many texts it stands. The null word stands in every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            yield _rows([None], [len(label)], [int(label.sum())])
            for i, j, keys, owner in _word_keys(batch.column("text")):
                keys, owner = _distinct(keys, owner)
                words, code = np.unique(keys, return_inverse=True)
                toxic = np.bincount(code, label[i:j][owner], len(words)).astype(np.int64)
                yield _rows(words.view(np.int64), np.bincount(code, minlength=len(words)), toxic)

    def _rows(word, texts, toxic) -> pa.RecordBatch:  # noqa: ANN001
        return pa.RecordBatch.from_pydict({"word": pa.array(word, pa.int64()), "texts": pa.array(texts, pa.int64()), "toxic": pa.array(toxic, pa.int64())})

    return sample.mapInArrow(work, "word long, texts long, toxic long").groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))


def _hits(sample: DataFrame, words: np.ndarray) -> list:
    """Which of the chosen words stand in each text: labels, sizes and word numbers, a row for each slice of texts."""
    handed = sample.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int8)
            for i, j, keys, owner in _word_keys(batch.column("text")):
                at = np.minimum(np.searchsorted(handed.value, keys), len(handed.value) - 1)
                hit = handed.value[at] == keys
                pair = np.unique(owner[hit] * np.int64(len(handed.value)) + at[hit])
                sizes = np.bincount(pair // len(handed.value), minlength=j - i).astype(np.int32)
                row = {"toxic": [label[i:j].tobytes()], "sizes": [sizes.tobytes()], "words": [(pair % len(handed.value)).astype(np.int32).tobytes()]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary()) for k, v in row.items()})

    return sample.mapInArrow(work, "toxic binary, sizes binary, words binary").collect()


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES,
    swap_penalty: float = 4.0, ridge: float = 2.0, text: str = "text", steps: int = 60,
) -> Model:
    """Fits the model to labelled rows.

    docs has doc_id and the text, labels has doc_id and toxic (0 or 1; a repeated id counts once, as its
    largest label). ``allowed`` keeps labels of which the fit may know. Words are counted over the sample by Spark; the
    driver gets the words that tell labels apart best, and which of them stand in each sampled text.
    """
    sample = _sample(docs, labels, F.lit(True) if allowed is None else allowed, sample_rows, text)
    counts = kept(_counts(sample), "word-counts")
    every = counts.where("word IS NULL").first()
    if every is None or every["toxic"] in (0, every["texts"]):
        return Model()
    share = every["toxic"] / every["texts"]
    gain = F.pow(F.col("toxic") - F.col("texts") * share, 2) / (F.col("texts") * share * (1 - share))
    best = counts.where("word IS NOT NULL AND texts >= 3").withColumn("gain", gain).where("gain > 6").orderBy(F.desc("gain"), "word").limit(features)
    identity = np.unique(_keys_of(IDENTITY_TERMS))
    chosen = np.union1d(np.array([r["word"] for r in best.collect()], np.int64).view(np.uint64), identity)
    got = _hits(sample, chosen)
    y = np.concatenate([np.frombuffer(r["toxic"], np.int8) for r in got]).astype(float)
    x_row = np.repeat(np.arange(len(y)), np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in got]))
    x_col = np.concatenate([np.frombuffer(r["words"], np.int32) for r in got])
    n, k = len(y), len(chosen)

    # A swap of term a for b in a text that holds a: the change is w_b - w_a. Only the number of such texts matters.
    terms = np.searchsorted(chosen, identity)
    mentions = np.bincount(x_col, minlength=k)[terms].astype(float)
    pull = np.zeros((len(terms), len(terms)))
    if len(terms) > 1:
        weight = (mentions[:, None] + mentions[None, :]) / (len(terms) - 1)
        np.fill_diagonal(weight, 0)
        pull = np.diag(weight.sum(1)) - weight
    # Newton steps with a conjugate-gradient solve; the loss is convex.
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    curb = np.full(k, ridge)
    curb[terms] += swap_penalty * mentions  # a text without the term is a swap, too

    def dot(v: np.ndarray) -> np.ndarray:
        return np.bincount(x_row, v[x_col], n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(x_col, r[x_row], k)

    def loss(w: np.ndarray, b: float) -> float:
        z = dot(w) + b
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (curb * w * w).sum() + 0.5 * swap_penalty * w[terms] @ pull @ w[terms])

    now = loss(w, b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(dot(w) + b)))
        gw = back(p - y) + curb * w
        gw[terms] += swap_penalty * pull @ w[terms]
        gb = float((p - y).sum())
        h = np.maximum(p * (1 - p), 1e-6)

        def times(v: np.ndarray, c: float, h: np.ndarray = h) -> tuple[np.ndarray, float]:
            r = h * (dot(v) + c)
            out = back(r) + curb * v
            out[terms] += swap_penalty * pull @ v[terms]
            return out, float(r.sum())

        dw, db, rw, rb = np.zeros(k), 0.0, -gw, -gb
        pw, pb = rw.copy(), rb
        rr = float(rw @ rw + rb * rb)
        for _ in range(30):
            aw, ab = times(pw, pb)
            alpha = rr / max(float(pw @ aw + pb * ab), 1e-12)
            dw, db, rw, rb = dw + alpha * pw, db + alpha * pb, rw - alpha * aw, rb - alpha * ab
            new = float(rw @ rw + rb * rb)
            if new < 1e-10 * (1 + rr):
                break
            pw, pb, rr = rw + new / rr * pw, rb + new / rr * pb, new
        step = 1.0
        while step > 1e-4 and loss(w + step * dw, b + step * db) > now:
            step /= 2
        w, b = w + step * dw, b + step * db
        after = loss(w, b)
        if now - after < 1e-6 * max(1, abs(now)):
            break
        now = after
    return Model(chosen, w, b)


def with_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 where the score reaches the threshold) to every row."""
    added = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    schema = T.StructType([f for f in docs.schema.fields if f.name not in added] + [T.StructField(c, t) for c, t in added.items()])
    handed = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES and the identity terms

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = handed.value.scores(batch.column(text))
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c not in added}
            columns |= {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(work, schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows whose score stays below the threshold, with their columns as they are."""
    handed = docs.sparkSession.sparkContext.broadcast(model)

    # Only the texts go to Python; the rows stay where they are and are filtered by the verdict.
    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        return pa.array(handed.value.scores(column) < threshold)

    return docs.where(clean(F.col(text)))
