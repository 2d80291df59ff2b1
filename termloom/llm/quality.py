"""Supervised subword embeddings: a document is the mean of learned vectors of its hashed words, word pairs and
character n-grams; a softmax on it tells the class. Trained by stochastic gradient descent in numpy.

Scoring needs one number for each bucket (its vector times the difference of the two output rows), so a
document's score is a mean of table look-ups over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.bytesvec import Words, mix
from termloom.llm.common import held_out, labelled_sample, release, slices

BUCKETS = 1 << 17
CHAR_SIZES = (3, 4)
_PAIR, _WORD, _AGAIN = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
#: Bounds of fitting, and of nothing else: labelled documents in the sample, characters of one, documents of the sample that a bucket
#: needs to be learned (others keep the vector zero: they are read, and say nothing).
ROWS, MAX_CHARS, LEAST_DOCS = 4000, 20_000, 4


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, bucket) of every word, pair of neighbouring words and character n-gram of bytes within a word."""
    w = Words(column)
    docs, found = [w.doc], [mix(w.hash + _WORD)]
    if len(w.doc) > 1:
        near = np.flatnonzero(w.doc[1:] == w.doc[:-1])
        docs.append(w.doc[near])
        found.append(mix(w.hash[near] * _PAIR + w.hash[near + 1]))
        # a word after itself is, whichever word it is, one more gram
        again = near[w.hash[near] == w.hash[near + 1]]
        docs.append(w.doc[again])
        found.append(np.full(len(again), _AGAIN))
    size = w.end - w.start
    for n in CHAR_SIZES:
        count = np.maximum(size - n + 1, 0)
        owner = np.repeat(np.arange(len(size)), count)
        at = w.start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        edge = (at == w.start[owner]).astype(np.uint64) + np.uint64(2) * (at + n == w.end[owner]).astype(np.uint64)
        docs.append(w.doc[owner])
        found.append(w.span_hash(at, at + n) * np.uint64(5) + edge)
    doc, h = np.concatenate(docs), np.concatenate(found)
    return doc, (h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), w.n_docs


@dataclass
class Model:
    """score of a bucket's vector, and the bias, both as log odds of class 1."""

    table: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        doc, bucket, n = grams(column)
        total = np.bincount(doc, weights=self.table[bucket], minlength=n)
        count = np.bincount(doc, minlength=n)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def fit(texts: list[str], labels: np.ndarray, prior: float, dim: int = 8, steps: int = 400, batch: int = 48, rate: float = 0.5, seed: int = 7, least_docs: int = LEAST_DOCS) -> Model:
    """Stochastic gradient descent on the softmax's log loss, for a fixed number of steps.

    prior is class 1's share of all labels; a sample with other shares is weighted to it. Without both classes: the prior alone. Buckets
    that fewer than least_docs texts have stay zero, so that no single text is learned by heart; 1 learns all."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    weigh = (np.array([1 - prior, prior]) / np.array([1 - labels.mean(), labels.mean()])).astype(np.float32)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, part in slices(pa.array(texts, pa.string())):
        doc, bucket, n = grams(part)
        for d in np.split(bucket[np.argsort(doc, kind="stable")], np.cumsum(np.bincount(doc, minlength=n))[:-1]):
            ids, count = np.unique(d, return_counts=True)
            rows.append((ids, (count / max(1, len(d))).astype(np.float32)))
    common = np.bincount(np.concatenate([ids for ids, _ in rows]), minlength=BUCKETS) >= least_docs
    rows = [(ids[common[ids]], share[common[ids]]) for ids, share in rows]
    vectors = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    vectors[~common] = 0
    out, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.log(np.array([1 - prior, prior])).astype(np.float32)
    # squared gradients so far, by bucket: rare n-grams keep longer steps
    seen = np.full(BUCKETS, 1e-8, np.float32)
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(steps * batch // len(rows) + 1)])
    for step in range(steps):
        pick = order[step * batch : (step + 1) * batch]
        ids = np.concatenate([rows[i][0] for i in pick])
        share = np.concatenate([rows[i][1] for i in pick])
        owner = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
        hidden = np.stack([np.bincount(owner, weights=share * vectors[ids, k], minlength=len(pick)) for k in range(dim)], 1).astype(np.float32)
        z = hidden @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), labels[pick].astype(int)] -= 1
        p *= weigh[labels[pick].astype(int)][:, None]
        back = p @ out.T
        pull = share[:, None] * back[owner]
        unique, place = np.unique(ids, return_inverse=True)
        grad = np.stack([np.bincount(place, weights=pull[:, k]) for k in range(dim)], 1).astype(np.float32)
        seen[unique] += (grad**2).mean(1)
        vectors[unique] -= rate * grad / np.sqrt(seen[unique])[:, None]
        out -= hidden.T @ p / len(pick)
        bias -= 0.1 * p.mean(0)
    towards = out[:, 1] - out[:, 0]
    return Model((vectors @ towards).astype(np.float32), float(bias[1] - bias[0]))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample_rows: int = ROWS, max_chars: int = MAX_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...), by a model fitted on labels.

    The sample for fitting is bounded by sample_rows and max_chars, and what is learned from it by least_docs; scoring covers every
    whole text. Null and empty texts get the prior's score. Rows stay one to one, whether doc_ids repeat or are null; other columns
    aren't read. An empty table gives an empty one.
    """
    model = fit(*labelled_sample(docs, labels, label, sample_rows, max_chars), least_docs=least_docs)
    return apply_model(docs, model, threshold)


def apply_model(docs: DataFrame, model, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted by any model with score(column of texts). The model's size is fixed."""
    release(docs.sparkSession)  # what fitting took
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start, texts in slices(batch.column(1), 1 << 18):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(own.score(texts).astype(np.float64))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_below(docs: DataFrame, model, threshold: float) -> DataFrame:
    """The rows of docs, whole, whose text scores below threshold."""
    release(docs.sparkSession)  # what fitting took
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start, texts in slices(batch.column(at), 1 << 18):
                yield batch.slice(start, len(texts)).filter(pa.array(own.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
