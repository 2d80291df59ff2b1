"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of the learned vector of its hash and the mean learned vector of its hashed
character n-grams. The network reads overlapping windows of WINDOW words, half a window apart, in both
directions; attention pools a window's states to one log odds. Training takes a document's log odds as
the mean of its windows' by their own softmax, so that the worst windows learn; scoring takes the worst of
all windows of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm.bytesvec import Words
from termloom.llm.common import labelled_sample, slices
from termloom.llm.quality import apply_model, keep_below

WINDOW, STRIDE = 24, 12
BUCKETS, DIM, HIDDEN = 1 << 16, 8, 8
CHAR_SIZES = (3, 5)
#: Bounds of fitting, and of nothing else: labelled documents in the sample, characters of one, windows of one in a training step.
ROWS, MAX_CHARS, STEP_WINDOWS = 12_000, 20_000, 96


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Inputs:
    """Distinct words of some texts by their buckets, and the windows as indices of distinct words (-1: none)."""

    word: np.ndarray  # bucket of each distinct word
    gram: np.ndarray  # buckets of character n-grams, one distinct word after the other
    gram_of: np.ndarray  # the distinct word of each n-gram
    window: np.ndarray  # windows x WINDOW
    doc: np.ndarray  # the document of each window
    n_docs: int


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(24)).astype(np.int64) & (BUCKETS - 1)


def read(column: pa.Array) -> Inputs:
    """Words are lower-cased in A-Z; all windows of every text, the last one reaching its end."""
    w = Words(column, lower=True)
    _, first, uid = np.unique(w.hash, return_index=True, return_inverse=True)
    start, end = w.start[first], w.end[first]
    size = end - start
    grams, owners = [], []
    for n in CHAR_SIZES:
        count = np.maximum(size - n + 1, 0)
        owner = np.repeat(np.arange(len(size)), count)
        at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        grams.append(_bucket(w.span_hash(at, at + n) * np.uint64(3) + (at == start[owner]).astype(np.uint64)))
        owners.append(owner)
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    n_windows = np.where(w.count > 0, np.maximum(1, -(-(w.count - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(w.n_docs), n_windows)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * STRIDE
    place = begin[:, None] + np.arange(WINDOW)
    there = place < w.count[doc][:, None]
    index = np.where(there, place + w.first_word()[doc][:, None], 0)
    window = np.where(there, uid[index], -1) if len(uid) else np.zeros((0, WINDOW), np.int64)
    return Inputs(_bucket(w.hash[first]), gram[order], owner[order], window, doc, w.n_docs)


class Network:
    """Weights by name; forward() and backward() over windows, float32."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        # vectors begin at zero, so that words never seen in training say nothing
        self.p = {"word": np.zeros((BUCKETS, DIM), np.float32), "gram": np.zeros((BUCKETS, DIM), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": normal(DIM, 3 * HIDDEN, scale=0.5), f"u{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": normal(2 * HIDDEN, scale=0.3), "o": normal(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        self.prior = 0.0

    def embed(self, x: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the distinct words, and one over the number of n-grams of each."""
        count = np.bincount(x.gram_of, minlength=len(x.word))
        one_over = (1 / np.maximum(count, 1)).astype(np.float32)
        total = np.zeros((len(x.word) + 1, DIM), np.float32)
        if len(x.gram):
            filled = np.flatnonzero(count)
            total[filled] = np.add.reduceat(self.p["gram"][x.gram], (np.cumsum(count) - count)[filled])
        return self.p["word"][x.word] + total[:-1] * one_over[:, None], one_over

    def _direction(self, d: str, gates: np.ndarray, window: np.ndarray, keep: list | None) -> np.ndarray:
        u, n = self.p[f"u{d}"], len(window)
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.zeros((WINDOW, n, HIDDEN), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            at = window[:, t]
            g = gates[at]
            hu = h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            z = z * (at >= 0)[:, None]
            if keep is not None:
                keep.append((t, h, z, r, new, hu[:, 2 * HIDDEN :]))
            h = h + z * (new - h)
            states[t] = h
        return states

    def forward(self, x: Inputs, window: np.ndarray, training: bool = False):
        """Log odds of each window; with training, all that backward() needs as well."""
        e, one_over = self.embed(x)
        kept: dict = {"f": [] if training else None, "b": [] if training else None}
        s = []
        for d in "fb":
            # index -1, no word, gets the last row
            gates = np.concatenate([e @ self.p[f"w{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            s.append(self._direction(d, gates, window, kept[d]))
        s = np.concatenate(s, 2)
        mask = (window >= 0).T
        score = np.where(mask, s @ self.p["a"], np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * s).sum(0)
        out = pooled @ self.p["o"] + self.p["bias"][0]
        return (out, (e, one_over, kept, s, weight, pooled)) if training else out

    def backward(self, x: Inputs, window: np.ndarray, saved, pull: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by name, for pull: the loss's derivative by each window's log odds."""
        e, one_over, kept, s, weight, pooled = saved
        grad = {"o": pooled.T @ pull, "bias": np.array([pull.sum()], np.float32)}
        dp = pull[:, None] * self.p["o"]
        ds = weight[:, :, None] * dp
        along = (s * dp).sum(2)
        dscore = weight * (along - (weight * along).sum(0))
        grad["a"] = np.einsum("tnh,tn->h", s, dscore)
        ds = ds + dscore[:, :, None] * self.p["a"]
        de = np.zeros((len(x.word) + 1, DIM), np.float32)
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            dg_words = np.zeros((len(x.word) + 1, 3 * HIDDEN), np.float32)
            du, dh = np.zeros_like(u), np.zeros((len(window), HIDDEN), np.float32)
            flat_at, flat_dg = [], []
            for t, h, z, r, new, hn in reversed(kept[d]):
                dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dn = dh * z * (1 - new * new)
                there = (window[:, t] >= 0)[:, None]
                dz = dh * (new - h) * z * (1 - z) * there
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                flat_at.append(window[:, t])
                flat_dg.append(np.concatenate([dz, dr, dn], 1) * there)
                du += h.T @ dhu
                dh = dh * (1 - z) + dhu @ u.T
            at, dg = np.concatenate(flat_at), np.concatenate(flat_dg)
            for j in range(3 * HIDDEN):
                dg_words[:, j] = np.bincount(np.where(at >= 0, at, len(x.word)), weights=dg[:, j], minlength=len(x.word) + 1)
            dg_words = dg_words[:-1]
            grad |= {f"u{d}": du, f"w{d}": e.T @ dg_words, f"c{d}": dg_words.sum(0)}
            de[:-1] += dg_words @ self.p[f"w{d}"].T
        de = de[:-1]
        share = de * one_over[:, None]
        columns = lambda place, value: np.stack([np.bincount(place, weights=value[:, j], minlength=BUCKETS) for j in range(DIM)], 1).astype(np.float32)
        grad["word"] = columns(x.word, de)
        grad["gram"] = columns(x.gram, share[x.gram_of])
        return grad

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability for each text: that of its worst window; the prior for a text without words."""
        x = read(column)
        worst = np.full(x.n_docs, -np.inf, np.float32)
        for k in range(0, len(x.window), 1 << 14):
            part = slice(k, k + (1 << 14))
            np.maximum.at(worst, x.doc[part], self.forward(x, x.window[part]))
        return _sigmoid(np.where(np.isinf(worst), np.float32(self.prior), worst).astype(np.float64))


def fit(
    texts: list[str], labels: np.ndarray, prior: float, steps: int = 1000, batch: int = 24, rate: float = 0.01, seed: int = 11,
    step_windows: int = STEP_WINDOWS, dropout: float = 0.1, decay: float = 0.5,
) -> Network:
    """Adam on the documents' log loss for a fixed number of steps; prior is class 1's share of all labels. Without both classes: the prior alone.

    A step reads `batch` documents, of one with more than step_windows windows that many, drawn anew each time (a bound of the
    training sample; scoring reads all). Against learning rare words by heart, a share `dropout` of a step's words is blanked and the
    vectors shrink by rate * decay a step."""
    net, rng = Network(seed), np.random.default_rng(seed)
    net.prior = float(np.log(prior / (1 - prior)))
    net.p["bias"][0] = net.prior
    if len(set(labels.tolist())) < 2:
        net.p["o"][:] = 0
        return net
    mean, square = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    sides = [np.flatnonzero(labels == c) for c in (0, 1)]
    for step in range(1, steps + 1):
        # a third of each batch is of class 1; the weights give the classes their own shares back
        n_one = max(1, batch // 3)
        pick = np.concatenate([rng.choice(sides[1], n_one), rng.choice(sides[0], batch - n_one)])
        x = read(pa.array([texts[i] for i in pick], pa.string()))
        chosen = np.concatenate([w if len(w) <= step_windows else rng.choice(w, step_windows, replace=False) for w in np.split(np.arange(len(x.doc)), np.cumsum(np.bincount(x.doc, minlength=x.n_docs))[:-1])]).astype(np.int64)
        window, doc = x.window[chosen], x.doc[chosen]
        window = np.where(rng.random(window.shape) < dropout, -1, window)
        out, saved = net.forward(x, window, True)
        top = np.full(len(pick), -np.inf)
        np.maximum.at(top, doc, out)
        soft = np.exp(out - top[doc])
        soft /= np.bincount(doc, weights=soft, minlength=len(pick))[doc]
        of_doc = np.bincount(doc, weights=soft * out, minlength=len(pick))
        share = np.where(labels[pick] == 1, prior / n_one, (1 - prior) / (batch - n_one)) ** 0.5
        share /= share.sum()
        err = (_sigmoid(of_doc) - labels[pick]) * share
        pull = (err[doc] * soft * (1 + out - of_doc[doc])).astype(np.float32)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in net.backward(x, window, saved, pull).items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            net.p[k] -= (now * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if k in ("word", "gram"):
                net.p[k] *= np.float32(1 - now * decay)
    return net


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, sample_rows: int = ROWS, max_chars: int = MAX_CHARS, step_windows: int = STEP_WINDOWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...), by a network fitted on labels.

    The sample for fitting is bounded by sample_rows and max_chars, and a training step by step_windows; scoring covers every
    window of every whole text. Null and blank texts get the prior's score. Rows stay one to one, whether doc_ids repeat or are null;
    other columns aren't read. An empty table gives an empty one.
    """
    return apply_model(docs, fit(*labelled_sample(docs, labels, label, sample_rows, max_chars), step_windows=step_windows), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, sample_rows: int = ROWS, max_chars: int = MAX_CHARS, step_windows: int = STEP_WINDOWS) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns. Null and blank texts stay while the prior is below it."""
    return keep_below(docs, fit(*labelled_sample(docs, labels, label, sample_rows, max_chars), step_windows=step_windows), threshold)
