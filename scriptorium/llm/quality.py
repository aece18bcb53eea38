"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its inputs are shares of character classes, repetition
of words and length, its own and those of the lines before and after it; the
chain has a weight for each pair of neighbouring labels. The field is fitted by
maximum likelihood to labelled documents whose label holds for all their lines.
A document's quality is the length-weighted mean of its lines' forward-backward
marginals, put on the scale of a probability by a logistic map fitted to the
same documents.

A null or empty text is one empty line; empty lines are no lines otherwise. Texts
are read whole, whatever their length, repeated rows get equal scores. Without
labels every score is the constant 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import flat_bytes, pieces, word_hashes
from ._fit import filter_by_score, in_slices, minimise, sigmoid, training_rows, weights

_MARKS = b"|!%$#*&<>{}[]=_~^\\/@+"
UPPER, LOWER, DIGIT, END, MARK, BAR, SHOUT, OTHER = range(8)
_CLASS = np.full(256, OTHER, np.int8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = UPPER, LOWER, DIGIT
for _b in b".,;:?":
    _CLASS[_b] = END
for _b in _MARKS:
    _CLASS[_b] = MARK
_CLASS[ord("|")], _CLASS[ord("!")] = BAR, SHOUT
OWN = 11  # inputs of one line


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of all lines, their lengths in bytes, and where each document's lines begin.

    Works on whole batches: classes are counted over bytes, words by their hashes.
    """
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros((n_docs, 3 * OWN + 1), np.float64) + np.eye(1, 3 * OWN + 1, 3 * OWN), np.zeros(n_docs), np.arange(n_docs + 1)
    newline = data == 10
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(first[: len(data)] | np.concatenate(([True], newline[:-1])))
    ends = np.append(starts[1:], len(data))
    size = ends - starts - newline[ends - 1]
    full = size > 0
    starts, size = starts[full], size[full]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    lacking = np.setdiff1d(np.arange(n_docs), doc)  # documents without a line get an empty one
    doc, starts, size = np.append(doc, lacking), np.append(starts, np.zeros(len(lacking), np.int64)), np.append(size, np.zeros(len(lacking), np.int64))
    order = np.lexsort((starts, doc))
    doc, starts, size = doc[order], starts[order], size[order]
    kinds = _CLASS[data]
    lead = data == 0xC3  # capital and small letters of Latin-1
    after = np.append(data[1:], 0)
    kinds[lead] = np.where(after[lead] < 0x9F, UPPER, LOWER)
    m = len(starts)
    counts = np.zeros((m, 8))
    for k in (UPPER, LOWER, DIGIT, END, MARK, BAR, SHOUT):
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        counts[:, k] = total[starts + size] - total[starts]
    spans = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(starts - spans[:-1], size) + np.arange(spans[-1])
    words, bounds = word_hashes(data[at], spans)
    n_words = np.diff(bounds)
    line = np.repeat(np.arange(m), n_words)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[same], minlength=m)
    by = np.lexsort((words, line))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[by][1:] != words[by][:-1]) | (line[by][1:] != line[by][:-1])
    distinct = np.bincount(line[by][fresh], minlength=m)
    letters = counts[:, UPPER] + counts[:, LOWER]
    w, b = np.maximum(n_words, 1), np.maximum(size, 1)
    own = np.stack([
        counts[:, UPPER] / np.maximum(letters, 1), counts[:, SHOUT] / w, counts[:, BAR] / w, counts[:, MARK] / w, counts[:, DIGIT] / b, counts[:, END] / w,
        repeats / w, np.where(n_words > 0, 1 - distinct / w, 0.0), letters / b, np.minimum(size / w, 30) / 10, np.log1p(size) / 5,
    ], 1)
    starts_at = np.searchsorted(doc, np.arange(n_docs + 1))
    before, behind = np.zeros_like(own), np.zeros_like(own)
    linked = doc[1:] == doc[:-1]
    before[1:][linked], behind[:-1][linked] = own[:-1][linked], own[1:][linked]
    return np.hstack([own, before, behind, np.ones((m, 1))]), size.astype(float), starts_at


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of any number of texts, a few MB at a time."""
    data, offsets = flat_bytes(texts)
    parts = [line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets)]
    lines = np.concatenate([[0], *(np.diff(at) for _, _, at in parts)])
    return np.vstack([x for x, _, _ in parts]), np.concatenate([size for _, size, _ in parts]), np.cumsum(lines)


@dataclass
class Field:
    """``weight``: log-odds of good from a line's inputs; ``step[a, b]``: of label b after a."""

    weight: np.ndarray
    step: np.ndarray
    map: tuple[float, float] = (0.0, 0.0)

    def quality(self, x: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        good, _ = marginals(x @ self.weight, self.step, at)
        share = np.maximum(size, 1e-9)
        total = np.add.reduceat(share, at[:-1]) if len(at) > 1 else np.zeros(0)
        return np.add.reduceat(share * good, at[:-1]) / total if len(at) > 1 else np.zeros(0)

    def score(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(quality, 1e-4, 1 - 1e-4)
        return sigmoid(self.map[0] * np.log(q / (1 - q)) + self.map[1])


def marginals(odds: np.ndarray, step: np.ndarray, at: np.ndarray, y: np.ndarray | None = None):
    """P(good) of every line by forward-backward, all documents side by side.

    With labels also: log-likelihood per document and the gradient of their sum by ``step``
    as (per document, 2, 2).
    """
    lens = np.diff(at)
    order = np.argsort(-lens, kind="stable")
    begin, lens = at[:-1][order], lens[order]
    longest = int(lens[0]) if len(lens) else 0
    active = [int(np.searchsorted(-lens, -t, side="left")) for t in range(longest)]  # documents with a line t
    e = np.exp(np.stack([np.minimum(-odds, 0), np.minimum(odds, 0)], 1))  # bad, good; the larger is 1
    trans = np.exp(step - step.max())
    fwd, scale = np.zeros((len(odds), 2)), np.ones(len(odds))
    for t in range(longest):
        i = begin[: active[t]] + t
        a = e[i] * (fwd[i - 1] @ trans if t else 1.0)
        scale[i] = a.sum(1)
        fwd[i] = a / scale[i, None]
    back = np.ones((len(odds), 2))
    expected = np.zeros((len(lens), 2, 2)) if y is not None else None
    for t in range(longest - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        ahead = e[i + 1] * back[i + 1] / scale[i + 1, None]
        if expected is not None:
            expected[: active[t + 1]] += fwd[i][:, :, None] * trans * ahead[:, None, :]
        back[i] = ahead @ trans.T
    p = fwd * back
    p /= p.sum(1, keepdims=True)
    if y is None:
        return p[:, 1], None
    inverse = np.argsort(order)
    per_line = np.where(y > 0.5, np.minimum(odds, 0), np.minimum(-odds, 0)) - np.log(scale)
    log = np.add.reduceat(per_line, at[:-1])
    links = np.diff(at) - 1
    label = (y[at[:-1]] > 0.5).astype(int)
    log += links * (step[label, label] - step.max())
    grad = -expected[inverse]
    grad[np.arange(len(label)), label, label] += links
    return p[:, 1], (log, grad)


@dataclass(frozen=True)
class Params:
    most: int = 2000
    ridge: float = 1e-3


def fit(texts: pa.Array, y: np.ndarray, totals: dict[int, int], p: Params = Params()) -> Field:
    if not len(y):
        return Field(np.zeros(3 * OWN + 1), np.zeros((2, 2)))
    x, size, at = features(texts)
    k = x.shape[1]
    per_doc = weights(y, totals) / len(y)
    line_y, line_doc = np.repeat(y, np.diff(at)), np.repeat(np.arange(len(y)), np.diff(at))
    per_doc = per_doc / np.sqrt(np.diff(at))  # long documents don't outweigh the rest

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, step = v[:k], v[k:].reshape(2, 2)
        good, (log, grad) = marginals(x @ w, step, at, line_y)
        value = -float(per_doc @ log) + p.ridge / 2 * float(v @ v)
        dw = -(x.T @ (per_doc[line_doc] * (line_y - good)))
        return value, np.append(dw, -np.tensordot(per_doc, grad, 1).ravel()) + p.ridge * v

    v = minimise(loss, np.zeros(k + 4))
    field = Field(v[:k], v[k:].reshape(2, 2))
    q = np.clip(field.quality(x, size, at), 1e-4, 1 - 1e-4)
    z, w8 = np.log(q / (1 - q)), weights(y, totals) / len(y)

    def platt(v: np.ndarray) -> tuple[float, np.ndarray]:
        t = v[0] * z + v[1]
        error = w8 * (sigmoid(t) - y)
        return float(w8 @ (np.logaddexp(0, t) - y * t)) + 1e-3 / 2 * float((v[0] - 1) ** 2), np.array([error @ z + 1e-3 * (v[0] - 1), error.sum()])

    a, b = minimise(platt, np.array([1.0, 0.0]))
    field.map = (float(a), float(b))
    return field


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Field:
    rows, totals = training_rows(docs, labels, "quality", p.most)
    return fit(rows["text"].combine_chunks(), np.array(rows["y"].to_pylist(), float), totals, p)


def scorer(field: Field) -> Callable[[pa.Array], np.ndarray]:
    return in_slices(lambda texts: field.score(field.quality(*features(texts))))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and score."""
    scored = scorer(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scored(b.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, field: Field, at: float = 0.3) -> DataFrame:
    """``docs`` that score ``at`` or more."""
    return filter_by_score(docs, scorer(field), lambda s: s >= at)
