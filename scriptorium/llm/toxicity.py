"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words and word beginnings (how often, and how often per
word) is fitted to labelled documents. Every labelled sentence that mentions an
identity term is written again with each other term of its group, and the loss
grows with the squared change of the score, so that a mention of a group by
itself moves no score. Labels, languages, sources and ids are not inputs.

Terms are listed for English, German, French and Spanish. Where no labelled
sentence mentions any, as in the given tables, there is nothing to swap and the
fit is a plain logistic one; ``Model.mentions`` and ``Model.swaps`` say how much
there was.

Null and empty texts have no words and get the model's base score; repeated
rows get equal scores; without any labels the score is 0.5 throughout (0 or 1
alone in the labels gives a constant near it). Texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._fit import filter_by_score, in_slices, minimise, sigmoid, training_rows, weights

#: Identity terms by language and group; within a group any term may stand for any other.
IDENTITY_TERMS = (
    # English
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("mother", "father"), ("wife", "husband"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"), ("old", "young"), ("disabled", "deaf", "blind"),
    # German
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("mutter", "vater"), ("weiblich", "männlich"),
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"), ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("christliche", "muslimische", "jüdische", "hinduistische", "buddhistische"), ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"), ("einwanderer", "flüchtlinge", "staatsbürger"), ("alte", "junge"), ("behinderte", "gehörlose", "blinde"),
    # French
    ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("mère", "père"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noir", "blanc", "asiatique", "africain", "européen"), ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("gay", "lesbienne", "bisexuel", "hétérosexuel"), ("immigré", "réfugié", "citoyen"), ("immigrés", "réfugiés", "citoyens"), ("vieux", "jeune"), ("handicapé", "sourd", "aveugle"),
    # Spanish
    ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"), ("madre", "padre"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negro", "blanco", "asiático", "africano", "europeo"), ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("gay", "lesbiana", "bisexual", "heterosexual"), ("inmigrante", "refugiado", "ciudadano"), ("inmigrantes", "refugiados", "ciudadanos"), ("viejo", "joven"), ("discapacitado", "sordo", "ciego"),
)


def _counterparts() -> dict[str, tuple[str, ...]]:
    """For each term all others of its groups, in the order in which they are listed."""
    out: dict[str, dict[str, None]] = {}
    for group in IDENTITY_TERMS:
        for t in group:
            out.setdefault(t, {}).update(dict.fromkeys(x for x in group if x != t))
    return {t: tuple(x) for t, x in out.items()}


GROUP = _counterparts()
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class Params:
    """``most`` labelled texts of each class at most; ``features`` chosen by their part in telling the classes apart."""

    most: int = 2500
    features: int = 1200
    least_docs: int = 5
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)
    ridge: float = 3e-4
    swap: float = 1.0


def grams(word: str, prefixes: tuple[int, ...]) -> list[str]:
    return ["=" + word, *(word[:k] for k in prefixes if len(word) > k)]


@dataclass
class Model:
    index: dict[str, int]
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prefixes: tuple[int, ...]
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)
    mentions: int = 0  # labelled sentences with an identity term
    swaps: int = 0  # their counterfactuals

    def counts(self, text: str | None) -> tuple[np.ndarray, int]:
        words = WORD.findall((text or "").lower())
        memo, hits = self.memo, []
        for w in words:
            got = memo.get(w)
            if got is None:
                got = tuple(self.index[g] for g in grams(w, self.prefixes) if g in self.index)
                if len(memo) >= 100_000:
                    memo.clear()
                memo[w] = got
            if got:
                hits.extend(got)
        return np.bincount(np.array(hits, np.int64), minlength=len(self.index)), len(words)

    def inputs(self, text: str | None) -> np.ndarray:
        c, n = self.counts(text)
        return np.concatenate((np.log1p(c), np.log1p(100.0 * c / max(n, 1))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        w = self.weight * self.scale
        return np.array([self.bias + self.inputs(t) @ w for t in texts], float)


def fit(texts: list[str | None], y: np.ndarray, totals: dict[int, int], p: Params = Params()) -> Model:
    def all_grams() -> Iterator[tuple[set[str], int]]:
        for t, label in zip(texts, y, strict=True):
            yield {g for w in set(WORD.findall((t or "").lower())) for g in grams(w, p.prefixes)}, int(label)

    often = np.zeros(1 << 20, np.int32)  # most grams are in one text only; they are never kept as strings
    for found, _ in all_grams():
        np.add.at(often, np.fromiter((hash(g) & 0xFFFFF for g in found), np.int64, len(found)), 1)
    seen = [Counter(), Counter()]
    for found, label in all_grams():
        seen[label].update(g for g in found if often[hash(g) & 0xFFFFF] >= p.least_docs)
    n = np.maximum(1, [(y == 0).sum(), (y == 1).sum()])
    part = {}
    for g in {*seen[0], *seen[1]}:
        a, b = seen[1][g], seen[0][g]
        if a + b >= p.least_docs:
            share = (a + b) / n.sum()
            part[g] = abs(a / n[1] - b / n[0]) / np.sqrt(share * (1 - share) + 1e-3)
    chosen = sorted(part, key=lambda g: (-part[g], g))[: p.features]
    del seen
    chosen += [f"={t}" for t in GROUP if f"={t}" in part and f"={t}" not in set(chosen)]
    model = Model({g: i for i, g in enumerate(chosen)}, np.ones(0), np.zeros(0), 0.0, p.prefixes)
    k = 2 * len(chosen)
    x = np.zeros((len(texts), k), np.float32)
    for i, t in enumerate(texts):
        x[i] = model.inputs(t)
    model.scale = (1 / np.maximum(x.std(0), 1e-2)) if len(texts) else np.ones(k)
    x *= model.scale.astype(np.float32)
    model.mentions, model.swaps, swaps = _swaps(model, texts)
    w8 = weights(y, totals) / max(len(y), 1)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = v[:-1], v[-1]
        z = x @ w.astype(np.float32) + b
        error = w8 * (sigmoid(z) - y)
        value = float(w8 @ (np.logaddexp(0, z) - y * z)) + p.ridge / 2 * float(w @ w)
        grad = np.append(x.T @ error.astype(np.float32) + p.ridge * w, error.sum())
        if swaps is not None:
            change = swaps @ w  # the mean of squared changes as a quadratic form
            value += p.swap / 2 * float(w @ change)
            grad[:-1] += p.swap * change
        return value, grad

    v = minimise(loss, np.zeros(k + 1)) if len(y) else np.zeros(k + 1)
    model.weight, model.bias = v[:-1], float(v[-1])
    model.memo.clear()
    return model


def _swaps(model: Model, texts: list[str | None], block: int = 512) -> tuple[int, int, np.ndarray | None]:
    """Labelled sentences with an identity term, counterfactuals that change an input, and the mean outer product of these changes.

    Changes are added up a block at a time, so memory follows the number of inputs, not that of mentions.
    """
    k, rows, changed, sentences = 2 * len(model.index), [], 0, 0
    total = np.zeros((k, k))

    def add() -> None:
        x = np.array(rows, np.float32) * model.scale.astype(np.float32)
        total[:] += x.T @ x
        rows.clear()

    for t in texts:
        for s in SENTENCE.findall((t or "").lower()):
            words = WORD.findall(s)
            terms = {w for w in words if w in GROUP}
            sentences += bool(terms)
            for term in sorted(terms):
                own = model.inputs(s)
                for other in GROUP[term]:
                    change = own - model.inputs(" ".join(other if w == term else w for w in words))
                    if change.any():
                        rows.append(change)
                        changed += 1
                        if len(rows) == block:
                            add()
    if rows:
        add()
    return sentences, changed, total / changed if changed else None


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    rows, totals = training_rows(docs, labels, "toxic", p.most)
    return fit(rows["text"].to_pylist(), np.array(rows["y"].to_pylist(), float), totals, p)


def scorer(model: Model) -> Callable[[pa.Array], np.ndarray]:
    """From texts to scores; what is sent to the executors is bounded by ``Params.features``."""
    parts = (model.index, model.scale, model.weight, model.bias, model.prefixes)
    made: list[Model] = []

    def run(texts: pa.Array) -> np.ndarray:
        if not made:
            made.append(Model(*parts))
        return sigmoid(made[0].score(texts.to_pylist()))

    return in_slices(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score."""
    scored = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scored(b.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def remove_toxic(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``at`` or more."""
    return filter_by_score(docs, scorer(model), lambda s: s < at)
