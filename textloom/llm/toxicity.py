"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and word beginnings. Counterfactuals of each training text are made by
swapping mentions of groups of people, and the squared change of the score between text and counterfactual is part of the
loss, so the mention itself carries no weight. Texts that mention a group are swapped as they stand. Labelled corpora
may hold few such texts, so every text also gets a neutral mention chosen by its id, which is swapped within its kind, for
one of another kind and for none; half of the texts are fitted with that mention in place, label unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import documents, quoted, written

#: Kinds of neutral group mentions; terms of one kind are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("muslims", "christians", "jews", "hindus", "buddhists"), ("immigrants", "locals"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
#: Labelled rows of each class, in expectation, that the model is fitted on.
SAMPLE_PER_CLASS = 2500
#: Features kept, by chi-square on the sample, and the least texts of the sample that hold one.
FEATURES, MIN_TEXTS = 1500, 4
#: Lengths of the word beginnings that are features besides whole words.
PREFIXES = (4, 5)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()) if text else set()


def features_of_word(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def swaps(terms=IDENTITY_TERMS) -> dict[bytes, bytes]:
    """Each term's counterfactual: the next of its kind."""
    return {a.encode(): b.encode() for kind in terms for a, b in zip(kind, [*kind[1:], kind[0]], strict=True)}


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float

    def score(self, words: set[bytes], known: dict[bytes, tuple]) -> float:
        """known: the model's features of the words seen so far."""
        present: set[bytes] = set()
        for w in words:
            found = known.get(w)
            if found is None:
                found = tuple(f for f in features_of_word(w) if f in self.weights)
                if len(known) >= 500_000:
                    known.clear()
                known[w] = found
            if found:
                present.update(found)
        x = self.bias + sum(self.weights[f] for f in sorted(present))
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def objective(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, gram: np.ndarray, shrink: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The loss and its gradient. gram: the mean outer product of the changes, so w gram w is the mean squared change."""
    z = np.clip(x @ w, -30, 30)
    pulled = gram @ w
    value = float(weight @ (np.logaddexp(0, z) - y * z) + penalty * (w @ pulled) + (shrink * w) @ w / 2)
    return value, x.T @ (weight * (1 / (1 + np.exp(-z)) - y)) + 2 * penalty * pulled + shrink * w


def fit_gram(x: np.ndarray, y: np.ndarray, gram: np.ndarray, l2: float = 1e-4, penalty: float = 1.0, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on objective().

    Both classes weigh the same, however many rows each has.
    """
    weight = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum())).astype(np.float32)
    x, y = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1), y.astype(np.float32)  # the last column is the bias
    gram = np.pad(gram, (0, 1)).astype(np.float32)
    shrink = np.full(x.shape[1], l2, np.float32)
    shrink[-1] = 0
    # The step follows from the largest curvature, found by power iteration.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        v = 0.25 * (x.T @ (weight * (x @ v))) + 2 * np.float32(penalty) * (gram @ v) + shrink * v
        top = float(np.linalg.norm(v))
        v = v / top
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        _, gradient = objective(ahead, x, y, weight, gram, shrink, np.float32(penalty))
        last, w = w, ahead - gradient / np.float32(1.05 * top)
        ahead = w + np.float32(k / (k + 3)) * (w - last)
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, swapped: np.ndarray, l2: float = 1e-4, penalty: float = 1.0, steps: int = 800) -> tuple[np.ndarray, float]:
    """fit_gram() for rows of changes: swapped holds x minus its counterfactual."""
    return fit_gram(x, y, swapped.T @ swapped / max(1, len(swapped)), l2, penalty, steps)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", terms=IDENTITY_TERMS, per_class: int = SAMPLE_PER_CLASS, penalty: float = 1.0) -> ToxicityModel:
    """The model fitted on the rows of docs that labels marks 0 or 1; other labels and null texts are left out.

    About per_class rows of each class are used, chosen by a hash of the id; their features come to the driver, which
    holds a matrix of at most that many rows and FEATURES columns beside those of terms. Without rows of both classes
    the model scores every text with the share of positive labels (0.5 if there are none). ValueError for a penalty
    without terms, as its part of the loss would be empty.
    """
    if penalty and not any(len(kind) > 1 for kind in terms):
        raise ValueError("a counterfactual penalty needs kinds of two terms or more")
    marks = labels.select(quoted(label_id_col).cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return ToxicityModel({}, float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = marks.where(chance < F.when(F.col("y") == 1, per_class / counts[1]).otherwise(per_class / counts[0]))
    sample = written(documents(docs, id_col, text_col).where("text is not null").join(F.broadcast(picked), "doc_id"), "toxicity-sample")  # broadcast: a bounded sample
    classes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return ToxicityModel({}, float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    names = sorted({*_best_features(sample, classes), *(t.encode() for kind in terms for t in kind)})
    x, y, gram = training_rows(sample, names, terms)
    w, b = fit_gram(x, y, gram, penalty=penalty)
    return ToxicityModel({f: float(v) for f, v in zip(names, w, strict=True) if v}, float(b))


def training_rows(sample: DataFrame, names: list[bytes], terms=IDENTITY_TERMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of (doc_id, y, text), and the mean outer product of all changes under swaps."""
    rows = sorted(_as_columns(sample, names, terms).collect(), key=lambda r: (r.doc_id, r.y, r.own))
    x, y = np.zeros((len(rows), len(names)), np.float32), np.array([r.y for r in rows], float)
    gram, changes = np.zeros((len(names), len(names)), np.float32), 0
    for i, r in enumerate(rows):
        own, here = set(r.own), set(r.mention) - set(r.own)
        x[i, r.own] = 1
        if r.doc_id % 2:
            x[i, list(here)] = 1
        pairs = [(here, set(other) - own) for other in (r.near, r.far, [])]
        if r.swapped is not None:
            pairs.append((own - set(r.swapped), set(r.swapped) - own))
        for a, b in pairs:
            more, less = sorted(a - b), sorted(b - a)
            value = np.array([1.0] * len(more) + [-1.0] * len(less), np.float32)
            gram[np.ix_(more + less, more + less)] += np.outer(value, value)
            changes += 1
    return x, y, gram / max(1, changes)


def _best_features(sample: DataFrame, classes: dict[int, int]) -> list[bytes]:
    """The FEATURES features of the largest chi-square, counted on the executors."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column("y"), batch.column("text"), strict=True):
                found = sorted({f for w in words_of(text.as_py()) for f in features_of_word(w)})
                yield pa.record_batch([pa.array(found, pa.binary()), pa.array([y.as_py()] * len(found), pa.int32())], ["feature", "y"])

    held = sample.select("y", "text").mapInArrow(features, "feature binary, y int").groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    c, d = classes[1] - F.col("a"), classes[0] - F.col("b")
    chi = (F.col("a") * d - F.col("b") * c).cast("double") ** 2 / ((F.col("a") + F.col("b")) * F.greatest(F.lit(1), c + d))
    best = held.where(F.col("a") + F.col("b") >= MIN_TEXTS).orderBy(chi.desc(), "feature").limit(FEATURES)
    return sorted(bytes(r.feature) for r in best.select("feature").collect())


def _as_columns(sample: DataFrame, names: list[bytes], terms) -> DataFrame:
    """doc_id, y and numbers of features: own, those of the text with its mentions swapped (null without any), those of a
    mention chosen by the id, of the next of its kind (near) and of one of another kind (far)."""
    column, swap = {f: k for k, f in enumerate(names)}, swaps(terms)
    flat = [(k, t.encode()) for k, kind in enumerate(terms) for t in kind]
    fields = ("own", "swapped", "mention", "near", "far")

    def numbers(words) -> list[int]:
        return sorted({column[f] for w in words for f in features_of_word(w) if f in column})

    def mentions(doc_id: int) -> list[list[int]]:
        if not flat:
            return [[], [], []]
        h = xxhash.xxh3_64_intdigest(str(doc_id).encode())
        kind, term = flat[h % len(flat)]
        others = [t for k, t in flat if k != kind] or [term]
        return [numbers([t]) for t in (term, swap[term], others[h // len(flat) % len(others)])]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                swapped = None if swap.keys().isdisjoint(words) else numbers({swap.get(w, w) for w in words})
                made.append((numbers(words), swapped, *mentions(doc_id.as_py())))
            lists = [pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in range(len(fields))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), *lists], ["doc_id", "y", *fields])

    return sample.select("doc_id", "y", "text").mapInArrow(gather, "doc_id long, y int, " + ", ".join(f"{f} array<int>" for f in fields))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and score in 0 to 1 of the whole text; null is scored as empty. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            scores = [shared.value.score(words_of(t.as_py()), known) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return documents(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")
