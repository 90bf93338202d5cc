"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered, 0 (clean) to G - 1. One weight vector serves all thresholds: P(grade > g) = sigmoid(w.x - t[g]) with
increasing t, and the output is the expected severity, the sum of these probabilities. Features are hashed lower-cased
words, present or not. From a bounded labelled sample (``per_class`` documents of each label with the smallest hash of
their id) the words are chosen whose tie to the label is proven: with a chance of 95 %, no word without a tie is among
them (Bonferroni over all words tested; copies count once). All such words are taken, or the surest ``features`` of them.
Without any, the surest word is. Weights and thresholds are fitted by gradient descent with the classes at equal weight; the thresholds are then shifted to the share of toxic rows among all labels. A document
counts as toxic from the score on that separates the sampled labels best; its grade is then the likeliest one above 0, and
0 for all others.

The labels say toxic or not. Severity among toxic documents is taken from how many distinct chosen toxic words a document
has: grade 1 up to the median, grade 2 above it.

Defined cases: null, empty or blank text has no feature and gets the prior severity. Without labels of both kinds all
severities are 0. Several label rows of one document count once, as toxic if any says so. Null ids are kept.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsift.llm import textkit as T
from dealsift.llm.tables import documents

BITS = 20
PER_CLASS = 3000
LEAST_DOCS = 5
CHANCE = 0.05  # that any word without a tie to the label is chosen


@dataclass
class Model:
    index: np.ndarray  # bucket -> feature + 1, 0 for none
    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float  # toxic from this score on


def _word_buckets(part) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word with a letter run, punctuation at its ends ignored, and the text of each."""
    data, bounds = T.flat(part.column("text"))
    data = T.LOWER[data]
    # ASCII signs separate like blanks, so "word," and "word" are one feature
    letters = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    data = np.where(letters, data, np.uint8(32))
    starts, _, wb = T.words(data, bounds)
    bucket = (T.word_hashes(data, starts) >> np.uint64(64 - BITS)).astype(np.int64)
    return bucket, np.repeat(np.arange(len(part)), np.diff(wb))


def _sample_features(batches):
    for batch in batches:
        for part in T.slices(batch):
            bucket, doc = _word_buckets(part)
            cells = np.unique((doc << BITS) | bucket)
            cut = np.searchsorted(cells, np.arange(len(part) + 1) << BITS)
            found = (cells & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "toxic": part.column("toxic"),
                "found": pa.array([found[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def _fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, steps: int = 600, rate: float = 1.0, decay: float = 1e-4):
    """Weights and increasing thresholds by gradient descent on the cumulative-link likelihood."""
    weight = 1 / (np.bincount(grade, minlength=grades).clip(1)[grade] * len(np.unique(grade)))
    w = np.zeros(x.shape[1])
    base, gaps = 0.0, np.zeros(grades - 2)
    momentum = [np.zeros_like(w), 0.0, np.zeros_like(gaps)]
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(steps):
        t = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = x @ w
        cuts = np.concatenate([[-np.inf], t, [np.inf]])
        # P(grade <= g) at the upper and lower cut of each row's grade
        up, low = cuts[grade + 1] - z, cuts[grade] - z
        f_up, f_low = np.where(np.isinf(up), 1.0, logistic(up)), np.where(np.isinf(low), 0.0, logistic(low))
        p = np.maximum(f_up - f_low, 1e-9)
        d_up, d_low = f_up * (1 - f_up) / p * weight, f_low * (1 - f_low) / p * weight
        grad_w = x.T @ (d_up - d_low) + decay * w
        grad_t = np.array([d_low[grade == g + 1].sum() - d_up[grade == g].sum() for g in range(grades - 1)])
        grad_gaps = np.array([grad_t[k + 1:].sum() for k in range(grades - 2)]) * np.exp(gaps)
        for k, grad in enumerate((grad_w, grad_t.sum(), grad_gaps)):
            momentum[k] = 0.9 * momentum[k] + grad
        w -= rate * momentum[0]
        base -= rate * momentum[1]
        gaps = np.clip(gaps - rate * momentum[2], -3, 3)
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _gain(count: list[np.ndarray], total: list[int]) -> np.ndarray:
    """Likelihood gain of every word for the label, negative where it speaks for clean.

    A word that is in ``m`` documents whatever their label has as large a gain ``g`` in one direction with a chance of at
    most exp(-g) (Chernoff, also for draws without replacement), rare or common, at any balance of the labels.
    """
    m, share = count[0] + count[1], total[1] / (total[0] + total[1])
    of = count[1] / np.maximum(m, 1)
    part = lambda x, y: x * np.log(np.where(x > 0, x, 1) / y)
    return np.sign(of - share) * m * (part(of, share) + part(1 - of, 1 - share))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int | None = None) -> Model | None:
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    shares = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        return None
    clean, bad = (marks.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in ("toxic = 0", "toxic > 0"))
    chosen = clean.unionByName(bad)
    table = documents(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # at most 2 * per_class ids
    rows = table.join(F.broadcast(chosen), "doc_id").mapInArrow(_sample_features, "doc_id long, toxic int, found binary").collect()
    rows = sorted({r.doc_id: (int(r.toxic > 0), np.frombuffer(r.found, np.int32)) for r in rows}.items())
    toxic = np.array([t for _, (t, _) in rows])
    if len(set(toxic)) < 2:
        return None
    count = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    # a copy is no further evidence for its words
    sets = {(t, found.tobytes()): found for _, (t, found) in rows}
    for (t, _), found in sets.items():
        count[t][found] += 1
    total = [sum(t == c for t, _ in sets) for c in (0, 1)]
    tested = (count[0] + count[1]) >= min(LEAST_DOCS, total[1])
    gain = np.where(tested, _gain(count, total), 0)
    picked = np.argsort(-np.abs(gain), kind="stable")[:features]
    # the bound of a chance word, for each of the words tested and both directions
    proven = np.abs(gain[picked]) > np.log(2 * tested.sum() / CHANCE)
    picked = picked[proven] if proven.any() else picked[:1]
    index = np.zeros(1 << BITS, np.int32)
    index[picked] = np.arange(1, len(picked) + 1)
    x = np.zeros((len(rows), len(picked)))
    for i, (_, (_, found)) in enumerate(rows):
        hit = index[found]
        x[i, hit[hit > 0] - 1] = 1
    strong = x[:, gain[picked] > 0].sum(1)
    middle = np.median(strong[toxic == 1])
    grade = np.where(toxic == 1, 1 + (strong > middle), 0)
    grades = int(grade.max()) + 1
    w, t = _fit_ordinal(x, grade, max(grades, 2))
    # fitted with grades at equal weight; move to their share among all labels
    above = np.array([(grade > g).sum() / max(1, (toxic == 1).sum()) for g in range(len(t))]) * sum(n for c, n in shares.items() if c > 0) / sum(shares.values())
    even = np.array([(len(t) - g) / (len(t) + 1) for g in range(len(t))])
    t = t + np.log(even / (1 - even)) - np.log(np.clip(above, 1e-6, 1 - 1e-6) / (1 - np.clip(above, 1e-6, 1 - 1e-6)))
    return Model(index, w, np.maximum.accumulate(t), _cutoff(x @ w, toxic, shares))


def _cutoff(z: np.ndarray, toxic: np.ndarray, shares: dict) -> float:
    """The score that separates the labels best (F1 at their share among all labels), halfway between two rows."""
    order = np.argsort(-z, kind="stable")
    z, toxic = z[order], toxic[order]
    bad = sum(n for c, n in shares.items() if c > 0)
    hit = np.cumsum(toxic) / toxic.sum() * bad
    wrong = np.cumsum(1 - toxic) / (1 - toxic).sum() * (sum(shares.values()) - bad)
    last = np.append(z[1:] < z[:-1], True)
    best = int(np.argmax(np.where(last, 2 * hit / (hit + wrong + bad), -1)))
    return float((z[best] + (z[best + 1] if best + 1 < len(z) else z[best] - 1)) / 2)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, expected severity (0 to G - 1), grade, and whether the document counts as toxic."""
    table = documents(docs)
    if model is None:
        return table.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^20 buckets of 4 bytes, whatever the data

    def run(batches):
        m = held.value
        for batch in batches:
            for part in T.slices(batch):
                bucket, doc = _word_buckets(part)
                feature = m.index[bucket]
                at = np.flatnonzero(feature)
                cells = np.unique(doc[at] * (len(m.weights) + 1) + feature[at])
                z = np.bincount(cells // (len(m.weights) + 1), weights=m.weights[cells % (len(m.weights) + 1) - 1], minlength=len(part))
                above = 1 / (1 + np.exp(-np.clip(z[:, None] - m.thresholds[None, :], -30, 30)))
                toxic = z >= m.cutoff
                p = -np.diff(np.hstack([np.ones((len(part), 1)), above, np.zeros((len(part), 1))]), axis=1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "severity": pa.array(above.sum(1)), "toxic": pa.array(toxic),
                    "grade": pa.array(np.where(toxic, 1 + p[:, 1:].argmax(1), 0).astype(np.int32))})

    return table.mapInArrow(run, "doc_id long, severity double, toxic boolean, grade int").select("doc_id", "severity", "grade", "toxic")


def grade(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int | None = None) -> DataFrame:
    return score(docs, fit(docs, labels, per_class, features))
