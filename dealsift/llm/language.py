"""Language identification: family first, then one-versus-one linear support vector machines within the family.

Features are relative frequencies of hashed byte 1- to 3-grams of the whole text (A-Z lower-cased). A softmax regression
over them predicts the language family; each pair of languages of one family has a linear SVM, and the language with the
most votes (ties: larger summed margin) wins. A language outside the table is a family of its own.

The model is fitted on a bounded sample, ``per_language`` documents of each language with the smallest hash of their id;
everything else covers all rows. Scores are linear, so prediction sums weights over the positions of a text and no
document needs a feature vector.

Defined cases: null text or text without a letter: ``und``, score 0. No labelled document: all ``und``. Null id: kept,
counts as not held out. Repeated rows: one prediction each.
"""

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dealsift.llm import textkit as T
from dealsift.llm.tables import documents

#: Languages by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "pa", "gu"),
    "semitic": ("ar", "he", "mt"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

BITS = 12
PER_LANGUAGE = 500
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    weights: np.ndarray  # (features + 1, families + pairs), the last row is the bias
    pairs: list[tuple[int, int]]


def held_out():
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _grams(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature of every position for n = 1, 2, 3, and the positions where the gram lies within its text."""
    size = (1 << BITS) - 1
    a = T.LOWER[data].astype(np.uint32)
    out = [(a & size, None)]
    code = a
    for n in (2, 3):
        if len(a) < n:
            break
        code = code[:-1] * np.uint32(257) + a[n - 1:]
        feature = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint32)
        inside = np.ones(len(feature), dtype=bool)
        for k in range(1, n):
            at = bounds[1:-1] - k
            inside[at[(at >= 0) & (at < len(feature))]] = False
        out.append((feature, inside))
    return out


def _vectors(batch) -> np.ndarray:
    """Relative frequencies, one row per text."""
    data, bounds = T.flat(batch.column("text"))
    row = np.repeat(np.arange(len(batch)), np.diff(bounds))
    counts = np.zeros(len(batch) << BITS)
    for feature, inside in _grams(data, bounds):
        cell = (row[:len(feature)] << BITS) + feature
        counts += np.bincount(cell if inside is None else cell[inside], minlength=len(counts))
    counts = counts.reshape(len(batch), 1 << BITS)
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _sample_vectors(batches):
    for batch in batches:
        for part in T.slices(batch, limit=1 << 20):
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "lang": part.column("lang"), "vector": pa.array([v.tobytes() for v in _vectors(part)], pa.binary())})


def _softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, rate: float = 1.0) -> np.ndarray:
    w = np.zeros((x.shape[1], classes))
    momentum = np.zeros_like(w)
    target = np.eye(classes)[y]
    weight = 1 / (np.bincount(y, minlength=classes)[y] * classes)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        momentum = 0.9 * momentum + x.T @ ((p - target) * weight[:, None])
        w -= rate * momentum
    return w


def _svm(x: np.ndarray, sign: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Dual coordinate descent for the squared-hinge linear SVM."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(1) + 1 / (2 * c)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            grad = sign[i] * (x[i] @ w) - 1 + alpha[i] / (2 * c)
            new = max(0.0, alpha[i] - grad / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                alpha[i] = new
    return w


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from documents that are not held out and have a language; at most ``per_language`` texts of each."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id").distinct()
    # at most per_language ids of each language
    rows = (known.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text", "lang")
            .mapInArrow(_sample_vectors, "doc_id long, lang string, vector binary").collect())
    rows = sorted({(r.lang, r.doc_id): r.vector for r in rows}.items())
    if not rows:
        return None
    langs = sorted({lang for (lang, _), _ in rows})
    y = np.array([langs.index(lang) for (lang, _), _ in rows])
    x = np.stack([np.frombuffer(v, np.float32) for _, v in rows]).astype(float)
    # columns on one scale, so that rare grams count; folded back into the weights
    scale = 1 / np.sqrt((x * x).mean(0) + 1e-8)
    x = np.hstack([x * scale / np.sqrt(len(scale)), np.ones((len(x), 1))])
    families = sorted({FAMILY_OF.get(lang, lang) for lang in langs})
    family = np.array([families.index(FAMILY_OF.get(lang, lang)) for lang in langs])
    pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if family[a] == family[b]]
    columns = [_softmax(x, family[y], len(families)) if len(families) > 1 else np.zeros((x.shape[1], 1))]
    for a, b in pairs:
        of = (y == a) | (y == b)
        columns.append(_svm(x[of], np.where(y[of] == a, 1.0, -1.0))[:, None])
    weights = np.hstack(columns)
    weights[:-1] *= scale[:, None] / np.sqrt(len(scale))
    return Model(langs, families, weights.astype(np.float32), pairs)


def _letters(part, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; texts with ASCII letters only need no look at the characters."""
    low = data | 32
    plain = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    has = plain[bounds[1:]] > plain[bounds[:-1]]
    texts = part.column("text")
    for i in np.flatnonzero(~has & (np.diff(bounds) > 0)):
        has[i] = any(c.isalpha() for c in texts[i].as_py())
    return has


def _judge(model: Model, part) -> tuple[list[str], np.ndarray]:
    data, bounds = T.flat(part.column("text"))
    n = len(part)
    sums, grams = np.zeros((n, model.weights.shape[1])), np.zeros(n)
    filled = np.flatnonzero(np.diff(bounds))
    for feature, inside in _grams(data, bounds):
        for c in range(sums.shape[1]):
            values = model.weights[:-1, c][feature]
            if inside is not None:
                values[~inside] = 0
            if len(values):
                at = filled[bounds[filled] < len(values)]
                sums[at, c] += np.add.reduceat(values.astype(np.float64), bounds[at])
        grams += np.diff(bounds) if inside is None else np.diff(np.concatenate([[0], np.cumsum(inside)])[np.minimum(bounds, len(inside))])
    z = sums / np.maximum(grams, 1)[:, None] + model.weights[-1]
    k = len(model.families)
    p = np.exp(z[:, :k] - z[:, :k].max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    # votes of the pairs count only in the family that was predicted
    votes, margin = np.zeros((n, len(model.langs))), np.zeros((n, len(model.langs)))
    for j, (a, b) in enumerate(model.pairs):
        m = z[:, k + j]
        votes[:, a] += m > 0
        votes[:, b] += m <= 0
        margin[:, a] += m
        margin[:, b] -= m
    family = np.array([model.families.index(FAMILY_OF.get(lang, lang)) for lang in model.langs])
    rank = np.where(family[None, :] == best[:, None], votes + 0.5 * margin / (1 + np.abs(margin)) / (1 + len(model.langs)), -1.0)
    lang = rank.argmax(1)
    peers = np.bincount(family, minlength=k)[best]
    inner = np.where(peers > 1, 1 / (1 + np.exp(-np.clip(2 * margin[np.arange(n), lang] / np.maximum(peers - 1, 1), -50, 50))), 1.0)
    has = _letters(part, data, bounds)
    return [model.langs[i] if ok else UNKNOWN for i, ok in zip(lang, has)], np.where(has, p[np.arange(n), best] * inner, 0.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row; lang, source and doc_id are no inputs of a prediction."""
    base = documents(docs)
    if model is None:
        return base.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                langs, score = _judge(model, part)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64())})

    return base.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on the documents that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    table = documents(docs, F.col("lang").cast("string").alias("lang"))
    return predict(table, fit(table, per_language)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of at least ``least``; all columns stay.

    Rejected are texts without a letter. With two families of two languages every other score is at least 0.25, so junk
    and unknown languages pass the default; more languages let scores fall below it. The verdict travels with its row, so no
    join on ids is needed and repeated ids are no problem. With no labelled document nothing is rejected.
    """
    table = documents(docs, F.col("lang").cast("string").alias("lang"))
    model = fit(table, per_language)
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                langs, score = _judge(model, part.select(["text"]))
                yield part.filter(pa.array((np.array(langs) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
