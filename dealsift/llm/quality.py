"""Quality rules with risk-controlled thresholds.

Every document gets counts (word characters, symbols, repeated lines, words in repeated 5-word windows). The base rule
rejects short and repetitive texts. Beyond it, each signal has a fixed grid of cutoffs, and a cutoff may be used in a
stratum (the language) only if the labelled good documents there show that it rejects few of them: with k of n good
documents rejected, the exact binomial tail P(Bin(n, risk) <= k) must not exceed delta / (strata x signals x cutoffs).
That is the Clopper-Pearson upper bound with a Bonferroni correction over everything that is tested; the strictest
proven cutoff is used, none if none is proven. ``risk`` is the limit of false rejections per signal, so a stratum loses
at most signals x risk of its good documents, with confidence 1 - delta for all strata together.

The labelled documents are a holdout for this: the grid is fixed beforehand and nothing is fitted on them. All labelled
rows count, and only sums over (stratum, signal, cutoff) reach the driver.

Defined cases: null or blank text has no words and fails the base rule. Null language is a stratum of its own. A stratum
without labels has no proven cutoff, so only the base rule applies. Several label rows of one document count once, as
bad if any of them says so; null labels do not count.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsift.llm import textkit as T
from dealsift.llm.tables import documents

SYMBOLS = "#*$%&|<>"
RISK = 0.02
DELTA = 0.05

#: Fixed grids in parts per 1000: reject where the signal is above the cutoff; the strictest comes first.
SIGNALS = {
    "symbols": ("1000 * n_symbols", "word_chars", (5, 10, 20, 50, 100, 200, 400)),
    "dup_lines": ("1000 * n_dup_lines", "n_lines", (50, 100, 200, 300, 500, 700)),
    "repeats": ("1000 * n_repeat_words", "n_words", (20, 50, 100, 150)),
    "upper": ("1000 * n_upper", "word_chars", (150, 300, 500, 700)),
}

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS.encode())] = 1
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
COUNTS = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)


def _repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For equal (group, value): which entries are not alone, and which are not the first."""
    order = np.lexsort((value, group))
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = (group[order][1:] == group[order][:-1]) & (value[order][1:] == value[order][:-1])
    twice, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def _line_repeats(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word per text, and those of them that equal an earlier line."""
    n = len(bounds) - 1
    if not len(data):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = np.zeros(len(data), dtype=bool)
    first[1:] = data[:-1] == 10
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    begin = np.flatnonzero(first)
    # bytes + 1 keeps zero bytes and blanks in the hash; the line feed itself ends the line
    size = np.diff(begin, append=len(data))
    with np.errstate(over="ignore"):
        step = np.full(int(size.max()), T._STEP[1], dtype=np.uint64)
        step[0] = 1
        np.multiply.accumulate(step, out=step)
        table = T._odd(401, 256)
        table[10] = 0
        line = T.mix(np.add.reduceat(table[data] * step[np.arange(len(data)) - np.repeat(begin, size)], begin))
    filled = np.unique(np.searchsorted(begin, starts, side="right") - 1)
    doc = T.owner(bounds, begin[filled])
    later = _repeated(doc, line[filled])[1]
    return np.bincount(doc, minlength=n), np.bincount(doc[later], minlength=n)


def count(part) -> dict[str, np.ndarray]:
    """All counts of a slice of texts."""
    data, bounds = T.flat(part.column("text"))
    starts, ends, wb = T.words(data, bounds)
    n = len(part)
    total = lambda per_byte: np.diff(np.concatenate([[0], np.cumsum(per_byte)])[bounds])
    lines, dup_lines = _line_repeats(data, bounds, starts)
    windows = T.window_hashes(T.word_hashes(data, starts), 5)
    at = T.window_starts(wb, 5)
    twice = at[_repeated(T.owner(wb, at), windows[at])[0]]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.subtract.at(cover, twice + 5, 1)
    covered = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": np.diff(wb), "word_chars": total(~T.BLANK[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(T.owner(wb, np.flatnonzero(covered)), minlength=n),
        "n_lines": lines, "n_upper": total((data >= 65) & (data <= 90)),
    }


def counts(docs: DataFrame) -> DataFrame:
    """One row of counts per document, with its stratum."""
    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "stratum": part.column("lang"), **{k: pa.array(v, pa.int64()) for k, v in count(part).items()}})

    return documents(docs, F.col("lang").cast("string").alias("lang")).mapInArrow(run, COUNTS.replace("doc_id long,", "doc_id long, stratum string,"))


def base_failed():
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def over(signal: str, cutoff) -> str:
    value, base, _ = SIGNALS[signal]
    return f"{value} > {cutoff} * {base}"


def thresholds(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[str | None, str], int]:
    """The strictest proven cutoff by (stratum, signal).

    ``labelled``: counts of the good labelled documents that pass the base rule.
    """
    sums = [F.count(F.when(F.expr(over(s, c)), 1)).alias(f"{s}_{c}") for s, (_, _, grid) in SIGNALS.items() for c in grid]
    rows = labelled.groupBy("stratum").agg(F.count("*").alias("n"), *sums).collect()
    level = delta / max(1, len(rows) * sum(len(grid) for _, _, grid in SIGNALS.values()))
    found = {}
    for row in rows:
        for signal, (_, _, grid) in SIGNALS.items():
            for cutoff in grid:
                k = row[f"{signal}_{cutoff}"]
                if k < risk * row.n and tail(k, row.n, risk) <= level:
                    found[row.stratum, signal] = cutoff
                    break
    return found


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the first signal that rejects."""
    from dealsift.llm.tables import stored

    table = stored(counts(docs), "quality-counts")
    good = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
            .filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1"))
    found = thresholds(table.filter(~base_failed()).join(good, "doc_id", "left_semi"), risk, delta)
    why = F.lit(None).cast("string")
    for (stratum, signal), cutoff in sorted(found.items(), key=str):
        why = F.coalesce(why, F.when(F.col("stratum").eqNullSafe(F.lit(stratum)) & F.expr(over(signal, cutoff)), F.lit(signal)))
    out = table.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.when(~F.col("base_failed"), why))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
