"""Small tables with the awkward cases every text operator has to take, and plain versions of what operators compute."""

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, key string, block int, n_words string, stratum int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"p{i}" for i in range(60))


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}{'.' if pick.random() < 0.1 else ''}" for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    pick = random.Random(seed)
    return " ".join(f"x{seed}_{i}" if pick.random() < share else w for i, w in enumerate(text.split(" ")))


def texts() -> list[tuple[int | None, str | None]]:
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, copies and near copies."""
    base = prose(1, 300)
    rows = [(None, base), (None, "lonely words of a row without id"), (1, None), (2, ""), (3, " \n\t \r\n"), (4, "one two"), (5, "One TWO"), (6, "a b c d e"),
            (7, base), (8, base), (8, base), (9, edited(base, 9, 0.02)), (10, edited(base, 10, 0.04)), (11, edited(base, 11, 0.2)),
            (12, prose(12, 30_000, 20_000)), (13, prose(13, 40) + " " + PASSAGE + " " + prose(14, 40)), (14, PASSAGE + "\n" + prose(15, 50)), (15, "tab\tand\x0bvertical\x0cform feed\u00a0nbsp \u2003em"),
            (16, "x" * 5000), (17, "a a a a a a a a a a a a a a a a a a a a"), (18, prose(16, 12)), (19, prose(16, 13)), (20, prose(16, 13) + " tail"), (21, "É é ß İ Σας ΑΣ 日本語 🙂 <|endoftext|> it's I'LL")]
    return rows + [(100 + i, edited(base, 100 + i, 0.01 * (i % 20))) for i in range(40)] + [(200 + i, prose(200 + i, 80)) for i in range(20)]


def frame(spark: SparkSession, rows=None) -> DataFrame:
    """Documents with nulls in the other columns and extra columns whose names operators use inside."""
    rows = texts() if rows is None else rows
    data = [(i, t, None if k % 3 else "en", None if k % 4 else "s", None if t is None else len(t), 5, "key", 3, "n", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingles(text: str | None) -> set[tuple]:
    w = words(text, True)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
