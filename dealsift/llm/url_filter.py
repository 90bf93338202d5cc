"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Rules are (verdict, host, path start); the longest rule that fits wins. Where none fits, the model decides. It is
trained from a small labelled URL table (``LABELLED``, at most ``MAX_LABELLED`` rows) on the driver; weights are rounded
to whole numbers, so sums do not depend on their order. Scoring is native: n-grams, their buckets and the sum of weights
are expressions within the row, without a shuffle, and the weights are one literal array of fixed size.

The bucket of an n-gram is taken from its md5, which Python, Spark and other SQL engines compute alike.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, and is blocked: there is nothing to
fetch. A url with an empty host likewise. Null page ids and repeated rows are kept as they are.
"""

import hashlib
import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values: (verdict, host, path start).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

#: Small labelled table: (url, block).
LABELLED = [(f"https://{host}/{path}", block) for block, hosts, paths in [
    (1, ("spam-farm.example.org", "www.spam-farm.example.com", "cheap-pills.example.com", "www.cheap-pills.example.org", "pills-online.example.com",
         "casino-bonus.example.org", "win-casino.example.com", "free-money.example.org", "spam-links.example.com", "adult-cams.example.org", "casino-win.example.org", "free-bets.example.com", "ads-track.example.org", "track-ads.example.com",
         "m.cheap-pills.example.org", "blog.spam-farm.example.com", "best-casino.example.org", "cheap-loans.example.com", "xxx-videos.example.org"),
     ("en/100", "en/771.html", "fr/25/", "es/310?page=2")),
    (0, ("there.example.org", "www.hetion.example.com", "blog.thering.example.org", "m.ertion.example.com", "ththon.example.org",
         "news.example.org", "library.example.com", "www.university.example.org", "docs.software.example.com", "archive.example.org",
         "museum.example.com", "weather.example.org", "recipes.example.com", "m.science.example.org", "www.history.example.com",
         "therou.example.com", "thwhst.example.org", "ingedthe.example.com", "blog.andion.example.org", "www.oushthe.example.com"),
     ("en/100", "en/771.html", "fr/25/", "es/310?page=2", "de/44#top")),
] for host in hosts for path in paths]

MAX_LABELLED = 10_000
BUCKETS = 1024
SIZES = (3, 4, 5)
SCALE = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | None) -> tuple[str, str]:
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (match[1].translate(str.maketrans(_UPPER, _LOWER)), match[2]) if match else ("", "")


def grams(url: str | None) -> set[int]:
    """Buckets of the n-grams of ``^host path$``, each once. Digits count as one sign, so page numbers do not matter."""
    text = "^" + re.sub("[0-9]", "0", "".join(split_url(url))) + "$"
    return {int(hashlib.md5(text[i:i + n].encode()).hexdigest()[:8], 16) % BUCKETS for n in SIZES for i in range(len(text) - n + 1)}


def train(labelled, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[list[int], int]:
    """Logistic regression by gradient descent; whole-number weights of the buckets, and the bias."""
    rows = [(sorted(grams(url)), float(block)) for url, block in labelled]
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled urls")
    weights, bias = [0.0] * BUCKETS, 0.0
    share = [sum(y == c for _, y in rows) or 1 for c in (0.0, 1.0)]
    for _ in range(steps):
        step, shift = [0.0] * BUCKETS, 0.0
        for found, y in rows:
            z = bias + sum(weights[g] for g in found)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) / (2 * share[int(y)])
            shift += error
            for g in found:
                step[g] += error
        bias -= rate * shift
        weights = [w - rate * (s + decay * w) for w, s in zip(weights, step)]
    return [round(w * SCALE) for w in weights], round(bias * SCALE)


@lru_cache(1)
def default_model() -> tuple[list[int], int]:
    return train(LABELLED)


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule(rules=RULES) -> Column:
    """Text of the longest rule that fits the columns host and path."""
    out = F.lit(None).cast("string")
    for _, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start), name + start).otherwise(out)
    return out


def score(model: tuple[list[int], int]) -> Column:
    """Bias plus the weights of the distinct n-gram buckets of host and path."""
    weights, bias = model
    text = F.concat(F.lit("^"), F.regexp_replace(F.concat("host", "path"), "[0-9]", "0"), F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: (F.conv(F.substring(F.md5(F.substring(text, i, F.lit(n)).cast("binary")), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"))

    found = F.array_distinct(F.concat(*[of(n) for n in SIZES]))
    table = F.expr("array(" + ",".join(map(str, weights)) + ")")
    return F.aggregate(found, F.lit(bias).cast("long"), lambda total, g: total + F.get(table, g))


def judge(pages: DataFrame, rules=RULES, model: tuple[list[int], int] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    url = F.col("url").cast("string")
    split = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    verdicts = {name + start: verdict for verdict, name, start in rules}
    chosen = split.withColumn("rule", rule(rules))
    by_rule = F.lit(None).cast("string")
    for text, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == text, verdict).otherwise(by_rule)
    by_model = F.when((F.col("host") == "") | (score(model or default_model()) > 0), "block").otherwise("allow")
    return chosen.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_model).alias("verdict"))


def oracle(table: str = "pages", rules=RULES) -> str:
    """The same rows in SQL, with the trained weights as a list."""
    weights, bias = default_model()
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = " ".join(f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '{p}') THEN '{n}{p}'" for _, n, p in ordered)
    verdict = " ".join(f"WHEN rule = '{n}{p}' THEN '{v}'" for v, n, p in rules)
    each = " || ".join(
        f"list_transform(range(1, length(t) - {n} + 2), lambda i: ('0x' || md5(substr(t, i, {n}))[1:8])::BIGINT % {BUCKETS})" for n in SIZES)
    return f"""
WITH split AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                      coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM {table}),
chosen AS (SELECT *, CASE {case} END AS rule, '^' || regexp_replace(host || path, '[0-9]', '0', 'g') || '$' AS t FROM split),
scored AS (SELECT *, {bias} + list_sum(list_transform(list_distinct({each}), lambda g: {weights}[g + 1])) AS score FROM chosen)
SELECT page_id, host, path, rule,
       CASE {verdict} WHEN host = '' OR score > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM scored"""
