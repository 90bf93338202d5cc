"""Benchmark decontamination: SimHash of item-sized windows, a multi-index Hamming join, and an exact check.

All of it is DataFrame and SQL expressions; only documents that may hold an item are looked at twice.

1. Words are lower-cased; shingles are hashes of five words. A window that is similar enough to an item shares at least
   ``least / (1 + least)`` of both their shingles with it. The items' shingles (small, broadcast) are looked up for every
   position of every text; from the positions found for an item, every start of a window that holds so many of them is
   listed, wherever they lie in the item: insertions, deletions and moved parts lose nothing.
2. Each of these windows and each item gets a 64-bit SimHash of its shingles, each counted as often as it occurs. The 64
   bits are split into ``BLOCKS`` = 13 blocks. Items are indexed under each block value and all values one bit away;
   fingerprints within ``RADIUS`` = 25 differ in at most one bit in some block by pigeonhole, so all pairs of equal length
   within the radius meet. At a similarity of 0.75 the expected distance is 11 with a deviation of 3.
3. Pairs within the radius are confirmed by the weighted shingle similarity: sum of the smaller count over sum of the
   larger count of each shingle, at least ``LEAST``.

Items are searched in slices whose broadcast tables stay below ``BROADCAST_BYTES``. The starts are written to the shared
folder and broadcast to the documents only below the same bound; beyond it both are shuffled.

Defined cases: null or short texts (under five words) contain nothing. Items of under five words or null text match
nothing. A text shorter than the item is one window. Null ids are kept as they are. ``find`` reports rows of equal ids as
one document; ``remove`` judges each row by its own text.
"""

from pyspark.sql import DataFrame, functions as F

from dealsift.llm.tables import stored

LEAST = 0.75
RADIUS = 25
BLOCKS = 13
BROADCAST_BYTES = 64 << 20
#: Bytes of a broadcast row: a shingle of an item, an index entry, a listed start.
_SHINGLE, _ENTRY, _START = 48, 48, 16

_WORDS = r"filter(split(lower(text), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def _shingles(table: DataFrame, *keys: str) -> DataFrame:
    """Keys, n (words), sh (hash of the five words from each position)."""
    # no filter here: it would be pushed down and repeat these expressions for every element of the lambda
    words = table.select(*keys, F.expr(f"coalesce(transform({_WORDS}, w -> xxhash64(w)), array())").alias("wh"))
    five = ", ".join(f"get(wh, i + {k})" for k in range(5))
    each = f"transform(sequence(0, size(wh) - 5), i -> xxhash64({five}))"
    return words.select(*keys, F.size("wh").alias("n"), F.expr(f"CASE WHEN size(wh) >= 5 THEN {each} ELSE array() END").alias("sh"))


def _simhash(array: str) -> str:
    """64-bit SimHash: each bit is the majority among the hashes, ties are 0. Never null, so no filter is derived from it."""
    return (f"coalesce(aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(CASE WHEN 2 * aggregate({array}, 0, (t, h) -> t + CAST(shiftright(h, b) & 1L AS int))"
            f" > size({array}) THEN 1L ELSE 0L END, b)), 0L)")


def _mask(block: int) -> int:
    low = 5 * block
    return ((1 << min(5, 64 - low)) - 1) << low


def _signed(value: int) -> str:
    return f"{value - (1 << 64) if value >= 1 << 63 else value}L"


def _similarity(a: str, b: str) -> str:
    """Weighted Jaccard of two arrays: counts of each value, smaller over larger."""
    count = lambda array: f"size(filter({array}, y -> y = x))"
    counted = f"aggregate(array_distinct({a}), 0, (t, x) -> t + least({count(a)}, {count(b)}))"
    both = f"CASE WHEN size(array_distinct({a})) = size({a}) THEN size(array_intersect({a}, {b})) ELSE {counted} END"
    return f"transform(array({both}), s -> s / (size({a}) + size({b}) - s))[0]"


def _starts(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """id, text_hash, m (shingles of the item) and all starts of windows that hold enough shingles of an item of that size."""
    probes = items.select("item_id", F.size("sh").alias("m"), F.explode_outer("sh").alias("h")).distinct()
    # outer explodes keep the planner from testing the arrays in a filter; null hashes end in the join
    found = _shingles(docs, "id", "text_hash").select("id", "text_hash", F.size("sh").alias("total"), F.posexplode_outer("sh").alias("pos", "h")).join(F.broadcast(probes), "h")
    need = f"CAST(ceil((m + least(m, total)) * {least / (1 + least)!r}D - 1e-9D) AS int)"
    held = found.groupBy("id", "text_hash", "item_id", "m", "total").agg(F.collect_set("pos").alias("p")).selectExpr(
        "id", "text_hash", "m", "total", f"{need} AS need", "array_sort(p) AS p").filter("size(p) >= need")
    # places i to i + need - 1 lie in a window exactly when it starts in this range
    low, high = "greatest(get(p, i + need - 1) - m + 1, 0)", "least(get(p, i), greatest(total - m, 0))"
    ranges = f"flatten(transform(sequence(0, size(p) - need), i -> CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE array() END))"
    each = held.select("id", "text_hash", "m", F.expr(f"array_distinct({ranges})").alias("starts"))
    return each.groupBy("id", "text_hash", "m").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def _windows(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """id, text_hash, length, start and shingles of every window that may be similar to an item."""
    starts = stored(_starts(docs, items, least), "decontamination-starts")
    listed = starts.agg(F.sum(F.size("starts") + 4)).first()[0] or 0
    right = (F.broadcast(starts) if listed * _START <= BROADCAST_BYTES else starts).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "m", "starts")
    met = docs.join(right, docs["id"].eqNullSafe(right["_id"]) & (docs["text_hash"] == right["_hash"])).drop("_id", "_hash")
    each = _shingles(met, "id", "text_hash", "m", "starts").select("id", "text_hash", "m", "sh", F.explode_outer("starts").alias("start"))
    return each.selectExpr("id", "text_hash", "m + 4 AS length", "start", "slice(sh, start + 1, m) AS sh")


def _search(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    print_of = lambda df: df.withColumn("fp", F.expr(_simhash("sh")))
    windows = print_of(_windows(docs, items, least))
    blocks = [f"struct({b} AS block, fp & {_signed(_mask(b))} AS value)" for b in range(BLOCKS)]
    near = [f"struct({b} AS block, (fp & {_signed(_mask(b))}) ^ {_signed(1 << bit)} AS value)" for b in range(BLOCKS) for bit in range(5 * b, min(5 * b + 5, 64))]
    index = print_of(items).select("item_id", F.col("n").alias("length"), F.col("fp").alias("item_fp"), F.explode_outer(F.expr(f"array({', '.join(blocks + near)})")).alias("key"))
    first = " ".join(f"WHEN bit_count((fp ^ item_fp) & {_signed(_mask(b))}) <= 1 THEN {b}" for b in range(BLOCKS))
    probes = windows.withColumn("key", F.explode_outer(F.expr(f"array({', '.join(blocks)})")))
    index = index.select("item_id", "length", "item_fp", F.col("key.block").alias("block"), F.col("key.value").alias("value"))
    probes = probes.select("id", "text_hash", "length", "start", "sh", "fp", F.col("key.block").alias("block"), F.col("key.value").alias("value"))
    pairs = (probes.join(F.broadcast(index), ["length", "block", "value"])
             .filter(f"bit_count(fp ^ item_fp) <= {RADIUS} AND block = CASE {first} END"))
    pairs = pairs.join(F.broadcast(items.select("item_id", F.col("sh").alias("item_sh"))), "item_id")
    judged = pairs.select("id", "text_hash", "item_id", "start", F.col("length").alias("n_words"), F.expr(_similarity("sh", "item_sh")).alias("similarity"))
    return judged.filter(F.col("similarity") >= least)


def _hits(docs: DataFrame, benchmark: DataFrame, least: float, broadcast_bytes: int) -> DataFrame:
    """Every window that is similar enough to an item: id, text_hash, item_id, start, n_words, similarity."""
    text = F.col("text").cast("string")
    table = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    # an item of several rows is one number: equal ids may hold different texts
    items = _shingles(benchmark.select("item_id", text.alias("text")).distinct(), "item_id", "text").withColumn("item_id", F.struct("item_id", F.xxhash64("text").alias("h"))).drop("text")
    items = items.filter(F.size("sh") > 0)
    size = items.agg(F.sum(F.size("sh") * _SHINGLE + (BLOCKS + 64) * _ENTRY)).first()[0] or 0
    cuts = -(-size // broadcast_bytes) or 1
    found = None
    for k in range(cuts):
        some = items if cuts == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(cuts)) == k)
        part = _search(table, some, least)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("item_id", F.col("item_id.item_id"))


def find(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, and the best window: similarity, start (word), n_words; one row per contaminated pair."""
    found = _hits(docs, benchmark, least, broadcast_bytes)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("best")
    return found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(best).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.s")).alias("start"), "best.n_words")


def remove(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` whose own text contains no item, whatever other rows have the same id or none."""
    found = _hits(docs, benchmark, least, broadcast_bytes).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"].cast("string")) == found["__hash"])
    return docs.join(found, same, "left_anti")
