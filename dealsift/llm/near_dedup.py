"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on the full shingle sets.

1. Each document gets the set of its 5-word shingles (64-bit hashes; A-Z lower-cased) and a signature of ``HASHES``
   16-bit MinHash values. Equal sets are one class from here on, a node of the graph, so copies cost nothing.
2. Multi-index join: the signature is split into ``BANDS`` chunks of four values. Two signatures that differ in at most
   2 * BANDS - 1 = 31 of 64 values have, by pigeonhole, a chunk with at most one difference, so the four ways to leave
   one value out of a chunk are its keys: all pairs within the distance share a key. At a similarity of 0.75 the expected
   distance is 16; a pair lacks a common key with probability 5e-10.
3. Members of a key compare signatures. A pair belongs to the first key that both have, and goes on if it differs in at
   most ``NEAR`` values. Only documents with such a pair are fetched again, with their sets, one row per key.
4. In the key the pairs are confirmed exactly, 100 * intersection >= 75 * union. Pairs that confirmed links have already
   joined are not looked at, so a key gives fewer links than it has members, and no pair is lost for the components.
5. Components by star steps over the links between classes; each is then named by the smallest id in it.

Keys with many members are split: members form blocks of bounded weight, and each pair of blocks is a group of its own.

Defined cases: fewer than five words: the whole sequence is the one shingle. No word (null, empty, blank): an empty set,
linked with nothing, its own component. Null ids count as the largest id and are linked like others, each text for
itself. Rows with equal ids are all returned, with the component of their own text.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dealsift.llm import textkit as T
from dealsift.llm.components import components
from dealsift.llm.tables import NULL_ID, documents, stored

SHINGLE = 5
HASHES, CHUNK = 64, 4
BANDS = HASHES // CHUNK
KEYS = BANDS * CHUNK
NEAR = 36
BLOCK_ROWS = 4096
BLOCK_SHINGLES = 2 << 20

_FACTORS = T._odd(900, HASHES)


def shingle_sets(part) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text in a row, and the bounds of the texts."""
    data, bounds = T.flat(part.column("text"))
    data = T.LOWER[data]
    starts, _, wb = T.words(data, bounds)
    hashes = T.word_hashes(data, starts)
    at = T.window_starts(wb, SHINGLE)
    value, owner = T.window_hashes(hashes, SHINGLE)[at], T.owner(wb, at)
    n_words = np.diff(wb)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        with np.errstate(over="ignore"):
            # the length enters the hash, so a short text is no part of a longer one
            few = [T.mix(np.array([np.sum(hashes[wb[i]:wb[i + 1]] * T._WINDOW[1][:n_words[i]], dtype=np.uint64) + T._WINDOW[0][n_words[i] + 40]]))[0] for i in short]
        value, owner = np.concatenate([value, np.array(few, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(part) + 1))


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of every non-empty set, a row each."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), HASHES), np.uint16)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = (T.mix(np.minimum.reduceat(value * _FACTORS[k], starts)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The keys of every signature: for each chunk and left-out value, a hash of the other three and of their place."""
    out = np.empty((len(sig), KEYS), np.uint64)
    wide = sig.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(KEYS):
            chunk, gone = divmod(k, CHUNK)
            a, b, c = (chunk * CHUNK + i for i in range(CHUNK) if i != gone)
            code = (wide[:, a] << np.uint64(32)) | (wide[:, b] << np.uint64(16)) | wide[:, c] | (np.uint64(k) << np.uint64(48))
            out[:, k] = T.mix(code)
    return out.view(np.int64)


def _identity(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of every set, and sums of two mixes of its hashes: equal for equal sets."""
    with np.errstate(over="ignore"):
        sums = [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(value ^ salt), dtype=np.uint64)])[bounds]).view(np.int64)
                for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDEF01))]
    return np.diff(bounds).astype(np.int64), *sums


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, number of shingles, two sums that identify the set, and the signature."""
    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                value, bounds = shingle_sets(part)
                size, *sums = _identity(value, bounds)
                sig, raw = signatures(value, bounds), np.empty(len(part), object)
                for i, row in zip(np.flatnonzero(size), sig):
                    raw[i] = row.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n_shingles": pa.array(size, pa.int64()), "s1": pa.array(sums[0]), "s2": pa.array(sums[1]),
                    "sig": pa.array(raw, pa.binary())})

    return documents(docs, F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, sig binary")


def classes(profiles: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: a number for it, its smallest id, the hash of a text of that id, the signature.

    The numbers only hold for one evaluation, so the result is to be stored.
    """
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("rep"), "text_hash")).alias("first")
    return (profiles.filter("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(first, F.max("sig").alias("sig"))
            .select("n_shingles", "s1", "s2", F.monotonically_increasing_id().alias("node"), "first.rep", "first.text_hash", "sig"))


def _explode_keys(reps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
                keys = _chunk_keys(sig)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(keys.reshape(-1)), "k": pa.array(np.tile(np.arange(KEYS, dtype=np.int32), len(part))),
                    "node": pa.array(np.repeat(part.column("node").to_numpy(), KEYS)), "weight": pa.array(np.repeat(part.column("n_shingles").to_numpy(), KEYS))})

    return reps.select("node", "n_shingles", "sig").mapInArrow(run, "key long, k int, node long, weight long")


def blocks(members: DataFrame, weight, limit: int) -> DataFrame:
    """Members of a key, dealt to groups so that each pair of members meets: columns ``i``, ``j`` are the group in the key.

    A key lighter than ``limit`` is one group (0, 0). A heavier one is cut into blocks, each member goes to all groups of
    its block, and ``block`` says which block a member is of.
    """
    order = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    cut = members.withColumn("block", F.floor(F.coalesce(F.sum(weight).over(order), F.lit(0)) / limit).cast("int"))
    cut = cut.withColumn("blocks", F.max("block").over(Window.partitionBy("key")) + 1)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (cut.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            .drop("other", "blocks"))


def _first_key(same: np.ndarray) -> np.ndarray:
    """Index of the first key that each pair has in common, from which values agree (pairs x HASHES)."""
    same = same.reshape(-1, BANDS, CHUNK)
    agree = same.sum(2)
    chunk = (agree >= CHUNK - 1).argmax(1)
    values = same[np.arange(len(same)), chunk]
    # all four agree: the key without the first value; else the one without the odd value
    gone = np.where(agree[np.arange(len(same)), chunk] == CHUNK, 0, (~values).argmax(1))
    return chunk * CHUNK + gone


def _partners(sig: np.ndarray, block: np.ndarray, across: bool, k: int, size: np.ndarray):
    """For each member x: the later members whose pair with x belongs to key ``k`` and is near enough."""
    for x in range(len(sig) - 1):
        later = np.arange(x + 1, len(sig))
        if across:
            later = later[block[later] != block[x]]
        small, large = np.minimum(size[later], size[x]), np.maximum(size[later], size[x])
        later = later[100 * small >= 75 * large]
        if not len(later):
            continue
        same = sig[later] == sig[x]
        near = np.flatnonzero(HASHES - same.sum(1) <= NEAR)
        if len(near):
            near = near[_first_key(same[near]) == k]
        if len(near):
            yield x, later[near]


def needed(pairs_of: DataFrame) -> DataFrame:
    """The groups in which each member has a near partner."""
    def run(key, rows):
        rows = rows.combine_chunks()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        hit = np.zeros(len(rows), dtype=bool)
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        for x, others in _partners(sig, rows.column("block").to_numpy(), i != j, rows.column("k")[0].as_py(), rows.column("weight").to_numpy()):
            hit[x] = True
            hit[others] = True
        return rows.select(["key", "k", "node", "weight"]).filter(pa.array(hit))

    return pairs_of.groupBy("key", "i", "j").applyInArrow(run, "key long, k int, node long, weight long")


def _links(rows) -> tuple[list[int], list[int]]:
    """A spanning set of the confirmed links in a group."""
    ids = rows.column("node").to_numpy()
    sets = [np.frombuffer(b, np.uint64) for b in rows.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets])
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    for x, others in _partners(sig, rows.column("block").to_numpy(), i != j, rows.column("k")[0].as_py(), size):
        mine = root(x)
        others = [y for y in others.tolist() if root(y) != mine]
        for at in range(0, len(others), 256):
            some = others[at:at + 256]
            value = np.concatenate([sets[y] for y in some])
            place = np.minimum(np.searchsorted(sets[x], value), size[x] - 1)
            shared = np.add.reduceat(sets[x][place] == value, np.cumsum([0, *size[some][:-1]]), dtype=np.int64)
            for y, both in zip(some, shared.tolist()):
                if 100 * both >= 75 * (size[x] + size[y] - both) and root(y) != root(x):
                    parent[root(y)] = root(x)
                    a.append(int(ids[x]))
                    b.append(int(ids[y]))
    return a, b


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Confirmed links ``a``, ``b`` between classes, enough to connect all that is linked."""
    keys = _explode_keys(reps)
    size = Window.partitionBy("key")
    members = keys.withColumn("members", F.count("*").over(size)).filter("members > 1").drop("members")
    signed = members.join(reps.select("node", "sig"), "node")
    wanted = stored(needed(blocks(signed, F.lit(1), BLOCK_ROWS)).distinct(), "near-keys")
    # one visit to a text, whatever the number of its groups
    places = blocks(wanted, F.col("weight"), BLOCK_SHINGLES).groupBy("node").agg(F.collect_list(F.struct("key", "k", "i", "j", "block")).alias("places"))
    # an id may stand for several texts (null for any number), so the text of a class is found by id and hash
    places = places.join(reps.select("node", "rep", "text_hash"), "node")
    # the size of a stored table says little about its rows in memory, so this side is never planned as a broadcast
    texts = (docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("rep"), F.xxhash64("text").alias("text_hash"), "text").join(places.hint("merge"), ["rep", "text_hash"])
             .dropDuplicates(["rep", "text_hash"]))

    def fetch(batches):
        for batch in batches:
            for part in T.slices(batch):
                value, bounds = shingle_sets(part)
                sig, at = signatures(value, bounds), np.cumsum(np.diff(bounds) > 0) - 1
                lists = part.column("places")
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                for start in range(0, len(row), 256):
                    some = row[start:start + 256]
                    place = flat.slice(start, len(some))
                    yield pa.RecordBatch.from_pydict({
                        **{c: place.field(c) for c in ("key", "k", "i", "j", "block")}, "node": part.column("node").take(pa.array(some)),
                        "shingles": pa.array([value[bounds[r]:bounds[r + 1]].tobytes() for r in some], pa.binary()),
                        "sig": pa.array([sig[at[r]].tobytes() for r in some], pa.binary())})

    def confirm(key, rows):
        a, b = _links(rows.combine_chunks())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    fetched = texts.mapInArrow(fetch, "key long, k int, i int, j int, block int, node long, shingles binary, sig binary")
    return fetched.groupBy("key", "i", "j").applyInArrow(confirm, "a long, b long")


def _labelled(table: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every non-empty set with its smallest id (rep), the smallest id of its component, and whether it is the one set to keep."""
    reps = stored(classes(profiles), "near-classes")
    found = components(links(table, reps)).withColumnRenamed("component", "root")
    # ids that repeat with other texts must not mix: links are between sets, ids only name the components
    order = F.struct("rep", "n_shingles", "s1", "s2")
    linked = found.join(reps.select("node", order.alias("own")), "node")
    least = linked.groupBy("root").agg(F.min("own").alias("least"))
    named = linked.join(least, "root").select("node", "least")
    first = F.coalesce("least", order)
    return reps.join(named, "node", "left").select("n_shingles", "s1", "s2", "rep", first["rep"].alias("component"), (first == order).alias("first"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id is that id) for every row."""
    table = documents(docs)
    profiles = stored(profile(table), "near-profiles")
    joined = profiles.join(_labelled(table, profiles).drop("rep", "first"), ["n_shingles", "s1", "s2"], "left")
    component = F.coalesce(F.nullif(F.col("component"), F.lit(NULL_ID)), F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """A row of ``docs`` with the smallest id of each component, all columns; where several have it, one. Empty sets all stay."""
    table = documents(docs)
    profiles = stored(profile(table), "near-profiles")
    winners = _labelled(table, profiles).filter("first").select(
        F.col("n_shingles").alias("__n"), F.col("s1").alias("__s1"), F.col("s2").alias("__s2"), F.col("rep").alias("__rep"))

    def tag(batches):
        rows = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in T.slices(batch):
                size, s1, s2 = _identity(*shingle_sets(part))
                # an empty set is a key of its own, so that empty texts neither meet nor crowd one task
                s1 = np.where(size > 0, s1, rows + np.arange(len(part)))
                rows += len(part)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size), pa.array(s1), pa.array(s2)], [*part.schema.names, "__n", "__s1", "__s2"])

    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in ("__n", "__s1", "__s2"))])
    joined = docs.mapInArrow(tag, schema).join(winners, ["__n", "__s1", "__s2"], "left")
    first = joined.filter((F.col("__n") == 0) | (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("__rep")))
    return first.dropDuplicates(["__n", "__s1", "__s2"]).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM t UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
