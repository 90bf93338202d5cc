"""Token ids on disk: canonical length-limited Huffman codes, in blocks that decode on their own.

1. Texts are put in ascending order of doc_id by a range partitioning and encoded once; the ids wait in a folder.
2. ``count_ids``: global counts of the ids, summed in Spark; at most one row per vocabulary entry reaches the driver,
   where the package-merge method gives the best code lengths of at most ``MAX_LENGTH`` bits. The code is canonical, so
   its lengths are the whole table.
3. ``write``: ids are coded in shards of about ``SHARD_IDS``. A shard carries ids and lengths of its documents, the bit offset of every ``BLOCK``-th id
   (checkpoint), and the bits. Shards are rows of a Parquet folder with their place (part, number); lengths of the code
   are in a second folder beside it. Spark's committer makes writes atomic, so a lost executor leaves nothing behind.
4. ``read``: blocks of a shard are decoded side by side with one table of 2^MAX_LENGTH entries, starting from their
   checkpoints.

Shard layout, little-endian: magic ``DSTK``, version, documents, ids, block size; then doc ids (8 bytes each), null marks
(1), lengths (4), checkpoints (8), bits.

Defined cases: null and empty texts hold only the end id. A null doc_id comes last. Equal doc_ids are ordered by a hash
of their text. An empty table gives no shard and no row.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dealsift.llm import textkit as T, tokens
from dealsift.llm.tables import NULL_ID, documents, importable, parts, text_bytes

MAX_LENGTH = 18
BLOCK = 512
SHARD_IDS = 1 << 18
PART_BYTES = 16 << 20
_HEAD = struct.Struct("<4sIIQI")


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of the best prefix code with no code above ``limit`` bits; 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit in codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    # package-merge: each level offers the leaves and the pairs of the level below
    levels, weights = [], np.zeros(0, np.int64)
    for _ in range(limit):
        pairs = weights[:len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        weights = np.concatenate([leaves, pairs])
        order = np.argsort(weights, kind="stable")
        weights = weights[order]
        levels.append(np.cumsum(order < n))
    take = 2 * n - 2
    for leaf_count in reversed(levels):
        if take == 0:
            break
        k = int(leaf_count[take - 1])
        lengths[used[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the next number at its length."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        code <<= size - last
        last = size
        at = np.flatnonzero(lengths == size)
        codes[at] = np.arange(code, code + len(at), dtype=np.uint64)
        code += len(at)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every MAX_LENGTH bits: the id whose code they start with, and the length of that code."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (MAX_LENGTH - lengths[order].astype(np.int64))
    ids = np.repeat(order, span).astype(np.uint32)
    sizes = np.repeat(lengths[order], span).astype(np.int64)
    gap = (1 << MAX_LENGTH) - len(ids)
    return np.concatenate([ids, np.zeros(gap, np.uint32)]), np.concatenate([sizes, np.ones(gap, np.int64)])


def pack(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One shard."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ends) else 0
    # a code lies in at most two 32-bit words; codes do not overlap, so sums are their union
    shifted = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    n = (total >> 5) + 2
    bits = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n)
    bits += np.bincount(word + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    return b"".join([
        _HEAD.pack(b"DSTK", 1, len(doc_ids), len(ids), BLOCK), doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(),
        sizes.astype("<u4").tobytes(), at[::BLOCK].astype("<u8").tobytes(), bits.astype(np.uint64).astype(">u4").tobytes()])


def unpack(shard: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, doc ids, null marks and lengths of a shard."""
    magic, version, docs, count, block = _HEAD.unpack_from(shard)
    if magic != b"DSTK" or version != 1:
        raise ValueError("not a token shard")
    place = _HEAD.size

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(shard, kind, n, place)
        place += out.nbytes
        return out

    doc_ids, nulls, sizes = part("<i8", docs), part("u1", docs), part("<u4", docs)
    blocks = -(-count // block)
    at = part("<u8", blocks).astype(np.int64)
    data = np.frombuffer(shard, "u1", -1, place).astype(np.uint32)
    window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    ids = np.zeros((block, blocks), np.uint32)
    symbol, width = table
    full = blocks if count % block == 0 else blocks - 1
    for k in range(block):
        live = blocks if k < count - full * block else full
        if not live:
            break
        here = at[:live]
        bits = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - MAX_LENGTH)
        ids[k, :live] = symbol[bits]
        at[:live] = here + width[bits]
    return ids.T.reshape(-1)[:count], doc_ids, nulls, sizes


def _with_end(part, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice with ``end`` after each document."""
    ids, bounds = tokens.encode(part.column("text"), tokens.library(path))
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))


def _raw_shards(docs: DataFrame, path: str, end: int, part_bytes: int) -> DataFrame:
    """The ids of all documents in ascending order of doc_id, in shards not yet coded."""
    ranged = (docs.withColumn("place", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("tie", F.xxhash64("text"))
              .repartitionByRange(parts(text_bytes(docs), part_bytes, 8), "place", "tie").sortWithinPartitions("place", "tie"))

    def run(batches):
        task, number, before, count = TaskContext.get().partitionId(), 0, 0, 0
        waiting: list = []

        def shard():
            nonlocal number, before
            ids, doc, null, size = (np.concatenate(c) for c in zip(*waiting))
            # low and high bytes apart: the high ones compress
            planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            row = [task, number, before, len(ids), doc.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), size.astype("<u4").tobytes(), planes.tobytes()]
            number, before = number + 1, before + len(ids)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _RAW_TYPES)], _RAW_NAMES)

        for batch in batches:
            for part in T.slices(batch, limit=1 << 20):
                ids, bounds = _with_end(part, path, end)
                doc = part.column("doc_id")
                waiting.append((ids, doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), np.diff(bounds)))
                count += len(ids)
                if count >= SHARD_IDS:
                    yield shard()
                    count = 0
        if waiting:
            yield shard()

    return ranged.select("doc_id", "text").mapInArrow(run, _RAW)


_RAW = "part int, number int, before long, n_ids long, docs binary, nulls binary, sizes binary, ids binary"
_RAW_NAMES = [c.split()[0] for c in _RAW.split(", ")]
_RAW_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in _RAW.split(", ")]


def _ids(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def count_ids(raw: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for body in batch.column("ids"):
                found = np.bincount(_ids(body.as_py()), minlength=len(total))
                found[:len(total)] += total
                total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen.astype(np.int32)), "n": pa.array(total[seen])})

    rows = raw.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write(docs: DataFrame, path: str, folder: str, end: int = 2, part_bytes: int = PART_BYTES) -> None:
    """Write all documents as shards below ``folder``. Texts are encoded once; the ids wait in ``folder``/raw for the code."""
    table = documents(docs)
    spark = table.sparkSession
    _raw_shards(table, path, end, part_bytes).write.option("compression", "zstd").parquet(f"{folder}/raw")
    raw = spark.read.schema(_RAW).parquet(f"{folder}/raw")
    lengths = code_lengths(count_ids(raw))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/code")

    def run(batches):
        held, codes = np.frombuffer(lengths, np.uint8), canonical(lengths)
        for batch in batches:
            for k in range(len(batch)):
                doc, null, size, ids = (batch.column(c)[k].as_py() for c in ("docs", "nulls", "sizes", "ids"))
                shard = pack(_ids(ids), np.frombuffer(doc, "<i8"), np.frombuffer(null, np.uint8), np.frombuffer(size, "<u4"), held, codes)
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in _RAW_NAMES[:4]), pa.array([shard], pa.binary())], [*_RAW_NAMES[:4], "shard"])

    raw.mapInArrow(run, "part int, number int, before long, n_ids long, shard binary").write.parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and the ids themselves or their crc32."""
    importable(spark)
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/code").first().lengths, np.uint8)
    shards = spark.read.parquet(f"{folder}/shards")
    # one row per part: as many as tasks wrote, whatever the data
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sums.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(starts), "part").select((F.col("base") + F.col("before")).alias("base"), "shard")
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches):
        table = decoding_table(lengths)
        for batch in batches:
            for base, shard in zip(batch.column("base").to_pylist(), batch.column("shard")):
                ids, doc, null, size = unpack(shard.as_py(), table)
                ends = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
                raw = memoryview(ids.astype("<u4")).cast("B")
                out = (pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64()) if digest
                       else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(base + ends[:-1], pa.int64()), pa.array(size, pa.int64()), out],
                    ["doc_id", "start", "n_tokens", last.split()[0]])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
