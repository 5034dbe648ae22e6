"""Token ids in sharded binary payloads with a minimal perfect hash index over document keys.

A store is a Parquet folder. A row is a block: the ids of consecutive documents, in ascending
order of doc_id, as one little-endian payload, plus the index of the block. A shard is what one
task wrote; shards follow one another in key order, blocks within them.

The index of a block is a cascade of bit arrays: at each level the keys still unplaced hash to
places, a place hit by one key alone gets its bit, and the rank of a key's bit is its slot. `n` keys
fill slots 0 to n-1 without gaps, at about three bits a key. A slot holds a 32-bit fingerprint of
its key, the key's first row in the block and its number of rows (documents may repeat an id), so a
lookup reads one slot, compares one fingerprint and slices the payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backhaul.llm.encoding import END, encoder, vocabulary_path
from backhaul.llm.scratch import shuffles_removed
from backhaul.llm.words import buffers, mix, slices

BLOCK_IDS = 1 << 19
_LEVELS, _GAMMA = 40, 1.6
_SEED = np.uint64(0x9E3779B97F4A7C15)
_NO_FINGERPRINT = 0xA5A5A5A5A5A5A5A5

BLOCK = (
    "shard int, block int, shard_start long, first_key long, last_key long, null_rows int, n_docs long, n_ids long,"
    " width int, keys binary, mph binary, slots binary, bounds binary, payload binary"
)
SLOT = np.dtype([("fingerprint", "<u4"), ("row", "<u4"), ("rows", "<u4")])


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(level * int(_SEED) % (1 << 64))
    return (mix(hashes + salt) % np.uint64(size)).astype(np.int64)


def build_mph(hashes: np.ndarray) -> bytes:
    """Cascade over distinct 64-bit hashes; keys left after the last level are listed at the end."""
    levels, left = [], hashes
    while len(left) and len(levels) < _LEVELS:
        size = max(8, int(len(left) * _GAMMA))
        place = _place(left, len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        levels.append((size, np.packbits(alone)))
        left = left[~alone[place]]
    head = struct.pack("<II", len(levels), len(left)) + struct.pack(f"<{len(levels)}I", *[s for s, _ in levels])
    return head + b"".join(bits.tobytes() for _, bits in levels) + np.sort(left).astype("<u8").tobytes()


def mph_slots(mph: bytes, hashes: np.ndarray) -> np.ndarray:
    """Slot of each hash; -1 where no level has its bit (then it is no key of the index)."""
    n, rest = struct.unpack_from("<II", mph)
    sizes = struct.unpack_from(f"<{n}I", mph, 8)
    at, before = 8 + 4 * n, 0
    out = np.full(len(hashes), -1, np.int64)
    open_ = np.arange(len(hashes))
    for level, size in enumerate(sizes):
        packed = np.frombuffer(mph, np.uint8, (size + 7) // 8, at)
        at += len(packed)
        bits = np.unpackbits(packed, count=size).astype(bool)
        rank = np.cumsum(bits)
        place = _place(hashes[open_], level, size)
        hit = bits[place]
        out[open_[hit]] = before + rank[place[hit]] - 1
        before += int(rank[-1])
        open_ = open_[~hit]
    if rest and len(open_):
        listed = np.frombuffer(mph, "<u8", rest, at)
        i = np.searchsorted(listed, hashes[open_])
        found = listed[np.minimum(i, rest - 1)] == hashes[open_]
        out[open_[found]] = before + i[found]
    return out


def _hashes(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + _SEED)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(_NO_FINGERPRINT)) >> np.uint64(32)).astype(np.uint32)


def index_block(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Index of a block's sorted keys: the cascade and its slots."""
    distinct, row, rows = np.unique(keys, return_index=True, return_counts=True)
    hashes = _hashes(distinct)
    mph = build_mph(hashes)
    slots = np.zeros(len(distinct), SLOT)
    at = mph_slots(mph, hashes)
    slots["fingerprint"][at] = _fingerprints(distinct)
    slots["row"][at], slots["rows"][at] = row, rows
    return mph, slots.tobytes()


def find(mph: bytes, slots: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each key in a block; 0 rows for keys it does not hold."""
    table = np.frombuffer(slots, SLOT)
    at = mph_slots(mph, _hashes(keys))
    if len(table) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    ok = (at >= 0) & (table["fingerprint"][at] == _fingerprints(keys))
    return np.where(ok, table["row"][at], 0).astype(np.int64), np.where(ok, table["rows"][at], 0).astype(np.int64)


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append the end id, and write the ids in ascending order of doc_id.

    A null or blank text has the end id only. Rows without an id come first. Rows that share an id
    are all kept, ordered by a hash of their text. Only `doc_id` and `text` are read. An empty table
    gives a store without blocks. Rows are range-partitioned with a tie-breaker, so that any number
    of rows with one id, or of equal rows, spreads over tasks.
    """
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, end)
        size = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        shard, block, written = TaskContext.get().partitionId(), 0, 0
        keys, ids, tokens, held = [], [], [], 0

        def flush():
            nonlocal block, written, keys, ids, tokens, held
            key = pa.concat_arrays(keys)
            nulls = key.null_count
            plain = np.asarray(key.drop_null(), dtype=np.int64)
            mph, slots = index_block(plain)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(tokens))])
            row = {
                "shard": shard,
                "block": block,
                "shard_start": written,
                "first_key": int(plain[0]) if len(plain) else None,
                "last_key": int(plain[-1]) if len(plain) else None,
                "null_rows": nulls,
                "n_docs": len(key),
                "n_ids": int(bounds[-1]),
                "width": size,
                "keys": plain.astype("<i8").tobytes(),
                "mph": mph,
                "slots": slots,
                "bounds": bounds.astype("<i8").tobytes(),
                "payload": np.concatenate(ids).astype(f"<u{size}").tobytes(),
            }
            block, written = block + 1, written + int(bounds[-1])
            keys, ids, tokens, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                found, bounds = encode.encode(*buffers(batch.column(1)))
                keys.append(batch.column(0))
                ids.append(found.astype(f"<u{size}"))
                tokens.append(np.diff(bounds))
                held += len(found)
                if held >= block_ids:
                    yield flush()
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_hash", "_row"]
    ranged = tie.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with shuffles_removed(docs.sparkSession):
        ranged.mapInArrow(run, BLOCK).write.parquet(path)


_BLOCK = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]
    + [("null_rows", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]
    + [(n, pa.binary()) for n in ("keys", "mph", "slots", "bounds", "payload")]
)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def _shards(spark: SparkSession, path: str) -> list[tuple[int, int, int | None, int | None]]:
    """Shard, ids before it, first and last key: one entry per file of the store."""
    heads = blocks(spark, path).groupBy("shard").agg(
        F.sum("n_ids"), F.min("first_key"), F.max("last_key")
    )
    total, out = 0, []
    for shard, n, first, last in sorted(heads.collect(), key=lambda r: r[0]):
        out.append((shard, total, first, last))
        total += n
    return out


DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store, fetched through the index: doc_id, start (ids of all documents
    before it), n_tokens and its ids as little-endian unsigned 32-bit integers.

    Blocks are read where they lie; nothing is shuffled.
    """
    starts = {shard: start for shard, start, _, _ in _shards(spark, path)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (block,) = batch.slice(i, 1).to_pylist()
                yield _documents(block, starts[block["shard"]])

    return blocks(spark, path).drop("first_key", "last_key").mapInArrow(run, DOCUMENT)


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """The documents with the ids in `keys.doc_id`, like `read_store`; unknown and null ids give
    no row, repeated ones count once.

    A key finds its shard by bisection over the shards' key ranges, its block by the heads of that
    shard, its row by the block's index.
    """
    spark = keys.sparkSession
    shards = [s for s in _shards(spark, path) if s[2] is not None]
    starts = {shard: start for shard, start, _, _ in shards}
    number = np.array([s[0] for s in shards], np.int32)
    first = np.array([s[2] for s in shards], np.int64)
    last = np.array([s[3] for s in shards], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column(0), dtype=np.int64)
            lo, hi = np.searchsorted(last, key, "left"), np.searchsorted(first, key, "right")
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key, n)), pa.array(number[at])], names=["doc_id", "shard"]
            )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (block,) = batch.slice(i, 1).to_pylist()
                wanted = np.unique(np.array(block["wanted"], np.int64))
                yield _documents(block, starts[block["shard"]], wanted)

    asked = keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    routed = asked.mapInArrow(route, "doc_id long, shard int")
    store = blocks(spark, path)
    heads = store.select("shard", "block", "first_key", "last_key")
    per_block = (
        routed.join(heads, "shard")
        .where("doc_id between first_key and last_key")
        .groupBy("shard", "block")
        .agg(F.collect_list("doc_id").alias("wanted"))
    )
    found = store.drop("first_key", "last_key").join(per_block, ["shard", "block"])
    return found.mapInArrow(fetch, DOCUMENT)


def _documents(b: dict, start: int, wanted: np.ndarray | None = None) -> pa.RecordBatch:
    """All documents of a block, or those with the wanted keys."""
    keys, bounds = np.frombuffer(b["keys"], "<i8"), np.frombuffer(b["bounds"], "<i8")
    ask = np.unique(keys) if wanted is None else wanted
    row, rows = find(b["mph"], b["slots"], ask)
    if wanted is None and (rows == 0).any():
        raise ValueError("a key of the block is missing from its index")
    nulls = b["null_rows"] if wanted is None else 0
    at = np.repeat(row - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())
    at = np.concatenate([np.arange(nulls), at + b["null_rows"]]).astype(np.int64)
    payload = memoryview(b["payload"])
    lo, hi, w = bounds[at], bounds[at + 1], b["width"]
    ids = [
        np.frombuffer(payload[w * x : w * y], f"<u{w}").astype("<u4").tobytes()
        for x, y in zip(lo.tolist(), hi.tolist())
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None] * nulls + np.repeat(ask, rows).tolist(), pa.int64()),
            pa.array(lo + (start + b["shard_start"])),
            pa.array(hi - lo),
            pa.array(ids, pa.binary()),
        ],
        names=["doc_id", "start", "n_tokens", "ids"],
    )


def digest(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
