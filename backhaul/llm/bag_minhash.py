"""Near-duplicates by BagMinHash signatures, banding, and exact multiset overlap.

A document is the multiset of its runs of five words. Its weights are whole numbers, laid out on a
line that is cut at 1, 2, 4, 8 ...: a shingle of weight w reaches over the first segments and into
one of them. Each (shingle, segment) has a Poisson process of its own, the same in every document,
of a rate equal to the segment's length; each point has a place on the line, down to a unit, and one
of the signature's positions. A document owns the points on the part of the line its weight reaches,
and a position's value is its first owned point. Two documents agree at a position with the
probability of their weighted Jaccard similarity, sum of minima over sum of maxima.

Points come in ascending order, so a shingle is dropped once its next point lies beyond the level at
which a document's positions are all taken: the work per document is its length plus a constant.

Texts that agree in all rows of a band meet in a bucket. A bucket is not expanded into pairs: its most
connected text is compared with the others by exact overlap, and only texts that are not of one class
then are compared with each other, if a longer signature does not rule it out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.llm.components import components
from backhaul.llm.scratch import stored
from backhaul.llm.words import LOWER, NOT_SPACE, buffers, hash_spans, mix, row_sums, salted, slices, spans, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5  # 99.995 % of pairs at similarity 0.8 meet in a band
FINE = 2048  # positions of the longer signature, of which one bit each is kept
SLACK = 3.0
_ROWS_SIGNED = 1024  # texts given a longer signature together, 16 KB each
_FIRST, _SPOT, _PLACE = 0x51ED270B, 0x2545F491, 0x7F4A7C15  # salts of gaps, positions, places


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle, in row order: runs of `size` words, ASCII letters in lower
    case; a row with fewer words has one shingle of all of them, a row without words none."""
    data = LOWER[data]
    begin, end, first = spans(data, offsets, NOT_SPACE)
    word = hash_spans(data, begin, end)
    key, _, row = windows(word, first, size)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            extra[has] = mix(extra[has] + word[first[short[has]] + k] + np.uint64(1))
        key, row = np.concatenate([key, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        key, row = key[order], row[order]
    return key, row


def weights(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row and how often they occur there."""
    mark = salted(key, row)
    order = np.argsort(mark)
    mark = mark[order]
    new = np.ones(len(mark), bool)
    new[1:] = mark[1:] != mark[:-1]
    at = np.flatnonzero(new)
    return key[order[at]], row[order[at]], np.diff(np.append(at, len(mark)))


def _uniform(key: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Numbers in (0, 1], the same for the same key, point and salt."""
    bits = mix(key ^ mix(np.array([k], np.uint64) + np.uint64(salt)))
    return ((bits >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def signatures(key: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """`n_rows` x `size` values; rows without shingles keep infinities."""
    out = np.full((n_rows, size), np.inf)
    level = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # of the last segment reached
    item = np.repeat(np.arange(len(key)), level + 1)
    segment = np.arange(len(item)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    low = np.where(segment > 0, 2 ** np.maximum(segment - 1, 0), 0)
    length = np.maximum(low, 1)
    process, owner, reach = mix(key[item] + mix(segment.astype(np.uint64))), row[item], weight[item]
    total = np.bincount(row, weight, n_rows)
    limit = size * (np.log(size) + SLACK) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        out[todo] = np.inf
        flat, at, k = out.ravel(), np.zeros(len(live)), 0
        while len(live):
            p = process[live]
            at = at - np.log(_uniform(p, k, _FIRST)) / length[live]
            on = at <= limit[owner[live]]
            live, at, p = live[on], at[on], p[on]
            spot = (_uniform(p, k, _SPOT) * size).astype(np.int64) % size
            place = low[live] + (_uniform(p, k, _PLACE) * length[live]).astype(np.int64) % length[live]
            own = place < reach[live]
            np.minimum.at(flat, owner[live[own]] * size + spot[own], at[own])
            k += 1
        todo &= np.isinf(out).any(1)
        limit[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.tile(mix(np.arange(bands, dtype=np.uint64)), (len(signature), 1))
    for k in range(rows):
        key = mix(key ^ bits[:, :, k])
    return key.view(np.int64)


def position_bits(signature: np.ndarray) -> np.ndarray:
    """One bit of each of the signature's values, 64 to a number. Bits of different values agree half
    of the time."""
    place = mix(np.arange(signature.shape[1], dtype=np.uint64))
    bits = (mix(signature.view(np.uint64) ^ place) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def text_key(text: Column) -> Column:
    """The 128-bit digest that stands for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (of the text), size (number of shingles) and the band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                key, row = shingles(*buffers(batch.column(1)), shingle)
                n = batch.num_rows
                signature = signatures(*weights(key, row), n, bands * rows)
                size = np.bincount(row, minlength=n)
                some = np.where(size > 0, bands, 0)
                keys = band_keys(signature, bands, rows)[size > 0].ravel()
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(some)]), pa.int32()), pa.array(keys, pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(size, pa.int64()), lists],
                    names=["doc_id", "key", "size", "bands"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text")).alias("key"))
    return texts.mapInArrow(run, "doc_id long, key binary, size long, bands array<long>")


def overlaps(pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """a, b and the similarity of their texts `text_a` and `text_b`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in slices(whole, "text_a"):
                for batch in slices(half, "text_b"):
                    sides = [shingles(*buffers(batch.column(c)), shingle) for c in (2, 3)]
                    mark = np.concatenate([salted(key, row) for key, row in sides])
                    row = np.concatenate([row for _, row in sides])
                    left = np.zeros(len(mark), np.int64)
                    left[: len(sides[0][0])] = 1
                    order = np.argsort(mark)
                    mark, row, left = mark[order], row[order], left[order]
                    first = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])) if len(mark) else np.zeros(0, np.int64)
                    bounds = np.append(first, len(mark))
                    in_a = row_sums(left, bounds)
                    in_b = np.diff(bounds) - in_a
                    n = batch.num_rows
                    both = np.bincount(row[first], np.minimum(in_a, in_b), n)
                    either = np.bincount(row[first], np.maximum(in_a, in_b), n)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(np.where(either > 0, both / np.maximum(either, 1), 0.0))],
                        names=["a", "b", "similarity"],
                    )

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def _links(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs that are similar enough. A text is compared where its partners' texts arrive;
    either join may be split if one text has very many partners."""
    right = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return overlaps(both, shingle).where(F.col("similarity") >= similarity - 1e-12).select("a", "b")


def _shared(member: DataFrame) -> DataFrame:
    """Members of the buckets that hold several texts, with their degree: the summed sizes of the
    text's buckets."""
    several = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = member.join(several, "bucket")
    degree = rows.groupBy("key").agg(F.sum("n").alias("degree"))
    return stored(rows.drop("n").join(degree, "key"), "buckets")


def _fine(texts: DataFrame, positions: int, shingle: int) -> DataFrame:
    """key and marks: the bits of a longer signature, for texts of buckets that hold several classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                for low in range(0, part.num_rows, _ROWS_SIGNED):
                    batch = part.slice(low, _ROWS_SIGNED)
                    n = batch.num_rows
                    signature = signatures(*weights(*shingles(*buffers(batch.column(1)), shingle)), n, positions)
                    each = pa.array(np.arange(n + 1) * (positions // 64), pa.int32())
                    marks = pa.ListArray.from_arrays(each, pa.array(position_bits(signature).ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), marks], names=["key", "marks"])

    return texts.select("key", "text").mapInArrow(run, "key binary, marks array<long>")


def _may_reach(similarity: float, positions: int) -> Column:
    """Whether the bits of a pair agree as often as those of a pair at `similarity`, less four standard
    deviations. Bits agree at equal values, and else half of the time."""
    apart = (1 - similarity) / 2
    most = positions * apart + 4 * math.sqrt(positions * apart * (1 - apart))
    differ = [
        F.bit_count(F.col("marks_a")[i].bitwiseXOR(F.col("marks_b")[i])) for i in range(positions // 64)
    ]
    return reduce(lambda a, b: a + b, differ) <= math.ceil(most)


def _pairs(met: DataFrame) -> DataFrame:
    one, two = F.col("key_a"), F.col("key_b")
    return met.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select("bucket", *[F.col(c).alias(f"{c}_{name}") for c in ("key", "size", *more)])


def classes(docs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """node and root: the class of every text key that is linked with another text.

    First each bucket's most connected text, the hub, is compared with the others: that joins the
    copies of a text, however many. Where a bucket still holds several classes, the texts outside its
    largest class are compared with those of other classes, as far as a longer signature lets the pair
    be similar (it turns down one in 30,000 pairs at the limit). So every pair of texts that meet in a
    bucket is either compared, or known to be of one class, or too different by size or signature.
    """
    texts = signed.where("size > 0").groupBy("key").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = stored(texts, "texts")
    member = _shared(texts.select("key", "size", F.explode("bands").alias("bucket")))
    candidates = member.select("key").distinct()
    one_each = docs.select(text_key(F.col("text")).alias("key"), F.col("text").cast("string"))
    words = stored(one_each.dropDuplicates(["key"]).join(candidates, "key", "left_semi"), "candidate-texts")
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-9

    best = member.groupBy("bucket").agg(F.max(F.struct("degree", "key", "size")).alias("best"))
    hub = stored(best.select("bucket", "best.key", "best.size"), "hubs")
    met = _side(member, "b").join(_side(hub, "a"), "bucket").where((F.col("key_a") != F.col("key_b")) & fits)
    compared = stored(_pairs(met), "pairs")
    links = stored(_links(compared, words, similarity, shingle), "links")
    roots = components(links)

    rest = member.join(hub.select("bucket", "key"), ["bucket", "key"], "left_anti")
    named = rest.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    per_class = named.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = per_class.groupBy("bucket").agg(F.count("*").alias("several"), F.max(F.struct("n", "root")).alias("top"))
    mixed = mixed.where("several > 1").select("bucket", F.col("top.root").alias("top"))
    left = stored(named.join(mixed, "bucket").withColumn("outside", F.col("root") != F.col("top")), "open-buckets")
    if left.isEmpty():
        return roots
    fine = stored(_fine(words.join(left.select("key").distinct(), "key", "left_semi"), FINE, shingle), "fine-signatures")
    marked = left.join(fine.join(texts.select("key", "bands"), "key"), "key")
    one = _side(marked.where("outside"), "a", "root", "marks", "bands")
    other = _side(marked, "b", "root", "marks", "bands", "outside")
    apart = (F.col("root_a") != F.col("root_b")) & (~F.col("outside_b") | (F.col("key_a") < F.col("key_b")))
    # A pair may meet in many buckets; it counts in the first one. If a text is not there any more,
    # it was the hub and has been compared.
    once = F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == F.col("bucket")
    alike = _may_reach(similarity, FINE)
    pairs = stored(_pairs(other.join(one, "bucket").where(apart & fits & alike & once)), "pairs")
    more = _links(pairs.join(compared, ["a", "b"], "left_anti"), words, similarity, shingle)
    # The classes found so far stand for the links that made them.
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, class_id (lowest doc_id of its class), class_size (documents in
    it) and n_shingles.

    A class is a connected component of the texts whose multisets overlap by `similarity` or more.
    Equal texts are always of one class, null counting as empty; texts without words are near no
    other text. Rows without an id are classified, too; a class of such rows only has a null
    class_id. Repeated rows all appear. Other columns are not read. An empty table gives no rows.
    """
    members = _members(docs, similarity, bands, rows, shingle)
    found = members.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return members.join(found, "class").select("doc_id", "class_id", "class_size", F.col("size").alias("n_shingles"))


def _members(docs: DataFrame, similarity: float, bands: int, rows: int, shingle: int) -> DataFrame:
    """doc_id, key, size and class of every document."""
    signed = stored(sign(docs, bands, rows, shingle), "signatures")
    roots = classes(docs, signed, similarity, shingle).withColumnRenamed("node", "key")
    named = signed.select("doc_id", "key", "size").join(roots, "key", "left")
    return named.select("doc_id", "key", "size", F.coalesce("root", "key").alias("class"))


def one_per_class(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each class, with all its columns: the one with the lowest id, of several
    texts under that id the one with the lowest digest. Rows alike in id and text count once."""
    members = _members(docs, similarity, bands, rows, shingle)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    kept = members.groupBy("class").agg(least).select("least.doc_id", "least.key")
    # The documents' columns stay together in one, so that theirs may have any names.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.withColumns({"id": F.col("row.doc_id").cast("long"), "text_key": text_key(F.col("row.text"))})
    once = whole.dropDuplicates(["id", "text_key"])
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key"))
    return once.join(kept, same, "left_semi").select("row.*")
