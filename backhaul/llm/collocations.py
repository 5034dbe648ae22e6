"""Phrases whose words stand together more often than their parts would by chance, mined by shards.

A phrase of the whole corpus's support must reach that support in proportion in at least one shard.
So each shard, a run of documents of bounded size within a task, is mined completely at support
lowered in proportion to its share of the language's text: words first, then longer phrases where
both their shorter parts are frequent in the shard. The union of what shards find holds every
frequent phrase. A shard that does not name a phrase has it less often than its lowered support, so
some of the union is known to fall short; all the rest is counted exactly over all documents. Pairs of words come first; phrases of three words and more are mined only where
all pairs in them are frequent over the whole corpus.

Documents are read four times and never shuffled; what moves is phrases that shards name and counts
of the union, one per phrase and task, so both grow faster than the input: more shards, more phrases. Tasks know the union by a Bloom filter of bounded size, the one thing broadcast:
what it lets through in error falls out in the join with the union. When it is full, more rows move
and the result is the same.

Inside a shard a word is a number of 32 bits and a phrase is a hash of 64 bits of its language and
words; two phrases share a hash once in 10^19 pairs. Phrases outside shards are strings.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backhaul.llm.scratch import stored
from backhaul.llm.words import LOWER, buffers, hash_spans, mix, slices, spans

SUPPORT = 100
MAX_WORDS = 5
COVERED = 100  # percent of a phrase's occurrences inside a longer phrase that drop it
TOP = 2000
NO_LANGUAGE = "und"
SHARD_BYTES = 128 << 20  # text per shard, about; a shard takes some three bytes of memory a byte
COUNTED_TOGETHER = 2  # shards' worth of text that one task counts, a part of it at a time
BROADCAST_ROWS = 200_000  # languages; beyond, Spark shuffles
FILTER_BITS = 28  # the filter's largest size, as a power of two: 32 MB
_SEGMENTS = 6
_CHUNK, _PART = 1 << 20, 1 << 21  # places looked at together, phrases sorted together
_STEP = np.uint64(0x9E3779B97F4A7C15)

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False


def _salts(languages: pa.Array) -> np.ndarray:
    """What is added to the hashes of a language's words; not a hash that a word may have itself."""
    data, offsets = buffers(languages)
    return mix(hash_spans(data, offsets[:-1], offsets[1:]) + _STEP)


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as strings."""
    size = end - begin
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(data[at])])


class Shard:
    """Words of a run of documents. `ids` are word numbers with a 0 before every piece; `key`,
    `word` and `language` tell a number's hash, its word and the place of its language in `languages`.
    """

    def __init__(self):
        self.languages: list[str] = []
        self.share = np.zeros((0, 2), np.int64)  # per language: bytes here, bytes in all
        self.bytes = 0
        self.count = np.zeros(1, np.int64)  # occurrences of each number
        self._ids, self._words, self._of = deque(), [], []
        self._known, self._number = np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def add(self, batch: pa.RecordBatch) -> None:
        """Take in rows of lang, text and lang_bytes."""
        data, offsets = buffers(batch.column(1))
        self.bytes += len(data) + 1
        named = batch.column(0).dictionary_encode()
        here = [str(v) for v in named.dictionary.to_pylist()]
        self.languages += [name for name in here if name not in self.languages]
        place = np.array([self.languages.index(name) for name in here], np.int64)[np.asarray(named.indices)]
        self.share = np.concatenate([self.share, np.zeros((len(self.languages) - len(self.share), 2), np.int64)])
        np.add.at(self.share[:, 0], place, np.diff(offsets))
        self.share[place, 1] = batch.column(2).to_numpy()

        data = LOWER[data]
        begin, end, first = spans(data, offsets, _WORD)
        if len(begin) == 0:
            return
        row = np.repeat(np.arange(len(place)), np.diff(first))
        salt = _salts(pa.array(self.languages))[place]
        word = mix(hash_spans(data, begin, end) + salt[row])
        key, at, word, n = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
        slot = np.searchsorted(self._known, key)
        old = np.zeros(len(key), bool)
        if len(self._known):
            old = self._known[np.minimum(slot, len(self._known) - 1)] == key
        number = np.empty(len(key), np.uint32)
        number[old] = self._number[slot[old]]
        new = np.flatnonzero(~old)
        number[new] = len(self._known) + 1 + np.arange(len(new))
        self.count = np.concatenate([self.count, np.zeros(len(new), np.int64)])
        self.count[number] += n
        self._words.append(_strings(data, begin[at[new]], end[at[new]]))
        self._of.append(place[row[at[new]]])
        order = np.argsort(both := np.concatenate([self._known, key[new]]))
        self._known, self._number = both[order], np.concatenate([self._number, number[new]])[order]

        piece = np.cumsum(_BREAK[data])[begin]
        starts = np.append(True, (piece[1:] != piece[:-1]) | (row[1:] != row[:-1]))
        self._ids.append(np.insert(number[word], np.flatnonzero(starts), np.uint32(0)))

    def close(self) -> Shard:
        self.ids, low = np.zeros(sum(map(len, self._ids)) + 1, np.uint32), 0
        while self._ids:  # each part goes once it is copied
            part = self._ids.popleft()
            self.ids[low : low + len(part)] = part
            low += len(part)
        self.key = np.zeros(len(self._known) + 1, np.uint64)
        self.key[self._number] = self._known
        self.word = pa.concat_arrays([pa.array([""], pa.large_string()), *self._words])
        self.language = np.concatenate([[0], *self._of]).astype(np.int64)
        self._words = self._of = []
        return self

    def support(self, support: int) -> np.ndarray:
        """The lowered support of each language: its share of the language's bytes, rounded up."""
        here, whole = self.share.T
        return np.array([max(1, -(-support * int(a) // max(int(b), 1))) for a, b in zip(here, whole)], np.int64)

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of `size` words that start at the places."""
        out = self.key[self.ids[at]]
        for k in range(1, size):
            out = out * _STEP + self.key[self.ids[at + k]]
        return mix(out + np.uint64(size))

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        words = [self.word.take(pa.array(self.ids[at + k])) for k in range(size)]
        return words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))

    def pairs(self, good: np.ndarray, test: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Marks the places where two words that are `good` (per number) follow each other; with a
        `test`, only those whose hash passes."""
        fits = np.zeros(len(self.ids), bool)
        for low in range(0, len(fits), _CHUNK):  # NumPy widens the numbers it looks up by
            fits[low : low + _CHUNK] = good[self.ids[low : low + _CHUNK]]
        out = _longer(fits)
        if test is not None:
            for at in _places(out):
                out[at] = test(self.keys(at, 2))
        return out


def _places(marks: np.ndarray) -> Iterator[np.ndarray]:
    """Marked places, some at a time."""
    for low in range(0, len(marks), _CHUNK):
        at = np.flatnonzero(marks[low : low + _CHUNK]) + low
        if len(at):
            yield at


def _longer(marks: np.ndarray) -> np.ndarray:
    """The marked places that another follows: there a phrase starts that is longer by a word, its
    first words and its last words being marked."""
    out = np.zeros(len(marks), bool)
    out[:-1] = marks[:-1] & marks[1:]
    return out


def _often(shard: Shard, marks: np.ndarray, size: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first places and counts of the phrases that start at marked places and occur as often
    as their language asks for.

    Phrases are gathered a part of them at a time, and added up before they are, so that neither many
    different phrases nor one that is everywhere takes much memory.
    """
    parts = max(1, -(-int(marks.sum()) // _PART))
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for part in range(parts):
        keys, firsts, counts = [], [], []
        for at in _places(marks):
            if parts > 1:
                spread = shard.ids[at] * np.uint32(0x9E3779B1) + shard.ids[at + 1] * np.uint32(0x85EBCA77)
                at = at[(spread >> np.uint32(8)) % np.uint32(parts) == part]
            key, first, n = np.unique(shard.keys(at, size), return_index=True, return_counts=True)
            keys.append(key)
            firsts.append(at[first])
            counts.append(n)
        if not keys:
            continue
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        n = np.add.reduceat(np.concatenate(counts)[order], head) if len(head) else np.zeros(0, np.int64)
        at = np.concatenate(firsts)[order[head]]
        enough = n >= least[shard.language[shard.ids[at]]]
        found.append((key[head[enough]], at[enough], n[enough]))
    return tuple(np.concatenate(column) for column in zip(*found))


def _marked(shard: Shard, marks: np.ndarray, size: int, key: np.ndarray) -> np.ndarray:
    """The marked places at which one of the phrases starts."""
    out, key = np.zeros(len(marks), bool), np.sort(key)
    for at in _places(marks):
        if len(key):
            own = shard.keys(at, size)
            out[at] = key[np.minimum(np.searchsorted(key, own), len(key) - 1)] == own
    return out


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Shard]:
    """Shards of a task's rows, in their order, each of half as much again as `limit` at most, but of
    one row at least."""
    shard = Shard()
    for whole in batches:
        for batch in slices(whole):
            if shard.bytes and shard.bytes + batch.nbytes > limit * 3 // 2:
                yield shard.close()
                shard = Shard()
            shard.add(batch)
    yield shard.close()


def _mine(
    sizes: range, support: int, limit: int, pairs: Broadcast | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Phrases of the sizes that are frequent within a shard, n times there, and how often those may
    occur that are not (`below`); the number of its words per language comes as a phrase of size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = None if pairs is None else Filter(pairs.value).holds
        for shard in shards(batches, limit):
            least = shard.support(support)
            names = pa.array(shard.languages, pa.string())
            words = np.bincount(shard.language, shard.count, len(names)).astype(np.int64)
            yield _rows(names, pa.array([""] * len(names), pa.string()), 0, words, least - 1)
            marks = shard.pairs(shard.count >= least[shard.language] if len(least) else shard.count > 0, test)
            for size in range(2, sizes.stop):
                if size > 2:
                    marks = _longer(marks)
                if size in sizes:
                    key, found, count = _often(shard, marks, size, least)
                    for low in range(0, len(found), _CHUNK // 8):
                        at, n = found[low : low + _CHUNK // 8], count[low : low + _CHUNK // 8]
                        of = shard.language[shard.ids[at]]
                        phrase = shard.phrases(at, size).cast(pa.string())
                        yield _rows(names.take(pa.array(of)), phrase, size, n, least[of] - 1)
                    if size + 1 in sizes:
                        marks = _marked(shard, marks, size, key)

    return run


def _rows(lang: pa.Array, phrase: pa.Array, size: int, n: np.ndarray, below: np.ndarray) -> pa.RecordBatch:
    sizes = pa.array(np.full(len(lang), size, np.int32))
    columns = [lang, phrase, sizes, pa.array(n), pa.array(below)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "n", "below"])


def _count(
    sizes: range, single: bool, limit: int, union: Broadcast, pairs: Broadcast | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences within a task of the phrases of the sizes, and with `single` of the words, that the
    filter of the union lets through. `pairs` filters the pairs that longer phrases consist of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = Filter(union.value).holds
        test = None if pairs is None else Filter(pairs.value).holds
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for shard in shards(batches, limit):
            for key, n in _occurrences(shard, sizes, single, holds, test):
                keys, slot = np.unique(np.concatenate([keys, key]), return_inverse=True)
                counts = np.bincount(slot, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > _PART:
                    yield _tally(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield _tally(keys, counts)

    return run


def _occurrences(
    shard: Shard, sizes: range, single: bool, holds: Callable, test: Callable | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if single:
        key = mix(shard.key + np.uint64(1))
        some = holds(key) & (shard.count > 0)
        yield key[some], shard.count[some]
    marks = shard.pairs(shard.count > 0, test)
    for size in range(2, sizes.stop):
        if size > 2:
            marks = _longer(marks)
        if size in sizes:
            for at in _places(marks):
                key = shard.keys(at, size)
                yield np.unique(key[holds(key)], return_counts=True)


def _tally(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


class Filter:
    """Set of hashes in 64-bit words: a hash sets four bits of one word. Its top bits choose the
    word, so a part of the words belongs to a part of the hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(64 - (len(words).bit_length() - 1))

    @staticmethod
    def mask(key: np.ndarray) -> np.ndarray:
        bits, out = mix(key), np.zeros(len(key), np.uint64)
        for k in range(4):
            out |= np.uint64(1) << ((bits >> np.uint64(6 * k)) & np.uint64(63))
        return out

    def holds(self, key: np.ndarray) -> np.ndarray:
        mask = self.mask(key)
        return self.words[(key >> self.shift).astype(np.int64)] & mask == mask


def _filter(keys: DataFrame, largest: int = FILTER_BITS) -> Broadcast:
    """A filter of the column `key`, with 16 bits a hash up to 2^largest bits in all. It is made in
    64 parts of fixed size, which together pass the driver."""
    bits = min(max(keys.count() * 16, 1 << 16).bit_length(), largest)
    part = 1 << (bits - 6 - _SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, segment = np.zeros(part, np.uint64), None
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            segment = int(key[0] >> np.uint64(64 - _SEGMENTS)) if len(key) else segment
            at = (key >> np.uint64(64 - (bits - 6))) & np.uint64(part - 1)
            np.bitwise_or.at(words, at.astype(np.int64), Filter.mask(key))
        if segment is not None:
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([words.tobytes()])], names=["segment", "words"])

    segment = F.shiftrightunsigned("key", 64 - _SEGMENTS)
    dealt = keys.select("key", segment.alias("segment")).groupBy("segment")
    built = dealt.applyInArrow(_whole_group(run), "segment long, words binary")
    words = np.zeros((1 << _SEGMENTS, part), np.uint64)
    for row in built.collect():
        words[row.segment] = np.frombuffer(row.words, np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words.ravel())


def _whole_group(run: Callable) -> Callable[[pa.Table], pa.Table]:
    def on_table(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(iter(group.to_batches()))))

    return on_table


def _keyed(phrases: DataFrame) -> DataFrame:
    """lang, phrase and size with the phrase's hash, as shards compute it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            begin, end, first = spans(data, offsets, _NOT_BLANK)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            word = mix(hash_spans(data, begin, end) + _salts(batch.column(0))[row])
            size, out = np.diff(first), np.zeros(batch.num_rows, np.uint64)
            for n in np.unique(size):
                at = first[:-1][size == n]
                key = word[at]
                for k in range(1, n):
                    key = key * _STEP + word[at + k]
                out[size == n] = mix(key + np.uint64(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=["lang", "phrase", "size", "key"])

    return phrases.select("lang", "phrase", "size").mapInArrow(run, "lang string, phrase string, size int, key long")


_FOUND = "lang string, phrase string, size int, n long, below long"


def _union(mined: DataFrame, support: int) -> DataFrame:
    """The phrases that shards named, but those that cannot reach the support: with n times in shards
    that named it, and `below` times at most in each of the others, a phrase falls short."""
    phrases = mined.where("size > 0").groupBy("lang", "phrase", "size").agg(F.sum(F.col("n") - F.col("below")).alias("over"))
    most = mined.where("size = 0").groupBy("lang").agg(F.sum("below").alias("most"))
    return phrases.join(most, "lang").where(F.col("over") + F.col("most") >= support).select("lang", "phrase", "size")


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, shard_bytes: int = SHARD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size and f of all phrases of two to `max_words` words that occur `support` times
    or more, and of the words in them; and lang and n, the number of words of each language."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    rows = docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = stored(rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("lang_bytes")), "languages")
    few = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    total = sizes.agg(F.coalesce(F.sum("lang_bytes"), F.lit(0))).first()[0]
    dealt = rows.join(F.broadcast(sizes) if few else sizes, "lang").select("lang", "text", "lang_bytes")
    # Shards much smaller than meant would be mined at a support too low to turn anything down.
    mining = dealt.coalesce(max(1, round(total / shard_bytes)))
    counting = dealt.coalesce(max(1, round(total / (shard_bytes * COUNTED_TOGETHER))))

    def counted(union: DataFrame, sizes: range, single: bool, pairs: Broadcast | None) -> DataFrame:
        count = _count(sizes, single, max(1, shard_bytes // 4), _filter(union), pairs)
        tallies = counting.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("f"))
        return stored(union.join(tallies, "key").where(F.col("f") >= support), "frequent")

    mined = stored(mining.mapInArrow(_mine(range(2, 3), support, shard_bytes, None), _FOUND), "mined")
    words = mined.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    union = stored(_keyed(_union(mined, support)), "union")
    two = counted(union, range(2, 3), False, None)

    pairs = _filter(two)
    long = stored(mining.mapInArrow(_mine(range(3, max_words + 1), support, shard_bytes, pairs), _FOUND), "mined")
    single = two.select("lang", F.explode(F.split("phrase", " ")).alias("phrase"), F.lit(1).alias("size"))
    union = stored(_keyed(_union(long, support).union(single.distinct())), "union")
    others = counted(union, range(3, max_words + 1), True, pairs)
    return two.union(others).select("lang", "phrase", "size", "f"), words


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def score(frequent: DataFrame, words: DataFrame) -> DataFrame:
    """Every phrase with a, l, r and n of its lowest-scoring cut, and the score: 1000 a n / (l r),
    rounded down. The products are decimals of 38 digits; one that did not fit would be an error."""
    part = F.split("phrase", " ")
    cuts = frequent.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns(
        {"head": _joined(F.slice(part, F.lit(1), F.col("k"))), "tail": _joined(F.slice(part, F.col("k") + 1, F.col("size")))}
    )
    one = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    two = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    whole = cuts.join(one, ["lang", "head"]).join(two, ["lang", "tail"]).join(words, "lang")
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    above, below = F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"], exact["l"] * exact["r"]
    scored = whole.withColumns({"above": above, "below": below}).withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "size", "a", "n").agg(lowest).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def not_covered(phrases: DataFrame, frequent: DataFrame, covered: int = COVERED) -> DataFrame:
    """The phrases but those of whose occurrences `covered` percent or more lie inside those of one
    longer phrase. If any does that, one that is longer by a word does it, too."""
    part = F.split("phrase", " ")
    inner = F.explode(F.array(F.slice(part, F.lit(1), F.col("size") - 1), F.slice(part, F.lit(2), F.col("size") - 1)))
    longer = frequent.where("size > 2").select("lang", inner.alias("part"), "f")
    most = longer.select("lang", _joined(F.col("part")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return phrases.join(most, ["lang", "phrase"], "left").where(100 * F.coalesce("most", F.lit(0)) < covered * F.col("a")).drop("most")


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    max_words: int = MAX_WORDS,
    covered: int = COVERED,
    top: int = TOP,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The `top` phrases of each language by score, count and phrase: lang, rank (from 1), phrase, a
    (its count), l and r (those of its parts), n (words of the language) and score.

    A null language is `und`, like a language of that name; null and blank texts have no words.
    Repeated rows count each time. Languages without a frequent phrase have no rows, nor has an empty
    table. Only `lang` and `text` are read, other columns may have any names. A text of any length is
    one run of documents by itself, in time and memory that grow with its length.
    """
    frequent, words = frequent_phrases(docs, support, max_words, shard_bytes)
    frequent = stored(frequent, "phrases")
    kept = not_covered(score(frequent, words), frequent, covered)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
with p as (
  select row_number() over () as pid, lang, w from (
    select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (
      select coalesce(lang, '{NO_LANGUAGE}') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece
      from documents)
    where len(w) > 0)
),
total as (select lang, cast(sum(len(w)) as bigint) as n from p group by lang),
g as (
  select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase, cast(count(*) as bigint) as f
  from (select lang, w, size, unnest(range(1, cast(len(w) - size + 2 as bigint))) as i
        from p cross join (select unnest(range(1, {MAX_WORDS + 1})) as size) where len(w) >= size)
  group by all having count(*) >= {SUPPORT}
),
c as (select *, string_split(phrase, ' ') as w from g where size >= 2),
cuts as (
  select lang, phrase, size, f as a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
  from (select *, unnest(range(1, size)) as k from c)
),
scored as (
  select cuts.*, x.f as l, y.f as r, n,
    cast((1000 * a::hugeint * n::hugeint) // (x.f::hugeint * y.f::hugeint) as bigint) as score
  from cuts join g x on x.lang = cuts.lang and x.phrase = head join g y on y.lang = cuts.lang and y.phrase = tail
    join total on total.lang = cuts.lang
),
best as (select *, row_number() over (partition by lang, phrase order by score, k) as cut from scored),
inner_phrases as (
  select lang, array_to_string(w[i:j], ' ') as phrase, max(f) as most
  from (select *, unnest(range(i + 1, size + 1)) as j from (select *, unnest(range(1, size)) as i from c))
  where j - i + 1 < size group by all
),
kept as (
  select best.* from best left join inner_phrases m on m.lang = best.lang and m.phrase = best.phrase
  where cut = 1 and 100 * coalesce(most, 0) < {COVERED} * a
)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
) where rank <= {TOP}
"""
