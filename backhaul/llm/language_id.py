"""Language of texts by prediction by partial matching over bytes.

Each language has a tree of byte contexts, up to three bytes long, with the counts of the byte that
followed. In a context of n counts and q different followers, a follower with count c has probability
c / (n + q); with q / (n + q) the tree escapes to the next shorter context, whose probabilities are
scaled up for the followers ruled out. Below the empty context all bytes are alike. The statistics are
frozen after training, so the code length of every byte in every context is a number that can be
looked up, and a text's code length under a language is the sum of those numbers. The shortest code wins.

The trees learn from at most `per_language` documents of each language, `sample` in all, those with the
lowest hash of doc_id and text; repeated rows count once. They are pruned to the most frequent contexts so that the tables of all
languages together keep to a bound; a pruned context is read as the longest suffix that was kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backhaul.llm.sampling import ROW, distinct_rows, rows_of
from backhaul.llm.words import buffers, slices

PER_LANGUAGE, SAMPLE = 400, 8000
CELLS = 16 << 20  # table entries over all languages
HELD_OUT = 2
ORDER = 3
UNKNOWN = "und"
_PAD = 0x0A
_BLOCK = 1 << 20
_PARTS, _COUNTING_TASKS = 32, 4
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LETTER = re.compile(r"[^\W\d_]")


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def _before(data: np.ndarray, offsets: np.ndarray, pad: int) -> list[np.ndarray]:
    """The byte one, two and three places before each byte; `pad` before a text's start."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = []
    for k in range(1, ORDER + 1):
        back = np.full(len(data), pad, data.dtype)
        back[k:] = data[:-k]
        back[place < k] = pad
        out.append(back)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram (three context bytes and the byte that follows) and n, added up over the task."""
    place: dict[str, int] = {}
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # languages in the upper half of a key
    for whole in batches:
        for batch in slices(whole):
            data, offsets = buffers(batch.column(1))
            if len(data) == 0:
                continue
            one, two, three = (x.astype(np.uint64) for x in _before(data, offsets, _PAD))
            gram = three << np.uint64(24) | two << np.uint64(16) | one << np.uint64(8) | data.astype(np.uint64)
            lang = np.array([place.setdefault(x, len(place)) for x in batch.column(0).to_pylist()], np.uint64)
            new, count = np.unique(np.repeat(lang, np.diff(offsets)) << np.uint64(32) | gram, return_counts=True)
            keys, slot = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n = np.bincount(slot, np.concatenate([n, count]), len(keys)).astype(np.int64)
    names = pa.array(list(place), pa.string())
    yield pa.RecordBatch.from_arrays(
        [
            names.take(pa.array((keys >> np.uint64(32)).astype(np.int64))),
            pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
            pa.array(n),
        ],
        names=["lang", "gram", "n"],
    )


@dataclass(frozen=True)
class Counts:
    """Frozen statistics: for each language its grams and how often each occurs."""

    languages: list[str]
    grams: list[np.ndarray]
    n: list[np.ndarray]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Counts:
    """Count the grams of the sample. They come to the driver, added up: no more than its bytes."""
    known = docs.where(F.col("lang").isNotNull() & (F.octet_length(F.col("text").cast("string")) > 0))
    known = known.where(remainder(F.col("doc_id")) != HELD_OUT).withColumn("lang", F.col("lang").cast("string"))
    # First within parts of a language, so that none is sorted by one task whole.
    order = (F.xxhash64(ROW), "doc_id", ROW)
    part = distinct_rows(known, "lang").withColumn("part", F.pmod(F.xxhash64(ROW, "doc_id"), F.lit(_PARTS)))
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    best = part.withColumn("rank", in_part).where(F.col("rank") <= per_language).drop("part")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= per_language)
    chosen = ranked.orderBy("rank", "lang").limit(sample).drop("rank")
    # The sample is small; counted by a few tasks, its grams are the same rows however it lay.
    rows = rows_of(docs, chosen, "lang", "text").coalesce(_COUNTING_TASKS)
    found = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    lang = np.asarray(table.column("lang").to_pylist(), dtype=object)
    gram, n = np.asarray(table.column("gram")), np.asarray(table.column("n"))
    languages = sorted(set(lang))
    picks = [np.flatnonzero(lang == x) for x in languages]
    picks = [p[np.argsort(gram[p])] for p in picks]
    return Counts(languages, [gram[p] for p in picks], [n[p] for p in picks])


class Tables:
    """Code lengths in bits by context and next byte, all languages side by side."""

    def __init__(self, counts: Counts, cells: int = CELLS):
        seen = np.zeros(256, bool)
        seen[_PAD] = True
        for g in counts.grams:
            for k in range(4):
                seen[np.unique(g >> (8 * k) & 255)] = True
        self.letter = np.zeros(256, np.int64)  # bytes of no training text share symbol 0
        self.letter[seen] = np.arange(1, seen.sum() + 1)
        size = self.size = int(seen.sum()) + 1
        n_lang = len(counts.languages)
        symbols = [[self.letter[g >> (8 * k) & 255] for k in range(4)] for g in counts.grams]

        def context(s: list[np.ndarray], order: int) -> np.ndarray:
            key = np.zeros(len(s[0]), np.int64)
            for k in range(order, 0, -1):
                key = key * size + s[k]
            return key

        # The most frequent contexts over all languages; a suffix is never rarer than its context.
        ranked = []
        for order in range(1, ORDER + 1):
            key = np.concatenate([context(s, order) for s in symbols])
            distinct, at = np.unique(key, return_inverse=True)
            total = np.bincount(at, np.concatenate(counts.n), len(distinct))
            ranked.append(np.column_stack([-total, np.full(len(distinct), order), distinct]))
        every = np.concatenate(ranked)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        every = every[: max(0, cells // (size * n_lang) - 1)].astype(np.int64)

        nodes = 1 + len(every)
        node = [np.zeros(size**order, np.int32) for order in range(ORDER + 1)]  # by context, 0 is empty
        place = np.arange(1, nodes, dtype=np.int32)
        parent = np.zeros(nodes, np.int64)
        for order in range(1, ORDER + 1):
            node[order][:] = np.tile(node[order - 1], size)  # the longest suffix so far
            mine = every[:, 1] == order
            keys = every[mine, 2]
            parent[place[mine]] = node[order][keys]
            node[order][keys] = place[mine]
        self.node = node[ORDER]
        self.bits = np.empty((nodes, size, n_lang), np.float32)
        by_order = [np.array([0]), *[place[every[:, 1] == o] for o in range(1, ORDER + 1)]]
        spare = 256 - size + 1  # bytes that share symbol 0
        flat = np.full(size, 1 / 256)
        flat[0] = spare / 256
        for at, (s, n) in enumerate(zip(symbols, counts.n)):
            p = np.empty((nodes, size))
            for order, mine in enumerate(by_order):
                if len(mine) == 0:
                    continue
                of = node[order][context(s, order)]
                row = np.full(nodes, -1)
                row[mine] = np.arange(len(mine))
                ours = row[of] >= 0
                found = np.bincount(row[of[ours]] * size + s[0][ours], n[ours], len(mine) * size).reshape(-1, size)
                below = p[parent[mine]] if order else flat[None, :]
                total, kinds = found.sum(1, keepdims=True), (found > 0).sum(1, keepdims=True)
                left = np.where(found > 0, 0, below)
                rest = left.sum(1, keepdims=True)
                escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
                escape = np.where(rest > 0, escape, 0)
                p[mine] = np.where(found > 0, found / np.maximum(total + kinds, 1), escape * left / np.maximum(rest, 1e-300))
            p[:, 0] /= spare
            self.bits[:, :, at] = -np.log2(np.maximum(p, 1e-30))
        self.bits = self.bits.reshape(nodes * size, n_lang)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        n, n_lang = len(offsets) - 1, self.bits.shape[1]
        out = np.zeros((n, n_lang))
        symbol = self.letter[data]
        one, two, three = _before(symbol, offsets, int(self.letter[_PAD]))
        row = np.repeat(np.arange(n), np.diff(offsets))
        step = max(1 << 14, _BLOCK * 4 // n_lang)
        for a in range(0, len(data), step):
            b = min(a + step, len(data))
            context = (three[a:b] * self.size + two[a:b]) * self.size + one[a:b]
            bits = self.bits[self.node[context].astype(np.int64) * self.size + symbol[a:b]]
            lo, hi = row[a], row[b - 1] + 1
            for k in range(n_lang):
                out[lo:hi, k] += np.bincount(row[a:b] - lo, bits[:, k], hi - lo)
        return out


_TABLES: dict[str, Tables] = {}


def predict(docs: DataFrame, counts: Counts) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of doc_id as text, modulo 4, is 2: not learned
    from), lang_pred and score, the probability of that language if all were equally likely before.

    Null and blank texts and texts without a letter are `und` with score 0, as is everything if
    nothing was learned; of equally short codes the first language by name wins. Repeated rows and
    rows without an id (read as the empty string) each get a row. Whole texts are read; of the
    columns only doc_id and text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    name = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value.languages
        if languages and name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = Tables(shared.value)
        for whole in batches:
            for batch in slices(whole):
                data, offsets = buffers(batch.column(1))
                total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                letters = total[offsets[1:]] > total[offsets[:-1]]
                for i in np.flatnonzero(~letters):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    letters[i] = _LETTER.search(text) is not None
                if languages:
                    bits = _TABLES[name].code_lengths(data, offsets)
                    best = bits.argmin(1)
                    share = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
                    names = np.where(letters, np.array(languages, object)[best], UNKNOWN)
                else:
                    names, share = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array(names.tolist(), pa.string()),
                        pa.array(np.where(letters, share, 0.0)),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
