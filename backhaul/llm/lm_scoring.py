"""Language-model scoring by deleted interpolation.

The probability of a word after its context is a mixture of relative frequencies of the word after
ever shorter contexts, down to add-one smoothed words. The mixture's weights depend on how often the
context was seen: contexts fall into buckets by the logarithm of their count. The weights are learned
by expectation-maximisation on documents whose own counts are taken out of the frequencies first.

Documents are dealt into groups of a bounded amount of text. A group asks for the counts of its
distinct n-grams in a few sorted arrays, one per shard of the n-gram space; a shard adds up what all
groups have and answers each group in the order it asked, so that answers need no keys. Whatever an
n-gram's frequency, it is one entry per group. Two exchanges of text and one of n-grams do the rest:
no n-gram or document passes through the driver, which sees one histogram of bounded size and the
totals.

An n-gram is known by a 64-bit hash of its words. Sentences are whole documents: each starts with a
start mark that is not counted and ends with the end token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.llm.scratch import shuffles_removed, stored
from backhaul.llm.words import LOWER, NOT_SPACE, buffers, hash_spans, mix, row_sums, spans

ORDER = 2
GROUP_BYTES = 12 << 20  # text per group
SHARD_KEYS = 4 << 20  # entries per shard, about
BUCKETS = 16  # of context counts, by powers of two
FOLD, HELD_OUT = 3, 2  # remainders: documents for the weights, documents that teach nothing
_ROUNDS = 40
_CELLS = 6  # histogram cells per factor of two
_NEVER = -(1 << 20)  # the cell of tokens that never follow their context
_END = np.uint64(0x0E0D0E0D0E0D0E0D)
_BEGIN = np.uint64(0xB0E0B0E0B0E0B0E0)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TAG = np.uint64(3)


class Grams:
    """The n-grams of a list of texts. `keys` are their distinct hashes in ascending order, the order
    less one in the two lowest bits; `slots[n][t]` is the place in `keys` of the n + 1 words that end
    with token t, `start` that of the start mark. Tokens are lower-case words and one end per text.
    """

    def __init__(self, column: pa.Array, order: int):
        data, offsets = buffers(column)
        data = LOWER[data]
        begin, end, first = spans(data, offsets, NOT_SPACE)
        word = np.insert(hash_spans(data, begin, end), first[1:], _END)
        self.first = first + np.arange(len(first))
        self.place = np.arange(len(word)) - np.repeat(self.first[:-1], np.diff(self.first))
        parts, key = [word & ~_TAG], word
        for n in range(1, order):
            back = np.full(len(word), _BEGIN)
            back[n:] = word[: len(word) - n]
            back[self.place < n] = _BEGIN
            key = mix(key * _STEP + back + np.uint64(n))
            parts.append(key & ~_TAG | np.uint64(n))
        every = np.concatenate([*parts, [_BEGIN | _TAG]])
        rank = np.argsort(every)
        ordered = every[rank]
        new = np.append(True, ordered[1:] != ordered[:-1])
        slot = np.empty(len(every), np.int64)
        slot[rank] = np.cumsum(new) - 1
        self.keys = ordered[new]
        self.slots = [slot[n * len(word) : (n + 1) * len(word)] for n in range(order)]
        self.start = int(slot[-1])

    def context(self, n: int) -> np.ndarray:
        """Place in `keys` of the n words before each token; the start mark where a text begins."""
        before = np.roll(self.slots[n - 1], 1)
        before[self.place == 0] = self.start
        return before

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How often each key occurs in the chosen rows; for the start mark, how many these are."""
        token = np.repeat(rows, np.diff(self.first))
        out = sum(np.bincount(slot[token], minlength=len(self.keys)) for slot in self.slots)
        out[self.start] = rows.sum()
        return out


def _pack(values: np.ndarray) -> bytes:
    """Byte planes: the high bytes of sorted values compress well together."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack_counts(values: np.ndarray) -> bytes:
    """Byte planes, as many as the largest count needs; their number comes first."""
    planes = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    whole = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([planes]) + whole[:, :planes].T.tobytes()


def _unpack_counts(raw: bytes) -> np.ndarray:
    if len(raw) == 0:
        return np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    planes = data[1:].reshape(data[0], -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, : len(planes)] = planes.T
    return whole.view("<i8").ravel()


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7


def _grouped(docs: DataFrame, group_bytes: int) -> tuple[DataFrame, int, int]:
    """doc_id, text, role (0 counts, 1 counts and sets the weights, 2 is held out) and group; the
    number of groups of role 1, which come first; bytes of text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = _remainder(F.col("doc_id"))
    role = F.when(left == HELD_OUT, 2).when(left == FOLD, 1).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), role.alias("role"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    fold = max(1, round(size / 7 / group_bytes))
    other = max(1, round(size * 6 / 7 / group_bytes))
    # Equal rows must spread as well, so the group comes from the row's place; it is written down,
    # since places are only settled once.
    place = F.xxhash64("doc_id", F.monotonically_increasing_id())
    group = F.when(F.col("role") == 1, F.pmod(place, F.lit(fold))).otherwise(fold + F.pmod(place, F.lit(other)))
    return stored(rows.withColumn("group", group.cast("int")), "lm-documents", codec="zstd"), fold, size


_REQUEST = "shard int, group int, keys binary, counts binary"
_REPLY = "group int, shard int, counts binary, fold binary, train long, types long, fold_train long"
_SCORE = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
    " base_score double, score double"
)


def _text(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _requests(order: int, shards: int):
    """One row per shard from a group: its n-grams there, sorted, and their counts in the documents
    that teach (0 if none has them)."""
    cuts = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        g = Grams(_text(table), order)
        counts = g.counts(np.asarray(table.column("role")) != 2)
        bounds = [0, *np.searchsorted(g.keys, cuts).tolist(), len(g.keys)]
        some = [(s, a, b) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
        return pa.table(
            {
                "shard": pa.array([s for s, _, _ in some], pa.int32()),
                "group": pa.array([group] * len(some), pa.int32()),
                "keys": pa.array([_pack(g.keys[a:b]) for _, a, b in some], pa.binary()),
                "counts": pa.array([_pack_counts(counts[a:b]) for _, a, b in some], pa.binary()),
            }
        )

    return run


def _answers(fold_groups: int):
    """Adds up a shard's n-grams over all groups and answers each group in the order it asked: counts
    in all teaching documents, and for the groups that set the weights also in theirs. The first
    answer carries the shard's totals: training tokens, known words, tokens of the weights' part."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        groups = np.asarray(table.column("group"))
        asked = [_unpack(k.as_buffer()) for k in table.column("keys")]
        own = np.concatenate([_unpack_counts(c.as_buffer()) for c in table.column("counts")])
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in asked])])
        every = np.concatenate(asked)
        rank = np.argsort(every)
        ordered = every[rank]
        new = np.append(True, ordered[1:] != ordered[:-1])
        slot = np.empty(len(every), np.int64)
        slot[rank] = np.cumsum(new) - 1
        word = (ordered[new] & _TAG) == 0
        total = np.bincount(slot, own).astype(np.int64)
        in_fold = np.repeat(groups < fold_groups, np.diff(bounds))
        fold = np.bincount(slot[in_fold], own[in_fold], len(total)).astype(np.int64)
        parts = [slot[a:b] for a, b in zip(bounds, bounds[1:])]
        totals = [int(total[word].sum()), int((total[word] > 0).sum()), int(fold[word].sum())]
        once = [[x] + [0] * (len(groups) - 1) for x in totals]
        return pa.table(
            {
                "group": pa.array(groups, pa.int32()),
                "shard": pa.array([shard] * len(groups), pa.int32()),
                "counts": pa.array([_pack_counts(total[p]) for p in parts], pa.binary()),
                "fold": pa.array(
                    [_pack_counts(fold[p]) if g < fold_groups else b"" for g, p in zip(groups, parts)], pa.binary()
                ),
                "train": pa.array(once[0], pa.int64()),
                "types": pa.array(once[1], pa.int64()),
                "fold_train": pa.array(once[2], pa.int64()),
            }
        )

    return run


def bucket(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 for unseen, then one per power of two."""
    return np.minimum(np.ceil(np.log2(np.maximum(count, 0) + 1)), BUCKETS - 1).astype(np.int64)


def _mixture(g: Grams, counts: np.ndarray, train: int, types: int, weights: list[np.ndarray]) -> np.ndarray:
    """Probability of every token, up to the order that has weights."""
    p = (counts[g.slots[0]] + 1) / (train + types + 1)
    for n, weight in enumerate(weights, 1):
        seen = counts[g.context(n)]
        share = weight[bucket(seen)]
        p = share * counts[g.slots[n]] / np.maximum(seen, 1) + (1 - share) * p
    return p


def _in_order(replies: pa.Table, column: str) -> np.ndarray:
    """The answers of all shards put together, which is the order of the group's keys."""
    rows = sorted(zip(replies.column("shard").to_pylist(), replies.column(column)), key=lambda r: r[0])
    return np.concatenate([_unpack_counts(raw.as_buffer()) for _, raw in rows])


def _histogram(order: int, train: int, types: int, weights: list[np.ndarray]):
    """For the next order: tokens by context bucket and by how much more probable the longer context
    makes them than the mixture so far, their own part's counts taken out."""
    n = len(weights) + 1

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.table({c: pa.array([], pa.int64() if c != "gain" else pa.float64()) for c in ("bucket", "cell", "n", "gain")})
        g = Grams(_text(table), order)
        counts = _in_order(replies, "counts") - _in_order(replies, "fold")
        p = _mixture(g, counts, train, types, weights)
        seen = counts[g.context(n)]
        gain = np.log2(np.maximum(counts[g.slots[n]], 1e-300) / np.maximum(seen, 1) / p)
        cell = np.where(counts[g.slots[n]] > 0, np.floor(gain * _CELLS), _NEVER).astype(np.int64)
        known = seen > 0
        both = bucket(seen)[known] * 2 * -_NEVER + cell[known] - _NEVER
        keys, at, size = np.unique(both, return_inverse=True, return_counts=True)
        return pa.table(
            {
                "bucket": pa.array(keys // (2 * -_NEVER)),
                "cell": pa.array(keys % (2 * -_NEVER) + _NEVER),
                "n": pa.array(size),
                "gain": pa.array(np.bincount(at, np.maximum(gain[known], -1e3), len(keys))),
            }
        )

    return run


def expectation_maximisation(rows: list, rounds: int = _ROUNDS) -> np.ndarray:
    """Per bucket the share of the longer context, from rows of bucket, cell, n and summed gain. An
    unseen context has none; a bucket without tokens takes the share of the one below."""
    share = np.zeros(BUCKETS)
    for b in range(1, BUCKETS):
        part = [r for r in rows if r.bucket == b]
        if not part:
            share[b] = share[b - 1]
            continue
        n = np.array([r.n for r in part], float)
        ratio = np.array([0.0 if r.cell == _NEVER else 2.0 ** (r.gain / r.n) for r in part])
        x = 0.5
        for _ in range(rounds):
            x = float((n * x * ratio / (x * ratio + 1 - x)).sum() / n.sum())
        share[b] = min(x, 0.999)
    return share


def _scores(order: int, train: int, types: int, weights: list[np.ndarray]):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.table([pa.array([], f.type) for f in _SCORED], schema=_SCORED)
        g = Grams(_text(table), order)
        counts = _in_order(replies, "counts")
        known = counts[g.slots[0]]
        at = g.first[:-1]
        base = np.log10((known + 1) / (train + types + 1))
        score = np.log10(_mixture(g, counts, train, types, weights))
        return pa.table(
            [
                table.column("doc_id").combine_chunks(),
                pa.array(np.asarray(table.column("role")) == 2),
                pa.array(np.diff(g.first)),
                pa.array(row_sums(known > 0, g.first)),
                pa.array(np.full(len(at), train)),
                pa.array(np.add.reduceat(base, at)),
                pa.array(np.add.reduceat(score, at)),
            ],
            schema=_SCORED,
        )

    return run


_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
    + [("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def score(docs: DataFrame, order: int = ORDER, group_bytes: int = GROUP_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens (words and one end), n_known (tokens met in
    training), train_tokens, base_score (add-one unigrams) and score, both base-ten logarithms of the
    whole text's probability.

    Documents teach if crc32 of doc_id as text, modulo 7, is not 2; those with remainder 3 also set
    the mixture's weights. A null id counts as the empty text. Null and blank texts consist of the
    end token. Repeated rows teach and are scored each. With no training document every token is
    equally unknown and scores are 0. Only `doc_id` and `text` are read.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    grouped, fold, size = _grouped(docs, group_bytes)
    shards = max(1, -(-size * order // 8 // shard_keys))
    asked = grouped.groupBy("group").applyInArrow(_requests(order, shards), _REQUEST)
    replies = stored(asked.groupBy("shard").applyInArrow(_answers(fold), _REPLY), "lm-counts")
    train, types, fold_train = (
        x or 0 for x in replies.agg(F.sum("train"), F.sum("types"), F.sum("fold_train")).first()
    )

    def with_counts(rows: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
        return rows.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(run, schema)

    weights: list[np.ndarray] = []
    for _ in range(1, order):
        rows = grouped.where(F.col("role") == 1)
        answers = replies.where(F.col("group") < fold)
        run = _histogram(order, train - fold_train, types, list(weights))
        cells = with_counts(rows, answers, run, "bucket long, cell long, n long, gain double")
        with shuffles_removed(docs.sparkSession):
            found = cells.groupBy("bucket", "cell").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain")).collect()
        weights.append(expectation_maximisation(found))
    return with_counts(grouped, replies.select("group", "shard", "counts"), _scores(order, train, types, weights), _SCORE)
