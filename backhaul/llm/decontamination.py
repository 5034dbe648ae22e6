"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of 13 words (all its words if it has fewer). A document that holds a
window holds each of the window's words, so it is enough to join on one necessary word per window:
the one that is rarest over all documents. Where a document has that word at place p and the window
has it at place q, the window can only start at p - q; it must fit into the document (length and
position bounds), and then its words are compared one by one.

The documents are read three times and never shuffled: to count the benchmark's words, to find
windows, and to give each document its row. What moves is counts of benchmark words, hits, and two
numbers per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 13
#: Up to this many words or windows of the benchmark are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000
SHARE = 20  # a document is contaminated from one hit word in so many

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case words; ASCII marks, spaces and controls stand between them. Null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    small = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _CAPITALS, _CAPITALS.lower()))
    return F.array_remove(F.split(small, _BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: their words, and the items that have them."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    cut = items.select(
        "item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("window")
    )
    return cut.groupBy("window").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))


def _small(df: DataFrame, bound: int) -> DataFrame:
    """`df` to be broadcast if it has at most `bound` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def rare_words(docs: DataFrame, windows: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """For each window its rarest word over all documents: one row per window, with its words, their
    number, the items that have it, the word and the word's place in it. Windows with a word that no
    document has are left out."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    seen = docs.select(F.explode_outer(words(F.col("text"))).alias("word"))
    counts = seen.join(_small(vocabulary, bound), "word").groupBy("word").count()
    spots = windows.select("window", "items", F.posexplode("window").alias("place", "word"))
    best = Window.partitionBy("window").orderBy("count", "word", "place")
    return (
        spots.join(vocabulary.join(counts, "word", "left").na.fill(0, ["count"]), "word")
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1 and count > 0")
        .select("word", "window", F.size("window").alias("size"), "place", "items")
    )


def _key(df: DataFrame) -> list[Column]:
    """Rows with the same id and the same text have the same result."""
    return [F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("_text")]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Occurrences of windows: doc_id, _text (hash of the text), start (from 0), size, items."""
    from backhaul.llm.scratch import stored

    windows = stored(benchmark_windows(benchmark, window), "windows")
    prefix = stored(rare_words(docs, windows, bound), "rare-words")
    texts = docs.select(*_key(docs), words(F.col("text")).alias("w"))
    places = texts.select("doc_id", "_text", "w", F.posexplode_outer("w").alias("at", "word"))
    low = F.greatest(F.col("at") - (window - 1), F.lit(0))
    if prefix.limit(bound + 1).count() <= bound:
        # Windows come to the documents. All runs in one generated stage, and a document's words are
        # not copied per word.
        met = places.withColumns({"near": F.col("w"), "low": F.lit(0), "n": F.size("w")}).join(F.broadcast(prefix), "word")
    else:
        # Words go to the windows, each with those around it that a window may hold.
        near = places.select("doc_id", "_text", "at", "word", F.slice("w", low + 1, 2 * window - 1).alias("near"), low.alias("low"), F.size("w").alias("n"))
        met = near.join(prefix, "word")
    start = F.col("at") - F.col("place")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n"))
    same = F.slice("near", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.col("size")) == F.col("window")
    return met.where(inside & same).select("doc_id", "_text", start.alias("start"), "size", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256 (of the ids of the items met, as strings, sorted, joined by commas) and
    contaminated (a twentieth of the words or more are hit).

    Null and blank texts have no words and are clean; an empty benchmark hits nothing; items without
    words have no windows; rows of the benchmark that share an id are one item, and a null id counts
    as an item written as the empty string. Repeated documents get a row each. Other columns are not read.
    """
    met = hits(docs, benchmark, window, bound)
    spans = F.collect_set(F.struct("start", "size"))
    covered = F.array_distinct(
        F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    )
    per_doc = (
        met.groupBy("doc_id", "_text")
        .agg(spans.alias("spans"), F.collect_set("items").alias("items"))
        .select(
            F.col("doc_id").alias("_doc"),
            F.col("_text").alias("_hash"),
            F.size(covered).alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        )
    )
    sizes = docs.select(*_key(docs), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("_text").eqNullSafe(F.col("_hash"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return sizes.join(per_doc, same, "left").select(
        F.col("doc_id").cast("long"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    met = hits(docs, benchmark)
    spans = met.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    covered = F.array_distinct(
        F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    )
    hit = spans.select(F.col("doc_id").alias("hit_id"), F.col("_text").alias("hit_text"), F.size(covered).alias("n_hit"))
    # The documents' columns stay together in one, so that theirs may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    of_text = F.xxhash64(F.col("row.text").cast("string")).eqNullSafe(F.col("hit_text"))
    bad = SHARE * F.col("n_hit") >= F.size(words(F.col("row.text")))
    return rows.join(hit, F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & of_text & bad, "left_anti").select("row.*")


_DUCK_WORDS = f"""regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, {_DUCK_WORDS} as w from documents),
b as (select item_id, {_DUCK_WORDS} as w from benchmark),
cut as (
  select item_id, w, least(len(w), {WINDOW}) as n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i
  from b where len(w) > 0
),
item_windows as (select distinct item_id, n, list_slice(w, i, i + n - 1) as g from cut),
sizes as (select distinct n from item_windows),
places as (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join sizes where len(w) >= n),
hit as (
  select p.rid, p.i, p.n, iw.item_id
  from (select rid, i, n, list_slice(w, i, i + n - 1) as g from places) p
  join item_windows iw on p.g = iw.g and p.n = iw.n
),
n_hits as (
  select rid, count(distinct spot) as n_hit from (select rid, unnest(range(i, i + n)) as spot from hit) group by rid
),
ids as (select distinct rid, cast(item_id as varchar) as id from hit),
n_ids as (select rid, count(*) as n_items, string_agg(id, ',' order by id) as names from ids group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n_hits using (rid) left join n_ids using (rid)
"""
