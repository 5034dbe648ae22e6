"""Lines that many documents share are dropped, in DataFrame functions only.

Lines are exploded, stripped and lower-cased, and hashed; distinct documents are counted per hash;
the places of lines over the threshold are gathered per document, and the other lines are put
together again by position.

A text never moves with its lines: what is shuffled is two hashes and an id per line, once per
document and hash, then counts per hash, each added up before it moves, so a line of every document
is one row per task. Places move for dropped lines only. Documents meet them in one join, in which
Spark sends the places to the documents while they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.llm.scratch import stored

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Hashes of shared lines up to this many are broadcast (32 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 200_000

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\f\r"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _small_letters(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _CAPITALS, _CAPITALS.lower()))


def keys(text: Column) -> Column:
    """The key of every line: stripped of white space at both ends, A-Z in lower case."""
    return F.transform(F.split(_small_letters(text), "\n"), lambda line: F.btrim(line, F.lit(_SPACE)))


def _identity() -> list[Column]:
    """What names a row: rows of one id and text have one result."""
    return [F.col("doc_id").cast("long").alias("doc"), F.xxhash64(_text()).alias("one"), F.xxhash64(F.lit(1), _text()).alias("two")]


def _hashes() -> list[Column]:
    """128 bits of a key."""
    return [F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), F.col("key")).alias("b")]


def shared_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """a, b and n_documents of the keys of at least `min_chars` code points that stand in at least
    `min_documents` documents. Rows that share an id are one document, rows without an id another."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc"), F.explode(keys(_text())).alias("key"))
    once = lines.where(F.length("key") >= min_chars).select(*_hashes(), "doc").distinct()
    counts = once.groupBy("a", "b").agg(F.count("*").alias("n_documents"))
    return counts.where(F.col("n_documents") >= min_documents)


def dropped_places(docs: DataFrame, shared: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """doc, one, two (the row's id and hashes of its text) and `places` (from 0) of its shared lines."""
    # The texts are hashed below the explosion, not once per line.
    whole = docs.select(*_identity(), keys(_text()).alias("keys"))
    lines = whole.select("doc", "one", "two", F.posexplode("keys").alias("place", "key"))
    shared = shared.select("a", "b")
    few = shared.limit(bound + 1).count() <= bound
    hit = lines.select("doc", "one", "two", "place", *_hashes()).join(F.broadcast(shared) if few else shared, ["a", "b"])
    return hit.groupBy("doc", "one", "two").agg(F.collect_set("place").alias("places"))


def drop_shared_lines(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and kept, the text of its other lines.

    A null or empty text is one empty line, which no threshold above zero code points drops; a
    document that loses all lines keeps an empty text. Keys count once per document however often it
    repeats them, and every such line goes. Repeated rows all appear, and rows that share an id count
    as one document. Only `doc_id` and `text` are read, other columns may have any names. An empty
    table gives no rows. A text of any length is split whole where it is read, in time and memory
    that grow with its length.
    """
    shared = stored(shared_lines(docs, min_documents, min_chars), "shared-lines")
    places = dropped_places(docs, shared, bound)
    # Split before the join: lines are then looked up in the joined row, not split again per line.
    rows = docs.select(F.col("doc_id").cast("long"), *_identity(), F.split(_text(), "\n").alias("lines"))
    named = places.withColumnsRenamed({"doc": "of_doc", "one": "of_one", "two": "of_two"})
    same_text = (F.col("one") == F.col("of_one")) & (F.col("two") == F.col("of_two"))
    same = F.col("doc").eqNullSafe(F.col("of_doc")) & same_text
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    return rows.join(named, same, "left").select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )


def digest(dropped: DataFrame) -> DataFrame:
    return dropped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as w from documents),
lines as (select rid, doc_id, unnest(w) as line, unnest(range(1, len(w) + 1)) as place from d),
k as (
  select *, regexp_replace(translate(line, '{_CAPITALS}', '{_CAPITALS.lower()}'),
    '\\A[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+\\z', '', 'g') as key
  from lines
),
shared as (
  select key from k where length(key) >= {MIN_CHARS}
  group by key having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= {MIN_DOCUMENTS}
),
marked as (select k.*, s.key is not null as gone from k left join shared s on k.key = s.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by rid
"""
