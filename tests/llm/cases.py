"""Small documents that the operators must cope with."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from backhaul.session import ship

SF_DIR = Path("/root/testdata/sf0.001")


def documents(spark, rows):
    """A frame of documents from (doc_id, text) pairs; extra columns carry names that operators use."""
    ship(spark)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {"lang": "en", "key": "x", "n_words": -1, "kept": False, "spans": "y", "score": 2.0, "size": 0, "root": "r"}
    return frame.withColumns({name: F.lit(value) for name, value in clash.items()})


#: Null, empty, blank, one word, white space of other kinds, ties, repeated rows, rows without an id.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d"), (6, "Same text here"),
    (6, "Same text here"), (6, "another text"), (None, "no id"), (None, None), (7, "\x00\x01 \x7f"),
    (8, "long " * 30_000), (9, "x" * 60_000),
]
