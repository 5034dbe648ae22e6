"""Registered queries of this subpackage: `opN_<name>` over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from backhaul.llm import (
    bag_minhash,
    collocations,
    decontamination,
    fill_middle,
    html_blocks,
    language_id,
    line_dedup,
    line_rules,
    lm_scoring,
    packing,
    pii,
    quality_classifier,
    token_store,
)
from backhaul.session import configure, scratch_path, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(configure(spark)).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into sequences of power-of-two lengths."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


@query
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to a keyed store and read back through its index."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "tokens")
    token_store.write_store(docs, path)
    return token_store.digest(token_store.read_store(spark, path))


@query
def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the line labels let it stay."""
    docs = table(spark, sf_dir, "documents")
    return line_rules.judge(docs, line_rules.train(docs, table(spark, sf_dir, "labels")))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand inside windows of benchmark items."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items)


ORACLES["op8_decontamination"] = decontamination.ORACLE


@query
def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.train(docs)))


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document under unigrams and under the interpolated model."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.train(pages))


@query
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three at unit ends and rearranged, and restored from that."""
    return fill_middle.digest(fill_middle.transform(table(spark, sf_dir, "documents")))


ORACLES["op11_fill_middle"] = fill_middle.ORACLE


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    return line_dedup.digest(line_dedup.drop_shared_lines(table(spark, sf_dir, "documents")))


ORACLES["op12_line_dedup"] = line_dedup.ORACLE


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words stand together most."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = collocations.ORACLE
