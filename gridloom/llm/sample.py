"""The bounded sample of labelled rows on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, store

SAMPLE_ROWS = 20_000


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, label, text`` of at most ``rows`` labelled ids, chosen by a hash of the id, one row for each; ids whose
    remainder is ``held_out`` are never read. An id with several labels counts with the larger, one with several texts with
    that of the smallest hash. The chosen ids are broadcast: their number is the bound."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held_out))
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return store(once)
