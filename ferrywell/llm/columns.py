"""Column expressions that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def nested(docs: DataFrame) -> DataFrame:
    """The whole row as one struct ``row`` beside ``doc_id`` and ``text`` (null text: empty).

    What an operator adds can then have any name, whatever columns the input brings.
    """
    return docs.select(
        F.struct(F.col("*")).alias("row"),
        F.col("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def split_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def document_key(doc_id: Column, text: Column) -> Column:
    """One value for a row's identity and content; repeated rows share it."""
    return F.sha2(F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("null")), text), 256)
