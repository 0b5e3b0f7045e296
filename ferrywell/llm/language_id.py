"""Language identification by compression.

For each language a sample of its texts becomes a raw-content dictionary. A text is compressed
with every dictionary, and the language whose dictionary gives the fewest bytes wins. Long texts are
compressed in chunks, so the dictionary counts for all of the text, not just for its start. Case is
set aside, so that shouted text is compared with ordinary text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, in the languages' order."""

    dictionaries: tuple[tuple[str, bytes], ...]
    chunk: int = 2048
    level: int = 6
    #: Below this share of bytes saved against the second best, the answer is marked as rejected.
    margin: float = 0.01


#: Parts of a language in which the lowest hashes are found first, so that no task sees all rows of one.
PARTS = 64


def fit(labelled: DataFrame, per_language: int = 512, dictionary_bytes: int = 112_640) -> Model:
    """Learn from rows with text and lang: at most ``per_language`` rows of each, the ones whose
    identifiers hash lowest, and from each an equal share of the dictionary's bytes, taken at a place that
    the hash decides. The languages are those of all rows.
    """
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    rows = labelled.where("text is not null and lang is not null")
    candidates = rows.select("lang", "doc_id", hashed.alias("h")).distinct()
    for by in (["lang", F.pmod("h", F.lit(PARTS))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
        candidates = candidates.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    share = max(1, dictionary_bytes // per_language - 1)  # one byte parts them
    sample = rows.join(F.broadcast(candidates.select("lang", "doc_id")), ["lang", "doc_id"], "left_semi")
    start = F.pmod(hashed, F.greatest(F.lit(1), F.length("text") - share + 1)) + 1
    found = (sample.select("lang", "doc_id", F.substring(F.col("text"), start.cast("int"), F.lit(share)).alias("part"))
             .groupBy("lang", "doc_id").agg(F.min("part").alias("part")).orderBy("lang", "doc_id").collect())
    parts: dict[str, list[bytes]] = {}
    for row in found:
        # letters of several bytes: whole ones, as many as fit
        part = row["part"].lower().encode()[:share].decode(errors="ignore").encode()
        parts.setdefault(row["lang"], []).append(part)
    return Model(tuple((lang, b"\n".join(texts)) for lang, texts in sorted(parts.items())))


@lru_cache(maxsize=2)
def _compressors(model: Model):
    import zstandard

    made = []
    for _, content in model.dictionaries:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=model.level)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_dict_id=False))
    return made


def _verdict(text: str | None, model: Model) -> tuple[str, float, bool]:
    if not text or not model.dictionaries or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, True
    raw = text.lower().encode()
    chunks = [raw[i:i + model.chunk] for i in range(0, len(raw), model.chunk)]
    sizes = [sum(len(c.compress(chunk)) for chunk in chunks) for c in _compressors(model)]
    ranked = sorted(zip(sizes, (lang for lang, _ in model.dictionaries), strict=True))
    if len(ranked) == 1:
        return ranked[0][1], 1.0, False
    (least, lang), (second, _) = ranked[:2]
    saved = (second - least) / second
    return lang, min(1.0, 0.5 + 5 * saved), saved < model.margin


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row, from its text alone.

    lang_pred is the best language even where the margin is narrow and ``rejected`` says so; ties
    go to the first language by name. Null texts and texts without a letter are undetermined,
    with score 0. Repeated rows each get the result; an empty table gives none.
    """
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_verdict(t, model) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.select("doc_id", classify(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def fold(doc_id: Column) -> Column:
    """0, 1 or 2 by the identifier; fold 1 is held out."""
    return F.crc32(doc_id.cast("string")) % 3
