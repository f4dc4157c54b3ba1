"""Sentence packing: texts to chunks of bounded length, as one native fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import strip


def sentence_chunks(text: Column, limit: int) -> Column:
    """Array of chunks: sentences joined by blanks while they fit, longer ones cut hard.

    Blank and null texts give an empty array; a text within the limit is one chunk. The length test counts the blank
    even before the first sentence, as the reference does.
    """
    body = F.coalesce(strip(text), F.lit(""))
    sentences = F.split(body, r"(?U)(?<=[.!?])\s+")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(s) + 1 <= limit
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        flushed = F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))
        n_cuts = F.greatest(F.ceil(F.length(s) / F.lit(limit)).cast("int") - 1, F.lit(0))
        cuts = F.when(n_cuts > 0, F.transform(F.sequence(F.lit(0), n_cuts - 1), lambda k: strip(F.substring(s, k * limit + 1, F.lit(limit))))).otherwise(F.array().cast("array<string>"))
        rest = strip(F.substring(s, n_cuts * limit + 1, F.lit(limit)))
        return F.when(fits, F.struct(acc["out"].alias("out"), strip(joined).alias("cur"))).otherwise(F.struct(F.concat(flushed, cuts).alias("out"), rest.alias("cur")))

    folded = F.aggregate(sentences, start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    return F.when(body == "", F.array().cast("array<string>")).when(F.length(body) <= limit, F.array(body)).otherwise(folded)


def segments(text: Column, limit: int = 300) -> Column:
    """Header segments: cut after . ; ! ? and, where still too long, after commas."""
    first = F.split(F.coalesce(text, F.lit("")), r"(?<=[.;!?])\s+")
    finer = F.transform(first, lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(F.split(s, r"(?<=,)\s+")))
    return F.filter(F.transform(F.flatten(finer), strip), lambda x: x != "")


def chunk_id(doc: Column, field: Column, index: Column) -> Column:
    """doc__field__000"""
    return F.format_string("%s__%s__%03d", doc.cast("string"), field, index.cast("int"))
