"""Legal signatures: article, clause and point as one key, in the two formats of the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import label_token, plain_token, split_values, strip, strip_accents


def expand(dieu: Column, khoan: Column, diem: Column) -> Column:
    """Array of signatures of all combinations of the values in three cells; absent levels are left out.

    An item without an article has none.
    """
    def values(c: Column, lower: bool = False) -> Column:
        return F.filter(F.transform(split_values(c), lambda x: label_token(x, lower)), lambda x: x != "")

    def with_absent(v: Column) -> Column:
        return F.when(F.size(v) == 0, F.array(F.lit(None).cast("string"))).otherwise(v)

    ks, ms = with_absent(values(khoan)), with_absent(values(diem, True))
    combos = F.transform(values(dieu), lambda d: F.transform(ks, lambda k: F.transform(ms, lambda m: F.concat_ws("-", d, k, m))))
    return F.array_distinct(F.flatten(F.flatten(combos)))


def zero_filled(dieu: Column, khoan: Column, diem: Column) -> Column:
    """article-clause-point with 0 for an absent level; null without an article."""
    def part(c: Column) -> Column:
        return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("0"))

    d = F.nullif(strip(dieu), F.lit(""))
    return F.when(d.isNotNull(), F.concat_ws("-", d, part(khoan), F.lower(part(diem))))


def article_of(signature: Column) -> Column:
    """Text before the first hyphen."""
    return F.split_part(signature, F.lit("-"), F.lit(1))


def articles(signatures: Column) -> Column:
    """Distinct articles of an array of signatures, in order of first occurrence, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(signatures, article_of), lambda x: x != ""))


def parse(query: Column) -> Column:
    """struct(dieu, khoan, diem, normalized, error) of a free-form citation.

    Accents and blanks go, label words and every run of other signs separate; order counts, words do not. Leading
    zeros are kept. Errors: null, nothing left, an article that is not a number, more than three parts.
    """
    shown = F.concat(F.lit("'"), query, F.lit("'"))
    folded = F.regexp_replace(strip_accents(F.lower(query)), r"(?U)\s+", "")
    unlabelled = F.regexp_replace(folded, r"(?:dieu|đieu|khoan|diem|điem)", "-")
    parts = F.filter(F.split(F.regexp_replace(unlabelled, r"[^0-9a-zđ]+", "-"), "-"), lambda x: x != "")
    n = F.size(parts)
    error = (
        F.when(query.isNull(), F.lit("signature is None"))
        .when(strip(query) == "", F.lit("signature is empty"))
        .when(n == 0, F.concat(F.lit("invalid signature: "), shown))
        .when(~F.get(parts, F.lit(0)).rlike(r"^\d+$"), F.concat(F.lit("invalid dieu in signature: "), shown))
        .when(n > 3, F.concat(F.lit("too many parts in signature: "), shown))
    )
    good = error.isNull()
    return F.struct(
        F.when(good, F.get(parts, F.lit(0))).alias("dieu"),
        F.when(good, F.get(parts, F.lit(1))).alias("khoan"),
        F.when(good, F.get(parts, F.lit(2))).alias("diem"),
        F.when(good, F.array_join(parts, "-")).alias("normalized"),
        error.alias("error"),
    )


def lookup_key(c: Column) -> Column:
    """The form in which stored indexes are compared with parsed ones."""
    return strip_accents(plain_token(c))
