"""Months of imprisonment in a penalty text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import collapse, strip_accents

LIFE_MONTHS = 360
# Folded phrases of outcomes without imprisonment.
NON_CUSTODIAL = (
    "cai tao khong giam giu",
    "an treo",
    "phat tien",
    "canh cao",
    "mien hinh phat",
    "khong phai chap hanh hinh phat tu",
    "khong phai di tu",
    "khong tu",
)
_N = r"(\d{1,3})"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _years_months(text: Column, end: str) -> Column:
    both = rf"{_N}\s*nam\s*{_N}\s*thang{end}"
    years, months = rf"{_N}\s*nam{end}", rf"{_N}\s*thang{end}"
    return F.coalesce(_number(text, both, 1) * 12 + _number(text, both, 2), _number(text, years, 1) * 12, _number(text, months, 1))


def _any_years_months(text: Column) -> Column:
    """Years and months wherever they stand in a fragment; null without either."""
    y, m = _number(text, rf"{_N}\s*nam\b", 1), _number(text, rf"{_N}\s*thang\b", 1)
    return F.when(y.isNotNull() | m.isNotNull(), F.coalesce(y, F.lit(0)) * 12 + F.coalesce(m, F.lit(0)))


def months(text: Column, fold_d: bool = False) -> Column:
    """Months, 0 for null, blank and non-custodial texts.

    Precedence: no imprisonment; the joint penalty; the middle of a range (half to even); a number of years and
    months of imprisonment; life (360); any number of years or months. Folding keeps đ as the reference does, so an
    accented range or negation with đ is not seen; ``fold_d`` folds it too.
    """
    low = F.lower(strip_accents(collapse(F.coalesce(text, F.lit("")))))
    if fold_d:
        low = F.translate(low, "đ", "d")
    s = collapse(F.regexp_replace(low, r"\([^)]*\)", " "))
    free = reduce(lambda a, b: a | b, [F.contains(s, F.lit(m)) for m in NON_CUSTODIAL])
    joint = F.regexp_extract_all(s, F.lit(r"(tong hop[^.;,:\n]*)"), F.lit(1))
    joint_months = F.transform(joint, lambda x: F.coalesce(_any_years_months(x), F.when(F.contains(x, F.lit("chung than")), F.lit(LIFE_MONTHS))))
    years = rf"tu\s*{_N}\s*nam\s*den\s*{_N}\s*nam"
    spans = rf"tu\s*{_N}\s*thang\s*den\s*{_N}\s*thang"
    middle = F.coalesce((_number(s, years, 1) + _number(s, years, 2)) * 12 / 2, (_number(s, spans, 1) + _number(s, spans, 2)) / 2)
    found = F.coalesce(
        F.get(F.filter(joint_months, lambda x: x.isNotNull()), F.lit(0)),
        F.bround(middle, 0).cast("int"),
        _years_months(s, r"\s*tu\b"),
        F.when(F.contains(s, F.lit("chung than")), F.lit(LIFE_MONTHS)),
        _years_months(s, ""),
        F.lit(0),
    )
    return F.when((s == "") | free, F.lit(0)).otherwise(found)
