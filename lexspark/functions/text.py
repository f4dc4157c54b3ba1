"""Column functions on text: accent folding, token normalisation, keys, multi-value splitting.

Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one base letter, by rule over the Latin blocks, and combining marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(source) + marks, "".join(target)


_FROM, _TO = _fold_table()
SPACES = r"(?U)^\s+|\s+$"


def strip_accents(c: Column) -> Column:
    """Without combining marks and accents; đ and Đ stay. Works on composed and decomposed text alike."""
    return F.translate(c, _FROM, _TO)


def strip_diacritics(c: Column) -> Column:
    """As strip_accents, and đ becomes d."""
    return F.translate(strip_accents(c), "đĐ", "dD")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, SPACES, "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def heading_norm(c: Column) -> Column:
    """A line without its leading Markdown marks, stars and backslashes, folded with đ as d, upper case."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^#{1,6}\s*", ""), r"[*\\]", "")
    return F.upper(strip_diacritics(strip(bare)))


def lookup_token(c: Column) -> Column:
    """Lower case, accents off (đ stays), no white space."""
    return F.regexp_replace(strip_accents(F.lower(c)), r"(?U)\s+", "")


def plain_token(c: Column) -> Column:
    """Lower case, no white space, accents kept."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


# The label words and separators of the next two functions.
def label_token(c: Column, lower: bool = False) -> Column:
    """A legal index without its label word, outer blanks and dots, and inner white space."""
    bare = F.regexp_replace(strip(c), r"(?iu)^(điều|dieu|khoản|khoan|điểm|diem)\s+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[ .]+|[ .]+$", ""), r"(?U)\s+", "")
    return F.lower(bare) if lower else bare


def split_values(c: Column) -> Column:
    """Values of a cell separated by , ; / or a connecting word, blanks dropped; null gives an empty array."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?iu),|;|/|(?<![\p{L}\p{N}_])(?:và|va|and)(?![\p{L}\p{N}_])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def name_key(c: Column) -> Column:
    """Folded, lower case, only a-z and 0-9 (so đ is deleted)."""
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", "")


def name_norm(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(collapse(c))


def slug(c: Column, default: str = "default") -> Column:
    """Runs of other than letters and digits become _; lower case; ``default`` where nothing is left."""
    s = F.lower(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s)


def unfence(c: Column) -> Column:
    """The inside of a Markdown code fence, or the text itself."""
    return strip(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*\n?|\n?```$", ""))


def drop_page_breaks(c: Column) -> Column:
    """Page separators of the converter ({12}-----) become one blank line."""
    return F.regexp_replace(c, r"\n*\s*\{?\d+\}?-{3,}\s*\n*", "\n\n")


def first_line(c: Column) -> Column:
    """First line that is not blank, or an empty text."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), F.lit(0)), F.lit(""))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether any of the words occurs; false for null."""
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.contains(c, F.lit(w)), F.lit(False))
    return out


def is_penal_code(c: Column) -> Column:
    """Whether a source names the penal code, accents and case ignored; null and blank are false."""
    folded = F.lower(strip_accents(F.coalesce(c, F.lit(""))))
    return F.contains(folded, F.lit("blhs")) | F.contains(folded, F.lit("bo luat hinh su"))


def is_penal_code_literal(c: Column) -> Column:
    """The weaker test on the accented words only."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("bộ luật hình sự"))


def letter_case(c: Column) -> Column:
    """none, upper, lower, title or mixed, by the letters of a text."""
    letters = F.regexp_replace(c, r"[^\p{L}\s]", "")
    any_letter = F.regexp_replace(letters, r"\s", "") != ""
    title = letters.rlike(r"^\s*(\p{Lu}\p{Ll}*\s*)+$")
    return F.when(~any_letter, "none").when(letters == F.upper(letters), "upper").when(letters == F.lower(letters), "lower").when(title, "title").otherwise("mixed")


def apply_case(c: Column, kind: Column) -> Column:
    """A text brought to a letter case of ``letter_case``; mixed and none leave it as it is."""
    return F.when(kind == "upper", F.upper(c)).when(kind == "lower", F.lower(c)).when(kind == "title", F.initcap(c)).otherwise(c)


def accept_correction(old: Column, new: Column, limit: float = 0.4) -> Column:
    """Whether a spelling suggestion is trusted: other accents only, or at most two edits of a small part.

    Suggestions that only change punctuation at the end or bring in new signs are refused.
    """
    bare_old, bare_new = F.lower(strip_accents(old)), F.lower(strip_accents(new))
    edits = F.levenshtein(F.lower(old), F.lower(new))
    tail = F.regexp_replace(old, r"\p{P}+$", "") == F.regexp_replace(new, r"\p{P}+$", "")
    signs = new.rlike(r"[^\p{L}\p{N}\s]") & ~old.rlike(r"[^\p{L}\p{N}\s]")
    near = (edits <= 2) & (edits / F.greatest(F.length(old), F.lit(1)) < limit)
    return ~tail & ~signs & ((bare_old == bare_new) | near)


def map_text(c: Column) -> Column:
    """The non-blank values of a map of texts, in key order, separated by blank lines; null gives an empty text."""
    entries = F.array_sort(F.map_entries(c))
    return F.coalesce(F.array_join(F.filter(F.transform(entries, lambda e: strip(e["value"])), lambda x: x != ""), "\n\n"), F.lit(""))


def http_answer(status: Column, body: Column) -> Column:
    """struct(usable, detail) of a status code: 2xx is usable, 401 and 403 are failed authorisations."""
    code = F.concat(F.lit("HTTP "), status.cast("string"))
    snippet = F.substring(collapse(F.coalesce(body, F.lit(""))), 1, 180)
    ok = status.between(200, 299)
    detail = F.when(ok, code).when(status.isin(401, 403), F.concat(code, F.lit(" (auth failed)"))).when(snippet != "", F.concat(code, F.lit(": "), snippet)).otherwise(code)
    return F.struct(F.when(ok, "yes").otherwise("no").alias("usable"), detail.alias("detail"))


def exact_round(c: Column, places: int) -> Column:
    """Rounding of the exact binary value, half to even, as Python does; for byte-equal reports only."""
    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None or x != x else round(x, places))

    return run(c)
