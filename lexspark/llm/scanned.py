"""Noise in text from scanned pages: broken words, misread characters, running headers, page numbers.

Corpus evidence is counted over all texts, then judged in SQL:

* the hash of a word is the sum of its characters' hashes, so a confusion (``rn`` for ``m``) shifts it by a constant.
  Confusions are those known to occur in scans and those the collection shows: rare and frequent words are joined
  by hash less that of one or two characters, and a difference that recurs in many words, in one direction only and as
  the usual fate of what it replaces, is a confusion; differences of accents, case and typing slips are none;
* a rare word is joined with the frequent words it may be a misreading of by hash + shift, for any number of
  confusions in it; candidates are verified by replacement and ranked by frequency;
* numbers are judged by their shape (digits as 9): a token is misread where its shape is rare and the one with letters
  read as digits is common;
* a line is a running header if it stands beside a page number, or if its key (letters only, confusions undone) or
  the first or last words of that are those of lines that repeat or stand next to page numbers in several texts;
* a word cut at a line end is joined unless the hyphenated form is the usual one in the collection.

Scale: the texts are scanned twice and shuffled once, where copies become one text; what moves besides are word counts
(combined per task), line keys and the few candidate tokens of each text.  Corrections are joined, not broadcast by hand.

Defined results of odd input: null and empty texts give no rows; a text without line breaks can only hold misread
characters; repeated rows of one id are reported once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import strip_diacritics
from lexspark.runtime import cut

# What scanners read (left) for what was printed (right).
CONFUSIONS: tuple[tuple[str, str], ...] = (
    ("rn", "m"), ("ii", "u"), ("cl", "d"), ("lc", "k"), ("l1", "h"), ("I\\I", "N"), ("\\/", "V"), ("\\/", "v"), ("vv", "w"),
    ("|", "i"), ("|", "l"), ("!", "i"), ("!", "l"), ("1", "l"), ("1", "i"), ("0", "o"), ("0", "O"), ("9", "g"), ("9", "q"),
    ("6", "b"), ("5", "S"), ("8", "B"), ("@", "a"), ("†", "t"), ("ñ", "n"), ("ћ", "h"), ("ƣ", "ư"), ("ð", "đ"), ("Ð", "Đ"),
    ("§", "S"), ("§", "s"), ("$", "S"), ("(", "c"), ("€", "e"), ("€", "C"), ("£", "E"), ("¢", "c"), ("ō", "ơ"),
)
MARKS = "-‐‑¬­"
MIN_RATIO = 8  # a target must be so many times as frequent as its misreading
FREQUENT = 20  # words that show a confusion are misreadings of words with at least this count
RECUR = 10  # words that must show a confusion
SHOWS = 40  # characters of the longest words that confusions are learned from; they are applied to words of any length
WIDE = 2  # a header is at most so many times as long as the text's usual line
USUAL = 60  # characters of a usual line at least, for texts of few lines
READINGS = 2048  # of one word; beyond that each further sign is read in one way only
_HAS_LETTER = re.compile(r"[^\W\d_]")
_CODE = re.compile(r"[A-Za-z]{1,3}\d{2,}.*|\d{1,2}[A-Z]\d.*|[\d.,:/-]+|\d+(?:kg|g|m|km|đ|m2|h|%)|\d[\d.,]*đ")
_NUMBER_LIKE = re.compile(r"(?=\S*[OoIl])(?:\S*\d\S*|[OoIl.,/:-]{2,})")
_GROUPED = re.compile(r"(?=\S*\d)[\dOoIl]{1,3}(?:[.,][\dOoIl]{3})+")  # groups of three need no evidence
_DIGIT = re.compile(r"\d")
_CUT = re.compile(rf"(?:^|\s)([^\s\d]*[^\W\d_])[{MARKS}]$")
_PAGE = re.compile(r"[~\-–—\[({|\s]*(?:(?:trang|tr\.?|page|p\.)\s*(?:so\s*)?:?\s*)?(\d{1,4})\s*(?:/\s*\d{1,4})?\s*[~\-–—\])}|\s.]*", re.I)
_SURE_PAGE = re.compile(r"(?:[~\-–—\[{(]+\s*\d{1,4}\s*[~\-–—\]})]+|\d{1,4}\s*\|| \|\s*\d{1,4}|(?:trang|tr\.|page)\s*(?:so\s*)?\d{1,4}(?:\s*/\s*\d{1,4})?)\s*", re.I)
_NUMBER = r"(?:[~\-–—\[({]*\s*(?:trang\s*(?:so\s*)?|tr\.\s*|page\s*)?\d{1,4}(?:\s*/\s*\d{1,4})?\s*[~\-–—\])}|.]*)"
_BESIDE = re.compile(rf"(?P<left>.*\S)(?:\s{{2,}}|\t)(?P<after>{_NUMBER})|(?P<before>{_NUMBER})(?:\s{{2,}}|\t)(?P<right>\S.*)")
_STYLED = re.compile(r"\s{2,}\S|\s\|\s")
_ITEM = re.compile(r"\s*(?:\d{1,3}[.)]\s+\S|[-+•]\s+\S|[a-zđ]\)\s)")


def fold(text: str) -> str:
    """Lower case without accents; đ counts as d."""
    s = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in s if not unicodedata.combining(c)).replace("đ", "d")


_UNDO = tuple((a.lower(), fold(b)) for a, b in dict(CONFUSIONS).items() if a not in tuple("156890(|"))


def line_key(line: str) -> str:
    """Letters of a line without accents, case, numbers and confusions: equal for the same header on every page."""
    s = re.sub(r"(?<=\s)\|(?=\s)", "zz", line.lower())  # a bar between two parts counts as a word
    for a, b in _UNDO:
        s = s.replace(a, b)
    return re.sub(r"[^a-z]+", " ", fold(s)).strip()


def core(token: str) -> str:
    """A token without the punctuation around it; signs that may be misread letters stay."""
    t = token.strip(".,;:?\"“”…»«'’")
    if t[:1] == "(" and t[-1:] == ")":
        t = t[1:-1]
    return t.rstrip(")") if "(" not in t else t


class Page:
    """The lines of a text with the roles of its running headers and page numbers."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        filled = [k for k, line in enumerate(self.lines) if line.strip()]
        self.inner = filled[1:-1]
        self.before = {k: filled[at] for at, k in enumerate(filled[1:])}
        self.after = {filled[at]: filled[at + 1] for at in range(len(filled) - 1)}
        lengths = sorted(len(self.lines[k]) for k in filled)
        self.widest = WIDE * max(lengths[len(lengths) // 2], USUAL) if filled else 0  # a header fits on a line of the page
        self.page: dict[int, int] = {}  # line -> page number
        self.header: dict[int, str] = {}  # line -> key
        self._pages()

    def _interrupts(self, k: int) -> bool:
        """The text before a line runs on after it."""
        before, after = self.lines[self.before[k]].rstrip(), self.lines[self.after[k]].lstrip()
        return not before.endswith((".", ":", ";")) and not _ITEM.match(after)

    def _pages(self) -> None:
        weak = []
        for k in self.inner:
            s = self.lines[k].strip()
            if len(s) > self.widest:
                continue
            f = fold(s)
            alone = _PAGE.fullmatch(f)
            if alone and not re.fullmatch(r"\d+-", f):
                if _SURE_PAGE.fullmatch(f):
                    self.page[k] = int(alone.group(1))
                else:
                    weak.append((k, int(alone.group(1))))
            elif (m := _BESIDE.fullmatch(f)) and not _ITEM.match(f):
                words = m["left"] or m["right"]
                if _HAS_LETTER.search(words) and words[-1:] not in ".;,":
                    self.page[k] = int(re.search(r"\d+", m["after"] or m["before"]).group())
                    self.header[k] = line_key(words)
        numbers = sorted([(k, v) for k, v in self.page.items()] + weak)
        for at, (k, v) in enumerate(numbers):
            if k in self.page:
                continue
            near = [numbers[i][1] for i in (at - 1, at + 1) if 0 <= i < len(numbers)]
            follows = any(abs(x - v) == 1 for x in near)
            if follows or (v < 1000 and self._interrupts(k)):  # larger ones alone may be years
                self.page[k] = v

    def candidates(self) -> Iterator[tuple[int, str, int]]:
        """Lines that may be headers: (line, key, level).

        Level 1: the line repeats or stands next to a page number; 2: moreover it is in capitals or has wide gaps, or
        a page number stands on the line itself; 0: nothing is known.
        """
        for k, key in self.header.items():
            yield k, key, 2
        keys = {}
        for k in self.inner:
            s = self.lines[k].strip()
            if k in self.page or k in self.header or len(s) > self.widest or _ITEM.match(s) or s[-1:] in ".;,:" or re.search(r"[.;] \D", s):
                continue
            key = line_key(s)
            if len(key) >= 4:
                keys[k] = key
        times = Counter(keys.values()) + Counter(self.header.values())
        breaks = {keys[k] for k in keys if self._interrupts(k)}
        for k, key in keys.items():
            s = self.lines[k].strip()
            beside_page = self.before.get(k) in self.page or self.after.get(k) in self.page
            styled = s.isupper() or bool(_STYLED.search(s))
            if s[:1].islower() and not styled:
                continue
            sure = beside_page or (times[key] > 1 and (styled or key in breaks))
            yield k, key, int(sure) + int(sure and styled)

    def body(self) -> tuple[list[tuple[int, str]], list[tuple[str, str]]]:
        """The lines (number, text) without page lines, cut words joined, and the forms (joined, hyphenated) of those."""
        rows = [[k, line.rstrip()] for k, line in enumerate(self.lines) if k not in self.page]
        cuts: list[tuple[str, str]] = []
        for at, (_, line) in enumerate(rows):
            m = _CUT.search(line)
            if not m:
                continue
            for later in range(at + 1, min(at + 4, len(rows))):  # a header may stand between the parts
                text = rows[later][1].lstrip()
                if text[:1].isalpha() and (text[0].islower() or (m[1].isupper() and text[:2].isupper())):
                    head, _, rest = text.partition(" ")
                    cuts.append((core(m[1] + head), core(m[1] + "-" + head)))
                    rows[at][1] = line[:-1] + head
                    rows[later][1] = rest
                    break
        return [(k, line) for k, line in rows], cuts


def affixes(key: str) -> tuple[str, str]:
    """First and last words of a line key: headers of one form differ in names and numbers only."""
    w = key.split(" ")
    return " ".join(w[:3]) + " *", "* " + " ".join(w[-2:])


def _words(text: str) -> Iterator[str]:
    for token in unicodedata.normalize("NFC", text).split():
        t = core(token)
        if t:
            yield t


def _is_word(t: str) -> bool:
    return bool(_HAS_LETTER.search(t)) and not _CODE.fullmatch(t)


def evidence(texts: DataFrame) -> DataFrame:
    """(kind, key, n, sure): counts of words and shapes of numbers over all distinct texts, and of header candidates by key over all texts.

    A copied text is no further evidence of a word: its misreadings would be as frequent as words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        shapes: Counter = Counter()
        lines: Counter = Counter()
        certain: Counter = Counter()
        for b in batches:
            for text, copies in zip(b["t"], b["copies"], strict=True):
                words.update(_words(text))
                if "\n" in text:
                    seen: dict[str, int] = {}
                    for _, key, level in Page(text).candidates():
                        for x in affixes(key):
                            seen[x] = max(seen.get(x, 0), min(level, 1))
                    for x, level in seen.items():
                        lines[x] += copies
                        certain[x] += copies * level
        for w, c in words.items():
            if _DIGIT.search(w) or _NUMBER_LIKE.fullmatch(w):
                shapes[_DIGIT.sub("9", w)] += c
        kept = [(w, c) for w, c in words.items() if _is_word(w)]
        rows = [("word", w, c, 0) for w, c in kept] + [("shape", w, c, 0) for w, c in shapes.items()] + [("line", k, c, certain[k]) for k, c in lines.items()]
        yield pd.DataFrame(rows, columns=["kind", "key", "n", "sure"])

    once = texts.groupBy(F.xxhash64("t").alias("h")).agg(F.any_value("t").alias("t"), F.count("*").alias("copies")).select("t", "copies")
    found = once.mapInPandas(run, "kind string, key string, n long, sure long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure"))


def _anagram(word: Column) -> Column:
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: acc + F.xxhash64(c).bitwiseAND(F.lit((1 << 40) - 1)))


def _plain(word: Column) -> Column:
    return strip_diacritics(F.lower(word))


def learn(words: DataFrame) -> list[tuple[str, str]]:
    """Confusions (read, printed) of one or two characters that recur in the words (key, n) of a collection.

    The driver gets those that recur, a few of the pairs that the alphabet allows.
    """
    most = words.groupBy(_plain(F.col("key")).alias("p")).agg(F.max("n").alias("most"))
    known = words.select("key", "n", _plain(F.col("key")).alias("p")).join(most, "p")
    known = known.select("key", "n", (F.col("most") < MIN_RATIO * F.col("n")).alias("own"))  # else a word without its accents or in other case

    def parts(size: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length("key") - (size - 1), F.lit(1)))
        cut_ = F.transform(at, lambda i: F.struct(F.substring("key", F.lit(1), i - 1).alias("before"), F.substring("key", i, F.lit(size)).alias("x"), F.expr("key").substr(i + size, F.length("key")).alias("after")))
        return F.when(F.length("key") > size, cut_).otherwise(F.slice(cut_, 1, 0))

    split = known.where(F.length("key").between(3, SHOWS)).select("key", "n", "own", F.explode(F.concat(parts(1), parts(2))).alias("c")).select("key", "n", "own", "c.*")
    split = cut(split.where(F.length(F.concat("before", "after")) >= 2).withColumn("h", _anagram(F.col("key")) - _anagram(F.col("x"))))
    read = split.where("own").select("h", "before", "after", F.col("key").alias("variant"), F.col("n").alias("n_variant"), F.col("x").alias("a"))
    meant = split.where(F.col("n") >= FREQUENT).select("h", "before", "after", F.col("n").alias("n_target"), F.col("x").alias("b"))
    met = read.join(meant, ["h", "before", "after"]).where((F.col("n_target") >= MIN_RATIO * F.col("n_variant")) & ~F.arrays_overlap(F.split(_plain(F.col("a")), ""), F.split(_plain(F.col("b")), "")))
    shown = met.groupBy("a", "b").agg(F.count_distinct("variant").alias("n"))
    back = shown.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("back"))
    best = shown.groupBy("a").agg(F.max("n").alias("best"))
    rare = split.where("own").where(F.col("n") < FREQUENT).groupBy(F.col("x").alias("a")).agg(F.count_distinct("key").alias("rare"))
    kept = shown.where(F.col("n") >= RECUR).join(best, "a").join(back, ["a", "b"], "left").join(rare, "a", "left")
    kept = kept.where("20 * coalesce(back, 0) <= n and 2 * n >= best and 4 * n >= coalesce(rare, 0)")
    found = [(r["a"], r["b"]) for r in kept.orderBy(F.desc("n"), "a", "b").collect() if not set(r["a"] + r["b"]) & set(MARKS)]
    alone = {a for a, _ in (*found, *CONFUSIONS) if len(a) == 1}
    return [(a, b) for a, b in found if (a, b) not in CONFUSIONS and (len(a) == 1 or not set(a) & alone)]


def _left(table: list[tuple[str, str]]) -> str:
    return "|".join(sorted({re.escape(a) for a, _ in table}, key=len, reverse=True))


def corrections(words: DataFrame, table: list[tuple[str, str]] | tuple[tuple[str, str], ...] = CONFUSIONS) -> DataFrame:
    """(variant, target, n_variant, n_target): the best frequent word for each misread one.

    Any number of confusions a word, each in one place or in all; a target must be ``MIN_RATIO`` times as frequent and
    hold no sign itself.
    """
    rare = words.where(F.col("key").rlike(_left(table))).select(F.col("key").alias("variant"), F.col("n").alias("n_variant"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in table])

    def read(readings: Column, p: Column) -> Column:
        def all_of(w: Column) -> Column:
            return F.replace(w, p["a"], p["b"])

        def first_of(w: Column) -> Column:
            at = F.position(p["a"], w)
            return F.concat(F.substring(w, F.lit(1), at - 1), p["b"], w.substr(at + F.length(p["a"]), F.length(w)))

        hit = F.filter(readings, lambda w: w.contains(p["a"]))
        more = F.array_union(readings, F.array_union(F.transform(hit, all_of), F.transform(hit, first_of)))
        return F.when(F.size(hit) == 0, readings).when(F.size(readings) > READINGS, F.transform(readings, all_of)).otherwise(more)

    readings = F.aggregate(pairs, F.array("variant"), read)
    tries = rare.select("variant", "n_variant", F.explode(readings).alias("w1")).where("w1 <> variant").withColumn("h", _anagram(F.col("w1")))
    clean = words.where(~F.col("key").rlike(r"[^\p{L}\p{M}-]|ii|rn$|^cl|lc|[ñðћƣ]")).select(F.col("key").alias("target"), F.col("n").alias("n_target")).withColumn("h", _anagram(F.col("target")))
    met = tries.join(clean, "h").where((F.col("w1") == F.col("target")) & (F.col("n_target") >= MIN_RATIO * F.col("n_variant")))
    best = met.groupBy("variant").agg(F.max(F.struct("n_target", "target")).alias("x"), F.max("n_variant").alias("n_variant"))
    return best.select("variant", F.col("x.target").alias("target"), "n_variant", F.col("x.n_target").alias("n_target"))


def signs(texts: DataFrame, table: list[tuple[str, str]] | tuple[tuple[str, str], ...] = CONFUSIONS) -> DataFrame:
    """(id, field, kind, a, b, level): everything in a text that is or may be noise.

    Kinds: ``page_no``; ``line`` (a: key of a line that may be a header; level as in ``Page.candidates``); ``cut``
    (a: joined, b: hyphenated form); ``number`` and ``word`` (a: a token that may be misread, b: key of its line
    where that may be a header).
    """
    left = _left(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        misread = re.compile(left)
        for b in batches:
            out: set[tuple] = set()
            for rid, field, text in zip(b["id"], b["field"], b["t"], strict=True):
                rows, maybe = [(0, text)], {}
                if "\n" in text:
                    p = Page(text)
                    if p.page:
                        out.add((rid, field, "page_no", "", "", 2))
                    for k, key, level in p.candidates():
                        out.add((rid, field, "line", key, "", level))
                        maybe[k] = key
                    rows, cuts = p.body()
                    for joined, hyphened in cuts:
                        out.add((rid, field, "cut", joined, hyphened, 0))
                for k, line in rows:
                    for t in _words(line):
                        if _NUMBER_LIKE.fullmatch(t):
                            out.add((rid, field, "number", t, maybe.get(k, ""), int(_GROUPED.fullmatch(t) is not None)))
                        if misread.search(t) and _is_word(t):
                            out.add((rid, field, "word", t, maybe.get(k, ""), 0))
            yield pd.DataFrame(list(out), columns=["id", "field", "kind", "a", "b", "level"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "field", "t").mapInPandas(run, f"id {kind}, field string, kind string, a string, b string, level int")


def headers(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, field, key): lines that are running headers.

    A form (the first or the last words of a key) is known where at least three texts hold it with evidence of
    their own and these are four fifths of all texts that hold it.
    """
    known = lines.where("sure >= 3 and sure >= 0.8 * n").select("key")
    rows = found.where("kind = 'line'").select("id", "field", F.col("a").alias("key"), "level")
    words = F.split("key", " ")
    n = F.size(words)
    first = F.concat(F.array_join(F.slice(words, 1, 3), " "), F.lit(" *"))
    last = F.concat(F.lit("* "), F.array_join(F.slice(words, F.greatest(n - 1, F.lit(1)), 2), " "))
    forms = rows.where("level < 2").select("id", "field", "key", F.explode(F.array(first, last)).alias("form"))
    by_form = forms.join(known.withColumnRenamed("key", "form"), "form", "left_semi").select("id", "field", "key")
    return rows.where("level = 2").select("id", "field", "key").unionByName(by_form).distinct()


def _judged(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signs of all texts, their headers, and the tokens and cut words of the texts that are noise."""
    counts = cut(evidence(texts))
    words = counts.where("kind = 'word'").select("key", "n")
    table = [*CONFUSIONS, *learn(words)]
    fixes = cut(corrections(words, table))
    found = cut(signs(texts, table))
    heads = cut(headers(found, counts.where("kind = 'line'")))
    tokens = found.where("kind in ('word', 'number')").join(heads.withColumnRenamed("key", "b"), ["id", "field", "b"], "left_anti")
    shapes = counts.where("kind = 'shape'").select("key", "n")
    misread = tokens.where("kind = 'word'").join(fixes.select(F.col("variant").alias("a"), "target"), "a").select("id", "field", "a", "target")
    numbers = tokens.where("kind = 'number'").select("id", "field", "a", "level", F.translate("a", "OoIl", "0011").alias("target"))
    for side, n in (("a", "n_own"), ("target", "n_read")):
        numbers = numbers.withColumn("shape", F.regexp_replace(side, "[0-9]", "9")).join(shapes.select(F.col("key").alias("shape"), F.col("n").alias(n)), "shape", "left").drop("shape")
    numbers = numbers.where(F.expr(f"level = 1 or coalesce(n_read, 0) >= {MIN_RATIO} * greatest(coalesce(n_own, 0), 1)")).select("id", "field", "a", "target")
    cuts = found.where("kind = 'cut'").select("id", "field", "a", "b")
    usual = cuts.join(words.select(F.col("key").alias("a"), F.col("n").alias("n_joined")), "a", "left").join(words.select(F.col("key").alias("b"), F.col("n").alias("n_hyphened")), "b", "left")
    broken = usual.select("id", "field", "a", "b", F.expr("coalesce(n_hyphened, 0) < 2 or coalesce(n_joined, 0) > n_hyphened").alias("broken"))
    return found, heads, misread.unionByName(numbers), broken


def find_noise(texts: DataFrame) -> DataFrame:
    """(id, field, kind) of texts (id, field, t): the kinds of scan noise that each text holds."""
    found, heads, chars, broken = _judged(texts.where(F.length("t") > 0))
    pages = found.where("kind = 'page_no'")
    parts = [x.select("id", "field", F.lit(k).alias("kind")) for k, x in (("page_no", pages), ("header", heads), ("char", chars), ("hyphen", broken.where("broken")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


_TOKEN = re.compile(r"\S+")


def mend(text: str, heads: set[str], fixes: dict[str, str], hyphened: dict[str, str]) -> str:
    """A text in whole paragraphs: headers and page numbers out, cut words joined, misread words replaced.

    A blank line or a list item begins a paragraph; ``hyphened`` are the cut words that keep their hyphen.
    """

    def right(m: re.Match) -> str:
        token = m.group()
        inner = core(unicodedata.normalize("NFC", token))
        target = fixes.get(inner) or hyphened.get(inner)
        return unicodedata.normalize("NFC", token).replace(inner, target) if target else token

    out: list[str] = []
    fresh = True
    if "\n" in text:
        p = Page(text)
        drop = {k for k, key, level in p.candidates() if key in heads or k in p.header}
        rows, _ = p.body()
        for k, line in rows:
            if k in drop:
                continue
            if not line.strip():
                fresh = fresh or k not in p.page
            elif fresh or _ITEM.match(line) or not out:
                out.append(line.strip())
                fresh = False
            else:
                out[-1] += " " + line.strip()
    else:
        out = [text]
    return "\n".join(_TOKEN.sub(right, line) for line in out)


def repair(texts: DataFrame) -> DataFrame:
    """(id, field, repaired): every text in continuous paragraphs. The texts are shuffled once more, to meet their fixes."""
    texts = texts.where(F.length("t") > 0)
    _, heads, chars, broken = _judged(texts)
    keys = heads.groupBy("id", "field").agg(F.collect_set("key").alias("heads"))
    fixes = chars.groupBy("id", "field").agg(F.collect_set(F.struct("a", "target")).alias("fixes"))
    kept = broken.where("not broken").groupBy("id", "field").agg(F.collect_set(F.struct("a", "b")).alias("kept"))
    rows = texts.join(keys, ["id", "field"], "left").join(fixes, ["id", "field"], "left").join(kept, ["id", "field"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [
                mend(t, set() if h is None else set(h), {} if f is None else {x["a"]: x["target"] for x in f}, {} if k is None else {x["a"]: x["b"] for x in k})
                for t, h, f, k in zip(b["t"], b["heads"], b["fixes"], b["kept"], strict=True)
            ]
            yield pd.DataFrame({"id": b["id"], "field": b["field"], "repaired": done})

    kind = texts.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, field string, repaired string")
