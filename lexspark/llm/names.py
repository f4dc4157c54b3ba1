"""Variant spellings of names: MinHash banding, Monge-Elkan verification, star clustering.

A written name is parsed into its name proper, its other names (aliases) and notes that do not belong to it.  Inside
a block (one judgment, or one birth date and residence) candidates are names that share a MinHash band over padded
q-grams of the folded, sorted name, or one of its short forms (initials with given name, given name, an alias); the
number of bands follows from the collision curve for the recall asked.  Candidates are scored by Monge-Elkan
similarity with an edit distance that knows transpositions and abbreviations.  Clusters are stars: the names of the
reference list are the centres, every other name joins its most similar centre.

Accents of the given name decide between centres: a name equal to a centre with accents belongs to that one, and a
name that fits two centres equally well to neither, unless the other centre already has its own name in that list.

Scale: keys of blocks of very many names are split into parts; vertices are the distinct written names of a block, so a name that is repeated a million times is one vertex;
where a block has centres, other names are linked to these only.  Names that no centre takes are compared with all
names they share a key with, so the pairs of a block of very many distinct names grow with the square of the names
under one key.  All steps are equi-joins and windows over a name's candidates.

Defined results of odd input: null and blank names are nobody; equal strings are never linked to each other; equal
names of one block count once; rows that were delivered again count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.runtime import cut

Q = 2
RECALL = 0.99
AT = 0.45  # q-gram Jaccard similarity at which that recall is asked
ROWS = 2
ACCEPT = 0.74
_MARK = re.compile("[̀-ͯ]+")
_PREFIX = re.compile(r"^\s*(?:bị\s+cáo|bi\s+cao|bị\s+can|bc|ông|bà)\s*(?:tên|ten)?\s*:?\s+", re.I)
_BORN = re.compile(r"[(,]?\s*(?:\bSN|\bsinh(?:\s+(?:năm|nam))?)\s*:?\s*\d{4}\s*\)?|\s*[-–,]\s*\d{4}\s*$", re.I)
_ALIAS = re.compile(r"(?:[,\-–(]\s*|\s)(?:tên\s+gọi\s+khác|ten\s+goi\s+khac|còn\s+gọi\s+là|tức|tuc|tự|tu)(?=[\s:“\"])\s*:?\s*[“\"]?([^”\")]+)[”\"]?\s*\)?", re.I)
_BRACKET = re.compile(r"\(([^)]*)\)|[“\"]([^”\"]*)[”\"]")


def fold(text: str) -> str:
    return _MARK.sub("", unicodedata.normalize("NFD", text.lower())).replace("đ", "d")


class Name:
    """The tokens of a name in written order (lower case), folded, and its folded aliases."""

    __slots__ = ("accented", "folded", "aliases")

    def __init__(self, written: str):
        s = unicodedata.normalize("NFC", written).replace("\xa0", " ")
        s = _BORN.sub(" ", _PREFIX.sub("", s))
        found: list[str] = []

        def take(m: re.Match) -> str:
            found.extend(g for g in m.groups() if g)
            return " "

        s = _BRACKET.sub(take, _ALIAS.sub(take, s))
        found = [re.sub(r"(?i)^\s*(?:tên gọi khác|ten goi khac|tức|tự|tuc|tu)\s*:?\s+", "", a) for a in found]
        s = s.strip(" .,;:-–")
        if "," in s:  # given name first
            given, _, rest = s.partition(",")
            s = f"{rest} {given}"
        if not s.isupper():
            s = "".join(f" {c}" if k and c.isupper() and s[k - 1].islower() else c for k, c in enumerate(s))  # a lost blank
        self.accented = [t for t in re.split(r"[^\ẁ-ͯ]+", s.lower()) if t]
        self.folded = [fold(t) for t in self.accented]
        self.aliases = [a for a in (" ".join(re.findall(r"\w+", fold(x))) for x in found) if a]

    def forms(self) -> tuple[str, list[str]]:
        """The full form for MinHash, and the short forms that are compared whole."""
        f = self.folded
        full = " ".join(sorted(f))
        short = set(self.aliases)
        if f:
            short.add(f[-1])
            short.add(f[0])
            short.add("".join(t[0] for t in f) + "*")
            if len(f) > 1:
                short.add("".join(t[0] for t in f[:-1]) + " " + f[-1])
        return full, sorted(short)


def bands(recall: float = RECALL, at: float = AT, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes for which pairs of similarity ``at`` collide with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - at**rows)))


def _hashes(text: str, n: int) -> np.ndarray:
    """``n`` MinHash values of the padded q-grams of a text."""
    padded = "#" * (Q - 1) + text + "#" * (Q - 1)
    grams = {padded[i : i + Q] for i in range(len(padded) - Q + 1)}
    base = np.array([hash_text(g) for g in grams], np.uint64)
    with np.errstate(over="ignore"):
        h = base[:, None] * _MULTIPLY[None, :n] + _ADD[None, :n]
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0x9E3779B97F4A7C15)).min(0)


@lru_cache(maxsize=100_000)
def hash_text(text: str) -> int:
    """A 64-bit hash that is equal on every machine."""
    import xxhash

    return xxhash.xxh64_intdigest(text)


_random = np.random.default_rng(7)
_MULTIPLY = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, 256, dtype=np.uint64)


def _distance(a: str, b: str) -> int:
    """Edits between two words; a transposition of neighbours is one."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        before, last = last, now
    return last[-1]


@lru_cache(maxsize=200_000)
def token_similarity(a: str, b: str) -> float:
    """1 for equal words, less for lost accents, abbreviations and few edits, else 0."""
    if a == b:
        return 1.0
    x, y = fold(a), fold(b)
    if x == y:
        return 0.97
    short, long = (x, y) if len(x) < len(y) else (y, x)
    if len(short) <= 2 and long.startswith(short):
        return 0.9 if len(short) == 1 or short in ("ng", "tr", "th", "ph", "nh", "kh", "gi", "qu", "ch") else 0.86
    d = _distance(x, y)
    return 1 - 0.8 * d / len(long) if d == 1 and len(long) > 2 or d == 2 and len(long) > 5 else 0.0


def _monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean best similarity of the words of ``a`` among those of ``b``, each used once."""
    free = list(b)
    total = 0.0
    for x in sorted(a, key=len, reverse=True):
        if not free:
            break
        k = max(range(len(free)), key=lambda j: token_similarity(x, free[j]))
        s = token_similarity(x, free[k])
        if s > 0:
            total += s
            free.pop(k)
    return total / len(a)


def similarity(x: Name, y: Name) -> float:
    """How likely two written names are one person's, between 0 and 1."""
    a, b = x.accented, y.accented
    if not a or not b:
        return 0.9 if set(x.aliases) & set(y.aliases) else 0.0
    for m, c in ((x, y), (y, x)):  # m is written by another name of c
        whole = " ".join(m.folded)
        if whole in c.aliases:
            return 0.9
        for alias in c.aliases:
            for given in (c.folded[-1], c.folded[0]):
                alike = token_similarity(m.folded[0], given)
                if alike > 0.6 and (m.folded[1:] == alias.split(" ") or (len(m.folded) == 1 and alias in m.aliases)):
                    return 0.92 * alike
    short, long = sorted((a, b), key=lambda t: (len(t), t))
    ends = max(token_similarity(short[-1], long[-1]), token_similarity(short[0], long[-1]) - 0.02, token_similarity(short[-1], long[0]) - 0.02)
    if ends < 0.6:
        return 0.0
    if len(short) == 1:
        return 0.5 * ends
    score = 0.85 * _monge_elkan(short, long) + 0.15 * ends - 0.03 * (len(long) - len(short))
    shared = x.aliases and y.aliases
    if shared:
        score += 0.03 if set(x.aliases) & set(y.aliases) else -0.1
    in_order = sum(p == q for p, q in zip(x.accented, y.accented, strict=False)) / max(len(a), len(b))
    return max(0.0, min(1.0, score)) - 0.01 * (1 - in_order)


def _keys(vertices: DataFrame) -> DataFrame:
    """(key, vid, centre, length, parts): every band and short form of every vertex, mixed with its block into one number."""
    n = bands()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, keys = [], []
            for k, (block, written) in enumerate(zip(b["block"], b["name"], strict=True)):
                full, short = Name(written).forms()
                own = {hash_text(f"s {s}") for s in short}
                if full:
                    h = _hashes(full, n * ROWS).reshape(n, ROWS)
                    own |= {hash_text(f"{i} {r.tobytes().hex()}") for i, r in enumerate(h)}
                salt = hash_text(block)
                keys += [x ^ salt for x in own]
                at += [k] * len(own)
            if at:
                with np.errstate(over="ignore"):
                    mixed = np.array(keys, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                columns = {c: b[c].to_numpy()[at] for c in ("vid", "centre", "length", "parts")}
                yield pd.DataFrame({"key": mixed.view(np.int64), **columns})

    return vertices.select("vid", "block", "name", "centre", "length", "parts").mapInPandas(run, "key long, vid long, centre boolean, length int, parts int")


HOT = 50_000  # names of a block that one part of its keys is meant for
_PAIRS = 1_000_000  # pairs made at once


def _sized(vertices: DataFrame) -> DataFrame:
    """Vertices with ``parts``, more than one in blocks of very many names."""
    hot = vertices.groupBy("block").agg((F.count("*") / HOT).cast("int").alias("more")).where("more > 0")
    return vertices.join(hot, "block", "left").withColumn("parts", F.coalesce("more", F.lit(0)) + 1).drop("more")


def _meet(keys: DataFrame, leads: bool) -> DataFrame:
    """(vid, other): vertices that share a key, the second a centre, or with ``leads`` any longer name of the key.

    In every part of a key stand all possible partners and a share of those that ask.  One exchange and a sort in the
    JVM bring them together; a task reads its rows as a stream and holds the partners of one key, as numbers, and a
    bounded number of pairs.
    """
    if "parts" not in keys.columns:
        keys = keys.withColumn("parts", F.lit(1))
    asking = F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    if leads:
        rows = keys.select("key", "vid", F.col("length"), F.explode(everywhere).alias("part"), (asking == F.col("part")).alias("asks"), F.lit(True).alias("partner"))
        order = ["key", "part", F.desc("length"), "vid"]
    else:
        rows = keys.select("key", "vid", F.col("length"), F.explode(F.when(F.col("centre"), everywhere).otherwise(F.array(asking))).alias("part"), (~F.col("centre")).alias("asks"), F.col("centre").alias("partner"))
        order = ["key", "part", "asks", "vid"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.zeros(0, np.int64)
        for b in batches:
            if not len(b):
                continue
            group = b["key"].to_numpy() * 31 + b["part"].to_numpy()
            vid, asks, partner = b["vid"].to_numpy(), b["asks"].to_numpy(bool), b["partner"].to_numpy(bool)
            if last is None or group[0] != last:
                held = held[:0]
            # The partners of a key that is open from the batch before stand in front.
            pool = np.concatenate([held, vid[partner]])
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
            seen = np.cumsum(partner) - partner  # partners before a row, in the batch
            begin = (seen[starts] + len(held))[run_of]
            begin[run_of == 0] = 0
            end = seen + len(held)
            rows_ = np.flatnonzero(asks & (end > begin))
            many = (end - begin)[rows_]
            for part in np.split(rows_, np.searchsorted(np.cumsum(many), np.arange(_PAIRS, many.sum(), _PAIRS))):
                if len(part):
                    m = (end - begin)[part]
                    right = np.repeat(begin[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    yield pd.DataFrame({"vid": np.repeat(vid[part], m), "other": pool[right]}).drop_duplicates()
            tail = partner & (run_of == run_of[-1])
            held = np.concatenate([held, vid[tail]]) if len(starts) == 1 else vid[tail]
            last = group[-1]

    return rows.repartition("key", "part").sortWithinPartitions(*order).select("key", "part", "vid", "asks", "partner").mapInPandas(run, "vid long, other long").distinct()


def _named(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(block, name, other) of pairs of vertices."""
    mine = vertices.select("vid", "block", "name")
    theirs = vertices.select(F.col("vid").alias("other"), F.col("name").alias("other_name"))
    return pairs.join(mine, "vid").join(theirs, "other").select("block", "name", F.col("other_name").alias("other"))


def _scored(pairs: DataFrame) -> DataFrame:
    """(block, name, other, s): pairs with their similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed = lru_cache(maxsize=100_000)(Name)
        for b in batches:
            b["s"] = [similarity(parsed(x), parsed(y)) for x, y in zip(b["name"], b["other"], strict=True)]
            yield b

    return pairs.mapInPandas(run, "block string, name string, other string, s double")


def stars(names: DataFrame) -> DataFrame:
    """(block, name, star): the centre that each written name of a block belongs to; centres belong to themselves.

    ``names``: (block string, name string, centre boolean, list string); ``list`` tells sources apart in which a
    person is named once.  Names that join no centre are compared with all longer names they share a key
    with and follow the most similar ones to a star of their own.
    """
    vertices = names.where(F.trim("name") != "").groupBy("block", "name").agg(F.max("centre").alias("centre"))
    vertices = cut(_sized(vertices.select(F.xxhash64("block", "name").alias("vid"), "block", "name", "centre", F.length("name").alias("length"))))
    centred = vertices.where("centre").select("block").distinct()
    pairs = _meet(_keys(vertices.join(centred, "block", "left_semi")), leads=False)
    edges = cut(_scored(_named(pairs, vertices)).where(F.col("s") >= ACCEPT))
    by_name = Window.partitionBy("block", "name")
    best = edges.withColumn("top", F.max("s").over(by_name)).where(F.col("s") >= F.col("top") - 0.005).withColumn("n", F.count("*").over(by_name))
    sure = best.where("n = 1").select("block", "name", F.col("other").alias("star"))
    # Two centres fit: the one that has no name of its own in the same list, where only one such is left.
    lists = names.where(F.trim("name") != "").select("block", "name", "list").distinct()
    taken = sure.join(lists, ["block", "name"]).select("block", F.col("star").alias("other"), "list")
    taken = taken.unionByName(lists.join(vertices.where("centre").select("block", "name"), ["block", "name"]).select("block", F.col("name").alias("other"), "list")).distinct()
    open_ = best.where("n > 1").join(lists, ["block", "name"]).join(taken, ["block", "other", "list"], "left_anti").select("block", "name", "other").distinct()
    last = open_.withColumn("n", F.count("*").over(by_name)).where("n = 1").select("block", "name", F.col("other").alias("star"))
    joined = cut(sure.unionByName(last).unionByName(vertices.where("centre").select("block", "name", F.col("name").alias("star"))))
    rest = cut(vertices.join(joined, ["block", "name"], "left_anti").join(best.select("block", "name"), ["block", "name"], "left_anti"))
    linked = _scored(_named(_meet(_keys(rest), leads=True), rest)).where(F.col("s") >= ACCEPT)
    linked = linked.groupBy("block", "name").agg(F.max_by("other", F.struct("s", F.length("other"), "other")).alias("star"))
    alone = cut(rest.select("block", "name").join(linked, ["block", "name"], "left").select("block", "name", F.coalesce("star", "name").alias("star")))
    while True:  # a name whose centre joined a longer one itself moves on to that one's centre; each round halves the way
        onward = alone.select("block", F.col("name").alias("star"), F.col("star").alias("next"))
        alone = cut(alone.join(onward, ["block", "star"], "left").select("block", "name", F.coalesce("next", "star").alias("star"), (F.col("next") != F.col("star")).alias("moved")))
        if alone.where("moved").isEmpty():
            break
        alone = alone.drop("moved")
    alone = alone.drop("moved")
    return joined.unionByName(alone)


def same_person(mentions: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: mentions of one person in one block whose written names differ.

    ``mentions``: (id, block string, name string, centre boolean, list string); one id may stand in several blocks.
    """
    known = mentions.where(F.trim("name") != "")
    groups = cut(stars(known.select("block", "name", "centre", "list")))
    placed = known.select("id", "block", "name").join(groups, ["block", "name"])
    names = groups.where("name is not null")
    pairs = names.alias("x").join(names.alias("y"), (F.col("x.block") == F.col("y.block")) & (F.col("x.star") == F.col("y.star")) & (F.col("x.name") < F.col("y.name")))
    pairs = pairs.select(F.col("x.block").alias("block"), F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
    a = placed.select("block", F.col("name").alias("name_a"), F.col("id").alias("a"))
    b = placed.select("block", F.col("name").alias("name_b"), F.col("id").alias("b"))
    out = pairs.join(a, ["block", "name_a"]).join(b, ["block", "name_b"])
    return out.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
