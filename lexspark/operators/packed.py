"""Several values packed in one field: one value per row, with its place.

A cell is cut into atoms at every candidate delimiter; quoted spans are atomic.  The runs of atoms between two
delimiters are the edges of a lattice, and each edge is one possible value; runs of very many atoms are edges where the column holds their value
free, whatever its length.  Expectation-maximisation over the
lattices of the whole column learns how often each value and how often each kind of delimiter really separates;
a Viterbi pass then chooses the likeliest path of every cell.  So a comma or a connecting word inside a frequent
value ("processing, storing and sale") is kept, and the same comma between two frequent values cuts.

Scale: cells are first reduced to distinct lattices with a weight (a cell that fills a third of the column is one
lattice).  Value frequencies are a table that is joined by key, never a driver-side map; Spark may broadcast it
where its measured size allows and joins by shuffle beyond that.  Only the counts per delimiter kind (a fixed,
small set) reach the driver.

Defined results of odd input: null and blank cells give no rows; empty values do not count; equal values in one
cell stay separate rows; other columns are not touched, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.runtime import cut, spread

#: Delimiter kinds with the prior probability that one separates values. A kind's pattern must not match inside numbers.
DELIMITERS: tuple[tuple[str, str, float], ...] = (
    ("line", r"\s*\n\s*", 0.9),
    ("semicolon", r"\s*;\s*", 0.85),
    ("bar", r"\s*\|\s*", 0.9),
    ("plus", r"\s\+\s", 0.9),
    ("ampersand", r"\s&\s", 0.9),
    ("slash", r"\s*(?<!\d)/\s*|\s+/\s*|\s*/\s+", 0.7),
    ("and", r"(?:\s+|(?<=[\s,;\"”»'’]))(?:và|cùng với|and|et)\s+", 0.5),
    ("comma", r"\s*(?:(?<!\d),|,(?!\d))\s*", 0.5),
)
_DELIMITER = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in DELIMITERS), re.I)
_QUOTES = {'"': '"', "“": "”", "«": "»", "'": "'", "‘": "’"}
_MARK = re.compile(r"\s*(?:\(?(\d{1,2})[.)/](?!\d)|[-•*–]\s)\s*")
_INLINE_MARK = re.compile(r"(?:(?<=\s)|^)\(?(\d{1,2})[.)/](?!\d)\s*")
_TRIM = " \t\n\r ;|,"

NEAR_ATOMS = 8  # every run of so many atoms is an edge; a longer one is where its value stands free in the column
_FLOOR = -5.0  # log-probability of a value never seen, plus _PER_WORD for each of its words
_PER_WORD = -2.0
_DISCOUNT = 0.5  # absolute discount of an expected count: what is seen by accident does not become a value

Rules = tuple[tuple[str, str], ...]


def _quoted(s: str, at: int) -> int:
    """End of the quoted span that opens at ``at`` and fills a whole piece, or -1."""
    close = _QUOTES.get(s[at])
    if close is None:
        return -1
    end = s.find(close, at + 1)
    while end > 0:
        rest = s[end + 1 :]
        if not rest.strip() or _DELIMITER.match(rest) or (rest.lstrip()[:1] in _QUOTES and rest[:1].isspace()):
            return end + 1
        if close in "'’":  # an apostrophe
            end = s.find(close, end + 1)
            continue
        return -1
    return -1


def atoms(cell: str) -> tuple[list[tuple[int, int, bool]], list[str]]:
    """Atoms (start, end, quoted) of a cell, and the kind of the delimiter after each but the last.

    The kind ``hard`` always separates: between two quoted spans and before a numbered or dashed list item.
    """
    if cell.strip()[:1] == "[":
        try:
            listed = json.loads(cell.strip())
        except ValueError:
            listed = None
        if isinstance(listed, list):
            found, at = [], 0
            for x in listed:
                if isinstance(x, str) and x.strip() and (k := cell.find(json.dumps(x, ensure_ascii=False)[1:-1], at)) >= 0:
                    at = k + len(x)
                    found.append((k, at, True))
            if found:
                return found, ["hard"] * (len(found) - 1)
    marks = [m for m in _INLINE_MARK.finditer(cell)]
    numbered = {m.start(): m.end() for k, m in enumerate(marks) if int(m.group(1)) == k + 1} if len(marks) > 1 and int(marks[0].group(1)) == 1 and not cell[: marks[0].start()].strip() else {}
    out: list[tuple[int, int, bool]] = []
    kinds: list[str] = []
    start, pending, n = 0, "", len(cell)

    def close(end: int, quoted: bool = False) -> None:
        nonlocal pending
        a, b = start, end
        while a < b and cell[a] in _TRIM:
            a += 1
        while b > a and cell[b - 1] in _TRIM:
            b -= 1
        if a < b:
            if out:
                kinds.append("hard" if quoted and out[-1][2] else pending or "hard")
            out.append((a, b, quoted))
            pending = ""

    at = 0
    fresh = True  # at the beginning of a piece
    while at < n:
        if at in numbered:
            close(at)
            pending = "hard"
            at = start = numbered[at]
            fresh = True
            continue
        if fresh:
            m = _MARK.match(cell, at)
            if m and m.group(1) is None and m.end() > at and (at == 0 or cell[at - 1] == "\n" or "\n" in cell[max(0, at - 2) : at]):
                pending = "hard" if out else pending
                at = start = m.end()
                continue
            while at < n and cell[at].isspace():
                at += 1
            if at < n and at not in numbered and (end := _quoted(cell, at)) > 0:
                start = at + 1
                close(end - 1, True)
                at = start = end
                fresh = bool(cell[at : at + 1].isspace())
                continue
            if at >= n or at in numbered:
                continue
        m = _DELIMITER.match(cell, at)
        if m and m.end() > at:
            close(at)
            if m.lastgroup and (not pending or pending == "comma"):
                pending = m.lastgroup
            at = start = m.end()
            fresh = True
            continue
        fresh = False
        at += 1
    close(n)
    return out, kinds


def _normal(text: str, rules: tuple[tuple[re.Pattern, str], ...]) -> str:
    s = re.sub(r"\s+", " ", text.lower()).strip(" .\"'“”«»‘’")
    for pattern, into in rules:
        s = pattern.sub(into, s)
    return s


def lattice(cell: str, rules: tuple[tuple[re.Pattern, str], ...]) -> tuple[list[tuple[int, int, bool]], list[str], list[tuple[int, int, str]]]:
    """Atoms, delimiter kinds and edges (i, j, value key) of a cell."""
    spans, kinds = atoms(cell)
    n, edges = len(spans), []
    for i in range(n):
        for j in range(i + 1, n + 1):
            if j - i > 1 and (kinds[j - 2] == "hard" or spans[j - 1][2] or spans[i][2]):
                break
            if j - i > NEAR_ATOMS and not (i == 0 and j == n):
                continue
            edges.append((i, j, _normal(cell[spans[i][0] : spans[j - 1][1]], rules)))
    return spans, kinds, edges


def _score(key: str, count: float, total: float) -> float:
    unseen = _FLOOR + _PER_WORD * (1 + key.count(" "))
    seen = count - _DISCOUNT
    return max(unseen, math.log(seen / total)) if seen > 0 and total > 0 else unseen


def _paths(edges: list[tuple[int, int, float]], kinds: list[str], split: dict[str, float], best: bool):
    """Viterbi path as [(i, j)], or the expected use of each edge, by forward and backward sums in logs."""
    n = len(kinds) + 1
    inner = [0.0]  # prefix sums of the log-probability that a delimiter does not separate
    for k in kinds:
        inner.append(inner[-1] + (0.0 if k == "hard" else math.log(1 - split[k])))
    before = [0.0 if k == 0 or kinds[k - 1] == "hard" else math.log(split[kinds[k - 1]]) for k in range(n)]
    scored = [(i, j, s + inner[j - 1] - inner[i] + before[i]) for i, j, s in edges]
    if best:
        top: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * n
        for i, j, s in sorted(scored):
            if top[i][0] + s > top[j][0]:
                top[j] = (top[i][0] + s, i)
        path, j = [], n
        while j:
            path.append((top[j][1], j))
            j = top[j][1]
        return path[::-1]

    def plus(a: float, b: float) -> float:
        hi, lo = (a, b) if a > b else (b, a)
        return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))

    fore, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, s in sorted(scored):
        fore[j] = plus(fore[j], fore[i] + s)
    for i, j, s in sorted(scored, reverse=True):
        back[i] = plus(back[i], back[j] + s)
    return [(i, j, math.exp(fore[i] + s + back[j] - fore[n])) for i, j, s in scored]


def unpack(df: DataFrame, id_col: str, columns: list[str], rules: dict[str, Rules] | None = None, iterations: int = 4) -> DataFrame:
    """(id, field, pos, n_values, item): every value of every packed cell of ``columns``.

    ``rules`` are, by column, replacements that make a value's key from its lower-case text, so that values which
    differ only in numbers, say, share one frequency.  ``id_col`` must be unique.
    """
    patterns = {c: tuple((re.compile(p), r) for p, r in (rules or {}).get(c, ())) for c in columns}
    cells = df.select(F.col(id_col).alias("id"), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "cell"))
    cells = cells.where(F.trim("cell") != "")
    distinct = cells.groupBy("field", "cell").agg(F.count("*").alias("w"))

    def to_lattice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for field, cell, w in zip(b["field"], b["cell"], b["w"], strict=True):
                spans, kinds, edges = lattice(cell, patterns[field])
                if not spans:
                    continue
                free = "".join("q" if q else "-" for *_, q in spans)
                rows.append((field, cell, w, json.dumps([kinds, [k for *_, k in edges], free], ensure_ascii=False), kinds, [e[0] for e in edges], [e[1] for e in edges], [e[2] for e in edges], [e[0] for e in spans], [e[1] for e in spans], free))
            yield pd.DataFrame(rows, columns=["field", "cell", "w", "sig", "kinds", "i", "j", "key", "a", "b", "free"])

    schema = "field string, cell string, w long, sig string, kinds array<string>, i array<int>, j array<int>, key array<string>, a array<int>, b array<int>, free string"
    by_cell = cut(spread(distinct, "field", "cell").mapInPandas(to_lattice, schema).withColumn("sig", F.md5("sig")))
    lattices = cut(by_cell.groupBy("field", "sig").agg(F.sum("w").alias("w"), *[F.first(c).alias(c) for c in ("kinds", "i", "j", "key", "free")], F.min_by(F.struct("cell", "a", "b"), "cell").alias("one")).select("*", "one.*").drop("one"))
    edges = lattices.select("field", "sig", F.explode(F.arrays_zip("i", "j", "key")).alias("e"), (F.size("kinds") + 1).alias("n"), "w", "free").select("field", "sig", "e.*", "n", "w", "free")
    # Longer values: runs of as many atoms as some value of the column that fills a cell, and equal to one.
    free = edges.where((F.col("i") == 0) & (F.col("j") == F.col("n")) & (F.col("n") > NEAR_ATOMS)).select("field", "key", "n").distinct()
    free = cut(free)
    lengths: dict[str, list[int]] = {}
    for r in free.select("field", "n").distinct().collect():  # a number of atoms is a row
        lengths.setdefault(r["field"], []).append(r["n"])
    if lengths:

        def long_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for field, sig, cell, kinds, a, e, q, w in zip(b["field"], b["sig"], b["cell"], b["kinds"], b["a"], b["b"], b["free"], b["w"], strict=True):
                    n = len(a)
                    bars = [k for k in range(n) if q[k] == "q" or (k + 1 < n and kinds[k] == "hard")]
                    for m in lengths.get(field, []):
                        for i in range(n - m + 1 if m < n else 0):
                            k = bisect.bisect_left(bars, i)
                            if k == len(bars) or bars[k] >= i + m - (q[bars[k]] != "q"):
                                rows.append((field, sig, i, i + m, _normal(cell[a[i] : e[i + m - 1]], patterns[field]), n, w, q))
                yield pd.DataFrame(rows, columns=["field", "sig", "i", "j", "key", "n", "w", "free"])

        long_cells = lattices.where(F.size("kinds") > NEAR_ATOMS).select("field", "sig", "cell", "kinds", "a", "b", "free", "w")
        runs = long_cells.mapInPandas(long_edges, "field string, sig string, i int, j int, key string, n int, w long, free string")
        edges = edges.unionByName(runs.join(free.select("field", "key"), ["field", "key"], "left_semi").select(*edges.columns))
    # First evidence: values that stand free, as a whole cell, in quotes or as a list item.
    hard = F.expr("substring(free, i + 1, 1) = 'q' and j = i + 1")
    theta = edges.where(((F.col("n") == F.col("j") - F.col("i"))) | hard).groupBy("field", "key").agg(F.sum(F.col("w") * F.pow(F.lit(0.5), F.col("j") - F.col("i") - 1)).alias("c"))
    split = {(c, k): p for c in columns for k, _, p in DELIMITERS}
    weighed = None
    for step in range(iterations + 1):
        theta = cut(theta)
        totals = {r["field"]: r["t"] for r in theta.groupBy("field").agg(F.sum("c").alias("t")).collect()}
        weighed = edges.join(theta, ["field", "key"], "left").groupBy("field", "sig").agg(F.collect_list(F.struct("i", "j", "key", F.coalesce("c", F.lit(0.0)).alias("c"))).alias("es"))
        weighed = weighed.join(lattices.select("field", "sig", "kinds", "w"), ["field", "sig"])
        if step == iterations:
            break

        def expect(batches: Iterator[pd.DataFrame], split=split, totals=totals) -> Iterator[pd.DataFrame]:
            for b in batches:
                counts: dict[tuple[str, str, bool], float] = defaultdict(float)
                for field, es, kinds, w in zip(b["field"], b["es"], b["kinds"], b["w"], strict=True):
                    own = {k: split[field, k] for k, *_ in DELIMITERS}
                    used = _paths([(e["i"], e["j"], _score(e["key"], e["c"], totals.get(field, 0))) for e in es], list(kinds), own, False)
                    for e, (i, j, p) in zip(es, used, strict=True):
                        counts[field, e["key"], False] += w * p
                        for k in kinds[i : j - 1]:
                            counts[field, f"keep {k}", True] += w * p
                        if i and kinds[i - 1] != "hard":
                            counts[field, f"split {kinds[i - 1]}", True] += w * p
                yield pd.DataFrame([(f, k, m, c) for (f, k, m), c in counts.items()], columns=["field", "key", "meta", "c"])

        summed = cut(weighed.mapInPandas(expect, "field string, key string, meta boolean, c double").groupBy("field", "key", "meta").agg(F.sum("c").alias("c")))
        seen = {(r["field"], r["key"]): r["c"] for r in summed.where("meta").collect()}  # two rows for each delimiter kind
        for c in columns:
            for k, _, prior in DELIMITERS:
                yes, no = seen.get((c, f"split {k}"), 0.0), seen.get((c, f"keep {k}"), 0.0)
                split[c, k] = (yes + 10 * prior) / (yes + no + 10)
        theta = summed.where(~F.col("meta")).select("field", "key", "c")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for field, sig, es, kinds in zip(b["field"], b["sig"], b["es"], b["kinds"], strict=True):
                own = {k: split[field, k] for k, *_ in DELIMITERS}
                path = _paths([(e["i"], e["j"], _score(e["key"], e["c"], totals.get(field, 0))) for e in es], list(kinds), own, True)
                out.append((field, sig, [p[0] for p in path], [p[1] for p in path]))
            yield pd.DataFrame(out, columns=["field", "sig", "from", "to"])

    chosen = weighed.mapInPandas(decide, "field string, sig string, from array<int>, to array<int>")
    parts = by_cell.join(chosen, ["field", "sig"]).select("field", "cell", "a", "b", F.size("from").alias("n_values"), F.posexplode(F.arrays_zip("from", "to")).alias("pos", "v"))
    item = F.expr("substring(cell, a[v.from] + 1, b[v.to - 1] - a[v.from])")
    parts = parts.select("field", "cell", (F.col("pos") + 1).alias("pos"), "n_values", item.alias("item"))
    return cells.join(parts, ["field", "cell"]).select("id", "field", "pos", "n_values", "item")
