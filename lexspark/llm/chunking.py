"""Splitting oversized texts at natural boundaries, with overlap.

Lexical cohesion: at every sentence end the words of the sentences before and after it are compared as two blocks;
the depth of the valley in that similarity curve marks a change of topic.  Pieces are cut greedily: within the window
of permitted lengths the deepest valley is taken, a paragraph end counting as deeper; without a sentence end in the
window, a word end; without that, the limit itself.  Each further piece begins with the last words of the one before.

Scale: narrow; only texts over the limit reach Python (the length filter runs in the JVM), each text is handled alone
and cohesion is computed from blocks of a fixed number of sentences, so the cost is linear in its length.

Defined results of odd input: null, empty and short texts give no pieces here (they are within the limit); a text
without blanks is cut at the limit, never inside a combined character; overlap never exceeds a quarter of the limit.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1500
OVERLAP = 150
BLOCK = 4  # sentences on either side of a gap
LEAST = 0.5  # of the limit: pieces are not cut shorter where a sentence end allows
_PARAGRAPH = 0.15  # depth that a paragraph end adds
_END = re.compile(r"""\n\s*\n\s*|(?:(?<=[.!?…:;])|(?<=[.!?…]["”»)]))\s*\n\s*|(?:(?<=[.!?…])|(?<=[.!?…]["”»)]))\s+""")
_WORD = re.compile(r"[^\W\d_]{2,}")
_BLANK = re.compile(r"\s+")


def valleys(text: str) -> tuple[list[int], list[float]]:
    """Positions right after each sentence end inside the text, and the depth of the similarity valley there."""
    ends = [(m.start(), m.end(), "\n" in m.group()) for m in _END.finditer(text) if 0 < m.start() and m.end() < len(text)]
    if not ends:
        return [], []
    starts = [0] + [e for _, e, _ in ends]
    bags = [Counter(_WORD.findall(text[a:b].lower())) for a, b in zip(starts, [s for s, _, _ in ends] + [len(text)], strict=True)]
    sims = []
    for g in range(1, len(bags)):
        left, right = Counter(), Counter()
        for bag in bags[max(0, g - BLOCK) : g]:
            left.update(bag)
        for bag in bags[g : g + BLOCK]:
            right.update(bag)
        small, big = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(n * big[w] for w, n in small.items() if w in big)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        sims.append(dot / norm if norm else 0.0)
    up_left, up_right = sims[:], sims[:]
    for k in range(1, len(sims)):  # the peak to which the curve rises without a break
        if sims[k - 1] > sims[k]:
            up_left[k] = up_left[k - 1]
    for k in range(len(sims) - 2, -1, -1):
        if sims[k + 1] > sims[k]:
            up_right[k] = up_right[k + 1]
    depth = [a + b - 2 * s + (_PARAGRAPH if p else 0.0) for a, b, s, (_, _, p) in zip(up_left, up_right, sims, ends, strict=True)]
    return [e for _, e, _ in ends], depth


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, core, end) of each piece: text[begin:end], of which text[begin:core] repeats the piece before.

    The cores follow each other without gap. A text within the limit is one piece.
    """
    overlap = min(overlap, limit // 4)
    if len(text) <= limit:
        return [(0, 0, len(text))]
    cuts, depth = valleys(text)
    pieces, begin, core = [], 0, 0
    while len(text) - begin > limit:
        last = begin + limit
        lo, hi = bisect.bisect_left(cuts, max(core + 1, begin + int(limit * LEAST))), bisect.bisect_right(cuts, last)
        if lo >= hi:
            lo = bisect.bisect_left(cuts, core + 1)
        if lo < hi:
            end = cuts[max(range(lo, hi), key=lambda k: (depth[k], k))]
        else:
            blank = [m.end() for m in _BLANK.finditer(text, core + 1, last)]
            end = blank[-1] if blank and blank[-1] > core else last
            if not blank:
                while end > core + 1 and unicodedata.combining(text[end]):
                    end -= 1
        pieces.append((begin, core, end))
        core = begin = end
        if overlap:
            m = _BLANK.search(text, max(pieces[-1][1], end - overlap), end)
            begin = m.end() if m and m.end() < end else max(pieces[-1][1], end - overlap) if not m else end
    pieces.append((begin, core, len(text)))
    return pieces


def split_texts(texts: DataFrame, keys: tuple[str, ...], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(*keys, piece, n_pieces, overlap, piece_text) of texts (*keys, t) longer than ``limit`` code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                t = row[-1]
                pieces = split(t, limit, overlap)
                rows += [(*row[:-1], k, len(pieces), core - begin, t[begin:end]) for k, (begin, core, end) in enumerate(pieces, 1)]
            yield pd.DataFrame(rows, columns=[*keys, "piece", "n_pieces", "overlap", "piece_text"])

    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", piece int, n_pieces int, overlap int, piece_text string"
    return texts.where(F.length("t") > limit).select(*keys, "t").mapInPandas(run, schema)
