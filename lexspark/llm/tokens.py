"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = RANKS):
    """The encoding of a vocabulary file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Ends of stretches that are counted by themselves: the pattern begins a piece at every blank between two characters
#: that are no white space, and a token never crosses pieces.
_ENDS = re.compile(r"(?<=\S)(?= \S)")


class _Sizes(dict):
    """Tokens of each stretch: what a worker has counted serves for the texts to come."""

    def __init__(self, path: str, lead: str):
        super().__init__()
        self.encode, self.lead = encoder(path).encode_ordinary, lead

    def __missing__(self, part: str) -> float:
        if not part or part[0].isspace() or part[-1].isspace():
            return math.nan  # no end of a stretch
        n = len(self.encode(self.lead + part))
        if len(part) <= 64:
            if len(self) >= 300_000:
                self.clear()
            self[part] = n
        return n


@lru_cache(maxsize=4)
def _sizes(path: str) -> tuple[_Sizes, _Sizes]:
    """Of stretches at the start of a text and of those after a blank, without it."""
    return _Sizes(path, ""), _Sizes(path, " ")


def count(text: str | None, path: str = RANKS) -> int:
    """Tokens of a text; null and empty texts have none."""
    if not text:
        return 0
    first, after = _sizes(path)
    head, *rest = text.split(" ")
    n = first[head] + sum(map(after.__getitem__, rest))
    if n == n:
        return n
    encode = encoder(path).encode_ordinary  # some blanks stand beside white space
    n = 0
    for part in _ENDS.split(text):
        lead, own = (after, part[1:]) if part[0] == " " and len(part) > 1 else (first, part)
        got = lead[own]
        n += got if got == got else len(encode(part))
    return n


def token_table(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), label: Callable[[str], str] | None = None, path: str = RANKS) -> DataFrame:
    """(id, n_tokens, label, *keep): sizes of all texts, and a label made from each text. Narrow; texts do not move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["id", *keep]].copy()
            out["n_tokens"] = [count(t, path) for t in b["_text"]]
            out["label"] = [label(t or "") if label else None for t in b["_text"]]
            yield out[["id", "n_tokens", "label", *keep]]

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"id {types[id_col]}", "n_tokens long", "label string", *[f"{c} {types[c]}" for c in keep]])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), *keep).mapInPandas(run, schema)
