"""Topics of texts: spherical k-means over hashed words, fitted on all texts and applied to every text.

A text's vector holds the roots of its word and word-pair counts, weighed by their rarity in all texts.  The clusters
start as one and those of the largest distortion are split in two, off their mean by the spread of all texts, with
rounds of k-means over all texts after each split.

Scale: the texts are read once and their counts written, compressed; each round and the labels are narrow passes over
the counts, and ``WIDTH`` sums a cluster reach the driver.  Sums are of whole numbers, so the order of the tasks changes nothing.

Defined results of odd input: null texts and texts without words have topic -1; an empty table fits no topics and all
its texts would have topic -1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.runtime import stored

TOPICS = 8
WIDTH = 1024
ROUNDS = 4  # after a split, at most; twice as many after the last
_BLOCK = 1024  # texts whose vectors are held at once
_CHARS = 1_000_000  # characters whose words are held at once; a longer text is a run of its own
_ONE = 1 << 30  # the whole number that stands for 1 in sums
_WORD = re.compile(r"[^\W\d_]{2,}")


def _hashed(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed words and word pairs, a row per text."""
    # White space ends a word, so what stands between white space is taken apart once however often it comes.
    split = [(t or "").lower().split() for t in texts]
    every = list(chain.from_iterable(split))
    tokens = {t: k for k, t in enumerate(dict.fromkeys(every))}
    token = np.fromiter(map(tokens.__getitem__, every), np.int64, len(every))
    words: dict[str, int] = {}
    parts = [[words.setdefault(w, len(words)) for w in _WORD.findall(t)] for t in tokens]
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.fromiter(chain.from_iterable(parts), np.int64)
    own = size[token]
    word = flat[np.repeat((np.cumsum(size) - size)[token] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
    row = np.repeat(np.repeat(np.arange(len(texts)), [len(s) for s in split]), own)
    named = list(words)
    of_word = np.array([zlib.crc32(w.encode()) % WIDTH for w in named], np.int64)
    both = row[1:] == row[:-1]
    pairs, at = np.unique(word[:-1][both] * len(named) + word[1:][both], return_inverse=True)
    of_pair = np.array([zlib.crc32(f"{named[p // len(named)]} {named[p % len(named)]}".encode()) % WIDTH for p in pairs.tolist()], np.int64)
    places = np.concatenate([row * WIDTH + of_word[word], row[1:][both] * WIDTH + of_pair[at]])
    return np.bincount(places, minlength=len(texts) * WIDTH).reshape(len(texts), WIDTH)


def _ends(texts: pd.Series) -> list[int]:
    """Where runs of at most ``_BLOCK`` texts and about ``_CHARS`` characters begin, and the end of the last."""
    ends, chars = [0], 0
    for k, n in enumerate(texts.str.len().fillna(0)):
        if k > ends[-1] and (k - ends[-1] == _BLOCK or chars + n > _CHARS):
            ends.append(k)
            chars = 0
        chars += n
    return ends + [len(texts)] if len(texts) else ends


def counted(df: DataFrame, text_col: str, keep: tuple[str, ...] = (), size: Callable[[str | None], int] | None = None) -> DataFrame:
    """(*keep, size, at, n) of all texts, written once: the columns of its counts that are not zero, and the counts there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j in pairwise(_ends(b["_text"])):
                part = b.iloc[i:j]
                texts = part["_text"].tolist()
                c = _hashed(texts)
                row, at = np.nonzero(c)
                n, ends = c[row, at].astype(np.uint32), np.searchsorted(row, np.arange(len(part) + 1))
                at = at.astype(np.uint16)
                yield part[list(keep)].assign(
                    size=[size(t) if size else None for t in texts],
                    at=[at[k:m].tobytes() for k, m in pairwise(ends)],
                    n=[n[k:m].tobytes() for k, m in pairwise(ends)],
                )

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{c} {types[c]}" for c in keep), "size long", "at binary", "n binary"])
    return stored(df.select(F.col(text_col).alias("_text"), *keep).mapInPandas(run, schema))


#: By text where its columns begin and how many it has; the columns and counts of all.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blocks(b: pd.DataFrame) -> Iterator[Block]:
    for s in range(0, len(b), _BLOCK):
        at, n = b["at"].iloc[s : s + _BLOCK], b["n"].iloc[s : s + _BLOCK]
        sizes = np.array([len(a) // 2 for a in at])
        yield np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(at), np.uint16).astype(np.int64), np.frombuffer(b"".join(n), np.uint32).astype(float)


def _sums(counts: DataFrame, of: Callable[[Block], np.ndarray]) -> np.ndarray:
    """Sum over all texts with words of what ``of`` makes of the counts of some texts: an array of whole numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for block in _blocks(b):
                got = of(block)
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "n": total})

    rows = counts.where(F.length("at") > 0).select("at", "n").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")
    return rows["n"].to_numpy(np.int64)


def _unit(block: Block, rarity: np.ndarray) -> np.ndarray:
    """The entries of unit vectors, in whole numbers; sums of a block of them are exact in double precision."""
    starts, sizes, at, n = block
    x = np.sqrt(n) * rarity[at]
    x *= np.repeat(_ONE / np.sqrt(np.add.reduceat(x * x, starts)), sizes)
    return np.rint(x, out=x)


def _rows(block: Block, x: np.ndarray) -> np.ndarray:
    """The vectors of a block of which ``x`` are the entries, a row each."""
    _, sizes, at, _ = block
    out = np.zeros(len(sizes) * WIDTH)
    out[np.repeat(np.arange(len(sizes)) * WIDTH, sizes) + at] = x
    return out.reshape(-1, WIDTH)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.round(rows @ centres.T).argmax(1)


def fit_counts(counts: DataFrame, topics: int = TOPICS) -> tuple[np.ndarray, np.ndarray] | None:
    """Rarity of the columns and centres of the topics, from the counts of all texts; None where no text has words."""
    seen = _sums(counts, lambda c: np.append(np.bincount(c[2], minlength=WIDTH), len(c[1])))
    if not len(seen):
        return None
    rarity = np.log1p(seen[-1] / (1 + seen[:-1]))

    def moments(c: Block) -> np.ndarray:
        x = _unit(c, rarity)
        return np.append(np.bincount(c[2], x, WIDTH), np.bincount(c[2], np.rint(x * x / _ONE), WIDTH)).astype(np.int64)

    first, second = _sums(counts, moments).reshape(2, WIDTH) / _ONE
    spread = np.sqrt(np.maximum(second / seen[-1] - (first / seen[-1]) ** 2, 0.0))
    signs = np.random.default_rng(0).choice([-1.0, 1.0], (topics, WIDTH))
    sums, sizes = first[None, :], seen[-1:].astype(float)
    while len(sums) < topics:
        before = len(sums)
        # 1 - cosine, summed over a cluster, is its size less the length of its sum.
        loose = np.argsort(np.linalg.norm(sums, axis=1) - sizes, kind="stable")[: topics - len(sums)]
        means = sums / np.maximum(sizes, 1)[:, None]
        means[loose] += 0.5 * spread * signs[: len(loose)]
        centres = np.concatenate([means, means[loose] - spread * signs[: len(loose)]])
        for _ in range(ROUNDS if len(centres) < topics else 2 * ROUNDS):
            centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

            def assigned(c: Block, centres: np.ndarray = centres) -> np.ndarray:
                x = _rows(c, _unit(c, rarity))
                member = (_nearest(x, centres)[:, None] == np.arange(len(centres))).astype(float)
                return np.append((member.T @ x).ravel(), member.sum(0)).astype(np.int64)

            got = _sums(counts, assigned)
            now = got[: -len(centres)].reshape(-1, WIDTH) / _ONE
            same = now.shape == sums.shape and (now == sums).all()
            sums, sizes = now, got[-len(centres) :].astype(float)
            centres = np.where(sizes[:, None] > 0, sums, centres)
            if same:
                break
        sums, sizes = sums[sizes > 0], sizes[sizes > 0]
        if len(sums) == before:  # fewer different texts than topics
            break
    return rarity, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


def labelled(counts: DataFrame, fitted: tuple[np.ndarray, np.ndarray] | None, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, topic) of all texts from their counts; the texts are not read again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            topic = np.full(len(b), -1)
            some = (b["at"].str.len() > 0).to_numpy()
            if fitted and some.any():
                topic[some] = np.concatenate([_nearest(_rows(c, _unit(c, fitted[0])), fitted[1]) for c in _blocks(b[some])])
            yield b[list(keep)].assign(topic=topic.astype(str))

    types = {f.name: f.dataType.simpleString() for f in counts.schema}
    return counts.select(*keep, "at", "n").mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in keep), "topic string"]))


def fit(df: DataFrame, id_col: str, text_col: str, topics: int = TOPICS) -> Callable[[str | None], str]:
    """A function that gives the topic of a text as a number in text form."""
    fitted = fit_counts(counted(df, text_col), topics)
    if fitted is None:
        return lambda text: "-1"
    rarity, centres = fitted

    def topic(text: str | None) -> str:
        v = _hashed([text])[0]
        at = np.flatnonzero(v)
        block = (np.zeros(1, np.int64), np.array([len(at)]), at, v[at].astype(float))
        return str(int(_nearest(_rows(block, _unit(block, rarity)), centres)[0])) if len(at) else "-1"

    return topic
