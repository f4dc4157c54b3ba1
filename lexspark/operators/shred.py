"""Deeply nested JSON text to flat related tables by columnar shredding.

Every leaf path of a declared schema becomes a column of (repetition level, definition level, value) entries, one
column per record and leaf.  Flat tables are then read back from the level sequences alone: an entry whose
repetition level is at most d starts a new item of the d-th repeated ancestor, and an entry whose definition level
does not reach an ancestor's item says that the item is null or that its list is empty.

Both steps are narrow (no shuffle): a record is shredded where it is read and assembled where it was shredded.

Defined results of odd input: null, empty and unreadable text gives no entries; code fences, JSON inside JSON
strings, single-element lists and wrapper objects are looked through, however many; an object where a list is declared counts as
a list of one; lists in lists are flattened; a null item keeps its place; a scalar where an object is declared
counts as a null item; numbers and booleans become their JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"```[A-Za-z]*\s*(.*?)\s*```", re.S)


@dataclass(frozen=True)
class Repeated:
    """A repeated object: ``paths`` are the alternative places of its list, ``leaves`` its scalar fields."""

    name: str
    paths: tuple[tuple[str, ...], ...]
    leaves: tuple[str, ...]
    children: tuple[Repeated, ...] = field(default=())


def _readable(text: str | None):
    """The JSON value of a text, or None if there is none."""
    if not text or not text.strip():
        return None
    fenced = _FENCE.search(text)
    for candidate in (text.strip(), fenced.group(1) if fenced else None):
        if candidate:
            try:
                return json.loads(candidate)
            except (ValueError, RecursionError):
                continue
    return None


def unwrap(text: str | None, marks: frozenset[str]):
    """The first object that holds a key of ``marks``, looked for through strings, lists and wrapper objects."""
    front = [_readable(text)]
    while front:
        following = []
        for node in front:
            if isinstance(node, dict):
                if marks & node.keys():
                    return node
                following.extend(v for v in node.values() if isinstance(v, dict | list | str))
            elif isinstance(node, list):
                following.extend(node)
            elif isinstance(node, str) and node.lstrip()[:1] in ("{", "[", '"', "`"):
                following.append(_readable(node))
        front = following
    return None


def _at(node, path: tuple[str, ...]):
    for key in path:
        if not isinstance(node, dict):
            return None
        node = node.get(key)
    return node


def _items(node, paths) -> list | None:
    """The items of a list field: None where the field is absent, null or not a list."""
    for path in paths:
        value = _at(node, path)
        if isinstance(value, str):
            value = _readable(value)
        if isinstance(value, dict):
            return [value]
        if isinstance(value, list):
            flat: list = []
            stack = value[::-1]
            while stack:
                x = stack.pop()
                if isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
                    x = _readable(x)
                if isinstance(x, list):
                    stack.extend(x[::-1])
                else:
                    flat.append(x)
            return flat
    return None


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _shred(node, schema: Repeated, rep: int, depth: int, prefix: str, out: dict) -> None:
    """Append the level entries of one parent's list. Levels per repeated node: +1 item there, +1 item not null."""
    base = 2 * depth
    items = _items(node, schema.paths) if isinstance(node, dict) else None

    def absent(s: Repeated, r: int, d: int, path: str) -> None:
        for leaf in s.leaves:
            out[f"{path}.{leaf}"].append((r, d, None))
        for child in s.children:
            absent(child, r, d, f"{path}.{child.name}")

    if not items:
        absent(schema, rep, base, prefix)
        return
    for k, item in enumerate(items):
        r = rep if k == 0 else depth + 1
        if not isinstance(item, dict):
            absent(schema, r, base + 1, prefix)
            continue
        for leaf in schema.leaves:
            value = _text(item.get(leaf))
            out[f"{prefix}.{leaf}"].append((r, base + 2 + (value is not None), value))
        for child in schema.children:
            _shred(item, child, r, depth + 1, f"{prefix}.{child.name}", out)


def _leaf_paths(schema: Repeated, prefix: str) -> list[str]:
    here = [f"{prefix}.{leaf}" for leaf in schema.leaves]
    return here + [p for c in schema.children for p in _leaf_paths(c, f"{prefix}.{c.name}")]


def shred_json(df: DataFrame, id_col: str, json_col: str, schemas: tuple[Repeated, ...]) -> DataFrame:
    """(id, leaf, rep, def, val): one row per readable record and leaf path, the level entries as arrays.

    ``rep`` and ``def`` of a leaf under d repeated ancestors run from 0 to d and from 0 to 2d + 1.
    """
    marks = frozenset(p[0] for s in schemas for p in s.paths)
    leaves = [p for s in schemas for p in _leaf_paths(s, s.name)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, text in zip(batch["id"], batch["json"], strict=True):
                node = unwrap(text, marks)
                if node is None:
                    continue
                out: dict[str, list] = {leaf: [] for leaf in leaves}
                for schema in schemas:
                    _shred(node, schema, 0, 0, schema.name, out)
                for leaf, entries in out.items():
                    reps, defs, vals = zip(*entries, strict=True)
                    rows.append((rid, leaf, list(reps), list(defs), list(vals)))
            yield pd.DataFrame(rows, columns=["id", "leaf", "rep", "def", "val"])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(json_col).cast("string").alias("json"))
    return source.mapInPandas(run, f"id {kind}, leaf string, rep array<int>, def array<int>, val array<string>")


def assemble(shredded: DataFrame, leaf: str) -> DataFrame:
    """(id, pos1..posd, val): the items of the leaf's innermost repeated ancestor, from its level sequences alone.

    ``pos`` columns count items from 1 inside their parent; null items keep their place but give no row; an
    item without the leaf has a null ``val``.  Running counts over the concatenated columns of a batch replace
    per-record loops.
    """
    depth = leaf.count(".")
    names = [f"pos{d}" for d in range(1, depth + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["rep"].str.len().to_numpy(dtype=np.int64) if len(batch) else np.zeros(0, np.int64)
            if not len(batch) or sizes.sum() == 0:
                continue
            rep, dfn = np.concatenate(batch["rep"].to_numpy()), np.concatenate(batch["def"].to_numpy())
            val = np.concatenate([np.asarray(v, dtype=object) for v in batch["val"]])
            out = {"id": np.repeat(batch["id"].to_numpy(), sizes)}
            for d in range(1, depth + 1):
                starts = rep < d  # a new parent of level d
                count = np.cumsum(rep <= d)
                first = np.maximum.accumulate(np.where(starts, count, 0))
                out[f"pos{d}"] = (count - first + 1).astype(np.int32)
            keep = dfn >= 2 * depth
            yield pd.DataFrame({k: v[keep] for k, v in out.items()} | {"val": val[keep]})

    kind = shredded.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} int" for n in names) + ", val string"
    return shredded.where(F.col("leaf") == leaf).select("id", "rep", "def", "val").mapInPandas(run, schema)
