"""JSON text: fields under alternative paths, and all texts of a nested value as one."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def project(c: Column, *paths: str) -> Column:
    """The value under the first path that is there: texts as they are, all else as compact JSON; null for none.

    Text that is no JSON has no paths.
    """
    node = F.coalesce(*[F.try_variant_get(F.try_parse_json(c), p, "variant") for p in paths])
    is_text = F.schema_of_variant(node) == "STRING"
    return F.when(node.isNull(), F.lit(None)).when(is_text, F.try_variant_get(node, "$", "string")).otherwise(F.to_json(node))


def flat_text(c: Column) -> Column:
    """The texts and numbers of a JSON value at any depth, in order, blank ones dropped, separated by blank lines.

    Null, unreadable and empty values give an empty text. The walk keeps its own stack, so depth has no limit but the
    reader's.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            out = []
            for value in values:
                try:
                    stack = [json.loads(value)] if value else []
                except (ValueError, RecursionError):
                    stack = []
                texts = []
                while stack:
                    node = stack.pop()
                    if isinstance(node, dict):
                        stack.extend(reversed(node.values()))
                    elif isinstance(node, list):
                        stack.extend(reversed(node))
                    elif node is not None:
                        texts.append((node if isinstance(node, str) else json.dumps(node)).strip())
                out.append("\n\n".join(t for t in texts if t))
            yield pd.Series(out)

    return run(c)
