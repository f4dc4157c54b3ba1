"""Exact cosine search of a stated query set against all vectors.

A query set of at most ``BLOCK`` vectors is broadcast: every task keeps its own k best per query by one matrix
product, and only those rows are shuffled.  A larger one never reaches the driver: queries and vectors meet in blocks
of about ``BLOCK`` of each, so the work is the stated one, all queries against all vectors, and a task holds two blocks
and the distances of ``STRIP`` queries.  Both sides are computed once before, as vectors may come from an encoder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.runtime import cut

BLOCK = 4096
STRIP = 512  # queries compared with a batch of vectors at once


def _matrix(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and the rows that have one."""
    fit = np.array([v is not None and len(v) > 0 for v in column], bool)
    if not fit.any():
        return np.zeros((0, 0)), np.zeros(0, int)
    x = np.stack(column[fit].to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    good = norm > 0
    return x[good] / norm[good, None], np.flatnonzero(fit)[good]


def _nearest(q: tuple, batches: Iterator[pd.DataFrame], k: int, per_doc: bool) -> pd.DataFrame | None:
    """The k best of all batches for each query of a block (matrix, ids, docs)."""
    x_q, ids, docs = q
    best: pd.DataFrame | None = None
    for batch in batches:
        x, at = _matrix(batch["v"])
        if not len(x) or not len(x_q):
            continue
        own, doc = batch["id"].to_numpy()[at], batch["doc"].to_numpy()[at]
        order = np.lexsort((own, pd.factorize(doc, sort=False)[0]))
        x, own, doc = x[order], own[order], doc[order]
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if per_doc else np.arange(len(x))
        found = [] if best is None else [best]
        for s in range(0, len(x_q), STRIP):
            d = 1.0 - x_q[s : s + STRIP] @ x.T
            d[docs[s : s + STRIP, None] == doc[None, :]] = np.inf
            least = np.minimum.reduceat(d, starts, axis=1) if per_doc else d
            keep = min(least.shape[1], k)
            kth = np.partition(least, keep - 1, axis=1)[:, keep - 1]
            r, c = np.nonzero((least <= kth[:, None]) & np.isfinite(least))  # ties of the k-th stay
            if per_doc:  # the nearest chunk of a document, of equal ones the smallest id
                ends = np.append(starts[1:], len(x))
                c = np.array([starts[j] + d[i, starts[j] : ends[j]].argmin() for i, j in zip(r, c, strict=True)], dtype=np.int64)
            found.append(_reduce(pd.DataFrame({"query_id": ids[s + r], "other_id": own[c], "doc": doc[c], "distance": d[r, c]}), k, per_doc))
        best = _reduce(pd.concat(found), k, per_doc)
    return best


def _block(part: pd.DataFrame) -> tuple:
    q, at = _matrix(part["v"])
    return q, part["id"].to_numpy()[at], part["doc"].to_numpy()[at]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, per_doc: bool = False) -> DataFrame:
    """(query_id, other_id, doc, distance, rank): the k nearest chunks, or documents, of other documents.

    ``vectors`` and ``queries``: (id, doc, v). Null and all-zero vectors take no part; a query's own document is left
    out; equal distances go to the smaller id. With ``per_doc`` a document counts once, by its nearest chunk, so no
    over-fetching is needed: every task keeps the best chunk of each of its k best documents per query.
    """
    spark = vectors.sparkSession
    asked = queries.where("v is not null").select("id", "doc", "v")
    known = vectors.where("v is not null").select("id", "doc", "v")
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"query_id {types['id']}, other_id {types['id']}, doc {types['doc']}, distance double"
    first = asked.limit(BLOCK + 1).toPandas()  # the size is checked before anything is broadcast
    if len(first) <= BLOCK:
        shared = spark.sparkContext.broadcast(_block(first))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _nearest(shared.value, batches, k, per_doc)
            if best is not None:
                yield best

        rows = known.mapInPandas(scan, schema)
    else:

        def blocks(df: DataFrame, salt: str) -> tuple[DataFrame, int]:
            n = -(-df.count() // BLOCK)
            return df.withColumn(salt, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n

        asked, n_q = blocks(cut(asked), "qb")
        # Names of their own: Spark mixes up the columns of two sides that come from one table.
        known, n_v = blocks(cut(known), "vb")
        known = known.select(*[F.col(c).alias(f"known_{c}") for c in ("id", "doc", "v")], "vb")
        left = asked.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
        right = known.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

        def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            best = _nearest(_block(q), iter([v.rename(columns=lambda c: c.removeprefix("known_"))]), k, per_doc) if len(q) and len(v) else None
            return pd.DataFrame(columns=["query_id", "other_id", "doc", "distance"]) if best is None else best

        rows = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(meet, schema)
    order = Window.partitionBy("query_id").orderBy("distance", "other_id")
    if per_doc:
        by_doc = Window.partitionBy("query_id", "doc").orderBy("distance", "other_id")
        rows = rows.withColumn("n", F.row_number().over(by_doc)).where("n = 1").drop("n")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reduce(rows: pd.DataFrame, k: int, per_doc: bool) -> pd.DataFrame:
    rows = rows.sort_values(["query_id", "distance", "other_id"], kind="stable")
    if per_doc:
        rows = rows.drop_duplicates(["query_id", "doc"])
    return rows[rows.groupby("query_id").cumcount() < k]


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a sentence encoder: signed hashed words, unit length; null for no words.

    The port for a real encoder is an iterator pandas UDF with the same signature.
    """
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dim)
                for w in (t or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    v[h % dim] += 1 if (h >> 32) & 1 else -1
                n = np.linalg.norm(v)
                out.append((v / n).astype(np.float32) if n else None)
            yield pd.Series(out)

    return encode(text)
