"""Set covers: which training cases cover a test case's clauses, greedily and by linear programming.

Only sets that share a clause with the query can help, so candidates come from an equi-join on the clause; the few
smallest other sets are kept besides, because a pick without gain takes the smallest set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """(query, case_id, common): training sets that share clauses with a query, and how many.

    ``queries``: (query, sig), ``sets``: (case_id, sig), both distinct.
    """
    return queries.join(sets, "sig").groupBy("query", "case_id").agg(F.count("*").alias("common"))


def _candidates(queries: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(case_id, query, sigs, size): the training sets of each query with the clauses they cover, sorted."""
    covered = queries.join(sets, "sig").groupBy("query", "case_id").agg(F.array_sort(F.collect_list("sig")).alias("sigs"))
    return covered.join(sizes, "case_id").select("case_id", "query", "sigs", "size")


def greedy(queries: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(query, iteration, case_id, subset_size, gain, covered, n_clauses, coverage) of k picks per query.

    A pick has the greatest gain, then the smallest size, then the smallest id; without gain the smallest set is
    taken. Of candidates that cover the same clauses of a query only the k smallest can ever be picked, so a clause
    that very many sets hold does not make a query's group large.
    """
    sizes = sets.groupBy("case_id").agg(F.count("*").alias("size"))
    small = sizes.orderBy("size", "case_id").limit(k)  # padding once everything is covered
    shared = _candidates(queries, sets, sizes)
    best = Window.partitionBy("query", "sigs").orderBy("size", "case_id")
    shared = shared.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    padding = queries.select("query").distinct().join(F.broadcast(small))
    padding = padding.join(shared.select("query", "case_id"), ["query", "case_id"], "left_anti").select("case_id", "query", F.array().cast("array<string>").alias("sigs"), "size")
    total = queries.groupBy("query").agg(F.count("*").alias("n"))
    frame = shared.unionByName(padding).join(total, "query")
    key, case = queries.schema["query"].dataType.simpleString(), sets.schema["case_id"].dataType.simpleString()

    def run(pdf):
        n = int(pdf["n"].iloc[0])
        left = [(c, int(s), set(x)) for c, s, x in zip(pdf["case_id"], pdf["size"], pdf["sigs"], strict=True)]
        covered: set = set()
        rows = []
        for i in range(min(k, len(left))):
            at = min(range(len(left)), key=lambda j: (-len(left[j][2] - covered), left[j][1], left[j][0]))
            c, s, x = left.pop(at)
            gain = len(x - covered)
            covered |= x
            rows.append((pdf["query"].iloc[0], i + 1, c, s, gain, len(covered), n, len(covered) / n))
        return pd.DataFrame(rows, columns=["query", "iteration", "case_id", "subset_size", "gain", "covered", "n_clauses", "coverage"])

    return frame.groupBy("query").applyInPandas(run, f"query {key}, iteration int, case_id {case}, subset_size long, gain long, covered long, n_clauses long, coverage double")


def solve_cover(a: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """min c.x with a x >= 1, x >= 0 by the simplex method on the dual (feasible at zero), Bland's rule.

    ``a``: rows are clauses, columns sets. The bound x <= 1 never binds at an optimum with positive costs.
    """
    m, n = a.shape
    t = np.zeros((n + 1, m + n + 1))
    t[:n, :m], t[:n, m : m + n], t[:n, -1], t[n, :m] = a.T, np.eye(n), c, -1.0
    basis = list(range(m, m + n))
    while True:
        enter = next((j for j in range(m + n) if t[n, j] < -1e-9), None)
        if enter is None:
            return float(t[n, -1]), t[n, m : m + n].copy()
        ratios = [(t[i, -1] / t[i, enter], basis[i], i) for i in range(n) if t[i, enter] > 1e-9]
        if not ratios:
            return float("inf"), np.zeros(n)
        _, _, row = min(ratios)
        t[row] /= t[row, enter]
        for i in range(n + 1):
            if i != row and t[i, enter]:
                t[i] -= t[i, enter] * t[row]
        basis[row] = enter


def linear_cover(queries: DataFrame, sets: DataFrame, k: int, rounds: int = 200) -> DataFrame:
    """(query, status, lp_value, n_clauses, n_candidates, picked, covered) by relaxation and randomised rounding.

    The costs are set sizes. A clause that no set holds makes the programme infeasible: then every candidate has
    weight one. Rounding draws with a seed of its own per query, keeps the best draw and fills up by weight.
    """
    sizes = sets.groupBy("case_id").agg(F.count("*").alias("size"))
    every = _candidates(queries, sets, sizes)
    totals = every.groupBy("query").agg(F.count("*").alias("n_candidates"), F.sum("size").alias("total"))
    # Of sets that cover the same clauses only the cheapest can have weight; the fallback takes the smallest ids.
    same = Window.partitionBy("query", "sigs")
    few = every.withColumn("c", F.row_number().over(same.orderBy("size", "case_id"))).withColumn("i", F.row_number().over(same.orderBy("case_id"))).where((F.col("c") <= k) | (F.col("i") <= k)).drop("c", "i")
    wanted = queries.groupBy("query").agg(F.array_sort(F.collect_list("sig")).alias("wanted"))
    frame = wanted.join(totals, "query", "left").join(few, "query", "left")
    key = queries.schema["query"].dataType.simpleString()

    def run(pdf):
        name, sigs = pdf["query"].iloc[0], list(pdf["wanted"].iloc[0])
        inside = pdf[pdf["case_id"].notna()].sort_values("case_id")
        cases, cost = inside["case_id"].tolist(), inside["size"].to_numpy(float)
        at = {s: i for i, s in enumerate(sigs)}
        a = np.zeros((len(sigs), len(cases)))
        for j, covered in enumerate(inside["sigs"]):
            a[[at[s] for s in covered], j] = 1
        feasible = len(cases) > 0 and bool(a.any(1).all())
        weight = np.ones(len(cases))
        value = float(pdf["total"].iloc[0]) if len(cases) else 0.0
        if feasible:
            order = np.lexsort((np.arange(len(cases)), cost))
            _, first = np.unique(a[:, order], axis=1, return_index=True)  # equal columns once, by their cheapest set
            first = order[first]
            value, x = solve_cover(a[:, first], cost[first])
            weight = np.zeros(len(cases))
            weight[first] = np.clip(x, 0, 1)
        rng = np.random.default_rng(int.from_bytes(str(name).encode()[-8:], "big"))
        order = sorted(range(len(cases)), key=lambda j: (-weight[j], cases[j]))
        best, best_cover = np.zeros(len(cases), bool), -1
        for _ in range(rounds if len(cases) else 0):
            draw = rng.random(len(cases)) < weight
            if draw.sum() > k:
                on = [j for j in order if draw[j]][:k]
                draw = np.zeros(len(cases), bool)
                draw[on] = True
            got = int(a[:, draw].any(1).sum())
            if got > best_cover:
                best, best_cover = draw, got
        for j in order:
            if best.sum() >= k:
                break
            best[j] = True
        got = int(a[:, best].any(1).sum()) if len(cases) else 0
        n = int(pdf["n_candidates"].iloc[0]) if len(cases) else 0
        return pd.DataFrame([(name, "optimal" if feasible else "fallback", round(value, 6), len(sigs), n, int(best.sum()), got)], columns=["query", "status", "lp_value", "n_clauses", "n_candidates", "picked", "covered"])

    return frame.groupBy("query").applyInPandas(run, f"query {key}, status string, lp_value double, n_clauses long, n_candidates long, picked long, covered long")


def ranked_trials(trials: DataFrame) -> DataFrame:
    """Trials (trial, recall, f1, k) with their place (recall, then F1, then small k) and the best so far."""
    order = Window.orderBy(F.desc("recall"), F.desc("f1"), "k", "trial")
    so_far = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct("recall", "f1", (-F.col("k")).alias("minus_k"))).over(so_far)
    return trials.withColumn("place", F.row_number().over(order)).withColumn("best_recall", best["recall"]).withColumn("best_k", -best["minus_k"])
