"""Mixing sources to target weights.

Token totals by cell (source, language, topic) are raked by iterative proportional fitting: repetition weights are
scaled in turn to the source, language and topic marginals, clipped at the repeats that a source allows, and ended on
the source marginal, which has the last word.  Records are then sampled: a record of a cell with weight w is taken
floor(w) times and once more with probability w - floor(w), decided by a hash of its id, so the result is the same on
every run; a factor per source, read off a histogram of the sizes by hash, calibrates the probabilities so that the
share reached is the share aimed at, not only its expectation.

Scale: one narrow pass for sizes; cells (sources x ``LANGS`` x topics) and histograms (sources x ``BINS``) are the
only things that reach the driver, and both have a fixed size: topics beyond ``TOPIC_CELLS`` share cells by hash.

Defined results of odd input: records of null or unlisted sources and of size zero take no part; null languages are a
language of their own; a source that is listed but has no records makes its share unreachable and is left out, the
others keep their proportions; ties need no rule, as every record decides for itself.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.runtime import cut

LANGS = ("vi", "en", "fr")
TOPIC_CELLS = 256  # topics with a cell of their own; beyond that several share one
BINS = 8192


def rake(tokens: dict[tuple[str, str, str], float], shares: dict[str, float], repeats: dict[str, int], total: float | None = None, rounds: int = 50) -> dict[tuple[str, str, str], float]:
    """Repetition weight of each cell. Without ``total``: the largest mix whose source shares the repeats allow."""
    have = {s: sum(n for c, n in tokens.items() if c[0] == s) for s in shares}
    live = {s: p for s, p in shares.items() if have[s] > 0 and p > 0}
    whole = sum(live.values())
    live = {s: p / whole for s, p in live.items()}
    if not live:
        return {}
    most = min(repeats[s] * have[s] / p for s, p in live.items())
    total = most if total is None else min(total, most)
    cells = {c: n for c, n in tokens.items() if c[0] in live and n > 0}
    sums = sum(cells.values())
    weight = dict.fromkeys(cells, 1.0)

    def margin(axis: int, goal: dict[str, float]) -> None:
        now: dict[str, float] = {}
        for c, n in cells.items():
            now[c[axis]] = now.get(c[axis], 0.0) + n * weight[c]
        for c in cells:
            weight[c] = min(weight[c] * goal[c[axis]] / now[c[axis]] if now[c[axis]] else 0.0, repeats[c[0]])

    others = {axis: {k: total * sum(n for c, n in cells.items() if c[axis] == k) / sums for k in {c[axis] for c in cells}} for axis in (1, 2)}
    by_source = {s: total * p for s, p in live.items()}
    for _ in range(rounds):
        margin(1, others[1])
        margin(2, others[2])
        margin(0, by_source)
    for s, goal in by_source.items():  # what clipping took away goes to the source's other cells
        own = {c: n for c, n in cells.items() if c[0] == s}
        low, high = 0.0, 1e9
        for _ in range(100):
            factor = (low + high) / 2
            if sum(n * min(weight[c] * factor, repeats[s]) for c, n in own.items()) < goal:
                low = factor
            else:
                high = factor
        for c in own:
            weight[c] = min(weight[c] * high, repeats[s])
    return weight


def mix(records: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(id, source, size, copies) of records (id, source, lang, topic, size), each at most ``max_repeats`` times.

    ``targets``: (source, target_share, max_repeats), a handful of rows.
    """
    aims = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").collect()}
    lang = F.when(F.col("lang").isin(*LANGS), F.col("lang")).when(F.col("lang").isNull(), "none").otherwise("other")
    known = records.where(F.col("source").isin(*aims) & (F.col("size") > 0)) if aims else records.where(F.lit(False))
    known = cut(known.select("id", "source", lang.alias("lang"), F.pmod(F.xxhash64("topic"), F.lit(TOPIC_CELLS)).cast("string").alias("topic"), "size", ((F.xxhash64("id", F.lit("mix")).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / F.lit(float(1 << 52))).alias("u")))
    tokens = {(r["source"], r["lang"], r["topic"]): float(r["n"]) for r in known.groupBy("source", "lang", "topic").agg(F.sum("size").alias("n")).collect()}
    weight = rake(tokens, {s: a[0] for s, a in aims.items()}, {s: a[1] for s, a in aims.items()}, total)
    spark = records.sparkSession
    cells = spark.createDataFrame([(*c, float(w), aims[c[0]][1]) for c, w in weight.items()], "source string, lang string, topic string, w double, cap long")
    # v below the source's factor means one copy more; the factor is near 1.
    extra = F.col("w") - F.floor("w")
    drawn = known.join(F.broadcast(cells), ["source", "lang", "topic"]).select(
        "id", "source", "size", "w", "cap", F.floor("w").alias("base"), F.when((extra > 0) & (F.floor("w") < F.col("cap")), F.col("u") / extra).alias("v")
    )
    by_bin = F.floor(F.col("v") / (F.col("v") + 1) * BINS).alias("bin")  # any factor from 0 on has a bin
    hist = drawn.where("v is not null").groupBy("source", by_bin).agg(F.sum("size").alias("n")).collect()
    aim = {r["source"]: (r["goal"] - r["sure"]) for r in drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("w")).alias("goal"), F.sum(F.col("size") * F.col("base")).alias("sure")).collect()}
    factor = {}
    for s, rows in itertools.groupby(sorted(hist, key=lambda r: (r["source"], r["bin"])), key=lambda r: r["source"]):
        got, factor[s] = 0.0, 0.0
        for r in rows:
            if abs(got + r["n"] - aim[s]) > abs(got - aim[s]):
                break
            got += r["n"]
            factor[s] = (r["bin"] + 1) / max(BINS - r["bin"] - 1, 1e-9)
    factors = spark.createDataFrame(list(factor.items()) or [("", 0.0)], "source string, factor double")
    taken = drawn.join(F.broadcast(factors), "source", "left").select("id", "source", "size", (F.col("base") + F.when(F.col("v") < F.col("factor"), 1).otherwise(0)).cast("int").alias("copies"))
    return taken.where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_records, n_copies, tokens, max_copies): what a mix reached by source."""
    own = mixed.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("size")).alias("tokens"), F.max("copies").alias("max_copies"))
    total = own.agg(F.sum("tokens").alias("total"))
    joined = F.broadcast(targets.select("source", "target_share")).join(own, "source", "left").join(F.broadcast(total))
    return joined.select("source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("actual_share"), "n_records", "n_copies", "tokens", "max_copies")
