import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import chunking as c
from lexspark.llm import mixing as m
from lexspark.llm import packing as p
from lexspark.llm import tokens, topics


def check_pieces(text, limit, overlap):
    pieces = c.split(text, limit, overlap)
    assert "".join(text[core:end] for _, core, end in pieces) == text
    assert all(0 < end - begin <= limit and begin <= core < end for begin, core, end in pieces) or text == ""
    assert all(core - begin <= min(overlap, limit // 4) for begin, core, _ in pieces)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc. \ńễ", max_size=200), st.integers(8, 60), st.integers(0, 30))
def test_pieces_cover_the_text(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_cuts_fall_on_natural_ends():
    text = "\n\n".join(" ".join(f"Câu {i} nói về chủ đề {k} rất dài dòng." for i in range(20)) for k in range(6))
    for _, core, end in check_pieces(text, 400, 60)[:-1]:
        assert text[:end].rstrip().endswith(".") and text[core : core + 1].strip()


def test_topic_change_is_preferred():
    a = " ".join("Xe tải chạy nhanh trên đường lớn." for _ in range(9))
    b = " ".join("Toà án xét hỏi người làm chứng." for _ in range(20))
    text = a + " " + b
    assert c.split(text, len(a) + 120, 0)[0][2] == len(a) + 1


def test_no_blank_and_words():
    assert [e - b for b, _, e in c.split("x" * 25, 10, 0)] == [10, 10, 5]
    assert all(" ".join(["abcd"] * 50)[e - 1] == " " for _, _, e in c.split(" ".join(["abcd"] * 50), 33, 0)[:-1])


def test_split_texts_frame(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "Một câu. " * 300), (4, "Một câu. " * 300)], "k long, t string")
    got = c.split_texts(rows, ("k",), 500, 50).collect()
    assert {r["k"] for r in got} == {4} and max(len(r["piece_text"]) for r in got) <= 500
    assert c.split_texts(rows.limit(0), ("k",)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_packing_is_valid(sizes):
    sizes = sorted(sizes, reverse=True)
    where, caps = p.pack(sizes, (16, 32, 64), 2)
    used = [0] * len(caps)
    for s, w in zip(sizes, where, strict=True):
        used[w] += s
    assert all(0 < u <= k for u, k in zip(used, caps, strict=True))
    assert all(k == next(x for x in (16, 32, 64) if x >= u) for u, k in zip(used, caps, strict=True))
    assert sum(caps) <= 2 * sum(sizes) + 16


def test_several_capacities_are_used_and_full():
    rng = random.Random(3)
    sizes = sorted((min(4096, int(rng.lognormvariate(6.1, 0.7)) + 1) for _ in range(9000)), reverse=True)
    _, caps = p.pack(sizes)
    assert len(set(caps)) >= 3 and sum(sizes) > 0.99 * sum(caps)
    largest_only = p.pack(sizes, (4096,))[1]
    assert sum(map(p.cost_of, caps)) < sum(map(p.cost_of, largest_only))


def test_pack_items_frame(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 3000), "x") for i in range(3000)] + [(9000, 10_000, "x"), (9001, 0, "x"), (9002, None, "x"), (9003, 4096, "x")]
    got = p.pack_items(spark.createDataFrame(rows, "id long, size long, capacity string")).toPandas()
    assert got[got["id"] == 9000].sort_values("part")["size"].tolist() == [4096, 4096, 1808]
    assert not set(got["id"]) & {9001, 9002} and (got[got["id"] < 9000].groupby("id").size() == 1).all()
    bins = got.groupby("container").agg(used=("size", "sum"), cap=("capacity", "first"), n=("capacity", "nunique"))
    assert (bins["used"] <= bins["cap"]).all() and (bins["n"] == 1).all()
    assert got["size"].sum() == sum(s or 0 for _, s, _ in rows) and got["size"].sum() / bins["cap"].sum() > 0.98
    assert p.pack_items(spark.createDataFrame([], "id long, size long")).count() == 0


def test_rake_meets_shares_and_caps():
    cells = {("a", "vi", "x"): 100.0, ("a", "en", "y"): 20.0, ("b", "vi", "x"): 10.0, ("b", "vi", "y"): 5.0, ("c", "vi", "x"): 50.0}
    w = m.rake(cells, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.4}, {"a": 1, "b": 3, "c": 2, "d": 9})
    by = {s: sum(n * w[c] for c, n in cells.items() if c[0] == s) for s in "abc"}
    total = sum(by.values())
    assert all(abs(by[s] / total - x) < 1e-3 for s, x in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert all(w[c] <= {"a": 1, "b": 3, "c": 2}[c[0]] + 1e-9 for c in cells)
    assert m.rake({}, {"a": 1.0}, {"a": 1}) == {}


def test_mix_frame(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["big", "big", "big", "small", None, "other"]), rng.choice(["vi", "en", None]), "t", rng.randint(0, 400)) for i in range(6000)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("empty", 0.1, 2)], "source string, target_share double, max_repeats long")
    df = spark.createDataFrame(rows, "id long, source string, lang string, topic string, size long")
    mixed = m.mix(df, targets).toPandas()
    t = (mixed["size"] * mixed["copies"]).groupby(mixed["source"]).sum()
    assert abs(t["big"] / t.sum() - 0.6) < 0.01 and set(mixed["source"]) == {"big", "small"}
    assert mixed["id"].is_unique and (mixed["size"] > 0).all() and mixed.groupby("source")["copies"].max().to_dict()["big"] == 1 and mixed["copies"].max() <= 3
    report = {r["source"]: r for r in m.shares(m.mix(df, targets), targets).collect()}
    assert abs(report["small"]["actual_share"] - 0.4) < 0.01 and report["empty"]["actual_share"] == 0
    assert m.mix(df.limit(0), targets).count() == 0


def test_token_counts():
    if not __import__("os").path.exists(tokens.RANKS):
        pytest.skip("no vocabulary file")
    assert tokens.count(None) == 0 and tokens.count("") == 0 and tokens.count("Toà án") > 1
    assert tokens.count("a b" * 1000) == len(tokens.encoder().encode_ordinary("a b" * 1000))


def test_topics_tell_texts_apart(spark):
    rng = random.Random(1)
    groups = ["trộm cắp tài sản xe máy".split(), "chất cấm ma túy mua bán".split(), "giao thông tai nạn đường".split()]
    rows = [(i, " ".join(rng.choices(groups[i % 3], k=40))) for i in range(300)] + [(900, None), (901, ""), (902, "12 34")]
    topic = topics.fit(spark.createDataFrame(rows, "id long, t string"), "id", "t", topics=3)
    found = [{topic(t) for i, t in rows[:300] if i % 3 == g} for g in range(3)]
    assert all(len(x) == 1 for x in found) and len(set.union(*found)) == 3
    assert topic(None) == topic("") == topic("12 34") == "-1"
    assert topics.fit(spark.createDataFrame([], "id long, t string"), "id", "t")("a b") == "-1"


def test_topics_come_from_all_texts(spark):
    """A text more changes the topics, however many there are, and parts and order do not."""
    rng = random.Random(2)
    groups = ["trộm cắp tài sản xe máy".split(), "giao thông tai nạn đường".split()]
    rows = [(i, " ".join(rng.choices(groups[i % 2], k=12))) for i in range(5000)]

    def centres(rows, parts):
        topic = topics.fit(spark.createDataFrame(rows, "id long, t string").repartition(parts), "id", "t", topics=2)
        return topic.__closure__[topic.__code__.co_freevars.index("centres")].cell_contents

    one = centres(rows, 2)
    assert (one == centres(rows[::-1], 5)).all()
    assert all((centres([*rows, (5000 + k, "chất cấm ma túy mua bán")], 2) != one).any() for k in range(2))


def test_counts_of_stretches_are_those_of_the_text():
    if not __import__("os").path.exists(tokens.RANKS):
        pytest.skip("no vocabulary file")
    rng = random.Random(6)
    parts = ["a", "Toà", "án", "'s", "12", ".", "_", "😀", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "　"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    assert [tokens.count(t) for t in texts] == [len(tokens.encoder().encode_ordinary(t)) for t in texts]


def test_words_are_counted_as_one_by_one():
    def alone(text):
        ws = topics._WORD.findall((text or "").lower())
        at = [topics.zlib.crc32(w.encode()) % topics.WIDTH for w in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))]]
        return topics.np.bincount(topics.np.array(at, int), minlength=topics.WIDTH)

    rng = random.Random(7)
    parts = ["toà", "Án", "b", "-", "_", "12", "ΑΣ", ",", " ", " ", " ", "\n", "\x1c", "　"]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500))]
    assert (topics._hashed(texts) == topics.np.array([alone(t) for t in texts])).all()


def test_mix_reads_and_splits_each_text_once(spark, tmp_path, monkeypatch):
    """The topics and the sizes come from one pass over the texts; the labels are those that ``fit`` gives."""
    from lexspark.llm import mixing, queries

    rng = random.Random(8)
    groups = ["trộm cắp tài sản xe máy".split(), "chất cấm ma túy mua bán".split(), "giao thông tai nạn đường".split()]
    rows = [(i, " ".join(rng.choices(groups[i % 3], k=30)), "a" if i % 2 else "b", "vi") for i in range(300)] + [(900, None, "a", None), (901, "", "b", "vi"), (902, "12 34", "a", "vi")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats long").write.parquet(f"{tmp_path}/mix_targets.parquet")
    read, mixed_of, seen = [], mixing.mix, []
    monkeypatch.setattr(queries, "wide_table", lambda *a: read.append(a[2]) or df)
    monkeypatch.setattr(queries, "table", lambda s, d, name: read.append(name) or s.read.parquet(f"{d}/{name}.parquet"))
    monkeypatch.setattr(mixing, "mix", lambda records, targets: seen.append(records.collect()) or mixed_of(records, targets))
    assert queries.p9_mixed(spark, str(tmp_path)).count() > 0 and sorted(read) == ["documents", "mix_targets"]
    topic = topics.fit(df, "doc_id", "text")
    assert {r["id"]: (r["topic"], r["size"]) for r in seen[0]} == {i: (topic(t), tokens.count(t)) for i, t, _, _ in rows}
