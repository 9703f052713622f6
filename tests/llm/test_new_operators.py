"""Exact duplicates, lexical search and hard negatives against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import exact, negatives, search

WORDS = "the of and a red Red fox dog é ünder 42 x7 日本".split()


def texts(seed, n):
    r = np.random.default_rng(seed)
    return [" ".join(r.choice(WORDS, r.integers(1, 40)).tolist()) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    own = texts(1, 80)
    rows = [*own, own[3], own[3], "A" * 300, "A" * 300, "A" * 299 + "B", None, "", " ", "the " * 9000, "the " * 9000, "🙂|x", "a\x00b"]
    rows = [(k, t, "x", 1, b"", 2) for k, t in enumerate(rows)] + [(None, own[3], "y", 1, b"", 2), (None, "alone", "y", 1, b"", 2), (2, own[2], "z", 1, b"", 2)]
    rows += [(1000 + k, "hot copy", "y", 1, b"", 2) for k in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, number int, digest binary, border int").repartition(5)


@pytest.mark.parametrize("largest", [True, False])
def test_exact_duplicates_by_brute_force(spark, docs, largest):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact.exact_duplicates(docs, largest=largest).collect()
    assert len(got) == len(rows)
    stays = {t: (max if largest else min)((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = collections.Counter((i, stays[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_a_hot_text_fills_many_ranges(spark, docs):
    """With more ranges than texts, the copies of one text lie in several of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact.exact_duplicates(docs).where("group_size = 150").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 150 and {r.keep_id for r in got} == {1149} and [r.doc_id for r in got if r.kept] == [1149]


def test_texts_equal_after_a_rule(spark):
    d = spark.createDataFrame([("b", "A  x"), ("a", "a x"), ("c", None), ("d", "")], "key string, body string")
    got = exact.exact_duplicates(d, "key", "body", lambda c: F.lower(F.regexp_replace(c, " +", " ")), largest=False)
    assert {(r.key, r.keep_id, r.kept) for r in got.collect()} == {("a", "a", True), ("b", "a", False), ("c", "c", True), ("d", "c", False)}


def ranked(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(i, term.findall((t or "").translate(lower))) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = collections.Counter(x for _, t in found for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in found:
            tf = collections.Counter(t)
            m = 75 + 25 * len(t) * n_docs // total if t else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in term.findall((text or "").translate(lower)) if tf[x])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return collections.Counter(out)


ITEMS = [(1, "Red fox, red dog."), (2, "日本 ünder é é é"), (3, None), (4, ""), (5, "nowhere to be seen"), (None, "x7 42"), (1, "Red fox, red dog."), (7, "the the of hot")]


@pytest.mark.parametrize(("k", "postings"), [(20, 1 << 17), (3, 4)])
def test_search_by_brute_force(spark, docs, monkeypatch, k, postings):
    monkeypatch.setattr(search, "POSTINGS", postings)
    monkeypatch.setattr(search, "CELLS", 300)
    items = spark.createDataFrame([(i, t, 0, 0) for i, t in ITEMS], "item_id long, text string, doc_id int, score int")
    got = search.search(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS, k)


def test_packed_products_are_exact():
    r = np.random.default_rng(3)
    for bound, d in ((1, 1), (200, 64), (5000, 64), (2**20, 7), (2**29, 12), (2**31, 2)):
        a, b = r.integers(-bound, bound, (5, d)), r.integers(-bound // 2, bound, (11, d))
        assert (negatives.packed_products(a, b) == a.astype(object) @ b.astype(object).T).all()
    assert negatives.packed_products(np.zeros((2, 0), int), np.zeros((3, 0), int)).tolist() == [[0] * 3] * 2
    with pytest.raises(OverflowError):
        negatives.packed_products(np.full((1, 2), 2**40), np.full((1, 2), 2**40))


def mined(rows, limit, percent=80):
    valid = [(i, g, [math.floor(256 * x) for x in v]) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, g, v in {(i, g, tuple(v)) for i, g, v in valid if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, h) for j, h, w in valid)
        for s, p, _ in [x for x in scored if x[2] == g and x[1] != i][:limit]:
            window = [x for x in scored if x[2] != g and percent * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j, _) in enumerate(window[:limit], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize(("rows_at_a_time", "limit"), [(8192, 5), (30, 2)])
def test_negatives_by_brute_force(spark, monkeypatch, rows_at_a_time, limit):
    monkeypatch.setattr(negatives, "ROWS", rows_at_a_time)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "SLICE", 2)
    r = np.random.default_rng(4)
    rows = [(k * 25, np.float32(r.normal(size=8) + k % 3).tolist(), int(k % 3)) for k in range(90)]
    rows += [(7, rows[4][1], 1), (8, rows[4][1], 0), (9, rows[4][1], 2), (10, rows[4][1], 2), rows[5], rows[8], (100, rows[7][1], 2)]
    rows += [(20, None, 1), (21, [None] * 8, 1), (22, [float("nan")] * 8, 1), (23, [float("inf")] + [0.0] * 7, 1), (24, [1.0] * 8, None), (None, [1.0] * 8, 1), (26, [], 1), (27, [3.0] * 3, 2)]
    rows += [(300000 + k, [2.0] * 8, 0) for k in range(60)]
    d = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, label int, place int, anchor_id int").repartition(3)
    got = negatives.mine(d, F.col("vec_id") % 100 == 0, positives=limit, negatives=limit)
    # Short vectors are filled up by zeros, as zip cuts what a zero would count.
    assert collections.Counter(map(tuple, got.collect())) == mined(rows, limit)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], docs.schema)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert exact.exact_duplicates(none).count() == 0
    assert search.search(none, items).count() == search.search(docs, items.limit(0)).count() == search.search(docs, items.where("item_id > 2 AND item_id < 5")).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(empty, F.col("vec_id") % 100 == 0).count() == 0
    none_leads = spark.createDataFrame([(1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(none_leads, F.col("vec_id") % 100 == 0).count() == 0
