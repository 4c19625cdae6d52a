import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimforge.llm import mixture

DOCS = "doc_id long, source string, text string, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, "big", "word " * (5 + i % 9), "x") for i in range(600)] + [(1000 + i, "mid", "word " * 12, "x") for i in range(90)] + [(2000 + i, "small", "word " * 8, "x") for i in range(20)]
    rows += [(3000, "other", "word", "x"), (3001, None, "word", "x"), (3002, "big", None, "x"), (3003, "big", "", "x"), (5, "big", "word " * 10, "x")]
    return spark.createDataFrame(rows, DOCS)


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), TARGETS)


def test_shares_and_repeats(spark, documents):
    t = targets(spark, ("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("absent", 0.1, 2))
    got = mixture.mixture(documents, t).collect()
    uses = {}
    for r in got:
        uses.setdefault((r.source, r.doc_id), []).append(r.copy)
    assert all(sorted(c) == list(range(len(c))) for c in uses.values())
    assert max(len(c) for (s, _), c in uses.items() if s == "small") <= 3 and max(len(c) for (s, _), c in uses.items() if s == "big") == 1
    tokens = {}
    for r in got:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
    whole = sum(tokens.values())
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert abs(tokens[s] / whole - share / 0.9) < 0.01
    report = {r.source: r for r in mixture.shares(documents, t).collect()}
    assert report["absent"].actual_share == 0 and report["big"].tokens == tokens["big"] and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    # It is the largest such total: one source is used up to its cap.
    assert max(len(c) for (s, _), c in uses.items() if s == "small") == 3 or len({d for s, d in uses if s == "big"}) > 590
    assert len({(r.shard, r.position) for r in got}) == len(got)


def test_same_again_and_partitioning(spark, documents):
    t = targets(spark, ("big", 0.5, 1), ("mid", 0.5, 2))
    a = sorted(map(tuple, mixture.mixture(documents, t).collect()))
    assert a == sorted(map(tuple, mixture.mixture(documents.repartition(11), t).collect()))


def test_given_total_and_short_source(spark, documents):
    t = targets(spark, ("big", 0.5, 1), ("small", 0.5, 2))
    got = {r.source: r for r in mixture.shares(documents, t, total=4000).collect()}
    assert got["small"].most_uses == 2 and got["small"].actual_share < 0.2 and abs(got["big"].tokens - 2000) < 20


def test_empty(spark, documents):
    t = targets(spark, ("big", 0.5, 1))
    assert mixture.mixture(documents.limit(0), t).count() == 0
    assert mixture.mixture(documents, t.limit(0)).count() == 0
    assert [r.actual_share for r in mixture.shares(documents.limit(0), t).collect()] == [0.0]
    assert mixture.mixture(documents, targets(spark, ("big", 0.5, 0), (None, 0.5, 2), ("mid", None, 1))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=6), st.integers(1, 40))
def test_tree_is_exact(blocks, shards):
    got = mixture.split_tree(blocks, shards)
    assert (got.sum(axis=0) == np.array(blocks)).all() and got.min() >= 0
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1


def test_tree_spreads():
    got = np.array([mixture.split_tree([320, 320], 10, seed)[:, 0] for seed in range(300)])
    assert abs(got.mean() - 32) < 0.5 and 3 < got.std() < 5  # hypergeometric: 3.8


@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=8), st.integers(8, 500))
def test_apportion(shares, total):
    got = mixture.apportion(shares, total)
    assert sum(got) == total and min(got) >= 1


def test_tree_split_in_two_steps():
    """The top on the driver and the rest in tasks give the same leaves as the whole tree at once."""
    blocks, shards = [40, 7, 0, 91], 23
    whole = mixture.split((0, shards, blocks, [0] * 4), sum(blocks), shards, 5)
    top = mixture.split((0, shards, blocks, [0] * 4), sum(blocks), shards, 5, 6)
    assert len(top) < len(whole) == shards and sorted(leaf for node in top for leaf in mixture.split(node, sum(blocks), shards, 5)) == sorted(whole)
    at = [0] * 4
    for lo, hi, counts, before in sorted(whole):
        assert before == at and hi == lo + 1 and sum(counts) in (sum(blocks) // shards, sum(blocks) // shards + 1)
        at = [x + c for x, c in zip(at, counts)]
    assert at == blocks


def test_many_small_shards(spark, documents, monkeypatch):
    plan = mixture.Plan(documents, targets(spark, ("big", 0.5, 1), ("mid", 0.5, 2)), shard_tokens=20)
    held = plan.leaves().collect()
    assert plan.shards > 100 and len({(r.source, r.block) for r in held}) == len(held) == sum(plan.blocks.values())
    monkeypatch.setattr(mixture, "MOST_BLOCKS", 100)
    with pytest.raises(ValueError, match="shard_tokens"):
        mixture.Plan(documents, targets(spark, ("big", 1.0, 1)), shard_tokens=20)
