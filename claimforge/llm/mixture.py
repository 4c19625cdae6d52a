"""Problem 9: a mixture of sources by target weights, through a multivariate-hypergeometric splitting tree.

Sizes are tokens of a public tokenizer. The total is the largest at which every listed source that has tokens can reach its share without
using a document more than max_repeats times (or a given total, of which short sources then fill what they can). Each
source's quota is cut into blocks of equal size, in proportion to its share; a tree over the output shards splits the exact counts of blocks
per source, each inner node drawing its left half from the multivariate hypergeometric distribution, until every shard knows how many blocks of each source it holds.
The driver splits the top of the tree, tasks the nodes below. Shards draw disjoint runs of blocks from each source's permuted documents, and shuffle them locally.

A document's place in its source's permutation is a prefix sum in two levels (hash buckets of bounded size, then within a bucket), so
that no source, however large, is sorted in one task. A quota of q full passes and a rest uses every document q times
and the documents up to the rest once more, cut at the nearest document boundary.

Results at the edges: documents of no tokens (null, empty) are not used; sources that are not listed, and null sources, contribute nothing; listed sources
without tokens have an actual share of 0, and the others share the whole in proportion to their targets; rows with one doc_id
are one document; if nothing can be drawn, mixture and report are empty or zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimforge.llm import bpe
from claimforge.llm.common import checkpointed
from claimforge.session import widened

#: Tokens of a shard, blocks of a shard, documents of a bucket; targets may list at most MOST_SOURCES sources.
SHARD_TOKENS, BLOCKS, BUCKET_DOCS, MOST_SOURCES = 500_000, 64, 5_000, 10_000
#: Nodes that the driver splits the tree into, fewer with many sources so that they hold TOP_COUNTS numbers at most; tasks split the rest. Blocks that the draw allows.
TOP_NODES, TOP_COUNTS, MOST_BLOCKS = 1_000, 2_000_000, 999_999_999
SEED = 20_240_501


Node = tuple[int, int, list[int], list[int]]


def split(node: Node, total: int, shards: int, seed: int, most: int = 1) -> list[Node]:
    """The nodes of at most ``most`` shards below a node, exactly and at random.

    A node is (first shard, end, its blocks of each source, the blocks of each source in the shards before it). Every draw depends on the seed and
    the node alone, so that parts of the tree can be split anywhere. The shards hold total blocks, equally many but for one.
    """
    end = lambda shard: shard * (total // shards) + min(shard, total % shards)
    out, stack = [], [node]
    while stack:
        lo, hi, counts, before = stack.pop()
        if hi - lo <= max(1, most):
            out.append((lo, hi, counts, before))
            continue
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, end(mid) - end(lo), method="marginals").tolist()
        stack += [(mid, hi, [c - x for c, x in zip(counts, left)], [b + x for b, x in zip(before, left)]), (lo, mid, left, before)]
    return out


def split_tree(blocks: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) counts: the blocks of each source divided among shards of equal size, exactly and at random."""
    leaves = split((0, shards, list(blocks), [0] * len(blocks)), sum(blocks), shards, seed)
    return np.array([counts for _, _, counts, _ in leaves], np.int64).reshape(shards, len(blocks))


def apportion(shares: list[float], total: int) -> list[int]:
    """Whole numbers in proportion to shares that sum to total, by largest remainders; none is 0 where total allows."""
    whole = sum(shares)
    exact = [total * s / whole for s in shares]
    got = [max(1, math.floor(x)) for x in exact]
    order = sorted(range(len(shares)), key=lambda i: (got[i] - exact[i], i))
    k = 0
    while sum(got) < total:
        got[order[k % len(order)]] += 1
        k += 1
    while sum(got) > total and max(got) > 1:
        got[max(range(len(got)), key=lambda i: (got[i] - exact[i], got[i]) if got[i] > 1 else (-math.inf, 0))] -= 1
    return got


def _uniform(key: str, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / float(1 << 52)


class Plan:
    """What is drawn of each source; built on the driver from one row per listed source."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, tokenizer: str = bpe.DEFAULT_TOKENIZER, shard_tokens: int = SHARD_TOKENS):
        wanted = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("most"))
        self.targets = {r.source: (r.share, max(0, r.most)) for r in wanted.limit(MOST_SOURCES + 1).collect()}
        if len(self.targets) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources are listed")
        self.seed = seed
        listed = documents.filter(F.col("source").isin(list(self.targets))) if self.targets else documents.limit(0)
        counted = bpe.token_counts(listed.select("doc_id", "source", "text"), name=tokenizer).filter("n_tokens > 0")
        self.sized = checkpointed(counted.groupBy("doc_id").agg(F.max_by(F.struct("source", "n_tokens"), F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.source", "d.n_tokens"))
        stats = {r.source: r for r in self.sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
        self.names = sorted(s for s, (_, most) in self.targets.items() if s in stats and most > 0)
        self.size = {s: stats[s].tokens for s in self.names}
        self.docs = {s: stats[s].docs for s in self.names}
        whole = sum(self.targets[s][0] for s in self.names)
        self.share = {s: self.targets[s][0] / whole for s in self.names}
        most = {s: self.size[s] * self.targets[s][1] for s in self.names}
        self.total = (total if total is not None else min((math.floor(most[s] / self.share[s]) for s in self.names), default=0)) if self.names else 0
        self.quota = {s: min(most[s], round(self.share[s] * self.total)) for s in self.names}
        self.shards = max(1, math.ceil(sum(self.quota.values()) / shard_tokens))
        slots = max(self.shards * BLOCKS, len(self.names))
        if slots > MOST_BLOCKS:
            raise ValueError(f"{self.shards} shards are more than can be drawn for: take shard_tokens above {shard_tokens}")
        self.blocks = dict(zip(self.names, apportion([self.quota[s] for s in self.names], slots))) if self.total else {}

    def draw(self) -> DataFrame:
        """(source, doc_id, copy, n_tokens, block): every use of every document."""
        spark = self.sized.sparkSession
        rows = [(s, self.size[s], self.quota[s] // self.size[s], self.quota[s] % self.size[s], max(1, math.ceil(self.docs[s] / BUCKET_DOCS)), self.blocks[s], self.quota[s]) for s in self.names if self.quota[s] > 0]
        plan = spark.createDataFrame(rows, "source string, size bigint, passes bigint, rest bigint, buckets bigint, blocks bigint, quota bigint")
        placed = self.sized.join(F.broadcast(plan), "source").withColumn("u", _uniform("doc_id", self.seed)).withColumn("bucket", F.floor(F.col("u") * F.col("buckets")))
        sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
        before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        within = W.partitionBy("source", "bucket").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, -1)
        lined = placed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(offsets, ["source", "bucket"]).withColumn("start", F.col("offset") + F.col("inside"))
        # The rest ends at the document boundary nearest to it.
        uses = F.col("passes") + F.when(F.col("start") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
        copies = lined.withColumn("uses", uses).filter("uses > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("uses") - 1)).alias("copy"))
        middle = F.col("copy") * F.col("size") + F.col("start") + F.col("n_tokens") / 2
        block = F.least(F.floor(middle * F.col("blocks") / F.greatest("quota", F.lit(1))), F.col("blocks") - 1)
        return copies.select("source", "doc_id", F.col("copy").cast("int").alias("copy"), "n_tokens", block.cast("bigint").alias("block"))

    def leaves(self) -> DataFrame:
        """(source, block, shard): which shard holds each block; each shard's run of blocks of a source is contiguous."""
        spark = self.sized.sparkSession
        names = [s for s in self.names if self.quota[s] > 0]
        if not names:
            return spark.createDataFrame([], "source string, block bigint, shard int")
        blocks = [self.blocks[s] for s in names]
        total, shards, seed = sum(blocks), self.shards, self.seed
        width = math.ceil(shards / max(1, min(TOP_NODES, TOP_COUNTS // len(names))))
        top = split((0, shards, blocks, [0] * len(names)), total, shards, seed, width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for node in zip(*(c.to_pylist() for c in batch.columns)):
                    for shard, _, counts, before in split(node, total, shards, seed):
                        held = [(s, b, b + n, shard) for s, n, b in zip(names, counts, before) if n]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.int64(), pa.int64(), pa.int32()))], names=["source", "lo", "hi", "shard"])

        nodes = spark.createDataFrame(top, "first int, past int, counts array<bigint>, before array<bigint>")
        runs = widened(nodes).mapInArrow(run, "source string, lo bigint, hi bigint, shard int")
        return runs.select("source", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("block"), "shard")


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(shard, position, source, doc_id, copy, n_tokens): the mixture, one row for every use of a document."""
    plan = Plan(documents, targets, total, seed)
    held = plan.draw().join(plan.leaves(), ["source", "block"])
    local = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "doc_id", "copy"), "doc_id", "copy")
    return held.select("shard", F.row_number().over(local).alias("position"), "source", "doc_id", "copy", "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per listed source: its target and actual share, tokens, uses, and the most uses of one document."""
    plan = Plan(documents, targets, total, seed)
    spark = documents.sparkSession
    listed = spark.createDataFrame([(s, float(t), int(m)) for s, (t, m) in sorted(plan.targets.items())], "source string, target_share double, max_repeats int")
    used = plan.draw().groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max(F.col("copy") + 1).alias("most_uses"))
    joined = listed.join(used, "source", "left").select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "uses", "most_uses")))
    whole = F.sum("tokens").over(W.partitionBy())
    return joined.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
