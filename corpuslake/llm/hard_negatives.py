"""Hard negatives for anchors by branch and bound in ball trees.

Vectors are dealt evenly; each partition plants a ball tree for every ``tree_rows`` of its rows, split by
label first and then by the widest component, and writes it as one row of a work table: leaves
of vectors in order, and for every node its centre, radius and labels. A node's inner products with anchor
a lie within a.centre - |a| r and a.centre + |a| r. Anchors come in blocks of ``block`` rows,
which is what a broadcast holds at most; a block passes the trees twice:

1. positives: the first ``positives`` rows of the anchor's label. A node without that label is pruned, and one whose
   upper bound is strictly beneath the anchor's current kth score (equal scores may win by their id);
2. negatives: for each positive, the first ``negatives`` rows of other labels inside its score window.
   A node is pruned if its bounds lie outside of the window, or strictly beneath the window's current kth.

A leaf that is left is scored exactly in integers. Tasks return at most k rows an anchor (and positive); the first of all
are found by rank with partial limits. Every anchor is compared with all rows, in blocks; nothing is sampled.

Nulls and odd input: rows whose label, vec_id or vector is null, with a component that is null, NaN, infinite or
scales beyond ``vectors.LARGEST``, take no part. Of rows that repeat a vec_id the one with the smallest
label and vector takes part. Shorter vectors count as filled up with zeros. Ties go to the smaller vec_id. An anchor without
positive or without negative has no row. Empty tables give an empty result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import partitions, work_path, written
from corpuslake.llm.vectors import matrix, one_vector_each, products

#: No score: beneath all scores that a long of two vectors within ``vectors.LARGEST`` can have.
_NONE = np.int64(-(1 << 62))
#: Columns of a planted tree. ``first``, ``last`` are a node's rows, ``child`` its left child (0: a leaf; the right one follows).
_TREE = "ids array<long>, labels array<int>, dims int, vectors binary, first array<int>, last array<int>, child array<int>, low array<int>, high array<int>, radius array<double>, centres binary"


def plant(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = 128) -> dict:
    """A ball tree over the rows; a parent stands before its children."""
    order = np.arange(len(ids))
    first, last, child, low, high, radius, centres = ([] for _ in range(7))
    nodes = [(0, len(ids))]
    at = 0
    while at < len(nodes):
        a, b = nodes[at]
        rows = order[a:b]
        centre = v[rows].mean(axis=0)
        first.append(a), last.append(b), low.append(labels[rows].min()), high.append(labels[rows].max()), centres.append(centre)
        radius.append(np.sqrt(((v[rows] - centre) ** 2).sum(axis=1).max()))
        if b - a > leaf:
            by = labels[rows] if low[-1] != high[-1] else v[rows, np.ptp(v[rows], axis=0).argmax()] if v.shape[1] else ids[rows]
            rows = rows[np.lexsort((ids[rows], by))]
            by = np.sort(by)
            middle = (b - a) // 2
            if low[-1] != high[-1]:  # between two labels, where that is nearest to the middle
                cuts = np.flatnonzero(by[1:] != by[:-1]) + 1
                middle = int(cuts[np.abs(cuts - middle).argmin()])
            order[a:b] = rows
            child.append(len(nodes))
            nodes += [(a, a + middle), (a + middle, b)]
        else:
            child.append(0)
        at += 1
    return {"order": order, "first": first, "last": last, "child": child, "low": low, "high": high, "radius": radius, "centres": np.array(centres, float).reshape(len(nodes), -1)}


def _planted(tree_rows: int, leaf: int):
    names = [c.split()[0] for c in _TREE.split(", ")]
    schema = pa.schema([(n, {"binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}[c.split()[1]]) for n, c in zip(names, _TREE.split(", "), strict=True)])

    def tree(table: pa.Table) -> pa.RecordBatch:
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        v = matrix(table.column("v").combine_chunks())
        t = plant(ids, labels, v, leaf)
        row = {n: [t[n]] for n in ("first", "last", "child", "low", "high", "radius")} | {"ids": [ids[t["order"]]], "labels": [labels[t["order"]]], "dims": [v.shape[1]], "vectors": [v[t["order"]].astype("<i4").tobytes()], "centres": [t["centres"].astype("<f8").tobytes()]}
        return pa.RecordBatch.from_pydict({n: row[n] for n in names}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, tree_rows - rows)
                held, rows, batch = [*held, part], rows + part.num_rows, batch.slice(part.num_rows)
                if rows == tree_rows:
                    yield tree(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield tree(pa.Table.from_batches(held))

    return run


class Best:
    """The first k (score, id) of each of many searches, higher scores first, ties by the smaller id."""

    def __init__(self, searches: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((searches, k), _NONE), np.zeros((searches, k), np.int64)

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def take(self, search: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(search):
            return
        own, k = np.unique(search), self.k
        search = np.concatenate([np.repeat(own, k), search])
        score = np.concatenate([self.score[own].reshape(-1), score])
        id_ = np.concatenate([self.id[own].reshape(-1), id_])
        order = np.lexsort((id_, -score, search))
        search, score, id_ = search[order], score[order], id_[order]
        place = np.arange(len(search)) - np.searchsorted(search, search)
        keep = place < k
        self.score[search[keep], place[keep]], self.id[search[keep], place[keep]] = score[keep], id_[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        search, place = np.nonzero(self.score != _NONE)
        return search, self.score[search, place], self.id[search, place]


class Tree:
    """A planted tree and the bounds of its nodes for a block of anchors."""

    def __init__(self, row: dict, anchors: np.ndarray) -> None:
        self.ids, self.labels = np.array(row["ids"], np.int64), np.array(row["labels"], np.int64)
        n, dims = len(self.ids), row["dims"]
        self.v = np.frombuffer(row["vectors"], "<i4").astype(np.int64).reshape(n, dims)
        self.first, self.last, self.child, self.low, self.high = (np.array(row[c], np.int64) for c in ("first", "last", "child", "low", "high"))
        radius, centres = np.array(row["radius"]), np.frombuffer(row["centres"], "<f8").reshape(len(row["radius"]), dims)
        d = min(dims, anchors.shape[1])
        length = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
        middle = centres[:, :d] @ anchors[:, :d].T.astype(float)
        reach = radius[:, None] * length
        slack = 1e-9 * (reach + np.sqrt((centres**2).sum(axis=1))[:, None] * length) + 1e-6  # what doubles round off
        self.upper, self.lower = middle + reach + slack, middle - reach - slack
        self.anchors = anchors

    def leaves(self, fits) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the anchors that reach them, likeliest first. ``fits(node, anchors)`` tells which of them may find a row below the node; a leaf is asked again when its turn comes."""
        found, todo = [], [(0, np.arange(len(self.anchors)))]
        while todo:
            node, who = todo.pop()
            who = who[fits(self, node, who)]
            if len(who) and self.child[node]:
                todo += [(self.child[node], who), (self.child[node] + 1, who)]
            elif len(who):
                found.append((self.upper[node, who].mean(), node, who))
        for _, node, who in sorted(found, key=lambda x: -x[0]):
            who = who[fits(self, node, who)]
            if len(who):
                yield node, who

    def scores(self, node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, labels, exact scores of every anchor) of a leaf's rows."""
        part = slice(self.first[node], self.last[node])
        return self.ids[part], self.labels[part], products(self.anchors[who], self.v[part])


def find_positives(row: dict, block: dict, best: Best) -> int:
    """Takes a tree's rows of the anchors' labels into ``best``; returns how many scores were computed."""

    def fits(tree: Tree, node: int, who: np.ndarray) -> np.ndarray:
        return (tree.low[node] <= block["label"][who]) & (block["label"][who] <= tree.high[node]) & (tree.upper[node, who] >= best.kth[who])

    tree, scored = Tree(row, block["v"]), 0
    for node, who in tree.leaves(fits):
        ids, labels, score = tree.scores(node, who)
        scored += score.size
        a, b = np.nonzero((labels == block["label"][who, None]) & (ids != block["id"][who, None]) & (score >= best.kth[who, None]))
        best.take(who[a], score[a, b], ids[b])
    return scored


def find_negatives(row: dict, block: dict, best: Best) -> int:
    """As ``find_positives``, for rows of other labels in each window; search = anchor * windows + window."""
    low, high = block["low"], block["high"]
    windows = low.shape[1]
    least = lambda who: np.maximum(low[who], best.kth.reshape(low.shape)[who])

    def fits(tree: Tree, node: int, who: np.ndarray) -> np.ndarray:
        other = (tree.low[node] != tree.high[node]) | (tree.low[node] != block["label"][who])
        return other & ((tree.upper[node, who, None] >= least(who)) & (tree.lower[node, who, None] <= high[who])).any(axis=1)

    tree, scored = Tree(row, block["v"]), 0
    for node, who in tree.leaves(fits):
        ids, labels, score = tree.scores(node, who)
        scored += score.size
        other = labels != block["label"][who, None]
        for i in range(windows):
            a, b = np.nonzero(other & (score <= high[who, i, None]) & (score >= least(who)[:, i, None]))
            best.take(who[a] * windows + i, score[a, b], ids[b])
    return scored


def _searched(shared, find, k: int, windows: int):
    """(anchor, search, score, id): the first rows of a task for each search of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = Best(len(block["id"]) * windows, k)
        for batch in batches:
            for i in range(batch.num_rows):
                find(batch.slice(i, 1).to_pylist()[0], block, best)
        search, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(block["id"][search // windows]), pa.array((search % windows).astype(np.int32)), pa.array(score), pa.array(ids)], names=["anchor_id", "window", "score", "id"])

    return run


def _first(found: DataFrame, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def _with_windows(block: dict, found: list, positives: int, percent: int) -> dict:
    """The block with a score window for each positive: percent * positive <= 100 * score <= 100 * positive."""
    at = {int(x): i for i, x in enumerate(block["id"])}
    low, high = np.full((len(at), positives), -_NONE), np.full((len(at), positives), _NONE)
    for row in found:
        i, j = at[row["anchor_id"]], row["rank"] - 1
        low[i, j], high[i, j] = -(-percent * row["score"] // 100), row["score"]
    return block | {"low": low, "high": high}


def _block(anchors: DataFrame, most: int) -> dict:
    table = anchors.select("vec_id", "label", "v").toArrow()
    if table.num_rows > most:
        raise ValueError(f"a block of {table.num_rows} anchors where {most} are the bound")
    return {"id": table.column("vec_id").to_numpy(), "label": table.column("label").to_numpy().astype(np.int64), "v": matrix(table.column("v").combine_chunks())}


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, block: int = 8192, tree_rows: int = 4096, leaf: int = 128
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and v (an array of int, null if the row takes no part);
    ``is_anchor`` is a condition on them. ``block`` anchors are in one broadcast: 4 MB of 64 components.
    """
    spark: SparkSession = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "v").filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = written(one_vector_each(rows), "vectors")
    trees = written(rows.repartition(partitions(spark), "vec_id").mapInArrow(_planted(tree_rows, leaf), _TREE), "trees")
    anchors = rows.filter(is_anchor)
    blocks = -(-anchors.count() // (block * 3 // 4))  # dealt by hash, so not all alike
    out = work_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{out}/block=none")
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1))).cast("int"))
    if blocks > 1:
        dealt = written(dealt, "anchors", partition_by=["block"])
    found_schema = "anchor_id long, window int, score long, id long"
    for i in range(blocks):
        own = _block(dealt.filter(F.col("block") == i), block)
        shared = spark.sparkContext.broadcast(own)
        near = _first(trees.mapInArrow(_searched(shared, find_positives, positives, 1), found_schema), positives, "rank").collect()  # at most `positives` an anchor
        wide = spark.sparkContext.broadcast(_with_windows(own, near, positives, percent))
        far = _first(trees.mapInArrow(_searched(wide, find_negatives, negatives, positives), found_schema), negatives, "rank")
        pairs = spark.createDataFrame([(r["anchor_id"], r["rank"] - 1, r["id"], r["score"]) for r in near], "anchor_id long, window int, positive_id long, positive_score long")
        joined = far.join(F.broadcast(pairs), ["anchor_id", "window"])
        joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/block={i}")
        shared.unpersist(), wide.unpersist()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
