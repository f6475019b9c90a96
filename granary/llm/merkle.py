"""A Merkle manifest of a table: a digest for each row, one for each source and one for all, with a proof for each row.

The rows are dealt out by range, and each partition folds its own into a sparse forest: the nodes whose sibling runs it does not
hold whole, keyed by tree, level and index. Forests form a monoid. Merging two is to put their nodes together and to complete every
run whose members are then all there; a tree's number of leaves says how many those are. Neighbouring forests are merged in a
tree of rounds until the root is left. A forest of a range of rows has under 32 nodes a level, so rounds stay small.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, scratch, stored

ARITY = 16
_HEX = 64
#: The tree whose leaves are the other trees' roots.
TOP = -1


def digest(values: list[Column]) -> Column:
    """sha256 of the values one after another: each as its UTF-8 bytes' count, a colon and itself, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def nodes_at(leaves, level):
    """How many nodes a tree of so many leaves has at a level."""
    width = np.int64(ARITY) ** level
    return -(-leaves // width)


class Forest:
    """Nodes (tree, level, index, leaves of the tree, digest) in numpy arrays; `trees` is the number of leaves of the tree TOP."""

    def __init__(self, trees: int, columns: list[np.ndarray]) -> None:
        self.trees, self.columns = trees, columns

    @classmethod
    def empty(cls, trees: int) -> Forest:
        return cls(trees, [np.zeros(0, np.int64) for _ in range(4)] + [np.zeros(0, f"S{_HEX}")])

    def merged(self, other: Forest) -> Forest:
        return Forest(self.trees, [np.concatenate(pair) for pair in zip(self.columns, other.columns, strict=True)])

    def folded(self, completed=None) -> Forest:
        """The forest with every whole run replaced by its parent, again and again. completed(tree, level, run, digests in one
        string of bytes) is told of every run."""
        done, todo = Forest.empty(self.trees).columns, self.columns
        while len(todo[0]):
            todo = self._risen(todo)
            todo = [c[np.lexsort((todo[2], todo[1], todo[0]))] for c in todo]
            tree, level, index, leaves, digests = todo
            run = index // ARITY
            new = np.ones(len(tree), bool)
            new[1:] = (tree[1:] != tree[:-1]) | (level[1:] != level[:-1]) | (run[1:] != run[:-1])
            first = np.flatnonzero(new)
            have = np.diff(np.append(first, len(tree)))
            here = nodes_at(leaves[first], level[first])
            whole = (here > 1) & (have == np.minimum(ARITY, here - ARITY * run[first]))
            parents = []
            for a, n in zip(first[whole].tolist(), have[whole].tolist(), strict=True):
                joined = digests[a : a + n].tobytes()
                parents.append(hashlib.sha256(joined).hexdigest())
                if completed:
                    completed(int(tree[a]), int(level[a]), int(run[a]), joined)
            left = ~np.repeat(whole, have)
            done = [np.concatenate([d, c[left]]) for d, c in zip(done, todo, strict=True)]
            at = first[whole]
            todo = [tree[at], level[at] + 1, run[at], leaves[at], np.array(parents, f"S{_HEX}")]
            if len(at) and len(done[0]):  # parents may complete runs with nodes that were left
                todo, done = [np.concatenate(pair) for pair in zip(done, todo, strict=True)], Forest.empty(self.trees).columns
        return Forest(self.trees, done)

    def _risen(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Roots of the trees below as leaves of the tree TOP."""
        tree, level, index, leaves, digests = columns
        up = (tree != TOP) & (nodes_at(leaves, level) == 1)
        return [np.where(up, TOP, tree), np.where(up, 0, level), np.where(up, tree, index), np.where(up, self.trees, leaves), digests]


def _hexes(column) -> np.ndarray:
    return np.array(column.to_pylist(), f"S{_HEX}") if len(column) else np.zeros(0, f"S{_HEX}")


def _leaves(rows: pa.Table, info: pa.Table) -> tuple[pa.Table, Forest]:
    """A partition's rows in order, and the forest of their leaves. info: this partition's line of _lines()."""
    rows = rows.sort_by("at")
    line = info.slice(0, 1).to_pylist()[0]
    codes = rows.column("group").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    first = np.flatnonzero(new)
    have = np.diff(np.append(first, len(codes)))
    ahead, total = np.zeros(len(first), np.int64), have.astype(np.int64)
    ahead[0] = line["before"]
    total[0] += line["before"]
    total[-1] += line["after"]
    number = np.cumsum(new) - 1
    index = np.arange(len(codes)) - first[number] + ahead[number]
    return rows, Forest(line["trees"], [line["rank"] + number, np.zeros(len(codes), np.int64), index, total[number], _hexes(rows.column("leaf"))])


def _runs_above(forest: Forest) -> list[tuple[int, int, int]]:
    """The runs that the nodes, and all nodes above them, are members of."""
    found = set()
    for tree, level, index, leaves in zip(*(c.tolist() for c in forest.columns[:4]), strict=True):
        while True:
            if nodes_at(leaves, level) > 1:
                found.add((tree, level, index // ARITY))
                level, index = level + 1, index // ARITY
            elif tree != TOP:
                tree, level, index, leaves = TOP, 0, tree, forest.trees
            else:
                break
    return sorted(found)


_NODE = "part int, tree long, level long, index long, leaves long, trees long, digest string, members binary"


def _table(part: int, forest: Forest, runs: list[tuple]) -> pa.Table:
    """Rows of _NODE: nodes have a digest; runs have neither digest nor leaves, and members if they are known."""
    tree, level, index, leaves, digests = forest.columns
    at = [np.array([r[k] for r in runs], np.int64) for k in range(3)]
    n, m = len(tree), len(runs)
    return pa.table(
        {
            "part": pa.array(np.full(n + m, part, np.int32)), "tree": np.concatenate([tree, at[0]]), "level": np.concatenate([level, at[1]]), "index": np.concatenate([index, at[2]]),
            "leaves": pa.array([*leaves.tolist(), *[None] * m], pa.int64()), "trees": pa.array(np.full(n + m, forest.trees, np.int64)),
            "digest": pa.array([*(d.decode() for d in digests.tolist()), *[None] * m], pa.string()), "members": pa.array([*[None] * n, *(r[3] if len(r) > 3 else None for r in runs)], pa.binary()),
        }
    )


def _up(key: tuple[pa.Scalar, ...], rows: pa.Table, info: pa.Table) -> pa.Table:
    """A partition's forest, and the runs that its rows' proofs need from outside."""
    if not rows.num_rows:
        return _table(0, Forest.empty(0), [])
    forest = _leaves(rows, info)[1].folded()
    return _table(key[0].as_py(), forest, _runs_above(forest))


def _merge(key: tuple[pa.Scalar, ...], nodes: pa.Table) -> pa.Table:
    """The forests of neighbouring partitions as one, and the runs that this completed."""
    runs: list[tuple] = []
    columns = [nodes.column(c).to_numpy() for c in ("tree", "level", "index", "leaves")] + [_hexes(nodes.column("digest"))]
    forest = Forest(nodes.column("trees")[0].as_py(), columns).folded(lambda *run: runs.append(run))
    return _table(key[0].as_py(), forest, runs)


def _lines(parts: list[dict]) -> list[tuple]:
    """Where each partition stands in the order of all: part, rank of its first group, rows of that group before it, rows of its last
    group after it, and groups in all."""
    before, ranks = [], []
    rank, seen, last = -1, 0, _NONE
    for p in parts:
        if p["first"]["group"] != last:
            rank, seen = rank + 1, 0
        ranks.append(rank)
        before.append(seen)
        seen = seen + p["last"]["n"] if p["groups"] == 1 else p["last"]["n"]
        rank, last = rank + p["groups"] - 1, p["last"]["group"]
    after = [0] * len(parts)
    for k in range(len(parts) - 2, -1, -1):
        if ranks[k + 1] == ranks[k] + parts[k]["groups"] - 1:
            after[k] = parts[k + 1]["first"]["n"] + (after[k + 1] if parts[k + 1]["groups"] == 1 else 0)
    return [(p["part"], r, b, a, rank + 1) for p, r, b, a in zip(parts, ranks, before, after, strict=True)]


#: No group yet; null is a group.
_NONE = object()


def _down(root: str | None, key_type: pa.DataType):
    def prove(key: tuple[pa.Scalar, ...], rows: pa.Table, given: pa.Table) -> pa.Table:
        names = ["key", "group", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        if not rows.num_rows:
            return pa.table({n: pa.array([], key_type if n == "key" else pa.bool_() if n == "verified" else pa.string()) for n in names})
        info = given.filter(given.column("rank").is_valid())
        rows, forest = _leaves(rows, info)
        runs: dict[tuple, bytes] = {}
        forest.folded(lambda tree, level, run, members: runs.__setitem__((tree, level, run), members))
        far = given.filter(given.column("members").is_valid())
        runs.update(zip(zip(*(far.column(c).to_pylist() for c in ("tree", "level", "index")), strict=True), far.column("members").to_pylist(), strict=True))

        def step(tree: int, level: int, index: int, leaves: int):
            """The node's siblings before and after it, and its parent; None for the root."""
            if nodes_at(leaves, level) == 1:
                if tree == TOP:
                    return None
                return step(TOP, 0, tree, forest.trees)
            members, at = runs[tree, level, index // ARITY], index % ARITY * _HEX
            return members[:at], members[at + _HEX :], (tree, level + 1, index // ARITY, leaves)

        # rows are in order, so what a run's members share is made once and soon let go
        @lru_cache(64)
        def siblings(*node) -> bytes:
            met = step(*node)
            return b"" if met is None else met[0] + met[1] + siblings(*met[2])

        @lru_cache(256)
        def folded(mine: bytes, *node) -> str:
            met = step(*node)
            return mine.decode() if met is None else folded(hashlib.sha256(met[0] + mine + met[1]).hexdigest().encode(), *met[2])

        @lru_cache(64)
        def subroot(tree: int) -> str:
            if forest.trees == 1:
                return root
            at = tree % ARITY * _HEX
            return runs[TOP, 0, tree // ARITY][at : at + _HEX].decode()

        claimed = [None if c is None else c.encode() for c in rows.column("claimed").to_pylist()]
        proofs, ends, tops = [], [], []
        for tree, index, leaves, mine, other in zip(*(forest.columns[k].tolist() for k in (0, 2, 3, 4)), claimed, strict=True):
            met = step(tree, 0, index, leaves)
            proofs.append(hashlib.sha256(b"" if met is None else met[0] + met[1] + siblings(*met[2])).hexdigest())
            ends.append(folded(other or mine, tree, 0, index, leaves))
            tops.append(subroot(tree))
        values = [rows.column("key"), rows.column("group"), rows.column("leaf"), tops, [root] * len(tops), proofs, ends, [e == root for e in ends]]
        return pa.table(dict(zip(names, values, strict=True)))

    return prove


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "source", claimed: dict[str, Column] | None = None, when: Column | None = None, part_rows: int = 1 << 17, fan: int = 32) -> DataFrame:
    """The key and group of each row, its leaf, subroot and root, proof_sha256, folded_root and verified.

    A row's leaf is the digest() of `columns`. Within a group leaves are in the order of `key`, and while there are several nodes every 16
    in a row become the sha256 of their digests; groups' last nodes (subroots), in the order of groups, become the root likewise.
    proof_sha256 is of all siblings from the leaf up to the root. claimed: other values of columns, for rows where `when`
    holds; folded_root is what the leaf of those values and the siblings come to, verified whether that is the root.

    Keys and groups that are null come first; rows of one key in one group are in the order of their leaves, and equal rows are
    interchangeable; a null or empty text is a value like any other; no rows give none. A hot group is spread over partitions as
    all rows are. The driver gets a line for each partition of up to about part_rows rows, and the root.
    """
    spark = docs.sparkSession
    other = digest([(claimed or {}).get(c, F.col(c)) for c in columns])
    hold = fresh(docs, "claimed_leaf")
    given = docs.select(*dict.fromkeys([key, group, *columns]), (F.when(when, other) if when is not None else F.lit(None).cast("string")).alias(hold))
    with_leaf = given.select(F.col(key).alias("key"), F.col(group).cast("string").alias("group"), digest([F.col(c) for c in columns]).alias("leaf"), F.col(hold).alias("claimed"))
    with scratch(spark):
        rows = stored(with_leaf, "leaves")
        n = rows.count()
        parts = max(-(-n // part_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1024)), 1)
        order = [F.col(c).asc_nulls_first() for c in ("group", "key", "leaf", "claimed", "tie")]
        dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        placed = stored(dealt.select("key", "group", "leaf", "claimed", F.spark_partition_id().alias("part"), at.alias("at")), "placed", keep=True)
        runs = placed.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("at").alias("at"))
        of = F.struct("group", "n")
        lines = runs.groupBy("part").agg(F.count("*").alias("groups"), F.min_by(of, "at").alias("first"), F.max_by(of, "at").alias("last"))
        lines = _lines(sorted((r.asDict(recursive=True) for r in lines.collect()), key=lambda p: p["part"]))
        info = spark.createDataFrame(lines, "part int, rank long, before long, after long, trees long")
        nodes = stored(placed.groupBy("part").cogroup(info.groupBy("part")).applyInArrow(_up, _NODE), "forests")
        wanted, known, count = nodes.where("digest is null").select("part", "tree", "level", "index"), [], (max((p[0] for p in lines), default=0)) + 1
        nodes = nodes.where("digest is not null")
        while count > 1:
            near = nodes.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
            made = stored(near.groupBy("part").applyInArrow(_merge, _NODE), "forests")
            nodes, count = made.where("digest is not null"), -(-count // fan)
            known.append(made.where("digest is null").select("tree", "level", "index", "members"))
        roots = [r.digest for r in nodes.select("digest").collect()]
        given = info.withColumns({c: F.lit(None).cast("long") for c in ("tree", "level", "index")} | {"members": F.lit(None).cast("binary")})
        for runs in known:
            given = given.unionByName(wanted.join(runs, ["tree", "level", "index"]), allowMissingColumns=True)
        given = stored(given, "runs", keep=True)
    key_type, group_type = docs.schema[key].dataType.simpleString(), docs.schema[group].dataType
    proved = placed.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(
        _down(roots[0] if roots else None, to_arrow_type(docs.schema[key].dataType)), f"key {key_type}, group string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return proved.select(F.col("key").alias(key), F.col("group").cast(group_type).alias(group), *proved.columns[2:])
