"""Operator 1: n-gram Jaccard join on count-vector R-trees.

A document is the set of its distinct five-word shingles. Each shingle hashes into one of
``GROUPS`` groups, and a set's group counts are its point. Two sets overlap in at most the sum
over groups of the lesser count, so a pair (or, with a node's largest coordinates, a whole
subtree) whose summed minima stay below the overlap that the threshold asks for is dropped
without looking at the sets. Surviving pairs are verified on the whole sets.

One tree over all points can't be split over machines without comparing everything to
everything, so the points are blocked first, without loss: in hash order, two sets that meet
the threshold share a shingle among the first ``n - ceil(0.8 n) + 1`` of either. Blocks of up
to ``LEAF`` points are one leaf. Larger blocks come from shingles that many documents share.
Each set keeps 5% more shingles than the bound needs; a set with no more large blocks than that
surplus meets all its partners in small blocks and leaves the large ones. What stays in large
blocks is mostly groups of near copies: they are joined to one member first, and only blocks
that still hold several components become R-trees. A tree emits a spanning forest of the
components that may join, never all pairs; whole sets then meet inside the clusters so found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .stash import discard, stash
from .words import SHINGLE, mix, slices, words

GROUPS = 256
LEAF = 32
#: Members of a group, and bytes of their sets and points, that a task compares at once; larger groups are cut into parts.
TREE = 4096
PART = 32 << 20
#: Rows that may be broadcast; beyond it the same join shuffles.
SMALL = 1_000_000

_POINT = "doc_id long, node long, n long, point binary"
_KEY = "spot long, node long, n int, key long"
_PAIR = "a long, b long, na int, nb int, shared int, large boolean"


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each document."""
    s, first = words(batch["text"]).shingles(size)
    for a, b in zip(first, first[1:], strict=False):
        yield np.unique(s[a:b])


def _node(u: np.ndarray) -> int:
    """One 64-bit name for equal sets."""
    x = np.array([np.add.reduce(u), np.bitwise_xor.reduce(u)], np.uint64)
    return int(mix(mix(x[:1]) + mix(x[1:] ^ np.uint64(len(u)))).view(np.int64)[0])


def _point(u: np.ndarray) -> bytes:
    """Group counts as 16-bit numbers; a set too large for them has the top number everywhere, which bounds nothing wrongly."""
    if len(u) > 65_535:
        return np.full(GROUPS, 65_535, "<u2").tobytes()
    return np.bincount((u >> np.uint64(40)) % np.uint64(GROUPS), minlength=GROUPS).astype("<u2").tobytes()


def _matrix(points: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(points.to_pylist()), "<u2").reshape(-1, GROUPS)


def _may_meet(x: np.ndarray, y: np.ndarray, nx, ny) -> np.ndarray:
    """Whether the summed coordinate minima reach the overlap that sizes of at least ``nx`` and ``ny`` ask for."""
    low = np.minimum(x, y).sum(-1, dtype=np.uint32).astype(np.int64)
    return (9 * low >= 4 * (nx + ny)) | (low == 65_535 * GROUPS)


def _points(size: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                node, n, point = [], [], []
                for u in _sets(batch, size):
                    node.append(_node(u) if len(u) else None)
                    n.append(len(u))
                    point.append(_point(u))
                yield pa.record_batch([batch["doc_id"], pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(point, pa.binary())], ["doc_id", "node", "n", "point"])

    return run


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap with any partner of a set of ``n``."""
    return (4 * n + 4) // 5


def _keys(size: int):
    """Prefix shingles of each set. Those that over LEAF sets of one flush share are known to be large and skip the bucket's task but for a marker."""

    def flush(rows):
        key, node, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((node, key))
        key, node, n = key[order], node[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n = key[new], node[new], n[new]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        large = (count := np.diff(np.append(np.flatnonzero(head), len(key)))) > LEAF
        marks = key[np.flatnonzero(head)[large]]
        large = np.repeat(large, count)
        spot = np.where(large, mix(node.view(np.uint64) + mix(key.view(np.uint64))).view(np.int64), key)
        yield pa.record_batch([pa.array(spot), pa.array(node), pa.array(n), pa.array(key, mask=~large)], ["spot", "node", "n", "key"])
        if len(marks):
            yield pa.record_batch([pa.array(marks), pa.array(np.zeros(len(marks), np.int64)), pa.array(np.full(len(marks), -1, np.int32)), pa.nulls(len(marks), pa.int64())], ["spot", "node", "n", "key"])

    def run(batches):
        rows, held = [], 0
        for whole in batches:
            for batch in slices(whole):
                for u in _sets(batch, size):
                    if n := len(u):
                        k = min(n, n - needed(n) + 1 + n // 20)
                        rows.append((u[:k].view(np.int64), np.full(k, _node(u)), np.full(k, n, np.int32)))
                        held += k
                if held >= 600_000:
                    yield from flush(rows)
                    rows, held = [], 0
        if rows:
            yield from flush(rows)

    return run


def _meet(spot, node, n, key, large_spot):
    """(pairs and memberships of complete runs as arrays, per _PAIR)."""
    out = []

    def add(a, b, na, nb, shared, large):
        if len(a):
            out.append(pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(na, pa.int32()), pa.array(nb, pa.int32()), pa.array(shared, pa.int32()), pa.array(np.full(len(a), large))], ["a", "b", "na", "nb", "shared", "large"]))

    through = key != 0
    zero = np.zeros(len(spot), np.int32)
    add(key[through], node[through], n[through], zero[through], zero[through], True)
    spot, node, n = spot[~through], node[~through], n[~through]
    if not len(spot):
        return out
    new = np.ones(len(spot), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])
    spot, node, n = spot[new], node[new], n[new]
    run = np.zeros(len(spot), np.int64)
    np.cumsum(spot[1:] != spot[:-1], out=run[1:])
    size = np.bincount(run)
    big = size > LEAF
    big[run[n < 0]] = True
    if large_spot is not None:
        big[run[spot == large_spot]] = True
    mask = big[run]
    k = mask & (n >= 0)
    add(spot[k], node[k], n[k], zero[: k.sum()], zero[: k.sum()], True)
    keep = ~mask & (size[run] > 1)
    node, n, run = node[keep], n[keep], run[keep]
    found = []
    for d in range(1, LEAF):
        if len(run) <= d or not (same := run[d:] == run[:-d]).any():
            break
        i = np.flatnonzero(same)
        x, y = n[i].astype(np.int64), n[i + d].astype(np.int64)
        i = i[5 * np.minimum(x, y) >= 4 * np.maximum(x, y)]
        found.append((node[i], node[i + d], n[i], n[i + d]))
    if found:
        a, b, na, nb = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        head = np.ones(len(a), bool)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(head)
        add(a[at], b[at], na[at], nb[at], np.diff(np.append(at, len(a))), False)
    return out


def _buckets(batches):
    """Rows sorted by (spot, node): pairs of small blocks, members of large ones. Holds at most a flush and LEAF rows of one block."""
    held, size, large_spot = [], 0, None

    def arrays():
        t = pa.Table.from_batches(held)
        return [t[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in ("spot", "node", "n", "key")]

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < 300_000:
            continue
        cols = arrays()
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if size - cut > LEAF + 1 and cols[0][-1] != large_spot:
            tail = cols[1][cut:]
            if len(np.unique(tail)) > LEAF or (cols[2][cut:] < 0).any():
                yield from _meet(*(c[:cut] for c in cols), large_spot)
                large_spot, cols, cut = cols[0][-1], [c[cut:] for c in cols], 0
        if cols[0][-1] == large_spot:
            cut = len(cols[0])
        yield from _meet(*(c[:cut] for c in cols), large_spot)
        rest = [c[cut:] for c in cols]
        if len(rest[0]):  # a run of repeated rows only stays small
            keep = np.ones(len(rest[0]), bool)
            keep[1:] = rest[1][1:] != rest[1][:-1]
            rest = [c[keep] for c in rest]
        held = [pa.record_batch([pa.array(rest[0]), pa.array(rest[1]), pa.array(rest[2]), pa.array(rest[3])], ["spot", "node", "n", "key"])]
        size = len(rest[0])
    if held and size:
        yield from _meet(*arrays(), large_spot)


def _rows(size: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                node, sets = [], []
                for u in _sets(batch, size):
                    node.append(_node(u) if len(u) else None)
                    sets.append(u.view(np.int64))
                yield pa.record_batch([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _whole_sets(docs: DataFrame, points: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, items): the shingles of each of ``nodes`` (node, ...; distinct), from one of its texts."""
    many = nodes.count()
    ids = points.join(_small(nodes, many), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("rep")).select("rep").distinct()
    few = docs.select("doc_id", "text").join(_small(ids, many), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = few.select("text").mapInArrow(_rows(size), "node long, items array<long>").join(_small(nodes, many), "node", "left_semi")
    return stash(sets.groupBy("node").agg(F.first("items").alias("items")), "sets")


def _verified(docs: DataFrame, points: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b), a few for each node, whose whole sets meet the threshold."""
    pairs = stash(pairs.select("a", "b"), "pairs")
    nodes = stash(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    sets = _whole_sets(docs, points, nodes, size)
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    met = met.withColumn("o", both).where(100 * F.col("o") >= 80 * (F.size("x") + F.size("y") - F.col("o"))).select("a", "b")
    met = stash(met, "edges")
    discard(pairs, nodes, sets)
    return met


def _bound(pairs: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (x, y, nx, ny, ...) that may meet; x and y leave."""

    def run(batches):
        for batch in batches:
            if len(batch):
                n = [batch[c].to_numpy(zero_copy_only=False) for c in ("nx", "ny")]
                keep = _may_meet(_matrix(batch["x"]), _matrix(batch["y"]), *n)
                yield batch.drop_columns(["x", "y"]).filter(pa.array(keep))

    rest = [f for f in pairs.schema.fields if f.name not in ("x", "y")]
    return pairs.mapInArrow(run, T.StructType(rest))


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Leaf test: keep pairs (a, b, na, nb) whose summed coordinate minima reach the overlap that their sizes ask for."""
    at = points.where("node is not null").groupBy("node").agg(F.first("point").alias("point"))
    many = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    at = stash(at.join(many, "node", "left_semi"), "bounds")
    pairs = pairs.join(at.select(F.col("node").alias("a"), F.col("point").alias("x")), "a").join(at.select(F.col("node").alias("b"), F.col("point").alias("y")), "b")
    return _bound(pairs.select("a", "b", F.col("na").cast("long").alias("nx"), F.col("nb").cast("long").alias("ny"), "x", "y")).select("a", "b")


class _Members:
    """Members of a group in leaves of LEAF points, each leaf with its largest coordinates and least size.

    Components lie together, in the order of their least sizes, so that the leaves of near copies have tight corners. Rows have
    node, comp and n and point, or the sorted shingles ``items``, from which both follow.
    """

    def __init__(self, rows: pa.Table):
        node, comp = rows["node"].to_numpy(), rows["comp"].to_numpy()
        self.items = None
        if "items" in rows.column_names:
            items = rows["items"].combine_chunks()
            items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
            ends, flat = items.offsets.to_numpy(), items.values.to_numpy().view(np.uint64)
            sets = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            n, points = np.diff(ends).astype(np.int64), [_point(u) for u in sets]
        else:
            n, points = rows["n"].to_numpy(), rows["point"].to_pylist()
        name, comp = np.unique(comp, return_inverse=True)
        least = np.full(len(name), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, n)
        order = np.lexsort((node, n, comp, least[comp]))
        self.node, self.n, self.comp = node[order], n[order], name[comp[order]]
        if "items" in rows.column_names:
            self.items = [sets[i] for i in order.tolist()]
        self.point = np.frombuffer(b"".join(points[i] for i in order.tolist()), "<u2").reshape(-1, GROUPS)
        self.starts = np.arange(0, len(order), LEAF)
        self.top = np.maximum.reduceat(self.point, self.starts) if len(order) else self.point
        self.least = np.minimum.reduceat(self.n, self.starts) if len(order) else self.n

    def may_meet(self, point, n, after: int) -> np.ndarray:
        """Members from ``after`` on in leaves whose corner doesn't rule them out."""
        first = after // LEAF
        leaves = first + np.flatnonzero(_may_meet(point, self.top[first:], n, self.least[first:]))
        k = (self.starts[leaves][:, None] + np.arange(LEAF)).ravel()
        return k[(k >= after) & (k < len(self.n))]


def _similar(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two sorted sets meet the threshold."""
    if len(u) < len(v):
        u, v = v, u
    o = int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum())
    return 100 * o >= 80 * (len(u) + len(v) - o)


def _spanning_links(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
    """Links that join all components that pairs of members join, within ``left`` or between it and ``right``: a forest, so fewer than members.

    Pairs already joined, through whichever links, are passed over; pairs that fail are not told. A pair joins where whole sets are at
    hand and meet the threshold, else where its points allow it.
    """
    x = _Members(left)
    y = x if right is None else _Members(right)
    at = 0 if right is None else len(x.n)
    label = np.unique(x.comp if right is None else np.concatenate([x.comp, y.comp]), return_inverse=True)[1]
    out = []
    for i in range(len(x.n)):
        if len(k := y.may_meet(x.point[i], x.n[i], i + 1 if right is None else 0)):
            k = k[label[at + k] != label[i]]
        if len(k):
            k = k[_may_meet(x.point[i], y.point[k], x.n[i], y.n[k])]
        while len(k):  # one of each component, then what is left of those that weren't joined
            one = np.unique(label[at + k], return_index=True)[1]
            for j in k[one].tolist():
                if x.items is None or _similar(x.items[i], y.items[j]):
                    out.append((x.node[i], y.node[j]))
                    label[label == label[at + j]] = label[i]
            k = np.delete(k, one)
            k = k[label[at + k] != label[i]]
    out = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": out.min(1), "b": out.max(1)} if len(out) else {"a": out[:, 0], "b": out[:, 1]})


def _spanning(member: DataFrame) -> DataFrame:
    """(a, b): links by which members (grp, node, comp, n, and point or items; read several times) of a group join components.

    A task takes at most about PART bytes or TREE members of a group. A larger group is first joined within parts by hash. Of what is
    then still apart, each large component is cut by hash and the small ones by size, and two parts meet where their sizes can and
    more than one component is left: for a group that is one component but for a few members, that grows with the group, not its square.
    """
    share = F.lit(1 / TREE) + (8 * F.col("n") + 2 * GROUPS) / PART
    large = member.groupBy("grp").agg(F.sum(share).alias("share")).where("share > 1")
    large = stash(large.select("grp", F.ceil("share").alias("parts")), "groups")
    cut = member.join(_small(large, large.count()), "grp", "left")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    found = stash(cut.withColumn("part", part).groupBy("grp", "part").applyInArrow(lambda t: _spanning_links(t), "a long, b long").distinct(), "links")
    if not large.head(1):
        discard(large)
        return found
    rest = cut.where("parts > 1").drop("parts")
    roots = components(found.unionByName(rest.select(F.col("node").alias("a"), F.col("comp").alias("b")).where("a <> b")))
    rest = rest.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    apart = rest.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp")
    rest = stash(rest.join(_small(apart, large.count()), "grp", "left_semi"), "apart")
    many = rest.groupBy("grp", "comp").agg(F.sum(share).alias("share")).where("share > 0.5").select("grp", "comp", F.lit(True).alias("whole"))
    many = stash(many, "many")
    rest = rest.join(_small(many, many.count()), ["grp", "comp"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    rest = rest.withColumn("of", F.when(F.col("whole"), F.col("comp")).otherwise(F.floor(F.log("n") / F.log(F.lit(1.25)))))
    parts = stash(rest.groupBy("grp", "whole", "of").agg(F.ceil(F.sum(share)).alias("parts")), "parts")
    rest = rest.join(_small(parts, parts.count()), ["grp", "whole", "of"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    rest = stash(rest, "cut")
    box = rest.groupBy("grp", "whole", "of", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    box = stash(box.withColumn("name", F.struct("whole", "of", "part")), "boxes")
    x, y = (box.select("grp", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "lo", "hi", "c0", "c1")]) for s in "xy")
    met = x.join(y, "grp").where("name_x <= name_y and 5 * hi_x >= 4 * lo_y and 5 * hi_y >= 4 * lo_x and least(c0_x, c0_y) < greatest(c1_x, c1_y)")
    met = stash(met.select("grp", "name_x", "name_y"), "met")

    def side(s: str, pairs: DataFrame) -> DataFrame:
        at = pairs.select("grp", "name_x", "name_y", F.col(f"name_{s}.whole").alias("whole"), F.col(f"name_{s}.of").alias("of"), F.col(f"name_{s}.part").alias("part"))
        at = at.join(rest, ["grp", "whole", "of", "part"]).drop("whole", "of", "part")
        return at.toDF(*at.columns).groupBy("grp", "name_x", "name_y")

    own = side("x", met.where("name_x = name_y")).applyInArrow(lambda t: _spanning_links(t), "a long, b long")
    two = met.where("name_x < name_y")
    cross = side("x", two).cogroup(side("y", two)).applyInArrow(lambda a, b: _spanning_links(a, b), "a long, b long")
    return stash(found.unionByName(own).unionByName(cross).distinct(), "links")


def _between(docs: DataFrame, points: DataFrame, pairs: DataFrame, large: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """Links (a, b) on whole sets between components, of which candidates are ``pairs`` (a, b) and members (key, node) of large blocks.

    An R-tree of each block that holds several components tells by points alone which may join; so do the pairs. Components that may
    join form clusters, a node lies in one cluster only, and so each node's whole set travels once, to be compared inside its cluster.
    """
    member = large.select("key", "node", F.col("n").cast("long").alias("n")).join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    member = stash(member.join(mixed, "key", "left_semi"), "members")
    rx, ry = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    apart = pairs.join(rx, "a", "left").join(ry, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
    apart = stash(apart.where("x <> y"), "apart")
    if not member.head(1) and not apart.head(1):
        return apart.select("a", "b")
    at = points.where("node is not null").groupBy("node").agg(F.first("point").alias("point"))
    at = stash(at.join(member.select("node").distinct(), "node", "left_semi"), "points")
    wide = stash(member.withColumnRenamed("key", "grp").join(at, "node"), "wide")
    may = _spanning(wide)
    discard(wide)
    nodes = member.select("node", "comp").unionByName(apart.select(F.col("a").alias("node"), F.col("x").alias("comp"))).unionByName(apart.select(F.col("b").alias("node"), F.col("y").alias("comp")))
    nodes = stash(nodes.distinct(), "nodes")
    x, y = (nodes.select(F.col("node").alias(c), F.col("comp").alias(d)) for c, d in ("ax", "by"))
    cluster = components(may.join(x, "a").join(y, "b").select("x", "y").unionByName(apart.select("x", "y")).toDF("a", "b"))
    nodes = stash(nodes.join(cluster.select(F.col("node").alias("comp"), F.col("root").alias("grp")), "comp"), "nodes")
    sets = _whole_sets(docs, points, nodes.select("node"), size)
    wide = stash(nodes.join(sets, "node").withColumn("n", F.size("items").cast("long")), "wide")
    found = _spanning(wide)
    discard(wide)
    discard(member, apart, at, may, nodes, sets, cluster)
    return found


def links(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(points, roots): points (doc_id, node, n, point) of every row; roots (node, root) of the sets that link with others.

    ``node`` names a distinct set, so copies of a text are one node. Null and word-less texts have a null node.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    points = stash(docs.mapInArrow(_points(size), _POINT), "points")
    keys = docs.select("text").mapInArrow(_keys(size), _KEY)
    met = stash(keys.repartition("spot").sortWithinPartitions("spot", "node").mapInArrow(_buckets, _PAIR), "met")
    members = stash(met.where("large").groupBy(F.col("a").alias("key"), F.col("b").alias("node")).agg(F.first("na").alias("n")), "large")
    held = stash(members.groupBy("node").agg(F.count("*").alias("h"), F.first("n").alias("n")), "held")
    h = [held.select(F.col("node").alias(c), F.col("h").alias(f"h{c}")) for c in "ab"]
    pairs = met.where("not large").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("shared").alias("shared"))
    pairs = pairs.join(h[0], "a", "left").join(h[1], "b", "left").fillna(0, ["ha", "hb"])
    pairs = pairs.where("shared + least(ha, hb) >= 1 + least(na, nb) div 20").select("a", "b", "na", "nb")
    pairs = stash(_bounded(pairs, points), "candidates")
    stuck = held.where("h > n div 25").select("node")
    large = members.join(stuck, "node", "left_semi")
    # two stuck sets that meet share over n div 25 blocks, so each may leave that many, the largest, and still meets the other in the smallest one
    order = Window.partitionBy("node").orderBy(F.desc("members"), "key")
    often = large.groupBy("key").agg(F.count("*").alias("members"))
    large = large.join(often, "key").withColumn("at", F.row_number().over(order)).where("at > n div 25").select("key", "node", "n")
    large = stash(large, "stuck")
    # first a link for each set to its least neighbour; most groups of copies are whole after it
    lead = large.groupBy("key").agg(F.min("node").alias("b"))
    first = large.join(lead, "key").groupBy(F.col("node").alias("a")).agg(F.min("b").alias("b")).where("a <> b")
    near = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.groupBy("a").agg(F.min("b").alias("b")).where("b < a")
    edges = _verified(docs, points, first.unionByName(near).distinct(), size)
    roots = components(edges)
    # then whatever lies between different components
    rest = _between(docs, points, pairs, large, roots, size)
    if rest.head(1):
        roots = components(edges.unionByName(rest))
    discard(met, members, held, pairs, large, edges, rest)
    return points, roots


def ngram_join(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text, ...): components of Jaccard >= 0.8.

    Other columns are ignored. Null, empty and word-less texts: 0 shingles, a component of their own. Fewer than five words:
    the whole sequence is one shingle. Repeated rows each give a row. A null doc_id counts only where its whole component has none.
    An empty table gives an empty table.
    """
    points, roots = links(docs, size)
    node = points.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    node = node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = node.groupBy("root").agg(F.min("least").alias("component_id"))
    named = node.join(least, "root").select("node", "component_id")
    return points.select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

