"""Exact n-gram Jaccard self-join into classes, by signature trees.

A document's set is its distinct 5-word shingles, as 64-bit hashes.  Two documents link if their Jaccard similarity is at
least ``num / den``; the result names each document's connected component.

The join is that of signature trees: items carry a bitmap of their shingles, inner nodes the OR of their children's
bitmaps, the range of set sizes and the largest number of shingles that share a bit.  Two trees (or one with itself) are
traversed together, and a pair of nodes is left out when its largest possible overlap, the shared bits plus the shared-bit
slack, is below what the smallest sets in it would need.  Pairs of items that remain are intersected exactly, unless they are
connected already.

No task could hold one tree of all documents, so the trees are built in blocks:

1. Equal sets become one class, named by its smallest doc_id; only classes go on.
2. Each class gets ``BANDS`` keys of ``ROWS`` min-hashes.  Two sets at similarity s share none with probability
   (1 - s^3)^48: 1e-15 at 0.8, less above, which is of the order of a collision of the 64-bit shingle hashes.  Sets that
   just share a passage (s of 0.1) meet in a key once in a thousand, so frequent passages make no large groups.
3. Each class that shares a key is sent once, to the smallest class it shares one with, in blocks of ``BLOCK`` that all hold
   that class; each block is a tree joined with itself.  Links give components.
4. A key whose classes are not all in one component goes on; one of more than a block only with classes that may still link.
   Of the classes of such keys all shingles are counted.  A shingle of at most a block of them is rare, any other is common.  Two linked classes of different
   components that share a rare shingle share one among the rarest shingles of both (a prefix of n - 0.8 n + 1), which is a key of
   its own.  Two that share none overlap in common shingles only, so those are bounded: a class leaves a key of min-hashes
   where its common shingles and those of every class of another component are too few for their sizes.
5. While there are keys of more than a block, each class outside its key's largest component meets some of that component in a
   block, in rounds that end once one connects less than half of those outside.
6. For what is left all pairs are decided.  Keys that hang together are one group where that makes fewer rows; a group of a
   block at most is one tree.  Classes of a larger group make blocks by size and component, which meet as summary rows first, and
   the pairs of blocks that survive are joined as trees, where only pairs across components are compared.  After that every key's
   linked pairs are connected.

A group of n copies costs O(n): equal sets collapse, near copies are connected by steps 3 and 5 and skipped after that, and copies
changed too much to link leave in step 4.

Edge cases: fewer than 5 words are one shingle of all words; no words (null, empty) give an empty set that
links with nothing; rows of one doc_id are one node; a null doc_id is one node, below all others; repeated rows are
answered one by one; texts of any length are processed whole; an empty table gives no row; other columns, whatever their names, are
ignored by ``jaccard_classes`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, remove_dir, shingle_set, slices, stored, texts_of, work_dir

WORDS, NUM, DEN = 5, 80, 100
BANDS, ROWS = 48, 3
BLOCK = 192
LEAF, FAN = 8, 8
_RNG = np.random.default_rng(7919)
_XOR = _RNG.integers(0, 1 << 32, size=(BANDS * ROWS, 1), dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, size=(BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key a band from its min-hashes."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 4096):
        part = (low[i : i + 4096] ^ _XOR) * _ODD
        np.minimum(least, (part ^ (part >> np.uint32(15))).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = rows[:, 0] * np.uint64(0x9E3779B97F4A7C15) + rows[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, 2] * np.uint64(0x165667B19E3779F9)
    key ^= key >> np.uint64(31)
    return (key * np.uint64(0xFF51AFD7ED558CCD)).view(np.int64)


# --- the tree
class Tree:
    """A signature tree over sorted arrays of hashes, packed bottom-up in order of (size, smallest min-hash)."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            flags = np.zeros(bits, dtype=np.uint8)
            flags[at] = 1
            self.maps[i] = np.packbits(flags, bitorder="little").view(np.uint64)
        self.slack = self.size - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        order = np.lexsort((np.array([s[0] for s in sets], dtype=np.uint64), self.size))
        #: Levels from the leaves up; a node is (members, OR of the bitmaps, least size, most size, most slack).
        level = [self._node(order[i : i + LEAF].tolist(), None) for i in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self._join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        self.root = level[0] if level else None

    def _node(self, items, children):
        return (items, children, np.bitwise_or.reduce(self.maps[items], axis=0), int(self.size[items].min()), int(self.size[items].max()), int(self.slack[items].max()))

    def _join(self, nodes):
        return (None, nodes, np.bitwise_or.reduce([n[2] for n in nodes], axis=0), min(n[3] for n in nodes), max(n[4] for n in nodes), max(n[5] for n in nodes))


def may_link(a, b, num: int, den: int) -> bool:
    """Whether some pair of items below two nodes can reach the threshold, by size range and largest possible overlap."""
    if a[4] * den < b[3] * num or b[4] * den < a[3] * num:
        return False
    overlap = min(a[4], b[4], int(np.bitwise_count(a[2] & b[2]).sum()) + min(a[5], b[5]))
    return overlap * (num + den) >= num * (a[3] + b[3])


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (len(a) + len(b) - common)


def tree_links(sets: list[np.ndarray], groups: list[int], num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Links that connect what is linked: pairs of indexes, one for each time that two components meet.

    ``groups`` names the component each item starts in.
    """
    if len(sets) < 2:
        return []
    bits = 1 << max(8, (2 * max(map(len, sets)) - 1).bit_length())
    tree = Tree(sets, bits)
    first: dict[int, int] = {}
    up = [first.setdefault(g, i) for i, g in enumerate(groups)]

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out: list[tuple[int, int]] = []
    todo = [(tree.root, tree.root)]
    while todo:
        a, b = todo.pop()
        if a is not b and not may_link(a, b, num, den):
            continue
        if a[1] is None and b[1] is None:
            shared = np.bitwise_count(tree.maps[a[0], None] & tree.maps[None, b[0]]).sum(axis=2, dtype=np.int64)
            sa, sb = tree.size[a[0]][:, None], tree.size[b[0]][None]
            overlap = np.minimum(np.minimum(sa, sb), shared + np.minimum(tree.slack[a[0]][:, None], tree.slack[b[0]][None]))
            for x, y in np.argwhere((num + den) * overlap >= num * (sa + sb)).tolist():
                i, j = a[0][x], b[0][y]
                if (a is not b or x < y) and (p := top(i)) != (q := top(j)) and linked(sets[i], sets[j], num, den):
                    up[max(p, q)] = min(p, q)
                    out.append((i, j))
        else:
            xs, ys = a[1] or [a], b[1] or [b]
            if a is b:
                todo += [(x, xs[j]) for i, x in enumerate(xs) for j in range(i, len(xs))]
            else:
                todo += [(x, y) for x in xs for y in ys]
    return out


# --- connected components
def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of edges (a, b).

    Labels that an edge joins are hooked to the smaller one and edges are contracted, until none is left.
    """
    edges = checkpointed(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = checkpointed(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        hooks = checkpointed(edges.groupBy("b").agg(F.min("a").alias("a")))
        jump = hooks.select(F.col("b").alias("a"), F.col("a").alias("to"))
        hooks = checkpointed(hooks.join(jump, "a", "left").select(F.col("b").alias("label"), F.coalesce("to", "a").alias("less")))
        labels = checkpointed(labels.join(hooks, "label", "left").select("node", F.coalesce("less", "label").alias("label")))
        for side in ("a", "b"):
            edges = edges.join(hooks.withColumnRenamed("label", side), side, "left").withColumn(side, F.coalesce("less", side)).drop("less")
        edges = checkpointed(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after links (a, b) between nodes, which need not have a label yet."""
    if labels is None:
        return components(links)
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(side), "label"), side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    above = components(links).select(F.col("node").alias("label"), F.col("label").alias("up"))
    moved = labels.join(above, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return checkpointed(moved.unionByName(above.select(F.col("label").alias("node"), F.col("up").alias("label"))).groupBy("node").agg(F.min("label").alias("label")))


# --- the join
MAP_WORDS = 16
ROUNDS = 4


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The bitmap of a set as ``MAP_WORDS`` 64-bit words."""
    flags = np.zeros(64 * MAP_WORDS, dtype=np.uint8)
    flags[(shingles & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.int64)


def mixed_keys(members: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """(key, rep, label): the members of the keys whose classes are not all in one component; keys with equal classes are named once."""
    now = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    now = stored(now, f"{path}/now")
    mixed = now.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.sum(F.xxhash64("rep") / F.lit(2.0**20)).cast("long").alias("f"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.count(F.lit(1)).alias("all")).where("l != m")
    once = mixed.groupBy("x", "f", "all").agg(F.min("key").alias("key")).select("key")
    return stored(now.join(once, "key", "left_semi"), f"{path}/mixed")


def shingle_counts(items: DataFrame, words: int, most: int, path: str) -> DataFrame:
    """(item, n, own, common, rare) of ``items`` (item, label, text): how many shingles a text has, how many of them are in texts of
    its label only, how many of the others are in more than ``most`` texts, and what remains as an array of (count, shingle)."""
    # a task counts the shingles of about 4 MB of text; it makes a row for each text, so there are fewer rows than shingles
    parts = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (4 << 20)

    def deal(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingle_set(x, words) for x in texts_of(batch.column("text"))]
                size, h = [len(x) for x in sets], np.concatenate(sets)
                part = (h % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part = part[order]
                columns = [h[order], *(np.repeat(np.asarray(batch.column(c)), size)[order] for c in ("item", "label"))]
                at = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(at, len(part))[1:]
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), *(pa.array([x[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()) for x in columns)], names=["part", "h", "item", "label"])

    def count(key, t):
        h, item, label = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in ("h", "item", "label"))
        order = np.lexsort((item, h))
        h, item, label = h[order], item[order], label[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])]  # repeated rows
        h, item, label = h[once], item[once], label[once]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        runs = np.diff(np.append(at, len(h)))
        own = np.repeat(np.minimum.reduceat(label, at) == np.maximum.reduceat(label, at), runs)
        times = np.repeat(runs, runs)
        rare = ~own & (times <= most)
        items, of = np.unique(item, return_inverse=True)
        each = lambda which: np.bincount(of[which], minlength=len(items))
        by = np.flatnonzero(rare)
        by = by[np.argsort(of[by], kind="stable")]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each(rare))], pa.int32()), pa.StructArray.from_arrays([pa.array(times[by]), pa.array(h[by])], names=["times", "h"]))
        return pa.table({"item": items, "n": np.bincount(of), "own": each(own), "common": each(~own & ~rare), "rare": lists})

    dealt = items.mapInArrow(deal, "part long, h binary, item binary, label binary")
    counted = dealt.groupBy("part").applyInArrow(count, "item long, n long, own long, common long, rare array<struct<times:long,h:long>>")
    return stored(counted.groupBy("item").agg(*[F.sum(c).alias(c) for c in ("n", "own", "common")], F.flatten(F.collect_list("rare")).alias("rare")), f"{path}/counts")


def hopeful_members(now: DataFrame, texts: DataFrame, words: int, num: int, den: int, block: int, path: str) -> DataFrame:
    """(key, rep): keys for all pairs of classes that share a key of ``now``, are in different components and may link.

    Keys of a block at most stay as they are, the others are left by what cannot link.
    Linked sets share ``num / den`` of the larger one at least, so with shingles in order of their counts the first that both have is
    no later in either than what that leaves.  If it is rare, it is their key.  If not, all they share are common shingles, and
    they keep the keys of ``now`` if these may be enough.  ``texts`` are the classes' texts (rep, text); a rep may have several.
    """
    large = shares(now, path).where(F.col("all") > block).select("key")
    small = now.join(large, "key", "left_anti").select("key", "rep")
    if large.isEmpty():
        return small
    now = stored(now.join(large, "key", "left_semi"), f"{path}/large")
    items = texts.join(now.select("rep", "label").distinct(), "rep").withColumn("item", F.xxhash64("rep", "text"))
    items = stored(items, f"{path}/items")
    counts = shingle_counts(items.select("item", "label", "text"), words, block, path)
    counts = counts.join(items.select("item", "rep", "label").distinct(), "item").where((F.col("n") - F.col("own")) * den >= F.col("n") * num)
    first = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - F.col("own")
    rare = counts.select(F.explode(F.slice(F.array_sort("rare"), F.lit(1), first.cast("int"))).alias("s"), "rep", "label", "n", (F.col("n") - F.col("own")).alias("reach"))
    rare = rare.select(F.xxhash64(F.lit("shingle"), "s.h").alias("key"), "rep", "label", "n", "reach")
    common = counts.where(F.col("common") * den >= F.col("n") * num).select("rep", "n", F.col("common").alias("reach"))
    common = now.select("key", "rep", "label").join(common, "rep").select("key", "rep", "label", "n", "reach")
    rows = stored(rare.unionByName(common), f"{path}/hopeful")
    sizes = stored(rows.groupBy("key", "n").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.max("reach").alias("reach")), f"{path}/sizes")
    a, b = rows.alias("a"), sizes.alias("b")
    other = (F.col("b.l") != F.col("a.label")) | (F.col("b.m") != F.col("a.label"))
    enough = F.least("a.reach", "b.reach") * (num + den) >= (F.col("a.n") + F.col("b.n")) * num
    left = a.join(b, (F.col("a.key") == F.col("b.key")) & other & enough, "left_semi").select("key", "rep").distinct()
    return stored(small.unionByName(left), f"{path}/members")


def shares(now: DataFrame, path: str) -> DataFrame:
    """For each key how many classes it has (``all``), its largest component (``main``) and how many of them that has (``ins``)."""
    by = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"))
    return stored(by.select("key", F.col("main.label").alias("main"), "all", F.col("main.n").alias("ins")), f"{path}/shares")


def outsiders_tasks(now: DataFrame, large: DataFrame, block: int, turn: int, path: str) -> DataFrame:
    """(task, rep, label): each class outside the largest component of a key in ``large`` once, in blocks with as many of that component.

    Of several keys a class goes to the largest.  Blocks take different members of the component in turn, so the rows are
    twice the outsiders at most.
    """
    half = max(1, block // 2)
    rows = now.join(large, "key")
    outside = rows.where("label != main").groupBy("rep", "label").agg(F.max(F.struct("all", "key", "ins")).alias("to")).select("rep", "label", F.col("to.key").alias("key"), F.col("to.ins").alias("ins"))
    outside = stored(outside, f"{path}/outside")
    parts = stored(outside.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / half).alias("parts")), f"{path}/parts")
    dealt = lambda n: F.pmod(F.xxhash64("rep", F.lit(turn)), n)
    guests = outside.join(parts, "key").select("key", "rep", "label", dealt(F.col("parts")).alias("part"))
    hosts = rows.where("label = main").join(parts, "key").withColumn("n", F.ceil(F.col("ins") / half)).withColumn("first", dealt(F.col("n"))).where("first < parts")
    hosts = hosts.select("key", "rep", "label", F.explode(F.sequence("first", F.col("parts") - 1, "n")).alias("part"))
    return guests.unionByName(hosts).select(F.xxhash64("key", "part").alias("task"), "rep", "label")


def candidate_groups(now: DataFrame, block: int, path: str) -> DataFrame:
    """``now`` with the keys that hang together as one, where that makes fewer rows: their pairs are then met once, not once a key."""
    hubs = stored(now.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("all")), f"{path}/hubs")
    edges = now.join(hubs, "key").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    whole = stored(components(edges).select(F.col("node").alias("hub"), F.col("label").alias("whole")), f"{path}/whole")
    # the choice is made with a row a key, so no row of a member is dealt by what hangs together
    hubs = stored(hubs.join(whole, "hub"), f"{path}/keys")
    rows_of = lambda n: n * F.ceil(n / block)
    apart = hubs.groupBy("whole").agg(F.sum(rows_of(F.col("all"))).alias("apart"))
    at_once = whole.groupBy("whole").agg(rows_of(F.count(F.lit(1))).alias("at_once"))
    choice = apart.join(at_once, "whole").select("whole", (F.col("at_once") <= F.col("apart")).alias("one"))
    key = F.when(F.col("one"), F.xxhash64("whole")).otherwise(F.col("key")).alias("to")
    chosen = now.join(hubs.join(choice, "whole").select("key", key), "key").select(F.col("to").alias("key"), "rep", "label")
    return stored(chosen.distinct(), f"{path}/groups")


def block_tasks(now: DataFrame, measured, num: int, den: int, block: int, path: str) -> DataFrame:
    """(task, rep, label): every pair of classes of a key that are in different components and may link, in some task.

    A small key is one task.  The classes of a larger one make blocks by size, then component, and a block has one
    row: the OR of its bitmaps, its sizes and its slack.  Rows of blocks meet first, those outside the largest component with
    every block of the key, and only pairs of blocks whose largest possible overlap reaches the threshold become tasks.
    ``measured`` gives the size and bitmap (n, map) of classes.
    """
    rows = now.join(shares(now, path), "key")
    small = rows.where(F.col("all") <= block).select(F.xxhash64("key").alias("task"), "rep", "label")
    large = stored(rows.where(F.col("all") > block), f"{path}/large")
    sizes = stored(measured(large.select("rep").distinct()), f"{path}/sizes")
    # sets that link differ by one size class at most
    large = large.join(sizes, "rep").select("key", "rep", "label", (F.col("label") != F.col("main")).alias("outside"), "n", "map", F.floor(F.log("n") / float(np.log(den / num))).cast("int").alias("level"))
    same = ["key", "outside", "level"]
    of_label = large.groupBy(*same, "label").agg(F.count(F.lit(1)).alias("own"))
    of_level = of_label.groupBy(*same).agg(F.ceil(F.sum("own") / block).alias("parts"))
    # a component that fills blocks of its own is dealt to them; smaller ones stay whole
    dealt = of_label.join(of_level, same).select(*same, "label", F.ceil(F.col("own") / block).alias("split"), F.pmod(F.xxhash64("label"), F.col("parts")).alias("part"))
    dealt = stored(dealt, f"{path}/dealt")
    one = F.when(F.col("split") > 1, F.xxhash64("label", F.pmod(F.xxhash64("rep"), F.col("split")))).otherwise(F.col("part"))
    inside = large.join(dealt, [*same, "label"]).withColumn("block", F.xxhash64("outside", "level", F.col("split") > 1, one))
    inside = stored(inside.select("key", "rep", "label", "outside", "block", "n", "map"), f"{path}/inside")
    ones = lambda words: reduce(operator.add, (F.bit_count(w) for w in words))
    word = lambda i: F.col("map")[i]
    summary = inside.withColumn("slack", F.col("n") - ones(word(i) for i in range(MAP_WORDS))).groupBy("key", "block").agg(F.first("outside").alias("outside"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("slack").alias("slack"), *[F.bit_or(word(i)).alias(f"w{i}") for i in range(MAP_WORDS)])
    summary = stored(summary, f"{path}/summary")
    a, b = summary.where("outside").alias("a"), summary.alias("b")
    shared = ones(F.col(f"a.w{i}").bitwiseAND(F.col(f"b.w{i}")) for i in range(MAP_WORDS))
    overlap = F.least("a.most", "b.most", shared + F.least("a.slack", "b.slack"))
    once = ~F.col("b.outside") | (F.col("a.block") <= F.col("b.block"))
    fits = (F.col("a.most") * den >= F.col("b.least") * num) & (F.col("b.most") * den >= F.col("a.least") * num)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & once & fits & (overlap * (num + den) >= num * (F.col("a.least") + F.col("b.least"))))
    pairs = stored(pairs.select(F.col("a.key").alias("key"), F.col("a.block").alias("x"), F.col("b.block").alias("y")), f"{path}/pairs")
    task = F.xxhash64("key", "x", "y").alias("task")
    sides = pairs.select("key", F.col("x").alias("block"), task).unionByName(pairs.where("x != y").select("key", F.col("y").alias("block"), task))
    return small.unionByName(inside.join(sides, ["key", "block"]).select("task", "rep", "label"))


def jaccard_classes(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of ``df``: doc_id, n_shingles, class_id (smallest doc_id of the equal sets), component_id."""
    spark, kept = df.sparkSession, work_dir(df.sparkSession)
    path = f"{kept}/steps"
    rows = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def sign(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                n, h1, h2, keys = [], [], [], []
                for t in texts_of(batch.column("text")):
                    s = shingle_set(t, words)
                    h = xxhash.xxh3_128_digest(s.tobytes())
                    n.append(len(s))
                    h1.append(int.from_bytes(h[:8], "little", signed=True))
                    h2.append(int.from_bytes(h[8:], "little", signed=True))
                    keys.append(band_keys(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "h1", "h2", "keys"])

    signed = stored(rows.mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, keys array<long>"), f"{kept}/signed")
    classes = signed.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    classes = stored(classes, f"{kept}/classes")
    entries = classes.select("rep", F.posexplode("keys").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "rep")
    groups = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub")).where("size > 1"), f"{path}/groups")
    members = stored(entries.join(groups, "key").select("key", "rep", "hub"), f"{path}/members")
    # all that follows is about the texts that share a key
    involved = members.select("rep").distinct()
    texts = rows.withColumnRenamed("doc_id", "rep").where("text is not null and text != ''").join(involved.hint("merge"), "rep", "left_semi")
    texts = stored(texts, f"{path}/texts")

    def joined(tasks: DataFrame) -> DataFrame:
        """Links found in each task's tree."""

        def run(key, t):
            ids, labels = t.column("rep").to_pylist(), t.column("label").to_pylist()
            sets = [shingle_set(x, words) for x in texts_of(t.column("text"))]
            links = tree_links(sets, labels, num, den)
            return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

        return tasks.distinct().join(texts.hint("merge"), "rep").select("task", "rep", "label", "text").distinct().groupBy("task").applyInArrow(run, "a long, b long")

    # step 3: each class to one hub, in blocks that all hold the hub
    sent = stored(members.groupBy("rep").agg(F.min("hub").alias("hub")).where("rep != hub"), f"{path}/sent")
    hubs = stored(sent.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")), f"{path}/hubs")
    blocks = sent.join(hubs, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"))
    heads = hubs.select("hub", F.col("hub").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = blocks.unionByName(heads).select(F.xxhash64("hub", "part").alias("task"), "rep", F.col("rep").alias("label"))
    labels = merged(None, stored(joined(blocks), f"{path}/links"))

    def measured(reps: DataFrame) -> DataFrame:
        """(rep, n, map): the size and bitmap of the classes' sets."""

        def run(batches):
            for whole in batches:
                for batch in slices(whole, "text"):
                    sets = [shingle_set(x, words) for x in texts_of(batch.column("text"))]
                    yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x) for x in sets], pa.list_(pa.int64()))], names=["rep", "n", "map"])

        return texts.join(reps, "rep", "left_semi").mapInArrow(run, "rep long, n long, map array<long>").where("n > 0")

    # step 4
    now = mixed_keys(members.select("key", "rep"), labels, f"{path}/first")
    members, before = hopeful_members(now, texts, words, num, den, block, f"{path}/first"), None
    # step 5: rounds go on while they connect at least half of the classes outside
    for turn in range(rounds):
        now = mixed_keys(members, labels, f"{path}/{turn}")
        large = shares(now, f"{path}/{turn}").where(F.col("all") > block)
        left = large.agg(F.sum(F.col("all") - F.col("ins"))).first()[0] or 0
        if not left or before is not None and 2 * left > before:
            break
        labels, before = merged(labels, stored(joined(outsiders_tasks(now, large, block, turn, f"{path}/{turn}")), f"{path}/{turn}/links")), left
    else:
        now = mixed_keys(members, labels, f"{path}/{rounds}")
    # step 6
    tasks = block_tasks(candidate_groups(now, block, f"{path}/last"), measured, num, den, block, f"{path}/last")
    labels = merged(labels, stored(joined(tasks), f"{path}/last/links"))
    final = stored(labels, f"{kept}/components")
    remove_dir(spark, path)
    out = signed.select("doc_id", "n", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left")
    out = out.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    null = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(F.coalesce("rep", "doc_id")).alias("class_id"), null(F.coalesce("label", "rep", "doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one document of each component, the one of the smallest doc_id; documents without words all stay.

    A document is a doc_id with a text: rows that share an id, or have none, but differ in text are documents of their own.
    """
    path, name = work_dir(df.sparkSession), "__tokenloom_key"
    number = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID))
    keyed = df.withColumn(name, F.xxhash64(number, F.col(f"`{text}`")))
    found = jaccard_classes(keyed, doc_id=name, text=text, **options).select(F.col("doc_id").alias(name), "component_id").distinct()
    found = found.join(keyed.select(name, number.alias("number")).distinct(), name)
    keep = stored(found.groupBy("component_id").agg(F.min(F.struct("number", name)).alias("least")).select(f"least.{name}"), f"{path}/keep")
    return keyed.join(keep, name, "left_semi").dropDuplicates([name]).drop(name)
