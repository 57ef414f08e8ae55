"""The trie of conversations' prefixes, built as a compressed (Patricia) tree.

A turn is a 16-byte digest of its role and text, a conversation the string of
its turns' digests, so a prefix of turns is a prefix of bytes.  Conversations
that are equal become one row with its members counted and hashed, the rows are
range-partitioned and sorted, and what two neighbours share is a branch point.

Each partition builds the compressed tree of its rows with a stack: only
branches, ends and leaves are nodes, each with the edge above it.  Sums are made
on those nodes.  A prefix that two partitions share is a node in both, at every
depth, so partial sums of such nodes meet in one aggregate, of as many rows as
there are partitions times the depth that they share; all other nodes lie in one
partition whole.  The unary nodes of an edge are then listed with sums over the
rest of their edge.

No text is shuffled beyond its digest and its length.  The members of a group of
equal conversations are gathered in runs of RUN ids, so that a group that holds a
third of all is split; the runs are hashed one after the other.  What one task
holds: a conversation's turns (20 bytes each), and a partition of about
PART_TURNS turns of distinct conversations.

Defined cases: turns are ordered by turn, null first, ties by their digests; null
roles and texts are empty; rows without a conversation's id belong to none;
repeated rows are turns of their own; further columns go; an empty table gives
no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskline.llm.store import stored

WIDTH = 16
RUN = 4096
PART_TURNS = 200_000
NOTHING = hashlib.sha256(b"").hexdigest()
SORTED = "part int, path binary, sizes array<int>, n_convs long, conv_id long, ends_sha256 string"
NODES = "key binary, depth long, conv_id long, parent binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string"


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digests in hex with their texts' code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.left(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * WIDTH))
    turn = F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("int").alias("size"))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), turn.alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def shared_starts(found: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The conversations with their first turns replaced by those of the first of their group.

    Conversation c takes the first h turns of c - c % group and keeps its own
    after its first h; h is the CRC-32 of its number modulo ``most``.
    """
    of = F.col("conv_id") - F.col("conv_id") % group
    heads = found.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_of"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    none = F.slice("turns", 1, 0)
    joined = found.withColumn("_of", of).join(heads, "_of", "left")
    head = F.coalesce(F.slice("_head", F.lit(1), h), none)
    return joined.select("conv_id", F.concat(head, F.coalesce(own, none)).alias("turns"))


def _members(rows: DataFrame) -> DataFrame:
    """Equal sequences by runs of ids: (path, run, sizes, n, least, ids), ids ascending and joined by commas."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    keyed = rows.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"), F.floor(F.col("conv_id") / RUN).alias("run"))
    return keyed.groupBy("path", "run").agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"),
    )


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """Sorted distinct sequences, stored (SORTED); ``part`` numbers ranges of them."""
    runs = stored(_members(rows))
    turns = runs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    dealt = runs.repartitionByRange(max(1, -(-turns // PART_TURNS)), "path").sortWithinPartitions("path", "run")
    dealt = dealt.withColumn("part", F.spark_partition_id())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashed, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if last is None or row["path"] != last["path"]:
                    if last is not None:
                        out.append(last | {"ends_sha256": hashed.hexdigest()})
                    last, hashed = {"part": row["part"], "path": row["path"], "sizes": row["sizes"], "n_convs": row["n"], "conv_id": row["least"]}, hashlib.sha256(row["ids"].encode())
                else:
                    hashed.update(b"," + row["ids"].encode())
                    last["n_convs"] += row["n"]
                    last["conv_id"] = min(last["conv_id"], row["least"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SORTED)
                out = []
        if last is not None:
            yield pa.RecordBatch.from_pylist([last | {"ends_sha256": hashed.hexdigest()}], schema=_SORTED)

    return stored(dealt.mapInArrow(joined, SORTED))


_SORTED = pa.schema([("part", pa.int32()), ("path", pa.binary()), ("sizes", pa.list_(pa.int32())), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])
_NODES = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent", pa.binary()), ("parent_conv_id", pa.int64()), *((c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved")), ("ends_sha256", pa.string())])


def common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences share from the start; -1 if there is only one."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    unlike = np.flatnonzero(x != y)
    return int(unlike[0] if len(unlike) else n) // WIDTH


class _Part:
    """The compressed tree of a partition's sorted sequences.

    A point is a branch, an end or leaf, or a prefix that a neighbouring
    partition shares; ``row`` is the first sequence that passes through it.
    """

    def __init__(self, rows: list[dict], before: bytes | None, after: bytes | None):
        self.rows = rows
        paths = [before, *(r["path"] for r in rows), after]
        #: What each row shares with the one before it; last, what the last row shares with the next partition.
        self.lcp = [common(a, b) for a, b in zip(paths[:-1], paths[1:])]
        self.depth: list[int] = []
        self.row: list[int] = []
        self.above: list[int] = []
        self.end: dict[int, int] = {}
        self._build()

    def _point(self, depth: int, row: int) -> int:
        self.depth.append(depth)
        self.row.append(row)
        self.above.append(-1)
        return len(self.depth) - 1

    def _build(self) -> None:
        head, tail = self.lcp[0], self.lcp[-1]
        stack = [self._point(d, 0) for d in range(max(head, 0) + 1)]
        for i, row in enumerate(self.rows):
            if i:
                self._close(stack, self.lcp[i])
            if self.depth[stack[-1]] < len(row["sizes"]):
                stack.append(self._point(len(row["sizes"]), i))
            self.end[stack[-1]] = i
        # Each depth that goes on into the next partition is a point.
        there, spine = {self.depth[x]: x for x in stack}, []
        for d in range(self.depth[stack[-1]], -1, -1):
            if d in there:
                spine.append(there[d])
            elif d <= tail:
                spine.append(self._point(d, self.row[spine[-1]]))
        for low, high in zip(spine[:-1], spine[1:]):
            self.above[low] = high
        self.right = {x for x in spine if self.depth[x] <= tail}

    def _close(self, stack: list[int], upto: int) -> None:
        """Points deeper than this are whole; one of this depth branches off where there is none."""
        while self.depth[stack[-1]] > upto:
            low = stack.pop()
            if self.depth[stack[-1]] < upto:
                stack.append(self._point(upto, self.row[low]))
            self.above[low] = stack[-1]

    def nodes(self) -> pa.Table:
        """All nodes: whole ones, and shared ones (those with a key) as partial sums."""
        n = len(self.depth)
        count, leaves, children, moved, begun = ([0] * n for _ in range(5))
        least: list[int | None] = [None] * n
        left = [r == 0 and d <= self.lcp[0] for r, d in zip(self.row, self.depth)]
        sums = [np.concatenate([[0], np.cumsum(np.array(r["sizes"], np.int64))]).tolist() for r in self.rows]
        for x, i in self.end.items():
            count[x], least[x] = self.rows[i]["n_convs"], self.rows[i]["conv_id"]
            leaves[x] = int(self.lcp[i + 1] < self.depth[x])
        # Sums on the compressed tree, from below: of members times size, and of sizes once, over all nodes beneath.
        for x in sorted(range(n), key=lambda x: -self.depth[x]):
            if (up := self.above[x]) >= 0:
                own = sums[self.row[x]]
                edge = own[self.depth[x]] - own[self.depth[up]]
                count[up] += count[x]
                leaves[up] += leaves[x]
                moved[up] += moved[x] + count[x] * edge
                # What the partition before has too begins there and is counted there.
                begun[up] += begun[x] + (0 if left[x] else edge)
                children[up] += not left[x]
                least[up] = least[x] if least[up] is None else min(least[up], least[x])
        keys = {True: _keys(self.rows[0]["path"], max(self.lcp[0], 0)), False: _keys(self.rows[-1]["path"], max(self.lcp[-1], 0))}
        shared = lambda x: left[x] or x in self.right
        key = lambda x: keys[left[x]][self.depth[x]]
        out = []
        for x in range(n):
            d, up, own = self.depth[x], self.above[x], sums[self.row[x]]
            last = own[d] - own[d - 1] if d else 0
            saved = moved[x] - begun[x] + count[x] * last - (0 if left[x] else last)
            ends = self.rows[self.end[x]]["ends_sha256"] if x in self.end else None
            if shared(x):
                parent = keys[left[x]][d - 1] if d else None
                out.append((key(x), d, least[x], parent, None, count[x], children[x], leaves[x], saved, ends))
                continue
            start = self.depth[up] if up >= 0 else d - 1
            for k in range(d, start, -1):
                # Above the point its edge's nodes are unary: theirs is the point's sum and that of the rest of the edge.
                rest = (count[x] - 1) * (own[d - 1] - own[k - 1]) if k < d else 0
                parent, parent_id = None, least[x]
                if k == start + 1:
                    parent, parent_id = (None, None) if up < 0 else (key(up), None) if shared(up) else (None, least[up])
                out.append((None, k, least[x], parent, parent_id, count[x], children[x] if k == d else 1, leaves[x], saved + rest, ends if k == d else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _NODES.types)], schema=_NODES)


def _keys(path: bytes, depth: int) -> list[bytes]:
    """The keys of a sequence's prefixes of 0 to depth turns."""
    h = hashlib.sha256()
    out = [h.digest()]
    for k in range(depth):
        h.update(path[k * WIDTH : (k + 1) * WIDTH])
        out.append(h.copy().digest())
    return out


def trie(rows: DataFrame) -> DataFrame:
    """Every node of the trie of sequences (conv_id, turns: array of digest and size).

    ``saved_tokens`` sums, over a node's subtree, members less one times the size
    of the node's last turn; ``ends_sha256`` hashes the members that end there.
    """
    ordered = distinct_sequences(rows)
    across = Window.orderBy("part")  # two rows' worth of bytes for each partition
    ends = ordered.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    bounds = ends.select("part", F.lag("high").over(across).alias("before"), F.lead("low").over(across).alias("after"))

    def build(part: pa.Table, bound: pa.Table) -> pa.Table:
        if not len(part):
            return _NODES.empty_table()
        (around,) = bound.to_pylist()
        return _Part(sorted(part.to_pylist(), key=lambda r: r["path"]), around["before"], around["after"]).nodes()

    found = stored(ordered.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(build, NODES))
    sums = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")}
    shared = stored(
        found.where("key is not null").groupBy("key").agg(
            F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), *sums.values(), F.max("ends_sha256").alias("ends_sha256"),
        )
    )
    names = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = found.where("key is null")
    linked = whole.where("parent is not null").drop("parent_conv_id").join(names, "parent").unionByName(shared.join(names, "parent", "left"))
    every = whole.where("parent is null").unionByName(linked)
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
