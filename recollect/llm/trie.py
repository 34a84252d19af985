"""Conversation prefix trie: one node for each different sequence of first turns, with rollups over its subtree.

Turns are put in order by a sort over ranges, so that a long conversation spans many tasks, and each prefix gets a
digest chained over its turns, by pieces of `PIECE` turns. A node whose subtree holds more than `most` rows is heavy;
so are all nodes above it. Below the heavy nodes each subtree is a shard of at most `most` rows. Tasks take many
shards at once as a forest: level by level numpy numbers the nodes, a LOUDS bit vector (for each node a one a child,
then a zero) and a label array hold the trie, and rollups go from the last level to the first by `np.add.at`.
Heavy nodes are merged as tables: members, children and bytes are counts by digest, and leaves and saved bytes come
from each conversation's own rows, where a unit (a shard, or a heavy node without children) counts once, at the
smallest conversation through it.

Rows of a null conv_id belong to no conversation and are left out. Turns of a null `turn` come first, equal turns are
taken by role, then text; a null role or text is empty. Repeated rows are turns of their own. Without a conversation
there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import common

#: Turns that are chained in one task; a longer conversation is chained over its pieces.
PIECE = 4096
#: Rows of shards that are built as one forest.
TOGETHER = 50_000
#: Conversations in one piece of a node's list.
LISTED = 4096
#: Heavy nodes that are broadcast, of some 60 bytes each; beyond that they are joined by a shuffle.
BROADCAST = 200_000
ROOT = bytes(16)

def _root() -> Column:
    return F.lit(bytearray(ROOT))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def order_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, part, position from 0, key, size, n_turns) of rows (conv_id, turn, role, text).

    `key` is a digest of role and text, `size` the text's UTF-8 bytes. A conversation's rows of one `part` stand in
    one partition; joins by (conv_id, part) have no key that grows with a conversation.
    """
    spark = common.prepare(rows.sparkSession)
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    key = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    in_order = turns.repartitionByRange(common.parallelism(spark), *by).sortWithinPartitions(*by)

    def numbered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, n = TaskContext.get().partitionId(), None, 0
        for x in frames:
            ids = x.column(0).to_numpy()
            if not len(ids):
                continue
            new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            at = np.arange(len(ids)) - np.repeat(new, np.diff(np.append(new, len(ids))))
            if ids[0] == conv:
                at[: new[1] if len(new) > 1 else len(ids)] += n
            conv, n = ids[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(at), x.column(1), x.column(2)], names=["conv_id", "part", "at", "key", "size"])

    slim = in_order.select("conv_id", key.alias("key"), F.octet_length("text").cast("bigint").alias("size"))
    local = common.staged(slim.mapInArrow(numbered, "conv_id bigint, part int, at bigint, key binary, size bigint"), "turns")
    parts = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    own = Window.partitionBy("conv_id")
    parts = parts.select("conv_id", "part", (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("n_turns"))
    return local.join(parts, ["conv_id", "part"]).select("conv_id", "part", (F.col("at") + F.col("before")).alias("position"), "key", "size", "n_turns")


def _chained(before: Column, key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(before, key), 256)), 1, 16)


def _chain(before: bytes, key: bytes) -> bytes:
    return hashlib.sha256(before + key).digest()[:16]


def prefix_ids(turns: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, id, parent, size, n_turns): a digest of each prefix and of the one before it."""
    spark = common.prepare(turns.sparkSession)
    pieces = turns.select("conv_id", F.floor(F.col("position") / PIECE).alias("piece"), "position", "key", "size", "n_turns")
    dealt = pieces.repartition(common.parallelism(spark), "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "position")

    def local(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, ROOT
        for x in frames:
            ids, before = [], []
            for conv, piece, key in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(3).to_pylist(), strict=True):
                if (conv, piece) != last:
                    last, state = (conv, piece), ROOT
                before.append(state)
                state = _chain(state, key)
                ids.append(state)
            yield pa.RecordBatch.from_arrays([*x.columns[:3], *x.columns[4:], pa.array(ids, pa.binary()), pa.array(before, pa.binary())], names=["conv_id", "piece", "position", "size", "n_turns", "id", "parent"])

    found = dealt.mapInArrow(local, "conv_id bigint, piece bigint, position bigint, size bigint, n_turns bigint, id binary, parent binary")
    found = common.staged(found.withColumn("depth", F.col("position") + 1), "chains")

    def joined(rows):
        """The prefix before each piece but the first, from the pieces' own chains."""
        rows, state, out = rows.sort_values("piece"), ROOT, []
        for own in rows["id"]:
            state = bytes(own) if state == ROOT else _chain(state, bytes(own))
            out.append(state)
        return rows.assign(start=out, piece=rows["piece"] + 1)[["conv_id", "piece", "start"]]

    whole = found.where(f"depth % {PIECE} = 0").select("conv_id", "piece", "id")
    starts = whole.groupBy("conv_id").applyInPandas(joined, "conv_id bigint, piece bigint, start binary")
    later = found.where("piece > 0").join(starts, ["conv_id", "piece"])
    first = F.col("depth") % PIECE == 1
    later = later.select("conv_id", "depth", _chained(F.col("start"), F.col("id")).alias("id"), F.when(first, F.col("start")).otherwise(_chained(F.col("start"), F.col("parent"))).alias("parent"), "size", "n_turns")
    return found.where("piece = 0").select(*later.columns).unionByName(later)


class Louds:
    """A trie by the number of children of its nodes in level order, from node 0, the root."""

    def __init__(self, degrees: np.ndarray, labels: np.ndarray) -> None:
        bits = np.ones(len(degrees) + int(degrees.sum()), np.uint8)
        bits[np.cumsum(degrees + 1) - 1] = 0
        self.n, self.size, self.bits, self.labels = len(degrees), len(bits), np.packbits(bits), labels

    def parents(self) -> np.ndarray:
        """Of each node but the root, whose entry is 0: the one bit of node i has a zero for each node before its parent."""
        bits = np.unpackbits(self.bits, count=self.size)
        ones = np.flatnonzero(bits)
        return np.concatenate(([0], ones - np.arange(len(ones))))

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=self.size) == 0)
        return np.diff(np.concatenate(([-1], zeros))) - 1

    def levels(self) -> list[tuple[int, int]]:
        """[first, end) of each level; the children of a level are the next."""
        degrees, out, start, end = self.degrees(), [], 0, 1
        while start < end:
            out.append((start, end))
            start, end = end, end + int(degrees[start:end].sum())
        return out

    def rolled_up(self, own: np.ndarray) -> np.ndarray:
        """The sum of each node's subtree."""
        total, parents = own.astype(np.int64), self.parents()
        for start, end in reversed(self.levels()[1:]):
            np.add.at(total, parents[start:end], total[start:end])
        return total


def forest(conv: np.ndarray, depth: np.ndarray, label: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The trie of conversations' rows under one root, and the node of each row. `label` is two numbers a row.

    Rows of a conversation have consecutive depths; where they begin is the level below the root.
    """
    who = np.unique(conv, return_inverse=True)[1]
    least = np.full(who.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, who, depth)
    level = depth - least[who]
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(level.max(initial=-1) + 2))
    at, node, parents, labels, n = np.zeros(len(least), np.int64), np.zeros(len(conv), np.int64), [], [np.zeros((1, 2), np.uint64)], 1
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        rows = order[a:b]
        above = at[who[rows]]
        sort = np.lexsort((label[rows, 1], label[rows, 0], above))
        rows, above = rows[sort], above[sort]
        new = np.concatenate(([True], (above[1:] != above[:-1]) | (label[rows[1:]] != label[rows[:-1]]).any(axis=1)))
        node[rows] = n + np.cumsum(new) - 1
        at[who[rows]] = node[rows]
        parents.append(above[new])
        labels.append(label[rows[new]])
        n += int(new.sum())
    degrees = np.bincount(np.concatenate(parents), minlength=n) if parents else np.zeros(1, np.int64)
    return Louds(degrees, np.concatenate(labels)), node


_LIGHT = "id binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, top boolean"


def _light_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of whole shards, from rows (shard, conv_id, depth, id, parent, size) of which none is heavy."""

    def built(x: pa.Table) -> pa.RecordBatch:
        conv, depth, size = (x.column(c).to_numpy().astype(np.int64) for c in ("conv_id", "depth", "size"))
        label = np.frombuffer(b"".join(x.column("id").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        trie, node = forest(conv, depth, label)
        members = np.bincount(node, minlength=trie.n)
        first = np.full(trie.n, np.iinfo(np.int64).max)
        np.minimum.at(first, node, conv)
        of = np.zeros(trie.n, np.int64)
        of[node] = np.arange(len(node))  # some row of each node
        degrees, parents = trie.degrees(), trie.parents()
        leaves = trie.rolled_up(degrees == 0)
        saved = trie.rolled_up(np.concatenate(([0], (members[1:] - 1) * size[of[1:]])))
        at, top = of[1:], parents[1:] == 0
        ids = [a.tobytes() for a in trie.labels[1:].astype(">u8")]
        above = pa.array(first[parents[1:]], mask=top)
        columns = [pa.array(ids, pa.binary()), x.column("parent").take(pa.array(at)).combine_chunks(), depth[at], first[1:], above, members[1:], degrees[1:], leaves[1:], saved[1:], top]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c) for c in columns], names=[f.split()[0] for f in _LIGHT.split(", ")])

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in frames:
            if not x.num_rows:
                continue
            held.append(x)
            if sum(h.num_rows for h in held) >= TOGETHER:
                whole = pa.Table.from_batches(held)
                shard = whole.column("shard").to_pylist()
                cut = next((i for i in range(len(shard) - 1, 0, -1) if shard[i] != shard[i - 1]), 0)
                if cut:
                    yield built(whole.slice(0, cut))
                    held = whole.slice(cut).combine_chunks().to_batches()
        if held:
            yield built(pa.Table.from_batches(held))

    n = common.parallelism(rows.sparkSession)
    return rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(work, _LIGHT)


def _ends(enders: DataFrame) -> DataFrame:
    """(id, ends_sha256): the digest of the conversations (id, conv_id) of each node, ascending, joined by commas."""
    n = common.parallelism(enders.sparkSession)

    def listed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node, ids, seq, first = TaskContext.get().partitionId(), None, [], 0, True
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["id", "part", "seq", "ids", "whole"])

        for x in frames:
            for key, conv in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                if key != node or len(ids) == LISTED:
                    if ids:
                        out.append((node, part, seq, ",".join(map(str, ids)), key != node and seq == 0 and not first))
                    first = first and (node is None or key == node)
                    seq = seq + 1 if key == node else 0
                    node, ids = key, []
                ids.append(conv)
            yield batch()
            out.clear()
        if ids:  # the next partition may go on with it
            out.append((node, part, seq, ",".join(map(str, ids)), False))
        yield batch()

    def digested(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        out: list[tuple] = []
        for x in frames:
            for key, ids in zip(x.column(0).to_pylist(), x.column(3).to_pylist(), strict=True):
                if key != node:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            out.append((node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["id", "ends_sha256"])

    by = ["id", "conv_id"]
    in_order = enders.select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by)
    lists = common.staged(in_order.mapInArrow(listed, "id binary, part int, seq bigint, ids string, whole boolean"), "ends")
    split = lists.where("not whole").repartition(n, "id").sortWithinPartitions("id", "part", "seq")
    return lists.where("whole").select("id", F.sha2("ids", 256).alias("ends_sha256")).unionByName(split.mapInArrow(digested, "id binary, ends_sha256 string"))


def prefix_nodes(turns: DataFrame, members: DataFrame, most: int = 1024) -> DataFrame:
    """The trie's nodes: id, depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, from turns (conv_id, position, key, size, n_turns) and all conversations' ids.

    `members` (conv_id, n_turns) has turnless conversations too. saved_tokens sums (n_convs - 1) * size over a
    subtree. `most` is the rows of a shard at most.
    """
    rows = common.staged(prefix_ids(turns), "prefixes")
    member = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = member.select(_root().alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("size"))

    nodes = rows.groupBy("id").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("size").alias("size"), F.sum(F.expr("n_turns - depth + 1")).alias("below"))
    heavy = common.staged(nodes.where(F.col("below") > most).drop("below").unionByName(root), "heavy")
    n_heavy = heavy.count()
    marks = _small(heavy.select("id", F.col("conv_id").alias("owner"), F.expr("(n_convs - 1) * size").alias("saves")), n_heavy)
    marked = rows.join(marks, "id", "left")

    first = F.first("id").over(Window.partitionBy("conv_id").orderBy("depth"))
    shards = marked.where("owner is null").select("conv_id", "depth", "id", "parent", "size").withColumn("shard", first)
    light = common.staged(_light_nodes(shards), "light")
    tops = light.where("top").select("id", "parent", "depth", "conv_id", "n_leaves", "saved_tokens")

    children = tops.select("parent").unionByName(heavy.where("parent is not null").select("parent")).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    upper = heavy.join(children, "id", "left").fillna(0, ["n_children"])
    bare = upper.where("n_children = 0 and depth > 0").select("conv_id", F.lit(1).cast("bigint").alias("unit_leaves"), F.lit(0).cast("bigint").alias("unit_saved"))
    units = bare.unionByName(tops.select("conv_id", F.col("n_leaves").alias("unit_leaves"), F.col("saved_tokens").alias("unit_saved")))

    saves = F.when(F.col("owner") == F.col("conv_id"), F.col("saves")).otherwise(0)
    above = marked.where("owner is not null").select("conv_id", F.floor(F.col("depth") / PIECE).alias("piece"), "depth", "id", saves.alias("saves"))
    pieces = above.groupBy("conv_id", "piece").agg(F.sum("saves").alias("saves")).join(units, "conv_id", "left")
    after = F.sum("saves").over(Window.partitionBy("conv_id").orderBy(F.desc("piece"))) - F.col("saves")
    rest = pieces.select("conv_id", "piece", (after + F.coalesce("unit_saved", F.lit(0))).alias("after"), F.coalesce("unit_leaves", F.lit(0)).alias("unit_leaves"))
    suffix = F.sum("saves").over(Window.partitionBy("conv_id", "piece").orderBy(F.desc("depth")))
    shares = above.withColumn("suffix", suffix).join(rest, ["conv_id", "piece"])
    sums = shares.groupBy("id").agg(F.sum("unit_leaves").alias("n_leaves"), F.sum(F.col("suffix") + F.col("after")).alias("saved_tokens"))
    sums = common.staged(sums, "heavy-sums")

    level = tops.where("depth = 1").select("n_leaves", "saved_tokens").unionByName(heavy.where("depth = 1").select("id").join(sums, "id").select("n_leaves", "saved_tokens"))
    total = level.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    sums = sums.unionByName(total.select(_root().alias("id"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens")))
    upper = upper.join(sums, "id")

    names = _small(heavy.select(F.col("id").alias("parent"), F.col("conv_id").alias("above")), n_heavy)
    columns = ["id", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    top = light.where("top").drop("parent_conv_id").unionByName(upper.select(*upper.columns[:-2], "n_leaves", "saved_tokens").drop("size").withColumn("top", F.lit(True)))
    top = top.join(names, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    found = light.where("not top").select(*columns).unionByName(top.select(*columns))

    ends = rows.where("depth = n_turns").select("id", "conv_id").unionByName(members.where("n_turns = 0").select(_root().alias("id"), "conv_id"))
    return found.join(_ends(ends), "id", "left").fillna(hashlib.sha256().hexdigest(), ["ends_sha256"])


def conversation_trie(rows: DataFrame, most: int = 1024) -> DataFrame:
    """The nodes (prefix_nodes) of the conversations of rows (conv_id, turn, role, text)."""
    turns = order_turns(rows.select("conv_id", "turn", "role", "text"))
    return prefix_nodes(turns, turns.where("position = 0").select("conv_id", "n_turns"), most)
