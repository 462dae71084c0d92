"""Prefix trie of conversations, built from adaptive radix trees over fixed-width turn ids.

A turn's id is 20 bytes, big-endian: 16 of the SHA-256 of role and text, then the text's length. A
conversation's path is the bytes of its turns, so equal beginnings are equal bytes, and a trie node is a byte
depth that is a multiple of 20. Paths are range-sorted over all tasks (equal paths by conversation, so any
number of copies spreads out); each task puts runs of them, *segments*, into radix trees and walks these.

Only prefixes of a segment's first or last path can stand in another segment. These *edge* nodes are sent as
partial sums and added up; what two neighbouring segments both counted (nodes that they share, and a leaf
that goes on in the next) is taken off again. All other nodes are final where they are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.llm.radix_tree import Node, RadixTree, shared_length
from clickspark.llm.storage import broadcast_if_small, materialise

WIDTH = 20
SEGMENT_ROWS, SEGMENT_BYTES = 100_000, 32 << 20
_PIECE = 5_000  # conversation ids in one piece of a node's list
_BATCH = 5_000

_COLUMNS = [("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()),
            ("node_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
            ("ends_sha256", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("piece", pa.int32()), ("first", pa.binary()), ("last", pa.binary())]
_SCHEMA = ("kind string, conv_id long, depth long, parent_conv_id long, parent_key binary, node_key binary, n_convs long, n_children long, "
           "n_leaves long, saved_tokens long, ends_sha256 string, part int, number int, piece int, first binary, last binary")
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_paths(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path) for every conversation, its turns ordered by turn (null first), equal turns by their
    ids. Null roles and texts are empty; rows without a conversation id belong to none and are left out.

    Texts stay where they are: only turn numbers and ids are shuffled. A conversation's path is one value,
    so it may have up to 100 million turns (2 GB).
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    length = lambda c: F.lpad(F.hex(F.octet_length(c)), 8, "0")
    turn_id = F.concat(F.substring(F.sha2(F.concat(length(role), role, text), 256), 1, 32), length(text))
    slim = turns.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.unhex(turn_id).alias("id"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id")))
    return slim.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda t: F.hex(t["id"])), "")).alias("path"))


def first_turns(path: Column, turns: Column | int) -> Column:
    return F.substring(path, 1, turns * F.lit(WIDTH) if isinstance(turns, Column) else F.lit(turns * WIDTH))


def after_turns(path: Column, turns: Column) -> Column:
    return F.substring(path, turns * F.lit(WIDTH) + 1, F.octet_length(path))


def forked_paths(paths: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % ``family`` (all
    if fewer, none if it is absent); h is the unsigned CRC-32 of c in decimal, modulo ``most`` + 1.

    A base serves at most ``family`` conversations and only its first ``most`` turns are sent.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most + 1)).cast("int")
    bases = paths.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), first_turns(F.col("path"), most).alias("head"))
    found = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(bases, "base", "left")
    head = F.coalesce(first_turns(F.col("head"), h), F.lit(b""))
    return found.select("conv_id", F.concat(head, after_turns(F.col("path"), h)).alias("path"))


def _prefix_keys(path: bytes) -> list[bytes]:
    """Digests that name the nodes on ``path``, from the root on."""
    running = hashlib.sha256()
    keys = [running.digest()]
    for at in range(0, len(path), WIDTH):
        running.update(path[at:at + WIDTH])
        keys.append(running.digest())
    return keys


def _text_bytes(path: bytes, depth: int) -> int:
    return int.from_bytes(path[depth * WIDTH - 4:depth * WIDTH], "big") if depth else 0


def _digest(ends: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


class Segment:
    """A run of sorted (path, conversation) rows as a radix tree."""

    def __init__(self) -> None:
        self.tree, self.rows, self.bytes = RadixTree(), 0, 0
        self.first = self.last = b""

    def add(self, path: bytes, conv_id: int) -> None:
        if not self.rows:
            self.first = path
        if not self.rows or path != self.last:
            self.bytes += len(path)
        self.last = path
        self.rows += 1
        self.tree.insert(path, conv_id)

    def full(self) -> bool:
        return self.rows >= SEGMENT_ROWS or self.bytes >= SEGMENT_BYTES

    def _summed(self) -> list[tuple[Node, int, int]]:
        """(node, start, end) from the root down, in bytes; ``total`` of each node is [conversations, smallest
        one, leaves, text bytes of all members below, of all trie nodes below, trie nodes next below, a path]."""
        order, stack = [], [(self.tree.root, -1, len(self.tree.root.prefix))]
        while stack:
            node, start, end = entry = stack.pop()
            order.append(entry)
            stack.extend((kid, end, end + 1 + len(kid.prefix)) for _, kid in node.children())
        for node, _, end in reversed(order):
            total = [len(node.ends), min(node.ends, default=None), 0, 0, 0, 0, node.key]
            for _, kid in node.children():
                n, low, leaves, all_bytes, own_bytes, nearest, path = kid.total
                reached = range(end // WIDTH + 1, (end + 1 + len(kid.prefix)) // WIDTH + 1)
                passed = sum(_text_bytes(path, d) for d in reached)
                total[0] += n
                total[1] = low if total[1] is None else min(total[1], low)
                total[2] += leaves
                total[3] += all_bytes + n * passed
                total[4] += own_bytes + passed
                total[5] += 1 if reached else nearest
                total[6] = total[6] or path
            total[2] = total[2] or 1
            node.total = total
        return order

    def records(self, part: int, number: int) -> Iterator[dict]:
        """Final nodes, partial edge nodes, their lists of conversations, and the segment's bounds."""
        place = {"part": part, "number": number}
        yield {"kind": "bound", "first": self.first, "last": self.last, **place}
        edges = [(self.first, _prefix_keys(self.first)), (self.last, _prefix_keys(self.last))]
        above = {id(self.tree.root): (None, None, (True, True))}  # parent's conversation, parent's key, path so far shared with first, last
        for node, start, end in self._summed():
            parent, parent_key, along = above.pop(id(node))
            n, low, leaves, all_bytes, own_bytes, nearest, path = node.total
            begin = max(start, 0)
            shared = [begin + shared_length(path[begin:end], edge[begin:end]) if on else -1 for on, (edge, _) in zip(along, edges, strict=True)]
            depths = range(start // WIDTH + 1, end // WIDTH + 1)
            sizes = [_text_bytes(path, d) for d in depths]
            rest = sum(sizes)
            for depth, size in zip(depths, sizes, strict=True):
                last = depth == depths[-1]
                ends = node.ends if last and depth * WIDTH == end else []
                key = next((keys[depth] for (_, keys), reach in zip(edges, shared, strict=True) if depth * WIDTH <= reach), None)
                row = {"conv_id": low, "depth": depth, "parent_key": parent_key, "n_convs": n, "n_children": nearest if last else 1,
                       "n_leaves": leaves, "saved_tokens": all_bytes + n * rest - own_bytes - rest}
                if key is None:
                    yield row | {"kind": "node", "parent_conv_id": parent, "ends_sha256": _digest(ends)}
                else:
                    yield row | {"kind": "edge", "node_key": key}
                    for piece, at in enumerate(range(0, len(ends), _PIECE)):
                        yield {"kind": "ends", "node_key": key, "piece": piece, "first": ",".join(map(str, ends[at:at + _PIECE])).encode(), **place}
                parent, parent_key, rest = (low, None, rest - size) if key is None else (None, key, rest - size)
            on = tuple(reach == end for reach in shared)
            for _, kid in node.children():
                above[id(kid)] = parent, parent_key, on


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in _COLUMNS], [name for name, _ in _COLUMNS])


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    def rows() -> Iterator[dict]:
        part, number, segment = TaskContext.get().partitionId(), 0, Segment()
        for batch in batches:
            for path, conv_id in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if segment.full():
                    yield from segment.records(part, number)
                    number, segment = number + 1, Segment()
                segment.add(path, conv_id)
        if segment.rows:
            yield from segment.records(part, number)

    return _batches(rows())


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a segment and the next one both counted, to be taken off their edge nodes."""
    def rows() -> Iterator[dict]:
        for batch in batches:
            for last, following in zip(batch.column("last").to_pylist(), batch.column("following").to_pylist(), strict=True):
                common = shared_length(last, following) // WIDTH
                keys = _prefix_keys(last[:common * WIDTH])
                again = sum(_text_bytes(last, d) for d in range(common + 1))
                goes_on = -1 if common * WIDTH == len(last) else 0
                for depth, key in enumerate(keys):
                    yield {"kind": "edge", "node_key": key, "depth": depth, "n_convs": 0, "n_children": -1 if depth < common else 0, "n_leaves": goes_on, "saved_tokens": again}
                    again -= _text_bytes(last, depth)

    return _batches(rows())


def _ends_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its sorted pieces; only the running digest is held."""
    def rows() -> Iterator[dict]:
        node, running = None, hashlib.sha256()
        for batch in batches:
            for key, piece in zip(batch.column("node_key").to_pylist(), batch.column("first").to_pylist(), strict=True):
                if key == node:
                    running.update(b",")
                else:
                    if node is not None:
                        yield {"node_key": node, "ends_sha256": running.hexdigest()}
                    node, running = key, hashlib.sha256()
                running.update(piece)
        if node is not None:
            yield {"node_key": node, "ends_sha256": running.hexdigest()}

    for batch in _batches(rows()):
        yield batch.select(["node_key", "ends_sha256"])


def trie_nodes(paths: DataFrame) -> DataFrame:
    """One row per node of the trie over ``paths`` (conv_id not null and unique, path as of
    :func:`turn_paths`): conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree, a
    node's members but one times its last text's bytes) and ends_sha256 (of the sorted, comma-joined ids of
    members that end there). The root is there if any conversation is; no conversations give no rows.

    A task holds one segment: at most 100 000 rows, or 32 MB of different paths. Segments send two paths
    each, their bounds, through one ordered window. A list of conversations that spans segments is digested in
    order from pieces; SHA-256 is sequential, so that is one pass over the ids of that node.
    """
    found = materialise(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_grow, _SCHEMA), "trie")
    bounds = found.filter("kind = 'bound'").select(
        "last", F.lead("first").over(Window.orderBy("part", "number")).alias("following")).filter("following IS NOT NULL")
    partial = found.filter("kind = 'edge'").unionByName(bounds.mapInArrow(_overlap, _SCHEMA))
    digests = found.filter("kind = 'ends'").select("node_key", "part", "number", "piece", "first").repartition("node_key").sortWithinPartitions(
        "node_key", "part", "number", "piece").mapInArrow(_ends_digests, "node_key binary, ends_sha256 string")
    merged = partial.groupBy("node_key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    edges = materialise(merged.join(digests, "node_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_digest([])))), "trie-edges")
    parents = broadcast_if_small(edges.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("edge_parent")), 160)
    nodes = found.filter("kind = 'node'").select("parent_key", *_RESULT).unionByName(
        edges.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent_key", *_RESULT))
    return nodes.join(parents, "parent_key", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "edge_parent")).select(*_RESULT)
