"""Operator 12, prefix trie of conversations: sorted sequences, LCPs, range minima over a sparse table.

A conversation is a sequence of turns. Its key is the list of chain digests of its prefixes (16 bytes a turn: the
digest of a prefix is that of the one before it and the next turn), so equal prefixes are equal elements, and sorted
keys hold the members of every trie node next to each other. Equal sequences are one row with a count.

The sorted rows are cut into blocks of at most ``BLOCK`` rows or ``TURNS`` turns. Within a block, the LCPs of
neighbours feed a sparse table of range minima. Every candidate (row, depth) finds the left and the right end of the
rows that share its prefix by two binary searches over that table, independently of all others; the candidate that
stands at its own left end is the node's row in this block. All sums over a subtree are sums over that interval:

* members and words: sums of row counts, and of row counts times the words of whole rows;
* distinct words below a node: the words of each row beyond the LCP with the row before it;
* leaves: rows less those that the next row continues; children: rows that part exactly at the node's depth.

Such sums add up, so a node that reaches over several blocks is put together by a group-by of its rows, one for each
block. Only the last row before a block has to be known there; blocks are dealt by number, so no node, not even the
root or a first turn shared by a third of all conversations, gathers its members in one task.

Nulls: turns without a conversation id belong to none and are left out; a null turn number sorts first; a null role or
text is empty. Turns of one number are ordered by role, then by digest. Repeated rows are repeated turns. No
conversations give no nodes, not even a root. A conversation takes one row of 24 bytes a turn, its texts are not moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import blobs, keep, work_folder

WIDTH = 16
ROOT = bytes(WIDTH)
BLOCK = 1 << 15
TURNS = 1 << 18
IDS = 4096
NO_TURNS = "array<struct<digest: binary, words: bigint>>"


@dataclass
class Trie:
    #: node, parent (digests), depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    nodes: DataFrame
    #: node, first, ids: the conversations that end at a node, in runs of at most ``IDS`` ascending ids
    ends: DataFrame


def sequences(table: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as digest and number of words."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256), 1, 2 * WIDTH))
    words = F.regexp_count(text_, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = table.filter(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), role_.alias("role"), digest.alias("digest"), words.alias("words")).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def _chains(seqs: DataFrame) -> DataFrame:
    """(conv_id, node, key, words): digest of the whole conversation, of all its prefixes, words of each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, keys, words = [], [], []
            for digests, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, out = ROOT, []
                for d in digests:
                    at = hashlib.blake2b(at + d, digest_size=WIDTH).digest()
                    out.append(at)
                ends.append(at)
                keys.append(b"".join(out))
                words.append(np.array(counts, np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs(ends), blobs(keys), blobs(words)], ["conv_id", "node", "key", "words"])

    turns = F.coalesce(F.col("turns"), F.array().cast(NO_TURNS))
    rows = seqs.select(F.col("conv_id").cast("long"), turns["digest"].alias("d"), turns["words"].alias("w"))
    return rows.mapInArrow(run, "conv_id long, node binary, key binary, words binary")


def _runs(made: DataFrame) -> DataFrame:
    """(node, first, ids): the conversations that end at each node; a node with many of them lies in many partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out(done):
            return pa.RecordBatch.from_arrays(
                [blobs([n for n, _ in done]), pa.array([i[0] for _, i in done], pa.int64()), pa.array([i for _, i in done], pa.list_(pa.int64()))],
                ["node", "first", "ids"],
            )

        for batch in batches:
            done = []
            for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (n != node or len(ids) >= IDS):
                    done.append((node, ids))
                    ids = []
                node = n
                ids.append(i)
            yield out(done)
        if ids:
            yield out([(node, ids)])

    rows = made.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    return rows.mapInArrow(run, "node binary, first long, ids array<long>")


def _blocks(distinct: DataFrame) -> DataFrame:
    """Distinct sequences in order, with the number of their block and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, rows, turns = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            block, place = [], []
            for size in (len(k) // WIDTH for k in batch.column(0).to_pylist()):
                if rows and (rows >= BLOCK or turns + size > TURNS):
                    chunk, rows, turns = chunk + 1, 0, 0
                block.append(part + chunk)
                place.append(rows)
                rows, turns = rows + 1, turns + size
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(place, pa.int32()), *batch.columns], schema=shape)

    shape = pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("key", pa.binary()), ("words", pa.binary()), ("n", pa.int64()), ("low", pa.int64())])
    rows = distinct.select("key", "words", "n", "low").repartitionByRange("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "block long, pos int, key binary, words binary, n long, low long")


def _minima(a: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the minimum of every window of 2**k values."""
    levels, span = [a], 1
    while 2 * span <= len(a):
        levels.append(np.minimum(levels[-1][:-span], levels[-1][span:]))
        span *= 2
    return levels


def _reach(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share the first ``depth`` elements of ``row``, by binary search over range minima of LCPs."""
    left, right = row.copy(), row.copy()
    for k in reversed(range(len(levels))):
        if not len(levels[k]):
            continue
        step = 1 << k
        at = left - step
        left = np.where((at >= 0) & (levels[k][np.clip(at, 0, len(levels[k]) - 1)] >= depth), at, left)
        fits = right + step < rows
        right = np.where(fits & (levels[k][np.clip(right, 0, len(levels[k]) - 1)] >= depth), right + step, right)
    return left, right


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


def _within(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of the values at left..right."""
    k = np.frexp((right - left + 1).astype(float))[1] - 1
    out = np.empty(len(left), np.int64)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(levels[level][left[at]], levels[level][right[at] - (1 << level) + 1])
    return out


NODE_ROWS = "block long, node binary, parent binary, depth long, low long, n long, children long, leaves long, saved long"


def _block_nodes(table: pa.Table) -> pa.Table:
    """Nodes of one block: their part of the sums of the whole node."""
    table = table.sort_by("pos").combine_chunks()
    number, place = table["block"][0].as_py(), table["pos"].to_numpy()
    keys, carried = table["key"].to_pylist(), None
    first = int(place[0] < 0)  # the last row before this block
    if first:
        carried = keys[0]
    keys, words = keys[first:], table["words"].to_pylist()[first:]
    n, low = (table[c].to_numpy()[first:].astype(np.int64) for c in ("n", "low"))
    rows, lens = len(keys), np.array([len(k) // WIDTH for k in keys], np.int64)
    flat, off = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2), _sums(lens)
    total = _sums(np.frombuffer(b"".join(words), np.int64))
    upto = lambda i, d: total[off[i] + d] - total[off[i]]  # noqa: E731  words of the first d turns of rows i

    lcp = np.full(rows, -1, np.int64)
    m = np.minimum(lens[1:], lens[:-1])
    pair = np.repeat(np.arange(1, rows), m)
    t = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
    same = (flat[off[pair] + t] == flat[off[pair - 1] + t]).all(axis=1)
    lcp[1:] = np.bincount(pair - 1, same, minlength=rows - 1)
    before = np.concatenate(([-1], lens[:-1]))
    if carried is not None:
        other = np.frombuffer(carried, np.uint64).reshape(-1, 2)
        least = min(len(other), int(lens[0]))
        lcp[0], before[0] = int((flat[:least] == other[:least]).all(axis=1).sum()), len(other)

    row = np.repeat(np.arange(rows), lens + 1)
    depth = np.arange(len(row)) - np.repeat(off[:-1] + np.arange(rows), lens + 1)
    left, right = _reach(_minima(lcp[1:]), row, depth, rows)
    own = left == row
    left, right, depth = left[own], right[own], depth[own]

    fresh = lcp[left] < depth  # the row before the interval is no member: the node begins here
    whole = upto(np.arange(rows), lens)
    beyond = whole - upto(np.arange(rows), np.maximum(lcp, 0))
    above = upto(left, np.maximum(depth - 1, 0))
    members, spent, distinct, continued = _sums(n), _sums(n * whole), _sums(beyond), _sums(lcp == before)
    over = lambda s: s[right + 1] - s[left]
    words_below = over(distinct) + np.where(fresh, whole[left] - above - beyond[left], 0)
    saved = over(spent) - over(members) * above - words_below
    leaves = right - left + 1 - over(continued) + np.where(fresh, (lcp == before)[left], 0)
    parting = np.sort(lcp * (rows + 1) + np.arange(rows))  # rows by the depth at which they part from the row before
    at = depth * (rows + 1)
    children = np.searchsorted(parting, at + right, "right") - np.searchsorted(parting, at + left, "right")
    children += (lens[left] > depth) & (lcp[left] <= depth)

    def digests(places: np.ndarray, none: np.ndarray) -> pa.Array:
        got = np.zeros((len(places), 2), np.uint64)
        got[~none] = flat[places[~none]]
        return pa.Array.from_buffers(pa.binary(WIDTH), len(got), [None, pa.py_buffer(got.tobytes())]).cast(pa.binary())

    count = len(left)
    parent = digests(off[left] + depth - 2, depth < 2)
    return pa.table(
        {
            "block": pa.array(np.full(count, number, np.int64)), "node": digests(off[left] + depth - 1, depth < 1),
            "parent": pc.if_else(pa.array(depth > 0), parent, pa.scalar(None, pa.binary())),
            "depth": depth, "low": _within(_minima(low), left, right), "n": over(members), "children": children, "leaves": leaves, "saved": saved,
        }
    )


def build(seqs: DataFrame) -> Trie:
    """Trie of (conv_id, turns), turns as an array of (digest, words); a conversation id is given once."""
    folder = work_folder(seqs.sparkSession, "trie")
    made = keep(_chains(seqs), folder, "chains")
    ends = keep(_runs(made), folder, "ends")
    same = made.groupBy("node").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.any_value("key").alias("key"), F.any_value("words").alias("words"))
    rows = keep(_blocks(same), folder, "rows")

    last = rows.groupBy("block").agg(F.max_by("key", "pos").alias("key"))
    following = rows.select("block").distinct().withColumn("next", F.lead("block").over(Window.orderBy("block")))  # a row for each block
    carry = last.join(following, "block").filter("next IS NOT NULL")
    carry = carry.select(F.col("next").alias("block"), F.lit(-1).alias("pos"), "key", F.lit(b"").alias("words"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("low"))
    parts = keep(rows.unionByName(carry).groupBy("block").applyInArrow(_block_nodes, NODE_ROWS), folder, "parts")

    whole = parts.groupBy("node").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.min("block").alias("block"), F.min("low").alias("conv_id"),
        F.sum("n").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    whole = keep(whole, folder, "whole")
    # A parent has a row in each block of its children: joined by block, its children are never more than a block's rows.
    there = parts.select("block", "node").join(whole.select("node", "conv_id"), "node")
    parents = there.select("block", F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = whole.join(parents, ["block", "parent"], "left")
    return Trie(nodes.select("node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends)


def digest_of_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the ids, ascending and joined by commas; the runs of a node pass through one digest in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([blobs([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])
        for batch in batches:
            for n, ids in zip(batch.column(0), batch.column(1)):
                n, text = n.as_py(), ",".join(map(str, ids.as_py())).encode()
                if n != node or state is None:
                    if state is not None:
                        yield row()
                    node, state = n, hashlib.sha256(text)
                else:
                    state.update(b"," + text)
        if state is not None:
            yield row()

    rows = ends.select("node", "first", "ids").repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return rows.mapInArrow(run, "node binary, ends_sha256 string")
