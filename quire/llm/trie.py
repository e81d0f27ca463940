"""Prefix trie of conversations by truncation peeling (op 12).

A conversation is written as its path: for every turn 16 bytes of the SHA-256 of role
and text, and the text's length. Equal conversations are one sequence with its number of
members, its smallest id and the digest of its ids. Peeling starts at the greatest
depth. At depth d the surviving nodes (children stripped of their last turn) meet the
sequences that end there; grouping them by path gives the nodes of depth d with members,
children, leaves and saved tokens summed, and these survive to depth d - 1. No node is
visited twice and no path is expanded into all its prefixes.

Peeling one level is one grouped sum, in which a hot node (a greeting that a third of
all conversations start with) is combined before the shuffle. From the smallest depth on
at which the sequences under every node hold at most ``group_turns`` turns, the levels
below a node are independent of all others: they are peeled together, the sequences
under a node in one task. Only the levels above it are grouped and written one by one,
so the number of Spark jobs follows the depth of crowded prefixes, not the longest
conversation.

``rebuilt`` gives every conversation the first turns of another one. Turns are ordered by
turn, null first; ties by role, then text. Null role or text is empty. Rows without a
conversation id are no conversation. Repeated rows are turns of their own. The path of
one conversation (20 bytes a turn) is held in one row. Extra columns are ignored, names
may hold dots. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes a turn has in a path: digest and length of its text.
DIGEST, TURN = 16, 20
#: Turns of the sequences under a node that are peeled in one task.
GROUP_TURNS = 1_000_000
#: Ids of a sequence that are joined at once.
ID_BLOCK = 1 << 16
#: Most parents of a level that are broadcast to their children.
HOT_PARENTS = 100_000
#: Conversations in a family and the most turns taken from its head.
FAMILY, HEAD = 5, 8

_NODE = "depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, path binary"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, p, seg) of every turn: place in its conversation from 0, and its part of a path in hex."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.left(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")).cast("binary"), 256), F.lit(2 * DIGEST))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    seg = F.concat(digest, F.lpad(F.hex(F.octet_length("text")), 2 * (TURN - DIGEST), "0"))
    return rows.filter("conv_id IS NOT NULL").select("conv_id", (F.row_number().over(order) - 1).alias("p"), seg.alias("seg"))


def _paths(parts: DataFrame) -> DataFrame:
    """(conv_id, path) from (conv_id, own, use, part, p, seg); conversations without own rows are left out."""
    used = F.sort_array(F.collect_list(F.when(F.col("use"), F.struct("part", "p", "seg"))))
    got = parts.groupBy("conv_id").agg(F.max("own").alias("own"), used.alias("t")).filter("own")
    return got.select("conv_id", F.unhex(F.array_join(F.col("t.seg"), "")).alias("path"))


def paths(conversations: DataFrame, **cols) -> DataFrame:
    """(conv_id, path) of every conversation as it is."""
    t = turns(conversations, **cols)
    return _paths(t.select("conv_id", F.lit(True).alias("own"), F.lit(True).alias("use"), F.lit(1).alias("part"), "p", "seg"))


def rebuilt(conversations: DataFrame, family: int = FAMILY, head: int = HEAD, **cols) -> DataFrame:
    """(conv_id, path) of every conversation c after its first h turns were replaced by those of conversation c - c % family.

    h is crc32(decimal c) % (head + 1); fewer turns are all taken, an absent conversation gives none.
    """
    t = turns(conversations, **cols)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (head + 1)
    own = t.select("conv_id", F.lit(True).alias("own"), ((F.col("conv_id") % family == 0) | (F.col("p") >= h)).alias("use"), F.lit(1).alias("part"), "p", "seg")
    heads = t.filter((F.col("conv_id") % family == 0) & (F.col("p") < head))
    step = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(1 - family, family) if i]))
    lent = (heads.select(F.col("conv_id").alias("from"), step.alias("step"), "p", "seg")
            .select("from", F.expr("try_add(`from`, step)").alias("conv_id"), "p", "seg")
            .filter((F.col("conv_id") - F.col("conv_id") % family == F.col("from")) & (F.col("p") < h))
            .select("conv_id", F.lit(False).alias("own"), F.lit(True).alias("use"), F.lit(0).alias("part"), "p", "seg"))
    return _paths(own.unionByName(lent))


def sequences(convs: DataFrame) -> DataFrame:
    """(path, len, n, conv_id, ends) of every distinct path: members, smallest id, SHA-256 of the ids in order.

    Ids are joined in blocks of ``ID_BLOCK`` numbers, and a sequence's blocks are fed to its
    digest one after the other, so no list of all its ids is held anywhere.
    """
    ids = F.sort_array(F.collect_list("conv_id"))
    blocks = (convs.withColumn("block", F.shiftright("conv_id", ID_BLOCK.bit_length() - 1)).groupBy("path", "block")
              .agg(ids.alias("ids")).select("path", "block", F.size("ids").alias("n"), F.col("ids")[0].alias("first"),
                                           F.array_join(F.col("ids").cast("array<string>"), ",").alias("text")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, sha, n, first = [], None, None, 0, 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("path", "len", "n", "conv_id", "ends"), r, strict=True)) for r in out],
                                              schema=pa.schema([("path", pa.binary()), ("len", pa.int32()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())]))

        for b in batches:
            for p, k, f, text in zip(*(b.column(c).to_pylist() for c in ("path", "n", "first", "text")), strict=True):
                if p != path:
                    if path is not None:
                        out.append((path, len(path) // TURN, n, first, sha.hexdigest()))
                    path, sha, n, first = p, hashlib.sha256(text.encode()), k, f
                else:
                    sha.update(b"," + text.encode())
                    n += k
            if len(out) >= 1024:
                yield packed()
                out = []
        if path is not None:
            out.append((path, len(path) // TURN, n, first, sha.hexdigest()))
        if out:
            yield packed()

    return (blocks.repartition("path").sortWithinPartitions("path", "block")
            .mapInArrow(digest, "path binary, len int, n bigint, conv_id bigint, ends string"))


def _peel(rows: list[tuple], top: int) -> list[tuple]:
    """Nodes of depth ``top`` and below, from the sequences under one node of depth ``top``.

    A row is (path, len, n, conv_id, ends). The parent of a node of depth ``top`` is not known here.
    """
    chains, ended = [], {}
    for r, (path, size, *_rest) in enumerate(rows):
        key, chain = b"", []
        for d in range(size):
            key = hashlib.blake2b(key + path[TURN * d:TURN * (d + 1)], digest_size=16).digest()
            chain.append(key)
        chains.append(chain)
        ended.setdefault(size, []).append(r)
    out, alive = [], []  # alive: nodes of the level below: [row, conv, n, children, leaves, saved, ends]
    for d in range(max(ended), top - 1, -1):
        level: dict[bytes, list] = {}
        for r in ended.get(d, ()):
            _, _, n, conv, ends = rows[r]
            level[chains[r][d - 1]] = [r, conv, n, 0, 0, 0, ends]
        above = []
        for child in alive:
            r, conv, n, _, leaves, saved, _ = child
            node = level.setdefault(chains[r][d - 1], [r, conv, 0, 0, 0, 0, None])
            node[1] = min(node[1], conv)
            node[2] += n
            node[3] += 1
            node[4] += leaves
            node[5] += saved
            above.append(node)
        for (r, conv, n, children, leaves, saved, ends), node in zip(alive, above, strict=True):
            out.append((d + 1, conv, node[1], n, children, leaves, saved, ends, None))
        alive = list(level.values())
        for node in alive:
            node[4] = node[4] or 1
            node[5] += (node[2] - 1) * int.from_bytes(rows[node[0]][0][TURN * d - TURN + DIGEST:TURN * d], "big")
    out += [(top, conv, None, n, children, leaves, saved, ends, rows[r][0][:TURN * top]) for r, conv, n, children, leaves, saved, ends in alive]
    return out


def _peel_groups(top: int):
    names = [c.split()[0] for c in _NODE.split(", ")]
    types = dict(zip(names, [pa.int32()] + [pa.int64()] * 6 + [pa.string(), pa.binary()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[tuple] = []

        def packed(nodes: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*nodes, strict=True), types.values(), strict=True)], names=names)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("path", "len", "n", "conv_id", "ends")), strict=True):
                if group and row[0][:TURN * top] != group[0][0][:TURN * top]:
                    out += _peel(group, top)
                    group = []
                group.append(row)
                while len(out) >= 8192:
                    yield packed(out[:8192])
                    out = out[8192:]
        if group:
            out += _peel(group, top)
        for lo in range(0, len(out), 8192):
            yield packed(out[lo:lo + 8192])

    return run


def _prefix(depth: int):
    return F.substring("path", 1, TURN * depth)


def _level(below: DataFrame, seqs: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth: stripped children and the sequences that end here, grouped by path."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    children = below.select(_prefix(depth).alias("path"), "conv_id", "n_convs", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens", none.alias("ends"))
    ended = seqs.filter(F.col("len") == depth).select("path", "conv_id", F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends")
    got = children.unionByName(ended).groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends").alias("ends"))
    size = F.conv(F.hex(F.substring("path", TURN * depth - TURN + DIGEST + 1, TURN - DIGEST)), 16, 10).cast("bigint") if depth else zero
    return got.select(F.lit(depth).alias("depth"), "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"),
                      (F.col("saved_tokens") + (F.col("n_convs") - 1) * size).alias("saved_tokens"), "ends", "path")


def _with_parent(nodes: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """Nodes of ``depth`` with the id of their parent.

    Parents of very many children are broadcast (each has more than 1 / HOT_PARENTS of the level,
    so there are fewer than HOT_PARENTS), the others joined by path.
    """
    many = F.lit(max(1_000, nodes.count() // HOT_PARENTS))
    child = nodes.drop("parent_conv_id").withColumn("up", _prefix(depth - 1))
    known = parents.select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > many).alias("hot"))
    hot = F.broadcast(known.filter("hot").drop("hot"))
    crowded = child.join(hot, "up")
    rest = child.join(hot.select("up"), "up", "left_anti").join(known.filter("NOT hot").drop("hot"), "up")
    return crowded.unionByName(rest)


def nodes(convs: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """One row per node of the trie of (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    seqs = written(sequences(convs), "sequences")
    deepest = seqs.agg(F.max("len")).first()[0] or 0
    top = 1
    while top < deepest:  # the smallest depth, by steps of a quarter, from which on the sequences under a node fit a task
        under = seqs.filter(F.col("len") >= top).groupBy(_prefix(top)).agg(F.count("*").alias("n"), F.sum("len").alias("t"))
        if under.filter((F.col("n") > 1) & (F.col("t") > group_turns)).isEmpty():
            break
        top += max(1, top // 4)
    top = max(1, min(top, deepest))
    deep = seqs.filter(F.col("len") >= top).repartition(_prefix(top)).sortWithinPartitions("path")
    deep = written(deep.mapInArrow(_peel_groups(top), _NODE), "trie-deep")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    out = [deep.filter(F.col("depth") > top).select(columns)]
    below = deep.filter(F.col("depth") == top)
    for depth in range(top - 1, -1, -1):
        level = written(_level(below, seqs, depth), f"trie-{depth}")
        out.append(_with_parent(below, level, depth + 1).select(columns))
        below = level
    out.append(below.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(columns))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.select("conv_id", F.col("depth").cast("bigint").alias("depth"), *columns[2:-1], F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"))


def rebuilt_nodes(conversations: DataFrame, **cols) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return nodes(rebuilt(conversations, **cols))
