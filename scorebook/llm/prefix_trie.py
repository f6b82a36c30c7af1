"""Prefix trie of conversations by truncation peeling.

A conversation is a path of turn keys, each the digest of its role, its text and the path before it, so equal keys mean
equal beginnings; texts themselves are hashed where they are read and never move. Peeling descends from the greatest
depth: conversations that end at a depth merge with the nodes that survive there, the last turn is stripped, and what has
the same path is grouped again, so nodes are found and summed in the same pass.

Tasks peel whole subtrees. A subtree of more than `crowd` conversations is not given to a task: such crowded nodes (all
their ancestors are crowded too) are found by counting keys, each task's own first. `crowd` grows with the input so that
no more than MOST_CROWDED nodes are crowded; what their uncrowded children sum up to is added by their keys, and the
crowded nodes themselves are peeled last. The ids of the conversations that end at a crowded node are sorted and joined
in spans of IDS_AT_ONCE ids; their digest reads span after span.

Turns are ordered by turn, nulls first; ties by the digest of role and text. Null role or text: empty. Rows without a
conversation id belong to none and are left out. Repeated rows are turns of their own. A conversation may be turnless. An
empty table gives no rows. Very long texts count in full; a task holds the keys of one conversation's turns (24 bytes
each), and streams its subtrees. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import map_rows, table, written

#: Least conversations that crowd a subtree, and the most nodes that may be crowded; ids joined at once.
LEAST_CROWD, MOST_CROWDED, IDS_AT_ONCE = 64, 1 << 17, 1024
#: Bytes of a key; the key of the root; the digest of no ids.
KEY, ROOT, NOTHING = 16, b"\0" * 16, hashlib.sha256(b"").hexdigest()
NODE = "key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def own_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(base, conv, turns): each conversation's turns in order, as (digest, bytes of the text); rows of a base together."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * KEY))
    conv = F.col(conv_col).cast("long")
    rows = turns.where(conv.isNotNull()).select(conv.alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.withColumn("base", F.expr("conv - conv % 5")).repartition("base")
    listed = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("later"), "turn", "digest", "bytes")))
    return rows.groupBy("base", "conv").agg(F.transform(listed, lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def with_heads(own: DataFrame) -> DataFrame:
    """(conv, turns): conversations rebuilt with the first turns of their base in the place of as many of their own."""
    first = F.max(F.when(F.col("conv") == F.col("base"), F.slice("turns", 1, 8))).over(Window.partitionBy("base"))
    head = F.coalesce("head", F.expr("slice(turns, 1, 0)"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")
    rows = own.withColumn("head", first).withColumn("h", h)
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return rows.select("conv", F.concat(F.slice(head, F.lit(1), F.col("h")), rest).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv, keys, sizes): the key of each beginning of a conversation (conv, turns), and the bytes of its last text."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for conv, turns in rows:
            key, keys = ROOT, []
            for turn in turns:
                key = hashlib.sha256(key + turn["digest"]).digest()[:KEY]
                keys.append(key)
            yield conv, keys, [turn["bytes"] for turn in turns]

    return map_rows(conversations.select("conv", "turns"), run, "conv long, keys array<binary>, sizes array<long>")


class Node:
    """What a node has gathered from conversations that end at it and from its children."""

    __slots__ = ("children", "conv", "ends", "keys", "leaves", "n", "saved", "sizes")

    def __init__(self, keys: list[bytes], sizes: list[int]):
        self.keys, self.sizes, self.n, self.conv, self.leaves, self.saved, self.children, self.ends = keys, sizes, 0, None, 0, 0, [], []

    def row(self, key: bytes, parent: bytes, depth: int, parent_conv: int | None, top: bool) -> tuple:
        ends = hashlib.sha256(",".join(map(str, sorted(self.ends))).encode()).hexdigest() if self.ends else NOTHING
        return key, parent, depth, self.conv, parent_conv, self.n, len(self.children), self.leaves, self.saved, ends, top


def peel(ended: list[tuple[int, int, bytes, list[bytes], list[int]]]) -> Iterator[tuple]:
    """NODE rows of one subtree: ended has (conv, depth, parent, keys, sizes), paths from the subtree's top, at `depth`, on."""
    by_depth: dict[int, list[tuple[int, list[bytes], list[int]]]] = {}
    for conv, _, _, keys, sizes in ended:
        by_depth.setdefault(len(keys), []).append((conv, keys, sizes))
    _, above, top_parent, _, _ = ended[0]
    alive: dict[bytes, Node] = {}
    for d in range(max(by_depth), 0, -1):
        for conv, keys, sizes in by_depth.get(d, ()):
            node = alive.get(keys[d - 1])
            if node is None:
                node = alive[keys[d - 1]] = Node(keys, sizes)
            node.n += 1
            node.ends.append(conv)
            node.conv = conv if node.conv is None else min(node.conv, conv)
        shorter: dict[bytes, Node] = {}
        for key, node in alive.items():
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.sizes[d - 1]
            for child, below in node.children:  # all that begins like the parent has been found, so its id is known
                yield below.row(child, key, above + d, node.conv, False)
            if d == 1:
                yield node.row(key, top_parent, above, None, True)
                continue
            parent = shorter.get(node.keys[d - 2])
            if parent is None:
                parent = shorter[node.keys[d - 2]] = Node(node.keys, node.sizes)
            parent.n += node.n
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
            parent.children.append((key, node))
        alive = shorter


def subtrees(cut: DataFrame) -> DataFrame:
    """NODE rows of all uncrowded nodes; cut has (unit, conv, depth, parent, keys, sizes). Sorted units stream through a task."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        unit, held = None, []
        for row in rows:
            if held and row[0] != unit:
                yield from peel(held)
                held = []
            unit = row[0]
            held.append(row[1:])
        if held:
            yield from peel(held)

    return map_rows(cut.repartition("unit").sortWithinPartitions("unit").select("unit", "conv", "depth", "parent", "keys", "sizes"), run, NODE)


def ends_of(ended: DataFrame) -> DataFrame:
    """(key, ends_sha256): digests of the sorted ids of the conversations of (key, conv) that end at each key."""
    spans = ended.groupBy("key", F.floor(F.col("conv") / F.lit(IDS_AT_ONCE)).cast("long").alias("span"))
    joined = spans.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        at, digest = None, None
        for key, ids in rows:
            if key != at:
                if digest is not None:
                    yield at, digest.hexdigest()
                at, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if digest is not None:
            yield at, digest.hexdigest()

    return map_rows(joined.repartition("key").sortWithinPartitions("key", "span").select("key", "ids"), run, "key binary, ends_sha256 string")


def upper(crowded: DataFrame, sums: DataFrame, ends: DataFrame) -> DataFrame:
    """NODE rows of the crowded nodes (key, parent, depth, bytes, n_convs, conv_id), peeled from the deepest on.

    sums: (key, children, leaves, saved) of their uncrowded children. At most MOST_CROWDED nodes, in one task.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        nodes = {r[0]: list(r[1:]) for r in rows}
        for key in sorted(nodes, key=lambda k: -nodes[k][1]):
            parent, depth, size, n, conv, children, leaves, saved, ends = nodes[key]
            leaves, saved = leaves or 1, saved + (n - 1) * size
            above = nodes.get(parent) if depth else None
            if above:
                above[5] += 1
                above[6] += leaves
                above[7] += saved
            yield key, parent, depth, conv, above and above[4], n, children, leaves, saved, ends, False

    none = F.lit(0).cast("long")
    rows = crowded.join(sums, "key", "left").join(ends, "key", "left").select(
        "key", "parent", "depth", "bytes", "n_convs", "conv_id", F.coalesce("children", none), F.coalesce("leaves", none), F.coalesce("saved", none), F.coalesce("ends_sha256", F.lit(NOTHING)),
    )
    return map_rows(rows.coalesce(1), run, NODE)


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuilt: bool = True, least_crowd: int = LEAST_CROWD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    `rebuilt`: conversations get the first turns of their base first (see with_heads); else they stay as they are.
    """
    own = own_turns(turns, conv_col, turn_col, role_col, text_col)
    walks = written(paths(with_heads(own) if rebuilt else own.select("conv", "turns")))
    # crowded nodes, each with what all its members agree on
    n = walks.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    crowd = max(least_crowd, n // MOST_CROWDED)
    beginnings = walks.select("conv", "keys", "sizes", F.explode(F.sequence(F.lit(0), F.size("keys"))).alias("depth"))
    key = F.when(F.col("depth") == 0, F.lit(ROOT)).otherwise(F.expr("try_element_at(keys, nullif(depth, 0))"))
    parent = F.when(F.col("depth") == 0, F.lit(None).cast("binary")).when(F.col("depth") == 1, F.lit(ROOT)).otherwise(F.expr("try_element_at(keys, nullif(depth - 1, 0))"))
    size = F.coalesce(F.expr("try_element_at(sizes, nullif(depth, 0))"), F.lit(0))
    members = beginnings.select(key.alias("key"), parent.alias("parent"), F.col("depth").cast("long").alias("depth"), size.cast("long").alias("bytes"), "conv")
    counted = members.groupBy("key", "parent", "depth", "bytes").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"))
    crowded = written(counted.where((F.col("n_convs") > crowd) | (F.col("depth") == 0)))
    known = walks.sparkSession.sparkContext.broadcast({r[0] for r in crowded.select("key").toLocalIterator()})  # at most MOST_CROWDED and the root

    def cut(rows: Iterable[tuple]) -> Iterator[tuple]:
        for conv, keys, sizes in rows:
            k = next((i for i, x in enumerate(keys) if x not in known.value), len(keys))
            above = keys[k - 1] if k else ROOT
            yield (above, conv, None, None, None, None) if k == len(keys) else (keys[k], conv, k + 1, above, keys[k:], sizes[k:])

    parts = written(map_rows(walks.select("conv", "keys", "sizes"), cut, "unit binary, conv long, depth long, parent binary, keys array<binary>, sizes array<long>"))
    nodes = written(subtrees(parts.where("keys is not null")))
    tops = nodes.where("top").groupBy(F.col("parent").alias("key"))
    sums = tops.agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ends = ends_of(parts.where("keys is null").select(F.col("unit").alias("key"), "conv"))
    above = written(upper(crowded, sums, ends))
    names = F.broadcast(above.select(F.col("key").alias("parent"), F.col("conv_id").alias("above")))
    joined = nodes.where("top").drop("parent_conv_id").join(names, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return above.select(columns).unionByName(joined.select(columns)).unionByName(nodes.where("not top").select(columns))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH turns AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT c, own, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda y, i: xor(y // 2, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END))) AS raw
  FROM turns),
h AS (SELECT c, own, xor(raw, 4294967295) % 9 AS h FROM crc),
rebuilt AS (
  SELECT x.c, list_concat(coalesce(b.own[1:x.h], []), x.own[x.h + 1:]) AS t FROM h x LEFT JOIN turns b ON b.c = x.c - x.c % 5),
begins AS (SELECT c, len(t) AS n, unnest(range(0, len(t) + 1)) AS depth, t FROM rebuilt),
members AS (SELECT c, n, depth, to_json(t[1:depth])::VARCHAR AS path, CASE WHEN depth > 0 THEN to_json(t[1:depth - 1])::VARCHAR END AS above, CASE WHEN depth > 0 THEN octet_length(encode(t[depth].text)) ELSE 0 END AS bytes FROM begins),
nodes AS (
  SELECT path, above, depth, bytes, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY path, above, depth, bytes),
kids AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
firsts AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
sums AS (
  SELECT m.path, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM members m JOIN members x ON x.c = m.c AND x.depth >= m.depth JOIN firsts f ON f.path = x.path AND f.conv_id = x.c GROUP BY m.path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM firsts f JOIN sums s ON s.path = f.path LEFT JOIN nodes p ON p.path = f.above
"""
