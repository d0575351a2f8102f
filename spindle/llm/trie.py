"""Operator 13, conversation prefix trie in double arrays.

A node of the trie is a distinct sequence of first turns (role, text); its
members are the conversations that start with it.

1. Texts become 128-bit turn digests at the scan.  Conversations are dealt out
   and sorted; a stream over each gives every prefix a digest chained from its
   turns (``prefixes``, written once).  Texts are in no shuffle.
2. A prefix whose members have more than ``SHARD_ROWS`` turns below it is an
   upper node; counts come from a grouping that is combined on the map side.
   Below the upper nodes hang the shards: the subtree of a prefix with at most
   SHARD_ROWS turns, so a popular first turn is split along deeper turns until
   it fits, and a shard's memory is bounded whatever the data.
3. In a shard turns get dense ids.  A double array is packed over them: the
   child of state s by turn t is state BASE[s] + t if CHECK of that place is s.
   Walking every conversation through the array counts members and ends;
   a pass in reverse order of depth sums up leaves and saved tokens.
4. Shards that share upper nodes are merged globally: what an upper node or a
   shard's top adds is booked on its smallest member's path, running sums
   from the end of that path give the part of every upper node, and a
   grouping by node adds the parts up.
5. The ends of upper nodes may be any number of conversations.  They are sorted
   over all tasks, joined into pieces of text there, and only these are
   streamed through the hash.

Defined results
* null role or text: the empty string; null turn: before all others; equal turns: by role, then by the text's digest
* repeated rows: each is a turn; null conv_id: no conversation
* a conversation without rebuilt turns is a member of the root alone and ends there
* very long texts: hashed whole at the scan; a very long conversation is streamed by one task, its state is one digest
* empty table: no rows; other columns are ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_schema, read_table, written

#: Turns of a shard at most; conversation ids in a piece of joined ends.
SHARD_ROWS, PIECE_IDS = 256, 4096
#: Digest of the empty prefix.
ROOT = bytes(16)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, chars): every turn, numbered from 0 in its conversation, its content as a digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn_key"),
        F.char_length(text).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_key")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "turn_key", "chars")


def rebuilt(conversations: DataFrame, heads: int = 6) -> DataFrame:
    """(conv_id, pos, turn_key, chars, length): conversations whose first h turns are those of the first conversation of
    their hundred, h = crc32(conv_id) % heads.  One without turns has a single row with a null pos and length 0."""
    own = written(turns(conversations), "trie-turns")
    c = F.col("conv_id")
    head = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")).select("conv_id", "n_own", head.alias("h"), (c - c % 100).alias("base"))
    lent = own.where((c % 100 == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    wanted = sizes.join(lent, "base").where("pos < h").select("conv_id", "pos", "turn_key", "chars")
    kept = own.withColumn("h", head).where("pos >= h").drop("h")
    n_lent = lent.groupBy("base").agg(F.count(F.lit(1)).alias("n_lent"))
    n_head = F.least(F.col("h").cast("long"), F.coalesce("n_lent", F.lit(0)))
    length = sizes.join(n_lent, "base", "left").select("conv_id", (n_head + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"))
    empty = length.where("length = 0").select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("chars"))
    return wanted.unionByName(kept).unionByName(empty).join(length, "conv_id")


_LONG, _BYTES = T.LongType(), T.BinaryType()
PREFIXES = T.StructType(
    [
        T.StructField("conv_id", _LONG),
        T.StructField("depth", _LONG),
        T.StructField("node", _BYTES),
        T.StructField("parent", _BYTES),
        T.StructField("turn_key", _BYTES),
        T.StructField("chars", _LONG),
        T.StructField("length", _LONG),
    ]
)


def prefixes(rows: DataFrame) -> DataFrame:
    """One row per conversation and prefix, the empty one included, from ``rebuilt`` rows (pos need not be gapless)."""
    schema = arrow_schema(PREFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, node = None, 0, ROOT
        for batch in batches:
            out = []
            for c, pos, key, chars, length in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    conv, depth, node = c, 0, ROOT
                    out.append((c, 0, ROOT, None, None, 0, length))
                if pos is None:
                    continue
                before, node, depth = node, hashlib.md5(node + key, usedforsecurity=False).digest(), depth + 1
                out.append((c, depth, node, before, key, chars, length))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = rows.select("conv_id", "pos", "turn_key", "chars", "length").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(run, PREFIXES)


@dataclass
class DoubleArray:
    """BASE and CHECK over dense turn ids 1..n; state 1 is the top, the child of s by t is base[s] + t."""

    base: np.ndarray = field(default_factory=lambda: np.zeros(64, np.int64))
    check: np.ndarray = field(default_factory=lambda: np.zeros(64, np.int64))
    _free: int = 2  # every place below is taken

    def _grow(self, n: int) -> None:
        if n > len(self.base):
            more = max(n, 2 * len(self.base)) - len(self.base)
            self.base, self.check = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.base, self.check))

    def place(self, state: int, labels: list[int]) -> None:
        """Find a base at which all children of ``state`` (sorted, distinct labels) fall on free places."""
        while self._free < len(self.check) and self.check[self._free]:
            self._free += 1
        at = np.array(labels)
        first = max(1, self._free - labels[0])
        while True:
            self._grow(first + labels[-1] + 65)
            tries = np.arange(first, first + 64)
            ok = (self.check[tries[:, None] + at[None, :]] == 0).all(axis=1)
            if ok.any():
                base = int(tries[ok.argmax()])
                break
            first += 64
        self.base[state] = base
        self.check[base + at] = state

    def step(self, state: int, label: int) -> int:
        """The child of ``state`` by ``label``, or 0."""
        to = int(self.base[state]) + label
        return to if self.base[state] and to < len(self.check) and self.check[to] == state else 0


def packed(paths: list[list[int]]) -> DoubleArray:
    """The trie of label sequences."""
    out = DoubleArray()
    out.check[1] = -1
    level = [(1, sorted(p for p in paths), 0)]
    while level:
        state, group, depth = level.pop()
        by_label: dict[int, list[list[int]]] = {}
        for p in group:
            if len(p) > depth:
                by_label.setdefault(p[depth], []).append(p)
        if by_label:
            labels = sorted(by_label)
            out.place(state, labels)
            base = int(out.base[state])
            level += [(base + x, by_label[x], depth + 1) for x in labels]
    return out


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


NODES = T.StructType(
    [
        T.StructField("node", _BYTES),
        T.StructField("parent", _BYTES),
        T.StructField("conv_id", _LONG),
        T.StructField("depth", _LONG),
        T.StructField("parent_conv_id", _LONG),
        T.StructField("n_convs", _LONG),
        T.StructField("n_children", _LONG),
        T.StructField("n_leaves", _LONG),
        T.StructField("saved_tokens", _LONG),
        T.StructField("ends_sha256", T.StringType()),
        T.StructField("top", T.BooleanType()),
    ]
)


def shard_nodes(convs: list[tuple[int, int, int | None, list[dict]]]) -> list[tuple]:
    """The nodes of one shard.  ``convs``: (conv_id, length, above, path), where a path lists the prefixes (depth, node,
    parent, turn_key, chars) from the shard's top on and ``above`` is the conv_id of the upper node that it hangs on."""
    dense: dict[bytes, int] = {}
    paths = [[dense.setdefault(p["turn_key"], len(dense) + 1) for p in path[1:]] for *_, path in convs]
    trie = packed([list(p) for p in {tuple(p) for p in paths}])
    members: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    info: dict[int, tuple[dict, int]] = {}  # the prefix and the parent's state
    for (conv, length, _, path), labels in zip(convs, paths, strict=True):
        state, above = 1, 0
        for p, label in zip(path, [0, *labels], strict=True):
            if label:
                above, state = state, trie.step(state, label)
            members.setdefault(state, []).append(conv)
            info.setdefault(state, (p, above))
        if path[-1]["depth"] == length:
            ends.setdefault(state, []).append(conv)
    children, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    saved = {s: (len(m) - 1) * info[s][0]["chars"] for s, m in members.items()}
    for s in sorted(members, key=lambda s: -info[s][0]["depth"]):
        leaves[s] = leaves[s] or 1  # a node without children is a leaf itself
        if above := info[s][1]:
            children[above] += 1
            leaves[above] += leaves[s]
            saved[above] += saved[s]
    return [
        (
            p["node"], p["parent"], min(members[s]), p["depth"], min(members[above]) if above else convs[0][2], len(members[s]),
            children[s], leaves[s], saved[s], digest(ends.get(s, [])), not above,
        )
        for s, (p, above) in info.items()
    ]


def _shards(paths: DataFrame) -> DataFrame:
    """Nodes of all shards, from one row (top, conv_id, length, above, path) per conversation."""
    schema = arrow_schema(NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, convs = None, []

        def table() -> pa.RecordBatch:
            rows = shard_nodes(convs)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for t, *conv in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if convs and t != top:
                    yield table()
                    convs = []
                top = t
                convs.append(conv)
        if convs:
            yield table()

    return paths.select("top", "conv_id", "length", "above", "path").repartition("top").sortWithinPartitions("top").mapInArrow(run, NODES)


ENDS = T.StructType([T.StructField("node", _BYTES), T.StructField("first", _LONG), T.StructField("piece", T.StringType())])
HASHES = T.StructType([T.StructField("node", _BYTES), T.StructField("ends_sha256", T.StringType())])


def _ends(ending: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``ending(node, conv_id)``, a node's conversations being any number."""
    pieces, hashes = arrow_schema(ENDS), arrow_schema(HASHES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        out = []
        for batch in batches:
            for n, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if ids and (n != node or len(ids) == PIECE_IDS):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = n
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), pieces, strict=True)], schema=pieces)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((node, ids[0], ",".join(map(str, ids))), pieces, strict=True)], schema=pieces)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], schema=hashes)
        for batch in batches:
            for n, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if h is None or n != node:
                    if h is not None:
                        yield row()
                    node, h = n, hashlib.sha256(piece.encode())
                else:
                    h.update(b"," + piece.encode())
        if h is not None:
            yield row()

    n = max(1, int(ending.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = ending.select("node", "conv_id").repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = written(ordered.mapInArrow(join, ENDS), "trie-ends")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, HASHES)


def prefix_trie(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every node of the trie over ``rows`` (as ``rebuilt`` gives them): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    flat = written(prefixes(rows), "trie-prefixes")
    below = F.sum(F.col("length") - F.col("depth") + 1)
    first = lambda c: F.first(c).alias(c)
    upper = flat.groupBy("node").agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), first("depth"), first("parent"), first("chars"), below.alias("_below")
    )
    upper = written(upper.where(F.col("_below") > shard_rows).drop("_below"), "trie-upper")
    marked = written(flat.join(upper.select("node", "owner"), "node", "left"), "trie-marked")
    low = F.col("owner").isNull()
    step = F.when(low, F.struct("depth", "node", "parent", "turn_key", "chars"))
    # Only what lies below the upper nodes is collected, shard_rows prefixes at most.
    paths = marked.groupBy("conv_id").agg(
        F.first("length").alias("length"), F.max_by("owner", F.when(~low, F.col("depth"))).alias("above"), F.array_sort(F.collect_list(step)).alias("path")
    )
    low = written(_shards(paths.where(F.size("path") > 0).withColumn("top", F.col("path")[0]["node"])), "trie-shards")

    # What upper nodes and tops add, booked on the path of their smallest member.
    tops = low.where("top AND parent IS NOT NULL")
    n_children = upper.where("parent IS NOT NULL").select("parent").unionByName(tops.select("parent")).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    kids = upper.join(n_children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own_leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    adds = kids.select(F.col("owner").alias("conv_id"), "depth", own_leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    # A top's part belongs to its parent's depth on that path.
    adds = adds.unionByName(tops.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaf"), F.col("saved_tokens").alias("saved")))
    adds = adds.groupBy("conv_id", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    path = marked.where("owner IS NOT NULL").select("conv_id", "depth", "node")
    path = path.join(adds.select("conv_id").distinct(), "conv_id", "left_semi").join(adds, ["conv_id", "depth"], "left")
    rest = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = path.select("node", F.sum("leaf").over(rest).alias("leaf"), F.sum("saved").over(rest).alias("saved"))
    sums = parts.groupBy("node").agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))

    ends = _ends(marked.where("owner IS NOT NULL AND depth = length").select("node", "conv_id"))
    above = upper.select(F.col("node").alias("parent"), F.col("owner").alias("_above"))
    no_end = F.lit(hashlib.sha256(b"").hexdigest())
    high = (
        kids.withColumnRenamed("owner", "conv_id").join(sums, "node").join(ends, "node", "left").join(above, "parent", "left")
        .select("conv_id", "depth", F.col("_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", no_end).alias("ends_sha256"))
    )
    return high.unionByName(low.select(*high.columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(rebuilt(read_table(spark, sf_dir, "conversations")))


#: CRC-32 of the decimal digits, bit by bit: 0xEDB88320 = 3988292384.
_BIT = "CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
OP13_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM own),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: {_BIT.format(x="x")})), 4294967295) AS crc
  FROM ids),
h AS (SELECT conv_id, crc % 6 AS h FROM crc),
built AS (
  SELECT h.conv_id, o.pos, o.role, o.text FROM h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 100 AND o.pos < h.h
  UNION ALL
  SELECT h.conv_id, o.pos, o.role, o.text FROM h JOIN own o ON o.conv_id = h.conv_id AND o.pos >= h.h),
seq AS (
  SELECT conv_id, list(length(CAST(role AS VARCHAR)) || ':' || role || text ORDER BY pos) AS s, list(length(text) ORDER BY pos) AS l FROM built GROUP BY conv_id
  UNION ALL
  SELECT conv_id, []::VARCHAR[], []::BIGINT[] FROM ids WHERE conv_id NOT IN (SELECT conv_id FROM built)),
pre AS (
  SELECT conv_id, d, s[1:d] AS node, CASE WHEN d > 0 THEN s[1:d - 1] END AS parent, CASE WHEN d > 0 THEN l[d] ELSE 0 END AS chars, d = len(s) AS is_end
  FROM (SELECT conv_id, s, l, unnest(range(len(s) + 1)) AS d FROM seq)),
nodes AS (
  SELECT node, any_value(d) AS depth, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM pre GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (
  SELECT u.node, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM (SELECT node, depth, unnest(range(depth + 1)) AS d FROM nodes) x
  JOIN nodes n ON n.node = x.node JOIN nodes u ON u.node = x.node[1:x.d] LEFT JOIN kids k ON k.node = x.node
  GROUP BY u.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.leaves AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN under u ON u.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.parent
"""
