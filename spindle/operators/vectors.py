"""Exact cosine threshold join by reference points and block bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .util import written
from .windows import ordinal_index

#: Reference points, and the rows (of smallest hash) that they are chosen from.
PIVOTS = 32
PIVOT_SAMPLE = 2_000
#: Vectors of a block.
BLOCK_ROWS = 1_024
#: Copies of a cell's block bounds, so that the blocks that meet a large cell are spread over as many tasks.
SALTS = 16
#: Blocks that a task holds while the blocks that they meet pass by (about; dealt by hash).
GROUP_BLOCKS = 16
#: Rows of a product of two blocks that are made at once.
SLICE = 256
#: Angles come from rounded cosines: bounds are this much wider.
SLACK = 1e-6


def unit_vectors(vecs: DataFrame) -> DataFrame:
    """``(id, m, u)``: every different direction once, its smallest id and its number of rows.

    Rows without id or vector and vectors that are empty, zero, or hold null or non-finite components are left out.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    ok = vecs.select("id", "v").where(usable).withColumn("_n", norm).where((F.col("_n") > 0) & (F.col("_n") < F.lit(math.inf)))
    unit = ok.select("id", F.transform("v", lambda x: x / F.col("_n")).alias("u"))
    return unit.groupBy("u").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")).select("id", "m", "u")


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    """The lists of an Arrow column as the rows of a matrix; shorter ones end in zeros."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    lens = np.diff(col.offsets.to_numpy())
    if (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(col), dim))
    out[np.repeat(np.arange(len(col)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def choose_pivots(units: DataFrame, dim: int, k: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Up to ``k`` reference points, each the sampled vector whose nearest chosen one is farthest (at most ``sample`` rows on the driver)."""
    rows = units.select("u").orderBy(F.xxhash64("u"), "id").limit(sample).toArrow().column("u").combine_chunks()
    x = _matrix(rows, dim)
    if not len(x):
        return x
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        nxt = int(near.argmin())
        if nxt in chosen:
            break
        chosen.append(nxt)
        near = np.maximum(near, x @ x[nxt])
    return x[chosen]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def blocks(units: DataFrame, pivots: np.ndarray, dim: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(block, cell, ids, ms, us, lo, hi)``: the vectors in blocks of at most ``block_rows``, written once.

    A vector's cell is its nearest reference point.  A cell's vectors are ordered by their second nearest point and the
    angle to the nearest, by a running count over range partitions, and cut into blocks, however many a cell takes.
    ``lo`` and ``hi`` are a block's smallest and largest angle to every reference point.
    """

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ang = _angles(_matrix(b.column("u"), dim), pivots)
            order = np.argsort(ang, axis=1, kind="stable")
            cell, second = order[:, 0], order[:, min(1, order.shape[1] - 1)]
            cols = [cell.astype("int32"), second.astype("int32"), ang[np.arange(len(ang)), cell]]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, cols)], names=[*b.schema.names, "cell", "second", "angle"])

    id_type = units.schema["id"].dataType.simpleString()
    placed = units.mapInArrow(place, f"id {id_type}, m bigint, u array<double>, cell int, second int, angle double")
    ranked = ordinal_index(placed, [F.col("second"), F.col("angle"), F.col("id")], ("cell",), "_k")
    packed = ranked.groupBy("cell", F.floor(F.col("_k") / F.lit(block_rows)).cast("bigint").alias("_b")).agg(
        F.collect_list(F.struct("id", "m", "u")).alias("rows")
    )
    parts = packed.select(
        F.concat_ws("-", "cell", "_b").alias("block"), "cell", F.col("rows.id").alias("ids"), F.col("rows.m").alias("ms"), F.col("rows.u").alias("us")
    )

    def bound(batches):
        for b in batches:
            lo, hi = [], []
            us = b.column("us")
            for i in range(b.num_rows):
                ang = _angles(_matrix(us[i].values, dim), pivots)
                lo.append(ang.min(axis=0))
                hi.append(ang.max(axis=0))
            extra = [pa.array(v, pa.list_(pa.float64())) for v in (lo, hi)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "lo", "hi"])

    schema = f"block string, cell int, ids array<{id_type}>, ms array<bigint>, us array<array<double>>, lo array<double>, hi array<double>"
    return written(parts.mapInArrow(bound, schema), "blocks")


def _gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Largest lower bound, over the reference points, of the angle between a member of one block and one of the other."""
    below, above = F.zip_with(lo_a, hi_b, lambda x, y: x - y), F.zip_with(lo_b, hi_a, lambda x, y: x - y)
    return F.array_max(F.zip_with(below, above, lambda x, y: F.greatest(x, y)))


def block_pairs(blocked: DataFrame, min_cosine: float) -> DataFrame:
    """``(block_a, block_b)``: pairs of blocks, each with itself included, whose bound lets a pair of members reach ``min_cosine``.

    Cells are compared first (at most PIVOTS rows on the driver); then blocks of the cells left meet by an equi-join.
    """
    limit = math.acos(max(-1.0, min(1.0, min_cosine))) + SLACK
    bounds = blocked.select("block", "cell", "lo", "hi")
    cells = (
        bounds.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "z"))
        .groupBy("cell", "p")
        .agg(F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi"))
        .collect()
    )
    lo, hi = {}, {}
    for r in sorted(cells, key=lambda r: (r["cell"], r["p"])):
        lo.setdefault(r["cell"], []).append(r["lo"])
        hi.setdefault(r["cell"], []).append(r["hi"])
    meet = [
        (a, b)
        for a in lo
        for b in lo
        if a <= b and max(max(x - y for x, y in zip(lo[a], hi[b], strict=True)), max(x - y for x, y in zip(lo[b], hi[a], strict=True))) <= limit
    ]
    meeting = blocked.sparkSession.createDataFrame(meet, "cell int, cell_b int")
    a = bounds.join(F.broadcast(meeting), "cell").select(
        F.col("block").alias("block_a"), F.col("cell").alias("cell_a"), "cell_b", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
        F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    b = bounds.select(
        F.col("block").alias("block_b"), F.col("cell").alias("cell_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    once = (F.col("cell_a") < F.col("cell_b")) | (F.col("block_a") <= F.col("block_b"))
    return a.join(b, ["cell_b", "salt"]).where(once & (_gap(*map(F.col, ("lo_a", "hi_a", "lo_b", "hi_b"))) <= limit)).select("block_a", "block_b")


def _met_blocks(blocked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(part, salt, block, partners, ids, ms, us)``, a part's rows together: first the blocks it holds (null ``partners``),
    then every block that meets some of them, once, with their names.

    A block thus travels once for about GROUP_BLOCKS partners, not once for each.  With few parts the passing blocks are
    dealt over several salts, each with the held ones.
    """
    tasks = int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_parts = max(1, math.ceil(blocked.count() / GROUP_BLOCKS))
    salts = math.ceil(tasks / n_parts)
    dealt = pairs.select(
        F.pmod(F.xxhash64("block_a"), F.lit(n_parts)).cast("int").alias("part"), F.pmod(F.xxhash64("block_b"), F.lit(salts)).cast("int").alias("salt"), "block_a", "block_b"
    )
    held = dealt.select("part", "salt", F.col("block_a").alias("block")).distinct().withColumn("partners", F.lit(None).cast("array<string>"))
    passing = dealt.groupBy("part", "salt", F.col("block_b").alias("block")).agg(F.collect_list("block_a").alias("partners"))
    rows = held.unionByName(passing).join(blocked.select("block", "ids", "ms", "us"), "block")
    dealt_out = rows.repartition(tasks, "part", "salt").sortWithinPartitions("part", "salt", F.col("partners").isNotNull())
    return dealt_out.select("part", "salt", "block", "partners", "ids", "ms", "us")


def cosine_pairs(
    vecs: DataFrame, min_cosine: float = 0.9, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, sample: int = PIVOT_SAMPLE
) -> DataFrame:
    """#32: all pairs of different directions with cosine ≥ ``min_cosine``.

    ``vecs(id, v array<double>)`` → (id_a, id_b, cosine, m_a, m_b): the smallest ids of two directions, in order,
    and how many rows have each.  Exact: angles are a metric, so two blocks whose angles to some reference point lie
    further apart than the threshold hold no pair and never meet; all other blocks are multiplied out in slices.

    Defined results: what ``unit_vectors`` leaves out takes part in no pair; of vectors of different lengths the
    shorter counts as ending in zeros; copies are one direction; a repeated id stands for each of its directions
    and may pair with itself; an empty table gives no rows.
    """
    spark = vecs.sparkSession
    ship_package(spark)
    units = written(unit_vectors(vecs.select("id", "v")), "units")
    id_type = units.schema["id"].dataType.simpleString()
    schema = f"id_a {id_type}, id_b {id_type}, cosine double, m_a bigint, m_b bigint"
    dim = units.agg(F.max(F.size("u"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], schema)
    blocked = blocks(units, choose_pivots(units, dim, pivots, sample), dim, block_rows)
    met = _met_blocks(blocked, written(block_pairs(blocked, min_cosine), "block-pairs"))

    def multiply(batches):
        key, held = None, {}
        for b in batches:
            col = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                if (now := (col["part"][i].as_py(), col["salt"][i].as_py())) != key:
                    key, held = now, {}
                name, y, ids_b, ms_b = col["block"][i].as_py(), _matrix(col["us"][i].values, dim), col["ids"][i].values, col["ms"][i].values
                partners = col["partners"][i].as_py()
                if partners is None:  # held ones come first
                    held[name] = y, ids_b, ms_b
                    continue
                for block_a in partners:
                    x, ids_a, ms_a = held[block_a]
                    for at in range(0, len(x), SLICE):
                        cos = x[at : at + SLICE] @ y.T
                        hit = cos >= min_cosine
                        if block_a == name:
                            hit &= np.arange(len(y)) > np.arange(at, at + len(cos))[:, None]
                        p, q = np.nonzero(hit)
                        if len(p):
                            p_at, q_at = pa.array(p + at), pa.array(q)
                            arrays = [ids_a.take(p_at), ids_b.take(q_at), pa.array(cos[p, q]), ms_a.take(p_at), ms_b.take(q_at)]
                            yield pa.RecordBatch.from_arrays(arrays, names=["id_a", "id_b", "cosine", "m_a", "m_b"])

    found = met.mapInArrow(multiply, schema)
    a, b = F.struct(F.col("id_a").alias("id"), F.col("m_a").alias("m")), F.struct(F.col("id_b").alias("id"), F.col("m_b").alias("m"))
    ends = found.select("cosine", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.least("cosine", F.lit(1.0)).alias("cosine"),
        F.col("a.m").alias("m_a"), F.col("b.m").alias("m_b"),
    )
