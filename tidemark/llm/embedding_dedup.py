"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a fixed rotation the coordinates are split into blocks;
each block gets a share of the squared-distance budget in proportion to its width, so a linked pair stays within the
budget in at least one block. Every block is range-joined on its own: its leading coordinates are cut into cells of
twice the block's radius, a vector lives in its cell and visits the later cells that its radius reaches. Candidates
of a cell are verified at once by the exact cosine in double precision, and counted only in the first block that
finds them. Cells return link counts and spanning stars, never pairs. A dealt row holds its vector once, in the type of
its column; the rotation is computed again where it is needed, row by row, so that all tasks see the same numbers.

A cell of over ``cell_rows`` rows is dealt once more by further coordinates of its block, in the same way, as long as
that makes it smaller. What no coordinate of the block parts is a crowd within about one radius, where nearly all
pairs are links that have to be counted: it is split in chunks, and pairs of chunks go to different tasks.

Equal vectors of a label are one class that is searched once. More rows mean more leading coordinates, by formula.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label
or id, link with nothing: n_links 0, component_id their own id. Vectors of different lengths don't link. Repeated rows
are vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, stored
from .simhash import _join_up

#: Absolute slack of squared distances: rotated coordinates are rounded to float32.
SLACK = 1e-5


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors after the rotation; a row's numbers don't depend on the rows beside it."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.einsum("ij,jk->ik", unit, rotation(vectors.shape[1])).astype(np.float32).astype(np.float64)


def block_cuts(dims: int, blocks: int) -> list[int]:
    blocks = min(blocks, dims)
    return [dims * i // blocks for i in range(blocks + 1)]


def _mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Fold integer columns into one 64-bit name of a cell; equal names only add rows to a cell."""
    h = (h ^ v.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _visits(x: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows, their cells, and whether those are their homes. Of two rows within the radius, one lives where the other
    lives or visits, and that is one cell only."""
    home = np.floor(x / (2 * radius)).astype(np.int64)
    first, last = np.floor((x - radius) / (2 * radius)).astype(np.int64), np.floor((x + radius) / (2 * radius)).astype(np.int64)
    for steps in np.ndindex(*([3] * x.shape[1])):
        step = next((s - 1 for s in steps if s != 1), 0)
        if step < 0:  # only later cells are visited
            continue
        cell = home + np.array(steps) - 1
        rows = np.flatnonzero(((cell >= first) & (cell <= last)).all(axis=1))
        if len(rows):
            yield rows, cell[rows], step == 0


def deal(rows: DataFrame, vec_type: str, budget: float, blocks: int, begin: int, count: int) -> DataFrame:
    """A row for each cell that a row lives in or visits, by ``count`` coordinates of its block from ``begin`` on.

    rows: parent (name of the cell, or of the label), block (null: every block), homes (a bit for each time a row was
    dealt to its home), label, rep, n, vec.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, part in b.groupby(b["vec"].str.len()):
                x = turned(np.stack(part["vec"].to_numpy()).astype(np.float64))
                cuts = block_cuts(int(dims), blocks)
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = np.flatnonzero(part["block"].isna() | (part["block"] == k))
                    coordinates = x[own, min(hi, lo + begin) : min(hi, lo + begin + count)]
                    name = _mix(part["parent"].to_numpy(dtype=np.int64)[own].view(np.uint64), np.full(len(own), dims * 64 + k))
                    for at, cell, home in _visits(coordinates, math.sqrt(budget * (hi - lo) / dims + SLACK)) if len(own) else ():
                        cell_name = name[at]
                        for j in range(cell.shape[1]):
                            cell_name = _mix(cell_name, cell[:, j])
                        t = part.iloc[own[at]]
                        yield t.assign(cell=cell_name.view(np.int64), block=k, homes=t["homes"] * 2 + int(home))

    columns = f"parent long, cell long, block int, homes int, label long, rep long, n long, vec {vec_type}"
    names = [c.split()[0] for c in columns.split(", ")]
    return rows.select("parent", "block", "homes", "label", "rep", "n", "vec").mapInPandas(lambda batches: (t[names] for t in run(batches)), columns)


def search_cell(t: pd.DataFrame, threshold: float, budget: float, blocks: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts of a cell's rows, and for each row a row of its local component."""
    n = len(t)
    raw = np.stack(t["vec"].to_numpy()).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    spun = turned(raw)
    block, homes, weight, rep, label = int(t["block"].iloc[0]), t["homes"].to_numpy(), t["n"].to_numpy(), t["rep"].to_numpy(), t["label"].to_numpy()
    chunk, pair_a, pair_b, all_homes = t["chunk"].to_numpy(), int(t["pair_a"].iloc[0]), int(t["pair_b"].iloc[0]), (1 << int(t["level"].iloc[0])) - 1
    dims = raw.shape[1]
    cuts = np.array(block_cuts(dims, blocks))
    allowed = budget * np.diff(cuts) / dims + SLACK
    x = spun[:, cuts[block] : cuts[block + 1]]
    sq = (x * x).sum(axis=1)
    counts, parent = np.zeros(n, dtype=np.int64), np.arange(n)
    for s in range(0, n, tile):
        e = min(n, s + tile)
        near = sq[s:e, None] + sq[None, s:] - 2 * (x[s:e] @ x[s:].T) <= allowed[block] * 1.001 + SLACK
        i, j = np.nonzero(near)
        i, j = i + s, j + s
        ok = (i < j) & ((homes[i] | homes[j]) == all_homes) & (rep[i] != rep[j]) & (label[i] == label[j])
        if pair_a != pair_b:
            ok &= chunk[i] != chunk[j]
        i, j = i[ok], j[ok]
        for c in range(0, len(i), 1 << 15):
            a, b = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
            gap = (spun[a] - spun[b]) ** 2
            inside = np.add.reduceat(gap, cuts[:-1], axis=1) <= allowed
            mine = inside[:, block] & ~inside[:, :block].any(axis=1)
            a, b = a[mine], b[mine]
            cos = np.einsum("ij,ij->i", raw[a], raw[b]) / (norms[a] * norms[b])
            a, b = a[cos >= threshold], b[cos >= threshold]
            np.add.at(counts, a, weight[b])
            np.add.at(counts, b, weight[a])
            parent = _join_up(parent, a, b)
    return counts, parent


def dealt_out(classes: DataFrame, budget: float, blocks: int, leading: int, cell_rows: int, again: int = 2, levels: int = 4) -> DataFrame:
    """Rows of cells: the columns of ``deal``, level, and chunk, pair_a, pair_b for cells that stay too large."""
    vec_type = classes.schema["vec"].dataType.simpleString()
    first = classes.withColumns({"parent": F.col("label"), "block": F.lit(None).cast("int"), "homes": F.lit(0)})
    open_ = stored(deal(first, vec_type, budget, blocks, 0, leading), "dealt")
    done, one, level = [], F.lit(0), 1
    while True:
        sizes = open_.groupBy("cell", "block").agg(F.count("*").alias("rows"))
        hot = stored(sizes.where(F.col("rows") > cell_rows), "hot_cells")
        marked = open_.withColumn("level", F.lit(level))
        if hot.isEmpty():
            done.append(marked.withColumns({"chunk": one, "pair_a": one, "pair_b": one}))
            break
        done.append(marked.join(hot, ["cell", "block"], "left_anti").withColumns({"chunk": one, "pair_a": one, "pair_b": one}))
        crowd = open_.join(hot, ["cell", "block"])
        smaller = stored(deal(crowd.withColumn("parent", F.col("cell")), vec_type, budget, blocks, leading + again * (level - 1), again), "dealt")
        parts = smaller.groupBy("parent", "cell", "block").agg(F.count("*").alias("part")).groupBy("parent", "block").agg(F.max("part").alias("most"))
        helped = hot.join(parts, (hot["cell"] == F.col("parent")) & (hot["block"] == parts["block"])).where(F.col("most") <= 0.6 * F.col("rows")).select("parent", hot["block"])
        helped = stored(helped if level < levels else helped.limit(0), "helped")
        left = crowd.withColumn("level", F.lit(level)).join(helped.withColumnRenamed("parent", "cell"), ["cell", "block"], "left_anti").withColumn("chunks", F.ceil(F.col("rows") / cell_rows).cast("int"))
        left = left.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        done.append(left.withColumns({"pair_a": F.least("chunk", "other"), "pair_b": F.greatest("chunk", "other")}).drop("rows", "chunks", "other"))
        open_, level = stored(smaller.join(helped, ["parent", "block"], "left_semi"), "dealt"), level + 1
    return reduce(DataFrame.unionByName, done)


def links_of_classes(classes: DataFrame, threshold: float, blocks: int = 4, cell_target: int = 4096, cell_rows: int = 8192) -> DataFrame:
    """(a, b, n): b null and n a count of links of a, or a star edge a - b."""
    spark = classes.sparkSession
    total, labels = classes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    leading = max(1, min(6, math.ceil(math.log(max(1.0, total / max(1, labels) / cell_target)) / math.log(1 / 0.45))))
    budget = 2 - 2 * threshold
    dealt = dealt_out(classes, budget, blocks, leading, cell_rows)
    keys = ["cell", "block", "pair_a", "pair_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def search(t: pd.DataFrame) -> pd.DataFrame:
            counts, parent = search_cell(t, threshold, budget, blocks)
            rep, some, hung = t["rep"].to_numpy(), counts > 0, parent != np.arange(len(parent))
            return pd.DataFrame({"a": np.r_[rep[some], rep[hung]], "b": pd.array([None] * int(some.sum()) + rep[parent[hung]].tolist(), dtype="Int64"), "n": np.r_[counts[some], np.zeros(int(hung.sum()), dtype=np.int64)]})

        def complete(t: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
            k = t[keys].to_numpy()
            starts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(t)]
            for s, e in zip(starts[:-1], starts[1:] if last else starts[1:-1], strict=False):
                if e - s > 1:
                    yield search(t.iloc[s:e])
            held[:] = [] if last else [t.iloc[starts[-2] :]]

        for b in batches:
            held.append(b)
            yield from complete(pd.concat(held), False)
        if held:
            yield from complete(pd.concat(held), True)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long, n long")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, **options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    element = vectors.schema[vec_col].dataType.elementType
    vec_type = "array<float>" if isinstance(element, FloatType) else "array<double>"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(vec_type).alias("vec"), F.col(label_col).alias("label"))
    finite = F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    base = stored(base.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))), "vectors")
    able = base.where("ok").select("vec_id", "label", "vec", F.xxhash64("label", "vec").alias("h"))
    classes = stored(able.groupBy("h", "label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    found = stored(links_of_classes(classes.select(F.xxhash64("label").alias("label"), "rep", "n", "vec"), threshold, **options), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    linked = components(found.where("b is not null").select("a", "b"))
    of_class = classes.join(counts, F.col("rep") == F.col("a"), "left").drop("a").join(linked, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("h", "label", "vec", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = able.join(of_class, ["h", "label", "vec"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(base.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
