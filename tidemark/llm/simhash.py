"""SimHash near-dedup over a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours share long runs of bits. Runs of ``FANOUT`` codes
form a node that holds the bits all of them share (mask and pattern); runs of nodes form the next level. A pair of
nodes whose common shared bits differ in more than the threshold is dropped with everything below it; a pair whose
bits are shared but for so few that nothing below can exceed the threshold is linked as a whole.

Spark deals the index out. Two fingerprints that differ in at most t bits agree on one of t + 1 blocks of bits, so
every fingerprint goes to t + 1 subtrees, whose root fixes the bits of one block. A subtree of over ``subtree_rows``
codes is dealt out again by blocks of the bits that differ in it, until none is larger. Subtrees return a spanning star of each local component,
never pairs; ``components`` joins the stars.

Defined results: null and blank texts have fingerprint zero and link with each other. Fewer than ``words`` words
make one shingle. Rows with a null id are reported alone. Repeated rows keep one result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few, stored, without

FANOUT = 8
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit value of the fingerprint."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lower() and split() know ASCII only
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
        starts = np.r_[0, ends[: -words] + 1]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.fromiter((fingerprint(t, words) for t in b["text"]), dtype=np.int64, count=len(b))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated, and first[i] .. first[i] + count[i] - 1 beside them."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


class GrayIndex:
    """Codes grouped by subtree and Gray-sorted within it; levels[0] are the codes, levels[-1] the roots."""

    def __init__(self, subtree: np.ndarray, codes: np.ndarray):
        """Rows must come sorted by subtree and Gray rank."""
        n = len(codes)
        first = np.arange(n)
        self.levels = [{"first": first, "count": np.ones(n, dtype=np.int64), "and": codes, "or": codes, "begin": first, "end": first + 1}]
        owner = subtree
        while True:
            below = self.levels[-1]
            changes = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if len(changes) == len(owner) and len(self.levels) > 1:
                break
            sizes = np.diff(np.r_[changes, len(owner)])
            within = np.arange(len(owner)) - np.repeat(changes, sizes)
            at = np.flatnonzero(within % FANOUT == 0)
            self.levels.append({"first": at, "count": np.diff(np.r_[at, len(owner)]), "and": np.bitwise_and.reduceat(below["and"], at), "or": np.bitwise_or.reduceat(below["or"], at), "begin": below["begin"][at], "end": below["end"][np.r_[at[1:], len(owner)] - 1]})
            owner = owner[at]

    def links(self, threshold: int, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of linked codes (positions); whole groups that must be linked come as stars."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["and"]))
        waiting = [(top, roots, roots)]
        while waiting:
            level, a, b = waiting.pop()
            if len(a) > chunk:
                waiting += [(level, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
                continue
            x = self.levels[level]
            all_and, all_or = x["and"][a] & x["and"][b], x["or"][a] | x["or"][b]
            fixed_a, fixed_b = ~(x["and"][a] ^ x["or"][a]), ~(x["and"][b] ^ x["or"][b])
            apart = np.bitwise_count((x["and"][a] ^ x["and"][b]) & fixed_a & fixed_b)
            near = apart <= threshold
            if level == 0:
                near &= a < b
                yield a[near], b[near]
                continue
            whole = near & (np.bitwise_count(all_and ^ all_or) <= threshold)
            if whole.any():
                for side in (a, b):
                    row, at = _spread(x["begin"][side[whole]], (x["end"] - x["begin"])[side[whole]])
                    yield x["begin"][a[whole]][row], at
            go = near & ~whole
            a, b = a[go], b[go]
            row, left = _spread(x["first"][a], x["count"][a])
            row2, right = _spread(x["first"][b[row]], x["count"][b[row]])
            left = left[row2]
            keep = left <= right  # a node meets itself and what stands behind it
            waiting.append((level - 1, left[keep], right[keep]))


def _join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable, given former components and new links."""
    while True:
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            return parent
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def local_stars(subtree: np.ndarray, codes: np.ndarray, reps: np.ndarray, threshold: int) -> pd.DataFrame:
    order = np.lexsort((gray_rank(codes), subtree))
    codes, reps = codes[order], reps[order]
    parent = np.arange(len(codes))
    for a, b in GrayIndex(subtree[order], codes).links(threshold):
        parent = _join_up(parent, a, b)
    hung = parent != np.arange(len(codes))
    return pd.DataFrame({"a": reps[hung], "b": reps[parent[hung]]})


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``parts`` blocks of nearly equal width."""
    cut = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


SPLIT = "parent long, block int, v long, fp long, rep long"


def block_masks(free: np.ndarray, parts: int) -> np.ndarray:
    """For each mask of free bits, masks of ``parts`` blocks that share its bits evenly."""
    masks, back = np.unique(free, return_inverse=True)
    out = np.zeros((len(masks), parts), dtype=np.uint64)
    for i, m in enumerate(masks.tolist()):
        places = [k for k in range(64) if m >> k & 1]
        for b, (first, width) in enumerate(_blocks(len(places), parts)):
            out[i, b] = sum(1 << k for k in places[first : first + width])
    return out[back]


def routed(distinct: DataFrame, threshold: int, subtree_rows: int) -> DataFrame:
    """distinct: fp, rep. Rows (subtree, fp, rep): every pair within the threshold meets in a subtree, and no subtree has
    more than ``subtree_rows`` rows (2 ** threshold at least).

    A subtree fixes one of ``threshold + 1`` blocks of the 64 bits. One that is too large is split again by blocks of
    those bits that still differ among its codes, which leaves at most three quarters of them to differ. As codes are
    distinct, fewer than log2(subtree_rows) such bits cannot make a subtree too large, so a few rounds are enough.
    """
    parts = threshold + 1
    most = max(subtree_rows, 1 << threshold)
    once = F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L").alias("v")) for i, (first, width) in enumerate(_blocks(64, parts))])
    rows = distinct.select("fp", "rep", F.explode(once).alias("k")).select(F.xxhash64("k.block", "k.v").alias("subtree"), "fp", "rep")
    settled = None

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            masks = block_masks((b["all"].to_numpy() ^ b["any"].to_numpy()).view(np.uint64), parts)
            for k in range(parts):
                yield pd.DataFrame({"parent": b["subtree"], "block": np.int32(k), "v": fp & masks[:, k].view(np.int64), "fp": fp, "rep": b["rep"]})

    while True:
        sizes = rows.groupBy("subtree").agg(F.count("*").alias("n"), F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any"))
        hot = stored(sizes.where(F.col("n") > most).drop("n"), "hot")
        if hot.isEmpty():
            return rows if settled is None else settled.unionByName(rows)
        large = few(hot)
        cold = rows.join(large.select("subtree"), "subtree", "left_anti")
        settled = cold if settled is None else settled.unionByName(cold)
        parted_rows = rows.join(large, "subtree").mapInPandas(split, SPLIT)
        rows = stored(parted_rows.select(F.xxhash64("parent", "block", "v").alias("subtree"), "fp", "rep"), "subtrees")


def near_links(distinct: DataFrame, threshold: int = 3, subtree_rows: int = 16_384, buffer_rows: int = 200_000) -> DataFrame:
    """Spanning stars (a, b) over the reps of fingerprints within ``threshold`` bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def search(t: pd.DataFrame) -> pd.DataFrame:
            return local_stars(t["subtree"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["rep"].to_numpy(), threshold)

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            rows += len(b)
            # Put together only once a subtree is complete: the batches of a large one are joined a single time.
            if rows >= buffer_rows and held[0]["subtree"].iat[0] != b["subtree"].iat[-1]:
                t = pd.concat(held)
                last = t["subtree"].to_numpy()
                cut = int(np.flatnonzero(last != last[-1])[-1]) + 1
                yield search(t.iloc[:cut])
                held = [t.iloc[cut:]]
                rows = len(t) - cut
        if rows:
            yield search(pd.concat(held))

    # xxhash64 names a subtree; two subtrees under one name only add true links.
    keyed = routed(distinct, threshold, subtree_rows)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "subtree").sortWithinPartitions("subtree").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 3, **options) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    linked = components(near_links(distinct, threshold, **options))
    named = distinct.join(linked, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.where("doc_id is not null").join(named, "fp").select("doc_id", "fp", "component_id")
    out = out.unionByName(prints.where("doc_id is null").select("doc_id", "fp", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their own columns."""
    dropped = near_duplicates(docs, id_col, text_col, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, F.col(id_col).cast("long"), dropped, "doc_id")
