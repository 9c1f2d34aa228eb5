import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, registry, simhash


def test_exact_against_sql(spark, data):
    got = registry.op1_exact_dedup(spark, data)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = c.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({registry.oracle_sql()['op1_exact_dedup']})").fetchall()
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == sorted(want)


def expected_exact(rows):
    norm = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in rows]
    out = []
    for i, t in norm:
        same = [j for j, u in norm if u == t and j is not None]
        sha = hashlib.sha256(t.encode()).hexdigest()
        out.append((i, min(same), len(same), i == min(same), sha) if i is not None else (None, None, 1, True, sha))
    return sorted(map(str, out))


def test_exact_odd_rows_small_memtables_and_collisions(odd):
    want = expected_exact(odd.collect())
    for options in ({}, {"memtable_rows": 2}, {"key": lambda sha: F.conv(F.substring(sha, 1, 1), 16, 10).cast("long") % 2, "filter_bits": 0}, {"key": lambda sha: F.lit(0).cast("long")}):
        assert sorted(str(tuple(r)) for r in exact_dedup.exact_duplicates(odd, **options).collect()) == want


def test_exact_keeps_columns_and_empty_table(odd, nothing):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "5", "6", "7", "8", "9", "None", "None"])
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.keep_first(nothing).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(pairs, limit):
    ids = [i for i, _ in pairs]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = np.array([x for _, x in pairs], dtype=np.uint64)
    for a in range(len(f)):
        for b in np.flatnonzero(np.bitwise_count(f ^ f[a]) <= limit):
            x, y = find(ids[a]), find(ids[b])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_spark_hash_is_the_shingle_hash(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


def test_simhash_against_brute_force(spark, documents, data):
    rows = documents.collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    want = brute_components(list(prints.items()), 3)
    for options in ({}, {"subtree_rows": 2, "buffer_rows": 20}):
        got = simhash.near_duplicates(documents, **options).collect()
        assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_gray_index_on_dense_clusters():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    codes = np.unique(np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6), replace=False))) for c in centres for _ in range(150)], dtype=np.uint64))
    reps = np.arange(len(codes))
    for limit in (0, 1, 3, 8):
        stars = simhash.local_stars(np.zeros(len(codes), dtype=np.int64), codes, reps, limit)
        parent = simhash._join_up(np.arange(len(codes)), stars["a"].to_numpy(), stars["b"].to_numpy())
        assert dict(enumerate(parent.tolist())) == brute_components(list(zip(reps.tolist(), codes.tolist(), strict=True)), limit)
        assert len(stars) < len(codes)


def test_gray_rank_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    by_rank = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


def test_simhash_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd)
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.where("doc_id is not null").collect()}
    assert got.count() == odd.count() and by[3] == ("0" * 16, 3) and by[4] == by[5] == ("0" * 16, 3)
    assert by[2][1] == 1 and int(by[9][0], 16) == brute_fingerprint([r["text"] for r in odd.where("doc_id = 9").collect()][0])
    assert got.where("doc_id is null and component_id is null").count() == 2
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (2, 4, 5)").isEmpty()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 1)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 150)}


def test_filters_follow_their_keys(spark):
    """Texts that meet the index are the repeated ones and few more; without a filter it is all of them."""
    assert common.bits_for(0, 1 << 20) == 1 << 16 and common.bits_for(100_000, 1 << 20) == 0
    rows, keys = spark.range(200_000), spark.range(40_000).withColumnRenamed("id", "key")
    some, rest = common.parted(rows, F.col("id"), keys, "key")
    assert some.where("id < 40000").count() == 40_000 and some.count() < 48_000 and some.count() + rest.count() == 200_000
    some, rest = common.parted(rows, F.col("id"), keys, "key", most_bits=1 << 16)
    assert some.count() == 200_000 and rest.count() == 0


def test_runs_carry_filters(spark):
    docs = spark.range(5000, numPartitions=4).selectExpr("id", "id * 7919 digest", "cast(id as string) sha")
    filters = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "5000"}
    runs = common.stored(exact_dedup.flush_runs(docs, 700), "runs", **filters)
    assert [r["ids"] for r in exact_dedup.lookup(runs, [7919 * 4321]).collect()] == [[4321]]
    assert exact_dedup.lookup(runs, [1]).count() == 0
    plain = common.stored(exact_dedup.flush_runs(docs, 700), "runs")
    assert sum(map(size_of, runs.inputFiles())) > sum(map(size_of, plain.inputFiles()))


def size_of(file):
    import os
    from urllib.parse import urlparse

    return os.path.getsize(urlparse(file).path)


def codes_frame(spark, codes):
    return spark.createDataFrame([(int(np.array(c, dtype=np.uint64).view(np.int64)), i) for i, c in enumerate(codes)], "fp long, rep long")


@pytest.mark.parametrize("shared,rows", [(32, 64), (52, 16), (0, 8), (58, 2)])
def test_hot_subtrees_are_split_until_they_fit_and_lose_no_pair(spark, shared, rows):
    """Codes that share their upper bits, where other bits are nearly always the same too."""
    rng = np.random.default_rng(shared)
    low = rng.integers(0, 1 << (64 - shared) if shared else 2**63, 900, dtype=np.uint64)
    rare = rng.random(900) < 0.9
    low[rare] &= np.uint64(0xFFFF_FFFF_FFFF_F0F3)
    codes = np.unique(low | np.uint64(0xABCDEF0123456789 >> (64 - shared) << (64 - shared) if shared else 0))
    dealt = simhash.routed(codes_frame(spark, codes), 3, rows)
    got = dealt.toPandas()
    assert got.groupby("subtree").size().max() <= max(rows, 8)
    met = set()
    for _, own in got.groupby("subtree"):
        reps = own["rep"].to_numpy()
        f = own["fp"].to_numpy().view(np.uint64)
        a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
        met |= {(int(reps[i]), int(reps[j])) for i, j in zip(a, b, strict=True) if reps[i] < reps[j]}
    near = {(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 3) if j > i}
    assert near <= met and len(near) > 0 or shared == 0
    want = brute_components(list(enumerate(codes.tolist())), 3)
    linked = {r["node"]: r["component"] for r in common.components(simhash.near_links(codes_frame(spark, codes), 3, subtree_rows=rows, buffer_rows=50)).collect()}
    assert {i: linked.get(i, i) for i in want} == want


def test_a_hundred_thousand_codes_with_32_bits_in_common(spark):
    codes = spark.range(100_000).select((F.lit(0x1234567 << 32) + (F.xxhash64("id").bitwiseAND(0xFFFFFFFF))).alias("fp")).distinct().withColumn("rep", F.col("fp"))
    sizes = simhash.routed(codes, 3, 16_384).groupBy("subtree").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 16_384 and sizes[1] <= 12 * 100_000


def test_blocks_share_the_free_bits():
    free = np.array([0, 0b1011, 2**64 - 1], dtype=np.uint64)
    masks = simhash.block_masks(free, 4)
    assert masks[0].tolist() == [0] * 4 and masks[2].tolist() == [0xFFFF << 16 * k for k in range(4)]
    assert np.bitwise_or.reduce(masks, axis=1).tolist() == free.tolist() and np.bitwise_count(masks).sum(axis=1).tolist() == [0, 3, 64]
