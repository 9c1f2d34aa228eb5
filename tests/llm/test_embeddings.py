import numpy as np
import pytest

from tidemark.llm import embedding_dedup


def brute(rows, limit):
    n, parent = {}, {}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, _, _ in rows:
        n[i], parent[i] = 0, i
    for a, (i, v, l) in enumerate(rows):
        for j, w, m in rows[a + 1 :]:
            if l == m and float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) >= limit:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return n, {i: find(i) for i in parent}


@pytest.mark.parametrize("options", [{}, {"cell_rows": 8, "cell_target": 5}, {"blocks": 16}, {"blocks": 1}])
def test_against_brute_force(spark, options):
    rng = np.random.default_rng(4)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 1.0])
        rows.append((i, v.astype(np.float32).astype(float), int(rng.integers(0, 2))))
    df = spark.createDataFrame([(i, [float(x) for x in v], l) for i, v, l in rows], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.embedding_links(df, **options).collect()
    n, c = brute(rows, 0.98)
    assert sum(n.values()) > 0
    assert {r["vec_id"]: r["n_links"] for r in got} == n and {r["vec_id"]: r["component_id"] for r in got} == c
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0, "x"), (2, [2.0, 0.0], 0, "x"), (3, [1.0, 0.0], 1, "x"), (4, None, 0, "x"), (5, [0.0, 0.0], 0, "x"), (6, [nan, 1.0], 0, "x"), (7, [1.0, None], 0, "x"), (8, [1.0, 0.0], None, "x"), (9, [1.0, 0.0, 0.0], 0, "x"), (10, [], 0, "x"), (None, [1.0, 0.0], 0, "x"), (11, [float("inf"), 1.0], 0, "x"), (1, [1.0, 0.0], 0, "x")]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string"))
    by = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got.collect())
    assert by == [(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *[(i, 0, i, True) for i in range(3, 12)]]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_links(none).count() == 0


def test_double_vectors_and_text_labels(spark):
    """Pairs within 2e-9 of the threshold need the column's own precision."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        a, b = rng.normal(size=(2, 8))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        cos = 0.98 + float(rng.uniform(-2e-9, 2e-9))
        rows += [(2 * i, a, f"label {i}"), (2 * i + 1, cos * a + np.sqrt(1 - cos * cos) * b, f"label {i}")]
    df = spark.createDataFrame([(i, [float(x) for x in v], l) for i, v, l in rows], "vec_id long, embedding array<double>, label string")
    got = embedding_dedup.embedding_links(df).collect()
    n, c = brute(rows, 0.98)
    assert 20 < sum(n.values()) < 280
    assert {r["vec_id"]: r["n_links"] for r in got} == n and {r["vec_id"]: r["component_id"] for r in got} == c


def test_hot_cells_are_parted_before_they_are_chunked(spark):
    """Spread vectors in one cell: dealing by further coordinates copies far fewer rows than pairs of chunks do, and the
    more so the hotter the cell is."""
    rng = np.random.default_rng(9)
    rows = {}
    for n in (3000, 9000):
        v = rng.normal(size=(n, 16)).astype(np.float32)
        df = spark.createDataFrame([(i, 1, 1, [float(y) for y in x]) for i, x in enumerate(v)], "rep long, n long, label long, vec array<float>")
        for levels in (1, 4):
            rows[n, levels] = embedding_dedup.dealt_out(df, 0.04, 4, 1, 100, levels=levels).count()
    assert rows[9000, 4] < 0.7 * rows[9000, 1] and rows[9000, 4] / rows[9000, 1] < rows[3000, 4] / rows[3000, 1]
    print(rows)
