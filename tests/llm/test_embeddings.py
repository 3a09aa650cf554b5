import numpy as np

from quire.llm.common import Scratch
from quire.llm.embeddings import embedding_groups

SCHEMA = "vec_id long, embedding array<float>, label int, n int, cell int"


def brute(rows, threshold=0.98):
    ok = [r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                    root[b] = a
    return sorted((r[0] if r[0] is not None else -1, links[i], rows[find(i)][0] if r[0] is not None else -1) for i, r in enumerate(rows))


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        centre = rng.normal(size=(20, 8))
        for c in centre:
            rows += [(len(rows) + k, (c + rng.normal(size=8) * 0.12).tolist(), label) for k in range(6)]
    rows += [(1000 + k, rows[3][1], 0) for k in range(30)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 8, 0), (2003, [float("nan")] * 8, 0), (2004, [None] + [1.0] * 7, 0), (None, rows[3][1], 0), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, rows[3][1], 0), (2007, rows[3][1], 0), (2008, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    want = brute(rows)
    for cell, block in ((1024, 2048), (10, 4)):
        got = embedding_groups(df, Scratch(spark, "t"), cell_rows=cell, block_rows=block).collect()
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert sum(x[1] for x in want) > 1000


def test_empty(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
