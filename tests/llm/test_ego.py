import numpy as np

from cladeframe.llm import ego

SCHEMA = "vec_id long, embedding array<float>, label int, block string, n long"


def brute(rows, least):
    good = {}
    out = {}
    for k, (i, v) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v] if v is not None else [], np.float32).astype(float)
        if i is not None and len(x) and np.isfinite(x).all() and x.any():
            good[k] = x
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n = [0] * len(rows)
    keys = list(good)
    for p, a in enumerate(keys):
        for b in keys[:p]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least - 1e-12:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                root[y] = x
    return sorted(((i, n[k], rows[find(k)][0], i == rows[find(k)][0]) for k, (i, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), [float(x) for x in (centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.18, 0.6])).astype(np.float32)]) for i in rng.permutation(400)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(40)] + [(1100, [2 * x for x in rows[0][1]])]
    rows += [(1200, None), (1201, []), (1202, [0.0] * 16), (1203, [None] + [1.0] * 15), (1204, [float("nan")] * 16), (1205, [float("inf")] + [0.0] * 15), (1206, rows[0][1][:8]), (None, rows[0][1]), (1000, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], SCHEMA)
    expected = brute(rows, 0.95)
    assert max(e[1] for e in expected) > 30
    for block in (2048, 37):
        got = ego.near_duplicates(frame, block=block)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert ego.near_duplicates(frame.where("vec_id < 0")).count() == 0


def test_intervals_skip_only_distant_blocks():
    rng = np.random.default_rng(1)
    points = np.sort(rng.uniform(-1, 1, (40, 1)), axis=0)
    boxes = np.stack([np.stack([p, p + 0.01]) for p in points])
    pairs = ego.near_intervals(boxes, 0.1)
    assert set(pairs) >= {(a, b) for a in range(40) for b in range(a, 40) if points[b] - points[a] <= 0.1}
    assert len(pairs) == len(set(pairs)) < 40 * 41 // 2


def test_clusters_are_skipped_by_blocks(spark):
    """Of clustered vectors most pairs of blocks are never compared, and those that are left have all links."""
    rng = np.random.default_rng(9)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0][:8]
    x = np.repeat(centres, 40, axis=0) + rng.normal(size=(320, 16)) * 0.02
    u = ego.unit(x)
    directions = ego.principal(u, 8)
    p = ego.coordinates(u, directions)
    eps = np.sqrt(0.1)
    order = np.lexsort(np.floor(p[:, :8] / eps).T[::-1])
    boxes = np.stack([[b.min(axis=0), b.max(axis=0)] for b in np.array_split(p[order], 32)])
    pairs = ego.near_intervals(boxes, eps)
    assert len(pairs) < 32 * 33 // 2 // 3
    assert {(a, b) for a in range(32) for b in range(a, 32) if (np.array_split(u[order], 32)[a] @ np.array_split(u[order], 32)[b].T >= 0.95).any()} <= set(pairs)
    gaps = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    assert (gaps <= ((u[:, None] - u[None]) ** 2).sum(axis=2) + 1e-9).all()
