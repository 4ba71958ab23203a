import hashlib
import math
import random

import numpy as np

from paperlens.llm import vector_codes as V


def brute(rows, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    d = len(kept[0][1]) // 8
    books = [[v[p * d : p * d + d] for _, v, _ in kept[:entries]] for p in range(8)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(books[p], v[p * d : p * d + d])[1], []).append(v[p * d : p * d + d])
            for j, parts in own.items():
                books[p][j] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, errors = [], {}
    for i, v, label in kept:
        found = [near(books[p], v[p * d : p * d + d]) for p in range(8)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(e for e, _ in found), label))
        errors[label] = errors.get(label, 0) + out[-1][2]
    return sorted([(i, code, error, errors[label], digest) for i, code, error, label in out], key=str)


def vectors(n, dim, spread=1.0, seed=2):
    random.seed(seed)
    centres = [[random.gauss(0, spread) for _ in range(dim)] for _ in range(6)]
    rows = [(i * 3 % n, [x + random.gauss(0, 0.2) for x in random.choice(centres)], random.choice([1, 2, None])) for i in range(n)]
    return rows + [(n + i, list(rows[-1][1]), 2) for i in range(40)]


def got(spark, rows, dim=None):
    df = spark.createDataFrame([(i, v, label, "x", 5) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    return sorted([tuple(r) for r in V.vector_codes(df).collect()], key=str)


def test_same_as_brute_force(spark):
    rows = vectors(300, 24)
    rows += [(-5, None, 1), (-4, [None] * 24, 1), (-3, [float("nan")] * 24, 1), (-2, [0.0] * 23 + [float("-inf")], None), (None, rows[3][1], 1), (7, rows[9][1], 1), (7, rows[9][1], 1)]
    assert got(spark, rows) == brute(rows)


def test_few_wide_and_empty(spark):
    assert got(spark, vectors(4, 8)[:5]) == brute(vectors(4, 8)[:5])
    assert got(spark, []) == []
    far = [(i, [x * 3000 for x in v], label) for i, v, label in vectors(60, 16)]
    assert got(spark, far) == brute(far)


def test_odd_lengths(spark):
    rows = got(spark, [(1, [0.5] * 10, 1), (2, [0.25] * 10, 1), (3, [0.5] * 4, 1), (4, [], None)])
    assert [(r[0], r[1] is None, r[2], r[3]) for r in rows] == [(1, False, 0, 0), (2, False, 0, 0), (3, True, None, None), (4, True, None, None)]
    assert [r[1] for r in got(spark, [(1, [], 1)])] == ["00" * 8]


def test_cells_leave_no_nearest_entry_out(monkeypatch):
    rng = np.random.default_rng(1)
    for width in (3, 900, 1 << 20):
        entries, points = rng.integers(-width, width, (16, 5)), rng.integers(-2 * width, 2 * width, (3_000, 5))
        entries[4] = entries[2]
        points[:50] = points[0]
        distance = ((points[:, None] - entries) ** 2).sum(axis=2)
        for cells in (1 << 16, 500):
            monkeypatch.setattr(V, "CACHE_CELLS", cells)
            cache = V.Cells(entries)
            for some in (points[:100], points, points[::-1]):
                index, error = cache.nearest(some)
                want = ((some[:, None] - entries) ** 2).sum(axis=2)
                assert (index == want.argmin(axis=1)).all() and (error == want.min(axis=1)).all()
        monkeypatch.setattr(V.Cells, "_hash", lambda self, cells: np.zeros(len(cells), "uint64"))  # all cells collide
        assert (V.Cells(entries).nearest(points)[0] == distance.argmin(axis=1)).all()
        monkeypatch.undo()
