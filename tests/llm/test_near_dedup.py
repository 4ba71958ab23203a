import random
from collections import defaultdict

import numpy as np
import pytest

from paperlens.llm import near_dedup as N


def brute(rows, k, percent):
    sets = []
    for i, text in rows:
        words = text.encode().lower().split() if text else []
        sets.append((i, {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def run(spark, rows, k, percent):
    got = N.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string"), k, percent).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in got)


def corpus(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(500)]
    base = [[random.choice(words) for _ in range(random.randint(1, 120))] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for b in (*base[:20], *[base[0]] * 60):  # one large group of near copies of near copies
        copy = list(b)
        for _ in range(random.randint(0, 4)):
            copy[random.randrange(len(copy))] = random.choice(words)
        rows.append((len(rows), "  ".join(copy).upper() if random.random() < 0.3 else "\n".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t "), (3, rows[5][1]), (4, rows[4][1]), (None, rows[0][1]), (900, "one"), (901, "ONE"), (902, "one two")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_same_as_brute_force(spark, k, percent):
    rows = corpus(k)
    assert run(spark, rows, k, percent) == brute(rows, k, percent)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    base, m, misses = rng.integers(0, 2**63, 200_000).astype("uint64"), 180, []
    for trial in range(60):
        n, common = 200, 170
        a = base[trial * 1000 : trial * 1000 + n]
        b = np.concatenate([a[:common], base[trial * 1000 + 500 : trial * 1000 + 500 + n - common]])
        sig = N.superminhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2, m)
        misses.append((sig[0] == sig[1]).mean() - common / (2 * n - common))
    assert abs(np.mean(misses)) < 0.02


def test_every_slot_is_filled_for_small_sets():
    sig = N.superminhash(np.array([5, 9], "uint64"), np.array([0, 1]), 2, 64)
    assert (sig != N.EMPTY).all() and len(set(sig[0] >> np.uint64(48))) == 64


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    groups = defaultdict(set)
    for a, b in links:
        merged = groups[a] | groups[b] | {a, b}
        for x in merged:
            groups[x] = merged
    want = {x: min(g) for x, g in groups.items() if min(g) != x}
    got = {r.id: r.component for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
