import math
import random
import re
from collections import Counter

import pytest

from paperlens.llm import ranked_search as R


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in bags), max(1, sum(n for _, _, n in bags))
    df = Counter(t for _, bag, _ in bags for t in bag)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, bag, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in ts if bag[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i if i is not None else -1, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, score int, rank string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = R.best_documents(d, q, k).collect()
    return sorted([(r.item_id if r.item_id is not None else -1, r["rank"], r.doc_id, r.score) for r in rows], key=str)


@pytest.fixture
def tables():
    random.seed(3)
    words = ["alpha", "Beta", "gamma3", "été", "世界", "x", *(f"w{i}" for i in range(60))]
    text = lambda n: "".join(random.choice(words[: random.choice([6, 20, 66])]) + random.choice([" ", ", ", ".\n", "\x1c", "_"]) for _ in range(n))
    docs = [(i, text(random.choice([0, 1, 5, 30, 200]))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)] + [(5, docs[9][1])] * 3 + [(None, docs[9][1]), (2000, None), (2001, "..!"), (2002, "alpha " * 70_000)]
    items = [(i, text(random.choice([1, 3, 12, 40]))) for i in range(30)] + [(40, None), (41, ""), (42, "?!"), (43, "nowhere"), (3, "W1 w1 unheard"), (None, "beta été")]
    return docs, items


def test_same_as_brute_force(spark, tables):
    docs, items = tables
    assert got(spark, docs, items) == brute(docs, items, 10)


def test_blocks_of_documents_and_items(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(R, "ITEM_TERMS", 60)
    assert got(spark, docs, items, 3) == brute(docs, items, 3)


def test_tries_bound_and_find_all():
    """Blocks of many documents: comb-like and random sequences, all copies but the first ones left out."""
    rng = random.Random(4)
    for make in (lambda i: list(range(i % 300 + 1)), lambda i: sorted(rng.sample(range(40), rng.randint(1, 12))), lambda i: [1, 2]):
        vectors = [make(i) for i in range(900)]
        np = R.np
        terms_, ends = np.concatenate([np.array(v) for v in vectors]), np.cumsum([len(v) for v in vectors])
        counts, m = np.array([rng.randint(1, 3) for _ in terms_]), np.array([rng.choice([10, 50, 400]) for _ in vectors])
        trie = R.Trie(terms_, counts, ends, m, np.arange(len(vectors)), 10)
        assert sum(len(trie.terms[a:b]) for a, b in zip([0, *trie.ends[:-1]], trie.ends, strict=True)) == len(trie.terms)
        assert len(trie.of_term) < 14 * len(trie.terms) + 300
        query = np.array([1, 2, 5, 11])
        weights = np.array([900, 40, 300, 7])
        best = R.Best(10)
        trie.search(query, weights, np.zeros(400, "int64"), best.least, lambda rows, best=best: best.add([(s, d) for d, s in rows]))
        scores = Counter()
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            for t, tf in zip(terms_[a:b].tolist(), counts[a:b].tolist(), strict=True):
                if t in query.tolist():
                    scores[i] += int(weights[query.tolist().index(t)]) * ((1000000000 * tf) // (1000 * tf + 8 * int(m[i])))
        assert best.rows == sorted(((s, i) for i, s in scores.items() if s > 0), key=lambda r: (-r[0], r[1]))[:10]


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] == got(spark, [(1, "a")], [])
    assert got(spark, [(1, None)], [(1, None)]) == []
