import random

from paperlens.llm import url_filters as U


def parts(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def fixed(host, path):
    best = None
    for verdict, domain, start in U.RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(start) and (best is None or len(domain + start) > len(best[0])):
            best = (domain + start, verdict)
    return best or (None, None)


def test_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://a.net/", "http://a.net", "https://Example.NET/en/x?y#z", "http://example.net/enx", "http://x.example.com/de/1", "ftp://org/fr/", "http://b.org/fr", "http://notorg/fr/", "a://b.net/://c", "http://h?q=/en/", "http://h#/x", "x\n://org/fr/\n?", "http://İ.net/é"]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://a.net/", "x"), (0, None, "x")], "page_id long, url string, verdict string")
    got = U.judged(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r.page_id is None:
            continue
        host, path = parts(urls[r.page_id])
        rule, verdict = fixed(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r


def test_mined_rules_match_as_brute_force(spark):
    random.seed(8)
    hosts, rows, labels = ["good.example.org", "cheap-pills.example.org", "news.site.com", "casino.site.com"], [], []
    for i in range(600):
        host = random.choice(hosts)
        rows.append((i, f"https://{host}/{random.choice(['a', 'b'])}/{i}.html?{random.choice(['utm', 'page'])}=1"))
        bad = ("pills" in host or "casino" in host and "/b/" in rows[-1][1]) and random.random() < 0.9
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in U.judged(pages, marks, rules=(), confidence=0.75).collect()}
    assert all((got[i] == "block") == ("pills" in u or "casino" in u and "/b/" in u) for i, u in rows)


def test_inverted_index(spark):
    rules = spark.createDataFrame([("a", ["a"], 1), ("b", ["b", "c"], 2)], "rarest string, antecedent array<string>, size int")
    pages = spark.createDataFrame([(1, ["a", "x"]), (2, ["b"]), (3, ["c", "b"]), (4, [])], "key int, tokens array<string>")
    assert sorted(r.key for r in U.fired(pages, rules).collect()) == [1, 3]


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judged(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_rules_on_the_last_of_thirty_tokens(spark):
    random.seed(4)
    path, keys = "/".join(f"part{'abcdefghijkl'[i]}" for i in range(12)), "&".join(f"{c}=1" for c in "klmno")
    rows = [(i, f"https://www.a-b.example.co.uk/{path}/{i}.html?{keys}&{random.choice(['utm', 'page'])}=1") for i in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    host, path = U.host_and_path(U.F.col("url"))
    n = frame.select(host.alias("host"), path.alias("path"), "url").select(U.F.size(U.tokens()).alias("n")).first().n
    assert n >= 30
    labels = spark.createDataFrame([(i, int("utm=" not in u), 0) for i, u in rows if i % 2], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in U.judged(frame, labels, rules=()).collect()}
    assert all((got[i] == "block") == ("utm=" in u) for i, u in rows)


def test_tokens_that_go_together_keep_their_own_rules(spark):
    rows = [(["a", "b", "x"], True)] * 30 + [(["c", "x"], False)] * 60 + [(["a", "b", "c"], True)] * 10 + [([], False)] * 5 + [(["rare"], True)]
    rules = U.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), support=0.05)
    assert sorted((tuple(r.antecedent), r.size, r.rarest) for r in rules.collect()) == [(("a",), 1, "a"), (("b",), 1, "b")]


def test_mined_rules_against_enumerated_sets(spark):
    """Every set of tokens by counting: support, confidence and lift, and only sets that no smaller one implies."""
    from itertools import combinations

    random.seed(12)
    rows = []
    for _ in range(300):
        tokens = sorted({random.choice("abcdefgh") for _ in range(random.randint(0, 5))})
        rows.append((tokens, random.random() < (0.9 if {"a", "b"} <= set(tokens) or "h" in tokens else 0.25)))
    support, confidence, lift = 0.02, 0.7, 1.3
    share = sum(b for _, b in rows) / len(rows)
    found = {}
    for size in range(1, 6):
        for some in combinations("abcdefgh", size):
            hit = [b for t, b in rows if set(some) <= set(t)]
            if hit and sum(hit) >= support * len(rows) and sum(hit) / len(hit) >= confidence and sum(hit) / len(hit) / share >= lift:
                found[some] = (sum(hit) / len(hit), sum(hit) / len(rows))
    want = {s: v for s, v in found.items() if not any(s[:k] + s[k + 1 :] in found for k in range(len(s)))}
    rules = U.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), support, confidence, lift).collect()
    assert {tuple(r.antecedent) for r in rules} == set(want) and len(want) > 2
    for r in rules:
        assert abs(r.confidence - want[tuple(r.antecedent)][0]) < 1e-9 and abs(r.support - want[tuple(r.antecedent)][1]) < 1e-9
        freq = {t: sum(t in tokens for tokens, _ in rows) for t in r.antecedent}
        assert r.rarest == min(freq, key=lambda t: (freq[t], t))
