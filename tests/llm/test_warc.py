import os
import random

import pytest

from paperlens.llm import warc as W
from paperlens.llm.common import new_path
from paperlens.llm.queries import ORACLE_SQL, QUERIES


def pages(spark, n=200):
    random.seed(6)
    texts = [None, "", "<p>same</p>", *("".join(random.choice("abcdefgh \n\r世é\x1f\x8b\x08") for _ in range(random.randint(0, 3000))) for _ in range(40))]
    rows = [(i, random.choice([None, f"http://h/{i}", "http://x/\r\nWARC/1.1"]), random.choice(texts), "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def want(rows, least=0):
    first = {}
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        if len(payload) >= least:
            first[payload] = min(first.get(payload, i), i)
    out = []
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        f = first.get(payload, i)
        out.append((i, len(payload), W.digest(payload), "response" if f == i else "revisit", None if f == i else f))
    return sorted(out)


def test_round_trip(spark):
    rows, frame = pages(spark)
    for least in (0, 10):
        assert sorted(tuple(r) for r in W.archived(frame, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want(rows, least)


def test_any_split_finds_every_record_once(spark):
    rows, frame = pages(spark, 80)
    path = new_path(spark, "warc")
    W.write(frame.coalesce(2), path)
    for split in (97, 1000, 1 << 20):
        back = W.read(spark, path, split_bytes=split).collect()
        assert sorted(int(r.record_id.removeprefix(W.ID)) for r in back) == sorted(r[0] for r in rows)
        html = {r[0]: (r[2] or "").encode() for r in rows}
        assert all(r.payload == html[int(r.record_id.removeprefix(W.ID))] for r in back if r.record_type == "response")
        assert all(W.digest(bytes(r.payload)) == r.payload_digest for r in back if r.payload is not None)


def test_ids_come_back_whole(spark):
    ids = ["x" * 200, " spaced ", "a/b:c%+é\r\n<>", "", None]
    frame = spark.createDataFrame([(i, "u", f"page {i}") for i in ids] + [("second", "u", f"page {ids[2]}")], "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in W.archived(frame).collect()}
    assert got == {*((i, "response", None) for i in ids), ("second", "revisit", ids[2])}


def test_long_payload(spark):
    import os

    html = os.urandom(1_500_000).hex()
    got = W.archived(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert (got.payload_bytes, got.payload_digest) == (3_000_000, W.digest(html.encode()))


@pytest.mark.parametrize("split", [97, 5000, 1 << 20])
def test_damage_is_an_error(spark, split):
    _, frame = pages(spark, 60)
    path = new_path(spark, "warc")
    W.write(frame.coalesce(1), path)
    place = next(f"{path.removeprefix('file://')}/{f}" for f in os.listdir(path.removeprefix("file://")) if f.endswith(".warc.gz"))
    whole = bytearray(open(place, "rb").read())
    at = sorted((r.offset, r.record_id) for r in W.read(spark, path).collect())[30][0]
    whole[at + 60] ^= 0xFF
    open(place, "wb").write(whole)
    with pytest.raises(Exception, match="damaged record"):
        W.read(spark, path, split_bytes=split).count()


def test_chance_magic_and_headers_within_payloads_are_no_records(spark, monkeypatch):
    """Level-0 members keep the payload's bytes as they are, so ranges begin in front of what looks like a member."""
    import gzip

    monkeypatch.setattr(gzip, "compress", lambda data, level=9, mtime=None, own=gzip.compress: own(data, 0, mtime=0))
    fakes = [W.MAGIC + b"junk" * 50, gzip.compress(b"WARC/1.1\r\n\r\nno type"), gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\nshort"), gzip.compress(b"hello WARC/1.1")]
    folder = new_path(spark, "warc").removeprefix("file://")
    os.makedirs(folder)
    with open(f"{folder}/a.warc.gz", "wb") as out:
        for i, fake in enumerate(fakes * 5):
            out.write(W.record(i, "u", fake, None, "2020-01-01T00:00:00Z"))
    for split in (50, 333, 1 << 20):
        assert sorted(r.record_id for r in W.read(spark, f"file://{folder}", split_bytes=split).collect()) == sorted(W.urn(i) for i in range(20))


def test_payloads_are_not_shuffled(spark):
    plan = W.with_revisits(pages(spark)[1])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_nulls_ties_and_empty(spark):
    frame = spark.createDataFrame([(None, None, "a"), (3, "u", "a"), (3, "u", "a"), (5, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in W.archived(frame).collect())
    assert got == [(-1, "revisit", 3), (3, "response", None), (3, "response", None), (5, "response", None)]
    assert W.archived(frame.limit(0)).count() == 0


def test_same_as_sql(same_rows):
    same_rows(QUERIES["op5_warc"], ORACLE_SQL["op5_warc"])
