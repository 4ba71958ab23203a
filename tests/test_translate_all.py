from paperlens.operators import translation as O
from paperlens.plans.catalogue import ORACLE_SQL, QUERIES

TINY = "/root/testdata/sf0.001"


def test_every_translatable_block_is_cached_or_sent(spark):
    got = QUERIES["q_translate_all"](spark, TINY).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in QUERIES["q_translatable"](spark, TINY).collect())
    hits = {r.doc_id for r in QUERIES["q_cache_lookup"](spark, TINY).where("translation IS NOT NULL").collect()}
    assert all(r.cached == (r.doc_id in hits) and r.translation_hash for r in got)
    assert {(r.style, r.cached) for r in got} == {(s, c) for s in (O.STYLE, O.PROMPT_STYLE) for c in (True, False)}


def test_same_as_sql(same_rows):
    same_rows(QUERIES["q_translate_all"], ORACLE_SQL["q_translate_all"])
