"""Bilingual passages: paragraphs and sentences of two languages put beside each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlens.functions import text as T
from paperlens.functions.jsregex import named, trim

PASSAGE = "struct<id:string,paragraphs:array<struct<id:string,order:int,en:string,zh:string,sentences:array<struct<id:string,en:string,zh:string,order:int>>>>>"


def sentence_pairs(en: Column, zh: Column) -> Column:
    """Sentences by position (arrays in, array of structs out); surplus sentences of the second language join the last pair."""

    def pair(s: Column, i: Column) -> Column:
        last = i == F.size(en) - 1
        rest = F.when(last & (F.size(zh) > F.size(en)), F.array_join(F.slice(zh, F.size(en) + 1, F.greatest(F.size(zh) - F.size(en), F.lit(0))), "")).otherwise("")
        return F.struct(s.alias("en"), trim(F.concat(F.coalesce(F.get(zh, i), F.lit("")), rest)).alias("zh"), i.cast("int").alias("order"))

    return F.transform(en, pair)


def paragraph_structure(block_id: Column, en: Column, zh: Column) -> Column:
    """Paragraphs with aligned sentences: explicit paragraphs one to one where both texts have equally many, else the sentences
    of the second text are dealt out in order, by the first text's numbers of sentences, the rest to the last paragraph."""
    parts = F.struct(
        T.paragraphs(en).alias("en"),
        F.when(zh.isNull() | (zh == ""), F.array().cast("array<string>")).otherwise(T.explicit_paragraphs(zh)).alias("explicit"),
        F.when(zh.isNull() | (zh == ""), F.array().cast("array<string>")).otherwise(T.sentences_zh(zh)).alias("zh"),
    )

    def with_sentences(p: Column) -> Column:
        sentences = F.transform(p.en, lambda x: named(T.sentences_en(x), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(trim(x)))))
        return F.struct(p.en.alias("en"), p.explicit.alias("explicit"), p.zh.alias("zh"), sentences.alias("sentences"))

    def build(p: Column) -> Column:
        one_to_one = (F.size(p.explicit) > 1) & (F.size(p.explicit) == F.size(p.en))

        def paragraph(x: Column, i: Column) -> Column:
            own = F.get(p.sentences, i)
            before = F.aggregate(F.slice(p.sentences, 1, i), F.lit(0), lambda n, s: n + F.size(s))
            take = F.when(i == F.size(p.en) - 1, F.size(p.zh)).otherwise(F.size(own))
            other = F.when(one_to_one, T.sentences_zh(F.get(p.explicit, i))).otherwise(F.slice(p.zh, before + 1, take))
            pid = F.concat(block_id.cast("string"), F.lit("-p-"), i.cast("string"))

            def finish(pairs: Column) -> Column:
                joined = F.array_join(F.filter(F.transform(pairs, lambda s: s.zh), lambda s: s != ""), "")
                sentences = F.transform(pairs, lambda s: F.struct(F.concat(pid, F.lit("-s-"), s.order.cast("string")).alias("id"), s.en.alias("en"), s.zh.alias("zh"), s.order.alias("order")))
                return F.struct(pid.alias("id"), i.cast("int").alias("order"), x.alias("en"), F.when(one_to_one, F.get(p.explicit, i)).otherwise(joined).alias("zh"), sentences.alias("sentences"))

            return named(sentence_pairs(own, other), finish)

        return F.transform(p.en, paragraph)

    return named(named(parts, with_sentences), build)


def passage(block_id: Column, en: Column, zh: Column) -> Column:
    return F.struct(block_id.cast("string").alias("id"), paragraph_structure(block_id, en, zh).alias("paragraphs"))


def parsed(json: Column, block_id: Column, en: Column, zh: Column) -> Column:
    """A passage from JSON (an object, or a bare array of paragraphs); rebuilt where it is missing or not well-formed."""
    as_object = F.from_json(json, PASSAGE)
    as_array = F.from_json(json, PASSAGE.removeprefix("struct<id:string,paragraphs:").removesuffix(">"))
    complete = lambda a: a.isNotNull() & F.forall(a, lambda p: p.isNotNull() & p.id.isNotNull() & p.en.isNotNull() & p.sentences.isNotNull())
    return (
        F.when(json.startswith("[") & complete(as_array), F.struct(block_id.cast("string").alias("id"), as_array.alias("paragraphs")))
        .when(~json.startswith("[") & complete(as_object.paragraphs), as_object)
        .otherwise(passage(block_id, en, zh))
    )
