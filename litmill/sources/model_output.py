"""Tables of model answers turned into rows: triples, entities, relations, quiz items, repaired JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.text import let, strip

_TRIPLES = (
    "struct<entities:array<struct<id:string,type:string>>,"
    "relations:array<struct<source:string,predicate:string,target:string,evidence:string>>,_bad:string>"
)
_ENTITIES = "array<struct<name:string,type:string>>"
_RELATIONS = (
    "array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string,evidence:string>>"
)
_QUIZ = "array<struct<question:string,options:array<string>,answer:string>>"


def relation_type(c: Column) -> Column:
    """Upper case with underscores; empty becomes RELATED_TO."""
    c = F.when(F.coalesce(c, F.lit("")) != "", c).otherwise("RELATED_TO")
    return F.replace(F.upper(strip(c)), F.lit(" "), F.lit("_"))


def _unfenced(raw: Column) -> Column:
    """The content of the first code fence, or the whole text."""
    raw = strip(F.coalesce(raw, F.lit("")))
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    return F.when(raw.rlike(fence), strip(F.regexp_extract(raw, fence, 1))).otherwise(raw)


def _between(raw: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket; null when there is no such span."""

    def cut(t: Column) -> Column:
        start = F.instr(t, opening)
        end = F.length(t) - F.instr(F.reverse(t), closing) + 1
        return F.when((start > 0) & t.contains(closing) & (end > start), t.substr(start, end - start + 1))

    return let(_unfenced(raw), cut)


def _text(c: Column, default: str = "") -> Column:
    c = strip(F.coalesce(c, F.lit("")))
    return F.when(c != "", c).otherwise(default) if default else c


def _valid_triples(responses: DataFrame, key: str, raw: str) -> DataFrame:
    """Answers whose JSON parses and has every required field; one bad item rejects the answer."""
    parsed = F.from_json(_between(F.col(raw), "{", "}"), _TRIPLES, {"columnNameOfCorruptRecord": "_bad"})
    df = responses.select(key, parsed.alias("p")).where(F.col("p").isNotNull() & F.col("p._bad").isNull())
    no_entities = F.array().cast("array<struct<id:string,type:string>>")
    no_relations = F.array().cast("array<struct<source:string,predicate:string,target:string,evidence:string>>")
    return df.where(
        F.forall(F.coalesce("p.entities", no_entities), lambda e: e["id"].isNotNull() & e["type"].isNotNull())
        & F.forall(
            F.coalesce("p.relations", no_relations),
            lambda r: r["source"].isNotNull() & r["predicate"].isNotNull() & r["target"].isNotNull() & r["evidence"].isNotNull(),
        )
    )


def parse_triples(responses: DataFrame, key: str = "chunk_id", raw: str = "raw") -> DataFrame:
    """(key, pos, head, head_type, relation, tail, tail_type, evidence) out of answers holding a JSON object.

    Endpoint types come from the entities of the same answer (the last one of a name, any case);
    unknown ones are "Concept". Answers that do not parse give no rows.
    """
    df = _valid_triples(responses, key, raw)
    names = F.transform(
        F.coalesce("p.entities", F.array().cast("array<struct<id:string,type:string>>")),
        lambda e: F.struct(F.lower(_text(e["id"])).alias("k"), _text(e["type"], "Concept").alias("v")),
    )
    df = df.withColumn("_types", F.filter(names, lambda e: e["k"] != ""))

    def type_of(name: Column) -> Column:
        hits = F.filter(F.col("_types"), lambda e: e["k"] == F.lower(name))
        return F.coalesce(F.get(hits, F.size(hits) - 1)["v"], F.lit("Concept"))

    rows = df.select(key, "_types", F.posexplode("p.relations").alias("pos", "r"))
    rows = rows.withColumn("head", _text(F.col("r.source"))).withColumn("tail", _text(F.col("r.target")))
    evidence = _text(F.col("r.evidence"))
    return rows.where("head != '' and tail != ''").select(
        key,
        "pos",
        "head",
        type_of(F.col("head")).alias("head_type"),
        relation_type(F.col("r.predicate")).alias("relation"),
        "tail",
        type_of(F.col("tail")).alias("tail_type"),
        F.when(evidence != "", evidence).alias("evidence"),
    )


def parse_triple_entities(responses: DataFrame, key: str = "chunk_id", raw: str = "raw") -> DataFrame:
    """(key, pos, name, type): the entities listed beside the triples."""
    df = _valid_triples(responses, key, raw)
    rows = df.select(key, F.posexplode("p.entities").alias("pos", "e"))
    return rows.select(key, "pos", _text(F.col("e.id")).alias("name"), _text(F.col("e.type"), "Concept").alias("type")).where(
        "name != ''"
    )


def _array_rows(responses: DataFrame, schema: str, key: str, raw: str) -> DataFrame:
    parsed = F.from_json(_between(F.col(raw), "[", "]"), schema)
    return responses.select(key, F.posexplode(parsed).alias("pos", "e")).where(F.col("e").isNotNull())


def parse_entities(responses: DataFrame, key: str = "chunk_id", raw: str = "raw") -> DataFrame:
    rows = _array_rows(responses, _ENTITIES, key, raw)
    return rows.select(key, "pos", _text(F.col("e.name")).alias("name"), _text(F.col("e.type"), "Concept").alias("type")).where(
        "name != ''"
    )


def parse_relations(responses: DataFrame, key: str = "chunk_id", raw: str = "raw") -> DataFrame:
    rows = _array_rows(responses, _RELATIONS, key, raw)
    evidence = _text(F.col("e.evidence"))
    return rows.select(
        key,
        "pos",
        _text(F.col("e.head")).alias("head"),
        _text(F.col("e.head_type"), "Concept").alias("head_type"),
        relation_type(F.col("e.relation")).alias("relation"),
        _text(F.col("e.tail")).alias("tail"),
        _text(F.col("e.tail_type"), "Concept").alias("tail_type"),
        F.when(evidence != "", evidence).alias("evidence"),
    ).where("head != '' and tail != ''")


def valid_quiz_items(responses: DataFrame, key: str = "response_id", raw: str = "raw") -> DataFrame:
    """(key, pos, question, options, answer) with all three fields and two options or more."""
    whole = strip(F.coalesce(F.col(raw), F.lit("")))
    span = F.regexp_extract(whole, r"(?s)(\[.*\])", 1)
    items = responses.select(key, F.posexplode(F.from_json(span, _QUIZ)).alias("pos", "q")).select(key, "pos", "q.*")
    return items.where("question is not null and answer is not null and size(options) >= 2")


# ---- truncated JSON ------------------------------------------------------------------------------


def repaired_json(raw: Column) -> Column:
    """JSON cut off in the middle: back to the last point where all braces were closed, then brackets closed.

    Strings are blanked first (same length), so depth is a running count over the structural
    characters that are left: one fold per row, on the JVM.
    """

    def blank_strings(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(r'(?s)("(?:[^"\\]|\\.)*+"?|[^"]+)'), F.lit(1))
        return F.array_join(
            F.transform(pieces, lambda p: F.when(p.startswith('"'), F.repeat(F.lit("s"), F.length(p))).otherwise(p)), ""
        )

    marks = F.filter(
        F.transform(F.split(blank_strings(raw), ""), lambda ch, i: F.struct(ch.alias("ch"), i.alias("i"))),
        lambda e: e["ch"].isin("{", "}", "[", "]"),
    )
    start = F.struct(F.lit(0).alias("brace"), F.lit(0).alias("square"), F.lit(0).alias("safe"))

    def step(acc: Column, e: Column) -> Column:
        brace = acc["brace"] + F.when(e["ch"] == "{", 1).when(e["ch"] == "}", -1).otherwise(0)
        square = acc["square"] + F.when(e["ch"] == "[", 1).when(e["ch"] == "]", -1).otherwise(0)
        safe = F.when((e["ch"] == "}") & (brace == 0), e["i"]).otherwise(acc["safe"])
        return F.struct(brace.alias("brace"), square.alias("square"), safe.alias("safe"))

    def finish(acc: Column) -> Column:
        head = F.when(acc["safe"] > 0, F.substring(raw, F.lit(1), acc["safe"] + 1)).otherwise(raw)
        closing = F.concat(
            F.repeat(F.lit("]"), F.greatest(acc["square"], F.lit(0))),
            F.repeat(F.lit("}"), F.greatest(acc["brace"] - 1, F.lit(0))),
        )
        return F.when((acc["brace"] == 0) & (acc["square"] == 0), raw).otherwise(F.concat(head, closing))

    return F.aggregate(marks, start, step, finish)


def repair_json(responses: DataFrame, key: str = "response_id", raw: str = "raw") -> DataFrame:
    """(key, json, parsed): text without fences, repaired where it does not parse as it is."""
    from litmill.operators.cleaning import without_fences

    df = responses.withColumn("_t", without_fences(F.coalesce(F.col(raw), F.lit("")))).withColumn(
        "_fixed", repaired_json(F.col("_t"))
    )
    ok = lambda c: F.try_parse_json(c).isNotNull()
    chosen = F.when(ok(F.col("_t")), F.col("_t")).otherwise(F.col("_fixed"))
    return df.select(key, chosen.alias("json")).withColumn("parsed", ok(F.col("json")))


# ---- pluggable extractor ---------------------------------------------------------------------------


def extract_with(chunks: DataFrame, make_extractor: Callable[[], Callable[[str], str]], key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, raw): a text-to-JSON function applied batch by batch; it is built once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make_extractor()
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "raw": [extract(t) for t in pdf[text]]})

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, text).mapInPandas(run, f"{key} {kind}, raw string")
