"""Replies of extraction models: validation, counters, and the model path itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import ENTITY_TYPES, IngestConfig
from quarry.functions import text as T
from quarry.operators.providers import ChatModel, ask, build_options
from quarry.operators.structural import extract_records

_SHAPE = "struct<entities:array<struct<name:string,type:string>>,relationships:array<struct<source:string,relation:string,target:string>>>"


def unfenced(reply: Column) -> Column:
    """Without a Markdown code fence around it."""
    return T.strip(F.regexp_replace(T.strip(reply), r"^```[A-Za-z]*\s*|\s*```$", ""))


def _first_by(items: Column, key) -> Column:
    """The items whose key did not come before."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, key), key(x)) == i + 1)


def parse_extraction(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Add entities and relations from a JSON reply.  Bad JSON gives none.  A type that is missing or
    unknown is CONCEPT; names need two characters and count once by lower case; a relation needs
    three filled parts and two different ends among the entities.

    The two columns come out of a generator.  Else what a caller asks of them, and be it that Spark infers from an
    explode that a list is not empty, is pushed below the parsing: every reply would be parsed again for each of its
    items, and in the tasks that read the table."""
    parsed = rows.withColumn("_p", F.from_json(unfenced(F.col(reply)), _SHAPE))
    kind = lambda t: F.when(F.upper(T.strip(t)).isin(*ENTITY_TYPES), F.upper(T.strip(t))).otherwise("CONCEPT")
    named = F.transform(F.coalesce("_p.entities", F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.struct(T.strip(e["name"]).alias("name"), kind(e["type"]).alias("type")))
    step = parsed.withColumn("_n", F.filter(named, lambda e: F.length(e["name"]) >= 2))
    step = step.withColumn("entities", _first_by(F.col("_n"), lambda e: F.lower(e["name"]))).withColumn("_k", F.transform("entities", lambda e: F.lower(e["name"])))
    edges = F.transform(
        F.coalesce("_p.relationships", F.array().cast("array<struct<source:string,relation:string,target:string>>")),
        lambda e: F.struct(T.strip(e["source"]).alias("source"), F.upper(F.replace(T.strip(e["relation"]), F.lit(" "), F.lit("_"))).alias("relation"), T.strip(e["target"]).alias("target")),
    )
    known = lambda x: F.array_contains("_k", F.lower(x))
    good = F.filter(edges, lambda e: F.coalesce((e["relation"] != "") & known(e["source"]) & known(e["target"]) & (F.lower(e["source"]) != F.lower(e["target"])), F.lit(False)))
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return step.withColumn("_r", good).select(*kept, F.inline(F.array(F.struct("entities", F.col("_r").alias("relations")))))


def type_quality(entities: DataFrame) -> DataFrame:
    """(type, missing, invalid, n): how many types are missing or unknown."""
    kind = F.coalesce(F.upper(T.strip(F.col("type"))), F.lit(""))
    return entities.groupBy("type").agg(F.count_if(kind == "").alias("missing"), F.count_if((kind != "") & ~kind.isin(*ENTITY_TYPES)).alias("invalid"), F.count("*").alias("n"))


def extraction_prompt(text: Column, most_tokens: int = IngestConfig.extraction_tokens) -> Column:
    """The task, the kinds and the shape of the reply, then the text."""
    kinds = ", ".join(ENTITY_TYPES)
    task = (
        f"Find the named entities of the text below and the relations between them that it states. Kinds: {kinds}. Reply with JSON alone, in at most {most_tokens} tokens: "
        '{"entities": [{"name": "...", "type": "..."}], "relationships": [{"source": "...", "relation": "...", "target": "..."}]}. Sources and targets are names among the entities.'
    )
    return F.concat(F.lit(task + "\n\nText:\n"), T.strip(text))


def extract_with_model(rows: DataFrame, model: ChatModel, text: str, config: IngestConfig = IngestConfig(), base_delay: float = 1.0) -> DataFrame:
    """Entities and relations of texts from a chat model; a blank text or a failing call gives none."""
    blank = F.coalesce(F.length(T.strip(F.col(text))), F.lit(0)) == 0
    prompted = rows.withColumn("prompt_", extraction_prompt(F.col(text), config.extraction_tokens))
    replies = ask(prompted.where(~blank), model, "prompt_", base_delay=base_delay, options=build_options(temperature=0.0, max_tokens=config.extraction_tokens))
    none = prompted.where(blank).withColumn("reply", F.lit(None).cast("string"))
    return parse_extraction(replies.unionByName(none), "reply").drop("reply", "prompt_")


def gated_extraction(rows: DataFrame, model: ChatModel, text: str, config: IngestConfig = IngestConfig(), base_delay: float = 1.0) -> DataFrame:
    """rows(..., value: JSON or null) with entities, relations and route: by their structure, without any
    call, where enough of the fields are known (``min_coverage``), all others by a model."""
    read = extract_records(rows, "value")
    known = (F.col("coverage") >= config.min_coverage) & F.col("value").isNotNull() & F.lit(config.structural)
    by_structure = read.where(known).drop("coverage").withColumn("route", F.lit("structural"))
    by_model = extract_with_model(read.where(~known).drop("entities", "relations", "coverage"), model, text, config, base_delay)
    return by_structure.unionByName(by_model.withColumn("route", F.lit("model")))


def string_list(reply: Column, most: int) -> Column:
    """The filled strings of a JSON array, the first ``most``; none if it is no such array."""
    found = F.from_json(unfenced(reply), "array<string>")
    return F.slice(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), T.strip), lambda s: s != ""), 1, most)


def scores(reply: Column) -> Column:
    """map<int,double> of a JSON array of {index, score}; empty if it is none."""
    found = F.from_json(unfenced(reply), "array<struct<index:int,score:double>>")
    pairs = F.filter(F.coalesce(found, F.array().cast("array<struct<index:int,score:double>>")), lambda s: s["index"].isNotNull())
    return F.map_from_entries(F.array_distinct(F.transform(_first_by(pairs, lambda s: s["index"]), lambda s: F.struct(s["index"], s["score"]))))
