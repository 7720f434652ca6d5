"""Validation, evidence check and flattening of extraction trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainledger.functions.domain import CONFIDENCES, LONGEST_EVIDENCE, RECENCIES, SEVERITIES, THEMES
from rainledger.functions.text import contains_quote

EXTRACTION = (
    "struct<events:array<struct<reasoning:string,location:string,recency_in_months:int,impacts:array<struct<classification:string,severity:int,"
    "evidence:string,confidence:double>>>>>"
)
_EVENTS = EXTRACTION[len("struct<events:") : -1]


def _valid_impact(i: Column) -> Column:
    return F.coalesce(i["classification"].isin(list(THEMES)) & i["severity"].isin(*SEVERITIES) & i["confidence"].isin(*CONFIDENCES) & F.char_length(F.trim(i["evidence"])).between(1, LONGEST_EVIDENCE), F.lit(False))


def _valid_event(e: Column) -> Column:
    return F.coalesce((F.trim(e["location"]) != "") & e["recency_in_months"].isin(*RECENCIES) & e["impacts"].isNotNull() & F.forall(e["impacts"], _valid_impact), F.lit(False))


def parse_answers(answers: DataFrame, payload: str) -> DataFrame:
    """Adds events and error: all or nothing, so one invalid impact rejects the answer. An answer that reports an
    error keeps its message; missing events are an empty list. Anything that is not one whole JSON object is an error, and
    so are events that are no array."""
    tree = F.from_json(F.col(payload), EXTRACTION)
    json = F.try_parse_json(F.col(payload))
    kinds = F.struct(F.schema_of_variant(json).alias("whole"), F.schema_of_variant(F.try_variant_get(json, "$.events", "variant")).alias("events"))
    out = answers.withColumns({"__tree": tree, "__kinds": kinds}).withColumn("__events", F.coalesce(F.col("__tree.events"), F.array().cast(_EVENTS)))
    blank = F.coalesce(F.trim(F.col(payload)) == "", F.lit(True))
    whole = F.coalesce(F.col("__kinds.whole").startswith("OBJECT"), F.lit(False))
    listed = F.coalesce(F.col("__kinds.events").rlike("^(ARRAY|VOID)"), F.lit(True))
    error = F.when(blank, "empty").when(F.col(payload).startswith("Error:"), F.col(payload)).when(~whole, "not an extraction object").when(~listed | ~F.forall("__events", _valid_event), "invalid value")
    return out.withColumn("error", error).withColumn("events", F.when(F.col("error").isNull(), F.col("__events")).otherwise(F.array().cast(_EVENTS))).drop("__tree", "__kinds", "__events")


def verbatim(events: Column, title: Column, text: Column) -> Column:
    """The events with evidence_found_verbatim in every impact."""
    hay = F.concat_ws("\n", title, text)
    return F.transform(events, lambda e: e.withField("impacts", F.transform(e["impacts"], lambda i: i.withField("evidence_found_verbatim", contains_quote(hay, i["evidence"])))))


def flat_impacts(articles: DataFrame, events: str, keep: list[str]) -> DataFrame:
    """keep, event_pos, impact_pos and the fields; an event without impacts has one row without impact fields."""
    at = articles.select(*keep, F.posexplode(events).alias("event_pos", "e")).where("e is not null")
    at = at.select(*keep, "event_pos", F.col("e.location").alias("location"), F.col("e.recency_in_months").alias("recency_in_months"), F.posexplode_outer("e.impacts").alias("impact_pos", "i"))
    return at.select(*keep, "event_pos", "impact_pos", "location", "recency_in_months", "i.*")
