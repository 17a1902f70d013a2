"""Structured summaries by an injected model: prompts, replies in Arrow batches, parsing, checks, roll-ups, critique.

A model has three functions from prompt to reply: summary, availability, critique. It is called on the workers, a batch of
prompts at a time; an exception is a null reply. Whatever can't be parsed or breaks a rule is asked for again, `attempts`
times in all; then a summary is invalid, an availability reads not_reported, and a critique reads rejected with zero scores.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import tokens
from ..functions.normalize import year as year_of
from ..functions.text import SECTIONS, json_object, sections
from ..ship import ship
from . import availability, validate
from .lineage import checkpointed

ASSESSMENT = f"struct<datasets:array<{validate.DATASET}>,overall_status:string>"
CRITIQUE = "struct<is_relevant_to_seed_topic:boolean,relevance_score:double,factual_grounding_score:double,critique_rationale:string,verdict:string>"
NO_CHUNKS = "There is no full text; use the title and abstract."
HEADINGS = ", ".join(f"{heads[0]}:" for heads in SECTIONS.values())
AGAIN = f"\n\nThe reply must hold all of these headings: {HEADINGS}"


REPAIR = (
    "\n\nThe reply before this one broke a rule. Give one JSON object with datasets and overall_status. Every dataset that is reported needs evidence quoted from a chunk; an open one needs a url, accession or"
    " repository (code alone is not data); one that is not available needs the words that deny it; not_reported has no evidence of access."
)


class Model(Protocol):
    def summary(self, prompt: str) -> str: ...

    def availability(self, prompt: str) -> str: ...

    def critique(self, prompt: str) -> str: ...


class RuleModel:
    """A stand-in without a network: replies follow from words in the prompt. `malformed` gives no sections, `rejected` a bad critique."""

    def summary(self, prompt: str) -> str:
        if "malformed" in prompt:
            return "nothing of use"
        return "\n".join(f"{heads[0]}: This part follows from the given chunks." for heads in SECTIONS.values())

    def availability(self, prompt: str) -> str:
        found = re.search(r"\[id=(\S+)[^\n]*\n(?:(?!\[id=).)*?\b(GSE\d+)\b", prompt, re.S)
        if not found:
            return json.dumps({"datasets": [], "overall_status": "not_reported"})
        evidence = [{"source_chunk_id": found[1], "quote": found[2]}]
        return "```json\n" + json.dumps({"datasets": [{"dataset_name": found[2], "status": "publicly_available", "repository": "GEO", "accession": found[2], "evidence": evidence}]}) + "\n```"

    def critique(self, prompt: str) -> str:
        if "rejected" in prompt:
            return json.dumps({"is_relevant_to_seed_topic": False, "relevance_score": 1, "factual_grounding_score": 2, "verdict": "rejected"})
        return json.dumps({"is_relevant_to_seed_topic": True, "relevance_score": 8, "factual_grounding_score": 9, "verdict": "accepted"})


class PresetModel:
    """A stand-in whose replies follow from one preset: an availability status, malformed (nothing parses) or rejected.

    Evidence quotes the first chunk of the prompt.
    """

    #: Of each preset the datasets that its reply reports: status and what tells of it.
    DATASETS = {
        "publicly_available": [("publicly_available", {"url": "https://data.example.org/set", "repository": "Open store"})],
        "restricted": [("restricted", {"access_conditions": "On reasonable request."})],
        "not_available": [("not_available", {"access_conditions": "Cannot be shared, for privacy."})],
        "not_reported": [],
        "mixed": [("publicly_available", {"accession": "GSE12345"}), ("restricted", {"access_conditions": "After an agreement."})],
        "unclear": [("restricted", {"access_conditions": "From the authors."})],
    }

    def __init__(self, preset: str = "publicly_available"):
        self.preset = preset

    def summary(self, prompt: str) -> str:
        title = re.search(r"Title: (.+)", prompt)
        return "\n".join(f"{heads[0]}: What the paper {title[1] if title else 'at hand'} says of this." for heads in SECTIONS.values())

    def availability(self, prompt: str) -> str:
        if self.preset == "malformed":
            return "no JSON here"
        chunk = re.search(r"\[id=(\S+)[^\n]*\]\n([^\n]*)", prompt)
        quote = chunk[2][:50] if chunk else "Data are available."
        found = self.DATASETS.get(self.preset, self.DATASETS["unclear"])
        datasets = [{"dataset_name": f"Set {i}", "role": "primary" if i == 1 else "validation", "status": status, "evidence": [{"source_chunk_id": chunk[1] if chunk else "chunk-1", "quote": quote}], **told} for i, (status, told) in enumerate(found, 1)]
        return json.dumps({"datasets": datasets, "overall_status": self.preset})

    def critique(self, prompt: str) -> str:
        if self.preset == "malformed":
            return "{"
        good = self.preset != "rejected"
        return json.dumps({"is_relevant_to_seed_topic": good, "relevance_score": 8.5 if good else 3.0, "factual_grounding_score": 9.0 if good else 4.0, "verdict": "accepted" if good else "rejected", "critique_rationale": ""})


def trimmed(chunks: DataFrame, part: str, index: str, budget: int, text: str = "content", size: str = "token_count") -> DataFrame:
    """Whole chunks in order while they fit the budget; a first chunk that is larger than the budget is cut to it."""
    kept = availability.budgeted(chunks, [part], [F.col(index)], size, budget)
    cut = F.array_join(F.slice(tokens(F.col(text)), 1, budget), " ")
    return kept.withColumn(text, F.when(F.col(size) > budget, cut).otherwise(F.col(text))).withColumn(size, F.least(F.col(size), F.lit(budget)))


def prompts(papers: DataFrame, chunks: DataFrame, target: str, target_abstract: str, part: str = "paper_id", index: str = "chunk_index") -> DataFrame:
    """papers with prompt and retry_prompt (half of the chunks, and a reminder of the headings)."""
    whole = availability.formatted(chunks, part, index)
    half = availability.formatted(availability.first_half(chunks, [part], [F.col(index)]), part, index).withColumnRenamed("context", "__half")
    rows = papers.join(whole, part, "left").join(half, part, "left")
    year = year_of(F.col("publication_year"), F.lit(None).cast("int")).cast("string")
    authors = F.nullif(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", "), F.lit(""))
    head = F.concat(
        F.lit("Summarise this paper.\nTitle: "), F.coalesce("title", F.lit("Untitled")), F.lit("\nAuthors: "), F.coalesce(authors, F.lit("Unknown")), F.lit("\nYear: "), F.coalesce(year, F.lit("N/A")),
        F.lit(f"\nIts relation is sought to: {target}\n{target_abstract}\nUse these headings: {HEADINGS}\n\n"),
    )
    context = lambda c: F.coalesce(c, F.lit(NO_CHUNKS))
    return rows.withColumn("prompt", F.concat(head, context(F.col("context")))).withColumn("retry_prompt", F.concat(head, context(F.col("__half")), F.lit(AGAIN))).drop("__half")


def replies(prompt: Column, ask: Callable[[str], str]) -> Column:
    """The model's reply to each prompt; null for a null prompt or an exception."""

    def batch(ps: pd.Series) -> pd.Series:
        def one(p):
            try:
                return None if p is None else ask(p)
            except Exception:  # noqa: BLE001 - a failed call is a null reply
                return None

        return pd.Series([one(p) for p in ps], dtype="object")

    return F.pandas_udf(batch, "string")(prompt).alias("reply")


def _asked(df: DataFrame, name: str, ask: Callable[[str], str], parse: Callable[[Column], Column], prompt: str, again: str, attempts: int) -> DataFrame:
    """df with `name`: the parsed reply; later attempts ask only for rows that have none yet. Each attempt is written, so that
    no reply is asked for twice when a later step or a lost executor needs it again."""
    out = checkpointed(df.withColumn("__r", replies(F.col(prompt), ask)).withColumn(name, parse(F.col("__r"))))
    for _ in range(attempts - 1):
        more = out.withColumn("__r", replies(F.when(F.col(name).isNull(), F.col(again)), ask))
        out = checkpointed(more.withColumn(name, F.coalesce(name, parse(F.col("__r")))))
    return out.drop("__r")


def parsed_summary(reply: Column) -> Column:
    """Struct of all sections, null unless each is there."""
    s = sections(F.coalesce(reply, F.lit("")))
    whole = F.lit(True)
    for c in s.values():
        whole = whole & c.isNotNull()
    return F.when(whole, F.struct(*[c.alias(k) for k, c in s.items()]))


def parsed_availability(reply: Column) -> Column:
    """The assessment, null unless it parses and no dataset breaks a rule."""
    a = F.from_json(json_object(reply), ASSESSMENT)
    datasets = F.coalesce(a["datasets"], F.array().cast(f"array<{validate.DATASET}>"))
    good = F.forall(datasets, lambda d: F.size(validate.dataset_violations(d)) == 0)
    return F.when(reply.isNotNull() & (a["datasets"].isNotNull() | a["overall_status"].isNotNull()) & good, F.struct(datasets.alias("datasets")))


def parsed_critique(reply: Column) -> Column:
    c = F.from_json(json_object(reply), CRITIQUE)
    return F.when(reply.isNotNull() & (F.size(validate.critique_violations(c)) == 0), c)


def summarized(rows: DataFrame, model: Model, attempts: int = 2, least: tuple[float, float] = (6.0, 7.0)) -> DataFrame:
    """rows (prompt, retry_prompt, context) with is_valid, the sections, data_availability, data_location, the critique, is_accepted."""
    ship(rows.sparkSession)
    out = _asked(rows, "__s", model.summary, parsed_summary, "prompt", "retry_prompt", attempts)
    out = out.withColumn("is_valid", F.col("__s").isNotNull()).select("*", *[F.col("__s")[k].alias(k) for k in SECTIONS]).drop("__s")
    out = out.withColumn("__c", F.when(F.col("is_valid"), F.coalesce("context", F.lit(NO_CHUNKS))))
    out = out.withColumn("__more", F.concat("__c", F.lit(REPAIR)))
    out = _asked(out, "__a", model.availability, parsed_availability, "__c", "__more", attempts).drop("__more")
    datasets = F.col("__a.datasets")
    evidence = F.coalesce(F.exists(datasets, lambda d: F.size(d["evidence"]) > 0), F.lit(False))
    out = out.withColumn("data_availability", validate.overall_status(F.transform(datasets, lambda d: d["status"]), evidence)).withColumn("data_location", validate.data_location(datasets)).drop("__a")
    about = F.when(F.col("is_valid"), F.concat_ws("\n\n", F.col("title"), F.col("paragraph_summary"), F.col("__c")))
    out = _asked(out.withColumn("__q", about), "__k", model.critique, parsed_critique, "__q", "__q", 1)
    k = F.col("__k")
    out = out.withColumns({"relevance_score": F.coalesce(k["relevance_score"], F.lit(0.0)), "factual_grounding_score": F.coalesce(k["factual_grounding_score"], F.lit(0.0)), "verdict": F.coalesce(k["verdict"], F.lit("rejected"))})
    accepted = validate.accepted_fail_safe(k["is_relevant_to_seed_topic"], F.col("verdict"), F.col("relevance_score"), F.col("factual_grounding_score"), least)
    return out.withColumn("is_accepted", F.col("is_valid") & accepted).drop("__c", "__q", "__k")
