"""Checks and roll-ups of nested assessment records, as columns: a violation is a string in an array, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = "array<struct<source_chunk_id:string,quote:string,section_title:string,page_number:int>>"
DATASET = f"struct<dataset_name:string,role:string,status:string,repository:string,accession:string,url:string,access_conditions:string,ownership:string,required_for_reproduction:boolean,evidence:{EVIDENCE}>"

# Statuses, roles, owners and the words that the rules look for.
STATUSES = ["publicly_available", "restricted", "not_available", "not_reported", "unclear"]
PAPER_STATUSES = [*STATUSES, "mixed"]
ROLES = ["primary", "validation", "benchmark", "derived", "supplementary", "unknown"]
OWNERS = ["public", "academic", "government", "commercial", "mixed", "unknown"]
CODE_HOSTS = ["github", "gitlab", "bitbucket"]
DATA_WORDS = ["dataset", "raw data", "study data", "counts", "matrices", "table", "supplement"]
IN_ARTICLE = ["article", "supplementary", "supplement", "additional file", "included in", "table", "attached", "available in the paper"]
NEGATIVE = ["cannot", "not available", "will not", "unable", "privacy", "restricted", "private", "no public", "withheld"]
ACCESS = ["available", "deposited", "accession", "gse", "sra", "download", "request"]


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _has(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def dataset_violations(d: Column) -> Column:
    """The rules that a dataset record breaks."""
    status, evidence = d["status"], F.coalesce(d["evidence"], F.array().cast(EVIDENCE))
    quotes = F.lower(F.array_join(F.transform(evidence, lambda e: e["quote"]), " "))
    none = F.size(evidence) == 0
    hosts = F.concat_ws(" ", F.lower(d["url"]), F.lower(d["repository"]))
    code = _any(hosts, CODE_HOSTS)
    open_ = status == "publicly_available"
    found = _has(d["url"]) | _has(d["accession"]) | (_has(d["repository"]) & ~code) | _any(quotes, IN_ARTICLE)
    denied = _any(F.concat_ws(" ", F.lower(d["access_conditions"]), quotes), NEGATIVE)
    rules = F.array(
        F.when(~status.isin(STATUSES) | status.isNull(), F.lit("unknown_status")),
        F.when((status != "not_reported") & none, F.lit("evidence_required")),
        F.when(open_ & code & ~_any(quotes, DATA_WORDS), F.lit("code_host_only")),
        F.when(open_ & ~found, F.lit("no_location")),
        F.when((status == "not_available") & ~denied, F.lit("no_denial")),
        F.when((status == "not_reported") & ~none & _any(quotes, ACCESS), F.lit("access_discussed")),
    )
    return F.filter(rules, lambda r: r.isNotNull())


def mixed_violation(overall: Column, statuses: Column) -> Column:
    """mixed without two different statuses."""
    kinds = F.array_distinct(statuses)
    return (overall == "mixed") & (F.size(F.array_remove(kinds, "not_reported")) < 2) & (F.size(kinds) < 2)


def overall_status(statuses: Column, has_evidence: Column) -> Column:
    """Roll-up of an array of dataset statuses."""
    kinds = F.array_distinct(F.coalesce(statuses, F.array().cast("array<string>")))
    real = F.array_remove(kinds, "not_reported")
    return (
        F.when(F.size(kinds) == 0, F.when(has_evidence, "unclear").otherwise("not_reported"))
        .when(F.size(real) == 0, "not_reported")
        .when(F.size(real) > 1, "mixed")
        .otherwise(F.when(F.get(real, 0).isin(STATUSES), F.get(real, 0)).otherwise("unclear"))
    )


def status_rollup(df: DataFrame, group: str, status: str, evidence: Column) -> DataFrame:
    """group, overall_status from one row a dataset."""
    return df.groupBy(group).agg(overall_status(F.collect_set(status), F.max(evidence)).alias("overall_status"))


def data_location(datasets: Column) -> Column:
    """Of the first dataset that has any: its url, else repository: accession, else its conditions."""
    filled = lambda c: F.nullif(c, F.lit(""))
    one = lambda d: F.coalesce(filled(d["url"]), F.concat(F.coalesce(filled(d["repository"]), F.lit("Accession")), F.lit(": "), filled(d["accession"])), filled(d["access_conditions"]))
    return F.get(F.filter(F.transform(datasets, one), lambda x: x.isNotNull()), 0)


def summary_violations(df: DataFrame, fields: list[str], summary: str = "paragraph_summary", status: str = "data_availability", most: int = 300) -> Column:
    words = F.size(F.filter(F.split(F.trim(summary), r"\s+"), lambda w: w != ""))
    rules = [F.when(~_has(F.col(c)), F.lit(f"{c}_empty")) for c in fields]
    rules += [F.when(words > most, F.lit("too_many_words")), F.when(F.col(summary).contains("\n"), F.lit("several_paragraphs")), F.when(~F.coalesce(F.lower(F.trim(status)).isin(PAPER_STATUSES), F.lit(False)), F.lit("unknown_status"))]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def evidence_checks(evidence: DataFrame, chunks: DataFrame, chunk: str = "source_chunk_id", quote: str = "quote", key: str = "id", text: str = "content") -> DataFrame:
    """evidence with verdict: ok, unknown_chunk, or not_in_chunk (white space and case aside)."""
    c = chunks.select(F.col(key).alias(chunk), F.col(text).alias("__text"))
    out = evidence.join(c, chunk, "left")
    return out.withColumn("verdict", F.when(F.col("__text").isNull(), "unknown_chunk").when(_collapsed(F.col("__text")).contains(_collapsed(F.col(quote))), "ok").otherwise("not_in_chunk")).drop("__text")


def critique_violations(c: Column) -> Column:
    rules = F.array(
        F.when(~F.coalesce(c["relevance_score"].between(0, 10), F.lit(False)), F.lit("relevance_score")),
        F.when(~F.coalesce(c["factual_grounding_score"].between(0, 10), F.lit(False)), F.lit("factual_grounding_score")),
        F.when(~F.coalesce(c["verdict"].isin("accepted", "marginal", "rejected"), F.lit(False)), F.lit("verdict")),
    )
    return F.filter(rules, lambda r: r.isNotNull())


def accepted_fail_safe(relevant: Column, verdict: Column, relevance: Column, grounding: Column, least: tuple[float, float] = (6.0, 7.0)) -> Column:
    """Without a critique: rejected."""
    return F.coalesce(relevant & verdict.isin("accepted", "marginal") & (relevance >= least[0]) & (grounding >= least[1]), F.lit(False))


def accepted_fail_open(verdict: Column) -> Column:
    """Without a critique: accepted."""
    return F.coalesce(verdict.isin("accepted", "marginal"), F.lit(True))


def verified_reference(df: DataFrame) -> DataFrame:
    """Flags of a bibliography entry, and whether it has a title of over 3 characters and authors or a year."""
    flags = {
        "has_title": F.length(F.trim(F.coalesce("title", F.lit("")))) > 3,
        "has_authors": F.coalesce(F.size("authors") > 0, F.lit(False)),
        "has_year": F.col("year").isNotNull(),
        "has_doi": _has(F.col("doi")),
        "has_arxiv": _has(F.col("arxiv_id")),
    }
    return df.withColumns(flags).withColumn("is_verified", F.col("has_title") & (F.col("has_authors") | F.col("has_year")))
