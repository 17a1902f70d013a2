"""Report rows and citations."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import year as year_of


def _year(df: DataFrame) -> Column:
    other = F.col("year") if "year" in df.columns else F.lit(None).cast("int")
    return year_of(F.col("publication_year"), other)


def bibtex_key(df: DataFrame) -> Column:
    """Surname of the first author, year, first title word of over 3 characters."""
    name = F.regexp_replace(F.lower(F.element_at(F.split(F.trim(F.coalesce(F.get("authors", F.lit(0)), F.lit("unknown"))), r"\s+"), -1)), r"(?U)[^\w]", "")
    words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("paper")), r"(?U)[^\w\s]", "")), r"\s+"), lambda w: F.length(w) > 3)
    return F.concat(name, F.coalesce(_year(df).cast("string"), F.lit("nodate")), F.coalesce(F.get(words, 0), F.lit("paper")))


def bibtex(df: DataFrame, keep_venue: bool = True) -> Column:
    """The given entry if it is one; else an @article. keep_venue=False drops a venue where there is no arXiv id."""
    arxiv = F.nullif(F.col("arxiv_id"), F.lit(""))
    venue = F.nullif(F.col("venue"), F.lit(""))
    journal = F.coalesce(venue, F.when(arxiv.isNotNull(), "arXiv preprint").otherwise("Publication")) if keep_venue else F.when(arxiv.isNotNull(), F.coalesce(venue, F.lit("arXiv preprint"))).otherwise("Publication")
    field = lambda name, c: F.concat(F.lit(f"  {name} = {{"), c, F.lit("}"))
    authors = F.coalesce(F.nullif(F.array_join("authors", " and "), F.lit("")), F.lit("Unknown Author"))
    fields = F.concat_ws(
        ",\n", field("title", F.coalesce("title", F.lit("Untitled Paper"))), field("author", authors), field("year", _year(df).cast("string")), field("journal", journal),
        field("doi", F.nullif(F.col("doi"), F.lit(""))), field("eprint", arxiv), F.when(arxiv.isNotNull(), F.lit("  archiveprefix = {arXiv}")),
    )
    made = F.concat(F.lit("@article{"), bibtex_key(df), F.lit(",\n"), fields, F.lit("\n}"))
    if "raw_bibtex" in df.columns:
        return F.when(F.col("raw_bibtex").contains("@"), F.trim("raw_bibtex")).otherwise(made)
    return made


def report_rows(candidates: DataFrame, papers: DataFrame, summaries: DataFrame, include_abstract_only: bool = False) -> DataFrame:
    """Candidates with their paper and summary, those without an accepted summary left out unless asked for."""
    s = summaries.withColumn("summary_accepted", F.coalesce("is_accepted", F.lit(True))).drop("run_id", "is_accepted")
    rows = candidates.join(papers.withColumnRenamed("id", "paper_id"), "paper_id").join(s, "candidate_paper_id", "left")
    return rows if include_abstract_only else rows.filter(F.coalesce("summary_accepted", F.lit(False)))


#: Parts of a summary, in a report's order, with their headings.
PARTS = {"problem_formulation": "Problem", "methodological_novelty": "Method", "empirical_findings": "Findings", "paragraph_summary": "Summary", "relationship_to_target": "Relationship to Target Paper"}


def _safe(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def card(df: DataFrame) -> Column:
    """A report row as HTML. Columns that df lacks, and empty ones, leave their line out; without a summary the abstract stands."""
    have = set(df.columns)
    text = lambda c: F.nullif(F.array_join(c, ", ") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string"), F.lit("")) if c in have else F.lit(None).cast("string")

    safe = _safe
    line = lambda before, c, after: F.concat(F.lit(before), c, F.lit(after))
    label = lambda name, c: line(f"<span class='badge'>{name}: ", safe(c), "</span>")
    link = lambda before, c, name: F.concat(F.lit(f"<a href='{before}"), safe(c), F.lit(f"'>{name}</a>"))
    year = F.coalesce(text("publication_year"), F.lit("N/A"))
    summary = F.coalesce(*[text(c) for c in PARTS])
    parts = [F.when(text(c).isNotNull(), F.concat(F.lit(f"<h3>{head}</h3><p>"), safe(text(c)), F.lit("</p>"))) for c, head in PARTS.items()]
    abstract = F.when(summary.isNull(), line("<p>", safe(F.coalesce(text("abstract"), F.lit("No abstract text available."))), "</p>"))
    score = F.when(text("abstract_relevance_score").isNotNull(), F.concat(F.lit("<span class='badge'>Abstract Relevance: "), text("abstract_relevance_score"), F.lit("/10 ("), F.upper(F.coalesce(text("abstract_relevance_tier"), F.lit(""))), F.lit(")</span>")))
    place = safe(text("data_location"))
    where = F.when(text("data_location").startswith("http"), F.concat(F.lit("<p><a href='"), place, F.lit("'>"), place, F.lit("</a></p>"))).otherwise(line("<p><code>", place, "</code></p>"))
    return F.concat_ws(
        "\n", F.lit("<section>"), line("<h2>", safe(F.coalesce(text("title"), F.lit("Untitled"))), "</h2>"), F.concat(F.lit("<p>"), F.coalesce(safe(text("authors")), F.lit("")), F.lit(" ("), year, F.lit("), <em>"), F.coalesce(safe(text("venue")), F.lit("Academic Venue")), F.lit("</em></p>")),
        line("<span class='badge'>Rank #", text("rrf_rank"), "</span>"), score, F.when(F.lower(text("is_open_access")) == "true", F.lit("<span class='badge'>Open Access</span>")), label("Verdict", text("self_critique_verdict")), label("Data", text("data_availability")),
        F.when(text("abstract_relevance_reasoning").isNotNull(), line("<p>", safe(text("abstract_relevance_reasoning")), "</p>")), *parts, abstract, where, F.when(text("oa_pdf_url").isNotNull(), link("", text("oa_pdf_url"), "View PDF")), F.when(text("doi").isNotNull(), link("https://doi.org/", text("doi"), "DOI Link")),
        line("<pre>", safe(text("bibtex")), "</pre>"), F.lit("</section>"),
    )


def render(cards: list[str], title: str, paper: dict | None = None, exclusion_status: str = "incomplete") -> str:
    """A run's page from its rows' cards (already cut to the report's size)."""
    esc = lambda x: html.escape("N/A" if x in (None, "") else str(x))
    p = paper or {}
    head = f"<p>Target Input Paper: <strong>{esc(p.get('title'))}</strong></p><p>DOI: {esc(p.get('doi'))} | arXiv: {esc(p.get('arxiv_id'))} | Year: {esc(p.get('publication_year'))} | Exclusion Status: {esc(exclusion_status)}</p>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(title)} - {esc(p.get('title'))}</title></head><body><h1>{esc(title)}</h1>\n{head}\n<h2>Discovered Related Literature ({len(cards)} Papers)</h2>\n" + "\n".join(cards) + "\n</body></html>"


def write_pages(rows: DataFrame, heads: DataFrame, path: str, run: str = "run_id", rank: str = "rrf_rank") -> None:
    """A page for each run of `heads`, as one text file under path/run=...: its head, its rows' cards by rank, its foot.

    heads: run, title, and what is known of paper_title, doi, arxiv_id, publication_year, exclusion_status. Rows of equal rank
    stand by their cards; rows of runs without a head are left out, a run without rows is a page without cards. Each run's rows
    are dealt to one task and sorted there, on disk if need be; nothing passes the driver.
    """
    said = lambda c: _safe(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("N/A"))) if c in heads.columns else F.lit("N/A")
    status = F.coalesce(F.nullif(F.col("exclusion_status"), F.lit("")), F.lit("incomplete")) if "exclusion_status" in heads.columns else F.lit("incomplete")
    cards = rows.select(F.col(run).alias("run"), F.col(rank).cast("double").alias("rank"), card(rows).alias("value"))
    n = cards.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    top = F.concat(
        F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), said("title"), F.lit(" - "), said("paper_title"), F.lit("</title></head><body><h1>"), said("title"), F.lit("</h1>\n<p>Target Input Paper: <strong>"), said("paper_title"),
        F.lit("</strong></p><p>DOI: "), said("doi"), F.lit(" | arXiv: "), said("arxiv_id"), F.lit(" | Year: "), said("publication_year"), F.lit(" | Exclusion Status: "), _safe(status), F.lit("</p>\n<h2>Discovered Related Literature ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" Papers)</h2>"),
    )
    runs = heads.withColumn("run", F.col(run)).join(n, "run", "left")
    lines = runs.select("run", F.lit(0).alias("place"), F.lit(0.0).alias("rank"), top.alias("value")).unionByName(heads.select(F.col(run).alias("run"), F.lit(2).alias("place"), F.lit(0.0).alias("rank"), F.lit("</body></html>").alias("value")))
    lines = lines.unionByName(cards.join(heads.select(F.col(run).alias("run")), "run", "left_semi").select("run", F.lit(1).alias("place"), "rank", "value"))
    placed = lines.repartition("run").sortWithinPartitions("run", "place", "rank", "value").select(F.col("run").alias(run), "value")
    placed.write.mode("overwrite").partitionBy(run).text(path)


def export(rows: DataFrame, title: str, paper: dict | None = None, exclusion_status: str = "incomplete", rank: str = "rrf_rank") -> str:
    """The page of one run's report rows, by rank, as a string: the caller's driver holds it (see write_pages for files)."""
    return render([r[0] for r in rows.withColumn("bibtex", bibtex(rows)).transform(lambda d: d.select(card(d).alias("card"), rank)).orderBy(rank).select("card").collect()], title, paper, exclusion_status)
