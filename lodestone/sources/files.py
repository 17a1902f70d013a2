"""Files and payloads: scans, content hashes, names, validity; JSON lines; tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import clean_text
from ..operators.lineage import unused


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def binaries(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, content, sha256, length of each file; a missing path is an error."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content", content_hash(F.col("content")).alias("sha256"), "length")


def is_pdf(content: Column, most: int = 50 << 20) -> Column:
    """Within the size limit, and begins with the PDF mark."""
    return F.coalesce((F.length(content) <= most) & (F.substring(content, 1, 5) == F.lit(b"%PDF-")), F.lit(False))


def file_name(arxiv_id: Column, doi: Column, s2_id: Column) -> Column:
    """The first id there is, other characters as _, 50 at most, with .pdf."""
    some = F.coalesce(*[F.nullif(c, F.lit("")) for c in (arxiv_id, doi, s2_id)], F.lit("cand"))
    return F.concat(F.substring(F.regexp_replace(some, "(?U)[^\\p{Alnum}]", "_"), 1, 50), F.lit(".pdf"))


def access_url(df: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """df with access_url: the stored one, else the resolver's for the DOI (doi, url), else arXiv's."""
    arxiv = F.concat(F.lit("https://arxiv.org/pdf/"), F.nullif(F.col("arxiv_id"), F.lit("")), F.lit(".pdf"))
    if resolved is None:
        return df.withColumn("access_url", F.coalesce(F.nullif(F.col("oa_pdf_url"), F.lit("")), arxiv))
    url = unused(df, "url")
    out = df.join(resolved.select("doi", F.col("url").alias(url)), "doi", "left")
    return out.withColumn("access_url", F.coalesce(F.nullif(F.col("oa_pdf_url"), F.lit("")), url, arxiv)).drop(url)


def page_header(html: Column, url: Column) -> dict[str, Column]:
    """title (text of the first title element as written; empty if none) and host (with its port; empty for another scheme) of a web page."""
    return {"title": F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), "host": F.regexp_extract(url, r"^https?://([^/]+)", 1)}


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write_clean(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write with NUL characters taken out of every string. Overwriting replaces only the partitions at hand."""
    strings = {c: clean_text(F.col(c)) for c, t in df.dtypes if t == "string"}
    out = df.withColumns(strings) if strings else df
    writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def with_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Additive migration: missing columns as typed nulls, in the schema's order, others after."""
    new = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()]
    return df.select(*new, *[c for c in df.columns if c not in schema])


def remap_legacy(df: DataFrame, column: str = "data_availability") -> DataFrame:
    """The retired value proprietary reads unclear."""
    return df.withColumn(column, F.when(F.lower(F.trim(column)) == "proprietary", "unclear").otherwise(F.col(column)))


def latest(status: DataFrame, key: str, at: str) -> DataFrame:
    """Status updates as an append-only table: the last one of each key."""
    cols = [c for c in status.columns if c != key]
    return status.groupBy(key).agg(F.max_by(F.struct(*cols), at).alias("r")).select(key, "r.*")


def scan(df: DataFrame, equal: dict, order: list[str] | None = None) -> DataFrame:
    """Rows whose columns equal the given values (None: any value), in order. The filters reach the files."""
    for c, value in equal.items():
        if value is not None:
            df = df.filter(F.col(c) == value)
    return df.orderBy(*order) if order else df


def candidates_of(candidates: DataFrame, run) -> DataFrame:
    return scan(candidates, {"run_id": run}, ["rrf_rank"])


def chunks_of(chunks: DataFrame, run, paper=None, chunk_type: str | None = None) -> DataFrame:
    return scan(chunks, {"run_id": run, "paper_id": paper, "chunk_type": chunk_type}, ["chunk_index"])


def to_index(candidates: DataFrame, require_pdf: bool = False, pdf_text: str = "pdf_text") -> DataFrame:
    """candidates with text: the file's where there is one; else abstract or title, or, if a file is required, no row."""
    has = F.coalesce(F.col("pdf_path"), F.lit("")) != ""
    rows = candidates.filter(has) if require_pdf else candidates
    plain = F.coalesce(F.nullif(F.col("abstract"), F.lit("")), F.col("title"))
    return rows.withColumn("text", F.when(has, F.col(pdf_text)).otherwise(plain))
