"""Scholarly records: TEI headers and bibliographies, and works as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions import normalize as N
from ..functions.text import inverted_abstract
from ..ship import ship
from . import tei


HEADER = "title string, abstract string, authors array<string>, doi string, arxiv_id string, publication_year int"
REFERENCE = "pos int, raw_citation string, title string, authors array<string>, doi string, arxiv_id string, year int, extraction_method string"


def tei_header(xml: Column) -> dict[str, Column]:
    """The paper's own data, from the header alone, never from what it cites; from the whole document if it has no header.
    A null document is one without any data. All fields come from one parse."""

    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tei.header(x) for x in texts], columns=[c.split(" ")[0] for c in HEADER.split(", ")], dtype=object)

    found = F.pandas_udf(read, HEADER)(xml)
    return {c.split(" ")[0]: found[c.split(" ")[0]] for c in HEADER.split(", ")}


def tei_references(df: DataFrame, xml: str = "xml", key: str = "id") -> DataFrame:
    """key, pos, raw_citation, title, authors, doi, arxiv_id, year, extraction_method: a row for each biblStruct.

    They stand in the first listBibl, else in the back matter, else anywhere. A title is the article's (level a), else the
    monograph's (m), else one without a level; the year is that of the first date, wherever it stands.
    """
    ship(df.sparkSession)
    rows = df.select(key, xml)
    kind = rows.schema[key].dataType
    types = to_arrow_schema(StructType([StructField(key, kind), *StructType.fromDDL(REFERENCE)]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, r) for i, x in enumerate(batch.column(1).to_pylist()) for r in tei.references(x)]
            of = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            columns = [pa.array([r[f.name] for _, r in found], f.type) for f in list(types)[1:]]
            yield pa.RecordBatch.from_arrays([of, *columns], names=types.names)

    return rows.mapInArrow(read, StructType([StructField(key, kind), *StructType.fromDDL(REFERENCE)]))


WORK = (
    "id string, doi string, display_name string, title string, ids map<string,string>, authorships array<struct<author:struct<display_name:string>>>, publication_year int, biblio struct<pub_year:int>,"
    " primary_location struct<source:struct<display_name:string>>, open_access struct<is_oa:boolean,oa_url:string>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
)


def works(df: DataFrame, json: str = "json") -> DataFrame:
    """Works' JSON as typed rows."""
    w = df.select(F.from_json(json, WORK).alias("w"))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    return w.select(
        F.coalesce("w.display_name", "w.title", F.lit("")).alias("title"),
        F.filter(F.transform("w.authorships", lambda a: a["author"]["display_name"]), lambda x: F.coalesce(x, F.lit("")) != "").alias("authors"),
        N.doi(F.col("w.doi")).alias("doi"), N.arxiv(last(F.col("w.ids")["arxiv"])).alias("arxiv_id"), F.nullif(last(F.col("w.id")), F.lit("")).alias("openalex_id"),
        N.year(F.col("w.publication_year"), F.col("w.biblio.pub_year")).alias("publication_year"), F.col("w.primary_location.source.display_name").alias("venue"),
        inverted_abstract(F.col("w.abstract_inverted_index")).alias("abstract"), F.coalesce("w.open_access.is_oa", F.lit(False)).alias("is_open_access"),
        F.col("w.open_access.oa_url").alias("oa_pdf_url"), F.coalesce("w.referenced_works", F.array().cast("array<string>")).alias("referenced_works"),
    )


RECORD = "paperId string, title string, externalIds struct<DOI:string,ArXiv:string>, authors array<struct<name:string>>, year int, venue string, abstract string, isOpenAccess boolean, openAccessPdf struct<url:string>"


def semantic_records(df: DataFrame, json: str = "json") -> DataFrame:
    """Records of a search's or recommendation's reply (JSON with the records under data or recommendedPapers, or one record)."""
    reply = F.from_json(json, f"data array<struct<{_typed(RECORD)}>>, recommendedPapers array<struct<{_typed(RECORD)}>>, {RECORD}")
    one = F.struct(*[F.col("w")[c].alias(c) for c in ("paperId", "title", "externalIds", "authors", "year", "venue", "abstract", "isOpenAccess", "openAccessPdf")])
    r = df.select(reply.alias("w")).select(F.explode(F.coalesce("w.data", "w.recommendedPapers", F.when(F.col("w.paperId").isNotNull(), F.array(one)))).alias("r"))
    names = F.transform(F.coalesce("r.authors", F.array().cast("array<struct<name:string>>")), lambda a: a["name"])
    return r.select(
        F.coalesce("r.title", F.lit("")).alias("title"), F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "").alias("authors"), N.doi(F.col("r.externalIds.DOI")).alias("doi"), N.arxiv(F.col("r.externalIds.ArXiv")).alias("arxiv_id"),
        F.col("r.paperId").alias("s2_id"), F.col("r.year").alias("publication_year"), F.col("r.venue").alias("venue"), F.col("r.abstract").alias("abstract"), F.coalesce("r.isOpenAccess", F.lit(False)).alias("is_open_access"), F.col("r.openAccessPdf.url").alias("oa_pdf_url"),
    )


def _typed(schema: str) -> str:
    """A list of columns as the fields of a struct."""
    return ",".join(f"{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}" for x in schema.split(", "))
