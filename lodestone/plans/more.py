"""Registered queries over matching by title, lookups, scans, filters, counts, injected models and report cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import availability, candidates, chunk, embed, exclude, expand, fuse, inverted, match, quota, report, screen, summarize, validate
from ..operators.lineage import dealt, run_path
from ..sources import files, paper_text, scholarly, store
from .papers import abstract_sql
from .queries import CLEAN_MACRO, ORACLES, SEARCH, SEED, TOKENS, query, table


def _k(c: str):
    return F.col(c).cast("string")


def _null(kind: str = "string"):
    return F.lit(None).cast(kind)


def _titled(spark, sf_dir) -> DataFrame:
    """Parts as papers under a long title, one for each name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Observations Concerning the "), F.md5("p_name"), F.lit(" Production: Line")).alias("title"), _null("int").alias("publication_year"), _null().alias("doi"))


def _retitled(spark, sf_dir) -> DataFrame:
    """Suppliers as papers of the part of their number: the same title, one with more words, and one with another ending."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    s = table(spark, sf_dir, "supplier").join(p, "s_suppkey")
    kind = F.col("s_suppkey") % 3
    title = F.when(kind == 0, F.concat(F.lit("observations concerning the "), F.md5("p_name"), F.lit(" production line!"))).when(kind == 1, F.concat(F.lit("On observations concerning the old "), F.md5("p_name"), F.lit(" production line, revisited")))
    title = title.otherwise(F.concat(F.lit("Observations concerning the "), F.md5("p_name"), F.lit(" productions line")))
    return s.select(F.col("s_suppkey").alias("id"), title.alias("title"), _null("int").alias("publication_year"), _null().alias("doi"))


#: A title has 76 characters in six words; one letter more makes 152 of 153 alike.
ALIKE = """(SELECT s_suppkey AS l, b.p_partkey AS r, CASE WHEN s_suppkey % 3 = 2 THEN round(152.0 / 153, 6) ELSE 1.0 END AS ratio
FROM supplier JOIN part a ON a.p_partkey = s_suppkey JOIN part b ON b.p_name = a.p_name)"""


@query(f"SELECT l, r, CAST(ratio AS DOUBLE) AS ratio FROM {ALIKE}")
def fuzzy_titles_near(spark, sf_dir):
    """Titles that are equal, part of one another, or one letter apart."""
    return match.title_matches(_retitled(spark, sf_dir), _titled(spark, sf_dir), digits=6)


#: Suppliers' codes of two or three letters that a part's code of three becomes by losing one letter, or is.
SHORT = """SELECT s_suppkey AS l, p_partkey AS r, CASE WHEN s_suppkey % 2 = 0 THEN round(28.0 / 29, 6) ELSE 1.0 END AS ratio
FROM (SELECT s_suppkey, substr(md5(p_name), 1, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 3 END) AS code FROM supplier JOIN part ON p_partkey = s_suppkey),
(SELECT p_partkey, substr(md5(p_name), 1, 3) AS c FROM part) WHERE code IN (c, substr(c, 1, 2), substr(c, 2, 2), substr(c, 1, 1) || substr(c, 3, 1))"""


@query(f"SELECT l, r, CAST(ratio AS DOUBLE) AS ratio FROM ({SHORT})")
def short_titles(spark, sf_dir):
    """Short titles that share all words but one: equal, or a letter apart."""
    code = lambda n: F.concat(F.lit("A Survey of "), F.substr(F.md5("p_name"), F.lit(1), F.lit(n)))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", code(3).alias("title"))
    s = table(spark, sf_dir, "supplier").join(p.withColumnRenamed("id", "s_suppkey"), "s_suppkey").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, code(2)).otherwise(code(3)).alias("title"))
    return match.title_matches(s, p, digits=6)


@query(f"SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT r FROM {ALIKE}) AND p_partkey > 40")
def exclusion_by_title(spark, sf_dir):
    """Neither cited under a like title nor the seed, whose identifiers some share."""
    parts = _titled(spark, sf_dir).withColumn("doi", F.when(F.col("id") <= 40, "10.1/seed"))
    seed = spark.range(1).select(F.lit(-1).cast("long").alias("id"), _null().alias("title"), _null("int").alias("publication_year"), F.lit("https://doi.org/10.1/SEED").alias("doi"))
    return exclude.exclude(parts, seed, _retitled(spark, sf_dir)).select("id")


@query("SELECT min(p_partkey) AS id, arg_min(p_brand, p_partkey) AS venue, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS source_apis FROM part GROUP BY p_name")
def dedup_by_title(spark, sf_dir):
    """One record for each title, with the sources that list it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.upper("p_name").alias("title"), _null("int").alias("publication_year"), _null().alias("doi"), F.col("p_brand").alias("venue"), F.col("p_type").alias("source"))
    return fuse.deduplicated(p, ["pos"], source="source").select("id", "venue", F.array_join("source_apis", ",").alias("source_apis"))


@query("SELECT p_partkey AS id, p_partkey % 3 <> 0 AS resolved_ok FROM part")
def title_identity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" revisited")).alias("title"), F.when(F.col("p_partkey") % 3 == 0, "quite another work").otherwise(F.concat(F.upper("p_name"), F.lit(": Revisited!"))).alias("resolved_title"))
    return match.same_identity(p).select("id", "resolved_ok")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 50 WHEN 1 THEN p_partkey % 60 WHEN 2 THEN p_partkey % 70 END AS wanted, CASE WHEN wanted < (SELECT count(*) FROM supplier) THEN wanted END AS found FROM part""")
def get_work(spark, sf_dir):
    """OpenAlex before DOI before arXiv, however each is written; the first that a row has decides alone."""
    k, by = F.col("p_partkey"), F.col("p_partkey") % 4
    pad = lambda c: F.concat(F.lit("2301."), F.lpad(c.cast("string"), 5, "0"))
    p = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(by == 0, F.concat(F.lit(" https://openalex.org/w"), (k % 50).cast("string"))).otherwise("").alias("openalex_id"),
        F.when(by == 0, "10.1/none").when(by == 1, F.concat(F.lit("DOI:10.1/X"), (k % 60).cast("string"), F.lit("/"))).alias("doi"), F.when(by < 2, "2301.99999").when(by == 2, F.concat(F.lit("arXiv:"), pad(k % 70), F.lit("v3"))).alias("arxiv_id"),
        F.when(by == 0, k % 50).when(by == 1, k % 60).when(by == 2, k % 70).alias("wanted"),
    )
    w = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("W"), _k("s_suppkey")).alias("openalex_id"), F.concat(F.lit("https://doi.org/10.1/x"), _k("s_suppkey")).alias("doi"), pad(F.col("s_suppkey")).alias("arxiv_id"))
    return match.get_work(p, w).select("id", "wanted", "found")


@query("""SELECT 'p' || p_partkey AS s2_id, p_name AS title, '10.1/' || lower(p_brand) AS doi, CASE WHEN p_partkey % 2 = 0 THEN '2301.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS arxiv_id, p_brand || '|' || p_type AS authors, CAST(1990 + p_size AS INTEGER) AS publication_year,
p_partkey % 3 = 0 AS is_open_access, CASE WHEN p_partkey % 3 = 0 THEN 'https://host/' || p_partkey END AS oa_pdf_url FROM part""")
def semantic_parse(spark, sf_dir):
    """Search replies (under data) and recommendations (under recommendedPapers) of one record each."""
    k = F.col("p_partkey")
    ids = F.struct(F.concat(F.lit("https://doi.org/10.1/"), "p_brand").alias("DOI"), F.when(k % 2 == 0, F.concat(F.lit("2301."), F.lpad(_k("p_partkey"), 5, "0"))).alias("ArXiv"))
    names = F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.col("p_type").alias("name")))
    record = F.struct(F.concat(F.lit("p"), _k("p_partkey")).alias("paperId"), F.col("p_name").alias("title"), ids.alias("externalIds"), names.alias("authors"), (F.col("p_size") + 1990).alias("year"), F.when(k % 3 == 0, True).alias("isOpenAccess"), F.when(k % 3 == 0, F.struct(F.concat(F.lit("https://host/"), _k("p_partkey")).alias("url"))).alias("openAccessPdf"))
    reply = F.when(k % 2 == 0, F.to_json(F.struct(F.array(record).alias("data")))).otherwise(F.to_json(F.struct(F.array(record).alias("recommendedPapers"))))
    out = scholarly.semantic_records(table(spark, sf_dir, "part").select(reply.alias("json")))
    return out.select("s2_id", "title", "doi", "arxiv_id", F.array_join("authors", "|").alias("authors"), "publication_year", "is_open_access", "oa_pdf_url")


@query("""SELECT p_partkey AS id, p_name AS title, 'Ann ' || p_brand || '|' || p_type AS authors, 'On ' || p_name || ' and more.' AS abstract, CAST(1990 + p_size AS INTEGER) AS publication_year, '2301.00001' AS arxiv_id FROM part""")
def tei_authors(spark, sf_dir):
    """Headers with full names; every second document has its data without a header."""
    person = F.concat(F.lit("<author><persName xml:id='x'><forename type='first'>Ann</forename><forename type='middle'>B</forename><surname>"), "p_brand", F.lit("</surname></persName></author><author><email>x</email></author><author><persName><surname>"), "p_type", F.lit("</surname></persName></author>"))
    data = F.concat(F.lit("<title level='a' type='main'>"), "p_name", F.lit("</title>"), person, F.lit("<idno type='arXiv'>2301.00001</idno><date when='"), (F.col("p_size") + 1990).cast("string"), F.lit("'/><abstract><p>On <hi>"), "p_name", F.lit("</hi>\n and more.</p></abstract>"))
    h = scholarly.tei_header(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<TEI><teiHeader>"), data, F.lit("</teiHeader><text><title type='main'>No</title></text></TEI>"))).otherwise(F.concat(F.lit("<TEI>"), data, F.lit("</TEI>"))))
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), h["title"].alias("title"), F.array_join(h["authors"], "|").alias("authors"), h["abstract"].alias("abstract"), h["publication_year"].alias("publication_year"), h["arxiv_id"].alias("arxiv_id"))


def _marked_up(spark, sf_dir) -> DataFrame:
    """Parts as TEI with a prefix, references, CDATA, comments, instructions and elements within elements."""
    head = F.concat(F.lit("<t:title type='main'>Caf&#233; &#x41;&amp;B <![CDATA[x<y]]> <t:hi>of</t:hi> "), "p_name", F.lit("</t:title><t:idno type='doi'>10.1/&lt;<!-- x -->"), _k("p_partkey"), F.lit("</t:idno><t:abstract><t:div><t:p>On <t:hi>its <t:hi>own</t:hi></t:hi>.</t:p><t:p>More&nbsp;"), "p_type", F.lit("</t:p></t:div></t:abstract>"))
    cited = F.concat(F.lit("<t:biblStruct><t:analytic><!-- <t:title level='a'>No</t:title> --><t:title t:level='a'><![CDATA[A & B: ]]>"), "p_type", F.lit("</t:title><t:author><t:persName><t:forename type='first'>Zo&#235;</t:forename><t:surname>"), "p_brand", F.lit("</t:surname></t:persName></t:author></t:analytic><t:monogr><t:imprint><t:date when='1999-01'/></t:imprint></t:monogr></t:biblStruct>"))
    xml = F.concat(F.lit("<?xml version='1.0' encoding='UTF-8'?>\n<!DOCTYPE TEI>\n<t:TEI xmlns:t='http://www.tei-c.org/ns/1.0'><!-- <teiHeader><title type='main'>No</title><abstract>No</abstract></teiHeader> --><t:teiHeader>"), head, F.lit("</t:teiHeader><t:text><t:back><t:listBibl>"), cited, F.lit("</t:listBibl></t:back></t:text>"))
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), F.concat(xml, F.when(F.col("p_partkey") % 5 == 0, F.lit("<unclosed>")).otherwise(F.lit("</t:TEI>"))).alias("xml"))


@query("SELECT p_partkey AS id, 'Café A&B x<y of ' || p_name AS title, '10.1/<' || p_partkey AS doi, 'On its own . More ' || p_type AS abstract FROM part")
def tei_header_markup(spark, sf_dir):
    h = scholarly.tei_header(F.col("xml"))
    return _marked_up(spark, sf_dir).select("id", h["title"].alias("title"), h["doi"].alias("doi"), h["abstract"].alias("abstract"))


@query("SELECT p_partkey AS id, 0 AS pos, 'A & B: ' || p_type AS title, 'Zoë ' || p_brand AS author, 1999 AS year, 'A & B: ' || p_type || ' Zoë ' || p_brand AS raw_citation FROM part")
def tei_references_markup(spark, sf_dir):
    return scholarly.tei_references(_marked_up(spark, sf_dir)).select("id", "pos", "title", F.get("authors", F.lit(0)).alias("author"), "year", "raw_citation")


@query("""SELECT p_partkey AS id, 0 AS pos, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'Bo ' || p_brand END AS author, CAST(1990 + p_size AS INTEGER) AS year, trim(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Bo ' || p_brand ELSE '' END || ' & sons ' || p_type) AS raw_citation FROM part""")
def tei_references_anywhere(spark, sf_dir):
    """Citations in a list, in back matter without one, or in neither; titles of level m; raw citations."""
    author = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<author><persName><forename type='first'>Bo</forename><surname>"), "p_brand", F.lit("</surname></persName></author>"))).otherwise("")
    one = F.concat(F.lit("<biblStruct xml:id='b'><monogr><title level='m'>"), "p_name", F.lit("</title>"), author, F.lit("<publisher>&amp; sons</publisher></monogr><series><date when='"), (F.col("p_size") + 1990).cast("string"), F.lit("-05'>"), "p_type", F.lit("</date></series></biblStruct>"))
    where = F.col("p_partkey") % 3
    xml = F.when(where == 0, F.concat(F.lit("<TEI><back><listBibl>"), one, F.lit("</listBibl></back></TEI>"))).when(where == 1, F.concat(F.lit("<TEI><back><div>"), one, F.lit("</div></back></TEI>"))).otherwise(F.concat(F.lit("<TEI>"), one, F.lit("</TEI>")))
    out = scholarly.tei_references(dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), xml.alias("xml")))
    return out.select("id", "pos", "title", F.get("authors", F.lit(0)).alias("author"), "year", "raw_citation")


@query("SELECT * FROM (SELECT s_suppkey AS id, row_number() OVER (PARTITION BY s_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos, 'W' || l_partkey AS ref FROM supplier JOIN lineitem ON l_suppkey = s_suppkey) WHERE pos < 100")
def first_references(spark, sf_dir):
    """The first hundred references of each work."""
    cites = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("W"), x["l_partkey"].cast("string"))).alias("referenced_works"))
    works = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(cites, "id")
    return expand.references(works).select("id", F.col("pos").cast("long").alias("pos"), "ref")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 IN (0, 1) THEN 'complete' ELSE 'incomplete' END AS exclusion_status FROM part")
def bibliography_complete(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    refs = p.filter("id % 7 = 0").select(F.col("id").alias("source_paper_id")).unionByName(p.filter("id % 7 = 1").select(F.col("id").alias("source_paper_id")))
    return exclude.bibliography_status(p, refs)


@query("""SELECT p_partkey AS id, policy, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN policy = 'drop' THEN 0.0 ELSE 5.0 END WHEN p_partkey % 4 = 1 THEN 10.0 ELSE 6.0 END::DOUBLE AS score,
CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN policy = 'drop' THEN 'irrelevant' ELSE 'moderate' END WHEN p_partkey % 4 = 1 THEN 'high' ELSE 'moderate' END AS tier FROM part, (VALUES ('pass'), ('drop')) p(policy)""")
def missing_abstracts(spark, sf_dir):
    """Blank abstracts under either policy."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 4 == 0, F.when(k % 8 == 0, " \n").otherwise(_null())).otherwise(F.col("p_name")).alias("abstract"), F.when(k % 4 == 1, F.array(F.lit(2.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8))).alias("embedding"))
    seed = spark.range(1).select(F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    out = [screen.scored(p, seed, policy).select("id", F.lit(policy).alias("policy"), F.col("abstract_relevance_score").alias("score"), F.col("abstract_relevance_tier").alias("tier")) for policy in ("pass", "drop")]
    return out[0].unionByName(out[1])


@query("""SELECT p_partkey AS id, p_partkey % 3 = 0 AND len(list_distinct(list_filter(s, lambda x: x <> 'not_reported'))) < 2 AND len(list_distinct(s)) < 2 AS broken
FROM (SELECT p_partkey, [['restricted', 'restricted'], ['restricted', 'not_reported'], ['restricted', 'unclear'], ['not_reported', 'not_reported']][p_partkey % 4 + 1] AS s FROM part)""")
def mixed_rule(spark, sf_dir):
    k = F.col("p_partkey")
    kinds = [["restricted", "restricted"], ["restricted", "not_reported"], ["restricted", "unclear"], ["not_reported", "not_reported"]]
    s = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in kinds]), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), validate.mixed_violation(F.when(k % 3 == 0, "mixed").otherwise("unclear"), s).alias("broken"))


@query(f"SELECT doc_id, chunk_index, CASE WHEN chunk_type = 'child' THEN max(CASE WHEN chunk_type = 'parent' THEN chunk_index END) OVER (PARTITION BY doc_id ORDER BY chunk_index) END AS parent_index FROM ({ORACLES['clean_chunks']})")
def chunk_parents(spark, sf_dir):
    """Each child's parent."""
    return chunk.chunks(table(spark, sf_dir, "documents")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("parent_index").cast("long").alias("parent_index"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def register_once(spark, sf_dir):
    """The first row of each key stays."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return fuse.keep_first(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT user_id AS id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS source_apis,
arg_min(CAST(event_id AS VARCHAR), event_id) FILTER (event_id % 3 = 0) AS venue FROM events GROUP BY user_id""")
def source_sets(spark, sf_dir):
    """The sources that list an entity, and its first value that isn't empty."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 == 0, _k("event_id")).otherwise("").alias("venue"), F.col("event_type").alias("source"))
    return fuse.merged(e, "id", ["pos"], "source").select("id", F.array_join("source_apis", ",").alias("source_apis"), "venue")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'https://host/' || p_partkey WHEN 1 THEN 'Store: A' || p_partkey WHEN 2 THEN 'Accession: A' || p_partkey WHEN 3 THEN 'ask' END AS location FROM part""")
def data_locations(spark, sf_dir):
    """Of the first data set that has one: its url, its accession, its conditions; a first one without any is passed over."""
    k, kind = _k("p_partkey"), F.col("p_partkey") % 5
    field = {"url": F.when(kind == 0, F.concat(F.lit("https://host/"), k)).otherwise(""), "repository": F.when(kind == 1, "Store"), "accession": F.when(kind.isin(0, 1, 2), F.concat(F.lit("A"), k)), "access_conditions": F.when(kind < 4, "ask")}
    first = F.struct(*[_null().alias(c) for c in field])
    datasets = F.array(first, F.struct(*[c.alias(n) for n, c in field.items()]), F.struct(F.lit("https://late").alias("url"), *[_null().alias(c) for c in list(field)[1:]]))
    datasets = F.when(kind == 4, F.array(first)).otherwise(datasets)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), validate.data_location(datasets).alias("location"))


#: A phrase for each of the patterns of where data are.
SAYINGS = (
    "Data  Availability,availability of data and materials,data sharing,DATA ACCESS,code and data availability,Supplementary Data,GSE12345,SRR99,PRJNA12,phs000123.v2.p1,EGAD01,PXD77,E-MTAB-12,ds0042,syn55,MTBLS9,"
    "available upon reasonable request,controlled access,managed access,data-use agreement,data access committee,application required,authorization,credentialed access,cannot be shared,not publicly available,privacy restriction,ethical restrictions,deposited in,accession,xGSE1 nodata"
).split(",")


def _points(text: str) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN {points} ELSE 0 END" for patterns, points in availability.GROUPS for p in patterns)


@query(f"SELECT doc_id, CAST({_points('t')} AS DOUBLE) AS score FROM (SELECT doc_id, text || ' ' || {SAYINGS!r}[doc_id % {len(SAYINGS)} + 1] || ' and ' || {SAYINGS!r}[doc_id * 7 % {len(SAYINGS)} + 1] || '.' AS t FROM documents)")
def availability_patterns(spark, sf_dir):
    """All patterns, each with a phrase in some documents."""
    said = F.array(*map(F.lit, SAYINGS))
    at = lambda c: F.element_at(said, (c % len(SAYINGS) + 1).cast("int"))
    text = F.concat("text", F.lit(" "), at(F.col("doc_id")), F.lit(" and "), at(F.col("doc_id") * 7), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", availability.pattern_score(text).alias("score"))


@query("""WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS n FROM part)
SELECT id, n AS source_rank FROM a WHERE n <= 30 UNION ALL SELECT id, n + 30 FROM b WHERE n <= 20""")
def continued_ranks(spark, sf_dir):
    """Two lists of one source end to end."""
    p = table(spark, sf_dir, "part")
    top = lambda c, n: fuse.ranked(p.orderBy(F.desc(c), "p_partkey").limit(n), [F.desc(c), F.col("p_partkey")], name="source_rank").select(F.col("p_partkey").alias("id"), F.col("source_rank").cast("long").alias("source_rank"))
    return fuse.bag(top("p_retailprice", 30), top("p_size", 20))


@query("SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations) AND role = 'user' ORDER BY turn")
def chunk_scan(spark, sf_dir):
    """The chunks of one run and type, in order."""
    c = table(spark, sf_dir, "conversations")
    run = c.agg(F.max("conv_id")).first()[0]
    chunks = c.select(F.col("conv_id").alias("run_id"), F.lit(1).alias("paper_id"), F.col("role").alias("chunk_type"), F.col("turn").alias("chunk_index"), "text")
    return files.chunks_of(chunks, run, 1, "user").select(F.col("run_id").alias("conv_id"), F.col("chunk_index").alias("turn"), F.md5("text").alias("digest"))


@query("""SELECT p_partkey AS id, required, CASE WHEN p_partkey % 2 = 0 THEN 'file ' || p_partkey WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS text FROM part, (VALUES (true), (false)) r(required) WHERE p_partkey % 2 = 0 OR NOT required""")
def texts_to_index(spark, sf_dir):
    """With and without the condition that a file is there."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 2 == 0, F.lit("/x.pdf")).otherwise("").alias("pdf_path"), F.concat(F.lit("file "), _k("p_partkey")).alias("pdf_text"), F.when(k % 3 == 0, F.col("p_type")).otherwise("").alias("abstract"), F.col("p_name").alias("title"))
    one = lambda required: files.to_index(p, required).select("id", F.lit(required).alias("required"), "text")
    return one(True).unionByName(one(False))


@query("""WITH q AS (SELECT source AS run_id, doc_id AS id, coalesce(quality = 1 AND toxic = 0, false) AS ok FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id) AS position, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT run_id, count(*) AS looked_at, count(*) AS evaluated, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS accepted, count(*) - CAST(sum(CAST(ok AS INT)) AS BIGINT) AS pruned FROM n WHERE before < 20 AND position <= 100 GROUP BY run_id""")
def quota_counters(spark, sf_dir):
    """What each run's loop comes to."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("source").alias("run_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), "quality", "toxic")
    return quota.counters(quota.one_round(d, (F.col("quality") == 1) & (F.col("toxic") == 0)))


@query("SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 0.6 ELSE 1.0 END::DOUBLE AS x, CASE WHEN length(text) % 2 = 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS y FROM documents")
def embedded_texts(spark, sf_dir):
    """Unit vectors from an injected model, here one of two by a text's length."""
    e = embed.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", lambda texts: [[3.0, 4.0] if len(t) % 2 == 0 else [7.0, 0.0] for t in texts])
    return e.select("doc_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("x"), F.round(F.get("embedding", F.lit(1)).cast("double"), 4).alias("y"))


@query("""SELECT s_suppkey AS id, s_suppkey % 3 <> 0 AS is_valid, CASE WHEN s_suppkey % 3 = 0 THEN 'not_reported' WHEN s_suppkey % 5 = 0 THEN 'publicly_available' ELSE 'not_reported' END AS data_availability, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 5 = 0 THEN 'GEO: GSE' || s_suppkey END AS data_location,
CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS verdict, s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AS is_accepted FROM supplier""")
def summaries(spark, sf_dir):
    """A summary of each paper by an injected rule model, with its availability, critique and acceptance."""
    k = F.col("s_suppkey")
    prompt = F.concat(F.lit("Title: "), "s_name", F.when(k % 3 == 0, " malformed").otherwise(""))
    context = F.concat(F.lit("[id=c"), _k("s_suppkey"), F.lit(" index=0]\nThe data are "), F.when(k % 5 == 0, F.concat(F.lit("deposited as GSE"), _k("s_suppkey"))).otherwise("ours"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), prompt.alias("prompt"), prompt.alias("retry_prompt"), F.concat("s_name", F.when(k % 7 == 0, " rejected").otherwise("")).alias("title"), context.alias("context"))
    return summarize.summarized(rows, summarize.RuleModel()).select("id", "is_valid", "data_availability", "data_location", "verdict", "is_accepted")


@query("""SELECT p_partkey AS id, '<section>' || chr(10) || '<h2>' || p_name || ' &lt;x&gt;</h2>' || chr(10) || '<p>Ann ' || p_brand || ' (' || (1990 + p_size) || '), <em>Academic Venue</em></p>' || chr(10) || '<span class=''badge''>Rank #' || p_partkey || '</span>' || chr(10) ||
CASE WHEN p_partkey % 2 = 0 THEN '<h3>Summary</h3><p>' || p_type || '</p>' ELSE '<p>No abstract text available.</p>' END || chr(10) || '<a href=''https://doi.org/10.1/' || p_partkey || '''>DOI Link</a>' || chr(10) || '</section>' AS card FROM part""")
def report_cards(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" <x>")).alias("title"), F.array(F.concat(F.lit("Ann "), "p_brand")).alias("authors"), (F.col("p_size") + 1990).alias("publication_year"), F.col("p_partkey").alias("rrf_rank"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("paragraph_summary"), F.concat(F.lit("10.1/"), _k("p_partkey")).alias("doi"))
    return p.select("id", report.card(p).alias("card"))


@query("""SELECT run_id, md5('<!DOCTYPE html><html><head><meta charset=''utf-8''><title>Related &amp; new - Base ' || run_id || '</title></head><body><h1>Related &amp; new</h1>' || chr(10) || '<p>Target Input Paper: <strong>Base ' || run_id || '</strong></p><p>DOI: N/A | arXiv: N/A | Year: ' || (1990 + run_id) ||
' | Exclusion Status: complete</p>' || chr(10) || '<h2>Discovered Related Literature (' || n || ' Papers)</h2>' || chr(10) || cards || chr(10) || '</body></html>' || chr(10)) AS digest, 1 AS n_files
FROM (SELECT p_size AS run_id, count(*) AS n, string_agg('<section>' || chr(10) || '<h2>' || p_name || ' &lt;x&gt;</h2>' || chr(10) || '<p> (N/A), <em>Academic Venue</em></p>' || chr(10) || '<span class=''badge''>Rank #' || p_partkey || '</span>' || chr(10) || '<p>No abstract text available.</p>' || chr(10) || '</section>', chr(10) ORDER BY p_partkey) AS cards FROM part GROUP BY p_size)""")
def report_pages(spark, sf_dir):
    """A page for each size of parts, written and read back as files."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("run_id"), F.concat("p_name", F.lit(" <x>")).alias("title"), F.col("p_partkey").alias("rrf_rank"))
    heads = p.select("run_id").distinct().select("run_id", F.lit("Related & new").alias("title"), F.concat(F.lit("Base "), _k("run_id")).alias("paper_title"), (F.col("run_id") + 1990).alias("publication_year"), F.lit("complete").alias("exclusion_status"))
    path = run_path(spark, "reports")
    report.write_pages(p, heads, path)
    files_ = spark.read.text(path, wholetext=True)
    return files_.groupBy(F.col("run_id").cast("int").alias("run_id")).agg(F.md5(F.max("value")).alias("digest"), F.count(F.lit(1)).cast("int").alias("n_files"))


@query(abstract_sql("SELECT doc_id, text || chr(10) || '1. Introduction' AS text FROM documents", 0))
def abstract_span(spark, sf_dir):
    """The lines between a heading that says abstract and the next section: each whole text in a paper's frame."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("A paper about much of this\nAnn Lee\nAbstract\n"), "text", F.lit("\n1. Introduction\nIt began long ago.")).alias("text"))
    return paper_text.with_title_and_abstract(d).select("doc_id", "abstract")


@query("""WITH q AS (SELECT source AS run_id, doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 10)::DOUBLE END AS score, coalesce(quality = 1, false) AS ok FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, coalesce(score >= 3, true) AS evaluated, row_number() OVER (PARTITION BY run_id ORDER BY id) AS position FROM q),
b AS (SELECT *, coalesce(sum((evaluated AND ok)::INT) OVER (PARTITION BY run_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT run_id, id, position, evaluated, evaluated AND ok AS accepted FROM b WHERE before < 25 AND position <= 400""")
def scored_queue(spark, sf_dir):
    """A queue with scores: what lies below the floor is looked at and passed over, what has no score isn't."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    q = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    k = F.col("doc_id")
    q = q.select(F.col("source").alias("run_id"), k.alias("id"), k.alias("rank"), "quality", F.when(k % 7 != 0, (k % 10).cast("double")).alias("abstract_relevance_score"))
    out = quota.one_round(q, F.col("quality") == 1, target=25, depth=400)
    return out.select("run_id", "id", F.col("position").cast("long").alias("position"), "evaluated", "accepted")


@query("""WITH c AS (SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 5.0 ELSE (vec_id % 100) / 10.0 END AS score, vec_id % 4 = 0 AS blank FROM embeddings)
SELECT id, score, CASE WHEN blank THEN 'moderate' WHEN score >= 8 THEN 'high' WHEN score >= 6 THEN 'moderate' WHEN score >= 4 THEN 'low' ELSE 'irrelevant' END AS tier, CASE WHEN blank THEN 'vector' ELSE 'scorer' END AS scored_by, row_number() OVER (ORDER BY score DESC, id) AS final_rank FROM c""")
def scorer_ranks(spark, sf_dir):
    """An injected scorer for all rows with an abstract, the fixed score for the rest; none reaches the threshold, so all compete."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 4 != 0, F.concat(F.lit("about "), _k("label"))).alias("abstract"))
    by_model = lambda d: d.withColumn("abstract_relevance_score", (F.col("id") % 100) / 10.0).withColumn("abstract_relevance_tier", S.relevance_tier(F.col("abstract_relevance_score")))
    out = candidates.screened(e.orderBy("id").limit(1).select("embedding"), e, by_model, least=9.95, most=(1 << 31) - 1)
    return out.select("id", F.col("abstract_relevance_score").alias("score"), F.col("abstract_relevance_tier").alias("tier"), "scored_by", F.col("final_rank").cast("long").alias("final_rank"))


@query("""WITH f AS (SELECT s_suppkey AS id, '%PDF-' || chr(10) || 'Report of ' || s_name || chr(12) || 'nation ' || s_nationkey || chr(10) AS content FROM supplier)
SELECT id, sha256(content) AS sha256, length(content) AS length, true AS is_pdf, replace(replace(content, '%PDF-' || chr(10), ''), chr(12), chr(10)) AS text, CAST(NULL AS VARCHAR) AS error FROM f""")
def scanned_files(spark, sf_dir):
    """A file for each supplier, written, scanned as bytes, told by its hash and read by an injected reader of pages."""
    content = F.concat(F.lit("%PDF-\nReport of "), "s_name", F.lit("\fnation "), _k("s_nationkey"))
    path = run_path(spark, "files")
    # Many tasks write, and each commits its own files: the committer's first version moves them one by one on the driver.
    rows = dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("id"), content.alias("value"))
    rows.write.partitionBy("id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    found = files.binaries(spark, path, "*.txt")
    pages = lambda data: data.decode().removeprefix("%PDF-\n").split("\f")
    rows = paper_text.extracted(found.withColumn("is_pdf", files.is_pdf(F.col("content"))), pages, keep=("sha256", "length", "is_pdf"))
    return rows.select(F.regexp_extract("path", r"/id=(\d+)/", 1).cast("long").alias("id"), "sha256", "length", "is_pdf", "text", "error")


#: Parts as papers: 500 DOIs, of which those of even number have the arXiv id of one of 250, so that two DOIs share it.
PARTS = """SELECT p_partkey AS id, 'd' || (p_partkey % 500) AS doi, CASE WHEN p_partkey % 2 = 0 THEN 'a' || (p_partkey % 250) END AS arxiv_id, p_name AS title FROM part"""


@query(f"""WITH p AS ({PARTS}), q AS (SELECT *, CASE WHEN arxiv_id IS NULL THEN '0:' || doi ELSE min('0:' || doi) OVER (PARTITION BY arxiv_id) END AS least FROM p),
e AS (SELECT sha1(least) AS paper_id, arg_min(doi, id) AS doi, arg_min(arxiv_id, id) AS arxiv_id, arg_min(title, id) AS title FROM q GROUP BY least),
s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'd' || s_suppkey END AS doi, 'a' || s_suppkey AS arxiv_id, s_name AS title FROM supplier),
t AS (SELECT s.*, d.least AS by_doi, a.least AS by_arxiv FROM s LEFT JOIN (SELECT DISTINCT doi, least FROM q) d ON s.doi = d.doi LEFT JOIN (SELECT arxiv_id, min(least) AS least FROM q GROUP BY arxiv_id) a ON s.arxiv_id = a.arxiv_id),
n AS (SELECT sha1(coalesce('0:' || doi, '1:' || arxiv_id)) AS paper_id, doi, arxiv_id, title FROM t WHERE by_doi IS NULL AND by_arxiv IS NULL)
SELECT * FROM e UNION ALL SELECT * FROM n""")
def registered_papers(spark, sf_dir):
    """Two batches written by get-or-create, the first one twice, and the stored papers read back."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("d"), (k % 500).cast("string")).alias("doi"), F.when(k % 2 == 0, F.concat(F.lit("a"), (k % 250).cast("string"))).alias("arxiv_id"), F.col("p_name").alias("title"))
    n = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select(n.alias("id"), F.when(n % 3 == 0, F.concat(F.lit("d"), n.cast("string"))).alias("doi"), F.concat(F.lit("a"), n.cast("string")).alias("arxiv_id"), F.col("s_name").alias("title"))
    path = run_path(spark, "papers-store")
    for batch in (parts, parts, suppliers):
        store.get_or_create(batch, path, buckets=8)
    return store.stored(spark, f"{path}/papers").select("paper_id", "doi", "arxiv_id", "title")


@query("""SELECT n_nationkey AS run_id, n_nationkey * 1000 + k AS id, k AS position, n_nationkey % 5 <> 0 AND k % 2 = 0 AS accepted FROM nation, (SELECT unnest(range(1, 11)) AS k) WHERE k <= CASE WHEN n_nationkey % 5 = 0 THEN 10 ELSE 6 END""")
def quota_expansion(spark, sf_dir):
    """Whole loops: a queue of three works a run, two more by each expansion, until three are accepted or ten were looked at."""
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("run_id"))
    more = lambda d, first, n: d.select("run_id", F.explode(F.sequence(first, first + n - 1)).alias("rank")).withColumn("id", F.col("run_id") * 1000 + F.col("rank"))
    last = lambda seen: seen.groupBy("run_id").agg(F.max("rank").alias("last"))
    good = lambda d: (F.col("run_id") % 5 != 0) & (F.col("rank") % 2 == 0)
    seen = quota.loop(more(runs, F.lit(1).cast("long"), 3), good, lambda accepted, seen: more(last(seen), F.col("last") + 1, 2), target=3, depth=10)
    return seen.select("run_id", "id", F.col("position").cast("long").alias("position"), "accepted")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0")
def guarded_rows(spark, sf_dir):
    """Rows behind the guard inside a plan: all of them have a complete exclusion."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "complete").otherwise("incomplete").alias("status"))
    return exclude.guarded(p.filter("status = 'complete'"), F.col("status")).select("id")


@query("SELECT 'D' || p_partkey AS id, CAST(p_size AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS venue FROM part")
def migrated_columns(spark, sf_dir):
    """A table brought to a newer schema: what it lacks is null, its own columns keep their values."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n"), F.concat(F.lit("D"), _k("p_partkey")).alias("id"))
    return files.with_columns(p, {"id": "string", "n": "long", "venue": "string"})


#: The second query of each source, and the vector that comes second.
AGAIN = "la que die qqqq de"
SECOND = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 1)"


@query(ORACLES["bm25_topk"])
def stored_bm25(spark, sf_dir):
    """The same rows as bm25_topk, from postings that were written once."""
    d = table(spark, sf_dir, "documents")
    asked = d.select("source").distinct().select("source", F.lit(1).alias("query_id"), F.lit(SEARCH).alias("text"))
    return inverted.sparse(inverted.build(d, "source", "doc_id", "text"), asked, "source", "doc_id", 30, places=6).select("source", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(ORACLES["relaxed_search"])
def stored_relaxed_search(spark, sf_dir):
    """The same rows as relaxed_search, from postings."""
    index = inverted.build(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return inverted.search(index, "the of and qqqq zzzz", 100).select(F.col("key").alias("doc_id"), F.col("attempt").cast("long").alias("attempt"))


@query(f"""WITH qs AS (SELECT 1 AS query_id, '{SEARCH}' AS qt, {SEED} AS v UNION ALL SELECT 2, '{AGAIN}', {SECOND}),
q AS (SELECT query_id, unnest(string_split(qt, ' ')) AS term FROM qs),
t AS (SELECT source, doc_id, {TOKENS.format('lower(text)')} AS w FROM documents),
st AS (SELECT source, count(*) AS n, avg(len(w)) AS avgdl FROM t GROUP BY source),
h AS (SELECT source, doc_id, dl, term, count(*) AS f FROM (SELECT source, doc_id, len(w) AS dl, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT source, term, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT query_id, source, doc_id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM h JOIN df USING (source, term) JOIN st USING (source) JOIN q USING (term) GROUP BY ALL),
sp AS (SELECT query_id, source, doc_id, row_number() OVER (PARTITION BY query_id, source ORDER BY round(coalesce(s, 0), 9) DESC, doc_id) AS s_rank FROM (SELECT query_id, source, doc_id FROM t, qs) LEFT JOIN s USING (query_id, source, doc_id)),
de AS (SELECT query_id, source, doc_id, row_number() OVER (PARTITION BY query_id, source ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 9) DESC, doc_id) AS d_rank FROM documents JOIN embeddings ON vec_id = doc_id, qs),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.source, b.source) AS source, coalesce(a.doc_id, b.doc_id) AS doc_id, d_rank, s_rank, round(coalesce(1.0::DOUBLE / (60 + d_rank), 0) + coalesce(1.0::DOUBLE / (60 + s_rank), 0), 12) AS rrf
  FROM (SELECT * FROM de WHERE d_rank <= 30) a FULL JOIN (SELECT * FROM sp WHERE s_rank <= 30) b ON a.source = b.source AND a.doc_id = b.doc_id AND a.query_id = b.query_id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rrf DESC, d_rank NULLS LAST, s_rank NULLS LAST) AS place FROM f),
k AS (SELECT query_id, p.source, p.doc_id, place, text AS c FROM p JOIN documents d ON p.doc_id = d.doc_id WHERE place <= 12),
r AS (SELECT query_id, source, doc_id, row_number() OVER (PARTITION BY query_id, source ORDER BY place) AS rank FROM (SELECT * FROM k WHERE {CLEAN_MACRO.replace("string_split(c, ' ')", "list_filter(regexp_split_to_array(c, '\\s+'), lambda t: t <> '')")})),
m AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY query_id, rank) AS time FROM r WHERE rank <= 4)
SELECT source, doc_id, query_id, row_number() OVER (PARTITION BY source ORDER BY query_id, rank) AS pos FROM m WHERE time = 1""")
def many_queries(spark, sf_dir):
    """Two queries of each source over its documents, each by words and vector; what both find stands with the first."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, sf_dir, "documents")
    two = e.orderBy("doc_id").limit(2).select((F.row_number().over(Window.orderBy("doc_id"))).alias("query_id"), "embedding")
    text = F.when(F.col("query_id") == 1, SEARCH).otherwise(AGAIN).alias("text")
    asked = d.select("source").distinct().crossJoin(F.broadcast(two)).select("source", "query_id", text, "embedding")  # two rows
    near = d.select("source", "doc_id").join(e, "doc_id")
    lists = inverted.hybrid(d, inverted.build(d, "source", "doc_id", "text"), asked, "source", "doc_id", "text", ks=(30, 30, 4), vectors=near)
    return inverted.merged(lists, "source", "doc_id").select("source", "doc_id", "query_id", F.col("pos").cast("long").alias("pos"))
