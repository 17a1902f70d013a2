"""More registered queries: records, identifiers, paper text, references, checks of replies, and the candidate list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from ..operators import availability, candidates, expand, fuse, match, summarize, validate
from ..operators.lineage import dealt
from ..sources import files, paper_text, scholarly
from .queries import SEED, TOKENS, query, table


def _null(kind: str = "string"):
    return F.lit(None).cast(kind)


def _text(c):
    return F.col(c).cast("string")


@query(r"""SELECT p_partkey AS id, '10.1234/' || lower(p_brand) || p_partkey AS doi, CASE WHEN p_partkey % 4 <> 0 THEN '2301.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') END AS arxiv_id,
'W' || p_partkey AS openalex_id, CAST(p_partkey AS VARCHAR) AS s2_id, trim(regexp_replace(regexp_replace(lower(p_name || ': ' || p_type || '...'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM part""")
def normalized_ids(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), _text("p_partkey")
    doi = F.concat(F.when(F.col("p_partkey") % 2 == 0, " https://doi.org/10.1234/").otherwise("DOI:10.1234/"), "p_brand", k, F.lit("/"))
    arxiv = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("cs/"), k)).otherwise(F.concat(F.lit("https://arxiv.org/abs/2301."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit("v2")))
    title = F.concat("p_name", F.lit(": "), "p_type", F.lit("..."))
    return p.select(F.col("p_partkey").alias("id"), N.doi(doi).alias("doi"), N.arxiv(arxiv).alias("arxiv_id"), N.openalex_id(F.concat(F.lit("https://openalex.org/w"), k)).alias("openalex_id"), N.s2_id(F.concat(F.lit("CorpusId:"), k)).alias("s2_id"), N.title(title).alias("title"))


@query("SELECT p_partkey AS l, s_suppkey AS r FROM part JOIN supplier ON p_partkey % 700 = s_suppkey")
def id_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("doi:10.1/"), (F.col("p_partkey") % 700).cast("string")).alias("doi"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://doi.org/10.1/"), _text("s_suppkey")).alias("doi"))
    return match.id_matches(p, s)


@query("""SELECT p_partkey AS id, coalesce(d.s_suppkey, a.s_suppkey) AS found FROM part LEFT JOIN supplier d ON p_partkey % 3 = 0 AND d.s_suppkey = p_partkey % 40
LEFT JOIN supplier a ON a.s_suppkey + 5 = p_partkey % 60""")
def lookup_cascade(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("d"), (k % 40).cast("string"))).otherwise("").alias("doi"), F.concat(F.lit("a"), (k % 60).cast("string")).alias("arxiv_id"), _null().alias("openalex_id"), _null().alias("s2_id"))
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("d"), _text("s_suppkey")).alias("doi"), F.concat(F.lit("a"), (F.col("s_suppkey") + 5).cast("string")).alias("arxiv_id"), _null().alias("openalex_id"), _null().alias("s2_id"))
    return match.lookup(p, e).select("id", "found")


#: Texts with identifiers behind them, some repeated, some with closing marks.
CITING = """(SELECT doc_id, text || ' see 10.1234/ab.' || (doc_id % 7) || '., also arXiv: 2301.0' || (1000 + doc_id % 9) || 'v2 and 10.1234/ab.' || (doc_id % 2) || ';' AS text FROM documents)"""


def _citing(spark, sf_dir) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    more = F.concat(F.lit(" see 10.1234/ab."), (k % 7).cast("string"), F.lit("., also arXiv: 2301.0"), (k % 9 + 1000).cast("string"), F.lit("v2 and 10.1234/ab."), (k % 2).cast("string"), F.lit(";"))
    return d.select("doc_id", F.concat("text", more).alias("text"))


IDS = r"""SELECT doc_id, 'DOI: ' || unnest(list_distinct(list_transform(regexp_extract_all(text, '10\.\d{4,9}/[-._;()/:A-Za-z0-9]+'), lambda d: regexp_replace(d, '[.,;]+$', '')))) AS raw_citation FROM CITING
UNION ALL SELECT doc_id, 'arXiv: ' || unnest(list_distinct(regexp_extract_all(text, '(?i)(?:arXiv:\s*|arxiv/|abs/)?(\d{4}\.\d{4,5}(?:v\d+)?)', 1))) FROM CITING""".replace("CITING", CITING)


@query(IDS)
def cited_identifiers(spark, sf_dir):
    return paper_text.cited_identifiers(_citing(spark, sf_dir), "doc_id").select("doc_id", "raw_citation")


@query(f"""WITH t AS ({IDS}), p AS (SELECT doc_id, 'parsed' AS raw_citation FROM documents WHERE doc_id % 3 = 0), k AS (SELECT doc_id, 'known' AS raw_citation FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, raw_citation, 1 AS stage FROM p UNION ALL SELECT doc_id, raw_citation, 2 FROM t WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, raw_citation, 3 FROM k WHERE doc_id % 3 <> 0""")
def reference_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parsed, known = (d.filter(F.col("doc_id") % n == 0).select("doc_id", F.lit(c).alias("raw_citation")) for n, c in ((3, "parsed"), (5, "known")))
    refs, _ = paper_text.references(d, parsed, _citing(spark, sf_dir), known, "doc_id")
    return refs.select("doc_id", "raw_citation", "stage")


LINES = r"""SELECT doc_id, text, list_transform(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, lambda x: x) AS l FROM (SELECT doc_id, text, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS l FROM documents)"""


@query(rf"""WITH l AS ({LINES}), f AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^\s*(?:[0-9]+\.?\s+)?(introduction|keywords|index terms)\b')), true) AS a FROM l)
SELECT doc_id, md5(CASE WHEN coalesce(a, 0) > 0 THEN array_to_string(l[1:a - 1], chr(10)) ELSE substr(text, 1, 4000) END) AS front FROM f""")
def front_matter(spark, sf_dir):
    return paper_text.with_matter(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5("front").alias("front"))


BANNER = r"'(?i)preprint|under review|manuscript submitted|copyright|arxiv:|\d+\s*[:–-]\s*\d+\s*[–-]\s*\d+\s*,\s*\d{4}|^\s*\d+\s*$'"
PEOPLE = r"""(regexp_matches({0}, '(?i)\b(anonymous|university|institute|department|corresponding author|et al\.?)\b|@') OR (len({1}) BETWEEN 1 AND 4
 AND len(list_filter({1}, lambda w: NOT regexp_matches(w, '^\p{{Lu}}'))) = 0 AND len(list_filter({1}, lambda w: list_contains(['of','the','and','for','with','in','on','using','via','to','a','an','from','into','under','over','as','is','are','vs','vs.'], trim(lower(w), ',.')))) = 0))"""


def _people(c: str) -> str:
    return PEOPLE.format(c, TOKENS.format(c))


def abstract_sql(texts: str, heading: int | None = None) -> str:
    """doc_id, abstract: the lines behind the first abstract heading (or the given line) to a section heading or the line that reaches the limit."""
    first = r"(SELECT doc_id, min(i) AS h FROM x WHERE regexp_matches(line, '(?i)^\s*abstract\s*[:.]?\s*$') GROUP BY doc_id)" if heading is None else f"(SELECT doc_id, {heading} AS h FROM d)"
    return rf"""WITH d AS ({texts}), l AS ({LINES.replace("documents", "d")}), y AS (SELECT doc_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS l FROM l),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM y), f AS {first},
e AS (SELECT x.doc_id, min(i) AS e FROM x JOIN f USING (doc_id) WHERE i > h AND regexp_matches(line, '(?i)^\s*(?:[0-9]+\.?\s+)?(introduction|keywords|index terms)\b') GROUP BY x.doc_id),
b AS (SELECT x.doc_id, i, line, coalesce(sum(length(line)) OVER (PARTITION BY x.doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x JOIN f USING (doc_id) LEFT JOIN e ON x.doc_id = e.doc_id WHERE i > h AND (e IS NULL OR i < e)),
g AS (SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS abstract FROM b WHERE before < 2500 GROUP BY doc_id)
SELECT d.doc_id, abstract FROM d LEFT JOIN g USING (doc_id)"""


TITLE_SQL = rf"""WITH l AS ({LINES}), s AS (SELECT doc_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS l FROM l),
b AS (SELECT doc_id, l, CASE WHEN len(list_filter(l, lambda x: NOT regexp_matches(x, {BANNER}))) > 0 THEN list_position(list_transform(l, lambda x: regexp_matches(x, {BANNER})), false) ELSE len(l) END AS i FROM s WHERE len(l) > 0),
t AS (SELECT doc_id, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c FROM b),
u AS (SELECT *, b IS NOT NULL AND NOT regexp_matches(a, '[.!?:]\s*$') AND NOT {_people('b')} AS two FROM t)
SELECT s.doc_id, CASE WHEN NOT two THEN a WHEN c IS NOT NULL AND NOT regexp_matches(b, '[.!?:]\s*$') AND NOT {_people('c')} THEN a || ' ' || b || ' ' || c ELSE a || ' ' || b END AS title FROM s LEFT JOIN u ON s.doc_id = u.doc_id"""


@query(TITLE_SQL)
def line_title(spark, sf_dir):
    return paper_text.with_title_and_abstract(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "title")


@query(rf"""WITH ti AS ({TITLE_SQL}), ab AS ({abstract_sql("SELECT doc_id, text FROM documents")}),
fl AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^\s*(?:[0-9]+\.?\s+)?(introduction|keywords|index terms)\b')), true) AS hd FROM ({LINES})),
fr AS (SELECT doc_id, CASE WHEN coalesce(hd, 0) = 0 THEN substr(text, 1, 4000) ELSE array_to_string(l[1:hd - 1], chr(10)) END AS front, text FROM fl JOIN documents USING (doc_id))
SELECT doc_id, title, coalesce(abstract, substr(text, 1, 1000)) AS abstract,
nullif(regexp_replace(regexp_extract(front, '10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), '[.,;]+$', ''), '') AS doi, nullif(regexp_extract(front, '(?i)(?:arXiv:\s*|arxiv/|abs/)?(\d{{4}}\.\d{{4,5}}(?:v\d+)?)', 1), '') AS arxiv_id
FROM fr JOIN ti USING (doc_id) JOIN ab USING (doc_id)""")
def text_metadata(spark, sf_dir):
    """Title, abstract and own identifiers of each whole text."""
    return paper_text.metadata(table(spark, sf_dir, "documents"), "doc_id")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount AS top, l_quantity AS size, 'piece ' || l_partkey AS t, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
SELECT l_orderkey AS id, string_agg(t, ' ' ORDER BY top, l_linenumber, t) AS title FROM s WHERE size >= m - 0.5 GROUP BY l_orderkey HAVING length(string_agg(t, ' ')) BETWEEN 8 AND 300""")
def font_title(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    spans = x.select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("size"), F.col("l_discount").alias("top"), F.col("l_linenumber").alias("pos"), F.concat(F.lit(" piece "), _text("l_partkey"), F.lit(" ")).alias("text"))
    return paper_text.largest_font_title(spans, "id")


@query("""SELECT doc_id, doc_id % 2 = 0 AND octet_length(encode(text)) + 5 <= 2000 AS valid,
substr(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '10.1/' || source || doc_id ELSE 'cand' END, '[^A-Za-z0-9]', '_', 'g'), 1, 50) || '.pdf' AS file_name FROM documents""")
def payload_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("%PDF-")).otherwise("<html"), "text").cast("binary")
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/"), "source", _text("doc_id")))
    return d.select("doc_id", files.is_pdf(content, 2000).alias("valid"), files.file_name(_null(), doi, F.lit("")).alias("file_name"))


@query("""SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 4 = 0 THEN 'https://host/' || p_partkey END, CASE WHEN s_suppkey IS NOT NULL THEN 'https://oa/' || s_suppkey END, CASE WHEN p_partkey % 3 = 0 THEN 'https://arxiv.org/pdf/' || p_partkey || '.pdf' END) AS access_url
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 700""")
def access_urls(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("10.1/"), (k % 700).cast("string")).alias("doi"), F.when(k % 3 == 0, k.cast("string")).alias("arxiv_id"), F.when(k % 4 == 0, F.concat(F.lit("https://host/"), k.cast("string"))).otherwise("").alias("oa_pdf_url"))
    r = table(spark, sf_dir, "supplier").select(F.concat(F.lit("10.1/"), _text("s_suppkey")).alias("doi"), F.concat(F.lit("https://oa/"), _text("s_suppkey")).alias("url"))
    return files.access_url(p, r).select("id", "access_url")


@query("""SELECT 'W' || p_partkey AS openalex_id, '10.1/' || p_partkey AS doi, p_name AS title, p_brand AS author, p_type || ' ' || p_brand AS abstract, CAST(1990 + p_size AS INTEGER) AS publication_year, p_partkey % 2 = 0 AS is_open_access FROM part""")
def works_parse(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), _text("p_partkey")
    words = F.split(F.concat_ws(" ", "p_type", "p_brand"), " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    author = F.array(F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("author")))
    j = F.to_json(F.struct(F.concat(F.lit("https://openalex.org/W"), k).alias("id"), F.concat(F.lit("https://doi.org/10.1/"), k).alias("doi"), F.col("p_name").alias("display_name"), author.alias("authorships"), (F.col("p_size") + 1990).alias("publication_year"), F.struct((F.col("p_partkey") % 2 == 0).alias("is_oa")).alias("open_access"), index.alias("abstract_inverted_index")))
    return scholarly.works(p.select(j.alias("json"))).select("openalex_id", "doi", "title", F.get("authors", F.lit(0)).alias("author"), "abstract", "publication_year", "is_open_access")


@query("""SELECT p_partkey AS id, p_name AS title, '10.1/' || p_partkey AS doi, CAST(1990 + p_size AS INTEGER) AS publication_year FROM part""")
def tei_header(spark, sf_dir):
    xml = F.concat(F.lit("<TEI><teiHeader><titleStmt><title type='main'>"), "p_name", F.lit("</title></titleStmt><idno type='DOI'>10.1/"), _text("p_partkey"), F.lit("</idno><date type='published' when='"), (F.col("p_size") + 1990).cast("string"), F.lit("-01-02'/></teiHeader><text><idno type='DOI'>10.9/cited</idno></text></TEI>"))
    h = scholarly.tei_header(xml)
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), *[h[c].alias(c) for c in ("title", "doi", "publication_year")])


@query("""SELECT p_partkey AS id, 0 AS pos, p_name AS title, 'Ann ' || p_brand AS author, CAST(1990 + p_size AS INTEGER) AS year FROM part UNION ALL SELECT p_partkey, 1, p_type, NULL, NULL FROM part""")
def tei_bibliography(spark, sf_dir):
    one = F.concat(F.lit("<biblStruct><analytic><title level='a'>"), "p_name", F.lit("</title><author><persName><forename type='first'>Ann</forename><surname>"), "p_brand", F.lit("</surname></persName></author></analytic><monogr><imprint><date when='"), (F.col("p_size") + 1990).cast("string"), F.lit("'/></imprint></monogr></biblStruct>"))
    two = F.concat(F.lit("<biblStruct><monogr><title>"), "p_type", F.lit("</title></monogr></biblStruct>"))
    d = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), F.concat(F.lit("<TEI><back><listBibl>"), one, two, F.lit("</listBibl></back></TEI>")).alias("xml"))
    return scholarly.tei_references(d).select("id", "pos", "title", F.get("authors", F.lit(0)).alias("author"), "year")


@query(f"""WITH c AS (SELECT conv_id, turn, text, len({TOKENS.format('text')}) AS n, CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 10.0 ELSE 0.0 END AS s0 FROM conversations),
b AS (SELECT *, max(s0) OVER (PARTITION BY conv_id) AS best FROM c), s AS (SELECT conv_id, turn, n, CASE WHEN best > 0 THEN s0 WHEN contains(lower(text), 'de') THEN 1.0 ELSE 0.0 END AS score FROM b),
k AS (SELECT * FROM s WHERE EXISTS (SELECT 1 FROM s x WHERE x.conv_id = s.conv_id AND x.score > 0 AND abs(x.turn - s.turn) <= 1)),
r AS (SELECT *, sum(n) OVER w AS cum, row_number() OVER w AS rn FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY score = 0, turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, CAST(score AS DOUBLE) AS score FROM r WHERE cum <= 200 OR rn = 1""")
def context_select(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return availability.context(c, "conv_id", "turn", budget=200, groups=(([r"\bthe\b"], 10.0),), fallback="de").select("conv_id", "turn", "score")


@query("SELECT conv_id, md5(string_agg('[id=' || role || ' index=' || turn || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn)) AS context FROM conversations GROUP BY conv_id")
def context_format(spark, sf_dir):
    return availability.formatted(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", F.md5("context").alias("context"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE rn <= greatest(1, n // 2)")
def retry_half(spark, sf_dir):
    return availability.first_half(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")]).select("conv_id", "turn")


@query(f"""WITH c AS (SELECT conv_id, turn, {TOKENS.format('text')} AS w FROM conversations), r AS (SELECT *, sum(len(w)) OVER q AS cum, row_number() OVER q AS rn FROM c WINDOW q AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, CAST(least(len(w), 30) AS BIGINT) AS n FROM r WHERE cum <= 30 OR rn = 1""")
def prompt_trim(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("n", F.size(N.tokens(F.col("text"))).cast("long"))
    return summarize.trimmed(c, "conv_id", "turn", 30, "text", "n").select("conv_id", "turn", F.col("n").cast("long").alias("n"))


@query("""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM embeddings)
SELECT label, vec_id, round(1.0 + CASE WHEN rank <= 10 THEN 10.0 / rank ELSE 0 END, 6) AS score FROM r""")
def dense_bonus(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    ranked = fuse.ranked(e, [F.desc("vec_id")], ["label"])
    return availability.with_dense_bonus(e.withColumn("score", F.lit(1.0)), ranked, "label", "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


@query("""SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN st <> 'not_reported' AND NOT ev THEN 'evidence_required' END, CASE WHEN st = 'publicly_available' AND code AND NOT (ev AND q2) THEN 'code_host_only' END,
CASE WHEN st = 'publicly_available' AND NOT (url OR (ev AND q2)) THEN 'no_location' END, CASE WHEN st = 'not_available' AND NOT (ev AND q1) THEN 'no_denial' END, CASE WHEN st = 'not_reported' AND ev AND q1 THEN 'access_discussed' END], lambda x: x IS NOT NULL), ',') AS violations
FROM (SELECT p_partkey, ['publicly_available', 'not_available', 'not_reported', 'restricted'][p_partkey % 4 + 1] AS st, p_partkey % 3 = 0 AS code, p_partkey % 3 <= 1 AS url, p_partkey % 5 <> 0 AS ev, p_partkey % 7 = 0 AS q1, p_partkey % 7 = 1 AS q2 FROM part)""")
def dataset_rules(spark, sf_dir):
    k = F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, ("publicly_available", "not_available", "not_reported", "restricted"))), (k % 4 + 1).cast("int"))
    quote = F.when(k % 7 == 0, "data are not available").when(k % 7 == 1, "see supplementary table").otherwise("some words")
    evidence = F.when(k % 5 != 0, F.array(F.struct(F.lit("c").alias("source_chunk_id"), quote.alias("quote"), _null().alias("section_title"), _null("int").alias("page_number")))).otherwise(F.array().cast(validate.EVIDENCE))
    url = F.when(k % 3 == 0, "https://github.com/x").when(k % 3 == 1, "https://host/x")
    fields = {"dataset_name": F.col("p_name"), "role": _null(), "status": status, "repository": _null(), "accession": _null(), "url": url, "access_conditions": _null(), "ownership": _null(), "required_for_reproduction": _null("boolean"), "evidence": evidence}
    d = table(spark, sf_dir, "part").select(k.alias("id"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("d"))
    return d.select("id", F.array_join(validate.dataset_violations(F.col("d")), ",").alias("violations"))


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'text_empty' END, CASE WHEN len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) > 300 THEN 'too_many_words' END,
CASE WHEN contains(text, chr(10)) THEN 'several_paragraphs' END, CASE WHEN doc_id % 2 = 1 THEN 'unknown_status' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents""")
def summary_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("data_availability", F.when(F.col("doc_id") % 2 == 0, " Mixed ").otherwise("proprietary"))
    return d.select("doc_id", F.array_join(validate.summary_violations(d, ["text"], "text"), ",").alias("violations"))


@query("""SELECT p_partkey AS id, p_name AS problem, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' again' END AS relation, '{"a": ' || p_partkey || '}' AS body, 'c' || p_partkey AS chunk, p_brand AS content FROM part""")
def reply_parse(spark, sf_dir):
    k = _text("p_partkey")
    reply = F.concat(F.lit("PROBLEM FORMULATION:  "), "p_name", F.lit("\n\nMETHODOLOGY: what is new\n## RESULTS: some found\nSUMMARY: all in all\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("RELATIONSHIP TO TARGET: "), "p_type", F.lit("\nagain"))).otherwise(""))
    s = T.sections(reply)
    c = F.get(T.prompt_chunks(F.concat(F.lit("Chunks:\n[CHUNK id=c"), k, F.lit(" index=1]\n"), "p_brand", F.lit("\n\n[CHUNK id=z index=2]\nend"))), 0)
    body = T.json_object(F.concat(F.lit('Sure:\n```json\n{"a": '), k, F.lit("}\n```")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), s["problem_formulation"].alias("problem"), s["relationship_to_target"].alias("relation"), body.alias("body"), c["id"].alias("chunk"), c["content"].alias("content"))


@query("SELECT p_partkey AS id, p_partkey % 3 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 5 = 0) AS is_verified FROM part")
def verified_references(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 != 0, F.lit("A title")).otherwise("abc").alias("title"), F.when(k % 2 == 0, F.array("p_brand")).alias("authors"), F.when(k % 5 == 0, 2000).alias("year"), _null().alias("doi"), _null().alias("arxiv_id"))
    return validate.verified_reference(p).select("id", "is_verified")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'unclear' ELSE o_orderstatus END AS data_availability, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN lower(o_orderpriority) ELSE 'unknown' END AS role FROM orders")
def legacy_remap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", " Proprietary").otherwise(F.col("o_orderstatus")).alias("data_availability"), N.choice(F.concat(F.lit(" "), "o_orderpriority"), ["1-urgent", "2-high"]).alias("role"))
    return files.remap_legacy(o)


@query("""WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, max(CAST(l_quantity AS BIGINT)) AS weight FROM lineitem GROUP BY ALL),
h AS (SELECT dst AS id, max(weight) AS weight FROM e WHERE src BETWEEN 1 AND 5 GROUP BY dst)
SELECT id, weight FROM h WHERE id % 7 <> 0 AND id % 11 <> 0 AND id > 3 ORDER BY weight DESC, id LIMIT 50""")
def graph_expand(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max(F.col("l_quantity").cast("long")).alias("weight"))
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("10.1/"), _text("p_partkey")).alias("doi"), _null().alias("title"))
    accepted = spark.range(1, 6).select("id", F.lit("10.2/none").alias("doi"), _null().alias("title"))
    return expand.expansion(accepted, edges, works, works.filter("id <= 3"), works.filter("id % 7 = 0"), works.filter("id % 11 = 0")).select("id", "weight")


PAPERS = """a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part),
u AS (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100)"""


@query(f"""WITH {PAPERS}, s AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM u WHERE id > 10 GROUP BY id),
v AS (SELECT id, rrf, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {SEED}) AS cos FROM s JOIN embeddings ON vec_id = id % 400),
r AS (SELECT id, cos, row_number() OVER (ORDER BY round(rrf * (1 + 5 * greatest(0, cos)), 12) DESC, id) AS pos FROM v),
k AS (SELECT id, round(greatest(0, least(10, 10 * cos)), 2) AS score FROM r WHERE pos <= 50)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rrf_rank FROM k WHERE score >= 2 OR (SELECT max(score) FROM k) < 2 ORDER BY score DESC, id LIMIT 20""")
def candidate_list(spark, sf_dir) -> DataFrame:
    """Two ranked lists of parts, the first ten parts cited; vectors stand in by number."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    p = table(spark, sf_dir, "part").withColumn("v", F.col("p_partkey") % 400).join(e, "v")
    fields = [F.col("p_partkey").alias("id"), F.concat(F.lit("10.1/"), _text("p_partkey")).alias("doi"), _null().alias("title"), F.col("p_type").alias("abstract"), "embedding"]
    first = lambda c: fuse.ranked(p.orderBy(F.desc(c), "p_partkey").limit(100), [F.desc(c), F.col("p_partkey")]).select(*fields, "rank")
    seed = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("10.1/seed").alias("doi"), _null().alias("title"), _null().alias("abstract"), "embedding")
    cited = table(spark, sf_dir, "part").filter("p_partkey <= 10").select(F.col("p_partkey").alias("id"), F.concat(F.lit("10.1/"), _text("p_partkey")).alias("doi"), _null().alias("title"))
    out = candidates.build(seed, cited, {"price": [first("p_retailprice")], "size": [first("p_size")]}, least=2.0)
    return out.select("id", F.col("abstract_relevance_score").alias("score"), F.col("rrf_rank").cast("long").alias("rrf_rank"))
