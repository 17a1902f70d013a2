"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows.

The tables aren't scholarly; each operator runs on the column that plays its part (a document for a paper's text, a label for
a critique, a part for a record with identifiers, a conversation for a run of chunks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import scoring as S
from ..functions import text as T
from ..operators import availability, chunk, exclude, expand, fuse, quota, report, retrieve, screen, validate
from ..sources import files
from ..streaming import events as streaming_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEARCH = "the of and de la der thtion"
LICENCES = ([r"licensed under", r"released under", r"all rights reserved"], 10.0), ([r"apache license", r"mit license", r"creative commons"], 5.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOKENS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda t: t <> '')"


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('lower(text)')})) AS n_distinct FROM documents")
def token_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(N.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(N.tokens(F.lower("text")))).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, term, count(*) AS tf, any_value(n) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM (SELECT doc_id, {TOKENS.format('lower(text)')} AS w FROM documents)) GROUP BY doc_id, term")
def term_frequency(spark, sf_dir):
    return retrieve.term_counts(table(spark, sf_dir, "documents").withColumn("p", F.lit(0)), "p", "doc_id", "text").select("doc_id", "term", F.col("f").alias("tf"), F.col("dl").cast("long").alias("dl"))


@query(f"SELECT doc_id, p AS p_start, len(w[p + 1:p + 768]) AS n, md5(array_to_string(w[p + 1:p + 768], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, len(w), 672)) AS p FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents))")
def chunk_windows(spark, sf_dir):
    p = chunk.parents(table(spark, sf_dir, "documents"))
    return p.select("doc_id", F.col("p_start").cast("long").alias("p_start"), F.size("p_tokens").cast("long").alias("n"), F.md5(F.array_join("p_tokens", " ")).alias("digest"))


CLEAN_MACRO = r"""
  NOT (
    (len(list_filter(string_split(trim(c, E' \n\t\r'), ','), lambda x: regexp_full_match(x, '\s*\d+\s*'))) >= 5
      AND len(list_filter(regexp_split_to_array(trim(c, E' \n\t\r'), '[,\s]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '\d+'))) < 3)
    OR (len(regexp_extract_all(trim(c, E' \n\t\r'), '(?:^|,)\s*([A-Z][a-z]+)\s*,', 1)) >= 6
      AND list_max(list_transform(regexp_extract_all(trim(c, E' \n\t\r'), '(?:^|,)\s*([A-Z][a-z]+)\s*,', 1), lambda s: len(list_filter(regexp_extract_all(trim(c, E' \n\t\r'), '(?:^|,)\s*([A-Z][a-z]+)\s*,', 1), lambda x: x = s)))) >= 4)
    OR len(regexp_extract_all(c, '(?i)https?://|\.tar\.gz|\.bcf|\.vcf|s3[.-]|\.fasta\b')) >= 2
    OR len(regexp_extract_all(c, '(?i)\bSupplementary (?:Figure|Table|Note|Information|File|Movie)\b')) >= 2
    OR len(regexp_extract_all(c, '(?i)\bet al\b')) >= 2 OR len(regexp_extract_all(c, '10\.\d{4,9}/')) >= 2
    OR len(regexp_extract_all(c, '\b(?:19|20)\d{2}\s*;\s*\d+')) >= 2 OR len(regexp_extract_all(c, '(?m)^\s*\d{1,3}\.\s+[A-Z]')) >= 3)
  AND len(regexp_extract_all(c, '[a-zA-Z]{3,}')) >= 20 AND len(regexp_extract_all(c, 'https?://\S+|s3-\S+')) < 2
  AND len(list_filter(string_split(c, ' '), lambda t: NOT regexp_matches(t, '[a-zA-Z]'))) <= 0.5 * len(string_split(c, ' '))
"""


@query(rf"""
WITH w AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
p AS (SELECT doc_id, p, w[p + 1:p + 768] AS pt FROM (SELECT doc_id, w, unnest(range(0, len(w), 672)) AS p FROM w)),
pc AS (SELECT * FROM (SELECT doc_id, p, pt, array_to_string(pt, ' ') AS c FROM p) WHERE {CLEAN_MACRO}),
k AS (SELECT doc_id, p, k, len(pt) AS n, pt[k + 1:k + 256] AS kt FROM (SELECT doc_id, p, pt, unnest(range(0, len(pt), 208)) AS k FROM pc)),
kc AS (SELECT * FROM (SELECT doc_id, p, k, n, len(kt) AS m, array_to_string(kt, ' ') AS c FROM k) WHERE {CLEAN_MACRO}),
kk AS (SELECT * FROM (SELECT *, max(k + 256 >= n) OVER (PARTITION BY doc_id, p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM kc) WHERE coalesce(done, false) = false),
r AS (SELECT doc_id, p, 0 AS is_child, 0 AS k, len(pt) AS token_count, c FROM pc UNION ALL SELECT doc_id, p, 1, k, m, c FROM kk)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, is_child, k) - 1 AS chunk_index, CASE WHEN is_child = 1 THEN 'child' ELSE 'parent' END AS chunk_type,
  p + k AS start, CAST(token_count AS BIGINT) AS token_count, md5(c) AS digest FROM r
""")
def clean_chunks(spark, sf_dir):
    c = chunk.chunks(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", F.col("start").cast("long").alias("start"), F.col("token_count").cast("long").alias("token_count"), F.md5("content").alias("digest"))


BM25 = f"""
q AS (SELECT unnest(string_split('{SEARCH}', ' ')) AS term),
t AS (SELECT source, doc_id, {TOKENS.format('lower(text)')} AS w FROM documents),
st AS (SELECT source, count(*) AS n, avg(len(w)) AS avgdl FROM t GROUP BY source),
h AS (SELECT source, doc_id, dl, term, count(*) AS f FROM (SELECT source, doc_id, len(w) AS dl, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT source, term, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT source, doc_id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM h JOIN df USING (source, term) JOIN st USING (source) JOIN q USING (term) GROUP BY ALL),
sparse AS (SELECT source, doc_id, round(coalesce(s, 0), 6) AS score FROM t LEFT JOIN s USING (source, doc_id))
"""


@query(f"WITH {BM25} SELECT * FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM sparse) WHERE rank <= 30")
def bm25_topk(spark, sf_dir):
    s = retrieve.bm25(table(spark, sf_dir, "documents"), SEARCH, "source", "doc_id", "text", places=6)
    return retrieve.top(s, "source", "score", "doc_id", 30).withColumn("rank", F.col("rank").cast("long"))


def _seed(spark, sf_dir) -> list[float]:
    """The vector of the smallest id."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


SEED = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"SELECT * FROM (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {SEED}), 6) AS score FROM embeddings)) WHERE rank <= 30")
def dense_topk(spark, sf_dir):
    return retrieve.dense(table(spark, sf_dir, "embeddings"), _seed(spark, sf_dir), "label", "vec_id", k=30, places=6).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT vec_id, s AS score, CASE WHEN s >= 8 THEN 'high' WHEN s >= 6 THEN 'moderate' WHEN s >= 4 THEN 'low' ELSE 'irrelevant' END AS tier FROM (SELECT vec_id, round(greatest(0, least(10, 10 * round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {SEED}), 9))), 2) AS s FROM embeddings)")
def seed_similarity_tier(spark, sf_dir):
    q = F.array(*map(F.lit, _seed(spark, sf_dir)))
    e = table(spark, sf_dir, "embeddings").withColumn("score", S.relevance_score(F.round(S.cosine(F.col("embedding"), q), 9)))
    return e.select("vec_id", "score", S.relevance_tier(F.col("score")).alias("tier"))


TWO_LISTS = """
a AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey),
b AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey)
"""


def _two_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    first = lambda c: o.orderBy(F.desc(c), "id").limit(100).select("id", F.lit(0).alias("part"), c)
    return tuple(retrieve.top(first(c), "part", c, "id", 100).select("part", "id", "rank") for c in ("total", "n"))


@query(f"WITH {TWO_LISTS} SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 12) AS rrf FROM (SELECT * FROM a WHERE rank <= 100) a FULL JOIN (SELECT * FROM b WHERE rank <= 100) b ON a.id = b.id")
def rrf_fusion(spark, sf_dir):
    a, b = _two_lists(spark, sf_dir)
    return retrieve.fuse(a, b, "part", "id").select("id", "rrf")


@query(f"""WITH {TWO_LISTS}, u AS (SELECT id, 'a' AS source, rank FROM a WHERE rank <= 100 UNION ALL SELECT id, 'b', rank FROM b WHERE rank <= 100),
s AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, list_sort(list_distinct(list(source))) AS src FROM u GROUP BY id)
SELECT id, round(rrf * (1 + 5 * greatest(0, c_acctbal / 10000)), 10) AS score, array_to_string(src, ',') AS source_apis FROM s JOIN customer ON c_custkey = id""")
def source_rrf_boosted(spark, sf_dir):
    a, b = _two_lists(spark, sf_dir)
    u = a.withColumn("source", F.lit("a")).unionByName(b.withColumn("source", F.lit("b")))
    ranks = fuse.source_rank(u, "id", "source", "rank")
    src = ranks.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source_apis"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("sim"))
    return fuse.rrf(ranks, ["id"], "rank").join(src, "id").join(c, "id").select("id", F.round(fuse.boosted(F.col("rrf_score"), F.col("sim")), 10).alias("score"), "source_apis")


def _records(spark, sf_dir) -> DataFrame:
    """Parts as records: a DOI that several share, written in several ways."""
    p = table(spark, sf_dir, "part")
    doi = F.concat(F.when(F.col("p_partkey") % 2 == 0, "https://doi.org/10.1234/").otherwise("DOI:10.1234/"), (F.col("p_partkey") % 700).cast("string"))
    return p.select(F.col("p_partkey").alias("id"), doi.alias("doi"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("publication_year"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("venue"))


@query("SELECT p_partkey AS id FROM part WHERE (p_partkey % 700) NOT IN (SELECT s_suppkey FROM supplier) AND (p_partkey % 700) <> 699")
def exclusion_anti_join(spark, sf_dir):
    cited = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("10.1234/"), F.col("s_suppkey").cast("string")).alias("doi"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("publication_year"))
    seed = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("10.1234/699").alias("doi"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("publication_year"))
    return exclude.exclude(_records(spark, sf_dir), seed, cited).select("id")


@query("SELECT min(p_partkey) AS id, '10.1234/' || (p_partkey % 700) AS doi, arg_min(p_brand, p_partkey) FILTER (p_partkey % 3 <> 0) AS venue FROM part GROUP BY p_partkey % 700")
def dedup_merge(spark, sf_dir):
    return fuse.deduplicated(_records(spark, sf_dir).withColumn("pos", F.col("id")), ["pos"]).select("id", "doi", "venue")


def _screen(least: float) -> str:
    return f"""WITH s AS (SELECT label, vec_id, round(greatest(0, least(10, 10 * round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {SEED}), 9))), 2) AS score FROM embeddings),
m AS (SELECT label, max(score) AS top FROM s GROUP BY label)
SELECT label, vec_id, score, final_rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.label ORDER BY score DESC, vec_id) AS final_rank FROM s JOIN m ON s.label = m.label WHERE score >= {least} OR top < {least}) WHERE final_rank <= 20"""


def _screened(spark, sf_dir, least):
    q = F.array(*map(F.lit, _seed(spark, sf_dir)))
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", S.relevance_score(F.round(S.cosine(F.col("embedding"), q), 9)).alias("score"))
    return screen.relaxed(e, "score", least, 20, [F.col("vec_id")], ["label"]).withColumn("final_rank", F.col("final_rank").cast("long"))


@query(_screen(4.0))
def screen_relaxation(spark, sf_dir):
    return _screened(spark, sf_dir, 4.0)


@query(_screen(11.0))
def screen_nobody_passes(spark, sf_dir):
    return _screened(spark, sf_dir, 11.0)


CONV = f"SELECT conv_id, turn, text, len({TOKENS.format('text')}) AS n FROM conversations"


@query(f"SELECT conv_id, turn, n FROM (SELECT conv_id, turn, n, sum(n) OVER w AS cum, row_number() OVER w AS rn FROM ({CONV}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE cum <= 150 OR rn = 1")
def budget_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("n", F.size(N.tokens(F.col("text"))).cast("long"))
    return availability.budgeted(c, ["conv_id"], [F.col("turn")], "n", 150).select("conv_id", "turn", "n")


@query("WITH s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)the') THEN 1.0 ELSE 0.0 END AS score FROM conversations) SELECT s.conv_id, s.turn, CAST(s.score AS DOUBLE) AS score FROM s WHERE EXISTS (SELECT 1 FROM s x WHERE x.conv_id = s.conv_id AND x.score > 0 AND abs(x.turn - s.turn) <= 1)")
def neighbor_expand(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", availability.pattern_score(F.col("text"), None, (([r"the"], 1.0),)).alias("score"))
    return availability.neighbours(c, "conv_id", "turn").select("conv_id", "turn", "score")


@query("SELECT doc_id, CAST(" + " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {n} ELSE 0 END" for ps, n in LICENCES for p in ps) + " AS DOUBLE) AS score FROM documents")
def pattern_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", availability.pattern_score(F.col("text"), None, LICENCES).alias("score"))


@query("""WITH s AS (SELECT DISTINCT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'publicly_available' WHEN 'O' THEN 'not_reported' ELSE 'restricted' END AS st FROM orders),
g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (st <> 'not_reported') AS k, min(st) FILTER (st <> 'not_reported') AS one FROM s GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN k = 0 THEN 'not_reported' WHEN k > 1 THEN 'mixed' ELSE one END AS overall_status FROM g""")
def status_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("st", F.when(F.col("o_orderstatus") == "F", "publicly_available").when(F.col("o_orderstatus") == "O", "not_reported").otherwise("restricted"))
    return validate.status_rollup(o, "o_custkey", "st", F.lit(True))


def _gated(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.withColumn("verdict", F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected"))


@query("SELECT doc_id, coalesce(quality = 1 AND toxic = 0, false) AS accepted FROM documents LEFT JOIN labels USING (doc_id)")
def accept_gate_failsafe(spark, sf_dir):
    g = _gated(spark, sf_dir)
    return g.select("doc_id", validate.accepted_fail_safe(F.col("toxic") == 0, F.col("verdict"), F.col("quality") * 10.0, F.lit(8.0)).alias("accepted"))


@query("SELECT doc_id, coalesce(quality = 1, true) AS accepted FROM documents LEFT JOIN labels USING (doc_id)")
def accept_gate_failopen(spark, sf_dir):
    return _gated(spark, sf_dir).select("doc_id", validate.accepted_fail_open(F.col("verdict")).alias("accepted"))


STOP = "[" + ", ".join(f"'{w}'" for w in S.STOPWORDS) + "]"
TOPIC = "[" + ", ".join(f"'{w}'" for w in S.TOPIC_STOPWORDS) + "]"


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{{3,}}'), lambda w: NOT list_contains({STOP}, lower(w))) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w), f AS (SELECT doc_id, lower(t) AS l, arg_min(t, i) AS t, min(i) AS i FROM u GROUP BY doc_id, lower(t)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT w.doc_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS keywords FROM w LEFT JOIN (SELECT * FROM r WHERE n <= 10) r ON w.doc_id = r.doc_id GROUP BY w.doc_id""")
def keyword_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.keywords(F.col("text")).alias("keywords"))


@query(f"""WITH t AS (SELECT list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda w: NOT list_contains({TOPIC}, w)) AS t FROM benchmark ORDER BY item_id LIMIT 1)
SELECT doc_id, round(CASE WHEN (SELECT len(t) FROM t) = 0 THEN 1 ELSE len(list_intersect((SELECT t FROM t), list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}')))) / ((SELECT len(t) FROM t) + 1e-5::DOUBLE) END, 9) AS relevance FROM documents""")
def lexical_relevance(spark, sf_dir):
    target = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()[0]
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.lexical_relevance(F.lit(target), F.col("text")), 9).alias("relevance"))


@query(r"SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'unknown_chunk' WHEN contains(trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(substr(a.text, 3, 40)), '\s+', ' ', 'g'))) THEN 'ok' ELSE 'not_in_chunk' END AS verdict FROM documents a LEFT JOIN documents b ON b.doc_id = CASE WHEN a.doc_id % 3 = 0 THEN a.doc_id + 1 WHEN a.doc_id % 3 = 1 THEN a.doc_id ELSE -1 END")
def quote_containment(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    target = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).when(F.col("doc_id") % 3 == 1, F.col("doc_id")).otherwise(-1)
    e = d.select("doc_id", target.alias("source_chunk_id"), F.concat(F.lit("  "), F.substring("text", 3, 40)).alias("quote"))
    return validate.evidence_checks(e, d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))).select("doc_id", "verdict")


def _papers(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array(F.concat(F.lit("Ann "), F.col("p_brand"))).alias("authors"), (F.lit(1990) + F.col("p_size")).cast("int").alias("publication_year"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("venue"), F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("doi"), F.when(F.col("p_partkey") % 3 == 0, "2301.00001").alias("arxiv_id"),
    )


BIB = r"""regexp_replace(lower(p_brand), '[^\w]', '', 'g') || (1990 + p_size) || coalesce(list_filter(regexp_split_to_array(lower(regexp_replace(p_name, '[^\w\s]', '', 'g')), '\s+'), lambda w: len(w) > 3)[1], 'paper')"""


@query(f"""SELECT p_partkey AS id, '@article{{' || {BIB} || E',\\n  title = {{' || p_name || E'}},\\n  author = {{Ann ' || p_brand || E'}},\\n  year = {{' || (1990 + p_size) || E'}},\\n  journal = {{'
|| CASE WHEN p_partkey % 2 = 0 THEN p_type WHEN p_partkey % 3 = 0 THEN 'arXiv preprint' ELSE 'Publication' END || E'}},\\n  doi = {{10.1/' || p_partkey || '}}'
|| CASE WHEN p_partkey % 3 = 0 THEN E',\\n  eprint = {{2301.00001}},\\n  archiveprefix = {{arXiv}}' ELSE '' END || E'\\n}}' AS bibtex FROM part""")
def bibtex_entry(spark, sf_dir):
    p = _papers(spark, sf_dir)
    return p.select("id", report.bibtex(p).alias("bibtex"))


@query("SELECT p_partkey AS paper_id, p_name AS title, 'text ' || p_partkey AS paragraph_summary FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 4 = 1")
def report_rows(spark, sf_dir):
    p = _papers(spark, sf_dir)
    cand = p.select(F.col("id").alias("paper_id"), F.col("id").alias("candidate_paper_id"), F.lit(1).alias("run_id"))
    s = p.filter("id % 5 <> 0").select(F.col("id").alias("candidate_paper_id"), F.lit(1).alias("run_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("paragraph_summary"), (F.col("id") % 4 == 1).alias("is_accepted"))
    return report.report_rows(cand, p, s).select("paper_id", "title", "paragraph_summary")


@query(r"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def page_header_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(name) for name, c in files.page_header(F.col("html"), F.col("url")).items()))


@query("""WITH q AS (SELECT source AS run_id, doc_id AS id, coalesce(quality = 1 AND toxic = 0, false) AS ok FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER w AS position, coalesce(sum(ok::INT) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q WINDOW w AS (PARTITION BY run_id ORDER BY id))
SELECT run_id, id, position, ok AS accepted FROM r WHERE before < 5 AND position <= 40""")
def quota_loop(spark, sf_dir):
    q = _gated(spark, sf_dir).select(F.col("source").alias("run_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), "quality", "toxic")
    out = quota.one_round(q, (F.col("quality") == 1) & (F.col("toxic") == 0), target=5, depth=40)
    return out.select("run_id", "id", F.col("position").cast("long").alias("position"), "accepted")


@query("""WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(CAST(l_quantity AS BIGINT)) AS weight FROM lineitem GROUP BY ALL),
h AS (SELECT s_nationkey AS run_id, dst AS id, max(weight) AS weight FROM supplier JOIN e ON src = s_suppkey GROUP BY ALL)
SELECT run_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY weight DESC, id) AS rank FROM h) WHERE rank <= 100""")
def graph_related(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"))
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("id"))
    return expand.related(seeds, e).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH w AS (SELECT doc_id, list_distinct({TOKENS.format('lower(text)')}) AS w FROM documents),
a AS (SELECT doc_id, CASE WHEN list_has_all(w, ['the', 'of', 'and', 'qqqq', 'zzzz']) THEN 0 WHEN list_has_all(w, ['the', 'of']) THEN 1 WHEN list_contains(w, 'the') THEN 2 END AS attempt FROM w)
SELECT doc_id, CAST(attempt AS BIGINT) AS attempt FROM a WHERE attempt = (SELECT min(attempt) FROM a) ORDER BY doc_id LIMIT 100""")
def relaxed_search(spark, sf_dir):
    return expand.search(table(spark, sf_dir, "documents"), "the of and qqqq zzzz", F.col("text"), 100, [F.col("doc_id")]).select("doc_id", F.col("attempt").cast("long").alias("attempt"))


@query("SELECT doc_id, sha256(replace(text, chr(1), '')) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.content_hash(F.regexp_replace("text", "\\u0001", "").cast("binary")).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_status(spark, sf_dir):
    return files.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    out = streaming_events.windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {BM25}, sp AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS s_rank FROM sparse),
de AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {SEED}), 9) DESC, doc_id) AS d_rank FROM documents JOIN embeddings ON vec_id = doc_id),
f AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.doc_id, b.doc_id) AS doc_id, d_rank, s_rank, round(coalesce(1.0::DOUBLE / (60 + d_rank), 0) + coalesce(1.0::DOUBLE / (60 + s_rank), 0), 12) AS rrf
  FROM (SELECT * FROM de WHERE d_rank <= 30) a FULL JOIN (SELECT * FROM sp WHERE s_rank <= 30) b ON a.source = b.source AND a.doc_id = b.doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rrf DESC, d_rank NULLS LAST, s_rank NULLS LAST) AS place FROM f),
k AS (SELECT p.source, p.doc_id, rrf, place, text AS c FROM p JOIN documents d ON p.doc_id = d.doc_id WHERE place <= 24)
SELECT source, doc_id, rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS rank FROM (SELECT * FROM k WHERE {CLEAN_MACRO.replace("string_split(c, ' ')", "list_filter(regexp_split_to_array(c, '\\s+'), lambda t: t <> '')")})) WHERE rank <= 8""")
def hybrid_search(spark, sf_dir):
    """Documents with the vector of their own number, where there is one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, sf_dir, "documents")
    near = d.select("source", "doc_id").join(e, "doc_id")
    return retrieve.hybrid(d, SEARCH, _seed(spark, sf_dir), "source", "doc_id", "text", vectors=near).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT s_suppkey AS l, b.p_partkey AS r, 1.0::DOUBLE AS ratio FROM supplier JOIN part a ON a.p_partkey = s_suppkey JOIN part b ON b.p_name = a.p_name")
def fuzzy_title_pairs(spark, sf_dir):
    """Titles that are alike: of two words each, so only equal ones reach the ratio."""
    from ..operators import match

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("int").alias("publication_year"))
    s = table(spark, sf_dir, "supplier").join(p.withColumnRenamed("id", "k"), F.col("k") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("id"), F.concat(F.col("title"), F.lit("!")).alias("title"), F.lit(None).cast("int").alias("publication_year"))
    return match.title_matches(s, p, digits=6)
