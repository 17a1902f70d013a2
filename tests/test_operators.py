"""Small fixtures for the scholarly operators."""

import os
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.operators import availability, candidates, chunk, components, embed, exclude, expand, fuse, inverted, match, quota, report, retrieve, screen, summarize, validate
from lodestone.plans import queries
from lodestone.sources import files, paper_text, scholarly, store

PAPER = "id string, title string, doi string, arxiv_id string, openalex_id string, s2_id string, publication_year int, year int"


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "f, raw, want",
    [
        (N.doi, "https://doi.org/10.1234/ABC.123", "10.1234/abc.123"), (N.doi, "DOI:10.1000/182", "10.1000/182"), (N.doi, None, None), (N.doi, " / ", None),
        (N.arxiv, "arXiv:2301.12345v2", "2301.12345"), (N.arxiv, "https://arxiv.org/abs/2106.00001", "2106.00001"), (N.arxiv, "2608.12838v1[math.st]", "2608.12838"), (N.arxiv, "cs/0112017", None),
        (N.openalex_id, "https://openalex.org/w2741809807", "W2741809807"), (N.s2_id, "CorpusId:77", "77"), (N.title, "Deep  Residual   Learning...", "deep residual learning"), (N.title, "Étude: naïve!", "étude naïve"),
    ],
)
def test_normalise(spark, f, raw, want):
    assert one(spark, f, raw) == want


def test_identifiers_and_tokens(spark):
    found = one(spark, N.identifiers, "See 10.1000/xyz. and arXiv: 2301.12345v1, 10.1000/xyz")
    assert [(r.kind, r.id) for r in found][:2] == [("doi", "10.1000/xyz"), ("arxiv", "2301.12345v1")]
    assert one(spark, N.tokens, "  a b\n\tc ") == ["a", "b", "c"] and one(spark, N.tokens, None) == []


def test_match(spark):
    rows = [("a", "Deep learning", "https://doi.org/10.1/X", None, None, None, 2017, None), ("b", "Attention is all you need", None, "1706.03762v5", None, None, 2017, None), ("c", "Other thing entirely", None, None, None, None, 2017, None)]
    others = [("p", "zzz", "10.1/x", None, None, None, None, None), ("q", "Attention Is All You Need!", None, "1706.03762", None, None, 2018, None), ("r", "Other thing entirely", None, None, None, None, None, 2022)]
    m = match.matches(spark.createDataFrame(rows, PAPER), spark.createDataFrame(others, PAPER))
    assert {(r.l, r.r) for r in m.collect()} == {("a", "p"), ("b", "q")}


def test_token_set_ratio():
    assert S.token_set_ratio("bert", "bert for all of us") == 1.0
    assert S.token_set_ratio("candidate work 1", "candidate work 2") < 0.96
    rng = random.Random(3)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in "ab")
        assert S._common_subsequence(a, b) == lcs(a, b)


def test_exclusion(spark):
    row = lambda i, doi: (i, None, doi, None, None, None, None, None)
    frame = lambda *r: spark.createDataFrame(list(r), PAPER)
    seed, cited, found = frame(row("s", "10.1000/1")), frame(row("c", "10.1000/2")), frame(row("x", "10.1000/1"), row("y", "10.1000/2"), row("z", "10.1000/3"))
    assert [r.id for r in exclude.exclude(found, seed, cited).collect()] == ["z"]
    with pytest.raises(exclude.ExclusionIncomplete):
        exclude.exclude(found, seed, cited, status="incomplete")
    with pytest.raises(Exception, match="exclusion status"):
        exclude.guarded(found.withColumn("s", F.lit("incomplete")), F.col("s")).collect()


def test_fusion_and_retrieval(spark):
    d = spark.createDataFrame([(0, "c1", 1), (0, "c2", 2)], "p int, id string, rank int")
    s = spark.createDataFrame([(0, "c2", 1), (0, "c3", 2)], "p int, id string, rank int")
    rows = retrieve.fuse(d, s, "p", "id").orderBy(F.desc("rrf"), "id").collect()
    assert [r.id for r in rows][0] == "c2" and len(rows) == 3
    docs = spark.createDataFrame([(0, "c1", "convolutional networks for images"), (0, "c2", "the transformer uses self-attention"), (0, "c3", "reinforcement learning")], "p int, id string, t string")
    best = retrieve.top(retrieve.bm25(docs, "transformer self-attention", "p", "id", "t"), "p", "score", "id", 3).orderBy("rank").collect()
    assert best[0].id == "c2" and len(best) == 3 and best[2].score == 0
    v = spark.createDataFrame([("A", "a", [1.0, 0.1]), ("B", "b", [1.0, 0.0]), ("A", "n", [-1.0, 0.0])], "paper string, id string, embedding array<double>")
    got = retrieve.dense(v, [1.0, 0.0], "paper", "id").filter("paper = 'A'").orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "n"]


def test_merge(spark):
    rows = [(1, "https://doi.org/10.1/A", None, "s1", 1), (2, "10.1/a", "V", "s2", 2), (3, "10.1/b", "W", "s1", 3)]
    pool = spark.createDataFrame([(i, d, v, s, p, None, None) for i, d, v, s, p in rows], "id int, doi string, venue string, source string, pos int, title string, publication_year int")
    got = {r.id: r for r in fuse.deduplicated(pool, ["pos"], source="source").collect()}
    assert set(got) == {1, 3} and got[1].venue == "V" and got[1].source_apis == ["s1", "s2"] and got[1].doi == "10.1/a"


def test_screening(spark):
    seed = spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>")
    c = spark.createDataFrame([("a", "x", [0.85, 0.526783]), ("b", "x", [0.2, 0.979796]), ("c", " ", [1.0, 0.0])], "id string, abstract string, embedding array<double>")
    got = {r.id: (r.abstract_relevance_score, r.abstract_relevance_tier) for r in screen.scored(c, seed).collect()}
    assert got == {"a": (8.5, "high"), "b": (2.0, "irrelevant"), "c": (5.0, "moderate")}
    dropped = screen.scored(c, seed, "drop")
    assert [r.id for r in screen.relaxed(dropped, "abstract_relevance_score", 6.0, 5, [F.col("id")]).collect()] == ["a"]
    assert [r.id for r in screen.relaxed(dropped, "abstract_relevance_score", 9.0, 3, [F.col("id")]).orderBy("final_rank").collect()] == ["a", "b", "c"]


def test_chunks(spark):
    docs = spark.createDataFrame([("d", "Word " * 120), ("e", None), ("f", "")], "doc_id string, text string")
    rows = chunk.chunks(docs, parent=(50, 10), child=(20, 5), min_words=5).orderBy("chunk_index").collect()
    assert {r.chunk_type for r in rows} == {"parent", "child"} and all(r.parent_index is not None for r in rows if r.chunk_type == "child")
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and {r.doc_id for r in rows} == {"d"}


def test_text_predicates(spark):
    assert one(spark, T.is_reference, ",14,15,16,17,18") and one(spark, T.is_reference, "Smith et al. 2001; Jones et al. 2002") and not one(spark, T.is_reference, "plain prose about networks")
    assert one(spark, T.is_reference, "Lee, Lee,Lee, Lee,Lee, Lee,Kim, Lee,Park, Lee,Lee, Lee,Lee,")
    assert one(spark, T.is_low_quality, "1 2 3") and not one(spark, T.is_low_quality, "words " * 25)
    assert one(spark, T.json_object, 'x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    text = "PROBLEM: what it is about\nMETHODOLOGY: how it is done\nRESULTS: what was found\nSYNTHESIS: all of it together\nRELATIONSHIP TO TARGET PAPER: they are related"
    got = spark.createDataFrame([(text,)], "x string").select(*[c.alias(k) for k, c in T.sections(F.col("x")).items()]).first()
    assert list(got) == ["what it is about", "how it is done", "what was found", "all of it together", "they are related"]
    assert [(r.id, r.content) for r in one(spark, T.prompt_chunks, "[CHUNK id=a index=1]\nfirst\n\n[CHUNK id=b]\nsecond")] == [("a", "first"), ("b", "second")]
    assert one(spark, T.inverted_abstract, {"b": [1], "a": [0, 2]}, "map<string,array<int>>") == "a b a"
    assert one(spark, S.keywords, "Deep deep learning with graph-based models") == "Deep learning graph-based models"


def test_availability(spark):
    for t in ("Israeli", "negative", "geospatial"):
        assert one(spark, availability.pattern_score, t) == 0
    assert one(spark, availability.pattern_score, "Data availability: GSE123 upon reasonable request") == 23
    rows = [("p", i, "filler words here", 10) for i in range(25)] + [("p", 25, "Data availability: deposited in GSE1", 10)]
    c = spark.createDataFrame(rows, "paper_id string, chunk_index int, content string, token_count int")
    assert [r.chunk_index for r in availability.context(c, budget=1000).orderBy("chunk_index").collect()] == [24, 25]
    assert [r.chunk_index for r in availability.context(c, budget=5).collect()] == [25]
    assert "index=25]" in availability.formatted(c.withColumn("id", F.lit("x")), "paper_id").first().context


def test_validation(spark):
    ev = [("c1", "cannot be shared", None, None)]
    base = dict(dataset_name=None, role="primary", status="unclear", repository=None, accession=None, url=None, access_conditions=None, ownership="public", required_for_reproduction=None, evidence=ev)
    cases = [
        ({}, []), ({"evidence": []}, ["evidence_required"]), ({"status": "publicly_available", "repository": "GitHub", "url": "https://github.com/x"}, ["code_host_only"]),
        ({"status": "publicly_available"}, ["no_location"]), ({"status": "publicly_available", "accession": "GSE1"}, []), ({"status": "not_available"}, []),
        ({"status": "not_available", "evidence": [("c", "so it is", None, None)]}, ["no_denial"]), ({"status": "not_reported", "evidence": [("c", "available on request", None, None)]}, ["access_discussed"]), ({"status": "odd"}, ["unknown_status"]),
    ]
    rows = [(i, tuple((base | c).values())) for i, (c, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, f"i int, d {validate.DATASET}").select("i", validate.dataset_violations(F.col("d")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [w for _, w in cases]
    roll = [([], False, "not_reported"), ([], True, "unclear"), (["not_reported"], True, "not_reported"), (["restricted", "not_reported"], True, "restricted"), (["restricted", "unclear"], True, "mixed")]
    got = spark.createDataFrame(roll, "s array<string>, e boolean, want string").withColumn("got", validate.overall_status(F.col("s"), F.col("e"))).collect()
    assert all(r.got == r.want for r in got)
    s = spark.createDataFrame([("w " * 305, "unclear"), ("a\nb", "unclear"), ("fine", "proprietary")], "paragraph_summary string, data_availability string")
    assert [r[0] for r in s.select(validate.summary_violations(s, ["paragraph_summary"])).collect()] == [["too_many_words"], ["several_paragraphs"], ["unknown_status"]]
    assert [r.data_availability for r in files.remap_legacy(s).collect()] == ["unclear"] * 3


def test_chunk_counts(spark):
    """Sums of blocks say of every window what the text itself does, or leave it open; few are open in prose."""
    rng = random.Random(5)
    prose = "one two 12 ; 3 the method shows results of many trials".split()
    odd = ["et", "al.", "Supplementary", "Figure", "10.1234/ab", "1999;", "2001", ";", "12", "https://x.org", "s3-", "s3.x", "Lee,", "Smith,Lee,", ",", "Lee", "1.", "A", "x\u2028y", "\u2028", "12.", "B", "é", "-", "7,8,9,", "x.tar.gz", "y.fasta"]
    rows = [(i, [rng.choice(odd if rng.random() < share else prose) for _ in range(rng.choice((5, 16, 31, 64)))]) for i in range(400) for share in (rng.choice((0.05, 0.3, 1.0)),)]
    rows += [(1000, ["12,"] * 6), (1001, "a " * 5), (1002, "Lee, Smith, Lee, Wood, Lee, Smith, Lee, Hill, and more words stand here".split())]
    rows = [(i, w.split() if isinstance(w, str) else w) for i, w in rows]
    for unit in (1, 4, 16):
        d = spark.createDataFrame(rows, "id int, w array<string>").withColumn("s", T.summed(T.marks(F.col("w"), unit)))
        got = d.select("id", T.surely_clean(F.col("s"), F.size("w"), 3).alias("sure"), T.is_clean(F.array_join("w", " "), 3).alias("is")).collect()
        assert [r for r in got if r.sure is not None and r.sure != r["is"]] == []
        assert sum(r.sure is None for r in got) < len(got) / 2 and {r["is"] for r in got} == {True, False}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(2000, None), (2001, ""), (2002, " \n ")], "doc_id int, text string")
    sizes = {"parent": (24, 8), "child": (8, 4), "min_words": 3}
    whole = chunk.chunks(docs, **sizes, joined=lambda c: F.array_join(c, " "))  # reads every window
    assert sorted(map(tuple, chunk.chunks(docs, **sizes).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_titles_behind_the_start(spark):
    """A title further back than what is read first, and texts just at that size."""
    skip = "Preprint\n" * 300
    texts = {1: skip + "A Long Way\nto the title of it\nAnn Lee\n", 2: "x" * 1999 + "\ny of it", 3: "x" * 3000, 4: skip, 5: "", 6: None, 7: "First of all\r\n" + "second of these " * 200, 8: skip + "\nAbstract\nfar back"}
    got = {r.id: (r.title, r.abstract) for r in paper_text.with_title_and_abstract(spark.createDataFrame(list(texts.items()), "id int, text string")).collect()}
    assert got[1][0] == "A Long Way to the title of it" and got[2][0] == "x" * 1999 + " y of it" and got[3][0] == "x" * 3000
    assert got[4][0] == "Preprint" and got[5] == got[6] == (None, None) and got[7][0] == "First of all " + ("second of these " * 200).strip() and got[8][1] == "far back"


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.stored(spark, path) is None
    store.upsert(spark.createDataFrame([], "id int, v string"), path, ["id"])
    assert store.stored(spark, path) is None
    first = spark.createDataFrame([(i, f"a\0{i}") for i in range(20)], "id int, v string")
    for _ in range(2):
        store.upsert(first, path, ["id"], buckets=4)
        assert sorted(r.v for r in store.stored(spark, path).collect()) == sorted(f"a{i}" for i in range(20))
    store.upsert(spark.createDataFrame([(3, "b", 1), (30, "c", 2)], "id int, v string, w int"), path, ["id"], buckets=4)
    store.upsert(spark.createDataFrame([(3, "no", 9), (31, "d", 9)], "id int, v string, w int"), path, ["id"], update=False, buckets=4)
    got = {r.id: (r.v, r.w) for r in store.stored(spark, path).collect()}
    assert len(got) == 22 and got[3] == ("b", 1) and got[30] == ("c", 2) and got[31] == ("d", 9) and got[4] == ("a4", None)


def test_get_or_create(spark, tmp_path):
    path, schema = str(tmp_path / "papers"), "id int, doi string, arxiv_id string, s2_id string, title string"
    batch = spark.createDataFrame([(1, "A", "X", None, None), (2, "B", "X", "", "two"), (3, "B", None, None, "three"), (4, None, None, None, "alone"), (5, "", None, None, "alone"), (6, None, None, "S", "six"), (7, "C", None, "S", "sev\0en")], schema)
    got = {r.id: (r.paper_id, r.created) for r in store.get_or_create(batch, path, buckets=4).collect()}
    key = {i: k for i, (k, _) in got.items()}
    assert all(c for _, c in got.values()) and key[1] == key[2] == key[3] and key[6] == key[7] and len(set(key.values())) == 4
    papers = lambda: sorted(map(str, store.stored(spark, f"{path}/papers").drop("bucket").collect()))
    once = papers()
    assert len(once) == 4 and any("title='two'" in r and "doi='A'" in r for r in once)
    again = {r.id: (r.paper_id, r.created) for r in store.get_or_create(batch, path, buckets=4).collect()}
    assert papers() == once and again == {i: (k, False) for i, k in key.items()}
    # Found by the first kind that leads anywhere; what is found learns nothing; the rest are new.
    more = spark.createDataFrame([(1, "A", None, "S", None), (2, "no", None, "S", None), (3, "Z", "Q", None, "new"), (4, "no", None, None, None)], schema)
    got = {r.id: (r.paper_id, r.created) for r in store.get_or_create(more, path, buckets=4).collect()}
    assert got[1] == (key[1], False) and got[2] == (key[6], False) and got[3][1] and got[4][1] and len(papers()) == 6
    assert store.get_or_create(batch.limit(0), path, buckets=4).count() == 0 and len(papers()) == 6


def test_quota(spark):
    rows = [("r", f"p{i}", i, i != 1) for i in range(9)]
    q = spark.createDataFrame(rows, "run_id string, id string, rank int, ok boolean")
    got = quota.one_round(q, F.col("ok"), target=3).filter("accepted").orderBy("rank").collect()
    assert [r.id for r in got] == ["p0", "p2", "p3"]
    two = q.filter("rank < 1")
    more = spark.createDataFrame([("r", "n1", 1, True), ("r", "p0", 2, True)], "run_id string, id string, rank int, ok boolean")
    out = quota.loop(two, lambda d: F.col("ok"), lambda accepted, seen: more, target=2)
    assert {r.id for r in out.filter("accepted").collect()} == {"p0", "n1"}
    dup = spark.createDataFrame([("r", "a", 1, True), ("r", "a", 2, True), ("r", "b", 3, True)], "run_id string, id string, rank int, ok boolean")
    assert [r.evaluated for r in quota.one_round(dup, F.col("ok"), target=10).orderBy("rank").collect()] == [True, False, True]


def test_salted_join_keeps_columns(spark):
    """Names of either side that look like the salt's stay."""
    from lodestone.operators.components import spread_join

    left = spark.createDataFrame([(i % 3, i, "mine") for i in range(30)], "k int, i int, __salt string")
    right = spark.createDataFrame([(k, k * 10) for k in range(3)], "k int, __salts int")
    hot = spark.createDataFrame([(1,)], "k int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = (spread_join(left, right, "k", "i", h, how) for h in (hot, None))
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_page_header(spark):
    from lodestone.sources import files

    df = spark.createDataFrame([("<html><title>a\nb</title><title>c</title>", "https://x.org:80/y"), ("<p>", "ftp://x"), (None, None)], "html string, url string")
    got = df.select(*(c.alias(n) for n, c in files.page_header(F.col("html"), F.col("url")).items())).collect()
    assert [tuple(r) for r in got] == [("a\nb", "x.org:80"), ("", ""), (None, None)]


def test_quota_rounds(spark):
    """A chain of works, one new work a round: the quota, the depth or the end of the chain stops it, each run for itself."""
    columns = "run_id string, id string, rank int, ok boolean"
    start = spark.createDataFrame([(r, f"{r}0", 0, True) for r in "abc"], columns)
    length = {"a": 30, "b": 8, "c": 30}
    works = spark.createDataFrame([(r, f"{r}{i}", i, r != "c" or i == 0) for r in "abc" for i in range(length[r])], columns).withColumn("n", F.col("rank"))

    def expand(accepted, seen):
        last = seen.groupBy("run_id").agg(F.max("rank").alias("last"))
        return works.join(last, "run_id").filter(F.col("n") == F.col("last") + 1).select("run_id", "id", "rank", "ok")

    rows = quota.loop(start, lambda d: F.col("ok"), expand, target=9, depth=12).collect()
    assert {r: sorted(x.rank for x in rows if x.run_id == r) for r in "abc"} == {"a": list(range(9)), "b": list(range(8)), "c": list(range(12))}
    assert all(x.position == x.rank + 1 for x in rows)


def test_report(spark):
    p = spark.createDataFrame([("Attention Is All You Need", ["Ashish Vaswani", "Noam Shazeer"], 2017, "NeurIPS", None, "1706.03762")], "title string, authors array<string>, publication_year int, venue string, doi string, arxiv_id string")
    key, entry = p.select(report.bibtex_key(p), report.bibtex(p)).first()
    assert key == "vaswani2017attention" and "journal = {NeurIPS}" in entry and entry.endswith("\n}")
    rows = spark.createDataFrame(
        [("Second", ["B"], 2020, None, "10.1/x", None, 2, None, None, None), ("a <b>", ["John Doe"], 2023, "ICML", None, "2301.00001", 1, "Single paragraph.", "Direct extension.", "https://host/x?a=1&b='2'")],
        "title string, authors array<string>, publication_year int, venue string, doi string, arxiv_id string, rrf_rank int, paragraph_summary string, relationship_to_target string, data_location string",
    )
    page = report.export(rows, "Test <Report>", {"title": "Base Input Paper", "doi": "10.1000/base"}, "complete")
    for part in ("<h1>Test &lt;Report&gt;</h1>", "Discovered Related Literature (2 Papers)", "<h2>a &lt;b&gt;</h2>", "Relationship to Target Paper</h3><p>Direct extension.", "Exclusion Status: complete", "arXiv: N/A", "No abstract text available.", "href='https://host/x?a=1&amp;b=&#39;2&#39;'", "<pre>@article{doe2023paper,", "archiveprefix"):
        assert part in page, part
    assert page.index("a &lt;b&gt;</h2>") < page.index("<h2>Second")


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title type="main">A Title</title></titleStmt><sourceDesc><biblStruct><idno type="DOI">10.1234/sample</idno>
<monogr><imprint><date type="published" when="2023-05-01"/></imprint></monogr></biblStruct></sourceDesc></fileDesc></teiHeader><text><back><listBibl>
<biblStruct xml:id="b0"><analytic><title level="a">First cited</title><author><persName><forename type="first">Ann</forename><surname>Lee</surname></persName></author><idno type="arXiv">1706.03762</idno></analytic><monogr><imprint><date when="2017"/></imprint></monogr></biblStruct>
<biblStruct xml:id="b1"><analytic><title level="a">Second</title><idno type="DOI">10.1109/x</idno></analytic><monogr><imprint/></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_sources(spark, tmp_path):
    x = spark.createDataFrame([(1, TEI)], "id int, xml string")
    h = x.select(*[c.alias(k) for k, c in scholarly.tei_header(F.col("xml")).items()]).first()
    assert (h.title, h.doi, h.arxiv_id, h.publication_year, h.authors, h.abstract) == ("A Title", "10.1234/sample", None, 2023, [], "")
    refs = scholarly.tei_references(x).orderBy("pos").collect()
    assert [(r.title, r.authors, r.doi, r.arxiv_id, r.year) for r in refs] == [("First cited", ["Ann Lee"], None, "1706.03762", 2017), ("Second", [], "10.1109/x", None, None)]
    w = spark.createDataFrame([('{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1/A","display_name":"T","authorships":[{"author":{"display_name":"X"}}],"publication_year":2020,"abstract_inverted_index":{"b":[1],"a":[0]}}',)], "json string")
    r = scholarly.works(w).first()
    assert (r.openalex_id, r.doi, r.title, r.authors, r.publication_year, r.abstract, r.is_open_access) == ("W1", "10.1/a", "T", ["X"], 2020, "a b", False)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    got = files.binaries(spark, str(tmp_path)).select(F.substring_index("path", "/", -1).alias("n"), files.is_pdf(F.col("content")).alias("ok"), "sha256").collect()
    assert {r.n: r.ok for r in got} == {"a.pdf": True, "b.pdf": False}
    assert one(spark, lambda c: files.file_name(F.lit(None).cast("string"), c, c), "10.1/a:b") == "10_1_a_b.pdf"
    files.write_clean(spark.createDataFrame([("a\x00b",)], "s string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().s == "ab"
    assert one(spark, paper_text.front_matter, "Title\nAbstract\n1. Introduction\nBody") == "Title\nAbstract"


TEXT = """Preprint: Under Review 298:1-21, 2026
Robust Estimation for
low-frequency Variants
Anonymous Author
doi 10.1234/own.1.
Abstract
We study variants.
Across cohorts.
1. Introduction
See 10.5555/other, and arXiv:2301.00001v2.
References
[1] 10.5555/other"""


def test_paper_text(spark):
    d = spark.createDataFrame([(1, TEXT), (2, None), (3, "Only one line"), (4, "12\nIntroduction\n")], "id int, text string")
    got = {r.id: r for r in paper_text.metadata(d).collect()}
    assert (got[1].title, got[1].abstract, got[1].doi, got[1].arxiv_id) == ("Robust Estimation for low-frequency Variants", "We study variants. Across cohorts.", "10.1234/own.1", None)
    assert (got[2].title, got[2].abstract, got[2].doi) == (None, "", None)
    assert got[3].title == "Only one line" and got[4].title == "Introduction"
    body = {r.id: r.body for r in paper_text.with_matter(d).collect()}
    assert body[1] == TEXT[: TEXT.index("\nReferences")] and body[2] == ""
    refs, status = paper_text.references(d, spark.createDataFrame([(3, "10.1/x")], "id int, doi string"), d, spark.createDataFrame([(4, "10.2/y"), (3, "10.9/z")], "id int, doi string"))
    assert sorted((r.id, r.stage, r.doi or r.arxiv_id) for r in refs.collect()) == [(1, 2, "10.1234/own.1"), (1, 2, "10.5555/other"), (1, 2, "2301.00001v2"), (3, 1, "10.1/x"), (4, 3, "10.2/y")]
    assert {r.id: r.exclusion_status for r in status.collect()} == {1: "complete", 2: "incomplete", 3: "complete", 4: "complete"}
    spans = spark.createDataFrame([(1, 20.0, 1.0, 0, "A Large"), (1, 19.6, 2.0, 1, " Title "), (1, 10.0, 0.0, 2, "small"), (2, 20.0, 0.0, 0, "arXiv: 12345")], "id int, size double, top double, pos int, text string")
    assert [tuple(r) for r in paper_text.largest_font_title(spans, "id").collect()] == [(1, "A Large Title")]


def test_candidates(spark):
    fields = "id int, title string, doi string, abstract string, embedding array<double>, rank int"
    seed = spark.createDataFrame([(0, "Seed", "10.1/seed", "about things", [1.0, 0.0])], "id int, title string, doi string, abstract string, embedding array<double>")
    cited = spark.createDataFrame([(9, "Cited", "10.1/cited", None, None)], seed.schema)
    a = spark.createDataFrame([(1, None, "10.1/a", "x", [0.7, 0.714143], 1), (2, None, "10.1/cited", "x", [1.0, 0.0], 2)], fields)
    b = spark.createDataFrame([(3, "Late title", "doi:10.1/A", None, None, 1), (4, None, "10.1/b", "x", [0.2, 0.979796], 2), (5, None, "10.1/seed", "x", [1.0, 0.0], 3)], fields)
    lists = {"one": [a], "two": [b]}
    got = candidates.build(seed, cited, lists, least=1.0).orderBy("rrf_rank").collect()
    assert [(r.id, r.title, r.source_apis, r.abstract_relevance_score) for r in got] == [(1, "Late title", ["one", "two"], 7.0), (4, None, ["two"], 2.0)]
    with pytest.raises(exclude.ExclusionIncomplete):
        candidates.build(seed, cited, lists, "incomplete")
    pool = spark.createDataFrame([(1, "x", [0.7, 0.714143]), (2, " ", None)], "id int, abstract string, embedding array<double>")

    def broken(d):
        return d.withColumn("abstract_relevance_score", F.raise_error(F.lit("no model")).cast("double")).withColumn("abstract_relevance_tier", F.lit("high"))

    def told(d):
        return d.withColumn("abstract_relevance_score", F.lit(9.0)).withColumn("abstract_relevance_tier", F.lit("high"))

    assert [(r.id, r.abstract_relevance_score) for r in candidates.screened(seed, pool, broken).collect()] == [(1, 7.0)]
    assert [(r.id, r.abstract_relevance_score) for r in candidates.screened(seed, pool, told).collect()] == [(1, 9.0)]


def test_summaries(spark):
    chunks = spark.createDataFrame([(1, "c1", 0, "Data are in GSE12 at the archive", 7), (1, "c2", 1, "The method is fast", 4), (2, "c3", 0, "One two three four five six", 6)], "paper_id int, id string, chunk_index int, content string, token_count int")
    cut = summarize.trimmed(chunks, "paper_id", "chunk_index", 5).collect()
    assert sorted((r.id, r.content, r.token_count) for r in cut) == [("c1", "Data are in GSE12 at", 5), ("c3", "One two three four five", 5)]
    papers = spark.createDataFrame([(1, "T", ["A B"], 2020), (2, "malformed", None, None), (3, "No chunks", None, 2021)], "paper_id int, title string, authors array<string>, publication_year int")
    rows = summarize.prompts(papers, chunks, "Seed", "About seeds")
    got = {r.paper_id: r for r in summarize.summarized(rows, summarize.RuleModel()).collect()}
    assert got[1].is_accepted and got[1].data_availability == "publicly_available" and got[1].data_location == "GEO: GSE12" and got[1].relevance_score == 8.0
    assert not got[2].is_valid and not got[2].is_accepted and (got[2].verdict, got[2].relevance_score) == ("rejected", 0.0)
    assert got[3].is_valid and got[3].data_availability == "not_reported"


def test_titles_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 14)))
    titles = [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(60)]
    near = []
    for t in titles:
        x = list(t)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "k", " "])
            x = x or ["k"]
        near.append("".join(x))
    near += ["".join(w + "s " for w in t.split()) for t in titles]
    left, right = (spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id int, title string") for ts in (titles, near))
    clean = lambda ts: [" ".join(t.split()) for t in ts]
    for ratio in (0.96, 0.9):
        want = {(i, j) for i, x in enumerate(clean(titles)) for j, y in enumerate(clean(near)) if S.token_set_ratio(x, y) >= ratio}
        alone = sum(not set(titles[i].split()) & set(near[j].split()) for i, j in want)
        got = {(r.l, r.r) for r in match.title_matches(left, right, ratio=ratio).collect()}
        assert got == want and alone > 3


def test_common_words_make_no_block(spark):
    """300 titles that share two words are not compared pair by pair, while one that is part of all of them still meets them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    titles = [f"towards {word()} {word()} learning {word()}" for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert match.title_pairs(df, df).count() < 2000
    one = spark.createDataFrame([("learning towards",)], "t string")
    assert match.title_pairs(one, df).count() == match.title_pairs(df, one).count() == 300


def test_short_titles_of_one_make(spark):
    """730 titles that share all words but one: few pairs, and none is missed."""
    rng = random.Random(9)
    codes = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice([2, 3, 3, 3]))) for _ in range(820)})[:730]
    titles = [f"a survey of {c}" for c in codes]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    assert match.title_pairs(*[df.select(F.col("title").alias("t"))] * 2).count() < 20 * len(titles)
    want = {(i, j) for i, x in enumerate(titles) for j, y in enumerate(titles) if S.token_set_ratio(x, y) >= match.RATIO}
    assert {(r.l, r.r) for r in match.title_matches(df, df).collect()} == want and len(want) > len(titles)


def test_titles_two_edits_apart(spark):
    """Titles of 24 to 38 characters whose words are cut, joined, reordered or changed, against all pairs."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 8)))
    titles = [t for t in {" ".join(word() for _ in range(rng.randint(3, 7))) for _ in range(300)} if 22 <= len(t) <= 40][:120]
    near = []
    for t in titles:
        for _ in range(3):
            x = list(t)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "", "k", " "])
            w = "".join(x).split()
            rng.shuffle(w)
            near.append(" ".join(w))
    left, right = (spark.createDataFrame(list(enumerate(ts)), "id int, title string") for ts in (titles, near))
    for a, b, x, y in ((left, right, titles, near), (right, left, near, titles)):
        want = {(i, j) for i, p in enumerate(x) for j, q in enumerate(y) if S.token_set_ratio(p, q) >= match.RATIO}
        assert {(r.l, r.r) for r in match.title_matches(a, b).collect()} == want and len(want) > 50


def test_no_titles(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "id int, title string")
    some = spark.createDataFrame([(1, "a title")], "id int, title string")
    assert match.title_matches(rows, some).count() == match.title_matches(some, rows).count() == match.title_matches(rows, rows).count() == 0


def test_tei_of_all_makes(spark):
    odd = ["<TEI><teiHeader><title>Kept &eacute; &unknown;x</title><idno type='DOI'>10.1/a</idno><author><persName>", "no xml", "", None, "<a>" * 3000 + "<title>deep</title>", "<TEI><abstract>a\n<b/>b</abstract><date type='x' when='20'/><date type='published' when='abcd'/></TEI>"]
    x = spark.createDataFrame(list(enumerate(odd)), "id int, xml string")
    got = x.select("id", *[c.alias(k) for k, c in scholarly.tei_header(F.col("xml")).items()]).orderBy("id").collect()
    assert [(r.title, r.doi, r.abstract, r.authors, r.publication_year) for r in got] == [("Kept é x", "10.1/a", "", [], None), ("Untitled", None, "", [], None), ("Untitled", None, "", [], None), ("Untitled", None, "", [], None), ("deep", None, "", [], None), ("Untitled", None, "a b", [], None)]
    assert scholarly.tei_references(x).count() == 0 and scholarly.tei_references(x.limit(0)).count() == 0


def test_patterns_by_their_anchors(spark):
    """Every pattern with and without the search for its anchors first, letters that only case folding knows among them."""
    said = ["Data\u00a0 Availability", "data  AVAILABILITY", "GSE12", "g\u017fe1", "GSEx1", "xGSE1", "PRJEB77 ds3", "E-ABCD-1", "e-abcd-12", "\u212aode and data availability", "not publicly\navailable", "ethical re\u017ftrictions", "privacy restriction", "Ava\u0130lability of data", "phs000001.v1.p1", "syn7", "authorization accession", "", None]
    df = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    plain = [(p, n) for g, n in availability.GROUPS for p in g]
    want = {r.id: r.s for r in df.select("id", sum((F.when(F.coalesce("text", F.lit("")).rlike(f"(?iu){p}"), n).otherwise(0.0) for p, n in plain), F.lit(0.0)).alias("s")).collect()}
    assert {r.id: r.s for r in df.select("id", availability.pattern_score(F.col("text")).alias("s")).collect()} == want and sum(v > 0 for v in want.values()) > 12
    assert availability.anchors(r"\b(?:SRP|SRR)\d+(?:\.v\d+)?\b") == [["srp", "srr"]] and availability.anchors(r"\bprivacy\s+restrictions?\b") == [["restriction"], ["privacy"]]


def test_stored_index(spark, monkeypatch):
    """Words and vectors of many queries at once against one query at a time, with terms named to the scan and joined."""
    rng = random.Random(12)
    said = lambda: " ".join(rng.choices("ab cd ef gh The kl mn".split(), k=rng.randint(0, 12)))
    rows = [(rng.choice(["p", "q", "r"]), i, rng.choice([None, said(), said(), said()]), [rng.uniform(-1, 1) for _ in range(4)] if i % 5 else None) for i in range(120)]
    df = spark.createDataFrame([*rows, rows[3], (None, 500, "ab cd", None)], "part string, id int, content string, embedding array<float>").repartition(3)
    texts, vectors = {1: "the ab", 2: "kl kl nothing", 3: ""}, {1: [1.0, 0.0, 0.5, 0.0], 2: [0.0, 0.0, 0.0, 0.0], 3: [0.1, 0.2, -0.3, 0.4]}
    asked = spark.createDataFrame([(p, q, texts[q], vectors[q]) for p in ("p", "q", "none") for q in texts], "part string, query_id int, text string, embedding array<float>")
    index = inverted.build(df, "part", "id", "content")
    for named, held in ((4096, 4096), (0, 0)):
        monkeypatch.setattr(inverted, "NAMED", named)
        monkeypatch.setattr(inverted, "HELD", held)
        words = {(r.part, r.query_id, r.rank, r.id): r.score for r in inverted.sparse(index, asked, "part", "id", 30).collect()}
        near = {(r.part, r.query_id, r.rank, r.id): r.score for r in inverted.dense(df, asked, "part", "id", k=10).collect()}
        for q in texts:
            inside = df.filter("part in ('p', 'q')")
            one = retrieve.top(retrieve.bm25(df, texts[q], "part", "id", "content"), "part", "score", "id", 30).filter("part in ('p', 'q')")
            assert {k[:1] + k[2:]: v for k, v in words.items() if k[1] == q} == pytest.approx({(r.part, r.rank, r.id): r.score for r in one.collect()})
            assert {k[:1] + k[2:]: v for k, v in near.items() if k[1] == q} == pytest.approx({(r.part, r.rank, r.id): r.score for r in retrieve.dense(inside, vectors[q], "part", "id", k=10).collect()})
    for text in ("the ab kl zz zz zz", "zz", "ab", ""):
        want = [(r.id, r.attempt) for r in expand.search(df, text, F.col("content"), 7, [F.col("id")]).collect()]
        assert sorted((r.key, r.attempt) for r in inverted.search(index, text, 7).collect()) == sorted(want)
    assert inverted.sparse(inverted.build(df.limit(0), "part", "id", "content"), asked, "part", "id").count() == 0


def test_report_pages(spark, tmp_path):
    """Files of several runs are the pages that one run at a time gives, a run without rows among them."""
    rows = spark.createDataFrame([(r, i, f"Paper <{i}> & co", None if i % 2 else "10.1/x", "v", 2000 + i, ["A B"]) for r in (1, 2) for i in range(30, 0, -1)] + [(9, 1, "no head", None, None, None, None)], "run_id int, rrf_rank int, title string, doi string, venue string, publication_year int, authors array<string>").repartition(5)
    heads = spark.createDataFrame([(1, "T <1>", "Base", "10.1/b", "complete"), (2, "T2", None, None, None), (3, "Empty", "", "", "")], "run_id int, title string, paper_title string, doi string, exclusion_status string")
    report.write_pages(rows, heads, str(tmp_path / "out"))
    got = {r.run_id: r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    for h in heads.collect():
        cards = [r.c for r in rows.filter(F.col("run_id") == h.run_id).select(report.card(rows).alias("c"), "rrf_rank").orderBy("rrf_rank").collect()]
        want = report.render(cards, h.title, {"title": h.paper_title, "doi": h.doi}, h.exclusion_status or "incomplete")
        assert got[h.run_id].split("\n") == ([*want.split("\n"), ""] if cards else [x for x in want.split("\n") if x] + [""])
    assert sorted(got) == [1, 2, 3]


def test_keywords_of_all_languages(spark, tmp_path):
    texts = ["Größe größe naïve-Modelle Straße Wörter 日本語", "L'étude Étude Über-sicht the corpus Corpus", "", None, "Kelvin \u212aelvin İstanbul this With", *["mot%d-é palabra niño Haus " % i * 20 for i in range(3)]]
    spark.createDataFrame([(i, t, ["fr", "de", "es", "en"][i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.keywords for r in queries.keyword_extract(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        first = {}
        for w in re.findall(r"[A-Za-z][A-Za-z\-]{3,}", t or ""):
            if w.lower() not in S.STOPWORDS:
                first.setdefault(w.lower(), w)
        assert got[i] == (None if t is None else " ".join(list(first.values())[:10]))


def test_relevance_of_all_scripts(spark, tmp_path):
    target = "Größe naïve étude ΣΟΦΟΣ слова ١٢٣٤ x²³¼½ cafe\u0301 Ⓐword this_is under"
    texts = ["GRÖSSE größe", "Naïve ÉTUDE", "σοφος ΣΟΦΟΣ", "Слова", "١٢٣٤ x²³¼½", "cafe\u0301", "cafe", "Ⓐword word", "THIS_IS", "naïveté", "", "plain ascii", "日本語 テキスト — naïve"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, target)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.relevance for r in queries.lexical_relevance(spark, str(tmp_path)).collect()}
    want = set(re.findall(r"\w{4,}", target.lower())) - set(S.TOPIC_STOPWORDS)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(len(want & set(re.findall(r"\w{3,}", t.lower()))) / (len(want) + 1e-5), abs=1e-8), t


def test_embedding(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "abc")], "id int, text string").repartition(2)
    got = {r.id: r.embedding for r in embed.embedded(df, "text").collect()}
    assert got[2] is None and got[1] == got[4] and len(got[1]) == embed.SIZE and abs(sum(x * x for x in got[1]) - 1) < 1e-4
    assert {r.id: r.embedding for r in embed.embedded(df, "text", lambda ts: [[0.0, 0.0] for _ in ts]).collect()}[1] == [0.0, 0.0]

    def broken(texts):
        raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        embed.embedded(df, "text", broken).collect()


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no vocabulary here")
def test_subword_chunks(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    from tokenizers import Tokenizer

    text = " ".join(f"sentence number {i} has several plain words in it" for i in range(30))
    cut, joined = chunk.subwords(spark, path)
    rows = chunk.chunks(spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string"), parent=(100, 20), child=(40, 10), min_words=5, cut=cut, joined=joined).orderBy("chunk_index").collect()
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    t = Tokenizer.from_file(path)
    parents = [r for r in rows if r.chunk_type == "parent"]
    assert [r.start for r in parents] == list(range(0, len(ids), 80)) and all(r.content == t.decode(ids[r.start : r.start + 100]) and r.token_count == len(ids[r.start : r.start + 100]) for r in parents)
    assert any(r.chunk_type == "child" and r.token_count == 40 for r in rows) and {r.doc_id for r in rows} == {1}


@pytest.mark.parametrize("preset, status", [("publicly_available", "publicly_available"), ("restricted", "restricted"), ("not_available", "not_available"), ("not_reported", "not_reported"), ("mixed", "mixed"), ("unclear", "restricted"), ("malformed", "not_reported"), ("rejected", "restricted")])
def test_preset_model(spark, preset, status):
    rows = spark.createDataFrame([(1, "Title: A\n", "A", "[id=c1 index=0]\nThe data cannot be shared freely.")], "id int, prompt string, title string, context string").withColumn("retry_prompt", F.col("prompt"))
    got = summarize.summarized(rows, summarize.PresetModel(preset)).first()
    assert got.is_valid and got.data_availability == status and got.is_accepted == (preset not in ("malformed", "rejected"))


def test_repair_prompt(spark):
    """The second attempt at an availability reply says what was wrong."""

    class Second(summarize.RuleModel):
        def availability(self, prompt):
            return super().availability(prompt) if "broke a rule" in prompt else "{"

    rows = spark.createDataFrame([(1, "p", "p", "T", "[id=c1 index=0]\ndeposited as GSE12")], "id int, prompt string, retry_prompt string, title string, context string")
    assert summarize.summarized(rows, Second()).first().data_availability == "publicly_available"
    assert summarize.summarized(rows, Second(), attempts=1).first().data_availability == "not_reported"


def test_json_lines_and_columns(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "x", "n": 1}\n{"prompt": "y"}\n')
    assert sorted((r.prompt, r.n) for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "prompt string, n long").collect()) == [("x", 1), ("y", None)]
    df = files.with_columns(spark.createDataFrame([("x", 1)], "prompt string, extra int"), {"n": "long", "prompt": "string"})
    assert df.dtypes == [("n", "bigint"), ("prompt", "string"), ("extra", "int")] and tuple(df.first()) == (None, "x", 1)


def test_rows_named_as_our_own(spark):
    """Helper columns give way to columns of the same name."""
    df = spark.createDataFrame([("a", 1, 10, "keep", "me"), ("a", 2, 95, "and", "this")], "k string, i int, size int, __n string, __cum string")
    got = availability.budgeted(df, ["k"], [F.col("i")], "size", 50)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [("a", 1, 10, "keep", "me")]
    assert [tuple(r) for r in availability.first_half(df, ["k"], [F.col("i")]).select(df.columns).collect()] == [("a", 1, 10, "keep", "me")]
    assert [tuple(r) for r in fuse.keep_first(df, ["k"], [F.col("i")]).collect()] == [("a", 1, 10, "keep", "me")]


def test_components_with_hot_vertices(spark):
    """Stars, chains and rings, with a hub that counts as hot."""
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (59, 150)] + [(i, 500) for i in range(400, 450)]
    df = spark.createDataFrame(edges, "u long, v long")
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for x in parent if find(x) != x}
    for hot in (10_000, 5):
        assert {r.v: r.root for r in components.components(df, hot=hot).collect()} == want
    from lodestone.operators import lineage

    assert lineage.shared_dir(spark) in lineage.run_path(spark, "x") and spark.sparkContext.applicationId in lineage.run_path(spark, "x")


def test_extracted_texts(spark):
    """An injected PDF reader's pages end to end; a file that it can't read has a null text."""

    def pages(data):
        if data.startswith(b"bad"):
            raise ValueError("broken")
        return data.decode().split("|")

    df = spark.createDataFrame([("a", bytearray(b"one|t\x00wo")), ("b", bytearray(b"bad|x")), ("c", bytearray(b""))], "path string, content binary")
    got = paper_text.extracted(df, pages).collect()
    assert {r.path: r.text for r in got} == {"a": "one\ntwo", "b": None, "c": ""}
    assert [r.path for r in got if r.error] == ["b"] and ": " in next(r.error for r in got if r.error)


def test_rows_of_one_title(spark, monkeypatch):
    """Many rows of few titles and identifiers: as many links as rows, components and matched rows as the pairs have them."""
    rng = random.Random(5)
    names = ["deep nets for text", "deep nets for texts", "a survey of soil", "on soil and water in the alps", "quite another work"]
    rows = [(i, rng.choice([*names, None]), rng.choice([None, "10.1/a", "doi:10.1/A", f"10.1/{i}"]), rng.choice([2001, 2002, 2009, None] if i % 9 == 0 else [2001, 2009])) for i in range(300)]
    pool = spark.createDataFrame(rows, "id int, title string, doi string, publication_year int")
    found = match.links(pool)
    assert found.count() < 3 * len(rows) < match.matches(pool, pool).count() and found.filter("l >= r").count() == 0
    roots = lambda m: {(r.id, r.root) for r in fuse.components(m, pool).collect()}
    assert roots(found) == roots(match.matches(pool, pool).filter("l < r"))
    for least in (0, 1):  # with every value hot, and with none
        monkeypatch.setattr(match, "hot_keys", lambda sizes, key, total, least=least: sizes.select(key) if least else None)
        assert roots(match.links(pool)) == roots(found)
    some, few = pool.filter("id % 2 = 0"), pool.filter("id % 50 = 1")
    want = {r.l for r in match.matches(some, few).collect()}
    assert {r.id for r in match.matched(some, few).collect()} == want and 0 < len(want) < 150
    monkeypatch.setattr(match, "matches", None)
    monkeypatch.setattr(match, "title_matches", None)
    assert exclude.novel(some, few, few.limit(0)).count() == 150 - len(want)


def test_row_pairs_in_cells(spark, monkeypatch):
    """Pairs of rows in cells of a few rows and tasks of a few pairs: the same ones, in more tasks than the inputs alone would take."""
    rows = [(i, ("one title of many rows" if i % 3 else "one titles of many rows") if i % 7 else "another", 2000 + i % 4 if i % 5 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, title string, publication_year int")
    whole = sorted(tuple(r) for r in match.title_matches(df, df).collect())
    near = lambda a, b: S.token_set_ratio(a[1], b[1]) >= match.RATIO and (a[2] is None or b[2] is None or abs(a[2] - b[2]) <= 1)
    assert [x[:2] for x in whole] == sorted((a[0], b[0]) for a in rows for b in rows if near(a, b))
    monkeypatch.setattr(match, "CELL", 8)
    monkeypatch.setattr(match, "PAIRS", 500)
    dealt = match.title_matches(df, df)
    assert sorted(tuple(r) for r in dealt.collect()) == whole
    tasks = {r.t for r in dealt.select(F.spark_partition_id().alias("t")).distinct().collect()}
    assert len(tasks) > 10


def test_row_pairs_from_lists(spark):
    """Joins meet lists of keys, not rows; repeated and null keys, unknown years and rounded ratios among the pairs."""
    kinds = [("lists of many rows", 2000), ("list of many rows", 2001), ("lists of many rows", None), ("lists of many rows", 2002), ("another", 2000)]
    rows = [(None if i % 50 == 3 else i // 2, *kinds[i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, title string, publication_year int")
    found = match.title_matches(df, df, ratio=0.9, digits=3)
    got = Counter(tuple(r) for r in found.collect())
    alike = {(a, b): S.token_set_ratio(a[0], b[0]) for a in kinds for b in kinds if a[1] is None or b[1] is None or abs(a[1] - b[1]) <= 1}
    want = Counter((a[0], b[0], round(alike[a[1:], b[1:]], 3)) for a in rows for b in rows if alike.get((a[1:], b[1:]), 0) >= 0.9)
    assert got == want and sum(n for (x, y, _), n in got.items() if x is None or y is None) > 500

    def joined(node) -> int:
        name, below = node.nodeName(), node.children()
        if name == "AdaptiveSparkPlan":
            return joined(node.executedPlan())
        if "QueryStage" in name:
            return joined(node.plan())
        return (node.metrics().apply("numOutputRows").value() if "Join" in name else 0) + sum(joined(below.apply(i)) for i in range(below.size()))

    assert 0 < joined(found._jdf.queryExecution().executedPlan()) < 10 * len(rows) < sum(got.values()) / 10


def test_counts_in_the_row(spark):
    """Terms counted in the row as from all tokens, by one shuffle of texts; repeated keys, empty and null texts among them."""
    texts = ["b a  B c b", "", None, " \n", "x", "a a a"]
    rows = spark.createDataFrame([(i % 2, i // 2 % 4, t) for i, t in enumerate(texts * 3)], "p int, id int, t string")
    want: dict = {}
    for r in rows.collect():
        for w in (r.t or "").lower().split():
            want[r.p, r.id, w] = want.get((r.p, r.id, w), 0) + 1
    out = retrieve.term_counts(rows, "p", "id", "t")
    assert {(r.p, r.id, r.term): r.f for r in out.collect()} == want and out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" in plan.split("Exchange hashpartitioning")[0]
    index = inverted.build(rows, "p", "id", "t")
    assert index.postings.groupBy("part", "key", "term").agg(F.sum("f").alias("f")).count() == len(want)
    assert sum(r.f for r in index.postings.collect()) == sum(want.values())


@pytest.mark.parametrize("name", ["tei_header", "tei_authors", "tei_header_markup", "tei_references_markup", "tei_references_anywhere", "tei_bibliography"])
def test_texts_made_in_many_tasks(spark, tmp_path, name):
    """Documents made of a small file's rows are parsed in many tasks, not in that file's one."""
    parts = spark.range(200).selectExpr("id as p_partkey", "concat('a b', id) as p_name", "'B' as p_brand", "'T' as p_type", "cast(id % 9 as int) as p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    from lodestone.plans import more, papers  # noqa: F401 - they register the queries

    out = queries.QUERIES[name](spark, str(tmp_path))
    assert out.select(F.spark_partition_id().alias("t")).distinct().count() > 8


def test_extracted_keeps_columns(spark):
    """What a file's row has besides its bytes goes with its text, so that files are scanned once and not joined again."""
    rows = spark.createDataFrame([("a", b"x\x00\fy", 3, True), ("b", b"\xff", 1, None)], "path string, content binary, length long, is_pdf boolean")
    out = paper_text.extracted(rows, lambda data: data.decode().split("\f"), keep=("length", "is_pdf"))
    assert out.columns == ["path", "length", "is_pdf", "text", "error"]
    a, b = out.orderBy("path").collect()
    assert tuple(a) == ("a", 3, True, "x\ny", None) and (b.length, b.is_pdf, b.text) == (1, None, None) and b.error.startswith("UnicodeDecodeError")


def test_index_in_runs(spark, monkeypatch):
    """An index of many small runs: every posting once, texts read once, no posting shuffled; terms of each run in order."""
    texts = ["b a  B\x0bc\tb", "", None, " \n", "x\u2003y \u0130x", "a a a", "\u0001 e\u0301 E\u0301"]
    rows = spark.createDataFrame([(i % 3 or None, i, t) for i, t in enumerate(texts * 4)], "p int, id int, t string").repartition(2).cache()
    want: dict = {}
    lengths: dict = {}
    for r in rows.select("p", "id", N.tokens(F.lower("t")).alias("w")).collect():
        lengths[r.id] = len(r.w)
        for w in r.w:
            want[r.p, r.id, w] = want.get((r.p, r.id, w), 0) + 1
    monkeypatch.setattr(inverted, "PIECE", 5)
    monkeypatch.setattr(inverted, "RUN", 40)
    index = inverted.build(rows, "p", "id", "t")
    got = index.postings.collect()
    assert {(r.part, r.key, r.term): r.f for r in got} == want and len(got) == len(want)
    assert all(r.dl == lengths[r.key] for r in got) and sorted(r.key for r in index.rows.collect()) == list(range(len(texts) * 4))
    df: dict = {}
    for p, _, w in want:
        df[p, w] = df.get((p, w), 0) + 1
    assert {(r.part, r.term): r.df for r in index.dfs.collect()} == df
    assert {r.part: r.n for r in index.sizes.collect()} == {p: sum((i % 3 or None) == p for i in range(len(texts) * 4)) for p in (None, 1, 2)}
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan parquet" in plan
    table = pa.table({"part": [1, 1], "key": [1, 2], "row": [0, 1], "text": ["b a b", "c a"]})
    assert [t for b in inverted._run(table) for t in b.column(0).to_pylist()] == ["", "", "a", "a", "b", "c"]


def test_texts_picked_before_they_are_read(spark):
    """Whether a text is clean is asked of the few fused rows alone, not of every row ahead of the join; vectors may stand apart."""
    asked = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i % 2, i, " ".join(["word"] * 25 + [f"w{i}"]), [float(i), 1.0]) for i in range(200)], "p int, id int, t string, embedding array<float>")

    @F.udf("string")
    def seen(t):
        asked.add(1)
        return t

    few = rows.filter("id < 5").select("p", "id", F.col("id").alias("place"))
    out = retrieve.picked(few, rows, "p", "id", "t").filter(seen("t").contains("w"))
    assert sorted((r.id, r.t[-2:], r.place) for r in out.collect()) == [(i, f"w{i}", i) for i in range(5)]
    assert asked.value == 5
    one = retrieve.hybrid(rows, "w3 word", [1.0, 0.0], "p", "id", "t").collect()
    apart = retrieve.hybrid(rows.drop("embedding"), "w3 word", [1.0, 0.0], "p", "id", "t", vectors=rows.drop("t")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, apart)) and len(one) == 16


def test_blocks_are_counted_as_by_their_patterns(spark):
    """Counts behind what a pattern can't do without are the plain ones, odd cases and letters that fold to ASCII among them."""
    odd = "HTTP://A https://b ftp://c S3-x s3.y .TAR.GZ .Bcf .FASTA .fastaq Supplementary Figure SUPPLEMENTARY note \u017fupplementary Table et al ET AL et\u00a0al 10.1234/ 10.12/ 2020; ; 5 ; x\u0085y \u2028 Smith, Jones , , , \u212aing, 7 \u0130 s3 - :// a 12"
    rng = random.Random(5)
    rows = [(i, rng.sample(odd.split(" "), k=rng.randint(1, 40))) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, odd.split(" "))], "id int, t array<string>")
    text = lambda b, n: F.array_join(F.slice("t", b * 4 + 1, n), " ")
    blocks = F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 4).cast("int"))
    plain = F.transform(blocks, lambda b: F.struct(*[T.count_matches(text(b, 5 if more else 4), p).alias(n) for n, p, more, *_ in T.COUNTED]))
    got = df.select("id", T.marks(F.col("t"), 4).alias("m"), plain.alias("p")).collect()
    assert all(r.m == r.p for r in got) and all(any(m[n] for r in got for m in r.m) for n, *_ in T.COUNTED)
    assert all(x[3] for x in T.COUNTED if x[0] not in ("words", "bare"))


def test_chunks_in_many_tasks(spark):
    """Texts of a few MB are cut and read in as many tasks as larger ones."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("word"), i)), " ").alias("text"))
    assert chunk.chunks(docs).select(F.spark_partition_id().alias("t")).distinct().count() > 8
