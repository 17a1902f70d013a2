"""A paper's own data from its plain text: front matter, title, abstract, body, and the identifiers that it cites.

Text comes as a column (PDF libraries are outside: `extracted` takes a function from bytes to page texts). Lines are staged as
a column once, so that no expression splits a text twice, and only of texts that hold a word of the headings looked for; titles
read the start of a text, and more only if their lines aren't in it. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import normalize as N
from ..operators.lineage import unused

# Line ends, headings, banners, and what tells a title line from an author line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
SECTION = r"(?i)^\s*(?:[0-9]+\.?\s+)?(introduction|keywords|index terms)\b"
ABSTRACT = r"(?i)^\s*abstract\s*[:.]?\s*$"
BACK_MATTER = r"(?i)^\s*(?:[0-9.]+\s*)?(?:references|ref\s*er\s*en\s*ces|bibliography|works cited|data availability|code availability|supplementary information|author contributions|competing interests)\s*$"
BANNER = r"(?i)preprint|under review|manuscript submitted|copyright|arxiv:|\d+\s*[:–-]\s*\d+\s*[–-]\s*\d+\s*,\s*\d{4}|^\s*\d+\s*$"
PEOPLE = r"(?i)\b(anonymous|university|institute|department|corresponding author|et al\.?)\b|@"
CONNECTORS = "of the and for with in on using via to a an from into under over as is are vs vs.".split()
TITLE_END = r"[.!?:]\s*$"
FRONT_CHARS, ABSTRACT_CHARS, TITLE_LINES, SHORT_ABSTRACT = 4000, 2500, 3, 1000

# What a text must hold for one of its lines to be such a heading; other texts aren't cut into lines for it.
MATTER_WORDS = r"(?i)introduction|keywords|index terms|ref\s*er\s*en\s*ces|bibliography|works cited|availability|supplementary|contributions|competing"
ABSTRACT_WORD = "(?i)abstract"
#: So many characters are looked at for a title first, the whole text only if they don't hold its lines.
TITLE_CHARS = 2000


def lines(text: Column) -> Column:
    """Lines, without an empty one after a closing line end."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _first_line(staged: Column, pattern: str, least: Column | None = None) -> Column:
    """0-based index of the first line (from `least` on) that matches; null if none does."""
    hit = F.transform(staged, lambda x, i: F.trim(x).rlike(pattern) & ((i >= least) if least is not None else F.lit(True)))
    return F.nullif(F.array_position(hit, True), F.lit(0).cast("long")) - 1


def _until(staged: Column, n: Column) -> Column:
    return F.array_join(F.slice(staged, F.lit(1), n.cast("int")), "\n")


def with_matter(df: DataFrame, text: str = "text") -> DataFrame:
    """df with front (lines before the first section heading, else the first characters) and body (lines before the first
    back-matter heading of the second half, else all)."""
    parts, first, back = (unused(df, c) for c in ("lines", "front", "back"))
    out = df.withColumn(parts, F.when(F.col(text).rlike(MATTER_WORDS), lines(F.col(text))))
    out = out.withColumn(first, _first_line(F.col(parts), SECTION)).withColumn(back, _first_line(F.col(parts), BACK_MATTER, F.floor(F.size(parts) / 2)))
    whole = F.coalesce(F.col(text), F.lit(""))
    front = F.when(F.col(first).isNull(), F.substring(whole, 1, FRONT_CHARS)).otherwise(_until(F.col(parts), F.col(first)))
    body = F.when(F.col(back).isNull(), whole).otherwise(_until(F.col(parts), F.col(back)))
    return out.withColumn("front", front).withColumn("body", body).drop(parts, first, back)


def front_matter(text: Column, most: int = FRONT_CHARS) -> Column:
    """The front matter as a column of its own."""
    staged = lines(text)
    at = _first_line(staged, SECTION)
    return F.when(at.isNull(), F.substring(F.coalesce(text, F.lit("")), 1, most)).otherwise(_until(staged, at))


def _names_people(line: Column) -> Column:
    """Whether a line reads like authors or their places: a marker word, or up to four words, all capitalised, none a connector."""
    words = N.tokens(line)
    capitals = F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    joins = F.exists(words, lambda w: F.regexp_replace(F.lower(w), r"^[,.]+|[,.]+$", "").isin(CONNECTORS))
    return line.rlike(PEOPLE) | (F.size(words).between(1, 4) & capitals & ~joins)


def with_title_and_abstract(df: DataFrame, text: str = "text") -> DataFrame:
    """df with title (null without lines) and abstract (null if there is no heading with text below).

    Title: banners are skipped; up to two more lines go on a line that doesn't end in a mark, unless they name people.
    Abstract: the lines below a heading, to the next section heading or the line that reaches the limit.
    """
    trimmed = lambda x: F.filter(F.transform(x, lambda y: F.trim(F.regexp_replace(y, r"^\s+|\s+$", ""))), lambda y: y != "")
    plain = lambda x: F.array_position(F.transform(x, lambda y: ~y.rlike(BANNER)), True).cast("int")
    head, at, top, under, short = (unused(df, c) for c in ("head", "at", "top", "under", "short"))
    # The last line of a piece may be cut; a title that needs it, or lines behind it, is looked for in the whole text.
    pieces, longer_text = F.split(F.substring(F.coalesce(F.col(text), F.lit("")), 1, TITLE_CHARS), LINE_END), F.length(text) > TITLE_CHARS
    out = df.withColumn(head, trimmed(F.when(longer_text, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces))).withColumn(at, plain(F.col(head)))
    out = out.withColumn(short, longer_text & ((F.col(at) == 0) | (F.col(at) + TITLE_LINES - 1 > F.size(head))))
    out = out.withColumn(head, F.when(F.col(short), trimmed(lines(F.col(text)))).otherwise(F.col(head)))
    out = out.withColumn(at, F.when(F.col(short), plain(F.col(head))).otherwise(F.col(at)))
    out = out.withColumn(top, F.when(F.size(head) > 0, F.slice(F.col(head), F.when(F.col(at) > 0, F.col(at)).otherwise(F.size(head)), F.lit(TITLE_LINES))))

    def longer(acc: Column, line: Column) -> Column:
        done = acc["done"] | acc["t"].rlike(TITLE_END) | _names_people(line)
        return F.struct(F.when(done, acc["t"]).otherwise(F.concat(acc["t"], F.lit(" "), line)).alias("t"), done.alias("done"))

    first = F.struct(F.get(top, F.lit(0)).alias("t"), F.lit(False).alias("done"))
    title = F.aggregate(F.slice(top, 2, TITLE_LINES), first, longer, lambda acc: acc["t"])

    def span(acc: Column, line: Column) -> Column:
        # phase 0: before a heading, 1: below it, 2: done
        ends = line.rlike(SECTION)
        below = (acc["phase"] == 1) & ~ends
        size = acc["n"] + F.when(below, F.length(line)).otherwise(0)
        phase = F.when(acc["phase"] == 0, F.when(line.rlike(ABSTRACT), 1).otherwise(0)).when(ends, F.when(F.size(acc["out"]) > 0, 2).otherwise(0)).when(size >= ABSTRACT_CHARS, 2).otherwise(1)
        step = F.struct(phase.cast("int").alias("phase"), size.cast("int").alias("n"), F.when(below, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"))
        return F.when(acc["phase"] == 2, acc).otherwise(step)  # nothing is looked at behind the abstract

    empty = F.struct(F.lit(0).alias("phase"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    heading = lambda x: F.array_position(F.transform(x, lambda y: y.rlike(ABSTRACT)), True).cast("int")
    none = F.array().cast("array<string>")
    out = out.withColumn(under, F.when(F.col(text).rlike(ABSTRACT_WORD), trimmed(lines(F.col(text)))).otherwise(none))
    out = out.withColumn(at, heading(F.col(under)))
    from_it = F.when(F.col(at) > 0, F.slice(F.col(under), F.col(at), F.size(under))).otherwise(none)
    abstract = F.nullif(F.trim(F.aggregate(from_it, empty, span, lambda acc: F.array_join(acc["out"], " "))), F.lit(""))
    return out.withColumn("title", title).withColumn("abstract", abstract).drop(head, at, top, under, short)


def largest_font_title(spans: DataFrame, key: str, size: str = "size", top: str = "top", pos: str = "pos", text: str = "text") -> DataFrame:
    """key, title: a first page's pieces within half a point of its largest, from top to bottom; none if that is shorter than 8
    or longer than 300 characters, or a banner."""
    s = spans.withColumn("__t", F.trim(text)).filter("__t <> ''").withColumn("__max", F.max(size).over(Window.partitionBy(key)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(top).alias("a"), F.col(pos).alias("b"), F.col("__t").alias("t"))))
    out = s.filter(F.col(size) >= F.col("__max") - 0.5).groupBy(key).agg(F.trim(F.array_join(F.transform(rows, lambda r: r["t"]), " ")).alias("title"))
    return out.filter(F.length("title").between(8, 300) & ~F.col("title").rlike(BANNER))


def metadata(df: DataFrame, key: str = "id", text: str = "text", fonts: DataFrame | None = None) -> DataFrame:
    """key, title, abstract, doi, arxiv_id. Identifiers come from the front matter alone, never from what the paper cites."""
    out = with_title_and_abstract(with_matter(df.select(key, text), text), text)
    if fonts is not None:
        out = out.join(fonts.select(key, F.col("title").alias("__font")), key, "left").withColumn("title", F.coalesce("__font", "title"))
    return out.select(
        key, "title", F.coalesce("abstract", F.substring(F.coalesce(F.col(text), F.lit("")), 1, SHORT_ABSTRACT)).alias("abstract"),
        F.get(N.dois(F.col("front")), 0).alias("doi"), F.get(N.arxiv_ids(F.col("front")), 0).alias("arxiv_id"),
    )


def cited_identifiers(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, pos, raw_citation, doi, arxiv_id, extraction_method: the distinct DOIs of a text, then its arXiv ids."""
    rows = df.select(key, F.posexplode(N.identifiers(F.coalesce(F.col(text), F.lit("")))).alias("pos", "i"))
    doi = F.col("i.kind") == "doi"
    return rows.select(key, "pos", F.concat(F.when(doi, "DOI: ").otherwise("arXiv: "), F.col("i.id")).alias("raw_citation"), F.when(doi, F.col("i.id")).alias("doi"), F.when(~doi, F.col("i.id")).alias("arxiv_id"), F.lit("text").alias("extraction_method"))


def references(papers: DataFrame, parsed: DataFrame, texts: DataFrame, known: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The references of each paper, and key, exclusion_status.

    parsed: references from a structured parse; a paper that has any takes these alone. Others take the identifiers in their
    text (texts: key, text), then those that a catalogue lists (known). Complete means at least one reference.
    """
    has = parsed.select(key).distinct()
    others = papers.select(key).join(has, key, "left_anti")
    rest = cited_identifiers(texts.join(others, key, "left_semi"), key).withColumn("stage", F.lit(2))
    rest = rest.unionByName(known.join(others, key, "left_semi").withColumn("stage", F.lit(3)), allowMissingColumns=True)
    refs = parsed.join(papers.select(key), key, "left_semi").withColumn("stage", F.lit(1)).unionByName(rest, allowMissingColumns=True)
    got = refs.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    status = papers.select(key).join(got, key, "left").select(key, F.when(F.col("__n") > 0, "complete").otherwise("incomplete").alias("exclusion_status"))
    return refs, status


def extracted(files: DataFrame, pages: Callable[[bytes], list[str]], key: str = "path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to keep, text, error: the texts of a file's pages end to end, each with a line end, without NUL.

    Where `pages` raises, text is null and error says what; else error is null.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(data: bytes) -> tuple[str | None, str | None]:
            try:
                return "\n".join(pages(bytes(data))).replace("\x00", ""), None
            except Exception as e:  # noqa: BLE001 - a broken file is a row with its error, not a failed job
                return None, f"{type(e).__name__}: {e}"

        for b in batches:
            got = [one(x) for x in b[content]]
            yield pd.DataFrame({**{c: b[c] for c in (key, *keep)}, "text": [t for t, _ in got], "error": [e for _, e in got]})

    own = StructType([*(files.schema[c] for c in (key, *keep)), StructField("text", StringType()), StructField("error", StringType())])
    return files.select(key, *keep, content).mapInPandas(work, own)
