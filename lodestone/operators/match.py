"""Which rows are the same paper: equal identifiers, or titles alike and years close.

Identifiers go through one equality join on (kind, value). Titles meet only where their likeness can reach the ratio at all:
by the rarest of their words, short ones by what is left of them after a deletion or two, longer ones by the rarest of their
pieces. No word that most titles share makes a block; of pieces that all long titles share, one may, where a title has no D + 1
rarer ones. The ratio itself runs in Arrow batches over the pairs that lengths and word counts leave.

Rows of one title and year match the same rows, and so do rows of one identifier. Where only what is matched (`matched`) or what
hangs together (`links`) is asked for, such a class counts as one, and no pair of its rows is made. `title_matches` returns the
pairs themselves: lists of keys meet, and are unfolded to pairs by tasks that they are dealt to by number.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.scoring import title_ratio
from ..ship import ship
from .components import hot_keys, spread_join
from .lineage import saved

IDS = ("doi", "arxiv_id", "openalex_id", "s2_id")
_NORMAL = {"doi": N.doi, "arxiv_id": N.arxiv, "openalex_id": N.openalex_id, "s2_id": N.s2_id}
RATIO, YEAR_GAP = 0.96, 1


def ids(df: DataFrame, key: str) -> DataFrame:
    """key, kind, value: each normalised identifier that a row has."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), _NORMAL[c](F.col(c)).alias("value")) for c in IDS if c in df.columns])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.kind", "p.value").filter("value is not null").distinct()


def id_matches(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """l, r: keys of rows that share an identifier."""
    a, b = ids(left, key).withColumnRenamed(key, "l"), ids(right, key).withColumnRenamed(key, "r")
    return a.join(b, ["kind", "value"]).select("l", "r").distinct()


def _titles(df: DataFrame, key: str, name: str) -> DataFrame:
    year = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("int")
    y = N.year(year("publication_year"), year("year"))
    return df.select(F.col(key).alias(name), N.title(F.col("title")).alias("t"), y.cast("int").alias("y")).filter("t <> ''")


#: Keys that may be listed as common: those with more than a LISTED-th of all rows, so fewer than LISTED of them.
LISTED = 1 << 16


def _rarest(rows: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """rows (t, k, size, ...) with f: how often k comes in counts (k), 0 unless it is common. The common ones are a bounded list."""
    n = counts.groupBy("k").agg(F.count(F.lit(1)).alias("f"))
    total = n.agg(F.sum("f").alias("total"))
    common = n.crossJoin(F.broadcast(total)).filter(F.col("f") > F.col("total") / LISTED).select("k", "f")
    return rows.join(F.broadcast(common), "k", "left").withColumn("f", F.coalesce("f", F.lit(0)))


def _ordered(rows: DataFrame) -> DataFrame:
    """t, n, q, by: each title's (f, k, size), the rarest first."""
    return rows.groupBy("t", "n").agg(F.first("q").alias("q"), F.sort_array(F.collect_list(F.struct("f", "k", "size"))).alias("by"))


def _within(small: DataFrame, large: DataFrame, slack: float) -> DataFrame:
    """s, l: titles whose words nearly all stand in another.

    Such a title lacks words of at most a share `most` of its characters, so of its rarest words that make more than that
    share one at least is common to both; only those words are looked up.
    """
    most = 2 * slack / (1 + slack)
    words = lambda d: d.select("t", "n", F.explode("tok").alias("k"), F.lit(0).alias("q"))
    both = words(small).unionByName(words(large))
    by = _ordered(_rarest(words(small).withColumn("size", F.length("k") + 1), "k", both))
    before = lambda i: F.aggregate(F.slice("by", 1, i), F.lit(0), lambda acc, x: acc + x["size"])
    few = F.filter("by", lambda x, i: F.when(i == 0, True).otherwise(before(i) <= F.lit(most) * F.col("n") + 1e-9))
    keys = by.select(F.col("t").alias("s"), F.explode(F.transform(few, lambda x: x["k"])).alias("k"))
    return keys.join(words(large).select(F.col("t").alias("l"), "k"), "k").select("s", "l")


def _pieces(a: DataFrame, b: DataFrame, slack: float) -> DataFrame:
    """l, r: titles that may differ in few characters, for left ones of more than DELETIONS differences.

    Such a left title of n characters differs in at most D = n 2 slack / (1 - slack) insertions and deletions. Its words are
    cut into pieces of q characters, 4 or fewer where that leaves no more than D of them; each edit spoils one at most, so of
    any D + 1 pieces one stands in a word of the right title: the rarest ones are looked up.
    """
    c, widest = 2 * slack / (1 - slack), (1 + slack) / (1 - slack)
    most = F.floor(F.col("n") * c + 1e-9).cast("int")
    cut = lambda q: F.flatten(F.transform("tok", lambda w: F.when(F.length(w) >= q, F.transform(F.sequence(F.lit(0), F.floor(F.length(w) / q).cast("int") - 1), lambda i: F.substr(w, i * q + 1, F.lit(q)))).otherwise(F.array().cast("array<string>"))))
    left = a.withColumn("d", most).filter(F.col("d") > DELETIONS)
    pieces = F.when(F.size(cut(4)) > F.col("d"), F.struct(F.lit(4).alias("q"), cut(4).alias("p"))).when(F.size(cut(2)) > F.col("d"), F.struct(F.lit(2).alias("q"), cut(2).alias("p"))).otherwise(F.struct(F.lit(1).alias("q"), cut(1).alias("p")))
    left = left.select("t", "n", pieces.alias("x")).select("t", "n", "x.q", F.explode("x.p").alias("k")).withColumn("size", F.lit(1))
    grams = lambda w, q: F.when(F.length(w) >= q, F.transform(F.sequence(F.lit(1), F.length(w) - q + 1), lambda i: F.substr(w, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    every = F.flatten(F.transform("tok", lambda w: F.concat(grams(w, 4), grams(w, 2), grams(w, 1))))
    right = b.filter(F.floor(F.col("n") * widest * c + 1e-9) > DELETIONS).select(F.col("t").alias("r"), F.col("n").alias("m"), F.explode(F.array_distinct(every)).alias("k"))
    by = _ordered(_rarest(left, "k", left.select("k").unionByName(right.select("k"))))
    keys = by.withColumn("d", most).select(F.col("t").alias("l"), "n", F.explode(F.array_distinct(F.transform(F.slice("by", 1, F.col("d") + 1), lambda x: x["k"]))).alias("k"))
    return keys.join(right, "k").filter(F.greatest("m", "n") <= F.least("m", "n") * widest + 1e-9).select("l", "r")


#: Titles that may differ in so many insertions and deletions are met by what is left after them; longer ones by pieces.
DELETIONS = 2


def remains(words: list[str], most: int) -> list[set[str]]:
    """What may be left of a title's words after 0, 1, ... `most` deletions of a character, or of the space between two words.

    Each is the sorted words, one space apart. Which words of a pair of titles face each other isn't known before they meet, so
    a space may join any two words in their sorted order. Words come in order of the alphabet and keep their places.
    """
    now, found = {tuple(sorted(words))}, []
    for left in range(most, -1, -1):
        found.append({" ".join(sorted(w for w in x if w)) for x in now})
        if left:
            cut = {(*x[:i], w[:k] + w[k + 1 :], *x[i + 1 :]) for x in now for i, w in enumerate(x) for k in range(len(w))}
            now = cut | {(*x[:i], x[i] + x[j], *x[i + 1 : j], *x[j + 1 :]) for x in now for j in range(1, len(x)) for i in range(j)}
    return found


def _deletions(a: DataFrame, b: DataFrame, slack: float) -> DataFrame:
    """l, r: titles that may differ in few characters, for left ones of at most DELETIONS differences.

    With D as in _pieces, such a pair has a text in common that is left of one title after i deletions and of the other after
    j, i + j <= D. A key is the hash of such a text: there are some n of them for D = 1 and n^2 / 2 for D = 2, where n < 36 at
    the ratio 0.96, and titles meet only where such texts are equal, whatever words they share.
    """
    c, widest = 2 * slack / (1 - slack), (1 + slack) / (1 - slack)

    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(t, d, i, k) for t, tok, d in zip(*(x.to_pylist() for x in part.columns), strict=True) for i, level in enumerate(remains(tok, min(d, DELETIONS))) for k in level]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), (pa.utf8(), pa.int32(), pa.int32(), pa.utf8()), strict=True)], names=["t", "d", "i", "k"])

    def left_after(d: DataFrame, most) -> DataFrame:
        rows = d.withColumn("d", most.cast("int")).filter("d > 0").select("t", "tok", "d")
        return rows.mapInArrow(keys, "t string, d int, i int, k string").select("t", "d", "i", F.xxhash64("k").alias("k"))

    left = left_after(a.filter(F.floor(F.col("n") * c + 1e-9) <= DELETIONS), F.floor(F.col("n") * c + 1e-9)).withColumnsRenamed({"t": "l", "i": "x"})
    right = left_after(b.filter(F.floor(F.col("n") / widest * c - 1e-9) <= DELETIONS), F.floor(F.col("n") * widest * c + 1e-9)).withColumnsRenamed({"t": "r", "i": "y"}).drop("d")
    return left.join(right, "k").filter("x + y <= d").select("l", "r").distinct()


def title_pairs(left: DataFrame, right: DataFrame, ratio: float = RATIO) -> DataFrame:
    """l, r: all pairs of normalised titles (columns t, distinct here) that could reach the ratio, and some that don't.

    A pair reaches it in one of three ways: the words of one nearly all stand in the other (either way round), or the two
    differ in few characters. The distinct titles are written once; where a side has none, there is nothing to look for.
    """
    ship(left.sparkSession)
    slack = 1 - ratio
    tok = F.array_distinct(F.filter(F.split("t", " "), lambda w: w != ""))
    a, b = (saved(d.select("t").filter("t <> ''").distinct(), "titles") for d in (left, right))
    if a.isEmpty() or b.isEmpty():
        return left.sparkSession.createDataFrame([], "l string, r string")
    a, b = (d.withColumn("tok", tok).withColumn("n", F.length(F.array_join("tok", " "))) for d in (a, b))
    held = _within(a, b, slack).select(F.col("s").alias("l"), F.col("l").alias("r"))
    holds = _within(b, a, slack).select("l", F.col("s").alias("r"))
    pairs = held.unionByName(holds).unionByName(_deletions(a, b, slack)).unionByName(_pieces(a, b, slack)).distinct()
    # What the ratio can be at most, from the words alone.
    x, y = F.split("l", " "), F.split("r", " ")
    size = lambda w: F.aggregate(w, F.lit(0), lambda acc, z: acc + F.length(z) + 1)
    n, m = size(F.array_distinct(x)) - 1, size(F.array_distinct(y)) - 1
    most = 2 * slack / (1 + slack)
    lacks, misses = size(F.array_except(x, y)), size(F.array_except(y, x))
    near = F.greatest(n, m) <= F.least(n, m) * (1 + slack) / (1 - slack) + 1e-9
    return pairs.filter((lacks <= n * most + 1e-9) | (misses <= m * most + 1e-9) | near)


#: Keys of either side that meet in one cell of the join of rows, and pairs that a task makes of them.
CELL, PAIRS = 1 << 10, 1 << 24


def _alike(a: DataFrame, b: DataFrame, ratio: float) -> DataFrame:
    """lt, rt, ratio: the pairs of titles (t of each side) that reach it, written once."""
    ship(a.sparkSession)
    return saved(title_pairs(a, b, ratio).select(F.col("l").alias("lt"), F.col("r").alias("rt"), title_ratio("l", "r").alias("ratio")).filter(F.col("ratio") >= ratio), "alike")


def _close(year_gap: int):
    return F.coalesce(F.abs(F.col("ly") - F.col("ry")) <= year_gap, F.lit(True))


def _same(t: str, y: str):
    """Rows of a class that t and y name. Unknown years are a class of their own."""
    return (F.col("t") == F.col(t)) & F.col("y").eqNullSafe(F.col(y))


def _lists(rows: DataFrame, cells: DataFrame, v: str, t: str, y: str, parts: str) -> DataFrame:
    """t, y, part, vs: the keys v of each class that cells name, dealt to `parts` lists of about CELL by their rows' numbers."""
    known = cells.select(t, y, parts).distinct()
    part = F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")
    held = rows.join(known, _same(t, y)).select(t, y, part.alias("part"), v).groupBy(t, y, "part").agg(F.collect_list(v).alias("vs"), F.count_if(F.isnull(v)).cast("int").alias("gone"))
    # Null keys are rows too; collect_list leaves them out.
    lost = F.array_repeat(F.lit(None).cast(rows.schema[v].dataType), F.col("gone"))
    return held.select(F.col(t).alias("t"), F.col(y).alias("y"), "part", F.when(F.col("gone") > 0, F.concat("vs", lost)).otherwise(F.col("vs")).alias("vs"))


def title_matches(left: DataFrame, right: DataFrame, key: str = "id", ratio: float = RATIO, year_gap: int = YEAR_GAP, digits: int | None = None) -> DataFrame:
    """l, r, ratio of rows whose titles are alike, and whose years, where both are known, lie close. Equal titles are compared once.

    Titles n rows to m make n m pairs, however few titles there are. So titles with years are matched, and the ratio is rounded to
    `digits` places if they are given; the keys of each are put into lists of about CELL, each two lists meet in a cell, and there
    are as many tasks as all pairs need. Up to there nothing has a row for each pair, only for each cell.
    """
    a, b = (saved(_titles(d, key, v).withColumn("row", F.monotonically_increasing_id()), "titled") for d, v in ((left, "l"), (right, "r")))
    sizes = lambda d, t, y, n: d.groupBy(F.col("t").alias(t), F.col("y").alias(y)).agg(F.count(F.lit(1)).alias(n))
    groups = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    pairs = _alike(a, b, ratio).join(sizes(a, "lt", "ly", "n"), "lt").join(sizes(b, "rt", "ry", "m"), "rt").filter(_close(year_gap))
    said = F.col("ratio") if digits is None else F.round("ratio", digits).alias("ratio")
    cells = saved(pairs.select("lt", "ly", "rt", "ry", said, "n", "m", groups("n").alias("p"), groups("m").alias("q"), F.monotonically_increasing_id().alias("pair")), "cells")
    total = cells.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    ls, rs = (_lists(a, cells, "l", "lt", "ly", "p"), _lists(b, cells, "r", "rt", "ry", "q"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = cells.select("lt", "ly", "rt", "ry", "ratio", "pair", "q", every("p").alias("i")).select("lt", "ly", "rt", "ry", "ratio", "pair", "i", every("q").alias("j"))
    a = met.join(ls, _same("lt", "ly") & (F.col("part") == F.col("i"))).select("pair", "i", "j", "ratio", F.col("vs").alias("ls"))
    b = met.join(rs, _same("rt", "ry") & (F.col("part") == F.col("j"))).select("pair", "i", "j", F.col("vs").alias("rs"))
    if total > PAIRS:
        # By number, so that small inputs of a large result aren't put into few tasks.
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS))
        a, b = (d.repartition(tasks, "pair", "i", "j") for d in (a, b))
    # A merge join goes by left rows, so a task holds the pairs of one left key with a list, not those of a cell.
    a = a.select("pair", "i", "j", "ratio", F.explode("ls").alias("l"))
    return a.join(b.hint("merge"), ["pair", "i", "j"]).select("l", F.explode("rs").alias("r"), "ratio")


def _class_pairs(alike: DataFrame, a: DataFrame, b: DataFrame, year_gap: int) -> DataFrame:
    """lt, ly, rt, ry: titles with years that match, of classes a and b (distinct t, y)."""
    a, b = (d.select(F.col("t").alias(t), F.col("y").alias(y)) for d, t, y in ((a, "lt", "ly"), (b, "rt", "ry")))
    return alike.select("lt", "rt").join(a, "lt").join(b, "rt").filter(_close(year_gap)).select("lt", "ly", "rt", "ry")


def matched(left: DataFrame, right: DataFrame, key: str = "id", ratio: float = RATIO, year_gap: int = YEAR_GAP) -> DataFrame:
    """key of the left rows that match any right one, as `matches` has them, without a pair of rows."""
    by_id = ids(left, key).join(ids(right, key).select("kind", "value").distinct(), ["kind", "value"], "left_semi").select(key)
    a, b = _titles(left, key, key), _titles(right, key, key)
    found = _class_pairs(_alike(a, b, ratio), a.select("t", "y").distinct(), b.select("t", "y").distinct(), year_gap).select("lt", "ly").distinct()
    by_title = a.join(found, (F.col("t") == F.col("lt")) & F.col("y").eqNullSafe(F.col("ly")), "left_semi").select(key)
    return by_id.unionByName(by_title).distinct()


def _stars(rows: DataFrame, name: str) -> DataFrame:
    """l, r: the least v of each value k, and each other one. Rows (v, k) of a hot value are dealt to several tasks."""
    rows = saved(rows, name)
    least = rows.groupBy("k").agg(F.min("v").alias("l"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(least, "k", rows.count())
    return spread_join(rows, least.select("k", "l"), "k", "v", hot).filter("l < v").select("l", F.col("v").alias("r"))


def links(pool: DataFrame, key: str = "id", ratio: float = RATIO, year_gap: int = YEAR_GAP) -> DataFrame:
    """l, r: links (l < r) that join the same rows, directly or by others, as the matches of a pool with itself.

    Rows of an identifier, and rows of a title and year, are linked to the least of them; classes that match, by these least rows.
    There are about as many links as rows have values, however many rows share one.
    """
    by_id = _stars(ids(pool, key).select(F.col(key).alias("v"), F.concat_ws("\x1f", "kind", "value").alias("k")), "identified")
    titles = saved(_titles(pool, key, "v"), "titled")
    by_title = _stars(titles.select("v", F.concat_ws("\x1f", F.coalesce(F.col("y").cast("string"), F.lit("-")), "t").alias("k")), "classes")
    least = saved(titles.groupBy("t", "y").agg(F.min("v").alias("v")), "least")
    pairs = _class_pairs(_alike(titles, titles, ratio), least, least, year_gap)
    ends = lambda v, t, y: least.select(F.col("v").alias(v), F.col("t").alias(t), F.col("y").alias(y))
    same = lambda x, v, t, y: x.join(ends(v, f"{t}_", f"{y}_"), (F.col(t) == F.col(f"{t}_")) & F.col(y).eqNullSafe(F.col(f"{y}_"))).drop(f"{t}_", f"{y}_")
    between = same(same(pairs, "l", "lt", "ly"), "r", "rt", "ry").filter("l < r").select("l", "r")
    return by_id.unionByName(by_title).unionByName(between).distinct()


def matches(left: DataFrame, right: DataFrame, key: str = "id", ratio: float = RATIO, year_gap: int = YEAR_GAP) -> DataFrame:
    """l, r: the same paper by identifier or by title."""
    return id_matches(left, right, key).unionByName(title_matches(left, right, key, ratio, year_gap).select("l", "r")).distinct()


def lookup(rows: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """rows and found: the entity of equal raw doi, else arxiv_id, else openalex_id, else s2_id (of several the least key)."""
    spread = lambda d, n: d.select(F.col(key).alias(n), F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.nullif(F.col(c), F.lit("")).alias("value")) for i, c in enumerate(IDS)])).alias("p")).select(n, "p.rank", "p.value").filter("value is not null")
    best = spread(rows, "l").join(spread(entities, "found"), ["rank", "value"]).groupBy("l").agg(F.min(F.struct("rank", "found")).alias("b")).select("l", "b.found")
    return rows.join(best.withColumnRenamed("l", key), key, "left")


def get_work(rows: DataFrame, works: DataFrame, key: str = "id") -> DataFrame:
    """rows and found: the key of the work that has the row's one deciding identifier, normalised: OpenAlex, else DOI, else arXiv.

    A row is looked up by that identifier alone; one that no work has gives null. Of several works the least key counts.
    """
    order = ("openalex_id", "doi", "arxiv_id")
    given = lambda d, c: _NORMAL[c](F.col(c)) if c in d.columns else F.lit(None).cast("string")
    wanted = F.coalesce(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.struct(F.lit(c).alias("kind"), given(rows, c).alias("value"))) for c in order if c in rows.columns])
    has = works.select(F.col(key).alias("found"), F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), given(works, c).alias("value")) for c in order])).alias("p")).select("found", "p.kind", "p.value").filter("value is not null")
    ask = rows.select(F.col(key).alias("l"), wanted.alias("p")).select("l", "p.kind", "p.value")
    found = ask.join(has, ["kind", "value"]).groupBy("l").agg(F.min("found").alias("found"))
    return rows.join(found.withColumnRenamed("l", key), key, "left")


def same_identity(resolved: DataFrame, floor: float = 0.85) -> DataFrame:
    """Rows (title, resolved_title, ...) whose resolved work is dropped (resolved_ok false) if its title is another."""
    ship(resolved.sparkSession)
    return resolved.withColumn("resolved_ok", F.coalesce(title_ratio(N.title(F.col("title")), N.title(F.col("resolved_title"))) >= floor, F.lit(False)))
