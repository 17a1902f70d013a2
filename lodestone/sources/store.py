"""Tables that batches are written into: rows by key in partitions that a batch rewrites whole, and papers by get-or-create.

Writing a batch again leaves a table as it was, so a job that was stopped is run again. One writer at a time. A table keeps the
number of buckets that it began with; choose it so that a bucket is a few files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import clean_text
from ..operators.components import components, hot_keys, spread_join
from ..operators.lineage import discard, saved, unused
from ..operators.match import IDS

BUCKETS, SPREAD = 256, 4


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _clean(df: DataFrame) -> DataFrame:
    strings = {c: clean_text(F.col(c)) for c, t in df.dtypes if t == "string"}
    return df.withColumns(strings) if strings else df


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, with its column bucket and the columns of all batches; None before the first write."""
    return spark.read.option("mergeSchema", True).parquet(path) if _exists(spark, path) else None


def upsert(rows: DataFrame, path: str, keys: list[str], update: bool = True, buckets: int = BUCKETS) -> None:
    """Write rows (no column `bucket`; one of several with equal keys is taken) over those of equal keys, or, without update, only where the key is new.

    NUL characters are taken out of strings. Only the buckets that have a row at hand are read and written again; the merged
    ones are in the shared folder before any is replaced. Columns that either side lacks are null there. No rows: no change.
    """
    spark = rows.sparkSession
    rows = _clean(rows)
    fresh = saved(rows.withColumn("bucket", _bucket(keys, buckets)), "upsert")
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        discard(fresh)
        return
    age = unused(fresh, "age")
    both, old = fresh.withColumn(age, F.lit(0 if update else 1)), stored(spark, path)
    if old is not None:
        both = both.unionByName(old.filter(F.col("bucket").isin(touched)).withColumn(age, F.lit(1 if update else 0)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "bucket", age)]
    value = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(0).alias(age))
    merged = both.groupBy("bucket", *keys).agg(F.min_by(value, age).alias(age)).select("bucket", *keys, *[F.col(age)[c].alias(c) for c in rest])
    ready = saved(merged, "upsert-merged")
    out = ready.repartition(F.col("bucket"), F.pmod(F.xxhash64(*keys), F.lit(SPREAD)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    discard(fresh, ready)


def get_or_create(rows: DataFrame, path: str, key: str = "paper_id", order: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """rows with key and created: the stored paper of each row, made where there is none. rows have a unique column `order`.

    A row is looked up by its raw doi, else arxiv_id, openalex_id, s2_id (empty ones and absent columns count as none): the
    first that some stored paper goes by decides. Rows that none is found for are one paper where they share an identifier,
    directly or through others; it takes the first value in `order` of each column, its key is a hash of its least identifier,
    and it goes by all of theirs from then on. A row without identifiers is a paper of its own, found again by its whole contents. A found row
    changes nothing.

    Under `path`: `papers` (key and the columns of rows) and `aliases` (name, key). Papers are written first: a job stopped in
    between makes the same ones when it is run again.
    """
    spark = rows.sparkSession
    papers, names = f"{path}/papers", f"{path}/aliases"
    rows = _clean(rows)
    given = F.filter(F.array(*[F.concat(F.lit(f"{i}:"), F.nullif(F.col(c).cast("string"), F.lit(""))) for i, c in enumerate(IDS) if c in rows.columns], F.lit(None).cast("string")), lambda x: x.isNotNull())
    ks, found, first = unused(rows, "names"), unused(rows, "found"), unused(rows, "first")
    work = saved(rows.withColumn(ks, given), "papers-batch")

    # Stored names, of the buckets that the batch asks for.
    asked = work.select(F.col(order).alias("l"), F.explode(ks).alias("name"))
    known = stored(spark, names)
    if known is None:
        work = work.withColumn(found, F.lit(None).cast("string"))
    else:
        wanted = saved(asked.select("name").distinct().withColumn("bucket", _bucket(["name"], buckets)), "papers-asked")
        touched = [r[0] for r in wanted.select("bucket").distinct().collect()]
        hits = saved(wanted.join(known.filter(F.col("bucket").isin(touched)).drop("bucket"), "name").select("name", "key"), "papers-hits")
        sizes = asked.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        best = spread_join(asked, hits, "name", "l", hot_keys(sizes, "name", asked.count())).groupBy("l").agg(F.min(F.struct("name", "key")).alias("b"))
        work = saved(work.join(best.select(F.col("l").alias(order), F.col("b.key").alias(found)), order, "left"), "papers-looked-up")

    every = work.filter(F.col(found).isNotNull()).select(*rows.columns, F.col(found).alias(key), F.lit(False).alias("created"))
    if work.filter(F.col(found).isNull()).isEmpty():
        return every

    # What is new: names joined where a row has several; the least name of a component names the paper.
    new = work.filter(F.col(found).isNull() & (F.size(ks) > 0))
    edges = new.select(F.explode(F.transform(F.slice(ks, 2, len(IDS)), lambda x: F.struct(F.get(ks, 0).alias("u"), x.alias("v")))).alias("e")).select("e.u", "e.v")
    roots = (edges.select(F.col("u").alias("v"), F.col("v").alias("root")).limit(0) if edges.isEmpty() else components(edges, "papers-names")).withColumnRenamed("v", "name")
    paper = lambda c: F.sha1(F.encode(c, "UTF-8"))
    called = saved(new.select(F.explode(ks).alias("name")).distinct().join(roots, "name", "left").select("name", paper(F.coalesce("root", "name")).alias("key")), "papers-called")
    leading = new.select(*[c for c in new.columns if c != found], F.get(ks, 0).alias(first))
    sizes = leading.groupBy(first).agg(F.count(F.lit(1)).alias("n"))
    named = spread_join(leading, called.select(F.col("name").alias(first), F.col("key").alias(found)), first, order, hot_keys(sizes, first, leading.count())).drop(first)
    columns = [c for c in rows.columns if c != order]
    alone = work.filter(F.col(found).isNull() & (F.size(ks) == 0)).withColumn(found, F.sha1(F.encode(F.concat(F.lit("row:"), F.to_json(F.struct(*columns))), "UTF-8")))
    made = saved(named.unionByName(alone), "papers-made")
    values = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    before = stored(spark, papers)
    old = made.select(found).limit(0) if before is None else before.select(F.col(key).alias(found))
    fresh = saved(made.select(found).distinct().join(old, found, "left_anti").withColumn("created", F.lit(True)), "papers-fresh")
    upsert(made.groupBy(F.col(found).alias(key)).agg(*values), papers, [key], update=False, buckets=buckets)
    upsert(called, names, ["name"], update=False, buckets=buckets)
    mine = made.join(fresh, found, "left").select(*rows.columns, F.col(found).alias(key), F.coalesce("created", F.lit(False)).alias("created"))
    return every.unionByName(mine)
