"""File sequences, tables and documents."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import file_stem
from gridloom.operators.ordering import natural_key, strided


def name_matches(name: Column, pattern: str = "", regex: bool = False) -> Column:
    """An empty pattern matches all; else a regular expression anywhere, or a substring."""
    if not pattern:
        return F.lit(True)
    return name.rlike(pattern) if regex else name.contains(pattern)


def sequence(paths: DataFrame, extensions: Sequence[str] = (".tif", ".tiff"), pattern: str = "", regex: bool = False, natural: bool = True, start: int = 0, stride: int = 1, count: int | None = None, explicit: Sequence[str] | None = None) -> DataFrame:
    """``path, position`` of the files to run, from ``paths(path)``.

    An explicit list is taken as it is, in its order; all other options are
    for listings.
    """
    if explicit is not None:
        return paths.sparkSession.createDataFrame(list(enumerate(explicit)), "position int, path string").select("path", "position")
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    right = reduce(lambda a, b: a | b, (F.lower(name).endswith(e.lower()) for e in extensions), F.lit(False))
    listed = paths.filter(right & name_matches(name, pattern, regex))
    return strided(listed.select("path"), [natural_key(name) if natural else name, "path"], start, stride, count).select("path", "position")


def unique_paths(paths: DataFrame) -> DataFrame:
    """First listing of each normalised path: ``path, position``."""
    normal = F.regexp_replace(F.regexp_replace(F.lower("path"), r"\\", "/"), r"/+", "/")
    return paths.groupBy(normal.alias("__n")).agg(F.min_by("path", "position").alias("path"), F.min("position").alias("position")).drop("__n")


def output_name(template: str, path: Column, index: Column) -> Column:
    """``{stem}`` and ``{index}`` (five digits) filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{stem}"), file_stem(path)), F.lit("{index}"), F.lpad(index.cast("string"), 5, "0"))


def measurements(spark: SparkSession, path: str, required: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Rows of a CSV whose numbers all parse; a missing column raises."""
    raw = spark.read.csv(path, header=True)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return raw.withColumns({c: F.col(c).try_cast("double") for c in numeric}).dropna(subset=list(numeric))


def write_table(df: DataFrame, path: str, partition: str | None = None, append: bool = False) -> None:
    """CSV with a header; refuses to overwrite."""
    w = df.write.mode("append" if append else "errorifexists").option("header", True)
    (w.partitionBy(partition) if partition else w).csv(path)


def twelve_digits(df: DataFrame) -> DataFrame:
    """Doubles as text with up to twelve significant digits and no trailing zeros, within 1e-4 and 1e12."""

    def text(c: Column) -> Column:
        digits = F.least(F.greatest(F.lit(11) - F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-4)))), F.lit(0)), F.lit(15)).cast("int")
        plain = F.element_at(F.array(*[F.format_string(f"%.{k}f", c) for k in range(16)]), digits + 1)
        return F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)

    return df.withColumns({c: text(F.col(c)) for c, t in df.dtypes if t == "double"})


ANNOTATIONS = (
    "version INT, app STRING, n_classes INT, classes ARRAY<STRUCT<id: INT, color: STRING>>, interactions ARRAY<STRUCT<uid: BIGINT, slice: STRING, tool: STRING, class: INT, points: ARRAY<ARRAY<DOUBLE>>>>"
)


def annotations(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row a gesture of tolerant, versioned documents; what doesn't parse gives none."""
    parsed = documents.select(F.from_json(column, ANNOTATIONS, {"mode": "PERMISSIVE"}).alias("d"))
    rows = parsed.select(F.coalesce("d.version", F.lit(1)).alias("version"), F.explode("d.interactions").alias("i")).select("version", "i.*")
    return rows.filter("uid IS NOT NULL").withColumn("points", F.transform("points", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def seam_documents(table: DataFrame, item: str = "z") -> DataFrame:
    """One JSON document an item with its seams."""
    fields = F.struct("seam", "a", "b", "j0", "j1", "length")
    return table.groupBy(item).agg(F.to_json(F.struct(F.count("*").alias("n_seams"), F.array_sort(F.collect_list(fields)).alias("seams"))).alias("document"))


#: How many files a task may hold open at once; only beyond them does it sort its rows by their folders.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_shards(rows: DataFrame, path: str, keys: Sequence[str] = ("slide", "tile", "factor")) -> None:
    """Harvest shards; keys that are already there are left alone, so a job may be run again.

    The keys that are there are as many as the folders that Spark lists in the
    driver, and are broadcast: a key may hold any share of the rows.  Tasks of
    an even size write them, a few keys at a time and so without a sort.
    """
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path).select(*keys).distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = None
    new = rows if there is None else rows.join(F.broadcast(there), list(keys), "left_anti")
    before = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, "8")
    try:
        new.hint("rebalance", *[F.col(k) for k in keys]).write.mode("append").partitionBy(*keys).parquet(path)
    finally:
        spark.conf.unset(WRITERS) if before is None else spark.conf.set(WRITERS, before)


def read_shards(spark: SparkSession, path: str, factors: Sequence[float] | None = None, budget: int | None = None, seed: int = 0, keys: Sequence[str] = ("slide", "tile", "factor")) -> DataFrame:
    """Whole shards in a seeded order while they fit the row budget, factors pruned by partition."""
    from pyspark.sql import Window

    rows = spark.read.parquet(path)
    if factors is not None:
        rows = rows.filter(F.col("factor").isin(list(factors)))
    if budget is None:
        return rows
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.lit(seed), *keys))
    total = F.sum("n").over(Window.orderBy("h", *keys).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sizes.withColumn("total", total).filter(F.col("total") <= budget).select(*keys), list(keys), "left_semi")


def to_json_document(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def write_binaries(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``name, content`` as files below a shared folder; returns ``name, bytes`` of what is there.

    Each file is written under a name of its own and moved into place whole.
    """
    import uuid
    from collections.abc import Iterator

    import pandas as pd
    import pyarrow.fs as pafs

    from gridloom.plans.durable import durable, qualified

    uri = qualified(rows.sparkSession, folder)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                part = f"{base}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(bytes(content))
                fs.move(part, f"{base}/{name}")
            yield pd.DataFrame({"name": pdf["name"], "bytes": pdf["content"].map(len)})

    return durable(rows.select("name", "content").mapInPandas(put, "name string, bytes long"), "written")
