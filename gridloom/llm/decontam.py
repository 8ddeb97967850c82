"""Benchmark decontamination by a prefix-filtered set join, native throughout.

An item's windows (ten consecutive words; a shorter item is one window) are
sets of word shingles.  A document holds a window only if it holds all of its
shingles, so the rarest one alone, by count over the whole corpus, is the
necessary prefix.  Its places in the documents are joined with the windows,
impossible starts are cut by the window's length and the shingle's position in
it, and the words of the window are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.durable import durable

#: What stands between words: ASCII but for digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Benchmarks up to so many distinct windows (some 200 bytes each) are broadcast.
BROADCAST_WINDOWS = 100_000
#: ... and only up to so many bytes, as a word may be of any length.
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Split where no word is: extracting all matches copies the text for each of them."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _key(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)])


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``wid, words, size, width``, and ``wid, item`` of the items that they belong to."""
    items = benchmark.select(F.col(key).alias("item"), words_of(F.col(text)).alias("w")).filter("size(w) > 0")
    starts = items.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("at"))
    cut = durable(starts.select("item", F.slice("w", F.col("at") + 1, window).alias("words")).distinct(), "decontam-cut")
    sized = cut.select("words").distinct().select("words", F.size("words").alias("size"), F.least(F.size("words"), F.lit(shingle)).alias("width"))
    known = durable(sized.withColumn("wid", F.monotonically_increasing_id()), "decontam-windows")
    return known, durable(cut.filter("item IS NOT NULL").join(known.select("words", "wid"), "words").select("wid", "item"), "decontam-items")


def _keys_at(words: Column, at: Column, widths: list[int]) -> Column:
    return F.array(*[F.when(at + w <= F.size(words), _key(words, at, w)) for w in widths])


def _places(docs: DataFrame, widths: list[int], first: int) -> DataFrame:
    """A row a word of each document, with the keys of the shingles that start there."""
    at = docs.select("rid", "doc_id", "w", F.explode(F.sequence(F.lit(first), F.greatest(F.size("w") - 1, F.lit(first)))).alias("at"))
    if len(widths) == 1:
        return at.withColumn("key", F.when((F.col("at") >= 0) & (F.col("at") + widths[0] <= F.size("w")), _key(F.col("w"), F.col("at"), widths[0])))
    return at.select("*", F.explode(_keys_at(F.col("w"), F.col("at"), widths)).alias("key"))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rid, doc_id, n_words, spans, items`` per input row.

    ``spans`` are the distinct ``(start, size)`` of occurring windows in words,
    ``items`` the ids of the items that they belong to.  Null and empty texts
    have no words and no spans.  Repeated rows are reported each; items without
    words match nothing; an item id of null marks words but isn't listed.
    """
    known, listed = windows(benchmark, window, shingle)
    n, weight = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " ")) + 16 * F.size("words")), F.lit(0))).first()
    widths = sorted(r[0] for r in known.select("width").distinct().collect())
    few = n <= broadcast_windows and weight <= broadcast_bytes
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if not few:
        texts = durable(texts, "decontam-texts")
    tokenised = texts.select("rid", "doc_id", words_of(F.col("text")).alias("w"))
    none = tokenised.select(
        "rid", "doc_id", F.size("w").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("wid")
    )
    if not n:
        found = none
    else:
        offsets = known.select("wid", "words", "size", "width", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width"))).alias("offset"))
        shingles = offsets.withColumn("key", F.coalesce(*[F.when(F.col("width") == w, _key(F.col("words"), F.col("offset"), w)) for w in widths]))
        counts = (
            _places(tokenised, widths, 0).select("key").join(small(shingles.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("n"))
        )
        # One row a shingle and window of the benchmark: the rarest shingle of each window is its prefix.
        rarity = shingles.select("wid", "size", "offset", "key").join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rarest = rarity.groupBy("wid").agg(F.min_by(F.struct("size", "offset", "key"), F.struct("n", "key", "offset")).alias("p"), F.min("n").alias("n"))
        prefix = durable(rarest.filter("n > 0").select("wid", "p.*").join(known.select("wid", F.col("words").alias("window")), "wid"), "decontam-prefix")
        start = F.col("at") - F.col("offset")
        if few:
            verified = (start >= 0) & (start + F.col("size") <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("window"))
            columns = ["rid", "doc_id", F.size("w").alias("n_words"), F.when(verified, start).alias("start"), F.when(verified, F.col("size")).alias("size"), F.when(verified, F.col("wid")).alias("wid")]
            # The row at -1 stands for the document itself, so one pass also counts its words.
            found = _places(tokenised, widths, -1).join(F.broadcast(prefix), "key", "left").filter((F.col("at") < 0) | verified).select(*columns)
        else:
            # Places are shuffled without the text, which meets the candidate starts once a document.
            places = _places(tokenised, widths, 0).select("rid", "at", "key").filter("key IS NOT NULL")
            starts = places.join(prefix.drop("window"), "key").select("rid", start.alias("start"), "size", "wid").filter("start >= 0")
            passages = (
                starts.join(tokenised, "rid").filter(F.col("start") + F.col("size") <= F.size("w"))
                .select("rid", "doc_id", F.size("w").alias("n_words"), "start", "size", "wid", F.slice("w", F.col("start") + 1, F.col("size")).alias("passage"))
            )
            found = passages.join(prefix.select("wid", "window"), "wid").filter("passage = window").select(*none.columns).union(none)
    marked = found.groupBy("rid", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "size"))).alias("spans"),
        F.collect_set("wid").alias("wids"),
    )
    marked = durable(marked, "decontam-marked")
    items = marked.select("rid", F.explode("wids").alias("wid")).join(listed, "wid").groupBy("rid").agg(F.collect_set("item").alias("items"))
    return marked.join(items, "rid", "left").select("rid", "doc_id", "n_words", "spans", F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the spans, each counted once."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per input row."""
    found = find_windows(docs, benchmark, **options)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a window of the benchmark, columns unchanged.

    Rows are judged one by one, whether or not they have an id or share it.
    """
    rid = "__rid" + "_" * max(map(len, docs.columns))
    rows = durable(docs.withColumn(rid, F.monotonically_increasing_id()), "decontam-rows")
    dirty = durable(find_windows(rows, benchmark, key=rid).filter("size(spans) > 0").select(F.col("doc_id").alias(rid)), "decontam-dirty")
    return rows.join(dirty, rid, "left_anti").select(*docs.columns)
