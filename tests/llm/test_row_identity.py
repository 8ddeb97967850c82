"""Stages of the pipeline on rows that share an id or have none."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

from gridloom.llm import decontam, mixing, simhash, suffix, urls


def test_thousands_of_texts_under_null_and_equal_ids(spark):
    r = random.Random(4)
    passage = "".join(r.choice(string.ascii_lowercase) for _ in range(150))

    def own(k):
        return "".join(r.choice(string.ascii_lowercase) for _ in range(k))

    # Half of the texts repeat the passage, behind a beginning of varying length; the others are short and have no repeat.
    texts = [own(r.randint(0, 300)) + passage if k % 2 else own(r.randint(100, 140)) for k in range(3000)]
    df = spark.createDataFrame([(None if k % 3 else 5, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    order = [x.text for x in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select("text").collect()]
    want, seen = [], set()
    for t in order:
        gone = set()
        for at in range(len(t) - 99):
            if t[at : at + 100] in seen:
                gone |= set(range(at, at + 100))
        seen |= {t[at : at + 100] for at in range(len(t) - 99)}
        want.append((len(t), len(gone), "".join(x for k, x in enumerate(t) if k not in gone)))
    assert sum(x[1] > 0 for x in want) == 1499
    assert sorted((x.n_bytes, x.n_removed) for x in suffix.report(df).collect()) == sorted(x[:2] for x in want)
    assert sorted(x.text for x in suffix.remove(df).collect()) == sorted(x[2] for x in want)


def test_clean_rows_are_kept_one_by_one(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(None, f"so {passage} it is"), (None, "clean without an id"), (1, passage), (1, "clean with the same id"), (2, passage), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {(x.doc_id, x.text) for x in decontam.keep_clean(df, bench).collect()}
    assert got == {rows[1], rows[3], rows[5]}


def test_fingerprints_without_ids_bridge_others(spark, monkeypatch):
    """Fingerprints 0, 3, 15 and 63 are two bits apart each; every second one has no id."""
    rows = [(1, 0), (None, 3), (5, 15), (None, 63), (9, 0x0F0F0F0F << 16), (None, -1), (None, -1)]
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, key, text: docs.select("doc_id", "fp"))
    for bucket in (64, 0):
        got = sorted((tuple(r) for r in simhash.near_duplicates(fps, bucket=bucket).collect()), key=repr)
        assert got == sorted([(1, 0, 1), (None, 3, 1), (5, 15, 1), (None, 63, 1), (9, 0x0F0F0F0F << 16, 9), (None, -1, None), (None, -1, None)], key=repr)


def test_hot_rows_without_ids_are_mixed_exactly(spark):
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    other = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("t").alias("source"))
    rows = mixing.mix(hot.union(other).repartition(5))
    by = {r.source_size: r for r in rows.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()}
    assert by[9000].n == 3000 and by[1000].n == 500
    for n, r in by.items():
        assert abs(r.taken - r.target) <= 3 and r.most <= 3


def test_a_label_of_a_hundred_thousand_characters(spark):
    label = ("cheappills" * 10_001)[:100_005]
    long_word = "pillscheappillscheappills"
    words = spark.createDataFrame([("cheap", 50), ("pills", 20), ("s", 1), (long_word, 5), ("pillscheappillscheapx", 9)], "word string, n long")
    got = {r.label: r.words for r in urls.segment_labels(spark.createDataFrame([(label,), ("cheap",), ("ü",)], "label string"), words).collect()}
    assert "".join(got[label]) == label and set(got[label]) <= {"cheap", "pills", long_word} and got["cheap"] == ["cheap"] and got["ü"] == ["ü"]
