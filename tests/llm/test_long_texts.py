"""The shuffled branch of decontamination with very long texts and shared passages."""

from __future__ import annotations

import random

from gridloom.llm import decontam


def test_shuffled_windows_in_a_very_long_text(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    passage = " ".join(words[59_985:59_999])
    bench = spark.createDataFrame([(k, passage) for k in range(50)] + [(None, passage), (99, "none of these words is in any text at all here")], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(words)), (2, "word " * 30_000), (None, passage), (3, "")], "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = [decontam.report(df, bench, broadcast_windows=most).collect() for most in (0, 10**6)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for got in both:
        assert {(x.doc_id, x.n_words, x.n_hit, x.n_items) for x in got} == {(1, 60_000, 14, 50), (2, 30_000, 0, 0), (None, 14, 14, 50), (3, 0, 0, 0)}
