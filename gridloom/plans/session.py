"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000}


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lower the Arrow batch size of ``df``'s session, never raise it; returns ``df``.

    Texts differ in length by orders of magnitude, so Python workers are fed by
    the megabyte and not by ten thousand rows.
    """
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            conf.set(key, str(most))
    return df
