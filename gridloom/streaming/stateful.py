"""Arbitrary state over streams: slices released in order, and features linked slice by slice.

State lives in Spark's state store (RocksDB), is checkpointed with the stream
and is rebuilt by Spark after a lost executor.  Results go to Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gridloom.operators.linking import STEPS, node_id
from gridloom.plans.durable import fresh_path
from gridloom.plans.ranking import global_rank

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def to_parquet(df: DataFrame, label: str = "stream", mode: str = "append") -> DataFrame:
    """Run a stream over what there is into a new Parquet folder and read that back.

    The state store provider is set for the start of this stream only.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark, f"{label}-log")).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


class InOrder(StatefulProcessor):
    """The next index of a sequence, and those that wait for one before them: the sorted offsets of each block of indices.

    A worker holds what is gathered, one block and a number a block, however many wait.
    """

    #: Indices of a block, whose offsets fit two bytes, and how many are gathered before they go to the state.
    BLOCK, GATHERED = 1 << 14, 1 << 18

    def __init__(self, columns: tuple[str, str], time: str | None, patience_ms: int) -> None:
        self.columns, self.time, self.patience_ms = columns, time, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.expected = handle.getValueState("expected", "at long")
        self.waiting = handle.getMapState("waiting", "block long", "offsets binary")

    def _offsets(self, block: int) -> np.ndarray:
        stored = self.waiting.getValue((block,))
        return np.frombuffer(stored[0] if stored else b"", "<u2")

    def _keep(self, gathered: list[np.ndarray]) -> None:
        indices = np.unique(np.concatenate(gathered))
        cuts = [0, *(np.flatnonzero(np.diff(indices // self.BLOCK)) + 1).tolist(), len(indices)]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if stop > start:
                block = int(indices[start] // self.BLOCK)
                offsets = (indices[start:stop] - block * self.BLOCK).astype("<u2")
                self.waiting.updateValue((block,), (np.union1d(self._offsets(block), offsets).tobytes(),))

    def _next(self, at: int) -> Iterator[np.ndarray]:
        """The indices from ``at`` up to the first that isn't there, block by block."""
        while True:
            block, first = divmod(at, self.BLOCK)
            offsets = self._offsets(block)
            gaps = np.flatnonzero(offsets != first + np.arange(len(offsets)))
            n = int(gaps[0]) if len(gaps) else len(offsets)
            if n:
                rest = offsets[n:]
                self.waiting.updateValue((block,), (rest.tobytes(),)) if len(rest) else self.waiting.removeKey((block,))
                yield at + np.arange(n)
            at += n
            if not n or at % self.BLOCK:
                return

    def _all(self) -> Iterator[np.ndarray]:
        """All that wait, over the gaps."""
        for block in np.sort(np.fromiter((k[0] for k in self.waiting.keys()), np.int64)).tolist() if self.waiting.exists() else []:
            yield block * self.BLOCK + self._offsets(block).astype(np.int64)
        self.waiting.clear()

    def _release(self, key: tuple, parts: Iterator[np.ndarray], skip: bool) -> Iterator[pd.DataFrame]:
        for part in parts:
            self.expected.update((int(part[-1]) + 1,))
            yield pd.DataFrame({self.columns[0]: key[0], self.columns[1]: part, "flushed": skip})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.expected.get()[0] if self.expected.exists() else 0
        gathered, newest = [], 0
        for pdf in rows:
            indices = pdf[self.columns[1]]
            gathered.append(indices[indices >= at].to_numpy().astype(np.int64))
            newest = max(newest, int(pdf[self.time].max().timestamp() * 1000)) if self.time else 0
            if sum(map(len, gathered)) >= self.GATHERED:
                self._keep(gathered)
                gathered = []
        if gathered:
            self._keep(gathered)
        yield from self._release(key, self._next(at), False)
        if self.time:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.waiting.exists():
                self.handle.registerTimer(newest + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, self._all(), True)

    def close(self) -> None:
        pass


def in_order(slices: DataFrame, sequence: str = "sequence", index: str = "index", time: str | None = None, late: str = "0 seconds", patience_ms: int = 3_600_000) -> DataFrame:
    """``sequence, index, flushed``: each index once all before it are there.

    Indices start at 0; those already released and repeats are dropped.  With
    ``time``, what still waits when the watermark is the patience past the last
    arrival is released over the gap (``flushed``), and what would have filled
    it is dropped if it comes in a later trigger.  State: one number and the
    waiting indices of a sequence, two bytes each in blocks.
    """
    kept = slices.select(F.col(sequence).cast("long").alias(sequence), F.col(index).cast("long").alias(index), *([time] if time else []))
    kept = kept.withWatermark(time, late) if time else kept
    return kept.groupBy(sequence).transformWithStateInPandas(
        statefulProcessor=InOrder((sequence, index), time, patience_ms), outputStructType=f"{sequence} long, {index} long, flushed boolean",
        outputMode="append", timeMode="EventTime" if time else "None",
    )


class TileLinks(StatefulProcessor):
    """The cells of a tile's last slice with their components: what the next slice can touch."""

    def __init__(self, steps: list[tuple[int, int]]) -> None:
        self.steps = steps

    def init(self, handle) -> None:
        self.last = handle.getListState("last", "z long, y long, x long, node long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        before = pd.DataFrame(list(self.last.get()) if self.last.exists() else [], columns=["z", "y", "x", "node"])
        edges = []
        for z, cells in sorted(new.groupby("z"), key=lambda g: g[0]):
            if len(before) and before["z"].iloc[0] >= z:
                raise ValueError(f"slice {z} came after slice {before['z'].iloc[0]}: put in_order before the linking")
            own = cells[cells["own"]]
            edges.append(pd.DataFrame({"u": own["node"], "v": own["node"]}))
            if len(before) and before["z"].iloc[0] == z - 1:
                for dy, dx in self.steps:
                    moved = own.assign(y=own["y"] + dy, x=own["x"] + dx).merge(before, on=["y", "x"], suffixes=("", "_before"))
                    edges.append(pd.DataFrame({"u": moved["node"], "v": moved["node_before"]}))
            before = cells[["z", "y", "x", "node"]]
        self.last.put([tuple(map(int, r)) for r in before.itertuples(index=False)])
        out = pd.concat(edges).drop_duplicates()
        yield out.assign(volume=key[0]).astype("int64")[["volume", "u", "v"]]

    def close(self) -> None:
        pass


class Forest(StatefulProcessor):
    """Which node each component stands for: a union-find forest over the nodes seen so far."""

    def init(self, handle) -> None:
        self.parent = handle.getMapState("parent", "node long", "parent long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parent = {int(k[0]): int(v[0]) for k, v in self.parent.iterator()} if self.parent.exists() else {}
        stored = dict(parent)

        def find(a: int) -> int:
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            return a

        out = []
        for pdf in rows:
            for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = find(u), find(v)
                if a != b:
                    # Both stood for features of their own until now, or one of them is new.
                    parent[max(a, b)] = min(a, b)
        for node in list(parent):
            root = find(node)
            if stored.get(node) != root:
                self.parent.updateValue((node,), (root,))
                out.append((key[0], node, root, node in stored))
        yield pd.DataFrame(out, columns=["volume", "node", "root", "renamed"])

    def close(self) -> None:
        pass


def tiled(labelled: DataFrame, connectivity: int, tile: int) -> DataFrame:
    """Each cell at its own tile, and as a neighbour at the tiles that it may be touched from."""
    spots = [F.struct(F.floor((F.col("y") + dy) / tile).cast("long").alias("ty"), F.floor((F.col("x") + dx) / tile).cast("long").alias("tx")) for dy, dx in STEPS[connectivity]]
    home = F.struct(F.floor(F.col("y") / tile).cast("long").alias("ty"), F.floor(F.col("x") / tile).cast("long").alias("tx"))
    cells = labelled.select("volume", F.col("z").cast("long").alias("z"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), node_id().alias("node"))
    return cells.withColumn("t", F.explode(F.array_distinct(F.array(*spots)))).select("volume", "t.ty", "t.tx", "z", "y", "x", "node", (F.col("t") == home).alias("own"))


def link_stream(labelled: DataFrame, connectivity: int = 6, tile: int = 512) -> DataFrame:
    """``volume, node, root, renamed`` as slices arrive: the first node of each node's feature, and again whenever it changes.

    ``labelled`` streams ``volume, z, y, x, component``, a slice in one trigger
    and slices in order.  Cells stay in a tile's state for one slice; a volume's
    state is its components.  A late bridge renames the nodes of the feature
    that was seen later.
    """
    edges = tiled(labelled, connectivity, tile).groupBy("volume", "ty", "tx").transformWithStateInPandas(
        statefulProcessor=TileLinks(STEPS[connectivity]), outputStructType="volume long, u long, v long", outputMode="append", timeMode="None"
    )
    return edges.groupBy("volume").transformWithStateInPandas(
        statefulProcessor=Forest(), outputStructType="volume long, node long, root long, renamed boolean", outputMode="append", timeMode="None"
    )


def final_ids(named: DataFrame) -> DataFrame:
    """``volume, slice_index, segment_id, global_id`` once all slices are in: each node's last root, numbered from 1 in a volume.

    Roots only ever get smaller, so the last is the least.
    """
    last = named.groupBy("volume", "node").agg(F.min("root").alias("root"))
    ids = global_rank(last.select("volume", "root").distinct(), "volume", "root", out="rank")
    first = ids.groupBy("volume").agg((F.min("rank") - 1).alias("before"))
    numbered = ids.join(first, "volume").select("volume", "root", (F.col("rank") - F.col("before")).cast("int").alias("global_id"))
    return last.join(numbered, ["volume", "root"]).select(
        "volume", F.shiftright("node", 32).cast("int").alias("slice_index"), F.col("node").bitwiseAND(F.lit((1 << 32) - 1)).alias("segment_id"), "global_id"
    )
