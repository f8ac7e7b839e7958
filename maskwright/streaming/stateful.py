"""Operators with state of their own on streams: runs of low samples, and a dictionary that lasts over batches.

State is kept key by key in RocksDB through transformWithState: a few numbers for a run, one entry for a name and one counter for a label. A new name costs one
look-up and one write, however many names there are. Each has a batch form that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scan import running

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_rocksdb(stream: DataFrame) -> DataFrame:
    """transformWithState needs this store; it's set on the session."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream


# ------------------------------------------------------------ runs of low samples

class _Runs(StatefulProcessor):
    def __init__(self, below: float, required: int):
        self.below, self.required = below, required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "n long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        n = self.run.get()[0] if self.run.exists() else 0
        for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
            n = n + 1 if r["value"] is not None and r["value"] < self.below else 0
            if n == self.required:
                yield Row(key=key[0], ts=r["ts"], id=r["id"], value=r["value"])
        self.run.update((n,))

    def close(self) -> None:
        pass


def _samples(rows: DataFrame, key: str, ts: str, value: str, id_: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(id_).cast("long").alias("id"), F.col(value).cast("double").alias("value"))


def low_runs(samples: DataFrame, key: str, ts: str, value: str, id_: str, below: float, required: int = 2) -> DataFrame:
    """(key, ts, id, value) of each sample with which a run of `required` samples below a bound is complete; a sample at the bound or above, or a null, ends the run.

    One row for each run. samples is a stream or a batch; samples of a key must come in the order of (ts, id) over the batches of a stream (within one they are sorted). A null key is one key.
    """
    s = _samples(samples, key, ts, value, id_)
    if samples.isStreaming:
        return _with_rocksdb(s).groupBy("key").transformWithState(_Runs(below, required), "key string, ts timestamp, id long, value double", "Append", "None")
    low = F.coalesce(F.col("value") < below, F.lit(False))
    ordered = running(s, ["key"], ["ts", "id"], None, {"_ended": (~low).cast("long")})
    run = running(ordered.where(low), ["key", "_ended"], ["ts", "id"], "_n")
    return run.where(F.col("_n") == required).select("key", "ts", "id", "value")


# ------------------------------------------------------------ a dictionary that lasts

def _name(label: str, value: str) -> str:
    return f"{label}:{' '.join(value.split()).lower()}"


class _Names(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "name string", "ph string")
        self.counters = handle.getMapState("counters", "label string", "n long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            if r["label"] is None or r["value"] is None:
                continue
            name = (_name(r["label"], r["value"]),)
            if not self.names.containsKey(name):
                label = (r["label"],)
                n = 1 + (self.counters.getValue(label)[0] if self.counters.containsKey(label) else 0)
                ph = f"[{r['label']}_{n}]"
                self.counters.updateValue(label, (n,))
                self.names.updateValue(name, (ph,))
                yield Row(conv_id=key[0], label=r["label"], value=r["value"], ph=ph)

    def close(self) -> None:
        pass


def lasting_dictionary(entities: DataFrame) -> DataFrame:
    """Placeholders numbered over all turns of a conversation: entities streams (conv_id, label, value); emits each new entry once. Values are alike up to case and white space; null labels and values are skipped."""
    e = entities.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("label").cast("string").alias("label"), F.col("value").cast("string").alias("value"))
    return _with_rocksdb(e).groupBy("conv_id").transformWithState(_Names(), "conv_id long, label string, value string, ph string", "Append", "None")
