"""The engine as an object: an index that is created, loaded, asked, flushed and closed, and control messages.

The index is a folder of Parquet saves, one for each flush, with the keys that changed
since the one before; every FULL-th holds all keys. A save counts once its marker of
success is there, so a flush that fails leaves the one before it. A call costs what it
asks and what changed since the last full save, not what was asked before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata.operators import index as I
from blockstrata.operators import stats as S
from blockstrata.runtime import keep, remove

_HELD = "key long, metadata double, seq long, gone boolean"
#: Saves of changes, at most, before one with all keys.
FULL = 16


class SessionError(RuntimeError):
    """A call that the session's state does not allow."""


class IndexSession:
    """One index: open, ask, flush, suspend, resume, close."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.state = spark, path.rstrip("/"), "closed"
        self.saves, self.base, self.recent, self.kept, self.counts = 0, 0, [], [], None

    def _at(self, n: int, full: bool) -> str:
        return f"{self.path}/{'full' if full else 'save'}-{n:06d}"

    def _found(self) -> tuple[list[int], list[int]]:
        """The numbers of whole saves: those with all keys, and those with changes."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return [], []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        whole = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return tuple(sorted(int(n[5:]) for n in whole if n.startswith(kind)) for kind in ("full-", "save-"))

    def open(self, mode: str = "load") -> IndexSession:
        """``create`` begins empty, ``load`` takes the latest whole save, and ``no_rebuild`` fails where there is none."""
        if self.state != "closed":
            raise SessionError(f"open while {self.state}")
        full, changes = self._found()
        if mode == "no_rebuild" and not full:
            raise SessionError("no save to load")
        if mode not in ("create", "load", "no_rebuild"):
            raise SessionError(f"unknown mode {mode}")
        self.base = full[-1] if full else 0
        self.saves = max([self.base, *changes])
        if mode == "create" or not full:
            self.saves = self.base = self.saves + 1
            self.spark.createDataFrame([], _HELD).write.parquet(self._at(self.base, True))
        self.state, self.recent = "online", []
        return self

    def _need(self, *states: str) -> None:
        if self.state not in states:
            raise SessionError(f"not possible while {self.state}")

    def _latest(self, layers: list[DataFrame]) -> DataFrame:
        """The last record of each key over layers, the oldest first."""
        rows = [df.select("key", "metadata", "seq", "gone", F.lit(k).alias("layer")) for k, df in enumerate(layers)]
        last = reduce(DataFrame.unionByName, rows).groupBy("key").agg(F.max_by(F.struct("metadata", "seq", "gone"), "layer").alias("r"))
        return last.select("key", "r.*")

    def _saved(self) -> list[DataFrame]:
        read = self.spark.read.schema(_HELD)
        return [read.parquet(self._at(self.base, True)), *(read.parquet(self._at(n, False)) for n in range(self.base + 1, self.saves + 1))]

    def held(self) -> DataFrame:
        """The records of the latest save."""
        return self._latest(self._saved()).filter("not gone").select("key", "metadata", "seq")

    def ask(self, requests: DataFrame, callback: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Answers to requests (seq, key, op, metadata), after all that was asked before; ``callback`` gets them too. They last until the session closes."""
        self._need("online")
        own = requests.select("seq", "key", "op", "metadata", F.lit(0).alias("kind"))
        after = own.groupBy("key").agg((F.max("seq") + 1).alias("seq")).select("seq", "key", F.lit("QUERY_NO_UPDATE").alias("op"), F.lit(None).cast("double").alias("metadata"), F.lit(1).alias("kind"))
        known = self._latest([df.join(after.select("key"), "key", "left_semi") for df in [*self._saved(), *self.recent]]).filter("not gone")
        start = known.join(own.groupBy("key").agg(F.min("seq").alias("first")), "key").select((F.col("first") - 1).alias("seq"), "key", F.lit("UPDATE").alias("op"), "metadata", F.lit(2).alias("kind"))
        done, path = keep(I.answers(start.unionByName(own).unionByName(after)))
        self.kept.append(path)
        self.recent.append(done.filter("kind = 1").select("key", F.col("old_metadata").alias("metadata"), "seq", (~F.col("found")).alias("gone")))
        answered = done.filter("kind = 0").drop("kind")
        self.counts = I.stats(answered)
        if callback:
            callback(answered)
        return answered

    def flush(self) -> None:
        """Save what changed by everything asked so far; all keys, once many saves have only changes."""
        self._need("online", "suspended")
        if not self.recent:
            return
        n = self.saves + 1
        if n - self.base >= FULL:
            self._latest([*self._saved(), *self.recent]).filter("not gone").write.parquet(self._at(n, True))
            self.base = n
        else:
            self._latest(self.recent).write.parquet(self._at(n, False))
        self.saves, self.recent = n, []

    def suspend(self, save: bool = True) -> None:
        self._need("online")
        if save:
            self.flush()
        self.state = "suspended"

    def resume(self) -> None:
        self._need("suspended")
        self.state = "online"

    def close(self) -> None:
        if self.state == "online":
            self.flush()
        for path in self.kept:
            remove(self.spark, path)
        self.state, self.recent, self.kept = "closed", [], []

    def stats(self) -> DataFrame:
        """Requests by kind and outcome of the last call."""
        self._need("online", "suspended")
        if self.counts is None:
            raise SessionError("nothing was asked yet")
        return self.counts


class Engine:
    """Control messages and the status line of a device."""

    def __init__(self, device: str, index: IndexSession, stats: Callable[[], DataFrame], total_blocks: int):
        self.device, self.index, self.stats, self.total = device, index, stats, total_blocks
        self.compression, self.deduplication, self.dump_on_shutdown = False, True, False

    def message(self, *words: str) -> DataFrame | None:
        """Run one message; ``stats`` and ``dump`` give a DataFrame."""
        match [w.lower() for w in words]:
            case ["stats"]:
                return S.as_text(self.stats())
            case ["dump"] | ["dump", "all"]:
                return S.rows_of(self.stats())
            case ["dump-on-shutdown"]:
                self.dump_on_shutdown = True
            case ["compression", ("on" | "off") as v]:
                self.compression = v == "on"
            case ["index-create"]:
                self.index.open("create")
            case ["index-close"]:
                self.index.close()
            case ["index-enable"]:
                self.deduplication = True
            case ["index-disable"]:
                self.deduplication = False
            case _:
                raise SessionError(f"unknown message {' '.join(words)}")
        return None

    def status(self, used: DataFrame) -> DataFrame:
        """The status line; ``used`` has one number, the blocks in use."""
        index = self.index.state if self.deduplication else "offline"
        return S.status(self.device, "normal", "-", index, self.compression, used, self.total)
