"""Keeping an index current: retries, reconciliation, one maintainer, readiness, hooks after a publish."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from codeloom.streaming.changes import merge

#: Seconds: the longest wait after failures, between full passes, that a lease lasts, that a caller waits for an index.
MAX_WAIT, RECONCILE, LEASE, READY = 60.0, 300.0, 30.0, 20.0


def retry_wait(debounce: float, failures: int) -> float:
    """Doubles with every failure in a row, up to MAX_WAIT; the first one waits the debounce time."""
    return min(MAX_WAIT, debounce * 2 ** max(0, failures - 1)) if failures < 64 else MAX_WAIT


@dataclass
class Pending:
    """What a maintainer still has to do. After an overflow or a failure that's a full walk."""

    debounce: float = 0.5
    paths: list[str] = field(default_factory=list)
    rescan: bool = False
    failures: int = 0
    not_before: float = 0.0
    last_full: float = 0.0

    def add(self, paths: list[str], overflow: bool = False) -> None:
        self.paths, self.rescan = merge(self.paths, self.rescan or overflow, paths)

    def due(self, now: float) -> bool:
        """Whether to run: something waits, or the last full pass is RECONCILE old, and no retry holds it back."""
        return now >= self.not_before and (bool(self.paths) or self.rescan or now - self.last_full >= RECONCILE)

    def run(self, now: float, index: Callable[[list[str] | None], None]) -> bool:
        """index(paths), or index(None) for a full walk. A failure keeps the work as a full walk and
        delays the next attempt."""
        full = self.rescan or now - self.last_full >= RECONCILE
        try:
            index(None if full else list(self.paths))
        except Exception:
            self.failures += 1
            self.paths, self.rescan = [], True
            self.not_before = now + retry_wait(self.debounce, self.failures)
            return False
        self.paths, self.rescan, self.failures, self.not_before = [], False, 0, 0.0
        self.last_full = now if full else self.last_full
        return True


class Lease:
    """One maintainer for an index: a file that names its holder and when it ends.

    The file is created in one step that fails if it exists; an ended lease is removed by the
    one that renames it away first.
    """

    def __init__(self, spark: SparkSession, root: str, seconds: float = LEASE, clock: Callable[[], float] = time.time):
        self.name, self.seconds, self.clock = uuid.uuid4().hex, seconds, clock
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self.fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.at = hadoop.Path(f"{root.rstrip('/')}/LEASE")
        self.fs.mkdirs(hadoop.Path(root))

    def _read(self) -> tuple[str, float] | None:
        if not self.fs.exists(self.at):
            return None
        stream = self.fs.open(self.at)
        try:
            holder, _, until = bytes(stream.readAllBytes()).decode().partition(" ")
            return holder, float(until or 0)
        finally:
            stream.close()

    def _write(self, overwrite: bool) -> bool:
        try:
            stream = self.fs.create(self.at, overwrite)
        except Exception:
            return False
        stream.write(bytearray(f"{self.name} {self.clock() + self.seconds}".encode()))
        stream.close()
        return True

    def take(self) -> bool:
        """Whether this maintainer holds the lease now; its own is renewed."""
        held = self._read()
        if held and held[0] == self.name:
            return self._write(True)
        if held and held[1] > self.clock():
            return False
        if held and not self.fs.rename(self.at, self._path(f"{self.at.toString()}.{self.name}")):
            return False
        return self._write(False) and (self._read() or ("",))[0] == self.name

    def release(self) -> None:
        if (self._read() or ("",))[0] == self.name:
            self.fs.delete(self.at, False)


def wait_ready(generation: Callable[[], int], seconds: float = READY, pause: float = 0.2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> int:
    """The published generation, as soon as there is one; an error after seconds without."""
    end = clock() + seconds
    while not (now := generation()):
        if clock() >= end:
            raise TimeoutError("the index isn't built yet")
        sleep(pause)
    return now


def after_publish(hooks: list[Callable[[int], None]], generation: int) -> list[str]:
    """Runs hooks; one that fails gives a warning and never undoes a publish."""
    out = []
    for hook in hooks:
        try:
            hook(generation)
        except Exception as e:
            out.append(f"{getattr(hook, '__name__', 'hook')}: {e}")
    return out


def maintain(batches: DataFrame, index: Callable[[list[str] | None], None], checkpoint: str, hooks: list[Callable[[int], None]] = (), generation: Callable[[], int] = lambda: 0):
    """A streaming query over debounced batches (paths, rescan) that keeps an index current; one
    checkpoint folder is one maintainer. A failing batch fails the query, which resumes it."""

    def each(df: DataFrame, _: int) -> None:
        work = Pending()
        for r in df.select("paths", "rescan").toLocalIterator():
            work.add(list(r["paths"]), r["rescan"])
        if work.paths or work.rescan:
            index(None if work.rescan else work.paths)
            after_publish(list(hooks), generation())

    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
