"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; everything else belongs to a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine (as in tests) gets a local
    folder; on a cluster that is an error, as executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = getattr(spark, "_depthline_dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = spark._depthline_dir = "file://" + tempfile.mkdtemp(prefix="depthline-")
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session has ended; its folder goes with the cluster's own clean-up
        pass


_INNERMOST: ContextVar = ContextVar("scratch", default=None)


class Scratch:
    """Tables in the shared folder that last until it is closed.

    Inside a ``with`` block every ``stored`` table belongs to the innermost scratch, so
    an operator's intermediates go as soon as its result is written.  Without one,
    tables last until the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.outer = _INNERMOST.get()
        _INNERMOST.set(self)
        return self

    def __exit__(self, *_) -> None:
        _INNERMOST.set(self.outer)
        self.close()

    def close(self) -> None:
        while self.paths:
            _delete(self.spark, self.paths.pop())

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a stored table that outlives this scratch: it belongs to the one around it."""
        return stored(df, name, self.outer)


_OWN = object()


def scratch_path(spark: SparkSession, name: str, scratch=_OWN) -> str:
    """A new path in the shared folder; what is written there goes with the scratch or at the process's end."""
    scratch = _INNERMOST.get() if scratch is _OWN else scratch
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if scratch is None:
        atexit.register(_delete, spark, path)
    else:
        scratch.paths.append(path)
    return path


def stored(df: DataFrame, name: str, scratch=_OWN) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that read the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, scratch)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- numpy helpers for Arrow batches ---------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(n, 2 * len(_POW))
        grown = np.full(size, _P, np.uint64)
        grown[0] = 1
        _POW = np.multiply.accumulate(grown)
    return _POW[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts and, per text, where its words begin.

    Returns ``(hashes, bounds)``; the words of text ``i`` are
    ``hashes[bounds[i]:bounds[i + 1]]``.  None counts as the empty text.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(sizes + 1)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    starts = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    stops = np.flatnonzero(space & np.concatenate(([False], word[:-1])))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lengths = stops - starts
    chars = data[word].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    hashes = np.add.reduceat(chars * _powers(int(lengths.max()))[place], first)
    return mix(hashes ^ (lengths.astype(np.uint64) << np.uint64(56))), bounds
