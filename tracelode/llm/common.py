"""What the operators share: the shared folder, staged tables and Arrow batches of whole texts."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; a longer single text is handled alone.
SLICE_BYTES = 4 << 20

_fallback: dict[str, str] = {}
_caches: dict[str, Callable[[], None]] = {}


def only_cache(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called where a task of an operator begins: a worker that served another operator lets go of what that one remembered."""
    for name in [n for n in _caches if n != owner]:
        _caches.pop(name)()
    if clear:
        _caches[owner] = clear


class Remembered:
    """What a worker remembers of distinct strings: two generations of at most ``limit`` bytes each.

    A string that a batch asks for again moves to the younger generation; when that is full it becomes the older one, and what
    has not been asked for since is let go. Strings of over ``longest`` characters are not remembered.
    """

    def __init__(self, limit: int = 12 << 20, longest: int = 64):
        self.limit, self.longest = limit, longest
        self.clear()

    def clear(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def of(self, want: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The value of each of some distinct strings; ``learn`` gets those that are not known."""
        found = list(map(self.young.get, want))
        if rest := [i for i, v in enumerate(found) if v is None]:
            names = [want[i] for i in rest]
            again = list(map(self.old.get, names))
            if missing := [k for k, v in enumerate(again) if v is None]:
                for k, v in zip(missing, learn([names[k] for k in missing]), strict=True):
                    again[k] = v
            for i, v in zip(rest, again, strict=True):
                found[i] = v
            keep = {x: v for x, v in zip(names, again, strict=True) if len(x) <= self.longest}
            self.size += sum(map(len, keep)) + sum(map(len, keep.values())) + 180 * len(keep)
            self.young.update(keep)
            if self.size > self.limit:
                self.young, self.old, self.size = {}, self.young, 0
        return found


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker gives freed memory back to the system when the task ends."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return out


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="tracelode-")
    return _fallback[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracelode/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared folder and read it back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that nothing needs any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        if "/tracelode/" in parent and path.getName():
            path.getFileSystem(conf).delete(path, True)


def shards_for(total: float, each: float, least: int = 1) -> int:
    """Partitions so that each holds about ``each`` of ``total``: grows with the input, never shrinks the work."""
    return max(least, math.ceil(total / each))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of its text column reach ``limit``."""
    text = batch.column(column)
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def map_texts(
    df: DataFrame,
    text_col: str,
    out: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch, list[str]], Sequence[pa.Array]]],
    drop: Iterable[str] = (),
) -> DataFrame:
    """Add columns made from whole texts, a null text counting as the empty one.

    ``make`` runs once a task and returns what turns a batch and its texts into the new columns. All columns of ``df``
    are kept but those in ``drop``; one whose name clashes with a new one (letters in either case) is replaced.
    """
    gone = {f.name.lower() for f in out} | {c.lower() for c in drop}
    keep = [f for f in df.schema if f.name.lower() not in gone]
    # ``text_col`` goes first, so that the worker finds it although it may be dropped afterwards
    src = df.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{f.name}`") for f in keep])
    schema = T.StructType([*keep, *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for batch in slices(whole, 0):
                texts = [x or "" for x in batch.column(0).to_pylist()]
                cols = [batch.column(i) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, *f(batch, texts)], names=[x.name for x in schema])

    return src.mapInArrow(tidy(run), schema)


def field(name: str, kind: str | T.DataType) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as UTF-8 in one array with a NUL after each, and where each starts and ends in it."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter((len(r) for r in raw), np.int64, len(raw))
    ends = np.cumsum(lens + 1) - 1
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    return data, ends - lens, ends


def lut(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that are ``least`` long or longer."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edge = np.concatenate(([0] if len(mask) and mask[0] else [], edge, [len(mask)] if len(mask) and mask[-1] else [])).astype(np.int64)
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """UTF-8 byte offsets within ``raw`` as code-point offsets; ``offsets`` ascend."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.searchsorted(first, offsets)
