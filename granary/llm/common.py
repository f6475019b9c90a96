"""What the operators share: input columns, tables in the shared folder, and words of Arrow batches as numpy arrays."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text that are turned into numpy arrays at a time.
BLOCK = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Has Spark send workers batches of 8 MB, unless the session was given another bound than Spark's own 64 MB: a batch is held
    several times over, in the JVM beside its heap and in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") in (str(64 << 20), "64m"):
        spark.conf.set(name, most)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names; and smaller batches for workers, see small_batches()."""
    small_batches(df.sparkSession)
    return df.select(*[df[old].alias(new) for new, old in cols.items()])


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learned from; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can read. Where that is unset, below the session's warehouse
    if that was set or Spark runs on one machine; else it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        given = spark.sparkContext.getConf().contains("spark.sql.warehouse.dir") or spark.sparkContext.master.split("[")[0] == "local"
        if not given:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/granary/{name}-{uuid.uuid4().hex}"


#: The stretches of work that are open in this thread (or task of an event loop), each with the tables it stored.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open stretches", default=())


@contextmanager
def scratch(spark: SparkSession):
    """A stretch of work whose stored tables are deleted when it ends, but for those stored with keep=True (they go with the stretch
    around it, if there is one). What is kept must not need the others. An error leaves the tables where they are. Each
    thread has stretches of its own, so queries that run side by side in one driver leave each other's tables alone."""
    mine: list[str] = []
    before = _open.set((*_open.get(), mine))
    try:
        yield
    finally:
        _open.reset(before)
    for path in mine:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: cuts the lineage, and a lost executor costs nothing
    that was already written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    around = _open.get()[: -1 if keep else None]
    if around:
        around[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string array and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = BLOCK):
    """The batch in slices of about `most` bytes of text; one row at least."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    release()


def release() -> None:
    """Gives memory that is free back to the system: workers live as long as their executor, and what one operator needed for a
    moment would otherwise count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to ask for
        pass


def text_column(kind: str, judge):
    """A function of a text column that gives values of the Spark type `kind`: judge gets Arrow arrays of about BLOCK bytes of text
    and gives an Arrow array each. Other columns of the rows stay in the JVM."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [judge(part.column(0)) for part in slices(batch, "text")]
        return pa.concat_arrays(parts) if parts else judge(texts)

    return run


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def met(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """The rows with the columns of their group. groups has one row for each key of the rows (null is a key) and in `count` how many rows
    it is of. Keys of over a thousandth of all rows, of which there are fewer than a thousand, are met by a broadcast, all others by a
    shuffle in which no key is hot. Both tables are read twice, so they should be stored."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot, is_hot = groups.where(F.col(count) * 1000 > total), F.col(count) * 1000 <= total
    other, seen = fresh(rows, "other_key"), fresh(rows, "is_hot")

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, left[key].eqNullSafe(right[other]), how)

    marked = joined(rows, F.broadcast(hot.withColumnRenamed(key, other).withColumn(seen, F.lit(True))), "left")
    columns = [*rows.columns, *[c for c in groups.columns if c != key]]
    cold = joined(marked.where(F.col(seen).isNull()).select(rows.columns), groups.where(is_hot).withColumnRenamed(key, other), "inner")
    return marked.where(F.col(seen)).select(columns).unionByName(cold.select(columns))


#: Bits of the bitmap of a key filter: 4 MB, whatever the number of keys.
FILTER_BITS = 25


class KeyFilter:
    """A bitmap of 2 ** FILTER_BITS bits of the 64-bit hashes in a column of keys: rows whose hash it lacks are certain to have none of
    the keys. With very many keys it lets everything through, and the join that follows does all. The bitmap is a table of at
    most 2 ** (FILTER_BITS - 6) words, which is what bounds the broadcasts of it."""

    def __init__(self, keys: DataFrame, column: str) -> None:
        low = F.col(column).bitwiseAND((1 << FILTER_BITS) - 1)
        words = keys.where(F.col(column).isNotNull()).select(F.shiftright(low, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63L as int))").alias("bits"))
        self.words = stored(words.groupBy("word").agg(F.bit_or("bits").alias("bits")), "bitmap")

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The rows of df whose hash in `column` may be one of the keys, and those whose hash is none."""
        word, bits = fresh(df, "bitmap_word"), fresh(df, "bitmap_bits")
        at = F.shiftright(F.col(column).bitwiseAND((1 << FILTER_BITS) - 1), 6).cast("int")
        marked = df.join(F.broadcast(self.words.toDF(word, bits)), at == F.col(word), "left")
        hit = F.expr(f"coalesce(shiftright(`{bits}`, cast(`{column}` & 63L as int)) & 1L, 0L) = 1L")
        return marked.where(hit).select(df.columns), marked.where(~hit).select(df.columns)

    def sent(self):
        """The bitmap as a broadcast array of 64-bit words, for in_filter()."""
        made = self.words.toArrow()
        held = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        held[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
        return self.words.sparkSession.sparkContext.broadcast(held)


def in_filter(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes.view(np.uint64) & np.uint64(64 * len(held) - 1)
    return (held[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)) > 0


def rng_table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Runs:
    """Hashes and comparisons of stretches of symbols (bytes or 32-bit code points), eight bytes at a time.

    A hash goes through a mixing step for every eight bytes, so no structure of the symbols makes two stretches collide, as sums of
    powers of a base do. Where equality must be certain, equal() compares the symbols.
    """

    _LONG = 32  # steps after which a stretch is left to a library's digest

    def __init__(self, symbols: np.ndarray) -> None:
        self._over(np.append(symbols, np.zeros(8 // symbols.itemsize, symbols.dtype)), len(symbols))

    @classmethod
    def over(cls, buffer: np.ndarray, n: int) -> Runs:
        """Of the first n symbols of a contiguous array that goes on for eight bytes more; nothing is copied."""
        made = cls.__new__(cls)
        made._over(buffer, n)
        return made

    def _over(self, buffer: np.ndarray, n: int) -> None:
        self.symbols, self.size = buffer[:n], buffer.itemsize
        self.per = 8 // self.size
        self.loads = np.ndarray((n + 1,), "<u8", buffer, strides=(self.size,))
        self.masks = np.array([(1 << (8 * self.size * k)) - 1 for k in range(self.per + 1)], np.uint64)

    def _bytes(self, start: int, length: int) -> bytes:
        return self.symbols[start : start + length].tobytes()

    def hashes(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        h = mix(lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        at, left, todo = starts, lengths, None
        for step in range(self._LONG):
            now = self.loads[at] & self.masks[np.minimum(left, self.per)]
            if todo is None:
                h = mix(h ^ now)
            else:
                h[todo] = mix(h[todo] ^ now)
            more = np.flatnonzero(left > self.per)
            if not len(more):
                return h
            todo = more if todo is None else todo[more]
            at, left = at[more] + self.per, left[more] - self.per
        for k in todo.tolist():
            h[k] = int.from_bytes(hashlib.blake2b(self._bytes(starts[k], lengths[k]), digest_size=8).digest(), "little")
        return h

    def equal(self, starts: np.ndarray, lengths: np.ndarray, other: Runs, others: np.ndarray, their_lengths: np.ndarray) -> np.ndarray:
        """Whether each stretch of this one is the same as the one of the other."""
        same = lengths == their_lengths
        todo = np.flatnonzero(same)
        a, b, left = starts[todo], others[todo], lengths[todo]
        for _ in range(self._LONG):
            mask = self.masks[np.minimum(left, self.per)]
            ok = (self.loads[a] & mask) == (other.loads[b] & mask)
            same[todo[~ok]] = False
            more = np.flatnonzero(ok & (left > self.per))
            if not len(more):
                return same
            todo, a, b, left = todo[more], a[more] + self.per, b[more] + self.per, left[more] - self.per
        for k, x, y, n in zip(todo.tolist(), a.tolist(), b.tolist(), left.tolist(), strict=True):
            same[k] = self._bytes(x, n) == other._bytes(y, n)
        return same


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def windows(codes: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """Hashes of every n codes that lie `step` apart: stretches of 1, 2, 4 and so on are joined to n."""
    if len(codes) <= (n - 1) * step:
        return codes[:0]
    got, have, part, width, left = None, 0, codes, 1, n
    while True:
        if left & 1:
            count = len(codes) - (have + width - 1) * step
            got, have = part if got is None else _join(got[:count], part[have * step : have * step + count]), have + width
        left >>= 1
        if not left:
            return got
        part, width = _join(part[: -width * step], part[width * step :]), 2 * width


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


class Words:
    """The words of a batch of texts: rows (the text of each), starts and ends (byte offsets), hashes, and bounds (rows'
    first words, with the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = False, prefixes: tuple[int, ...] = ()) -> None:
        """is_word: for each byte value, whether it is part of words. lower: A-Z count as a-z. prefixes: lengths up to 8 bytes for
        which self.prefixes has the hashes of the words' first bytes, 0 for words that are no longer."""
        self.data, self.offsets = _FOLDED[data] if lower else data, offsets
        inside = is_word[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before &= ~first[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after &= ~first[1:]
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.runs, self.lengths = Runs(self.data), self.ends - self.starts
        self.hashes = self.runs.hashes(self.starts, self.lengths)
        self.prefixes = [np.where(self.lengths > n, self.runs.hashes(self.starts, np.minimum(self.lengths, n)) ^ np.uint64(n), np.uint64(0)) for n in prefixes]
        self.bounds = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def text(self, at: int, end: int | None = None) -> bytes:
        """The bytes from word `at` to the word before `end`."""
        return self.data[self.starts[at] : self.ends[at if end is None else end - 1]].tobytes()

    def equal(self, at: np.ndarray, n: int, other: Words, places: np.ndarray) -> np.ndarray:
        """Whether the n words from each of `at` are those of the other from each of `places`, byte by byte."""
        reach = np.arange(n)
        a, b = (at[:, None] + reach).ravel(), (places[:, None] + reach).ravel()
        return self.runs.equal(self.starts[a], self.lengths[a], other.runs, other.starts[b], other.lengths[b]).reshape(len(at), n).all(1)


def byte_set(outside: bytes) -> np.ndarray:
    """is_word for words of all bytes but those given."""
    found = np.ones(256, bool)
    found[list(outside)] = False
    return found


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n places lie in one of the stretches."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0
