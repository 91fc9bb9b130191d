"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Characters of text handled at once inside a Python worker. It bounds memory
#: only: every text is processed whole, and a longer text forms its own block.
BLOCK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, and if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="seisframe-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/seisframe/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop(staged_table: DataFrame) -> None:
    """Remove a table that ``staged`` wrote and nothing reads any more."""
    context = staged_table.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(staged_table.staged_path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the faster built-in, which then does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal digits, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def release() -> None:
    """Give freed memory back: Python workers outlive their task."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows, about ``limit`` characters together; null text counts as empty."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at = size = 0
        out: list[str] = []
        for k, scalar in enumerate(texts):
            value = scalar.as_py() or ""
            out.append(value)
            size += len(value) + 16
            if size >= limit:
                yield ids.slice(at, len(out)).to_pylist(), out
                at, size, out = k + 1, 0, []
        if out:
            yield ids.slice(at, len(out)).to_pylist(), out


def map_blocks(docs: DataFrame, fn: Callable[[list, list[str]], dict], schema: str, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK_CHARS) -> DataFrame:
    """Apply ``fn(ids, texts) -> columns`` block by block, through Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, limit):
            out = fn(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            del out
        release()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, test: Callable[[list[str]], list[bool]], text_col: str = "text", rows: int = 512) -> DataFrame:
    """The rows of ``docs`` whose texts (null: empty) pass the test, with all columns; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                yield part.filter(pa.array(test([t or "" for t in part.column(at).to_pylist()]), type=pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


class WordHashes(dict):
    """UTF-8 word -> 64-bit hash. It forgets what it has seen at ``LIMIT`` words, which bounds memory only."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def size_of(df: DataFrame) -> int:
    """Spark's estimate of a relation's bytes; exact file sizes for a table just written."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Written tables up to this size are broadcast.
SMALL = 8 << 20


def sized(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if size_of(df) <= SMALL else df


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[dict[str, list]], dict], schema: str, order: str = "id") -> DataFrame:
    """Apply ``fn(columns) -> columns`` to the rows of each key, ordered; groups must be small enough for a task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow, names = to_arrow_schema(_parse_datatype_string(schema)), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        key, out, rows = None, {f.name: [] for f in arrow}, 0

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

        def close() -> int:
            made = fn(held)
            for f in arrow:
                out[f.name] += made[f.name]
            return len(made[arrow[0].name])

        for batch in batches:
            columns = {n: c.to_pylist() for n, c in zip(names, batch.columns, strict=True)}
            for i, own in enumerate(zip(*(columns[k] for k in keys), strict=True)):
                if own != key and key is not None:
                    rows += close()
                    held = {n: [] for n in names}
                    if rows >= 10_000:
                        yield result()
                        out, rows = {f.name: [] for f in arrow}, 0
                key = own
                for n in names:
                    held[n].append(columns[n][i])
        if key is not None:
            close()
        yield result()
        del held, out
        release()

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
