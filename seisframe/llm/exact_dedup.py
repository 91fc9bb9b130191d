"""Exact deduplication by an extendible-hash index on shared files.

The directory maps the leading bits of a 64-bit key to buckets. It doubles
until no bucket holds more than ``capacity`` keys: a level adds up to ``LEVEL``
bits below the slots that are still too full, so it has as many levels as the
keys need, up to all 64 bits, and is a table, whatever its size. Documents are
routed through it to the task that owns their bucket, a range of keys. There
rows of one key stand together, ordered by their bytes: each different text is
a link of the key's chain, and rows are copies if they share a link.

A key with very many rows, or very many bytes, would overload its owner. The
rows of such keys are united by key and bytes before they move; the chain made
of what is left is then joined back to the rows, again by bytes.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Keys per bucket before it splits, buckets that evenly dealt keys need at most (beyond, more keys fit into one, so that
#: the directory stays a few MB and is broadcast), and bits that one level of the directory adds at most.
CAPACITY, BUCKETS, LEVEL = 256, 1 << 17, 12
#: Rows of one key, and bytes of texts, that its owner takes as they are.
ROWS, BYTES = 256, 8 << 20


def prefix_of(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def level_bits(most: int, capacity: int, used: int) -> int:
    """How many bits a level adds for slots of up to ``most`` keys: two more than evenly dealt keys need."""
    need = max(0, -(-most // capacity) - 1).bit_length()
    return min(LEVEL, need + 2, 64 - used) if need else 0


def grow(keys: DataFrame, total: int, capacity: int) -> list[tuple[int, DataFrame]]:
    """Levels of the directory for distinct ``keys`` (key): (bits, slots); slots are (slot, bits).

    ``slot`` has the first bits of a key; its own ``bits`` are those its bucket
    goes by, null where the next level has to tell.
    """
    levels: list[tuple[int, DataFrame]] = []
    low, most = 0, total
    while most:
        high = low + level_bits(most, capacity, low)
        slots = keys.groupBy(prefix_of(F.col("key"), high).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        above = slots.select("slot", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {high} - depth)"))
        sums = above.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
        fits = above.join(sums, ["depth", "prefix"]).groupBy("slot").agg(F.min(F.when(F.col("held") <= capacity, F.col("depth"))).alias("bits"), F.first("n").alias("n"))
        fits = common.staged(fits, "directory")
        levels.append((high, fits.select("slot", "bits")))
        full = fits.where("bits is null")
        most = full.agg(F.max("n")).first()[0] or 0
        if most:
            keys = keys.join(full.select("slot"), prefix_of(F.col("key"), high) == F.col("slot"), "left_semi")
            low = high
    return levels


def routed(rows: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` (key, ...) with their bucket (its first key) and local_depth, looked up in the directory."""
    bits = []
    for k, (high, slots) in enumerate(levels):
        rows = rows.withColumn(f"__slot{k}", prefix_of(F.col("key"), high)).join(common.sized(slots.toDF(f"__slot{k}", f"__bits{k}")), f"__slot{k}", "left")
        bits.append(F.col(f"__bits{k}"))
    rows = rows.withColumn("local_depth", F.coalesce(*bits, F.lit(0)))
    shift = F.lit(64) - F.col("local_depth")
    first = F.when(F.col("local_depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", "key", shift), shift))
    return rows.withColumn("bucket", first).drop(*(f"__{x}{k}" for k in range(len(levels)) for x in ("slot", "bits")))


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_of: Callable[[Column], Column]) -> DataFrame:
    norm = common.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("key", key_of(F.col("norm")))


def _chained() -> Column:
    """The place of a text in its key's chain."""
    return F.dense_rank().over(Window.partitionBy("bucket", "key").orderBy("norm")) - 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_of: Callable[[Column], Column] = F.xxhash64, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """The index, a row per document: bucket, local_depth, key, chain, doc_id, n_bytes, text_sha256, keep_id, group_size."""
    keyed = _keyed(docs, id_col, text_col, key_of)
    keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("norm")).alias("width"))
    keys = common.staged(keys, "keys")
    total = keys.count()
    levels = grow(keys.select("key"), total, max(capacity, -(-total // BUCKETS)))
    crowded = common.staged(keys.where((F.col("n") > rows) | ((F.col("n") > 1) & (F.col("n") * F.col("width") > size))).select("key", F.lit(True).alias("crowded")), "crowded-keys")
    each = keyed.join(common.sized(crowded), "key", "left")
    own = Window.partitionBy("bucket", "key", "norm")
    names = ["bucket", "local_depth", "key", "chain", "doc_id", F.octet_length("norm").alias("n_bytes"), F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"]
    # every bucket has one owner; the rows of a key stand in it ordered by their bytes
    owned = routed(each.where("crowded is null"), levels).repartition("bucket")
    owned = owned.withColumn("chain", _chained()).withColumns({"keep_id": F.max("doc_id").over(own), "group_size": F.count(F.lit(1)).over(own)})
    owned = owned.select(*names)
    if not crowded.isEmpty():
        many = routed(each.where("crowded"), levels)
        chains = many.groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        chains = common.staged(chains.withColumn("chain", _chained()), "crowded-chains")
        owned = owned.union(many.drop("crowded").join(common.sized(chains), ["bucket", "key", "norm"]).select(*names))
    return common.staged(owned, "extendible-index")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; options as of ``build_index``.

    Equal texts are those identical after lower-casing A-Z; null counts as
    empty. The row with the largest id of its group stays. Rows that repeat
    that id all stay; a null id stays only in a group without any other id.
    Other columns of ``docs`` are not read.
    """
    index = build_index(docs, id_col, text_col, **options)
    return index.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mark`` keeps, with all their columns. Null and repeated ids are told apart by text."""
    gone = mark(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__text"))
    norm = common.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    named = docs.withColumn("__sha256", F.sha2(norm, 256))
    return named.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")) & (F.col("__sha256") == F.col("__text")), "left_anti").drop("__sha256")


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
