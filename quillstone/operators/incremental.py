"""Content-addressed reuse of earlier results."""

from __future__ import annotations

from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from .joins import salted_join
from .ranking import ranked


def atoms_key(file_hash: Column, model: Column, version: Column, tier: Column) -> Column:
    return T.content_key(file_hash, model, version, tier)


def split_hits(files: DataFrame, cache: DataFrame, key: str, now: Column, ttl_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): cached within the time to live, and the rest to process."""
    live = cache.filter(F.unix_timestamp(now) - F.unix_timestamp("ts") <= ttl_days * 86400)
    return files.join(live.drop("ts"), key), files.join(live, key, "left_anti")


SET_BLOCK = 1024


def file_set_key(files: DataFrame, domain: str, file_hash: str, order: str, model: str, tier: str) -> DataFrame:
    """(domain, n, set_key): one key per exact set of files, whatever their order.

    The key is that of the domain, the sorted hashes, model and tier in a row, joined with ':'.
    Hashes are ranked and joined in blocks of ``SET_BLOCK``; the blocks of a domain then pass
    one after the other through its digest, so no row or task holds more than a block.
    ``order`` tells equal hashes apart; repeated files count, null hashes are left out of the key.
    """
    items = files.select(domain, F.col(file_hash).alias("item"), F.col(order).alias("_o"))
    placed = ranked(items, [F.col("item"), F.col("_o")], "pos", [domain])
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    blocks = placed.groupBy(domain, F.floor((F.col("pos") - 1) / SET_BLOCK).alias("block")).agg(
        F.count("*").alias("n"), F.count("item").alias("held"), F.array_join(in_order, ":").alias("items"))
    columns = (domain, "n", "held", "items")
    kind = files.select(domain).schema[0].dataType
    types = pa.schema([(domain, to_arrow_type(kind)), ("n", pa.int64()), ("set_key", pa.string())])

    def run(batches):
        every = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
        for name, rows in groupby(every, key=lambda row: row[0]):
            digest, total, between = sha256(), 0, b""
            if name is not None:
                digest.update(str(name).encode())
                between = b":"
            for _, n, held, text in rows:
                total += n
                if held:
                    digest.update(between + text.encode())
                    between = b":"
            digest.update(between + f"{model}:{tier}".encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((name, total, digest.hexdigest()[:16]), types.types)], schema=types)

    dealt = blocks.repartition(domain).sortWithinPartitions(domain, "block")
    return dealt.select(*columns).mapInArrow(run, f"{domain} {kind.simpleString()}, n long, set_key string")


# --- vectors -------------------------------------------------------------------------------------

VECTORS = "key string, text_hash string, model string, vector array<double>, ts timestamp"


def vector_key(text_hash: Column, model: Column) -> Column:
    return T.content_key(text_hash, model)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The stored vectors; of a key written twice the latest row counts.  No folder yet is no vectors."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], VECTORS)
    stored = spark.read.schema(VECTORS).parquet(path)
    return stored.groupBy("key").agg(F.max_by(F.struct("text_hash", "model", "vector", "ts"), "ts").alias("v")).select("key", "v.*")


def split_vectors(texts: DataFrame, text: str, model: str, stored: DataFrame, now: Column, ttl_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of texts under a model.

    Hits are the rows of ``texts`` with ``key`` and ``vector``.  Misses are the different texts
    that no live row has, one row each (``key, text_hash`` and the text), however many copies
    ask; only they move with their text.  A null text is the empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = T.content_key(whole)
    keyed = texts.withColumn("key", vector_key(hashed, F.lit(model)))
    live = stored.filter((F.col("model") == model) & (F.unix_timestamp(now) - F.unix_timestamp("ts") <= ttl_days * 86400)).select("key", "vector")
    others = [c for c in texts.columns if c != text]
    # a much copied text is one key of the cache
    hits = salted_join(keyed.select(*others, "key"), live, ["key"], F.monotonically_increasing_id())
    different = keyed.groupBy("key").agg(F.first(hashed).alias("text_hash"), F.first(whole).alias(text))
    return hits, different.join(live.select("key"), "key", "left_anti")


def append_vectors(made: DataFrame, model: str, path: str, now: Column) -> None:
    """Add the vectors of misses (``key, text_hash, vector``) to the cache."""
    made.select("key", "text_hash", F.lit(model).alias("model"), F.col("vector").cast("array<double>").alias("vector"), now.cast("timestamp").alias("ts")).write.mode("append").parquet(path)
