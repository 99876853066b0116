"""Token counts with a digest cache.

The cache is a Parquet table (content_digest, version_digest, n_tokens).  A document's key is
the SHA-256 of its content after a normalisation the tokenizer cannot see (runs of ASCII white
space become one space, ends are trimmed), with the digest of the tokenizer's file, its
library's version and the normalisation.  Documents are joined with the cache on both digests;
of what it lacks each distinct content is encoded once, and the new counts are appended.

Only the distinct misses are shuffled with their text, copies being folded before the shuffle;
all else moves digests and numbers.  The lookup key of a much copied text may hold a third of
the rows: these are narrow, and the join is a plain one that adaptive execution can split.

Cases: a null text counts as the empty one (0 bytes, 0 tokens); texts are never cut; repeated
rows give a row each; a cache row written twice (two runs at once) counts once.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from ..session import materialise, shared_dir
from .common import MEMO_CHARS, MEMO_ROWS, groups, map_rows, whole_text

CACHE_SCHEMA = "content_digest string, version_digest string, n_tokens long"
OVER_LIMIT = 2048
SPACES = re.compile("[ \t\n\r\f\v]+")


class WordCounter:
    """Counts for a tokenizer that drops white space and never joins over it."""

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}

    def count_many(self, texts: list[str]) -> list[int]:
        out = []
        for start, stop in groups(texts):
            cut = [[w for w in SPACES.split(t) if w] for t in texts[start:stop]]
            new = list(set().union(*cut).difference(self.memo))
            for at in range(0, len(new), 20_000):
                words = new[at : at + 20_000]
                made = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
                self.memo.update(zip(words, map(len, made)))
            out += [sum(map(self.memo.__getitem__, words)) for words in cut]
            if len(self.memo) > MEMO_ROWS:
                self.memo.clear()
            else:
                for w in new:
                    if len(w) > MEMO_CHARS:
                        del self.memo[w]
        return out


@lru_cache(maxsize=2)
def counter(tokenizer_file: str) -> WordCounter:
    return WordCounter(tokenizer_file)


def version_digest(tokenizer_file: str) -> str:
    with open(tokenizer_file, "rb") as file:
        body = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{body} tokenizers {tokenizers.__version__} ascii-spaces".encode()).hexdigest()


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; a folder that does not exist yet is an empty cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(
    docs: DataFrame, tokenizer_file: str, cache: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit, content_digest``; fills the table at ``cache``."""
    spark = docs.sparkSession
    version = version_digest(tokenizer_file)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("_text")).withColumn(
        "_content", normalised(F.col("_text"))
    )
    digest = F.sha2(F.col("_content").cast("binary"), 256).alias("content_digest")

    def stored() -> DataFrame:
        return (
            read_cache(spark, cache)
            .filter(F.col("version_digest") == version)
            .groupBy("content_digest")
            .agg(F.max("n_tokens").alias("n_tokens"))
        )

    def start():
        words = counter(tokenizer_file)

        def handle(batch):
            counts = pa.array(words.count_many(batch.column("_content").to_pylist()), pa.int64())
            return pa.record_batch([batch.column("content_digest"), counts], names=["content_digest", "n_tokens"])

        return handle

    contents = keyed.select(digest, "_content").groupBy("content_digest").agg(F.first("_content").alias("_content"))
    misses = contents.join(stored(), "content_digest", "left_anti").select("content_digest", "_content")
    new = map_rows(misses, start, "content_digest string, n_tokens long")
    new.select("content_digest", F.lit(version).alias("version_digest"), "n_tokens").write.mode("append").parquet(cache)

    rows = keyed.select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), digest)
    counts = materialise(stored(), "token-counts")  # a plain table, so that the join has two plain shuffles
    return rows.join(counts, "content_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER_LIMIT).alias("over_limit"), "content_digest"
    )


def default_cache(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}"
