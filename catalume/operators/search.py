"""Substring search over an inverted index of trigrams, for texts that are searched more often than they change.

The index is a folder of three Parquet tables: ``postings`` (gram, key), one row for each distinct trigram of a normalised text, in folders by
bucket of the gram; ``grams`` (gram, n), how many texts hold each; ``texts`` (key, normal), in folders by lot of the key. A fourth, ``key``, has no rows and tells the key's type. Texts end in two
marks, so that words of one or two letters are found as the beginnings of trigrams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.functions.text import normalize_title

END = "\x00\x00"


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text with its end marks, found in one pass, so long texts cost their length."""
    return F.array_distinct(F.regexp_extract_all(F.concat(text, F.lit(END)), F.lit("(?s)(?=([^\\x{dc00}-\\x{dfff}]..))"), F.lit(1)))  # never from the second half of a pair


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of an index; an empty one has no files, so no schema is read from them."""
    kind = spark.read.parquet(f"{path}/key").schema["key"].dataType.simpleString()
    shapes = {"texts": f"key {kind}, normal string, lot int", "postings": f"gram string, key {kind}, lot int, bucket int", "grams": "gram string, n bigint, bucket int"}
    return spark.read.schema(shapes[name]).parquet(f"{path}/{name}")


def build_index(texts: DataFrame, key: str, text: str, path: str, buckets: int = 64) -> None:
    """Writes the index of ``texts`` (one row a key; null texts are found by nothing) to ``path``.

    A gram that every text holds is spread over the lots of the keys, so no task writes all of its rows.
    """
    lot = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    whole = texts.where(F.col(text).isNotNull())  # a test of the normalised text would normalise it twice
    rows = whole.select(F.col(key).alias("key"), normalize_title(F.col(text)).alias("normal")).withColumn("lot", lot)
    spark = texts.sparkSession
    rows.select("key").limit(0).write.parquet(f"{path}/key")
    rows.repartition("lot").write.partitionBy("lot").parquet(f"{path}/texts")
    each = _table(spark, path, "texts").select("key", "lot", F.explode(_grams(F.col("normal"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    each.repartition("bucket", "lot").sortWithinPartitions("bucket", "gram").select("gram", "key", "lot", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = _table(spark, path, "postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counted.write.partitionBy("bucket").parquet(f"{path}/grams")


def search(spark: SparkSession, path: str, words: str, buckets: int = 64, rare: int = 100_000) -> DataFrame:
    """key of the texts of an index that hold ``words``, both normalised. Words without a letter or digit are refused.

    Only the buckets of the words' trigrams are read. Postings are cut to the keys of the rarest trigram, which is broadcast if the index
    counts at most ``rare`` of them and joined by a shuffle otherwise; keys that hold all trigrams are checked against their text last.
    """
    asked = spark.range(1).select(normalize_title(F.lit(words)).alias("w"))
    text = asked.first().w  # the words themselves
    if not text:
        raise ValueError("nothing to search for")
    whole, postings, numbers = (_table(spark, path, name) for name in ("texts", "postings", "grams"))
    if len(text) < 3:
        return postings.where(F.col("gram").startswith(text)).select("key").distinct()
    grams = list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))  # as many as the words have letters
    places = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), buckets)).distinct().collect()]
    read = lambda table: table.where(F.col("bucket").isin(places) & F.col("gram").isin(grams))
    counts = {r.gram: r.n for r in read(numbers).collect()}
    if len(counts) < len(grams):
        return whole.select("key").limit(0)
    rarest = min(grams, key=lambda g: (counts[g], g))
    first = read(postings).where(F.col("gram") == rarest).select("key", "lot")
    rest = read(postings).where(F.col("gram") != rarest).select("key", "gram")
    near = rest.join(F.broadcast(first) if counts[rarest] <= rare else first, "key")
    if len(grams) > 1:
        first = near.groupBy("key", "lot").agg(F.count("*").alias("n")).where(F.col("n") == len(grams) - 1).drop("n")
    return whole.join(first, ["lot", "key"], "left_semi").where(F.col("normal").contains(text)).select("key")
