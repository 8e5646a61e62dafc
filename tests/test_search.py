"""The trigram index against plain substring search, and what its plans read."""

from __future__ import annotations

import re
import tempfile
import unicodedata

import pytest

from catalume.operators import search

TEXTS = ["Tình yêu & Định mệnh", "", None, "...", "a", "ab", "abab ababab", "ab c ab", "x" * 50_000 + " needle", "needle" * 3, "yeu dinh", "Yêu-Định!"]


@pytest.fixture(scope="module")
def index(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-index-', dir='/tmp')}/index"
    search.build_index(spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string"), "k", "t", path, buckets=8)
    return path


def plain(text: str) -> str:
    """Folded lower-case words of letters and digits, one space between."""
    letters = "".join(c for c in unicodedata.normalize("NFKD", text.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c)).lower()
    return re.sub(r"[\W_]+", " ", letters).strip()


def test_search(spark, index):
    for words in ("yêu đinh", "ab", "A", "ab ab", "baba", "needle", "eedlen", "mệnh", "abc", "b c a", "xxxx needle", "n", "zq"):
        want = [i for i, t in enumerate(TEXTS) if t is not None and plain(words) in plain(t)]
        for rare in (100_000, 0):
            found = [r.key for r in search.search(spark, index, words, 8, rare).collect()]
            assert sorted(found) == want, words


def test_no_words(spark, index):
    with pytest.raises(ValueError):
        search.search(spark, index, " ?! ")


def test_only_buckets_of_the_words_are_read(spark, index):
    plan = search.search(spark, index, "needle", 8)._jdf.queryExecution().toString()
    reads = [line for line in plan.splitlines() if "FileScan" in line and "postings" in line]
    assert reads and all(re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|INSET|=)", r) for r in reads)
    assert all("gram" in re.search(r"PushedFilters: \[(.*?)\]", r)[1] for r in reads)


def test_empty_table(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-index-', dir='/tmp')}/index"
    search.build_index(spark.createDataFrame([], "k int, t string"), "k", "t", path)
    assert search.search(spark, path, "needle").count() == 0


def test_trigrams_without_lambdas_and_texts_normalised_once(spark, tmp_path):
    """Each character went through two lambdas, and each text was normalised for the test for null and again for its row."""
    from pyspark.sql import functions as F

    text = "a𝐀b𠀀𠀁 c\n" * 3  # letters beyond the basic plane are one character
    chars = [*text, *search.END]
    df = spark.createDataFrame([(text,), (None,), ("",), ("x",)], "t string")
    got = [r.g for r in df.select(search._grams(F.col("t")).alias("g")).collect()]
    assert got[0] == list(dict.fromkeys("".join(chars[i : i + 3]) for i in range(len(chars) - 2)))
    assert got[1] is None and got[2] == [] and got[3] == ["x" + search.END]
    plan = df.select(search._grams(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    search.build_index(df.selectExpr("t AS k", "t"), "k", "t", str(tmp_path / "index"), 2)
    assert spark.read.parquet(str(tmp_path / "index" / "texts")).count() == 3
