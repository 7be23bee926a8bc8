import os
import re
import sys
from collections import namedtuple

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
Doc = namedtuple("Doc", "doc_id text lang source n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TR))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TR))


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(*rows, extra=()):
        """documents of (doc_id, text, ...); extra: names of more columns that hold 1."""
        full = [Doc(*r, *(None,) * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        for name in extra:
            df = df.withColumn(name, F.lit(1))
        return df

    return make


LONG = " ".join(f"w{i}x{i * 7 % 13}" for i in range(20_000))
#: Nulls, empty and long texts, ties and repeated rows.
ODD = [(1, None, None, None), (None, "a text without an id", "en", "s"), (2, "", "en", ""), (3, "12 34 !!", None, "s"), (4, LONG, "en", "s"), (5, "same text here", "en", "s"), (5, "same text here", "en", "s"), (6, "same text here", "de", None), (7, "é" * 50, "fr", "t")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(*ODD, extra=("key", "row", "size", "TEXT_", "items", "window", "uid", "n_words"))


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of()
