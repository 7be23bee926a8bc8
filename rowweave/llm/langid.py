"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of letters per language in one pass over all labelled texts (sparse counts per task,
summed by Spark); the log-probability matrix (languages x buckets, its size bounded by MAX_LANGS) is broadcast, and batches
are scored as sparse sums of its rows in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

BITS = 16
ORDERS = (1, 2, 3)
#: Labels a model may tell apart: the broadcast matrix is at most MAX_LANGS * 2**BITS * 4 bytes.
MAX_LANGS = 128
#: Bytes of text that are scored at once.
BLOCK = 1 << 17
#: Languages whose counts a task holds at once (1.5 MB each).
HELD = 16
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, the lower-case letter that it stands for, or a space."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the buckets of all n-grams, the texts' offsets among them, and which texts have a letter.

    Anything but letters is a space; runs of it count once, and each text has one at either end.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    seen = np.insert(letters()[points], at, 32)  # a space before each text and after the last
    at = at + np.arange(len(at))
    keep = np.ones(len(seen), bool)
    keep[1:] = (seen[1:] != 32) | (seen[:-1] != 32)
    keep[at] = True
    seen, at = seen[keep], np.concatenate(([0], np.cumsum(keep)))[at]
    any_letter = arrays.summed((seen[:-1] != 32).astype(np.int64), at) > 0
    count, seen = int(at[-1]), np.append(seen, np.full(max(ORDERS), 32, np.uint32))
    found = []
    for n in ORDERS:
        h = np.zeros(count, np.uint32)
        for j in range(n):
            h += seen[j : j + count] * _FACTORS[j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D + 2 * n)
        for j in range(2, n):  # these would reach into the next text; every text has one letter or its space at least
            h[np.maximum(at[1:] - j + 1, at[:-1])] = 0
        found.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    return found, at, any_letter


def train(docs: DataFrame, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (sorted), log prior and log-probability matrix [language, order and bucket] from docs (text, lang).

    Rows without text or lang teach nothing. Without any row the model knows no language.
    """
    docs = common.pick(docs, "text", "lang").where("text is not null and lang is not null")
    width = len(ORDERS) << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own = np.concatenate((own, [texts[lang]]))
                there = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int64()), pa.array(own[there], pa.int64())], ["lang", "at", "n"])
            counts.clear()
            texts.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                if lang not in counts and len(counts) == HELD:
                    yield from out()
                rows = np.flatnonzero(langs == lang)
                texts[lang] = texts.get(lang, 0) + len(rows)
                own = counts.setdefault(lang, np.zeros(width, np.int64))
                for _, _, data, offsets in arrays.blocks(batch.column(0).take(pa.array(rows)), BLOCK):
                    for k, h in enumerate(grams(data, offsets)[0]):
                        own[k << BITS : (k + 1) << BITS] += np.bincount(h, minlength=1 << BITS)
        yield from out()

    langs = [r[0] for r in docs.select("lang").distinct().orderBy("lang").limit(max_langs + 1).collect()]
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    total = docs.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    code, at, n = np.searchsorted(langs, total["lang"].to_pylist()) if langs else np.empty(0, int), total["at"].to_numpy(), total["n"].to_numpy()
    by = np.argsort(code, kind="stable")
    at, n, ends = at[by], n[by], np.searchsorted(code[by], np.arange(len(langs) + 1))
    used = np.zeros(width + 1, bool)
    used[at] = True
    used = np.maximum(used[:-1].reshape(len(ORDERS), -1).sum(-1), 1)
    prior, logs = np.zeros(len(langs)), np.empty((len(langs), width), np.float32)
    for i in range(len(langs)):  # one row of the matrix at a time
        own = np.zeros(width + 1)
        own[at[ends[i] : ends[i + 1]]] = n[ends[i] : ends[i + 1]]
        prior[i], by_order = own[-1], own[:-1].reshape(len(ORDERS), -1)
        logs[i] = np.log((by_order + 0.5) / (by_order.sum(-1) + 0.5 * used)[:, None]).ravel()
    return langs, np.log(np.maximum(prior, 1) / max(prior.sum(), 1)), logs


def _scored(texts: pa.Array, model: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """The most likely language of each text, and its probability."""
    langs, prior, logs = model
    best, prob = [], []
    for first, end, data, offsets in arrays.blocks(texts, BLOCK):
        if not langs:
            best += ["und"] * (end - first)
            prob += [0.0] * (end - first)
            continue
        found, at, any_letter = grams(data, offsets)
        total = np.empty((len(langs), end - first))
        for i in range(len(langs)):
            total[i] = prior[i]
            for k, h in enumerate(found):
                total[i] += arrays.summed(logs[i, k << BITS : (k + 1) << BITS][h].astype(np.float64), at)
        top = total.argmax(0)
        p = 1 / np.exp(total - total.max(0)).sum(0)
        best += [langs[t] if ok else "und" for t, ok in zip(top, any_letter, strict=True)]
        prob += np.where(any_letter, p, 0.0).tolist()
    return pa.array(best, pa.string()), pa.array(prob, pa.float64())


def language(spark: SparkSession, text: Column, model: tuple[list[str], np.ndarray, np.ndarray]) -> Column:
    """lang_pred and score of a column of texts, as a struct: other columns stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(list(_scored(texts, shared.value)), ["lang_pred", "score"])

    return run(text)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], *keep: str) -> DataFrame:
    """keep, lang_pred (und for null and for texts without a letter) and score (its probability; 0 for und). Of languages that
    are equally likely the first by code point is taken."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = common.pick(docs, *keep, "text") if "text" not in keep else common.pick(docs, *keep)
    text_at = docs.columns.index("text")
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, prob = _scored(batch.column(text_at), shared.value)
            out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, best, prob], [*keep, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by a model of those outside the held-out fold. Null texts and texts without a letter are
    und; rows without text or lang teach nothing; repeated rows count each time; a null id isn't held out."""
    docs = common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = train(docs.where(common.bucket_of(F.col("doc_id")) != 0))
    out = predict(docs.select("doc_id", "text"), model, "doc_id")
    held = F.coalesce(common.bucket_of(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language is likely (under a half), go."""
    rows = common.plain(docs, "text", "lang")
    out = rows.withColumn("_found", language(docs.sparkSession, F.col("text"), train(rows)))
    return out.where("_found.lang_pred <> 'und' and _found.score >= 0.5").select(*rows.columns).toDF(*docs.columns)
