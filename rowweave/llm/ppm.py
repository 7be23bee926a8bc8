"""Scoring documents by prediction by partial matching.

The model is a trie of byte contexts, learnt from all training texts: each task counts its n-grams of ORDER + 1 bytes and
Spark sums them. Every context that was seen is kept, so the model grows with the corpus. A byte is coded in the longest
context that the trie has; a byte not seen there costs an escape, which counts once for each distinct byte that was, and in
the shorter context the bytes of the longer one are excluded. As the bytes seen in a context are among those seen in any
shorter one, what an escape excludes depends on one context only, and is worked out once for each.

The score of an n-gram depends on it alone. Those of the most frequent n-grams are broadcast; the others of a text are
joined with the trie, which is dealt out by the last SUFFIX bytes of the context: each task has all longer contexts
with its endings, and the contexts shorter than that (65 792 entries at most) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

ORDER = 5
#: n-grams whose scores are broadcast: at most so many of the most frequent.
HOT_GRAMS = 1 << 20
#: The trie is dealt out by so many bytes before the last one, in parts of about so many n-grams.
SUFFIX = 2
PART_GRAMS = 1 << 17
#: Tokens whose counts are broadcast: those with more than one HOT_TOKENS-th of all tokens, so fewer than HOT_TOKENS.
HOT_TOKENS = 1 << 19
END = 0xFF  # never a byte of UTF-8
U64 = np.uint64


def gram_keys(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end, that byte and the order before it (zeros before a text) as one number."""
    sizes = np.diff(offsets) + 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    padded = np.zeros(int(at[-1]) + order * len(sizes), np.uint8)
    start = at[:-1] + order * np.arange(1, len(sizes) + 1)
    shift = np.repeat(start - at[:-1], sizes)
    place = np.arange(at[-1]) + shift
    symbols = np.full(int(at[-1]), END, np.uint8)
    inner = np.ones(int(at[-1]), bool)
    inner[at[1:] - 1] = False
    symbols[inner] = data
    padded[place] = symbols
    rolled = np.zeros(len(padded), U64)
    for j in range(order + 1):
        rolled[j:] |= padded[: len(padded) - j].astype(U64) << U64(8 * j)
    return rolled[place], at


GRAM, TOKEN = 0, 1


def gather(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """kind (GRAM or TOKEN), key, n: how often each n-gram and each token (by its 64-bit hash) is in all texts of docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {GRAM: _Counts(), TOKEN: _Counts()}
        for batch in batches:
            for _, _, data, offsets in arrays.blocks(batch.column(0)):
                kept[GRAM].add(gram_keys(data, offsets, order)[0])
                kept[TOKEN].add(arrays.word_hashes(data, offsets, arrays.IN_TOKEN)[0])
            for kind, counts in kept.items():
                if counts.large():
                    yield from counts.out(kind)
        for kind, counts in kept.items():
            yield from counts.out(kind)

    return common.pick(docs, "text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class _Counts:
    """How often keys came: sorted runs that are merged when they have grown."""

    def __init__(self):
        self.keys, self.n = [np.empty(0, U64)], [np.empty(0, np.int64)]

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.n.append(n)
        if sum(map(len, self.keys)) > max(1 << 20, 3 * len(self.keys[0])):
            self.merge()

    def merge(self) -> None:
        k, n = np.concatenate(self.keys), np.concatenate(self.n)
        by = np.argsort(k, kind="stable")
        k, n = k[by], n[by]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
        self.keys, self.n = [k[first]], [np.add.reduceat(n, first) if len(first) else n]

    def large(self) -> bool:
        return len(self.keys[0]) > 1 << 21

    def out(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        (k,), (n,) = self.keys, self.n
        for i in range(0, len(k), 1 << 18):
            j = min(len(k), i + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, kind, np.int32)), pa.array(k[i:j].view(np.int64)), pa.array(n[i:j])], ["kind", "key", "n"])
        self.__init__()


class Trie:
    """entries: for each order 0 to the highest, (keys, counts): a context and a byte as one number, and how often; total: how
    many bytes and ends there were."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]], total: int):
        self.order = len(entries) - 1
        self.entries, self.contexts = [], []
        parent = None
        for k, (keys, counts) in enumerate(entries):
            by = np.argsort(keys)
            keys, counts = keys[by].astype(U64), counts[by].astype(np.float64)
            contexts, of = np.unique(keys >> U64(8), return_inverse=True)
            kept, distinct = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(np.float64)
            # how often a context came at all: as the entry of the order below that ends with its last byte
            came = np.full(len(contexts), float(total))
            if parent is not None:
                place = parent[0].find(contexts)
                came = np.where(place >= 0, parent[1][place] if len(parent[1]) else 0.0, kept)
            gone = np.maximum(came - kept, 0) + distinct  # the weight of an escape
            entry, context = arrays.Lookup(keys), arrays.Lookup(contexts)
            first = np.log10(counts / (kept + gone)[of]) if len(keys) else np.empty(0)
            escape = np.log10(gone / (kept + gone))
            # what is left of the shorter context after the bytes of this one are excluded: of all it has, and of its escape
            if parent is None:
                room, rest = np.zeros(len(contexts)), 256 - distinct
            else:
                p_entry, p_counts, p_context, p_kept, p_gone, p_order = parent
                mask = U64((1 << 8 * (p_order + 1)) - 1)
                excluded = np.bincount(of, p_counts[p_entry.find(keys & mask)], len(contexts)) if len(keys) else np.zeros(0)
                shorter = p_context.find(contexts & U64((1 << 8 * p_order) - 1))
                rest = p_gone[shorter] - distinct
                room = p_kept[shorter] - excluded + rest
            self.entries.append((entry, counts, first))
            self.contexts.append((context, escape, room, rest))
            parent = (entry, counts, context, kept, gone, k)

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each gram (keys of ORDER + 1 bytes) after the others."""
        out = np.zeros(len(grams))
        left, keys = np.arange(len(grams)), grams
        begun = room = rest = None
        for k in range(self.order, -1, -1):
            entry, counts, first = self.entries[k]
            own = keys & U64((1 << 8 * (k + 1)) - 1)
            at = entry.find(own)
            hit = at >= 0
            if begun is None:
                out[left[hit]] = first[at[hit]]
                left, keys, own = left[~hit], keys[~hit], own[~hit]
                begun, room, rest = np.zeros(len(left), bool), np.zeros(len(left)), np.zeros(len(left))
            else:
                fresh, later = hit & ~begun, hit & begun
                out[left[fresh]] = first[at[fresh]]
                out[left[later]] += np.log10(counts[at[later]] / room[later])
                on = ~hit
                left, keys, own, begun, room, rest = left[on], keys[on], own[on], begun[on], room[on], rest[on]
                # not in this context either: the escape, if there is a byte to be coded besides those excluded
                paid = begun & (room > 0)
                out[left[paid]] += np.log10(rest[paid] / room[paid])
            context, escape, c_room, c_rest = self.contexts[k]
            at = context.find(own >> U64(8))
            there = at >= 0
            fresh = there & ~begun
            out[left[fresh]] += escape[at[fresh]]
            begun = begun | there
            room, rest = np.where(there, c_room[at] if len(c_room) else 0.0, room), np.where(there, c_rest[at] if len(c_rest) else 0.0, rest)
        out[left] += np.where(begun, -np.log10(np.maximum(np.where(begun, rest, 256), 1)), -np.log10(256))
        return out


def entries(gram: np.ndarray, n: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct entries of each of these orders, and how often each is in so many of these grams."""
    out = []
    for k in orders:
        keys, of = np.unique(gram & U64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        out.append((keys, np.bincount(of, n, len(keys))))
    return out


def fit(counts: DataFrame, order: int = ORDER, most: int | None = None) -> Trie:
    """The trie of what gather() counted in one piece, for small collections; with most, of entries that hold at least a
    most-th of all bytes. Without any text, all bytes are equally likely."""
    got = counts.where(F.col("kind") == GRAM).select("key", "n").toArrow()
    gram, n = got["key"].to_numpy().view(U64), got["n"].to_numpy()
    total = int(n.sum())
    found = entries(gram, n, range(order + 1))
    if most is not None:
        found = [(k[c * most >= total], c[c * most >= total]) for k, c in found]
    return Trie(found, total)


class Grams:
    """The model: counts of n-grams, which stay in Spark. The scores of frequent ones are in a table that every task has."""

    def __init__(self, counts: DataFrame, order: int = ORDER, hot: int = HOT_GRAMS):
        self.order = order
        self.counts = counts.where(F.col("kind") == GRAM).select(F.col("key").alias("gram"), "n")
        size = F.floor(4 * F.log2("n")).cast("int")
        sizes = self.counts.groupBy(size.alias("size")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("grams")).collect()
        self.total, self.distinct = sum(r.n for r in sizes), sum(r.grams for r in sizes)
        least, n = 0, 0
        for r in sorted(sizes, key=lambda r: -r.size):
            n += r.grams
            if n > hot:
                least = r.size + 1
                break
        context = F.shiftright("gram", 8).alias("context")
        contexts = self.counts.groupBy(context).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("escapes"))
        found = self.counts.where(size >= least).select("gram", context, "n").hint("shuffle_merge").join(contexts, "context")
        got = found.select("gram", F.log10(F.col("n") / (F.col("all") + F.col("escapes"))).alias("log")).toArrow()
        self.hot, self.hot_logs = arrays.Lookup(got["gram"].to_numpy().view(U64)), got["log"].to_numpy()

    def rare_scores(self, rare: DataFrame) -> DataFrame:
        """key, score: the sums of the scores of all n times gram of rare (key, gram, n: int); a key may have several rows."""
        spark, order = rare.sparkSession, self.order
        short = F.col("gram").bitwiseAND((1 << 8 * SUFFIX) - 1)
        got = self.counts.groupBy(short.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
        low = entries(got["gram"].to_numpy().view(U64), got["n"].to_numpy(), range(min(SUFFIX, order + 1)))
        shared = spark.sparkContext.broadcast((low, self.total))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.distinct // PART_GRAMS)
        model = self.counts.select(F.lit(None).cast("long").alias("key"), "gram", "n")
        both = model.unionByName(rare.select("key", "gram", F.col("n").cast("long").alias("n")))
        suffix = F.shiftright("gram", 8).bitwiseAND((1 << 8 * SUFFIX) - 1)
        both = both.repartition(parts, suffix).sortWithinPartitions(F.col("key").isNotNull())  # the model before what is asked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, total = shared.value
            grams, ns, trie = [np.empty(0, U64)], [np.empty(0, np.int64)], None
            for batch in batches:
                given = batch.column(0).null_count
                gram, n = (batch.column(c).to_numpy().astype(t) for c, t in ((1, U64), (2, np.int64)))
                grams.append(gram[:given])
                ns.append(n[:given])
                if given == batch.num_rows:
                    continue
                if trie is None:
                    trie = Trie(low + entries(np.concatenate(grams), np.concatenate(ns), range(len(low), order + 1)), total)
                    grams, ns = [], []
                keys, of = np.unique(batch.column(0)[given:].to_numpy(), return_inverse=True)
                sums = np.bincount(of, trie.scores(gram[given:]) * n[given:], len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["key", "score"])

        return both.select("key", "gram", "n").mapInArrow(run, "key long, score double").groupBy("key").agg(F.sum("score").alias("score"))


class Unigrams:
    """The base model: counts of tokens. Frequent ones are in a table that every task has; of the others the counts stay in
    Spark."""

    def __init__(self, counts: DataFrame, ends: int, hot: int = HOT_TOKENS):
        self.counts = counts.where(F.col("kind") == TOKEN).select(F.col("key").alias("token"), F.col("n").alias("c"))
        words, distinct = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.n, self.v, self.ends = words + ends, distinct + (ends > 0), ends
        got = self.counts.where(F.col("c") * hot > self.n).toArrow()
        self.hot = arrays.Lookup(got["token"].to_numpy().view(U64))
        self.hot_logs = self.log(got["c"].to_numpy())

    def log(self, c):
        """log10 of the smoothed share of a token that came c times; c is a number, an array or a column."""
        share = (c + 0.5) / (self.n + 0.5 * (self.v + 1))
        return np.log10(share) if not isinstance(share, Column) else F.log10(share)


def score(docs: DataFrame, grams: Grams, unigrams: Unigrams, *keep: str) -> DataFrame:
    """keep; known_score: log10 of the probability of the frequent n-grams of each whole text (null: empty) and its end;
    n_tokens, and of its end and frequent tokens n_known and base_score."""
    shared = docs.sparkSession.sparkContext.broadcast((grams.hot, grams.hot_logs, unigrams.hot, unigrams.hot_logs, float(unigrams.log(unigrams.ends)), int(unigrams.ends > 0)))
    docs = common.pick(docs, *dict.fromkeys((*keep, "text")))
    text_at, order = docs.columns.index("text"), grams.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_grams, gram_logs, hot, logs, end_log, end_known = shared.value
        for batch in batches:
            found, tokens, known, base = [np.empty(0)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for _, _, data, offsets in arrays.blocks(batch.column(text_at), arrays.BLOCK >> 1):
                keys, at = gram_keys(data, offsets, order)
                place = hot_grams.find(keys)
                found.append(arrays.summed(np.where(place >= 0, gram_logs[place] if len(gram_logs) else 0.0, 0.0), at))
                words, at = arrays.word_hashes(data, offsets, arrays.IN_TOKEN)
                place = hot.find(words)
                tokens.append(np.diff(at) + 1)
                known.append(arrays.summed((place >= 0).astype(np.int64), at) + end_known)
                base.append(arrays.summed(np.where(place >= 0, logs[place] if len(logs) else 0.0, 0.0), at) + end_log)
            out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(np.concatenate(x)) for x in (found, tokens, known, base))], [*keep, "known_score", "n_tokens", "n_known", "base_score"])

    return docs.mapInArrow(run, docs.select(*keep).schema.add("known_score", "double").add("n_tokens", "long").add("n_known", "long").add("base_score", "double"))


def _rare(docs: DataFrame, hot: arrays.Lookup, name: str, keys_of) -> DataFrame:
    """key, name, n: how often the keys (of the bytes and offsets of texts) that aren't in hot are in the texts of docs (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            for i, j, data, offsets in arrays.blocks(batch.column(0), arrays.BLOCK >> 1):
                words, at = keys_of(data, offsets)
                rare = np.flatnonzero(hot.find(words) < 0)
                of, words = np.repeat(np.arange(i, j), np.diff(at))[rare], words[rare]
                if len(words):
                    by = np.lexsort((words, of))
                    of, words = of[by], words[by]
                    first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (of[1:] != of[:-1]))))
                    n = np.diff(np.append(first, len(words)))
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(of[first])), pa.array(words[first].view(np.int64)), pa.array(n.astype(np.int32))], ["key", name, "n"])

    return docs.select("text", "key").mapInArrow(run, f"key long, {name} long, n int")


def rare_tokens(docs: DataFrame, unigrams: Unigrams) -> DataFrame:
    """key, token, n: how often the tokens that aren't frequent are in the texts of docs (key, text)."""
    return _rare(docs, unigrams.hot, "token", lambda data, offsets: arrays.word_hashes(data, offsets, arrays.IN_TOKEN))


def rare_grams(docs: DataFrame, grams: Grams) -> DataFrame:
    """key, gram, n: how often the n-grams that aren't frequent are in the texts of docs (key, text)."""
    order = grams.order
    return _rare(docs, grams.hot, "gram", lambda data, offsets: gram_keys(data, offsets, order))


def scored(docs: DataFrame, train: DataFrame, *keep: str, hot: int = HOT_GRAMS) -> DataFrame:
    """keep, score, n_tokens, n_known, train_tokens and base_score of docs (keep, text), by models of train (text).

    Tokens are told apart by 64-bit hashes. Rows of one text share their scores; null is an empty text.
    """
    counts = common.store(gather(train), "counts")
    grams, unigrams = Grams(counts, hot=hot), Unigrams(counts, train.count())
    docs = common.pick(docs, *dict.fromkeys((*keep, "text")))
    docs = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rare = rare_tokens(docs, unigrams).join(unigrams.counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.select("key", F.when(c > 0, F.col("n")).otherwise(0).cast("long").alias("known"), (F.col("n") * unigrams.log(c)).alias("base"), F.lit(0.0).alias("more"))
    rare = rare.unionByName(grams.rare_scores(rare_grams(docs, grams)).select("key", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.col("score").alias("more")))
    rare = rare.groupBy("key").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("more").alias("more"))
    rows = score(docs, grams, unigrams, *keep, "key")
    copies = docs.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))  # what is rare in all rows of a text came together
    rare = rare.join(copies, "key").select("key", (F.col("known") / F.col("copies")).cast("long").alias("known"), *((F.col(c) / F.col("copies")).alias(c) for c in ("base", "more")))
    rows = rows.join(rare, "key", "left")
    known, base = F.col("n_known") + F.coalesce("known", F.lit(0)), F.col("base_score") + F.coalesce("base", F.lit(0.0))
    whole = F.col("known_score") + F.coalesce("more", F.lit(0.0))
    return rows.select(*keep, whole.alias("score"), "n_tokens", known.alias("n_known"), F.lit(unigrams.n).cast("long").alias("train_tokens"), base.alias("base_score"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its log10 probabilities by the byte contexts and by the tokens of the training fold. Null and empty
    texts are one end each; a null id is in the training fold; repeated rows and rows of one text have the same scores."""
    docs = common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    fold = common.bucket_of(F.col("doc_id"))
    out = scored(docs, docs.where(F.coalesce(fold != 1, F.lit(True))), "doc_id")
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
