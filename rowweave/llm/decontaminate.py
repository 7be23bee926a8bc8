"""Benchmark decontamination: windows of benchmark words, looked up in a broadcast hash set while documents are scanned.

Only DataFrame functions. The windows of each length are two sets of bits that travel inside the plan: of hashes of three of a
window's words, which are looked up first, and of hashes of all its words. Each has BITS bits for each window and MAX_BITS at
most, and what they let through by chance (one in a thousand up to MAX_BITS / BITS windows, more beyond) is found out later. Documents are scanned in place and written with their
candidates; only the words of a candidate leave the row, to be compared with the windows themselves. The same way holds for
benchmarks and documents of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Bits of the set for each window, and at most: 16 MB.
BITS, MAX_BITS = 32, 1 << 27
#: Windows that may be broadcast when candidates are verified (some 100 bytes each).
BROADCAST_WINDOWS = 60_000


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """window (its words, joined by a space), len, items (ids of those that hold it, as strings; null ids not).

    An item of fewer words than width, but not none, is one window; null and empty items have none; repeated items count once.
    """
    items = common.pick(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), common.words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    each = items.withColumn("i", F.explode(starts)).select("item", "len", F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("window"))
    return each.groupBy("window", "len").agg(F.collect_set("item").alias("items"))


def _hashes(words: str, at: str, size: str) -> tuple[str, str]:
    """SQL: the hashes of three words (the first, the middle, the last) and of all words of the window that begins at (from 0)."""
    return f"xxhash64(get({words}, {at}), get({words}, {at} + {size} div 2), get({words}, {at} + {size} - 1))", f"xxhash64(slice({words}, {at} + 1, {size}))"


def bit_sets(found: DataFrame, most: int = MAX_BITS) -> dict[int, list[list[int]]]:
    """For each length of windows two sets of bits in numbers of 64: at most BITS bits a window, and most in all."""
    sizes = {r["len"]: r["n"] for r in found.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits = {size: min(most, 1 << max(6, (BITS * n - 1).bit_length())) for size, n in sizes.items()}
    if not bits:
        return {}
    mask = F.element_at(F.create_map(*(F.lit(x) for size, n in bits.items() for x in (size, n - 1))), F.col("len")).cast("long")
    hashed = found.select("len", F.split("window", " ").alias("w")).select("len", F.posexplode(F.array(*(F.expr(h) for h in _hashes("w", "0", "cast(len as int)")))).alias("set", "h"))
    places = hashed.select("len", "set", F.col("h").bitwiseAND(mask).alias("place"))
    one = F.expr("shiftleft(1L, cast(place & 63L as int))")
    numbers = places.groupBy("len", "set", F.shiftright("place", 6).cast("int").alias("at")).agg(F.bit_or(one).alias("bits")).collect()
    out = {size: [[0] * (n >> 6) for _ in range(2)] for size, n in bits.items()}
    for r in numbers:
        out[r["len"]][r["set"]][r["at"]] = r["bits"]
    return out


def _candidates(size: int, sets: list[list[int]]) -> Column:
    """The places of a document's words w where the bits of a window of that size are in the sets, with the window's words."""

    def passes(h: str, bits: list[int]) -> str:
        table, mask = f"cast(split('{','.join(map(str, bits))}', ',') as array<bigint>)", (len(bits) << 6) - 1
        return f"(shiftright(get({table}, cast(shiftright({h} & {mask}L, 6) as int)), cast({h} & 63L as int)) & 1L) = 1L"

    tests = " and ".join(passes(h, bits) for h, bits in zip(_hashes("w", "i", str(size)), sets, strict=True))
    return F.expr(
        f"case when size(w) >= {size} then transform(filter(sequence(0, size(w) - {size}), i -> {tests}),"
        f" i -> named_struct('p', i + 1, 'l', {size}, 't', array_join(slice(w, i + 1, {size}), ' '))) else array() end"
    )


def scan(docs: DataFrame, found: DataFrame, keep: tuple[str, ...] | None = None, most: int = MAX_BITS) -> DataFrame:
    """doc (the columns of docs in keep, or all, packed by common.packed), n_words, spans (verified hits: p from 1, l words), items (sorted ids), n_hit.

    found: what windows() gave. Null texts and texts without words have n_words 0 and no hit. Repeated rows stay rows of
    their own. Windows of fewer words than others (items that are short) are scanned for each length there is.
    """
    found = common.cut(found)
    n = found.count()
    none = F.expr("cast(array() as array<struct<p:int,l:int,t:string>>)")
    hits = [_candidates(size, sets) for size, sets in sorted(bit_sets(found, most).items())]
    docs = common.packed(docs, "text", keep=keep).select("doc", common.words(F.col("text")).alias("w"))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc", F.size("w").alias("n_words"), F.flatten(F.array(none, *hits)).alias("candidates"))
    docs = common.store(docs, "scanned")  # from here on rows keep their number
    clean = docs.where(F.size("candidates") == 0).select("doc", "n_words", F.expr("cast(array() as array<struct<p:int,l:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    each = docs.select("row", F.explode("candidates").alias("hit")).select("row", "hit.p", "hit.l", F.col("hit.t").alias("window"))
    texts = found.select("window", "items")
    each = each.join(F.broadcast(texts) if n <= BROADCAST_WINDOWS else texts, "window")
    each = each.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("p", "l"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    dirty = docs.where(F.size("candidates") > 0).select("row", "doc", "n_words").join(each, "row", "left")
    dirty = dirty.select("doc", "n_words", *(F.coalesce(dirty[c], F.array().cast(clean.schema[c].dataType)).alias(c) for c in ("spans", "items")))
    return clean.unionByName(dirty).withColumn("n_hit", F.size(_inside()))


def _inside() -> Column:
    """The places of words that are inside a hit."""
    return F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["p"], s["p"] + s["l"] - 1))))


def contaminated() -> Column:
    """Whether a twentieth or more of the words are inside a hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit").cast("long") >= F.col("n_words"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its words, those inside verified windows, and the items whose windows it has. Null, empty and
    very long texts and repeated rows and items are rows like any other; null item ids have windows, but aren't listed."""
    out = scan(common.table(spark, sf_dir, "documents"), windows(common.table(spark, sf_dir, "benchmark")), ("doc_id",))
    return out.select(
        F.col("doc._0").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the words of verified hits, and what stands before each of them, taken out of text; all else (case, signs,
    line breaks, other columns) stays as it is. Null texts stay null."""
    hits = scan(docs, found)
    pieces = F.regexp_extract_all("text", F.lit(f"(?:{common.BETWEEN_ANY_WORDS})?{common.ANY_WORD}"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(1), F.col("n_words")), _inside())
    rest = F.concat(F.array_join(F.transform(kept, lambda i: F.get(pieces, i - 1)), ""), F.regexp_extract("text", f"(?:{common.BETWEEN_ANY_WORDS})?$", 0))
    at = f"_{docs.columns.index('text')}"
    hits = hits.withColumn("text", F.col(f"doc.{at}"))
    cleaned = F.when(F.col("n_hit") > 0, rest).otherwise(F.col("text"))
    return common.unpacked(hits.select(F.col("doc").withField(at, cleaned).alias("doc")), docs.columns)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a whole window of WINDOW words, however long they are, or of which a twentieth or more of the words
    are inside shorter items; the others stay as they are. remove_spans() cuts the passages out instead."""
    out = scan(docs, windows(common.table(spark, sf_dir, "benchmark")))
    whole = F.exists("spans", lambda s: s["l"] >= WINDOW)
    return common.unpacked(out.where(~(whole | contaminated())), docs.columns)


ORACLE_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS t FROM bw),
lens AS (SELECT DISTINCT l FROM win),
dw AS (SELECT r, l, unnest(range(1, len(w) - l + 2)) AS i, w FROM d, lens WHERE len(w) >= l),
hit AS (SELECT r, i, dw.l AS l, item_id FROM dw JOIN win ON win.l = dw.l AND win.t = array_to_string(w[i:i + dw.l - 1], ' ')),
inside AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS x FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN inside USING (r) LEFT JOIN items USING (r)
"""
