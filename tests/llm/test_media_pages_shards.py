"""Transport streams, HTML extraction, shards, mixing, the pipeline, SQL."""

import hashlib
import math
import time
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from conftest_words import tokens
from rowweave.llm import common, mixing, queries, shards, transport, webtext


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400) | st.integers(0, 40_000).map(lambda n: bytes(i * 7 % 251 for i in range(n))))
def test_mux_round_trip(payload):
    media = transport.mux(payload)
    out = transport.demux(media)
    assert out.payload == payload and not out.errors and not out.bad_counters and len(media) % 188 == 0 and all(media[i] == 0x47 for i in range(0, len(media), 188))
    n = -(-len(payload) // transport.ELEMENTARY)
    assert out.programs == {1: {transport.MEDIA_PID: transport.STREAM_TYPE}} and out.timestamps == [i * transport.TICKS for i in range(n)]
    assert out.random_access == [i * transport.ELEMENTARY for i in range(0, n, transport.RANDOM_ACCESS)]


def test_damaged_streams():
    media = transport.mux(bytes(range(256)) * 20)
    lost = media[: 188 * 5] + media[188 * 6 :]
    assert transport.demux(lost).bad_counters == 1 and transport.demux(lost).errors
    assert transport.demux(b"\x00" + media[1:]).errors and transport.demux(media[:-1]).errors
    flipped = bytearray(media)
    flipped[14] ^= 1
    assert "program table" in transport.demux(bytes(flipped)).errors[0]
    assert transport.demux(None).payload == b"" and transport.demux(b"").packets == 0
    assert transport.section_crc(transport._section(0, 1, b"abcd")) == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600))
def test_any_bytes_are_a_stream(raw):
    transport.demux(raw)
    transport.demux(transport.mux(b"x" * 300) + raw)


def test_tables_over_several_packets_and_repeated_packets():
    """A program map of many streams, with a network table in the association and a legal repetition of a media packet."""
    pids = [0x100, *range(0x300, 0x360)]
    body = bytes([0xE1, 0, 0xF0, 0]) + b"".join(bytes([6, 0xE0 | p >> 8, p & 0xFF, 0xF0, 0]) for p in pids)
    section = transport._section(2, 1, body)
    assert len(section) > 2 * 184
    raw = b"\0" + section
    packets = [raw[i : i + 184].ljust(184, b"\xff") for i in range(0, len(raw), 184)]
    pmt = b"".join(bytes([0x47, (0x40 if k == 0 else 0) | 0x10, 0, 0x10 | k]) + x for k, x in enumerate(packets))
    pat = transport._table_packet(0, transport._section(0, 1, bytes([0, 0, 0xE0, 0x10, 0, 1, 0xF0, 0])))
    payload = bytes(range(256)) * 8
    media = transport.mux(payload)[2 * 188 :]
    out = transport.demux(pat + pmt + media[: 3 * 188] + media[2 * 188 :])
    assert out.payload == payload and out.programs == {1: {p: 6 for p in pids}} and not out.bad_counters and not out.errors
    assert transport.demux(pat + pmt[:188] + media).errors == ["a bad program table"]


def test_short_elementary_packets():
    body = b"\0\0\1\xbd\0\4\x80\x80\0x"  # a timestamp is announced, and there is no room for it
    packet = bytes([0x47, 0x41, 0, 0x30, 184 - len(body) - 1, 0]).ljust(188 - len(body), b"\xff") + body
    out = transport.demux(transport.TABLES + packet)
    assert out.timestamps == [-1] and out.payload == b"x" and len(out.errors) == 1


def test_media_columns(spark, sf, odd, none):
    docs = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    for r in transport.op2_media(spark, sf).collect():
        raw = docs[r.doc_id].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes % 188 == 0 and "cc_errors=0;errors=0" in r.feature
    media = transport.encode(odd, "doc_id", "size")
    out = transport.features(media, "doc_id", "size", "n_bytes").collect()
    assert len(out) == 9 and {r.payload_bytes for r in out if r.doc_id in (1, 2)} == {64} and len({r.media_sha256 for r in out if r.doc_id in (5, 6)}) == 1
    assert transport.features(transport.encode(none, "doc_id"), "doc_id").count() == 0


# pages

ARTICLE = "<article><h1>Title &amp; more</h1><p>One\n two<br>three.<p>Four &#233;&nbsp;five<ul><li>a<li>b</ul></article>"
TEXT = "Title & more\nOne two three.\nFour é five\na\nb"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain & text", "plain & text"), (ARTICLE, TEXT),
        (f"<html><head><title>x</title></head><body><nav><ul><li>menu</ul></nav><header>top</header>{ARTICLE}<footer>end</footer></body></html>", TEXT),
        (f"<body><div class='ad banner'>buy</div><div id=cookie-notice>ok?</div>{ARTICLE}<aside>side</aside><section class=comments><article>me too</article></section><form>f<input></form>", TEXT),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes<!-- <p>no</p> --></p><noscript>no</noscript>", "yes"),
        ("<p>a<b>b<i>c</b>d</i>e</p><div>f</div>g", "abcde\nf\ng"),
        ("<main><p>in</main><p>out", "in"), ("<p>x</div>y</span>z", "xyz"), ("a < b <3 &lt;c&gt", "a < b <3 <c>"), ("<p>cut <a href='x", "cut"), ("<p hidden>no<p aria-hidden=true>no<p style='display: none'>no<p>yes", "yes"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<article><header><h1>T</h1></header><p>x</p><footer>no</footer></article>", "T\nx"), ("<div><p>un<div>closed", "un\nclosed"),
    ],
)
def test_main_text(html, text):
    assert webtext.main_text(webtext.parse(html or "")) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x y'>", "</div>", "<li>", "<article>", "</article>", "text ", "&amp;", "<script>", "</script>", "<!--", "-->", "<", ">", '"', "<b", "<td>", "</table>"]), max_size=40).map("".join))
def test_any_page_is_parsed(html):
    page = webtext.parse(html)
    webtext.main_text(page)
    assert sum(k == "o" for k, _ in page.events) == sum(k == "c" for k, _ in page.events) == len(page.tags)


def test_site_templates(spark):
    frame = "<div><a href=/>home</a> <a href=/b>more</a></div><p>{}</p><p>The same line.</p><div><span>all rights</span></div>"
    pages = [(i, f"http://a.example/{i}", frame.format(f"own text {i}")) for i in range(8)] + [(i, f"https://b.example:80/{i}", frame.format(i)) for i in range(20, 23)]
    pages += [(30 + i, f"//c.example/{i}", f"<article><p>Own {i}</p><p>Said by all.</p><ul><li>share</ul></article>") for i in range(6)] + [(None, None, None), (50, "no url", "<p>x</p>"), (50, "no url", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("templates", F.lit(2))
    out = {r.page_id: r for r in webtext.extract(df).collect()}
    assert out[3].text == "own text 3"  # the line of all pages goes where there is no article
    assert out[21].text == "home more\n21\nThe same line.\nall rights"  # too few pages for a template
    assert out[32].text == "Own 2\nSaid by all."  # in an article lists can go, paragraphs not
    assert out[None].text == "" and out[50].text == "x" and out[50].n_chars == 1 and webtext.extract(df).count() == len(pages)
    assert webtext.extract(df.limit(0)).count() == 0


def test_classes_and_repeated_pages(spark):
    keep = "<article><p>One.</p><div class='related-work'>Two.</div><section id='search-algorithms'>Three.</section></article>"
    assert webtext.main_text(webtext.parse(keep)) == "One.\nTwo.\nThree."
    assert webtext.main_text(webtext.parse("<main><div class='social-history'>Kept.</div><div class='x related-posts'>no</div><div id=ad-slot-3>no</div></main>")) == "Kept."
    page = "<body><div><p>A page that was stored six times.</p></div></body>"
    pages = [(1, "http://a.example/x", page)] * 6 + [(i, None, f"<p>Said by all.</p><p>own {i} words of it</p>") for i in range(10, 18)]
    out = webtext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in out if r.page_id == 1} == {"A page that was stored six times."}
    assert all(r.text == f"Said by all.\nown {r.page_id} words of it" for r in out if r.page_id != 1)


def test_templates_equal_a_plain_count(spark):
    """Of a large host's pages a twentieth have a box; pages are counted one by one."""
    box = "<div>See our other offers</div>"
    pages = [(i, f"http://h.example/{i}", f"<body><div>Home</div>{box if i % 20 == 0 else ''}<p>The own words of page number {i} are these.</p></body>") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", webtext.host_of(F.col("url")))
    counts = {}
    for _, _, html in pages:
        page = webtext.parse(html)
        for h in {page.hashes[i] for i in range(len(page.tags)) if not page.hidden[i] and webtext.deletable(page, i)}:
            counts[h] = counts.get(h, 0) + 1
    (row,) = webtext.templates(df).collect()
    assert set(map(bytes, row.templates)) == {h for h, n in counts.items() if n >= max(5, 0.02 * 200)} and len(row.templates) == 2
    assert all(r.text == f"The own words of page number {r.page_id} are these." for r in webtext.extract(df.drop("host")).collect())


def test_long_pages(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, "http://a.example", f"<nav>x</nav><article><p>{text}</p>{'<div>' * 5000}end</article>")], "page_id long, url string, html string")
    assert webtext.extract(df).first().text == f"{text}\nend"


def test_articles_of_pages(spark, sf):
    """The article of each page is a text of documents, its first words as a heading before it."""
    docs = {" ".join(r.text.split()) for r in common.table(spark, sf, "documents").collect()}
    for r in webtext.op5_html_extraction(spark, sf).collect():
        assert " ".join(r.text.split("\n", 1)[1].split()) in docs and r.n_chars == len(r.text)


# shards


def test_store(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("path"), F.md5(F.col("id").cast("string")).alias("_shard"), F.lit(None).cast("string").alias("a b"))
    store = shards.Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.compact() == 0
    assert store.append(rows, 100) == 1 and store.append(rows.limit(10), 100) == 2
    before = store.manifest().count()
    assert before > 40
    version = store.compact(target=60_000, fanout=4, keep_old=True)
    assert version > 2 and store.manifest().count() < before / 4
    sizes = [r.bytes for r in store.manifest().collect()]
    assert max(sizes) < 2 * 60_000
    assert store.read().columns == ["path", "_shard", "a b", "__shard", "_shard_bytes", "_shard_rows"]
    assert store.read().select(*rows.columns).exceptAll(rows.union(rows.limit(10))).count() == 0 and store.read().count() == 5010
    assert store.read(1).count() == 5000 and store.compact(target=60_000) == version  # older versions are there; nothing more to do
    assert store.append(rows.limit(1)) == version + 1 and store.compact(60_000) == version + 1
    with pytest.raises(ValueError):
        store.append(spark.range(1))


def test_only_one_commit_of_a_version(spark, tmp_path):
    a, b = shards.Store(spark, str(tmp_path / "s")), shards.Store(spark, str(tmp_path / "s"))
    a.append(spark.range(3))
    entry = a._entry(1)
    a._commit(2, entry)
    with pytest.raises(shards.CommitConflict):
        b._commit(2, entry)
    assert b.read().count() == 3


def test_a_dead_claim_does_not_block(spark, tmp_path):
    store = shards.Store(spark, str(tmp_path / "s"))
    store.append(spark.range(3))
    claim = store._path(f"{store.root}/versions/.claim-00000002")
    store._fs.create(claim, False).close()
    with pytest.raises(shards.CommitConflict):
        store.append(spark.range(3))  # its writer may still be at work
    store._fs.setTimes(claim, int(1000 * (time.time() - shards.CLAIM_SECONDS - 60)), -1)
    assert store.append(spark.range(3)) == 2 and store.read().count() == 6


def test_vacuum_keeps_the_last_two_versions(spark, tmp_path):
    store = shards.Store(spark, str(tmp_path / "s"))
    for _ in range(5):
        store.append(spark.range(1000), 100)
    version = store.compact(target=1 << 20)
    assert store.read(version - 1).count() == store.read(version).count() == 5000
    orphan = store._path(f"{store.root}/data/failed")
    store._fs.mkdirs(orphan)
    store.append(spark.range(1))
    store.vacuum()
    assert store._fs.exists(orphan) and store.read(version).count() == 5000
    store._fs.setTimes(orphan, int(1000 * (time.time() - shards.ORPHAN_SECONDS - 60)), -1)
    store.append(spark.range(1))
    store.vacuum(1)
    assert not store._fs.exists(orphan) and store.read().count() == 5002


def test_plan_equals_a_plain_planner(spark, tmp_path):
    """Files of a tier in the order of their names are cut at the target size; runs of fanout files or a full file are merged."""
    store = shards.Store(spark, str(tmp_path / "s"))
    rows = spark.range(4000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("text"))
    for n in (50, 50, 400, 3000):
        store.append(rows.limit(n * 8), n)
    target, fanout, smallest = 60_000, 3, shards.SMALLEST
    files = [(max(0, math.floor(math.log(r.bytes / smallest, fanout))), r.shard, r.bytes, r.path) for r in store.manifest().collect() if r.bytes < target // 2]
    runs, before = {}, {}
    for tier, shard, size, path in sorted(files):
        nth = before.get(tier, 0) // target
        before[tier] = before.get(tier, 0) + size
        runs.setdefault((tier, nth), []).append((path, size))
    want = {frozenset(p for p, _ in r) for r in runs.values() if len(r) >= fanout or len(r) > 1 and sum(s for _, s in r) >= target}
    got = {}
    for r in store.plan(target, fanout).collect():
        got.setdefault(r.run, set()).add(r.path)
    assert {frozenset(x) for x in got.values()} == want and len(want) > 1


def test_shards_of_documents(spark, sf, odd, none):
    docs = common.table(spark, sf, "documents")
    out = shards.sharded(docs, target=100_000, arrival_rows=10)
    assert out.select(*docs.columns).exceptAll(docs).count() == 0 and out.count() == docs.count()
    per = {r._shard: r for r in out.groupBy("_shard").agg(F.count(F.lit(1)).alias("n"), F.max("_shard_rows").alias("rows"), F.max("_shard_bytes").alias("size")).collect()}
    assert all(r.n == r.rows for r in per.values()) and len(per) < 20
    plain = odd.drop("TEXT_")
    assert shards.sharded(plain).drop("_shard", "_shard_bytes", "_shard_rows").exceptAll(plain).count() == 0 and shards.sharded(plain).count() == 9
    assert shards.sharded(none).count() == 0 and shards.sharded(none).columns[:5] == none.columns


# mixing


def targets(sizes, weights=(5, 2, 1), ratio=1.5):
    """By resharing what is over the limits, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), ratio * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def check_mix(docs, rows):
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + len(tokens(d.text))
    want = targets(sizes)
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((d.doc_id or -1, len(tokens(d.text))) for d in docs)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
    by_total = {}
    for r in rows:
        key = (r.source_size, round(r.target, 6))
        by_total[key] = by_total.get(key, 0) + r.taken
    assert sorted(by_total) == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    for (size, target), taken in by_total.items():
        n = sum(1 for s in sizes if round(want[s], 6) == target and sizes[s] == size)
        assert abs(taken - n * target) <= max(0.02 * n * target, 8 * n)


def test_mix_of_documents(spark, sf):
    docs = common.table(spark, sf, "documents").collect()
    rows = mixing.op10_mixing(spark, sf).collect()
    check_mix(docs, rows)
    assert sorted(rows) == sorted(mixing.op10_mixing(spark, sf).collect())


def test_mix_odd_rows(spark, odd, none, tmp_path):
    odd.drop("TEXT_").write.parquet(str(tmp_path / "a" / "documents.parquet"))
    check_mix(odd.collect(), mixing.op10_mixing(spark, str(tmp_path / "a")).collect())
    none.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert mixing.op10_mixing(spark, str(tmp_path / "b")).count() == 0
    assert mixing.stage_mixing(spark, none, "").count() == 0


def test_schedule_is_spread(spark, sf):
    """Every part of the schedule has each source's share of slots, and blocks of a source come in turn."""
    m = mixing.mix(mixing.sized(common.table(spark, sf, "documents")))
    slots = m.schedule.orderBy("slot").collect()
    share = {r.src: r.target for r in m.sources.collect()}
    total = sum(share.values())
    for a in range(0, len(slots) - 1000, 7919):
        part = slots[a : a + 1000]
        for s, t in share.items():
            assert abs(sum(x.src == s for x in part) - 1000 * t / total) < 12
    for s in list(share)[:4]:
        assert [x.rank for x in slots if x.src == s] == list(range(sum(x.src == s for x in slots)))


def test_stages_with_clashing_columns(spark, odd):
    """Extra columns of any name, also such that stages use themselves, come out as they went in."""
    from rowweave.llm import langid

    clash = odd.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(("score", "TEXT", "_id", "_times", "times", "id", "nth", "doc", "copy", "lang_pred", "Source", "src"))))
    for stage in (langid.stage_language, mixing.stage_mixing):
        out = stage(spark, clash, "")
        assert out.columns == clash.columns and out.count() > 0
        assert {tuple(r)[-12:] for r in out.collect()} == {tuple(f"x{i}" for i in range(12))}


def test_mixing_stage(spark, sf):
    docs = common.table(spark, sf, "documents")
    out = mixing.stage_mixing(spark, docs, sf)
    assert out.columns == docs.columns and out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
    assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 2
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(common.TOKEN))).alias("n")).collect()}
    want, got = targets(size(docs)), size(out)
    longest = docs.agg(F.max(F.regexp_count("text", F.lit(common.TOKEN)))).first()[0]
    assert all(abs(got.get(s, 0) - t) <= longest + 0.02 * t for s, t in want.items())


def test_small_sources_reach_their_targets(spark):
    """Beside sources of millions of words, those that are smaller than one of their blocks are taken twice as well."""
    sizes = {"a": 40_000_000, "b": 10_000_000, "c": 10_000_000, "d": 300, "e": 1_000, "f": 150_000, "g": 7}
    rows = spark.createDataFrame([(s, n // k, k) for s, n in sizes.items() for k in [min(n, 100)]], "source string, each long, n int")
    docs = rows.select("source", F.explode(F.sequence(F.lit(1), "n")).alias("i"), "each").select(F.xxhash64("source", "i").alias("doc_id"), "source", F.col("each").alias("size"), F.md5(F.concat("source", "i")).alias("key"))
    m = mixing.mix(docs)
    assert m.block_tokens > 3 * 300
    taken = {r.src: r.n for r in m.taken().groupBy("src").agg(F.sum("taken").alias("n")).collect()}
    for s in m.sources.collect():
        assert abs(taken.get(s.src, 0) - s.target) <= max(1, 0.02 * s.target), s
    slots = [r.slot for r in m.schedule.where("src = 3").orderBy("rank").collect()]
    assert slots == sorted(slots) and slots[-1] - slots[0] > 0.9 * m.schedule.agg(F.max("slot")).first()[0]


def test_mixing_stage_keeps_small_sources(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SOURCE", 256)
    big = [(1000 * k + i, "w " * 100, "en", s) for k, s in enumerate("abc") for i in range(200)]
    small = [(9000 + i, "x " * 10, "en", s) for s in "d" for i in range(3)]
    out = mixing.stage_mixing(docs_of().sparkSession, docs_of(*big, *small), "")
    assert sorted(r.doc_id for r in out.where("source = 'd'").collect()) == [9000, 9000, 9001, 9001, 9002, 9002]


# SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
    order = lambda columns, rows: sorted([str([f"{r[columns.index(c)]:.9g}" if isinstance(r[columns.index(c)], float) else r[columns.index(c)] for c in sorted(columns)]) for r in rows])
    assert order(df.columns, df.collect()) == order(want.columns, want.fetchall()) and sorted(df.columns) == sorted(want.columns)


def test_pipeline(spark, sf):
    docs = common.table(spark, sf, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.store(stage(spark, before, sf), name)
        if name != "sharding":
            assert after.columns == docs.columns
        if name in ("language", "near_duplicates", "decontamination"):
            assert 0 < after.count() < before.count() or name == "language"
            assert after.exceptAll(before).count() == 0
        before = after
    assert corpus_pipeline.run(spark, sf).select("doc_id", "_shard").count() == before.count()
