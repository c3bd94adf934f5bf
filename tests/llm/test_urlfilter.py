import random
import re

import duckdb
from pyspark.sql import functions as F

from arborlane.llm import urlfilter
from arborlane.llm.registry import ORACLES

from .cases import CLASHES

URLS = [
    (1, "HTTP://WWW.Example.COM:80/de//x/?b=2&utm_source=q&a=1#f"),
    (2, "https://u:p@example.com/de/x?a=1&b=2"),
    (3, "https://sub.NET/"),
    (4, "https://sub.net"),
    (5, "http://example.net/en/1"),
    (6, "http://a.example.net/english"),
    (7, "http://notnet/"),
    (8, "http://x.org/fr/?q#r"),
    (9, "no address"),
    (10, ""),
    (11, None),
    (12, "http://x.org?fr=/fr/"),
    (12, "http://x.org?fr=/fr/"),
    (None, "http://net/a"),
    (13, "http://bad.example/spam/"),
    (14, "https://www.bad.example/spam?ref=1"),
    (15, "http://x.org/" + "long/" * 20000),
    (16, "a://b://c.net/d"),
    (17, "http:///path"),
]


def table(spark):
    return spark.createDataFrame(URLS, "page_id long, url string").withColumns({c: F.lit("clash") for c in [*CLASHES, "host", "path", "rule", "canonical", "listed", "possible", "w0", "html"]})


def expected(url, listed):
    """By the words of the contract, with sets and loops."""
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    best = None
    for verdict, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, "block" if url in listed else "allow"))


def test_edge_rows_by_the_contract(spark):
    listed = spark.createDataFrame([("https://bad.example/spam",), ("https://bad.example/spam",), (None,), ("",), ("nothing",)], "url string")
    got = urlfilter.judge(table(spark), urlfilter.RULES, listed).collect()
    same = {"http://bad.example/spam/", "https://www.bad.example/spam?ref=1"}
    want = [(i, *expected(u, same)) for i, u in URLS]
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got)
    names = {r.page_id: r.canonical for r in got}
    assert names[1] == names[2] == "example.com/de/x?a=1&b=2" and names[11] == names[9] == names[17] == ""


def test_empty(spark):
    none = table(spark).limit(0)
    assert urlfilter.judge(none, urlfilter.RULES, none).count() == 0
    assert {r.verdict for r in urlfilter.judge(table(spark), [], none.select("url")).collect()} == {"allow"}


def test_filter_never_loses_a_listed_url_and_the_join_removes_the_rest(spark):
    listed = spark.range(3000).select(F.concat(F.lit("http://h/"), "id").alias("url"))
    pages = spark.range(9000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h/"), "id", F.lit("/")).alias("url"))
    names = listed.select(urlfilter.canonical(F.col("url")).alias("canonical"))
    rows = pages.select("page_id", urlfilter.canonical(F.col("url")).alias("canonical"))
    for blocks, most in ((urlfilter.blocks_for(3000), 0.01), (8, 1.0)):
        asked = urlfilter.passing(rows, urlfilter.bloom(names, blocks), blocks)
        assert asked.where("page_id < 3000 and not possible").count() == 0
        assert asked.where("page_id >= 3000 and possible").count() <= most * 6000
    got = urlfilter.judge(pages, [], listed)
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(3000))
    old, urlfilter.MOST_BLOCKS = urlfilter.MOST_BLOCKS, 4  # a filter that is far too full
    try:
        got = urlfilter.judge(pages, [], listed)
        assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(3000)) and got.count() == 9000
    finally:
        urlfilter.MOST_BLOCKS = old


def test_bits_of_a_block_like_a_loop(spark):
    urls = [f"h/{random.Random(3).random()}-{k}" for k in range(200)]
    names = spark.createDataFrame([(u,) for u in urls], "canonical string")
    words = {}
    for r in names.select("canonical", F.pmod(F.xxhash64("canonical"), F.lit(5)).alias("block"), F.xxhash64("canonical", F.lit("bits")).alias("h")).collect():
        own = words.setdefault(r.block, [0] * 8)
        for k in range(8):
            own[k] |= 1 << (((r.h % 2**64) >> (6 * k)) & 63)
    got = {r.block: [r[f"w{k}"] % 2**64 for k in range(8)] for r in urlfilter.bloom(names, 5).collect()}
    assert got == words


def test_query_equals_sql_and_only_hits_are_joined(spark, sf):
    df = urlfilter.query(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(ORACLES["op13_blocked_bloom_urls"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
    plan = df._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Cartesian" not in plan and "html" not in plan.split("== Physical Plan ==")[1]
