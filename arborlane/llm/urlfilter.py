"""Operator 13, URL filters: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The few written rules decide first, row by row.  Every other URL is looked up
in a list of canonical URLs, which may be as long as the input:

* `bloom` folds the list into blocks of 512 bits, eight words of 64 bits; a
  URL sets one bit of each word of one block, so a look-up touches one block.
  The filter has about 16 bits for each listed URL and never more than
  `MOST_BLOCKS` blocks (16 MB), so broadcasting it is bounded.  A longer list
  only makes more false positives, never a wrong verdict.
* `judge` sends the possible hits, and no other row, to an exact join with the
  list by the whole canonical URL, which removes the false positives.

All of it is built-in functions, in the JVM.  Hot keys: hits collapse to their
distinct URLs before they meet the list, and the rows of a URL go to as many
tasks as their ids have salts; rows equal in id and URL share one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, salted_join

#: Words of a block, bits of the filter for each listed URL, blocks at most.
WORDS, BITS_EACH, MOST_BLOCKS = 8, 16, 1 << 18
#: Rules of the registered query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The registered query lists the pages of hosts with one of these words between dots and hyphens.
UNWANTED = ["adult", "ads", "bets", "casino", "pills", "spam"]
#: Query parameters that say where a visitor came from and not what the page is.
TRACKING = "utm_[^=]*|gclid|fbclid|ref"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL without scheme, user, default port, www., repeated or final slashes, tracking parameters and fragment; parameters sorted.

    Empty where there is no host.
    """
    host = F.regexp_replace(host_of(url), r"^.*@|:(80|443)?$|\.(:(80|443)?)?$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), "/$", "")
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host == "", "").otherwise(F.concat(host, path, tail))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, name) that fits, as a struct; null if none does.

    A rule fits its host and all hosts below it where the path starts with the
    rule's.  Of rules equally long the one with the longer host wins, then the
    first one given.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    each = [F.when(fits(h, p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("name"))) for v, h, p in ordered]
    return F.coalesce(*each) if each else F.lit(None).cast("struct<verdict:string,name:string>")


def _bits(url: Column) -> list[Column]:
    """One bit of each word."""
    h = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]


def blocks_for(n: int) -> int:
    return min(MOST_BLOCKS, max(1, math.ceil(n * BITS_EACH / (64 * WORDS))))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column `canonical`: block and its words w0..w7; a block without a URL has no row."""
    own = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("canonical")))])
    return own.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def passing(rows: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """rows with `possible`: whether the filter may hold their `canonical`; never false for one that it holds."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks)))
    hit = F.lit(True)
    for k, bit in enumerate(_bits(F.col("canonical"))):
        hit &= F.col(f"w{k}").bitwiseAND(bit) != 0
    out = rows.join(F.broadcast(table), "block", "left")  # MOST_BLOCKS rows at most
    return out.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("block", *[f"w{k}" for k in range(WORDS)])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and canonical of every row of pages; `listed` has URLs in a column `url`.

    The verdict is the longest fitting rule's, else block for a URL whose
    canonical form is that of a listed one, else allow.  A null URL, and one
    without ://, has empty host and path, fits no rule and is never listed;
    repeated rows get a row each; null and repeated listed URLs count once; an
    empty list allows what no rule blocks; an empty table gives an empty result.
    """
    listed = listed.select(canonical(F.col("url")).alias("canonical")).where("canonical <> ''").distinct()
    blocks = blocks_for(listed.count())
    url = F.col("url")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    rows = passing(rows.select("page_id", "host", "path", "canonical", F.col("fits.name").alias("rule"), F.col("fits.verdict").alias("ruled")), bloom(listed, blocks), blocks)
    asks = F.col("possible") & F.col("ruled").isNull()
    hits = rows.where(asks)
    found = hits.select("canonical").distinct().join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    settled = rows.where(~asks).withColumn("listed", F.lit(None).cast("boolean"))
    confirmed = salted_join(hits, found, "canonical", "page_id")
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return settled.unionByName(confirmed).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical")


def unwanted(pages: DataFrame, words: list[str] = UNWANTED, url_col: str = "url") -> DataFrame:
    """The URLs of pages whose host has one of the words between dots and hyphens."""
    url = F.col(f"`{url_col}`")
    return pages.select(url.alias("url")).where(F.arrays_overlap(F.split(host_of(url), "[.-]"), F.array(*[F.lit(w) for w in words])))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, RULES, unwanted(pages))


_SQL_RULE = "\n    ".join(
    f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
)
SQL = f"""WITH parts AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), '') AS query FROM pages),
  cut AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:(80|443)?$|\\.(:(80|443)?)?$', '', 'g'), '^www\\.', '') AS plain,
    regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS short,
    list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^({TRACKING})(=|$)'))) AS kept FROM parts),
  named AS (SELECT *, CASE WHEN plain = '' THEN '' ELSE plain || short || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical,
    CASE {_SQL_RULE} END AS rule FROM cut),
  listed AS (SELECT DISTINCT canonical FROM named WHERE canonical <> '' AND list_has_any(regexp_split_to_array(host, '[.-]'), [{", ".join(f"'{w}'" for w in UNWANTED)}]))
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)} WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict, canonical FROM named"""
