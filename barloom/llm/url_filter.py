"""URL filters: prefix rules, then a listed set behind a blocked Bloom filter, in DataFrame operations only.

The filter has a fixed number of 64-bit blocks. A listed canonical URL sets four bits of the one block that its hash
picks, so a look-up reads one word. The words travel as one array of bounded size, a scalar subquery's value. URLs
whose bits are all set go to an exact hash join with the list, which removes the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path). The contract's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: 2**14 blocks of 64 bits: 128 KB, whatever the list holds. A longer list lets more URLs through to the join.
BLOCK_BITS = 14
#: Query parameters that name no content.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def _rest(url: Column) -> Column:
    """What follows the first ://; null where null or without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def _upto(text: Column, marks: str) -> Column:
    """Up to the first of the marks, or the end."""
    return F.regexp_extract(text, f"^[^{marks}]*", 0)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where null or without ://."""
    return F.coalesce(ascii_lower(_upto(_rest(url), "/?#")), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; a :// further on, as in a query string, is text like any other."""
    rest = _rest(url)
    begin = F.char_length(_upto(rest, "/?#"))
    return F.coalesce(_upto(F.substring(rest, begin + 1, F.char_length(rest)), "?#"), F.lit(""))


def canonical(url: Column) -> Column:
    """host/path without www. or m., .html, a last slash, fragment or tracking parameters; null without ://.

    The rest of the query string stays, as it may choose the content.
    """
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?:/+|/index)$", ""), r"\.html?$", "")
    query = F.regexp_extract(_upto(_rest(url), "#"), r"(?s)^[^?]*\?(.*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^{TRACKING}(?:=|$)")))
    return F.when(url.contains("://"), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The fitting rule as struct(rule, verdict), the longest first; null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return reduce(lambda chain, x: chain.when(*x), fits[1:], F.when(*fits[0])) if fits else F.lit(None)


def _block(url: Column, block_bits: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(1 << block_bits))


def _bits(url: Column) -> Column:
    """Four of 64 bits, from separate parts of one hash."""
    h = F.xxhash64(url, F.lit(2))
    one = [F.expr("1L")] * 4
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", o, F.pmod(F.shiftrightunsigned(h, 12 * i), F.lit(64)).cast("int")) for i, o in enumerate(one)])


def bloom_words(listed: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row with one array: the filter's blocks in order. Its size depends on block_bits only."""
    bits = listed.select(_block(F.col("url"), block_bits).alias("block"), _bits(F.col("url")).alias("bits"))
    blank = listed.sparkSession.range(1 << block_bits).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("bits"))
    words = bits.unionByName(blank).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "bits"))), lambda x: x["bits"]).alias("words"))


def filter_urls(spark: SparkSession, pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, listed.

    The longest fitting rule decides; else a URL whose canonical form is among ``listed`` (a column url, canonical
    forms; nulls and repeats do no harm) is blocked, any other allowed. Null urls, and those without ://, have an
    empty host and path, fit no rule and are not listed. An empty list or table is fine; other columns are not read.
    """
    listed = listed.select("url").where(F.col("url").isNotNull()).distinct()
    words = bloom_words(listed, block_bits).scalar()
    url = F.col(url_col)
    seen = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    seen = seen.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    bits = _bits(F.col("canonical"))
    word = F.element_at(words, (_block(F.col("canonical"), block_bits) + 1).cast("int"))
    open_case = F.col("best").isNull() & F.col("canonical").isNotNull()
    seen = seen.withColumn("possible", F.when(open_case, F.coalesce(word.bitwiseAND(bits) == bits, F.lit(False))).otherwise(False))
    # rows that need no look-up get keys that match nothing, all different: they spread over the tasks
    seen = seen.withColumn("key", F.when(F.col("possible"), F.col("canonical")).otherwise(F.concat(F.lit("\0"), F.col(id_col).cast("string"))))
    hits = seen.where("possible").select(F.col("canonical").alias("url")).join(listed, "url", "left_semi").distinct().select(F.col("url").alias("key"), F.lit(True).alias("listed"))
    is_listed = F.coalesce(F.col("listed"), F.lit(False))
    return seen.join(hits, "key", "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.when(is_listed, "block").otherwise("allow")).alias("verdict"), is_listed.alias("listed")
    )
