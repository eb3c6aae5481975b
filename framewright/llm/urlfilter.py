"""URL filter: host and path rules, then a blocked Bloom filter before an exact join with a URL list.

Only DataFrame expressions are used. Every distinct listed URL sets BITS bits within one 256-bit block, and there are
blocks for BITS_PER_URL bits a URL, however long the list. Up to BROADCAST_BLOCKS blocks (of 40 bytes) the filter is
broadcast, and pages that it excludes never enter a shuffle; a larger one meets the pages' canonical URLs in a join on
the block. Possible hits are settled by an exact join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6
BROADCAST_BLOCKS = 1 << 17
BITS_PER_URL = 12


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for NULL or without '://'."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form in which URLs are compared: host without www. or m., path without closing slash or .html, and the
    query without utm_ parameters; scheme and fragment go. NULL where the url has no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = path_of(url)
    path = F.when(path.endswith(".html"), F.left(path, F.length(path) - 5)).otherwise(F.rtrim(path, F.lit("/")))
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else NULL; a few rules become one CASE."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _mask(url: Column, word: int) -> Column:
    """The bits of one url in 64-bit word 0..3 of its block."""
    bits = F.xxhash64(url, F.lit("bits"))
    at = [F.pmod(F.shiftright(bits, 9 * i), F.lit(256)) for i in range(BITS)]
    return reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.shiftright(x, 6) == word, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long")) for x in at],
    )


def bloom(listed: DataFrame, url: str = "url") -> tuple[DataFrame, int]:
    """The filter as rows (block, w0..w3), one per block that has a bit, and the number of blocks."""
    n = listed.count()
    blocks = 1
    while blocks * 256 < n * BITS_PER_URL:
        blocks *= 2
    masks = [F.bit_or(_mask(F.col(url), w)).alias(f"w{w}") for w in range(4)]
    return listed.groupBy(_block(F.col(url), blocks).alias("block")).agg(*masks), blocks


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    pages has page_id and url; listed has url. The longest rule that fits decides; else a page is blocked if its
    canonical URL is among the canonical URLs of listed, and allowed otherwise. A NULL url has an empty host and path
    and is allowed; urls of any length are read whole; of rules of equal length the last in alphabetical order decides;
    a NULL page_id is as good as another. Repeated rows are judged one by one; an empty list blocks nothing, an empty
    table gives an empty result; other columns are not read, whatever their names.
    """
    known = listed.select(canonical(F.col("url")).alias("listed_url")).where("listed_url is not null").distinct()
    blocks_df, blocks = bloom(known, "listed_url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical_url"))
    seen = seen.withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    probe = F.lit(True)
    for w in range(4):
        mask = _mask(F.col("canonical_url"), w)
        probe = probe & (F.col(f"w{w}").bitwiseAND(mask) == mask)
    needed = F.col("found").isNull() & F.col("canonical_url").isNotNull()
    columns = ["page_id", "host", "path", "found", "canonical_url"]
    block = _block(F.col("canonical_url"), blocks)
    if blocks <= BROADCAST_BLOCKS:
        probed, ruled = seen.withColumn("block", F.when(needed, block)).join(F.broadcast(blocks_df), "block", "left"), None
    else:  # only pages that need the filter are shuffled
        probed, ruled = seen.where(needed).withColumn("block", block).join(blocks_df, "block", "left"), seen.where(~needed)
    probed = probed.withColumn("possible", F.coalesce(F.col("w0").isNotNull() & probe, F.lit(False)))
    passed = probed.where(~F.col("possible")).select(*columns, F.lit(False).alias("listed"))
    if ruled is not None:
        passed = passed.unionByName(ruled.select(*columns, F.lit(False).alias("listed")))
    hits = probed.where("possible").select(*columns)
    exact = hits.join(known.withColumn("is_listed", F.lit(True)), F.col("canonical_url") == F.col("listed_url"), "left")
    exact = exact.select(*columns, F.coalesce("is_listed", F.lit(False)).alias("listed"))
    return passed.unionByName(exact).select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
