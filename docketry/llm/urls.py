"""URL filter: host and path rules, then a list of canonical URLs.

The listed URLs fill a blocked Bloom filter: an URL picks one block of four
64-bit words and sets two bits in each. Pages read their block by a broadcast
join; the filter has at most ``blocks`` rows of 40 bytes whatever the length of
the list (65,536 rows, 2.6 MB by default), which is the bound that makes the
broadcast safe. Only pages that pass, real hits and a few false positives, enter
the exact hash join with the list, so the mass of pages is never shuffled. A
filter that is too small for its list only sends more pages to the exact join.

Edge cases: null and URLs without ``://`` have an empty host and path, match no
rule and no list entry; a list may repeat entries and hold nulls; an empty list
blocks nothing; repeated pages are judged each; of two rules of equal length
that fit, block wins; only the page key and the url are read, so other columns
may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ascii_lower

BLOCKS = 65_536
WORDS = 4
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and without it."""
    at = F.instr(url, "://")
    return F.coalesce(
        F.when(at > 0, F.substring(url, at + 3, F.char_length(url))), F.lit("")
    )


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Host without ``www.``, path without closing slashes, sorted parameters.

    The scheme, the fragment and tracking parameters go. Null without a host.
    """
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(
            F.split(query, "&"),
            lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*tracking),
        )
    )
    return F.when(
        host_of(url) != "",
        F.concat(
            F.regexp_replace(host_of(url), r"^www\.", ""),
            F.regexp_replace(path_of(url), r"/+$", ""),
            F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
        ),
    )


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: Column) -> list[Column]:
    """Two bits in each word of a block, from a second hash."""
    spread = F.xxhash64(F.lit("bits"), key)

    def bit(i: int) -> Column:
        at = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """At most ``blocks`` rows: (bloom_block, bloom_0 .. bloom_3)."""
    return (
        keys.where(F.col(key).isNotNull())
        .select(
            block_of(F.col(key), blocks).alias("bloom_block"),
            *(b.alias(f"bit_{w}") for w, b in enumerate(bits_of(F.col(key)))),
        )
        .groupBy("bloom_block")
        .agg(*(F.bit_or(f"bit_{w}").alias(f"bloom_{w}") for w in range(WORDS)))
    )


def judge_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = rule.fits(host, path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    key: str = "page_id",
    url: str = "url",
    blocks: int = BLOCKS,
) -> DataFrame:
    """(key, host, path, rule, listed, verdict) of every page.

    ``listed`` has one column ``url``: canonical URLs to block where no rule
    decides.
    """
    exact = listed.select(F.col("url").alias("listed_url")).where("listed_url IS NOT NULL").distinct()
    parted = pages.select(
        F.col(key).alias("page_key"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        canonical(F.col(url)).alias("canonical"),
    )
    name, verdict = judge_rules(F.col("host"), F.col("path"), rules)
    probed = (
        parted.withColumn("rule", name)
        .withColumn("ruled", verdict)
        .withColumn("block", block_of(F.col("canonical"), blocks))
        .join(
            F.broadcast(bloom_filter(exact, "listed_url", blocks)),
            F.col("block") == F.col("bloom_block"),
            "left",
        )
    )
    passes = F.lit(True)
    for w, bits in enumerate(bits_of(F.col("canonical"))):
        passes = passes & (F.col(f"bloom_{w}").bitwiseAND(bits) == bits)
    possible = F.coalesce(F.col("canonical").isNotNull() & passes, F.lit(False))
    shown = ["page_key", "host", "path", "rule", "ruled"]
    misses = probed.where(~possible).select(*shown, F.lit(False).alias("listed"))
    hits = (
        probed.where(possible)
        .select(*shown, "canonical")
        .join(exact, F.col("canonical") == F.col("listed_url"), "left")
        .select(*shown, F.col("listed_url").isNotNull().alias("listed"))
    )
    return misses.unionByName(hits).select(
        F.col("page_key").alias(key),
        "host",
        "path",
        "rule",
        "listed",
        F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )
