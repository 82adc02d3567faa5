"""URL filter: a blocked Bloom filter lets possible hits through to an exact join; rules by host and path come first.

The filter is a table of at most ``MAX_BLOCKS`` blocks of 512 bits, so it may always be broadcast. A list too long for
it only raises the share of false positives, which the exact join with the listed canonical URLs removes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisurface.llm.frames import pick

#: 65,536 blocks of eight 64-bit words: 4 MB.
MAX_BLOCKS = 1 << 16
WORDS = 8
KEYS_PER_BLOCK = 40
#: Bits that a key sets, each in a word of its own choice.
PROBES = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and its subdomains where the path starts with ``path``; the longest rule that fits wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or if null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or if null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` or ``m.`` and port, then the path without ``.html`` and a closing slash; scheme, query and
    fragment do not count. Null if there is no host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^(?:www|m)\.", ""), r":\d*$", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"\.html?$", ""), "/+$", "")
    return F.when(host != "", F.concat(host, path))


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and the bits that it sets in each word of the block."""
    h, bits = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    words = [F.lit(0).cast("bigint") for _ in range(WORDS)]
    for i in range(PROBES):
        nine = F.shiftrightunsigned(bits, 9 * i).bitwiseAND(511)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), nine.bitwiseAND(63).cast("int"))
        word = F.shiftrightunsigned(nine, 6)
        words = [w.bitwiseOR(F.when(word == j, bit).otherwise(F.lit(0).cast("bigint"))) for j, w in enumerate(words)]
    return F.pmod(h, F.lit(blocks)).cast("int"), words


def bloom_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: a row for each block in use with its words; combined on the map side, at most ``blocks`` rows."""
    place, words = _places(F.col(key), blocks)
    rows = keys.select(place.alias("_block"), *[w.alias(f"_w{j}") for j, w in enumerate(words)])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_w{j}").alias(f"_w{j}") for j in range(WORDS)])


def block_count(n_keys: int) -> int:
    """A power of two with room for the keys, ``MAX_BLOCKS`` at most."""
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n_keys and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocks


def rule_of(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """``field`` of the longest rule that fits, else null; of equally long ones the first in order of name."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def filter_urls(
    pages: DataFrame, listed: DataFrame, id_col: str, url_col: str, listed_col: str, rules: Sequence[Rule] = ()
) -> DataFrame:
    """One row for each page: ``page_id``, ``url``, ``host``, ``path``, ``rule``, ``listed``, ``verdict``.

    ``listed`` says whether the canonical URL is among those of ``listed_col``. The verdict is that of the longest rule;
    without one, ``block`` if listed, else ``allow``. Null URLs and such without ``://`` have an empty host and path, are
    never listed and thus allowed. Repeated rows of ``pages`` each give a row, repeated or null entries of the list count
    once or not at all. ``rules`` is a short list that becomes part of the plan.
    """
    keys = pick(listed, _url=listed_col).select(canonical_url(F.col("_url")).alias("_key"))
    keys = keys.where(F.col("_key").isNotNull()).distinct()
    blocks = block_count(keys.count())
    bloom = F.broadcast(bloom_table(keys, "_key", blocks))
    rows = pick(pages, page_id=id_col, url=url_col)
    rows = rows.withColumns(
        {"host": url_host(F.col("url")), "path": url_path(F.col("url")), "_key": canonical_url(F.col("url"))}
    )
    place, words = _places(F.col("_key"), blocks)
    probed = rows.withColumn("_block", place).join(bloom, "_block", "left")
    hit = F.col("_key").isNotNull() & F.col("_w0").isNotNull()
    for j, bits in enumerate(words):
        hit = hit & (F.col(f"_w{j}").bitwiseAND(bits) == bits)
    probed = probed.select("page_id", "url", "host", "path", "_key", F.coalesce(hit, F.lit(False)).alias("_maybe"))
    misses = probed.where(~F.col("_maybe")).select("page_id", "url", "host", "path", F.lit(False).alias("listed"))
    exact = keys.select("_key", F.lit(True).alias("_in"))
    hits = probed.where(F.col("_maybe")).join(exact, "_key", "left")
    hits = hits.select("page_id", "url", "host", "path", F.coalesce("_in", F.lit(False)).alias("listed"))
    host, path = F.col("host"), F.col("path")
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return misses.unionByName(hits).select(
        "page_id",
        "url",
        "host",
        "path",
        rule_of(host, path, rules, "name").alias("rule"),
        "listed",
        F.coalesce(rule_of(host, path, rules, "verdict"), own).alias("verdict"),
    )
