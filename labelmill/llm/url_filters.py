"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

The filter has one 64-bit block per row, so it is an ordinary table: a URL's hash names the block
and six bits in it. Its number of blocks follows the list, whatever its length. Filter and list
are each sent to every task if measured below ``max_bytes``, else joined by shuffle with the rows
of hot keys spread. What passes the filter is joined with the list itself, so no false hit is left.
All is DataFrame expressions.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is on no
list; a page that no rule fits is blocked if listed, else allowed; the list may hold nulls and
repeated URLs; repeated pages are judged each; empty tables are fine; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.scratch import BROADCAST_BYTES, lookup_join, materialize

KEYS_A_BLOCK = 4
BITS_A_KEY = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a slash at its end; null where there is no host."""
    return F.when(host != "", F.concat(host, F.rtrim(path, F.lit("/"))))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does. A rule: (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def bits(url: Column) -> Column:
    """The bits of a URL inside its block."""
    h = F.xxhash64(url, F.lit(1))
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS_A_KEY)]
    return reduce(lambda a, b: a.bitwiseOR(b), one)


def block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the filter of ``listed`` (canonical), at most ``blocks`` rows of 16 bytes."""
    return listed.groupBy(block(F.col("canonical"), blocks).alias("block")).agg(F.bit_or(bits(F.col("canonical"))).alias("bits"))


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page."""
    host, path = host_and_path(F.col(f"`{listed_col}`").cast("string"))
    known = listed.select(canonical(host, path).alias("canonical")).where("canonical IS NOT NULL").distinct()
    known = materialize(known, "listed")
    blocks = max(1, -(-known.count() // KEYS_A_BLOCK))

    host, path = host_and_path(F.col("url"))
    rows = (
        pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("canonical", canonical(F.col("host"), F.col("path")))
        .withColumn("block", block(F.col("canonical"), blocks))
    )
    probed = lookup_join(rows, materialize(bloom(known, blocks), "bloom"), "block", "page_id", max_bytes=max_bytes)
    own = bits(F.col("canonical"))
    possible = F.coalesce(F.col("canonical").isNotNull() & (F.col("bits").bitwiseAND(own) == own), F.lit(False))
    columns = ["page_id", "host", "path", "canonical"]
    miss = probed.where(~possible).select(*columns, F.lit(False).alias("listed"))
    hit = probed.where(possible).select(*columns)
    exact = known.withColumn("found", F.lit(True))
    sure = lookup_join(hit, exact, "canonical", "page_id", max_bytes=max_bytes)
    sure = sure.select(*columns, F.coalesce("found", F.lit(False)).alias("listed"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    listed_verdict = F.when(F.col("listed"), "block").otherwise("allow")
    return miss.unionByName(sure).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, listed_verdict).alias("verdict"), "listed"
    )
