"""URL verdicts by rules and by a list of canonical URLs, with DataFrame operations only.

A URL's canonical form is tested against a blocked Bloom filter of the listed ones: its hash names one block of 256 bits,
and six bits in it must be set. Possible hits go to an exact hash join with the list, which removes false positives. Rules
(host, path prefix, verdict) meet URLs by each suffix of their host; the longest one that fits decides; else the URL is
blocked if it is listed.

A filter of up to `MAX_BLOCKS` blocks (2 MB) is broadcast; that of a longer list is joined by block, as both sides are dealt
evenly by the hash. Equal (host, path) pairs are judged once.

Defined cases: a null URL or one without `://` has an empty host and path, no rule and verdict allow; null list
entries and rules without a host list nothing; of equal rules with different verdicts block wins; repeated rows each get
a row; extra columns of pages are kept, and the added ones get another name where it is taken.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import at_most, fresh

MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 16
BITS = 6
BROADCAST_KEYS = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Without www., query, fragment, page suffix and final slashes; null for an empty host."""
    bare = F.regexp_replace(host, r"^www\.", "")
    trimmed = F.regexp_replace(F.regexp_replace(path, r"(index)?\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(F.lit("url "), bare, trimmed))


def _bits(key: Column) -> tuple[Column, list[Column]]:
    """The hash that picks a key's block, and the four words of bits it needs there."""
    spread = F.xxhash64(F.lit("bits"), key)
    words = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for j in range(BITS):
            at = F.shiftrightunsigned(spread, 8 * j).bitwiseAND(F.lit(255).cast("long")).cast("int")
            bit = F.when(F.shiftright(at, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long"))
            word = word.bitwiseOR(bit)
        words.append(word)
    return F.xxhash64(F.lit("block"), key), words


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(block, w0..w3) of the filter of keys (column key), and the number of blocks it is made for."""
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n:
        blocks *= 2
    at, words = _bits(F.col("key"))
    return keys.select(F.pmod(at, F.lit(blocks)).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4))), blocks


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """pages with host, path, rule (its host and path) and verdict."""
    names = fresh(pages, "host", "path", "rule", "verdict")
    host, path = host_path(F.col(url_col).cast("string"))
    rows = pages.withColumn(names[0], host).withColumn(names[1], path)
    urls = rows.select(F.col(names[0]).alias("host"), F.col(names[1]).alias("path")).distinct()

    made = rules.where("host <> ''").select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    made = made.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    depth = made.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - depth + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    made = F.broadcast(made) if at_most(made, BROADCAST_KEYS) else made
    named = urls.where("host <> ''")
    ruled = named.select("host", "path", F.explode(suffixes).alias("suffix")).join(made, F.col("suffix") == F.col("rule_host"))
    ruled = ruled.where(F.col("path").startswith(F.col("rule_path"))).withColumn("rule", F.concat("rule_host", "rule_path"))
    ruled = ruled.select("host", "path", F.struct(F.length("rule").alias("length"), "verdict", "rule").alias("best"), F.lit(False).alias("listed"))

    listed_host, listed_path = host_path(F.col(listed_col).cast("string"))
    keys = listed.select(canonical(listed_host, listed_path).alias("key")).where("key is not null").distinct()
    n = keys.count()
    asked = named.select("host", "path", canonical(F.col("host"), F.col("path")).alias("key"))
    at, words = _bits(F.col("key"))
    table, blocks = bloom(keys, n)
    asked = asked.select("host", "path", "key", F.pmod(at, F.lit(blocks)).alias("block"), *(w.alias(f"m{i}") for i, w in enumerate(words)))
    possible = asked.join(F.broadcast(table) if blocks <= MAX_BLOCKS else table, "block")
    for i in range(4):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    exact = possible.select("host", "path", "key").join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys.hint("shuffle_hash"), "key")
    exact = exact.select("host", "path", F.lit(None).cast("struct<length:int,verdict:string,rule:string>").alias("best"), F.lit(True).alias("listed"))

    h, p, best, is_listed = fresh(rows, "judged_host", "judged_path", "best", "listed")
    verdicts = ruled.union(exact).groupBy(F.col("host").alias(h), F.col("path").alias(p)).agg(F.max("best").alias(best), F.bool_or("listed").alias(is_listed))
    out = rows.join(verdicts, (F.col(names[0]) == F.col(h)) & (F.col(names[1]) == F.col(p)), "left")
    verdict = F.coalesce(F.col(best)["verdict"], F.when(F.coalesce(is_listed, F.lit(False)), "block").otherwise("allow"))
    return out.select(*(F.col(c) for c in rows.columns), F.col(best)["rule"].alias(names[2]), verdict.alias(names[3]))
