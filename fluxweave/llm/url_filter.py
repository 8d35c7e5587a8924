"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Level 1 encodes the listed keys; level 2 the false positives of level 1 among all other keys of the universe; level 3
those of level 2 among the listed keys, and so on until no false positive is left.  A key of the universe is listed
exactly if the first level that rejects it is an even one (or, past the last level, if the number of levels is odd).
Membership then needs no join: the levels are byte strings in the plan, a few bits a listed key.

The universe is the corpus's distinct keys, combined map-side.  A level's size follows the number of keys it encodes;
``max_level_bytes`` is checked before a level is gathered.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (host, path, verdict) in the order given; host "com" stands for every host under it.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Listed keys are the hosts that carry one of these labels; a list from elsewhere is a table of hosts.
LISTED_LABELS = ("casino-win", "cheap-pills", "free-bets", "spam-farm", "ads-track", "adult-x")


def parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", lower).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):  # a longer rule overrides
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _bit(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 64 + k), key), F.lit(bits))


class Level:
    def __init__(self, number: int, keys: DataFrame, count: int, fp: float, max_bytes: int):
        self.number, self.hashes = number, max(1, round(-math.log2(fp)))
        self.bits = 64 * max(1, math.ceil(count * -math.log(fp) / math.log(2) ** 2 / 64))
        if self.bits > 8 * max_bytes:
            raise ValueError(f"level {number} needs {self.bits // 8} bytes; raise max_level_bytes or split the list")
        at = keys.select(F.explode(F.array(*[_bit(F.col("key"), number, k, self.bits) for k in range(self.hashes)])).alias("bit"))
        words = at.groupBy(F.floor(F.col("bit") / 64).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("v")).toArrow()  # max_bytes / 8 rows at most
        data = np.zeros(self.bits // 64, "<i8")
        data[words["i"].to_numpy()] = words["v"].to_numpy()
        self.data = data.tobytes()

    def contains(self, key: Column) -> Column:
        held = F.lit(self.data)
        found = F.lit(True)
        for k in range(self.hashes):
            bit = _bit(key, self.number, k, self.bits)
            byte = F.conv(F.hex(F.substr(held, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            found = found & (F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found


class Cascade:
    """Exact membership over a universe of keys."""

    def __init__(self, universe: DataFrame, *, first_fp: float = 0.05, next_fp: float = 0.5, max_level_bytes: int = 64 << 20, max_levels: int = 64):
        """universe: key string, listed boolean; one row a key."""
        self.levels: list[Level] = []
        inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
        count = inside.count()
        while count and len(self.levels) < max_levels:
            level = Level(len(self.levels) + 1, inside, count, next_fp if self.levels else first_fp, max_level_bytes)
            self.levels.append(level)
            inside, outside = outside.where(level.contains(F.col("key"))), inside
            count = inside.count()
        if count:
            raise ValueError("the cascade did not end")

    def contains(self, key: Column) -> Column:
        listed = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            listed = F.when(level.contains(key), listed).otherwise(F.lit(level.number % 2 == 0))
        return listed


def listed_hosts(labels=LISTED_LABELS) -> Column:
    """Whether a key (a host) carries a listed label."""
    found = F.lit(False)
    for label in labels:
        found = found | F.array_contains(F.split("key", r"\."), label)
    return found


def judge(pages: DataFrame, *, url_col: str = "url", rules=RULES, block_list: DataFrame | None = None, **options) -> DataFrame:
    """All columns of pages with host, path, rule, listed and verdict; ``block_list``: a table of keys (host names)."""
    rows = parts(pages, url_col)
    keys = rows.select(F.col("host").alias("key")).where("key <> ''").distinct()
    if block_list is None:
        universe = keys.withColumn("listed", listed_hosts())
    else:
        universe = keys.join(block_list.select(F.col(block_list.columns[0]).alias("key")).distinct().withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    cascade = Cascade(materialize(universe), **options)
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("listed", (F.col("host") != "") & cascade.contains(F.col("host")))
    return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
