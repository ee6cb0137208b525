"""URL filters by a Bloom filter cascade, in DataFrame functions only.

The keys of a url are what a list entry can name: every suffix of its host at
a label boundary joined with the start of its path (for ``host/path`` rules),
and every word of its host (for word lists).  The corpus's complete key
universe is one distinct aggregate over all urls.

A cascade answers exact membership for that universe: level 1 is a Bloom
filter of the listed keys, level 2 one of the unlisted keys that pass level 1,
level 3 of the listed keys that pass level 2, and so on until nothing passes
wrongly.  A level is an array of 64-bit words that reaches the tasks as a
scalar subquery, so judging a url needs no join.  The filters grow with the
list and with the logarithm of the corpus; a level beyond ``max_bits`` raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.llm.common import ascii_lower, materialise

#: Host words that the default list blocks (a parameter of ``judge_urls``).
BLOCKED_WORDS = ("ads", "adserver", "bet", "bets", "casino", "pills", "porn", "spam", "track", "tracker", "viagra", "xxx")

FIRST = (10.0, 7)  # bits a key, hashes: about 1 in 100 unlisted keys pass
LATER = (2.0, 1)  # about 2 in 5 pass


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased; path from there up to ``?``, ``#`` or the end.
    Both empty without ``://`` or for NULL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """The rules that could fit a url: host suffixes joined with path starts
    of the listed lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(
        F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]).cast("array<string>"),
        lambda s: s.isNotNull(),
    )
    return F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda s: F.concat(h, s))))


class Level:
    """One Bloom filter: ``bits`` positions held as 64-bit words."""

    def __init__(self, number: int, keys: DataFrame, count: int, max_bits: int):
        per_key, self.hashes = FIRST if number == 1 else LATER
        self.number, self.words = number, max(1, -(-int(count * per_key) // 64))
        if self.words * 64 > max_bits:
            raise ValueError(f"level {number} needs {self.words * 64} bits; max_bits is {max_bits}")
        spot = keys.select(F.explode(F.array(*[self._spot(F.col("key"), j) for j in range(self.hashes)])).alias("spot"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("spot") % 64).cast("int"))
        held = spot.select(F.floor(F.col("spot") / 64).cast("long").alias("i"), bit.alias("bit"))
        zero = keys.sparkSession.range(self.words).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("bit"))
        words = held.unionByName(zero).groupBy("i").agg(F.bit_or("bit").alias("word"))
        self.table = materialise(words, f"bloom_{number}")

    def _spot(self, key: Column, j: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.number), F.lit(j), key), F.lit(self.words * 64).cast("long"))

    def passes(self, key: Column) -> Column:
        words = self.table.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])).scalar()
        out = F.lit(True)
        for j in range(self.hashes):
            spot = self._spot(key, j)
            word = F.element_at(words, (F.floor(spot / 64) + 1).cast("int"))
            out = out & (F.getbit(word, (spot % 64).cast("int")) == 1)
        return out


class Cascade:
    """Exact membership of ``listed(key)`` among the keys of ``universe(key)``."""

    def __init__(self, universe: DataFrame, listed: DataFrame, max_bits: int = 1 << 27, max_levels: int = 64):
        listed = materialise(listed.select("key").where("key IS NOT NULL").distinct(), "listed")
        others = materialise(universe.select("key").join(listed, "key", "left_anti"), "unlisted")
        self.levels: list[Level] = []
        count = listed.count()
        while count:
            if len(self.levels) == max_levels:
                raise RuntimeError(f"false positives remain after {max_levels} levels")
            level = Level(len(self.levels) + 1, listed, count, max_bits)
            self.levels.append(level)
            listed, others = materialise(others.where(level.passes(F.col("key"))), "false_positives"), listed
            count = listed.count()

    def has(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.passes(key) & ~out
        return out


def judge_urls(
    pages: DataFrame,
    block_rules: DataFrame,
    allow_rules: DataFrame,
    block_words: DataFrame,
    url_col: str = "url",
    max_bits: int = 1 << 27,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` after its
    other columns, one row per row.

    ``block_rules`` and ``allow_rules`` have a ``rule`` string ``host/path``: a
    rule fits the host and all its subdomains where the url's path starts with
    the rule's; of the rules that fit, the longest gives the verdict (block
    before allow when equal).  Without a rule, a host with a word of
    ``block_words(word)`` is blocked and any other allowed.  NULL, empty and
    malformed urls have empty parts and are allowed.  NULL list entries are
    ignored.  Input columns named like an output column are replaced."""
    outputs = ["host", "path", "rule", "verdict"]
    rules = block_rules.select("rule").unionByName(allow_rules.select("rule")).where("rule IS NOT NULL")
    longest = F.char_length("rule") - F.char_length(F.substring_index("rule", "/", 1))
    lengths = sorted(r[0] for r in rules.select(longest).distinct().collect())  # at most the longest rule path
    host, path = url_parts(pages[url_col])
    kept = [c for c in pages.columns if c not in outputs]
    parts = pages.select(F.struct(*kept).alias("_row"), host.alias("host"), path.alias("path")).withColumn("_id", F.monotonically_increasing_id())

    def typed(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.concat(F.lit(kind), k))

    words = F.filter(F.split("host", "[^a-z0-9]+"), lambda w: w != "")
    keys = F.array_distinct(F.concat(typed("r", rule_keys(F.col("host"), F.col("path"), lengths)), typed("w", words)))
    universe = materialise(parts.select(F.explode(keys).alias("key")).distinct(), "url_keys")
    listed = block_rules.select(F.concat(F.lit("r"), "rule").alias("key")).unionByName(block_words.select(F.concat(F.lit("w"), "word").alias("key")))
    block = Cascade(universe, listed, max_bits)
    allow = Cascade(universe, allow_rules.select(F.concat(F.lit("r"), "rule").alias("key")), max_bits)

    key = F.col("key")
    judged = parts.select("_id", "_row", "host", "path", F.explode_outer(keys).alias("key")).select(
        "_id", "_row", "host", "path", "key", block.has(key).alias("blocked"), allow.has(key).alias("allowed"))
    rule = F.when(key.startswith("r") & (F.col("blocked") | F.col("allowed")), F.struct(
        F.char_length("key").alias("n"), F.substring("key", 2, 1 << 30).alias("rule"), F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict")))
    best = judged.groupBy("_id").agg(
        F.first("_row").alias("_row"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(rule).alias("best"), F.max(F.when(key.startswith("w"), F.col("blocked")).otherwise(False)).alias("word"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("word"), "block").otherwise("allow"))
    return best.select("_row.*", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
