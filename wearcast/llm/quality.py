"""Quality rules, in DataFrame functions only.

Base rules look at one document: its words, symbols, repeated lines and
repeated three-word windows.  The method looks across documents: it hashes
each normalised line, counts the distinct documents of a host that hold it,
removes lines above ``max_docs`` from all of them but the first, and rejects
documents of which too little is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.llm.common import ascii_lower, order_key, words_of

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _repeat_windows(docs: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in three-word windows that occur twice.

    Each window's hash and place are packed into one number (the place takes
    as many low bits as the text needs, the hash the rest) and sorted, so equal
    windows become neighbours; the places found are sorted again and the words
    under them counted once.  Everything is linear or a primitive sort, for
    texts of any length."""
    n = F.size("w")
    hashed = docs.withColumns({
        "hw": F.transform("w", lambda x: F.xxhash64(x)),
        "low": F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1,
    })
    size = F.greatest(n - 2, F.lit(0))
    pairs = F.zip_with(F.slice("hw", 1, size), F.slice("hw", 2, size), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice("hw", 3, size), lambda p, c: F.xxhash64(p, c))
    packed = F.transform(windows, lambda x, i: x.bitwiseAND(F.bitwise_not("low")).bitwiseOR(i.cast("long")))
    ordered = hashed.withColumn("p", F.sort_array(packed))
    less = F.greatest(F.size("p") - 1, F.lit(0))
    same = F.zip_with(F.slice("p", 1, less), F.slice("p", 2, less), lambda a, b: a.bitwiseAND(F.bitwise_not("low")) == b.bitwiseAND(F.bitwise_not("low")))
    paired = ordered.withColumn("same", same)
    edge = F.array(F.lit(False))
    either = F.zip_with(F.concat(edge, "same"), F.concat("same", edge), lambda a, b: a | b)
    places = F.filter(F.zip_with(F.slice("p", 1, size), F.slice(either, 1, size), lambda x, f: F.when(f, x.bitwiseAND(F.col("low")))), lambda x: x.isNotNull())
    found = paired.withColumn("at", F.sort_array(places))
    some = F.greatest(F.size("at") - 1, F.lit(0))
    steps = F.zip_with(F.slice("at", 1, some), F.slice("at", 2, some), lambda a, b: F.least(b - a, F.lit(3).cast("long")))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x) + F.when(F.size("at") > 0, 3).otherwise(0)
    return found.withColumn("n_repeat_words", covered.cast("long")).drop("hw", "low", "p", "same", "at")


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (long) and base_failed.  NULL text: none of anything."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0)
    base = docs.withColumn("_text", text).withColumns({
        "w": words_of(F.col("_text")),
        "lines": lines,
        "word_chars": F.char_length(F.translate("_text", BLANKS, "")).cast("long"),
        "n_symbols": (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long"),
    })
    counted = base.withColumns({
        "n_words": F.size("w").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })
    full = _repeat_windows(counted).drop("w", "lines", "_text")
    return full.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _line_hash(words: Column) -> Column:
    return F.xxhash64(ascii_lower(F.array_join(words, " ")))


def frequent_line_words(docs: DataFrame, text_col: str, id_col: str, host_col: str, max_docs: int, min_line_words: int) -> DataFrame:
    """``(doc_id, text_hash, n_removed_words)`` of documents that lose lines.

    A line counts once for each distinct document (id and text aside, copies
    of one text on one host are one document).  Keys with very many documents
    are pre-aggregated on both steps of the distinct count."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    lines = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    ).withColumn("w", words_of(F.col("line")))
    lines = lines.where(F.size("w") >= min_line_words).select("doc_id", "host", "text_hash", "pos", _line_hash(F.col("w")).alias("line"), F.size("w").cast("long").alias("n"))
    per_text = lines.groupBy("host", "line", "text_hash").agg(F.min(order_key(F.col("doc_id"))).alias("first"))
    frequent = (
        per_text.groupBy("host", "line")
        .agg(F.count("*").alias("texts"), F.min(F.struct("first", "text_hash")).alias("first"))
        .where(F.col("texts") > max_docs)
        .select("host", "line", F.col("first.text_hash").alias("keeper"))
    )
    removed = lines.join(frequent, ["host", "line"]).where("text_hash <> keeper")
    return removed.select("doc_id", "text_hash", "pos", "n").distinct().groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_removed_words"))


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    host_col: str = "source",
    max_docs: int = 20,
    min_line_words: int = 5,
    max_removed: float = 0.7,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.

    ``kept`` is false where the base rules fail or where more than
    ``max_removed`` of the words stood in lines that more than ``max_docs``
    distinct documents of the host hold (lines of fewer than
    ``min_line_words`` words do not count).  The host's first document by id
    keeps such a line.  NULL and empty texts have no words and fail the base
    rules; NULL hosts are one host; repeated rows get equal results; other
    columns are ignored."""
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[host_col].alias("host"), docs[text_col].cast("string").alias("text"))
    base = base_features(slim.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).drop("host")).drop("text")
    removed = frequent_line_words(slim, "text", "doc_id", "host", max_docs, min_line_words)
    removed = removed.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_removed_words")
    joined = base.join(removed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    lost = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (lost <= max_removed * F.col("n_words"))).alias("kept"),
        lost.alias("n_removed_words"),
    )
