"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is removed when an earlier line of the corpus lies within one word edit
of it (a word replaced, inserted or deleted) or equals it.  "Earlier" is by
(doc_id, hash of the text, line number).  Lines are compared lower-cased, as words separated by
ASCII white space; lines of fewer than ``min_words`` words, and blank
ones, always stay.

1. Equal lines collapse to one row with their earliest place.
2. Of two lines within one edit, the longer one having L words, the first or
   the last half of L - 1 words is the same.  Each line offers the hashes of
   these halves for L its own length and one more; a line none of whose halves
   is offered by a different line has no neighbour and leaves here.
3. Each remaining line emits, for the halves it shares, its deletion variants
   as hashed keys: as the shorter line itself, and as the longer one the line
   without each word of the other half - once with the word's place (two lines
   that differ in that word only) and once without (a line with one word
   less).  Only here the words are read again, from the documents; the tables
   of lines hold hashes.
4. Equal keys meet in one map-side aggregate that keeps each key's earliest
   line, so a key shared by very many lines costs one row per task, and no
   pairs are made.  A line whose key has an earlier line is compared with it
   word by word (the edit distance itself, not its hash) before it goes.

The rule looks at all earlier lines, kept or not, so it does not depend on the
order of work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.llm.common import materialise, order_key, text_or_empty

FULL, REPLACED, LONGER = 0, 1, 2


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text); a NULL text is empty."""
    text = text_or_empty(docs, text_col)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _with_spaced(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the column spaced: ``text`` lower-cased, with single spaces between words."""
    lower = F.col("_lower")
    odd = [F.contains(lower, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")]  # most texts need no pattern
    spaced = F.when(reduce(Column.__or__, odd), F.regexp_replace(lower, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")).otherwise(lower)
    return df.withColumn("_lower", F.lower(text)).withColumn("spaced", spaced).drop("_lower")


def _n_words(norm: Column) -> Column:
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def _words(norm: Column, count: Column) -> Column:
    """The first ``count`` words of a line, or its last for a negative count."""
    return F.call_function("substring_index", norm, F.lit(" "), count)


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc_id, text_hash, pos, lid, halves): the lines long enough to compare, by a
    128-bit hash of their words."""
    texts = _texts(docs, id_col, text_col)
    spaced = _with_spaced(texts, F.col("text")).select("doc_id", "text_hash", "spaced")
    raw = spaced.select("doc_id", "text_hash", F.posexplode(F.split("spaced", "\n")).alias("pos", "line"))
    norm = raw.select("doc_id", "text_hash", "pos", F.btrim("line").alias("norm")).where("norm <> ''")
    fewer = _words(F.col("norm"), F.lit(max(min_words - 1, 0)))  # the whole line if it has fewer words than needed
    words = norm.where(F.octet_length(fewer) < F.octet_length("norm")).withColumn("n", _n_words(F.col("norm")))
    return words.select("doc_id", "text_hash", "pos", F.unhex(F.md5("norm")).alias("lid"), _halves(F.col("norm"), F.col("n")).alias("halves"))


def _place() -> Column:
    """A line's order: by document (id and text), then by line number."""
    return order_key(F.col("doc_id"), F.col("text_hash"), F.col("pos"))


def _halves(norm: Column, n: Column) -> Column:
    """Hashes of the halves a neighbour would share: first and last, for the
    longer line of the pair having n words, then n + 1."""

    def keys(longer: Column) -> list[Column]:
        h = F.floor((longer - 1) / 2).cast("int")
        return [F.xxhash64(F.lit(0), longer, _words(norm, h)), F.xxhash64(F.lit(1), longer, _words(norm, -h))]

    return F.array(*keys(n), *keys(n + 1))


def _variants(lines: DataFrame) -> DataFrame:
    """(lid, first, role, at, key) for the deletion variants of ``lines``, whose
    ``shared`` tells where another line offers the same half: its place, and
    whether a line of equal length or one word shorter does."""
    n = F.col("n")
    half = F.floor((n - 1) / 2).cast("int")  # shared first: the edit is behind it; shared last: before it
    none = F.array().cast("array<struct<role:int,at:int>>")

    def places(role: int, other: str) -> Column:
        def side(place: int, start: Column, stop: Column) -> Column:
            wanted = F.exists("shared", lambda x: (x["place"] == place) & x[other])
            return F.when(wanted, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))

        either = F.array_union(side(0, half, n - 1), side(1, F.lit(0), n - half - 1))
        return F.transform(either, lambda i: F.struct(F.lit(role).alias("role"), i.cast("int").alias("at")))

    shorter = F.exists("shared", lambda x: x["place"] >= 2)
    whole = F.when(shorter, F.array(F.struct(F.lit(FULL).alias("role"), F.lit(-1).alias("at")))).otherwise(none)
    made = F.concat(whole, places(REPLACED, "equal"), places(LONGER, "shorter"))
    rows = lines.withColumn("n", _n_words(F.col("norm"))).withColumn("made", made).select("lid", "first", "norm", "n", F.inline("made"))
    norm, role, at = F.col("norm"), F.col("role"), F.col("at")
    rest = F.btrim(F.concat(_words(norm, at), F.lit(" "), _words(norm, at - n + 1)))
    key = F.when(role == FULL, F.xxhash64(norm)).when(role == REPLACED, F.xxhash64(rest, at)).otherwise(F.xxhash64(rest))
    return rows.select("lid", "first", "role", "at", key.alias("key"))


def _within_one_edit(role: Column, a: Column, at: Column, b: Column, b_at: Column) -> Column:
    """Whether the claimed edit turns the words ``a`` into ``b``."""

    def without(w: Column, i: Column) -> Column:
        return F.concat(F.slice(w, 1, i), F.slice(w, i + 2, F.size(w)))

    same = F.size(a) == F.size(b)
    return (
        F.when(role == REPLACED, same & (without(a, at) == without(b, at)))
        .when(role == LONGER, without(a, at) == b)
        .otherwise(without(b, b_at) == a)
    )


def removed_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = 5, max_edits: int = 1) -> DataFrame:
    """``(doc_id, text_hash, pos, near)``: the lines that go, ``near`` telling
    whether the earlier line differs by an edit (True) or only an equal one is
    earlier.  ``text_hash`` is xxhash64 of the document's text."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    lines = materialise(_lines(docs, id_col, text_col, min_words), "lines")
    distinct = materialise(
        lines.groupBy("lid").agg(
            F.min(_place()).alias("first"),
            F.count("*").alias("copies"),
            F.first("halves").alias("halves"),
        ),
        "distinct_lines",
        release=True,
    )
    near = _near(_texts(docs, id_col, text_col), distinct) if max_edits else distinct.select("lid").limit(0)
    marked = (
        distinct.select("lid", "first", "copies")
        .join(near.withColumn("near", F.lit(True)), "lid", "left")
        .where("near OR copies > 1")
        .select("lid", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    out = lines.select("doc_id", "text_hash", "pos", "lid").join(marked, "lid").where(F.col("near") | (_place() != F.col("first")))
    return out.select("doc_id", "text_hash", "pos", "near")


def _with_words(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (lid, first, shared) with the line itself, ``norm``, read
    from the document it is first in."""
    by_doc = wanted.groupBy(F.col("first.doc_id").alias("in_doc"), F.col("first.text_hash").alias("in_text")).agg(F.collect_list(F.struct("lid", "first", "shared")).alias("here"))
    mine = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("text_hash") == F.col("in_text"))
    found = _with_spaced(texts.join(by_doc, mine).select("here", "text"), F.col("text")).select("here", F.split("spaced", "\n").alias("lines"))
    rows = found.select(F.inline(F.transform("here", lambda x: F.struct(x["lid"].alias("lid"), x["first"].alias("first"), x["shared"].alias("shared"), F.btrim(F.get("lines", x["first"]["pos"])).alias("norm")))))
    return rows.groupBy("lid").agg(F.first("first").alias("first"), F.first("norm").alias("norm"), F.first("shared").alias("shared"))  # rows may repeat


def _near(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(lid): distinct lines with an earlier line one word edit away."""
    halves = distinct.select("lid", F.posexplode("halves").alias("place", "key"))
    longer = F.count_if(F.col("place") < 2)
    met = halves.groupBy("key").agg(longer.alias("longer"), (F.count("*") - longer).alias("shorter")).where("longer > 1 OR (longer = 1 AND shorter > 0)")
    here = F.struct("place", (F.col("longer") > 1).alias("equal"), (F.col("shorter") > 0).alias("shorter"))
    shared = halves.join(met, "key").groupBy("lid").agg(F.collect_list(here).alias("shared"))  # four at most
    wanted = materialise(distinct.select("lid", "first").join(shared, "lid"), "shared_halves", release=True)
    lines = materialise(_with_words(texts, wanted), "near_lines", release=True)

    variants = materialise(_variants(lines), "variants")
    line = F.struct("first", "lid", "at")
    earliest = variants.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, line)).alias(f"m{r}") for r in (FULL, REPLACED, LONGER)])
    partner = F.when(F.col("role") == REPLACED, F.col(f"m{REPLACED}")).when(F.col("role") == LONGER, F.col(f"m{FULL}")).otherwise(F.col(f"m{LONGER}"))
    claims = (
        variants.join(earliest, "key")
        .select("lid", "first", "role", "at", partner.alias("p"))
        .where(F.col("p.first") < F.col("first"))
        .select("lid", "role", "at", F.col("p.lid").alias("other"), F.col("p.at").alias("other_at"))
    )
    words = lines.select("lid", F.split("norm", " ").alias("w"))
    checked = (
        claims.join(words, "lid")
        .join(words.select(F.col("lid").alias("other"), F.col("w").alias("other_w")), "other")
        .where(_within_one_edit(F.col("role"), F.col("w"), F.col("at"), F.col("other_w"), F.col("other_at")))
    )
    return materialise(checked.select("lid").distinct(), "repeated_lines", release=True)


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = 5, max_edits: int = 1) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text_col`` and the columns
    ``n_lines`` and ``n_removed`` (long) after the others.

    Every row stays; a text without removed lines is unchanged, one that loses
    all its lines becomes empty.  A NULL text stays NULL and has no lines; an
    empty text has one (blank) line.  Documents are known by (id, xxhash64 of
    the text): rows with the same id and text are one document and lose the
    same lines, other rows lose only their own; NULL ids are ordered last.  Columns of the input
    named n_lines or n_removed are replaced; others pass through."""
    gone = removed_lines(docs, text_col, id_col, min_words, max_edits).groupBy(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).agg(F.collect_set("pos").alias("_gone"))
    text = F.col(text_col)
    n_lines = F.when(text.isNull(), 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    mine = docs[id_col].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(text_or_empty(docs, text_col)) == gone["_gone_hash"])
    joined = docs.drop("n_lines", "n_removed").join(gone, mine, "left")
    counted = joined.withColumns({"n_lines": n_lines, "_lines": F.when(F.col("_gone").isNotNull(), F.split(text, "\n"))})
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    cut = counted.withColumn("_stay", F.when(F.col("_lines").isNotNull(), stay))
    n_removed = F.when(F.col("_stay").isNotNull(), F.col("n_lines") - F.size("_stay")).otherwise(0).cast("long")
    kept = F.array_join(F.transform("_stay", lambda i: F.get(F.col("_lines"), i)), "\n")
    return (
        cut.withColumn("n_removed", n_removed)
        .withColumn(text_col, F.when(F.col("n_removed") > 0, kept).otherwise(text))
        .drop("_gone", "_gone_id", "_gone_hash", "_lines", "_stay")
    )
