"""Secret scans, in DataFrame functions only.

Named patterns (an assignment to a password-like name, an access key, a long
hexadecimal number) give the base spans.  The method looks at every long token,
in base spans and elsewhere, and asks whether its characters were drawn at random:

* the encoding is inferred as the smallest alphabet that holds the token;
* three tests run on it: chi-squared uniformity over that alphabet, runs of
  character classes (upper, lower, other), and serial correlation of
  neighbouring alphabet positions.  The null hypothesis of each is *ordinary
  text*, at least ``UNEVEN`` away from uniform per character, changing class at
  most half as often as random text, and correlated by ``CORRELATED`` or more;
  so a token too short to tell is never called random;
* the three normal scores are added (Stouffer) and the false discovery rate is
  held at ``fdr`` by the step-up rule of Benjamini and Hochberg, within each
  class of lengths, over all tokens of the corpus.  The rule works on score
  bins of a tenth, each judged at its upper edge, so it needs one small count
  per (length class, bin) and no global ranking.

Spans are in code points.  A text gives one row per match; places are running
sums over those rows, so nothing is quadratic in the matches of a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearcast.llm.common import materialise, text_or_empty

KINDS = ("assign", "access", "hex", "random")
# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGNED = 6
MIN_TOKEN = 16
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (characters as a regular expression class, alphabet), the smallest first
ENCODINGS = (
    ("0-9a-f", _DIGITS + "abcdef"),
    ("0-9A-F", _DIGITS + "ABCDEF"),
    ("A-Z2-7", _UPPER + "234567"),
    ("A-Za-z0-9", _UPPER + _LOWER + _DIGITS),
    ("A-Za-z0-9+/", _UPPER + _LOWER + _DIGITS + "+/"),
    ("A-Za-z0-9_-", _UPPER + _LOWER + _DIGITS + "-_"),
    ("A-Za-z0-9+/_-", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
UNEVEN = 1.0
CORRELATED = 0.4
LENGTHS = (24, 32, 48, 64)
BINS = 120


def change_rate(alphabet: str) -> float:
    """How often neighbours of a random text are of different classes."""
    upper, lower = sum(c in _UPPER for c in alphabet), sum(c in _LOWER for c in alphabet)
    shares = [x / len(alphabet) for x in (upper, lower, len(alphabet) - upper - lower)]
    return round(1 - sum(x * x for x in shares), 6)


def tail(b: int) -> float:
    """P(Z <= -b / 10) of a standard normal Z."""
    return 0.5 * math.erfc(b / 10 / math.sqrt(2))


def _found(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """array of (kind, gap before, match, is one) of all matches in ``text``."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits
    least = ASSIGNED if value_group else 1
    both = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    made = F.transform(both, lambda x: F.struct(F.lit(kind).alias("kind"), F.char_length(x["gap"]).alias("gap"), x["hit"].alias("hit"), (F.char_length(x["value"]) >= least).alias("valid")))
    return F.filter(made, lambda x: x["hit"].isNotNull())


def find_matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, doc_id, k, kind, gap, hit, valid)``: every match in order, and
    one row of NULLs for a text without any.  ``row`` numbers the rows."""
    none = F.array().cast("array<struct<kind:int,gap:int,hit:string,valid:boolean>>")
    base = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    text = F.col("text")
    named = F.when(text.rlike(ASSIGN), _found(text, ASSIGN, 0, 2)).otherwise(none)
    coded = F.concat(_found(text, ACCESS, 1), _found(text, HEX, 2), _found(text, TOKEN, 3))
    listed = base.select("row", "doc_id", F.concat(named, F.when(text.rlike(TOKEN), coded).otherwise(none)).alias("found"))
    each = listed.select("row", "doc_id", F.posexplode_outer("found").alias("k", "m"))
    return each.select("row", "doc_id", "k", "m.kind", "m.gap", "m.hit", "m.valid")


def scores(token: Column) -> dict[str, Column]:
    """Column steps, in order, from a token to its combined score ``z`` (NULL
    for a NULL token); low means random."""
    pick, rate = F, F
    for chars, alphabet in ENCODINGS:
        fits = token.rlike(f"^[{chars}]+$")
        pick, rate = pick.when(fits, F.lit(alphabet)), rate.when(fits, F.lit(change_rate(alphabet)))
    n, sx, sxx, sxy = (F.col(c).cast("double") for c in ("n", "sx", "sxx", "sxy"))
    k = F.char_length("alphabet").cast("double")
    counts = F.transform(F.split("alphabet", ""), lambda c: (F.col("n") - F.char_length(F.replace(token, c, F.lit("")))).cast("long"))
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[A-Z]+", "A"), "[a-z]+", "a"), "[^A-Za-z]+", "0")
    chi2, shift = k / n * F.col("squares").cast("double") - n, n * UNEVEN
    half = F.col("rate") / 2
    spread = n * sxx - sx * sx
    r = F.when(spread == 0, F.lit(1.0)).otherwise((n * sxy - sx * sx) / F.when(spread != 0, spread))
    return {
        "alphabet": pick, "rate": rate, "n": F.char_length(token),
        "squares": F.aggregate(counts, zero, lambda a, x: a + x * x),
        "changes": F.char_length(classes) - 1,
        "x": F.transform(F.split(token, ""), lambda c: F.position(c, F.col("alphabet")).cast("long")),
        "sx": F.aggregate("x", zero, add),
        "sxx": F.aggregate("x", zero, lambda a, x: a + x * x),
        "sxy": F.aggregate(F.zip_with("x", F.concat(F.slice("x", F.lit(2), F.col("n") - 1), F.slice("x", 1, 1)), lambda a, b: a * b), zero, add),
        "uniform": (chi2 - (k - 1 + shift)) / F.sqrt(2 * (k - 1 + 2 * shift)),
        "runs": ((n - 1) * half - F.col("changes")) / F.sqrt((n - 1) * half * (1 - half)),
        "serial": (F.abs(r) - CORRELATED) * F.sqrt(n),
        "z": (F.col("uniform") + F.col("runs") + F.col("serial")) / F.sqrt(F.lit(3.0)),
    }


def length_class(n: Column) -> Column:
    return sum((F.when(n >= x, 1).otherwise(0) for x in LENGTHS), F.lit(0))


def _placed(matches: DataFrame) -> DataFrame:
    """Matches and tokens with their start and end."""
    before = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.col("size")).over(before) - F.col("size")
    return matches.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))


def thresholds(tokens: DataFrame, fdr: float) -> DataFrame:
    """``(class, least)``: per length class the lowest accepted score bin, from
    the counts of ``tokens(class, bin)``; at most classes x bins rows."""
    counts = tokens.groupBy("class", "bin").count()
    down = Window.partitionBy("class").orderBy(F.desc("bin"))
    edges = F.element_at(F.array(*[F.lit(tail(b)) for b in range(BINS + 1)]), F.col("bin") + 1)
    ranked = counts.select("class", "bin", F.sum("count").over(down).alias("above"), F.sum("count").over(Window.partitionBy("class")).alias("m"), edges.alias("p"))
    return ranked.where(F.col("p") * F.col("m") <= fdr * F.col("above")).groupBy("class").agg(F.min("bin").alias("least"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01) -> DataFrame:
    """``(doc_id, spans)``, one row per row of ``docs``: spans are (start, end,
    kind, place) by start, then place (the kind's number), in code points, end
    exclusive.  Kinds are ``KINDS``; spans of different kinds may overlap, so a
    base span with a ``random`` one inside is confirmed by the tests.

    NULL, empty and blank texts have no spans.  Repeated rows give repeated
    results and count as tokens each time; NULL ids stay NULL; an empty table
    gives none; other columns are ignored."""
    matches = find_matches(docs, id_col, text_col)
    token = F.when(F.col("kind") == 3, F.col("hit"))
    for name, step in scores(token).items():
        matches = matches.withColumn(name, step)
    bins = F.least(F.greatest(F.floor(-10 * F.col("z")), F.lit(0)), F.lit(BINS)).cast("int")
    slim = matches.select("row", "doc_id", "k", "kind", "gap", F.char_length("hit").alias("size"), "valid", length_class(F.col("n")).alias("class"), bins.alias("bin"))
    placed = materialise(_placed(materialise(slim, "secret_matches")), "secret_spans")
    least = thresholds(placed.where("kind = 3").select("class", "bin"), fdr)
    kept = placed.join(F.broadcast(least), "class", "left")  # one row a length class
    stays = F.col("valid") & ((F.col("kind") < 3) | (F.col("bin") >= F.col("least")))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct(F.col("start").alias("start"), F.col("kind").alias("place"), F.col("end").alias("end"), name.alias("kind"))
    return kept.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.when(stays, span))).alias("spans")).select("doc_id", "spans")
