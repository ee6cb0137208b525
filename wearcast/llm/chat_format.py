"""Chat formatting with typed content parts, in DataFrame functions only.

A turn holds parts of a kind (text, image, audio, document).  A visitor walks
the parts in order: text is escaped and kept; any other part becomes a
placeholder ``<|kind:turn.part|>`` in its place and is recorded as an
attachment with its reference and the number of tokens it expands to.

    <|im_start|>role\\n text and placeholders <|im_end|>\\n

Escaping is reversible and leaves no control string in a text: ``<`` followed
by any number of backslashes and ``|`` gets one backslash more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
END_PATTERN = r"<\|im_end\|>\n"
PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"

#: Tokens that one unit of an attachment expands to: image patches, seconds of
#: audio, document pages (a parameter).
TOKENS_PER_UNIT = {"image": 1.0, "audio": 25.0, "document": 600.0}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """A plain text as its only part (NULL: an empty text)."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text.cast("string"), F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("double").alias("units"),
        )
    ).cast(PARTS)


def _placeholder(kind: Column, turn: Column, part: Column) -> Column:
    return F.concat(F.lit("<|"), F.regexp_replace(kind, "[^a-z_]", "_"), F.lit(":"), turn.cast("string"), F.lit("."), part.cast("string"), F.lit("|>"))


#: A mark and what follows it stand for a mark of the text's own, and for the
#: two ends of a placeholder, while a body is put together.
MARK = "\x01"
OWN, OPEN, CLOSE = MARK + "a", MARK + "b", MARK + "c"


def _body(turn: Column, i: Column) -> Column:
    """The visitor: parts in order, as escaped text and placeholders.

    Texts are joined before they are escaped, so a control string that is
    split over several parts is escaped like any other; the placeholders
    between them are marked until then."""
    parts = F.coalesce(turn["parts"], F.array().cast(PARTS))

    def part(p: Column, j: Column) -> Column:
        inner = F.substr(_placeholder(p["kind"], i, j), F.lit(3))
        marked = F.concat(F.lit(OPEN), F.substring_index(inner, "|>", 1), F.lit(CLOSE))
        text = F.replace(F.coalesce(p["text"], F.lit("")), F.lit(MARK), F.lit(OWN))
        return F.when(F.coalesce(p["kind"], F.lit("text")) == "text", text).otherwise(marked)

    body = escape(F.array_join(F.transform(parts, part), ""))
    for mark, text in ((OPEN, "<|"), (CLOSE, "|>"), (OWN, MARK)):
        body = F.replace(body, F.lit(mark), F.lit(text))
    return body


def _attachments(turns: Column, rates: dict[str, float]) -> Column:
    rate = F.lit(0.0)
    rates_map = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v))]) if rates else None

    def visit(t: Column, i: Column) -> Column:
        def part(p: Column, j: Column) -> Column:
            per = F.coalesce(F.try_element_at(rates_map, p["kind"]), rate) if rates else rate
            return F.when(
                F.coalesce(p["kind"], F.lit("text")) != "text",
                F.struct(
                    _placeholder(p["kind"], i, j).alias("placeholder"),
                    p["kind"].alias("kind"),
                    p["ref"].alias("ref"),
                    F.ceil(F.coalesce(p["units"], F.lit(0.0)) * per).cast("long").alias("tokens"),
                ),
            )

        return F.filter(F.transform(F.coalesce(t["parts"], F.array().cast(PARTS)), part), lambda a: a.isNotNull())

    return F.flatten(F.transform(turns, visit))


CHUNK = 256


def _running(first: Column, sizes: Column) -> Column:
    """``first`` and the running sums after it, one more than ``sizes``."""
    return F.aggregate(sizes, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _with_starts(df: DataFrame) -> DataFrame:
    """Adds ``starts``: the sum of the ``sizes`` before each place.  A running
    sum copies what it has at every step, so it runs over chunks, and over the
    chunks' totals.  Each array is a column of its own: what a function of
    elements refers to is computed anew for each element otherwise."""
    last = F.floor((F.size("sizes") - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("sizes", b * CHUNK + 1, F.lit(CHUNK)))
    cut = df.withColumn("chunks", chunks)
    totals = F.transform("chunks", lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n))
    summed = cut.withColumn("offsets", _running(F.lit(0).cast("long"), totals))
    inner = F.zip_with("chunks", F.slice("offsets", F.lit(1), F.size("chunks")), lambda c, o: F.slice(_running(o, c), F.lit(1), F.size(c)))
    return summed.withColumn("starts", F.flatten(inner)).drop("sizes", "chunks", "offsets")


def format_conversations(rows: DataFrame, parts_col: str = "parts", rates: dict[str, float] | None = None) -> DataFrame:
    """One row per ``conv_id``: ``formatted`` (string), ``loss`` (array of
    start and length, in characters of ``formatted``, of each assistant turn's
    text), ``attachments`` (placeholder, kind, ref, tokens, in order) and
    ``n_tokens_attached``.

    ``rows`` has conv_id, turn, role and ``parts_col``; other columns are
    ignored.  Turns are ordered by (turn, role, parts), NULL first, so ties
    are settled by content; repeated rows are repeated turns.  NULL roles,
    parts and texts are empty; rows with a NULL conv_id form one conversation.
    A conversation is one string, so its turns meet in one row by nature; it
    must fit one task, however long."""
    rates = TOKENS_PER_UNIT if rates is None else rates
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col(parts_col).cast(PARTS).alias("parts"))
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t, i: F.struct(F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)).alias("role"), _body(t, i).alias("body"), (t["role"] == "assistant").alias("loss")),
        ).alias("made"),
        _attachments(F.col("turns"), rates).alias("attachments"),
    )
    frame = len(START) + 1 + len(END)
    sizes = F.transform("made", lambda m: (F.char_length(m["role"]) + F.char_length(m["body"]) + frame).cast("long"))
    placed = _with_starts(made.withColumn("sizes", sizes))

    def span(m: Column, start: Column) -> Column:
        at = start + len(START) + 1 + F.char_length(m["role"])
        return F.when(m["loss"], F.struct(at.alias("start"), F.char_length(m["body"]).cast("long").alias("length")))

    spans = F.filter(F.zip_with("made", "starts", span), lambda s: s.isNotNull())
    text = F.array_join(F.transform("made", lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["body"], F.lit(END))), "")
    return placed.select(
        "conv_id",
        text.alias("formatted"),
        spans.alias("loss"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens_attached"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped; placeholders
    stay in their text."""
    chunks = F.split(formatted, END_PATTERN)
    turns = F.slice(chunks, 1, F.size(chunks) - 1)

    def turn(c: Column) -> Column:
        inner = F.substring(c, len(START) + 1, 1 << 30)
        role = F.substring_index(inner, "\n", 1)
        text = F.substr(inner, F.char_length(role) + 2)
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
