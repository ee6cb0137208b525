"""Language identification by Bayesian evidence fusion.

Evidence for each language, as log odds that add up:

* the text: a smoothed model of hashed byte trigrams of every declared
  language, trained here on a bounded sample of distinct declared texts
  (``sample_per_language``);
* the declared language (a markup attribute or a column);
* the address suffix (a country domain or a language directory);
* the host: a prior smoothed hierarchically - host towards domain, domain
  towards the corpus - from grouped sums of the texts' posteriors over all
  documents.

Every document's whole text is scored.  The host sums are a map-side
aggregate, so one host with very many documents costs a row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.llm.common import materialise, schema_with, small_batches, with_column
from wearcast.llm.url_filter import url_parts

BUCKETS = 1 << 16
MAX_LANGUAGES = 512
MAX_BROADCAST_HOSTS = 20_000

#: Address suffixes that speak for a language: country domains, and a first
#: path directory named like the language itself.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, letters and their joints
    only: runs of other characters count as one space."""
    raw = np.frombuffer((text or "").lower().encode("utf-8"), dtype=np.uint8)
    letter = (raw >= 0x80) | ((raw >= 0x61) & (raw <= 0x7A))
    keep = letter | np.append(False, letter[:-1])
    b = np.where(letter, raw, 0x20)[keep].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.uint32)
    return (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)


class Model:
    """Log probabilities by (bucket, language); how foreign a text may look."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5, foreign: float = 0.5):
        self.languages = languages
        total = counts.sum(axis=0)
        self.logp = np.log((counts + smoothing) / (total + smoothing * BUCKETS)).astype(np.float32)
        usual = (counts * self.logp).sum(axis=0) / np.maximum(total, 1)
        unseen = np.log(smoothing / (total + smoothing * BUCKETS))
        self.least = usual + foreign * (unseen - usual)  # mean log probability of a trigram

    def score(self, text: str | None) -> tuple[list[float], int, bool]:
        """(log likelihood by language, trigrams, whether the text looks like
        the best language at all)."""
        g = trigrams(text)
        if not len(g):
            return [0.0] * len(self.languages), 0, False
        total = np.zeros(len(self.languages))
        for at in range(0, len(g), 1 << 18):
            total += self.logp[g[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return total.tolist(), len(g), bool(total[best] / len(g) >= self.least[best])


def _threshold(wanted: int, size: int) -> int:
    """The signed 64-bit number that about ``wanted`` of ``size`` evenly spread
    ones do not exceed."""
    return min((wanted << 64) // size, 1 << 64) - (1 << 63) - 1 if wanted > 0 else -(1 << 63)


def train(docs: DataFrame, text_col: str, declared_col: str, sample_per_language: int = 2000) -> Model | None:
    """Trigram counts of a sample of about ``sample_per_language`` distinct
    texts a language (all where it has no more), chosen by a hash of the text,
    however often each occurs; None when nothing is declared.  Every declared
    language is trained; more than ``MAX_LANGUAGES`` raise."""
    label = F.lower(F.trim(docs[declared_col].cast("string")))
    rows = docs.select(label.alias("language"), docs[text_col].cast("string").alias("text")).where("language IS NOT NULL AND language <> '' AND text IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    sizes = rows.select("language", "hash").distinct().groupBy("language").count().limit(MAX_LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} declared languages")
    languages = sorted(r["language"] for r in sizes)
    highest = F.create_map(*[x for r in sizes for x in (F.lit(r["language"]), F.lit(_threshold(sample_per_language, r["count"])).cast("long"))])
    sampled = rows.where(F.col("hash") <= F.try_element_at(highest, F.col("language")))
    chosen = sampled.groupBy("language", "hash").agg(F.min("text").alias("text")).select("language", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for language, text in zip(b.column(0), b.column(1)):
                held.setdefault(language.as_py(), np.zeros(BUCKETS, dtype=np.int64))
                held[language.as_py()] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for language, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["language", "bucket", "n"])

    sums = chosen.mapInArrow(count, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    counts[sums["bucket"].to_numpy(dtype=np.int64), sums["language"].map(number).to_numpy(dtype=np.int64)] = sums["n"]
    return Model(languages, counts)


def _with_likelihood(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` with ``_text``: struct(ll array<double>, grams long, known)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x MAX_LANGUAGES numbers at most
    kind = pa.struct([("ll", pa.list_(pa.float64())), ("grams", pa.int64()), ("known", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            made = [dict(zip(("ll", "grams", "known"), m.score(t.as_py()))) for t in b.column(b.schema.names.index(text_col))]
            yield with_column(b, "_text", pa.array(made, kind))

    return small_batches(docs).mapInArrow(run, schema_with(docs.schema.fields, "_text", "struct<ll:array<double>,grams:long,known:boolean>"))


def _softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def host_priors(scored: DataFrame, n: int, host_strength: float, domain_strength: float) -> tuple[DataFrame, list[float]]:
    """(host -> prior, corpus prior): grouped sums of text
    posteriors, each level smoothed towards the next."""
    sums = [F.sum(F.element_at("_p", i + 1)).alias(f"n{i}") for i in range(n)]
    hosts = materialise(scored.where("_text.grams > 0").groupBy("_host", "_domain").agg(*sums), "host_languages")
    domains = hosts.groupBy("_domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(n)])
    row = domains.agg(*[F.sum(f"d{i}").alias(f"g{i}") for i in range(n)]).first()
    total = [float(row[i] or 0.0) for i in range(n)]
    corpus = [(x + 1.0) / (sum(total) + n) for x in total]

    def smooth(sums: Column, towards: Column, strength: float) -> Column:
        size = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(sums, towards, lambda x, t: (x + strength * t) / (size + strength))

    spread = F.array(*[F.lit(x) for x in corpus])
    domains = domains.select("_domain", smooth(F.array(*[F.col(f"d{i}") for i in range(n)]), spread, domain_strength).alias("_dp"))
    smoothed = smooth(F.array(*[F.col(f"n{i}") for i in range(n)]), F.col("_dp"), host_strength)
    return hosts.join(domains, "_domain").select("_host", smoothed.alias("_prior")), corpus


def identify(
    docs: DataFrame,
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    url_col: str | None = None,
    model: Model | None = None,
    text_weight: float = 0.2,
    declared_reliability: float = 0.9,
    suffix_reliability: float = 0.8,
    host_strength: float = 20.0,
    domain_strength: float = 50.0,
    min_posterior: float = 0.5,
    accept: list[str] | None = None,
    sample_per_language: int = 2000,
) -> DataFrame:
    """``docs`` with ``language``, ``posterior`` and ``accepted`` after its
    other columns, one row per row.

    A document is accepted when its best language has at least
    ``min_posterior``, is in ``accept`` (default: any trained one), and its
    text has letters and looks like that language at all.  NULL, empty and
    letterless texts have language NULL, posterior 0 and are not accepted, as
    are all documents when nothing is declared to train on.  ``text_weight``
    discounts trigrams, which overlap.  NULL declarations, hosts and urls are
    missing evidence; equal posteriors go to the alphabetically first language.
    Input columns named like an output column are replaced."""
    outputs = ["language", "posterior", "accepted"]
    docs = docs.select(*[c for c in docs.columns if c not in outputs])
    if model is None and declared_col is not None:
        model = train(docs, text_col, declared_col, sample_per_language)
    if model is None:
        return docs.select("*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    languages, n = model.languages, len(model.languages)
    host = F.lit(None).cast("string")
    suffix = F.lit(None).cast("string")
    if url_col is not None:
        host, path = url_parts(docs[url_col])
        folder = F.split_part(path, F.lit("/"), F.lit(2))
        country = F.element_at(F.split(host, r"\."), -1)
        known = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
        suffix = F.coalesce(F.when(folder.isin(languages), folder), F.try_element_at(known, country))
    if host_col is not None:
        host = docs[host_col].cast("string")
    host = F.coalesce(host, F.lit(""))
    domain = F.substring_index(host, ".", -2)
    scored = _with_likelihood(docs.withColumn("_host", host).withColumn("_domain", domain).withColumn("_suffix", suffix), model, text_col)
    ll = F.col("_text.ll")
    scaled = F.transform(ll, lambda x: (x - F.array_max(ll)) * text_weight)
    scored = scored.withColumn("_p", _softmax(scaled))
    priors, corpus = host_priors(scored, n, host_strength, domain_strength)
    if priors.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS:  # else a shuffle join, with its skew split
        priors = F.broadcast(priors)
    joined = scored.join(priors, "_host", "left")

    def evidence(value: Column, reliability: float) -> Column:
        """log P(value | language) up to a constant; no evidence for others."""
        other = (1.0 - reliability) / max(n - 1, 1)
        hit, miss = np.log(reliability).item(), np.log(max(other, 1e-9)).item()
        names = F.array(*[F.lit(x) for x in languages])
        return F.when(value.isin(languages), F.transform(names, lambda x: F.when(x == value, hit).otherwise(miss))).otherwise(F.array_repeat(F.lit(0.0), n))

    declared = F.lower(F.trim(F.col(declared_col).cast("string"))) if declared_col else F.lit(None).cast("string")
    prior = F.coalesce("_prior", F.array(*[F.lit(x) for x in corpus]))
    total = F.zip_with(F.zip_with(F.col("_text.ll"), prior, lambda x, p: x * text_weight + F.log(p)), F.zip_with(evidence(F.col("_declared"), declared_reliability), evidence(F.col("_suffix"), suffix_reliability), lambda x, y: x + y), lambda x, y: x + y)
    fused = joined.withColumn("_declared", declared).withColumn("_total", total)
    top = F.array_max("_total")
    weight = F.aggregate("_total", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    best = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("_total", top).cast("int"))
    has = F.col("_text.grams") > 0
    final = fused.withColumn("language", F.when(has, best)).withColumn("posterior", F.when(has, 1.0 / weight).otherwise(0.0))
    wanted = F.col("language").isin(accept) if accept is not None else F.lit(True)
    accepted = has & F.col("_text.known") & (F.col("posterior") >= min_posterior) & wanted
    return final.withColumn("accepted", accepted).select(*docs.columns, *outputs)


def page_declared(html: Column) -> Column:
    """The language a page's markup declares (``<html lang="de-AT">``: de)."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)), F.lit(""))

