"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for every text and language:

* the text: likelihood of its byte trigrams under one model per language, fitted on a bounded
  sample of labelled documents (about ``FIT_DOCS`` per language, those with the smallest hashes);
* the declared language (a column, or the ``lang`` attribute of the text's own markup): how often
  each declaration goes with each language, counted over all rows by what their text says;
* the address suffix (the last label of the host), counted in the same way;
* the host: a prior from all its other texts, smoothed towards that of its parent domain, which is
  smoothed towards that of the whole table.

All counts are grouped aggregates over all rows (a row's own share is taken out of its host's), so
a hot host costs no more than a rare one.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import frugal, slices, written

#: Labelled documents per language, about, whose whole texts the models are fitted on.
FIT_DOCS = 400
BUCKETS = 1 << 14
#: Trigrams beyond which a text's likelihood weighs no more: neighbours in a text aren't independent.
FULL_WEIGHT = 40
#: Pseudo-counts of the parent when a host or domain is estimated, and of every table cell.
PARENT_WEIGHT, CELL_WEIGHT = 5.0, 1.0
#: Rows whose best language has a smaller probability are rejected.
LEAST_CONFIDENCE = 0.5
#: A table of declarations or suffixes up to this size is broadcast, a larger one joined by shuffle.
BROADCAST_VALUES = 10_000

_HTML = re.compile(rb"<html(?=[\s>])([^>]*)", re.I)
_LANG = re.compile(rb"\slang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_OPEN = re.compile(rb"<(?:(script|style)\b|(!--)|[a-z/!])", re.I)
_CLOSE = {kind: re.compile(end, re.I) for kind, end in ((b"script", rb"</script\s*>"), (b"style", rb"</style\s*>"), (b"!--", rb"-->"), (b"", rb">"))}
_BLANK = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def trigram_buckets(text: bytes) -> np.ndarray:
    """Buckets of the trigrams of the letters; other characters count as one space in a run."""
    data = b" ".join(text.translate(_BLANK).split())
    if not data:
        return np.zeros(0, np.int64)
    x = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    mixed = (x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:]
    return ((mixed * np.uint32(2654435769)) >> np.uint32(18)).astype(np.int64)


def declared_in(text: bytes | None) -> str | None:
    """The lang attribute of the text's first html tag, wherever it stands."""
    tag = _HTML.search(text or b"")
    found = tag and _LANG.search(tag[1])
    return found[1].decode().lower() if found else None


def visible(text: bytes) -> bytes:
    """Text without tags, comments, scripts and styles.  One pass: an end that is missing once is not
    looked for again, and what has no end of its kind goes up to the next ``>``."""
    kept, at, missing = [], 0, set()
    while b"" not in missing and (found := _OPEN.search(text, at)):
        for kind in ((found[1] or found[2] or b"").lower(), b""):
            close = None if kind in missing else _CLOSE[kind].search(text, found.end())
            if close:
                kept.append(text[at : found.start()])
                at = close.end()
                break
            missing.add(kind)
    kept.append(text[at:])
    return b" ".join(kept)


class TextModel:
    """Log likelihoods of trigram buckets, one row per language."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, np.ascontiguousarray(log_p.T)

    def posterior(self, text: bytes | None) -> np.ndarray:
        """Probabilities by the text alone; even ones where it has no letters."""
        grams = trigram_buckets(visible(text or b""))
        if not len(grams):
            return np.full(len(self.languages), 1 / len(self.languages))
        score = self.log_p[grams].mean(axis=0) * min(len(grams), FULL_WEIGHT)
        p = np.exp(score - score.max())
        return p / p.sum()


def fit(labelled: DataFrame, docs_per_language: int = FIT_DOCS) -> TextModel:
    """Fit on (doc_id, text, lang) rows with a label and a text: per language the rows whose hash is
    below a threshold that takes ``docs_per_language`` of them on average (all, where there are no more).

    The trigram buckets of their whole texts are counted by a grouped sum; the driver gets one number
    per language and bucket."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) / float(1 << 63)
    usable = labelled.where("lang is not null and text is not null").select("lang", place.alias("place"), F.col("text").cast("binary").alias("text"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per label
    languages = sorted(sizes)
    counts = np.zeros((max(1, len(languages)), BUCKETS))
    if languages:
        bounds = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / sizes[k]))))
        chosen = usable.where(F.col("place") <= F.element_at(bounds, F.col("lang"))).select("lang", "text")
        number = {language: k for k, language in enumerate(languages)}
        sums = chosen.mapInArrow(frugal(_trigram_counts), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        of = np.array([number[x] for x in sums.column("lang").to_pylist()], np.int64)
        counts[of, sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    smooth = counts + 0.05 + 2.0 * counts.sum(axis=0) / max(1.0, counts.sum())
    return TextModel(languages or ["und"], np.log(smooth / smooth.sum(axis=1, keepdims=True)))


def _trigram_counts(batches):
    """(lang, text) -> (lang, bucket, n), summed over each part of a task's rows."""
    for batch in batches:
        for part in slices(batch, 1):
            sums: dict[str, np.ndarray] = {}
            for language, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                sums.setdefault(language, np.zeros(BUCKETS, np.int64))
                sums[language] += np.bincount(trigram_buckets(visible(text)), minlength=BUCKETS)
            for language, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


def text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """Replace the column text (the last) by p_text (array<double>), markup (the lang attribute of
    its markup or null) and has_letters."""
    names = [c for c in rows.columns if c != "text"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                p = [model.posterior(t) for t in texts]
                found = [declared_in(t) for t in texts]
                letters = [any(x) for x in ((t or b"").translate(None, bytes(c for c in range(128) if not chr(c).isalpha()))[:1] for t in texts)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(p, pa.list_(pa.float64())), pa.array(found, pa.string()), pa.array(letters, pa.bool_())],
                    [*names, "p_text", "markup", "has_letters"],
                )

    return rows.select(*names, F.col("text").cast("binary").alias("text")).mapInArrow(frugal(run), f"{shape}, p_text array<double>, markup string, has_letters boolean")


def _sums(size: int) -> list[Column]:
    return [F.sum(F.col("p_text")[k]).alias(f"s{k}") for k in range(size)]


def _given_language(rows: DataFrame, column: str, size: int) -> tuple[DataFrame, list[float]]:
    """Log probability of each value of ``column`` given each language, from all rows; and that of
    a value not met."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(*_sums(size))
    kinds = counts.count() + 1
    over = counts.agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(size))).first()
    below = [math.log((over[k] or 0.0) + CELL_WEIGHT * kinds) for k in range(size)]
    logs = [(F.log(F.col(f"s{k}") + CELL_WEIGHT) - below[k]).alias(f"l{k}") for k in range(size)]
    table = counts.select("value", *logs)
    return F.broadcast(table) if kinds <= BROADCAST_VALUES else table, [math.log(CELL_WEIGHT) - b for b in below]


def fuse(evidence: DataFrame, languages: list[str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Add lang_found, confidence and accepted to rows with p_text, declared, suffix, host, domain,
    has_letters (declared to domain may be null, which is no evidence)."""
    size = len(languages)
    whole = evidence.agg(F.count("*").alias("n"), *_sums(size)).first()
    top = [((whole[f"s{k}"] or 0.0) + CELL_WEIGHT) / ((whole["n"] or 0) + CELL_WEIGHT * size) for k in range(size)]
    out = evidence
    score = [F.log(F.col("p_text")[k] + 1e-300) for k in range(size)]
    for column in ("declared", "suffix"):
        table, unseen = _given_language(evidence, column, size)
        table = table.select(F.col("value").alias(f"{column}_value"), *(F.col(f"l{k}").alias(f"{column}_{k}") for k in range(size)))
        out = out.join(table, F.col(column) == F.col(f"{column}_value"), "left").drop(f"{column}_value")
        for k in range(size):
            score[k] = score[k] + F.when(F.col(column).isNull(), 0.0).otherwise(F.coalesce(F.col(f"{column}_{k}"), F.lit(unseen[k])))
    domains = evidence.where("domain is not null").groupBy(F.col("domain").alias("domain_of")).agg(F.count("*").alias("domain_n"), *(F.sum(F.col("p_text")[k]).alias(f"d{k}") for k in range(size)))
    hosts = evidence.where("host is not null").groupBy(F.col("host").alias("host_of"), F.col("domain").alias("host_domain")).agg(F.count("*").alias("host_n"), *(F.sum(F.col("p_text")[k]).alias(f"h{k}") for k in range(size)))
    hosts = hosts.join(domains, F.col("host_domain").eqNullSafe(F.col("domain_of")), "left").drop("domain_of")
    out = out.join(hosts, F.col("host").eqNullSafe(F.col("host_of")) & F.col("domain").eqNullSafe(F.col("host_domain")), "left").drop("host_of", "host_domain")
    for k in range(size):
        own = F.when(F.col("host_n").isNull(), 0.0).otherwise(F.col("p_text")[k])
        one = F.when(F.col("host_n").isNull(), 0).otherwise(1)
        domain = (F.coalesce(F.col(f"d{k}") - own, F.lit(0.0)) + PARENT_WEIGHT * top[k]) / (F.coalesce(F.col("domain_n") - one, F.lit(0)) + PARENT_WEIGHT)
        host = (F.coalesce(F.col(f"h{k}") - own, F.lit(0.0)) + PARENT_WEIGHT * domain) / (F.coalesce(F.col("host_n") - one, F.lit(0)) + PARENT_WEIGHT)
        score[k] = score[k] + F.log(F.greatest(host, F.lit(1e-9)))
    out = out.select(*evidence.columns, F.array(*score).alias("score"))
    best = F.array_max("score")
    total = F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    names = F.array(*(F.lit(x) for x in languages))
    out = out.withColumn("confidence", 1 / total).withColumn("lang_found", F.element_at(names, F.array_position("score", best).cast("int")))
    return out.withColumn("accepted", F.col("has_letters") & (F.col("confidence") >= least)).drop("score")


def identify(rows: DataFrame, model: TextModel, keys: list[str], declared: str | None, host: Column, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(keys, lang_found, confidence, accepted) of every row with a column text.

    declared: a column with the declared language, which the markup's own overrules.  host: the
    row's host or source (null: no such evidence); its suffix and parent domain are derived from
    it.  A text without letters, null or empty, is rejected; repeated rows are judged alike (each
    is evidence for its host); an empty table gives an empty result; texts are read whole.  Keys may
    have any names and hold nulls; no other columns are read.
    """
    host = F.when(host != "", host)
    slim = rows.select(F.struct(*keys).alias("key"), (F.lower(F.col(declared)) if declared else F.lit(None).cast("string")).alias("said"), host.alias("host"), "text")
    evidence = text_evidence(slim, model)
    labels = F.split("host", "[.]")
    dotted = F.contains(F.col("host"), F.lit("."))
    evidence = evidence.select(
        "key", "p_text", "has_letters", "host", F.coalesce("markup", "said").alias("declared"),
        F.when(dotted, F.element_at(labels, -1)).alias("suffix"),
        F.when(dotted, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).otherwise(F.col("host")).alias("domain"),
    )
    kept = written(evidence, "language-evidence")
    return fuse(kept, model.languages, least).select("key.*", "lang_found", "confidence", "accepted")


def keep_identified(docs: DataFrame, docs_per_language: int = FIT_DOCS, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """The rows of docs(doc_id, text, lang, source) whose language can be told.

    Each row is judged on its own by text, lang and source: rows that share a doc_id, or have none, but
    differ in these don't share a verdict.  Null and empty texts and those without letters go; an empty
    table gives an empty result; other columns of any name pass unchanged."""
    judged = F.xxhash64("text", "lang", "source")
    slim = docs.select("doc_id", "text", "lang", "source", judged.alias("t"))
    found = identify(slim, fit(docs, docs_per_language), ["doc_id", "t"], "lang", F.col("source"), least)
    # written, so that its size is known: a small table is broadcast, and no text is shuffled
    gone = written(found.where("not accepted").select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct(), "language-rejects")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", judged.alias("t"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("t") == F.col("gone_t")), "left_anti").select("row.*")
