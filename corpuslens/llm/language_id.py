"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Evidence for each language l of a text:

* text: log likelihood of all byte trigrams of the whole text under a hashed trigram model of l,
  tempered to the weight of n / (1 + n / EFFECTIVE) observations, as neighbouring trigrams
  depend on each other. "und" competes as a language whose trigrams are uniform.
* declared language (markup or metadata) and address suffix: each agrees with the true language with a fixed
  probability and is spread evenly over the others else; an unknown code says nothing.
* host: prior of l at the host, smoothed towards the prior of the host's suffix, which is smoothed towards
  the prior of all texts, by grouped aggregation of what the texts alone say.

Every declared language has a model, however many there are. Codes are compared by their primary subtag in lower case
("EN", "en-GB" and "en_US" are "en"); "und" and empty codes are no declaration. The one minimum: a code
whose sampled texts have fewer than MIN_TRIGRAMS trigrams in all has no model and is no evidence. Models
are sparse (about 12 bytes per bucket that occurs) and are laid out one language at a time, so memory on the driver and in
each worker grows with what the languages' samples hold; time grows with the number of languages.

The trigram models are classifiers fitted on a bounded sample of labelled rows: of each declared
language, the share of texts, by a hash of the id, that makes FIT_TEXTS expected (all if there are
fewer); host counts cover all rows. A text is kept if its best language is not
"und" and has a posterior of at least MIN_POSTERIOR.

Defined cases: null texts and texts of under three bytes have no text evidence and are "und", not kept;
null declared languages, hosts and suffixes are no evidence (a null host takes the overall prior);
repeated rows are judged alike; without any declared language all texts are "und"; an empty table gives no
rows; extra columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bytes_text import bounded_batches, slices, text_buffers
from corpuslens.llm.tables import documents, table, uniform
from corpuslens.plans.scratch import Scratch

BUCKETS = 1 << 16
FIT_TEXTS = 2_000
MIN_TRIGRAMS = 20
_COUNT_CHUNK = 2 << 20
EFFECTIVE = 200.0
#: Share of a uniform model in each language's trigram model, for numbers, names and markup in its texts.
UNIFORM_SHARE = 0.2
DECLARED_AGREES, SUFFIX_AGREES = 0.9, 0.8
UND_PRIOR = 0.001
PRIOR_STRENGTH = 20.0
MIN_POSTERIOR = 0.5
#: Host tables up to this many rows are broadcast; larger ones are joined with salted hosts.
MAX_BROADCAST_HOSTS = 50_000
#: Beyond so many languages a host's row is wider, and fewer hosts are broadcast.
HOST_WIDTH = 64
#: Likelihoods in one Arrow batch at most.
BATCH_VALUES = 2 << 20
SALTS = 32
#: Address suffixes and first path segments that name a language.
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "en": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl",
}


def trigram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte trigram inside a text, first trigram of each text with the end)."""
    raw, offsets = text_buffers(column)
    counts = np.maximum(np.diff(offsets) - 2, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if not starts[-1]:
        return np.zeros(0, np.uint16), starts
    x = raw.astype(np.uint32)
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    bucket = ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    inside = np.ones(len(raw), bool)
    inside[-2:] = False
    ends = offsets[1:][np.diff(offsets) > 0]
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)[np.diff(offsets)[np.diff(offsets) > 0] > 1]] = False
    return bucket[inside[:-2]], starts


def primary_code(declared: Column) -> Column:
    """Primary subtag in lower case; null if nothing is declared."""
    code = F.regexp_extract(F.lower(declared), r"^\s*([^\s_-]+)", 1)
    return F.when(~code.isin("", "und"), code)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language number * BUCKETS + bucket."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    for batch in (part for whole in batches for part in slices(whole)):
        bucket, starts = trigram_buckets(batch.column("text"))
        held.append(np.repeat(batch.column("at").to_numpy().astype(np.int64), np.diff(starts)) * BUCKETS + bucket)
        if sum(map(len, held)) >= _COUNT_CHUNK:
            yield flush()
            held = []
    if held:
        yield flush()


class TextModel:
    """Log probabilities of trigram buckets by language, "und" (uniform) last; only buckets that occur are held."""

    def __init__(self, languages: list[str], cells: np.ndarray, n: np.ndarray):
        """cells: language number * BUCKETS + bucket, sorted, with counts n."""
        self.languages = [*languages, "und"]
        cuts = np.searchsorted(cells, np.arange(len(languages) + 1) * BUCKETS)
        self.buckets, self.values, self.floors = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            log = lambda smooth, total=n[a:b].sum() + 0.5 * BUCKETS: np.log((1 - UNIFORM_SHARE) * smooth / total + UNIFORM_SHARE / BUCKETS)
            self.buckets.append((cells[a:b] % BUCKETS).astype(np.int32))
            self.values.append(log(n[a:b] + 0.5))
            self.floors.append(float(log(0.5)))

    def _rows(self) -> Iterator[np.ndarray]:
        for bucket, value, floor in zip(self.buckets, self.values, self.floors, strict=True):
            row = np.full(BUCKETS, floor)
            row[bucket] = value
            yield row
        yield np.full(BUCKETS, -math.log(BUCKETS))

    def log_likelihoods(self, column: pa.Array) -> pa.Array:
        """array<double> per text: tempered log likelihood of each language; null without trigrams."""
        bucket, starts = trigram_buckets(column)
        n = np.diff(starts)
        out = np.zeros((len(column), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            for k, row in enumerate(self._rows()):
                out[some, k] = np.add.reduceat(row[bucket], starts[some])
        out /= np.maximum(n, 1)[:, None]
        out *= (n / (1 + n / EFFECTIVE))[:, None]
        width = len(self.languages)
        return pa.ListArray.from_arrays(np.arange(0, width * len(n) + 1, width, dtype=np.int32), pa.array(out.ravel()), mask=pa.array(n == 0))


def _place(names: list[str], said: Column) -> Column:
    """Number of a name, -1 if it isn't one of them, null for null."""
    return (F.array_position(F.array(*[F.lit(x) for x in names]), said) - 1).cast("int")


def fit_text_model(evidence: DataFrame, fit_texts: int = FIT_TEXTS) -> TextModel:
    declared = evidence.filter("text IS NOT NULL").select("id", primary_code(F.col("declared")).alias("declared"), "text").filter("declared IS NOT NULL")
    found = sorted(declared.groupBy("declared").count().collect(), key=lambda r: r["declared"])
    if not found:
        return TextModel([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    languages = [r["declared"] for r in found]
    shares = F.array(*[F.lit(min(1.0, fit_texts / r["count"])) for r in found])
    numbered = declared.withColumn("at", _place(languages, F.col("declared")))
    sample = numbered.filter(uniform(F.col("id"), "fit") < F.get(shares, F.col("at"))).select("at", "text")
    counted = sample.mapInArrow(_count_trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, n = (counted.column(c).to_numpy() for c in ("cell", "n"))
    order = np.argsort(cells)
    cells, n = cells[order], n[order]
    enough = np.bincount(cells // BUCKETS, weights=n, minlength=len(languages)) >= MIN_TRIGRAMS
    keep = enough[cells // BUCKETS]
    number = np.cumsum(enough) - 1
    return TextModel([x for x, e in zip(languages, enough, strict=True) if e], number[cells[keep] // BUCKETS] * BUCKETS + cells[keep] % BUCKETS, n[keep])


def _text_evidence(spark, model: TextModel) -> object:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def score(text: pa.Array) -> pa.Array:
        parts = slices(pa.RecordBatch.from_arrays([text], names=["text"]))
        return pa.concat_arrays([shared.value.log_likelihoods(p.column("text")) for p in parts] or [pa.array([], pa.list_(pa.float64()))])

    return score


def _agreement(said: Column, at: Column, known: int, agrees: float) -> Column:
    """log P(what is said | language) for language number at; said: number of the language, none if it is null or -1."""
    rest = math.log((1 - agrees) / max(1, known - 1)) if known > 1 else 0.0
    return F.when(said >= 0, F.when(at == known, -math.log(max(1, known))).when(at == said, math.log(agrees)).otherwise(rest)).otherwise(0.0)


def _arg_max(scores: Column, names: list[str]) -> Column:
    """Name of the greatest score, the first of equals."""
    return F.get(F.array(*[F.lit(x) for x in names]), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def host_priors(scored: DataFrame, languages: list[str], scratch: Scratch) -> tuple[DataFrame, list[float]]:
    """host -> log priors, smoothed host -> suffix -> all; counts are what the texts alone say."""
    counts = scored.filter("text_lang <> 'und'").groupBy("host", "suffix", "text_lang").count()
    counts = scratch.save(counts.select("host", "suffix", _place(languages, F.col("text_lang")).alias("at"), F.col("count").cast("double").alias("n")), "counts")
    k = len(languages)

    def per(*by: str) -> DataFrame:
        """n by language number as a map, and the sum of all."""
        each = counts.groupBy(*by, "at").agg(F.sum("n").alias("n"))
        return each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("by_language"), F.sum("n").alias("all"))

    overall = {r["at"]: r["n"] for r in counts.groupBy("at").agg(F.sum("n").alias("n")).collect()}  # a row a language
    total = sum(overall.values()) + k
    top = [(overall.get(i, 0.0) + 1) / total for i in range(k)]
    smoothed = lambda towards: F.transform(towards, lambda p, i: (F.coalesce(F.try_element_at("by_language", i), F.lit(0.0)) + PRIOR_STRENGTH * p) / (F.col("all") + PRIOR_STRENGTH))
    suffixes = per("suffix").select(F.col("suffix").alias("sx"), smoothed(F.array(*[F.lit(t) for t in top])).alias("of_suffix"))
    hosts = per("host", "suffix").filter("host IS NOT NULL").join(suffixes, F.col("suffix").eqNullSafe(F.col("sx")))
    fused = F.transform(smoothed(F.col("of_suffix")), lambda p: F.log(p))
    return scratch.save(hosts.select(F.col("host").alias("__host"), F.col("suffix").alias("__suffix"), fused.alias("__prior")), "hosts"), [math.log(t) for t in top]


#: Result columns; input columns of these names are replaced.
_MADE = ("text_lang", "lang_id", "posterior", "kept")


def identify(evidence: DataFrame, fit_texts: int = FIT_TEXTS, keep_text: bool = True) -> DataFrame:
    """evidence (id, text, declared, host, suffix and any others) with lang_id, posterior, text_lang, kept.

    Every text is scored once and the scored rows are saved; keep_text False leaves the texts out of them and of the result.
    """
    spark = evidence.sparkSession
    scratch = Scratch(spark, "language")
    with bounded_batches(spark):
        model = fit_text_model(evidence, fit_texts)
    names = model.languages
    languages = names[:-1]
    carried = [c for c in evidence.columns if (keep_text or c != "text") and c not in _MADE]
    if not languages:
        return evidence.select(*carried).withColumns({"text_lang": F.lit("und"), "lang_id": F.lit("und"), "posterior": F.lit(0.0), "kept": F.lit(False)})
    score = _text_evidence(spark, model)
    scored = evidence.withColumn("__ll", score(F.col("text"))).select(*carried, "__ll")
    scored = scored.withColumn("text_lang", F.when(F.col("__ll").isNull(), "und").otherwise(_arg_max(F.col("__ll"), names)))
    with bounded_batches(spark, max(1, BATCH_VALUES // len(names))):
        scored = scratch.save(scored, "scored")
    hosts, overall = host_priors(scored.select("host", "suffix", "text_lang"), languages, scratch)
    same = (F.col("host") == F.col("__host")) & F.col("suffix").eqNullSafe(F.col("__suffix"))
    if hosts.count() * max(1.0, len(languages) / HOST_WIDTH) <= MAX_BROADCAST_HOSTS:
        joined = scored.join(F.broadcast(hosts), same, "left")
    else:
        salted = hosts.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = scored.withColumn("__s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__s") == F.col("__salt")), "left").drop("__s", "__salt")
    k = len(languages)
    overall_prior = F.array(*[F.lit(p) for p in overall])
    by_suffix = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv]), F.col("suffix"))
    joined = joined.withColumns({"__declared": _place(languages, primary_code(F.col("declared"))), "__by_suffix": _place(languages, by_suffix)})

    def fuse(t: Column, i: Column) -> Column:
        prior = F.when(i == k, math.log(UND_PRIOR)).otherwise(F.coalesce(F.get("__prior", i), F.get(overall_prior, i)) + math.log(1 - UND_PRIOR))
        return t + _agreement(F.col("__declared"), i, k, DECLARED_AGREES) + _agreement(F.col("__by_suffix"), i, k, SUFFIX_AGREES) + prior

    judged = joined.withColumn("__f", F.transform("__ll", fuse))
    most = F.array_max("__f")
    posterior = 1 / F.aggregate("__f", F.lit(0.0), lambda a, x: a + F.exp(x - most))
    no_text = F.col("__ll").isNull()
    return (
        judged.withColumn("lang_id", F.when(no_text, "und").otherwise(_arg_max(F.col("__f"), names)))
        .withColumn("posterior", F.when(no_text, 0.0).otherwise(posterior))
        .withColumn("kept", (F.col("lang_id") != "und") & (F.col("posterior") >= MIN_POSTERIOR))
        .drop("__ll", "__f", "__host", "__suffix", "__prior", "__declared", "__by_suffix")
    )


def document_evidence(docs: DataFrame, *others: str) -> DataFrame:
    """Documents: the declared language is metadata, the source stands for the host."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), *others)


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages: declared language of the html element, address suffix (or first path segment), host."""
    html = F.coalesce("html", F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    segment = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    known = list(SUFFIX_LANGUAGE)
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    return pages.select(
        F.col("page_id").alias("id"), visible.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"),
        F.when(top.isin(known), top).when(segment.isin(known), segment).otherwise(F.nullif(top, F.lit(""))).alias("suffix"),
    )


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    out = identify(document_evidence(documents(spark, sf_dir)), keep_text=False)
    return out.select(F.col("id").alias("doc_id"), F.col("declared").alias("lang"), "lang_id", "text_lang", F.round("posterior", 6).alias("posterior"), "kept")


def pages_language_id(spark, sf_dir: str) -> DataFrame:
    out = identify(page_evidence(table(spark, sf_dir, "pages")), keep_text=False)
    return out.select(F.col("id").alias("page_id"), "declared", "suffix", "host", "lang_id", F.round("posterior", 6).alias("posterior"), "kept")
