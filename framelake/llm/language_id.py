"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior per page:

* the text: byte-trigram likelihoods by language, learned from a bounded sample of labelled documents; a long text
  counts as ``TEXT_WEIGHT`` independent trigrams at most, since trigrams of one text are anything but independent;
* the language that the markup declares, by how often each declaration meets each language in all pages;
* the address: priors of the suffix, the domain and the host, each smoothed towards the level above it by ``SMOOTH`` pages,
  from languages that text and declaration suggest, added up over all pages in grouped aggregations.

A page's own share is taken out of every sum that it meets again, so no evidence counts twice.  Sums are arrays with a place for
each language, so plans don't grow with their number.  A page's rows shrink to its evidence before anything is shuffled.  Aggregates are pre-summed on each side, and hosts that
hold more than a thousandth of all pages (so there are at most a thousand) are joined by broadcast, the others by shuffle.

Null or empty markup has an even text likelihood and no declaration; a null address is a host of its own; repeated rows
count each time and get equal results; ties go to the first language in alphabetical order; without labelled documents the
language is null.  Every labelled language is told apart, however rare.  A page of any length is read whole, in time
proportional to it; what an open comment, script, style or tag leads in, up to the end, is no text.  Further columns pass
through unless their names are those of the result; an empty table gives an empty one.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import materialize, sliced

#: Labelled documents learned from at most (more only if there are so many languages that each gets the least number),
#: trigrams that a text counts as at most, and pages by which a prior is smoothed.
TRAIN_ROWS, LEAST_ROWS, TEXT_WEIGHT, SMOOTH = 2000, 20, 40, 8.0
#: Buckets of trigrams, as a power of two.
BITS = 15

#: What isn't text; an open comment, script, style or tag reaches to the end of the page, so none is tried twice.
_DROP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", re.IGNORECASE | re.DOTALL)
#: A comment, a script or style with what is in it, or an <html> tag, whose attributes are the second group; none reads a part twice.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<html\b([^>]*)", re.IGNORECASE | re.DOTALL)
_DECLARED = re.compile(r"\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.IGNORECASE)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def visible_text(page: str | None) -> str:
    return html_lib.unescape(_DROP.sub(" ", page or ""))


def declared_language(page: str | None) -> str | None:
    """That of the first <html> tag with one, wherever it stands outside comments, scripts and styles."""
    for tag in _TAG.finditer(page or ""):
        if tag[2] and (m := _DECLARED.search(tag[2])):
            return m[1].lower()
    return None


def address(url: str | None) -> tuple[str, str, str]:
    """Host, its last two labels, and its last label."""
    m = _HOST.match(url or "")
    labels = m[1].lower().rstrip(".").split(".") if m else [""]
    return ".".join(labels), ".".join(labels[-2:]), labels[-1]


def trigrams(text: str) -> np.ndarray:
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), dtype=np.uint8).astype(np.uint64)
    if len(b) < 3:
        return np.empty(0, dtype=np.int64)
    x = (b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Profiles:
    """Log-probabilities of trigram buckets, one column for each language."""

    languages: list[str]
    table: np.ndarray

    def likelihoods(self, text: str) -> np.ndarray:
        """Log-likelihood of each language, weighed down to TEXT_WEIGHT trigrams."""
        t = trigrams(text)
        if not len(t):
            return np.zeros(len(self.languages))
        return self.table[t].sum(axis=0, dtype=np.float64) * min(1.0, TEXT_WEIGHT / len(t))


def learn(texts: list[str | None], languages: list[str]) -> Profiles:
    names = sorted(set(languages))
    counts = np.full((1 << BITS, len(names)), 0.1)
    for text, lang in zip(texts, languages, strict=True):
        counts[:, names.index(lang)] += np.bincount(trigrams(text or ""), minlength=1 << BITS)
    return Profiles(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS, least: int = LEAST_ROWS) -> Profiles:
    """From at most ``rows`` labelled documents, or ``least`` a language if that is more: of each language those of the smallest hashes of their ids."""
    labelled = docs.select(F.col("doc_id").alias("id"), F.lower(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
    languages = labelled.agg(F.count_distinct("lang")).first()[0]
    each = max(least, rows // max(1, languages))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labelled.select("id", "lang").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= each).select("id", "lang").distinct()
    found = labelled.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).toArrow()  # ``each`` a language
    found = found.sort_by([("id", "ascending"), ("lang", "ascending")])
    return learn(found.column("text").to_pylist(), found.column("lang").to_pylist())


def evidence(pages: DataFrame, shared) -> DataFrame:
    """From ``own, url, html``: ``own, host, domain, suffix, declared, likelihoods`` under the broadcast profiles."""

    def run(batches):
        profiles = shared.value
        known = set(profiles.languages)
        for batch in sliced(batches, "html"):
            where = [address(u) for u in batch.column("url").to_pylist()]
            markup = batch.column("html").to_pylist()
            declared = [d if (d := declared_language(m)) in known else None for m in markup]
            likely = [profiles.likelihoods(visible_text(m)) for m in markup]
            columns = [pa.array([w[k] for w in where], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *columns, pa.array(declared, pa.string()), pa.array(likely, pa.list_(pa.float64()))], names=["own", "host", "domain", "suffix", "declared", "likelihoods"])

    own = pages.schema["own"]
    return pages.mapInArrow(run, T.StructType([own, *(T.StructField(c, T.StringType()) for c in ("host", "domain", "suffix", "declared")), T.StructField("likelihoods", T.ArrayType(T.DoubleType()))]))


def normalized(logs: np.ndarray) -> np.ndarray:
    """Probabilities from logarithms, row by row."""
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def declared_logs(text: np.ndarray, declared: np.ndarray, met: np.ndarray) -> np.ndarray:
    """The log-likelihood of each page's declaration (a row of ``met``, or -1 for none) in each language, without the page's own share.

    With even text evidence a declaration speaks for itself: one page's worth for its own language.
    """
    counts = met + np.where(np.eye(len(met), dtype=bool), 1.0, 0.05)
    out = np.zeros_like(text)
    with_one = declared >= 0
    share = normalized(text[with_one])
    out[with_one] = np.log(np.maximum(counts[declared[with_one]] - share, 0.05)) - np.log(counts.sum(axis=0) - share)
    return out


def smoothed(share: np.ndarray, sums: list[np.ndarray], pages: list[np.ndarray], total: np.ndarray, n_pages: int) -> np.ndarray:
    """Priors from suffix, domain and host (in this order), each smoothed towards the level above it, without the page's own share."""
    prior = (total - share + 1.0) / (n_pages - 1 + len(total))
    for own, n in zip(sums, pages, strict=True):
        prior = (np.maximum(own - share, 0.0) + SMOOTH * prior) / (n[:, None] - 1 + SMOOTH)
    return prior


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _numbers(column: pa.Array, languages: list[str]) -> np.ndarray:
    at = {name: k for k, name in enumerate(languages)}
    return np.array([at.get(d, -1) for d in column.to_pylist()], dtype=np.int64)


def _summed(keys: list[str], batch: pa.RecordBatch, share: np.ndarray) -> pa.RecordBatch:
    """Pages and shares of a batch, summed by the columns ``keys``."""
    table = pa.table([batch.column(k) for k in keys] + [pa.array(np.arange(batch.num_rows))], names=[*keys, "row"])
    groups = table.group_by(keys, use_threads=False).aggregate([("row", "list")])
    rows = groups.column("row_list").combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    sums = np.add.reduceat(share[rows.flatten().to_numpy()], np.cumsum(sizes) - sizes, axis=0) if len(sizes) else np.empty((0, share.shape[1]))
    return pa.RecordBatch.from_arrays([*(groups.column(k).combine_chunks() for k in keys), pa.array(sizes.astype(np.int64)), pa.array(list(sums), pa.list_(pa.float64()))], names=[*keys, "pages", "sums"])


def _level(parts: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """``keys``, pages and the array of sums of each group; a group's arrays are added position by position."""
    counted = parts.groupBy(*keys).agg(F.sum("pages").alias(f"{mark}_pages"))
    added = parts.select(*keys, F.posexplode("sums").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    listed = added.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(f"{mark}_sums"))  # one for each language
    return counted.join(listed, keys)


def identify(spark: SparkSession, pages: DataFrame, profiles: Profiles, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` but the markup, and ``lang``, ``confidence`` (its posterior), ``text_lang`` and ``declared``."""
    names, wide = profiles.languages, len(profiles.languages)
    new = ("lang", "confidence", "text_lang", "declared")
    own = [c for c in pages.columns if c not in (*new, html_col)]
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(new, ("string", "double", "string", "string"), strict=True)]
    if not names:
        return pages.select(*own, *none)
    shared = spark.sparkContext.broadcast(profiles)  # 2 ** BITS numbers for each language, of which there are no more than labelled rows
    given = pages.select(F.struct(*own).alias("own"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    seen = materialize(spark, evidence(given, shared), "evidence")

    def by_declaration(batches):
        for batch in batches:
            yield _summed(["declared"], batch, normalized(_matrix(batch.column("likelihoods"), wide)))

    parts = seen.where("declared is not null").mapInArrow(by_declaration, "declared string, pages long, sums array<double>")
    met = np.zeros((wide, wide))
    for r in _level(parts, ["declared"], "d").collect():  # a row for each language at most
        met[names.index(r["declared"])] = r["d_sums"]
    shared_met = spark.sparkContext.broadcast(met)

    def shares(batch):
        text = _matrix(batch.column("likelihoods"), wide)
        both = text + declared_logs(text, _numbers(batch.column("declared"), names), shared_met.value)
        return text, both, normalized(both)

    def by_host(batches):
        for batch in batches:
            yield _summed(["suffix", "domain", "host"], batch, shares(batch)[2])

    parts = materialize(spark, seen.mapInArrow(by_host, "suffix string, domain string, host string, pages long, sums array<double>"), "hosts")
    n_pages = parts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    total = np.zeros(wide)
    for r in parts.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # a row for each language
        total[r["at"]] = r["x"]
    levels = _level(parts, ["suffix", "domain", "host"], "h").join(_level(parts, ["suffix", "domain"], "d"), ["suffix", "domain"]).join(_level(parts, ["suffix"], "s"), "suffix")
    priors = materialize(spark, levels.drop("suffix", "domain"), "priors")
    # Fewer than a thousand hosts hold more than a thousandth each.
    often = F.broadcast(priors.where(F.col("h_pages") * 1000 > n_pages))
    rare = priors.where(F.col("h_pages") * 1000 <= n_pages)
    joined = seen.join(often, "host").unionByName(seen.join(often.select("host"), "host", "left_anti").join(rare, "host"))

    def fuse(batches):
        label = np.array(names, dtype=object)
        for batch in batches:
            text, both, share = shares(batch)
            sums = [_matrix(batch.column(f"{m}_sums"), wide) for m in "sdh"]
            held = [batch.column(f"{m}_pages").to_numpy() for m in "sdh"]
            p = normalized(both + np.log(smoothed(share, sums, held, total, n_pages)))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(label[p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1)), pa.array(label[text.argmax(axis=1)], pa.string()), batch.column("declared")], names=["own", *new])

    fused = joined.select("own", "declared", "likelihoods", *(f"{m}_{c}" for m in "sdh" for c in ("sums", "pages")))
    out = fused.mapInArrow(fuse, T.StructType([seen.schema["own"], *(T.StructField(c, T.DoubleType() if c == "confidence" else T.StringType()) for c in new)]))
    return out.select("own.*", *new)
