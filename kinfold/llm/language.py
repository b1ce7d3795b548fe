"""Language identification by Bayesian evidence fusion.

The posterior of a row's language multiplies (adds in logs) four kinds of evidence: the likelihood of its text under
byte-trigram models, the language that its markup or metadata declares, the suffix of its address, and a prior of its
host. The last three are estimated by grouped aggregation over all rows; host priors are smoothed along host, domain,
suffix and the whole. Only the text model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``).

Evidence that a row lacks (null or unknown declaration, no host) adds nothing. A null or empty text, or one that a
uniform model explains better than every language, gets language ``und`` and isn't kept. Without any labelled row
every text is ``und``. Of languages of one posterior the first in alphabetical order is taken. Texts of any length are
scored whole. Repeated rows get the same result each; the text model counts equal labelled texts once, the other
evidence counts rows. An empty table gives an empty model and an empty result. Input columns named as a new one are
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, map_text, small_enough, unpacked, written

SAMPLE_ROWS = 6_000
BITS = 14
UNKNOWN = "und"
#: A letter falls in three trigrams, so their likelihoods count for a third.
WEIGHT = 1 / 3
LEAST = 0.5
#: Rows by which a level of hosts is drawn to the level above it.
PULL = 20.0

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # what is no letter in ASCII separates


def _trigrams(data: bytes) -> np.ndarray:
    """The buckets of the trigrams of folded bytes, without those that lie in separators alone."""
    x = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    some = (b != 32) | ((a != 32) & (c != 32))
    return (((a * np.uint32(65599) + b) * np.uint32(65599) + c) * np.uint32(2654435769) >> np.uint32(32 - BITS))[some].astype(np.int64)


@dataclass
class TextModel:
    """log P(bucket | language) for each language, a row of ``table`` each."""

    languages: list[str]
    table: np.ndarray  # buckets x languages

    def scores(self, text: str | None) -> list[float]:
        """Weighted log-likelihood of the text for each language less that of the uniform model; empty where nothing is to be seen."""
        if not text or not self.languages:
            return []
        x = _trigrams(text.encode())
        if not len(x):
            return []
        counts = np.bincount(x, minlength=1 << BITS).astype(np.float32) if len(x) > 1 << (BITS - 2) else None
        total = counts @ self.table if counts is not None else self.table[x].sum(0, dtype=np.float64)
        return ((total.astype(np.float64) + len(x) * BITS * math.log(2)) * WEIGHT).tolist()


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS, least_rows: int = 5) -> TextModel:
    """Fit on at most ``sample_rows`` different labelled texts, those of smallest hash; a language needs ``least_rows`` of them. Counts are summed by the executors."""
    rows = docs.select(F.lower(F.col(label)).alias("__l"), F.col(text).alias("__t")).filter("__l is not null and __t is not null and length(__t) > 0")
    rows = rows.withColumn("__h", F.xxhash64("__t", "__l"))
    # only hashes are ordered and brought together; the texts under the last one stay where they are
    last = rows.select("__h").distinct().orderBy("__h").limit(sample_rows).agg(F.max("__h")).first()[0]

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            for lang, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(_trigrams(t.encode()), minlength=1 << BITS)
                rows[lang] = rows.get(lang, 0) + 1
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "n": pa.array([rows[lang]], pa.int64()), "bucket": pa.array([np.flatnonzero(v).tolist()], pa.list_(pa.int64())), "times": pa.array([v[v > 0].tolist()], pa.list_(pa.int64()))})

    counts = written(rows.filter(F.col("__h") <= F.lit(last)).dropDuplicates(["__h"]).select("__l", "__t").mapInArrow(count, "lang string, n long, bucket array<bigint>, times array<bigint>"), "counts")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    cells = counts.select("lang", F.explode(F.arrays_zip("bucket", "times")).alias("c")).groupBy("lang", "c.bucket").agg(F.sum("c.times").alias("times")).collect()
    # as many cells as buckets and languages, whatever the input
    sums = {k: (n, np.zeros(1 << BITS, np.int64)) for k, n in sizes.items()}
    for r in cells:
        sums[r["lang"]][1][r["bucket"]] = r["times"]
    languages = sorted(k for k, (n, _) in sums.items() if n >= least_rows)
    columns = [np.log((sums[k][1] + 0.05) / (sums[k][1].sum() + 0.05 * (1 << BITS))) for k in languages]
    return TextModel(languages, np.stack(columns, 1).astype(np.float32) if columns else np.zeros((1 << BITS, 0), np.float32))


def scored(df: DataFrame, model: TextModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ``text_scores``, an array by language."""
    return map_text(df, text, df.columns if keep is None else keep, "text_scores array<double>", lambda texts: [list(map(model.scores, texts))])


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; what has no scheme is its own host."""
    u = F.lower(F.trim(url))
    return F.nullif(F.when(u.contains("://"), F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)).otherwise(u), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host that has several, else null."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def markup_language(html: Column) -> Column:
    """The primary language that the html element declares, else null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1)), F.lit(""))


def _best(model: TextModel, scores: Column) -> Column:
    """The language with the highest score over 0 (the uniform model), else und."""
    made = F.lit(UNKNOWN)
    top = F.greatest(F.array_max(scores), F.lit(0.0))
    for i, lang in reversed(list(enumerate(model.languages))):
        made = F.when((F.size(scores) > 0) & (top > 0) & (F.get(scores, i) == top), F.lit(lang)).otherwise(made)
    return made


def _logs(prefix: str, model: TextModel) -> list[str]:
    return [f"{prefix}_{i}" for i in range(len(model.languages))]


@dataclass
class Evidence:
    """Log-factors by declaration and suffix, host priors as a table, the prior of the whole."""

    declared: DataFrame
    suffixes: DataFrame
    hosts: DataFrame
    whole: list[float]


def gather(rows: DataFrame, model: TextModel) -> Evidence:
    """Counts of rows by (language that the text alone gives) and declaration, suffix, domain and host, over all rows with text evidence. ``rows`` has text_scores, declared and host."""
    langs = model.languages
    seen = rows.select("declared", "host", _best(model, F.col("text_scores")).alias("l")).filter(F.col("l") != UNKNOWN)
    counts = [F.sum(F.when(F.col("l") == x, 1).otherwise(0)).cast("double").alias(f"n_{i}") for i, x in enumerate(langs)]
    n = [f"n_{i}" for i in range(len(langs))]
    grouped = written(seen.groupBy("declared", "host").agg(*counts), "evidence") if langs else seen.groupBy("declared", "host").agg(F.lit(0.0).alias("n"))
    if not langs:
        none = grouped.select("declared").limit(0)
        return Evidence(none, grouped.select(F.lit("").alias("suffix")).limit(0), grouped.select("host").limit(0), [])
    sums = [F.sum(c).alias(c) for c in n]
    row = grouped.agg(*sums).first()
    totals = np.array([row[c] or 0.0 for c in n])
    whole = (totals + 1) / (totals.sum() + len(langs))
    wide = F.array(*[F.col(c) for c in n])
    each = sum((F.col(c) for c in n[1:]), F.col(n[0]))
    # P(declared | language): how often a language's rows say so, drawn to its share of all rows
    share = each / F.lit(max(totals.sum(), 1.0))
    declared = grouped.filter("declared is not null").groupBy("declared").agg(*sums).select(
        "declared", *[F.log((F.col(c) + F.lit(PULL) * share) / F.lit(totals[i] + PULL)).alias(f"d_{i}") for i, c in enumerate(n)])
    suffix = grouped.withColumn("suffix", suffix_of(F.col("host"))).filter("suffix is not null").groupBy("suffix").agg(*sums).select(
        "suffix", *[((F.col(c) + F.lit(PULL * whole[i])) / (each + F.lit(PULL))).alias(f"s_{i}") for i, c in enumerate(n)])
    top = grouped.filter("host is not null").withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    up = F.array(*[F.coalesce(F.col(f"s_{i}"), F.lit(float(whole[i]))) for i in range(len(langs))])
    domains = top.groupBy("domain", "suffix").agg(*sums).join(suffix, "suffix", "left").select(
        "domain", *[((F.col(c) + F.lit(PULL) * F.get(up, i)) / (each + F.lit(PULL))).alias(f"m_{i}") for i, c in enumerate(n)])
    hosts = top.groupBy("host", "domain").agg(*sums).join(domains, "domain").select(
        "host", *[F.log((F.col(c) + F.lit(PULL) * F.col(f"m_{i}")) / (each + F.lit(PULL))).alias(f"h_{i}") for i, c in enumerate(n)])
    factors = suffix.select("suffix", *[F.log(F.col(f"s_{i}") / F.lit(float(whole[i]))).alias(f"s_{i}") for i in range(len(langs))])
    return Evidence(declared, factors, written(hosts, "hosts"), np.log(whole).tolist())


def fuse(rows: DataFrame, model: TextModel, evidence: Evidence, least: float = LEAST) -> DataFrame:
    """Add language, confidence and kept to rows with text_scores, declared and host.

    The host prior already holds the suffix's share by its smoothing; the suffix's own factor counts for rows whose
    host isn't in the table. Host tables over the broadcast bound join by shuffle, where adaptive execution splits hot hosts.
    """
    k = len(model.languages)
    new = ["language", "confidence", "kept"]
    if not k:
        return rows.drop(*new).withColumns({"language": F.lit(UNKNOWN), "confidence": F.lit(0.0), "kept": F.lit(False)})
    small = lambda t: F.broadcast(t) if small_enough(t, 64 + 8 * k) else t
    names_ = [c for c in rows.columns if c not in new]
    out = rows.select(*kept(names_), "text_scores", "declared", "host", suffix_of(F.col("host")).alias("suffix__"))
    out = out.join(small(evidence.declared), "declared", "left").join(small(evidence.hosts), "host", "left").join(small(evidence.suffixes.withColumnRenamed("suffix", "suffix__")), "suffix__", "left")
    known = F.coalesce(F.size("text_scores"), F.lit(0)) > 0
    post = [F.get("text_scores", i) + F.coalesce(F.col(f"d_{i}"), F.lit(0.0)) + F.coalesce(F.col(f"h_{i}"), F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) + F.lit(evidence.whole[i])) for i in range(k)]
    # und stands for the uniform model, with the prior of the rarest language and no other evidence
    post.append(F.lit(float(min(evidence.whole))))
    out = out.withColumn("post__", F.when(known, F.array(*post)))
    out = out.withColumn("top__", F.array_max("post__"))
    confidence = 1 / F.aggregate("post__", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top__")))
    names = [*model.languages, UNKNOWN]
    which = F.lit(UNKNOWN)
    for i in reversed(range(k + 1)):
        which = F.when(F.get("post__", i) == F.col("top__"), F.lit(names[i])).otherwise(which)
    out = out.withColumns({"language": F.when(known, which).otherwise(F.lit(UNKNOWN)), "confidence": F.when(known, confidence).otherwise(F.lit(0.0))})
    out = out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("confidence") >= F.lit(least)))
    return unpacked(out, names_, new)
