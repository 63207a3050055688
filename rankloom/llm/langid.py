"""Language of pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the visible text under
byte-trigram models of every language (fitted on the labelled documents), the
language that the markup declares, the suffix of the address, and a prior of
the host. How far declarations and suffixes can be believed, and the priors,
are not given: they are expected counts under a first pass by text alone,
summed by grouped aggregation. The host prior is smoothed by that of its
domain, and that by all pages; a page's own count is left out of it, so a page
is no evidence for itself.

Trigrams of one text repeat each other's evidence, so a text counts as at most
``evidence`` of them. The driver sees the trigram table: languages times a
fixed number of buckets. Null or empty pages have no text evidence, null
addresses no host and no suffix; the other evidence decides, or the overall
prior. Without labelled documents every language is null. Repeated rows are
answered each, and count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from . import grams


def trigram_table(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and bucket) from all labelled rows."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for code, body in zip(batch["lang"], batch["text"]):
                if code not in seen:
                    seen[code] = np.zeros(grams.BUCKETS, np.int64)
                seen[code] += np.bincount(grams.buckets(body), minlength=grams.BUCKETS)
        for code, n in seen.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": code, "bucket": at, "n": n[at]})

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    table = np.full((len(langs), grams.BUCKETS), 0.5)
    table[[langs.index(x) for x in sums["lang"]], sums["bucket"].to_numpy(int)] += sums["n"].to_numpy(float)
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def evidence_of(pages: DataFrame, langs: list[str], table: np.ndarray, evidence: int) -> DataFrame:
    """(page_id, url parts, declared, text log-likelihoods, first-pass posterior)."""
    small = table.astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, page in zip(batch["url"], batch["html"]):
                at = grams.buckets(grams.visible(page))
                ll = small[:, at].sum(axis=1, dtype=float) * min(1.0, evidence / len(at)) if len(at) else np.zeros(len(small))
                p = np.exp(ll - ll.max())
                name = grams.host(url)
                parts = name.split(".") if name else []
                out.append((name, ".".join(parts[-2:]) or None, parts[-1] if len(parts) > 1 else None, grams.declared(page), len(at), ll - ll.max(), p / p.sum()))
            frame = pd.DataFrame(out, columns=["host", "domain", "suffix", "declared", "n_trigrams", "ll", "p"])
            frame.insert(0, "page_id", batch["page_id"].astype("Int64"))
            yield frame

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInPandas(run, "page_id long, host string, domain string, suffix string, declared string, n_trigrams long, ll array<double>, p array<double>")


def _sums(rows: DataFrame, n: int, *by: str) -> DataFrame:
    per = rows.groupBy(*by).agg(*[F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(n)])
    return per.select(*by, F.array(*[f"s{i}" for i in range(n)]).alias("sums"))


def _given(rows: DataFrame, n: int, by: str, total: np.ndarray, weight: float) -> DataFrame:
    """log p(value | language) of a discrete piece of evidence, smoothed toward no preference."""
    per = _sums(rows.where(F.col(by).isNotNull()), n, by)
    share = F.transform("sums", lambda s, i: F.log((s + weight) / (F.get(F.lit(total.tolist()), i) + weight)))
    return per.select(F.col(by).alias(f"_{by}"), share.alias(f"given_{by}"))


def identify(pages: DataFrame, docs: DataFrame, evidence: int = 120, host_weight: float = 4.0, domain_weight: float = 8.0) -> DataFrame:
    """(page_id, lang, score, text_lang, declared, suffix, host) of every page; score is the posterior of lang."""
    langs, table = trigram_table(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), none.alias("lang"), F.lit(0.0).alias("score"), none.alias("text_lang"),
                            none.alias("declared"), none.alias("suffix"), none.alias("host"))
    n = len(langs)
    rows = staged(evidence_of(pages, langs, table, evidence), "page-evidence")
    total = np.array((rows.agg(*[F.sum(F.get("p", F.lit(i))) for i in range(n)]).first()), float)
    total = np.nan_to_num(total)
    prior = ((total + 1) / (total.sum() + n)).tolist()
    hosts = _sums(rows.where("host is not null"), n, "host").select(F.col("host").alias("_host"), F.col("sums").alias("host_sums"))
    domains = _sums(rows.where("domain is not null"), n, "domain").select(F.col("domain").alias("_domain"), F.col("sums").alias("domain_sums"))
    rows = rows.join(hosts, F.col("host") == F.col("_host"), "left").join(domains, F.col("domain") == F.col("_domain"), "left")
    for by in ("declared", "suffix"):
        rows = rows.join(_given(rows.select(by, "p"), n, by, total, 1.0), F.col(by) == F.col(f"_{by}"), "left")
    zero = F.array(*[F.lit(0.0)] * n)
    base = F.array(*[F.lit(x) for x in prior])
    rows = rows.withColumn("domain_prior", _smoothed("domain_sums", base, domain_weight))
    size = F.aggregate("domain_prior", F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumn("_size", size)
    rows = rows.withColumn("domain_prior", F.transform("domain_prior", lambda v: v / F.col("_size")))
    rows = rows.withColumn("host_prior", _smoothed("host_sums", F.col("domain_prior"), host_weight))
    parts = F.arrays_zip(F.col("ll").alias("a"), F.col("host_prior").alias("b"), F.coalesce("given_declared", zero).alias("c"), F.coalesce("given_suffix", zero).alias("d"))
    rows = rows.withColumn("z", F.transform(parts, lambda x: x["a"] + F.log(x["b"]) + x["c"] + x["d"]))
    rows = rows.withColumn("top", F.array_max("z"))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    mass = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top")))
    text_lang = F.when(F.col("n_trigrams") > 0, best(F.col("ll")))
    return rows.select("page_id", best(F.col("z")).alias("lang"), (1 / mass).alias("score"), text_lang.alias("text_lang"), "declared", "suffix", "host")


def _smoothed(sums: str, toward: Column, weight: float) -> Column:
    """Prior, up to a factor, from summed posteriors without the row's own, drawn toward a wider one."""
    pairs = F.arrays_zip(F.col(sums).alias("s"), F.col("p").alias("own"), toward.alias("wide"))
    left = F.transform(pairs, lambda x: F.greatest(x["s"] - x["own"], F.lit(0.0)) + weight * x["wide"])
    return F.when(F.col(sums).isNull(), toward).otherwise(left)
