"""Language identification by Bayesian evidence fusion (operator 2).

For each row and language the log posterior adds up

* the text: a naive Bayes model over hashed byte trigrams of the whole text
  (letters only), divided by ``TEMPER`` because neighbouring trigrams overlap;
* the declared language (the ``lang`` attribute of a page's markup, the language
  column of a document): P(declared | language);
* the address suffix (last label of the host): P(suffix | language);
* the host: a prior from the languages of its other rows, smoothed towards its
  domain and that towards the whole corpus,
  (n(host, l) + K * prior(domain, l)) / (n(host) + K), the row itself left out.

The tables of declared languages, suffixes and hosts are grouped counts of the
languages that the text alone suggests, over all rows. The text model is
fitted on at most about ``SAMPLE`` labelled documents a language, drawn by a hash
of the id (the one bounded sample here); counts and the model's size are fixed
by ``BUCKETS``. A language ``und`` stands for text like none of the known ones: all
trigrams equally likely.

A row is accepted if its best language is a known one with posterior of at
least ``MIN_POSTERIOR`` and its text has letters. Null and empty texts, and all
rows if there is no labelled document to learn from, are ``und`` and rejected.
Null hosts, declarations and suffixes are no evidence. Rows are judged one by
one, so repeated rows and ids get equal results. Texts are read whole.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm import textbytes as tb
from calibra.llm.common import bounded_batches, cut, on_workers, table

BUCKETS = 1 << 16
SAMPLE = 4000
TEMPER = 3.0
STRENGTH = 20.0         # K: rows that a parent's prior counts for
MIN_POSTERIOR = 0.5
UNKNOWN_PRIOR = 1e-3
UNKNOWN = "und"
OWN = "__language_evidence"

_MAP = np.full(256, 0x20, dtype=np.uint8)
_MAP[0x80:] = np.arange(0x80, 0x100)
for _c in range(26):
    _MAP[65 + _c] = _MAP[97 + _c] = 97 + _c
_MARKUP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;")


def trigrams(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts at each byte, and whether it counts (inside a row, a letter in the middle)."""
    t = _MAP[b]
    n = len(t)
    if n < 3:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    after = np.zeros(n, bool)
    after[1:] = t[:-1] == 0xC3
    upper = after & (t >= 0x80) & (t <= 0x9E) & (t != 0x97)
    t = np.where(upper, t + 0x20, t).astype(np.uint32)
    code = t.copy()
    code[:-2] = (t[:-2] * np.uint32(65599) + t[1:-1]) * np.uint32(65599) + t[2:]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    counts = np.zeros(n, bool)
    counts[:-2] = t[1:-1] != 0x20
    ends = offs[1:]
    for back in (1, 2):
        at = ends - back
        counts[at[at >= 0]] = False
    return code.astype(np.int64), counts


def _plain(batch, column: int, html: int | None):
    """Bytes and offsets of the texts, markup removed where the flag column says so."""
    col = batch.column(column)
    if html is not None:
        flags = batch.column(html).to_pylist()
        col = pa.array([_MARKUP.sub(b" ", x or b"") if f else x for x, f in zip(col.to_pylist(), flags)], pa.binary())
    return tb.text_bytes(col)


def _learn(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        b, offs = tb.text_bytes(batch.column(1))
        for r, lang in enumerate(langs):
            code, counts = trigrams(b[offs[r]:offs[r + 1]], np.array([0, offs[r + 1] - offs[r]]))
            part = np.bincount(code[counts], minlength=BUCKETS)
            sums[lang] = sums[lang] + part if lang in sums else part
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))],
                                         ["lang", "bucket", "n"])


class TextModel:
    """Log probabilities of the trigram buckets for each language, with the unknown one last."""

    def __init__(self, langs: list[str], logs: np.ndarray):
        self.langs, self.logs = langs, logs

    def score(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages) log likelihoods and the number of trigrams of each row."""
        out = np.zeros((len(offs) - 1, len(self.langs) + 1))
        size = np.zeros(len(offs) - 1, np.int64)
        for i, j in tb.doc_groups(offs, tb.SEGMENT // 2):
            o = offs[i:j + 1] - offs[i]
            code, counts = trigrams(b[offs[i]:offs[j]], o)
            seen = np.concatenate([[0], np.cumsum(counts)])
            size[i:j] = seen[o[1:]] - seen[o[:-1]]
            code = code[counts]
            stop = seen[o]
            for k in range(len(self.langs)):
                sums = np.concatenate([[0.0], np.cumsum(self.logs[k][code], dtype=np.float64)])
                out[i:j, k] = sums[stop[1:]] - sums[stop[:-1]]
            out[i:j, -1] = -np.log(BUCKETS) * size[i:j]
        return out, size


def fit_text(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> TextModel:
    """The text model from about ``sample`` labelled documents of each language."""
    on_workers(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    given = docs.select(F.lower(F.col(lang_col)).alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    given = given.where("lang is not null and lang <> ''")
    counts = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(x for x in counts if x != UNKNOWN)
    if not langs:
        return TextModel([], np.zeros((0, BUCKETS)))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / counts[lang]))).otherwise(share)
    drawn = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * F.lit(float(1 << 20))).select("lang", "body")
    sums = drawn.mapInArrow(_learn, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    logs = np.full((len(langs), BUCKETS), 0.5)
    at = np.array([langs.index(x) for x in sums.column("lang").to_pylist()], np.int64)
    logs[at, sums.column("bucket").to_numpy()] += sums.column("n").to_numpy()
    return TextModel(langs, np.log(logs / logs.sum(1, keepdims=True)))


def _scores(shared, text_at: int, html_at: int | None, drop_html: bool):
    def run(batches):
        model = shared.value
        kind = pa.struct([("ll", pa.list_(pa.float64())), ("n", pa.int64()), ("best", pa.int32())])
        for batch in batches:
            if not batch.num_rows:
                continue
            b, offs = _plain(batch, text_at, html_at)
            ll, n = model.score(b, offs)
            best = np.where(n > 0, ll.argmax(1), len(model.langs))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, ll.shape[1]).astype(np.int32)), pa.array(ll.ravel()))
            own = pa.StructArray.from_arrays([lists, pa.array(n), pa.array(best.astype(np.int32))], fields=list(kind))
            keep = [c for i, c in enumerate(batch.columns) if not (drop_html and i in (text_at, html_at))]
            names = [x for i, x in enumerate(batch.schema.names) if not (drop_html and i in (text_at, html_at))]
            yield pa.RecordBatch.from_arrays([*keep, own], [*names, OWN])
    return run


EVIDENCE = "struct<ll:array<double>,n:bigint,best:int>"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.when(host.isNotNull(), F.substring_index(host, ".", -2))


def _counts(rows: DataFrame, key: str, langs: int) -> DataFrame:
    """One row per value of ``key``: how many of its rows the text alone gives to each language."""
    sums = [F.sum(F.when(F.col(f"{OWN}.best") == i, 1).otherwise(0)).cast("double") for i in range(langs)]
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__{key}")).agg(F.array(*sums).cast("array<double>").alias(f"__n_{key}"))


class Evidence:
    """Grouped counts over all rows: written tables keyed by declaration, suffix, domain and host."""

    KEYS = ("__declared", "__suffix", "__domain", "__host")

    def __init__(self, rows: DataFrame, model: TextModel):
        known = rows.where(F.col(f"{OWN}.best") < len(model.langs))
        self.model = model
        self.tables = {k: cut(_counts(known, k, len(model.langs)), "evidence") for k in self.KEYS}
        got = known.agg(F.count(F.lit(1)), *[F.sum(F.when(F.col(f"{OWN}.best") == i, 1).otherwise(0)) for i in range(len(model.langs))]).first()[1:]
        self.totals = [float(x or 0) for x in got]
        self.sizes = {k: self.tables[k].count() for k in ("__declared", "__suffix")}

    def judge(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``__lang``, ``__posterior``, ``__accepted``."""
        n, m = len(self.model.langs), sum(self.totals)
        df = rows
        for k in self.KEYS:
            df = df.join(self.tables[k], F.col(k) == F.col(f"__{k}"), "left").drop(f"__{k}")
        best = F.col(f"{OWN}.best")
        names = []
        for i in range(n):
            own = F.when(best == i, 1.0).otherwise(0.0)
            any_own = F.when(best < n, 1.0).otherwise(0.0)
            count = lambda k: F.coalesce(F.get(F.col(f"__n_{k}"), F.lit(i)), F.lit(0.0))  # noqa: B023, E731
            total = lambda k: F.coalesce(F.aggregate(f"__n_{k}", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
            root = F.lit((self.totals[i] + 1.0) / (m + n))
            prior = root
            for k in ("__domain", "__host"):
                here = F.col(f"__n_{k}").isNotNull()
                prior = (F.greatest(count(k) - F.when(here, own).otherwise(0.0), F.lit(0.0)) + F.lit(STRENGTH) * prior) / (
                    F.greatest(total(k) - F.when(here, any_own).otherwise(0.0), F.lit(0.0)) + F.lit(STRENGTH))
            logp = F.get(F.col(f"{OWN}.ll"), F.lit(i)) / F.lit(TEMPER) + F.log(prior)
            for k in ("__declared", "__suffix"):
                seen = F.greatest(count(k) - own, F.lit(0.0)) + 1.0
                logp = logp + F.when(F.col(k).isNotNull(), F.log(seen / F.lit(self.totals[i] + self.sizes[k] + 1.0))).otherwise(F.lit(0.0))
            df = df.withColumn(f"__p{i}", logp)
            names.append(f"__p{i}")
        none = F.get(F.col(f"{OWN}.ll"), F.lit(n)) / F.lit(TEMPER) + F.log(F.lit(UNKNOWN_PRIOR))
        for k in ("__declared", "__suffix"):
            none = none - F.when(F.col(k).isNotNull(), F.log(F.lit(self.sizes[k] + 1.0))).otherwise(F.lit(0.0))
        df = df.withColumn(f"__p{n}", none)
        names.append(f"__p{n}")
        top = F.greatest(*names) if n else F.col(names[0])
        df = df.withColumn("__top", top)
        norm = sum((F.exp(F.col(x) - F.col("__top")) for x in names), F.lit(0.0))
        lang = F.lit(UNKNOWN)
        for i in reversed(range(n)):
            lang = F.when(F.col(f"__p{i}") == F.col("__top"), F.lit(self.model.langs[i])).otherwise(lang)
        has_text = F.col(f"{OWN}.n") > 0
        df = df.withColumn("__lang", F.when(has_text, lang).otherwise(F.lit(UNKNOWN))).withColumn("__posterior", 1.0 / norm)
        df = df.withColumn("__accepted", has_text & (F.col("__lang") != UNKNOWN) & (F.col("__posterior") >= MIN_POSTERIOR))
        return df.drop(*names, "__top", *[f"__n_{k}" for k in self.KEYS])


def with_evidence(rows: DataFrame, model: TextModel, text_col: str, html_col: str | None = None, drop_text: bool = False) -> DataFrame:
    """``rows`` with the text's scores; ``html_col`` flags rows whose text is markup."""
    on_workers(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at, html = rows.columns.index(text_col), None if html_col is None else rows.columns.index(html_col)
    schema = [f for i, f in enumerate(rows.schema.fields) if not (drop_text and i in (at, html))]
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(_scores(shared, at, html, drop_text), f"{text}{', ' if text else ''}`{OWN}` {EVIDENCE}")


def _keys(host: Column, declared: Column, suffix: Column) -> list[Column]:
    return [F.lower(declared).alias("__declared"), suffix.alias("__suffix"), domain_of(host).alias("__domain"), host.alias("__host")]


def identify(spark, documents: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """kind, doc_id, page_id, lang, posterior, text_lang, accepted for every document and page."""
    model = fit_text(documents)
    none = F.lit(None).cast("string")
    rows = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"),
                            *_keys(F.col("source"), F.col("lang"), none), F.col("text").cast("binary").alias("body"), F.lit(False).alias("html"))
    if pages is not None:
        host = host_of(F.col("url"))
        declared = F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit(""))
        rows = rows.unionByName(pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"),
                                             *_keys(host, declared, suffix_of(host)), F.col("html").cast("binary").alias("body"), F.lit(True).alias("html")))
    scored = cut(with_evidence(rows, model, "body", "html", drop_text=True), "languages")
    out = Evidence(scored, model).judge(scored)
    names = F.array(*[F.lit(x) for x in [*model.langs, UNKNOWN]])
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return out.select("kind", of("document").alias("doc_id"), of("page").alias("page_id"), F.col("__lang").alias("lang"),
                      F.col("__posterior").alias("posterior"), F.get(names, F.col(f"{OWN}.best")).alias("text_lang"), F.col("__accepted").alias("accepted"))


def keep_identified(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rejected ones, the language column set to the identified language."""
    model = fit_text(docs, lang_col, id_col, text_col)
    keys = _keys(F.col(source_col), F.col(lang_col), F.lit(None).cast("string"))
    narrow = docs.select(*keys, F.col(text_col).cast("binary").alias("body"), F.lit(False).alias("html"))
    evidence = Evidence(cut(with_evidence(narrow, model, "body", "html", drop_text=True), "languages"), model)
    own = {c: f"column_{i}" for i, c in enumerate(docs.columns)}      # no name of the caller can meet one of ours
    judged = evidence.judge(with_evidence(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()], *keys), model, own[text_col])).where("__accepted")
    return judged.select(*[F.col("__lang" if c == lang_col else x).alias(c) for c, x in own.items()])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
