"""URL verdicts: host and path rules first, gradient-boosted trees for the rest.

URLs that a rule covers are the labelled ones. The trees learn from lexical features of
at most `MOST_TRAINING` of them, chosen by hash: length, depth, digit ratio, entropy,
parameter counts, and how often a host suffix was blocked. That is counted over all labelled
URLs, for a labelled one over those outside its own fold, so no URL's own label is among its
features. The table of all suffixes is broadcast if it is counted to be small, else joined by a shuffle.

Results for odd input. A null URL, or one without `://`, has an empty host and path and no
rule. Without labelled URLs of both kinds the verdict for the rest is that of the kind
there is, or allow. Repeated rows give repeated results; an empty table gives an empty
result; a very long URL is read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, materialize, ship, table

#: Rule, and its verdict; a rule is a host and the start of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MOST_TRAINING = 20_000
#: Folds by hash of id and URL; suffixes are counted outside of a URL's own.
FOLDS = 5
#: Weight of the overall rate in a suffix's rate, in rows.
PRIOR = 10.0
TREES, DEPTH = 10, 4
LEXICAL = ["n_chars", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "host_chars", "last_chars", "scheme_s", "has_fragment"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, decides in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decides)).otherwise(verdict)
    return rule, verdict


def lexical(urls: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: adds the LEXICAL features, of url, host and path, to a batch."""
    for batch in urls:
        rows = []
        for url, host, path in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url", "host", "path")), strict=True):
            url = url or ""
            raw = np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8)
            share = np.bincount(raw)[np.unique(raw)] / len(raw) if len(raw) else np.zeros(0)
            query = url.partition("?")[2].partition("#")[0]
            parts = [p for p in path.split("/") if p]
            digits = int(((raw >= 48) & (raw <= 57)).sum())
            rows.append((len(url), len(parts), digits / max(1, len(raw)), float(-(share * np.log2(share)).sum()), query.count("=") if query else 0, host.count(".") + 1 if host else 0, len(host), len(parts[-1]) if parts else 0, url.startswith("https"), "#" in url))
        values = np.array(rows, np.float64).reshape(-1, len(LEXICAL))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(values[:, k]) for k in range(len(LEXICAL)))], names=[*batch.schema.names, *LEXICAL])


def _rows(pages: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """id, url, host, path, rule, decided (the rule's verdict), suffix (the last two labels of the host), fold."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, decided = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": decided})
    suffix = F.array_join(F.slice(F.concat(F.array(F.lit("")), F.split("host", r"\.")), -2, 2), ".")
    return rows.withColumns({"suffix": suffix, "fold": F.when(rule.isNotNull(), F.pmod(F.xxhash64("id", "url"), F.lit(FOLDS)).cast("int")).otherwise(-1)})


def suffix_rates(labelled: DataFrame, rate: float) -> DataFrame:
    """suffix, fold, suffix_rate: of labelled rows outside that fold the share blocked, drawn to `rate`; fold -1: of all."""
    counts = labelled.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decided") == "block").alias("blocked"))
    total = counts.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
    each = total.select("*", F.explode(F.array(*map(F.lit, range(-1, FOLDS)))).alias("fold")).join(counts, ["suffix", "fold"], "left").fillna(0, ["n", "blocked"])
    value = (F.col("all_blocked") - F.col("blocked") + PRIOR * rate) / (F.col("all_n") - F.col("n") + PRIOR)
    return each.select("suffix", "fold", value.alias("suffix_rate"))


def _featured(rows: DataFrame, rates: DataFrame, rate: float) -> DataFrame:
    schema = f"id {dict(rows.dtypes)['id']}, url string, host string, path string, rule string, decided string, suffix string, fold int, " + ", ".join(f"{c} double" for c in LEXICAL)
    featured = ship(rows).mapInArrow(lexical, schema).join(rates, ["suffix", "fold"], "left").fillna(rate, ["suffix_rate"])
    return VectorAssembler(inputCols=[*LEXICAL, "suffix_rate"], outputCol="features").transform(featured)


def train(labelled: DataFrame, total: int, blocked: int) -> tuple[GBTClassificationModel, DataFrame, float]:
    """The trees, the table of suffix rates and the overall rate, from `total` labelled rows of which some are blocked and some not."""
    rate = blocked / total
    rates = broadcast_if_small(materialize(suffix_rates(labelled, rate), "suffixes"))
    chosen = F.pmod(F.xxhash64("url", "id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MOST_TRAINING / total))
    sample = _featured(labelled.where(chosen), rates, rate).select("features", (F.col("decided") == "block").cast("double").alias("label"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7).fit(materialize(sample, "labelled").coalesce(8))
    return model, rates, rate


def _counts(labelled: DataFrame) -> tuple[int, int]:
    return tuple(labelled.agg(F.count(F.lit(1)), F.count_if(F.col("decided") == "block")).first())


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict, score (the trees' probability of block; null under a rule)."""
    rows = _rows(pages, id_col, url_col, rules)
    labelled = rows.where("decided is not null")
    total, blocked = _counts(labelled)
    result = lambda df, verdict, score: df.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("decided", verdict).alias("verdict"), score.cast("double").alias("score"))
    if blocked in (0, total):
        return result(rows, F.lit("block" if blocked else "allow"), F.lit(None))
    model, rates, rate = train(labelled, total, blocked)
    scored = model.transform(_featured(rows.where("decided is null"), rates, rate)).withColumn("score", vector_to_array("probability")[1])
    scored = result(scored, F.when(F.col("score") > 0.5, "block").otherwise("allow"), F.col("score"))
    return result(labelled, F.lit(None), F.lit(None)).unionByName(scored)


def held_out_auc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> float:
    """Area under the ROC curve on labelled URLs of fold 0, for trees and suffix rates made without that fold."""
    labelled = _rows(pages, id_col, url_col, rules).where("decided is not null")
    known, test = labelled.where("fold <> 0"), labelled.where("fold = 0").withColumn("fold", F.lit(-1))
    model, rates, rate = train(known, *_counts(known))
    scored = model.transform(_featured(test, rates, rate)).withColumn("label", (F.col("decided") == "block").cast("double"))
    return BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
