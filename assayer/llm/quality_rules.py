"""Quality rules with risk-controlled thresholds (operator 4).

Each rule measures a badness in thousandths, an integer from 0 to 1000. For each stratum (the
document's language) the labelled documents are a holdout: a cutoff may be used only if an exact
binomial test rejects "this cutoff turns away a share of good documents of ``alpha`` or more".
Within a stratum and rule the cutoffs are tested from the mildest to the strictest and testing ends
at the first failure (fixed-sequence testing, so one level serves the whole sequence); across
strata and rules the level ``delta`` is divided by their number (Bonferroni), and ``alpha`` is
divided among the rules, so that with probability 1 - ``delta`` no stratum loses a share of more
than ``alpha`` of its good documents to all rules together. A stratum with too few labels certifies
no cutoff and loses nothing to this method; the fixed base rules still hold there.

Defined results: a null text has no words and fails the base rules; a null stratum is a stratum of
its own; repeated rows are judged one by one; repeated label rows count once, and of contradicting
labels of one document the lowest counts; labels without quality are left out; with no documents or
no labels there is no cutoff. Input columns that have the name of an output column are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import add_columns, encode, materialise, table

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
#: Badness of each rule, in thousandths.
RULES = ("symbol_pm", "dup_line_pm", "repeat_pm", "upper_pm", "bare_pm")
RULE_FIELDS = [T.StructField(n, T.IntegerType()) for n in RULES]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ALPHA = 0.02
DELTA = 0.05
#: Above this many strata the cutoffs are joined by a shuffle instead of a broadcast.
BROADCAST_STRATA = 10_000
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def _share(part: int, whole: int) -> int:
    return min(1000, part * 1000 // whole) if whole else 0


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    v = len(seen)
    if v == n:
        return 0
    if v < 2_000_000:
        code = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        code = pair[:-1] * v + ids[2:]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    hit = np.zeros(n, dtype=bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The five base counts, then the badness of each rule."""
    if not text:
        return (0,) * (len(BASE_FIELDS) + len(RULES))
    words = encode(text).split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in BLANK)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper = len(_UPPER.findall(text))
    bare = sum(len(w) == 1 for w in words)
    return (
        n, word_chars, n_symbols, dup, repeat,
        _share(n_symbols, word_chars), _share(dup, len(lines)), _share(repeat, n), _share(upper, word_chars), _share(bare, n),
    )


def measure_documents(docs: DataFrame, text: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    fields = [*BASE_FIELDS, *RULE_FIELDS]
    return add_columns(docs, [text], lambda _, texts: list(zip(*map(measure, texts), strict=True)) or [[]] * len(fields), fields, keep=None if keep is None else list(keep))


def base_failed(n_words: F.Column = None, n_repeat: F.Column = None):
    n_words, n_repeat = F.col("n_words") if n_words is None else n_words, F.col("n_repeat_words") if n_repeat is None else n_repeat
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= x), summed exactly over its terms in logarithms."""
    if n <= 0:
        return 1.0
    if x >= n:
        return 1.0
    k = np.arange(x + 1)
    lg = np.array([math.lgamma(i + 1) for i in range(x + 1)]) + np.array([math.lgamma(n - i + 1) for i in range(x + 1)])
    terms = math.lgamma(n + 1) - lg + k * math.log(p) + (n - k) * math.log1p(-p)
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def certified_cutoff(bins: Iterable[tuple[int, int, int]], good: int, alpha: float, level: float) -> int | None:
    """The smallest certified cutoff c ("turn away at c or above"), or None.

    ``bins``: (badness, good documents, all labelled documents). Only cutoffs at an observed
    badness differ in effect. Badness 0 is never a cutoff.
    """
    best, x = None, 0
    for value, n_good, _ in sorted(bins, reverse=True):
        x += n_good
        if value <= 0 or binomial_tail(x, good, alpha) > level:
            break
        best = value
    return best


def fit_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum that has labels: stratum and a nullable cutoff ``cut_<rule>`` for each rule.

    What meets in one place is one count for each stratum, rule and badness (at most 1001).
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good"))
    rated = (
        measured.where(~base_failed()).select("doc_id", F.col(f"`{stratum}`").cast("string").alias("stratum"), *RULES)
        .join(marks, "doc_id")
        .select("stratum", "_good", F.posexplode(F.array(*RULES)).alias("rule", "badness"))
        .groupBy("stratum", "rule", "badness").agg(F.sum(F.col("_good").cast("long")).alias("good"), F.count("*").alias("n"))
    )
    # one row for each stratum and rule, and every stratum has all rules
    rated = rated.groupBy("stratum", "rule").agg(F.collect_list(F.struct("badness", "good", "n")).alias("bins"))
    rated = materialise(rated, "risk-counts")
    strata = rated.count() // len(RULES)
    level, share = delta / max(1, strata * len(RULES)), alpha / len(RULES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = [[(x["badness"], x["good"], x["n"]) for x in found] for found in b.column("bins").to_pylist()]
            best = [certified_cutoff(x, sum(good for _, good, _ in x), share, level) for x in bins]
            yield pa.RecordBatch.from_arrays([b.column("stratum"), b.column("rule"), pa.array(best, pa.int32())], names=["stratum", "rule", "cut"])

    cuts = rated.mapInArrow(cut, "stratum string, rule int, cut int")
    return cuts.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == i, F.col("cut"))).alias(f"cut_{r}") for i, r in enumerate(RULES)))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Append base_failed, kept and broken_rules (names of the certified rules that the row breaks)."""
    cutoffs = materialise(cutoffs, "risk-cutoffs")
    n = cutoffs.count()
    side = cutoffs.withColumnRenamed("stratum", "_stratum")
    side = F.broadcast(side) if n <= BROADCAST_STRATA else side
    rows = measured.join(side, F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col("_stratum")), "left")
    broken = F.filter(F.array(*(F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    rows = rows.withColumns({"base_failed": base_failed(), "broken_rules": broken})
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    return rows.drop("_stratum", *(f"cut_{r}" for r in RULES))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Documents that pass, with their own columns: two passes, one to fit and one to judge."""
    if stratum not in docs.columns:
        docs = docs.withColumn(stratum, F.lit(None).cast("string"))
    cutoffs = fit_cutoffs(measure_documents(docs, keep=["doc_id", stratum]), labels, stratum)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"), F.col(f"`{stratum}`").alias("_lang"))
    return judge(measure_documents(own), cutoffs, "_lang").where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = materialise(measure_documents(docs.select("doc_id", "lang", "text"), keep=["doc_id", "lang"]), "rule-measures")
    judged = judge(measured, fit_cutoffs(measured, labels))
    return judged.select("doc_id", *(f.name for f in BASE_FIELDS), "base_failed", "kept")
