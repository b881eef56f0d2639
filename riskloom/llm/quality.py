"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over the row's own text (no shuffle, no user function),
and every rule of the table is a comparison of one ratio of measures with a threshold.

Defined results: a null or blank text has no words, fails the base rules and is not kept;
repeated rows get the same verdict each; all columns of the input stay, an input column
named like the verdict column is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE_CLASS, SPACES, boxed, unboxed, word_array

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish, lower case.
STOP_WORDS = ("the and of to in that is for with as this from an "
              "le la les de des et un une que qui pour dans sur par "
              "der die das und ein von zu mit den dem ist auf "
              "el los las del y en con por para se").split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``scale * measure`` compared with ``threshold * per`` holds."""

    measure: str
    op: str  # "<=" or ">="
    threshold: int
    per: str | None = None
    scale: int = 1

    def column(self) -> Column:
        left = F.col(self.measure) * self.scale
        right = F.lit(self.threshold) * (F.col(self.per) if self.per else F.lit(1))
        return {"<=": left <= right, ">=": left >= right}[self.op]


#: Texts that fail one of these fail the base.
BASE_RULES = (
    Rule("n_words", ">=", 50),
    Rule("n_repeat_words", "<=", 50, per="n_words", scale=100),
)
#: The method's own rules, integers throughout so that no rounding can differ.
RULES = (
    Rule("word_chars", ">=", 2, per="n_words"),                   # mean word length
    Rule("word_chars", "<=", 12, per="n_words"),
    Rule("n_symbols", "<=", 20, per="n_words", scale=100),        # symbols to words
    Rule("n_stop_words", ">=", 1),                                # different stop words
    Rule("n_dup_lines", "<=", 50, per="n_lines", scale=100),      # repeated lines
    Rule("n_ellipsis_lines", "<=", 50, per="n_lines", scale=100),  # lines that break off
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_stop_words", "n_lines", "n_ellipsis_lines")


def all_hold(rules) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & r.column()
    return out


def _measured(df: DataFrame, text: Column) -> DataFrame:
    """Adds MEASURES. Intermediate arrays are columns used more than once, so Spark computes each once."""
    df = df.withColumn("text_", F.coalesce(text, F.lit("")))
    df = df.withColumn("words_", word_array(F.col("text_")))
    df = df.withColumn("lines_", F.filter(F.split("text_", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")))
    bare = F.col("text_")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    df = df.select(
        "*",
        F.size("words_").cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        (F.length("text_") - F.length(bare)).cast("long").alias("n_symbols"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines_", lambda x: F.btrim(x, F.lit(SPACES)).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.array_intersect(F.split(F.lower(F.array_join("words_", " ")), " "), F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )
    # Windows of three words: the upper bits of each number are the window's hash, the lower
    # ``bits_`` its place, so one sort of numbers brings equal windows together. Neighbours
    # with the same hash are compared word by word before they count.
    df = df.withColumn("bits_", F.length(F.bin("n_words")))
    df = df.withColumn("wins_", F.expr(
        "CASE WHEN n_words >= 3 THEN sort_array(transform(sequence(0, size(words_) - 3), i -> "
        "shiftleft(xxhash64(words_[i], words_[i + 1], words_[i + 2]), bits_) | i)) ELSE cast(array() AS array<bigint>) END"))
    same = ("shiftright({a}, bits_) = shiftright({b}, bits_) AND "
            "words_[cast({a} & mask_ AS int)] = words_[cast({b} & mask_ AS int)] AND "
            "words_[cast({a} & mask_ AS int) + 1] = words_[cast({b} & mask_ AS int) + 1] AND "
            "words_[cast({a} & mask_ AS int) + 2] = words_[cast({b} & mask_ AS int) + 2]")
    df = df.withColumn("mask_", F.expr("shiftleft(1L, bits_) - 1"))
    df = df.withColumn("hits_", F.expr(
        "sort_array(transform(filter(wins_, (g, k) -> CASE WHEN k > 0 AND " + same.format(a="g", b="wins_[k - 1]")
        + " THEN true WHEN k + 1 < size(wins_) THEN " + same.format(a="g", b="wins_[k + 1]")
        + " ELSE false END), g -> cast(g & mask_ AS int)))"))
    return df.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(hits_, (p, k) -> CASE WHEN k + 1 < size(hits_) THEN least(3, hits_[k + 1] - p) ELSE 3 END), "
        "0L, (a, x) -> a + x)"))


def quality_rules(docs: DataFrame, text: str = "text", verdict: str = "quality",
                  rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``docs`` plus the struct ``verdict``: MEASURES, ``base_failed`` and ``kept``."""
    df = boxed(docs)
    df = _measured(df, F.col(f"row_in.`{text}`"))
    df = df.withColumn("base_failed", ~all_hold(base))
    # Spark doesn't push a filter through a projection that isn't deterministic. Pushed through this
    # one, a filter on the verdict would hold each measure's whole expression many times over.
    as_computed = F.monotonically_increasing_id() >= 0  # always true
    df = df.withColumn("kept", ~F.col("base_failed") & all_hold(rules) & as_computed)
    return unboxed(df.withColumn(verdict, F.struct(*MEASURES, "base_failed", "kept")), [verdict])
