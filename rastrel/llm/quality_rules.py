"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window for repeats.
WINDOW = 8
# Characters that count as symbols, and stop words of English, French, German and Spanish.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that it for on with as was are this be at by or from have an not he "
    "de la le et les des en un une que qui dans est pour par sur au pas plus el los las y se del con para su "
    "der die und das den von zu mit sich im ist ein eine dem nicht auf für als auch"
).split()


class Rule(NamedTuple):
    """A metric's allowed range, both ends included; None leaves an end open."""

    metric: str
    least: float | None
    most: float | None


#: Base rules are n_words and repeat_percent; the others are the method's verdict.
RULES = (
    Rule("n_words", 20, None),
    Rule("repeat_percent", None, 30),
    Rule("mean_word_chars", 2, 16),
    Rule("symbols_per_word", None, 0.1),
    Rule("shouts_per_word", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)
BASE = ("n_words", "repeat_percent")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where every metric of the table lies in its range; a metric that is null passes."""
    passed = F.lit(True)
    for r in rules:
        for bound, ok in ((r.least, F.col(r.metric) >= F.lit(r.least)), (r.most, F.col(r.metric) <= F.lit(r.most))):
            if bound is not None:
                passed = passed & F.coalesce(ok, F.lit(True))
    return passed


#: Columns that judge() adds.
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_percent", "mean_word_chars", "symbols_per_word", "shouts_per_word", "stop_word_ratio", "dup_line_ratio")
ROW = "__row"


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(ROW, the METRICS) of every row of docs: ROW is a struct of its columns, so that none clashes with a metric's name.

    A null text counts as an empty one. Long arrays are projected step by step, so that each is computed once a row:
    words, their hashes, the hashes of all windows, and for texts with equal windows alone the windows' sorted places."""
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    step = step.withColumn("words", F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != F.lit("")))
    step = step.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0))
    count = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    stop = F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:"))).isin(STOP_WORDS))
    step = step.select(
        ROW,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count("!").alias("shouts"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(stop).cast("long").alias("stops"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("names"),
    )
    whole = F.when(F.size("names") >= WINDOW, F.sequence(F.lit(0), F.size("names") - WINDOW)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(whole, lambda i: F.xxhash64(*[F.get("names", i + k) for k in range(WINDOW)]))
    step = step.withColumn("grams", grams).drop("names")
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    step = step.withColumn("placed", F.when(again, F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda k, j: F.get("placed", j)["g"] == F.get("placed", k)["g"]
    twice = F.filter("placed", lambda x, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    step = step.drop("grams").withColumn("places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    repeat = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    step = step.drop("placed").withColumn("n_repeat_words", repeat)
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    found = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.lit(100) * ratio("n_repeat_words", "n_words")).alias("repeat_percent"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("shouts", "n_words").alias("shouts_per_word"),
        ratio("stops", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )
    # A filter on plain columns would be pushed below the projections and compute their arrays over and over; one on what
    # a generator gives stays above it.
    return step.select(ROW, F.explode(F.array(found)).alias("found")).select(ROW, "found.*")


def _verdicts(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """metrics() with base_failed and kept."""
    found = metrics(docs, text_col)
    base, rest = (tuple(r for r in rules if (r.metric in BASE) == own) for own in (True, False))
    return found.withColumn("base_failed", ~compile_rules(base)).withColumn("kept", ~F.col("base_failed") & compile_rules(rest))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the METRICS, base_failed and kept.

    kept is false where a base rule fails, else the verdict of all rules together; a metric without a rule is not
    judged. Null and empty texts have no words and fail by length; very long texts are judged whole. Every row is judged
    alone, so ids, ties and repeated rows don't matter. Columns of docs that are named as a result are replaced by it."""
    added = [*METRICS, "base_failed", "kept"]
    return _verdicts(docs, text_col, rules).select(*[F.col(f"{ROW}.`{c}`") for c in docs.columns if c not in added], *added)


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns only, whatever these are named."""
    return _verdicts(docs, text_col, rules).where("kept").select(f"{ROW}.*")
