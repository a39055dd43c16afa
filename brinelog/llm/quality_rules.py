r"""Operator 6: quality rules under weak supervision, in DataFrame and SQL functions only.

Each rule looks at a document's measures and votes good (1), bad (-1) or abstains
(0).  Expectation-maximisation over the histogram of vote patterns (at most
3 ** len(RULES) rows, whatever the corpus) estimates each rule's accuracy on good
and on bad documents, where it votes, and how common good documents are; the
posterior probability of good then replaces a filter that all rules must pass.  The iteration itself is one SQL
``aggregate`` over the collected histogram; its one row of parameters is the only
thing that reaches the driver.

Words are runs of anything but ASCII white space.  Repeated 5-word windows are
found by 64-bit hashes within one document; a document whose hashes all differ has no
repeated window.

Defined results: null and empty texts have no words and fail the base rules;
rows are judged one by one, so repeated rows and ids get repeated
results; ties at the threshold are kept; extra columns are not looked at; an
empty table gives no row.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, texts_of, written

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
STEPS = 40
#: Weight of the prior rates of a rule, as a share of all documents (and ten documents more).
PRIOR = 0.01
RULES = ("length", "symbols", "symbol_share", "symbol_kinds", "dup_lines", "repeats", "word_size", "line_words", "stops", "digits")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stops", "n_digits", "n_symbol_kinds"]


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(rows: DataFrame) -> DataFrame:
    """The measures (all long) of every whole text of a table with doc_id and text, next to all its columns but the text."""
    others = [c for c in rows.columns if c != "text"]
    trimmed = F.btrim(F.col("text"), F.lit(SPACES))
    rows = rows.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    last = F.size("hashes") - WINDOW
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW))))
    rows = rows.withColumn("windows", F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>")))
    # Positions of repeated windows: neighbours with equal hashes once (hash, position) is sorted.
    order = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("order", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), order))
    at = lambda k: F.get("order", k)["h"]
    twice = F.filter("order", lambda x, k: F.coalesce(x["h"] == at(k - 1), F.lit(False)) | F.coalesce(x["h"] == at(k + 1), F.lit(False)))
    rows = rows.withColumn("starts", F.when(F.col("order").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    size = F.octet_length("text")
    return rows.select(
        *others,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (size - F.octet_length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (size - F.octet_length(_without(F.col("text"), ".!?"))).cast("long").alias("n_stops"),
        (size - F.octet_length(_without(F.col("text"), "0123456789"))).cast("long").alias("n_digits"),
        reduce(add, (F.contains("text", F.lit(c)).cast("long") for c in SYMBOLS)).alias("n_symbol_kinds"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes of each rule on a row of measures; a rule abstains where a text is too short for it."""
    n, per = F.col("n_words"), lambda c: F.try_divide(F.col(c), F.col("n_words"))
    return {
        "length": _vote(n < 20, n >= 60),
        "symbols": _vote(per("n_symbols") > 0.1, per("n_symbols") <= 0.01),
        "symbol_share": _vote(F.try_divide("n_symbols", "word_chars") > 0.03, F.try_divide("n_symbols", "word_chars") <= 0.003),
        "symbol_kinds": _vote(F.col("n_symbol_kinds") >= 4, F.col("n_symbol_kinds") <= 1),
        "dup_lines": _vote(F.try_divide("n_dup_lines", "n_lines") > 0.3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 3)),
        "repeats": _vote(per("n_repeat_words") > 0.2, per("n_repeat_words") <= 0.02),
        "word_size": _vote((per("word_chars") < 2.5) | (per("word_chars") > 14), per("word_chars").between(3.5, 10)),
        "line_words": _vote((n >= 20) & (n < 3 * F.col("n_lines")), n >= 6 * F.col("n_lines")),
        "stops": _vote((n >= 60) & (per("n_stops") < 0.005), per("n_stops").between(0.02, 0.35)),
        "digits": _vote(F.try_divide("n_digits", "word_chars") > 0.2, F.try_divide("n_digits", "word_chars") <= 0.02),
    }


def fit(votes: DataFrame, steps: int = STEPS) -> dict[str, list[float]]:
    """EM on a table with ``votes`` array<int>: the share of good documents, and each rule's rate of bad votes on good and on bad ones."""
    m = len(RULES)
    histogram = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n")).agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("h"))
    start = f"named_struct('share', 0.9D, 'on_good', array_repeat(0.02D, {m}), 'on_bad', array_repeat(0.4D, {m}))"
    prior = "ln(p.share / (1 - p.share))"
    weight = "CASE v WHEN 1 THEN ln((1 - get(p.on_good, j)) / (1 - get(p.on_bad, j))) WHEN -1 THEN ln(get(p.on_good, j) / get(p.on_bad, j)) ELSE 0D END"
    logit = f"{prior} + aggregate(transform(t.votes, (v, j) -> {weight}), 0D, (s, x) -> s + x)"
    good = f"transform(h, t -> named_struct('votes', t.votes, 'n', t.n, 'q', 1 / (1 + exp(-({logit})))))"

    weight_of_prior = f"aggregate(w, 10D, (s, t) -> s + {PRIOR}D * t.n)"

    def rate(of: str, start: float) -> str:
        """Bad votes among the votes of each rule, weighted, with a prior at the start's rate."""
        bad = f"aggregate(w, {start}D * {weight_of_prior}, (s, t) -> s + CASE WHEN get(t.votes, j) = -1 THEN t.n * {of} ELSE 0D END)"
        cast = f"aggregate(w, {weight_of_prior}, (s, t) -> s + CASE WHEN get(t.votes, j) <> 0 THEN t.n * {of} ELSE 0D END)"
        return f"transform(sequence(0, {m - 1}), j -> {bad} / {cast})"

    share = "aggregate(w, 9D, (s, t) -> s + t.n * t.q) / aggregate(w, 10D, (s, t) -> s + t.n)"
    fresh = f"named_struct('share', {share}, 'on_good', {rate('t.q', 0.02)}, 'on_bad', {rate('(1 - t.q)', 0.4)})"
    step = f"get(transform(array({good}), w -> {fresh}), 0)"
    p = histogram.select(F.expr(f"aggregate(sequence(1, {int(steps)}), {start}, (p, k) -> {step})").alias("p")).first()["p"]
    return {"share": [p["share"]], "on_good": list(p["on_good"]), "on_bad": list(p["on_bad"])}


def _judged(rows: DataFrame, threshold: float) -> DataFrame:
    measured = written(measures(rows), "measures")
    votes = F.array(*rules().values())
    p = fit(measured.select(votes.alias("votes")))
    logit = F.lit(math.log(p["share"][0] / (1 - p["share"][0])))
    for vote, on_good, on_bad in zip(rules().values(), p["on_good"], p["on_bad"], strict=True):
        logit = logit + F.when(vote == 1, math.log((1 - on_good) / (1 - on_bad))).when(vote == -1, math.log(on_good / on_bad)).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measured.select("*", failed.alias("base_failed"), (1 / (1 + F.exp(-logit))).alias("p_good"), votes.alias("votes"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def judge(df: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed, p_good, votes and kept for every row."""
    return _judged(texts_of(df, id_col, text_col), threshold)


def good(df: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a table that are kept, with its columns."""
    rows, restore, _ = carried(df, id_col, text_col)
    # The text is carried next to its measures, so that no join has to bring the two together again.
    whole = F.struct("*").alias("row")
    judged = _judged(rows.select("doc_id", "text", whole), threshold)
    return judged.where("kept").select("row.*").select(*restore)
