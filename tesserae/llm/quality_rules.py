"""Quality rules as weak supervision, in DataFrame expressions only.

Every rule votes (1 keep, -1 reject) or abstains (0). Expectation-maximisation over the table of
vote patterns - at most 3**len(RULES) rows, however many documents there are - estimates how each
rule votes on good and on bad documents and how common good ones are; a document is kept when the
posterior probability that it is good reaches the threshold. No document has to pass every rule.

Defined cases: a null or empty text has no words and fails the base rule (fewer than ``min_words``);
repeated rows are judged alike, each on its own; an empty table gives an empty result; further
columns are passed through by ``judge``, but for those that are named like its results, which are replaced;
internal names start with ``_q_``, and input columns of such names are refused.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Signs that stand alone where words should be.
BARE = list("!#$%&()*+,-./:;<=>?@[]^_{|}~")
#: Most repeated windows that are looked up one by one.
FEW = 16
MIN_WORDS, MAX_REPEATED = 50, 50


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_q``-columns: words and lines of the whole text, and the counts that the rules use."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_q_words", F.expr(f"regexp_extract_all(coalesce({_name(text)}, ''), '{_sql(WORD)}', 0)"))
    d = d.withColumn("_q_lines", F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)))
    d = d.withColumn("_q_n_words", F.size("_q_words").cast("long"))
    d = d.withColumn("_q_grams", F.expr("CASE WHEN _q_n_words >= 3 THEN slice(transform(_q_words, (w, i) -> xxhash64(w, get(_q_words, i + 1), get(_q_words, i + 2))), 1, cast(_q_n_words as int) - 2) ELSE cast(array() AS array<bigint>) END"))
    d = d.withColumn("_q_sorted", F.expr("CASE WHEN size(array_distinct(_q_grams)) < size(_q_grams) THEN sort_array(_q_grams) ELSE cast(array() AS array<bigint>) END"))
    d = d.withColumn("_q_twice", F.expr("array_distinct(filter(_q_sorted, (x, k) -> k > 0 AND x = get(_q_sorted, k - 1)))"))
    # A few repeated windows are looked up one by one; many are found by sorting, so that no text costs the square of its length.
    d = d.withColumn("_q_pairs", F.expr(f"CASE WHEN size(_q_twice) > {FEW} THEN array_sort(transform(_q_grams, (h, i) -> struct(h, i))) ELSE cast(array() AS array<struct<h:bigint,i:int>>) END"))
    d = d.withColumn(
        "_q_found",
        F.expr(
            f"CASE WHEN size(_q_twice) = 0 THEN cast(array() AS array<int>) WHEN size(_q_twice) <= {FEW} THEN filter(transform(_q_grams, (h, i) -> CASE WHEN array_contains(_q_twice, h) THEN i END), i -> i IS NOT NULL) "
            "ELSE array_sort(filter(transform(_q_pairs, (x, k) -> CASE WHEN get(_q_pairs, k - 1).h = x.h OR get(_q_pairs, k + 1).h = x.h THEN x.i END), i -> i IS NOT NULL)) END"
        ),
    )
    count = lambda pattern: (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))).cast("long")
    d = d.withColumns(
        {
            "_q_word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "_q_n_symbols": F.expr(f"size(regexp_extract_all(coalesce({_name(text)}, ''), '{_sql(SYMBOLS)}', 0))").cast("long"),
            "_q_n_lines": F.size("_q_lines").cast("long"),
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_n_repeat": F.expr("aggregate(_q_found, struct(-3 AS last, 0L AS n), (s, p) -> struct(p AS last, s.n + least(p - s.last, 3) AS n), s -> s.n)"),
            "_q_n_upper": count(r"\p{Lu}"),
            "_q_n_bang": (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).cast("long"),
            "_q_n_bare": F.size(F.filter("_q_words", lambda w: w.isin(*BARE))).cast("long"),
            "_q_n_short": F.size(F.filter("_q_words", lambda w: F.length(w) <= 3)).cast("long"),
            "_q_n_long": F.size(F.filter("_q_words", lambda w: F.length(w) >= 6)).cast("long"),
        }
    )
    return d.drop("_q_words", "_q_lines", "_q_grams", "_q_sorted", "_q_twice", "_q_pairs", "_q_found")


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _share(part: str, whole: str) -> Column:
    return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")


def _fault(share: Column, most: float) -> Column:
    """-1 above ``most``, else no vote: that one kind of fault is absent doesn't make a text good."""
    return F.when(share > most, -1).otherwise(0)


#: name -> vote. The bounds of the first seven follow the rules published for MassiveText and its successors (symbols a
#: word above 0.1, repeated lines above 0.3, words in repeated windows above 0.18, fewer than 0.8 of the words with a
#: letter, a mean word length outside 3 to 10), or are of that kind (capitals, exclamation marks). The last two stand in
#: for stop words in any language: texts have short words, and not only long ones.
RULES = {
    "symbols": lambda: _fault(_share("_q_n_symbols", "_q_n_words"), 0.1),
    "dup_lines": lambda: _fault(_share("_q_n_dup_lines", "_q_n_lines"), 0.3),
    "repeats": lambda: _fault(_share("_q_n_repeat", "_q_n_words"), 0.18),
    "capitals": lambda: _fault(_share("_q_n_upper", "_q_word_chars"), 0.25),
    "shouting": lambda: _fault(_share("_q_n_bang", "_q_n_words"), 0.15),
    "bare_words": lambda: _fault(_share("_q_n_bare", "_q_n_words"), 0.2),
    "mean_length": lambda: F.when((F.col("_q_word_chars") > 10 * F.col("_q_n_words")) | (F.col("_q_word_chars") < 3 * F.col("_q_n_words")), -1).otherwise(0),
    "short_words": lambda: F.when(_share("_q_n_short", "_q_n_words") >= 0.15, 1).when(_share("_q_n_short", "_q_n_words") < 0.06, -1).otherwise(0),
    "long_words": lambda: F.when(_share("_q_n_long", "_q_n_words") <= 0.6, 1).when(_share("_q_n_long", "_q_n_words") > 0.8, -1).otherwise(0),
}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, smooth: float = 0.5) -> tuple[float, np.ndarray]:
    """Prior log-odds and, for each rule and vote (-1, 0, 1), the log-odds it adds, by EM over (votes, count) rows.

    Starts from the majority of the votes; an empty table gives zeros. Votes that never separate the
    classes end with weights near zero, so a useless rule does no harm.
    """
    rules = len(RULES)
    if not patterns:
        return 0.0, np.zeros((rules, 3))
    votes = np.array([p for p, _ in patterns], int).reshape(len(patterns), rules)
    n = np.array([c for _, c in patterns], float)
    good = 1 / (1 + np.exp(-(2.0 * (votes == 1).sum(1) - 4.0 * (votes == -1).sum(1))))
    prior, weights = 0.0, np.zeros((rules, 3))
    for _ in range(rounds):
        yes, no = n * good, n * (1 - good)
        prior = float(np.log(yes.sum() + smooth) - np.log(no.sum() + smooth))
        for r in range(rules):
            hit = np.array([[(yes * (votes[:, r] == v)).sum(), (no * (votes[:, r] == v)).sum()] for v in (-1, 0, 1)]) + smooth
            weights[r] = np.log(hit[:, 0] / hit[:, 0].sum()) - np.log(hit[:, 1] / hit[:, 1].sum())
        odds = prior + weights[np.arange(rules), votes + 1].sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - good).max() < 1e-7
        good = new
        if done:
            break
    return prior, weights


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``keep_columns`` of it) with the measures, ``posterior``, ``base_failed`` and ``kept``.

    The measures are computed once and cut off in the shared checkpoint folder without the texts
    unless a caller keeps that column; the vote table that is collected has at most 3**len(RULES) rows.
    """
    results = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "posterior", "base_failed", "kept", *(f"vote_{k}" for k in RULES)}
    names = [c for c in dict.fromkeys(keep_columns or docs.columns) if c.lower() not in results]
    if clash := [c for c in names if c.lower().startswith("_q_")]:
        raise ValueError(f"input columns {clash} have internal names")
    measured = with_measures(docs.select(*dict.fromkeys([*names, text])), text)
    measured = measured.withColumns({f"_q_vote_{k}": v().cast("int") for k, v in RULES.items()})
    slim = cut(measured.select(*names, *[c for c in measured.columns if c.startswith("_q_")]))
    votes = [f"_q_vote_{k}" for k in RULES]
    enough = slim.where(f"_q_n_words >= {MIN_WORDS}")  # documents that fail the base rule say nothing about the others
    patterns = [(tuple(r[:-1]), r[-1]) for r in enough.groupBy(*votes).count().collect()]
    prior, weights = fit(sorted(patterns))
    odds = F.lit(prior)
    for r, name in enumerate(RULES):
        c = F.col(f"_q_vote_{name}")
        odds = odds + F.when(c == -1, float(weights[r, 0])).when(c == 1, float(weights[r, 2])).otherwise(float(weights[r, 1]))
    failed = (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat") > MAX_REPEATED * F.col("_q_n_words"))
    return (
        slim.withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= threshold))
        .withColumnsRenamed({"_q_n_words": "n_words", "_q_word_chars": "word_chars", "_q_n_symbols": "n_symbols", "_q_n_dup_lines": "n_dup_lines", "_q_n_repeat": "n_repeat_words"})
        .select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *votes, "posterior", "base_failed", "kept")
        .withColumnsRenamed({v: f"vote_{k}" for v, k in zip(votes, RULES, strict=True)})
    )
