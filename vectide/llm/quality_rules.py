"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each text is measured once. Quantile sketches (KLL, mergeable) of the measures
are aggregated per language and source over the texts that pass the base rules,
and merged to one per language and one for all. The thresholds of a language and
source are tail quantiles of its own values, ``TAIL`` of the texts on each side;
a group of fewer than ``LEAST_ROWS`` texts takes those of its language, or of all
texts. A text is kept if it passes the base rules and lies within the limits of
its group, which are joined by language and source (null is a group of its own).

The measures: word length (limits on both sides), symbols a word, share of
repeated lines, share of words in repeated three-word windows (upper limits). No
measure has a fixed limit: where most of a group is equal, the limit is what its
tail has. A sketch is exact up to some ``SKETCH_K`` texts and has a rank error of
about 0.1 % beyond, by its own random choices.

Nothing is exploded: repeated windows are found inside the row by sorting, and
only in texts in which hashes of windows repeat.

Defined cases: a null text has no words and fails; a null language or source is
a group of its own; copies and repeated rows count one by one; an empty table
gives an empty result; other columns pass through, under the name ``in_<name>``
if an added column has theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, set_aside

#: Fixed values of the measures.
WHITE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Parameters of the limits: share of a group's texts beyond each, least texts of a group, size of a sketch.
TAIL = 0.005
LEAST_ROWS = 100
SKETCH_K = 4096
#: Has a measure a lower limit, an upper one?
SIDES = {"word_length": (True, True), "symbol_rate": (False, True), "dup_line_share": (False, True), "repeat_share": (False, True)}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for the row."""
    return F.transform(F.array(value), body)[0]


def _count_repeated(words: Column) -> Column:
    """Number of words in three-word windows that occur twice or more."""

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    places = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(order: Column) -> Column:
        at = F.transform(
            order,
            lambda x, j: F.when(x["w"].eqNullSafe(F.get(order, j - 1)["w"]) | x["w"].eqNullSafe(F.get(order, j + 1)["w"]), x["i"]),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(F.filter(at, lambda i: i.isNotNull()), lambda i: F.array(i, i + 1, i + 2)))))

    exact = _let(F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("w"), i.alias("i")))), covered)
    alike = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 4, 0).when(alike, exact).otherwise(0).cast("long")


def measure(text: Column) -> Column:
    """A struct of the base counts of a text, as bigint."""

    def of(t: Column) -> Column:
        bare = F.trim(t, F.lit(WHITE))
        words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))

        def counts(w: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _let(lines, F.size).cast("long").alias("n_lines"),
                _count_repeated(w).alias("n_repeat_words"),
            )

        return _let(words, counts)

    return _let(F.coalesce(text, F.lit("")), of)


def _rate(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the base counts, base_failed and the measures."""
    df = docs.withColumn("_m", measure(F.col(text_col)))
    df = df.select(*docs.columns, *[F.col("_m")[c].alias(c) for c in (*BASE, "n_lines")])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumns(
        {
            "base_failed": failed,
            "word_length": _rate("word_chars", "n_words"),
            "symbol_rate": _rate("n_symbols", "n_words"),
            "dup_line_share": _rate("n_dup_lines", "n_lines"),
            "repeat_share": _rate("n_repeat_words", "n_words"),
        }
    )


def thresholds(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row a group: lo_ and hi_ of each measure."""
    names = list(SIDES)
    sketch = [F.expr(f"kll_sketch_agg_double({c}, {SKETCH_K})").alias(c) for c in names]
    own = rows.where(~F.col("base_failed")).groupBy(*group).agg(F.count("*").alias("n"), *sketch)

    def merged(by: list[str], prefix: str) -> DataFrame:
        return own.groupBy(*[F.col(c).alias(f"{prefix}{c}") for c in by]).agg(F.sum("n").alias(f"{prefix}n"), *[F.expr(f"kll_merge_agg_double({c})").alias(f"{prefix}{c}_all") for c in names])

    lang = merged(group[:1], "l_")
    every = merged([], "a_")
    wide = own.join(lang, F.col(group[0]).eqNullSafe(F.col(f"l_{group[0]}"))).withColumn("_one", F.lit(1))
    wide = wide.join(F.broadcast(every.withColumn("_one", F.lit(1))), "_one")  # one row
    out = [F.col(c) for c in group]
    for c in names:
        used = F.when(F.col("n") >= LEAST_ROWS, F.col(c)).when(F.col("l_n") >= LEAST_ROWS, F.col(f"l_{c}_all")).otherwise(F.col(f"a_{c}_all"))
        out.append(_let(used, lambda k: F.call_function("kll_sketch_get_quantile_double", k, F.array(F.lit(TAIL), F.lit(1 - TAIL)))).alias(f"q_{c}"))
    wide = wide.select(*out)
    limits = [F.col(f"q_{c}")[side].alias(f"{name}_{c}") for c in names for side, name in enumerate(("lo", "hi"))]
    return wide.select(*group, *limits)


def quality_rules(docs: DataFrame, text_col: str = "text", group: tuple[str, str] = ("lang", "source"), with_text: bool = True) -> DataFrame:
    """``docs`` (with the text if ``with_text``) and the base counts, base_failed, the measures and kept."""
    inner = {*(f"_t_{c}" for c in group), *(f"_t_{side}_{c}" for c in SIDES for side in ("lo", "hi")), "_m"}
    docs, name = set_aside(docs, {*BASE, "n_lines", "base_failed", "kept", *SIDES} | inner)
    text_col, group = name(text_col), [name(c) for c in group]
    rows = measured(docs, text_col)
    rows = materialise(rows if with_text else rows.drop(text_col), "measures")
    limits = materialise(thresholds(rows, group), "limits")
    limits = limits.withColumnsRenamed({c: f"_t_{c}" for c in limits.columns})
    # a plain equi-join: Spark broadcasts the limits if their size allows, and splits hot groups if not
    on = None
    for c in group:
        same = rows[c].eqNullSafe(limits[f"_t_{c}"])
        on = same if on is None else on & same
    inside = F.lit(True)
    for c, (low, high) in SIDES.items():
        if low:
            inside &= F.col(c) >= F.col(f"_t_lo_{c}")
        if high:
            inside &= F.col(c) <= F.col(f"_t_hi_{c}")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return rows.join(limits, on, "left").withColumn("kept", kept).select(*rows.columns, "kept")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of ``op3``."""
    return quality_rules(docs.select("doc_id", "text", "lang", "source"), with_text=False).select("doc_id", *BASE, "base_failed", "kept")
