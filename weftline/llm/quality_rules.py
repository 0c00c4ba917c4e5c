"""Operator 6, quality rules with adaptive thresholds. DataFrame functions only.

Base measures of each text are computed inside its row. Documents that no base rule fails
feed mergeable quantile sketches of each measure for each language and source, and, by the
same aggregation, for each language and for all; groups of fewer than MIN_GROUP documents
use the sketch of their language, or that of all. A fence stands at the median plus SPREADS
times the distance to the upper quartile (for word length also below), with a least distance
for each measure, so that a homogeneous group doesn't reject its own ordinary documents. The
fences are joined to the documents by language and source.

Defined results: null text has no words and fails; null language or source are groups of
their own; repeated rows are judged one by one; an empty table gives no rows; other columns
pass through where asked for (names that begin with "_q_" are the operator's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written
from .native import let, tail

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents that a group needs for thresholds of its own; accuracy of the sketches.
MIN_GROUP, ACCURACY = 200, 1000
SPREADS = 8.0
#: Least distance from the median to the quartile that counts, for each measure.
FLOORS = {"_q_symbols": 0.01, "_q_dup_lines": 0.08, "_q_repeats": 0.05, "_q_length": 0.4}
#: White space of the word pattern, and signs that count as symbols.
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _repeated_positions(hashes: Column) -> Column:
    """Positions of the elements that occur twice or more, in order.

    The hash's high bits and the position share a number, so a plain sort brings likely
    repeats together; only those are then sorted by their whole hash.
    """
    low = F.when(F.size(hashes) < 1 << 20, F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("bigint")

    def likely(mask: Column) -> Column:
        keys = F.array_sort(F.transform(hashes, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint"))))
        pair = lambda a, b: F.when(a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(mask)) == 0, F.array(a.bitwiseAND(mask), b.bitwiseAND(mask)))
        return let(keys, lambda k: F.array_distinct(F.flatten(F.array_compact(F.zip_with(k, tail(k, 2), pair)))))

    def certain(at: Column) -> Column:
        whole = F.array_sort(F.transform(at, lambda p: F.struct(F.get(hashes, p.cast("int")).alias("h"), p.alias("p"))))
        pair = lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))
        return let(whole, lambda w: F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.zip_with(w, tail(w, 2), pair))))))

    return let(let(low, likely), certain)


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        n = F.greatest(F.size(h) - 2, F.lit(0))
        triples = F.arrays_zip(F.slice(h, 1, n).alias("a"), F.slice(h, 2, n).alias("b"), F.slice(h, 3, n).alias("c"))
        return F.transform(triples, lambda t: F.xxhash64(t))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, tail(p, 2), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    count = let(let(let(hashed, windows), _repeated_positions), covered)
    return F.when(F.size(words) >= 3, count).otherwise(F.lit(0).cast("bigint"))


def measures(text: Column) -> Column:
    """A struct of the base measures, n_lines and base_failed of a text."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    return F.struct(
        let(_words(full), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.char_length(F.translate(full, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.char_length(full) - F.char_length(F.translate(full, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs with the base measures, n_lines and base_failed."""
    lang, source = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null")), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    rows = docs.select(*keep, lang.alias("_q_lang"), source.alias("_q_source"), measures(F.col("text")).alias("_q_m"))
    m = F.col("_q_m")
    failed = (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"))
    rows = rows.select(
        *keep, "_q_lang", "_q_source", m["w"]["n_words"].alias("_q_n_words"), m["word_chars"].alias("_q_word_chars"), m["n_symbols"].alias("_q_n_symbols"),
        m["l"]["n_dup_lines"].alias("_q_n_dup_lines"), m["l"]["n_lines"].alias("_q_n_lines"), m["w"]["n_repeat_words"].alias("_q_n_repeat_words"),
    )
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return rows.withColumns(
        {
            "_q_failed": failed,
            "_q_symbols": F.col("_q_n_symbols") / one("_q_word_chars"),
            "_q_dup_lines": F.col("_q_n_dup_lines") / one("_q_n_lines"),
            "_q_repeats": F.col("_q_n_repeat_words") / one("_q_n_words"),
            "_q_length": F.col("_q_word_chars") / one("_q_n_words"),
        }
    )


def fences(rows: DataFrame) -> DataFrame:
    """Thresholds for each language and source: _q_lang, _q_source, and low and high of each measure."""
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], ACCURACY).alias(m) for m in FLOORS]
    sketched = rows.where(~F.col("_q_failed")).rollup("_q_lang", "_q_source").agg(F.grouping_id().alias("_q_level"), F.count("*").alias("_q_n"), *quartiles)
    sketched = written(sketched, "quality-sketches")
    packed = F.struct("_q_n", *FLOORS)
    own = sketched.where("_q_level = 0").select("_q_lang", "_q_source", packed.alias("_q_own"))
    wide = sketched.where("_q_level = 1").select("_q_lang", packed.alias("_q_wide"))
    every = sketched.where("_q_level = 3").select(packed.alias("_q_all"))
    groups = rows.select("_q_lang", "_q_source").distinct()
    joined = groups.join(own, ["_q_lang", "_q_source"], "left").join(wide, "_q_lang", "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    best = F.when(F.col("_q_own._q_n") >= MIN_GROUP, F.col("_q_own")).when(F.col("_q_wide._q_n") >= MIN_GROUP, F.col("_q_wide")).otherwise(F.col("_q_all"))
    out = joined.select("_q_lang", "_q_source", best.alias("_q_best"))
    limits = []
    for m, floor in FLOORS.items():
        q = F.col(f"_q_best.{m}")
        low, mid, high = (F.get(q, F.lit(k)) for k in range(3))
        limits.append((mid + SPREADS * F.greatest(high - mid, F.lit(floor))).alias(f"{m}_high"))
        limits.append((mid - SPREADS * F.greatest(mid - low, F.lit(floor))).alias(f"{m}_low"))
    return out.select("_q_lang", "_q_source", *limits)


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, the measures as in measured(), and _q_kept."""
    rows = written(measured(docs, keep), "quality-measures")
    limits = written(fences(rows), "quality-fences")  # its size is known, so Spark broadcasts it only if small
    ok = F.lit(True)
    for m in FLOORS:
        ok &= F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
    ok &= F.coalesce(F.col("_q_length") >= F.col("_q_length_low"), F.lit(True))
    return rows.join(limits, ["_q_lang", "_q_source"], "left").withColumn("_q_kept", ~F.col("_q_failed") & ok)


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for each row of docs (doc_id, text, lang, source)."""
    return judged(docs, ["doc_id"]).select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in BASE), F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    return judged(docs, docs.columns).where("_q_kept").select(*docs.columns)
