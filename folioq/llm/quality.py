"""Quality rules as a learned decision list, in DataFrame expressions only.

Counts of every text give a few rates. From a bounded sample of labelled documents, sequential covering grows
conjunctions of thresholds on these rates (by FOIL gain on two thirds of the sample), prunes each from its end (by
precision on the other third), keeps it if it is precise enough there, takes the rows that it covers away, and goes on.
The result is an ordered list of readable conditions, emitted as one Spark conditional expression: the first rule that
holds rejects the document, no rule keeps it.

What bounds the model: SAMPLE labelled rows to learn from; a rule has up to LITERALS thresholds, each at one of CUTS ranks
of a rate's values over all rows and over the rejected ones; MAX_RULES rules at most, though the pruning part ends the
list as soon as a rule is not precise (MIN_PRECISION) or covers fewer than MIN_COVER rows. Windows of words are compared
by 64-bit hashes of 64-bit hashes: two different ones in a text of a million words are taken for equal with a chance of
about 1 in 40 million.

Null and empty texts have no words, all counts 0, and fail the base rule. Repeated rows are judged one by one. Without
labels (an empty table, all null, or one class only) the list is empty and the base rule alone decides. Columns of the
input that have an output's name give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioq.llm.common import let, table, without

#: Labelled rows to learn from, at most; the smallest hashes of doc_id are taken.
SAMPLE = 20_000
LITERALS, CUTS, MIN_PRECISION, MIN_COVER, MAX_RULES, MIN_WORDS = 3, 24, 0.9, 5, 12, 20
#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\f\r"
WINDOW = 8
#: Frequent function words of the languages at hand, fixed values.
COMMON = "a and de der des die du el en et in is la le les of que the to un und".split()

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_common")
RATES = {
    "mean_word": lambda q: q["word_chars"] / q["n_words"],
    "symbol_rate": lambda q: q["n_symbols"] / q["n_words"],
    "dup_line_rate": lambda q: q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)),
    "repeat_rate": lambda q: q["n_repeat_words"] / q["n_words"],
    "words_a_line": lambda q: q["n_words"] / F.greatest(q["n_lines"], F.lit(1)),
    "distinct_rate": lambda q: q["n_distinct"] / q["n_words"],
    "common_rate": lambda q: q["n_common"] / q["n_words"],
}


def _repeated(windows: Column) -> Column:
    """How many words stand in windows that are found twice or more: windows has a hash for each start."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(p: Column) -> Column:
        again = F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]))
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, lambda p: F.coalesce(covered(p), F.lit(0))))


def measures(text: Column) -> Column:
    """A struct of COUNTS, each a long."""
    blank = lambda t: F.translate(t, BLANK, "")
    words_of = lambda t: let(F.btrim(t, F.lit(BLANK)), lambda b: F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, r"[\x20\x09-\x0D]+")))

    def windows(hashes: Column) -> Column:
        starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.xxhash64(F.slice(hashes, i + 1, F.lit(WINDOW))))

    def counted(t: Column, words: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: blank(line) != "")
        line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        by_hash = lambda h: F.struct(F.size(F.array_distinct(h)).alias("distinct"), let(windows(h), _repeated).alias("repeated"))
        both = let(F.struct(line_counts.alias("l"), let(hashes, by_hash).alias("h")), lambda x: F.struct(
            F.size(words).alias("n_words"), F.length(blank(t)).alias("word_chars"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
            x["l"]["dup"].alias("n_dup_lines"), x["h"]["repeated"].alias("n_repeat_words"), x["l"]["n"].alias("n_lines"), x["h"]["distinct"].alias("n_distinct"),
            F.size(F.filter(words, lambda w: w.isin(COMMON))).alias("n_common")))
        return both.cast("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")

    return let(F.coalesce(text, F.lit("")), lambda t: let(words_of(t), lambda words: counted(t, words)))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


@dataclass(frozen=True)
class Rule:
    """Rejects what satisfies all literals (rate, ">" or "<=", threshold)."""

    literals: tuple[tuple[str, str, float], ...]

    def condition(self, q: Column) -> Column:
        out = F.lit(True)
        for name, sign, cut in self.literals:
            out = out & (RATES[name](q) > cut if sign == ">" else RATES[name](q) <= cut)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {c:g}" for n, s, c in self.literals)


def learn(rows: Sequence[Sequence[float]], bad: Sequence[bool], names: Sequence[str] = tuple(RATES)) -> list[Rule]:
    """The decision list from sampled rates and their labels. Row sets are integers' bits, so a conjunction is an and."""
    everything, wrong = (1 << len(rows)) - 1, sum(1 << k for k, b in enumerate(bad) if b)
    held = sum(1 << k for k in range(2, len(rows), 3))
    masks: dict[tuple[str, str, float], int] = {}
    for j, name in enumerate(names):
        order = sorted(range(len(rows)), key=lambda k: rows[k][j])
        values = [rows[k][j] for k in order]
        # cuts by rank over all rows and over the rejected ones, midway between neighbours
        ranks = {len(order) * c // CUTS for c in range(1, CUTS)}
        spots = [p for p, k in enumerate(order) if bad[k]]
        ranks |= {spots[len(spots) * c // CUTS] + d for c in range(CUTS) for d in (0, 1) if spots}
        mask, at = 0, 0
        for r in sorted(x for x in ranks if 0 < x < len(order) and values[x - 1] < values[x]):
            while at < r:
                mask |= 1 << order[at]
                at += 1
            cut = float(f"{(values[r - 1] + values[r]) / 2:.6g}")
            if values[r - 1] <= cut < values[r]:
                masks[name, "<=", cut], masks[name, ">", cut] = mask, everything & ~mask
    left, rules = everything, []
    while len(rules) < MAX_RULES and (left & wrong).bit_count() >= MIN_COVER:
        chosen, cover = [], left & ~held
        while len(chosen) < LITERALS and (cover & ~wrong):
            p0, n0 = (cover & wrong).bit_count(), (cover & ~wrong).bit_count()
            gain, best = 0.0, None
            for literal, mask in masks.items():
                p, n = (cover & mask & wrong).bit_count(), (cover & mask & ~wrong).bit_count()
                if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)) if p0 else 0.0)) > gain + 1e-9:
                    gain, best = g, literal
            if best is None:
                break
            chosen.append(best)
            cover &= masks[best]
        if not chosen:
            break

        def judged(literals: Sequence[tuple[str, str, float]], among: int) -> tuple[float, int]:
            for x in literals:
                among &= masks[x]
            p, n = (among & wrong).bit_count(), (among & ~wrong).bit_count()
            return (p + 1) / (p + n + 2), p

        chosen = max((chosen[:k] for k in range(len(chosen), 0, -1)), key=lambda c: judged(c, left & held))
        (_, seen), cover = judged(chosen, left), left
        for x in chosen:
            cover &= masks[x]
        n = (cover & ~wrong).bit_count()
        if seen < MIN_COVER or seen / (seen + n) < MIN_PRECISION or judged(chosen, left & held)[0] < MIN_PRECISION - 0.1:
            break
        rules.append(Rule(tuple(chosen)))
        left &= ~cover
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Learns from at most `sample` labelled documents that pass the base rule; 0 means to be rejected. A document with both labels counts as 0."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_label"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(sample)  # a row of two numbers each: the bound of what is broadcast
    q = docs.select(key, text).join(F.broadcast(chosen), key).select(F.col("_label"), measures(F.col(text)).alias("q"))
    # no filter here on the counts: it would be pushed below the join, and count in every document
    rates = q.select((F.col("_label") == 0).alias("bad"), *[F.when(~base_failed(F.col("q")), f(F.col("q"))).alias(n) for n, f in RATES.items()])
    got = sorted(tuple(r) for r in rates.collect() if r["mean_word"] is not None)
    # every third row prunes: neighbours in this order are alike, so that both parts are
    return learn([r[1:] for r in got], [r[0] for r in got])


def judged(q: Column, rules: Sequence[Rule]) -> Column:
    """A struct of the counts, base_failed, the number of the rule that rejects (from 1, else null), and kept."""
    fired = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        fired = F.when(rule.condition(q), F.lit(k)).otherwise(fired)
    verdict = let(F.struct(base_failed(q).alias("b"), F.when(base_failed(q), F.lit(None)).otherwise(fired).alias("r")), lambda v: F.struct(
        *[q[c].alias(c) for c in COUNTS], v["b"].alias("base_failed"), v["r"].alias("rule"), (~v["b"] & v["r"].isNull()).alias("kept")))
    return verdict


def quality(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """df with COUNTS, base_failed, rule and kept."""
    verdict = let(measures(F.col(text)), lambda q: judged(q, rules))
    return without(df, *COUNTS, "base_failed", "rule", "kept").withColumn("_v", verdict).select("*", "_v.*").drop("_v")


def kept(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """The rows of df that pass. The condition is one expression, so that pushing it down repeats no counting."""
    return df.where(let(measures(F.col(text)), lambda q: let(judged(q, rules), lambda v: v["kept"])))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
