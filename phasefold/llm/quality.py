"""Quality rules with risk-controlled thresholds.

Every document gets a few counts of its whole text.  A rule rejects documents
whose badness bin reaches a cutoff.  Cutoffs are not set by hand: for each
stratum (a language, say) and rule, the labelled holdout gives, cutoff by
cutoff from the safest to the boldest, the number k of good documents out of n
that would be rejected.  The exact binomial tail P(Bin(n, alpha) <= k) is the
p-value of "this cutoff rejects more than alpha of the good documents".  A
cutoff is admissible while it and all safer ones have p <= delta / (rules x
strata): fixed-sequence testing inside a rule, Bonferroni across rules and
strata.  ``alpha`` is ``max_false_rejection`` divided by the number of rules, so
with probability 1 - delta no stratum loses more than ``max_false_rejection`` of
its good documents to all rules together.  Among admissible cutoffs the one with
the best balance of bad against good rejections is taken, the safest on ties; a
stratum with too few labels has no admissible cutoff and rejects nothing.

Defined results: a null text has no words (and fails the base rule); a null
stratum is a stratum of its own; labels that contradict each other count as bad
if any of them does; null labels count for nothing; without labels only the
base rule acts; repeated rows are judged alike; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from phasefold.llm.common import WORD, free_name, materialize, words_of
from phasefold.session import small_side

SYMBOLS = "#*$%&|<>"
#: Low bits of a window code that hold its position: texts of up to 16 million words.
POSITION_BITS = 24
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``bin``: SQL over the measure columns; larger is worse, an integer of small range."""

    name: str
    bin: str


def _share(part: str, whole: str) -> str:
    """Quarter-octave bins of a share: 0 for none, 41 for all."""
    return f"CASE WHEN {part} <= 0 THEN 0 ELSE greatest(1, least(48, 41 + cast(floor(4 * log2({part} / {whole})) AS int))) END"


RULES = (
    Rule("symbols", _share("n_symbols", "(word_chars + 1)")),
    Rule("repeats", _share("n_repeat_words", "(n_words + 1)")),
    Rule("dup_lines", _share("n_dup_lines", "(n_lines + 1)")),
    Rule("long_words", "least(120, cast(floor(4 * word_chars / (n_words + 1)) AS int))"),
    Rule("short_words", "120 - least(120, cast(floor(4 * word_chars / (n_words + 1)) AS int))"),
)


def repeat_words(words: str) -> str:
    """SQL: how many words lie in 5-word windows that the array ``words`` holds twice or more.

    Window codes are a hash with the position in the low bits; after sorting, equal windows are neighbours, and equal
    hashes are confirmed on the words themselves.
    """
    low = (1 << POSITION_BITS) - 1
    code = f"(xxhash64({', '.join(f'{words}[i + {k}]' if k else f'{words}[i]' for k in range(5))}) & {~low}L) | i"
    codes = f"sort_array(transform(sequence(0L, size({words}) - 5L), i -> {code}))"
    same = "((s[j] ^ s[j + {0}]) & {1}L) = 0 AND slice({2}, cast(s[j] & {3}L AS int) + 1, 5) = slice({2}, cast(s[j + {0}] & {3}L AS int) + 1, 5)"
    left, right = same.format(-1, ~low, words, low).replace("+ -1", "- 1"), same.format(1, ~low, words, low)
    hits = f"filter(sequence(0, size(s) - 1), j -> (j > 0 AND {left}) OR (j < size(s) - 1 AND {right}))"
    starts = f"sort_array(transform({hits}, j -> s[j] & {low}L))"
    total = f"aggregate({starts}, named_struct('till', 0L, 'n', 0L), (a, p) -> named_struct('till', p + 5L, 'n', a.n + p + 5L - greatest(a.till, p)), a -> a.n)"
    return f"CASE WHEN size({words}) < 6 THEN 0L ELSE element_at(transform(array({codes}), s -> {total}), 1) END"


def measure(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Adds the counts; returns the frame and the (free) column names they got."""
    names = {m: free_name(docs, m if m not in docs.columns else f"_{m}") for m in [*MEASURES, "n_lines", "base_failed"]}
    words, lines, body = free_name(docs, "_words"), free_name(docs, "_lines"), free_name(docs, "_body")
    with_parts = docs.withColumn(body, F.coalesce(docs[text_col], F.lit(""))).withColumn(words, words_of(F.col(body)))
    with_parts = with_parts.withColumn(lines, F.filter(F.split(F.col(body), "\n"), lambda x: x.rlike(WORD)))
    bare: Column = F.col(body)
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    out = with_parts.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(words).cast("bigint").alias(names["n_words"]),
        F.length(F.array_join(words, "")).cast("bigint").alias(names["word_chars"]),
        (F.length(body) - F.length(bare)).cast("bigint").alias(names["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias(names["n_dup_lines"]),
        F.expr(repeat_words(f"`{words}`")).cast("bigint").alias(names["n_repeat_words"]),
        F.size(lines).cast("bigint").alias(names["n_lines"]),
    )
    n, rep = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return out.withColumn(names["base_failed"], (n < 10) | (100 * rep > 20 * n)), names


def binomial_tail(n: str, k: str, rate: float) -> str:
    """SQL of P(Bin(n, rate) <= k); 1 where k exceeds the mean, which no test here accepts."""
    odds = f"ln({rate!r}D / (1D - {rate!r}D))"
    step = f"named_struct('t', a.t + ln(({n} - i + 1D) / i) + {odds}, 's', a.s + exp(a.t + ln(({n} - i + 1D) / i) + {odds}))"
    first = f"{n} * ln(1D - {rate!r}D)"
    return (f"CASE WHEN {k} > {n} * {rate!r}D THEN 1D WHEN {k} = 0 THEN exp({first}) ELSE "
            f"aggregate(sequence(1L, cast({k} AS bigint)), named_struct('t', {first}, 's', exp({first})), (a, i) -> {step}, a -> a.s) END")


def choose_cutoffs(labelled: DataFrame, rules: tuple[Rule, ...] = RULES, max_false_rejection: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``labelled``: stratum, good (boolean), the measures.  Returns stratum, rule, cutoff, n_good, false_rejections, caught, p_value.

    Counts are per stratum, rule and bin, so the table tested here has at most (bins x rules) rows per stratum.
    """
    alpha = max_false_rejection / len(rules)
    marks = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.expr(r.bin).cast("int").alias("bin")) for r in rules])).alias("m")
    counts = labelled.select("stratum", "good", marks).groupBy("stratum", "m.rule", "m.bin").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counts = materialize(counts, "bins")
    n_strata = max(1, counts.select("stratum").distinct().count())
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("bin"))
    whole = Window.partitionBy("stratum", "rule")
    tested = counts.select(
        "stratum", "rule", "bin", F.sum("good").over(whole).alias("n_good"),
        F.sum("good").over(down).alias("k"), F.sum("bad").over(down).alias("caught"))
    tested = tested.filter("n_good > 0").withColumn("p_value", F.expr(binomial_tail("n_good", "k", alpha)))
    passing = tested.withColumn("ok", F.min(F.col("p_value") <= delta / (len(rules) * n_strata)).over(down)).filter("ok")
    best = F.max_by(F.struct("bin", "n_good", "k", "caught", "p_value"), F.struct((F.col("caught") - F.col("k")).alias("net"), "bin"))
    return passing.filter("caught > k").groupBy("stratum", "rule").agg(best.alias("b")).select(
        "stratum", "rule", F.col("b.bin").alias("cutoff"), F.col("b.n_good").alias("n_good"), F.col("b.k").alias("false_rejections"),
        F.col("b.caught").alias("caught"), F.col("b.p_value").alias("p_value"))


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "lang",
          rules: tuple[Rule, ...] = RULES, max_false_rejection: float = 0.05, delta: float = 0.05) -> tuple[DataFrame, dict[str, str], str]:
    """The documents with their measures and a verdict column; also the measures' names and the verdict's.

    ``labels``: id_col, quality (1 good, 0 bad).
    """
    measured, names = measure(docs, text_col)
    measured = materialize(measured, "measured")
    good = labels.groupBy(F.col(id_col).alias("_label_id")).agg((F.min("quality") > 0).alias("good")).filter("_label_id IS NOT NULL AND good IS NOT NULL")
    plain = [F.col(f"`{names[m]}`").alias(m) for m in [*MEASURES, "n_lines"]]
    holdout = measured.filter(~F.col(names["base_failed"])).select(F.col(id_col).alias("_id"), F.col(stratum_col).alias("stratum"), *plain)
    cutoffs = choose_cutoffs(holdout.join(good, F.col("_id") == F.col("_label_id")), rules, max_false_rejection, delta)
    stratum, cuts, verdict = (free_name(measured, x) for x in ("_stratum", "_cuts", "kept"))
    table = small_side(materialize(cutoffs.groupBy(F.col("stratum").alias(stratum)).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(cuts)), "cutoffs"))
    joined = measured.join(table, measured[stratum_col].eqNullSafe(table[stratum]), "left")
    rejected = F.lit(False)
    for r in rules:
        text = r.bin
        for m in sorted([*MEASURES, "n_lines"], key=len, reverse=True):
            text = _renamed(text, m, names[m])
        rejected = rejected | F.coalesce(F.expr(text) >= F.col(cuts)[r.name], F.lit(False))
    return joined.withColumn(verdict, ~F.col(names["base_failed"]) & ~rejected).drop(stratum, cuts), names, verdict


def _renamed(sql: str, name: str, to: str) -> str:
    import re

    return re.sub(rf"(?<![\w`]){name}(?![\w`])", f"`{to}`", sql)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns only."""
    judged, _, verdict = judge(docs, labels, **options)
    return judged.filter(F.col(verdict)).select(*[F.col(f"`{c}`") for c in docs.columns])
