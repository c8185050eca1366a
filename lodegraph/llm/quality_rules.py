"""Quality rules whose cutoffs carry a guarantee on false rejection.

Each rule rejects documents whose statistic exceeds a cutoff. Cutoffs form a ladder: its first
step holds every rule's loosest cutoff, each further one every rule's next tighter. In each stratum
steps are tested in that order on labelled good documents: the count that a step rejects is
binomial, and a step is certified when so low a count would be improbable (exact binomial tail) if its
true false-rejection rate, over all rules together, were above `risk`. Testing stops at the
first step that fails, so a fixed sequence costs nothing for its length; the tail is held against
`delta` over the number of strata. So with probability 1 - delta the last certified step of every
stratum holds at once. Rules share the risk as they need it. A stratum without evidence
rejects nothing. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.workspace import Workspace

WHITE = r"[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Parameters: allowed false rejection per stratum over all rules, error chance, candidate cutoffs by statistic.

    With no false rejection at all a stratum needs ln(delta / strata) / ln(1 - risk) good labelled documents, 144 of
    each of four strata by default. Statistics: symbol_share and upper_share per character in words, repeat_share per
    word, dup_line_share per line with a word.
    """

    stratum: str = "lang"
    risk: float = 0.03
    delta: float = 0.05
    cutoffs: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbol_share": (0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
            "upper_share": (0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
            "repeat_share": (0.1, 0.15, 0.2, 0.25, 0.3, 0.5),
            "dup_line_share": (0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
        }
    )

    def ladder(self) -> list[dict[str, float]]:
        """Cutoffs by rule at each step; a rule with fewer cutoffs than others stays at its tightest."""
        loosest = {rule: sorted(some, reverse=True) for rule, some in self.cutoffs.items() if some}
        return [{rule: some[min(k, len(some) - 1)] for rule, some in loosest.items()} for k in range(max(map(len, loosest.values()), default=0))]


#: Documents that no labels save.
BASE = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Per row of `docs` (doc_id, text and the stratum's column): doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper.

    Null text has no words. n_repeat_words counts the words that lie in a window of eight
    words found twice or more in the text. Windows are compared by 64-bit hash, found by
    sorting, so a text of n words costs n log n.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    cut = base.select(
        "doc_id",
        "stratum",
        F.expr(f"array_remove(split(text, '{WHITE}+'), '')").alias("words"),
        F.expr(f"filter(split(text, '\\n'), line -> line rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
        F.expr(f"length(text) - length(translate(text, '{SYMBOLS}', ''))").cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    hashed = cut.select(
        "*", F.size("words").cast("long").alias("n_words"), F.expr("if(size(words) < 8, array(), transform(sequence(1, size(words) - 7), i -> xxhash64(slice(words, i, 8))))").alias("windows")
    )
    paired = hashed.select(
        "doc_id",
        "stratum",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(array_distinct(windows)) = size(windows), null, array_sort(transform(windows, (h, i) -> struct(h, i))))").alias("sorted"),
    )
    twice = paired.withColumn("starts", F.expr("array_sort(transform(filter(sorted, (w, k) -> w.h <=> get(sorted, k - 1).h or w.h <=> get(sorted, k + 1).h), w -> w.i))"))
    gaps = "zip_with(starts, slice(starts, 2, size(starts)), (a, b) -> least(8, coalesce(b - a, 8)))"
    covered = F.expr(f"if(starts is null, 0, aggregate({gaps}, 0, (n, g) -> n + g))").cast("long")
    return twice.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "n_upper")


def _shares(table: DataFrame, rules: QualityRules) -> DataFrame:
    """Adds the rules' statistics; 0 where there is nothing to divide by."""
    of = {"symbol_share": ("n_symbols", "word_chars"), "upper_share": ("n_upper", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines")}
    return table.withColumns({k: F.when(F.col(of[k][1]) > 0, F.col(of[k][0]) / F.col(of[k][1])).otherwise(F.lit(0.0)) for k in rules.cutoffs})


def binomial_tail(n: str, x: str, rate: float | str) -> str:
    """SQL for P(X <= x), X binomial of n trials at `rate`; 1 where x is not below the mean. Terms by recursion on their logarithms."""
    rate = f"{rate!r}D"
    step = f"a.l + ln({n} - k + 1) - ln(k) + ln({rate} / (1 - {rate}))"
    start = f"named_struct('l', {n} * ln(1 - {rate}), 't', exp({n} * ln(1 - {rate})))"
    ks = f"if({x} < 1, cast(array() as array<bigint>), sequence(1L, {x}))"
    return f"if({x} >= {n} * {rate}, 1.0D, aggregate({ks}, {start}, (a, k) -> named_struct('l', {step}, 't', a.t + exp({step})), a -> a.t))"


def certified_steps(table: DataFrame, labels: DataFrame, rules: QualityRules) -> DataFrame:
    """(stratum, step): how many steps of the ladder are certified. `table`: doc_id, stratum, statistics; `labels`: doc_id, quality.

    Held out are labelled good documents that pass the base rule, all of them; rows of `labels` without doc_id
    or quality don't count, and repeated labels count once. Rows of `table` that share a doc_id are documents of their own.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    held = table.filter(f"not ({BASE})").join(good, F.col("doc_id") == F.col("good_id"))
    over = [reduce(or_, (F.col(rule) > c for rule, c in step.items())) for step in rules.ladder()]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(o).alias(f"x{k}") for k, o in enumerate(over)))
    strata = counts.agg(F.count("*").alias("strata"))
    passes = F.array(*(F.expr(binomial_tail("n", f"x{k}", rules.risk)) <= F.lit(rules.delta) / F.col("strata") for k in range(len(over))), F.lit(False))
    # `strata` is one row
    return counts.join(F.broadcast(strata)).select("stratum", (F.array_position(passes, False) - 1).cast("int").alias("step"))


def apply_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of `docs`.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated windows. kept is
    false then, and where a statistic exceeds its cutoff at the stratum's last certified step. A null stratum
    is a stratum of its own. Without labels nothing but the base rule rejects. Rows that share a doc_id are judged each by
    its own text. Other columns are not looked at. Null text has no words; an empty table gives no rows.
    """
    rules = rules or QualityRules()
    work = Workspace(spark, "rules")
    table = _shares(work.keep(statistics(docs, rules.stratum), "statistics"), rules)
    steps = certified_steps(table, labels, rules).withColumnRenamed("stratum", "at")
    over = F.lit(False)
    for k, step in enumerate(rules.ladder()):
        over = over | (F.coalesce("step", F.lit(0)) == k + 1) & reduce(or_, (F.col(rule) > c for rule, c in step.items()))
    # a row a stratum; a stratum is a language or the like, which is few
    judged = table.join(steps, F.col("stratum") == F.col("at"), "left").withColumn("base_failed", F.expr(BASE))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))


def oracle(rules: QualityRules | None = None) -> str:
    """DuckDB SQL for the same rows over `documents` and `labels`."""
    rules = rules or QualityRules()
    ladder = rules.ladder()
    over = ["(" + " OR ".join(f"{r} > {c}" for r, c in step.items()) + ")" for step in ladder]
    counts = ", ".join(f"count(*) FILTER (WHERE {o}) AS x{k}" for k, o in enumerate(over))
    tail = "list_sum(list_transform(range(0, x{k} + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({rate}) + (n - k) * ln(1 - {rate}))))"
    fails = [f"CASE WHEN x{k} < n * {rules.risk} AND {tail.format(k=k, rate=rules.risk)} <= {rules.delta} / (SELECT count(*) FROM x) THEN NULL ELSE {k} END" for k in range(len(ladder))]
    chosen = "CASE coalesce(steps.step, 0) " + " ".join(f"WHEN {k + 1} THEN {o}" for k, o in enumerate(over)) + " ELSE false END"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (
  SELECT rid, i, list_slice(words, i, i + 7) AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
s0 AS (
  SELECT w.rid, doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
s AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share FROM s0),
x AS (
  SELECT stratum, count(*) AS n, {counts} FROM s
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND NOT ({BASE}) GROUP BY stratum),
steps AS (SELECT stratum, least({", ".join(fails)}, {len(ladder)}) AS step FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({BASE}) AS base_failed, NOT ({BASE}) AND NOT {chosen} AS kept
FROM s LEFT JOIN steps ON s.stratum = steps.stratum
"""
