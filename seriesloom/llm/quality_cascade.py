"""Quality rules as a short-circuit cascade of native expressions, ordered by rejection per cost on a sample."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import GAP, SPACES, WORD, let, packed, whole

SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def _covered(starts: Column) -> Column:
    """Words in the union of three-word windows that begin at the sorted positions `starts`."""
    k = F.size(starts)
    steps = F.zip_with(F.slice(starts, 1, k - 1), F.slice(starts, 2, k - 1), lambda a, b: F.least(F.lit(3), b - a))
    return F.aggregate(steps, F.lit(3), lambda total, step: total + step)


def _repeated_starts(windows: Column) -> Column:
    """Positions of windows whose words occur at least twice; `windows` is sorted by words, then position."""
    k = F.size(windows)
    pairs = F.zip_with(F.slice(windows, 1, k - 1), F.slice(windows, 2, k - 1), lambda a, b: F.when(
        (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.array(a["at"], b["at"])))
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(pairs))))


def repeat_words(text: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Window hashes are compared first: all different means no repeat, which settles most texts without a sort. Otherwise
    the windows themselves are sorted, so equal hashes of different words change nothing.
    """

    def count(words: Column) -> Column:
        n = F.size(words) - 2
        windows = F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
        hashes = F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
        placed = F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"),
                              F.slice(words, 3, n).alias("c"), F.sequence(F.lit(1), n).alias("at"))
        sure = let(F.array_sort(placed), lambda s: let(_repeated_starts(s), lambda p: F.when(F.size(p) == 0, 0).otherwise(_covered(p))))
        return F.when(F.size(words) < 4, 0).when(F.size(F.array_distinct(hashes)) == n, 0).otherwise(sure)

    return let(_words(text), count).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Counts over a whole text as independent expressions; unused ones cost nothing."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(text),
        "n_letters": F.char_length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long"),
        "n_capitals": F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_shouts": (F.char_length(text) - F.char_length(F.translate(text, "!", ""))).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """`fails` over the measures; `work` is how often an evaluation passes over the characters of a text."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]
    work: float


BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50, 1.0),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], 12.0),
)
RULES = BASE_RULES + (
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"], 2.0),
    Rule("word_length", lambda m: (m["word_chars"] > 12 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]), 2.0),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 40 * m["n_lines"], 3.0),
    Rule("capitals", lambda m: 2 * m["n_capitals"] > m["n_letters"], 4.0),
    Rule("shouts", lambda m: 2 * m["n_shouts"] > m["n_words"], 2.0),
)


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000) -> list[Rule]:
    """Rules by rejection per cost, greedily: each next rule is judged on what the earlier ones would leave.

    Selectivities come from a hash sample of about `sample_rows` rows, the documented bound of this estimate: one job
    returns a count for each pattern of failing rules, at most 2^rules rows. The order changes the cost of the cascade and
    the name of the first failing rule, never which documents are kept.
    """
    total = docs.count()
    if not total:
        return list(rules)
    share = min(1.0, sample_rows / total)
    spot = F.pmod(F.xxhash64(F.lit(7), F.length(whole(text)), F.xxhash64(whole(text))), F.lit(1 << 30))
    sample = docs.where(spot < int(share * (1 << 30))).select(whole(text).alias("text"))
    m = measures(F.col("text"))
    fails = F.concat(*[F.when(r.fails(m), "1").otherwise("0") for r in rules])
    found = sample.select(fails.alias("fails"), F.length("text").alias("chars")).groupBy("fails").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    left, order = [(r["fails"], r["n"], r["chars"]) for r in found], []
    rest = list(range(len(rules)))
    while rest:
        chars = sum(c for _, _, c in left) or 1
        gain = {i: sum(n for f, n, _ in left if f[i] == "1") / (rules[i].work * chars) for i in rest}
        best = max(rest, key=lambda i: (gain[i], -rules[i].work, -i))
        order.append(rules[best])
        rest.remove(best)
        left = [x for x in left if x[0][best] == "0"]
    return order


def first_failed(order: list[Rule], m: Mapping[str, Column]) -> Column:
    """Name of the first rule that fails, else null. CASE evaluates a later rule only where all earlier ones pass."""
    chain = F.when(order[0].fails(m), order[0].name)
    for rule in order[1:]:
        chain = chain.when(rule.fails(m), rule.name)
    return chain


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of `docs` that pass every rule, with their columns. A null text is empty and fails for want of words."""
    order = ordered_rules(docs, rules, text, sample_rows)
    rows = packed(docs, whole(text).alias("body"))
    return rows.where(first_failed(order, measures(F.col("body"))).isNull()).select("row.*")


#: Measures that a report has by default; all others are formed inside the cascade, where a rule that needs them is reached.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text",
                   sample_rows: int = 2000, reported: tuple[str, ...] = REPORTED) -> DataFrame:
    """doc_id, the `reported` measures, failed_rule and kept for each row.

    Reported measures are formed once for every row and read by the cascade; a rule on any other measure forms it only
    where all rules ahead of it pass. Null and empty texts have no words and fail; repeated rows are reported each; an
    empty table gives no rows.
    """
    order = ordered_rules(docs, rules, text, sample_rows)
    base = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("body"))
    every = measures(F.col("body"))
    counted = base.select("doc_id", "body", *[every[k].alias(k) for k in reported])
    failed = first_failed(order, every | {k: F.col(k) for k in reported})
    judged = counted.withColumn("failed_rule", failed)
    return judged.select("doc_id", *reported, "failed_rule", F.col("failed_rule").isNull().alias("kept"))
