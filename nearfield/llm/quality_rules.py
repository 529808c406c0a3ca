"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and stores the measurements and one bit
for each rule that the text fails. Policies are sets of rules with a version:
applying one, or counting what each rule alone decides, is bit arithmetic on
the ledger, with no second look at the texts.

Measurements (words are runs of characters that are not ASCII white space):
n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``),
n_lines (lines with a word), n_dup_lines (those equal to an earlier line),
n_repeat_words (words in three-word windows that occur twice or more), n_upper
(upper-case letters). A null text counts as empty: all are 0. Repeated rows
are judged alike, ids are not looked at, other columns stay as they are, an
empty table gives an empty ledger. Time grows with n log n of a text's words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A text fails if ``fails`` (SQL over the measurements) holds."""

    name: str
    fails: str


#: The place of a rule is its bit; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("upper_case", "2 * n_upper > word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)
#: Versioned policies: the rules that count.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": tuple(r.name for r in RULES),
}


def mask(policy: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << k for k, r in enumerate(rules) if r.name in policy)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements; columns of those names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    df = docs.withColumn("__nf_text", text).withColumn("__nf_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")))
    df = df.withColumn("__nf_n", F.size("__nf_words"))
    df = df.withColumn("__nf_windows", F.expr("CASE WHEN __nf_n >= 4 THEN sort_array(transform(sequence(0, __nf_n - 3), i -> struct(xxhash64(__nf_words[i], __nf_words[i + 1], __nf_words[i + 2]) AS h, i AS i))) END"))
    df = df.withColumn("__nf_twins", F.expr("filter(zip_with(slice(__nf_windows, 1, __nf_n - 3), slice(__nf_windows, 2, __nf_n - 3), (a, b) -> CASE WHEN a.h = b.h THEN struct(a.i AS x, b.i AS y) END), z -> z IS NOT NULL)"))
    df = df.withColumn("__nf_starts", F.expr("CASE WHEN size(__nf_twins) > 0 THEN sort_array(array_distinct(concat(__nf_twins.x, __nf_twins.y))) END"))
    repeats = F.expr("CASE WHEN size(__nf_starts) > 0 THEN aggregate(zip_with(__nf_starts, concat(slice(__nf_starts, 2, size(__nf_starts)), array(element_at(__nf_starts, -1) + 3)), (a, b) -> least(3, b - a)), 0L, (s, x) -> s + x) ELSE 0L END")
    df = df.withColumn("__nf_lines", F.filter(F.split("__nf_text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")))
    symbols = F.octet_length("__nf_text") - F.octet_length(_without(F.col("__nf_text"), "#*$%&|<>"))
    found = {
        "n_words": F.col("__nf_n"),
        "word_chars": F.length(_without(F.col("__nf_text"), " \t\n\x0b\x0c\r")),
        "n_symbols": symbols,
        "n_lines": F.size("__nf_lines"),
        "n_dup_lines": F.size("__nf_lines") - F.size(F.array_distinct("__nf_lines")),
        "n_repeat_words": repeats,
        "n_upper": F.regexp_count("__nf_text", F.lit("\\p{Lu}")),
    }
    # behind a generator: a filter on a measurement must not be moved down to
    # where it would repeat these expressions inside each other
    own = [c for c in docs.columns if c not in found]
    row = F.explode(F.array(F.struct(*(v.cast("long").alias(k) for k, v in found.items())))).alias("__nf_found")
    return df.select(*own, row).select(*own, "__nf_found.*")


def ledger(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with measurements and ``fail_bits``: bit k is set if rule k fails."""
    bits = "0L"
    for k, r in enumerate(rules):
        bits += f" | CASE WHEN {r.fails} THEN {1 << k}L ELSE 0L END"
    return measured(docs, text_col).withColumn("fail_bits", F.expr(bits))


def passes(policy: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy], rules))) == 0


def ablations(book: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: how many rows fail it, how many fail it
    alone (dropping the rule would keep them), how many pass the policy. The
    ledger shrinks to one row for each bit pattern first."""
    m = mask(POLICIES[policy], rules)
    bits = F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")
    patterns = book.groupBy(bits).agg(F.count("*").alias("n"))
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("bit"), F.lit(r.name).alias("rule")) for k, r in enumerate(rules) if m >> k & 1))).alias("r")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    rows = patterns.select("bits", "n", names).withColumn("own", F.expr("shiftleft(1L, r.bit)"))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        count(F.col("bits").bitwiseAND(F.col("own")) != 0).alias("failing"),
        count(F.col("bits") == F.col("own")).alias("failing_alone"),
        count(F.col("bits") == 0).alias("passing"),
    )


def keep_good(docs: DataFrame, policy: str = "full-1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their own columns."""
    held = docs.select(F.struct("*").alias("__nf_row"), F.col(text_col).alias("__nf_in"))
    return ledger(held, "__nf_in").where(passes(policy)).select("__nf_row.*")
