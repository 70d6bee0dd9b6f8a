"""Operator 7, quality rules: a ledger of rule bits and measurements, judged by versioned policies.

Only DataFrame functions: every measurement is an expression of one row, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5

#: Order of the rules in the bitmask. Bits are only ever appended, so that old ledgers stay readable.
RULES = ("few_words", "repeated_words", "many_symbols", "duplicate_lines", "word_length", "upper_case", "few_letters")


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the thresholds in force when the ledger is written, and the rules that count."""

    version: str = "v1"
    min_words: int = 10
    max_repeat_pct: int = 20
    max_symbols_per_100_words: int = 10
    max_dup_line_pct: int = 50
    min_word_chars: int = 2
    max_word_chars: int = 20
    max_upper_pct: int = 50
    min_letter_pct: int = 50
    enforced: tuple[str, ...] = field(default=RULES)

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.enforced)


BASE = ("few_words", "repeated_words")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(docs: DataFrame, text: str = "text", into: str = "m") -> DataFrame:
    """Add a struct column of measurements of every whole text; null texts count as empty."""
    at = {c: f"__{into}_{c}" for c in ("text", "words", "lines", "windows", "dups")}
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = _without(t, SPACES)
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, SPACES) != "")
    df = docs.withColumn(at["words"], words).withColumn(at["lines"], lines)
    hashes = F.transform(F.col(at["words"]), lambda w: F.xxhash64(w))
    windows = F.when(
        F.size(at["words"]) > WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(at["words"]) - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col(at["dups"]), i + j) for j in range(WINDOW)]),
        ),
    )
    df = df.withColumn(at["dups"], hashes).withColumn(at["windows"], windows)
    # Only texts that repeat a window are sorted: equal windows become neighbours, in order of place.
    placed = F.array_sort(F.transform(F.col(at["windows"]), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(at["windows"])) < F.size(at["windows"])
    df = df.withColumn(at["dups"], F.when(repeats, placed))
    near = lambda i, d: F.get(F.col(at["dups"]), i + d)["h"]
    starts = F.array_sort(
        F.transform(
            F.filter(F.col(at["dups"]), lambda x, i: (x["h"] == near(i, -1)) | (x["h"] == near(i, 1))),
            lambda x: x["i"],
        )
    )
    df = df.withColumn(at["dups"], starts)
    # A window adds what lies before the next one's start, and five words at most.
    covered = F.aggregate(
        F.transform(
            F.col(at["dups"]),
            lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(at["dups"]), i + 1) - s, F.lit(WINDOW))),
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    upper = F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}", ""))
    letters = F.length(t) - F.length(F.regexp_replace(t, "\\p{L}", ""))
    m = F.struct(
        F.size(at["words"]).cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, "#*$%&|<>"))).cast("long").alias("n_symbols"),
        F.size(at["lines"]).cast("long").alias("n_lines"),
        (F.size(at["lines"]) - F.size(F.array_distinct(at["lines"]))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        upper.cast("long").alias("n_upper"),
        letters.cast("long").alias("n_letters"),
    )
    return df.withColumn(into, m).drop(*at.values())


def ledger(docs: DataFrame, policy: Policy = Policy(), text: str = "text", prefix: str = "") -> DataFrame:
    """Every rule evaluated once: adds ``m`` (measurements) and ``failed`` (bit i set: RULES[i] fails).

    Rows stay as they are, repeated rows and null columns too; a null or empty text fails "few_words"
    only, since the ratios need words. Columns of these names in the input are replaced; give a
    ``prefix`` to keep both.
    """
    df = measure(docs, text, f"{prefix}m")
    m = lambda c: F.col(f"`{prefix}m`.{c}")
    w = m("n_words")
    fails = {
        "few_words": w < policy.min_words,
        "repeated_words": 100 * m("n_repeat_words") > policy.max_repeat_pct * w,
        "many_symbols": 100 * m("n_symbols") > policy.max_symbols_per_100_words * w,
        "duplicate_lines": 100 * m("n_dup_lines") > policy.max_dup_line_pct * m("n_lines"),
        "word_length": (m("word_chars") < policy.min_word_chars * w) | (m("word_chars") > policy.max_word_chars * w),
        "upper_case": 100 * m("n_upper") > policy.max_upper_pct * m("n_letters"),
        "few_letters": 100 * m("n_letters") < policy.min_letter_pct * m("word_chars"),
    }
    bits = [F.when(fails[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return df.withColumn(f"{prefix}failed", total.cast("long"))


def verdict(failed: Column, policy: Policy) -> Column:
    """Kept under a policy: none of its rules failed. Works on stored ledgers without the texts."""
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def ablation(book: DataFrame, policy: Policy, failed: str = "failed") -> DataFrame:
    """Per rule of the policy: rows failing it, rows failing nothing else, and rows kept without it.

    Rows are counted per bit pattern first (at most 2^rules rows leave a task), then per rule.
    """
    patterns = book.groupBy(F.col(failed).bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.enforced]))
    cases = patterns.select("bits", "n", rule.alias("r")).select("bits", "n", "r.*")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return cases.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failing"),
        count(F.col("bits") == F.col("bit")).alias("only_this"),
        count(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )
