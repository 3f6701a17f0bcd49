"""Quality rules (native): every rule is evaluated once into a ledger of failure bits and measurements.

Policies and ablations read the ledger only: a policy is a version with a bit mask, a document passes if no bit of the mask
is set, and what a rule contributes follows from counts per pattern of bits. No text is read a second time.

Defined results: a null or empty text has no words and fails `few_words`; a repeated row gets its own ledger row; an empty
table gives an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoframe.llm.common import WORD, words_of

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails` holds over the measurements."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


#: Order is the order of the bits; append new rules, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    Rule("shouting", "10 * n_shouted > 5 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("few_letters", "10 * n_letters < 6 * word_chars"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = (
    Policy("base", BASE),
    Policy("v1", (*BASE, "symbols", "duplicate_lines", "shouting")),
    Policy("v2", tuple(rule.name for rule in RULES)),
)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside a window of three words that occurs at least twice in the text.

    Windows are compared by a 64-bit hash within one text. Equal hashes are brought side by side by one sort, and only in
    texts that have any.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.col("__n") - 3),
                         lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))
    df = df.withColumn("__h", F.when(F.col("__n") >= 4, hashes).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(
        F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda j: (F.get("__s", j)["h"] == F.get("__s", j - 1)["h"]) | (F.get("__s", j)["h"] == F.get("__s", j + 1)["h"])
    at = F.transform(F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda j: F.coalesce(twin(j), F.lit(False))),
                     lambda j: F.get("__s", j)["i"])
    df = df.withColumn("__at", F.when(F.col("__s").isNotNull(), F.sort_array(at)))
    covered = F.aggregate("__at", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__h", "__s", "__at")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every document that the rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"), words_of(text).alias("__words"))
    df = df.withColumn("__n", F.size("__words"))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD)))
    df = _repeat_words(df)
    count = lambda pattern: F.regexp_count(F.col("__text"), F.lit(pattern)).cast("long")
    # The generator keeps later filters from being pushed, and expanded, below the measurements.
    return df.select("doc_id", F.inline(F.array(F.struct(
        F.col("__n").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"), F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), F.col("n_repeat_words"),
        count(r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{2})[^\x20\x09-\x0D\p{javaLowerCase}]*\p{javaUpperCase}"
              r"[^\x20\x09-\x0D\p{javaLowerCase}]*(?![^\x20\x09-\x0D])").alias("n_shouted"),
        count(r"\p{L}").alias("n_letters")))))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and `failures`, one bit for each rule in the order of `rules`."""
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("failures", bits)


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    order = [rule.name for rule in rules]
    return sum(1 << order.index(name) for name in set(names))


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy.rules, rules)).cast("long")) == 0


def ablations(book: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that fail it alone, and that the policy would keep without it.

    Documents are counted once by their pattern of bits; the rest is arithmetic on at most 2^rules patterns.
    """
    patterns = book.groupBy("failures").agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(name).alias("rule"),
        F.lit(mask(p.rules, rules)).cast("long").alias("mask"), F.lit(mask([name], rules)).cast("long").alias("bit"))
        for p in policies for name in p.rules]))
    hit = F.col("failures").bitwiseAND(F.col("c.mask"))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias
    return patterns.select("failures", "n", cells.alias("c")).groupBy("c.policy", "c.rule").agg(
        total(hit.bitwiseAND(F.col("c.bit")) != 0)("n_failed"), total(hit == F.col("c.bit"))("n_only"),
        total(hit == 0)("n_kept"), total(hit.bitwiseAND(F.bitwise_not("c.bit")) == 0)("n_kept_without"))


def judge(docs: DataFrame, policy: Policy = POLICIES[-1], rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with base_failed and kept."""
    return ledger(docs, rules).withColumn("base_failed", ~passes(POLICIES[0], rules)).withColumn(
        "kept", passes(policy, rules) & ~F.col("base_failed"))


def keep(docs: DataFrame, policy: Policy = POLICIES[-1], rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of `docs` that `policy` passes, with their columns: the ledger is computed beside each row, nothing is shuffled."""
    held = docs.select(F.struct(*docs.columns).alias("doc_id"), F.col("text").alias("text"))
    book = ledger(held, rules)
    return book.filter(passes(policy, rules)).select("doc_id.*")
