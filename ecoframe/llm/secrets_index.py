"""Secret scans by a trigram inverted index (native).

Each rule carries a Boolean trigram query derived from its pattern: literal runs that every match must hold become
conjunctions of trigrams, alternatives become disjunctions. The index holds, for the trigrams that the queries use, the
documents whose text (A-Z lower-cased) has them. Postings are intersected per document by bits, and only candidates are
verified with the rule's pattern. A rule without a mandatory trigram has no query and scans every text.

Positions come from one split and one extraction: what lies between matches and the matches alternate, so their running
lengths are the offsets. They are summed by a window per (document, rule), not inside one array.

Defined results: a null or empty text has no spans; a repeated row gets the same result again; an empty table gives no rows;
other columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecoframe.llm.common import text_rows
from ecoframe.llm.url_templates import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    """`least` is the smallest length of group `group`. `long`: a pattern that matches exactly what `pattern` matches at that
    length or more; it can be given where a match is a whole run of one class, as what is too short is then never scanned.
    """

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False
    long: str | None = None

    @property
    def searched(self) -> str:
        return self.long or self.pattern


#: The base kinds come first, in the order that results list them.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, True, r"[0-9a-f]{16,}"),
    Rule("forge_token", r"(?:ghp_|gho_|ghs_|glpat-)[A-Za-z0-9_-]+", 0, 24),
    Rule("chat_token", r"(?:xoxb-|xoxp-|xoxa-)[A-Za-z0-9-]+", 0, 20),
    Rule("payment_key", r"(?:sk_live_|rk_live_)[A-Za-z0-9]+", 0, 24),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]+", 0, 27),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("url_login", r"[A-Za-z]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 9),
)


def _alternatives(node: str) -> list[str]:
    """Top-level alternatives of a group's inside."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(node):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append(node[start:i])
            start = i + 1
    return [*out, node[start:]]


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND over OR over AND of trigrams that every match holds, in lower case; [] if none is mandatory.

    Only plain literals and groups of alternatives are read; classes, repetitions and escapes end a literal run, so the query
    can ask for too little, never for too much.
    """
    clauses: list[list[list[str]]] = []
    grams = lambda run: [run[i:i + 3] for i in range(len(run) - 2)]
    run, i = "", 0

    def close(keep: str = "") -> None:
        nonlocal run
        if grams(run):
            clauses.append([grams(run)])
        run = keep

    while i < len(pattern):
        c = pattern[i]
        if c == "(":
            depth, j = 1, i + 1
            while depth:
                depth += (pattern[j] == "(") - (pattern[j] == ")")
                j += 1
            close()
            if pattern[j:j + 1] not in ("?", "*", "{"):
                inner = re.sub(r"^\?(?:i)?:", "", pattern[i + 1:j - 1])
                while inner.startswith("(") and inner.endswith(")") and _alternatives(inner) == [inner]:
                    inner = re.sub(r"^\?(?:i)?:", "", inner[1:-1])
                found = [[g for part in trigram_query(x) if len(part) == 1 for g in part[0]] for x in _alternatives(inner)] if not inner.startswith("?") else [[]]
                if all(found):
                    clauses.append(found)
            i = j
        elif c == "[":
            i = pattern.index("]", i + 2) + 1
            close()
        elif c == "\\":
            i += 4 if pattern[i + 1] == "x" else 2
            close()
        elif pattern[i + 1:i + 2] in ("?", "*", "{"):
            close()
            i += 1
        elif c in "+.^$?*{}|":
            close()
            i += 1
        else:
            run += c.lower()
            i += 1
    close()
    return clauses


def vocabulary(rules: Sequence[Rule]) -> list[str]:
    return sorted({g for rule in rules for clause in trigram_query(rule.pattern) for option in clause for g in option})


def postings(rows: DataFrame, grams: Sequence[str]) -> DataFrame:
    """The inverted index for `grams`: (gram, key, print), one row for each trigram and text."""
    low = F.translate("text", UPPER, LOWER)
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return rows.withColumn("low", low).select("key", "print", F.explode(present).alias("gram"))


def candidates(index: DataFrame, rules: Sequence[Rule], grams: Sequence[str]) -> DataFrame:
    """(key, print, rules): texts whose postings satisfy a rule's query, with a bit for each such rule."""
    words = -(-len(grams) // 63) or 1
    bit = lambda w: F.when(F.floor(F.col("gram") / 63) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("gram") % 63).cast("int"))).otherwise(F.lit(0).cast("long"))
    sets = index.groupBy("key", "print").agg(*[F.bit_or(bit(w)).alias(f"has{w}") for w in range(words)])
    place = {g: divmod(i, 63) for i, g in enumerate(grams)}

    def holds(option: Sequence[str]) -> Column:
        masks = [0] * words
        for g in option:
            masks[place[g][0]] |= 1 << place[g][1]
        out = F.lit(True)
        for w, m in enumerate(masks):
            out = out & (F.col(f"has{w}").bitwiseAND(F.lit(m).cast("long")) == m) if m else out
        return out

    found = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query:
            fits = F.lit(True)
            for clause in query:
                any_of = F.lit(False)
                for option in clause:
                    any_of = any_of | holds(option)
                fits = fits & any_of
            found = found.bitwiseOR(F.when(fits, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return sets.select("key", "print", found.alias("rules")).filter("rules <> 0")


def verify(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Spans (key, print, rule, start, end) of the rules whose bit is set in `rules`."""
    cases = []
    for i, rule in enumerate(rules):
        whole, part = F.regexp_extract_all("text", F.lit(rule.searched), F.lit(0)), F.regexp_extract_all("text", F.lit(rule.searched), F.lit(rule.group))
        gaps = F.split("text", rule.searched, -1)
        length = lambda a: F.transform(a, lambda x: F.length(x))
        cases.append(F.when((F.col("rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0) & F.col("text").rlike(rule.searched), F.struct(
            F.lit(i).alias("rule"), F.arrays_zip(length(gaps).alias("gap"), length(whole).alias("whole"), length(part).alias("part")).alias("hits"))))
    runs = rows.select("key", "print", F.explode(F.array_compact(F.array(*cases))).alias("run"))
    hits = runs.select("key", "print", "run.rule", F.posexplode("run.hits").alias("i", "hit")).select("key", "print", "rule", "i", "hit.*").distinct()
    so_far = Window.partitionBy("key", "print", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.col("whole"), F.lit(0))).over(so_far)
    least = F.element_at(F.array(*[F.lit(rule.least) for rule in rules]), F.col("rule") + 1)
    return hits.withColumn("end", end).filter(F.col("part") >= least).select("key", "print", "rule", (F.col("end") - F.col("whole")).alias("start"), "end")


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, key, print and `found`, the spans (start, kind, end, rank) in order, for every row of `docs`."""
    rows, grams = text_rows(docs), vocabulary(rules)
    scanned = sum(1 << i for i, rule in enumerate(rules) if not trigram_query(rule.pattern))
    may = candidates(postings(rows, grams), rules, grams)
    picked = rows.join(may, ["key", "print"]).select("key", "print", "text", "rules")
    whole = rows.select("key", "print", "text", F.lit(scanned).cast("long").alias("rules"))
    spans = verify(picked.unionByName(whole) if scanned else picked, rules)
    kind = F.element_at(F.array(*[F.lit(rule.kind) for rule in rules]), F.col("rule") + 1)
    found = spans.groupBy("key", "print").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start"), F.col("rule").alias("rank"), kind.alias("kind"), F.col("end")))).alias("found"))
    return rows.select("doc_id", "key", "print").join(found, ["key", "print"], "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")))
