"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme marks, plus signs before digits, digits, and cue words of
identifiers. From each anchor a deterministic parser expands to the boundaries of an email, a network address, a card or phone
number, a URL that names a person, or an account, and validates it (part ranges, Luhn, lengths, mod 97). No pattern is run
over the whole text.

Defined results: a null or empty text has no spans; a repeated row gets the same result; an empty table gives no rows; other
columns are ignored. Offsets are code points, end exclusive. Texts are read whole, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoframe.llm.common import text_rows

#: Kinds in the order that results list them; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
_URL_RUN = re.compile("[^ \t\n\x0b\x0c\r\"'<>|]*")
#: Words that announce the number of an account or a document of a person.
CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "customer", "member", "user id", "ssn", "iban")


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in "@":
        out.add_word(c, ("at", 1))
    for c in DIGITS:
        out.add_word(c, ("digit", 1))
        out.add_word("+" + c, ("plus", 2))
    out.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            out.add_word(form, ("cue", len(form)))
    out.make_automaton()
    return out


def _right(text: str, at: int, chars: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _left(text: str, at: int, floor: int, chars: frozenset[str]) -> int:
    """Start of the run of `chars` that ends before `at`, not below `floor`."""
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start, end = _left(text, at, floor, LOCAL), _right(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := _right(text, end + 1, LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def _numbers(text: str, at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """From the first digit of a chain: the addresses and the card numbers in it, and where the chain ends."""
    ips, runs, end, cards = [], [], at, []
    first, digits = at, []
    while True:
        stop = _right(text, end, DIGITS)
        runs.append((end, stop))
        digits.append(text[end:stop])
        joint = text[stop:stop + 1]
        onward = joint in (".", " ", "-") and text[stop + 1:stop + 2] in DIGITS and bool(text[stop + 1:stop + 2])
        if joint != "." or not onward:  # the dotted chain ends here
            for i in range(0, len(runs) - 3, 4):
                if all(len(part := text[a:b].lstrip("0")) <= 3 and int(part or "0") <= 255 for a, b in runs[i:i + 4]):
                    ips.append((runs[i][0], runs[i + 3][1]))
            runs = []
        if joint not in (" ", "-") or not onward:
            if 16 <= len(joined := "".join(digits)) <= 19 and luhn(joined):
                cards.append((first, stop))
            first, digits = stop + 1, []
        if not onward:
            return ips, cards, stop
        end = stop + 1


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    end = _right(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3:
        return None
    return plus, end


def _url(text: str, mark: int, run_end: int) -> tuple[tuple[int, int] | None, int]:
    """A URL that names a person: with a login, or with a personal page in its path; and where its run of characters ends.

    Another scheme within the run begins another URL.
    """
    start, end = _left(text, mark, 0, ALNUM), mark + 3
    if run_end <= end:
        run_end = _URL_RUN.match(text, end).end()
    following = text.find("://", end, run_end)
    end = run_end if following < 0 else _left(text, following, mark + 3, ALNUM)
    end = mark + 3 + len(text[mark + 3:end].rstrip(".,;:!?)"))
    host, _, path = text[mark + 3:end].partition("/")
    if start == mark or "." not in host.rpartition("@")[2].strip("."):
        return None, run_end
    return ((start, end) if "@" in host or re.match(r"(~|u/|user/|users/|profile/|in/|@)[^/]", path) else None), run_end


def _account(text: str, at: int, end: int) -> tuple[str, int, int] | None:
    """After a cue that stands alone: an IBAN, or an identifier of 6 to 34 characters with at least 5 digits."""
    if at and text[at - 1] in ALNUM or text[end:end + 1] in ALNUM and text[end:end + 1]:
        return None
    near = re.compile(r"\x20{0,3}(?:(?:no|nr|id|number|nummer|num)\b\.?\x20{0,3})?[:#=]?\x20{0,3}", re.I).match(text, end)
    start = near.end() if near else end
    stop, body = start, ""
    while len(body) < 35 and text[stop:stop + 1] in LABEL and stop < len(text):
        body += text[stop].replace("-", "")
        stop += 1
    spaced = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){2,8}").match(text, start)
    if spaced:
        iban = spaced[0].replace(" ", "")
        if 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1:
            return "iban", start, spaced.end()
    if 6 <= len(body) <= 34 and sum(c in DIGITS for c in body) >= 5:
        return "account", start, stop
    return None


def spans(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end) in order."""
    found: list[tuple[int, int, int]] = []
    mail_end = phone_end = chain_end = url_end = 0
    for last, (what, length) in machine.iter(text):
        at = last + 1 - length
        if what == "digit":
            if at >= chain_end:
                ips, cards, chain_end = _numbers(text, at)
                found += [(1, *x) for x in ips] + [(2, *x) for x in cards]
        elif what == "at":
            if at >= mail_end and (span := _email(text, at, mail_end)):
                found.append((0, *span))
                mail_end = span[1]
        elif what == "plus":
            if at >= phone_end and (span := _phone(text, at)):
                phone_end = span[1]
                if 8 <= sum(c in DIGITS for c in text[span[0]:span[1]]) <= 15:
                    found.append((3, *span))
        elif what == "scheme":
            span, url_end = _url(text, at, url_end)
            if span:
                found.append((4, *span))
        elif hit := _account(text, at, last + 1):
            found.append((KINDS.index(hit[0]), hit[1], hit[2]))
    return sorted(set(found))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and found (spans in order of kind, then start) of every row of `docs`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for x in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans(t, machine)] for t in x.pop("text")]
            yield x.assign(found=found)

    return text_rows(docs).select("doc_id", "text").mapInPandas(
        run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows and columns of `docs`, every span in `text` replaced by its kind, and n_chars (if there is one) counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for x in batches:
            at = x.schema.get_field_index("__text")
            clean = [t if t is None else redact(t, spans(t, machine)) for t in x.column(at).to_pylist()]
            yield x.set_column(at, x.schema.field(at), pa.array(clean, x.schema.field(at).type))

    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("__rest"), F.col("text").cast("string").alias("__text"))
    out = rows.mapInArrow(run, rows.schema)
    out = out.select("__rest.*", F.col("__text").alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """Spans become <KIND>; of overlapping ones the first, the longest of those, names the union."""
    if not found:
        return text
    out, at = [], 0
    for rank, start, end in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[rank].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def n_of(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
