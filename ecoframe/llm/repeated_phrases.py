"""Substring dedup by repeated-phrase automata.

Windows of `width` words that may recur meet in shards (see `repeats`). A shard confirms its recurring phrases by counting,
compiles them into an Aho-Corasick automaton over word numbers (pyahocorasick), and streams all its pieces of text through
it to locate every occurrence; an occurrence is removed if an equal one starts earlier. All pieces that may hold a phrase are
in its shard, so all texts are covered; the automata stay small because a shard has the passages of one neighbourhood.

Defined results: a null or empty text has no words; texts under `width` words lose none; rows that repeat an id with its text
are one occurrence (none is earlier than the other); a null id is later than any other; empty tables give no rows; other columns
are ignored. Texts that share an id, or have none, are apart, in the order of the hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from ecoframe.llm.common import text_rows
from ecoframe.llm.repeats import Units, covered, removed_runs, rolled, with_removed

WIDTH, GRAM = 20, 8


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


class _Numbers(dict):
    """Hash of a word, remembered; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_numbers = _Numbers()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))


UNITS = Units(WIDTH, GRAM, split, hashes, lambda words, a, b: b" ".join(words[a:b]), lambda piece: piece.split(b" "))


def locate(contents: list[list[bytes]], keys: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Which windows of each piece start earlier too, within the pieces given; `keys` rank the texts."""
    number: dict[bytes, int] = {}
    tokens = [tuple([number.setdefault(w, len(number)) for w in words]) for words in contents]
    counts = [len(t) - WIDTH + 1 for t in tokens]
    first = np.concatenate(([0], np.cumsum(counts)))
    gone = np.zeros(first[-1], bool)
    # Windows of all pieces in one pass over the words end to end; those that cross from piece to piece are left out.
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    flat = word[np.fromiter(chain.from_iterable(tokens), np.int64, sum(map(len, tokens)))]
    begin = np.cumsum([0, *map(len, tokens)])[:-1]
    windows = rolled(flat, WIDTH)[np.repeat(begin - first[:-1], counts) + np.arange(first[-1])]
    _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
    recurring = np.flatnonzero(times[inverse] > 1)
    # Confirmed phrases: windows whose hash recurs; equal words are one phrase, under the number of the last of them.
    piece = np.searchsorted(first, recurring, "right") - 1
    phrases = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, (p, at) in enumerate(zip(piece.tolist(), (recurring - first[piece]).tolist())):
        phrases.add_word(tokens[p][at:at + WIDTH], i)
    if not len(recurring):
        return [gone[a:b] for a, b in zip(first, first[1:])]
    phrases.make_automaton()
    found, where = [], []
    for p in np.unique(piece).tolist():
        base = int(first[p]) - WIDTH + 1
        for end, phrase in phrases.iter(tokens[p]):
            found.append(phrase)
            where.append(base + end)
    phrase, at = np.array(found), np.array(where)
    piece = np.searchsorted(first, at, "right") - 1
    key, start = keys[piece], starts[piece] + at - first[piece]
    order = np.lexsort((start, key, phrase))
    phrase, key, start, at = phrase[order], key[order], start[order], at[order]
    lead = np.concatenate(([True], phrase[1:] != phrase[:-1]))
    lead = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
    gone[at[(key != key[lead]) | (start != start[lead])]] = True
    return [gone[a:b] for a, b in zip(first, first[1:])]


def dedup(docs: DataFrame, part: int = 2048, crowd: int = 512, block: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row: words that an earlier window covers are removed."""
    return _apply(docs, part, crowd, block, True)


def summary(docs: DataFrame, part: int = 2048, crowd: int = 512, block: int = 1 << 20) -> DataFrame:
    """`dedup` without the texts."""
    return _apply(docs, part, crowd, block, False)


def _apply(docs: DataFrame, part: int, crowd: int, block: int, texts: bool) -> DataFrame:
    rows = text_rows(docs).select("doc_id", "key", "print", "text")
    met = with_removed(rows, removed_runs(rows, UNITS, locate, part, crowd, block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out: list[tuple] = []
            for text, listed in zip(x["text"], x["runs"]):
                words = split(text)
                kept = words
                if listed is not None:
                    gone = covered(len(words), listed, WIDTH)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if texts else None))
            done = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            yield pd.concat([x[["doc_id"]].reset_index(drop=True), done], axis=1)

    out = met.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")
