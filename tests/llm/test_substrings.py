"""Both substring operators against brute force, also with shards small enough to be dealt out."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from ecoframe.llm import repeated_phrases, suffix_sort
from ecoframe.llm.common import NO_ID


def brute(units, width):
    """doc → which units are removed; `units` in order of key, one entry for each key."""
    seen, out = set(), {}
    for key, u in sorted(units.items()):
        gone = bytearray(len(u))
        for i in range(len(u) - width + 1):
            window = tuple(u[i:i + width])
            if window in seen:
                gone[i:i + width] = b"\x01" * width
            seen.add(window)
        out[key] = bytes(gone)
    return out


def place(i, t):
    """The key and Spark's hash of the text, in the order in which texts come first."""
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return NO_ID if i is None else i, h - (1 << 64) if h >> 63 else h


def expected_words(rows):
    gone = brute({place(i, t): (t or "").encode().split() for i, t, _ in rows}, 20)
    out = []
    for i, t, _ in rows:
        words, g = (t or "").encode().split(), gone[place(i, t)]
        kept = b" ".join(w for w, x in zip(words, g) if not x)
        out.append((i, len(words), sum(g), hashlib.sha256(kept).hexdigest()))
    return out


def expected_bytes(rows):
    gone = brute({place(i, t): (t or "").encode() for i, t, _ in rows}, 100)
    out = []
    for i, t, _ in rows:
        data, g = (t or "").encode(), gone[place(i, t)]
        kept = bytes(b for b, x in zip(data, g) if not x)
        out.append((i, len(data), sum(g), len(re.findall(b"\x01+", g)), hashlib.sha256(kept).hexdigest()))
    return out


def shared_ids(rows):
    """With texts that share an id or have none, some of them equal to others and some to nothing."""
    solo = lambda name: " ".join(f"{name}{k}" for k in range(60))
    extra = [(None, rows[0][1]), (None, solo("unique")), (None, solo("other")), (5, rows[0][1]), (5, solo("solo")), (5, solo("other")), (5, solo("solo"))]
    return [*rows, *[(i, t, "s") for i, t in extra], *[(None, solo("hot"), "s")] * 30]


order = lambda rows: sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("settings", [{}, {"part": 16, "crowd": 2, "block": 400}])
def test_phrases_equal_brute_force(spark, documents, corpus, settings):
    rows = shared_ids(corpus)
    got = repeated_phrases.summary(documents(rows), **settings).collect()
    assert order(got) == order(expected_words(rows))
    assert sum(r["n_removed"] for r in got) > 500


@pytest.mark.parametrize("settings", [{}, {"part": 16, "crowd": 2, "block": 400}])
def test_suffixes_equal_brute_force(spark, documents, corpus, settings):
    rows = shared_ids(corpus)
    got = suffix_sort.summary(documents(rows), **settings).collect()
    assert order(got) == order(expected_bytes(rows))
    assert sum(r["n_removed"] for r in got) > 2000


def test_kept_texts(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "s"), (2, "before " + text + " after", "s")]
    kept = {r["doc_id"]: r["kept_text"] for r in repeated_phrases.dedup(documents(rows)).collect()}
    assert kept == {1: text, 2: "before after"}
    raw = {r["doc_id"]: bytes(r["kept"]) for r in suffix_sort.dedup(documents(rows)).collect()}
    assert raw == {1: text.encode(), 2: b"before  after"}


def test_empty_table_and_nulls(spark, documents):
    assert repeated_phrases.summary(documents([])).collect() == [] == suffix_sort.summary(documents([])).collect()
    assert [tuple(r)[:3] for r in repeated_phrases.summary(documents([(None, None, None)])).collect()] == [(None, 0, 0)]


def test_suffix_order():
    data = b"abracadabra" * 5 + b"abrac" + bytes(range(256)) * 2
    s, n = suffix_sort.Suffixes(data), 60
    at = np.arange(n)
    order_ = s.sort(at, np.zeros(n, np.int64), np.full(n, 40))
    assert order_.tolist() == sorted(range(n), key=lambda i: (data[i:i + 40], i))
    assert s.extension(np.array([0]), np.array([11]), np.array([40])).tolist() == [40]


def test_a_hash_collision_is_caught(monkeypatch):
    s = suffix_sort.Suffixes(b"a" * 50 + b"b" * 50)
    monkeypatch.setattr(s, "extension", lambda a, b, depth: depth)
    zero = np.zeros(2, np.int64)
    assert not s.equal_to_previous(np.array([0, 1]), np.array([0, 50]), zero, np.array([40, 40])).any()


def test_texts_without_or_with_one_id_keep_what_is_theirs(spark, documents):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(1, text("a"), "s"), (None, text("a"), "s"), (None, text("unique"), "s"), (5, text("a"), "s"), (5, text("solo"), "s")]
    for got, column in ((repeated_phrases.dedup(documents(rows)), "kept_text"), (suffix_sort.dedup(documents(rows)), "kept")):
        kept = sorted(r[column] if column == "kept_text" else bytes(r[column]).decode() for r in got.collect())
        assert kept == sorted([text("a"), "", text("unique"), "", text("solo")])


def test_very_long_texts(spark, documents):
    long = " ".join(f"w{k % 1000}x{k}" for k in range(100_000))
    rows = [(1, long, "s"), (2, "head " + long[:600_000], "s"), (3, "z" * 1_000_000, "s"), (4, None, "s")]
    assert order(repeated_phrases.summary(documents(rows)).collect()) == order(expected_words(rows))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_sort.summary(documents(rows)).collect()}
    assert got == {1: 0, 2: 600_000, 3: 999_999, 4: 0}
