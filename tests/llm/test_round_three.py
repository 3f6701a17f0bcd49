"""Prefix trie, filter audit and string-kernel toxicity against brute force."""

import hashlib
import random
import re
import time
import zlib
from itertools import combinations, permutations
from math import sqrt

import numpy as np
import pytest

from ecoframe.llm import filter_audit, pii, prefix_trie, toxicity

words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
order = lambda rows: sorted(map(tuple, rows), key=str)


# --- 11: prefix trie ------------------------------------------------------------------------------------------------

CONVERSATION = "conv_id long, turn long, role string, text string, node string, depth int, parent string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], CONVERSATION)


def brute_trie(rows):
    turns = {}
    for c, at, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((at is not None, at or 0, mark, role, text))
    for t in turns.values():
        t.sort(key=lambda x: x[:3])
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = turns.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h]
        paths[c] = tuple(x[3:] for x in head + own[h:])
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for node, of in members.items():
        below = [n for n in members if n[:len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(words(n[-1][1])) for n in below if n)
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of),
                    sum(len(m) == len(node) + 1 and m[:len(node)] == node for m in members), len(childless), saved,
                    hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
    return out


def conversations(seed=5):
    r = random.Random(seed)
    says = ["hello there", "", None, "a b  c\td", "ü 😀 x", "go on", "x" * 100_000]
    rows = []
    for c in range(90):
        rows += [(c, t, r.choice(["user", "bot", None]), r.choice(says[:r.choice([2, 7])])) for t in range(r.choice([1, 2, 3, 5, 9]))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(4)]  # many equal conversations
    rows += [(305, None, "user", "null turn"), (305, 2, "bot", "tie"), (305, 2, "bot", "tie"), (305, 2, "user", "another"), (305, 1, "a", "b")]
    rows += [(-7, 0, "user", "negative"), (-20, 0, "user", "head"), (-20, 1, "user", "head 2"), (None, 1, "user", "nobody"), (400, None, None, None)]
    rows += [(1, 0, "12", "3"), (1, 0, "1", "23"), (999_999_999_999, 3, "u", "far")]
    rows += [(500, t, "u", "long") for t in range(300)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [None, 20, 1])
def test_trie(spark, crowd):
    rows = conversations()
    got = prefix_trie.trie(prefix_trie.rebuilt(talks(spark, rows)), crowd)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert order(got.collect()) == order(brute_trie(rows))


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(talks(spark, []))).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt(talks(spark, [(None, 1, "a", "b")]))).count() == 0


def test_queue_spills_and_merges():
    r = random.Random(1)
    queue, expected = prefix_trie.Queue(held=5), {}
    levels = [[(-level, bytes([k])) for k in range(30)] for level in (3, 2, 1)]
    for above, level in zip([levels[0], *levels], levels):
        for key in above if above is not level else []:
            assert sorted(queue.take(key)) == sorted(expected.pop(key, []))
        for _ in range(200):
            key, record = r.choice(level), (r.random(),)
            queue.put(key, record)
            expected.setdefault(key, []).append(record)
    assert queue.runs
    for key in levels[2]:
        assert sorted(queue.take(key)) == sorted(expected.pop(key, []))
    assert not expected and not queue.heap and not queue.runs


# --- 12: filter audit -----------------------------------------------------------------------------------------------

def fails(text, doc_id, least):
    w = words(text)
    marks = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
             bool(re.search("[#$%&*|]", text)), (float("inf") if doc_id is None else doc_id) > least[text]]
    return {name for name, m in zip("ABCDE", marks) if m}


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", float("inf")), float("inf") if i is None else i)
    docs = [(s or "", fails(t or "", i, least), any(q == 1 for k, q, _ in labels if k == i and i is not None),
             any(x == 1 for k, _, x in labels if k == i and i is not None)) for i, t, s in rows]
    out = []
    for part in {d[0] for d in docs}:
        mine, removed_by, rows_of = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0), []
        for filters in map("".join, permutations("ABCDE")):
            for k, f in enumerate(filters):
                before = set(filters[:k])
                removed = [d for d in mine if f in d[1] and not d[1] & before]
                removed_by[f] += len(removed)
                rows_of.append((part, filters, k + 1, sum(not d[1] & (before | {f}) for d in mine), len(removed),
                                sum(f in d[1] and bool(d[1] & before) for d in mine), sum(d[1] == {f} for d in mine),
                                sum(d[2] for d in removed), sum(d[3] for d in removed), f))
        out += [(*x[:-1], removed_by[x[-1]]) for x in rows_of]
    return out


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, quality int, toxic int, source string, n string")


@pytest.mark.parametrize("cells", [None, 8])
def test_audit(spark, documents, corpus, cells, monkeypatch):
    if cells:  # a sketch so full that every text is a possible repeat
        monkeypatch.setattr(filter_audit, "cells_for", lambda rows: cells)
    many = " ".join(f"w{k}" for k in range(220))
    rows = [*corpus, *[(5000 + k, "copy " + many, "hot") for k in range(40)], (6000, many + " A" * 60 + " #", None), (6001, "W " * 1000, "s1"),
            (6002, "long " * 250_000, "s2"), (4000, "copy " + many, ""), (None, "copy " + many, "s1"), (None, None, "s2"), (6000, many, "s1")]
    labels = [(i, k % 2, k % 3 == 0) for k, (i, _, _) in enumerate(rows) if k % 2] + [(5000, None, 1), (5000, 1, 0), (None, 1, 1), (77777, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = filter_audit.audit(documents(rows), labelled(spark, labels))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert order(got.collect()) == order(brute_audit(rows, labels))


def test_audit_of_nothing(spark, documents):
    assert filter_audit.audit(documents([]), labelled(spark, [])).count() == 0
    assert filter_audit.audit(documents([(1, None, None)]), labelled(spark, [])).count() == 600


def test_sketch_clears_most_unique_texts(spark, documents):
    docs = documents([(i, f"text {i}", "s") for i in range(4000)] + [(9000 + i, f"text {i}", "s") for i in range(50)])
    rows = filter_audit.measured(docs).cache()
    cells = filter_audit.cells_for(rows.count())
    met = filter_audit.possible_repeats(rows, filter_audit.crowded(rows, cells), cells).count()
    assert 100 <= met < 300


# --- 13: toxicity ---------------------------------------------------------------------------------------------------

def brute_kernel(a, b):
    def weights(w):
        text, out = f"\x02{w}\x03", {}
        for at in combinations(range(len(text)), toxicity.LENGTH):
            if at[-1] - at[0] < toxicity.SPAN:
                key = "".join(text[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.LENGTH)
        return out

    x, y = weights(a), weights(b)
    size = sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return (sum(v * y.get(k, 0) for k, v in x.items()) / size) ** 2 if size else 0.0


def test_kernel_equals_brute_force():
    some = ["idiot", "idiiot", "idxiot", "tion", "a", "", "aaaaaaa", "ab", "été", "worthless", "😀😀idiot"]
    got = toxicity.Landmarks.of(some).kernels(some)
    assert np.allclose(got, [[brute_kernel(a, b) for b in some] for a in some])
    at = some.index
    assert got[at("idiot"), at("idiiot")] > 0.4 > 10 * got[at("idiot"), at("tion")]


def test_sentences():
    assert toxicity.sentences("You are an i d i o t again! Go. Go.\nA.") == [["you", "are", "an", "idiot", "again"], ["go"], ["go"], ["a"]]
    assert toxicity.sentences("id*ot #scum#") == [["idot", "scum"]]
    assert toxicity.sentences(None) == toxicity.sentences(" \n") == [[]]
    assert [len(s) for s in toxicity.sentences(" ".join(f"w{k}" for k in range(90)))] == [40, 40, 10]
    assert toxicity.sentences("x" * 100) == [["x" * 48, "x" * 4]]


def test_machine_learns_and_tolerates_gaps(spark, documents):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    insults = ["blockhead", "numbskull", "pillock", "wazzock"]
    disguised = lambda w: r.choice([w, w, w[:3] + "*" + w[3:], w[:4] + w[3:], " ".join(w), w + "s", w.upper()])

    def text(toxic):
        w = [r.choice(vocabulary) + r.choice(["", "", "", ". "]) for _ in range(r.choice([20, 60, 300]))]
        for _ in range(r.randint(1, 3) if toxic else 0):
            w.insert(r.randrange(len(w)), disguised(r.choice(insults)))
        return " ".join(w)

    rows = [(i, text(i % 6 == 0), "s") for i in range(900)]
    labels = labelled(spark, [(i, 1, int(i % 6 == 0)) for i in range(900)] + [(3, None, None), (None, 1, 1), (99_999, 1, 1)])
    odd = [(None, text(True), "s"), (None, None, None), (2000, "", "s"), (2001, "clean " * 200_000, "s"), (2002, rows[0][1], "s"), (0, "twice", "s"),
           (2003, "x" * 1_000_000, "s")]
    got = toxicity.judge(documents(rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    held = [g for g in got if g["doc_id"] is not None and g["doc_id"] < 900 and g["held_out"]]
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) for g in got if g["doc_id"] is not None)
    caught = [g["predicted"] for g in held if g["doc_id"] % 6 == 0]
    spared = [not g["predicted"] for g in held if g["doc_id"] % 6]
    assert sum(caught) >= 0.9 * len(caught) and sum(spared) >= 0.97 * len(spared) and len(caught) > 20
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)
    by = {g["doc_id"]: g["predicted"] for g in got}
    assert by[2000] == by[2001] == by[2003] == 0
    again = {(g["doc_id"], g["score"]) for g in toxicity.judge(documents(rows + odd), labels).collect()}
    assert again == {(g["doc_id"], g["score"]) for g in got}


def test_no_labels_and_no_texts(spark, documents):
    got = toxicity.judge(documents([(1, "a", "s"), (None, None, None)]), labelled(spark, [])).collect()
    assert [g["score"] for g in got] == [0.0, 0.0]
    assert toxicity.judge(documents([]), labelled(spark, [(1, 1, 1)])).count() == 0


# --- 2: a text of one anchor after the other ------------------------------------------------------------------------

@pytest.mark.parametrize("unit", ["a.b://", "account-", "@", "a@b", "+1 (", "1.", "1 ", "://", "http://u@h.de/", "1.2.3.4."])
def test_parsers_are_linear(unit):
    machine = pii.automaton()

    def seconds(size):
        begin = time.process_time()
        pii.spans((unit * (size // len(unit) + 1))[:size], machine)
        return time.process_time() - begin

    seconds(10_000)
    assert seconds(1_000_000) < 40 * max(0.05, seconds(100_000))


def test_a_scheme_ends_the_url_before_it():
    text = "see http://bob:pw@host.example/x?u=https://ann@other.example/y. end"
    assert [text[a:b] for k, a, b in pii.spans(text, pii.automaton()) if pii.KINDS[k] == "url"] == [
        "http://bob:pw@host.example/x?u=", "https://ann@other.example/y"]
