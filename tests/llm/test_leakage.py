import random

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import leakage as L

SCHEMA = "doc_id bigint, text string, cells array<struct<cell_type: string, execution_count: int, start_char: int, end_char: int>>"
ITEMS = "item_id bigint, suite string, text string"


def documents(spark, docs):
    data = []
    for i, cells in docs.items():
        text, places = "", []
        for t in cells:
            text += "\n\n" if text else ""
            places.append(("markdown", None, len(text), len(text) + len(t)))
            text += t
        data.append((i, text, places))
    return spark.createDataFrame(data, SCHEMA)


def item(n, words):
    return (n, "s", " ".join(words) + ".")


WORDS = [f"{a}{b}" for a in ("rope", "lamp", "tile", "drum", "bell", "weir", "quay") for b in ("maker", "ing", "yard", "s", "er", "let")]
QUESTION = WORDS[:30]


def test_forms_of_a_leak(spark):
    run = QUESTION[5:17]
    forms = {
        "plain": " ".join(run), "upper": " ".join(run).upper(), "punctuation": ", ".join(run), "lines": "\n> ".join(run), "comment": "\n# ".join(run), "markup": " ".join(f"<b>{w}</b>" if i % 2 else f"**{w}**" for i, w in enumerate(run)),
        "entities": "&nbsp;".join(run), "escapes": "\\u0020".join(run), "newline escapes": "\\n".join(run), "soft": " ".join(w[:2] + "­" + w[2:] for w in run), "zero": " ".join(w[:2] + "​" + w[2:] for w in run),
        "broken": " ".join(run[:6]) + " " + run[6][:3] + "-\n" + run[6][3:] + " " + " ".join(run[7:]), "broken in a literal": '"' + " ".join(run[:6]) + " " + run[6][:3] + '-"\n    "' + run[6][3:] + " " + " ".join(run[7:]) + '"',
        "broken without a hyphen": " ".join(run[:6]) + " " + run[6][:3] + "\n" + run[6][3:] + " " + " ".join(run[7:]), "numbered": "\n".join(f"  {i} | {a} {b}" for i, (a, b) in enumerate(zip(run[::2], run[1::2]))),
        "literals": "ask(\n" + "\n".join(f'    "{a} {b} "' for a, b in zip(run[::2], run[1::2])) + "\n)", "inside": "some more text " + " ".join(run) + " and more",
    }
    not_forms = {"eleven": " ".join(run[:11]), "changed": " ".join([*run[:6], "other", *run[6:11]]), "reversed": " ".join(run[::-1]), "plural": " ".join([*run[:11], run[11] + "x"])}
    docs = {i: ["intro text", f] for i, f in enumerate([*forms.values(), *not_forms.values()])}
    docs[900] = [" ".join(run[:6]), " ".join(run[6:])]  # over two cells
    docs[901] = ["x", "y " * 5000 + " ".join(QUESTION)]
    found = {d for d, _ in rows(L.find_leaks(documents(spark, docs), spark.createDataFrame([item(7, QUESTION), item(8, WORDS[30:]), (9, "s", "too short"), (None, "s", " ".join(QUESTION)), (10, "s", None)], ITEMS)))}
    names = [*forms, *not_forms]
    assert [n for i, n in enumerate(names) if (i in found) != (n in forms)] == []
    assert 900 not in found and 901 in found


def test_all_items_that_share_the_run_are_reported_once(spark):
    items = spark.createDataFrame([item(1, QUESTION), item(2, QUESTION[3:20]), item(3, WORDS[28:41])], ITEMS)
    docs = documents(spark, {5: [" ".join(QUESTION[3:16]), " ".join(QUESTION[3:16])]})
    assert rows(L.find_leaks(docs.unionByName(docs), items)) == [(5, 1), (5, 2)]


def test_random_corpus_equals_brute_force_in_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_BYTES", 4_000)
    rnd = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    items = [(i, [rnd.choice(pool) for _ in range(rnd.randrange(8, 60))]) for i in range(20)]
    docs = {}
    for d in range(120):
        words = [rnd.choice(pool + ["zz"]) for _ in range(rnd.randrange(0, 80))]
        if d % 2:
            _, source = rnd.choice(items)
            at = rnd.randrange(len(source))
            words[rnd.randrange(len(words) + 1) : 0] = source[at : at + rnd.randrange(9, 30)]
        docs[d] = [" ".join(words)]
    want = set()
    for i, ws in items:
        grams = {tuple(ws[k : k + 12]) for k in range(len(ws) - 11)}
        for d, (t,) in docs.items():
            w = t.split()
            if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                want.add((d, i))
    assert want and set(rows(L.find_leaks(documents(spark, docs), spark.createDataFrame([item(i, w) for i, w in items], ITEMS)))) == want


def test_paraphrases_keep_order_and_numbers(spark):
    source = [*QUESTION[:11], "417", *QUESTION[11:23]]
    near = [w for i, w in enumerate(source) if i % 6 != 2]
    wrong = [w if w != "417" else "418" for w in near]
    docs = documents(spark, {1: [" ".join([*near, *QUESTION[:4]])], 2: [" ".join(wrong)], 3: ["nothing of it"]})
    found = rows(L.find_paraphrases(docs, spark.createDataFrame([item(1, source)], ITEMS), least_cosine=0.3).select("doc_id", "item_id"))
    assert found == [(1, 1)]


RATES = (0.05, 0.1, 0.2, 0.3, 0.4)


def planted(seed, per_rate=40):
    """Items, and documents that hold a stretch of an item with a share of its words changed, at any place; also (document, item, share)."""
    rnd = random.Random(seed)
    common = [f"c{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    rare = [f"r{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(600)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.45 else rnd.choice(rare)
    items = [(i, [word() if rnd.random() > 0.03 else str(rnd.randrange(10, 9999)) for _ in range(rnd.randrange(50, 130))]) for i in range(40)]
    docs, truth = {}, []
    for share in RATES:
        for _ in range(per_rate):
            i, source = rnd.choice(items)
            n = rnd.randrange(36, len(source) + 1)
            at = rnd.randrange(len(source) - n + 1)
            # numbers stay, as the answer check asks; others become words of any item or of none
            copy = [w if w.isdigit() or rnd.random() >= share else rnd.choice([word(), "zz" + w]) for w in source[at : at + n]]
            pad = [word() if rnd.random() < 0.5 else f"pad{rnd.choice('abcdef')}" for _ in range(rnd.randrange(0, 60))]
            cut = rnd.randrange(len(pad) + 1)
            docs[len(docs)] = [" ".join([*pad[:cut], *copy, *pad[cut:]])]
            truth.append((len(docs) - 1, i, share))
    for _ in range(100):  # of the same words, in another order
        docs[len(docs)] = [" ".join(word() for _ in range(rnd.randrange(40, 120)))]
    return items, docs, truth


def test_planted_paraphrases_are_found_whatever_the_parts(spark, monkeypatch):
    items, docs, truth = planted(7)
    tables = documents(spark, docs), spark.createDataFrame([item(i, w) for i, w in items], ITEMS)
    found = rows(L.find_paraphrases(*tables))
    pairs = {r[:2] for r in found}
    recall = {s: sum((d, i) in pairs for d, i, x in truth if x == s) / sum(x == s for _, _, x in truth) for s in RATES}
    print(recall)
    assert sum(recall.values()) >= 0.9 * len(RATES) and all(recall[s] == 1 for s in RATES[:3])
    assert len(pairs - {t[:2] for t in truth}) <= 0.05 * len(pairs)
    assert all(0.6 <= r[3] <= 1 and abs(r[3] * 24 - r[2]) < 1e-9 or r[2] < 24 for r in found)
    for most in (20_000, 200_000):
        monkeypatch.setattr(L, "PART_BYTES", most)
        assert rows(L.find_paraphrases(*tables)) == found


def test_parts_hold_bounded_bytes_and_every_passage_once():
    items = L.Items([(i, " ".join(f"w{(i * 37 + k * k) % 5000}" for k in range(200))) for i in range(60)])
    for most in (1, 100_000, 10**9):
        parts = items.parts(most)
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(items.owner)))
        for p in parts:
            assert p.stop - p.start <= 64 or 4 * (p.stop - p.start) * len(np.unique(items.wide[p])) <= most
    many = L.Items([(1, " ".join(f"v{k}" for k in range(70_000)))])
    assert many.kind is np.uint32 and int(many.wide.max()) == 70_000


def test_common_runs_of_pairs():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, (400, 24)), rng.integers(0, 3, (400, 24))
    for k in range(200):
        n, i, j = rng.integers(8, 16), rng.integers(0, 8), rng.integers(0, 8)
        b[k, j : j + n] = a[k, i : i + n]
    text = lambda r: " ".join(f"<{w}>" if w else f"0{k}" for k, w in enumerate(r))
    slow = [any(" ".join(f"<{w}>" for w in x[k : k + 12]) in text(y) for k in range(13) if all(x[k : k + 12])) for x, y in zip(a, b)]
    assert L.common_run(a, b).tolist() == slow and any(slow)

def test_a_paraphrase_with_words_outside_the_vocabulary_is_found(spark):
    source = [*QUESTION[:11], "417", *QUESTION[11:23]]
    swapped = [f"other{i}" if i % 6 == 2 else w for i, w in enumerate(source)]  # never 12 words of the item in a row
    few = [f"other{i}" if i % 2 else w for i, w in enumerate(source)]
    docs = documents(spark, {1: [" ".join(swapped)], 2: [" ".join(few)], 3: ["x"], 4: [" ".join(swapped)]})
    found = rows(L.find_paraphrases(docs, spark.createDataFrame([item(1, source)], ITEMS)))
    assert [r[:2] for r in found] == [(1, 1), (4, 1)]
    assert rows(L.find_leaks(docs, spark.createDataFrame([item(1, source)], ITEMS))) == []


def test_a_part_of_an_item_is_found_wherever_it_begins(spark):
    source = [*QUESTION[:8], "417", *QUESTION[8:], *WORDS[30:]]
    docs = {}
    for offset in range(12):
        for begin in range(9):  # these 24 words hold the number, at last as their first
            docs[12 * begin + offset] = [" ".join(["pad"] * offset + source[begin : begin + 24])]
    changed = [w if w != "417" else "418" for w in source[:24]]
    docs[900] = [" ".join(changed)]
    items = spark.createDataFrame([item(1, source)], ITEMS)
    got = {r[0]: r[2] for r in rows(L.find_paraphrases(documents(spark, docs), items)) if r[0] != 900}
    assert got == {d: 24 for d in docs if d != 900}


def test_common_subsequences_of_pairs():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, (300, 36)), rng.integers(0, 9, (300, 36))
    assert L.common_subsequences(a, b).tolist() == [L.common_subsequence(x, y) for x, y in zip(a, b)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=9), st.lists(st.integers(0, 4), max_size=9))
def test_common_subsequence(a, b):
    def slow(x, y):
        if not x or not y:
            return 0
        if x[0] == y[0] and x[0]:
            return 1 + slow(x[1:], y[1:])
        return max(slow(x[1:], y), slow(x, y[1:]))

    assert L.common_subsequence(np.array(a, int), np.array(b, int)) == slow(a, b)


def test_nulls_empties_and_extra_columns(spark):
    items = spark.createDataFrame([item(1, QUESTION)], ITEMS)
    df = documents(spark, {1: [" ".join(QUESTION)], 2: [], 3: [""]})
    odd = spark.createDataFrame([(4, None, [("markdown", None, 0, 4)]), (5, "abc", None), (None, " ".join(QUESTION), [("code", None, 0, 400)]), (6, " ".join(QUESTION), [("code", None, 5, 2), (None, None, 0, 400)])], SCHEMA)
    df = df.unionByName(odd).withColumn("item_id", F.lit(1)).withColumn("words", F.lit("x"))
    assert rows(L.find_leaks(df, items)) == [(1, 1), (6, 1)]
    assert rows(L.find_leaks(df.limit(0), items)) == [] and rows(L.find_leaks(df, items.limit(0))) == []
    assert rows(L.find_paraphrases(df, items.limit(0))) == []


def test_the_sketch_is_that_of_all_passages():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(30)]
    items = L.Items([(1, " ".join(words))])
    docs = [" ".join(rng.choice([*words, *["zz"] * 120], size=n)) for n in (0, 5, 40, 200, 90)]
    cells = [[{"cell_type": "markdown", "start_char": 0, "end_char": len(d)}] for d in docs]
    kind = pa.list_(pa.struct([("cell_type", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())]))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5), pa.int64()), "text": pa.array(docs), "cells": pa.array(cells, kind)})
    got = np.zeros((items.size, L.SKETCH))
    for r in (r for b in L._read(items)(iter([batch])) for r in b.to_pylist()):
        if r["kind"] == "term":
            got[r["term"]] += r["y"]
    numbers = [L.numbered([L.CELL, *L.normalise(d)], items.vocabulary) for d in docs if d]
    stream = np.concatenate([np.concatenate([x, np.zeros(L.PASSAGE + (-len(x)) % L.RUN, np.int32)]) for x in numbers])
    tf = np.array([np.bincount(p, minlength=items.size) for p in L.passages_of(stream)], float)
    tf[:, 0] = 0
    want = tf.T @ (tf @ L.test_matrix(items.size))
    assert np.abs(got - want).max() < 1e-4 * np.abs(want).max()
