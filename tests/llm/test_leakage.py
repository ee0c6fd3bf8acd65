import pickle
import random

import numpy as np
import pytest

from runloom.llm import leakage

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "ve", "zo", "ra", "ne", "pi", "su") for b in ("ba", "do", "fi", "gu", "le", "mo", "na", "po", "ri", "te")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(1)
    shared = "please solve the following task with care and stop once it is done " * 2
    items = [(i, shared + text(rng, 60)) for i in range(60)]
    docs, want = [], set()
    for d in range(200):
        body = text(rng, 150)
        if d % 4 == 0:
            i = rng.randrange(60)
            w = items[i][1].split()[-45:]
            for k in range(len(w)):
                if rng.random() < 0.15:
                    w[k] = rng.choice(["also", "this", "one"])
                if rng.random() < 0.1:
                    w[k] += " now"
            body += "\n> " + "\n> ".join(" ".join(w[k : k + 9]).upper() for k in range(0, len(w), 9))
            want.add((d, i))
        elif d % 4 == 1:
            body = shared + body
        elif d % 4 == 2:
            body += " " + " ".join(items[d % 60][1].split()[-3:])  # a short phrase
        docs.append((d, body))
    docs += [(900, None), (901, "")]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found <= want and len(found) >= len(want) - 1  # a quarter of all words is replaced or has one put beside it


def test_blocks(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, text(rng, 50)) for i in range(40)]
    docs = spark.createDataFrame([(i, text(rng, 30) + " " + t) for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_TOKENS", 500)
    got = {(r[0], r[1]) for r in leakage.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(40)}


def test_a_stretch_that_qualifies_counts_beside_one_with_more_rare_tokens(spark):
    rng = random.Random(3)
    plain = [f"plain{k}" for k in range(20)]  # in three items each: no evidence
    first, second = [f"rare{k}" for k in range(8)], [f"seldom{k}" for k in range(5)]
    head = first + plain[:8]  # 16 tokens, 8 of them rare
    tail = [w for k in range(5) for w in [second[k], *plain[4 * k : 4 * k + 4]]]  # 25 tokens, 5 of them rare
    items = [(0, " ".join([*head, *text(rng, 40).split(), *tail])), (1, " ".join(plain)), (2, " ".join(plain[::-1]))]
    far = " ".join(f"far{k}" for k in range(2000))
    docs = [(0, " ".join([*head, far, *tail])), (1, " ".join([*head, far]))]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): (r["tokens"], r["rare_tokens"]) for r in got.collect()}
    assert found[0, 0] == (25, 5) and (1, 0) not in found


def find(spark, docs, items):
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in got.collect()}


def test_items_listed_more_than_once_each_have_their_row(spark):
    rng = random.Random(4)
    item = text(rng, 60)
    others = [(10 + i, text(rng, 60)) for i in range(5)]
    docs = [(0, text(rng, 40) + " " + item), (1, text(rng, 100))]
    assert find(spark, docs, [(1, item), (2, item), (3, item.upper()), (4, item), *others]) == {(0, 1), (0, 2), (0, 3), (0, 4)}


@pytest.mark.parametrize("n", [3, 8, 9, 17])
def test_short_items_are_found_whole(spark, n):
    rng = random.Random(n)
    item = text(rng, n)
    docs = [(0, f"{text(rng, 40)} {item} {text(rng, 40)}"), (1, f"{text(rng, 40)} {' '.join(item.split()[:-1])} {text(rng, 40)}"), (2, item)]
    assert find(spark, docs, [(1, item), (2, text(rng, 50))]) == {(0, 1), (2, 1)}


@pytest.mark.parametrize("block", [300, 1_000_000])
def test_blocks_do_not_change_what_is_found(spark, monkeypatch, block):
    rng = random.Random(5)
    shared = text(rng, 30)
    items = [(i, f"{shared} {text(rng, 40)}") for i in range(20)]
    docs = [(i, f"{text(rng, 30)} {' '.join(t.split()[40:70])}") for i, t in items] + [(100 + i, f"{shared} {text(rng, 60)}") for i in range(20)]
    monkeypatch.setattr(leakage, "BLOCK_TOKENS", block)
    assert find(spark, docs, items) == {(i, i) for i in range(20)}


def test_index_is_sent_in_plain_arrays():
    """Executors need not have this package."""
    index = leakage.kernel.SeedIndex.build([1], [np.arange(40, dtype=np.uint64)], np.empty(0, np.uint64))
    assert b"runloom" not in pickle.dumps(index.arrays())
