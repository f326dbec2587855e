"""The n-gram join against all pairs, on sets of words themselves."""

import random

import pytest

from gatehouse.llm import common, ngram_join
from gatehouse.llm.common import Scratch
from gatehouse.llm.ngram_join import Rule, connected_components, jaccard_components, one_of_each


def shingles(text, width):
    """Written anew: no hashes, no arrays."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, rule):
    sets = [(i, shingles(t, rule.width)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= rule.percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def edited(r, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(vocabulary)
    return " ".join(words)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(40, 120))] for _ in range(6)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    texts = [edited(r, b, r.randint(0, 5), vocabulary) for b in base for _ in range(r.randint(2, 12))]
    texts += [f"{passage} {edited(r, b, 3, vocabulary)}" for b in base for _ in range(3)]
    texts += [" ".join(base[0])] * 5 + ["", None, "two words", "TWO\tWords", "one", " \n ", passage]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, (None, " ".join(base[0])), rows[0]]


@pytest.mark.parametrize(("seed", "rule"), [(1, Rule(3, 90)), (2, Rule(5, 80)), (3, Rule(1, 50))])
def test_components_equal_all_pairs(spark, seed, rule):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, token string, size int")
    assert sorted(map(tuple, jaccard_components(df, rule).collect()), key=repr) == brute(rows, rule)


@pytest.mark.parametrize("rule", [Rule(3, 90), Rule(1, 60)])
def test_families_beyond_a_cell_and_links_beyond_a_task(spark, monkeypatch, rule):
    monkeypatch.setattr(ngram_join, "CELL_SETS", 3)
    monkeypatch.setattr(ngram_join, "TASK_LINKS", 10)
    monkeypatch.setattr(ngram_join, "TASK_TOKENS", 20)
    monkeypatch.setattr(ngram_join, "TILE_CELLS", 100)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 30)
    monkeypatch.setattr(common, "HOT_SHARE", 30)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard_components(df, rule).collect()), key=repr) == brute(rows, rule)


def test_hot_copies_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    monkeypatch.setattr(ngram_join, "CELL_SETS", 8)
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(200)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    near = [r.choice(vocabulary) for _ in range(100)]
    texts = [passage] * 40 + [f"{passage} {r.choice(vocabulary)}" for _ in range(25)] + [edited(r, near, r.randint(0, 3), vocabulary) for _ in range(40)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_components(df, Rule(3, 90)).collect()), key=repr) == brute(rows, Rule(3, 90))


def test_very_long_texts(spark):
    r = random.Random(13)
    words = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:59_000])), (3, " ".join(reversed(words))), (4, "x" * 400_000)]
    got = {x.doc_id: x.component_id for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Rule(3, 90)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    rows = corpus(5)
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Rule(3, 90))
    assert len(list(tmp_path.glob("*/[0-9]*"))) == 2  # the rows and their labels, which the result reads
    assert out.count() == len(rows)


def test_copies_of_ids_with_several_texts(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    a, b = (" ".join(r.choice(vocabulary) for _ in range(80)) for _ in range(2))
    rows = [(3, a), (5, a), (5, b), (7, f"{b} more"), (9, a), (9, "none of it is like the others")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, Rule(3, 90)).collect()), key=repr) == brute(rows, Rule(3, 90))


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, None), (5, "other words stand here now")]
    df = spark.createDataFrame([(i, t, 7, "u") for i, t in rows], "doc_id long, text string, n_chars long, dropped_id string")
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert one_of_each(df.where("false")).count() == 0


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("links", [7, 100_000])
def test_long_paths_become_one_component(spark, monkeypatch, links):
    monkeypatch.setattr(ngram_join, "TASK_LINKS", links)
    r = random.Random(6)
    names = r.sample(range(10_000), 400)
    edges = list(zip(names[:299], names[1:300])) + [(names[300], names[301])]
    found = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6), Scratch(spark, "test")).collect()}
    one, two = min(names[:300]), min(names[300:302])
    assert found == {n: one for n in names[:300] if n != one} | {max(names[300:302]): two}
