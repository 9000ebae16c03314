import random

import numpy as np
import pytest

from graphloom.llm import neardup
from graphloom.llm.common import text_buffer
from graphloom.llm.components import components
from graphloom.llm.shingles import overlap, shingle_sets


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def set_of(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = [set_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def made(seed, n=220):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = " ".join(r.choices(vocab, k=60))
    base = [" ".join(r.choices(vocab, k=r.choice([3, 12, 30, 60, 150, 300]))) for _ in range(40)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(int(len(w) * r.choice([0, 0, 0.01, 0.03, 0.06]))):
            w[r.randrange(len(w))] = r.choice(vocab)
        text = " ".join(w)
        if r.random() < 0.4:
            text = line + "\n" + text
        out.append((i, text))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one")]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return neardup.near_duplicates(df, **more).collect()


@pytest.mark.parametrize("seed,small", [(1, 16), (2, 2)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = made(seed)
    got = run(spark, rows, size=4)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = neardup.near_duplicates(docs, size=4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)


def test_nulls_repeats_and_empty_table(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(None, text), (7, text), (7, text), (3, "x y"), (None, "lone words here now")]
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in run(spark, rows, size=5)), key=str)
    assert got == sorted([(True, None, 7, False), (False, 7, 7, True), (False, 7, 7, True), (False, 3, 3, True), (True, None, None, True)], key=str)
    assert run(spark, []) == []


def test_drop_copies_keeps_columns(spark):
    text = " ".join(f"a{i}" for i in range(50))
    df = spark.createDataFrame([(1, text, "s", 5), (2, text, "t", 6), (2, text, "t", 6), (4, "other", None, 7), (5, None, "u", 8)], "doc_id bigint, text string, source string, n bigint")
    got = neardup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5]


def test_drop_copies_is_the_same_each_time(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(i % 3, text if i % 2 else None, f"s{i}", {"k": i}, i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, th string, m map<string, int>, row int")
    one, two = neardup.drop_copies(df.repartition(5)), neardup.drop_copies(df.repartition(3, "th"))
    assert one.columns == df.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 4


def test_words_that_a_plain_polynomial_confuses(spark):
    say = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    a = say(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    got = run(spark, [(1, " ".join([a] * 3 + ["x"])), (2, " ".join([b] * 3 + ["x"])), (3, a), (4, b), (5, a)], size=4)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_long_texts(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    other = words.copy()
    for i in range(0, len(other), 500):
        other[i] = "changed"
    got = run(spark, [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:100_000]))], size=5)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5)]
    got = {(r.node, r.label) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (200, 100), (300, 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_shingle_sets_match_word_tuples():
    import pyarrow as pa

    texts = ["a b c d e", "A  B\tc\nd", None, "a b", "é È x y z", "a b c d a b c d"]
    h, at = shingle_sets(*text_buffer(pa.array(texts)), 4)
    assert np.diff(at).tolist() == [len(set_of(t, 4)) for t in texts]
    assert overlap(h[at[0] : at[1]], h[at[1] : at[2]]) == 1
