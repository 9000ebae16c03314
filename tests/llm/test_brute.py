"""Operators that SQL can't tell against plain versions of their rules."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from graphloom.llm import bpe, linededup, toxicity
from graphloom.llm.common import _splitmix, span_hashes
from tests.llm.test_neardup import brute as near_brute

DOCS = "doc_id bigint, text string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# line dedup


def pieces_of(text):
    """(start, end, after) of each chunk, by the rule: at newlines, and before words where the hash of two words is a strict minimum among AROUND places on either side."""
    raw = text.encode()
    words = [(m.start(), m.end()) for m in WORD.finditer(raw)]
    lines, line = [], 0
    for i, (a, _) in enumerate(words):
        line += bool(i and b"\n" in raw[words[i - 1][1] : a])
        lines.append(line)
    whole = np.frombuffer(raw, np.uint8)
    place = {}
    for i in range(1, len(words)):
        if lines[i] == lines[i - 1]:
            a, b = words[i - 1][0], words[i][1]
            up, down = linededup._power_tables(b + 1)
            total = 0
            for k in range(a, b):
                total = (total + int(linededup._BYTE[whole[k]]) * int(up[k])) % 2**64
            mixed = np.array([total * int(down[a]) % 2**64 ^ (b - a)], np.uint64)
            place[i] = int(linededup._splitmix(mixed)[0])
    cuts = [0]
    for i in range(1, len(words)):
        near = [place[j] for j in range(i - linededup.AROUND, i) if j in place and lines[j] == lines[i]]
        far = [place[j] for j in range(i + 1, i + linededup.AROUND + 1) if j in place and lines[j] == lines[i]]
        if i not in place or (all(place[i] < x for x in near) and all(place[i] <= x for x in far)):
            cuts.append(i)
    out = []
    for n, c in enumerate(cuts):
        last = cuts[n + 1] if n + 1 < len(cuts) else len(words)
        if words:
            out.append((words[c][0], words[last - 1][1], words[last][0] if last < len(words) else len(raw), last - c))
    return raw, out


def clean_brute(rows):
    """What `cleaned` gives for rows (doc_id, text) of distinct ids, none of them null."""
    texts = {d: pieces_of(t or "") for d, t in rows}
    bodies = {d: [raw[a:b] for a, b, _, _ in chunks] for d, (raw, chunks) in texts.items()}
    many = {h for h, n in Counter(x for b in bodies.values() for x in b).items() if n > 1}
    runs = {}
    for d, (_, chunks) in texts.items():
        inside, k = set(), 0
        while k < len(chunks):
            j = k
            while j < len(chunks) and bodies[d][j] in many:
                j += 1
            if sum(c[3] for c in chunks[k:j]) >= linededup.RUN:
                inside |= set(range(k, j))
            k = max(j, k + 1)
        runs[d] = inside
    keeper, count = {}, Counter()
    for d in sorted(texts):
        for k in sorted(runs[d]):
            keeper.setdefault(bodies[d][k], (d, k))
            count[bodies[d][k]] += 1
    out = {}
    for d, t in rows:
        raw, chunks = texts[d]
        gone = [k in runs[d] and count[bodies[d][k]] > 1 and keeper[bodies[d][k]] != (d, k) for k in range(len(chunks))]
        words = lambda d, ks: [w for k in ks if 0 <= k < len(bodies[d]) for w in bodies[d][k].split()]
        parts, done, removed, k = [], 0, 0, 0
        while k < len(chunks):
            if not gone[k]:
                k += 1
                continue
            j = k
            while j < len(chunks) and gone[j]:
                j += 1
            n, begin, to = sum(c[3] for c in chunks[k:j]), chunks[k][0], chunks[j - 1][2]
            f, at = keeper[bodies[d][k]]
            if k and at:
                first = k - 2 if k > 1 and not gone[k - 2] else k - 1
                own = [(m.start(), m.group()) for m in WORD.finditer(raw[chunks[first][0] : chunks[k - 1][1]])][::-1]
                other = words(f, [at - 2, at - 1])[::-1]
                same = next((i for i, (x, y) in enumerate(zip(own, other, strict=False)) if x[1] != y), min(len(own), len(other)))
                if same:
                    n, begin = n + same, chunks[first][0] + own[same - 1][0]
            f, at = keeper[bodies[d][j - 1]]
            if j < len(chunks) and at + 1 < len(bodies[f]):
                last = j + 1 if j + 1 < len(chunks) and not gone[j + 1] else j
                own = [(m.start(), m.group()) for m in WORD.finditer(raw[chunks[j][0] : chunks[last][1]])]
                other = words(f, [at + 1, at + 2])
                same = next((i for i, (x, y) in enumerate(zip(own, other, strict=False)) if x[1] != y), min(len(own), len(other)))
                if same:
                    n, to = n + same, chunks[last][2] if same == len(own) else chunks[j][0] + own[same][0]
            if n >= linededup.LEAST:
                parts.append(raw[done : max(begin, done)])
                done, removed = to, removed + j - k
            k = j
        text = (b"".join(parts) + raw[done:]).decode() if removed else t
        out[d] = ("" if removed and not text.strip() else text, removed, bool(removed and not text.strip()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_plain_rules(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "中文", "a.", "?"]
    say = lambda n: "".join(r.choice(vocab) + r.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))
    plain = lambda n: " ".join(r.choices(vocab, k=n))
    shared = [plain(r.randint(5, 90)) for _ in range(12)] + [say(60) for _ in range(4)]
    rows = []
    for d in range(90):
        parts = [r.choice(shared) if r.random() < 0.5 else say(r.randint(0, 40)) for _ in range(r.randint(0, 5))]
        rows.append((d, r.choice([" ", "\n", "\n\n"]).join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1] + " more"), (502, None), (503, ""), (504, " \n ")]
    got = {x.doc_id: (x.text, x.n_removed, x.emptied) for x in linededup.cleaned(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert got == clean_brute(rows)


def test_line_dedup_of_long_texts(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["own"] * 3 + words[30_000:60_000] + ["end"]))]
    got = {x.doc_id: x.text for x in linededup.cleaned(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: rows[0][1], 2: "own own own end"}


# toxicity


def features_of(text):
    """Hashes of words and their prefixes, one by one."""
    found = set()
    one = lambda b: int(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", lower):
        found.add(one(w) >> 32)
        for n in toxicity.PREFIXES:
            if len(w) > n:
                found.add(int(_splitmix(np.array([one(w[:n]) + n & 2**64 - 1], np.uint64))[0]) >> 32)
    return found


def toxic_corpus(n=400):
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(800)]
    bad = ["zzkilo", "zzkilometre", "vexing", "qqrude"]
    rows = []
    for i in range(n):
        t = r.choices(words, k=r.randint(5, 80))
        if i % 6 == 0:
            for _ in range(r.randint(2, 5)):
                t[r.randrange(len(t))] = r.choice(bad)
        rows.append((i, " ".join(t).capitalize(), int(i % 6 == 0)))
    return rows


def test_severity_equals_a_second_reckoning(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "vexing " * 50_000)], DOCS)
    model = toxicity.train(docs, spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id bigint, toxic int"))
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    for x in toxicity.score(docs, model).collect():
        text = {a: b for a, b, _ in rows}.get(x.doc_id, {902: "vexing"}.get(x.doc_id))
        w = sum(weight.get(f, 0.0) for f in features_of(text))
        at_least = [1 / (1 + np.exp(t - w)) for t in model.thetas]  # of grades 1 and 2
        grades = [1 - at_least[0], at_least[0] - at_least[1], at_least[1]]
        assert sum(grades) == pytest.approx(1) and x.severity == pytest.approx(grades[1] + 2 * grades[2]) and x.p_toxic == pytest.approx(at_least[0])
        assert x.rejected == (at_least[0] >= model.reject)


def test_fit_is_at_the_least_penalised_loss():
    rows = toxic_corpus()
    found = [np.array(sorted(features_of(t)), np.uint32) for _, t, _ in rows]
    toxic = np.array([c > 0 for _, _, c in rows])
    model = toxicity.fit(found, toxic)
    n1, n0 = toxic.sum(), (~toxic).sum()
    index = {f: i for i, f in enumerate(model.ids.tolist())}
    x = np.zeros((len(rows), len(index)))
    for i, f in enumerate(found):
        x[i, [index[v] for v in f.tolist() if v in index]] = 1
    share = x.sum(axis=1) / np.maximum(1, [len(f) for f in found])
    grade = np.where(toxic, 1 + (share > np.median(share[toxic])), 0)

    def loss(w, thetas):
        upto = 1 / (1 + np.exp(-(thetas[None, :] - (x @ w)[:, None])))
        p = np.select([grade == 0, grade == 1], [upto[:, 0], upto[:, 1] - upto[:, 0]], 1 - upto[:, 1])
        return -(np.where(toxic, 0.5 / n1, 0.5 / n0) * np.log(p)).sum() + 1e-5 * (w @ w)

    best = loss(model.weights, model.thetas)
    assert best < 0.7 * loss(0 * model.weights, np.array([0.0, 1.0]))
    for i in [*np.argsort(-np.abs(model.weights))[:10], None]:
        for step in (-0.3, 0.3):
            w, th = model.weights.copy(), model.thetas.copy()
            if i is None:
                th = th + step
            else:
                w[i] += step
            assert loss(w, th) > best - 2e-4
    for f, i in list(index.items())[:50]:
        a, b = x[toxic, i].sum(), x[~toxic, i].sum()
        assert a >= 3 and (a + 0.5) / n1 >= toxicity.TIMES * (b + 0.5) / n0


# the pipeline's stages, each on its own input


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = docs.where("length(text) > 400").orderBy("doc_id").first()
    more = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (t.doc_id, t.text, t.lang, t.source, t.n_chars), (10**6 + 2, t.text, "en", None, t.n_chars), (None, t.text + " x", "en", "src1", 1), (None, "one two three four five six", "en", "src1", 5)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


def test_stage_toxicity(spark, odd):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.drop_toxic(spark, odd, sf).collect()
    model = toxicity.train(odd, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    rejected = lambda t: bool(weight) and 1 / (1 + np.exp(model.thetas[0] - sum(weight.get(f, 0.0) for f in features_of(t)))) >= model.reject
    assert Counter(map(tuple, out)) == Counter(tuple(r) for r in odd.collect() if not rejected(r.text))


def test_stage_line_dedup(spark, odd):
    own = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = clean_brute([(r.doc_id, r.text) for r in own.select("doc_id", "text").collect()])
    rows = {r.doc_id: r for r in own.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.dedup_lines(spark, own, "").collect()}
    assert {d: r.text for d, r in got.items()} == {d: t for d, (t, _, emptied) in want.items() if not emptied}
    assert all(r.n_chars == len(r.text or "") and (r.lang, r.source) == (rows[d].lang, rows[d].source) for d, r in got.items())
    whole = corpus_pipeline.dedup_lines(spark, odd, "")
    assert whole.columns == odd.columns and whole.where("text is null").count() == 1


def test_stage_near_duplicates(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    least = [(d if d is not None else 10**9 + i, t) for i, (d, t) in enumerate(rows)]  # rows without an id come last
    keep = {d for d, _, component in near_brute(least, 5, 80) if d == component}
    got = corpus_pipeline.drop_near_copies(spark, odd, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(d for d in keep if d < 10**9)
    assert sum(r.doc_id is None for r in got) == sum(d >= 10**9 for d in keep)


def test_stage_mixing(spark, odd):
    size = Counter()
    for r in odd.collect():
        size[r.source] += len(WORD.findall((r.text or "").encode()))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in over} if over else {s: level * weight[s] for s in open_}
        left -= sum(2 * size[s] for s in over)
        open_ = open_ - over if over else set()
    want = Counter()
    for r in odd.collect():
        rate = target[r.source] / size[r.source] if size[r.source] else 0.0
        key = str(r.doc_id) if r.doc_id is not None else "null:" + hashlib.md5((r.text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:13], 16) / 2**52
        if n := int(rate) + (u < rate - int(rate)):
            want[tuple(r)] += n
    assert Counter(map(tuple, corpus_pipeline.mix_sources(spark, odd, "").collect())) == want


def test_stage_bpe(spark, odd):
    enc = bpe.encoding(bpe.rank_file(public_tokenizers.path(corpus_pipeline.RANKS)), public_tokenizers.PATTERN)
    got = Counter((r.doc_id, r.source, tuple(r.token_ids), r.n_tokens) for r in corpus_pipeline.encode(spark, odd, "").collect())
    assert got == Counter((r.doc_id, r.source, tuple(enc.encode_ordinary(r.text or "")), len(enc.encode_ordinary(r.text or ""))) for r in odd.collect())
