import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from graphloom.llm import bpe, contextmix, linededup, mixing, mpeg, pii, toxicity, urls, vafile
from graphloom.llm.common import text_buffer, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# mixing


def test_mixing_levels_equal_resharing(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(10, "a"), (200, "b"), (30, None), (5, "a"), (0, "z"), (400, "c"), (7, "é"), (90, "b")])]
    got = {r.doc_id: r for r in mixing.rates(spark.createDataFrame(rows, DOCS + ", source string")).collect()}
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
        open_ -= over
    for d, t, s in rows:
        assert got[d].target == pytest.approx(target[s]) and got[d].source_size == size[s]
        assert got[d].taken in (len(WORD.findall(t)) * k for k in (0, 1, 2)) and got[d].taken <= 2 * got[d].size
    assert mixing.rates(spark.createDataFrame([], DOCS + ", source string")).collect() == []


def test_many_sources_mix_like_few(spark, monkeypatch):
    rows = [(i, "a " * (i % 7), f"s{i % 40}" if i % 41 else None, 1) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS + ", source string, salt int")
    few = sorted(map(str, mixing.rates(df).collect())), sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "FEW", 3)
    assert (sorted(map(str, mixing.rates(df).collect())), sorted(map(str, mixing.mix(df).collect()))) == few and mixing.mix(df).columns == df.columns


def test_mix_copies_follow_rates_and_reruns_agree(spark):
    rows = [(i, "a b c d", f"s{i % 3}", 9) for i in range(3000)] + [(None, None, None, 1)]
    df = spark.createDataFrame(rows, DOCS + ", source string, size int")
    once, again = mixing.mix(df).collect(), mixing.mix(df).collect()
    assert sorted(map(str, once)) == sorted(map(str, again)) and mixing.mix(df).columns == df.columns
    want = {r.source: r.target for r in mixing.source_targets(df.select("source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    odd = spark.createDataFrame([(None, f"w{i} a b c", "s", i) for i in range(3000)] + [(None, "x " * 3000, "t", 0)], DOCS + ", source string, rate int").withColumns({"copy": F.lit("c"), "of": F.lit(1)})
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.where("copy = 'c' and of = 1").count() == mixed.count()
    target = mixing.source_targets(odd.select("source", mixing.word_count(F.col("text")).alias("size"))).where("source = 's'").first().target
    assert 4 * mixed.where("source = 's'").count() == pytest.approx(target, rel=0.1) and 1.1 < target / 12000 < 1.9
    for s in ("s0", "s1", "s2"):
        assert 4 * sum(r.source == s for r in once) == pytest.approx(want[s], rel=0.1)


# personal data


def brute_spans(text):
    text = text or ""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in digits(s)][::-1]
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    for k, (kind, pattern, ok) in enumerate(checks):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
    return sorted(out)


PII_TEXTS = [
    None, "", "mail a.b+c@d-e.co.uk, x@y and p@q.r@s.t or @@a.b", "a@b.c%d@e.f then ..@--.--", "10.0.0.1 and 256.1.1.1, 1.2.3.4.5.6.7.8 0001.02.3.255",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4012888888881881 7 4012888888881881", "x4111 1111 1111 1111 22", "call +1 (743) 555-3824 or +49 30 1234567890123 or +1 2",
    "é😀 é 4111111111111111 😀 a@b.co 😀 1.1.1.1", "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and GB82WEST12345698765431", "1" * 5000 + " " + "1 " * 5000, "a" * 20000 + "@b.c" + ".d" * 9000, "+1" + "(" * 3000,
]


def test_pii_base_equals_plain_regexes(spark):
    rows = list(enumerate(PII_TEXTS))
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, DOCS)).collect()}
    for d, t in rows:
        want = brute_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (d, got[d].spans, text)
        assert set(text.split(",")) - {""} <= set(got[d].spans.split(","))
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
    assert got[9].spans.count("iban") == 2
    assert pii.report(spark.createDataFrame([], DOCS)).collect() == []


def test_redact_and_scores(spark):
    df = spark.createDataFrame([(1, "visa card 4111 1111 1111 1111 now", 3), (2, None, 4), (3, "a@b.co 1.2.3.4", 5), (4, "", 6), (5, "invoice 4111111111111111", 7)], DOCS + ", spans int")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "visa card [card] now" and got[2].text is None and got[3].text == "[email] [ip]" and got[4].text == "" and got[1].spans == 3
    assert {r.doc_id: r.scores for r in pii.report(df).collect()} == {1: "1.0", 2: "", 3: "0.6,0.6", 4: "", 5: "0.8"}
    assert {r.doc_id: r.text for r in pii.redact(df, least=0.85).collect()}[3] == "a@b.co 1.2.3.4"
    over = pii.redact(spark.createDataFrame([(1, "é x+1 (743) 555-3824@b.co, tel 😀 1.1.1.1")], DOCS)).first().text
    assert over == "é x[phone], tel 😀 [ip]"


def test_many_spans_in_one_text(spark):
    n = 20000
    text = " ".join(f"user{i}@host{i}.org" if i % 2 else f"😀{i % 256}.1.1.1" for i in range(n))
    df = spark.createDataFrame([(1, text)], DOCS)
    began = __import__("time").time()
    got = pii.report(df).first()
    assert __import__("time").time() - began < 30
    want = brute_spans(text)
    assert got.n_email == got.n_ip == n // 2 and got.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest()
    assert pii.redact(df).first().text == " ".join("[email]" if i % 2 else "😀[ip]" for i in range(n))


# exact search


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_top_k_equals_all_products(spark, scale):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(r.normal(size=8), 1) * scale]) for i in range(400)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, []), (None, [1.0] * 8), (450, [1.0, 2.0])]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(50, rows[50][1])]
    rows += [(50, rows[50][1])] * 20 + [(3000 + i // 7, rows[50][1]) for i in range(60)]
    rows += [(100, rows[77][1]), (2001, [9e4 * scale] * 8)]
    df = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "vec_id bigint, embedding array<double>, uid int, score double")
    got = {}
    for x in vafile.top_k(df).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in {i for i, v in good if i % 50 == 0}:
        s = sorted((-max((sum(a * b for a, b in zip(v, w, strict=True)) for j, v in good if j == q and len(w) == len(v)), default=None), i) for i, w in good if i != q and any(j == q and len(v) == len(w) for j, v in good))[:5]
        assert sorted(got.get(q, [])) == [(n, i, min(-p, (1 << 63) - 1)) for n, (p, i) in enumerate(s, 1)]
    assert vafile.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_few_exact_vectors_are_read(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 512)
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(r.normal(size=(4000, 32)))], "vec_id bigint, embedding array<double>")
    whole = vafile.usable(df, "vec_id", "embedding", 256.0)
    file = vafile.approximated(whole, vafile.reaches(whole))
    asked = file.where("vec_id % 50 = 0")
    assert 5 * 80 <= vafile.survivors(file, asked, 5).count() < 0.02 * 80 * 4000


# line dedup


def test_line_dedup_removes_planted_passages_and_leaves_the_rest(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    sentence = lambda: " ".join(word() for _ in range(9)).capitalize() + "."
    passages = [" ".join(sentence() for _ in range(8)) for _ in range(5)] + ["\n".join(sentence() for _ in range(8)) for _ in range(5)] + [" ".join(word() for _ in range(60))]
    rows, planted = [], []
    for i in range(200):
        parts = [sentence() for _ in range(6)]
        if i % 2:
            p = passages[i % len(passages)]
            parts.insert(3, ("\n" if i % 3 else "") + p + ("\n" if i % 5 else ""))
            planted.append((i, p))
        rows.append((i, " ".join(parts) + " Common footer line."))
    rows += [(300, None), (301, ""), (302, rows[0][1]), (302, rows[0][1]), (None, rows[2][1])]
    df = spark.createDataFrame([(*x, "s", 1, "e", 2) for x in rows], DOCS + ", source string, lost int, emptied string, bucket int")
    got = {}
    for x in linededup.cleaned(df).collect():
        got.setdefault(x.doc_id, x)
    for i in range(0, 200, 2):
        assert got[i].text == rows[i][1] and not got[i].n_removed and got[i].emptied == "e" and got[i].bucket == 2
    first = {}
    missed = 0
    for i, p in planted:
        if first.setdefault(p, i) == i:
            assert got[i].text == rows[i][1]
        else:
            missed += p in got[i].text
            assert len(got[i].text) > 100
    assert missed <= 0.05 * len(planted)
    assert got[300].text is None and got[301].text == "" and got[302].emptied_ and got[None].emptied_
    kept = linededup.dedup(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert linededup.cleaned(spark.createDataFrame([], DOCS)).collect() == []


def test_line_dedup_finds_passages_inside_lines_whole(spark):
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choices("klmnopqrst", k=6))
    say = lambda n: " ".join(word() for _ in range(n))
    danda = lambda n: " ".join(say(15) + "\u0964" for _ in range(n))
    passages = [say(70) for _ in range(6)] + [f"{say(35)}. {say(35)}." for _ in range(6)] + [danda(5) for _ in range(6)] + [" ".join(f"({say(12)}.)" for _ in range(6)) for _ in range(6)]
    docs, planted = [], []
    for i in range(240):
        before, after, p = say(9), say(9), passages[i % len(passages)]
        docs.append((i, f"{before} {p} {after}"))
        planted.append((before, p, after))
    got = {x.doc_id: x.text for x in linededup.cleaned(spark.createDataFrame(docs, DOCS)).collect()}
    left = 0
    for i, (before, p, after) in enumerate(planted):
        if i < len(passages):
            assert got[i] == docs[i][1]
        else:
            assert got[i].startswith(before + " ") and got[i].endswith(after)
            left += len(got[i].split()) - 18
    assert left <= 0.01 * sum(len(p.split()) for _, p, _ in planted[len(passages) :])


def test_chunks_cover_texts():
    texts = ["A b c. D e!\nF", " \n", "", "x", "One two. Three\n\nfour " * 50, "é. ü"]
    from graphloom.llm.common import text_buffer

    raw, at = text_buffer(pa.array(texts))
    c = linededup.chunks(raw, at)
    for r, t in enumerate(texts):
        own = np.flatnonzero(c.row == r)
        assert c.words[own].sum() == len(t.split())
        if len(own):
            assert (c.start[own][1:] == c.after[own][:-1]).all() and c.after[own][-1] == at[r + 1]


def test_bitmap_tells_repeated_chunks(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PART", 1 << 12)
    texts = [f"line {i // (1 + i % 2)} of text\nonly {i}\n" for i in range(3000)] + [None, ""]
    bits = linededup._repeated(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), sum(len(t or "") for t in texts))
    raw, at = text_buffer(pa.array(texts))
    h = linededup.chunks(raw, at).hash
    values, n = np.unique(h, return_counts=True)
    assert linededup._within(bits, values[n > 1]).all() and linededup._within(bits, values[n == 1]).mean() < 0.01 and (n > 1).sum() > 100


# URLs


def brute_rule(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = lower(re.match("[^/?#]*", rest).group())
    path = re.match("[^/?#]*([^?#]*)", rest).group(1)
    fits = [(h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_templates_go_on_where_deep_branches_differ(spark):
    rows = [("h", f"/a/b/c/d/{kind}/{i}x{j}", int(kind == "bad")) for kind in ("good", "bad") for i in "pqr" for j in "stu"] + [("h", "/a/b/c/d/bad/y", None), ("h", "/a/b/c/d/good/y", None), ("h", "/a/b/c/d", None)]
    rows += [("k", f"/a/b/c/{i}/{j}", 1) for i in "pq" for j in "st"]
    got = {(r.host, r.masked): (r.template, r.purity) for r in urls.templates(spark.createDataFrame(rows, "host string, masked string, blocked int")).collect()}
    assert len(got) == len(rows)
    mix = lambda bad, seen, above: (bad + urls.PRIOR * above) / (seen + urls.PRIOR)
    prior = 0.5
    for _ in range(7):  # last label, last two, host, /a, /a/b, /a/b/c, /a/b/c/d
        before, prior = prior, mix(9, 18, prior)
    assert got["h", "/a/b/c/d/bad/y"] == ("/a/b/c/d/bad/**", pytest.approx(mix(9, 9, prior))) and got["h", "/a/b/c/d/good/y"] == ("/a/b/c/d/good/**", pytest.approx(mix(0, 9, prior)))
    assert got["h", "/a/b/c/d"] == ("/a/b/c/d", pytest.approx(before))
    prior = 0.5
    for _ in range(5):
        prior = mix(4, 4, prior)
    assert got["k", "/a/b/c/p/s"] == ("/a/b/c/**", pytest.approx(mix(4, 4, prior)))
    assert got["h", "/a/b/c/d/bad/y"][1] > urls.LEAST > 0.5 > got["h", "/a/b/c/d/good/y"][1]


def test_url_branches_without_labels_go_where_their_host_goes(spark):
    rows = [("bad.net", f"/es/{i}", 1) for i in "abc"] + [("bad.net", "/de/x", None), ("sub.bad.net", "/en/x", None), ("good.net", "/en/x", 0), ("good.net", "/en/y", 0), ("good.net", "/fr/y", None), ("mixed.org", "/q", None)]
    rows += [("two.org", "/bad/" + i, 1) for i in "abcdefgh"] + [("two.org", "/good/" + i, 0) for i in "abcdefgh"] + [("two.org", "/bad/x", None), ("two.org", "/good/x", None), ("two.org", "/new/x", None)]
    got = {(r.host, r.masked): r for r in urls.templates(spark.createDataFrame(rows, "host string, masked string, blocked int")).collect()}
    assert got["bad.net", "/de/x"].template.startswith("/~") and got["bad.net", "/de/x"].purity > urls.LEAST
    assert got["bad.net", "/de/x"].template.split("/")[1] == got["bad.net", "/es/a"].template.split("/")[1]
    assert got["sub.bad.net", "/en/x"].purity > 0.7 and got["good.net", "/fr/y"].purity < 0.5
    assert got["two.org", "/bad/x"].purity > urls.LEAST > got["two.org", "/new/x"].purity > got["two.org", "/good/x"].purity


def test_url_rules_and_templates(spark):
    some = ["http://EXAMPLE.com/en/1", "http://www.example.com/en/2?x", "https://a.b.net/es/3#y", "http://net/fr/", "http://x.org", "http://com", "http://example.com?q=/en/", None, "", "no url", "http://ünï.COM/é/1", "ftp://h.net/de/1"]
    some += ["http://spam.net/de/7", "http://x.org/en/" + "s/" * 3000, None, "http://Spam.net/fr/9"]
    some += [f"http://spam.net/es/{i}" for i in range(9)] + [f"http://spam.net/fr/{i}" for i in range(9)] + [f"http://spam.net/es/p{i}q/x" for i in range(40)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, "h", 0.0) for i, u in enumerate(some)], "page_id bigint, url string, host string, purity double")).collect()}
    assert len(got) == len(some)
    action = {h + p: a for a, h, p in urls.RULES}
    for i, u in enumerate(some):
        assert (got[i].host, got[i].path, got[i].rule) == brute_rule(u)
        assert got[i].verdict == (action[got[i].rule] if got[i].rule else "block" if got[i].host.endswith(".net") else "allow")
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


def test_templates_reject_by_purity(spark):
    rows = [("h", f"/a/<n>/s{i}", 1) for i in range(30)] + [("h", f"/a/<n>/t{i}", None) for i in range(5)] + [("h", "/b/x", 0)] * 5 + [("h", "/b/y", 1), ("g", "/a/<n>/z", None)]
    got = {(r.host, r.masked): r for r in urls.templates(spark.createDataFrame(rows, "host string, masked string, blocked int")).collect()}
    assert got["h", "/a/<n>/t1"].template == got["h", "/a/<n>/s1"].template and got["h", "/a/<n>/t1"].purity > urls.LEAST
    assert got["h", "/b/x"].purity < 0.5 and got["g", "/a/<n>/z"].purity == 0.5


# byte-level BPE


def test_bpe_equals_the_library_and_round_trips(spark):
    ranks, pattern = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
    enc = bpe.encoding(ranks, pattern)
    texts = [None, "", "Hello world's <|endoftext|>", "é😀 日本語  \n\n x", " ", "a" * 3000, "word " * 40000 + "end", "mixed Text 12 34 .,;\t" * 9000, "  many   spaces  here " * 20]
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(list(enumerate(texts)), DOCS), ranks, pattern).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 8)], DOCS + ", n_tokens int")
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(df, ranks, pattern), ranks, pattern).collect()}
    assert bytes(back[1].decoded) == b"a b" and back[1].n_tokens == 7 and back[1].n_tokens_ == 2 and bytes(back[2].decoded) == b""
    assert bpe.digests(spark.createDataFrame([], DOCS), ranks, pattern).collect() == []


@pytest.mark.parametrize("size", [5, 17, 64])
def test_bpe_cuts_are_safe(size):
    enc = bpe.encoding(bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    for t in ("it's a  test of'll the cut 's at 12 places, é word x y\x1c z a b c d e f " * 30, "nospaces" * 50):
        assert "".join(bpe.pieces(t, size)) == t
        assert bpe.encode_text(enc, t, size).tolist() == enc.encode_ordinary(t)
        assert len(list(bpe.pieces(t, size))) > 3 or " " not in t


def test_bpe_cuts_of_any_text_are_safe():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    enc = bpe.encoding(bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    assert public_tokenizers.PATTERN == bpe.SPLIT

    @settings(max_examples=400, deadline=None)
    @given(st.text("ab're'llsS 1\u0662\n\t\r\u3000\x1c\x85\xa0\u4e2d\u6587\uff0c\u3002.!-_\u00e9\u0301\U0001f600", max_size=60), st.integers(1, 6))
    def check(t, size):
        assert "".join(bpe.pieces(t, size)) == t and bpe.encode_text(enc, t, size).tolist() == enc.encode_ordinary(t)

    check()
    assert max(map(len, bpe.pieces("\u4e2d\u6587\uff0c" * 5000 + "12ab" * 5000 + "a,b" * 5000, 100))) < 200


# toxicity


def test_toxicity_on_held_out_rows(spark):
    import random

    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 9))) for _ in range(3000)]
    bad = ["zzkilo", "zzkilometre", "vexing", "qqrude"]
    rows = []
    for i in range(1200):
        t = r.choices(words, k=r.randint(5, 200))
        if i % 8 == 0:
            for _ in range(max(2, len(t) // 20)):
                t[r.randrange(len(t))] = r.choice(bad)
        rows.append((i, " ".join(t).capitalize(), int(i % 8 == 0)))
    docs = spark.createDataFrame([(a, b, 1.0) for a, b, _ in rows] + [(9000, None, 1.0), (9001, "", 1.0)], DOCS + ", severity double")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if a < 700] + [(None, 1), (3, None), (4, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    test = [(a, c) for a, _, c in rows if a >= 700]
    assert sum(got[a].rejected == bool(c) for a, c in test) >= 0.98 * len(test)
    assert not got[9000].rejected and not got[9001].rejected and len(got) == 1202
    assert all(0 <= x.severity <= 2 for x in got.values()) and (np.diff(model.thetas) > 0).all()
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {a for a, x in got.items() if not x.rejected}
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert not any(x.rejected for x in toxicity.score(docs, none).collect())
    assert toxicity.train(docs.limit(0), labels) == toxicity.NONE


# audio


def test_audio_round_trip_and_features(spark):
    texts = [None, "", "x" * 63, "x" * 64, "é" * 5000, "some TAG here " + "y" * 121, "abc\n" * 40000]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate([*texts, texts[4]])], DOCS + ", media string")
    got = {r.doc_id: r for r in mpeg.features(mpeg.store(df)).collect()}
    for i, t in enumerate(texts):
        n, p = mpeg.padded(t)
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert x.duration_samples == 1152 * x.n_frames and len(x.seek_offsets) == x.n_frames
        assert x.reason is None and "table_agrees=1" in x.feature
        media = [r.media for r in mpeg.store(df.where(F.col("doc_id") == i)).collect()][0] if i in (2, 4, 6) else None
        assert media is None or plain_frames(media) == (p, x.seek_offsets)
    assert got[4].media_sha256 == got[7].media_sha256 and got[4].feature == got[7].feature
    assert mpeg.features(mpeg.store(df.limit(0))).collect() == []


def plain_frames(file):
    """The bytes after side information of MPEG-1 Layer III mono frames behind an ID3v2 tag and a Xing frame, and where they begin."""
    kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    at = 10 + (file[6] << 21 | file[7] << 14 | file[8] << 7 | file[9])
    bodies, offsets = [], []
    while at < len(file):
        assert file[at] == 0xFF and file[at + 1] == 0xFA and file[at + 3] >> 6 == 3
        size = 144000 * kbps[file[at + 2] >> 4] // 44100 + (file[at + 2] >> 1 & 1)
        bodies.append(file[at + 23 : at + size])
        offsets.append(at)
        at += size
    n = int.from_bytes(file[10 + 10 + 8 : 10 + 10 + 16])
    return b"".join(bodies[1:])[:n], offsets[1:]


def test_audio_features_of_foreign_and_damaged_files(spark):
    good = mpeg.write(b"some words " * 500)
    foreign = b"".join(h + b"\x55" * room for h, room in [mpeg._frame_head(k) for k in (64, 128, 320) * 4])
    hurt = bytearray(good)
    hurt[2000] ^= 255
    files = [(1, 5500, good), (2, 0, foreign), (3, 5500, bytes(hurt)), (4, 0, b""), (5, 0, None), (6, 0, b"\xff\xfb" * 300), (7, 0, b"ID3"), (8, 5500, good[:2500])]
    got = {r.doc_id: r for r in mpeg.features(spark.createDataFrame(files, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert got[1].reason is None and got[1].payload_bytes == 5500 and len(set(got[1].feature.split("kbps=")[1].split(";")[0].split("-"))) == 2
    assert got[2].reason == "no payload tag" and got[2].payload_bytes is None and got[2].n_frames == 12 and got[2].duration_samples == 12 * 1152
    assert got[3].reason == got[8].reason == "damaged payload" and "table_agrees=0" in got[8].feature
    assert got[4].n_frames == got[7].n_frames == 0 and got[5].feature is None and got[6].reason


def test_audio_reads_vbri_tables():
    heads = [mpeg._frame_head(k) for k in (128, 64, 128, 320, 64)]
    sizes = [len(h) + room for h, room in heads]
    body = b"VBRI" + bytes(6) + (sum(sizes)).to_bytes(4) + (4).to_bytes(4) + (4).to_bytes(2) + (1).to_bytes(2) + (2).to_bytes(2) + (1).to_bytes(2) + b"".join(n.to_bytes(2) for n in sizes[:4])
    head, room = heads[0]
    file = (head + bytes(36 - len(head)) + body).ljust(sizes[0], b"\0") + b"".join(h + bytes(r) for h, r in heads[1:])
    a = mpeg.read(file)
    assert a.table == "VBRI" and a.table_frames == 4 == len(a.offsets) and a.points[1:] == a.offsets and a.table_agrees
    assert not mpeg.read(file[: -sizes[-1]]).table_agrees


def test_audio_reader_resynchronises_and_checks():
    for n in (64, 1021, 1022, 5000, 100000):
        p = bytes(i * 7 % 251 for i in range(n))
        file = mpeg.write(p)
        a = mpeg.read(file)
        assert mpeg.payload_of(a) == p and a.crc_bad == 0 and a.skipped == 0 and a.table == "Xing" and a.table_frames == len(a.offsets)
        for o in a.offsets:
            assert mpeg.header(int.from_bytes(file[o : o + 4]))
    a0 = mpeg.read(file)
    at = a0.offsets[3]
    hurt = file[:at] + b"junk" * 3 + file[at:]
    a = mpeg.read(hurt)
    assert a.resyncs == 1 and a.skipped == 12 and len(a.offsets) == len(a0.offsets) and mpeg.payload_of(a) == p
    wrong = bytearray(file)
    wrong[at + 8] ^= 1  # within side information
    assert mpeg.read(bytes(wrong)).crc_bad == 1
    with pytest.raises(ValueError):
        mpeg.payload_of(mpeg.read(bytes(wrong)))
    assert mpeg.read(file + b"TAG".ljust(128, b"\0")).tags["ID3v1"][:3] == b"TAG"
    assert mpeg.read(b"").offsets == [] and mpeg.read(b"\xff" * 500).offsets == []


def test_crc16_check_value():
    assert mpeg.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


# language-model scores


def test_scores_base_and_counts(spark):
    r = __import__("random").Random(2)
    vocab = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(1, 40))).title() + ("\n" if i % 2 else "")) for i in range(150)] + [(900, None), (901, ""), (902, "Never-seen ñandú"), (None, "word1 word2"), (5, "word1 word1")]
    got = contextmix.scores(spark.createDataFrame([(*x, 0) for x in rows], DOCS + ", score int")).collect()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    count = {}
    for d, t in rows:
        if not held(d):
            for w in [*WORD.findall(lower(t)), None]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    for d, t in rows:
        tokens = [*WORD.findall(lower(t)), None]
        base = sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        x = min(by[d], key=lambda x: abs(x.base_score - base))
        assert x.held_out == held(d) and x.n_tokens == len(tokens) and x.n_known == sum(w in count for w in tokens) and x.train_tokens == n
        assert x.base_score == pytest.approx(base) and x.score < 0
    assert contextmix.scores(spark.createDataFrame([], DOCS)).collect() == []


def test_spelling_model_is_a_distribution_and_learns():
    words = [b"the", b"then", b"there", b"than", b"that", b"this"] * 50
    raw = np.frombuffer(b"".join(words), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    code = contextmix.Code.of(np.bincount(raw, minlength=256))
    assert sum(2.0 ** -int(n) for n in code.length) == pytest.approx(1)
    table = np.zeros((contextmix.CONTEXTS, 1 << contextmix.LEAST_BITS, 2), np.uint32)
    contextmix.count(raw, at, table, code)
    assert table.sum() == contextmix.CONTEXTS * sum(int(code.length[b]) for w in words for b in w + b"\0")
    m = contextmix.Mixer.fresh()
    for _ in range(5):
        contextmix.learn(raw, at, table, code, m)
    score = lambda ws: contextmix.log2_spelled(np.frombuffer(b"".join(ws), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in ws])]).astype(np.int64), table, code, m)
    one = [b"", *(bytes([b]) for b in range(1, 256))]
    two = [bytes([a, b]) for a in b"thx" for b in range(1, 256)]
    assert (2.0 ** score(one)).sum() < 1 and (2.0 ** score([*one, *two])).sum() <= 1.001
    good, bad = score([b"there", b"xqzjk"])
    assert good > bad + 10


def test_frequencies_equal_plain_counts():
    r = __import__("random").Random(4)
    vocab = ["a", "of", "é", *(f"Word{i}" for i in range(12))]
    texts = ["", "one", *(" ".join(r.choices(vocab, k=r.randint(1, 30))) for _ in range(30))]
    training = np.array([i % 4 > 0 for i in range(len(texts))])
    raw, at = text_buffer(pa.array(texts))
    known = contextmix.tokens(raw, at, 64)[0]
    given = []
    for keys in known.keys:
        d = contextmix.distinct(keys, known.row)
        given.append(np.bincount(d.of, training[known.row], minlength=len(d.keys)).astype(np.int64))
    n = int(training[known.row].sum())
    f = contextmix.frequencies(known, given, training, n)
    lines = [["<", "<", *WORD.findall(lower(t)), None] for t in texts]

    def seen(own):
        c = [__import__("collections").Counter() for _ in range(3)]
        for i, w in enumerate(lines):
            if training[i] and i != own:
                for j in range(2, len(w)):
                    for k, key in enumerate([(w[j],), (w[j - 1], w[j]), tuple(w[j - 2 : j + 1])]):
                        c[k][key] += 1
        return c

    x = 0
    for i, w in enumerate(lines):
        c = seen(i)
        starts = sum(training) - bool(training[i])
        for j in range(2, len(w)):
            pair = starts if j == 2 else c[0][(w[j - 1],)]
            triple = 0 if j == 2 else c[1][(w[j - 2], w[j - 1])]
            want = [(c[2][tuple(w[j - 2 : j + 1])], triple), (c[1][(w[j - 1], w[j])], pair), (w[2:j].count(w[j]), j - 2), (c[0][(w[j],)], sum(c[0].values()))]
            assert [(round(float(a * b), 6), b) for a, b in zip(f.p[:, x], f.context[:, x], strict=True)] == [(min(a, b), b) for a, b in want], (i, j)
            assert f.rest[x] == c[0][(w[j],)] and f.total[x] == f.rest[x] + training[i] * w.count(w[j])
            x += 1
    assert x == len(f.rest)


def test_chain_is_a_distribution_and_learns_online():
    r = np.random.default_rng(5)
    chain = contextmix.Chain.fresh()
    n = 300
    slots = lambda m: [[np.full(m, 3 * k + i) for i in range(contextmix.PREDICTORS)] for k in range(contextmix.ORDERS)]
    p = np.array([r.dirichlet(np.full(n - 50, 0.1)).tolist() + [0.0] * 50 for _ in range(contextmix.ORDERS)])  # the last 50 are told by no order
    s = np.concatenate([np.full(n - 50, -np.inf), np.full(50, np.log2(1 / 50))])
    one = lambda k: (slots(k), [np.zeros(k, int)] * contextmix.ORDERS, np.zeros(k, int))
    for _ in range(20):
        assert np.exp2(chain.step(p, *one(n), np.ones((contextmix.ORDERS, n), bool), s, np.zeros(n, bool))).sum() == pytest.approx(1)
        drawn = r.choice(n, 500, p=0.9 * np.append(p[1, :-50], [0] * 50) + 0.1 * np.append(np.zeros(n - 50), np.full(50, 1 / 50)))
        last = chain.step(p[:, drawn], *one(500), np.ones((contextmix.ORDERS, 500), bool), s[drawn], np.ones(500, bool)).mean()
    fresh = contextmix.Chain.fresh().step(p[:, drawn], *one(500), np.ones((contextmix.ORDERS, 500), bool), s[drawn], np.zeros(500, bool)).mean()
    assert last > fresh + 0.3


@pytest.mark.parametrize("most", [3, 2**40])
def test_packed_counts_come_back(most):
    r = np.random.default_rng(6)
    keys = np.unique(r.integers(0, 1 << 63, 1000, np.uint64))
    counts = r.integers(0, most, len(keys)).astype(np.uint64)
    once = [b"x" * int(i % 7) for i in range(int((counts == 1).sum()))]
    k, c, _ = contextmix._unpack(contextmix._pack(keys, counts, once))
    assert (k == keys).all() and (c == counts.astype(np.int64)).all()
    assert contextmix._unpack(contextmix._pack(keys[:1], counts[:1], None))[0].tolist() == keys[:1].tolist()


def test_scores_of_held_out_texts_beat_the_base(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sums = lambda: docs.sparkSession.createDataFrame(contextmix.scores(docs).collect()).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("total_bits").alias("bits"), F.sum("n_bytes").alias("n"), F.count("*").alias("rows")).first()
    got = sums()
    assert got.s > 0.9 * got.b and got.bits / got.n < 2.5 and got.s == pytest.approx(-got.bits * np.log10(2))
    assert sums() == got
    monkeypatch.setattr(contextmix, "BLOCK", 1 << 17)
    monkeypatch.setattr(contextmix, "PART", 1 << 16)
    many = sums()
    assert many.b == pytest.approx(got.b) and many.rows == got.rows and many.s > 0.95 * many.b


def test_scores_tell_copies_and_order_apart(spark):
    r = __import__("random").Random(9)
    vocab = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in ("ab", "ek", "op", "ul") for c in "nrstvwxz"]
    rows = [(i, " ".join(r.choices(vocab, k=60))) for i in range(300)]
    copy = rows[17][1].split()
    rows += [(400 + i, rows[i][1]) for i in range(100, 160)]
    rows += [(1000, " ".join(copy)), (1001, " ".join(sorted(copy)))]
    got = {x.doc_id: x for x in contextmix.scores(spark.createDataFrame(rows, DOCS), training=F.col("doc_id") < 1000).collect()}
    assert got[1000].bits_per_byte < 0.6 * got[1001].bits_per_byte and got[1000].held_out


def test_words_have_hashes_of_their_own():
    one = lambda n: bytes(97 + bin(i).count("1") % 2 for i in range(n))
    for n in (16, 64, 65, 1024, 4096):
        t = one(n).decode()
        raw, at = text_buffer(pa.array([t, t.translate(str.maketrans("ab", "ba")), t]))
        h = words(raw, at).hash
        assert h[0] != h[1] and h[0] == h[2]
    many = ["".join(x) for x in __import__("itertools").product("abc", repeat=7)]
    raw, at = text_buffer(pa.array([" ".join(many), "a" * 70 + " " + "a" * 71]))
    assert len(set(words(raw, at).hash.tolist())) == len(many) + 2
