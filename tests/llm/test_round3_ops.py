"""Token counts, conversation repair and the filters' audit against plain versions of their rules."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from graphloom.llm import filteraudit, tokencount, turns
from graphloom.llm.queries import MODEL, op11_token_counts, op12_turn_repair, op13_filter_audit

SF = "/root/testdata/sf0.001"
TALK = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def encoder():
    return tokencount.Encoder(tokencount.model_file(public_tokenizers.path(MODEL)))


# token counts


def odd_texts():
    rng = random.Random(3)
    docs = [t or "" for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]
    yield "".join(docs)
    for part in ("a", "ab", " ", "日本語テキスト", "x\n\n  ", "é", "0123456789", "</s> <unk> ", "▁a "):
        yield part * (20_000 // len(part))
    for letters in ("abcdefghijklmnop", "ab▁ \n😀é͸日\0\r"):
        yield "".join(rng.choice(letters) for _ in range(20_000))


@pytest.mark.parametrize(("size", "overlap"), [(tokencount.CHUNK, tokencount.OVERLAP), (1000, 16), (77, 5), (300, 2)])
def test_spliced_ids_are_those_of_the_whole_text(encoder, size, overlap):
    assert encoder.spliceable
    for text in odd_texts():
        assert np.concatenate(list(encoder.ids(text, size, overlap))).tolist() == encoder.whole.encode(text)


def test_texts_without_a_shared_token_are_encoded_in_longer_chunks(encoder):
    text = " " * 5000
    assert encoder.parts(text, 77, 5) is None and encoder.count(text, 77, 5) == len(encoder.whole.encode(text))


def test_other_models_encode_whole():
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(tokencount.model_file(public_tokenizers.path(MODEL)))
    spec.normalizer_spec.remove_extra_whitespaces = True
    other = tokencount.Encoder(spec.SerializeToString())
    text = "a  b   c " * 3000
    assert not other.spliceable and other.count(text, 100, 10) == len(other.whole.encode(text))


def test_token_counts_of_odd_rows(spark, encoder):
    rows = [(1, None, 5), (2, "", 5), (None, "hello </s>", None), (4, "wörd " * 5000, 1), (4, "wörd " * 5000, 1), (5, "日" * 40_000, 0)]
    model = tokencount.model_file(public_tokenizers.path(MODEL))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, N_Tokens int")
    out = tokencount.count(df, model)
    assert out.columns == ["doc_id", "text", "N_Tokens", "n_bytes", "n_tokens_", "over_limit"]
    plain = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = [(i, t, k, len((t or "").encode()), n := len(plain.encode(t or "")), n > 4096) for i, t, k in rows]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert tokencount.count(df.limit(0), model).collect() == []


def test_op11_equals_the_library(spark, encoder):
    texts = {d["doc_id"]: d["text"] or "" for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = op11_token_counts(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {tuple(r) for r in got.collect()} == {(i, len(t.encode()), n := len(encoder.whole.encode(t)), n > 4096) for i, t in texts.items()}


# conversation repair


def plain_edits(rows):
    """The cheapest edits by a search over (cost, initials, rows read, roles so far), and the roles that they give."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if (i, out[-1:]) in done:
            continue
        done.add((i, out[-1:]))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit, out
        further = [(cost + 2, audit + "I", i, out + r) for r in "ua"]
        if i < len(rows):
            role, gone, cut = rows[i]
            further.append((cost + 3, audit + "D", i + 1, out))
            if not gone:
                further.append((cost + cut, audit + "K", i + 1, out + (role or "?")))
                further += [(cost + 2 + cut, audit + "R", i + 1, out + r) for r in "ua"]
        for x in further:
            if re.fullmatch("s?(ua)*u?", x[3]):
                heapq.heappush(heap, x)


def plain_report(table, damage):
    seen, groups = {}, {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        copies = {0: 0, 3: 2}.get(kind, 1)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * copies
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            ink = text.strip("\t\n\x0b\x0c\r ")
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, roles = plain_edits([(r[1][:1], f in ("blank", "duplicate"), int(f == "truncated")) for r, f in zip(rows, faults)])
        lines, i, at = [], 0, 0
        for x in audit:
            if x == "I":
                lines.append({"u": "user:", "a": "assistant:"}[roles[at]])
                at += 1
                continue
            if x != "D":
                role = rows[i][1] if x == "K" else {"u": "user", "a": "assistant"}[roles[at]]
                lines.append(f"{role}:{rows[i][2]}")
                at += 1
            i += 1
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_talks():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "usher", "User"]
    texts = ["Hi.", "Yes!", "cut off", "", "  \n", None, "Où ? ", "ends.\x0b", "a" * 5000 + "?", "no end…", " "]
    for conv in range(150):
        for turn in range(rng.randrange(9)):
            yield (conv or None, rng.choice([turn, turn, turn * 3, None, 0]), rng.choice(roles[: 3 if conv % 2 else 8]), rng.choice(texts))
    yield from [(500, 0, "user", "same.")] * 40
    yield from [(501, t, "user" if t % 2 == 0 else "assistant", f"row {t}.") for t in range(300)]


@pytest.mark.parametrize("damage", [True, False])
def test_repair_equals_a_plain_search(spark, damage):
    table = list(odd_talks())
    df = spark.createDataFrame([(*r, 1) for r in table], TALK + ", copies int").repartition(5)
    got = turns.report(turns.damaged(df) if damage else turns.plain(df))
    want = plain_report(table, damage)
    found = {r.conv_id: tuple(r) for r in got.collect()}
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found == want


def test_a_conversation_over_many_tasks_is_one(spark):
    table = [(7, t // 3, "user" if t % 2 else "assistant", f"t {t % 40}.") for t in range(900)] + [(8, 1, "user", "x")]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.conv_id: tuple(r) for r in turns.report(turns.plain(spark.createDataFrame(table, TALK))).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == plain_report(table, False)


def test_a_trie_walk_is_each_signature_alone():
    rng = random.Random(5)
    letters = list(turns.LETTERS.values())
    signatures = sorted("".join(rng.choice(letters) for _ in range(rng.randrange(7))) for _ in range(400))
    assert list(turns.walk(signatures)) == [next(turns.walk([s])) for s in signatures]
    for s in signatures:
        rows = [(role, fault in ("blank", "duplicate"), int(fault == "truncated")) for role, fault in (turns._MEANING[x] for x in s)]
        assert next(turns.walk([s]))[4:] == plain_edits(rows)[:2]


def test_repaired_rows(spark):
    table = [(1, 0, "user", "Hi."), (1, 1, "user", "Yes."), (2, 0, "assistant", "No."), (3, 0, "tool", " ")]
    rows = turns.plain(spark.createDataFrame(table, TALK))
    out = turns.repaired(rows, turns.audit(turns.signatures(rows)))
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0, "user", "Hi.", "K"), (1, 2, 1, "assistant", "Yes.", "R"), (2, 1, None, "user", "", "I"), (2, 2, 0, "assistant", "No.", "K")]


def test_op12_on_whole_table(spark):
    table = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    assert {r.conv_id: tuple(r) for r in op12_turn_repair(spark, SF).collect()} == plain_report(table, True)
    none = spark.createDataFrame([], TALK)
    assert turns.report(turns.damaged(none)).collect() == []


# filter interactions


def plain_audit(docs, labels):
    known = {}
    for i, q, t in labels:
        a, b = known.get(i, (0, 0))
        known[i] = (max(a, int(q == 1)), max(b, int(t == 1)))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        fails.append((source or "", {x for x in f if f[x]}, *(known.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {f[0] for f in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            every = left
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                unique = sum(f[1] == {x} for f in every)
                failing = sum(x in f[1] for f in every)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), unique, sum(f[2] for f in gone), sum(f[3] for f in gone)]
        total = {x: sum(out[part, o, o.index(x) + 1][1] for o in map("".join, itertools.permutations("ABCDE"))) for x in "ABCDE"}
        for (p, o, s), v in out.items():
            if p == part:
                v.append(total[o[s - 1]])
    return {(*k, *v) for k, v in out.items()}


def odd_docs():
    rng = random.Random(2)
    texts = ["", None, "a b c", "A" * 50, "x # y", "word " * 250, " ".join(f"w{i}" for i in range(220)), "É" * 100 + "AB", "same same " * 30, "long " * 20_000, " ".join(f"w{i}" for i in range(220)) + " &"]
    return [(rng.choice([rng.randrange(300), None, 5, 5]), rng.choice(texts), rng.choice([None, "", "a", "b", "b", "b"])) for _ in range(500)]


@pytest.mark.parametrize("partitions", ["1", "4", "41"])
def test_audit_equals_plain_filters(spark, partitions):
    docs, labels = odd_docs(), [(i % 120, i % 3 % 2, i % 5 % 2) for i in range(200)] + [(None, 1, 1), (5, None, 1)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id bigint, text string, source string, mask int")
        got = filteraudit.audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        assert {tuple(r) for r in got.collect()} == plain_audit(docs, labels)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_texts_that_share_a_fingerprint_are_told_apart(spark, monkeypatch):
    docs = [(i, f"text {i % 3}", "a") for i in range(60)]
    monkeypatch.setattr(filteraudit.F, "xxhash64", lambda *_: filteraudit.F.lit(1).cast("bigint"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = filteraudit.masks(spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.doc_id for r in got if not r["mask"] & filteraudit.DUPLICATE) == [0, 1, 2] and len(got) == 60


def test_masks_of_batches(spark):
    texts = ["", "a b", "A" * 50, "x|"]
    assert filteraudit.failures(pa.array(texts)).tolist() == [1, 1, 1 | 4, 1 | 8]


def test_op13_on_whole_tables(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()]
    got = op13_filter_audit(spark, SF)
    assert {tuple(r) for r in got.collect()} == plain_audit(docs, labels)
    empty = filteraudit.audit(spark.createDataFrame([], "doc_id bigint, text string, source string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert empty.collect() == []
