"""Each query against brute force, on driver tables and on odd ones, and on empty tables."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.llm import bpe, decontaminate, exact_dedup, langid, licenses, line_dedup, queries, secrets, simhash, subwords, token_store
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
Q = queries.queries()


def pairs(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def items(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]


def got(spark, name, folder, *columns):
    return Counter(tuple(r) for r in Q[name](spark, folder).select(*columns).collect())


@pytest.fixture(params=["small", "odd"])
def folder(request, odd):
    return SMALL if request.param == "small" else odd


def test_op1(spark, folder):
    assert got(spark, "op1_bpe_codec", folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter(brute.op1(pairs(spark, folder)))


def test_op1_decode(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    back = Counter((r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs)).collect())
    assert back == Counter((d, t or "") for d, t in pairs(spark, odd))


def test_long_pieces():
    """Pieces far over LONG bytes are read in time that grows with their length alone, and as the library reads them."""
    import time

    from tokenizers import Tokenizer

    known, coder = Tokenizer.from_file(bpe.default_path()), bpe.tokenizer(bpe.default_path())
    rng = random.Random(3)
    texts = {"letters": "".join(rng.choices("etaoinshrdlucmf", k=200_000)), "dashes": "-" * 20_000, "one letter": "a" * 100_000, "just over": "ab" * 128 + "c", "at the bound": "q" * 256, "signs": "".join(rng.choices("=-*#", k=30_000))}
    for name, text in texts.items():
        began = time.perf_counter()
        ids = np.frombuffer(coder.encode_text(text), np.int32).tolist()
        took = time.perf_counter() - began
        assert ids == known.encode(text, add_special_tokens=False).ids, name
        assert took < 6, (name, took)


def test_automaton_of_other_merges():
    """Merge lists on which greedy and left-to-right readings differ."""
    rng = random.Random(0)
    for _ in range(200):
        labels, merges, tokens = {0: b"a", 1: b"b", 2: b"c"}, [], [0, 1, 2]
        for t in range(3, 3 + rng.randint(1, 12)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if labels[u] + labels[v] in labels.values():
                continue
            labels[t] = labels[u] + labels[v]
            merges.append((u, v, t))
            tokens.append(t)
        machine = bpe.MergeAutomaton(labels, merges)
        words = [bytes(rng.choices(b"abc", k=rng.randint(0, 12))) for _ in range(30)]
        for word, path in zip(words, machine.encode(words), strict=True):
            ids = [b"abc".index(x) for x in word]
            rank = {(u, v): (k, t) for k, (u, v, t) in enumerate(merges)}
            while found := [(rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]:
                _, i = min(found)
                ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]
            assert np.frombuffer(path, np.int32).tolist() == ids, (merges, word)


def test_op2(spark, folder):
    expected = Counter(brute.op2(pairs(spark, folder)))
    found = got(spark, "op2_exact_dedup", folder, "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found == expected


def test_op2_external_history(spark):
    old = spark.createDataFrame([(1, "Abc"), (2, "x"), (3, "abc")], "doc_id long, text string")
    history = exact_dedup.history_of(exact_dedup.digest_rows(old))
    new = spark.createDataFrame([(10, "ABC"), (11, "new"), (12, "NEW"), (13, None), (14, "x"), (15, "abc"), (1, "X")], "doc_id long, text string")
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(new, history).collect()}
    assert rows == {(10, 15, 4, False), (15, 15, 4, True), (11, 12, 2, False), (12, 12, 2, True), (13, 13, 1, True), (14, 14, 3, True), (1, 14, 3, False)}
    loads = history.unionByName(history.selectExpr("digest", "winner - 1 as winner", "size"))
    again = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(new, loads).collect()}
    assert again == {(10, 15, 6), (15, 15, 6), (11, 12, 2), (12, 12, 2), (13, 13, 1), (14, 14, 4), (1, 14, 4)}
    newer = history.selectExpr("digest", "winner + 100 as winner", "size")
    assert {(r.keep_id, r.kept) for r in exact_dedup.exact_dedup(new, newer).filter("doc_id in (10, 14, 15, 1)").collect()} == {(103, False), (102, False)}


def test_op2_copies_of_buckets(spark, monkeypatch):
    """Buckets and copies of a few rows each give the same."""
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 5)
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 3)
    assert got(spark, "op2_exact_dedup", SMALL, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == Counter(brute.op2(pairs(spark, SMALL)))


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        digests = rng.integers(0, 256, (n, 32), np.uint8)
        assert sorted(exact_dedup.PerfectHash(digests).slots(digests).tolist()) == list(range(n))


def test_op3(spark, folder):
    expected = Counter(brute.op3(pairs(spark, folder), items(spark, folder)))
    assert got(spark, "op3_decontamination", folder, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected


def test_op3_in_blocks(spark, odd, monkeypatch):
    whole = got(spark, "op3_decontamination", odd, "*")
    docs, bench = spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/benchmark.parquet")
    clean = Counter(tuple(r) for r in decontaminate.scrub(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    assert got(spark, "op3_decontamination", odd, "*") == whole
    assert Counter(tuple(r) for r in decontaminate.scrub(docs, bench).collect()) == clean


def test_op3_repeated_items(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([("1", "one two"), ("1", "two three"), ("10", "two"), (None, "three")], "item_id string, text string")
    assert [(r["items"], r.n_words) for r in decontaminate.report(docs, bench).collect()] == [(["", "1", "10"], 3)]


def test_op3_scrub(spark):
    docs = spark.createDataFrame([(1, "Before. One TWO three; after", 28), (2, "one two three", 13), (3, "clean é text", 12), (4, None, None), (5, "é one, two, three é", 20)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.scrub(docs, bench).collect()}
    assert rows == {1: ("Before. ; after", 15), 3: ("clean é text", 12), 4: (None, None), 5: ("é  é", 4)}


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(200):
        runs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 6))]
        s = np.array([x for r in runs for x in r])
        left = np.array([len(r) - k for r in runs for k in range(len(r))])
        ends = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        expected = sorted(range(len(s)), key=lambda p: [*((1, int(x)) for x in s[p : p + left[p]]), (0, int(ends[p]))])
        assert decontaminate.sort_suffixes(s, left, 20).tolist() == expected


def test_op4(spark, odd):
    assert got(spark, "op4_token_store", SMALL, "doc_id", "start", "n_tokens", "ids_crc32") == Counter(brute.op4(pairs(spark, SMALL)))
    single = [(d, t) for d, t in pairs(spark, odd) if d not in (6, None)]
    found = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in Q["op4_token_store"](spark, odd).collect()}
    assert all(found[d] == (n, crc) for d, _, n, crc in brute.op4(single))
    target = token_store.store(spark.read.parquet(f"{odd}/documents.parquet"))
    assert sorted(len(r.ids) for r in token_store.read_documents(spark, target).collect()) == sorted(r.n_tokens for r in Q["op4_token_store"](spark, odd).collect())
    rows = sorted(Q["op4_token_store"](spark, odd).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()


def test_op4_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 500)
    monkeypatch.setattr(token_store, "PART_ROWS", 30)
    assert got(spark, "op4_token_store", SMALL, "doc_id", "start", "n_tokens", "ids_crc32") == Counter(brute.op4(pairs(spark, SMALL)))


def test_huffman_round_trip():
    rng = np.random.default_rng(3)
    for n, most in ((1, 18), (2, 18), (3, 2), (1000, 10), (40_000, 18)):
        counts = np.maximum(1, (1e6 / (1 + rng.permutation(n)) ** 3).astype(np.int64))
        lengths = token_store.code_lengths(counts, most)
        assert lengths.max() <= max(most, (n - 1).bit_length()) and (n == 1 or abs(sum(2.0**-lengths) - 1) < 1e-9)
        ids = rng.choice(n, 5000, p=counts / counts.sum())
        sizes = np.array([1, 63, 64, 65, 1000, 5000 - 1193])
        code = token_store.Code(lengths)
        assert (code.unpack(*code.pack(ids, sizes), sizes) == ids).all()


def test_op5(spark, odd):
    rows = Q["op5_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    rows = Q["op5_language_id"](spark, odd).collect()
    assert len(rows) == len(pairs(spark, odd)) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" and r.rejected for r in rows if r.doc_id in (1, 2, 3, 12, 13))


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k}") for k in range(400)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs)


def test_perfect_hash_refuses_repeats():
    digests = np.frombuffer(b"a" * 32 + b"b" * 32 + b"a" * 32, np.uint8).reshape(-1, 32)
    with pytest.raises(ValueError, match="more than once"):
        exact_dedup.PerfectHash(digests)
    assert sorted(exact_dedup.PerfectHash(digests[:2]).slots(digests[:2])) == [0, 1]


def test_letters_decide_und():
    import pyarrow as pa

    model = subwords.Classifier(["a", "b"], np.zeros((2, langid.BUCKETS), np.float32), np.zeros(2))
    assert langid.predict(pa.array([None, "", "12 .", "é", "日", "①", "x"]), model)[0] == ["und", "und", "und", "a", "a", "und", "a"]


def test_op6(spark, folder):
    expected = brute.op6(pairs(spark, folder))
    if folder == SMALL:
        assert got(spark, "op6_line_dedup", folder, "doc_id", "n_lines", "n_removed", "text_sha256") == Counter(expected)
    else:
        found = got(spark, "op6_line_dedup", folder, "doc_id", "n_removed", "text_sha256")
        assert found == Counter((d, n, t) for d, _, n, t in expected)


def test_op6_near_lines(spark):
    rng = random.Random(4)
    words = ["aa", "bb", "cc", "dd"]
    base = [rng.choices(words, k=rng.randint(6, 12)) for _ in range(12)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(3):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                rng.choice([lambda: w.insert(k, rng.choice(words)), lambda: w.pop(k), lambda: w.__setitem__(k, "zz")])()
            lines.append(" ".join(w))
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect()}
    for d, _, n, text in brute.op6(docs):
        assert (found[d][0], brute.sha(found[d][1])) == (n, text), (d, found[d])


def test_op7(spark, odd):
    rows = Q["op7_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    rows = Q["op7_quality"](spark, odd).collect()
    assert len(rows) == len(pairs(spark, odd)) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_op8(spark, folder):
    assert got(spark, "op8_secrets", folder, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == Counter(brute.op8(pairs(spark, folder)))


def test_op8_links(spark):
    key = "aB3" + "x" * 37
    docs = spark.createDataFrame([(1, f"login: someone {key}"), (2, f"{key}"), (3, "login: someone https://host.example/a"), (4, f"login: someone {key} https://host.example/a"), (5, "login: someone" + " " * 300 + key), (6, "é😀 secret=token=abcdefghijkl"), (7, "password: token = abcdefghijklmnop")], "doc_id long, text string")
    from fernweave.llm import secrets

    rows = {r.doc_id: r.s for r in secrets.find_spans(docs).select("doc_id", secrets.as_text("spans").alias("s")).collect()}
    assert rows == {1: "account:0:14,key:15:55", 2: "", 3: "", 4: "account:0:14,key:15:55,endpoint:56:78", 5: "", 6: "assign:3:28", 7: ""}


def test_op8_links_against_brute_force(spark):
    rng = random.Random(12)
    parts = ["password: 'abcdefgh12345678'", "token=" + "Z" * 30, "AKIA" + "ABCDEFGHIJ123456", "deadbeef" * 3, "user: someone", "login=me.too@example", "A1" + "b" * 38, "https://example.com/" + "p" * 300, "http://h.example:8080", "secret=short", "user = ab"]
    docs = [(k, "".join(rng.choice(parts) + rng.choice([" ", "\n", " é " + "x " * rng.choice([5, 60, 95, 99, 101, 120])]) for _ in range(rng.randint(0, 9)))) for k in range(300)]
    docs += pairs(spark, SMALL)
    found = secrets.find_spans(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", secrets.as_text(F.col("spans")).alias("spans"))
    assert Counter(tuple(r) for r in found.collect()) == Counter((d, brute.op8_spans(t, secrets.KINDS, secrets.SCOPE)) for d, t in docs)


def test_op9(spark):
    rows = {r.doc_id: r for r in Q["op9_licenses"](spark, "/root/testdata/sf0.01").collect()}
    names = {"Apache License, Version 2.0": "apache-2.0", "the MIT License": "mit", "General Public License, version 3": "gpl-3.0", "CC BY-NC 4.0": "cc-by-nc-4.0"}
    for d, text in pairs(spark, "/root/testdata/sf0.01"):
        assert rows[d].licenses == ",".join(sorted({v for k, v in names.items() if k in text})), d


def test_op9_containment(spark):
    text = licenses.TEMPLATES["mit-text"]
    words = text.split()
    cut = " ".join(words[: int(len(words) * 0.9)])
    docs = [(1, "intro " * 333 + text + " outro" * 77), (2, cut), (3, " ".join(words[: len(words) // 2])), (4, None), (5, "license " * 5000), (6, text.upper())]
    rows = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: ["mit-terms", "mit-text"], 2: ["mit-terms", "mit-text"], 3: ["mit-terms"], 4: [], 5: [], 6: ["mit-terms", "mit-text"]}


def test_op9_against_brute_force(spark):
    rng = random.Random(9)
    filler = [w for _, t in pairs(spark, SMALL) if t for w in t.split()][:5000]
    docs = []
    for name, text in licenses.known_templates().items():
        words = text.split()
        for share in (0, 0.05, 0.12, 0.3) if len(words) < 1000 else (0, 0.08, 0.4):
            kept = [w if rng.random() >= share / 5 else rng.choice(filler) for w in words]
            head, tail = rng.randint(0, 900), rng.randint(0, 500)
            docs.append((len(docs), " ".join([*rng.choices(filler, k=head), *kept, *rng.choices(filler, k=tail)])))
    docs += pairs(spark, SMALL)
    found = Counter((r.doc_id, tuple(r.licenses)) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert found == Counter(brute.op9(docs, licenses.known_templates()))


def test_op9_templates_as_a_table(spark):
    own = "this software license lets friends of the house get the software copied and its license terms sent to nobody else"
    table = spark.createDataFrame([("house", own), ("house", own), ("house", own.replace("copied", "sold")), ("none", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "see " + own + " end"), (2, licenses.TEMPLATES["mit-text"]), (3, own.replace("copied", "sold"))], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan(docs, table).collect()} == {1: ["house"], 2: [], 3: ["house (2)"]}
    assert {tuple(r.licenses) for r in licenses.scan(docs, {}).collect()} == {()}
    with pytest.raises(ValueError, match="anchor"):
        licenses.scan(docs, {"x": "one two three four five six"})


def test_op10(spark, folder):
    assert got(spark, "op10_simhash", folder, "doc_id", "fingerprint", "component_id") == Counter(brute.op10(pairs(spark, folder)))


@pytest.mark.parametrize("most", [1, 2, 3])
@pytest.mark.parametrize("hot", [128, 3])
def test_op10_links(spark, most, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(5)
    fps = []
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.append(f)
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(df, most)).collect()}
    mine, expected = {}, {}
    for f, (_, _, c) in zip(fps, brute.linked(list(enumerate(fps)), most)):
        mine.setdefault(root.get(f, f), set()).add(f)
        expected.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("name", list(Q))
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    rows = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    assert got(spark, name, SMALL, *columns) == Counter(rows.fetchall())
