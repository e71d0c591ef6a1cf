"""The operators on documents: brute-force versions, round trips, and odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortlake.llm import bpe, decontamination, host_rules, lm, ngram_join, substring, token_counts, token_files, toxicity
from cohortlake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = [f"w{k}" for k in range(60)] + ["é", "#", "Über", "x.", "don't"]


def words(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join(r.choice(VOCAB) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, shared passages."""
    base, passage = words(120, 1), words(30, 2)
    near = base.split(" ")
    near[60] = "changed"
    return [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (3, " ".join(near), None, "b", None), (4, None, "en", None, 0), (5, "", "en", "b", 0),
            (6, " \n\t ", "de", "b", 4), (7, "one two", "de", "b", 7), (8, "one two", "de", "b", 7), (9, "One  TWO\n", "de", "c", 7), (None, base, "en", "a", 5), (None, "lost words", None, None, None),
            (10, words(40, 3) + " " + passage + " " + words(35, 4), "en", "c", 1), (11, words(33, 5) + "\n" + passage + "\n" + words(21, 6), "fr", "c", 1),
            (12, (passage + " ") * 3, "fr", "c", 1), (13, "x" * 90_000, "en", "d", 90_000), (14, words(30_000, 7), "en", "d", 1), (15, "a a a a a a a a a a a a a a a a a a a a a a a a", "es", "d", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    """The rows, with columns that operators use for their own results."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("ids", "bytes", "spans", "n_words", "n_removed", "score", "predicted", "offending", "n_tokens", "part", "hits", "host", "words"):
        df = df.selectExpr("*", f"'mine' as {name}")
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- 1 ---------------------------------------------------------------------------------------------------------------

def test_pieces_have_the_ids_of_the_whole_text():
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice(["a", "Zé", " ", "  ", "\n", "'s", "'", "9", "42", ".", ",!", "日本", "　", "\x85", "\x1c", "́", "😀", "\t", "don't"]) for _ in range(r.randrange(120)))
        assert "".join(bpe.pieces(text, 7)) == text
        assert [i for p in bpe.pieces(text, 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert list(bpe.pieces("x" * 99, 7)) == ["x" * 99]


def test_op1_is_the_library(spark, documents):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    got = by_id(QUERIES["op1_byte_bpe"](spark, FOLDER))
    assert len(got) == len(documents)
    for d in documents:
        ids = enc.encode_ordinary(d["text"])
        assert got[d["doc_id"]][1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())


def test_op1_odd_rows(odd, none):
    rows = bpe.decode(bpe.encode(odd)).select("doc_id", "text", "ids", "bytes", "part").collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert bytes(r["bytes"]) == (r["text"] or "").encode() and r["part"] == "mine" and (r["ids"] == []) == (not r["text"])
    assert bpe.decode(bpe.encode(none)).collect() == []
    assert bpe.decode(none.selectExpr("doc_id", "cast(null as array<int>) as ids")).collect() == []


# -- 2 ---------------------------------------------------------------------------------------------------------------

def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def component_of(rows):
    """Least reachable id per id, by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in rows]
    where, root = defaultdict(list), {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (d, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, (d, s) in enumerate(sets):
        for j, common in Counter(j for x in s for j in where[x] if j < k).items():
            if 100 * common >= 75 * (len(s) + len(sets[j][1]) - common):
                a, b = find(d), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}


def test_linked_sets_share_a_part():
    r = np.random.default_rng(0)
    for _ in range(400):
        n = int(r.integers(1, 700))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        change = int(r.integers(0, max(1, n // 7) + 1))
        b = np.unique(np.concatenate([a[change:], r.integers(0, 2**63, int(r.integers(0, max(1, n // 9) + 1)), dtype=np.uint64)]))
        if b.size == 0:
            continue
        common = np.intersect1d(a, b).size
        frequent = np.sort(r.choice(ngram_join.parts(a, 1 << (a.size.bit_length() - 1))[1], max(1, a.size // 5)))
        if 100 * common >= 75 * (a.size + b.size - common):
            assert np.intersect1d(ngram_join.first_parts(a, 75, frequent), ngram_join.first_parts(b, 75, frequent)).size
            assert ngram_join.close(a.size, b.size, ngram_join.dense(a, 1 << (a.size.bit_length() - 1)), ngram_join.dense(b, 1 << (b.size.bit_length() - 1)), 75)


def test_op2_one_id_is_one_document(spark):
    """Rows of one id with texts that are copies, or near copies, of different documents link all of them."""
    a, b, c, d = (words(40, k) for k in (21, 22, 23, 24))
    near = a.split(" ")
    near[0] = "changed"
    rows = [(3, a), (4, b), (5, a), (5, b), (6, c), (7, c), (7, " ".join(near)), (8, d), (9, d), (9, None), (10, "")]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()}
    assert got == {(3, 3), (4, 3), (5, 3), (6, 3), (7, 3), (8, 8), (9, 8), (10, 10)}, got


def test_op2_is_the_brute_force_result(spark, documents):
    got = by_id(QUERIES["op2_ngram_join"](spark, FOLDER))
    want = component_of([(d["doc_id"], d["text"]) for d in documents])
    assert {d: (len(shingles(t["text"])), want[d]) for t in documents for d in [t["doc_id"]]} == {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()}


def test_op2_odd_rows_and_chains(spark, odd, none):
    _, found = ngram_join.join(odd)
    rows = found.collect()
    assert len(rows) == len(odd_rows())
    want = component_of([(d, t) for d, t, *_ in odd_rows() if d is not None])
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert ngram_join.join(none)[1].collect() == []
    # a chain of copies, each changed a little more, among texts that share a frequent passage
    text, chain = words(100, 8).split(" "), []
    for k in range(40):
        text = list(text)
        text[(7 * k) % 100] = f"new{k}"
        chain.append((100 - k, " ".join(text)))
    passage = words(60, 9)
    chain += [(200 + k, passage + " " + words(45 if k % 3 else 9, 50 + k)) for k in range(120)]
    _, found = ngram_join.join(spark.createDataFrame(chain, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == component_of(chain)


# -- 3 ---------------------------------------------------------------------------------------------------------------

def removed(rows, window):
    """Kept words per row, one row an id; None for the id is later than all."""
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i:i + window]), (d, i)) != (d, i):
                keep[i:i + window] = [False] * window
        out.append((d, len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep) if k)))
    return out


def test_op3_is_the_brute_force_result(spark, documents):
    got = by_id(QUERIES["op3_substring_dedup"](spark, FOLDER))
    for d, n, gone, kept in removed([(d["doc_id"], d["text"]) for d in documents], 20):
        assert got[d][1:] == (n, gone, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("window", [2, 5, 20])
def test_op3_small_vocabulary(spark, window):
    r = random.Random(window)
    few = [f"v{k}" for k in range(3 if window > 2 else 12)]
    rows = [(k, " ".join(r.choice(few) for _ in range(r.randrange(0, 90)))) for k in range(60)]
    got = by_id(substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window=window))
    for d, n, gone, kept in removed(rows, window):
        assert (got[d]["n_words"], got[d]["n_removed"]) == (n, gone)
        assert b" ".join((got[d]["text"] or "").encode().split()) == kept


def test_op3_odd_rows(odd, none):
    rows = substring.dedup(odd).collect()
    assert len(rows) == len(odd_rows()) and rows[0]["ids"] == "mine"
    single = {d: t for d, t, *_ in odd_rows() if d is not None}
    want = {d: x for d, *x in removed(list(single.items()), 20)}
    for r in rows:
        if r["doc_id"] is not None:
            assert [r["n_words"], r["n_removed"]] == want[r["doc_id"]][:2], r["doc_id"]
            assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert [r["text"] for r in rows if r["doc_id"] in (4, 5, 6)] == [None, "", " \n\t "]
    assert [r["n_removed"] for r in rows if r["doc_id"] is None and r["n_words"] > 9] == [120]
    assert substring.dedup(none).collect() == []


# -- 4 ---------------------------------------------------------------------------------------------------------------

def test_op4_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = QUERIES["op4_toxicity"](spark, folder).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    cells = Counter((labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels)
    assert cells[0, 1] <= 0.01 * (cells[0, 0] + cells[0, 1])
    assert cells[1, 1] >= 0.8 * (cells[1, 0] + cells[1, 1])


def test_op4_locates_sentences_and_takes_odd_rows(spark, odd, none):
    texts = [(k, f"{words(9, k)}. {words(7, 99 - k)}{' vile' if k % 3 == 0 else ''} thing.\nAnd {words(5, 7 * k)}", int(k % 3 == 0)) for k in range(300)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(rows)
    got = by_id(toxicity.score(rows, model))
    assert all(got[k]["predicted"] == y for k, _, y in texts)
    assert all(["vile" in s["text"] for s in got[k]["offending"]] == [True] for k, _, y in texts if y)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in scored) and scored[0]["ids"] == "mine"
    assert toxicity.score(none, model).collect() == []
    # no labels: nothing is toxic; contradicting labels count as toxic; labels of other folds alone are read
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.held_out(odd, labels).collect()} == {0}
    labels = spark.createDataFrame([(k, int(k == 2)) for k in range(40)] + [(3, 0), (3, 1)], "doc_id long, toxic int")
    used = toxicity.training_rows(odd, labels).collect()
    assert {r["doc_id"] for r in used} == {d for d in range(1, 16) if zlib.crc32(str(d).encode()) % 5}
    assert {r["toxic"] for r in used if r["doc_id"] in (2, 3)} <= {1}


# -- 5 ---------------------------------------------------------------------------------------------------------------

def test_op5_finds_what_comparing_all_finds(spark, documents):
    items = [(r["item_id"], decontamination.words(r["text"].encode())) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    want = set()
    for d in documents:
        h = decontamination.words(d["text"].encode())
        for i, item in items:
            most = int(decontamination.RATE * item.size)
            if np.isin(item, h).sum() >= item.size - most and decontamination.distance(item, h)[0] <= most:
                want.add((d["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontamination"](spark, FOLDER).collect()}
    assert got == want


def test_op5_recall_under_edits_and_distances():
    r = np.random.default_rng(3)
    assert decontamination.distance(np.array([1, 2, 3, 4]), np.array([9, 1, 3, 4, 9]))[0] == 1
    found = {0.1: 0, 0.2: 0}
    items = [(k, r.integers(1, 400, int(r.integers(15, 100))).astype(np.uint64) * np.uint64(7919)) for k in range(60)]
    index = decontamination.Index(items)
    for k, item in items:
        for rate in found:
            edited = item.tolist()
            for at in r.choice(item.size, int(rate * item.size), replace=False):
                edited[at] = int(r.integers(1 << 60))
            pad = r.integers(1 << 60, size=50).astype(np.uint64)
            h = np.concatenate([pad, np.array(edited, np.uint64), pad])
            hits = index.candidates(np.concatenate([h, np.zeros(2 * decontamination.SEGMENT + 1, np.uint64)]), h.size)
            found[rate] += any(x[0] == k for x in decontamination.leaks(h, hits, items, 0.2))
    assert found[0.1] >= 0.97 * len(items) and found[0.2] >= 0.9 * len(items)


def test_op5_odd_rows(spark, odd, none):
    passage = words(30, 2)
    items = spark.createDataFrame([(1, passage), (2, passage.upper()), (3, None), (4, ""), (None, passage), (5, "one two")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(odd, items, at_once=30).collect()}
    assert got == {(d, i) for d in (10, 11, 12) for i in (1, 2)} | {(d, 5) for d in (7, 8, 9)}
    kept = decontamination.clean(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 6, 13, 14, 15}
    assert kept.count() == len(odd_rows()) - 6
    assert decontamination.contamination(none, items).collect() == [] and decontamination.contamination(odd, items.limit(0)).collect() == []


# -- 7 ---------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing_and_random_access(tmp_path, bits):
    r = np.random.default_rng(bits)
    docs = [r.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 1, 7, 5000, 0, 4096, 9000)]
    with open(tmp_path / "f", "wb") as f:
        w = token_files.Writer(f, bits)
        for k, d in enumerate(docs):
            w.add([None if k == 1 else k], [d.size], d)
        w.close()
    with open(tmp_path / "f", "rb") as f:
        reader, whole = token_files.Reader(f), np.concatenate(docs)
        assert reader.bits == bits and reader.doc_ids == [0, None, 2, 3, 4, 5, 6]
        assert [ids.tolist() for _, _, ids in reader.documents(100)] == [d.tolist() for d in docs]
        for a, b in r.integers(0, whole.size + 1, (50, 2)):
            assert reader.read(min(a, b), max(a, b)).tolist() == whole[min(a, b):max(a, b)].tolist()
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits], np.uint64), bits) if bits < 32 else token_files.pack(np.array([1 << 33], np.uint64), bits)


def test_op7_is_the_library(spark, documents):
    tokenizer = token_files.encoder(public_tokenizers.path(token_files.TOKENIZER)).tokenizer
    got, at = by_id(QUERIES["op7_token_files"](spark, FOLDER)), 0
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids + [0]
        assert got[d["doc_id"]][1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op7_units_and_odd_rows(odd, none):
    enc = token_files.encoder(public_tokenizers.path(token_files.TOKENIZER))
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "Zé", " ", "  ", "\n", "'s", "9", ".", "日", "　", "\x85", "\x1c", "😀", "\t", "<|endoftext|>", "the"]) for _ in range(r.randrange(40))) for _ in range(400)]
    sizes, ids = enc.encode(texts)
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert sizes == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    manifest = token_files.write(odd)
    rows = token_files.read(manifest, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 2, *range(3, 16)]
    assert [r["ids"] for r in rows if r["doc_id"] in (4, 5)] == [[0], [0]]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
    assert {r["bits"] for r in manifest.collect()} == {16}
    assert token_files.read(token_files.write(none)).collect() == []


# -- 8 ---------------------------------------------------------------------------------------------------------------

def test_op8_is_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    df = QUERIES["op8_host_rules"](spark, FOLDER)
    rel = con.sql(ORACLES["op8_host_rules"])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    assert sorted(map(tuple, df.select(*order).collect())) == sorted(rel.select(*order).fetchall())


def test_op8_hosts_and_odd_rows(spark, odd, none):
    good, bad = words(60, 1), "short"
    rows = [(k, good, f"ok{k % 8}") for k in range(80)] + [(100 + k, bad if k < 19 else good, "spam") for k in range(20)] + [(200, bad, "tiny"), (201, good, None), (202, bad, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(host_rules.judge(df))
    assert all(got[k]["kept"] for k in range(80)) and not got[119]["kept"] and got[119]["host_failed"] and not got[119]["base_failed"]
    assert got[201]["kept"] and not got[202]["kept"]
    # one failure of one document is pulled towards the other hosts' rates
    rates = {r["host"]: r["host_rate"] for r in host_rules.host_verdicts(host_rules.base_rules(host_rules.measures(df))).collect()}
    assert 0.95 < rates["spam"] + 0.05 and rates["tiny"] < 1 and 0 < rates["ok0"] < 0.1
    rows = host_rules.judge(odd).collect()
    assert len(rows) == len(odd_rows())
    figures = {r["doc_id"]: r for r in rows}
    assert (figures[4]["n_words"], figures[6]["n_words"], figures[4]["base_failed"]) == (0, 0, True)
    assert (figures[15]["n_words"], figures[15]["n_repeat_words"]) == (24, 24) and figures[12]["n_repeat_words"] == 90
    assert host_rules.judge(none).collect() == []


# -- 9 ---------------------------------------------------------------------------------------------------------------

def test_op9_is_the_library(spark, documents):
    from tokenizers import models
    pieces, _ = token_counts.pieces_of(public_tokenizers.path(token_counts.MODEL))
    bytes_ = [(f"<0x{b:02X}>", -2e9) for b in range(256)]
    low = min(s for _, s in pieces)
    # byte pieces are never matched as text; they must not lower the least score
    library = models.Unigram([("\x00unknown\x00", 0.0), *[(p, low) for p, _ in bytes_], *pieces], unk_id=0, byte_fallback=True)
    got = by_id(QUERIES["op9_token_counts"](spark, FOLDER))
    for d in documents[:60]:
        assert got[d["doc_id"]]["n_tokens"] == len(library.tokenize(token_counts.MARK + d["text"].replace(" ", token_counts.MARK)))
    counter = token_counts.counter(public_tokenizers.path(token_counts.MODEL))
    for t in ("a", " a", "  a  b ", "日本語\n\n x é ñ", "▁a▁▁b", "aaaa aaaaaa", "\x00\x01z", "😀😀 q"):
        assert counter.of_text(t) == len(library.tokenize(token_counts.MARK + t.replace(" ", token_counts.MARK))), t


def test_op9_ties_take_the_earliest_start(odd, none):
    # ab + c and a + bc are worth the same: the last piece that starts first wins
    own = token_counts.Counter([("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), (token_counts.MARK, 0.0)], False)
    from tokenizers import models
    library = models.Unigram([("?", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), (token_counts.MARK, 0.0)], unk_id=0)
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice("abcab xy") for _ in range(r.randrange(1, 14)))
        assert own.of_text(t) == len(library.tokenize(token_counts.MARK + t.replace(" ", token_counts.MARK))), t
    rows = token_counts.count_tokens(odd).collect()
    assert len(rows) == len(odd_rows()) and {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)} == {0} and rows[0]["ids"] == "mine"
    assert token_counts.count_tokens(none).collect() == []


# -- 10 --------------------------------------------------------------------------------------------------------------

def base_figures(rows):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    bags = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    c = Counter(w for d, b in bags if not held(d) for w in b)
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(b), sum(c[w] > 0 for w in b), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in b)) for d, b in bags]


def test_op10_base_and_better_than_base(spark, documents, monkeypatch):
    got = by_id(QUERIES["op10_lm_scoring"](spark, FOLDER))
    for d, held, n, known, total, base in base_figures([(d["doc_id"], d["text"]) for d in documents]):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total) and r["base_score"] == pytest.approx(base)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op10_words_beyond_the_frequent_ones_and_odd_rows(odd, none, monkeypatch):
    want = sorted((repr(r[0]), *r[1:5], round(r[5], 6)) for r in base_figures([(d, t) for d, t, *_ in odd_rows()]))
    for frequent in (5, 1 << 17):
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        rows = lm.score(odd).collect()
        assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
        assert all(r["score"] < 0 for r in rows)
    assert lm.score(none).collect() == []


def test_op10_gradients_lanes_and_normalisation():
    from cohortlake.llm.gru import START, Gru
    r, size = np.random.default_rng(1), 23
    g = Gru(size, 4, 5)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    t, y = r.integers(0, size, (6, 3)), r.integers(0, size, (6, 3))
    t[0] = START
    t[3, 1] = START

    def loss():
        s, _ = g.forward(t, t == START, np.zeros((3, 4)))
        return -g.log_probs(s.reshape(-1, 4), y.ravel()).mean()
    keep, grads = [], {}
    s, _ = g.forward(t, t == START, np.zeros((3, 4)), keep)
    g.log_probs(s.reshape(-1, 4), y.ravel(), grads)
    g.backward(t, t == START, keep, grads.pop("states").reshape(s.shape), grads)
    full = {k: np.zeros_like(v) for k, v in g.p.items()} | {k: grads[k] for k in ("u", "b", "c")}
    full["x"][grads["x"][0]] = grads["x"][1]
    for k, v in grads["o"].items():
        full["o"][k] = v
    for name, v in g.p.items():
        flat = v.ravel()
        for i in r.choice(flat.size, 12, replace=False):
            if abs(flat[i]) < 1e8:
                old, step = flat[i], 1e-3
                flat[i] = old + step
                up = loss()
                flat[i] = old - step
                down = loss()
                flat[i] = old
                assert (up - down) / (2 * step) == pytest.approx(full[name].ravel()[i], abs=3e-4), name
    g = Gru(size, 4, 5)
    docs = [r.integers(0, size, n) for n in (1, 5, 200, 33, 2, 70)]
    assert g.score(docs) == pytest.approx([g.score([d])[0] for d in docs], abs=1e-4)
    assert sum(np.exp(g.score([np.array([3, k])])[0] - g.score([np.array([3])])[0]) for k in range(size)) == pytest.approx(1, abs=1e-4)
