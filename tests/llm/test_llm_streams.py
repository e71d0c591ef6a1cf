"""Periodic runs, packing and source divergence: brute-force versions, the library's ids, SQL, and odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortlake.llm import divergence, packing, runs, token_files
from cohortlake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def some_words(n, seed, vocabulary=60):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, periodic texts."""
    base = " ".join(some_words(120, 1))
    return [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (2, "another", "en", "b", 5), (3, None, None, None, None), (None, base, "en", "a", 5),
            (None, "lost words.", None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "de", "b", 4), (6, "x" * 90_000, "en", "d", 1), (7, "a " * 5000, "en", "d", 1),
            (8, " ".join(some_words(30_000, 2, 30_000)), "en", "d", 1), (9, "  One.\n\nTwo!  \"Yes.\" é　ü, Über 日本。 ", "fr", "c", 1), (10, "x y z " * 9 + "x y", "fr", "c", 1),
            *[(20 + k, f"Tea tea {'cup ' * k}ÉÉ über-all it's pot{k % 2}", "nl", f"s{k % 3}", 1) for k in range(24)], (90, "12 34 --", "nl", "digits", 1), (91, "rare", "sv", "p", 1), (92, "", "sv", "q", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    """The rows, with columns that operators use for their own results, one with a dot in its name, and a map."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("row", "runs", "collapsed", "n_words", "start", "length", "ids", "offset", "sequence_id", "term", "n", "documents", "value", "item", "part", "rank", "`a.b`"):
        df = df.selectExpr("*", f"'mine' as {name}")
    return df.selectExpr("*", "map('k', 1) as pairs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 11 --------------------------------------------------------------------------------------------------------------

def runs_by_period(words, exponent=4, least=6):
    """Each period in turn: stretches of words that equal the word one period on."""
    found, n = {}, len(words)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, exponent * p):
                found.setdefault((start, i + p - start), p)
    return sorted((s, size, p) for (s, size), p in found.items())


def planted(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_are_those_of_all_periods(monkeypatch):
    r = random.Random(1)
    for known in (64, 3):
        monkeypatch.setattr(runs, "KNOWN", known)
        for _ in range(150):
            monkeypatch.setattr(runs, "PIECE", r.choice([1, 3, 17, 1 << 16]))
            docs = []
            for _ in range(r.randrange(1, 5)):
                w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(0, 60))]
                unit = [r.randrange(2) for _ in range(r.randrange(1, 9))]
                docs.append(w[:10] + (unit * 40)[:r.randrange(0, 90)] * r.randrange(0, 3) + w[10:])
            exponent, least = r.choice([2, 3, 4]), r.choice([2, 6])
            got = runs.runs_of([np.array(w, np.int64) for w in docs], exponent, least)
            assert [list(map(tuple, g.tolist())) for g in got] == [runs_by_period(w, exponent, least) for w in docs]


def test_squares_are_reported_as_they_end():
    words = np.array([5, 1, 2, 1, 2, 1, 7, 7], np.int64)
    catcher, seen = runs.Catcher(4), []
    for i, w in enumerate(words):
        seen += [(i, *s) for s in catcher.append(np.array([w])).tolist()]
    assert seen == [(4, 1, 5, 2), (5, 1, 6, 2), (5, 2, 6, 2), (7, 6, 8, 1)]


def digest_of_runs(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    found = runs_by_period(words)
    drop = {i for s, size, p in found for i in range(s + p, s + size)}
    s, size, p = next(iter(sorted(found, key=lambda x: (-x[1], x[0], x[2]))), (None,) * 3)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return len(found), s, size, p, 1000 * size // p if p else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_op11_is_the_brute_force_result(spark):
    documents = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    documents = [d for d in documents if len(d["text"].split()) < 2500]
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    assert sum(1 for x in got.values() if x[0]) > 5
    for d in documents:
        assert got[d["doc_id"]] == digest_of_runs(d["doc_id"], d["text"]), d["doc_id"]


def test_op11_odd_rows(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows() if r[1] is None or len(r[1].split()) < 9000]
    got = Counter(tuple(r) for r in runs.digests(odd).collect())
    assert sum(got.values()) == len(odd_rows())
    assert not Counter((d, *digest_of_runs(d, t)) for d, t in rows) - got
    found = runs.find(odd, keep=["doc_id", "a.b", "runs", "pairs"]).where("doc_id = 10").collect()
    assert found[0][:4] == (10, "mine", "mine", {"k": 1}) and found[0]["collapsed"] == "x y z" and [tuple(x) for x in found[0][5]] == [(0, 29, 3)]
    assert runs.digests(none).collect() == []


# -- 12 --------------------------------------------------------------------------------------------------------------

def least_cost(cuts, penalties, width):
    best = {0: 0}
    for j, penalty in zip(cuts, penalties):
        best[j] = penalty + min(best[i] + packing.padding(j - i, width) for i in best if 0 < j - i <= width)
    return best[cuts[-1]]


def test_windows_cost_the_least():
    r = random.Random(2)
    for _ in range(300):
        width, cuts, j = r.choice([16, 64]), [], 0
        for _ in range(r.randrange(1, 200)):
            j += r.randrange(1, r.choice([3, width // 2, width]) + 1)
            cuts.append(j)
        penalties = [r.choice([0, 2, 24]) for _ in cuts]
        windows, ends, i = packing.Windows(width), [], 0
        while i < len(cuts):
            k = i + r.randrange(1, 60)
            windows.add(cuts[i:k], penalties[i:k])
            ends, i = ends + windows.settled(), k
        ends += windows.rest()
        of = dict(zip(cuts, penalties))
        sizes = np.diff(ends, prepend=0)
        assert ends[-1] == cuts[-1] and 0 < sizes.min() and sizes.max() <= width
        assert sum(packing.padding(int(n), width) for n in sizes) + sum(of[e] for e in ends) == least_cost(cuts, penalties, width)


def check_pieces(rows, texts):
    """Every id once, gapless offsets, checksums of the library's ids, documents in order."""
    tokenizer = token_files.encoder(public_tokenizers.path(token_files.TOKENIZER)).tokenizer
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    of, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(of) == set(ids)
    for d, pieces in of.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[d][at:at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[d]), zlib.crc32(part.tobytes())) and r["length"] > 0
            at += r["length"]
        assert at == len(ids[d])
    order = []
    for s in sorted(windows):
        at = 0
        for r in sorted(windows[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            order.append((-1 if r["doc_id"] is None else r["doc_id"], r["start"]))
        assert at <= packing.WIDTH
    assert order == sorted(order)
    return {s: sum(r["length"] for r in w) for s, w in windows.items()}


def test_op12_on_documents(spark):
    documents = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    sizes = check_pieces(QUERIES["op12_packing"](spark, FOLDER).collect(), {d["doc_id"]: d["text"] for d in documents})
    assert sum(packing.padding(n) for n in sizes.values()) < 0.03 * sum(sizes.values())


def test_op12_odd_rows(odd, none):
    distinct = {r[0]: r[1] for r in odd_rows() if r[0] not in (None, 2)}
    check_pieces(packing.digests(odd.where("doc_id != 2")).collect(), distinct)
    rows = packing.digests(odd).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == sum(r["doc_tokens"] for r in rows if r["doc_id"] == 2 and r["start"] == 0)
    assert sum(1 for r in rows if r["doc_id"] is None and r["start"] == 0) == 2 and sum(1 for r in rows if r["doc_id"] == 2 and r["start"] == 0) == 3
    assert packing.digests(none).collect() == []


def test_final_windows_leave_memory(monkeypatch):
    """Tokens of final windows are freed, and the windows are those found without settling."""
    r = np.random.default_rng(0)
    stream, whole, rows, most = packing.Stream(64), packing.Stream(64), [], 0
    for k in range(300):
        sizes = r.integers(1, 200, 3)
        stops = np.unique(np.concatenate([np.cumsum(sizes), r.integers(1, sizes.sum(), 30)]))
        given = [3 * k, 3 * k + 1, 3 * k + 2], sizes, np.arange(sizes.sum(), dtype=np.uint32), stops
        stream.add(*given)
        whole.add(*given)
        rows += stream.pieces()
        most = max(most, stream.end - stream.done)
    assert rows + stream.pieces(True) == whole.pieces(True) and most < 5000


def test_texts_are_cut_where_sentences_end():
    enc = token_files.encoder(public_tokenizers.path(token_files.TOKENIZER))
    text = "One two. Three \"four.\" Five\nsix (seven!) eight"
    sizes, ids, stops = enc.coded(pa.array([text]))
    parts = [enc.tokenizer.decode(x.tolist()) for x in np.split(ids[:-1], stops[:-1])]
    assert parts == ["One two.", " Three \"four.\"", " Five\n", "six (seven!)", " eight"] and stops[-1] == sizes[0]


# -- 13 --------------------------------------------------------------------------------------------------------------

def test_radix_order_is_a_stable_sort():
    r = np.random.default_rng(0)
    high, low = (r.integers(0, 2**63, 3000, dtype=np.uint64) >> np.uint64(k) for k in (58, 3))
    low[::3] = low[0]
    assert np.array_equal(divergence.radix_order([low, high]), np.lexsort((low, high)))


def test_terms_of_every_length_are_counted():
    r = random.Random(4)
    vocabulary = ["a" * n for n in (1, 7, 8, 9, 15, 16, 17, 40)] + ["b" * 8 + "c", "b" * 8 + "d", "é" * 4, "é" * 8 + "x", "é" * 9, "日本", "z" * 5000]
    texts = [" 1".join(r.choice(vocabulary) for _ in range(r.randrange(0, 30))).encode() for _ in range(50)]
    group = np.sort(np.random.default_rng(1).integers(0, 4, 50))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(8, np.uint8)])
    terms, g, n, d = divergence.counted(data, offsets, group)
    want, docs = Counter(), Counter()
    for k, t in zip(group.tolist(), texts):
        ws = [w.lstrip(b"1") for w in t.split()]
        want.update((w, k) for w in ws)
        docs.update((w, k) for w in set(ws))
    assert {(t, k): (a, b) for t, k, a, b in zip(terms.to_pylist(), g.tolist(), n.tolist(), d.tolist())} == {x: (want[x], docs[x]) for x in want}


def audit_sql(rows, names):
    con = duckdb.connect()
    con.register("given", pa.table({c: pa.array(v) for c, v in zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*rows)))}))
    con.sql("create view documents as select * from given")
    return sorted(con.sql(f"select {', '.join(names)} from ({ORACLES['op13_source_divergence']})").fetchall())


def test_op13_odd_rows(odd, none, monkeypatch):
    for block in (2048, 2):  # all terms in one block, and in many
        monkeypatch.setattr(divergence, "BLOCK", block)
        found = divergence.audit(odd)
        assert sorted(map(tuple, found.collect())) == audit_sql(odd_rows(), found.columns)
    assert divergence.audit(none).collect() == []


def test_op13_is_its_sql(spark):
    found = QUERIES["op13_source_divergence"](spark, FOLDER)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"select {', '.join(found.columns)} from ({ORACLES['op13_source_divergence']})").fetchall())


def test_large_counts_stay_exact(spark):
    rows = spark.sql("select 9000000000000000L as n, 9000000000000123L as total, 1000L as v").select(divergence.share("n", "total", "v").alias("p"))
    assert rows.first()["p"] == 1 + 10**9 * (9000000000000000 + 2) // (9000000000000123 + 2 * 1000)
