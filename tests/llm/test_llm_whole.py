"""Nothing is left out: leaks wherever their edits lie, segments of whole items."""

import numpy as np
import pytest

from cohortlake.llm import decontamination, gru, lm, substring


def edited(item: np.ndarray, where: str, kind: str, r) -> np.ndarray:
    """The item with all allowed edits at one place, or anywhere."""
    n, k = item.size, int(decontamination.RATE * item.size)
    first = {"start": 0, "middle": (n - k) // 2, "end": n - k}
    at = r.choice(n, k, replace=False) if where == "any" else first[where] + np.arange(k)
    if kind == "delete":
        return np.delete(item, at)
    new = r.integers(1 << 60, size=k).astype(np.uint64)
    if kind == "insert":
        return np.insert(item, at, new)
    out = item.copy()
    out[at] = new
    return out


@pytest.mark.parametrize("where", ["start", "middle", "end", "any"])
def test_op5_recall_wherever_the_edits_lie(where):
    r = np.random.default_rng(7)
    for n in (5, 8, 15, 16, 30, 31, 50, 59, 63, 95):
        items = [(k, r.integers(1, 1 << 60, n).astype(np.uint64)) for k in range(60)]
        index = decontamination.Index(items)
        for kind in ("delete", "replace", "insert"):
            found = 0
            for k, item in items:
                pad = r.integers(1 << 60, size=int(r.integers(20, 60))).astype(np.uint64)
                h = np.concatenate([pad, edited(item, where, kind, r), pad])
                hits = index.candidates(np.concatenate([h, np.zeros(2 * decontamination.SEGMENT + 1, np.uint64)]), h.size)
                found += any(x[0] == k for x in decontamination.leaks(h, hits, items, decontamination.RATE))
            assert found >= 0.9 * len(items), (n, kind, found)


def test_op5_segments_cover_items():
    """Every word of an item lies in an indexed segment, and edits may fill any one of them."""
    r = np.random.default_rng(11)
    for n in [*range(1, 40), 63, 64, 95, 127, 200]:
        item = r.integers(1, 1 << 60, n).astype(np.uint64)
        index = decontamination.Index([(1, item)])
        (low, own), = index.segments.items()
        assert {at + j for _, at in own.tolist() for j in range(low)} == set(range(n))
        # a document with this part of the item alone, at any place
        for at in {0, (n - low) // 2, n - low}:
            for before in range(decontamination.stride(low)):
                part = item[at:at + 2 * low - 1] if n >= 7 else item[at:at + low]
                h = np.concatenate([np.full(before, 5, np.uint64), part])
                index.most[:] = n  # the filter by number of words is not what is looked at here
                if part.size >= min(n, low + decontamination.stride(low) - 1):
                    assert len(index.candidates(np.concatenate([h, np.zeros(2 * decontamination.SEGMENT + 1, np.uint64)]), h.size)), (n, at, before)


def test_op3_rows_without_an_id_lose_only_their_own_words(spark):
    r = np.random.default_rng(5)
    def text(n):
        return " ".join(f"w{k}" for k in r.integers(1 << 40, size=n))
    known, shared = text(120), text(40)
    rows = [(1, known), (None, known + " " + text(80)), (None, text(200)), (None, text(200)), (None, known + " " + text(50)),
            (7, shared + " " + text(100)), (7, text(140)), (9, text(30) + " " + shared), (9, text(70)), (9, text(70))]
    # the first two rows without an id hold the known text in one place, and so do equal rows
    rows.append(rows[1])
    want = [0, 120, 0, 0, 120, 0, 0, 40, 0, 0, 120]
    for parts in (1, 4):
        frame = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, k int").repartition(parts, "k")
        got = {x["k"]: (x["n_removed"], x["text"]) for x in substring.dedup(frame).collect()}
        assert [got[k][0] for k in range(len(rows))] == want
        assert all(got[k][1] == rows[k][1] for k, n in enumerate(want) if not n)


def test_op10_frequent_words_have_rows_of_their_own():
    words = lm.Vocabulary([b"w%d" % k for k in range(10000)], np.arange(10000, 0, -1), 10, 50005010, 10001)
    assert words.ids(np.array([0, 5000, 8189])).tolist() == [2, 5002, 8191] and words.ids(np.array([8190, -1])).tolist() == [gru.OTHER] * 2
    model = gru.Gru(words.size)
    assert model.p["x"].shape == (8193, 96) and model.hidden == 32


def test_op10_trains_on_every_token():
    # 515 tokens in four lanes: the last three were left out
    docs = [np.array([2] * 511 + [gru.END]), np.array([3, 4, gru.END])]
    model = gru.Gru(6, hidden=4, group=3)
    start = model.of(model.flat())
    assert model.train(docs, 0.1, {}) == 515
    assert (model.p["x"][[3, 4]] != start.p["x"][[3, 4]]).any(axis=1).all()


@pytest.mark.parametrize("size", [0, 1, 7, 511, 512, 5000])
def test_op3_blocks_are_read_as_they_were_packed(size):
    rng = np.random.default_rng(size)
    keys = np.sort(np.concatenate([rng.integers(0, 1 << substring.KEY_BITS, size), [0, (1 << substring.KEY_BITS) - 1] * (size > 0)]).astype(np.uint64))
    assert (substring.sorted_numbers(substring.sorted_bytes(keys), keys.size) == keys).all()
    for most in (1 << 20, 1 << 26):
        places = rng.integers(0, most, size)
        assert (substring.place_numbers(substring.place_bytes(places), size) == places).all()
