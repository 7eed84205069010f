import numpy as np
import pyarrow as pa
import pytest

from weftload.llm import decontaminate as d

ITEMS = "item_id long, question string, answer string"


def plain(text):
    words = [w.strip(".,;:!?\"'()[]{}|*#&%$<>-_") for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()]
    return [w for w in words if w]


def test_search_is_whole():
    """Against scores of every unit without any bound."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    rows = [type("R", (), {"item_id": i, "question": " ".join(rng.choice(vocab, rng.integers(6, 150))), "answer": None}) for i in range(90)]
    df = {}
    units = []
    for r in rows:
        ws = r.question.split()
        units += [set(ws[a : a + d.UNIT]) for a in range(0, len(ws), d.UNIT)]
    for u in units:
        for w in u:
            df[w] = df.get(w, 0) + 1
    index = d.Index(rows, df, len(units), 40.0)
    full = np.zeros((index.blocks * d.BLOCK, len(index.place)))
    for e in range(len(index.key)):
        at = slice(index.from_[e], index.from_[e] + index.size[e])
        full[index.unit[at], index.key[e] // index.blocks] = index.share[at]
    pairs = [(p, t) for p in range(40) for t in rng.choice(len(index.place), 25, replace=False)]
    pairs = np.unique(np.array(pairs), axis=0)
    p, u, s = index.search(pairs[:, 0], pairs[:, 1], 0.45)
    wanted = {}
    for q in range(40):
        score = full[:, pairs[pairs[:, 0] == q, 1]].sum(1)
        wanted |= {(q, k): score[k] for k in np.flatnonzero(score >= 0.45)}
    assert wanted and {(a, b) for a, b in zip(p.tolist(), u.tolist())} == set(wanted)
    assert all(wanted[a, b] == pytest.approx(c) for a, b, c in zip(p.tolist(), u.tolist(), s.tolist()))


def test_search_in_steps_is_whole(monkeypatch):
    """Steps of any size find the same, and none looks up more than it may, however many passages ask at once."""
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(40)]
    rows = [type("R", (), {"item_id": i, "question": " ".join(rng.choice(vocab, 50)), "answer": None}) for i in range(200)]
    df = {}
    for r in rows:
        for w in set(r.question.split()):
            df[w] = df.get(w, 0) + 1
    index = d.Index(rows, df, len(rows), 50.0)
    pairs = np.array([(p, t) for p in range(300) for t in np.sort(rng.choice(len(index.place), 25, replace=False))])
    whole = index.search(pairs[:, 0], pairs[:, 1], 0.6)
    assert len(whole[0]) and index.search(pairs[:0, 0], pairs[:0, 1], 0.6)[0].size == 0
    asked, ranges = [], d.ranges

    def watched(starts, lengths):
        asked.append(int(lengths.sum()))
        return ranges(starts, lengths)

    monkeypatch.setattr(d, "ranges", watched)
    for most in (5000, 700, 1):
        monkeypatch.setattr(d, "AT_ONCE", most)
        asked.clear()
        for a, b in zip(whole, index.search(pairs[:, 0], pairs[:, 1], 0.6)):
            np.testing.assert_array_equal(a, b)
        assert max(asked) <= d.BLOCK * max(most, 25 * index.blocks)  # an entry has BLOCK units at most


def test_a_slice_of_texts_is_bounded(monkeypatch):
    """A task's batch is searched in slices of about a megabyte."""
    texts = pa.array([f"{'word ' * 2000}{i}" for i in range(800)])
    sizes = []

    class Docs:
        def mapInArrow(self, run, schema):
            return list(run(iter([pa.record_batch([pa.array(range(len(texts))), texts], ["doc_id", "text"])])))

    monkeypatch.setattr(d, "search_slice", lambda index, some, *limits: sizes.append((len(some), some.nbytes)) or [])
    d.scan(Docs(), type("Shared", (), {"value": None}), 0.5, 0.5)
    assert sum(n for n, _ in sizes) == len(texts) and max(b for _, b in sizes) <= (1 << 20) + 20_000


def test_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = d.leaks(docs, bench.select("item_id", *d.question_answer()))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    items = [(b.item_id, plain(b.text)) for b in bench.collect()]
    wanted = set()
    for doc in docs.collect():
        text = " " + " ".join(plain(doc.text)) + " "
        wanted |= {(doc.doc_id, i) for i, w in items if " " + " ".join(w) + " " in text}
    assert wanted and wanted <= got
    extra = got - wanted  # nothing without most of an item's sequences
    assert len(extra) <= 2


QUESTION = "which river of the northern plain carries the most water in the spring of a wet year"


def test_question_and_answer(spark, documents):
    items = spark.createDataFrame([(7, QUESTION, "the long blue river"), (8, QUESTION, None), (9, None, None), (10, "", ""), (None, "too short", None), (11, None, f"{QUESTION} only answer")], ITEMS)
    filler = " ".join(f"filler{i}" for i in range(300))
    texts = [f"{filler} {QUESTION} the long blue river {filler}", f"{filler} {QUESTION} {filler}", filler, None, "", QUESTION.upper(), "which river " * 4000]
    got = {(r.doc_id, r.item_id) for r in d.leaks(documents(texts, clash=True), items).collect()}
    assert {(0, 7), (0, 8), (1, 8), (5, 8)} <= got
    assert not {g for g in got if g[0] in (2, 3, 4, 6)} and (1, 7) not in got and (5, 7) not in got


def test_every_place_and_shard(spark, documents):
    items = spark.createDataFrame([(i, " ".join(f"q{i}x{k}" for k in range(70)), f"a{i} b{i}") for i in range(8)], ITEMS)
    texts = []
    for i in range(8):
        for shift in (0, 31, 63, 64, 65, 100):
            texts.append(" ".join([*[f"f{k}" for k in range(shift)], *[f"q{i}x{k}" for k in range(70)], f"a{i}", f"b{i}", "tail"]))
    docs = documents(texts)
    for most in (10**6, 150):
        rows = d.leaks(docs, items, shard_words=most).collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(n, n // 6) for n in range(48)]
        assert all(r.score > 0.9 for r in rows)


def test_short_items_and_far_answers(spark, documents):
    """Short items stand word for word; an answer may stand far from its question."""
    items = spark.createDataFrame([(1, "capital of France?", "Paris"), (2, "Paris", None), (3, QUESTION, "the long blue river"), (4, None, "forty two")], ITEMS)
    far = " ".join(f"f{i}" for i in range(400))
    texts = ["The capital of France? Paris.", "France has a capital, of course: paris", f"{QUESTION} {far} the long blue river", f"{far} {QUESTION}", "two forty", "Forty, two!"]
    got = {(r.doc_id, r.item_id) for r in d.leaks(documents(texts), items).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (2, 3), (5, 4)}


def test_scores_do_not_depend_on_the_number_of_indexes(spark, documents):
    words = ["É", "é", "ÀB", "straße", "x\xa0y", "(z)", "一", "Ω"]
    items = spark.createDataFrame([(i, " ".join(f"{words[(i + k) % 8]}{k % 5}" for k in range(30)), f"{words[i]} end") for i in range(8)], ITEMS)
    texts = [f"lead {r.question} {r.answer} tail" for r in items.collect()] + ["É é ÀB straße"]
    rows = [sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in d.leaks(documents(texts), items, shard_words=most).collect()) for most in (10**6, 90)]
    assert rows[0] == rows[1] and {(i, i) for i in range(8)} <= {r[:2] for r in rows[0]}


def test_empty_and_repeated(spark, documents):
    items = spark.createDataFrame([(1, QUESTION, None), (1, QUESTION, None)], ITEMS)
    assert d.leaks(documents([]), items).collect() == []
    assert d.leaks(documents([QUESTION]), items.limit(0)).collect() == []
    rows = d.leaks(documents([(4, QUESTION), (4, QUESTION), (None, QUESTION)]), items).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "4", "None"]


def test_plain_items(spark):
    df = spark.createDataFrame([("Is it so? Yes.",), ("one sentence",), (None,)], "text string")
    rows = df.select(*d.question_answer()).collect()
    assert [tuple(r) for r in rows] == [("Is it so?", "Yes."), ("one sentence", None), (None, None)]
