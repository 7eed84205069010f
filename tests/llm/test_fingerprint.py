import hashlib

from pyspark.sql import functions as F

from weftload.llm import fingerprint as fp


def edits(pairs):
    """n_chars and digest of the edited text for each id."""
    texts = {}
    for i, t in pairs:
        key = fp.SMALLEST if i is None else i
        texts[key] = min(texts.get(key, t or ""), t or "")
    ids = sorted(texts)
    out = {}
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        q = len(texts[i]) // 4
        new = texts[i][: len(texts[i]) - q] + texts[nxt][:q]
        out[None if i == fp.SMALLEST else i] = (len(texts[i]), hashlib.sha256(new.encode()).hexdigest())
    return out


def verify(df, pairs):
    rows = fp.fingerprints(df).collect()
    wanted = edits(pairs)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == wanted and len(rows) == len(wanted)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    return {r.doc_id: r for r in rows}


def test_documents(sample):
    rows = verify(sample, [(d.doc_id, d.text) for d in sample.collect()])
    long = [r for r in rows.values() if r.n_chars > 1500]
    assert sum(r.near_edited for r in long) / len(long) > 0.45
    assert sum(r.near_next < 0.2 for r in long) > 0.9 * len(long)


def test_odd_texts(documents):
    text = "One is here. Two is there! Three?\nFour. " * 3
    pairs = [(5, text), (7, text), (1, None), (2, ""), (3, "é😀x"), (30, "é😀x"), (4, "a" * 50_000), (9, "x. " * 4000), (9, "a. "), (None, "q. r. s. t."), (12, "\x01 \x01")]
    rows = verify(documents(pairs, clash=True), pairs)
    assert rows[5].fingerprint == rows[7].fingerprint and rows[5].near_next == 1.0
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1.0
    assert rows[2].near_next == 0.0
    assert fp.fingerprints(documents([])).collect() == []
    verify(documents([(3, "only one. text")]), [(3, "only one. text")])


def test_paragraphs_do_not_depend_on_length(spark):
    """A start shares all its paragraphs but the last with the whole, on either side of any length; so does a text without sentence ends."""
    words = [f"w{i * 7919 % 5003}" for i in range(4000)]
    ended = " ".join(w + "." * (i % 9 == 0) for i, w in enumerate(words))
    texts = [t[:n] for t in (ended, " ".join(words)) for n in (1000, 1050, 2000, 2100, 4000, 4200, 8000, 8400, 16000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.p for r in df.select("i", fp.paragraphs(F.col("text")).alias("p")).collect()}
    for k in (0, 9):
        for i in range(k, k + 9):
            assert set(got[i][:-1]) <= set(got[k + 8])
        assert len(got[k + 8]) > 6 * len(got[k + 2]) > 0 if k == 0 else len(got[k + 8]) >= 4


def test_likeness_is_exact_where_peeling_ends(spark):
    """Sets of digests of every size and overlap, against the sets themselves."""
    rows = [(a, b, shared) for a in (0, 1, 5, 20, 60) for b in (0, 3, 20, 70) for shared in (0, 1, 4, 18) if shared <= min(a, b)]
    df = spark.createDataFrame([([f"s{i}" for i in range(s)] + [f"a{i}" for i in range(a - s)], [f"s{i}" for i in range(s)] + [f"b{i}" for i in range(b - s)]) for a, b, s in rows], "a array<string>, b array<string>")
    hashed = [F.transform(c, lambda x: F.xxhash64(x)) for c in ("a", "b")]
    got = df.select(F.size("a").alias("na"), F.size("b").alias("nb"), fp.likeness(fp.sketch(hashed[0]), fp.sketch(hashed[1])).alias("near"), F.size(F.array_intersect("a", "b")).alias("s")).collect()
    close = 0
    for r in got:
        union = r.na + r.nb - r.s
        true = r.s / union if union else 1.0
        assert abs(r.near - true) < 0.3
        close += abs(r.near - true) < 1e-9
    assert close > 0.5 * len(got)


def test_only_native_code(spark, sample):
    plan = fp.fingerprints(sample)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
