import zlib

import numpy as np
from pyspark.sql import functions as F

from weftload.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_index_is_exact():
    rng = np.random.default_rng(5)
    n, terms = 700, 40
    full = rng.random((n, terms)) * (rng.random((n, terms)) < 0.1)
    full[::7] = full[0]  # ties
    full[np.flatnonzero(full.sum(1) == 0), 3] = 1.0
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    row, term = np.nonzero(full)
    ids = rng.permutation(n)
    index = toxicity.Index(ids, rng.integers(0, 2, n), row, term, full[row, term], terms)
    for q in full[:60]:
        places, scores = index.nearest(np.flatnonzero(q), q[q > 0])
        cosine = full @ q
        order = np.lexsort((ids, -np.round(cosine, 12)))[: toxicity.NEIGHBOURS]
        assert index.ids[places].tolist() == ids[order][: len(places)].tolist()
        assert np.allclose(scores, cosine[order][: len(places)])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def made(spark, documents, extra=()):
    texts = [f"word{i % 17} fine text number{i % 5} " + ("vile rotten" if i % 4 == 0 else "calm") for i in range(200)]
    docs = documents([*enumerate(texts), *extra], clash=True)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None), (5, 0, 0)], LABELS)
    return docs, labels


def test_learned_words_and_odd_texts(spark, documents):
    extra = [(900, None), (901, ""), (902, "vile rotten words"), (903, "calm"), (None, "vile"), (904, "x " * 20_000), (902, "vile rotten words")]
    rows = toxicity.toxicity(*made(spark, documents, extra)).collect()
    assert len(rows) == 207
    got = {r.doc_id: r for r in rows}
    assert got[902].predicted == 1 and got[902].evidence and got[903].predicted == 0
    assert got[900].score == got[901].score == got[904].score
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))


def test_all_words_of_the_examples_count(spark, documents):
    """Texts without a telling word have neighbours too: the cosines of all examples, worked out in full."""
    asked = ["word3 fine number2", "word5 text", "nothing known", "calm word16 word16 number4"]
    docs, labels = made(spark, documents, [*enumerate(asked, 900)])
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert set(model.place) == {w for i in train for w in texts[i].split()}

    def vector(text):
        out = np.zeros(len(model.place))
        for w in set(text.split()) & model.place.keys():
            out[model.place[w]] = (1 + np.log(text.split().count(w))) * model.weights[model.place[w]]
        return out / (np.linalg.norm(out) or 1)

    got = {r.doc_id: r for r in toxicity.score(docs, model).where("doc_id >= 900").collect()}
    for i, text in enumerate(asked, 900):
        cosine = {d: round(float(vector(texts[d]) @ vector(text)), 12) for d in train}
        near = [d for d in sorted(train, key=lambda d: (-cosine[d], d)) if cosine[d] > 0][:3]
        assert got[i].evidence == near and abs(got[i].nearest - max(cosine.values())) < 1e-9
    assert got[900].evidence and got[901].evidence and not got[902].evidence


def test_held_out_labels_are_not_learned(spark, documents):
    docs, labels = made(spark, documents)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_no_labels_and_no_rows(spark, documents):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.toxicity(documents(["a", "b"]), none).collect()} == {0.0}
    assert toxicity.toxicity(documents([]), none).collect() == []
