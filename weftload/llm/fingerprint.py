"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests, in DataFrame code.

A text is cut into paragraphs after words that their own hash chooses, sentence ends more often than
others, at the same rates for all lengths: what two versions share is cut alike, and sketches grow
with the text. Every paragraph's digest goes into one cell of each third of the sketch; a cell keeps
how many digests it holds, and the exclusive or of them and of their checks. Two sketches are folded
to a common size and subtracted, which leaves the digests that only one version has; cells that hold
a single one are peeled until all are known. If that fails, the sketches are peeled again at their
own, larger sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftload.session import written_table

#: One in so many different last words of a sentence ends a paragraph, and one in so many other words.
SENTENCE_RATE, WORD_RATE = 3, 128
#: Rounds of peeling: each doubles, at least, how far the knowledge reaches.
ROUNDS = 14
LEAST_POWER = 3
SMALLEST = -(1 << 63)


def width(power_: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), power_)


def let(value: Column, body) -> Column:
    """The body of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Digests of the different paragraphs."""
    words = F.split(text, r"(?<=[ \n])(?=[^ \n])")

    def marked(w: Column) -> Column:
        bare = F.btrim(w, F.lit(" \n"))
        rate = F.when(F.substring(bare, -1, 1).isin(".", "!", "?", "|"), F.lit(SENTENCE_RATE)).otherwise(F.lit(WORD_RATE))
        return F.when(F.pmod(F.xxhash64(F.lit(7), bare), rate) == 0, F.concat(w, F.lit("\x01"))).otherwise(w)

    parts = F.filter(F.split(F.array_join(F.transform(words, marked), ""), "\x01"), lambda p: F.btrim(p, F.lit(" \n")) != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(F.btrim(p, F.lit(" \n")))))


def power(units: Column) -> Column:
    """A third of the sketch has 2 ** power cells, as many as there are digests or more."""
    return F.greatest(F.lit(LEAST_POWER), F.ceil(F.log2(F.greatest(units, F.lit(1)).cast("double"))).cast("int"))


def check_of(digest: Column) -> Column:
    return F.xxhash64(F.lit(11), digest).bitwiseAND(F.lit(0xFFFFFF))


def cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def nothing() -> Column:
    return cell(F.lit(0), F.lit(0), F.lit(0))


def plus(a: Column, b: Column, sign: int = 1) -> Column:
    return cell(a["n"] + sign * b["n"], a["k"].bitwiseXOR(b["k"]), a["c"].bitwiseXOR(b["c"]))


def placed(n: Column, k: Column, c: Column, cells: Column) -> Column:
    """A digest with its count, its check and where it lies in each third of that many cells."""
    places = [F.call_function("shiftright", k, F.lit(18 * third)).bitwiseAND((cells - 1).cast("long")).cast("int").alias(f"p{third}") for third in range(3)]
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"), *places)


def laid(items: Column, third: int, at: Column, start: Column, sign: int) -> Column:
    """A cell of one third after adding the items that lie there."""
    return F.aggregate(F.filter(items, lambda d: d[f"p{third}"] == at), start, lambda acc, d: plus(acc, d, sign))


def sketch(digests: Column) -> Column:
    """struct(units, power, cells)."""

    def filled(p: Column) -> Column:
        def thirds(items: Column) -> Column:
            def one(third: int) -> Column:
                return F.transform(F.sequence(F.lit(0), width(p) - 1), lambda at: laid(items, third, at, nothing(), 1))

            return F.concat(*map(one, range(3)))

        items = F.transform(digests, lambda d: placed(F.lit(1), d, check_of(d), width(p)))
        return F.struct(F.size(digests).alias("units"), p.alias("power"), let(items, thirds).alias("cells"))

    return let(power(F.size(digests)), filled)


def folded(cells: Column, from_: Column, to: Column) -> Column:
    """A smaller sketch of the same digests: halves of each third laid over each other."""

    def half(state: Column) -> Column:
        def over(w: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), 3 * w - 1),
                lambda i: let((F.floor(i / w) * w + i).cast("int"), lambda j: plus(F.get(state, j), F.get(state, j + w))),
            )

        return let(F.floor(F.size(state) / 6).cast("int"), over)

    smaller = F.aggregate(F.sequence(F.lit(1), F.greatest(from_ - to, F.lit(1))), cells, lambda state, _: half(state))
    return F.when(from_ > to, smaller).otherwise(cells)


def peeled(cells: Column, power_: Column) -> Column:
    """The digests of a sketch or a difference of two, or null if they can't all be recovered."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("more"))

    def one_round(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (check_of(c["k"]) == c["c"]))

        def without(known: Column) -> Column:
            w = width(power_)

            def thirds(items: Column) -> Column:
                def one(third: int) -> Column:
                    return F.transform(F.slice(state["cells"], third * w + 1, w), lambda c, at: laid(items, third, at, c, -1))

                return F.concat(*map(one, range(3)))

            items = F.transform(known, lambda d: placed(d["n"], d["k"], d["c"], w))
            found = F.concat(state["found"], F.transform(known, lambda d: d["k"]))
            fewer = F.struct(let(items, thirds).alias("cells"), found.alias("found"), F.lit(True).alias("more"))
            stuck = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("more"))
            return F.when(F.size(known) > 0, fewer).otherwise(stuck)

        return F.when(state["more"], let(F.array_distinct(single), without)).otherwise(state)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)
    return let(end, lambda e: F.when(F.forall(e["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0)), e["found"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared paragraphs among all paragraphs of two sketches, 0 to 1; two texts without any are alike (1).

    The difference at the size of the smaller sketch is peeled first. If that fails, each sketch is peeled
    at its own, larger size, which holds at least as many cells in a third as digests, and the digests are
    compared. Where several digests share all three cells even that fails; only then the number of
    differing digests is estimated from the empty cells."""

    def at(p: Column) -> Column:
        whole = F.zip_with(folded(a["cells"], a["power"], p), folded(b["cells"], b["power"], p), lambda x, y: plus(x, y, -1))

        def recovered(d: Column) -> Column:
            empty = F.size(F.filter(d, lambda c: (c["n"] == 0) & (c["k"] == 0))) / (3.0 * width(p))
            guess = F.round(-F.log(F.greatest(empty, 1 / (6.0 * width(p)))) * width(p))
            larger = F.array_size(F.array_intersect(peeled(a["cells"], a["power"]), peeled(b["cells"], b["power"])))
            return F.coalesce(F.array_size(peeled(d, p)), a["units"] + b["units"] - 2 * larger, guess)

        return let(whole, recovered)

    units = a["units"] + b["units"]
    found = let(F.least(a["power"], b["power"]), at)
    near = let(
        F.least(F.greatest(found, F.abs(a["units"] - b["units"])), units),
        lambda d: F.coalesce(F.try_divide((units - d).cast("double"), (units + d).cast("double")), F.lit(1.0)),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(near)


def written(s: Column) -> Column:
    cells = F.transform(s["cells"], lambda c: F.concat_ws(",", c["n"].cast("string"), F.lower(F.hex(c["k"])), F.lower(F.hex(c["c"]))))
    return F.concat_ws(";", s["units"].cast("string"), s["power"].cast("string"), F.array_join(cells, ";"))


def ring(docs: DataFrame) -> DataFrame:
    """(id, before, before_chars): the document before each in ascending order; the last stands before the first."""
    sizes = docs.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    dealt = written_table(sizes.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = dealt.groupBy("part").agg(F.max("id").alias("last"), F.max_by("n", "id").alias("last_n"))
    # one row for each task that dealt ids out, so this window stays small
    across = Window.orderBy("part")
    firsts = firsts.select("part", F.lag("last").over(across).alias("seam"), F.lag("last_n").over(across).alias("seam_n"))
    end, end_n = dealt.agg(F.max("id")).scalar(), dealt.agg(F.max_by("n", "id")).scalar()
    local = Window.partitionBy("part").orderBy("id")
    rows = dealt.withColumns({"p": F.lag("id").over(local), "p_n": F.lag("n").over(local)}).join(firsts, "part")
    return rows.select("id", F.coalesce("p", "seam", end).alias("before"), F.coalesce("p_n", "seam_n", end_n).alias("before_chars"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per doc_id of documents (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many (or all) of the
    next document's, in ascending doc_id; the first follows the last. Null texts are empty. If a doc_id
    stands several times, its smallest text stands for it. A null doc_id counts as the smallest number.
    A single document is its own next one. Other columns are ignored; no rows give none.

    Texts move once, by doc_id; what goes to the document before is at most a quarter of that one's length
    and a sketch.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = docs.groupBy("id").agg(F.min("text").alias("text"))
    sent = texts.join(ring(docs), "id").select(
        F.col("before").alias("id"), F.substring("text", F.lit(1), F.floor(F.col("before_chars") / 4).cast("int")).alias("head"), let(paragraphs(F.col("text")), sketch).alias("next_sketch")
    )
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut))
    rows = texts.join(sent, "id").select(
        "id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(edited).alias("new"), "next_sketch"
    )
    rows = rows.select("id", "n_chars", "edited_sha256", sketch(F.col("own")).alias("own"), sketch(F.col("new")).alias("new"), "next_sketch")
    return rows.select(
        F.when(F.col("id") != SMALLEST, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        written(F.col("own")).alias("fingerprint"), written(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next_sketch")).alias("near_next"),
    )
