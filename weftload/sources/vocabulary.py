"""Word lists from text files or text tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftload.functions.draws import element_in, key60
from weftload.functions.text import (
    LITERAL_VOCABULARY_LIMIT,
    MARK_ODDS,
    MARKS,
    WORD_JOINER,
    PagedVocabulary,
    Vocabulary,
    capitalised,
    exploded,
    form_code,
    split_words,
    whole_div,
    word_count,
)
from weftload.operators.blocks import running_sums
from weftload.session import written_table

PAGE_WORDS = 1024
#: Texts of one block, about: they are numbered and put into pages together.
BLOCK_TEXTS = 256


def vocabulary_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """``(…, word_pos, word)`` for each line, duplicates kept."""
    return exploded(lines, split_words(F.col(text)), "word", "word_pos")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` of a text file or folder: files by name, lines in their order.

    A file may be read in many pieces. Ids rise within a piece; a piece's first number follows
    from the sizes of the pieces before it, one row each.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    lines = written_table(lines, "lines")
    pieces = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that the optimizer knows how few they are and leaves the lines where they lie
    pieces = written_table(pieces.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), "pieces")
    number = F.col("_base") + F.col("_id") - F.col("_first")
    return lines.join(pieces, ["_file", "_start"]).select(number.alias("line_no"), "value")


def load_vocabulary(
    spark: SparkSession, path: str, literal: int = LITERAL_VOCABULARY_LIMIT
) -> Vocabulary | PagedVocabulary:
    """A word file as a vocabulary, whatever its length.

    Up to ``literal`` words come as a literal; a longer list stays in pages. Texts are the same.
    """
    pages = vocabulary_pages(numbered_lines(spark, path), "line_no", "value")
    size = pages.agg(F.sum(F.size("words").cast("bigint"))).first()[0]
    if not size:
        raise ValueError(f"no words in {path}")
    if size > literal:
        return PagedVocabulary(pages, size)
    words = [w for r in pages.orderBy("page").collect() for w in r.words]  # at most ``literal`` words
    return Vocabulary(tuple(words))


def vocabulary_pages(texts: DataFrame, order: str, text: str) -> DataFrame:
    """A word list of any length as pages of 1,024 words: ``(page, words)``.

    Words are numbered through all texts in the order of the unique integer ``order``.
    Texts are cut at page borders, so one huge text is many rows; a page is bounded. The
    texts are shuffled once, into blocks, where all pages within a block are put together; only
    the parts of pages that lie in several blocks meet again. The parts are written to the
    shared folder as plain text, a space between words (none holds one): they are read for counting and for look-ups.
    """
    counts = texts.select(order, text, F.size(split_words(F.col(text))).cast("bigint").alias("_n")).where("_n > 0")
    placed = running_sums(counts, [], order, {"_hi": "_n"}, BLOCK_TEXTS, keep_block=True)
    # each text of an order takes each place of that order: unique orders have one of both
    places = F.collect_list(F.struct((F.col("_hi") - F.col("_n")).alias("_lo"), "_hi"))
    ranged = placed.withColumn("_places", places.over(Window.partitionBy("_block", order)))
    ranged = ranged.select("_block", split_words(F.col(text)).alias("_words"), F.inline("_places"))
    first = F.greatest(F.col("page") * PAGE_WORDS, F.col("_lo"))
    end = F.least((F.col("page") + 1) * PAGE_WORDS, F.col("_hi"))
    paged = F.sequence(whole_div(F.col("_lo"), PAGE_WORDS), whole_div(F.col("_hi") - 1, PAGE_WORDS))
    pieces = ranged.withColumn("page", F.explode(paged)).select(
        "_block", "page", first.alias("_at"), end.alias("_end"),
        F.array_join(
            F.slice("_words", (first - F.col("_lo") + 1).cast("int"), (end - first).cast("int")), " "
        ).alias("_part"),
    )
    parts = joined_parts(pieces.where("_part <> ''"), "_block", "page").drop("_block")
    whole = (F.col("_at") == F.col("page") * PAGE_WORDS) & (F.col("_end") == (F.col("page") + 1) * PAGE_WORDS)
    parts = written_table(parts.withColumn("_whole", whole), "pages")
    # at most two pages of a block, its first and its last
    cut = written_table(joined_parts(parts.where("NOT _whole"), "page").select("page", "_part"), "cut_pages")
    whole = parts.where("_whole").select("page", "_part")
    return whole.unionByName(cut).select("page", F.split("_part", " ").alias("words"))


def joined_parts(pieces: DataFrame, *keys: str) -> DataFrame:
    """Pieces ``(_at, _end, _part)`` of a key as one, in the order of their places."""
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_part")))
    return pieces.groupBy(*keys).agg(
        F.min("_at").alias("_at"), F.max("_end").alias("_end"),
        F.array_join(F.transform(ordered, lambda p: p["_part"]), " ").alias("_part"),
    )


def count_words(pages: DataFrame) -> int:
    """Length of a paged word list; one number."""
    total = pages.agg(F.sum(F.size("words").cast("bigint"))).first()[0]
    if not total:
        raise ValueError("vocabulary is empty")
    return total


def text_from_pages(
    rows: DataFrame, pages: DataFrame, size: int, low: int, high: int,
    seed: int = 42, template: int = 0, slot: int = 0,
) -> DataFrame:
    """``(row_id, text)``: like the literal form, with words looked up by page.

    Positions are uniform over the list, so no page is hot. The words of a row come
    together again in a group of at most ``high`` elements.
    """
    cases = size * len(MARKS) * MARK_ODDS
    state = F.col("_state")
    seeded = rows.select("row_id", key60(seed, template, F.col("row_id"), slot).alias("_state"))
    counted = seeded.withColumn("_count", word_count(state, low, high))
    one = F.lit(1).cast("bigint")
    drawn = (
        counted.where("_count > 0")
        .withColumn("_k", F.explode(F.sequence(one, F.col("_count"))))
        .withColumn("_draw", element_in(state, F.col("_k"), 0, cases - 1))
        .withColumn("_code", form_code(F.col("_draw"), size))
        .select(
            "row_id", "_k", (F.col("_code") % size).alias("_pos"),
            whole_div(F.col("_code"), size).alias("_mark"),
        )
        .withColumn("page", whole_div(F.col("_pos"), PAGE_WORDS))
    )
    looked_up = drawn.join(pages, "page").select(
        "row_id", "_k", "_mark",
        F.get("words", (F.col("_pos") % PAGE_WORDS).cast("int")).alias("_word"),
    )
    by_row = looked_up.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("_k", "_word", "_mark"))).alias("_parts")
    )
    parts = F.col("_parts")
    endings = F.array(*[F.lit(m) for m in [*MARKS, ""]])

    def form(part, i):
        starts = (i == 0) | (F.get(parts, i - 1)["_mark"] == 0)
        word = F.when(starts, capitalised(part["_word"])).otherwise(part["_word"])
        last = i == F.size(parts) - 1
        ending = F.when(last, F.lit(MARKS[0])).otherwise(F.get(endings, part["_mark"].cast("int")))
        return F.concat(word, ending)

    texts = by_row.select("row_id", F.array_join(F.transform(parts, form), " ").alias("text"))
    if low > 0:
        return texts
    empty = counted.where("_count = 0").select("row_id", F.lit("").alias("text"))
    return texts.unionByName(empty)


def content_digest(vocabulary: Vocabulary | PagedVocabulary) -> str:
    """Identity of a word list: its words in their places. A paged list is summed up by tasks."""
    if isinstance(vocabulary, Vocabulary):
        return hashlib.md5(WORD_JOINER.join(vocabulary.words).encode()).hexdigest()
    place = F.xxhash64("page", "words")
    other = F.xxhash64(F.lit(1), "page", "words")
    found = vocabulary.pages.agg(
        F.count(F.lit(1)), F.sum(F.size("words")), F.bit_xor(place), F.bit_xor(other)
    ).first()
    return ":".join(str(x) for x in found)
