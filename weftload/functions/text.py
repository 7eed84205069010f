"""Vocabularies and sentence-like text."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftload.functions.draws import draws_in, element_in, let

# Characters that separate words in a vocabulary file.
WORD_SEPARATORS = r"""[\s.,;:!?()\[\]{}"'\-]+"""
# Marks that may follow a word, and the chance of one (1 in 5).
MARKS = [".", "!", "?", ",", ";"]
MARK_ODDS = 5

WORD_JOINER = "\x1f"

#: Words in a plan's constants, at most; longer lists are looked up in pages, with the same result.
LITERAL_VOCABULARY_LIMIT = 50_000
#: Words whose written forms are all kept as constants; an optimization that changes no result.
DECORATED_LIMIT = 2_000


def default_words() -> list[str]:
    """Pronounceable filler words built by rule: onset + vowel, then + coda."""
    onsets = ["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z"]
    vowels = ["a", "e", "i", "o"]
    codas = ["", "l", "n", "ra", "sto", "vim", "der"]
    return [o + v + c for o in onsets for v in vowels for c in codas]


def split_words(line: Column) -> Column:
    """Words of a line in order, duplicates kept."""
    return F.array_remove(F.split(line, WORD_SEPARATORS), "")


def exploded(df: DataFrame, values: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element.

    The outer form plus a filter: for the inner one the optimizer adds a test of the
    array's size below the explode, which computes a costly array a second time.
    """
    place = position or "_at"
    rows = df.select("*", F.posexplode_outer(values).alias(place, name)).where(
        F.col(place).isNotNull()
    )
    return rows if position else rows.drop(place)


@dataclass(frozen=True)
class Vocabulary:
    """A word list that lives in the plan as an array literal.

    Loaders give lists of up to ``LITERAL_VOCABULARY_LIMIT`` words in this form.
    """

    words: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.words:
            raise ValueError("vocabulary is empty")

    @staticmethod
    def default() -> Vocabulary:
        return Vocabulary(tuple(default_words()))

    @property
    def size(self) -> int:
        return len(self.words)


@dataclass(frozen=True)
class PagedVocabulary:
    """A word list of any length: a table of pages, and the number of words.

    A text over it is no expression but a lookup, made before the statement is put together.
    """

    pages: DataFrame
    size: int


def lookup_name(template: int, slot: int) -> str:
    """The column in which a looked-up text waits for its statement."""
    return f"_text_{template}_{slot}"


def whole_div(a: Column, b: int) -> Column:
    """Integer division of a long by a positive constant."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def capitalised(word: Column) -> Column:
    """Upper-case a first letter a-z and keep the rest as it is."""
    first = F.translate(F.substring(word, 1, 1), ascii_lowercase, ascii_uppercase)
    return F.concat(first, F.substring(word, 2, 2147483647))


def word_count(state: Column, low: int, high: int) -> Column:
    """Number of words of the text seeded by ``state``."""
    return element_in(state, F.lit(0).cast("bigint"), low, high)


def _word_array(words: list[str]) -> Column:
    """A constant array; one string literal that the optimizer folds, not thousands."""
    return F.split(F.lit(WORD_JOINER.join(words)), WORD_JOINER)


def _decorated(words: tuple[str, ...]) -> Column:
    """Every word in its twelve written forms: (plain, capital) x (five marks, no mark)."""
    endings = [*MARKS, ""]
    plain = [w + e for e in endings for w in words]
    capital = str.maketrans(ascii_lowercase, ascii_uppercase)  # as in ``capitalised``
    upper = [w[:1].translate(capital) + w[1:] + e for e in endings for w in words]
    return _word_array(plain + upper)


def form_code(draw: Column, size: int) -> Column:
    """``mark * size + word``: marks 0..4 in one of five cases, 5 (no mark) otherwise."""
    marked = size * len(MARKS)
    return F.when(draw < marked, draw).otherwise(draw % size + marked)


def text_column(state: Column, low: int, high: int, vocabulary: Vocabulary) -> Column:
    """Sentence-like text of ``low``..``high`` words as one expression.

    A word is capitalised at the start and after a full stop; every word but the
    last is followed by a mark one time in five; the last one by a full stop. The
    previous word's mark is read back from its code, so no fold over words is needed.
    """
    size = vocabulary.size
    cases = size * len(MARKS) * MARK_ODDS

    def written(codes: Column) -> Column:
        count = F.size(codes)

        def form(code: Column, i: Column) -> Column:
            # Code < size means mark 0, the full stop.
            starts = (i == 0) | (F.get(codes, i - 1) < size)
            ended = F.when(i == count - 1, code % size).otherwise(code)
            if size <= DECORATED_LIMIT:
                capital = F.when(starts, F.lit(size * (len(MARKS) + 1))).otherwise(F.lit(0))
                return F.get(_decorated(vocabulary.words), (ended + capital).cast("int"))
            word = F.get(_word_array(list(vocabulary.words)), (code % size).cast("int"))
            ending = F.get(_word_array([*MARKS, ""]), whole_div(ended, size).cast("int"))
            return let(word, lambda w: F.concat(F.when(starts, capitalised(w)).otherwise(w), ending))

        return F.array_join(F.transform(codes, form), " ")

    def body(seeded: Column) -> Column:
        def of_length(count: Column) -> Column:
            draws = draws_in(seeded, count, cases)
            text = let(F.transform(draws, lambda d: form_code(d, size)), written)
            return F.when(count > 0, text).otherwise(F.lit("")) if low == 0 else text

        return let(word_count(seeded, low, high), of_length)

    return let(state, body)
