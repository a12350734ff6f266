"""Numerals, agreement and gender over columns, in Spark's own functions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolot import lexicon as L
from kolot.config import Config
from kolot.operators import spoken as S

LEAST = -(2**63)


def lit_of(words: list[str], index: Column) -> Column:
    """The word at a place that starts from 0; null outside."""
    return F.get(F.array(*map(F.lit, words)), index.cast("int"))


def over(n: Column, by: int) -> Column:
    """Integer division, exact at 64 bits."""
    return F.call_function("div", n, F.lit(by))


def lookup(table: dict, key: Column) -> Column:
    """The value of a constant map; null for other keys."""
    if not table:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


@cache
def _table(kind: str) -> str:
    """Words of 0 to 999 of a kind, made by rule: a numeral of a gender, or a number of thousands and more."""
    two = L.BOUND["m"][2]
    if kind in L.ONES:
        return "|".join(S.cardinal(i, kind) for i in range(1000))
    one, dual, few = {"k": (L.THOUSAND, L.TWO_THOUSAND, L.THOUSANDS), "M": (L.MILLION, f"{two} {L.MILLION}", None), "G": (L.MILLIARD, f"{two} {L.MILLIARD}", None)}[kind]
    return "|".join(S.scaled(i, one, dual, few) if i else "" for i in range(1000))


def words(kind: str, n: Column) -> Column:
    """A look-up in a table of 1000 words, which folds to one constant array: a place in it is all the work for a row."""
    return F.get(F.split(F.lit(_table(kind)), r"\|"), n.cast("int"))


def _parts(n: Column, gender: str, most: int) -> Column:
    """Words of a number above 0, largest part first, with "and" before the last of several."""

    def part(kind: str, value: Column, rest: Column | None, larger: int) -> Column:
        last = (n >= larger) if rest is None else (n >= larger) & (rest == 0)
        joined = F.when(last, L.AND).otherwise("") if larger <= most else F.lit("")
        return F.when(value > 0, F.concat(joined, words(kind, value)))

    # below 1000 the table's words have their own "and"; after something larger only a single word lacks one
    low = n % 1000
    single = (low < 20) | ((low < 100) & (low % 10 == 0)) | (low % 100 == 0)
    ones = F.when(low > 0, F.concat(F.when((n >= 1000) & single, L.AND).otherwise(""), words(gender, low)))
    parts = [ones]
    if most >= 1000:
        parts.insert(0, part("k", over(n, 1000) % 1000, low, 10**6))
    if most >= 10**6:
        parts.insert(0, part("M", over(n, 10**6) % 1000, n % 10**6, 10**9))
    if most >= 10**9:
        count = over(n, 10**9)
        said = words("G", count)
        if most >= 10**12:
            said = F.when(count < 1000, said).otherwise(F.concat(_parts(count, "m", most // 10**9), F.lit(" " + L.MILLIARD)))
        parts.insert(0, F.when(count > 0, said))
    return F.concat_ws(" ", *parts)


def cardinal(n: Column, gender: str = "f", bound: bool = False, most: int = 2**63 - 1) -> Column:
    """A 64-bit integer in words; null stays null. `most` bounds the magnitude of the values, for a shorter expression; a value beyond it is an error."""
    n = n.cast("long")
    # the least value has no magnitude in 64 bits
    size = F.abs(F.when(n == LEAST, 0).otherwise(n)) if most == 2**63 - 1 else F.abs(n)
    said = F.when(size == 0, L.ONES[gender][0]).otherwise(_parts(size, gender, most))
    if most < 2**63 - 1:
        said = F.when(size > most, F.raise_error(F.concat(F.lit(f"a number beyond {most}: "), n.cast("string")))).otherwise(said)
    if most == 2**63 - 1:
        said = F.when(n == LEAST, S.cardinal(2**63, gender)).otherwise(said)
    if bound:
        said = F.coalesce(lookup(L.BOUND[gender], F.when((n != LEAST) & (size <= 10), size).otherwise(0).cast("int")), said)
    return F.when(n.isNotNull(), F.concat(F.when(n < 0, L.MINUS + " ").otherwise(""), said))


def digits(text: Column) -> Column:
    """Each ASCII digit of a string in the counting series; null stays null."""
    each = F.split(F.regexp_replace(text, "[^0-9]", ""), "")
    return F.array_join(F.transform(F.filter(each, lambda d: d != ""), lambda d: lit_of(L.ONES["f"], d.cast("int"))), " ")


def decimal(n: Column, fraction: Column, cfg: Config = Config(), gender: str = "f", most: int = 2**63 - 1) -> Column:
    return F.concat(cardinal(n, gender, most=most), F.lit(f" {cfg.decimal_word} "), digits(fraction))


def ordinal(n: Column, gender: str = "m", definite: bool = False, most: int = 2**63 - 1) -> Column:
    word = F.coalesce(F.when((n >= 1) & (n <= 10), lit_of(L.ORDINALS[gender], n - 1)), cardinal(n, gender, most=most))
    return F.concat(F.lit(L.THE if definite else ""), word)


def amount(n: Column, one: str | Column, many: str | Column, gender: str, most: int = 2**63 - 1) -> Column:
    """A counted thing: one follows its noun, two is bound, others stand before."""
    one, many = (F.lit(x) if isinstance(x, str) else x for x in (one, many))
    space = F.lit(" ")
    return F.when(n == 1, F.concat(one, space, F.lit(L.ONES[gender][1]))).when(n == 2, F.concat(F.lit(L.BOUND[gender][2]), space, many)).otherwise(F.concat(cardinal(n, gender, most=most), space, many))


def noun_gender(word: Column, cfg: Config = Config()) -> Column:
    """'m' or 'f': settings, known nouns and misleading endings, each for the word and without one and two attached letters; then the ending."""
    clitic = lambda w: (F.length(w) > 2) & w.rlike(f"^[{L.CLITICS}]")
    once = F.when(clitic(word), F.substring(word, 2, 1 << 20))
    twice = F.when(clitic(once), F.substring(once, 2, 1 << 20))
    tried = [lookup(table, form) for table in ({w: g.value for w, g in cfg.gender_overrides.items()}, L.NOUNS, L.ENDINGS) for form in (word, once, twice)]
    ending = F.when(word.endswith("ים"), "m").when(word.endswith("ה") | word.endswith("ת"), "f").otherwise("m")
    return F.when(word.isNotNull(), F.coalesce(*tried, ending))


def count_phrase(n: Column, noun: Column, cfg: Config = Config(), most: int = 2**63 - 1) -> Column:
    definite = (F.length(noun) > 2) & noun.startswith(L.THE) & n.between(3, 10)
    said = {g: F.when(definite, F.concat(cardinal(n, g, bound=True, most=most), F.lit(" "), noun)).otherwise(amount(n, noun, noun, g, most)) for g in "mf"}
    return F.when(noun_gender(noun, cfg) == "m", said["m"]).otherwise(said["f"])


def gematria(letters: Column) -> Column:
    """The sum of the letters' values; other characters count nothing."""
    values = F.transform(F.split(letters, ""), lambda c: F.coalesce(lookup(L.LETTER_VALUES, c), F.lit(0)))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
