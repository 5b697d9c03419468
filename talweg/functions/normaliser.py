"""Text for a speech model with a fixed set of characters: ordered rewriting with a log, in the JVM.

A rule is a name and a function of the text so far and its language; it is logged where it changed the
text.  Maps are tried longest first at each place; numbers are spelled by arithmetic on arrays of words.
Nothing is guessed: a Latin token without a reading or a number beyond 999,999 rejects the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the operations, phrases, abbreviations, readings of Latin tokens, words of numbers.
LOWER, PHRASES, ABBREVIATIONS = "unicode_lower_and_space_canonicalization", "ru_exact_inflected_quantity_map", "kk_abbreviation_expansion"
CURRENCY, PH_MIXED, PH_CYRILLIC = "usd_amount_expansion", "mixed_script_ph_expansion", "cyrillic_ph_expansion"
LATIN, NUMBERS, SUFFIXES, PUNCTUATION = "explicit_latin_token_map", "locale_cardinal_number_expansion", "kk_numeric_suffix_join", "unsupported_punctuation_canonicalization"
RU_PHRASES = {
    "40 000 жителей": "сорока тысяч жителей",
    "в 1920-е годы": "в тысяча девятьсот двадцатые годы",
    "35 мм": "тридцать пять миллиметров",
    "70 километров": "семидесяти километров",
    "120 километрах": "ста двадцати километрах",
    "53-летний": "пятидесятитрёхлетний",
    "800 000 солдат": "восьмисот тысяч солдат",
    "10 000 лет": "десяти тысяч лет",
    "более чем 70 острейшими": "более чем семьюдесятью острейшими",
    "около 70 км": "около семидесяти километров",
    "100 км": "ста километров",
}
KK_PHRASES = {"км/сағ": "километр сағатына", "б.з.": "біздің заманымыздың"}
LATIN_TOKENS = {
    "aerosmith": "аэросмит", "apple": "эппл", "asus": "асус", "broadsides": "бродсайдс", "civilis": "цивилис", "civis": "цивис", "civitas": "цивитас",
    "conirostris": "конирострис", "dunlap": "данлэп", "eee": "и и и", "f": "эф", "fkp": "эф кей пи", "ftir": "эф ти ай ар", "gbp": "джи би пи",
    "geospiza": "геоспиза", "h": "эйч", "m": "эм", "mdt": "эм ди ти", "meti": "мети", "p": "пи", "radio": "радио", "sanparks": "санпаркс",
    "scotturb": "скоттурб", "swapo": "свапо", "tmz": "ти эм зи", "toginet": "тоджинет", "usgs": "ю эс джи эс", "usoc": "ю эс о си", "xdr": "икс ди ар",
}
ONES = {"ru": "ноль один два три четыре пять шесть семь восемь девять".split(), "kk": "нөл бір екі үш төрт бес алты жеті сегіз тоғыз".split()}
TEENS = "десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
TENS = {"ru": "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split(), "kk": "он жиырма отыз қырық елу алпыс жетпіс сексен тоқсан".split()}
HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
JOINED_SUFFIXES = "ға ге қа ке да де та те дан ден тан тен нан нен".split()

_SPACE = r"(?U)[\s\x1c-\x1f]+"
_NUMBER = r"(?U)\d{1,3}(?: \d{3})+|\d+"
_MONEY = r"(?U)\$(?:\d{1,3}(?: \d{3})*|\d+)"
_DIGIT_ZEROS = (0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x17E0, 0x1810, 0xFF10)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rewritten(text: Column, pattern: str, use: Callable[[Column], Column]) -> Column:
    """``text`` with every match of a pattern replaced by what ``use`` makes of it."""
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), use), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.concat(a, b)), "")


def phrase_map(text: Column, phrases: dict[str, str]) -> Column:
    """Every phrase by its reading, at each place the longest one."""
    pattern = "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))
    table = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    return rewritten(text, pattern, lambda m: F.try_element_at(table, m))


# ---- numbers -----------------------------------------------------------------------------------------


def _word(words: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), i)


def _words(*parts: Column) -> Column:
    """Those that are not null, with a space between."""
    return F.concat_ws(" ", *parts)


def _below_thousand(n: Column, language: str) -> Column:
    h, t, o = (n / 100).cast("int"), (n % 100 / 10).cast("int"), (n % 10).cast("int")
    one = F.when(o > 0, _word(ONES[language], o))
    if language == "kk":
        return _words(F.when(h > 1, _word(ONES["kk"], h)), F.when(h > 0, F.lit("жүз")), _word(TENS["kk"], t - 1), one)
    return _words(_word(HUNDREDS, h - 1), F.when(t == 1, _word(TEENS, o)), _word(TENS["ru"], t - 2), F.when(t != 1, one))


def number_words(n: Column, language: str) -> Column:
    """Cardinal in words of ``ru`` or ``kk``; null below 0 and from a million on."""
    thousands, rest = (n / 1000).cast("int"), (n % 1000).cast("int")
    if language == "kk":
        many = F.concat(_below_thousand(thousands, "kk"), F.lit(" мың"))
    else:
        form = F.when(thousands.isin(3, 4), " тысячи").otherwise(" тысяч")
        many = F.when(thousands == 1, "одна тысяча").when(thousands == 2, "две тысячи").otherwise(F.concat(_below_thousand(thousands, "ru"), form))
    spelled = _words(F.when(thousands > 0, many), F.when(rest > 0, _below_thousand(rest, language)))
    return F.when((n < 0) | (n >= 1_000_000), F.lit(None).cast("string")).when(n == 0, ONES[language][0]).otherwise(spelled)


def _ascii_digits(s: Column) -> Column:
    return F.translate(s, "".join(chr(z + i) for z in _DIGIT_ZEROS for i in range(10)), "0123456789" * len(_DIGIT_ZEROS))


def _spelled(match: Column, language: str, digits_of_zero: bool) -> Column:
    """Words of a matched number; with a leading zero those of its digits. ``\\u0001`` marks one out of range."""

    def of(compact: Column) -> Column:
        n = F.least(F.coalesce(compact.try_cast("bigint"), F.lit(1_000_000)), F.lit(1_000_000))
        out = F.coalesce(number_words(n, language), F.lit("\u0001"))
        if not digits_of_zero:
            return out
        each = F.array_join(F.transform(F.split(compact, ""), lambda d: _word(ONES[language], d.try_cast("int"))), " ")
        return F.when((F.length(compact) > 1) & compact.startswith("0"), each).otherwise(out)

    return let(F.replace(_ascii_digits(match), F.lit(" "), F.lit("")), of)


def _by_language(language: Column, use: Callable[[str], Column]) -> Column:
    return F.when(language == "ru", use("ru")).otherwise(use("kk"))


# ---- the rules ---------------------------------------------------------------------------------------


def _spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def _quantities(t: Column, language: Column) -> Column:
    return F.when(language == "ru", phrase_map(t, RU_PHRASES)).otherwise(t)


def _abbreviations(t: Column, language: Column) -> Column:
    return F.when(language == "ru", t).otherwise(F.regexp_replace(phrase_map(t, KK_PHRASES), r"(?U)(?<!\w)мм(?!\w)", "миллиметр"))


def _dollars(t: Column, language: Column) -> Column:
    return rewritten(t, _MONEY, lambda m: F.concat(_by_language(language, lambda lang: _spelled(F.substring(m, 2, 1 << 30), lang, False)), F.lit(" доллар")))


def _latin(t: Column, language: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LATIN_TOKENS.items() for x in pair])
    return rewritten(t, "[a-z]+", lambda m: F.coalesce(F.concat(F.lit(" "), F.try_element_at(table, m), F.lit(" ")), m))


def _numbers(t: Column, language: Column) -> Column:
    return rewritten(t, _NUMBER, lambda m: _by_language(language, lambda lang: _spelled(m, lang, True)))


def _suffixes(t: Column, language: Column) -> Column:
    return F.when(language == "ru", t).otherwise(F.regexp_replace(t, rf"(?U)-({'|'.join(JOINED_SUFFIXES)})\b", "$1"))


RULES: list[tuple[str, Callable[[Column, Column], Column]]] = [
    (PHRASES, _quantities),
    (ABBREVIATIONS, _abbreviations),
    (CURRENCY, _dollars),
    (PH_MIXED, lambda t, language: F.replace(t, F.lit("pн"), F.lit("пи эйч"))),
    (PH_CYRILLIC, lambda t, language: F.regexp_replace(t, r"(?U)(?<!\w)рн(?!\w)", "пи эйч")),
    (LATIN, _latin),
    (NUMBERS, _numbers),
    (SUFFIXES, _suffixes),
    (PUNCTUATION, lambda t, language: F.translate(t, '«»"[]—/', "     - ")),
]


def normalised_text(text: Column, language: Column) -> Column:
    """struct<normalized, sha256, operations, error> of a text in ``ru``, ``kk`` or ``mixed`` (which reads as ``kk``).

    Errors, which leave normalized, sha256 and operations null: ``language``; ``empty`` (also a null text);
    ``latin`` with the sorted tokens that have no reading; ``number`` for one of a million or more.
    """
    start = F.struct(_spaces(F.lower(F.coalesce(text, F.lit("")))).alias("t"), F.array(F.lit(LOWER)).alias("ops"), F.array().cast("array<string>").alias("latin"))

    def step(state: Column, name: str, rule: Callable[[Column, Column], Column]) -> Column:
        def of(s: Column) -> Column:
            unknown = s["latin"]
            if name == LATIN:
                found = F.array_sort(F.array_distinct(F.regexp_extract_all(s["t"], F.lit("[a-z]+"), F.lit(0))))
                unknown = F.filter(found, lambda w: ~w.isin(*LATIN_TOKENS))
            ops = lambda now: F.when(now != s["t"], F.concat(s["ops"], F.array(F.lit(name)))).otherwise(s["ops"])
            return let(rule(s["t"], language), lambda now: F.struct(now.alias("t"), ops(now).alias("ops"), unknown.alias("latin")))

        return let(state, of)

    state = start
    for name, rule in RULES:
        state = step(state, name, rule)

    def result(s: Column) -> Column:
        last = F.regexp_replace(_spaces(s["t"]), r"(?U)[\s\x1c-\x1f]+([,.:;?!])", "$1")
        bad = F.size(s["latin"]) > 0

        def of(now: Column) -> Column:
            error = (
                F.when(~F.coalesce(language.isin("ru", "kk", "mixed"), F.lit(False)), "language")
                .when(bad, F.concat(F.lit("latin "), F.array_join(s["latin"], " ")))
                .when(F.contains(now, F.lit("\u0001")), "number")
                .when(now == "", "empty")
            )
            ok = error.isNull()
            return F.struct(F.when(ok, now).alias("normalized"), F.when(ok, F.sha2(now, 256)).alias("sha256"), F.when(ok, s["ops"]).alias("operations"), error.alias("error"))

        return let(last, of)

    return let(state, result)
