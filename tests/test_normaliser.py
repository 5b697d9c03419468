from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

KK = "нөл бір екі үш төрт бес алты жеті сегіз тоғыз".split()
KK10 = "- он жиырма отыз қырық елу алпыс жетпіс сексен тоқсан".split()
RU = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
RU10 = "- - двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU100 = "- сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()


def plain_words(n: int, language: str) -> str:
    """Numbers by recursion, apart from the operator."""
    if n == 0:
        return KK[0] if language == "kk" else RU[0]
    if n >= 1000:
        head = n // 1000
        if language == "kk":
            first = plain_words(head, "kk") + " мың"
        else:
            first = {1: "одна тысяча", 2: "две тысячи"}.get(head) or plain_words(head, "ru") + (" тысячи" if head in (3, 4) else " тысяч")
        return first + (" " + plain_words(n % 1000, language) if n % 1000 else "")
    if n >= 100:
        first = (KK[n // 100] + " " if n >= 200 else "") + "жүз" if language == "kk" else RU100[n // 100]
        return first + (" " + plain_words(n % 100, language) if n % 100 else "")
    if language == "kk":
        return " ".join(([KK10[n // 10]] if n >= 10 else []) + ([KK[n % 10]] if n % 10 else []))
    return RU[n] if n < 20 else RU10[n // 10] + (" " + RU[n % 10] if n % 10 else "")


def run(spark, *cases):
    from talweg.functions.normaliser import normalised_text

    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, language string")
    return [r["r"] for r in df.select("i", normalised_text(F.col("text"), F.col("language")).alias("r")).orderBy("i").collect()]


def test_numbers_in_words(spark):
    from talweg.functions.normaliser import number_words

    r = random.Random(3)
    numbers = sorted({*range(0, 130), *range(990, 1130), 2000, 2017, 3_003, 4_100, 5_000, 10_000, 21_000, 53_019, 100_000, 800_000, 999_999, *(r.randrange(10**6) for _ in range(300))})
    df = spark.createDataFrame([(n,) for n in [*numbers, -1, 10**6, 10**12]], "n long")
    got = {x["n"]: (x["kk"], x["ru"]) for x in df.select("n", *[number_words(F.col("n"), c).alias(c) for c in ("kk", "ru")]).collect()}
    assert all(got[n] == (plain_words(n, "kk"), plain_words(n, "ru")) for n in numbers)
    assert got[-1] == got[10**6] == got[10**12] == (None, None)


def test_texts_of_the_fixed_vectors(spark):
    got = run(
        spark,
        ("METI және Apple 2017 жылы «ауыр емес» деді", "kk"),
        ("В 1920-е годы было 40 000 жителей — это факт", "ru"),
        ("TMZ, USGS және pН және h", "kk"),
        ("f1 және 70-тен 100-ге дейін", "kk"),
        ("  Рн  5 км/сағ , 3 мм б.з. 007 ", "mixed"),
        ("цена $1 200 за 12 345 штук [и] 0 007", "ru"),
        ("около 70 км и 100 км в 2100 км", "ru"),
        ("٣ және ०५", "kk"),
    )
    assert [g["normalized"] for g in got] == [
        "мети және эппл екі мың он жеті жылы ауыр емес деді",
        "в тысяча девятьсот двадцатые годы было сорока тысяч жителей - это факт",
        "ти эм зи, ю эс джи эс және пи эйч және эйч",
        "эф бір және жетпістен жүзге дейін",
        "пи эйч бес километр сағатына, үш миллиметр біздің заманымыздың нөл нөл жеті",
        "цена одна тысяча двести доллар за двенадцать тысяч триста сорок пять штук и ноль ноль ноль семь",
        "около семидесяти километров и ста километров в 2ста километров".replace("2ста", "дваста"),
        "үш және нөл бес",
    ]
    assert all(g["sha256"] == hashlib.sha256(g["normalized"].encode()).hexdigest() and g["error"] is None for g in got)
    assert got[0]["operations"] == ["unicode_lower_and_space_canonicalization", "explicit_latin_token_map", "locale_cardinal_number_expansion", "unsupported_punctuation_canonicalization"]
    assert got[4]["operations"][1:] == ["kk_abbreviation_expansion", "cyrillic_ph_expansion", "locale_cardinal_number_expansion"]


def test_rejections(spark):
    got = run(spark, ("Zeta және beta, zeta", "kk"), (None, "ru"), (" \t\n", "kk"), ("«»", "kk"), ("бір", "en"), ("бір", None), ("1000000 және", "kk"), ("$5 000 000", "ru"), ("9" * 40, "ru"), ("0" * 25, "ru"))
    assert [g["error"] for g in got] == ["latin beta zeta", "empty", "empty", "empty", "language", "language", "number", "number", "number", None]
    assert all(g["normalized"] is None and g["sha256"] is None and g["operations"] is None for g in got[:9])
    assert got[9]["normalized"] == " ".join(["ноль"] * 25)


@pytest.mark.parametrize("language", ["ru", "kk"])
def test_random_texts_against_plain_python(spark, language):
    from talweg.functions.normaliser import JOINED_SUFFIXES, KK_PHRASES, LATIN_TOKENS, RU_PHRASES

    r = random.Random(language)
    bits = ["сөз", "7", "12", " 345", "1 000", "$5", "$ 6", "-тен", "-ге", "meti", "F", "рн", "pн", "мм", "«", "»", "—", "/", ".", " ,", "  ", "\t", "007", *KK_PHRASES, *RU_PHRASES]
    texts = [" ".join(r.choices(bits, k=r.randint(1, 9))) if r.random() < 0.5 else "".join(r.choices(bits, k=r.randint(1, 7))) for _ in range(150)]

    def number(raw: str, digits: bool) -> str:
        raw = raw.replace(" ", "")
        if digits and len(raw) > 1 and raw[0] == "0":
            return " ".join(plain_words(int(d), language) for d in raw)
        if int(raw) >= 10**6:
            raise OverflowError
        return plain_words(int(raw), language)

    def plain(text: str) -> str | None:
        t = " ".join(text.lower().split())
        phrases = RU_PHRASES if language == "ru" else KK_PHRASES
        t = re.sub("|".join(map(re.escape, sorted(phrases, key=len, reverse=True))), lambda m: phrases[m[0]], t)
        if language == "kk":
            t = re.sub(r"(?<!\w)мм(?!\w)", "миллиметр", t)
        t = re.sub(r"\$(\d{1,3}(?: \d{3})*|\d+)", lambda m: number(m[1], False) + " доллар", t)
        t = re.sub(r"(?<!\w)рн(?!\w)", "пи эйч", t.replace("pн", "пи эйч"))
        if not set(re.findall("[a-z]+", t)) <= set(LATIN_TOKENS):
            return None
        t = re.sub("[a-z]+", lambda m: f" {LATIN_TOKENS[m[0]]} ", t)
        t = re.sub(r"\d{1,3}(?: \d{3})+|\d+", lambda m: number(m[0], True), t)
        if language == "kk":
            t = re.sub(rf"-({'|'.join(JOINED_SUFFIXES)})\b", r"\1", t)
        for old, new in (("«", " "), ("»", " "), ("—", "-"), ("/", " ")):
            t = t.replace(old, new)
        return re.sub(r"\s+([,.:;?!])", r"\1", " ".join(t.split())) or None

    def expected(text: str) -> str | None:
        try:
            return plain(text)
        except OverflowError:
            return None

    got = run(spark, *[(t, language) for t in texts])
    want = [expected(t) for t in texts]
    assert [g["normalized"] for g in got] == want and sum(w is not None for w in want) > 60
