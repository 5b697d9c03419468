"""Format-preserving pseudonyms for personal data (DataFrame functions only).

Values are found by one pattern, validated by kind and then permuted by a keyed Feistel network
within their own format.  The network sees the value without its spelling (separators, case), and the
pseudonym is laid out as the value was, so equal values get equal pseudonyms in every document:

* cards: in a run of digit groups, the longest stretches of 13-19 digits between separators that pass
  the Luhn test, from the left; all digits but the last are permuted and the check digit is made anew;
* dates (ISO, d/m/y, d.m.y) that exist in 1800-2199: the day number is permuted within the 146,097
  days of those 400 years (as 189 x 773) and printed in the same form;
* IPv4 addresses: two 16-bit halves; IPv6 addresses: 32 hexadecimal digits, printed in full;
* phone numbers (country code kept; national ones link with those that have a code), US social
  security numbers, IBANs of their country's length (mod 97; check digits remade), local parts of
  e-mail addresses: digits to digits and letters to letters of the same case;
* hexadecimal secrets, access tokens with known prefixes, JSON web tokens, private keys.

Numbers that fail their test stay as they are.  ``key`` has no default: ``key_of`` takes it from the
setting ``spark.talweg.pii.key``.  Defined results: null texts stay null, empty texts stay empty,
repeated rows are treated alike, every other column passes through whatever its name, and a table
without rows gives one without rows; a name for ``changes`` that the table has is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.talweg.pii.key"
DEMO_KEY = "not a secret: for trials on synthetic tables only"
ROUNDS = 8
# Countries by the length of their IBANs, and calling codes of fewer than three digits.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
CALLING_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
TOKEN_PREFIX = r"(?:AKIA|ASIA|sk-|gh[oprsu]_|xox[abprs]-|AIza)"
_IBANS = "|".join(f"(?:{'|'.join(c.split())})\\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_HEX4 = r"[0-9A-Fa-f]{1,4}"
# The forms that are looked for, tried in this order.
FORMS = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]*PRIVATE KEY-----",
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "ipv6": rf"(?<![\w:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}(?::{_HEX4}){{0,6}})?::(?:{_HEX4}(?::{_HEX4}){{0,6}})?)(?![\w:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w(+.-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\w-])",
    "iban": rf"(?<!\w)(?=[A-Z]{{2}}\d{{2}})(?:{_IBANS})(?!\w)",
    "jwt": r"(?<![\w-])eyJ[\w-]{8,}+\.eyJ[\w-]{8,}+\.[\w-]{8,}+",
    "token": rf"(?<![\w-]){TOKEN_PREFIX}[A-Za-z0-9_-]{{16,}}+",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,}+(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)",
}
ANY = "|".join(FORMS.values())
# One of these stands in every match of every form; a text without them is passed on unread.
SCAN = rf"[0-9@]|-----BEGIN|::|eyJ|{TOKEN_PREFIX}|[a-f]{{32}}|[A-F]{{32}}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DAYS_A, DAYS_B, FIRST_DAY = 189, 773, "1800-01-01"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _stream(key: str, kind: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), other), 512)


def _number(stream: Column, at: Column | int, digits: int) -> Column:
    return F.conv(F.substring(stream, at if isinstance(at, Column) else F.lit(at), F.lit(digits)), 16, 10).cast("long")


def _turned(c: Column, k: Column, alphabet: str) -> Column:
    n = len(alphabet)
    return F.substring(F.lit(alphabet), (F.instr(F.lit(alphabet), c) - 1 + k % n).cast("int") % n + 1, F.lit(1))


def key_of(spark: SparkSession) -> str:
    """The key in ``spark.talweg.pii.key``; the registered queries run with a public one where it is not set."""
    return spark.conf.get(SETTING, None) or DEMO_KEY


def _moved(half: Column, other: Column, i: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """Each character of ``half`` moved within its alphabet by a keyed amount; others stay."""

    def one(c: Column, j: Column, stream: Column) -> Column:
        k = _number(stream, (j % 32 * 4 + 1).cast("int"), 4)
        out = c
        for a in alphabets:
            out = F.when((c != "") & F.lit(a).contains(c), _turned(c, k, a)).otherwise(out)
        return out

    return _bound(
        _stream(key, kind, i, other),
        lambda s: F.array_join(F.transform(F.split(half, ""), lambda c, j: one(c, j, s)), ""),
    )


def permuted(value: Column, kind: str, key: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """Feistel network over the two halves of a string, the format kept; one character alone is turned."""
    cut = (F.length(value) / 2).cast("int")
    start = F.struct(
        F.substring(value, F.lit(1), cut).alias("l"),
        F.substring(value, cut + 1, F.length(value)).alias("r"),
    )
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.struct(s["r"].alias("l"), _moved(s["l"], s["r"], i, key, kind, alphabets).alias("r")),
    )
    single = value
    for a in alphabets:
        turn = _number(_stream(key, kind, F.lit(0), F.lit("")), 1, 4) % (len(a) - 1) + 1
        single = F.when(F.lit(a).contains(value), _turned(value, turn, a)).otherwise(single)
    return F.when(F.length(value) < 2, F.when(value == "", value).otherwise(single)).otherwise(_bound(done, lambda s: F.concat(s["l"], s["r"])))


def laid_out(chars: Column, form: Column, kind: str = "[0-9]") -> Column:
    """``form`` with its characters of ``kind`` replaced in order by those of ``chars``."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def put(s: Column, c: Column) -> Column:
        taken = F.struct((s["k"] + 1).alias("k"), F.concat(s["out"], F.substring(chars, s["k"] + 1, F.lit(1))).alias("out"))
        return F.when(c.rlike(f"^{kind}$"), taken).otherwise(F.struct(s["k"].alias("k"), F.concat(s["out"], c).alias("out")))

    return F.aggregate(F.split(form, ""), start, put, lambda s: s["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def permuted_pair(left: Column, right: Column, a: int, b: int, kind: str, key: str) -> Column:
    """Feistel network on [0, a) x [0, b), each half moved by what the other gives; a struct l, r."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = (s["l"] + _number(_stream(key, kind, i, s["r"].cast("string")), 1, 12)) % a
        return _bound(
            left,
            lambda x: F.struct(
                x.alias("l"),
                ((s["r"] + _number(_stream(key, kind, i + 100, x.cast("string")), 1, 12)) % b).alias("r"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn)


def _ip(v: Column, key: str) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    made = _bound(octets, lambda o: permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", key))
    parts = _bound(made, lambda s: F.array((s["l"] / 256).cast("long"), s["l"] % 256, (s["r"] / 256).cast("long"), s["r"] % 256))
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), ".")


def _date(v: Column, key: str) -> Column:
    form = F.when(v.contains("-"), "yyyy-MM-dd").when(v.contains("/"), "dd/MM/yyyy").otherwise("dd.MM.yyyy")

    def one(pattern: str) -> Column:
        day = F.datediff(F.to_date(F.try_to_timestamp(v, F.lit(pattern))), F.to_date(F.lit(FIRST_DAY)))
        moved = _bound(day, lambda d: permuted_pair((d / DAYS_B).cast("long"), d % DAYS_B, DAYS_A, DAYS_B, "date", key))
        made = _bound(moved, lambda s: F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), (s["l"] * DAYS_B + s["r"]).cast("int")), pattern))
        return F.when(day.between(0, DAYS_A * DAYS_B - 1), made)

    made = F.lit(None).cast("string")
    for pattern in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy"):
        made = F.when(form == pattern, one(pattern)).otherwise(made)
    return F.coalesce(made, v)


def _card(v: Column, key: str) -> Column:
    def checked(head: Column) -> Column:
        ok = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(head, d.cast("string"))))
        return laid_out(F.concat(head, ok[0].cast("string")), v)

    bare = _digits(v)
    return _bound(permuted(F.substring(bare, F.lit(1), F.length(bare) - 1), "card", key, (DIGITS,)), checked)


def _cards(v: Column, key: str) -> Column:
    """A run of digit groups with every card in it replaced: longest first at each place, from the left."""
    n = F.length(v)

    def at(i: Column) -> Column:
        return F.substring(v, i, F.lit(1))

    def length(i: Column) -> Column:
        """Length of the longest card that begins at ``i``, or null."""
        most = F.least(F.lit(37), n - i + 1)
        lengths = F.filter(F.sequence(F.lit(13), F.lit(37)), lambda k: (k <= most) & ((i + k > n) | at(i + k).isin(" ", "-")) & ~at(i + k - 1).isin(" ", "-"))

        def valid(k: Column) -> Column:
            return _bound(_digits(F.substring(v, i, k)), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))

        return F.array_max(F.filter(lengths, valid))

    def step(s: Column, i: Column) -> Column:
        begins = (i >= s["next"]) & ~at(i).isin(" ", "-") & ((i == 1) | at(i - 1).isin(" ", "-"))
        taken = _bound(
            F.when(begins, length(i)),
            lambda k: F.when(
                k.isNotNull(),
                F.struct((i + k).alias("next"), F.concat(s["out"], F.substring(v, s["next"], i - s["next"]), _card(F.substring(v, i, k), key)).alias("out")),
            ),
        )
        return F.coalesce(taken, s)

    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.concat(s["out"], F.substring(v, s["next"], n)))


def _rest97(text: Column) -> Column:
    """Value modulo 97 of an IBAN that was turned round, letters as 10-35."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda r, c: F.when(F.lit(DIGITS).contains(c) & (c != ""), (r * 10 + F.instr(F.lit(DIGITS), c) - 1) % 97)
        .when(F.lit(UPPER).contains(c) & (c != ""), (r * 100 + F.instr(F.lit(UPPER), c) + 9) % 97)
        .otherwise(r)
        .cast("int"),
    )


def _iban(v: Column, key: str) -> Column:
    bare = F.regexp_replace(v, " ", "")
    country, tail = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    valid = _rest97(F.concat(tail, F.substring(bare, 1, 4))) == 1

    def checked(tail: Column) -> Column:
        check = F.lit(98) - _rest97(F.concat(tail, country, F.lit("00")))
        return laid_out(F.concat(country, F.lpad(check.cast("string"), 2, "0"), tail), v, "[A-Z0-9]")

    return F.when(valid, _bound(permuted(tail, "iban", key, (DIGITS, UPPER)), checked)).otherwise(v)


def _email(v: Column, key: str) -> Column:
    local = F.substring_index(v, "@", 1)
    moved = permuted(F.lower(local), "email", key, (DIGITS, LOWER))
    cased = F.zip_with(F.split(local, ""), F.split(moved, ""), lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b))
    return F.concat(F.array_join(cased, ""), F.lit("@"), F.substring_index(v, "@", -1))


def _phone(v: Column, key: str) -> Column:
    code = F.regexp_extract(v, CALLING_CODE, 0)
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    return F.concat(code, _bound(permuted(_digits(rest), "phone", key, (DIGITS,)), lambda d: laid_out(d, rest)))


def _ipv6(v: Column, key: str) -> Column:
    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    left, right = groups(F.substring_index(v, "::", 1)), groups(F.substring_index(v, "::", -1))
    zeros = F.lit(8) - F.size(left) - F.size(right)
    full = F.when(~v.contains("::"), groups(v)).when(zeros >= 1, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), right))
    made = permuted(F.array_join(F.transform(full, lambda g: F.lpad(F.lower(g), 4, "0")), ""), "ipv6", key, (DIGITS + LOWER[:6],))
    return F.when(full.isNull() | (v == "::"), v).otherwise(F.regexp_replace(made, "(.{4})(?!$)", "$1:"))


def _secret(v: Column, key: str) -> Column:
    made = permuted(F.lower(v), "secret", key, (DIGITS + LOWER[:6],))
    return F.when(F.upper(v) == v, F.upper(made)).otherwise(made)


def _after(pattern: str, kind: str):
    """Keeps what ``pattern`` matches at the beginning and permutes the rest."""

    def make(v: Column, key: str) -> Column:
        head = F.regexp_extract(v, f"^{pattern}", 0)
        return F.concat(head, permuted(F.substring(v, F.length(head) + 1, F.length(v)), kind, key))

    return make


def _pem(v: Column, key: str) -> Column:
    part = r"^(-----BEGIN [A-Z ]*-----)([^-]*)(-----END [A-Z ]*-----)$"
    return F.concat(F.regexp_extract(v, part, 1), permuted(F.regexp_extract(v, part, 2), "pem", key), F.regexp_extract(v, part, 3))


def kind_of(v: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, form in reversed(FORMS.items()):
        out = F.when(v.rlike(f"^(?:{form})$"), kind).otherwise(out)
    return out


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one found value, or the value where its test fails."""
    makers = {"email": _email, "ip": _ip, "ipv6": _ipv6, "date": _date, "phone": _phone, "iban": _iban, "card": _cards, "secret": _secret, "pem": _pem}
    makers |= {"ssn": lambda x, k: laid_out(permuted(_digits(x), "ssn", k, (DIGITS,)), x), "token": _after(TOKEN_PREFIX, "token"), "jwt": _after("eyJ", "jwt")}
    return _bound(
        kind_of(v),
        lambda kind: F.coalesce(*[F.when(kind == k, makers[k](v, key)) for k in FORMS], v),
    )


def pseudonymised(docs: DataFrame, *, key: str, text: str = "text", changes: str | None = None) -> DataFrame:
    """The rows of ``docs`` with ``text`` pseudonymised; ``changes`` names a column array<struct<was,now>> to add.

    Texts without any of ``SCAN`` hold none of the forms and are passed on after one quick scan.
    """
    if not key:
        raise ValueError(f"a key is required, see {SETTING}")
    if changes in docs.columns:
        raise ValueError(f"the table has a column {changes} already")
    held = changes or "changes_"
    while held in docs.columns:
        held += "_"
    body = F.col(f"`{text}`")
    found = F.when(body.rlike(SCAN), F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    pairs = F.transform(found, lambda v: F.struct(v.alias("was"), pseudonym(v, key).alias("now")))
    out = docs.withColumn(held, F.when(F.size(found) > 0, pairs))
    pieces = F.zip_with(F.split(body, ANY, -1), F.col(f"`{held}`.now"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    out = out.withColumn(text, F.when(F.col(f"`{held}`").isNotNull(), F.array_join(pieces, "")).otherwise(body))
    return out if changes else out.drop(held)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pseudonymised(docs.select("doc_id", "text"), key=key_of(spark), changes="changes")
    changed = F.filter(F.coalesce("changes", F.array().cast("array<struct<was:string,now:string>>")), lambda p: p["was"] != p["now"])
    return out.select("doc_id", "text", F.size(changed).cast("long").alias("n_replaced"))


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
