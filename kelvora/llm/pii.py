"""Format-preserving pseudonyms for personal data, as DataFrame expressions only.

Each value found in a text is validated and permuted within its own format by a keyed Feistel network, so the same
value has the same pseudonym in every document and no table of values is kept. Numbers are split into two halves
modulo a and b, and each half in turn is moved by a keyed hash of the other: a permutation of 0 .. a*b-1 whatever
a and b are, so no value leaves its format and none has to be walked back into it.

  card     13 to 19 digits in one run, or in groups as on cards, that pass the Luhn test: all but the last digit are
           permuted, and the last makes the number pass again
  iban     country, two check digits that hold and the rest: the rest is moved within its kinds, the check is made anew
  phone    +country and ten digits, (three) and seven, or three-three-four: the ten are permuted, signs stay
  ssn      three, two and four digits of an assigned range: permuted among the numbers of such ranges
  ip       four octets up to 255: the 32 bits are permuted; eight groups of hexadecimal digits, or fewer around one ::,
           digits moved
  date     yyyy-mm-dd, yyyy/mm/dd or dd.mm.yyyy of 1900 to 2099 that the calendar has: permuted among those days
  email    the local part: letters and digits are moved within their kind; the domain stays
  secret   access keys, passwords and tokens with a named prefix, in small letters or capitals: as the local part

Candidates that fail their check (a Luhn sum, an octet of 256, 30 February, an SSN of area 000) stay as they are.

Defined results: a null text stays null; a text without candidates is returned as it is; empty and very long texts, values
of any length among them, have no special way; rows that repeat get the same text; a table without rows gives none;
columns other than text are kept, whatever their names, with n_chars following the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvora.llm.common import table, unused

KEY = "kelvora"
ROUNDS = 6
#: What may be personal, one alternative a kind; a match is told apart by its own form below.
PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])(?i:password|passwd) ?[=:] ?\"?[^\s\"]{7,}[^\s\".,;:!?)]",
        r"(?<![A-Za-z0-9])(?i:token|secret|api_key) ?[=:] ?\"?[A-Za-z0-9_\-]{8,}+",
        r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9.\-]{0,251}[A-Za-z0-9])?\.[A-Za-z]{2,24}",
        r"\+\d{1,3}[ \-.]?\(?\d{3}\)?[ \-.]?\d{3}[ \-.]?\d{4}(?!\d)",
        r"(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
        r"(?<![\w\-.])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w\-]|\.\d)",
        r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
        r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
        r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])",
        r"(?<![\d\-])(?:19|20)\d\d-\d\d-\d\d(?![\d\-])",
        r"(?<![\d/])(?:19|20)\d\d/\d\d/\d\d(?![\d/])",
        r"(?<![\d.])\d\d\.\d\d\.(?:19|20)\d\d(?!\d|\.\d)",
        r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
        r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
        r"(?<![\w\-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})(?![\w\-])",
    )
)
#: The days from 1900-01-01 to 2099-12-31 are the product of these, so that a day moves to one of them.
_DATE_FACTORS = (17, 4297)
_CALENDAR_DAYS = 73_049


def _moved(own: Column, other: Column, m: int, i: Column, tweak: str, key: str) -> Column:
    """own, moved modulo m by 52 bits of a keyed digest of the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other.cast("string")), 256)
    return F.pmod(own + F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), F.lit(m))


def _feistel(x: Column, y: Column, a: int, b: int, tweak: str, key: str, rounds: int, finish) -> Column:
    """Rounds are an array fold, so that an expression stays as small as one of them."""

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(
            F.when(even, _moved(s["x"], s["y"], a, i, tweak, key)).otherwise(s["x"]).cast("long").alias("x"),
            F.when(even, s["y"]).otherwise(_moved(s["y"], s["x"], b, i, tweak, key)).cast("long").alias("y"),
        )

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, finish)


def feistel(value: Column, a: int, b: int, tweak: str, key: str = KEY, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. a*b-1."""
    return _feistel(F.floor(value / F.lit(b)), F.pmod(value, F.lit(b)), a, b, tweak, key, rounds, lambda s: s["x"] * F.lit(b) + s["y"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _put(text: Column, digits: Column) -> Column:
    """text with its digits replaced by these, in order."""
    parts = F.split(F.regexp_replace(text, r"\d", "\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.substring(digits, i, F.lit(1)), p))), "")


def _luhn(digits: Column) -> Column:
    """The remainder of the Luhn sum."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def _pad(number: Column, n: int) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def _number(digits: Column, n: int, tweak: str, key: str) -> Column:
    """n digits as n digits."""
    left, right = n - n // 2, n // 2
    x, y = F.substring(digits, 1, left), F.substring(digits, left + 1, right)
    return _feistel(x, y, 10**left, 10**right, f"{tweak}{n}", key, ROUNDS, lambda s: F.concat(_pad(s["x"], left), _pad(s["y"], right)))


def card(m: Column, key: str) -> Column:
    digits = _digits(m)
    own = F.lit(None).cast("string")
    for n in range(12, 19):
        own = F.when(F.length(digits) == n + 1, _number(F.substring(digits, 1, n), n, "card", key)).otherwise(own)
    # The last digit isn't doubled, so it alone makes the sum pass.
    last = F.pmod(-_luhn(F.concat(own, F.lit("0"))), F.lit(10))
    return F.when(_luhn(digits) == 0, _put(m, F.concat(own, last.cast("string")))).otherwise(m)


def _mod97(text: Column) -> Column:
    """The remainder of letters as 10 to 35 and digits as themselves, one after another."""

    def add(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.pmod(F.when(v >= 65, acc * 100 + v - 55).otherwise(acc * 10 + v - 48), F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def iban(m: Column, key: str) -> Column:
    country, rest = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))
    valid = _mod97(F.concat(rest, F.substring(m, 1, 4))) == 1
    new = letters(rest, "iban", key)
    made = F.transform(F.array(new), lambda r: F.concat(country, _pad(98 - _mod97(F.concat(r, country, F.lit("00"))), 2), r))[0]
    return F.when(valid, made).otherwise(m)


def phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    code = F.length(digits) - 10
    return _put(m, F.concat(F.substring(digits, F.lit(1), code), _number(F.substring(digits, code + 1, F.lit(10)), 10, "phone", key)))


def ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99 and serials 0001 to 9999, as one number."""
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    x = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

    def put(s: Column) -> Column:
        n = F.floor(s["x"] / 99) + 1
        return F.concat_ws("-", _pad(n + F.when(n >= 666, 1).otherwise(0), 3), _pad(F.pmod(s["x"], F.lit(99)) + 1, 2), _pad(s["y"] + 1, 4))

    fine = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    return F.when(fine, _feistel(x, serial - 1, 898 * 99, 9999, "ssn", key, ROUNDS, put)).otherwise(m)


def ip(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    new = feistel(value, 65536, 65536, "ip", key)
    dotted = F.transform(F.array(new), lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))[0]
    return F.when(F.forall(octets, lambda x: x.cast("int") <= 255), dotted).otherwise(m)


def ip6(m: Column, key: str) -> Column:
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    return F.when((groups == 8) & ~m.contains("::") | (groups <= 7) & m.contains("::"), letters(m, "ip6", key, hexadecimal=True)).otherwise(m)


#: How a date is written: a test of the match, and Spark's pattern.
DATES = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d\d\.", "dd.MM.yyyy"))


def date(m: Column, key: str) -> Column:
    out = m
    for like, form in DATES:
        parsed = F.try_to_timestamp(m, F.lit(form)).cast("date")
        number = F.date_diff(parsed, F.lit("1900-01-01").cast("date")).cast("long")
        moved = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), feistel(number, *_DATE_FACTORS, "date", key).cast("int")), form)
        out = F.when(m.rlike(like), F.when(parsed.isNull() | (number < 0) | (number >= _CALENDAR_DAYS), m).otherwise(moved)).otherwise(out)
    return out


def letters(m: Column, tweak: str, key: str, hexadecimal: bool = False) -> Column:
    """Characters moved within their kind (a-z, A-Z, 0-9; or hexadecimal digits), half against half; all else stays in its
    place. Hexadecimal digits come out in small letters, so capitals have to be made small before they are compared."""
    n = F.length(m)
    cut = F.floor(n / 2).cast("int")

    def moved(own: Column, other: Column, i: Column) -> Column:
        pad = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), n.cast("string"), i.cast("string"), other), 256)

        def one(c: Column, j: Column) -> Column:
            step = F.conv(F.substring(F.sha2(F.concat_ws("|", pad, F.floor(j / 16).cast("string")), 256), F.pmod(j, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            shift = lambda low, size: F.char(F.pmod(code - low + step, F.lit(size)) + low)
            if hexadecimal:
                return F.when(c == ":", c).otherwise(F.lower(F.hex(F.pmod(F.conv(c, 16, 10).cast("int") + step, F.lit(16)))))
            return F.when(c.rlike("[a-z]"), shift(97, 26)).when(c.rlike("[A-Z]"), shift(65, 26)).when(c.rlike("[0-9]"), shift(48, 10)).otherwise(c)

        return F.when(F.length(own) == 0, own).otherwise(F.array_join(F.transform(F.split(own, ""), one), ""))

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, moved(s["x"], s["y"], i)).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(moved(s["y"], s["x"], i)).alias("y"))

    # A single character has no other half; the pad then hangs on the key alone, still a permutation.
    text = F.lower(m) if hexadecimal else m
    start = F.struct(F.substring(text, F.lit(1), cut).alias("x"), F.substring(text, cut + 1, n).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["x"], s["y"]))


def email(m: Column, key: str) -> Column:
    return F.concat(letters(F.substring_index(m, "@", 1), "email", key), F.lit("@"), F.substring_index(m, "@", -1))


def secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:AKIA|[A-Za-z_]+ ?[=:] ?\"?)", 0)
    return F.concat(head, letters(F.substring(m, F.length(head) + 1, F.length(m)), "secret", key))


#: Kinds in the order in which a match is told apart.
KINDS = (
    ("secret", lambda m: m.rlike(r"^(?:AKIA[A-Z0-9]{16}$|(?i:password|passwd|token|secret|api_key) ?[=:])"), secret),
    ("email", lambda m: m.contains("@"), email),
    ("phone", lambda m: m.rlike(r"^[+(]|^\d{3}[-.]\d{3}[-.]\d{4}$"), phone),
    ("ip", lambda m: m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), ip),
    ("ip6", lambda m: m.contains(":"), ip6),
    ("date", lambda m: m.rlike(r"^\d{4}[-/]\d\d[-/]\d\d$|^\d\d\.\d\d\.\d{4}$"), date),
    ("ssn", lambda m: m.rlike(r"^\d{3}-\d\d-\d{4}$"), ssn),
    ("iban", lambda m: m.rlike(r"^[A-Z]{2}\d\d"), iban),
    ("card", lambda m: m.rlike(r"^\d(?:[ \-]?\d){12,18}$"), card),
)


def kind_of(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, fits, _ in reversed(KINDS):
        out = F.when(fits(m), F.lit(name)).otherwise(out)
    return out


def pseudonym(m: Column, key: str = KEY) -> Column:
    out = m
    for _, fits, made in reversed(KINDS):
        out = F.when(fits(m), made(m, key)).otherwise(out)
    return out


def _count(kinds: str, name: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == F.lit(name))).cast("long")


def apply(docs: DataFrame, key: str = KEY, counts: bool = False) -> DataFrame:
    """docs with pseudonyms in text. counts adds pii_<kind>, values changed of each kind, and pii_values, their number."""
    m, p, k = (unused(docs, f"pii_{x}") for x in ("found", "made", "kinds"))
    maybe = F.col("text").rlike("[0-9@]|(?i:password|passwd|token|secret|api_key)|[0-9A-Fa-f]:")
    none = F.array().cast("array<string>")
    found = docs.withColumn(m, F.when(maybe, F.regexp_extract_all("text", F.lit(PATTERN), 0)).otherwise(none))
    new = found.withColumn(p, F.when(F.size(m) > 0, F.transform(m, lambda x: pseudonym(x, key))).otherwise(none))
    parts = F.split("text", PATTERN)
    text = F.when(F.size(m) > 0, F.array_join(F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(F.get(F.col(p), i - 1), x)))), "")).otherwise(F.col("text"))
    out = new.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    if counts:
        changed = F.zip_with(m, p, lambda x, y: F.when(x != y, kind_of(x)))
        counted = out.withColumn(k, F.when(F.size(m) > 0, changed).otherwise(none))
        kept += [_count(k, n).alias(f"pii_{n}") for n, _, _ in KINDS] + [F.size(F.filter(k, lambda x: x.isNotNull())).cast("long").alias("pii_values")]
        return counted.select(*kept)
    return out.select(*kept)


def query(spark, sf_dir: str) -> DataFrame:
    names = [f"pii_{n}" for n, _, _ in KINDS]
    return apply(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True).select("doc_id", "text", *names, "pii_values")
