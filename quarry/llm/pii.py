"""Personal data replaced by format-preserving pseudonyms, in built-in functions only.

Digits are permuted by a keyed ten-round Feistel network over their own number of digits, letters and
digits of names each among their kind, so the pseudonym has the same format and length, equal values
get equal pseudonyms in every document, and different values of one format different ones.  (Letters
of an address beyond ASCII and Latin-1 become keyed ASCII letters, which are not one-to-one.)  Only
validated values are touched:

========  ==========================================  =======================================
kind      validated by                                pseudonym
========  ==========================================  =======================================
card      13 to 19 digits, Luhn sum                   permuted digits, new check digit
iban      remainder 1 modulo 97                       permuted digits, new check digits
phone     country code, area in brackets, national    permuted digits after the country code or
          form with its separators                    leading zero
ssn       area, group and serial in use               permuted digits
ip        four numbers up to 255                      permuted 32-bit address
date      a day of 1900 to 2099                       permuted day of these years that the same
                                                      notation and number of digits can write
email     local part, ``@``, domain with a dot        permuted letters and digits, same domain
secret    named token with a digit, quoted or         permuted letters and digits, hexadecimal
          quoted hexadecimal                          ones among their own
========  ==========================================  =======================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DEFAULT_KEY = "quarry-pseudonyms"

_START = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
#: In the order in which they are tried at a place.
PATTERNS = {
    "secret": r"(?:(?<!\p{L})(?i:(?:access|api|auth|bearer|client|private|refresh)?[_-]?(?:token|secret|password|passwd|pwd|key))[\"']?\s?[:=]\s?(?:[\"'][A-Za-z0-9_\-/+]{16,}|(?=[A-Za-z_\-/+]*[0-9])[A-Za-z0-9_\-/+]{16,})|\"[0-9A-Fa-f]{32,64}\")",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": _START + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "phone": r"(?:\+[0-9]{1,3}(?:[ ./-]?(?:\([0-9]{1,4}\)|[0-9]{2,5})){2,6}|(?<![\p{L}\p{N}(+])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|(?<![\p{L}\p{N}.+/-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|0[0-9]{1,4}[/-][0-9]{5,8}|0[1-9](?:[ .][0-9]{2}){4}))(?![\p{L}\p{N}]|[./-][0-9])",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?!(?!T[0-9]{2})[\p{L}\p{N}]|[./-][0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "card": r"(?<![\p{L}\p{N}.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}]|\.[0-9])",
}
ANY = "|".join(PATTERNS.values())
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Kinds of characters that are permuted among themselves.
NAMES = (_DIGITS, _LOWER, _UPPER, "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
HEXADECIMAL = (_DIGITS, "abcdef", "ABCDEF")
#: Steps in which a day walks on until the notation can write it; odds of 1e-34 that it still can't.
WALK = 400


def _long(value: Column) -> Column:
    return value.cast("bigint")


def _round(value: Column, step: Column, key: str, label: Column) -> Column:
    """60 keyed bits of one half, as a number."""
    mixed = F.sha2(F.concat_ws("\x1f", F.lit(key), label, step.cast("string"), value.cast("string")).cast("binary"), 256)
    return _long(F.conv(F.substring(mixed, 1, 15), 16, 10))


def feistel(left: Column, right: Column, modulus_l: Column, modulus_r: Column, key: str, label: Column) -> Column:
    """struct<a,b>: the pair (left, right) permuted among all pairs below their moduli.  Each round
    adds a keyed number of one half to the other; both halves are changed five times."""
    step = lambda s, i: F.when(
        i % 2 == 0, F.struct(F.pmod(s["a"] + F.pmod(_round(s["b"], i, key, label), modulus_l), modulus_l).alias("a"), s["b"].alias("b"))
    ).otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + F.pmod(_round(s["a"], i, key, label), modulus_r), modulus_r).alias("b")))
    start = F.struct(_long(left).alias("a"), _long(right).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, key: str, label: str) -> Column:
    """A string of two or more decimal digits (30 at most), permuted among all of its length."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    rest = n - half
    size = lambda k: _long(F.concat(F.lit("1"), F.repeat(F.lit("0"), k)))
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, rest)
    out = feistel(left, right, size(half), size(rest), key, F.concat(F.lit(label), n.cast("string")))
    return F.transform(F.array(out), lambda s: F.concat(F.lpad(s["a"].cast("string"), half, F.lit("0")), F.lpad(s["b"].cast("string"), rest, F.lit("0"))))[0]


def permute_names(text: Column, key: str, label: Column, kinds: tuple[str, ...]) -> Column:
    """A string with each character permuted among those of its kind, the others left alone.  The halves
    of the string take the place of numbers: each round shifts every character of one of them by a
    keyed number of the other."""

    def moved(c: Column, by: Column) -> Column:
        out = F.when(c.rlike("[^\\p{L}]"), c).otherwise(F.substr(F.lit(_LOWER), by % 26 + 1, F.lit(1)))
        for kind in reversed(kinds):
            at = F.instr(F.lit(kind), c)
            out = F.when(at > 0, F.substr(F.lit(kind), (at - 1 + by) % len(kind) + 1, F.lit(1))).otherwise(out)
        return out

    def shifted(half: Column, other: Column, step: Column) -> Column:
        """The other half is hashed once; 16 numbers come from each hash of that and a block's place."""
        hashed = F.sha2(F.concat_ws("\x1f", F.lit(key), label, step.cast("string"), other).cast("binary"), 256)
        places = F.sequence(F.lit(0), (F.length(half) / 16).cast("int"))
        block = lambda seed, b: F.sha2(F.concat(seed, F.lit(":"), b.cast("string")).cast("binary"), 256)
        cut = lambda h: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.conv(F.substr(h, 4 * j + 1, F.lit(4)), 16, 10).cast("int"))
        numbers = F.transform(F.array(hashed), lambda seed: F.flatten(F.transform(places, lambda b: cut(block(seed, b)))))
        made = F.transform(numbers, lambda by: F.array_join(F.transform(F.split(half, ""), lambda c, i: moved(c, by[i])), ""))[0]
        return F.when(F.length(half) > 0, made).otherwise(half)

    step = lambda s, i: F.when(
        i % 2 == 0, F.struct(shifted(s["a"], s["b"], i).alias("a"), s["b"].alias("b"))
    ).otherwise(F.struct(s["a"].alias("a"), shifted(s["b"], s["a"], i).alias("b")))
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(shape: Column, digits: Column) -> Column:
    """The string ``shape`` with its digits replaced, one by one, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    put = lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["used"] + 1, F.lit(1))).alias("out"), (s["used"] + 1).alias("used"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["used"].alias("used")))
    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum over the digits from the right, every second one doubled (less nine above nine)."""
    term = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: term(c.cast("int"), i))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """Remainder of the number that digits and letters (A is 10) spell."""
    ahead = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), ahead)


def _card(value: Column, key: str) -> Column:
    digits = digits_of(value)
    body = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))[0]
    return F.when(luhn_sum(digits) % 10 == 0, refill(value, check))


def _iban(value: Column, key: str) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    rest = F.substr(plain, F.lit(5), F.length(plain))
    many = F.length(digits_of(rest)) >= 2
    body = F.when(many, refill(rest, permute_digits(digits_of(rest), key, "iban"))).otherwise(rest)
    made = F.transform(F.array(body), lambda b: F.concat(F.lpad((98 - mod97(F.concat(b, F.substr(plain, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), digits_of(b)))[0]
    valid = mod97(F.concat(rest, F.substr(plain, F.lit(1), F.lit(4)))) == 1
    return F.when(valid & many, refill(value, made))


def _phone(value: Column, key: str) -> Column:
    """The country code (one digit, what stands before a separator, or two digits) or the leading zero of
    a national form stays; with a country code there are 8 to 15 digits in all."""
    lead = F.regexp_extract(value, r"^(\+(?:[17]|[0-9]{1,3}(?=[ ./(-])|[0-9]{2})|0[1-9](?=[ .])|0(?=[0-9]{1,4}[/-][0-9]{5}))", 1)
    body = F.substr(value, F.length(lead) + 1, F.length(value))
    valid = ~F.startswith(value, F.lit("+")) | F.length(digits_of(value)).between(8, 15)
    return F.when(valid, F.concat(lead, refill(body, permute_digits(digits_of(body), key, "phone"))))


def _ssn(value: Column, key: str) -> Column:
    valid = ~value.rlike("^(000|666|9..)-|-00-|-0000$")
    return F.when(valid, refill(value, permute_digits(digits_of(value), key, "ssn")))


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, "[.]"), lambda p: p.cast("int"))
    word = F.lit(65536).cast("bigint")
    out = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], word, word, key, F.lit("ip"))
    text = F.transform(F.array(out), lambda s: F.concat_ws(".", *(F.floor(x / 256).cast("string") if high else (x % 256).cast("string") for x in (s["a"], s["b"]) for high in (True, False))))[0]
    return F.when(F.forall(parts, lambda p: p <= 255), text)


def _date(value: Column, key: str) -> Column:
    """Day before month but in ISO dates, and where only month before day makes a date.

    Days of 1900 to 2099 number 73049 = 283 * 258 + 35, which is no product of suitable halves; the
    day goes through a network over 271 * 270 = 73170 pairs, again while it lands on a pair that is no
    day or on a day that the notation can't write with as many digits."""
    iso, slash = value.rlike("^[0-9]{4}-"), value.rlike("/")
    fields = F.split(value, "[-./]")
    american = slash & (fields[1].cast("int") > 12)
    part = lambda in_iso, in_american, other: F.when(iso, fields[in_iso]).when(american, fields[in_american]).otherwise(fields[other])
    y, m, d = part(0, 2, 2), part(1, 0, 1), part(2, 1, 0)
    first = F.lit("1900-01-01").cast("date")
    number = F.datediff(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), first)
    rows, columns = F.lit(271).cast("bigint"), F.lit(270).cast("bigint")
    once = lambda x: F.transform(F.array(feistel(F.floor(x / 270), x % 270, rows, columns, key, F.lit("date"))), lambda s: s["a"] * 270 + s["b"])[0]
    on = lambda x: F.date_add(first, x.cast("int"))

    def fits(x: Column) -> Column:
        day, month = F.dayofmonth(on(x)), F.month(on(x))
        return (x >= 0) & (x < 73049) & ((F.length(d) == 2) | (day < 10)) & ((F.length(m) == 2) | (month < 10)) & (~american | (day > 12))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _long(F.lit(-1)), lambda s, i: F.when(fits(s), s).otherwise(once(F.when(s < 0, _long(number)).otherwise(s))))

    def written(x: Column) -> Column:
        year = F.year(on(x)).cast("string")
        day, month = F.lpad(F.dayofmonth(on(x)).cast("string"), F.length(d), F.lit("0")), F.lpad(F.month(on(x)).cast("string"), F.length(m), F.lit("0"))
        dot = F.when(slash, "/").otherwise(".")
        other = F.concat(F.when(american, month).otherwise(day), dot, F.when(american, day).otherwise(month), dot, year)
        return F.when(fits(x), F.when(iso, F.concat_ws("-", year, month, day)).otherwise(other))

    return F.when(number.between(0, 73048), F.transform(F.array(walk), written)[0])


def _email(value: Column, key: str) -> Column:
    local = F.regexp_extract(value, "^([^@]*)@", 1)
    domain = F.substr(value, F.length(local) + 1, F.length(value))
    return F.concat(permute_names(local, key, F.concat(F.lit("email"), domain), NAMES), domain)


def _secret(value: Column, key: str) -> Column:
    lead = F.regexp_extract(value, r"^(.*?[:=]\s?[\"']?|\")[^:=\"']+\"?$", 1)
    body = F.regexp_extract(value, r"^(?:.*?[:=]\s?[\"']?|\")([^:=\"']+)\"?$", 1)
    permuted = lambda kinds: permute_names(body, key, F.lit("secret"), kinds)
    made = F.when(body.rlike("^[0-9A-Fa-f]+$"), permuted(HEXADECIMAL)).otherwise(permuted(NAMES))
    return F.when(F.length(body) > 0, F.concat(lead, made, F.when(value.endswith('"'), F.lit('"')).otherwise(F.lit(""))))


_MAKERS = {"secret": _secret, "email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}


def _whole(kind: str) -> str:
    """The pattern of a kind for a value on its own."""
    return f"^(?:{PATTERNS[kind]})$"


def judged(value: Column, key: str) -> Column:
    """struct<kind, pseudonym> of one found string; nulls where it fails validation."""
    fields = lambda kind, made: F.struct(F.when(made.isNotNull(), F.lit(kind)).alias("kind"), made.alias("pseudonym"))
    out = None
    for kind, make in _MAKERS.items():
        test = value.rlike(_whole(kind))
        out = F.when(test, fields(kind, make(value, key))) if out is None else out.when(test, fields(kind, make(value, key)))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("pseudonym")))


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """The documents with their text rewritten, and a column pii_findings:
    array<struct<kind, value_chars, pseudonym>> in text order.

    Each row is rewritten by itself, whatever its length.  A null text stays null without findings;
    empty tables, repeated rows and other columns of any name pass unchanged (a column named
    pii_findings is replaced)."""
    text = F.col("text")
    some = text.rlike(r"[0-9@]|(?i:token|secret|passw|pwd|key)")
    found = F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    # the caller's columns travel in a struct, so that none can clash with the steps' own
    pair = docs.drop("pii_findings").select(F.struct("*").alias("row"), "text", found.alias("found"))
    hits = F.transform(F.col("found"), lambda m: F.struct(m.alias("value"), judged(m, key).alias("j")))
    step = pair.select("row", "text", F.when(F.size("found") > 0, hits).alias("hits"))
    swapped = F.transform(F.col("hits"), lambda h: F.coalesce(h["j"]["pseudonym"], h["value"]))
    parts = F.zip_with(F.split(text, ANY), swapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    listed = F.transform(F.filter(F.col("hits"), lambda h: h["j"]["kind"].isNotNull()), lambda h: F.struct(h["j"]["kind"].alias("kind"), F.length(h["value"]).alias("value_chars"), h["j"]["pseudonym"].alias("pseudonym")))
    none = F.array().cast("array<struct<kind:string,value_chars:int,pseudonym:string>>")
    rewritten = F.when(F.col("hits").isNotNull(), F.array_join(parts, "")).otherwise(text)
    return step.select(F.col("row").withField("text", rewritten).alias("row"), F.coalesce(listed, none).alias("pii_findings")).select("row.*", "pii_findings")
