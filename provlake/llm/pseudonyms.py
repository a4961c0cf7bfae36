"""Operator 6, PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their kind's validation are replaced by another valid value of
the same format, by a keyed permutation: a Feistel network of ROUNDS rounds whose round
function is SHA-256 over key, kind, round and the other half. Equal values have equal
pseudonyms wherever they stand, different values of a kind different ones, and nothing is
stored or joined.

| kind | validation | what stays | permuted |
| - | - | - | - |
| card | 13 to 19 digits, or four groups of four; Luhn | first digit, grouping, Luhn validity | the digits between first and check digit |
| phone | ten digits in a North American format | country code, first digits of area and exchange, punctuation | the other eight digits |
| ssn | area, group and serial in range | dashes, ranges | all three parts |
| date | a date of 1900 to 2099, as y-m-d or m-d-y (d-m-y where only that is valid) with -, / or . | order and separators | the day, within these years |
| ip | four octets up to 255 | dots | 32 bits |
| email | a local part and a domain with a dot | domain, punctuation, kind of each character | letters and digits of the local part |

A d-m-y date becomes a d-m-y date; it stays linked, but as text may equal the pseudonym of
an m-d-y date.

Defined results: a null text stays null and an empty one empty; numbers that fail their
validation stay as they are; repeated rows each get theirs; of overlapping matches the
first counts; very long texts are taken whole; an empty table gives no rows; other columns,
whatever their names, are kept. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import unused

ROUNDS = 10
#: days of 1900 to 2099: DATE_LEFT * DATE_RIGHT
DATE_LEFT, DATE_RIGHT = 17, 4297
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9])"
ANY = "|".join([EMAIL, PHONE, SSN, DATE, IP, CARD])


def _round(key: str, kind: str, i: Column, x: Column) -> Column:
    """A 60-bit value of the round."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """struct(l, r): a permutation of the pairs l < a, r < b."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def step(s, i):
        even = F.struct(F.pmod(s["l"] + F.pmod(_round(key, kind, i, s["r"]), a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_round(key, kind, i, s["l"]), b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _shift(c: Column, by: Column) -> Column:
    """The character moved within its kind: digits, small and capital letters."""
    code = F.ascii(c)
    out = F.when(c.rlike("[0-9]"), F.chr(48 + F.pmod(code - 48 + F.pmod(by, F.lit(10)), F.lit(10))))
    for first in (97, 65):
        out = out.when(code.between(first, first + 25), F.chr(first + F.pmod(code - first + F.pmod(by, F.lit(26)), F.lit(26))))
    return out.otherwise(c)


def feistel_text(key: str, kind: str, text: Column) -> Column:
    """The same permutation over the characters of two halves, each kept to its kind."""
    half = F.floor(F.length(text) / 2).cast("int")

    def moved(x, other, i):
        each = F.transform(F.sequence(F.lit(1), F.length(x)), lambda j: _shift(F.substr(x, j, F.lit(1)), _round(key, kind, F.concat_ws(".", i.cast("string"), j.cast("string")), other)))
        return F.when(F.length(x) == 0, x).otherwise(F.array_join(each, ""))

    def step(s, i):
        return F.when(i % 2 == 0, F.struct(moved(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], s["l"], i).alias("r")))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r")), step)
    return F.concat(out["l"], out["r"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _formatted(x: Column, digits: Column) -> Column:
    """x with its digits replaced by these, in order."""
    place = lambda i: F.when(F.substr(x, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(x, F.lit(1), i))), F.lit(1))).otherwise(F.substr(x, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), place), "")


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def check_digit(payload: Column) -> Column:
    """Luhn's, of the digits before it."""

    def add(total, i):
        x = F.substr(payload, F.length(payload) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.pmod(10 - F.pmod(F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add), F.lit(10)), F.lit(10))


def _card(key: str, x: Column, d: Column) -> Column:
    n = F.length(d)
    u = F.floor((n - 2) / 2).cast("int")
    v = n - 2 - u
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    new = feistel(key, "card", F.substr(d, F.lit(2), u), F.substr(d, u + 2, v), power(u), power(v))
    payload = F.element_at(F.transform(F.array(new), lambda p: F.concat(F.substr(d, F.lit(1), F.lit(1)), _padded(p["l"], u), _padded(p["r"], v))), 1)
    whole = F.element_at(F.transform(F.array(payload), lambda p: F.concat(p, check_digit(p).cast("string"))), 1)
    valid = check_digit(F.substr(d, F.lit(1), n - 1)) == F.substr(d, n, F.lit(1)).cast("int")
    return F.when(valid, _formatted(x, whole)).otherwise(x)


def _phone(key: str, x: Column, d: Column) -> Column:
    lead = F.substr(d, F.lit(1), F.length(d) - 10)
    ten = F.substr(d, F.length(d) - 9, F.lit(10))
    at = lambda i, n: F.substr(ten, F.lit(i), F.lit(n))
    new = feistel(key, "phone", F.concat(at(2, 2), at(5, 2)), at(7, 4), 10_000, 10_000)
    whole = lambda p: F.concat(lead, at(1, 1), F.substr(_padded(p["l"], 4), F.lit(1), F.lit(2)), at(4, 1), F.substr(_padded(p["l"], 4), F.lit(3), F.lit(2)), _padded(p["r"], 4))
    return _formatted(x, F.element_at(F.transform(F.array(new), whole), 1))


def _ssn(key: str, x: Column, d: Column) -> Column:
    area, group, serial = (F.substr(d, F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas
    new = feistel(key, "ssn", place * 99 + group - 1, serial - 1, 898 * 99, 9_999)

    def whole(p):
        k = F.floor(p["l"] / 99)
        return F.concat(_padded(k + 1 + F.when(k >= 665, 1).otherwise(0), 3), _padded(F.pmod(p["l"], F.lit(99)) + 1, 2), _padded(p["r"] + 1, 4))

    return F.when(valid, _formatted(x, F.element_at(F.transform(F.array(new), whole), 1))).otherwise(x)


def _date(key: str, x: Column, d: Column) -> Column:
    def part(i, n):
        return F.substr(d, F.lit(i), F.lit(n)).cast("int")

    def valid(y, m, day):
        return F.when(y.between(1900, 2099) & m.between(1, 12), day.between(1, F.day(F.last_day(F.make_date(y, m, F.lit(1)))))).otherwise(False)

    def new(y, m, day, pattern):
        k = F.date_diff(F.make_date(y, m, day), F.lit("1900-01-01").cast("date"))
        p = feistel(key, "date", F.floor(k / DATE_RIGHT), F.pmod(k, F.lit(DATE_RIGHT)), DATE_LEFT, DATE_RIGHT)
        moved = F.transform(F.array(p), lambda q: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (q["l"] * DATE_RIGHT + q["r"]).cast("int")), pattern))
        return _formatted(x, F.element_at(moved, 1))

    iso, us, eu = (part(1, 4), part(5, 2), part(7, 2)), (part(5, 4), part(1, 2), part(3, 2)), (part(5, 4), part(3, 2), part(1, 2))
    first = x.rlike("^[0-9]{4}[-/.]")
    return F.when(first & valid(*iso), new(*iso, "yyyyMMdd")).when(~first & valid(*us), new(*us, "MMddyyyy")).when(~first & valid(*eu), new(*eu, "ddMMyyyy")).otherwise(x)


def _ip(key: str, x: Column, d: Column) -> Column:
    part = lambda i: F.split_part(x, F.lit("."), F.lit(i)).cast("int")
    valid = (part(1) <= 255) & (part(2) <= 255) & (part(3) <= 255) & (part(4) <= 255)
    new = feistel(key, "ip", part(1) * 256 + part(2), part(3) * 256 + part(4), 65_536, 65_536)
    whole = lambda p: F.concat_ws(".", *[y.cast("string") for h in ("l", "r") for y in (F.floor(p[h] / 256), F.pmod(p[h], F.lit(256)))])
    return F.when(valid, F.element_at(F.transform(F.array(new), whole), 1)).otherwise(x)


def _email(key: str, x: Column, d: Column) -> Column:
    return F.concat(feistel_text(key, "email", F.split_part(x, F.lit("@"), F.lit(1))), F.lit("@"), F.split_part(x, F.lit("@"), F.lit(2)))


def pseudonym(key: str, x: Column) -> Column:
    """What replaces a match of ANY."""
    d = _digits(x)
    whole = lambda pattern: x.rlike(f"^(?:{pattern})$")
    out = F.when(F.instr(x, "@") > 0, _email(key, x, d))
    for pattern, made in ((PHONE, _phone), (SSN, _ssn), (DATE, _date), (IP, _ip), (CARD, _card)):
        out = out.when(whole(pattern), made(key, x, d))
    return out.otherwise(x)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with text in pseudonyms, and how many values were replaced: n_replaced, or with underscores before it if docs has such a column."""
    text = F.col("row.text")
    rows = docs.select(F.struct("*").alias("row"))
    found = rows.select("row", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("found"))
    made = found.withColumn("made", F.when(F.size("found") > 0, F.transform("found", lambda x: pseudonym(key, x))))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat("made", F.array(F.lit(""))), lambda p, v: F.concat(p, v)), "")
    new = F.when(F.col("made").isNotNull(), joined).otherwise(text)
    changed = F.size(F.filter(F.zip_with("found", "made", lambda a, b: a != b), lambda x: x))
    (counted,) = unused(docs, "n_replaced")
    return made.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], F.when(F.col("made").isNotNull(), changed).otherwise(0).cast("long").alias(counted))
