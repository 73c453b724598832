"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers and dates are permuted within their format by a keyed Feistel network, so that equal values stay
linked across documents and every pseudonym is a valid value of its kind: card numbers keep the Luhn check, phone
numbers of the North American plan their ranges, social security numbers their excluded areas, IP addresses their
octets, dates of 1800 to 2199 are days of those years in the notation that they had. The network alternates between
the two parts of a product of two ranges, which makes it a permutation of exactly the valid values. E-mail addresses
and credentials, which have no such numbering, get a keyed token in the same alphabet and length class.

A null text stays null, an empty one empty; texts without such values are returned unchanged; repeated rows are
treated alike; an empty table gives an empty result; columns named like the added ones are replaced, all others kept.
Digits that fail validation (no Luhn check, octets over 255, no such day) are left alone. Texts may be of any length:
every part of a pattern is bounded (an address has up to 64 characters before the @ and 254 behind it) or a run of one
class of characters, so that neither the stack nor the time of a match grows with the run that it stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.shared import unused

ROUNDS = 8
#: What is looked for, by kind (fixed values). A match may not stand inside a longer run of letters or digits.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-][A-Za-z0-9.-]{0,189}\.[A-Za-z]{2,63}"
IP = r"\d{1,3}(?:\.\d{1,3}){3}(?![.\d]{0,8}\d)"
ISO = r"\d{4}-\d{2}-\d{2}"
DAY = r"\d{1,2}[/.]\d{1,2}[/.]\d{4}"
CARD = r"\d(?:[ -]?\d){12,18}"
PHONE = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{8,15}"
SSN = r"\d{3}-\d{2}-\d{4}"
SSN_VALID = r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"
KEY = r"AKIA[0-9A-Z]{16}"
#: What is assigned to a name of a credential; a bare "key:" is prose too often.
ASSIGNED = r"(?<=(?i:(?:api|access|private|secret|auth)[_-]?key|secret|password|passwd|pwd|token)[\"']? {0,3}[:=] {0,3}[\"']?|(?i:key)[\"']? {0,3}= {0,3}[\"']?)[^\s\"'<>,;&]{4,}"
EDGE = r"(?<![A-Za-z0-9_])(?:{})(?![A-Za-z0-9_])"
ANY = EDGE.format(ASSIGNED) + "|" + EDGE.format("|".join((EMAIL, IP, ISO, DAY, SSN, PHONE.replace(r"(?:\+\d{1,3}[ .-]?)?", r"(?:(?<!\d)\+\d{1,3}[ .-]?)?", 1), CARD, KEY))) + rf"|(?<![A-Za-z0-9_]){ISO}(?=T\d)"
HINT = r"[0-9@]|(?i:key|secret|passw|pwd|token)"
START, DAYS = "1800-01-01", (189, 773)  # 400 years are 146097 = 189 x 773 days


def _whole(m: Column, pattern: str) -> Column:
    return m.rlike(f"^(?:{pattern})$")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of Z_a x Z_b as a struct (l, r): the parts take turns to be shifted by a hash of the other."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (a, b))
    shift = lambda i, x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), a, b, i, x), 256), 1, 15), 16, 10).cast("long")
    turn = lambda acc, i: F.when(i % 2 == 0, F.struct(F.pmod(acc["l"] + F.pmod(shift(i, acc["r"]), a), a).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + F.pmod(shift(i, acc["l"]), b), b).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: expressions that are named twice would be evaluated twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(value: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    out = feistel(F.substr(value, F.lit(1), half), F.substr(value, half + 1), power(half), power(n - half), key, kind)
    return let(out, lambda x: F.concat(F.lpad(x["l"].cast("string"), half, "0"), F.lpad(x["r"].cast("string"), n - half, "0")))


def luhn_sum(value: Column) -> Column:
    """Sum of digits as the Luhn check counts them, the last one undoubled."""
    places = F.filter(F.split(F.reverse(value), ""), lambda c: c != "")
    return F.aggregate(F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.lit(DOUBLED), c.cast("int")))), F.lit(0), lambda s, x: s + x)


DOUBLED = [2 * x - 9 * (x > 4) for x in range(10)]


def _laid(m: Column, new: Column) -> Column:
    """Digits put in the places of those of m."""
    place = lambda i: F.length(_digits(F.substr(m, F.lit(1), i + 1)))
    return let(new, lambda v: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(v, place(i), F.lit(1))).otherwise(c)), ""))


def _run(m: Column) -> Column:
    """(at, run): the first run of whole digit groups of m that is a valid card number, the longest first; null if none."""

    def runs(words: Column) -> Column:
        size = lambda i, n: F.length(F.array_join(F.slice(words, i + 1, n), "x"))
        start = lambda i: size(F.lit(0), i) + F.when(i > 0, 2).otherwise(1)
        piece = lambda i, j: F.struct(start(i).alias("at"), F.substr(m, start(i), size(i, j - i + 1)).alias("run"))
        last = F.size(words) - 1
        return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(last, i, F.lit(-1)), lambda j: piece(i, j))))

    valid = lambda x: let(_digits(x["run"]), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0))
    return F.get(F.filter(let(F.split(m, "[ -]"), runs), valid), F.lit(0))


def _card(m: Column, key: str) -> Column:
    return let(_run(m), lambda x: F.concat(F.substr(m, F.lit(1), x["at"] - 1), _number(x["run"], key), F.substr(m, x["at"] + F.length(x["run"]))))


def _number(m: Column, key: str) -> Column:
    body = lambda d: F.concat(F.substr(d, F.lit(1), F.lit(1)), digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return _laid(m, let(let(_digits(m), body), check))


def _phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        code = F.substr(d, F.lit(1), F.greatest(F.length(d) - 10, F.lit(0)))
        last = F.substr(d, F.greatest(F.length(d) - 9, F.lit(1)))
        area, line = F.substr(last, F.lit(1), F.lit(3)).cast("long"), F.substr(last, F.lit(4), F.lit(7)).cast("long")
        plan = let(feistel(area - 200, line - 2_000_000, 800, 8_000_000, key, "phone"), lambda out: F.concat(code, (out["l"] + 200).cast("string"), (out["r"] + 2_000_000).cast("string")))
        free = F.concat(F.substr(d, F.lit(1), F.lit(2)), digits(F.substr(d, F.lit(3)), key, "line"))
        return F.when((F.length(d) >= 10) & last.rlike("^[2-9].{2}[2-9]"), plan).otherwise(free)

    return _laid(m, let(_digits(m), new))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    out = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    first = lambda x: x["l"] + 1 + F.when(x["l"] + 1 >= 666, 1).otherwise(0)
    return let(out, lambda x: F.concat_ws("-", F.lpad(first(x).cast("string"), 3, "0"), F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0")))


def _ip(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    return let(out, lambda v: F.concat_ws(".", *(x.cast("string") for part in ("l", "r") for x in (F.floor(v[part] / 256), v[part] % 256))))


def _day_of(m: Column) -> Column:
    """The day that m notes: year first, or day and month where only that reads, else month and day; null if none."""
    def day(p: Column) -> Column:
        a, b, c = (F.try_element_at(p, F.lit(i)) for i in (1, 2, 3))
        iso = F.when(F.length(a) == 4, F.concat_ws("-", a, b, c)).when((a.try_cast("int") > 12) | m.contains("."), F.concat_ws("-", c, F.lpad(b, 2, "0"), F.lpad(a, 2, "0"))).otherwise(F.concat_ws("-", c, F.lpad(a, 2, "0"), F.lpad(b, 2, "0")))
        return F.try_to_date(iso, "yyyy-MM-dd")

    return let(F.split(m, r"[-./]"), day)


def _date(m: Column, key: str) -> Column:
    at = F.datediff(_day_of(m), F.lit(START).cast("date"))
    first = F.regexp_extract(m, r"^(\d+)", 1).cast("int")
    days = lambda x: F.date_add(F.lit(START).cast("date"), (x["l"] * DAYS[1] + x["r"]).cast("int"))
    shown = lambda new: F.when(_whole(m, ISO), F.date_format(new, "yyyy-MM-dd")).when(m.contains("."), F.date_format(new, "dd.MM.yyyy")).when(first > 12, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))
    return let(let(let(at, lambda n: feistel(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, key, "date")), days), shown)


def _token(m: Column, key: str) -> Column:
    return F.sha2(F.concat(F.lit(key), F.lit("|token|"), m), 256)


def kind_of(m: Column) -> Column:
    """The validated kind of a match, or null."""
    octet = F.forall(F.split(m, r"\."), lambda x: x.try_cast("int") <= 255)
    return (
        F.when(_whole(m, EMAIL), "email").when(_whole(m, IP), F.when(octet, "ip"))
        .when(_whole(m, f"{ISO}|{DAY}"), F.when(F.year(_day_of(m)).between(1800, 2199), "date"))
        .when(_whole(m, SSN), F.when(_whole(m, SSN_VALID), "ssn"))
        .when(_whole(m, PHONE), "phone")
        .when(_whole(m, CARD), F.when(_run(m).isNotNull(), "card"))
        .otherwise("key")
    )


def pseudonym(m: Column, key: str, kind: Column | None = None) -> Column:
    """The pseudonym of one match; one that fails validation stays as it is."""
    email = F.concat(F.substring(_token(m, key), 1, 12), F.lit("@"), F.substring_index(m, "@", -1))
    secret = F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(_token(m, key), 1, 16)))).otherwise(F.substr(_token(m, key), F.lit(1), F.length(m)))
    new = lambda k: (
        F.when(k == "email", email).when(k == "ip", _ip(m, key)).when(k == "date", _date(m, key)).when(k == "ssn", _ssn(m, key))
        .when(k == "phone", _phone(m, key)).when(k == "card", _card(m, key)).when(k == "key", secret).otherwise(m)
    )
    return let(kind_of(m), new) if kind is None else new(kind)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with `text` rewritten, and n_private, the number of values replaced, by kind in private_kinds."""
    t = F.col(text)
    found = F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    step = docs.drop("n_private", "private_kinds")
    matches, sorts, new = unused(step, "matches", "sorts", "new")
    step = step.withColumn(matches, found).withColumn(sorts, F.transform(matches, kind_of))
    step = step.withColumn(new, F.zip_with(matches, sorts, lambda m, k: pseudonym(m, key, k)))
    pieces = F.split(t, ANY, -1)
    woven = F.array_join(F.zip_with(pieces, new, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    kinds = F.filter(sorts, lambda x: x.isNotNull())
    out = step.withColumn(text, F.when(F.size(matches) > 0, woven).otherwise(t)).withColumn("n_private", F.size(kinds).cast("long")).withColumn("private_kinds", F.array_join(F.array_sort(F.array_distinct(kinds)), ","))
    return out.drop(matches, sorts, new)
