"""Format-preserving pseudonyms for personal numbers, dates and mail addresses, made by keyed Feistel networks.

A value is validated by the rules of its kind (check digits, ranges, real dates), split into two parts of a mixed radix, and
permuted by additive Feistel rounds whose round function is a keyed SHA-256. The permutation is a bijection on the valid values of
its kind, so results have the same format and validity, and equal values stay equal in all documents, however they are
punctuated. All of it is column expressions; only rows with a match do more than one scan of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.quality import let
from panelspark.llm.rows import plain

ROUNDS = 4  # each changes both parts
KINDS = ("mail", "iban", "date", "ip", "ssn", "card", "phone")

#: Characters of an IBAN after its four first, and the countries that have so many.
IBAN_LENGTHS = {
    11: ("NO",), 12: ("BE",), 14: ("DK", "FI", "FK", "FO", "GL", "NL", "SD"), 15: ("MK", "SI"), 16: ("AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"), 17: ("CH", "HR", "LI", "LV"),
    18: ("BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"), 19: ("AE", "GI", "IL", "IQ", "OM", "SO", "TL"), 20: ("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"),
    21: ("LY", "PT", "ST"), 22: ("IS", "TR"), 23: ("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"), 24: ("AL", "AZ", "BY", "CY", "DO", "GT", "HN", "HU", "LB", "NI", "PL", "SV"),
    25: ("BR", "EG", "PS", "QA", "UA"), 26: ("JO", "KW", "MU", "YE"), 27: ("MT", "SC"), 28: ("LC",), 29: ("RU",),
}
_CODES = {n: "|".join(codes) for n, codes in IBAN_LENGTHS.items()}
_LISTED = "(?:" + "|".join(f"(?:{codes})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, codes in _CODES.items()) + ")(?![A-Za-z0-9])"
#: Other codes have no known length: up to 30 characters, but not into a listed number.
_UNLISTED = rf"(?!{'|'.join(_CODES.values())})[A-Z]{{2}}[0-9]{{2}}(?: ?(?!(?<![A-Za-z0-9]){_LISTED})[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"

#: Formats, tried in this order at each place of the text.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,24}",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_LISTED}|{_UNLISTED})",
    "date": r"(?<![0-9])(?:(?:19|20)[0-9]{2}([-/])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2})(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|\+[0-9]{8,15})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())

#: Days before each month of a common year, and days of each month.
BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _digest(key: str, kind: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)


def _permuted(key: str, kind: str, left: Column, right: Column, a, b) -> Column:
    """Struct (l, r): a keyed permutation of Z_a x Z_b; ``a`` and ``b`` may differ from row to row but are below 10^16."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def step(s, turn):
        def amount(x, half):
            return F.conv(F.substring(_digest(key, kind + half, turn, x), 1, 15), 16, 10).cast("long")

        return let((s["l"] + amount(s["r"], "l")) % a, lambda l: F.struct(l.alias("l"), ((s["r"] + amount(l, "r")) % b).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _digit_string(key: str, kind: str, d: Column) -> Column:
    """A permutation of the digit strings of the same length (2 to 30 digits)."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    p = _permuted(key, kind, F.substring(d, F.lit(1), half), F.substring(d, half + 1, rest), _power(half), _power(rest))
    return let(p, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0")))


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    filled = F.aggregate(chars, start, lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
                         .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))))
    return filled["out"]


def _luhn(payload: Column) -> Column:
    """Check digit of a digit string."""
    n = F.length(payload)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + let(
        F.substring(payload, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.pmod(-total, F.lit(10)).cast("string")


def _card(key, m):
    def new(d):
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        return F.when(_luhn(payload) == F.substring(d, F.length(d), F.lit(1)), let(_digit_string(key, "card", payload), lambda p: _refill(m, F.concat(p, _luhn(p)))))

    return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), new(d)))


def _mod97(text: Column) -> Column:
    """Remainder of the number a letter-and-digit text stands for (A is 10, B is 11, ...)."""
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), lambda s, i: let(
        F.substring(text, i, F.lit(1)), lambda c: F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)))


def _iban(key, m):
    def valid(x):
        return _mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1

    def new(x):
        rest = F.substring(x, F.lit(5), F.length(x))
        return let(_refill(rest, _digit_string(key, "iban", _digits(rest))), lambda body: let(
            98 - _mod97(F.concat(body, F.substring(x, 1, 2), F.lit("00"))),
            lambda check: _refill(m, F.concat(F.lpad(check.cast("string"), 2, "0"), _digits(body)))))

    # letters stay where they are, so only the digits are filled in again
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda x: F.when(valid(x) & (F.length(_digits(x)) >= 4), new(x)))


def _ip(key, m):
    def new(p):
        s = _permuted(key, "ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
        return let(s, lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), lambda p: F.when(F.forall(p, lambda x: x < 256), new(p)))


def _ssn(key, m):
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    def new(p):
        area = F.when(p[0] > 666, p[0] - 2).otherwise(p[0] - 1)
        s = _permuted(key, "ssn", area * 99 + p[1] - 1, p[2] - 1, 898 * 99, 9999)
        return let(s, lambda s: let(F.floor(s["l"] / 99), lambda a: F.format_string("%03d-%02d-%04d", F.when(a >= 665, a + 2).otherwise(a + 1), s["l"] % 99 + 1, s["r"] + 1)))

    return let(F.transform(F.split(m, "-"), lambda x: x.cast("long")),
               lambda p: F.when(p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0), new(p)))


def _phone(key, m):
    """Ten digits of the North American plan (after an optional 1), or an international number whose first three digits stay."""
    def plan(d):
        ten = F.right(d, F.lit(10))
        area, exchange, line = (F.substring(ten, *x).cast("long") for x in ((1, 3), (4, 3), (7, 4)))
        s = _permuted(key, "phone", (area - 200) * 800 + exchange - 200, line, 640_000, 10_000)
        new = let(s, lambda s: F.format_string("%03d%03d%04d", F.floor(s["l"] / 800) + 200, s["l"] % 800 + 200, s["r"]))
        ok = (area >= 200) & (exchange >= 200)
        return F.when(ok, _refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new)))

    def other(d):
        return _refill(m, F.concat(F.substring(d, 1, 3), _digit_string(key, "phone+", F.substring(d, F.lit(4), F.length(d)))))

    def new(d):
        home = (F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))
        return F.when(home & ~(m.startswith("+") & (F.length(d) == 10)), plan(d)).when(m.startswith("+") & F.length(d).between(8, 15), other(d))

    return let(_digits(m), new)


def _date(key, m):
    """Real dates from 1900 to 2099. Days of a common year are permuted with the year, 29 February among the leap years."""
    before, days = (F.array(*(F.lit(x) for x in xs)) for xs in (BEFORE, DAYS))

    def new(x):
        y, mo, d = x["y"], x["m"], x["d"]
        leap = ((y % 4 == 0) & (y != 1900))
        usual = mo.between(1, 12) & (d >= 1) & (d <= F.get(days, mo - 1))
        s = _permuted(key, "date", y - 1900, F.get(before, mo - 1) + d - 1, 200, 365)
        common = let(s, lambda s: let(F.size(F.filter(before, lambda b: b <= s["r"])), lambda month: _written(m, x, s["l"] + 1900, month, s["r"] - F.get(before, month - 1) + 1)))
        odd = let(_permuted(key, "leap", (y - 1904) / 4, F.lit(0), 49, 1), lambda s: _written(m, x, s["l"] * 4 + 1904, F.lit(2), F.lit(29)))
        return F.when(usual, common).when(leap & (mo == 2) & (d == 29), odd)

    def parts(p):
        first_year = F.length(p[0]) == 4
        n = F.transform(p, lambda v: v.cast("int"))
        # day first with dots, or where the second number cannot be a month's successor; else month first
        day_first = m.contains(".") | (n[0] > 12)
        return F.struct(
            F.when(first_year, n[0]).otherwise(n[2]).alias("y"), F.when(first_year, n[1]).when(day_first, n[1]).otherwise(n[0]).alias("m"),
            F.when(first_year, n[2]).when(day_first, n[0]).otherwise(n[1]).alias("d"), first_year.alias("first_year"), day_first.alias("day_first"),
            (F.length(m) < 10).alias("short"))

    return let(let(F.split(m, "[-/.]"), parts), new)


def _written(m, x, year, month, day):
    sep = F.regexp_extract(m, "([-/.])", 1)
    y, mo, d = year.cast("int").cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("int").cast("string"), 2, "0")
    long = F.when(x["first_year"], F.concat(y, sep, mo, sep, d)).when(x["day_first"], F.concat(d, sep, mo, sep, y)).otherwise(F.concat(mo, sep, d, sep, y))
    return F.when(x["short"], F.regexp_replace(long, r"(?<![0-9])0", "")).otherwise(long)


def _mail(key, m):
    """Letters and digits before the @ move within their class; the domain stays."""
    def shifted(s, digest):
        def one(i):
            amount = F.conv(F.substring(digest, (i * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int")
            return let(F.substring(s, i, F.lit(1)), lambda c: F.when(c.rlike("[0-9]"), F.char((F.ascii(c) - 48 + amount) % 10 + 48))
                       .when(c.rlike("[a-z]"), F.char((F.ascii(c) - 97 + amount) % 26 + 97)).when(c.rlike("[A-Z]"), F.char((F.ascii(c) - 65 + amount) % 26 + 65)).otherwise(c))

        return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")).otherwise(s)

    def step(s, turn):
        return let(shifted(s["l"], _digest(key, "mail-l", turn, s["r"])), lambda l: F.struct(l.alias("l"), shifted(s["r"], _digest(key, "mail-r", turn, l)).alias("r")))

    def new(local):
        half = F.floor(F.length(local) / 2).cast("int")
        start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda s: F.concat(s["l"], s["r"]))

    at = F.instr(m, "@")
    return F.concat(let(F.substring(m, F.lit(1), at - 1), new), F.substring(m, at, F.length(m)))


MAKERS = {"mail": _mail, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def _replaced(key: str, m: Column) -> Column:
    """Struct (kind, new) of a match; kind is null where no kind's validation holds."""
    def tried(kind):
        whole = PATTERNS[kind].replace("\\3", "\\1").replace("\\4", "\\2")  # its own groups count from 1
        return F.struct(F.lit(kind).alias("kind"), F.when(m.rlike(f"^(?:{whole})$"), MAKERS[kind](key, m)).alias("new"))

    # side by side and not inside each other: the analyser resolves nested lambdas one level at a time
    found = F.filter(F.array(*(tried(kind) for kind in KINDS)), lambda x: x["new"].isNotNull())
    return F.coalesce(F.get(found, 0), F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))


def pseudonyms(text: str, key: str) -> Column:
    """Struct (text, kinds): the text with pseudonyms, and the kind of each replaced value in order. Null stays null.

    All repetitions in the patterns are bounded, so texts of any length and content take a bounded stack; a mail name has at most
    127 labels, and where more follow each other none is replaced.
    """
    t = F.col(text)

    def rebuilt(found):
        gaps = F.split(t, ANY, -1)
        new = F.zip_with(gaps, found, lambda g, x: F.concat(g, F.coalesce(x["new"], F.lit(""))))
        return F.struct(F.array_join(new, "").alias("text"), F.array_compact(F.transform(found, lambda x: x["kind"])).alias("kinds"))

    nothing = F.struct(t.alias("text"), F.array().cast("array<string>").alias("kinds"))
    made = let(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda ms: F.when(F.size(ms) > 0, let(F.transform(ms, lambda m: _replaced(key, m)), rebuilt)).otherwise(nothing))
    return F.when(t.rlike("[0-9@]"), made).otherwise(nothing)


def pseudonymise(documents: DataFrame, *, key: str) -> DataFrame:
    """The documents with pseudonymous texts; other columns, order of columns and repeated rows stay, ``n_chars`` is counted again.

    Null texts stay null, empty texts empty. Values that fail their kind's validation stay as they are.
    """
    new = pseudonyms("text", key)["text"]
    changed = {"text": new}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length(new).cast(documents.schema["n_chars"].dataType))
    return documents.select(*(changed.get(n, F.col(f"`{n}`")).alias(n) for n in documents.columns))


def report(documents: DataFrame, *, key: str) -> DataFrame:
    """doc_id, text (with pseudonyms), n_replaced and a count per kind, one row per input row."""
    made = plain(documents, "doc_id", "text").select("doc_id", pseudonyms("text", key).alias("made"))
    kinds = F.coalesce(F.col("made.kinds"), F.array().cast("array<string>"))
    return made.select("doc_id", F.col("made.text").alias("text"), F.size(kinds).cast("long").alias("n_replaced"),
                       *(F.size(F.array_remove(F.transform(kinds, _is(kind)), False)).cast("long").alias(f"n_{kind}") for kind in KINDS))


def _is(kind: str):
    return lambda k: k == kind
