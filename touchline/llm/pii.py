"""Format-preserving pseudonyms by keyed Feistel networks, in Spark's own functions.

Validated card numbers (Luhn), bank accounts (IBAN, mod 97), social security numbers, phone numbers, IP addresses and
dates, and also e-mail addresses and secrets, are permuted within their format: a card becomes another valid card, a
date another date from 1900 to 2099, and separators stay; an IPv6 address is written in full. The same value gets the same
pseudonym in every document under one key; another key gives another permutation. Values that don't validate stay as
they are. Whoever has the key can undo the permutations, so the caller brings it; the query and the pipeline's stage take
it from ``KEY_SETTING`` and draw a random one for the run where that isn't set.

A number below a * b is halved into x < a and y < b; rounds add a keyed digest of one half to the other, which can be
undone, so it is a permutation. Where not all numbers of the domain are valid, it is applied again until one is.
Dates that can only be read month first stay such dates, so no two values share a pseudonym.

Defined results: a null text stays null and an empty one empty, both without findings; rows that repeat are treated
alike; an empty table gives no rows; all other columns stay, whatever their names. Work grows in proportion to a text's
length: no pattern recurs, looks back further than a fixed count of characters or, where it can begin at many places of
one stretch, looks on further than such a count. Secrets behind a keyword end at the first blank, quoted or not.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, like, table

KINDS = ("secret", "email", "iban", "date", "ip", "ssn", "card", "phone")
ROUNDS = 8
KEY_SETTING = "spark.touchline.pii.key"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_LEFT, _RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
SECRET = r"(?i:password|passwd|secret|token|api_key|apikey|access_key) {0,2}[=:] {0,2}[\"']?"
#: The most characters of a web token's first and second part. A part may begin anew behind each ``-`` of a long stretch
#: of its characters, so that without a bound each beginning would be followed to the end of the stretch.
HEADER, PAYLOAD = 1024, 1 << 15
#: What tokens of known issuers start with and what follows.
TOKENS = {"AKIA": "[0-9A-Z]{16}", "gh[pousr]_": "[0-9A-Za-z]{30,}+", "github_pat_": "[0-9A-Za-z_]{22,}+", "xox[abprs]-": "[0-9A-Za-z-]{10,}+", "sk-": "[0-9A-Za-z_-]{20,}+", "eyJ": rf"[0-9A-Za-z_-]{{8,{HEADER}}}+\.eyJ[0-9A-Za-z_-]{{8,{PAYLOAD}}}+\.[0-9A-Za-z_-]{{8,}}+"}
_TOKEN = "|".join(f"{a}{b}" for a, b in TOKENS.items())
#: Lengths of bank account numbers by country, so that one in groups of four ends where it does.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FO FI FK GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ XK LT LU MN",
    21: "HR LV LI CH",
    22: "BH BG CR GE DE IE ME RS GB VA",
    23: "GI IQ IL OM SO TL AE",
    24: "AD CZ MD PK RO SA SK ES SE TN VG",
    25: "PT ST LY",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_GROUPED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [0-9A-Z]{{4}}){{{n // 4 - 1}}}" + (f" [0-9A-Z]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})"
#: What may be a value of each kind; the kinds are tried in this order at each place. What repeats without a bound is
#: possessive, so that it takes no stack and is never tried again.
PATTERNS = {
    "secret": rf"{_LEFT}(?:{_TOKEN}){_RIGHT}|{SECRET}[0-9A-Za-z!#$%&*+./=?@^_~-]{{6,}}+",
    "email": r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}@[0-9A-Za-z-]{1,63}(?:\.[0-9A-Za-z-]{1,63}+)++",
    "iban": rf"{_LEFT}[A-Z]{{2}}[0-9]{{2}}[0-9A-Z]{{11,30}}{_RIGHT}|{_LEFT}(?:{_GROUPED}){_RIGHT}",
    "date": rf"{_LEFT}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}){_RIGHT}",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])|(?<![0-9A-Za-z.:]){IPV6}(?![0-9A-Za-z:]|\.[0-9])",
    "ssn": rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z]|-[0-9])",
    "card": rf"{_LEFT}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_RIGHT}",
    "phone": rf"(?<![0-9A-Za-z+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}{_RIGHT}|(?<![0-9A-Za-z])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[-.])[0-9]{{3}}[-.][0-9]{{4}}{_RIGHT}",
}
ANY = "|".join(PATTERNS.values())


def let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digest(key: str, *parts) -> Column:
    """60 bits of a keyed SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256), 1, 15), 16, 10).cast("long")


def permuted(n: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of the numbers below a * b."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def step(at: Column, r: Column) -> Column:
        x, y = at["x"], at["y"]
        odd = r % 2 == 1
        return F.struct(F.when(odd, (x + _digest(key, kind, a, b, r, y) % a) % a).otherwise(x).alias("x"), F.when(odd, y).otherwise((y + _digest(key, kind, a, b, r, x) % b) % b).alias("y"))

    start = F.struct(F.call_function("div", n, b).alias("x"), (n % b).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda at: at["x"] * b + at["y"])


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of at most 18 places to another of as many."""

    def of(d: Column) -> Column:
        n = F.length(d)
        half = F.call_function("div", n, F.lit(2)).cast("int")
        p = let(_ten_to(n - half), lambda a: let(_ten_to(half), lambda b: permuted(d.cast("long"), a, b, key, kind)))
        return F.lpad(p.cast("string"), n, F.lit("0"))

    return let(digits, of)


def permuted_chars(s: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """A string to another: digits stay digits, capitals capitals, small letters small letters; the rest stays.

    With ``hexadecimal``, digits and ``a`` to ``f`` are one alphabet instead.
    """

    def turned(c: Column, i: Column, r: Column, other: Column) -> Column:
        by = _digest(key, kind, r, other, i)

        def turn(first: int, size: int) -> Column:
            return F.char((F.ascii(c) - first + by % size) % size + first)

        if hexadecimal:
            return F.lower(F.conv(((F.conv(c, 16, 10).cast("long") + by % 16) % 16).cast("string"), 10, 16))
        return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[A-Z]$"), turn(65, 26)).when(c.rlike("^[a-z]$"), turn(97, 26)).otherwise(c)

    def moved(half: Column, other: Column, r: Column) -> Column:
        # a long half counts by its digest and is split once, so that the work grows with the length and not its square
        other = F.when(F.length(other) > 100, F.sha2(other, 256)).otherwise(other)
        chars = F.filter(F.split(half, ""), lambda c: c != "")
        return let(other, lambda o: F.array_join(F.transform(chars, lambda c, i: turned(c, i + 1, r, o)), ""))

    def step(at: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(F.when(odd, moved(at["x"], at["y"], r)).otherwise(at["x"]).alias("x"), F.when(odd, at["y"]).otherwise(moved(at["y"], at["x"], r)).alias("y"))

    def of(v: Column) -> Column:
        half = F.call_function("div", F.length(v) + 1, F.lit(2)).cast("int")
        start = F.struct(F.substring(v, F.lit(1), half).alias("x"), F.substring(v, half + 1, F.length(v)).alias("y"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda at: F.concat(at["x"], at["y"]))

    return let(s, of)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _filled(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced by ``digits``, one after another."""

    def of(t: Column, d: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            c = F.substring(t, i, F.lit(1))
            is_digit = c.rlike("^[0-9]$")
            return F.struct(F.concat(at["s"], F.when(is_digit, F.substring(d, at["n"], F.lit(1))).otherwise(c)).alias("s"), F.when(is_digit, at["n"] + 1).otherwise(at["n"]).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.length(t)), F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), step, lambda at: at["s"])

    return let(template, lambda t: let(digits, lambda d: of(t, d)))


def luhn_digit(body: Column) -> Column:
    """The check digit that follows ``body``."""

    def of(v: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            d = F.substring(v, F.length(v) + 1 - i, F.lit(1)).cast("int")
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return total + F.when(i % 2 == 1, twice).otherwise(d)

        return ((10 - F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), step) % 10) % 10).cast("string")

    return let(body, of)


def mod97(s: Column) -> Column:
    def of(v: Column) -> Column:
        def step(m: Column, i: Column) -> Column:
            c = F.substring(v, i, F.lit(1))
            return F.when(c.rlike("^[0-9]$"), m * 10 + c.cast("long")).otherwise(m * 100 + F.ascii(c) - 55) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0).cast("long"), step)

    return let(s, of)


def _head(s: Column, n: int) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - n)


def _valid_ssn(d: Column) -> Column:
    return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


FIRST_DAY, DAYS = "1900-01-01", 73049


def _day(m: Column) -> Column:
    """A date text as days since ``FIRST_DAY``; day before month unless only the other order is a date."""
    t = F.translate(m, "/.", "--")
    d = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy")])
    return F.datediff(d, F.lit(FIRST_DAY).cast("date")).cast("long")


def _hextets(m: Column) -> Column:
    """How many groups an IPv6 address names; 8 only where it isn't shortened."""
    n = F.regexp_count(m, F.lit("[0-9A-Fa-f]+"))
    return F.when(m.contains("::") & (n == 8), 9).otherwise(n)


def _ipv6(m: Column, key: str) -> Column:
    """The pseudonym of an IPv6 address, in full."""

    def groups(x: Column) -> Column:
        return F.filter(F.split(x, ":"), lambda g: g != "")

    left, right = groups(F.substring_index(m, "::", 1)), F.when(m.contains("::"), groups(F.substring_index(m, "::", -1))).otherwise(F.array().cast("array<string>"))
    full = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    digits = F.array_join(F.transform(full, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    new = permuted_chars(digits, key, "ipv6", hexadecimal=True)
    return let(new, lambda d: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(d, 4 * i + 1, F.lit(4)), "^0{1,3}", "")), ":"))


def kind_of(m: Column) -> Column:
    """The kind that ``m``, a match of ``ANY``, is a valid value of, or null."""
    d, c = _digits(m), F.replace(m, F.lit(" "), F.lit(""))
    valid = {
        "secret": m.rlike(f"^(?:(?:{_TOKEN})$|{SECRET})"),
        "email": m.contains("@"),
        "iban": c.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$") & (mod97(F.concat(F.substring(c, 5, 99), F.substring(c, 1, 4))) == 1),
        "date": m.rlike("^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\\1[0-9]{4})$") & _day(m).between(0, DAYS - 1),
        "ip": m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") | (m.rlike(f"^{IPV6}$") & m.rlike("[0-9]") & _hextets(m).between(3, 8)),
        "ssn": m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & _valid_ssn(d),
        "card": m.rlike("^[0-9][0-9 -]+[0-9]$") & F.length(d).between(13, 19) & ~d.rlike("^0+$") & (luhn_digit(_head(d, 1)) == F.substring(d, -1, 1)),
        "phone": m.rlike("^[+(0-9][0-9 ().-]+$") & (m.startswith("+") | m.rlike(r"^\(?[0-9]{3}[). -]+[0-9]{3}[.-][0-9]{4}$")) & F.length(d).between(7, 15),
    }
    out = F.lit(None).cast("string")
    for kind, ok in reversed(list(valid.items())):
        out = F.when(ok, F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of a kind; ``m`` itself where the kind is null."""
    d = _digits(m)
    card = let(permuted_digits(_head(d, 1), key, "card"), lambda b: F.concat(b, luhn_digit(b)))

    def iban(account: Column) -> Column:
        check = 98 - mod97(F.concat(account, F.substring(m, 1, 2), F.lit("00")))
        new = F.concat(F.substring(m, 1, 2), F.lpad(check.cast("string"), 2, "0"), account)
        return F.when(m.contains(" "), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new)

    again = lambda x, _: F.when(_valid_ssn(x), x).otherwise(permuted_digits(x, key, "ssn"))
    ssn = F.aggregate(F.sequence(F.lit(1), F.lit(60)), permuted_digits(d, key, "ssn"), again)
    code = F.regexp_extract(m, r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9])", 0)
    phone = let(code, lambda c: let(F.substring(m, F.length(c) + 1, F.length(m)), lambda rest: F.concat(c, _filled(rest, permuted_digits(_digits(rest), key, "phone")))))
    number = let(F.split(m, r"\."), lambda x: sum((x[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), x[0].cast("long") * 256**3))
    ip = let(permuted(number, 65536, 65536, key, "ip"), lambda n: F.concat_ws(".", *[F.call_function("div", n, F.lit(256**i)) % 256 for i in (3, 2, 1, 0)]))
    iso = m.rlike("^[0-9]{4}-")
    day_first = F.try_to_timestamp(F.translate(m, ".", "/"), F.lit("dd/MM/yyyy")).isNotNull()
    month_first = ~iso & ~day_first
    in_range = lambda x: (x < DAYS) & (~month_first | (F.dayofmonth(F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))) > 12))
    step = lambda x, _: F.when(in_range(x), x).otherwise(permuted(x, 271, 270, key, "date"))
    day = F.aggregate(F.sequence(F.lit(1), F.when(month_first, 60).otherwise(12)), permuted(_day(m), 271, 270, key, "date"), step)

    def date(new: Column) -> Column:
        dd, mm, yyyy = (F.date_format(new, x) for x in ("dd", "MM", "yyyy"))
        sep = F.substring(m, 3, 1)
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(day_first, F.concat(dd, sep, mm, sep, yyyy)).otherwise(F.concat(mm, sep, dd, sep, yyyy))

    starts = "|".join(f"{a}(?={b}$)" for a, b in TOKENS.items())
    name = F.regexp_extract(m, f"^(?:{starts}|{SECRET})", 0)
    new_of = {
        "secret": let(name, lambda x: F.concat(x, permuted_chars(F.substring(m, F.length(x) + 1, F.length(m)), key, "secret"))),
        "email": F.concat(permuted_chars(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1)),
        "iban": let(permuted_chars(F.substring(F.replace(m, F.lit(" "), F.lit("")), 5, 99), key, "iban"), iban),
        "date": let(F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")), date),
        "ip": F.when(m.contains(":"), _ipv6(m, key)).otherwise(ip),
        "ssn": _filled(m, ssn),
        "card": _filled(m, card),
        "phone": phone,
    }
    out = m
    for k, value in new_of.items():
        out = F.when(kind == k, value).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "_pii") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and ``found_col``: the kinds found, in the order of the text.

    Where ``docs`` has a column of that name, ``_`` is added to the name until it is free. A text is cut at each
    match and put together again with pseudonyms; no row leaves its partition.
    """
    name = free_name(docs, found_col)
    t, found = F.col(f"`{text_col}`"), F.col(f"`{name}`")
    may = F.coalesce(t.rlike("[0-9@]") | t.rlike(f"{SECRET}|{_TOKEN}"), F.lit(False))
    empty = F.array().cast("array<string>")
    hits = F.when(may, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(empty)
    df = docs.withColumn(name, F.transform(hits, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    new = F.transform(found, lambda h: F.when(h["kind"].isNull(), h["m"]).otherwise(pseudonym(h["m"], h["kind"], key)))
    joined = F.array_join(F.zip_with(F.split(t, ANY, -1), new, lambda part, m: F.concat(part, F.coalesce(m, F.lit("")))), "")
    changed = F.exists(found, lambda h: h["kind"].isNotNull())
    df = df.withColumn(text_col, F.when(changed, joined).otherwise(t))
    return df.withColumn(name, F.filter(F.transform(found, lambda h: h["kind"]), lambda k: k.isNotNull()))


def key_of(spark: SparkSession) -> str:
    """The caller's key, or a random one that links values within one run only."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` with pseudonyms, and how many of each kind it has."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    count = lambda kind: F.size(F.filter("_pii", lambda k: k == kind))
    return out.select("doc_id", "text", F.size("_pii").alias("n_found"), *[count(x).alias(f"n_{x}") for x in KINDS])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms."""
    return like(pseudonymise(docs, key_of(spark)), docs)
