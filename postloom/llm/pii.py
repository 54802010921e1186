"""Format-preserving pseudonyms for personal data, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is looked for, in order of precedence. Digits stand alone: no letter, digit or sign of a longer number next to them.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){2,4}(?![0-9]|\.[0-9])|(?<![0-9A-Za-z.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=(?:password|passwd|secret|token|api_key)=)[^\s\"'<>]{6,}|(?<=(?:password|passwd|secret|token|api_key) = \")[^\s\"'<>]{6,}|(?<=(?:PASSWORD|PASSWD|SECRET|TOKEN|API_KEY)=)[^\s\"'<>]{6,}|(?<=(?:PASSWORD|PASSWD|SECRET|TOKEN|API_KEY) = \")[^\s\"'<>]{6,}",
}
#: The days from 1900-01-01 to 2099-12-31: 17 times 4,297.
_FIRST, _DAYS = "1900-01-01", (17, 4297)
_ROUNDS = 10


def _regex() -> str:
    """One pattern of all kinds; back references are numbered anew as groups move."""
    parts, seen = [], 0
    for p in PATTERNS.values():
        for k in range(9, 0, -1):
            p = p.replace(f"\\{k}", f"\\{k + seen}")
        parts.append(p)
        seen += sum(1 for i, c in enumerate(p) if c == "(" and p[i + 1] != "?" and p[i - 1] != "\\")
    return "|".join(parts)


REGEX = _regex()


def _digest(key: str, *what: Column) -> Column:
    """52 bits of a keyed digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *what), 256), 1, 13), 16, 10).cast("long")


def feistel(key: str, kind: Column | str, left: Column, right: Column, u: Column, v: Column) -> Column:
    """A keyed permutation of the pairs (left below u, right below v), as a struct (a, b).

    Rounds take turns: one half gets the digest of the other added, modulo its own size, so sizes may differ and every pair
    has one image and one origin. Sizes are at most 10**10.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        mixed = lambda own, other, size: F.pmod(own + _digest(key, kind, r.cast("string"), u.cast("string"), v.cast("string"), other.cast("string")), size.cast("long"))
        even = r % 2 == 0
        return F.struct(F.when(even, mixed(acc["a"], acc["b"], u)).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(mixed(acc["b"], acc["a"], v)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), start, turn)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once."""
    return F.transform(F.array(value), then)[0]


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of one length (1 to 20; a single digit is shifted), leading zeros kept."""

    def two(n: Column, d: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        u, v = F.pow(F.lit(10), half).cast("long"), F.pow(F.lit(10), n - half).cast("long")
        a, b = F.substring(d, F.lit(1), half), F.substring(d, half + 1, n - half)
        out = feistel(key, kind, F.when(half == 0, F.lit(0)).otherwise(F.try_to_number(a, F.lit("9999999999")).cast("long")), F.try_to_number(b, F.lit("9999999999")).cast("long"), u, v)
        return _let(out, lambda o: F.concat(F.when(half == 0, F.lit("")).otherwise(F.lpad(o["a"].cast("string"), half, F.lit("0"))), F.lpad(o["b"].cast("string"), n - half, F.lit("0"))))

    return _let(digits, lambda d: _let(F.length(d), lambda n: two(n, d)))


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by digits."""
    chars = F.split(form, "")
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["s"], F.substring(digits, acc["n"] + 1, F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n")))
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), step, lambda acc: acc["s"])


def _digits(form: Column) -> Column:
    return F.regexp_replace(form, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled (less 9 if above 9), the last not doubled."""
    back = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x)


def _card(key: str, hit: Column) -> Column:
    def new(d: Column) -> Column:
        body = permute_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        whole = _let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"), _refill(hit, whole))

    return _let(_digits(hit), new)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as numbers (A is 10)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _iban(key: str, hit: Column) -> Column:
    def new(plain: Column) -> Column:
        body = F.substring(plain, F.lit(5), F.length(plain) - 4)
        digits = _digits(body)
        # 20 digits at most are permuted at once; longer ones in two parts
        first, rest = F.substring(digits, F.lit(1), F.lit(20)), F.substring(digits, F.lit(21), F.lit(20))
        moved = F.concat(F.when(F.length(first) > 0, permute_digits(key, "iban", first)).otherwise(F.lit("")), F.when(F.length(rest) > 0, permute_digits(key, "iban2", rest)).otherwise(F.lit("")))
        filled = _refill(body, moved)
        land = F.substring(plain, 1, 2)
        whole = _let(filled, lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
        spaced = lambda w: F.aggregate(F.filter(F.split(hit, ""), lambda c: c != ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), lambda acc, c: F.when(c == " ", F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n"))).otherwise(F.struct(F.concat(acc["s"], F.substring(w, acc["n"] + 1, F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))), lambda acc: acc["s"])
        valid = (F.length(plain) >= 15) & (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1)
        return F.when(valid, _let(whole, spaced))

    return _let(F.regexp_replace(hit, " ", ""), new)


def _ipv4(key: str, hit: Column) -> Column:
    def new(p: Column) -> Column:
        n = lambda i: p[i].cast("int")
        out = feistel(key, "ipv4", n(0) * 256 + n(1), n(2) * 256 + n(3), F.lit(65536), F.lit(65536))
        dotted = _let(out, lambda o: F.concat_ws(".", *[x.cast("string") for half in ("a", "b") for x in (F.floor(o[half] / 256), o[half] % 256)]))
        return F.when((n(0) < 256) & (n(1) < 256) & (n(2) < 256) & (n(3) < 256), dotted)

    return _let(F.split(hit, r"\."), new)


def _date(key: str, hit: Column) -> Column:
    def new(f: Column) -> Column:
        a, b = _DAYS
        n = F.datediff(f["day"], F.lit(_FIRST).cast("date"))
        out = feistel(key, "date", F.floor(n / b), n % b, F.lit(a), F.lit(b))
        moved = _let(out, lambda o: F.date_add(F.lit(_FIRST).cast("date"), (o["a"] * b + o["b"]).cast("int")))
        parts = lambda d, *order: F.concat(F.date_format(d, order[0]), f["sep"], F.date_format(d, order[1]), f["sep"], F.date_format(d, order[2]))
        written = _let(moved, lambda d: F.when(f["form"] == "ymd", parts(d, "yyyy", "MM", "dd")).when(f["form"] == "mdy", parts(d, "MM", "dd", "yyyy")).otherwise(parts(d, "dd", "MM", "yyyy")))
        return F.when(f["day"].isNotNull() & (n >= 0) & (n < a * b), written)

    part = lambda i, n: F.substring(hit, i, n)
    day = lambda *p: F.try_to_date(F.concat_ws("-", *p), "yyyy-MM-dd")
    front = hit.rlike("^[0-9]{4}")
    sep = F.when(front, part(5, 1)).otherwise(part(3, 1))
    mdy, dmy = day(part(7, 4), part(1, 2), part(4, 2)), day(part(7, 4), part(4, 2), part(1, 2))
    american = sep == "/"
    form = F.when(front, F.lit("ymd")).when(american & mdy.isNotNull(), F.lit("mdy")).when(dmy.isNotNull(), F.lit("dmy")).otherwise(F.lit("mdy"))
    value = F.when(front, day(part(1, 4), part(6, 2), part(9, 2))).when(american, F.coalesce(mdy, dmy)).otherwise(F.coalesce(dmy, mdy))
    return _let(F.struct(value.alias("day"), form.alias("form"), sep.alias("sep")), new)


def _ssn(key: str, hit: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(hit, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    out = feistel(key, "ssn", area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    written = _let(out, lambda o: F.concat_ws("-", pad(o["a"] + 1 + F.when(o["a"] >= 665, 1).otherwise(0), 3), pad(F.floor(o["b"] / 9999) + 1, 2), pad(o["b"] % 9999 + 1, 4)))
    return F.when(valid, written)


#: Country codes of international numbers: one digit, two, or else three; no code begins another.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(key: str, hit: Column) -> Column:
    """The country code stays, and the digits after it are permuted whatever stands between them; 7 to 15 digits make a number."""
    own = F.regexp_extract(hit, _COUNTRY, 0)
    rest = F.substring(hit, F.length(own) + 1, F.length(hit))
    n = F.length(_digits(hit))
    return F.when((n >= 7) & (n <= 15), F.concat(own, _refill(rest, permute_digits(key, "phone", _digits(rest)))))


def _email(key: str, hit: Column) -> Column:
    """A keyed digest for the name and one for the domain, under the reserved end ``.invalid``."""
    name, domain = F.substring_index(hit, "@", 1), F.lower(F.substring_index(hit, "@", -1))
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(name), domain), 256), 1, 12), F.lit("@d"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), 1, 8), F.lit(".invalid"))


def _secret(key: str, hit: Column) -> Column:
    """A keyed digest as long as the secret, up to 64 characters."""
    plain = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), hit), 256), F.lit(1), F.length(hit))
    return F.when(hit.rlike("[a-z]"), plain).otherwise(F.upper(plain))


_WAYS = {"email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "secret": _secret}


def pseudonym(hit: Column, key: str) -> Column:
    """A struct (kind, value): the pseudonym of a match, or null where no kind's check holds.

    A kind is tried where its own pattern matches the whole match, in order; one whose check fails (a wrong Luhn or
    IBAN check digit, no date of 1900 to 2099, an octet above 255) leaves the match to the next kind.
    """
    tried = []
    for kind, way in _WAYS.items():
        shape = hit.rlike(f"^(?:{PATTERNS[kind]})$")
        if kind == "secret":  # its words stand before the match; what only looks like an account number is none
            shape = hit.rlike("^[^@]{6,}$") & hit.rlike("[A-Za-z]") & (hit.rlike("^AKIA") | ~hit.rlike(f"^(?:{PATTERNS['iban']})$"))
        tried.append(F.struct(F.lit(kind).alias("kind"), F.when(shape, way(key, hit)).alias("value")))
    return F.try_element_at(F.filter(F.array(*tried), lambda t: t["value"].isNotNull()), F.lit(1))


def pseudonymize(docs: DataFrame, *, key: str, text_col: str = "text", into: str | None = None) -> DataFrame:
    """docs with personal data in text_col replaced (in column ``into``, if given), and ``pii``: kind and pseudonym of each.

    Card numbers (Luhn), IBANs, IPv4 addresses, phone and social security numbers and dates are permuted by a keyed Feistel
    network within their valid values and keep their written form; mail addresses and secrets get keyed digests. The
    same value gives the same pseudonym in every document. The text between matches stays as it is; a match whose check
    fails stays too. A null text stays null with no pii, an empty one empty. Columns called like an added one are
    replaced. Everything is an expression on the row: nothing is shuffled.
    """
    text = F.col(text_col)
    hits = F.regexp_extract_all(text, F.lit(REGEX), F.lit(0))
    moved = F.transform(hits, lambda h: F.struct(h.alias("hit"), pseudonym(h, key).alias("p")))
    at, new_at = "_moved", "_new"
    while {at, new_at} & set(docs.columns):
        at, new_at = f"{at}_", f"{new_at}_"
    cut = docs.withColumn(at, F.when(text.rlike(r"[0-9@]|AKIA|(?i:password|passwd|secret|token|api_key)"), moved))
    pieces = F.split(text, REGEX, -1)
    fill = F.transform(at, lambda m: F.coalesce(m["p"]["value"], m["hit"]))
    woven = F.array_join(F.transform(F.arrays_zip(pieces.alias("t"), F.concat(fill, F.array(F.lit(""))).alias("f")), lambda x: F.concat(x["t"], x["f"])), "")
    new = F.when(F.size(at) > 0, woven).otherwise(text)
    pii = F.when(F.col(at).isNull(), F.array().cast("array<struct<kind:string,value:string>>")).otherwise(F.transform(F.filter(at, lambda m: m["p"]["kind"].isNotNull()), lambda m: m["p"]))
    return cut.withColumn(new_at, new).withColumn("pii", pii).withColumn(into or text_col, F.col(new_at)).drop(at, new_at)
