"""Format-preserving pseudonyms for numbers, dates, addresses and secrets in texts, in built-in expressions only.

One pattern finds candidates; checks of their kind validate them (Luhn, IBAN remainder, calendar, octets, number of
digits), and what fails stays as it is. A keyed Feistel network permutes the value within its format: digits stay
digits, letters stay letters of their case, check digits are computed anew, dates stay dates of their century. A value
always gets the same pseudonym, whatever the separators around its digits, so equal values stay linked across
documents, and different values of one form stay different.

Texts are handled whole and one by one. Null texts stay null, empty texts empty; repeated rows give equal results, an
empty table gives an empty one, and all columns besides the text are passed through. Matches don't overlap: the leftmost
wins, then the earlier kind of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
#: For use without a secret of one's own, as in tests: pass another key to make pseudonyms irreversible.
OPEN_KEY = "faultline"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind and pattern; every pattern starts at a boundary, so that no start lies inside a longer run.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"),
    ("ip", rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"),
    ("date", r"(?<![0-9A-Za-z./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[./\-][0-9])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}"
              r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9A-Za-z])"),
    ("cloud_key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("hex_key", r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])"),
    ("password", r"(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|api_key|token)[ ]?[=:][ ]?[\"']?[A-Za-z0-9!@#$%^&*_+.\-]{6,64}+"),
)
#: All kinds begin after something else than a letter or digit, which rules out most places at once.
CANDIDATE = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for _, p in PATTERNS) + ")"
#: What candidates hold; the pattern runs only over texts that have one of them.
HINTS = ("@", "AKIA", "password", "passwd", "pwd", "secret", "api_key", "token")


def _may_hold(text: Column) -> Column:
    out = text.rlike("[0-9]")
    for hint in HINTS:
        out = out | text.contains(hint)
    return out


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _noise(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 512)


def _number(digest: Column, at: Column | int, digits: int = 4) -> Column:
    """``digits`` hexadecimal digits of a digest as a number."""
    start = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substr(digest, start, F.lit(digits)), 16, 10).cast("long")


def _shifted(chars: Column, digest: Column, lower: str) -> Column:
    """Each digit and letter moved within its class by the digest; ``lower`` lists the small letters."""
    classes = ("0123456789", lower, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def move(i: Column, noise: Column) -> Column:
        char, by = F.substr(chars, i, F.lit(1)), _number(noise, (i - 1) % 32 * 4 + 1)
        out = char
        for known in classes:
            place = F.instr(F.lit(known), char)
            out = F.when(place > 0, F.substr(F.lit(known), ((place - 1 + by) % len(known) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    moved = _let(digest, lambda noise: F.array_join(F.transform(F.sequence(F.lit(1), F.length(chars)), lambda i: move(i, noise)), ""))
    return F.when(F.length(chars) > 0, moved).otherwise("")


def permuted(text: Column, key: str, kind: str, lower: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """A permutation of all strings with the same classes of characters: a Feistel network on the two halves."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda s, i: F.struct(s["r"].alias("l"), _shifted(s["l"], _noise(f"{key}|{kind}", i, F.length(text), s["r"]), lower).alias("r")),
        lambda s: F.concat(s["l"], s["r"]))


def permuted_pair(high: Column, low: Column, n_high: Column, n_low: Column, key: str, kind: str) -> Column:
    """A permutation of the pairs below (``n_high``, ``n_low``), as ``high * n_low + low``."""
    start = F.struct(high.cast("long").alias("h"), low.cast("long").alias("l"))

    def turn(s: Column, i: Column) -> Column:
        moved = (s["h"] + _number(_noise(f"{key}|{kind}", i, F.lit("h"), s["l"]), 1, 12)) % n_high
        return _let(moved, lambda h: F.struct(h.alias("h"), ((s["l"] + _number(_noise(f"{key}|{kind}", i, F.lit("l"), h), 1, 12)) % n_low).alias("l")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["h"] * n_low + s["l"])


def _only(text: Column, keep: str) -> Column:
    return F.regexp_replace(text, f"[^{keep}]", "")


def _put_back(form: Column, values: Column, keep: str) -> Column:
    """``form`` with its characters of the set ``keep`` replaced by those of ``values``, in order."""

    def char(i: Column, new: Column) -> Column:
        own = F.substr(form, i, F.lit(1))
        nth = F.length(_only(F.substr(form, F.lit(1), i), keep))
        return F.when(own.rlike(f"[{keep}]"), F.substr(new, nth, F.lit(1))).otherwise(own)

    return _let(values, lambda new: F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: char(i, new)), ""))


def _digit(text: Column, i: Column) -> Column:
    return F.substr(text, i, F.lit(1)).cast("int")


def luhn_sum(digits: Column) -> Column:
    """Sum in which every second digit from the right, the last excluded, is doubled and its digits added."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = _digit(digits, n - i + 1)
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, d: a + d)


def iban_remainder(text: Column) -> Column:
    """Remainder by 97 with the first four characters at the end and letters as numbers from 10."""
    turned = F.concat(F.substr(text, F.lit(5), F.length(text)), F.substr(text, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        char = F.substr(turned, i, F.lit(1))
        return F.when(char.rlike("[0-9]"), (a * 10 + char.cast("int")) % 97).otherwise((a * 100 + F.ascii(char) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    both = permuted_pair(F.get(octets, F.lit(0)).cast("long") * 256 + F.get(octets, F.lit(1)).cast("long"), F.get(octets, F.lit(2)).cast("long") * 256 + F.get(octets, F.lit(3)).cast("long"),
                         F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    return _let(both, lambda b: F.concat_ws(".", *[(F.shiftright(b, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)]))


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    account = permuted(F.substr(plain, F.lit(5), F.length(plain)), key, "iban")
    country = F.substr(plain, F.lit(1), F.lit(2))
    valid = (iban_remainder(plain) == 1) & F.length(plain).between(15, 34)

    def whole(new: Column) -> Column:
        check = F.lpad((98 - iban_remainder(F.concat(country, F.lit("00"), new))).cast("string"), 2, "0")
        return F.concat(country, check, new)

    return F.when(valid, _put_back(m, _let(account, whole), "A-Z0-9")).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    valid = ~m.rlike(r"^(000|666|9)|-00-|-0000$")
    return F.when(valid, _put_back(m, permuted(_only(m, "0-9"), key, "ssn"), "0-9")).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Days of a century are numbered, and the number is permuted as a pair whose bounds multiply to the century's days:
    75 * 487 with a leap year at its start, else 92 * 397. A slash date is month first where that is a date, else day first."""
    iso = m.rlike("-")
    year = F.when(iso, F.substr(m, F.lit(1), F.lit(4))).otherwise(F.substr(m, F.lit(7), F.lit(4)))
    one, two = F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2))
    month_first = m.rlike("/") & (one.cast("int") <= 12)
    month = F.when(iso, F.substr(m, F.lit(6), F.lit(2))).when(month_first, one).otherwise(two)
    day = F.when(iso, F.substr(m, F.lit(9), F.lit(2))).when(month_first, two).otherwise(one)
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    century = F.floor(year.cast("int") / 100).cast("int")
    long = century % 4 == 0
    n_high, n_low = F.when(long, 75).otherwise(92).cast("long"), F.when(long, 487).otherwise(397).cast("long")
    first = F.make_date(century * 100, F.lit(1), F.lit(1))
    number = F.date_diff(date, first).cast("long")
    moved = F.date_add(first, permuted_pair(F.floor(number / n_low), number % n_low, n_high, n_low, key, "date").cast("int"))
    out = (F.when(iso, F.date_format(moved, "yyyy-MM-dd")).when(m.rlike(r"\."), F.date_format(moved, "dd.MM.yyyy"))
           .when(month_first, F.date_format(moved, "MM/dd/yyyy")).otherwise(F.date_format(moved, "dd/MM/yyyy")))
    return F.when(date.isNotNull() & (century >= 16), out).otherwise(m)


def _card(m: Column, key: str) -> Column:
    """Length, first digit and validity stay."""
    digits = _only(m, "0-9")
    n = F.length(digits)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted(F.substr(digits, F.lit(2), n - 2), key, "card"))
    whole = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when(luhn_sum(digits) % 10 == 0, _put_back(m, whole, "0-9")).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code after a plus sign stays; the other digits, at least 6 of at most 15, are permuted."""
    code = F.regexp_extract(m, r"^\+(1|7|[2-9][0-9]{0,2})(?![0-9])|^\+(1|7|[0-9]{2})", 0)
    digits = _only(m, "0-9")
    rest = F.substr(digits, F.length(_only(code, "0-9")) + 1, F.length(digits))
    new = F.concat(_only(code, "0-9"), permuted(rest, key, "phone"))
    return F.when((F.length(rest) >= 6) & (F.length(digits) <= 15), _put_back(m, new, "0-9")).otherwise(m)


def _after(head: Column, m: Column, key: str, kind: str, **how) -> Column:
    return F.concat(head, permuted(F.substr(m, F.length(head) + 1, F.length(m)), key, kind, **how))


def kind_of(m: Column) -> Column:
    """The kind of a candidate: the first whose pattern it is as a whole."""
    out = F.lit("other")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands in place of a candidate of a kind (itself if it isn't valid)."""
    makers = {
        "email": _email(m, key), "ip": _ip(m, key), "iban": _iban(m, key), "ssn": _ssn(m, key), "date": _date(m, key), "card": _card(m, key),
        "phone": _phone(m, key), "cloud_key": _after(F.lit("AKIA"), m, key, "cloud_key"), "hex_key": permuted(m, key, "hex_key", lower="abcdef"),
        "password": _after(F.regexp_extract(m, r"^[a-z_]+[ ]?[=:][ ]?[\"']?", 0), m, key, "password"),
    }
    out = m
    for name, made in makers.items():
        out = F.when(kind == name, made).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = OPEN_KEY, text_col: str = "text", found_col: str = "pseudonyms") -> DataFrame:
    """``docs`` with pseudonyms in its text and ``found_col``: kind, value and pseudonym of each replaced value, in order.

    The text is split at the candidates and joined again with what stands in their place.
    """
    text = F.col(text_col)
    pattern = F.lit(CANDIDATE)
    none = F.expr("CAST(array() AS array<string>)")
    found = F.when(_may_hold(text), F.regexp_extract_all(text, pattern, 0)).otherwise(none)
    kinds = F.transform(F.col("__found"), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value")))
    pairs = F.transform(F.col("__kinds"), lambda p: p.withField("pseudonym", pseudonym(p["value"], p["kind"], key)))
    gaps = F.split(text, CANDIDATE, -1)
    joined = F.concat(F.array_join(F.transform(F.col("__pairs"), lambda p, i: F.concat(F.get(F.col("__gaps"), i), p["pseudonym"])), ""),
                      F.element_at("__gaps", -1))
    return (docs.withColumn("__found", found).withColumn("__kinds", F.when(F.size("__found") > 0, kinds)).withColumn("__pairs", pairs)
            .withColumn("__gaps", F.when(F.size("__found") > 0, gaps))
            .withColumn(text_col, F.when(F.size("__found") > 0, joined).otherwise(text))
            .withColumn(found_col, F.filter("__pairs", lambda p: p["value"] != p["pseudonym"]))
            .drop("__found", "__kinds", "__pairs", "__gaps"))
