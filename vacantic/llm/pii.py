"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame expressions only.

A candidate found by pattern is first validated (check digits, ranges, calendar).  A valid one is taken apart into
symbols, each with its own number of possible values; a keyed Feistel network permutes the symbols, and the result is
put back into the candidate's own layout.  Rounds add a keyed hash of one half to the other half, symbol by symbol and
modulo the symbol's range, so the map is a permutation of all values of a format: equal values stay equal in every
document, different ones stay different, whatever their separators.  Check digits are computed anew.

Kept as they are: card issuer digit, country code, top-level domain, separators; candidates that do not validate.

Defined results: null text stays null; text without a candidate is returned unchanged; repeated rows get equal
results; columns other than the text are kept, and a column named like the counter is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantic.functions.let import let
from vacantic.llm.common import free_name

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 1 << 16  # dates from then to 2079-06-05

# candidates, the first alternative that fits wins
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
ISO_DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
SHORT_DATE = r"(?<![\d./])(?:\d{1,2}/\d{1,2}/|\d{1,2}\.\d{1,2}\.)\d{4}(?![\d/])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])(?:\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}|(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4})(?!\d)"
FOREIGN_PHONE = r"(?<![\d+])\+(?:[1-9]\d{7,14}|(?!1[ .\-(])[1-9]\d{0,2}(?:[ .\-]\(?\d{1,8}\)?){1,5})(?!\d)"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_BY_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
# a whole run of numbers with 13 digits or more; a number that begins another kind of candidate is not part of it
_OTHER = "|".join([r"\d{1,2}/\d{1,2}/\d{4}(?![\d/])", r"\d{1,2}\.\d{1,2}\.\d{4}(?![\d/])", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)", r"\d{4}-\d{2}-\d{2}(?![\d\-])",
                   r"\d{3}-\d{2}-\d{4}(?![\d\-])", r"\d{3}[.\-]\d{3}[ .\-]\d{4}(?!\d)", r"[A-Za-z0-9._%+\-]{1,64}@"])
# of the length that the country has, else of any length; the numbers behind it belong to the candidate, for it may be none
IBAN = rf"(?<![A-Za-z0-9])(?:{_BY_COUNTRY}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])(?: (?!{_OTHER})\d++)*+"
CARD = rf"(?<![\d.\-])(?=\d(?:[ \-]?\d){{12}})\d++(?:[ \-](?!{_OTHER})\d++)*+"
PLAIN_CARD = r"\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{4,5}"
CANDIDATE = "|".join([EMAIL, ISO_DATE, SHORT_DATE, SSN, PHONE, FOREIGN_PHONE, IP, IBAN, CARD])


def _is(m: Column, pattern: str) -> Column:
    return m.rlike(f"^(?:{pattern})$")


def permute(values: Column, ranges: Column, key: str, label: str) -> Column:
    """Keyed permutation of an array of ints; the element at i stays in [0, ranges[i])."""
    half = F.floor(F.size(values) / 2).cast("int")

    def digest(number: Column, other: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), number.cast("string"), F.array_join(other.cast("array<string>"), ",")), 256)

    def shifted(part: Column, bounds: Column, hashed: Column) -> Column:
        return let(hashed, lambda h: F.transform(part, lambda v, i: (
            (v + F.conv(F.substr(h, (i * 2) % 60 + 1, F.lit(4)), 16, 10).cast("int")) % F.get(bounds, i)).cast("int")))

    def rounds(n: Column, low: Column, high: Column) -> Column:
        start = F.struct(F.slice(values, F.lit(1), n).alias("a"), F.slice(values, n + 1, F.size(values) - n).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda s, k: F.when(
            k % 2 == 0, F.struct(shifted(s["a"], low, digest(k, s["b"])).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), shifted(s["b"], high, digest(k, s["a"])).alias("b"))),
            lambda s: F.concat(s["a"], s["b"]))

    return let(half, lambda n: rounds(n, F.slice(ranges, F.lit(1), n), F.slice(ranges, n + 1, F.size(values) - n)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def by_character(m: Column, key: str, label: str, lowest: Column | None = None, highest: Column | None = None) -> Column:
    """Permute digits within digits and letters within letters of their case; other characters stay.

    `lowest`, `highest`: smallest and largest digit allowed for the n-th digit, as arrays (missing: 0 and 9).
    """
    chars = F.split(m, "")

    def base(c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)

    def low(n: Column) -> Column:
        return F.lit(0) if lowest is None else F.coalesce(F.get(lowest, n), F.lit(0))

    def high(n: Column) -> Column:
        return F.lit(9) if highest is None else F.coalesce(F.get(highest, n), F.lit(9))

    slots = F.filter(chars, lambda c: c.rlike("^[0-9a-zA-Z]$"))
    values = lambda s: F.transform(s, lambda c, i: (F.ascii(c) - base(c) - low(i)).cast("int"))
    ranges = lambda s: F.transform(s, lambda c, i: F.when(base(c) == 48, high(i) - low(i) + 1).otherwise(26).cast("int"))

    def rebuilt(new: Column) -> Column:
        empty = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
        return F.aggregate(chars, empty, lambda a, c: F.when(
            base(c).isNull(), F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n"))).otherwise(
            F.struct(F.concat(a["s"], F.char(base(c) + F.get(new, a["n"]) + low(a["n"]))).alias("s"), (a["n"] + 1).alias("n"))),
            lambda a: a["s"])

    return let(slots, lambda s: let(permute(values(s), ranges(s), key, label), rebuilt))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capitals (A = 10)."""
    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int")
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def valid_card(m: Column) -> Column:
    digits = _digits(m)
    return F.length(digits).between(13, 19) & digits.rlike("^[2-6]") & (luhn_sum(digits) % 10 == 0)


def _card(m: Column, key: str) -> Column:
    body = F.concat(F.left(m, F.lit(1)), by_character(F.substr(m, F.lit(2), F.length(m) - 2), key, "card"))
    return let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(_digits(b), F.lit("0"))) % 10) % 10).cast("string")))


def _numbers(m: Column, key: str) -> Column:
    """(s, n): a run of numbers with new cards, and how many; `m` may hold cards next to dates, codes and other cards.

    Any numbers that stand side by side may be a card.  Those laid out like one are chosen first, from left to right,
    then valid ones of other layouts that begin or end the run, the longest first, then phone numbers.
    """
    def spans(tokens: Column) -> Column:
        n = F.size(tokens)
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda k: F.struct(
            i.alias("i"), k.alias("k"), F.regexp_replace(F.array_join(F.slice(tokens, i + 1, k), ""), r"[ \-]$", "").alias("t"))))
        open_ = F.filter(F.flatten(each), lambda x: F.length(x["t"]).between(12, 37))

        def kind(x: Column) -> Column:
            edge = (x["i"] == 0) | (x["i"] + x["k"] == n)
            plain = _is(x["t"], PLAIN_CARD)
            return F.when((plain | edge) & valid_card(x["t"]), F.when(plain, 1).otherwise(2)).when(_is(x["t"], PHONE), 3)

        graded = F.transform(open_, lambda x: F.struct(kind(x).alias("kind"), x["i"].alias("i"), (-x["k"]).alias("k"), x["t"].alias("t")))
        return F.array_sort(F.filter(graded, lambda x: x["kind"].isNotNull()))

    def apart(found: Column) -> Column:
        return F.aggregate(found, F.filter(found, lambda x: F.lit(False)), lambda kept, x: F.when(
            F.exists(kept, lambda y: (y["i"] < x["i"] - x["k"]) & (x["i"] < y["i"] - y["k"])), kept).otherwise(F.concat(kept, F.array(x))))

    def rebuilt(tokens: Column, chosen: Column) -> Column:
        new = F.transform(chosen, lambda x: F.struct(x["i"].alias("i"), (x["i"] - x["k"]).alias("j"), x["t"].alias("t"),
                                                     F.when(x["kind"] < 3, _card(x["t"], key)).otherwise(_phone(x["t"], key)).alias("s")))

        def one(token: Column, at: Column, c: Column) -> Column:
            over = F.filter(c, lambda x: (x["i"] <= at) & (at < x["j"]))
            tail = F.regexp_extract(token, r"[ \-]?$", 0)
            return let(over, lambda o: F.when(F.size(o) == 0, token).otherwise(F.concat(
                F.when(F.get(o, F.lit(0))["i"] == at, F.get(o, F.lit(0))["s"]).otherwise(F.lit("")),
                F.when(F.get(o, F.lit(0))["j"] == at + 1, tail).otherwise(F.lit("")))))

        return let(new, lambda c: F.struct(F.array_join(F.transform(tokens, lambda x, at: one(x, at, c)), "").alias("s"),
                                           F.size(F.filter(c, lambda x: x["s"] != x["t"])).alias("n")))

    return let(F.regexp_extract_all(m, F.lit(r"\d+[ \-]?"), F.lit(0)), lambda t: let(spans(t), lambda f: let(apart(f), lambda c: rebuilt(t, c))))


def _iban_only(m: Column, key: str) -> Column:
    country, rest = F.left(m, F.lit(2)), F.substr(m, F.lit(5), F.length(m))
    plain = lambda r: F.regexp_replace(r, " ", "")
    return let(by_character(rest, key, "iban"), lambda r: F.concat(
        country, F.lpad((98 - mod97(F.concat(plain(r), country, F.lit("00")))).cast("string"), 2, "0"), r))


def _iban(m: Column, key: str) -> Column:
    """(s, n): the beginning that validates, that of the country's length or the longest; what follows it, or all of a candidate without one, may hold cards and phone numbers."""
    words = F.split(m, " ")

    def valid(p: Column) -> Column:
        flat = F.regexp_replace(p, " ", "")
        return F.length(flat).between(12, 35) & (mod97(F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.left(flat, F.lit(4)))) == 1)

    starts = F.concat(F.array(F.regexp_extract(m, rf"^(?:{_BY_COUNTRY})(?![A-Za-z0-9])", 0)), F.transform(
        F.sequence(F.least(F.size(words), F.lit(34)), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")))

    def both(p: Column) -> Column:
        rest = F.when(p.isNull(), m).otherwise(F.substr(m, F.length(p) + 1, F.length(m)))
        new = F.when(p.isNotNull(), _iban_only(p, key))
        return let(rest, lambda r: let(_within(r, key), lambda x: let(new, lambda q: F.struct(
            F.concat(F.coalesce(q, F.lit("")), x["s"]).alias("s"), (x["n"] + F.when(q != p, 1).otherwise(0)).alias("n")))))

    return let(F.get(F.filter(starts, valid), F.lit(0)), both)


def _within(text: Column, key: str) -> Column:
    """(s, n): the cards and phone numbers inside a failed or too long candidate."""
    inner = f"{PHONE}|{CARD}"

    def joined(new: Column) -> Column:
        return F.struct(F.array_join(F.zip_with(F.split(text, inner, -1), new, lambda a, b: F.concat(a, F.coalesce(b["s"], F.lit("")))), "").alias("s"),
                        F.aggregate(new, F.lit(0), lambda a, x: a + x["n"]).alias("n"))

    each = lambda m: F.when(_is(m, PHONE), _counted(_phone(m, key), m)).otherwise(_numbers(m, key))
    return let(F.transform(F.regexp_extract_all(text, F.lit(inner), F.lit(0)), each), joined)


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(\+1[ .\-]?)?", 0)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    # area code and exchange keep to 2-9 or to 0-1, so no number of either kind meets a pseudonym of the other kind
    first = lambda n: F.substr(_digits(rest), F.lit(n), F.lit(1)) >= "2"
    limits = lambda common, rare, other: F.array(*[F.when(first(n), common).otherwise(rare) if n in (1, 4) else F.lit(other) for n in (1, 2, 3, 4)])
    return F.concat(head, by_character(rest, key, "phone", limits(2, 0, 0), limits(9, 1, 9)))


def _foreign_phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^\+(?:\d{2}(?=\d{6})|\d+)", 0)
    valid = F.length(_digits(m)).between(8, 15)
    return F.when(valid, F.concat(head, by_character(F.substr(m, F.length(head) + 1, F.length(m)), key, "phone+")))


def _email(m: Column, key: str) -> Column:
    tail = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    return F.concat(by_character(F.left(m, F.length(m) - F.length(tail)), key, "email"), tail)


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.").cast("array<int>")
    new = permute(parts, F.array_repeat(F.lit(256), 4), key, "ip")
    return F.when(F.forall(parts, lambda x: x < 256), F.array_join(new.cast("array<string>"), "."))


def _ssn(m: Column, key: str) -> Column:
    p = F.split(m, "-").cast("array<int>")
    area, group, serial = F.get(p, 0), F.get(p, 1), F.get(p, 2)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = permute(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    return F.when(valid, let(new, lambda v: F.format_string(
        "%03d-%02d-%04d", F.get(v, 0) + F.when(F.get(v, 0) > 664, 2).otherwise(1), F.get(v, 1) + 1, F.get(v, 2) + 1)))


def _moved(day: Column, key: str) -> Column:
    """The date that stands for a date; null outside the range."""
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    new = permute(F.array(F.floor(n / 256).cast("int"), (n % 256).cast("int")), F.array_repeat(F.lit(256), 2), key, "date")
    return F.when(n.between(0, DAYS - 1), let(new, lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(v, 0) * 256 + F.get(v, 1))))


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(month.between(1, 12) & day.between(1, 31), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def _iso_date(m: Column, key: str) -> Column:
    p = F.split(m, "-").cast("array<int>")
    return F.date_format(_moved(_date(F.get(p, 0), F.get(p, 1), F.get(p, 2)), key), "yyyy-MM-dd")


def _short_date(m: Column, key: str) -> Column:
    """Day first; month first where only that is a date."""
    sign = F.when(m.contains("/"), "/").otherwise(".")
    parts = F.split(m, "[./]")
    p = parts.cast("array<int>")
    day_first, month_first = _date(F.get(p, 2), F.get(p, 1), F.get(p, 0)), _date(F.get(p, 2), F.get(p, 0), F.get(p, 1))
    short = (F.length(F.get(parts, 0)) == 1) | (F.length(F.get(parts, 1)) == 1)

    def written(d: Column, first: str, second: str) -> Column:
        return F.when(short, F.concat(F.date_format(d, first), sign, F.date_format(d, second), sign, F.date_format(d, "yyyy"))) \
            .otherwise(F.concat(F.date_format(d, first * 2), sign, F.date_format(d, second * 2), sign, F.date_format(d, "yyyy")))

    by_day = let(_moved(day_first, key), lambda d: F.when(d.isNotNull(), written(d, "d", "M")))
    by_month = let(_moved(month_first, key), lambda d: F.when(d.isNotNull(), written(d, "M", "d")))
    return F.when(day_first.isNotNull(), by_day).otherwise(by_month)


def _counted(new: Column, m: Column) -> Column:
    """(s, n) of one value: its pseudonym, or the value itself if it does not validate."""
    return let(new, lambda s: F.struct(F.coalesce(s, m).alias("s"), F.when(s != m, 1).otherwise(0).alias("n")))


KINDS = [(EMAIL, _email), (ISO_DATE, _iso_date), (SHORT_DATE, _short_date), (SSN, _ssn), (PHONE, _phone),
         (FOREIGN_PHONE, _foreign_phone), (IP, _ip)]
RUNS = [(IBAN, _iban), (CARD, _numbers)]  # may hold several values


def pseudonym(m: Column, key: str) -> Column:
    """(s, n): the string that stands for one candidate, and how many values in it are changed."""
    out = F.struct(m.alias("s"), F.lit(0).alias("n"))
    for pattern, kind in reversed(RUNS):
        out = F.when(_is(m, pattern), kind(m, key)).otherwise(out)
    for pattern, kind in reversed(KINDS):
        out = F.when(_is(m, pattern), _counted(kind(m, key), m)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counter: str | None = None) -> DataFrame:
    """Replace every valid personal value in `text`; `counter` names a column for the number of changed values."""
    t, found, new = F.col(f"`{text}`"), free_name(docs, "_found"), free_name(docs, "_new")
    out = docs.withColumn(found, F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)))) \
        .withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    joined = F.array_join(F.zip_with(F.split(t, CANDIDATE, -1), F.col(new), lambda a, b: F.concat(a, F.coalesce(b["s"], F.lit("")))), "")
    columns = {text: F.when(F.col(new).isNull(), t).otherwise(joined)}
    if counter:
        columns[counter] = F.when(F.col(new).isNull(), 0).otherwise(F.aggregate(F.col(new), F.lit(0), lambda a, x: a + x["n"]))
    return out.withColumns(columns).drop(found, new)
