"""Format-preserving pseudonyms for personal numbers, dates and addresses, with DataFrame functions only.

A value is found by pattern, validated, and read as a row of symbols, each from an alphabet of its own size: digits,
letters, octets, the parts of a date. A Feistel network of ``ROUNDS`` rounds over the two halves of the row adds to each
symbol a keyed hash of the other half, modulo the symbol's alphabet: a permutation of all rows of that format, so
that equal values get equal pseudonyms in every document and different values different ones. Separators, case and
length stay; check digits are computed anew, so a pseudonym passes the validation that its value passed.

=========  =====================================================================================================
email      local part letter by letter and digit by digit; the domain stays
card       13 to 19 digits that pass the Luhn check; the last is computed anew
iban       remainder 1 modulo 97; the account part is permuted, the check digits are computed anew
ip         four octets up to 255; each octet keeps its number of digits
phone      a country code and up to 15 digits with it, or three groups of 3, 3 and 4 digits; the country code
           stays, leading digits keep to their range
ssn        three groups of 3, 2 and 4 digits in their valid ranges
date       a day of 1900 to 2099 as year-month-day, day.month.year or month/day/year; month and day of one
           digit keep to it
=========  =====================================================================================================

Defined results: text NULL or empty stays; what does not validate stays as it is; a value that repeats gets the same
pseudonym each time; long texts are read whole, in time linear in their length; other columns stay as they are;
an empty table gives an empty table. A permutation may map a value of a very small format (an address
``a@example.com``) onto itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofledger.llm.common import let

ROUNDS = 8
#: The formats, in the order in which they are tried at a place. None starts or ends inside a longer token.
FREE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# A domain has 127 labels at most, so the repeated group stays shallow.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}(?<=\.[A-Za-z]{2,24})"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
YEAR, TWO = "(?:19|20)[0-9]{2}", "[0-9]{1,2}"
DATE = FREE + rf"(?:{YEAR}([-/.]){TWO}\1{TWO}|{TWO}\.{TWO}\.{YEAR}|{TWO}/{TWO}/{YEAR})" + END
IP = r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[\p{L}\p{N}])"
SSN = FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + END
PHONE = (r"(?:(?<![\p{L}\p{N}+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
         # 7 to 15 digits, the country code's included, in any groups.
         r"|(?<![\p{L}\p{N}+])\+[2-9](?:[ .-]?\(?[0-9]\)?){6,14}"
         r"|(?<![\p{L}\p{N}])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?<![\p{L}\p{N}])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})" + END)
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: The groups of a card and of an IBAN; a shorter reading ends with one of them.
CARD_GROUP, IBAN_GROUP = "[ -]?[0-9]+", " ?[A-Z0-9]+"
#: Every format has one of these characters.
HINT = "[0-9@]"
#: Alphabets of letters: small and capital letters share their places, so case does not matter to the permutation.
SMALL, CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL_LATIN, CAPITAL_LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
OCTET = r"(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
DAYS = (319, 229)  # the days of 1900 to 2099 are 319 * 229


def symbol(value: Column, radix: Column) -> Column:
    """A symbol and the size of its alphabet; size 1 stays what it is."""
    return F.struct(value.cast("long").alias("v"), radix.cast("long").alias("r"))


def permuted(symbols: Column, tweak: Column, key: str) -> Column:
    """The symbols' values after the Feistel rounds, each of which looks at every symbol once."""
    def rounds(held: Column) -> Column:
        half = F.floor(F.size(held) / 2)

        def turn(values: Column, t: Column) -> Column:
            left = (t % 2) == 0
            other = F.when(left, F.slice(values, half + 1, F.size(values))).otherwise(F.slice(values, F.lit(1), half))
            seed = F.concat(F.lit(f"{key}/"), tweak, F.lit("/"), t.cast("string"), F.lit("/"),
                            F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
            # The other half is hashed once a round; each symbol then takes that digest with its place.
            paired = F.zip_with(values, held["r"], lambda x, r: F.struct(x.alias("v"), r.alias("r")))
            return let(F.sha2(seed.cast("binary"), 256), lambda s: F.transform(paired, lambda p, i: F.when(
                (i < half) == left, F.pmod(p["v"] + keyed(s, i), p["r"])).otherwise(p["v"])))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), held["v"], turn)

    return let(symbols, rounds)


def keyed(seed: Column, i: Column) -> Column:
    digest = F.sha2(F.concat(seed, F.lit("/"), i.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0))


def written(chars: Column, key: str, tweak: Column) -> Column:
    """Letters and digits permuted, each within its alphabet; other characters stay."""
    alphabets = ["0123456789", SMALL, CAPITAL, SMALL_LATIN, CAPITAL_LATIN]

    def read(c: Column) -> Column:
        at = F.array(*[F.instr(F.lit(a), c) for a in alphabets])
        return let(at, lambda a: let(F.greatest(*[F.element_at(a, k + 1) for k in range(len(alphabets))]), lambda p: symbol(
            F.greatest(p - 1, F.lit(0)), F.coalesce(*[
                F.when(F.element_at(a, k + 1) > 0, F.lit(len(alphabet))) for k, alphabet in enumerate(alphabets)], F.lit(1)))))

    def write(c: Column, value: Column) -> Column:
        return F.coalesce(*[
            F.when(F.instr(F.lit(a), c) > 0, F.substring(F.lit(a), (value + 1).cast("int"), F.lit(1))) for a in alphabets], c)

    return let(chars, lambda cs: F.array_join(F.zip_with(cs, permuted(F.transform(cs, read), tweak, key), write), ""))


def digits_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("long"))


def filled(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, one after the other."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    step = F.aggregate(letters(text), start, lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.element_at(digits, s["k"] + 1).cast("string")).alias("out"), (s["k"] + 1).alias("k")),
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))))
    return step["out"]


def luhn_sum(digits: Column, shift: int) -> Column:
    """The Luhn sum; ``shift`` 0 doubles every second digit from the last but one, 1 from the last."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when((i + shift) % 2 == 1, F.floor(d * 2 / 10) + (d * 2) % 10).otherwise(d))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, d: a + d)


def card_valid(m: Column) -> Column:
    return luhn_sum(digits_of(m), 0) % 10 == 0


def card(m: Column, key: str) -> Column:
    def use(d: Column) -> Column:
        body = F.slice(d, F.lit(1), F.size(d) - 1)
        new = permuted(F.transform(body, lambda x: symbol(x, F.lit(10))), F.lit("card"), key)
        whole = let(new, lambda n: F.concat(n, F.array(F.pmod(-luhn_sum(n, 1), F.lit(10)).cast("long"))))
        return F.when(luhn_sum(d, 0) % 10 == 0, let(whole, lambda w: filled(m, w)))

    return let(digits_of(m), use)


def remainder_97(text: Column) -> Column:
    return F.aggregate(letters(text), F.lit(0).cast("long"), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("long")) % 97).otherwise((a * 100 + F.instr(F.lit(CAPITAL), c) + 9) % 97))


def iban_valid(m: Column) -> Column:
    return let(F.regexp_replace(m, " ", ""), lambda flat: remainder_97(F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))) == 1)


def iban(m: Column, key: str) -> Column:
    def use(flat: Column) -> Column:
        country, account = F.substring(flat, 1, 2), F.substring(flat, 5, 40)
        new = written(letters(account), key, F.concat(F.lit("iban/"), country))
        # Blanks go back to their places: every character of the value takes the next one of the pseudonym.
        whole = let(new, lambda n: F.concat(country, F.lpad((98 - remainder_97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))
        return F.when(remainder_97(F.concat(account, F.substring(flat, 1, 4))) == 1, let(whole, lambda w: spaced(m, w)))

    return let(F.regexp_replace(m, " ", ""), use)


def spaced(text: Column, flat: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(letters(text), start, lambda s, c: F.when(
        c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))).otherwise(
        F.struct(F.concat(s["out"], F.substring(flat, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))))["out"]


def ip(m: Column, key: str) -> Column:
    def read(o: Column) -> Column:
        return F.when(F.length(o) == 1, symbol(o, F.lit(10))).when(F.length(o) == 2, symbol(o.cast("long") - 10, F.lit(90))).otherwise(
            symbol(o.cast("long") - 100, F.lit(156)))

    def write(o: Column, value: Column) -> Column:
        return (value + F.when(F.length(o) == 1, 0).when(F.length(o) == 2, 10).otherwise(100)).cast("string")

    return F.when(m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), let(F.split(m, r"\."), lambda os: F.array_join(
        F.zip_with(os, permuted(F.transform(os, read), F.lit("ip"), key), write), ".")))


def phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^(\+1(?=[ .(2-9-])|\+7|\+[0-9]{1,3}(?=[ .(-])|\+[0-9]{2})?", 1)

    def use(parts: Column) -> Column:
        code, rest = parts["code"], parts["rest"]
        american = code.isin("+1", "")

        # Area and exchange codes start with 2 to 9, others with 1 to 9; a digit outside stays outside.
        def least(d: Column, i: Column) -> Column:
            return F.when(american & i.isin(0, 3) & (d > 1), 2).when(~american & (i == 0) & (d > 0), 1).otherwise(0)

        def read(d: Column, i: Column) -> Column:
            low = least(d, i)
            return symbol(d - low, F.when(low > 0, 10 - low).when(american & i.isin(0, 3), 2).when(
                ~american & (i == 0), 1).otherwise(10))

        def fill(digits: Column) -> Column:
            valid = F.when(american, F.size(digits) == 10).otherwise(F.size(digits).between(5, 14))
            new = F.zip_with(permuted(F.transform(digits, read), F.concat(F.lit("phone/"), code), key),
                             F.transform(digits, least), lambda v, low: v + low)
            return F.when(valid, F.concat(code, let(new, lambda n: filled(rest, n))))

        return let(digits_of(rest), fill)

    return let(F.struct(code.alias("code"), F.substr(m, F.length(code) + 1).alias("rest")), use)


def ssn(m: Column, key: str) -> Column:
    def use(parts: Column) -> Column:
        area, group, serial = (F.element_at(parts, k).cast("long") for k in (1, 2, 3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        row = F.array(symbol(area - F.when(area > 666, 2).otherwise(1), F.lit(898)), symbol(group - 1, F.lit(99)), symbol(serial - 1, F.lit(9999)))

        def write(v: Column) -> Column:
            new = F.element_at(v, 1) + 1
            return F.concat_ws("-", F.lpad((new + F.when(new >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
                               F.lpad((F.element_at(v, 2) + 1).cast("string"), 2, "0"), F.lpad((F.element_at(v, 3) + 1).cast("string"), 4, "0"))

        return F.when(valid, let(permuted(row, F.lit("ssn"), key), write))

    return let(F.split(m, "-"), use)


def joined(mark: Column, *parts: Column) -> Column:
    return F.concat(parts[0], *[c for p in parts[1:] for c in (mark, p)])


def short_date(m: Column, key: str) -> Column:
    """A date with a month or day of one digit, among those whose month and day are as long."""
    parts = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    marks = F.regexp_extract_all(m, F.lit("[^0-9]"), F.lit(0))
    year_first, day_first = m.rlike(r"^[0-9]{4}"), F.contains(m, F.lit("."))

    def use(p: Column) -> Column:
        def ordered(by_year: int, by_day: int, else_: int) -> Column:
            return F.when(year_first, F.element_at(p, by_year)).when(day_first, F.element_at(p, by_day)).otherwise(F.element_at(p, else_))

        year, month, day = ordered(1, 3, 3), ordered(2, 2, 1), ordered(3, 1, 2)
        widths = F.concat(F.length(month).cast("string"), F.length(day).cast("string"))
        named = F.concat_ws("-", month.cast("int").cast("string"), day.cast("int").cast("string"))
        days = F.when(widths == "11", day_names(1, 1)).when(widths == "12", day_names(1, 2)).when(widths == "21", day_names(2, 1))
        tweak = F.concat(F.lit("date/"), widths)

        def write(new_year: Column, new_day: Column) -> Column:
            new_month, new_day = F.substring_index(new_day, "-", 1), F.substring_index(new_day, "-", -1)
            y, m, d = new_year.cast("string"), F.lpad(new_month, F.length(month), F.lit("0")), F.lpad(new_day, F.length(day), F.lit("0"))
            mark = F.element_at(marks, 1)
            return F.when(year_first, joined(mark, y, m, d)).when(day_first, joined(mark, d, m, y)).otherwise(joined(mark, m, d, y))

        def of(known: Column) -> Column:
            at = F.array_position(known, named)
            row = F.array(symbol(year.cast("long") - 1900, F.lit(200)), symbol(at - 1, F.size(known)))
            # 29 February stays, in one of the 49 leap years.
            leap = let(permuted(F.array(symbol(F.floor((year.cast("long") - 1904) / 4), F.lit(49))), tweak, key),
                       lambda v: write(F.element_at(v, 1) * 4 + 1904, F.lit("2-29")))
            return F.when(at > 0, let(permuted(row, tweak, key), lambda v: write(
                F.element_at(v, 1) + 1900, F.element_at(known, (F.element_at(v, 2) + 1).cast("int"))))).when(
                (named == "2-29") & (year.cast("long") % 4 == 0) & (year != "1900"), leap)

        return let(days, of)

    return let(parts, use)


def day_names(month: int, day: int) -> Column:
    """The days of a year, but 29 February, as month-day, whose month and day can be written with so many digits."""
    sizes = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return F.array(*[F.lit(f"{m}-{d}") for m, size in enumerate(sizes, 1) for d in range(1, size + 1)
                     if len(str(m)) <= month and len(str(d)) <= day])


def date(m: Column, key: str) -> Column:
    return F.when(F.length(m) == 10, long_date(m, key)).otherwise(short_date(m, key))


def long_date(m: Column, key: str) -> Column:
    first = F.lit("1900-01-01").cast("date")
    mark = F.regexp_extract(m, r"^[0-9]+(.)", 1)
    year_first, day_first = m.rlike(r"^[0-9]{4}"), mark == "."

    def part(text: Column, at: int, size: int) -> Column:
        return F.substring(text, at, size)

    text = F.when(year_first, F.regexp_replace(m, "[/.]", "-")).when(
        day_first, F.concat_ws("-", part(m, 7, 4), part(m, 4, 2), part(m, 1, 2))).otherwise(
        F.concat_ws("-", part(m, 7, 4), part(m, 1, 2), part(m, 4, 2)))

    def use(day: Column) -> Column:
        index = F.date_diff(day, first)
        row = F.array(symbol(F.floor(index / DAYS[1]), F.lit(DAYS[0])), symbol(index % DAYS[1], F.lit(DAYS[1])))
        new = F.aggregate(permuted(row, F.lit("date"), key), F.lit(0).cast("long"), lambda a, v: a * DAYS[1] + v)
        return F.when(day.isNotNull(), let(F.date_add(first, new.cast("int")).cast("string"), lambda d: F.when(
            year_first, joined(mark, part(d, 1, 4), part(d, 6, 2), part(d, 9, 2))).when(
            day_first, joined(mark, part(d, 9, 2), part(d, 6, 2), part(d, 1, 4))).otherwise(
            joined(mark, part(d, 6, 2), part(d, 9, 2), part(d, 1, 4)))))

    return let(F.try_to_date(text, "yyyy-MM-dd"), use)


def email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(written(letters(local), key, F.concat(F.lit("email/"), F.lower(domain))), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a match of ``formats``, or the match itself where nothing validates."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return F.coalesce(
        F.when(F.contains(m, F.lit("@")), email(m, key)), F.when(whole(IBAN), iban(m, key)), F.when(whole(DATE), date(m, key)),
        F.when(whole(IP), ip(m, key)), F.when(whole(SSN), ssn(m, key)), F.when(whole(PHONE), phone(m, key)), F.when(whole(CARD), card(m, key)), m)


def valid_readings(text: Column, pattern: str, group: str, valid: Callable[[Column], Column]) -> Column:
    """A pattern for the values of a format with check digits that ``text`` holds, or nothing: at every place where the
    format may start, the longest reading that ends with a group and is valid."""
    def longest(candidate: Column) -> Column:
        readings = let(F.regexp_extract_all(candidate, F.lit(group), F.lit(0)), lambda groups: F.transform(
            F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), "")))
        return F.get(F.filter(readings, lambda r: r.rlike(f"^(?:{pattern})$") & valid(r)), F.lit(0))

    # A look ahead takes nothing, so that a reading that fails hides none that starts behind its first group.
    candidates = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{FREE}(?=({pattern}){END})"), F.lit(1)))
    found = F.array_distinct(F.filter(F.transform(candidates, longest), lambda r: r.isNotNull()))
    longer_first = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    return let(longer_first, lambda f: F.when(F.size(f) > 0, F.concat(F.lit(f"|{FREE}(?:"), F.array_join(f, "|"), F.lit(f"){END}"))).otherwise(""))


def formats(text: Column) -> Column:
    """The pattern of all values of ``text``; of the formats with check digits only what is valid."""
    return F.concat(F.lit(EMAIL), valid_readings(text, IBAN, IBAN_GROUP, iban_valid), F.lit("|" + "|".join([DATE, IP, SSN, PHONE])),
                    valid_readings(text, CARD, CARD_GROUP, card_valid))


def replaced(text: Column, key: str) -> Column:
    """A struct of the text with pseudonyms and the number of values that got one."""
    found = let(formats(text), lambda any_of: F.struct(
        F.split(text, any_of, -1).alias("around"), F.regexp_extract_all(text, any_of, F.lit(0)).alias("found")))
    new = let(found, lambda f: let(F.transform(f["found"], lambda m: pseudonym(m, key)), lambda names: F.struct(
        F.array_join(F.zip_with(f["around"], names, lambda a, n: F.concat(a, F.coalesce(n, F.lit("")))), "").alias("text"),
        F.size(F.filter(F.zip_with(f["found"], names, lambda m, n: m != n), lambda changed: changed)).cast("long").alias("n"))))
    return F.when(text.rlike(HINT), new).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))


def pseudonymised(docs: DataFrame, key: str = "proofledger", count: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``count`` names a column for the number of values replaced."""
    both = docs.withColumn("__names", replaced(F.col("text"), key)).withColumn("text", F.col("__names.text"))
    return (both.withColumn(count, F.coalesce("__names.n", F.lit(0).cast("long"))) if count else both).drop("__names")
