"""PII: format-preserving Feistel pseudonyms, in column expressions.

Values are found and validated kind by kind, each in what the kinds before left,
and permuted within their format under a key: a card number stays a card number with a right check digit,
a date stays a date of the same notation, an address of four octets stays one.
The permutation depends on the key and the kind only, so equal values get equal
pseudonyms in every document, and whoever has the key can undo it.

Feistel rounds run as an aggregate over the round numbers.  A string is split
into halves; each round adds a keyed hash of one half to the characters of the
other, each within its own alphabet (digits, small or capital letters).  Dates
and addresses are numbers below a * b, split into a part below a and one below b.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import computed_once

ROUNDS = 8
#: Patterns by kind; no letter, digit or joining sign may touch a match.
_BEFORE, _AFTER = "(?<![A-Za-z0-9._%+/-])", "(?![A-Za-z0-9/-]|\\.[0-9])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PLUS = "\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{2,4}\\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4})"
KINDS = {
    "email": "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){1,8}",
    "date_iso": "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "date_dmy": "[0-9]{2}[./][0-9]{2}[./][0-9]{4}",
    "ip": f"{_OCTET}(?:\\.{_OCTET}){{3}}",
    # With a country code, 15 digits at most; or national, 3-3-4 digits.
    "phone": f"(?:(?!\\+(?:[ .()-]{{0,2}}[0-9]){{16}}){_PLUS}{{3}}|{_PLUS}{{2}}"
             "|(?:\\([0-9]{3}\\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})",
    "ssn": "(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
    "card": "[0-9](?:[ -]?[0-9]){12,18}",
}
#: What may touch a match of a kind, where it is not the above: a date may be part
#: of a time, a range or a path; a card may follow digits and a sign.
_EDGES = {
    "date_iso": ("(?:(?<![A-Za-z0-9._%+-])|(?<=[0-9]{4}-[0-9]{2}-[0-9]{2}-))",
                 "(?![A-SU-Za-z0-9]|T(?![0-9])|\\.[0-9])"),
    "date_dmy": ("(?:(?<![A-Za-z0-9._%+/-])|(?<=[./][0-9]{4}[/-]))", "(?![A-SU-Za-z0-9]|T(?![0-9])|\\.[0-9])"),
    "card": ("(?:(?<![A-Za-z0-9._%+/-])|(?<=[0-9]-))", "(?![A-Za-z0-9]|\\.[0-9])"),
}
#: Shapes of cards, tried in this order: one number, usual groups, any groups.
_USUAL = ("[0-9]{13,19}", *(
    sep.join(f"[0-9]{{{n}}}" for n in groups)
    for groups in ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)) for sep in (" ", "-")))
_ANY_GROUPS = tuple(f"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1))
# 400 Gregorian years, 189 * 773 days, from this day on.
EPOCH, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def _noise(key: str, kind: str, turn: Column, *parts: Column) -> Column:
    """A number below 2^32 from SHA-256."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), *parts)
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def _turns(inverse: bool) -> Column:
    return F.array(*map(F.lit, range(ROUNDS, 0, -1) if inverse else range(1, ROUNDS + 1)))


def _shift(c: Column, by: Column) -> Column:
    """The character moved along its alphabet; others stay."""
    out = c
    for first, size in (("0", 10), ("a", 26), ("A", 26)):
        moved = F.chr(F.pmod(F.ascii(c) - ord(first) + by, F.lit(size)) + ord(first))
        out = F.when((c >= first) & (c <= chr(ord(first) + size - 1)), moved).otherwise(out)
    return out


def permute_text(value: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A keyed permutation of a string that keeps the alphabet of each character;
    signs stay, and a string of one character is only shifted."""
    sign = -1 if inverse else 1

    def halves(chars: Column) -> Column:
        half = (F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, F.lit(1), half).alias("l"),
                         F.slice(chars, half + 1, F.size(chars) - half).alias("r"))

        def turn(acc: Column, k: Column) -> Column:
            fixed, moved = (acc["l"], acc["r"]) if inverse else (acc["r"], acc["l"])
            said = F.array_join(fixed, "")
            new = F.transform(moved, lambda c, i: _shift(
                c, sign * F.pmod(_noise(key, kind, k, i.cast("string"), said), F.lit(260))))
            # Forward (l, r) -> (r, l + f(r)); back (r, m) -> (m - f(r), r).
            return (F.struct(new.alias("l"), fixed.alias("r")) if inverse
                    else F.struct(fixed.alias("l"), new.alias("r")))

        return F.aggregate(_turns(inverse), start, turn,
                           lambda acc: F.concat(F.array_join(acc["l"], ""), F.array_join(acc["r"], "")))

    return F.element_at(F.transform(F.array(F.split(value, "")), halves), 1)


def permute_number(n: Column, a: int, b: int, key: str, kind: str, inverse: bool = False) -> Column:
    """A keyed permutation of the numbers below ``a * b``."""
    start = F.struct(F.floor(n / b).cast("long").alias("l"), F.pmod(n, F.lit(b)).cast("long").alias("r"))

    def turn(acc: Column, k: Column) -> Column:
        odd = k % 2 == 1
        sign = -1 if inverse else 1
        left = F.pmod(acc["l"] + sign * _noise(key, kind, k, acc["r"].cast("string")), F.lit(a))
        right = F.pmod(acc["r"] + sign * _noise(key, kind, k, acc["l"].cast("string")), F.lit(b))
        return F.struct(F.when(odd, left).otherwise(acc["l"]).cast("long").alias("l"),
                        F.when(odd, acc["r"]).otherwise(right).cast("long").alias("r"))

    return F.aggregate(_turns(inverse), start, turn, lambda acc: acc["l"] * b + acc["r"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(ds: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted once."""
    def add(acc: Column, d: Column) -> Column:
        x = F.when(acc["twice"], d.cast("int") * 2).otherwise(d.cast("int"))
        return F.struct((acc["s"] + x - F.when(x > 9, 9).otherwise(0)).alias("s"), (~acc["twice"]).alias("twice"))

    return F.aggregate(F.split(F.reverse(ds), ""), F.struct(F.lit(0).alias("s"), F.lit(False).alias("twice")),
                       add, lambda acc: acc["s"])


def _refill(value: Column, ds: Column) -> Column:
    """``value`` with its digits replaced by those of ``ds``, in order."""
    def fill(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(acc["t"], F.when(digit, F.substr(ds, acc["i"], F.lit(1))).otherwise(c)).alias("t"),
            (acc["i"] + F.when(digit, 1).otherwise(0)).alias("i"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), fill,
                       lambda acc: acc["t"])


def _card(value: Column, key: str, inverse: bool) -> Column:
    ds = digits(value)
    body = permute_text(F.substr(ds, F.lit(1), F.length(ds) - 1), key, "card", inverse)
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return _refill(value, F.concat(body, check.cast("string")))


def _date(value: Column, form: str, key: str, inverse: bool) -> Column:
    day = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(form))), F.lit(EPOCH).cast("date")).cast("long")
    new = permute_number(day, DAYS_A, DAYS_B, key, "date", inverse)
    return F.date_format(F.date_add(F.lit(EPOCH).cast("date"), new.cast("int")), form)


def _ip(value: Column, key: str, inverse: bool) -> Column:
    n = F.aggregate(F.split(value, "\\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    m = permute_number(n, 65536, 65536, key, "ip", inverse)
    return F.concat_ws(".", *[F.pmod(F.floor(m / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def _valid_date(value: Column, form: str) -> Column:
    d = F.to_date(F.try_to_timestamp(value, F.lit(form)))
    last = F.date_add(F.lit(EPOCH).cast("date"), DAYS_A * DAYS_B - 1)
    return F.coalesce(d.between(F.lit(EPOCH).cast("date"), last), F.lit(False))


_DMY, _DOTTED, _MDY = "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy"


def _late_day(value: Column, key: str, inverse: bool) -> Column:
    """A date MM/dd/yyyy whose day is above 12, so that it cannot be read as
    dd/MM/yyyy, permuted among such dates: these days are numbered, 88497 in all."""
    first = F.lit(EPOCH).cast("date")
    day = F.to_date(F.try_to_timestamp(value, F.lit(_MDY)))
    months = (F.year(day) - int(EPOCH[:4])) * 12 + F.month(day) - 1
    n = permute_number((F.datediff(day, first) - 12 * (months + 1)).cast("long"), 9, 9833, key, "date_mdy", inverse)

    def month_of(n: Column) -> Column:  # the last month with fewer such days before it
        near = F.floor(n / (DAYS_A * DAYS_B / 4800 - 12)).cast("int")
        month = F.array_max(F.filter(
            F.sequence(F.greatest(F.lit(0), near - 2), near + 2),
            lambda m: F.datediff(F.add_months(first, m), first) - 12 * m <= n))
        return F.date_add(first, (n + 12 * (month + 1)).cast("int"))

    return F.date_format(F.element_at(F.transform(F.array(n), month_of), 1), _MDY)


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is a value of the kind."""
    if kind == "date_iso":
        return _valid_date(value, "yyyy-MM-dd")
    if kind == "date_dmy":
        return _valid_date(value, _DMY) | _valid_date(value, _DOTTED) | _valid_date(value, _MDY)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "card":
        ds = digits(value)
        return (F.pmod(luhn_sum(ds), F.lit(10)) == 0) & ~ds.rlike("^0+$")
    return F.lit(True)


def _cut(part: Column, kind: str, pattern: Column) -> Column:
    """The pieces of a text between and at the matches of a pattern."""
    def pieces(p: Column, m: Column) -> Column:
        return F.array(F.struct(F.lit(None).cast("string").alias("kind"), p.alias("value")),
                       F.struct(F.when(_valid(kind, m), kind).alias("kind"), m.alias("value")))

    return F.filter(F.flatten(F.zip_with(F.split(part, pattern, -1), F.regexp_extract_all(part, pattern, F.lit(0)),
                                         pieces)), lambda x: x["value"].isNotNull())


def _cut_cards(part: Column, shapes: tuple[str, ...]) -> Column:
    """The pieces of a text at its valid cards.  Numbers side by side may be read as
    one run: at each place where a number starts every shape is tried, so that no
    invalid run hides a card that begins or ends within it."""
    before, after = _EDGES["card"]
    tried = F.concat(*[F.regexp_extract_all(part, F.lit(f"{before}(?=({x}){after})"), F.lit(1)) for x in shapes])
    valid = F.filter(F.array_distinct(tried), lambda v: _valid("card", v))
    # Digits, blanks and hyphens stand for themselves in a pattern.
    return F.element_at(F.transform(F.array(F.array_join(valid, "|")), lambda one: F.when(one != "", _cut(
        part, "card", F.concat(F.lit(before + "(?:"), one, F.lit(")" + after)))).otherwise(_rest(part))), 1)


def _rest(part: Column) -> Column:
    return F.array(F.struct(F.lit(None).cast("string").alias("kind"), part.alias("value")))


def _passes() -> list[tuple[str, Callable[[Column], Column]]]:
    """(pattern without which a text stays whole, cut of a text) in order."""
    out = []
    for kind, x in KINDS.items():
        if kind != "card":
            before, after = _EDGES.get(kind, (_BEFORE, _AFTER))
            pattern = before + x + after
            out.append((pattern, lambda part, kind=kind, pattern=pattern: _cut(part, kind, F.lit(pattern))))
    for shapes in (_USUAL, _ANY_GROUPS):
        out.append((KINDS["card"], lambda part, shapes=shapes: _cut_cards(part, shapes)))
    return out


def pseudonym(value: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The value of the same format that stands for ``value``; without a kind, itself."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    country = F.regexp_extract(value, "^\\+[0-9]{1,3}?(?=[ .(-])|^\\+[0-9]", 0)
    rest = F.substr(value, F.length(country) + 1)
    ssn = permute_text(digits(value), key, "ssn", inverse)
    dmy = (F.when(F.substring(value, 3, 1) == ".", _date(value, _DOTTED, key, inverse))
           .when(_valid_date(value, _DMY), _date(value, _DMY, key, inverse))
           .otherwise(_late_day(value, key, inverse)))
    return (F.when(kind == "email", F.concat(permute_text(local, key, "email", inverse), F.lit("@"), domain))
            .when(kind == "date_iso", _date(value, "yyyy-MM-dd", key, inverse))
            .when(kind == "date_dmy", dmy)
            .when(kind == "ip", _ip(value, key, inverse))
            .when(kind == "phone", F.concat(country, _refill(rest, permute_text(digits(rest), key, "phone", inverse))))
            .when(kind == "ssn", _refill(value, ssn))
            .when(kind == "card", _card(value, key, inverse))
            .otherwise(value))


def pseudonymise(docs: DataFrame, carry: list[Column], text: Column, key: str,
                 inverse: bool = False) -> DataFrame:
    """``carry`` columns, ``text`` with pseudonyms in place of personal values,
    ``n_found`` and an array ``found`` of struct(kind, value, pseudonym).

    Values that fail their validation (check digit, calendar, octets) stay, and hide
    none that begins or ends within them.  Dates with slashes are dd/MM, or MM/dd
    where only that is a date; both count as ``date_dmy``.  Phones have a country
    code or are national of 3-3-4 digits; other national notations stay.
    ``inverse`` undoes the permutation for texts made under the same key (a
    pseudonym of the social-security format may fail its validation, then it
    stays; a card in groups beside other groups of digits may be cut elsewhere, if
    the check digit is right there by chance).  Null texts stay null with nothing
    found; repeated rows give a row each; nothing is shuffled.
    """
    df = docs.select(F.struct(*carry).alias("_row"), text.alias("_t"))
    df = df.select("*", F.when(F.col("_t").isNotNull(), _rest(F.col("_t"))).otherwise(
        F.array().cast("array<struct<kind:string,value:string>>")).alias("_k"))
    for pattern, cut in _passes():
        df = df.select("_row", "_t", F.when(F.col("_t").rlike(pattern), F.flatten(F.transform(
            "_k", lambda s: F.when(s["kind"].isNull() & s["value"].rlike(pattern), cut(s["value"])).otherwise(
                F.array(F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))))).otherwise(F.col("_k")).alias("_k"))
        df = df.select("_row", "_t", computed_once(F.struct("_k")).alias("_s")).select("_row", "_t", "_s._k")
    df = df.select("*", F.transform("_k", lambda k: F.struct(
        k["kind"].alias("kind"), k["value"].alias("value"),
        F.when(k["kind"].isNull(), k["value"]).otherwise(
            pseudonym(k["value"], k["kind"], key, inverse)).alias("pseudonym"))).alias("_f"))
    found = F.filter("_f", lambda f: f["kind"].isNotNull())
    text = F.when(F.size("_f") > 1, F.array_join(F.transform("_f", lambda f: f["pseudonym"]), "")).otherwise(F.col("_t"))
    out = F.struct(text.alias("text"), F.size(found).cast("long").alias("n_found"), found.alias("found"))
    return df.select("_row", computed_once(out).alias("_out")).select("_row.*", "_out.*")
