"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their own check (Luhn, mod 97, octets, number plan, calendar) are replaced by
another value of the same format: a keyed Feistel network permutes the values of the format, so equal
values stay equal in all documents, different ones stay different, and the result passes the same check.
Punctuation stays where it is. E-mail addresses, access keys and passwords are no numbers; they get a keyed
digest, of the same length for keys and passwords. Hexadecimal strings are equal in either case and keep theirs.
Spaces around the = of a password are accepted if its value has a digit, 8 characters or more and no brackets.

| found | check | permuted |
|-|-|-|
| payment card, 13 to 19 digits | starts with 2 to 6, Luhn | all digits but the last, which is computed anew |
| IBAN | mod 97 | digits behind the check digits, which are computed anew |
| social security number | area, group and serial in use | within the numbers in use |
| telephone number | ten digits in groups, or + and 8 to 15 digits | the last ten digits, or all behind the second |
| IPv4 address | octets up to 255 | the 32 bits |
| date y-m-d, d.m.y, m/d/y, d/m/y | exists, 1900 to 2099 | the day within these years |

Only column expressions are used; nothing is shuffled, so a text's length and the number of its copies do not
matter. Defined results: a null text stays null, an empty one empty. Repeated rows give repeated rows, an
empty table an empty one. All other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31; 17 * 4297 days
DAYS_LEFT, DAYS_RIGHT = 17, 4297

EMAIL = r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
PASSWORD = r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api_key|apikey)(?:=[^\s\"'&;,]+| *= *(?=[^\s\"'&;,=()]*[0-9])[^\s\"'&;,=()]{8,}+(?![(=]))"
HEX_SECRET = r"(?<=\")[0-9a-fA-F]{40}(?=\")"
DATE = r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/-]|\.[0-9])"
IP = r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
CARD = r"(?<![\w.-])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w-]|\.[0-9])|(?<![\w.-])3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\w-]|\.[0-9])"
PHONE = r"(?<![\w.+-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])|(?<![\w.+-])\+[0-9](?:[ .-]?[0-9]){7,14}(?![\w-]|\.[0-9])"
KINDS = {"email": EMAIL, "access_key": ACCESS_KEY, "password": PASSWORD, "hex_secret": HEX_SECRET, "iban": IBAN, "date": DATE, "ip": IP, "ssn": SSN, "card": CARD, "phone": PHONE}
ANY = "|".join(KINDS.values())


def feistel(kind: str, left: Column, right: Column, lefts: Column, rights: Column, key: str) -> Column:
    """A keyed permutation of the pairs (l below ``lefts``, r below ``rights``), as a struct (l, r)."""

    def number(turn: Column, half: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), F.lit(kind), lefts.cast("string"), rights.cast("string"), turn.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + number(i, s["r"]), lefts).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + number(i, s["l"]), rights).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _permuted_digits(kind: str, digits: Column, key: str) -> Column:
    """Another string of as many digits (2 to 34)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    pair = feistel(kind, F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n), power(half), power(n - half), key)
    return F.concat(F.lpad(pair["l"].cast("string"), half, F.lit("0")), F.lpad(pair["r"].cast("string"), n - half, F.lit("0")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits, in order, replaced by ``digits``."""

    def add(s: Column, c: Column) -> Column:
        new = F.struct(F.concat(s["o"], F.substring(digits, s["k"], F.lit(1))).alias("o"), (s["k"] + 1).alias("k"))
        return F.when(c.rlike("^[0-9]$"), new).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["k"].alias("k")))

    return F.aggregate(F.regexp_extract_all(value, F.lit("."), F.lit(0)), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), add)["o"]


def _luhn_digit(payload: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.regexp_extract_all(F.reverse(payload), F.lit("."), F.lit(0)), worth), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = F.length(digits).between(13, 19) & (_luhn_digit(payload) == F.substring(digits, F.length(digits), F.lit(1)))
    new = _permuted_digits("card", payload, key)
    return F.when(valid, _refilled(value, F.concat(new, _luhn_digit(new))))


def _mod97(text: Column) -> Column:
    """Remainder of an alphanumeric string, A as 10 to Z as 35."""

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.regexp_extract_all(text, F.lit("."), F.lit(0)), F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    plain = F.regexp_replace(value, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    valid = (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & (F.length(_digits(account)) > 1)
    new = _refilled(account, _permuted_digits("iban", _digits(account), key))
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _refilled(value, F.concat(check, _digits(new))))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel("ssn", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key)
    new_area = pair["l"] + F.when(pair["l"] >= 665, 2).otherwise(1)
    return F.when(valid, F.format_string("%03d-%02d-%04d", new_area, F.floor(pair["r"] / 9999) + 1, pair["r"] % 9999 + 1))


def _phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    fixed = F.when(value.rlike(r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}$") & (F.length(digits) >= 10), F.length(digits) - 10).otherwise(2)
    valid = F.length(digits).between(8, 15)
    return F.when(valid, _refilled(value, F.concat(F.substring(digits, F.lit(1), fixed), _permuted_digits("phone", F.substring(digits, fixed + 1, F.length(digits)), key))))


def _ip(value: Column, key: str) -> Column:
    octet = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("int")
    o = [octet(i) for i in (1, 2, 3, 4)]
    pair = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key)
    new = [F.floor(pair["l"] / 256), pair["l"] % 256, F.floor(pair["r"] / 256), pair["r"] % 256]
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), F.concat_ws(".", *[x.cast("string") for x in new]))


def _date(value: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for shape, form in (("/", "dd/MM/yyyy"), ("/", "MM/dd/yyyy"), (".", "dd.MM.yyyy"), ("-", "yyyy-MM-dd")):
        day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        pair = feistel("date", F.floor(day / DAYS_RIGHT), day % DAYS_RIGHT, F.lit(DAYS_LEFT), F.lit(DAYS_RIGHT), key)
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["l"] * DAYS_RIGHT + pair["r"]).cast("int")), form)
        out = F.when(F.contains(value, F.lit(shape)) & day.between(0, DAYS - 1), new).otherwise(out)
    return out


def _digest(kind: str, value: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256)


def pseudonym(value: Column, key: str) -> Column:
    """The replacement of one found string; itself where it does not pass the check of its format."""
    whole = lambda kind: value.rlike("^(?:" + KINDS[kind].replace("(?<=\\\")", "").replace("(?=\\\")", "") + ")$")
    head = F.regexp_extract(value, r"^([A-Za-z_]+(?:=| *= *))", 1)
    secret = F.substring(value, F.length(head) + 1, F.length(value))
    stretched = F.repeat(_digest("password", secret, key), F.ceil(F.length(value) / 64).cast("int"))
    hexadecimal = F.substring(_digest("hex_secret", F.lower(value), key), 1, 40)
    new = (
        F.when(whole("email"), F.concat(F.lit("user-"), F.substring(_digest("email", F.lower(value), key), 1, 16), F.lit("@example.invalid")))
        .when(whole("access_key"), F.concat(F.substring(value, 1, 4), F.upper(F.substring(_digest("access_key", value, key), 1, 16))))
        .when(whole("password"), F.concat(head, F.substring(stretched, F.lit(1), F.length(secret))))
        .when(whole("hex_secret"), F.when(value.rlike("[A-F]") & ~value.rlike("[a-f]"), F.upper(hexadecimal)).otherwise(hexadecimal))
        .when(whole("date"), _date(value, key))
        .when(whole("ip"), _ip(value, key))
        .when(whole("ssn"), _ssn(value, key))
    )
    return F.coalesce(new, F.when(whole("iban"), _iban(value, key)), F.when(whole("card"), _card(value, key)), F.when(whole("phone"), _phone(value, key)), value)


def _replaced(text: Column, key: str) -> tuple[Column, Column]:
    """New text and number of strings changed."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    new = F.transform(found, lambda v: pseudonym(v, key))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(between, new, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    maybe = text.rlike("[0-9@=]|AKIA|ASIA|[A-Fa-f]{40}")
    return F.when(maybe, joined).otherwise(text), F.when(maybe, changed).otherwise(0)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of the text column replaced. ``key`` must be kept secret."""
    new, _ = _replaced(F.col(f"`{text}`"), key)
    return docs.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def pseudonyms(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the new text and ``n_replaced`` of every row."""
    new, changed = _replaced(F.col("_text"), key)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return rows.select("doc_id", new.alias("text"), F.coalesce(changed, F.lit(0)).cast("long").alias("n_replaced"))
