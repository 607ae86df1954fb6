r"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates are found by pattern, validated, and permuted by a keyed
Feistel network within the set of valid values of their format, so the result
is valid again, equal values get equal pseudonyms in every document, and the
holder of the key can undo them (``decrypt``).

A value becomes a pair (x, y) with 0 <= x < a and 0 <= y < b; each round adds
a keyed hash of one to the other (mod a or b), a permutation for any a and b.

=======  ==========================================  ===========================
kind     format and validation                       permuted
=======  ==========================================  ===========================
card     13-19 digits, plain or grouped, Luhn        all but the check digit,
                                                     which is computed anew
phone    NANP numbers, +1 or not; area and exchange  area code x subscriber,
         codes do not begin with 0 or 1              both staying valid
intl     + and 8-15 digits                           digits after the first two
ssn      ddd-dd-dddd, no area 000, 666 or 9xx, no    area x (group, serial)
         group 00, no serial 0000
ipv4     four numbers up to 255                      the 32-bit address
ymd dmy  yyyy-mm-dd, yyyy/mm/dd; dd.mm.yyyy;         the day within 1900-2099
mdy      mm/dd/yyyy; real days of 1900-2099
email    local part and domain                       letters and digits of the
                                                     local part, class by class
=======  ==========================================  ===========================

Separators stay where they are; a number written with other separators keeps
the pseudonym of its digits. What fails validation stays as it is.

Defined cases: null text stays null; empty texts and texts without matches
stay equal; a null doc_id is kept; repeated rows give equal results; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common

KEY = "shopfloor-demo-key"  # a parameter: production keys come from the caller
ROUNDS = 8

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "phone": r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d]|[.-]\d)",
    "intl": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?![\d]|[.-]\d)",
    "ymd": r"(?<![\d./-])\d{4}-\d{2}-\d{2}(?![\d]|[./-]\d)|(?<![\d./-])\d{4}/\d{2}/\d{2}(?![\d]|[./-]\d)",
    "dmy": r"(?<![\d./-])\d{2}\.\d{2}\.\d{4}(?![\d]|[./-]\d)",
    "mdy": r"(?<![\d./-])\d{2}/\d{2}/\d{4}(?![\d]|[./-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)",
    "ipv4": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "card": (r"(?<!\d)(?<!\d[ -])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\d|\1\d)|\d{4}([ -])\d{6}\2\d{5}(?!\d|\2\d))"
             r"|(?<!\d)\d{13,19}(?!\d)"),
}
ANY = "|".join(PATTERNS.values())  # only "card" has groups, so \1 and \2 are its own
FIRST_DAY, DAYS = "1900-01-01", 17 * 4297  # through 2099-12-31
DATES = {"ymd": ("$1", "$2", "$3", r"^(\d{4}).(\d{2}).(\d{2})$"), "dmy": ("$3", "$2", "$1", r"^(\d{2}).(\d{2}).(\d{4})$"),
         "mdy": ("$3", "$1", "$2", r"^(\d{2}).(\d{2}).(\d{4})$")}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def _luhn(reversed_digits: Column, doubled: int) -> Column:
    """Luhn sum; ``doubled``: parity of the positions, from the right, that count double."""
    def weigh(c: Column, i: Column) -> Column:
        v = c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)
    return F.aggregate(F.transform(F.split(reversed_digits, ""), weigh), F.lit(0), lambda s, v: s + v)


def _date(m: Column, kind: str) -> Column:
    y, mo, d, pattern = DATES[kind]
    return F.try_to_date(F.regexp_replace(m, pattern, f"{y}-{mo}-{d}"), "yyyy-MM-dd")


def _day(m: Column, kind: str) -> Column:
    return F.datediff(_date(m, kind), F.lit(FIRST_DAY).cast("date")).cast("bigint")


def _octet(m: Column, k: int) -> Column:
    return F.split_part(m, F.lit("."), F.lit(k)).cast("bigint")


def _kind(m: Column) -> Column:
    """The kind of a match, or null where validation fails."""
    d = _digits(m)
    n = F.char_length(d)
    is_a = lambda k: m.rlike(rf"^(?:{PATTERNS[k]})$")
    nanp = F.right(d, F.lit(10))
    out = F.when(m.contains("@"), "email")
    for k in DATES:
        out = out.when(is_a(k), F.when(_day(m, k).between(0, DAYS - 1), k))
    out = out.when(is_a("ssn"), F.when(d.rlike("^(?!000|666|9)\\d{3}(?!00)\\d{2}(?!0000)\\d{4}$"), "ssn"))
    out = out.when(is_a("ipv4"), F.when((_octet(m, 1) < 256) & (_octet(m, 2) < 256) & (_octet(m, 3) < 256)
                                        & (_octet(m, 4) < 256), "ipv4"))
    out = out.when(is_a("phone") & nanp.rlike("^[2-9]\\d\\d[2-9]"), "phone")
    out = out.when(m.startswith("+"), F.when(n.between(8, 15), "intl"))
    return out.when(is_a("card"), F.when(_luhn(F.reverse(d), 1) % 10 == 0, "card"))


def _pair(m: Column, kind: Column) -> Column:
    """struct(a, b, x, y): the value as a pair of numbers and their bounds."""
    d = _digits(m)
    n = F.char_length(d)

    def pair(a, b, x, y) -> Column:
        as_long = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("bigint")
        return F.struct(as_long(a).alias("a"), as_long(b).alias("b"), as_long(x).alias("x"), as_long(y).alias("y"))

    def halves(s: Column, size: Column) -> Column:
        left = F.floor(size / 2).cast("int")
        return pair(_power(left), _power(size - left), s.substr(F.lit(1), left), s.substr(left + 1, size - left))

    nanp = F.right(d, F.lit(10))
    area = d.substr(1, 3).cast("bigint")
    ip = [_octet(m, k) for k in (1, 2, 3, 4)]
    day = F.coalesce(*(F.when(kind == k, _day(m, k)) for k in DATES))
    return (F.when(kind == "card", halves(d.substr(F.lit(1), n - 1), n - 1))
            .when(kind == "phone", pair(800, 8000000, nanp.substr(1, 3).cast("bigint") - 200,
                                        nanp.substr(4, 7).cast("bigint") - 2000000))
            .when(kind == "intl", halves(d.substr(F.lit(3), n - 2), n - 2))
            .when(kind == "ssn", pair(898, 99 * 9999, area - 1 - F.when(area > 666, 1).otherwise(0),
                                      (d.substr(4, 2).cast("bigint") - 1) * 9999 + d.substr(6, 4).cast("bigint") - 1))
            .when(kind == "ipv4", pair(65536, 65536, ip[0] * 256 + ip[1], ip[2] * 256 + ip[3]))
            .when(kind.isin(*DATES), pair(17, 4297, F.floor(day / 4297), day % 4297)))


def _hash(key: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, *(p.cast("string") for p in parts)), 256)


def _feistel(kind: Column, p: Column, key: Column, forward: bool) -> Column:
    """The pair after all rounds, as struct(x, y)."""
    def round_(acc: Column, i: Column) -> Column:
        h = F.conv(F.left(_hash(key, kind, p["a"], p["b"], i, F.when(i % 2 == 1, acc["y"]).otherwise(acc["x"])),
                          F.lit(15)), 16, 10).cast("bigint") % F.when(i % 2 == 1, p["a"]).otherwise(p["b"])
        step = h if forward else -h
        return F.struct(F.when(i % 2 == 1, F.pmod(acc["x"] + step, p["a"])).otherwise(acc["x"]).alias("x"),
                        F.when(i % 2 == 0, F.pmod(acc["y"] + step, p["b"])).otherwise(acc["y"]).alias("y"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS)) if forward else F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1))
    return F.aggregate(rounds, F.struct(p["x"].alias("x"), p["y"].alias("y")), round_)


def _written_like(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(is_digit, digits.substr(acc["k"], F.lit(1))).otherwise(c)).alias("out"),
                        (acc["k"] + is_digit.cast("int")).alias("k"))
    return F.aggregate(F.split(m, ""), start, put)["out"]


def _value(m: Column, kind: Column, p: Column, q: Column) -> Column:
    """The match rewritten with the pair ``q`` in place of ``p``."""
    d = _digits(m)
    n = F.char_length(d)
    text = lambda v, size: F.lpad(v.cast("string"), size, "0")

    def both(size: Column) -> Column:
        left = F.floor(size / 2).cast("int")
        return F.concat(text(q["x"], left), text(q["y"], size - left))

    payload = both(n - 1)
    check = F.pmod(-_luhn(F.reverse(payload), 0), F.lit(10)).cast("string")
    area = q["x"] + 1 + F.when(q["x"] >= 665, 1).otherwise(0)
    date = F.date_add(F.lit(FIRST_DAY).cast("date"), (q["x"] * 4297 + q["y"]).cast("int"))
    quad = F.concat_ws(".", *(v.cast("string") for v in (F.floor(q["x"] / 256), q["x"] % 256,
                                                          F.floor(q["y"] / 256), q["y"] % 256)))
    return (F.when(kind == "card", _written_like(m, F.concat(payload, check)))
            .when(kind == "phone", _written_like(m, F.concat(d.substr(F.lit(1), n - 10), text(q["x"] + 200, 3),
                                                             text(q["y"] + 2000000, 7))))
            .when(kind == "intl", _written_like(m, F.concat(F.left(d, F.lit(2)), both(n - 2))))
            .when(kind == "ssn", _written_like(m, F.concat(text(area, 3), text(F.floor(q["y"] / 9999) + 1, 2),
                                                           text(q["y"] % 9999 + 1, 4))))
            .when(kind == "ipv4", quad)
            .when(kind == "ymd", F.concat(F.date_format(date, "yyyy"), m.substr(5, 1), F.date_format(date, "MM"),
                                          m.substr(5, 1), F.date_format(date, "dd")))
            .when(kind == "dmy", F.date_format(date, "dd.MM.yyyy"))
            .when(kind == "mdy", F.date_format(date, "MM/dd/yyyy")))


def _email(m: Column, key: Column, forward: bool) -> Column:
    """Letters and digits of the local part, shifted within their class by a
    Feistel network over its two halves."""
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    half = F.floor(F.char_length(local) / 2).cast("int")

    def shift(s: Column, h: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            v = F.conv(h.substr((j % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            v = v if forward else -v
            code = F.ascii(c)
            move = lambda low, size: F.char(F.pmod(code - low + v, F.lit(size)) + low)
            return (F.when(code.between(48, 57), move(48, 10)).when(code.between(65, 90), move(65, 26))
                    .when(code.between(97, 122), move(97, 26)).otherwise(c))
        return F.array_join(F.transform(F.split(s, ""), one), "")

    def round_(acc: Column, i: Column) -> Column:
        h = _hash(key, F.lit("email"), domain, i, F.when(i % 2 == 1, acc["y"]).otherwise(acc["x"]))
        return F.struct(F.when(i % 2 == 1, shift(acc["x"], h)).otherwise(acc["x"]).alias("x"),
                        F.when(i % 2 == 0, shift(acc["y"], h)).otherwise(acc["y"]).alias("y"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS)) if forward else F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1))
    start = F.struct(F.left(local, half).alias("x"), local.substr(half + 1, F.char_length(local)).alias("y"))
    out = F.aggregate(rounds, start, round_)
    return F.concat(out["x"], out["y"], F.lit("@"), domain)


def pseudonymize(docs: DataFrame, key: str = KEY, decrypt: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, kinds (of the replaced values, in order)."""
    k = F.lit(key)
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("found", found)
    staged: list[tuple[str, Callable[[Column], Column]]] = [
        ("m", lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))),
        ("p", lambda v: F.struct(v["m"].alias("m"), v["kind"].alias("kind"), _pair(v["m"], v["kind"]).alias("p"))),
        ("q", lambda v: F.struct(v["m"].alias("m"), v["kind"].alias("kind"), v["p"].alias("p"),
                                 F.when(v["p"].isNotNull(), _feistel(v["kind"], v["p"], k, not decrypt)).alias("q"))),
        ("w", lambda v: F.struct(v["kind"].alias("kind"), F.coalesce(
            F.when(v["kind"] == "email", _email(v["m"], k, not decrypt)),
            F.when(v["q"].isNotNull(), _value(v["m"], v["kind"], v["p"], v["q"])), v["m"]).alias("text")))]
    value = F.col("found")
    for _, f in staged:
        value = F.transform(value, f)
    d = d.withColumn("value", F.when(F.size("found") > 0, value))
    between = F.split("text", ANY, -1)
    text = F.when(F.col("value").isNotNull(), F.array_join(
        F.zip_with(between, F.col("value"), lambda b, v: F.concat(b, F.coalesce(v["text"], F.lit("")))), ""))
    kinds = F.coalesce(F.filter(F.transform("value", lambda v: v["kind"]), lambda v: v.isNotNull()),
                       F.array().cast("array<string>"))
    return d.select("doc_id", F.coalesce(text, F.col("text")).alias("text"),
                    F.size(kinds).cast("long").alias("n_found"), kinds.alias("kinds"))


def op10_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(common.table(spark, sf_dir, "documents"))
