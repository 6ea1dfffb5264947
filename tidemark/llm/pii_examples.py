"""Examples that the chooser of personal data learns from: values written into snippets of corpus texts.

Half of them are personal data in forms that the base rules don't cover, half are look-alikes.  Digits and choices come
from a hash of the example's number, so that examples are the same at every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_rows
from tidemark.llm.pii import KINDS, RESIDENT_LETTERS

PEOPLE = ("anna", "ben", "clara", "david", "elena", "frank", "greta", "hugo", "j.doe", "maria_k", "sales", "info")
HOSTS = ("example", "mailhost", "acme", "uni-x", "post9", "home", "cloud7", "shop")
SUFFIXES = ("com", "org", "net", "edu", "de", "fr", "es", "io")
PLAIN = ("noon", "table", "matrix", "line", "house", "river", "print", "matter")
# For each kind, what is written before: cues that speak for it, and those that speak for something else.
CUE = {
    "email": (("mail: ", "contact ", "write to ", "e-mail "), ("version ", "meet ", "id ")),
    "ip": (("host ", "server ", "ip: ", "address "), ("version ", "build ", "ref ")),
    "card": (("card ", "visa: ", "account ", "card no. "), ("order ", "invoice ", "ref ")),
    "phone": (("call ", "tel. ", "phone: ", "fax ", "mobile "), ("order ", "isbn ", "date ", "total ", "page ", "id ")),
    "secret": (('token = "', "api_key=", "password: ", "secret "), ("commit ", "sha1 ", "checksum ", "file ")),
    "national": (("ssn ", "ssn: ", "social security number ", "national insurance ", "nino ", "dni "), ("part ", "ref ", "order ", "flight ", "room ")),
}
# Forms that are data by what is written before them, and nothing without it.
CUED = ("secret", "phone by cue")


def number(salt: int, limit: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(limit))


def digits(salt: int, n: int) -> Column:
    return F.lpad(number(salt, 10**n).cast("string"), n, "0")


def one_of(values, salt: int) -> Column:
    columns = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.get(F.array(*columns), number(salt, len(columns)).cast("int"))


def with_check(body: Column, shift: Column, n: int = 15) -> Column:
    """``n`` digits and the last one that makes them pass (with another shift, fail) the card check."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(body, i, F.lit(1))) - 48
        return total + F.when(i % 2 == n % 2, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    weighed = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), add)
    return F.concat(body, F.pmod(F.lit(10) - weighed % 10 + shift, F.lit(10)).cast("string"))


def grouped(sixteen: Column, separator: Column) -> Column:
    return F.concat_ws("", *(x for i in range(4) for x in ([separator] if i else []) + [F.substring(sixteen, 4 * i + 1, 4)]))


def mixed(salt: int, n: int, alphabet: str) -> Column:
    """``n`` characters of an alphabet."""
    pick = lambda i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64("row", F.lit(salt), i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), pick), "")


HEX, BASE62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def forms() -> list[tuple[str, bool, list[Column]]]:
    """(kind, right, forms)."""
    person, host, end = F.concat(one_of(PEOPLE, 1), F.when(number(2, 3) == 0, digits(3, 2)).otherwise("")), one_of(HOSTS, 4), one_of(SUFFIXES, 5)
    octets = [number(10 + i, 256).cast("string") for i in range(4)]
    large = [number(20 + i, 700).cast("string") for i in range(3)] + [(number(23, 600) + 300).cast("string")]
    dot = one_of(("[.]", "(.)", "[dot]", "(dot)"), 14)
    card, wrong = with_check(F.concat(F.lit("4"), digits(30, 14)), F.lit(0)), with_check(F.concat(F.lit("4"), digits(30, 14)), number(31, 9) + 1)
    gap = one_of((".", "  ", " - ", "--", ". "), 32)
    a, b, c = digits(40, 3), digits(41, 3), digits(42, 4)
    year, month, day = (number(43, 40) + 1985).cast("string"), F.lpad((number(44, 12) + 1).cast("string"), 2, "0"), F.lpad((number(45, 28) + 1).cast("string"), 2, "0")
    j = F.concat
    apart = one_of((" ", "-", "."), 113)
    short, wrong_short = (j(F.substring(x, 1, 4), apart, F.substring(x, 5, 6), apart, F.substring(x, 11, 5)) for shift in (F.lit(0), number(31, 9) + 1) for x in [with_check(F.concat(one_of(("34", "37"), 114), digits(34, 12)), shift, 14)])
    area, group, serial = F.lpad((number(100, 665) + 1).cast("string"), 3, "0"), F.lpad((number(101, 99) + 1).cast("string"), 2, "0"), F.lpad((number(102, 9999) + 1).cast("string"), 4, "0")
    between, pairs, last = one_of(("-", " ", "."), 103), [digits(104 + i, 2) for i in range(3)], one_of(tuple("ABCD"), 107)
    insured, uninsured = one_of(("AB", "CE", "JG", "PX", "SR", "TW"), 108), one_of(("QQ", "FD", "NT", "ZZ", "IX"), 108)
    eight = digits(109, 8)
    letter = lambda shift: F.substring(F.lit(RESIDENT_LETTERS), (F.pmod(eight.cast("long") + shift, F.lit(23)) + 1).cast("int"), F.lit(1))
    return [
        ("email", True, [j(person, at, host, dots, end) for at, dots in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", "."), ("@", "(dot)"), (" AT ", " DOT ")) for at, dots in [(F.lit(at), F.lit(dots))]] + [j(person, one_of(("[at]", "(at)", " at ", "@"), 15), host, F.lit("(dot)co(dot)uk"))]),
        ("email", False, [j(person, F.lit(" at "), one_of(PLAIN, 6), F.lit(" dot "), one_of(PLAIN, 7)), j(digits(8, 2), F.lit("@"), digits(9, 1)), j(one_of(PLAIN, 6), F.lit("@"), digits(8, 1), F.lit("x")), j(one_of(PLAIN, 6), F.lit("(at)"), one_of(PLAIN, 7), F.lit("(dot)"), digits(9, 1))]),
        ("ip", True, [F.concat_ws("", octets[0], dot, octets[1], dot, octets[2], dot, octets[3])]),
        ("ip", False, [F.concat_ws("", large[0], dot, large[1], dot, large[2], dot, large[3])]),
        ("card", True, [grouped(card, gap), grouped(card, gap), short]),
        ("card", False, [grouped(wrong, gap), wrong, j(year, month, day, digits(33, 8)), grouped(wrong, F.lit(" ")), wrong_short]),
        ("phone", True, [j(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), j(a, F.lit("-"), b, F.lit("-"), c), j(a, F.lit("."), b, F.lit("."), c), j(F.lit("0"), a, F.lit(" "), digits(46, 7)), j(F.lit("00"), digits(47, 2), F.lit(" "), a, F.lit(" "), b, F.lit(" "), c), j(F.lit("0"), digits(48, 1), *(x for i in range(4) for x in (F.lit(" "), digits(50 + i, 2))))]),
        ("phone by cue", True, [j((number(65, 8) + 2).cast("string"), digits(66, 9))]),
        ("national", True, [j(area, between, group, between, serial), j(area, between, group, between, serial), F.concat_ws(" ", insured, *pairs, last), j(insured, *pairs, last), j(eight, one_of(("", "-"), 110), letter(F.lit(0)))]),
        ("national", False, [j(one_of(("000", "666", "923", "987"), 111), between, group, between, serial), j(area, between, F.lit("00"), between, serial), F.concat_ws(" ", uninsured, *pairs, last), j(uninsured, *pairs, last), j(eight, one_of(("", "-"), 110), letter(number(112, 22) + 1))]),
        ("phone", False, [j(year, F.lit("-"), month, F.lit("-"), day), j(year, month, day), j(F.lit("978-"), digits(60, 1), F.lit("-"), digits(61, 2), F.lit("-"), digits(62, 6), F.lit("-"), digits(63, 1)), j((number(64, 90) + 10).cast("string"), F.lit(" "), a, F.lit(" "), b), j((number(65, 9) + 1).cast("string"), digits(66, 9)), j((number(67, 8999999) + 1000000).cast("string"), F.lit("."), digits(68, 2)), j(year, F.lit(" - "), (number(69, 20) + 2025).cast("string")), j(day, F.lit("."), month, F.lit("."), year), j((number(65, 9) + 1).cast("string"), digits(66, 7))]),
        ("secret", True, [mixed(70, 40, HEX), mixed(71, 32, BASE62), j(F.lit("AKIA"), F.upper(mixed(72, 16, BASE62))), mixed(73, 24, BASE62 + "_-")]),
        ("secret", False, [j(one_of(PLAIN, 74), F.lit("-"), one_of(PLAIN, 75), F.lit("-"), one_of(PLAIN, 76), F.lit("-"), digits(77, 4), F.lit("-xx")), mixed(70, 40, HEX), F.concat_ws("-", mixed(78, 8, HEX), mixed(79, 4, HEX), mixed(80, 4, HEX), mixed(81, 12, HEX)), j(F.lit("data/"), one_of(PLAIN, 74), F.lit("/"), one_of(PLAIN, 75), F.lit("/part-"), digits(82, 5))]),
    ]


def written(docs: DataFrame, sample_docs: int, examples: int) -> DataFrame:
    """(row, text, kind, right, start, end): ``examples`` texts with one value each, its places in code points.

    ``sample_docs`` texts at most lend snippets; they are numbered in one task, and broadcast.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    texts = text_rows(docs)
    # About twice as many texts by their hash, so that what is sorted and cut to the bound doesn't grow.
    share = min(1.0, 2 * sample_docs / max(texts.count(), 1))
    texts = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    at = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - 120, F.lit(1))) + 1).cast("int")
    # Digits of the text beside a value would become part of it.
    left = F.regexp_replace(F.substring("text", at, F.lit(60)), r"[0-9\s().+@-]+$", "")
    right_text = F.regexp_replace(F.substring("text", at + 60, F.lit(60)), r"^[0-9\s().+@-]+", "")
    snippets = texts.select(left.alias("left"), right_text.alias("right_text")).distinct().orderBy(F.xxhash64("left", "right_text"), "left", "right_text").limit(sample_docs)
    snippets = snippets.withColumn("k", F.row_number().over(Window.orderBy("left", "right_text")) - 1)
    n = max(snippets.count(), 1)
    rows = spark.range(examples).withColumnRenamed("id", "row").withColumn("k", number(90, n).cast("int")).join(F.broadcast(snippets), "k", "left")
    made = forms()
    value = F.get(F.array(*(F.get(F.array(*f), number(91, len(f)).cast("int")) for *_, f in made)), F.col("form"))
    rows = rows.withColumn("form", F.pmod("row", F.lit(len(made))).cast("int")).withColumn("value", value)
    kind = F.get(F.array(*(F.lit(KINDS.index(k.split()[0])) for k, *_ in made)), F.col("form"))
    right = F.get(F.array(*(F.lit(r) for _, r, _ in made)), F.col("form"))
    own, other = (F.get(F.array(*(one_of(CUE[k.split()[0]][side], 92 + side) for k, *_ in made)), F.col("form")) for side in (0, 1))
    # Look-alikes have a cue of their own more often than one that misleads; digests are told from secrets by it alone.
    chance = number(94, 20)
    cued = F.get(F.array(*(F.lit(k in CUED) for k, *_ in made)), F.col("form"))
    cue = F.when(F.col("right"), F.when((chance < 14) | cued, own).otherwise("")).otherwise(F.when(chance < 9, other).when((chance < 11) & (F.col("kind") != KINDS.index("secret")), own).otherwise(""))
    rows = rows.withColumns({"kind": kind, "right": right}).withColumn("cue", cue)
    before = F.concat(F.coalesce("left", F.lit("")), F.lit(" "), F.col("cue"))
    start = F.char_length(before).cast("long")
    text = F.concat(before, "value", F.when(number(95, 3) == 0, ",").when(number(95, 3) == 1, ".").otherwise(""), F.lit(" "), F.coalesce("right_text", F.lit("")))
    return rows.select("row", text.alias("text"), "kind", "right", start.alias("start"), (start + F.char_length("value")).alias("end"))
