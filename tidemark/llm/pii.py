"""Personal data: rules, high-recall candidates, and boosted trees that choose among the candidates.

DataFrame, SQL and ML-pipeline functions only.  A pattern's places are found by writing a mark around each match
and splitting there; lengths of the parts, summed up in three levels, are the places in code points.

1.  Base spans: e-mail, ip, card (Luhn), phone.  They always stay.
2.  Candidates, by generators that see much more than the rules: any text with an at sign, spelled-out addresses, any run
    of seven digits or more with the usual separators, addresses defanged at one point or more, any run of twenty
    characters or more with letters and digits (secrets), short runs of digits and letters in the form of a British or
    Spanish identity number.  Secrets and national identity numbers have no base rule.  They may overlap base spans and each other.
3.  Gradient-boosted trees on format (digits, groups, separators, length, checks) and context (neighbouring
    characters, a cue word before) learn which candidates are personal data.  Labels come from neither the rules nor the
    corpus: :mod:`tidemark.llm.pii_examples` writes data in forms that the rules don't cover, and look-alikes (dates,
    order numbers, versions, digests, numbers that fail a check), into snippets of corpus texts.
4.  Each kind has a threshold: the lowest at which ``min_precision`` of that kind's chosen candidates were right, among
    examples that the trees didn't see and that no base span overlaps, as only such candidates can be added.
5.  Candidates at or above their threshold that no base span overlaps are added; those that overlap each other
    become one span, of the likeliest one's kind.

The snippets are at most ``sample_docs`` (smallest hashes) and there are ``examples`` examples; all
else covers all texts.

Defined results.  A null text is empty and has no span.  Repeated rows come back repeated.  A kind without a threshold
of that precision gets no added span.  Texts of any length are read whole, in time about proportional to the text.
An empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_rows

KINDS = ("email", "ip", "card", "phone", "secret", "national")
RULED = KINDS[:4]
MARK, INSTEAD = "\x01", "\x02"
DOT = r"(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))"
# Forms of national identity numbers: American, British, Spanish, French (thirteen digits and a key of two).
SOCIAL, INSURED, RESIDENT = r"[0-9]{3}[ .-][0-9]{2}[ .-][0-9]{4}", r"[A-Z]{2} ?(?:[0-9]{2} ?){3}[A-D]", r"[XYZ0-9][0-9]{7}-?[A-Z]"
#: The letter of a Spanish number by its remainder, and what British and American numbers don't begin with.
RESIDENT_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NOT_INSURED, NOT_SOCIAL = "[DFIQUV]|.[DFIOQUV]|BG|GB|KN|NK|NT|TN|ZZ", "000|666|9|...[ .-]00|.*0000$"
# Possessive forms of the rules; a look-behind keeps a search from starting again inside a run it has already tried.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", f"{MARK}$0{MARK}"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"{MARK}$0{MARK}"),
    # Both ends of every longest run of digits with single blanks or hyphens between.
    "card": (r"(?<![0-9])(?<![0-9][ -])(?=[0-9])|(?<=[0-9])(?![ -]?[0-9])", MARK),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"{MARK}$0{MARK}"),
    "address": (r"(?<![^\s@])[^\s@]++@[^\s@]++", f"{MARK}$0{MARK}"),
    "spelled": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[(\[{] ?at ?[)\]}] ?| at |@)[A-Za-z0-9-]++(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]++)+", f"{MARK}$0{MARK}"),
    "number": (r"(?<![A-Za-z0-9])[+(]?[0-9][0-9 ().-]*[0-9]", f"{MARK}$0{MARK}"),
    "defanged": (rf"(?<![0-9])(?=[0-9.]{{1,12}}[\[(])[0-9]++(?:(?:{DOT}|\.)[0-9]++){{3}}", f"{MARK}$0{MARK}"),
    "token": (r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}+", f"{MARK}$0{MARK}"),
    "lettered": (rf"(?<![A-Za-z0-9])(?:{INSURED}|{RESIDENT})(?![A-Za-z0-9])", f"{MARK}$0{MARK}"),
}
#: A text is searched only where this is found in it.
NEEDS = {"email": "@", "address": "@", "phone": r"\+", "spelled": r"(?i)[(\[{ ]dot[)\]} ]|[(\[{] ?at ?[)\]}]", "defanged": r"[0-9][\[(](?:\.|dot)[\])][0-9]", "lettered": r"[0-9][ -]?[A-Z]"}
GENERATORS = ("address", "spelled", "number", "defanged", "token", "lettered")
#: Words before a candidate that speak for its kind, and those that speak for something else.
CUES = ("mail|contact|write", "ip|host|server|address", "card|visa|amex|mastercard|account", "phone|tel|call|mobile|fax|ring|contact", "token|secret|key|password|passwd|bearer|auth", "ssn|security|security number|insurance|insurance number|nino|dni|nie|nif|nir|sociale")
OTHER_CUES = "order|invoice|isbn|version|page|ref|commit|sha|sha1|sha256|checksum|digest|date|total|no|since|between|build|id|at|hash"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
FEATURES = ("kind", "length", "digits", "separators", "longest_gap", "plus", "parens", "dots", "colons", "at", "labels", "suffix", "luhn", "octets", "distinct", "groups", "first_group", "last_group", "zero_first", "year_first", "cue", "other_cue", "left_space", "right_space", "letters", "capitals", "official")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes; nothing but digits may be in it."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return (n > 1) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0)


def official(value: Column) -> Column:
    """Whether a value passes what its country asks of an identity number."""
    digits = digits_of(value)
    whole = F.regexp_replace(F.translate(value, "XYZ", "012"), "[^0-9]", "").cast("long")
    letter = F.substring(F.lit(RESIDENT_LETTERS), (whole % 23 + 1).cast("int"), F.lit(1)) == F.substring(value, F.char_length(value), F.lit(1))
    key = (F.char_length(digits) == 15) & digits.rlike("^[12]") & (97 - F.substring(digits, 1, 13).cast("long") % 97 == F.substring(digits, 14, 2).cast("long"))
    return F.when(value.rlike(f"^{RESIDENT}$"), letter).when(value.rlike("^[0-9]"), value.rlike(f"^(?!{NOT_SOCIAL}){SOCIAL}$") | key).otherwise(value.rlike(f"^(?!{NOT_INSURED}){INSURED}$"))


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _parts(text: Column, name: str) -> Column:
    pattern, mark = PATTERNS[name]
    return F.when(text.rlike(NEEDS.get(name, "[0-9]")), F.split(F.regexp_replace(text, F.lit(pattern), F.lit(mark)), MARK, -1)).otherwise(F.array(text))


GROUP = 64


def _sums(values: Column) -> Column:
    """The sum of each run of ``GROUP`` values."""
    last = F.floor((F.size(values) - 1) / GROUP).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda g: total(F.slice(values, g * GROUP + 1, F.lit(GROUP))))


def _places(parts: Column, lengths: Column, sums: Column, sums_of_sums: Column) -> Column:
    """Odd parts as (start, end, value); a start adds up ``GROUP`` lengths and sums at most, and whole runs of sums."""
    odd = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def place(i: Column) -> Column:
        run = F.floor(i / GROUP).cast("int")
        runs = F.floor(run / GROUP).cast("int")
        start = total(F.slice(sums_of_sums, F.lit(1), runs)) + total(F.slice(sums, runs * GROUP + 1, run - runs * GROUP)) + total(F.slice(lengths, run * GROUP + 1, i - run * GROUP))
        value = F.get(parts, i)
        return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"))

    return F.transform(odd, place)


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(digits_of(value))
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return (n >= 16) & (n <= 19) & luhn(digits_of(value))
    return (n >= 8) & (n <= 15) if kind == "phone" else F.lit(True)


def _features(kind: Column, x: Column, text: Column) -> list[Column]:
    value, before = x["value"], F.substring(text, F.greatest(x["start"].cast("int") - 15, F.lit(1)), F.least(x["start"].cast("int"), F.lit(16)))
    digits, count = digits_of(value), lambda c, p: F.regexp_count(c, F.lit(p))
    cue = lambda words: before.rlike(rf"(?i)(?<![A-Za-z0-9])(?:{words})[^A-Za-z0-9]*$")
    own = reduce(lambda c, k: c.when(kind == k, cue(CUES[k])), range(1, len(KINDS)), F.when(kind == 0, cue(CUES[0])))
    return [
        kind,
        F.char_length(value),
        F.char_length(digits),
        count(value, r"[ ().-]"),
        F.char_length(F.regexp_extract(value, "([^0-9]{2,})", 1)),
        count(value, r"\+"),
        count(value, r"[()]"),
        count(value, r"\."),
        count(value, ":"),
        count(value, "@"),
        count(F.substring_index(value, "@", -1), r"[A-Za-z0-9-]+"),
        F.when(value.rlike(r"(?i)[^A-Za-z](?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|eu)$"), 1).otherwise(0),
        F.when((F.char_length(digits) <= 19) & luhn(digits), 1).otherwise(0),
        F.when(_valid("ip", F.regexp_replace(value, DOT, ".")), 1).otherwise(0),
        F.size(F.array_distinct(F.split(value, ""))),
        count(value, "[0-9]+"),
        F.char_length(F.regexp_extract(value, "([0-9]+)", 1)),
        F.char_length(F.regexp_extract(value, "([0-9]+)[^0-9]*$", 1)),
        F.when(value.rlike(r"^\(?0"), 1).otherwise(0),
        F.when(value.rlike(r"^(?:19|20)[0-9]{2}(?:[^0-9]|[01][0-9][0-3][0-9]$)"), 1).otherwise(0),
        F.when(own, 1).otherwise(0),
        F.when(cue(OTHER_CUES), 1).otherwise(0),
        F.when((before == "") | before.rlike(r"\s$"), 1).otherwise(0),
        F.when(F.substring(text, x["end"].cast("int") + 1, F.lit(1)).rlike(r"^[\s.,;]?$"), 1).otherwise(0),
        count(value, "[A-Za-z]"),
        count(value, "[A-Z]"),
        F.when(official(value), 1).otherwise(0),
    ]


def spans(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) -> (row, doc_id, base, candidates): steps 1 and 2, one row per document."""
    names = list(PATTERNS)
    rows = rows.select("row", "doc_id", F.translate("text", MARK, INSTEAD).alias("text"))
    rows = rows.select("*", *(_parts(F.col("text"), n).alias(f"p_{n}") for n in names))
    rows = rows.select("*", *(F.transform(f"p_{n}", lambda x: F.char_length(x).cast("long")).alias(f"l_{n}") for n in names))
    rows = rows.select("*", *(_sums(F.col(f"l_{n}")).alias(f"s_{n}") for n in names))
    rows = rows.select("*", *(_sums(F.col(f"s_{n}")).alias(f"t_{n}") for n in names))
    rows = rows.select("row", "doc_id", "text", *(_places(*(F.col(f"{c}_{n}") for c in "plst")).alias(n) for n in names))

    def valid(k: int) -> Column:
        kept = F.filter(KINDS[k], lambda x: _valid(KINDS[k], x["value"]))
        return F.transform(kept, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    loose = F.concat(*(F.filter(n, lambda x: F.char_length(digits_of(x["value"])) >= 7) if n == "number" else F.col(n) for n in GENERATORS))
    rows = rows.select("row", "doc_id", "text", F.concat(*map(valid, range(len(RULED)))).alias("base"), loose.alias("loose"))

    def kinded(x: Column) -> Column:
        value, digits = x["value"], F.char_length(digits_of(x["value"]))
        spelled = value.rlike(r"(?i)@|[(\[{ ]at[)\]} ]")
        national = value.rlike(f"^(?:{SOCIAL}|{INSURED}|{RESIDENT})$") | (digits == 15) & official(value)
        short_card = (digits == 15) & digits_of(value).rlike("^3[47]") & luhn(digits_of(value))
        kind = F.when(spelled, 0).when(value.rlike(DOT), 1).when(national, 5).when(short_card, 2).when(value.rlike("[A-Za-z]"), 4).when(digits >= 16, 2).otherwise(3)
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value.alias("value"))

    rows = rows.withColumn("loose", F.transform("loose", kinded))

    def candidate(x: Column) -> Column:
        return F.struct(x["kind"].alias("of"), x["start"].alias("start"), x["end"].alias("end"), *(f.cast("double").alias(n) for n, f in zip(FEATURES, _features(x["kind"], x, F.col("text")), strict=True)))

    return rows.select("row", "doc_id", "base", F.transform("loose", candidate).alias("candidates"))


def open_candidates(found: DataFrame) -> DataFrame:
    """Rows of :func:`spans` -> the candidates that no base span overlaps, one row each.

    Base spans stand at their start, candidates at their end: of all base spans that begin before a candidate ends, the
    one that ends last overlaps it if any does.
    """
    some = found.where(F.size("candidates") > 0)
    asked = some.select("row", F.explode("candidates").alias("c")).select("row", F.col("c.end").alias("at"), F.lit(0).alias("is_base"), F.lit(None).cast("long").alias("base_end"), "c")
    none = F.lit(None).cast(asked.schema["c"].dataType)
    told = some.select("row", F.explode("base").alias("b")).select("row", F.col("b.start").alias("at"), F.lit(1).alias("is_base"), F.col("b.end").alias("base_end"), none.alias("c"))
    before = Window.partitionBy("row").orderBy("at", "is_base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = asked.unionByName(told).withColumn("last", F.max("base_end").over(before))
    return seen.where((F.col("is_base") == 0) & F.coalesce(F.col("last") <= F.col("c.start"), F.lit(True))).select("row", "c.*")


class Chooser:
    """Boosted trees and each kind's threshold; a kind without one is never chosen."""

    def __init__(self, trees, thresholds: dict[int, float] | None = None):
        self.trees, self.thresholds = trees, thresholds or {}

    def scored(self, candidates: DataFrame) -> DataFrame:
        """Adds ``p`` to rows that have the features."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        made = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(candidates))
        return made.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")

    def chosen(self, candidates: DataFrame) -> DataFrame:
        limit = reduce(lambda c, kv: c.when(F.col("of") == kv[0], kv[1]), self.thresholds.items(), F.when(F.lit(False), 2.0)).otherwise(2.0)
        return self.scored(candidates).where(F.col("p") >= limit)


def fit(docs: DataFrame, *, sample_docs: int = 5000, examples: int = 10_000, trees: int = 16, depth: int = 5, min_precision: float = 0.98) -> Chooser:
    """Texts (doc_id, text), of which ``sample_docs`` lend snippets -> chooser."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from tidemark.llm.pii_examples import written

    made = stored(written(docs, sample_docs, examples), "pii-examples")
    found = open_candidates(stored(spans(made.select("row", F.col("row").alias("doc_id"), "text")), "pii-example-spans"))
    told = made.select("row", "kind", "right", F.col("start").alias("from"), F.col("end").alias("to")).withColumnRenamed("kind", "want")
    at = (F.col("start") < F.col("to")) & (F.col("from") < F.col("end"))
    rows = found.join(told, "row").where(at).withColumn("label", (F.col("right") & (F.col("of") == F.col("want"))).cast("double"))
    rows = stored(rows.withColumn("unseen", F.pmod(F.xxhash64("row"), F.lit(4)) == 0), "pii-candidates")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows.where("NOT unseen")).select("features", "label").coalesce(1)
    chooser = Chooser(GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=7, stepSize=0.3).fit(data))
    curve = chooser.scored(rows.where("unseen")).groupBy("of", F.round("p", 3).alias("p")).agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()
    for kind in range(len(KINDS)):
        right = n = 0.0
        for r in sorted((r for r in curve if r.of == kind), key=lambda r: -r.p):
            right, n = right + r.right, n + r.n
            if right >= min_precision * n:
                chooser.thresholds[kind] = r.p - 0.0005
    return chooser


def joined(array: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: reduce(lambda c, i: c.when(k == i, KINDS[i]), range(1, len(KINDS)), F.when(k == 0, KINDS[0]))
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def united(chosen: DataFrame) -> DataFrame:
    """(row, of, start, end, p) -> (row, kind, start, end): overlapping spans as one, of the likeliest one's kind."""
    order = Window.partitionBy("row").orderBy("start", "end", "of")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = chosen.withColumn("fresh", F.when(F.col("start") < reached, 0).otherwise(1))
    grouped = fresh.withColumn("g", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy("row", "g").agg(F.max_by("of", F.struct("p", -F.col("of"))).alias("kind"), F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def find(docs: DataFrame, **options) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, base, spans): arrays of (kind, start, end), kind a number of ``KINDS``.

    ``options``: of :func:`fit`.
    """
    found = stored(spans(text_rows(docs, F.monotonically_increasing_id().alias("row"))), "spans")
    added = united(fit(docs, **options).chosen(open_candidates(found))).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    both = found.select("row", "doc_id", "base").join(added, "row", "left")
    return both.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))).alias("spans"))
