"""Numbers and periods from text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a number, scales, and the order in which units are told apart.
NUMBER = r"(?i)(-)?([$€£])?\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(million|billion|thousand|mn|bn|k|m|b|x)?\s*(%|percent)?"
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "mn": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9}
TABLE_SCALES = {"hundreds": 1e2, "thousands": 1e3, "millions": 1e6, "billions": 1e9}
# A number with its sign, currency, scale and percent as it stands in running text.
IN_TEXT = r"(?<![\w.,])-?[$€£]?\s?\d(?:[\d,]*\d)?(?:\.\d+)?(?:\s*(?:million|billion|thousand|mn|bn|k|m|b|x)\b)?(?:\s*%|\s+percent\b)?"
TABLE_SCALE = r"(?i)\(\s*(?:in|amounts?\s+in)\s+(thousands|millions|billions|hundreds)\b[^)]*\)"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` takes from it."""
    return F.get(F.transform(F.array(value), f), 0)


def let_list(value: Column, f) -> Column:
    """``let`` for an ``f`` that gives an array. Taking an item asks for the type of all that ``f`` does, row by row; flattening doesn't."""
    return F.flatten(F.transform(F.array(value), f))


def scale_of(suffix: Column, scales: dict[str, float]) -> Column:
    def factor(lower: Column) -> Column:
        out = F.lit(1.0)
        for name, x in scales.items():
            out = F.when(lower == name, x).otherwise(out)
        return out

    return F.when(suffix == "", 1.0).otherwise(let(F.lower(suffix), factor))  # most numbers have none


def parts(text: Column, pattern: str, *groups: int) -> Column:
    """Struct p0, p1 and so on of these groups of the first match, each empty without one."""
    return F.struct(*[F.regexp_extract(text, pattern, k).alias(f"p{k}") for k in groups])


def parse_number(text: Column) -> Column:
    """Struct of value, unit and raw text of the first number, or null. A percentage keeps its figure: 45 % is 45."""
    return F.when(text.rlike(r"\d"), let(parts(text, NUMBER, *range(6)), number_of))  # each group is read once


def number_of(found: Column) -> Column:
    """What ``parse_number`` gives, from the parts of NUMBER."""
    part = lambda k: found[f"p{k}"]
    number, suffix = part(3), part(4)
    value = F.replace(number, F.lit(","), F.lit("")).try_cast("double") * scale_of(suffix, SCALES) * F.when(part(1) == "-", -1).otherwise(1)
    unit = (
        F.when(part(5) != "", "percent").when(part(2) != "", "currency").when(F.lower(suffix) == "x", "ratio")
        .when((suffix != "") | F.contains(number, F.lit(",")) | F.contains(number, F.lit(".")), "count").otherwise("other")
    )
    return F.when(number != "", F.struct(value.alias("value"), unit.alias("unit"), F.trim(part(0)).alias("raw")))


def review_number(text: Column) -> Column:
    """The review side's reading: percentages become fractions."""
    n = parse_number(text)
    return F.when(n["unit"] == "percent", n["value"] / 100).otherwise(n["value"])


def table_scale(text: Column) -> Column:
    """The factor that a note such as (in thousands) puts on a table; 1 without a note."""
    return scale_of(F.regexp_extract(text, TABLE_SCALE, 1), TABLE_SCALES)


def cell_scale(note: Column, stub: Column, raw: Column) -> Column:
    """The factor of one cell: that of the table's note, but 1 in a row marked (actual), and for an amount with a currency
    sign where the note makes exceptions."""
    own = F.contains(F.lower(stub), F.lit("(actual)"))
    money = note.rlike(r"(?i)except\s+as\s+(?:otherwise\s+)?noted") & raw.rlike(r"[$€£]")
    return F.when(F.coalesce(own, F.lit(False)) | F.coalesce(money, F.lit(False)), 1.0).otherwise(table_scale(F.coalesce(note, F.lit(""))))


# Metrics whose bare numbers are percentages where the context speaks of retention, and the words for that.
PERCENT_BY_CONTEXT = ["cm_net_revenue_retention", "cm_gross_revenue_retention", "cm_gross_retention_rate"]
RETENTION = r"(?i)retention|retained|churn|renewal|ndr|nrr|grr|dollar-based net expansion"
# What may stand before a spelled number.
APPROXIMATE = r"(?i)\b(?:about|roughly|approximately|nearly|almost|around|over|more\s+than|close\s+to|just\s+under|just\s+over|exceeded|surpassed|topped)\s+"


def promoted_unit(metric: Column, unit: Column, context: Column) -> Column:
    """A bare number of a retention metric is a percentage where the context speaks of retention."""
    bare = unit.isin("count", "other") & metric.isin(PERCENT_BY_CONTEXT)
    return F.when(bare & context.rlike(RETENTION), "percent").otherwise(unit)


def cell_number(text: Column) -> Column:
    """A cell's first number, or its spelled one, with approximations taken off. Cells without the name of a scale have none of these."""
    spelled = F.regexp_replace(text, APPROXIMATE, "")
    unit = F.when(spelled.rlike(r"[$€£]"), "currency").otherwise("count")
    word = F.struct(spelled_number(spelled).alias("value"), unit.alias("unit"), F.trim(spelled).alias("raw"))
    named = F.when(text.rlike("(?i)hundred|thousand|million|billion"), let(word, lambda w: F.when(w["value"].isNotNull(), w)))
    return F.coalesce(parse_number(text), named)


WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}


def spelled_number(text: Column) -> Column:
    """A spelled number with its scale: one billion, twelve thousand."""
    pattern = r"(?i)\b(" + "|".join(WORDS) + r")\s+(hundred|thousand|million|billion)\b"
    word = F.lower(F.regexp_extract(text, pattern, 1))
    value = F.lit(None).cast("double")
    for w, n in WORDS.items():
        value = F.when(word == w, float(n)).otherwise(value)
    return value * scale_of(F.regexp_extract(text, pattern, 2), SCALES | {"hundred": 1e2})


def normalise_gold(text: Column, scale_unit: Column | None = None) -> Column:
    """A gold value: currency signs and commas off, K/M/B/T scaled, a separate scale only if the text has none."""
    clean = F.regexp_replace(F.trim(text), r"[$€,\s%]", "")
    number, suffix = F.regexp_extract(clean, r"^(-?\d+(?:\.\d+)?)([KMBTkmbt]?)$", 1), F.regexp_extract(clean, r"^(-?\d+(?:\.\d+)?)([KMBTkmbt]?)$", 2)
    own = scale_of(suffix, {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12})
    other = scale_of(scale_unit, {"thousands": 1e3, "millions": 1e6, "billions": 1e9}) if scale_unit is not None else F.lit(1.0)
    return F.when(number != "", number.try_cast("double") * F.when(suffix != "", own).otherwise(other))


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def _period(kind: str, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("period_type"), start.alias("start"), end.alias("end"))


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"({MONTHS})\s+(\d{{1,2}}),?\s+((?:19|20)\d{{2}})"


def _date(text: Column, pattern: str, first: int) -> Column:
    return _day(parts(text, pattern, *range(first, first + 3)), first)


def _day(found: Column, first: int) -> Column:
    return F.try_to_date(F.concat_ws(" ", *[found[f"p{first + k}"] for k in range(3)]), "MMMM d yyyy")


def where(text: Column, pattern: str, period: Column) -> Column:
    """``period`` where the text has the pattern at all; most texts have not, and are read once then."""
    return F.when(text.rlike(pattern), period)


def parse_quarter(text: Column) -> Column:
    pattern = r"\bQ([1-4])\s*'?\s*((?:20)?\d{2})\b|\b([1-4])Q\s*'?((?:20)?\d{2})\b"

    def quarter(found):
        part = lambda k: F.nullif(found[f"p{k}"], F.lit(""))
        q, y = F.coalesce(part(1), part(3)).try_cast("int"), _year(F.coalesce(part(2), part(4)))
        start = F.make_date(y, q * 3 - 2, F.lit(1))
        return F.when(q.isNotNull(), _period("quarterly", start, F.last_day(F.add_months(start, 2))))

    return where(text, pattern, let(parts(text, pattern, 1, 2, 3, 4), quarter))


def parse_fiscal_year(text: Column, end_month: Column | None = None) -> Column:
    """The fiscal year that ends in ``end_month`` (calendar years without it)."""
    pattern = r"(?i)\b(?:FY|fiscal(?:\s+year)?|full\s+year)\s*'?((?:20)?\d{2})\b"
    month = F.coalesce(end_month, F.lit(12)) if end_month is not None else F.lit(12)

    def year(y):
        end = F.last_day(F.make_date(y, month, F.lit(1)))
        return F.when(y.isNotNull(), _period("annual", F.date_add(F.last_day(F.add_months(end, -12)), 1), end))

    return where(text, pattern, let(_year(F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))), year))


def parse_period_ended(text: Column) -> Column:
    pattern = rf"(?i)\b(three|six|nine|twelve)\s+months\s+ended\s+{DATE}|\b(year|quarter)\s+ended\s+{DATE}"

    def ended(found):
        n, kind = F.lower(found["p1"]), F.lower(found["p5"])
        months = F.when((n == "three") | (kind == "quarter"), 3).when(n == "six", 6).when(n == "nine", 9).when((n == "twelve") | (kind == "year"), 12)
        return let(F.struct(months.alias("months"), F.coalesce(_day(found, 2), _day(found, 6)).alias("end")), lambda x: period(x["months"], x["end"]))

    def period(months, end):
        start = F.date_add(F.last_day(F.add_months(end, -months)), 1)
        type_ = F.when(months == 3, "quarterly").when(months == 12, "annual").otherwise("ytd")
        return F.when(end.isNotNull() & months.isNotNull(), F.struct(type_.alias("period_type"), start.alias("start"), end.alias("end")))

    return where(text, pattern, let(parts(text, pattern, *range(1, 9)), ended))


def parse_as_of(text: Column) -> Column:
    pattern = rf"(?i)\b(?:as\s+of|at)\s+{DATE}"
    return where(text, pattern, let(_date(text, pattern, 1), lambda at: F.when(at.isNotNull(), _period("point_in_time", at, at))))


def parse_date(text: Column) -> Column:
    return where(text, DATE, let(_date(text, DATE, 1), lambda at: F.when(at.isNotNull(), _period("point_in_time", at, at))))


def parse_plain_year(text: Column) -> Column:
    y = F.nullif(F.regexp_extract(text, r"^\s*(20\d{2})\s*$", 1), F.lit("")).try_cast("int")
    return F.when(y.isNotNull(), _period("annual", F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31))))


def parse_trailing(text: Column, as_of: Column) -> Column:
    hit = text.rlike(r"(?i)\b(?:TTM|LTM|trailing\s+twelve\s+months|last\s+twelve\s+months)\b")
    return F.when(hit, _period("trailing", F.date_add(F.add_months(as_of, -12), 1), as_of))


def parse_ytd(text: Column, as_of: Column) -> Column:
    hit = text.rlike(r"(?i)\b(?:YTD|year[\s-]to[\s-]date)\b")
    return F.when(hit, _period("ytd", F.trunc(as_of, "year"), as_of))


def parse_relative_quarter(text: Column, as_of: Column) -> Column:
    """This or last quarter, or a bare Q4, against the document's date."""
    this = F.trunc(as_of, "quarter")
    bare = F.nullif(F.regexp_extract(text, r"\bQ([1-4])\b(?!\s*'?\d)", 1), F.lit("")).try_cast("int")
    start = F.when(text.rlike(r"(?i)\bthis\s+quarter\b"), this).when(text.rlike(r"(?i)\blast\s+quarter\b"), F.add_months(this, -3))
    start = F.coalesce(start, F.make_date(F.year(as_of), bare * 3 - 2, F.lit(1)))
    return F.when(start.isNotNull(), _period("quarterly", start, F.last_day(F.add_months(start, 2))))


PERIOD = "struct<period_type:string,start:date,end:date>"


def first_period(*parsed: Column) -> Column:
    """The first of these periods that isn't null; those behind it are not computed."""
    return F.coalesce(*[p.cast(PERIOD) for p in parsed])


def infer_period(header: Column | None, sentence: Column, as_of: Column, extended: Column | None = None, hint: Column | None = None) -> Column:
    """The first that says a period: a hint that goes with the value (0.85), its headers (0.9), its sentence (0.7), the text
    around it (0.5), or the document's date (0.3)."""

    def any_of(text):
        return [parse_quarter(text), parse_period_ended(text), parse_fiscal_year(text), parse_ytd(text, as_of), parse_trailing(text, as_of), parse_as_of(text), parse_relative_quarter(text, as_of)]

    def sure(period, confidence):
        return let(period.cast(PERIOD), lambda p: F.when(p.isNotNull(), F.struct(p.alias("p"), F.lit(confidence).alias("confidence"))))

    def said(text, confidence, *more):
        # The text itself may be dear (a sentence is cut out), so it is computed once for all readers.
        return sure(let(text, lambda t: first_period(*any_of(t), *[parse(t) for parse in more])), confidence)

    found = []
    if hint is not None:
        found.append(said(hint, 0.85, parse_plain_year))
    if header is not None:
        found.append(said(header, 0.9, parse_date, parse_plain_year))
    found.append(said(sentence, 0.7))
    if extended is not None:
        found.append(said(extended, 0.5))
    found.append(sure(_period("point_in_time", as_of, as_of), 0.3))
    best = F.coalesce(*found)  # later places are not read once one has said a period
    return let(best, lambda x: F.struct(x["p"]["period_type"].alias("period_type"), x["p"]["start"].alias("start"), x["p"]["end"].alias("end"), x["confidence"].alias("confidence")))


# Characters on either side of a value that are its context; where a sentence ends.
CONTEXT, SENTENCE = 200, r"(?<=[.!?])\s+(?=[A-Z])"


def sentence_at(text: Column, at: Column) -> Column:
    """The sentence that the 1-based character lies in."""
    return F.concat(F.element_at(F.split(F.substr(text, F.lit(1), at - 1), SENTENCE), -1), F.get(F.split(F.substr(text, at), SENTENCE), 0))


def around(text: Column, at: Column, n: int = CONTEXT) -> Column:
    first = F.greatest(F.lit(1), at - n)
    return F.substr(text, first, at + n - first)


def parse_cohort_label(label: Column) -> Column:
    """Struct of kind (acquisition, tenure, other) and normalised bucket."""
    part = lambda p, k=1: F.nullif(F.regexp_extract(label, p, k), F.lit(""))
    cohort = r"(?i)\b((?:19|20)\d{2})\b\s*cohort|cohort\s*(?:of\s*)?\b((?:19|20)\d{2})\b"
    year = F.coalesce(part(cohort), part(cohort, 2))
    months, years = r"(?i)(\d+)\s*-\s*(\d+)\s*(?:months?|mos?\b)", r"(?i)(\d+)\s*-\s*(\d+)\s*years?"
    plus, less = r"(?i)(\d+)\s*\+\s*years?", r"(?i)(?:less\s+than|<)\s*(\d+)"
    in_years = lambda c: (c.try_cast("int") / 12).cast("int")
    bucket = F.coalesce(
        F.concat(in_years(part(months)).cast("string"), F.lit("-"), in_years(part(months, 2)).cast("string"), F.lit("y")),
        F.concat(part(years), F.lit("-"), part(years, 2), F.lit("y")),
        F.concat(part(plus), F.lit("y+")),
        F.concat(F.lit("<"), F.when(label.rlike(r"(?i)month|\bmos?\b"), in_years(part(less)).cast("string")).otherwise(part(less)), F.lit("y")),
    )
    kind = F.when(year.isNotNull(), "acquisition").when(bucket.isNotNull(), "tenure").otherwise("other")
    return F.when(F.coalesce(label, F.lit("")) != "", F.struct(kind.alias("kind"), F.coalesce(year, bucket, label).alias("bucket")))
