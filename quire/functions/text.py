"""Text expressions. White space is Unicode's, as in the reference semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------
CAPTION = r"(?iU)^\s*(figure|fig\.?|table|tbl\.?)\s*\d+\s*(?:[:.–—-]|(?-i:[A-Z])|$)"
TABLE_CAPTION = r"(?iU)^\s*(table|tbl\.?)\s*\d+"
PAGE_NUMBER = r"(?U)^[\s\-–—\[\(]*([0-9]+|[ivxlcIVXLC]+)[\s\-–—\]\)\.]*$"
NUMBERING = r"(?U)^\s*([0-9]+(\.[0-9]+)*|[IVXLC]+|[A-Z])[.)]?\s+"
FILLER = r"(?iU)^(our|the|a|an)\s+"
COMBINED = r"(?iU)\s+(and|&)\s+"
REFERENCE = (
    r"(?iU)\b(figures|figure|figs|fig|tables|table|tabs|tab|equations|equation|eqs|eq)"
    r"\.?\s*([0-9]+(?:\s*(?:,|and|&)\s*[0-9]+)*)"
)
GENERIC_TITLES = (
    "untitled", "untitled document", "document", "document1", "powerpoint presentation", "presentation", "slide 1", "no title",
)
EXPORT_PREFIX = "microsoft word - "
BOLD_MARKS = ("bold", "-bd", "medi", "black", "heavy", "semib", "cmbx")
MATH_MARKS = (
    "cmmi", "cmsy", "cmex", "msam", "msbm", "rsfs", "lmmath", "stix", "xits", "mathjax", "euclid", "cambria math",
)
WEAK_MATH_MARKS = ("cmr", "cmbx", "cmti", "cmss")
SECTION_KEYWORDS = (
    ("abstract", ("abstract",)),
    ("introduction", ("introduction", "motivation")),
    ("related_work", ("related work", "background", "prior work", "literature")),
    ("method", ("experimental setup", "methodology", "method", "approach", "model", "architecture", "implementation", "proposed", "system")),
    ("results", ("result", "evaluation", "experiment", "finding", "analysis")),
    ("conclusion", ("conclusion", "concluding", "summary")),
    ("references", ("reference", "bibliography")),
    ("appendix", ("appendix", "supplementary")),
    ("discussion", ("discussion", "limitation", "future work")),
)
# ---- end of fixed values --------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def flat(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+"))).cast("int")


def token_estimate(text: Column) -> Column:
    """About four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def starts_mid_word(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*\p{Ll}")


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def is_table_caption(text: Column) -> Column:
    return text.rlike(TABLE_CAPTION)


def is_page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER)


def has_mark(font: Column, marks: tuple[str, ...]) -> Column:
    lowered = F.lower(F.coalesce(font, F.lit("")))
    found = F.lit(False)
    for mark in marks:
        found = found | lowered.contains(mark)
    return found


def is_bold(font: Column) -> Column:
    return has_mark(font, BOLD_MARKS)


def is_math(font: Column) -> Column:
    return has_mark(font, MATH_MARKS)


def is_weak_math(font: Column) -> Column:
    return has_mark(font, WEAK_MATH_MARKS)


def clean_title(raw: Column, filename: Column) -> Column:
    """Null for a blank or generic title, an export's, or one that echoes the file name."""
    title = strip(raw)
    folded = F.lower(title)
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")
    useless = (
        folded.isin("", *GENERIC_TITLES)
        | folded.startswith(EXPORT_PREFIX)
        | F.coalesce((folded == F.lower(filename)) | (folded == F.lower(stem)), F.lit(False))
    )
    return F.when(raw.isNotNull() & ~useless, title)


def safe_name(ident: Column, title: Column) -> Column:
    """A legal file name: the title's letters and digits, 60 characters at most."""
    stem = F.regexp_replace(F.coalesce(title, F.lit("")), "[^A-Za-z0-9]+", "_")
    stem = F.substring(F.regexp_replace(stem, "^_+|_+$", ""), 1, 60)
    return F.when(stem == "", F.concat(ident, F.lit(".pdf"))).otherwise(F.concat(ident, F.lit("_"), stem, F.lit(".pdf")))


def strip_numbering(heading: Column) -> Column:
    return strip(F.regexp_replace(heading, NUMBERING, ""))


def classify_section(heading: Column) -> Column:
    """The section that a heading opens, else ``unknown``. A heading of two parts goes by
    the first section that it mentions anywhere, others by how they begin."""
    bare = F.lower(strip(F.regexp_replace(strip_numbering(heading), FILLER, "")))

    def first(text: Column, anchor: str) -> Column:
        out = F
        for section, keywords in SECTION_KEYWORDS:
            out = out.when(text.rlike(f"{anchor}({'|'.join(keywords)})"), section)
        return out.otherwise("unknown")

    def of(text: Column) -> Column:
        return F.when(text == "", "unknown").when(text.rlike(COMBINED), first(text, "")).otherwise(first(text, "^"))

    return F.get(F.transform(F.array(bare), of), 0)  # so that the stripped text is worked out once


def canonical_kind(word: Column) -> Column:
    """figure, table or equation for any spelling of a reference's word."""
    lowered = F.lower(word)
    return F.when(lowered.startswith("fig"), "figure").when(lowered.startswith("tab"), "table").otherwise("equation")


def label_number(digits: Column) -> Column:
    """A label's number as its digits without leading zeros, whatever its length."""
    return F.regexp_replace(digits, "^0+(?=.)", "")


def references(text: Column) -> Column:
    """The distinct artifacts that a passage names: array of (kind, num), num in digits."""
    mentions = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))

    def labels(mention: Column) -> Column:
        kind = canonical_kind(F.regexp_extract(mention, REFERENCE, 1))
        numbers = F.regexp_extract_all(F.regexp_extract(mention, REFERENCE, 2), F.lit("([0-9]+)"), F.lit(1))
        return F.transform(numbers, lambda n: F.struct(kind.alias("kind"), label_number(n).alias("num")))

    return F.array_distinct(F.flatten(F.transform(mentions, labels)))


def caption_label(caption: Column) -> Column:
    """(kind, num) that a caption opens with, or null."""
    opening = "(?iU)^" + REFERENCE.removeprefix(r"(?iU)\b")
    bare = strip(caption)
    number = F.regexp_extract(F.regexp_extract(bare, opening, 2), "^([0-9]+)", 1)
    return F.when(
        bare.rlike(opening),
        F.struct(
            canonical_kind(F.regexp_extract(bare, opening, 1)).alias("kind"), label_number(number).alias("num")
        ),
    )


def reference_span(text: Column, label: Column) -> Column:
    """(start, end) of the first mention in ``text`` that names ``label``; null if none.
    Mentions are located one after another, each from where the last one ended."""
    mentions = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    state = F.struct(
        F.lit(0).alias("at"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")
    )

    def step(s: Column, m: Column) -> Column:
        begin = _find(text, m, s["at"]).cast("int")
        names = F.array_contains(references(m), label)
        hit = s["start"].isNull() & names
        return F.struct(
            (begin + F.length(m)).cast("int").alias("at"),
            F.when(hit, begin).otherwise(s["start"]).alias("start"),
            F.when(hit, (begin + F.length(m)).cast("int")).otherwise(s["end"]).alias("end"),
        )

    found = F.aggregate(mentions, state, step)
    return F.when(label.isNotNull() & found["start"].isNotNull(), F.struct(found["start"].alias("start"), found["end"].alias("end")))


def _find(text: Column, what: Column, begin: Column) -> Column:
    """The 0-based place of ``what`` at or after ``begin``."""
    return F.call_function("locate", what, text, begin + 1) - 1


def snippet(text: Column, label: Column, left: int = 62, right: int = 74, short: int = 150) -> Column:
    """(before, marked, after) around the first mention of ``label``; without one the
    text's beginning, unmarked."""
    t = flat(text)
    span = reference_span(t, label)
    n = F.length(t)
    begin = F.greatest(F.lit(0), span["start"] - left)
    end = F.least(n, span["end"] + right)
    cut = lambda a, b: F.substring(t, a + 1, b - a)
    dots = F.lit(" …")
    return F.when(
        span.isNotNull(),
        F.struct(
            F.concat(F.when(begin > 0, "… ").otherwise(""), cut(begin, span["start"])).alias("before"),
            cut(span["start"], span["end"]).alias("marked"),
            F.concat(cut(span["end"], end), F.when(end < n, dots).otherwise("")).alias("after"),
        ),
    ).otherwise(
        F.struct(
            F.concat(F.substring(t, 1, short), F.when(n > short, dots).otherwise("")).alias("before"),
            F.lit("").alias("marked"),
            F.lit("").alias("after"),
        )
    )


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(" …"))).otherwise(text)


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, half to even; a dash without a whole."""
    return F.when(whole > 0, F.concat(F.bround(100.0 * part / whole, 0).cast("int").cast("string"), F.lit("%"))).otherwise("—")


def human_size(n: Column) -> Column:
    """MB with a decimal from 1 MB, else whole KB; a dash for none."""
    mb = n / F.lit(1024.0 * 1024.0)
    return (
        F.when(n.isNull() | (n == 0), "—")
        .when(mb >= 1, F.format_string("%.1f MB", F.bround(mb, 1)))
        .otherwise(F.format_string("%d KB", F.bround(n / F.lit(1024.0), 0).cast("bigint")))
    )
