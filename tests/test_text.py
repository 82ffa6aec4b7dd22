"""Text expressions on the documented fixtures."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X


def each(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def test_headings(spark):
    cases = {
        "1. Introduction": "introduction", "2.1 Method": "method", "IV. RESULTS": "results", "A. Supplementary Material": "appendix",
        "Our Proposed System": "method", "The Model": "method", "Limitations of Prior Methods": "discussion", "Experiments and Results": "method",
        "Experimental Setup": "method", "Background and Motivation": "introduction", "Results & Discussion": "results", "Generator: BART": "unknown",
        "Bibliography": "references", "": "unknown", "A Survey": "unknown", "Conclusions and Future Work": "conclusion",
    }
    cases["Experiments and Results"] = "results"
    assert dict(zip(cases, each(spark, list(cases), X.classify_section), strict=True)) == cases


def test_mid_word_and_captions(spark):
    assert each(spark, ["ing of", "  tail", "The", "1.", "", "\n\n"], X.starts_mid_word) == [True, True, False, False, False, False]
    cases = {"Figure 1: x": True, "Fig. 2. y": True, "Table 3 Results": True, "Tbl. 3: z": True, "Table 4 reports": False, "Figure 5": True, "Figures 1": False}
    assert dict(zip(cases, each(spark, list(cases), X.is_caption), strict=True)) == cases


def test_page_numbers(spark):
    assert each(spark, ["100", "iv", "- 42 -", "(3)", "3 apples", "XII"], X.is_page_number) == [True, True, True, True, False, True]


def test_references(spark):
    def labels(t):
        return F.transform(X.references(t), lambda x: F.concat(x["kind"], x["num"]))

    texts = ["see Figures 1, 2 and 3", "Fig. 3 and Fig 10", "Tab. 2 & eq. (4)", "Equations 5 & 6", "Figure 1-3", "tbl 2", "fig. 1. We ran 9", "Figure 2, and 3"]
    got = [sorted(x) for x in each(spark, texts, labels)]
    assert got == [["figure1", "figure2", "figure3"], ["figure10", "figure3"], ["table2"], ["equation5", "equation6"], ["figure1"], [], ["figure1"], ["figure2"]]


def test_caption_label_and_span(spark):
    label = lambda t: F.concat(X.caption_label(t)["kind"], X.caption_label(t)["num"])
    assert each(spark, ["  Figure 7. x", "as in Figure 3", "", "Tables 2 and 3"], label) == ["figure7", None, None, "table2"]
    want = F.struct(F.lit("figure").alias("kind"), F.lit("3").alias("num"))
    span = lambda t: X.reference_span(t, want)
    texts = ["Figure 1 then Figure 3 here", "none", "Figure 31, Figure 3"]
    assert [tuple(x) if x else None for x in each(spark, texts, span)] == [(14, 22), None, (11, 19)]


def test_numbers_of_any_length(spark):
    """Equal as numbers, whatever their zeros and their length."""
    long = "1" * 45
    texts = [f"see Figure {long} and Figure 00{long}", "Table 007 or table 7", "Eq. 0 and eq. 000"]
    assert [[(y.kind, y.num) for y in x] for x in each(spark, texts, X.references)] == [[("figure", long)], [("table", "7")], [("equation", "0")]]
    assert each(spark, [f"Figure 0{long}: x"], lambda t: X.caption_label(t)["num"]) == [long]


@pytest.mark.parametrize("raw", [None, "  ", "Untitled", "DOCUMENT1", "Microsoft Word - x.doc", "paper.pdf", "Paper", "Slide 1"])
def test_useless_titles(spark, raw):
    row = spark.createDataFrame([(raw,)], "t string").select(X.clean_title(F.col("t"), F.lit("paper.pdf")).alias("x")).first()
    assert row.x is None


def test_file_names(spark):
    got = each(spark, ['a/b\\c:d*e?"<>|', "***", "word " * 80, None], lambda t: X.safe_name(F.lit("2401.1v2"), t))
    assert got[0] == "2401.1v2_a_b_c_d_e.pdf" and got[1] == got[3] == "2401.1v2.pdf" and len(got[2]) < 90


def test_shares_and_sizes(spark):
    row = spark.range(1).select(
        X.percent(F.lit(1), F.lit(8)).alias("a"), X.percent(F.lit(1), F.lit(0)).alias("b"), X.human_size(F.lit(1_572_864)).alias("c"),
        X.human_size(F.lit(2560)).alias("d"), X.human_size(F.lit(0)).alias("e"),
    ).first()
    assert tuple(row) == ("12%", "—", "1.5 MB", "2 KB", "—")
