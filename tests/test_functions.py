"""Functions and statistics against plain Python and numpy."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import identifiers as I
from citeloom.functions import markup as M
from citeloom.functions import stats as S
from citeloom.functions import text as T


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("doi,kind", [
    ("10.1371/journal.pone.0000001.s001", "supplementary"), ("10.14573/altex.1812101s1", "supplementary"), ("10.7554/eLife.1.sa1", "editorial"), ("10.5281/zenodo.1", "dataset"),
    ("10.1101/2020.01.02.123456", "preprint"), ("10.1101/gad.12345", "journal"), ("10.48550/arXiv.1", "preprint"), ("10.1007/978-3-1", "book_chapter"), ("10.12345/x", "other"), ("", "other"), (None, "other"),
])
def test_kind(spark, doi, kind):
    assert one(spark, doi, "string", I.doi_kind) == kind


def test_accents_stay_in_title_words(spark):
    assert one(spark, "L'Été: a Preprint", "string", I.title_words) == ["lété", "a"]
    assert one(spark, None, "string", I.title_words) == []


def test_safe_name(spark):
    assert one(spark, "https://doi.org/10.1/a b(c)", "string", I.safe_name) == "10.1__a_20_b_28_c_29_"


def test_student_p_is_the_textbook_quantile(spark):
    for df, t in ((1, 12.7062047), (2, 4.3026527), (3, 3.1824463), (5, 2.5705818), (10, 2.2281389), (29, 2.0452296)):
        r = t / math.sqrt(t * t + df)
        p = spark.createDataFrame([(r, df + 2)], "r double, n int").select(S.student_p(F.col("r"), F.col("n")).alias("p")).first().p
        assert abs(p - 0.05) < 1e-7


def test_student_p_edges(spark):
    rows = spark.createDataFrame([(1.0, 7), (None, 7), (0.3, 2), (0.0, 7)], "r double, n int").select(S.student_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert [round(x.p, 9) for x in rows] == [0.0, 1.0, 1.0, 1.0]


def test_average_ranks(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", S.average_rank(F.col("v")).alias("r")).orderBy("i").collect()
    assert [x.r for x in got] == [4.0, 1.0, 4.0, 2.0, 4.0]


def test_correlation_without_variation_is_null(spark):
    assert spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double").agg(S.correlation(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_threshold():
    assert [S.choose_threshold(k) for k in (1, 50, 51, 100, 200)] == [0.8, 0.8, 5 / 51, 0.05, 0.05]


@pytest.mark.parametrize("text,generic", [("More data is needed.", True), ("short", True), (None, True), ("The assay fails below ten degrees", False)])
def test_generic(spark, text, generic):
    assert one(spark, text, "string", T.is_generic) is generic


def test_answers(spark):
    assert [x.doi for x in one(spark, '```json\n[{"doi":"a"},{"x":1}]\n```', "string", T.parse_answer)] == ["a"]
    assert one(spark, "nothing", "string", T.parse_answer) == []


def test_markup():
    assert M.jats_groups("<broken") == dict.fromkeys(["methods_text", "results_text", "discussion_text", "full_body_text"], "")
    nested = "<article><body><sec><title>Methods</title><p>A</p><sec><title>Materials</title><p>B</p></sec></sec></body></article>"
    assert M.jats_groups(nested)["methods_text"] == "Methods A Materials B\n\nMaterials B"
    assert M.markdown_sections("") == {} and M.markdown_sections("x") == {"Content": "x"}
    assert M.tei_sections("nope") == {}
    assert M.jats_article(nested)["full_text"] == "## Methods\n\nA\n\n## Materials\n\nB"


@given(st.lists(st.integers(0, 5), min_size=1, max_size=30), st.lists(st.integers(0, 5), min_size=1, max_size=30))
def test_choose_two_sums(a, b):
    n = min(len(a), len(b))
    pairs = sum(1 for i in range(n) for j in range(i) if a[i] == a[j])
    assert pairs == sum(c * (c - 1) // 2 for c in np.unique(a[:n], return_counts=True)[1])
