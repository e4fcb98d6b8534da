import pytest
from pyspark.sql import functions as F

from postsieve.functions import text
from postsieve.sources.pages import posting_texts, scan_postings


def one(spark, expression, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "link, kept", [("a?x=1", "a"), ("a#top", "a#top"), ("a#t?x", "a#t"), ("a", "a"), ("a?b?c", "a"), (None, None)]
)
def test_link_is_cut_at_first_question_mark(spark, link, kept):
    assert one(spark, text.normalize_link, link) == kept


def test_commas_go(spark):
    assert one(spark, text.strip_commas, ",Senior, Engineer,,") == "Senior Engineer"


@pytest.mark.parametrize(
    "html, plain",
    [
        ("<p>one<p>two</p>\n\n three", "one\ntwo\nthree"),
        ("a <!-- <p>no</p> --> b", "a b"),
        ("a<SCRIPT type=x>var t='</p>';</script >b", "ab"),
        ("a<style>p{}</style>b<script>left open", "ab"),
        ("a<!-- left open <p>x</p>", "a"),
        ("see <a href='q'>the link</a> <img src=z>now", "see the link now"),
        ("one<br>two<br/>three", "one\ntwo\nthree"),
        ("<ul><li>x</li>\t<li>y</li></ul>", "x\ny"),
        ("5 < 6 and 7 > 2", "5 < 6 and 7 > 2"),
        ("tom &amp; jerry &lt;3 &quot;q&quot; &#65;&#x42;&#x1F600;", 'tom & jerry <3 "q" AB😀'),
        ("&amp;lt; &unknown; &#0; &#55296; &amp", "&lt; &unknown; &#0; &#55296; &amp"),
        ("a&nbsp;&nbsp;b", "a b"),
        ("", ""),
        (None, None),
    ],
)
def test_html_to_text(spark, html, plain):
    assert one(spark, text.html_to_text, html) == plain


def test_long_unclosed_markup_does_not_blow_up(spark):
    junk = "<!-- <script " * 20_000
    assert one(spark, text.html_to_text, "x" + junk) == "x"


def test_tokens(spark):
    assert one(spark, text.tokens, "C++ and C#, Node.js: 2-grams!") == ["c++", "and", "c#", "node", "js", "2", "grams"]


def test_flag_text(spark):
    rows = spark.sql("SELECT * FROM VALUES (true), (false), (CAST(NULL AS BOOLEAN)) AS t(b)")
    assert [r[0] for r in rows.select(text.flag_text(F.col("b"))).collect()] == ["True", "False", None]


def test_date_stamp(spark):
    assert spark.sql("SELECT DATE'2024-01-09' AS d").select(text.date_stamp(F.col("d"))).first()[0] == "09-01-2024"


def test_page_without_article_or_heading(spark):
    pages = spark.createDataFrame([(1, "u?x", "<html><p>bare</p></html>")], "page_id bigint, url string, html string")
    assert scan_postings(pages).first()[1:] == ("u?x", "", "")
    assert posting_texts(pages).first()[1:] == ("u", "", "")
