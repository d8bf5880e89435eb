"""Quote structure by windows against the line-by-line form, and hostile pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from heliograph.functions import quotes
from heliograph.operators import quote_segments

LINES = ["plain", "more text", "", "  ", "\t", "> quoted", ">> deeper", " > > spaced", "   >tight", "On Monday, Bob wrote:", "on Monday bob wrote", "在 2024 年 张三 写道：", "在 某日 写道", "-----Original Message-----", "-- Forwarded message --", "--", "-- ", "=====", "-- almost --", "From: a@x", "from： b", "Sent: now", "To: c", "Cc: d", "Subject: e", "Date: f", "发件人: g", "主题: h", "　", "\x1c", "ünï\r", "🙂 code points", "On x wrote: not"]


def bodies(seed, n):
    rng = random.Random(seed)
    made = ["\n".join(rng.choices(LINES, k=rng.randrange(1, 25))) for _ in range(n)]
    made += ["\n".join(["From: a", *["Sent: b"] * k, "tail"]) for k in range(12)] + ["\n".join(["From: a"] * k) for k in range(25)]
    return [*made, "", " ", "\n", "\n\n\n", None, "--", "--\n", "\n--\n\n"]


def tuples(segments):
    names = ("index", "kind", "level", "marker", "ambiguous", "char_start", "char_end", "text")
    return [tuple(s[c] for c in names) for s in segments]


def test_text_equals_line_by_line(spark):
    rows = list(enumerate(bodies(1, 400)))
    df = spark.createDataFrame(rows, "id long, body string").selectExpr("*", "'x' AS level", "1 AS at").repartition(3)
    got = {r["id"]: tuples(r["segments"]) for r in quote_segments.of_text(df, ["id"], "body").collect()}
    assert len(got) == len(rows)
    for i, body in rows:
        assert got[i] == tuples(quotes.of_text(body or "")["segments"]), repr(body)
    assert quote_segments.of_text(df.limit(0), ["id"], "body").count() == 0


def test_html_equals_page_by_page(spark):
    rng = random.Random(2)
    pieces = ["<blockquote>", "</blockquote>", "<BLOCKQUOTE class='x'>", "< / blockquote >", "<blockquotes>", "<p>", "<br/>", "text", "On x wrote:", "> q", "--", "<b>bold</b>", " &lt;tag&gt; &amp;", "<script>a<blockquote>b</script>", "<style>x</style>", "\n", "</p>", "<i"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randrange(0, 20)))) for i in range(250)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id long, page string")
    got = {r["id"]: tuples(r["segments"]) for r in quote_segments.of_html(df, ["id"], "page").collect()}
    for i, page in rows:
        assert got[i] == tuples(quotes.of_html(page or "")["segments"]), repr(page)


@pytest.mark.parametrize("unit", ["<p ", "<script>", "<style x", "<script ", "<", "<" + " " * 50, "</script>", "<script></script", "<blockquote "])
def test_hostile_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    quotes.html_to_text(page)
    quotes.of_html(page)
    quotes.html_to_text(page + "</script>")
    assert time.perf_counter() - began < 20


def test_hostile_pages_as_columns(spark):
    pages = [(i, u * (300_000 // len(u))) for i, u in enumerate(["<p ", "<script>", "<style x", "<", "<" + " " * 50])]
    began = time.perf_counter()
    spark.createDataFrame(pages, "id long, page string").select(F.length(quotes.html_to_text_column(F.col("page")))).collect()
    assert time.perf_counter() - began < 30
