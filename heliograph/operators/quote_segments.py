"""Quote structure of many bodies at once, as joins-free windows over their lines.

Lines come from ``posexplode`` and are classed by expressions; the state that a
line leaves for the next ones is the last value of a few columns over a window;
equal neighbours are joined as gaps and islands.  Only classes, lengths and
places are shuffled, once, by the body's key; texts are cut out of the body at
the end.  A group is one body, whose size a mail's limit bounds.

In HTML the depth of blockquotes is a prefix scan: every tag is x -> max(0, x
+ 1) or max(0, x - 1), and a chain of those is x -> max(a, x + b), so the depth
is the running sum less its running minimum where that is below zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import quotes

SEGMENT = "array<struct<index:int,kind:string,level:int,marker:string,ambiguous:boolean,char_start:int,char_end:int,text:string>>"

_STRETCH = r"(?i)<\s*+(?:/\s*+)?blockquote(?!\w)[^>]*>"


def _lines(bodies: DataFrame, key: list[str]) -> DataFrame:
    """(key, at, length, class, marks, head, after) of the lines of every body.

    A header block is found in a string with a letter for each line (F a From
    line, f another field): a B takes the place of a block's first letter, so
    blocks are marked from left to right and do not overlap.
    """
    fields = F.array_join(F.transform(F.split("__body", "\n", -1), lambda x: F.when(quotes.is_head_from(x), "F").when(quotes.is_head_field(x), "f").otherwise("-")), "")
    marked = F.regexp_replace(fields, r"F([Ff]{2,8})", "B$1")
    rows = bodies.where("__body <> ''").withColumn("__heads", marked).select(*key, "__heads", F.posexplode(F.split("__body", "\n", -1)).alias("at", "line"))
    mark = F.substring("__heads", F.col("at") + 1, F.lit(1))
    inside = F.when(mark == "B", 1 + F.length(F.regexp_extract(F.substring("__heads", F.col("at") + 2, F.lit(8)), "^[Ff]*", 0)))
    return rows.select(*key, "at", F.length("line").alias("length"), quotes.line_kind(F.col("line")).alias("class"), quotes.quote_level(F.col("line")).alias("marks"), inside.alias("block"))


def _spans(lines: DataFrame, key: list[str], depth: Column, mark: Column) -> DataFrame:
    """(key, index, kind, level, marker, ambiguous, char_start, char_end) from classed lines."""
    by_line = Window.partitionBy(*key).orderBy("at")
    before, so_far = by_line.rowsBetween(Window.unboundedPreceding, -1), by_line.rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("start", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)))
    head = F.last(F.when(F.col("block").isNotNull(), F.struct("at", "block")), ignorenulls=True).over(so_far)
    placed = placed.withColumn("head", head).withColumn("item", F.when(F.col("at") < F.col("head.at") + F.col("head.block"), F.col("head.at")).otherwise(F.col("at")))
    whole = Window.partitionBy(*key)
    placed = placed.withColumn("end_of_body", F.max(F.col("start") + F.col("length")).over(whole))
    own = placed.withColumn("class", F.when(F.col("block").isNotNull(), "outlook_header").otherwise(F.col("class"))).where("class <> 'blank' OR item <> at")
    first = F.col("item") == F.col("at")
    items = own.groupBy(*key, "item", "end_of_body").agg(
        F.max(F.when(first, F.col("class"))).alias("class"), F.max(F.when(first, F.col("marks"))).alias("marks"), F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop")
    )
    # a body of blank lines has no item; one of class "blank" stands for it
    empty = placed.groupBy(*key, "end_of_body").agg(F.count_if(F.col("class") != "blank").alias("seen")).where("seen = 0")
    by_item = Window.partitionBy(*key).orderBy("item")
    till_here = by_item.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("class").isin("on_wrote", "cn_daowen"), F.struct(F.lit("quote").alias("mode"), F.col("class").alias("opener")))
    opened = opened.when(F.col("class").isin("original_message", "forwarded_message", "outlook_header"), F.struct(F.lit("forward").alias("mode"), F.lit(None).cast("string").alias("opener")))
    opened = opened.when(F.col("class") == "signature", F.struct(F.lit("own").alias("mode"), F.lit(None).cast("string").alias("opener")))
    doubt = F.when(F.col("class") == "doubtful", True).when(~F.col("class").isin("text", "signature"), False)
    items = items.withColumn("state", F.last(opened, ignorenulls=True).over(till_here)).withColumn("doubt", F.coalesce(F.last(doubt, ignorenulls=True).over(till_here), F.lit(False)))
    text, mode, quoted = F.col("class") == "text", F.coalesce(F.col("state.mode"), F.lit("own")), F.col("marks") > 0
    kind = F.when(~text, "separator").when(mode == "forward", "forward").when((mode == "quote") | quoted | (depth > 0), "quote").otherwise("own")
    level = F.when(~text, 0).otherwise(depth + F.when(quoted, F.col("marks")).when(mode == "quote", 1).otherwise(0))
    extra = F.when(quoted, ">").when(mode == "quote", F.col("state.opener"))
    marker = F.when(~text, F.when(F.col("class") != "doubtful", F.col("class"))).otherwise(F.nullif(F.concat_ws("+", mark, extra), F.lit("")))
    run = F.struct(kind.alias("kind"), level.cast("int").alias("level"), marker.alias("marker"), F.when(text, F.col("doubt")).otherwise(F.col("class") == "doubtful").alias("ambiguous"))
    items = items.withColumn("run", run).withColumn("previous", F.lag("run").over(by_item))
    new = (~text) | F.col("previous").isNull() | ~F.col("previous").eqNullSafe(F.col("run"))
    islands = items.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(till_here))
    spans = islands.groupBy(*key, "island", "run", "end_of_body").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    by_span = Window.partitionBy(*key).orderBy("island")
    separate = F.col("run.kind") == "separator"
    behind = F.lag(F.struct("stop", separate.alias("separate"))).over(by_span)
    ahead = F.lead("start").over(by_span)
    # blank lines go to the text before them, else to the text after them
    spans = spans.withColumn("behind", behind).withColumn("ahead", ahead)
    begin = F.when(separate, F.col("start")).when(F.col("behind").isNull(), 0).when(F.col("behind.separate"), F.col("behind.stop") + 1).otherwise(F.col("start"))
    end = F.when(separate, F.col("stop")).when(F.col("ahead").isNull(), F.col("end_of_body")).otherwise(F.col("ahead") - 1)
    made = spans.select(*key, F.col("island").alias("order"), "run.*", begin.alias("char_start"), end.alias("char_end"))
    blank = [F.lit("own").alias("kind"), depth.cast("int").alias("level"), mark.alias("marker"), F.lit(False).alias("ambiguous")]
    last = spans.where(separate & F.col("ahead").isNull() & (F.col("stop") < F.col("end_of_body"))).select(*key, (F.col("island") + 1).alias("order"), *blank, (F.col("stop") + 1).alias("char_start"), F.col("end_of_body").alias("char_end"))
    alone = empty.select(*key, F.lit(1).alias("order"), *blank, F.lit(0).alias("char_start"), F.col("end_of_body").alias("char_end"))
    return made.unionByName(last).unionByName(alone)


def _collected(spans: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    one = F.struct(*order, "kind", "level", "marker", "ambiguous", "char_start", "char_end")
    return spans.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("__spans"))


def _joined(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    same = F.lit(True)
    for i, k in enumerate(key):
        found = found.withColumnRenamed(k, f"__k{i}")
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(found, same, "left").drop(*[f"__k{i}" for i in range(len(key))])


def _cut(spans: Column, body: Column, offset: Column | None = None) -> Column:
    def one(s: Column, i: Column) -> Column:
        at = lambda c: (s[c] + (F.lit(0) if offset is None else s["offset"])).cast("int")
        text = body if offset is None else s["body"]
        return F.struct(
            i.alias("index"), s["kind"].alias("kind"), s["level"].alias("level"), s["marker"].alias("marker"), s["ambiguous"].alias("ambiguous"), at("char_start").alias("char_start"), at("char_end").alias("char_end"),
            F.substring(text, s["char_start"].cast("int") + 1, (s["char_end"] - s["char_start"]).cast("int")).alias("text"),
        )

    return F.coalesce(F.transform(spans, one), F.array()).cast(SEGMENT)


def of_text(rows: DataFrame, key: list[str], body: str, out: str = "segments") -> DataFrame:
    """``rows`` with the segments of a plain body; offsets count code points of the body.

    ``key`` names a row; rows of one key are taken for one body, so it has to be
    unique.  A null or empty body has no segments.
    """
    lines = _lines(rows.select(*key, F.col(body).alias("__body")), key)
    found = _collected(_spans(lines, key, F.lit(0), F.lit(None).cast("string")), key, ["order"])
    return _joined(rows, found, key).withColumn(out, _cut(F.col("__spans"), F.col(body))).drop("__spans")


def stretches(rows: DataFrame, key: list[str], page: str) -> DataFrame:
    """(key, part, depth, text) of the stretches of an HTML body between blockquote tags, without empty ones.

    Unclosed and stray tags never take the depth below zero.
    """
    hidden = quotes.without_hidden(F.col(page))
    tags = F.regexp_extract_all(hidden, F.lit(f"({_STRETCH})"), 1)
    step = F.transform(tags, lambda t: F.when(t.rlike(r"^<\s*/"), -1).otherwise(1))
    parts = rows.where(F.col(page).isNotNull()).select(*key, F.posexplode(F.arrays_zip(F.split(hidden, _STRETCH, -1).alias("html"), F.concat(F.array(F.lit(0)), step).alias("step"))).alias("part", "p"))
    way = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.select(*key, "part", F.sum("p.step").over(way).alias("sum"), F.col("p.html").alias("html"))
    depth = F.col("sum") - F.least(F.lit(0), F.min("sum").over(way))
    return summed.select(*key, "part", depth.cast("int").alias("depth"), quotes.html_to_text_column(F.col("html")).alias("text")).where("text <> ''")


def of_html(rows: DataFrame, key: list[str], page: str, out: str = "segments") -> DataFrame:
    """``rows`` with the segments of an HTML body; offsets count in the view, the segments' texts joined by newlines.

    Entities are those of the column form of the text.
    """
    parts = stretches(rows, key, page)
    way = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(way), F.lit(0)))
    by_part = [*key, "part", "depth", "offset"]
    lines = _lines(parts.select(*by_part, F.col("text").alias("__body")), by_part)
    spans = _spans(lines, by_part, F.col("depth"), F.when(F.col("depth") > 0, "blockquote")).withColumnRenamed("part", "__part")
    texts = parts.select(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(key)], F.col("part").alias("__p"), F.col("text").alias("body"))
    spans = spans.join(texts, _same(key) & (F.col("__part") == F.col("__p")))
    one = F.struct(F.col("__part").alias("part"), "order", "kind", "level", "marker", "ambiguous", "char_start", "char_end", "offset", "body")
    found = spans.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("__spans"))
    return _joined(rows, found, key).withColumn(out, _cut(F.col("__spans"), F.col(page), F.col(page))).drop("__spans")


def _same(key: list[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"__t{i}"))
    return same
