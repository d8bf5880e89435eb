"""Quotation linking: replies joined to the messages that they quote.

A message's lines are parsed into its own text and quoted passages: a passage
is a maximal run of lines of one quote level (the number of ``>`` marks, with
blanks between them), so nested quotes are passages of their own.  Lines such
as "On ... wrote:" or "-----Original Message-----" that introduce a quote
belong to neither.  Each quoted line is normalised (case, white space and
remaining marks removed) and hashed, and the hashes are joined to the own lines
of earlier messages of the same conversation.  The passage's source is the
message that holds most of its lines, whoever wrote them before, if that is at
least half of them; of several the first, as later ones repeat it.

A message replies to the source of its outermost passages: the one with most
lines, then the latest.  Links always lead to an earlier turn, so ordering a
thread by turn puts every message after what it replies to; threads are found
by contracting the links.  The result is a row a message, with its text without
quotes, sorted within its conversation by (thread, turn).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.lineage import cut, keep

_MARK = regex.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
_INTRO = regex.compile(
    r"^\s*(?:(?:On|Am|Le|El)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:|-{2,}\s*(?:Original Message|Forwarded message|Ursprüngliche Nachricht|Message d'origine|Mensaje original)\s*-{2,})\s*$",
    regex.I,
)
_SPACE = regex.compile(r"\s+")

#: Lines with more writers than this in one conversation are looked up by sets.
FREQUENT = 64

PARSED = "own_text string, quotes array<struct<passage: int, level: int, lines: array<bigint>>>, own_lines array<bigint>"


def normal_hash(line: str) -> int | None:
    """The signed 64-bit hash of a line without case, white space and outer marks; None if nothing is left."""
    text = _SPACE.sub(" ", line).strip(" >*|\t").casefold()
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True) if text else None


def parse(text: str | None) -> tuple[str, list[tuple[int, int, list[int]]], list[int]]:
    """(own text, passages as (number, level, line hashes), own line hashes) of a message.

    Blank quoted lines continue their passage.  Blank lines around removed
    quotes are dropped at both ends of the own text.
    """
    own: list[str] = []
    passages: list[tuple[int, int, list[int]]] = []
    lines = (text or "").split("\n")
    open_level = 0
    for i, line in enumerate(lines):
        m = _MARK.match(line)
        if m is None:
            open_level = 0
            if _INTRO.match(line):
                after = next((x for x in lines[i + 1 :] if x.strip()), "")
                if _MARK.match(after) or line.lstrip().startswith("-"):
                    continue
            own.append(line)
            continue
        level = m.group(1).count(">")
        h = normal_hash(line[m.end() :])
        if level != open_level:
            passages.append((len(passages), level, []))
            open_level = level
        if h is not None:
            passages[-1][2].append(h)
    passages = [(i, level, hashes) for i, level, hashes in passages if hashes]
    own_hashes = [h for h in map(normal_hash, own) if h is not None]
    return "\n".join(own).strip("\n") if len(own) < len(lines) else (text or ""), passages, own_hashes


_ARROW = [
    pa.string(),
    pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("lines", pa.list_(pa.int64()))])),
    pa.list_(pa.int64()),
]


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse(x.as_py()) for x in batch.column("text")]
        quotes = [[{"passage": p, "level": v, "lines": h} for p, v, h in r[1]] for r in rows]
        arrays = [pa.array([r[0] for r in rows], _ARROW[0]), pa.array(quotes, _ARROW[1]), pa.array([r[2] for r in rows], _ARROW[2])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "own_text", "quotes", "own_lines"])


def thread_roots(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(conv, turn, root, depth) of every linked message, by pointer doubling over links alone."""
    now = cut(links.select("conv", "turn", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth")))
    for _ in range(max_rounds):
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = now.join(up, (F.col("conv") == F.col("c")) & (F.col("at") == F.col("t")), "left")
        now = cut(moved.select("conv", "turn", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("conv", "turn", F.col("at").alias("root"), "depth")
        now = now.drop("moved")
    raise RuntimeError("threads are deeper than expected")


def passage_sources(parsed: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv, turn, passage, level, met, source) of every passage with a source.

    All earlier messages that wrote a line of the passage are compared.  Lines
    of at most ``FREQUENT`` writers in the conversation name candidates one by
    one.  Lines of more writers are looked up once for each set of them that
    passages share: of the messages that hold equally many of the set only the
    first can win.
    """
    here = [F.col("conv") == F.col("c"), F.col("line") == F.col("l")]
    lines = quotes.select("conv", "turn", "passage", F.explode("lines").alias("line"))
    wanted = lines.select(F.col("conv").alias("c"), F.col("line").alias("l")).distinct()
    own = parsed.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", F.col("turn").alias("source"), F.explode(F.array_distinct("own_lines")).alias("line"))
    wrote = keep(own.join(wanted, here, "left_semi").distinct(), "quoted-lines")
    frequent = wrote.groupBy("conv", "line").count().where(F.col("count") > FREQUENT).select(F.col("conv").alias("c"), F.col("line").alias("l"))
    rare = wrote.join(frequent, here, "left_anti")
    common = wrote.join(frequent, here, "left_semi")
    key = ["conv", "turn", "passage"]
    sets = lines.join(frequent, here, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list("line")).alias("often"))
    asked = keep(quotes.select(*key, "level", F.size("lines").alias("n")).join(sets, key, "left"), "passages")
    # candidates by a rare line, with the frequent lines that they hold too
    held = common.groupBy("conv", "source").agg(F.collect_set("line").alias("held"))
    by_rare = lines.join(rare, ["conv", "line"]).where("source < turn").groupBy(*key, "source").agg(F.count(F.lit(1)).alias("met"))
    also = F.coalesce(F.size(F.filter("often", lambda x: F.array_contains("held", x))), F.lit(0))
    by_rare = by_rare.join(asked, key).join(held, ["conv", "source"], "left").withColumn("met", F.col("met") + F.when(F.col("often").isNotNull() & F.col("held").isNotNull(), also).otherwise(0))
    # the first message for each number of lines of a set
    of_set = asked.where("often IS NOT NULL").select("conv", "often").distinct().withColumn("line", F.explode("often"))
    firsts = of_set.join(common, ["conv", "line"]).groupBy("conv", "often", "source").agg(F.count(F.lit(1)).alias("met")).groupBy("conv", "often", "met").agg(F.min("source").alias("source"))
    by_set = asked.join(firsts, ["conv", "often"]).where("source < turn")
    out = [*key, "level", "n", "met", "source"]
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("met"), "source"))
    return by_rare.select(*out).union(by_set.select(*out)).withColumn("place", best).where("place = 1 AND 2 * met >= n").drop("place", "n")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each row of ``messages``, with its place in its conversation.

    Returns ``conv_id, turn, role, own_text, n_passages, max_level, n_linked,
    parent_turn, thread_root, depth``: quoted passages, their deepest level, how
    many have a source, the turn that the message replies to (null if no quote
    says so), and the first turn of its thread with the distance to it.  Rows
    without a conversation or turn are parsed but not linked.  Null text is
    empty.  Repeated rows of one turn are each returned; they share the links
    of their quotes.  An empty table gives an empty result.
    """
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    schema = f"conv long, turn long, role string, text string, {PARSED}"
    parsed = rows.mapInArrow(_parse_rows, schema).drop("text")
    quotes = keep(parsed.where("size(quotes) > 0 AND conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", F.inline("quotes")), "quoted-passages")
    sources = passage_sources(parsed, quotes)
    outer = sources.groupBy("conv", "turn", "source").agg(F.min("level").alias("level"), F.sum("met").alias("met"))
    first = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("level", F.desc("met"), F.desc("source")))
    parents = outer.withColumn("place", first).where("place = 1").select("conv", "turn", F.col("source").alias("parent"))
    linked = sources.groupBy("conv", "turn").agg(F.countDistinct("passage").alias("n_linked"))
    found = keep(parents.join(linked, ["conv", "turn"]), "quote-links")
    placed = found.join(thread_roots(found), ["conv", "turn"], "left")
    out = parsed.join(placed, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        "own_text",
        F.size("quotes").cast("long").alias("n_passages"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("thread_root"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def conversation_text(linked: DataFrame, role_open: str = "<|", role_close: str = "|>\n") -> DataFrame:
    """Adds ``chat``, the message as a chat turn, and sorts each partition in reply order."""
    return linked.withColumn("chat", F.concat(F.lit(role_open), F.coalesce("role", F.lit("unknown")), F.lit(role_close), F.col("own_text"))).sortWithinPartitions("conv_id", "thread_root", "turn")
