"""Trace and sender headers as column expressions.

The reader decodes a mail's headers and hands them over as ``TRACE`` and
``LINES``.  Which hosts, zones, domains and tags count, and what is wrong with
them, is decided here, in expressions over arrays whose work is linear in the
text (sorting aside).  Null arrays give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.functions.addresses import domain_of, same_or_below, strip_text

#: Received headers in order: one line of text, its clause and its time without comments, and the time as ISO text.
TRACE = "array<struct<raw:string,clause:string,time:string,moment:string>>"
#: Headers that name the sender, in order and with lower-case names; addresses where the header has any.
LINES = "array<struct<name:string,value:string,addresses:array<struct<name:string,address:string>>>>"

ADDRESS_HEADERS = ("from", "sender", "reply-to", "return-path")
#: Headers of which a second one is reported.
SINGLE_HEADERS = ("sender", "return-path", "message-id", "dkim-signature")
SENDER_HEADERS = (*ADDRESS_HEADERS, "message-id", "dkim-signature")

HOPS = "array<struct<index:int,raw:string,from_host:string,by_host:string,time_utc:string,time_original:string,timezone:string,issues:array<string>>>"
_ENTRY = (
    "struct<index:int,raw:string,count:int,addresses:array<struct<name:string,address:string,domain:string>>,address:string,name:string,domain:string,anomalies:array<string>>"
)
_ID = "struct<index:int,raw:string,value:string,local_part:string,domain:string,anomalies:array<string>>"
_SIGNATURE = "struct<index:int,raw:string,present:boolean,d:string,s:string,i:string,i_local_part:string,i_domain:string,h:array<string>,covers_from:boolean,anomalies:array<string>>"
IDENTITY = (
    f"struct<from:array<{_ENTRY}>,sender:array<{_ENTRY}>,reply_to:array<{_ENTRY}>,return_path:array<{_ENTRY}>,"
    f"message_id:struct<present:boolean,headers:array<{_ID}>>,dkim:array<{_SIGNATURE}>,"
    "anomalies:array<struct<kind:string,header:string,index:int,detail:string,raw:string>>>"
)

_ZONE = r"(?:[+-]\d{4}|[A-Za-z]{1,5})$"


def _steps(array: Column, *steps: Callable[..., Column]) -> Column:
    """One transform after the other, so that each step reads what the last one computed instead of computing it again."""
    for step in steps:
        array = F.transform(array, step)
    return array


def _fields(item: Column, *names: str) -> list[Column]:
    return [item[name].alias(name) for name in names]


def _notes(*notes: Column) -> Column:
    return F.array_compact(F.array(*notes))


def _some(text: Column) -> Column:
    """Null for empty text."""
    return F.when(text != "", text)


def _said(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), text)


def one_line(value: Column) -> Column:
    return strip_text(F.regexp_replace(value, r"\r?\n", " "))


# -------------------------------------------------------------------- received


def _host(clause: Column, name: str) -> Column:
    """The word behind the first ``name`` that has one, without what punctuation ends it."""
    return F.regexp_replace(_some(F.regexp_extract(clause, rf"(?iU)\b{name}\s+([^\s;]+)", 1)), "[,;]+$", "")


def _in_utc(moment: Column) -> Column:
    """An ISO time with an offset, moved to UTC without regard to the session's zone."""
    sign = F.substring(moment, 20, 1)
    hours, minutes = (F.concat(sign, F.substring(moment, at, 2)).try_cast("int") for at in (21, 24))
    moved = F.substring(moment, 1, 19).try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), hours, minutes)
    return F.concat(F.replace(moved.cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))


def received(trace: Column) -> Column:
    """``HOPS`` of ``TRACE``; the time of a hop counts in UTC only where its zone is known."""

    def read(t: Column, i: Column) -> Column:
        when = F.when(t["raw"].contains(";"), strip_text(F.substring_index(t["raw"], ";", -1)))
        zone = _some(F.regexp_extract(strip_text(t["time"]), _ZONE, 0))
        return F.struct(i.alias("index"), *_fields(t, "raw", "moment"), when.alias("when"), zone.alias("zone"), *(_host(t["clause"], n).alias(n) for n in ("from", "by")))

    def judge(t: Column) -> Column:
        zoned = F.length(t["moment"]) > 19
        # a name of a zone that is not known is kept, but gives no time
        named = F.when(t["zone"].rlike("^[A-Za-z]"), t["zone"])
        issues = _notes(
            F.when(t["when"].isNull(), "no_time: no semicolon").when(t["when"] == "", "no_time: empty after semicolon"),
            F.when(t["from"].isNull(), "no_from_host"),
            F.when(t["by"].isNull(), "no_by_host"),
            F.when(t["moment"].isNotNull(), F.when(~zoned, F.coalesce(_said("unknown_zone: ", named), F.lit("no_zone")))).when(t["when"] != "", _said("bad_time: ", t["when"])),
        )
        return F.struct(
            *_fields(t, "index", "raw"), t["from"].alias("from_host"), t["by"].alias("by_host"), F.when(zoned, _in_utc(t["moment"])).alias("time_utc"), t["moment"].alias("time_original"),
            F.when(zoned, t["zone"]).when(t["moment"].isNotNull(), named).alias("timezone"), issues.alias("issues"),
        )

    return _steps(trace, read, judge).cast(HOPS)


# -------------------------------------------------------------------- entries


def _values(lines: Column, header: str) -> Column:
    """(index, raw, text, addresses) of the header's repetitions."""
    return F.transform(
        F.filter(lines, lambda x: x["name"] == header),
        lambda x, i: F.struct(i.alias("index"), x["value"].alias("raw"), one_line(x["value"]).alias("text"), x["addresses"].alias("addresses")),
    )


def address_entries(lines: Column, header: str) -> Column:
    def read(x: Column) -> Column:
        found = F.transform(F.coalesce(x["addresses"], F.array().cast("array<struct<name:string,address:string>>")), lambda a: F.struct(*_fields(a, "name", "address"), domain_of(a["address"]).alias("domain")))
        return F.struct(*_fields(x, "index", "raw", "text"), F.size(found).alias("count"), found.alias("addresses"))

    def judge(x: Column) -> Column:
        bare = F.filter(x["addresses"], lambda a: (a["address"] != "") & a["domain"].isNull())
        several = (x["count"] > 1) if header in SINGLE_HEADERS else F.lit(False)
        whole = F.when(x["text"] == "", "empty").when(x["count"] == 0, "no_address").when(several, _said("several_addresses: ", x["count"].cast("string")))
        first = F.get(x["addresses"], F.lit(0))
        anomalies = F.concat(F.transform(bare, lambda a: _said("no_domain: ", a["address"])), _notes(whole))
        return F.struct(*_fields(x, "index", "raw", "count", "addresses"), *_fields(first, "address", "name", "domain"), anomalies.alias("anomalies"))

    return _steps(_values(lines, header), read, judge).cast(f"array<{_ENTRY}>")


def id_entries(lines: Column) -> Column:
    """Message-ID headers: what is inside the first angle brackets, else the first word, cut at its last ``@``."""

    def read(x: Column) -> Column:
        closed = x["text"].rlike(r"\A[^<]*+<[^>]*+>")
        inner = F.when(closed, strip_text(F.regexp_extract(x["text"], r"\A[^<]*+<([^>]*+)>", 1))).otherwise(F.regexp_extract(x["text"], r"(?U)\A\S*+", 0))
        return F.struct(*_fields(x, "index", "raw", "text"), closed.alias("closed"), inner.alias("inner"), inner.contains("@").alias("cut"))

    def split(x: Column) -> Column:
        local = F.when(x["cut"], _some(F.regexp_extract(x["inner"], r"(?s)\A(.*)@", 1)))
        domain = F.when(x["cut"], _some(F.lower(F.substring_index(x["inner"], "@", -1))))
        return F.struct(*_fields(x, "index", "raw", "text", "closed", "inner", "cut"), local.alias("local_part"), domain.alias("domain"))

    def judge(x: Column) -> Column:
        cut = lambda test, note: F.when(x["cut"] & test, note)
        anomalies = _notes(
            F.when(x["text"] == "", "empty").when(~x["cut"], "no_domain"),
            cut(x["local_part"].isNull() | x["domain"].isNull(), "incomplete"),
            cut(~x["closed"], "no_angle_brackets"),
            cut(x["inner"].rlike(r"(?U)\s"), "white_space"),
        )
        value = F.when(x["text"] != "", F.when(x["closed"], F.concat(F.lit("<"), x["inner"], F.lit(">"))).otherwise(x["inner"]))
        return F.struct(*_fields(x, "index", "raw"), value.alias("value"), *_fields(x, "local_part", "domain"), anomalies.alias("anomalies"))

    return _steps(_values(lines, "message-id"), read, split, judge).cast(f"array<{_ID}>")


# ------------------------------------------------------------------------ dkim

_TAGS = ("v", "d", "s", "i", "h", "b")


def _again(names: Column) -> Column:
    """Names that occur before, each once, in the order of their first repetition: equal neighbours after sorting."""
    byname = F.array_sort(F.transform(names, lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
    with_last = lambda s: F.arrays_zip(s.alias("this"), F.slice(F.concat(F.array(F.lit(None).cast("struct<n:string,i:int>")), s), F.lit(1), F.size(s)).alias("last"))
    later = F.filter(with_last(byname), lambda p: p["this"]["n"] == p["last"]["n"])
    return F.array_distinct(F.transform(F.array_sort(F.transform(later, lambda p: F.struct(p["this"]["i"].alias("i"), p["this"]["n"].alias("n")))), lambda p: p["n"]))


def signature_entries(lines: Column) -> Column:
    """Tags of signatures that are never verified; of a repeated tag the first counts."""

    def pieces(x: Column) -> Column:
        parts = F.filter(F.transform(F.split(x["text"], ";"), strip_text), lambda p: p != "")
        named = lambda p: F.struct(p.alias("piece"), p.contains("=").alias("marked"), F.lower(strip_text(F.substring_index(p, "=", 1))).alias("name"), strip_text(F.regexp_replace(p, r"(?s)\A[^=]*+=", "")).alias("value"))
        judged = lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), F.when(~p["marked"], _said("no_equals: ", p["piece"])).when(~p["name"].rlike(r"\A[a-z][a-z0-9_]*\z"), _said("bad_tag: ", p["name"])).alias("wrong"))
        return F.struct(*_fields(x, "index", "raw"), _steps(parts, named, judged).alias("pieces"))

    def tags(x: Column) -> Column:
        return F.struct(*_fields(x, "index", "raw", "pieces"), F.filter(x["pieces"], lambda p: p["wrong"].isNull()).alias("good"))

    def values(x: Column) -> Column:
        first = lambda tag: F.get(F.filter(x["good"], lambda p: p["name"] == tag), F.lit(0))["value"].alias(tag)
        wrong = F.array_compact(F.transform(x["pieces"], lambda p: p["wrong"]))
        again = F.transform(_again(F.transform(x["good"], lambda p: p["name"])), lambda n: _said("repeated_tag: ", n))
        return F.struct(*_fields(x, "index", "raw"), F.concat(wrong, again).alias("wrong"), *(first(t) for t in _TAGS))

    def parts(x: Column) -> Column:
        names = F.filter(F.split(F.lower(F.coalesce(x["h"], F.lit(""))), r"(?U)[\s:]+"), lambda n: n != "")
        return F.struct(
            *_fields(x, "index", "raw", "wrong", "v", "b", "i"), _some(x["d"]).alias("d"), _some(x["s"]).alias("s"), x["h"].isNull().alias("no_h"), names.alias("names"),
            _some(F.regexp_extract(x["i"], r"(?s)\A(.*)@", 1)).alias("local"), _some(F.lower(F.substring_index(x["i"], "@", -1))).alias("domain"),
        )

    def judge(x: Column) -> Column:
        rules = _notes(
            F.when(x["v"].isNull(), "no_v").when(x["v"] != "1", _said("bad_v: ", x["v"])),
            F.when(x["d"].isNull(), "no_d"),
            F.when(x["s"].isNull(), "no_s"),
            F.when(~same_or_below(x["domain"], F.lower(x["d"])), _said("i_outside_d: ", x["domain"])),
            F.when(F.size(x["names"]) == 0, F.when(x["no_h"], "no_h").otherwise("empty_h")),
            F.when(x["b"].isNull(), "no_b"),
        )
        return F.struct(
            *_fields(x, "index", "raw"), F.lit(True).alias("present"), *_fields(x, "d", "s", "i"), x["local"].alias("i_local_part"), x["domain"].alias("i_domain"),
            x["names"].alias("h"), F.array_contains(x["names"], "from").alias("covers_from"), F.concat(x["wrong"], rules).alias("anomalies"),
        )

    return _steps(_values(lines, "dkim-signature"), pieces, tags, values, parts, judge).cast(f"array<{_SIGNATURE}>")


# -------------------------------------------------------------------- identity


def entries(lines: Column) -> dict[str, Column]:
    """The entries of every sender header, by its name."""
    return {**{h: address_entries(lines, h) for h in ADDRESS_HEADERS}, "message-id": id_entries(lines), "dkim-signature": signature_entries(lines)}


def identity(of: dict[str, Column]) -> Column:
    """``IDENTITY`` of the entries of each header.

    Give columns of a frame rather than the expressions of ``entries``: the
    anomalies read every array a second time.
    """

    def noted(header: str) -> Column:
        kind = "dkim_tag_error" if header == "dkim-signature" else "malformed_value"
        note = lambda kind, index, detail, raw: F.struct(F.lit(kind).alias("kind"), F.lit(header).alias("header"), index.alias("index"), detail.alias("detail"), raw.alias("raw"))
        each = F.flatten(F.transform(of[header], lambda e: F.transform(e["anomalies"], lambda a: note(kind, e["index"], a, e["raw"]))))
        if header not in SINGLE_HEADERS:
            return each
        once = note("duplicate_header", F.lit(None).cast("int"), _said("repeated: ", F.size(of[header]).cast("string")), F.lit(None).cast("string"))
        return F.concat(each, F.filter(F.array(once), lambda _: F.size(of[header]) > 1))

    ids = of["message-id"]
    return F.when(
        ids.isNotNull(),
        F.struct(
            *(of[h].alias(h.replace("-", "_")) for h in ADDRESS_HEADERS), F.struct((F.size(ids) > 0).alias("present"), ids.alias("headers")).alias("message_id"), of["dkim-signature"].alias("dkim"),
            F.concat(*(noted(h) for h in SENDER_HEADERS)).alias("anomalies"),
        ),
    ).cast(IDENTITY)
