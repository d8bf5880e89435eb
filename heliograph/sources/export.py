"""Nested JSON of one thread or package at a time, and flat import of such documents.

Forests stay adjacency tables; nesting exists only at this edge.  Writing needs
neighbours in reading order and reading an explicit stack, so a chain of any
depth passes.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators.threads import climb

#: Documents that are nested less deeply are indented.
PRETTY_DEPTH = 500


def document_lines(forest: DataFrame, place: str = "thread_pos") -> DataFrame:
    """(part, root_uid, place, text): the nested JSON document of one scope's forest, a line for each mail.

    In reading order a mail opens its object and its list of children, and
    closes as many as the next mail lies higher, so a line needs its two
    neighbours only: two joins by place, no stack and no thread in one task.
    Lines in the order of (part, root_uid, place) are the document, whatever its
    depth; an empty forest is an empty list.
    """
    if not {"root_uid", "depth"} <= set(forest.columns):
        reached = climb(forest.withColumn("__scope", F.lit(0)), "__scope").drop("__scope", "circular")
        forest = forest.drop("root_uid", "depth").join(reached, "uid", "left").withColumn("root_uid", F.coalesce("root_uid", "uid")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    edges = forest.agg(F.min("root_uid").alias("first"), F.max("depth").alias("deepest")).first()
    shown = [F.col(f"`{c}`") for c in forest.columns if c not in ("parent_uid", place)]
    nodes = forest.select("root_uid", F.col(place).alias("place"), F.col("depth").cast("int").alias("depth"), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("own"))
    before = nodes.select("root_uid", (F.col("place") + 1).alias("place"), F.col("depth").alias("before"))
    after = nodes.select("root_uid", (F.col("place") - 1).alias("place"), F.col("depth").alias("after"))
    met = nodes.join(before, ["root_uid", "place"], "left").join(after, ["root_uid", "place"], "left")
    comma = F.when(F.coalesce(F.col("before") >= F.col("depth"), F.col("root_uid") != F.lit(edges["first"])), ",").otherwise("")
    indent = F.repeat(F.lit("  "), F.col("depth") + 1) if (edges["deepest"] or 0) < PRETTY_DEPTH else F.lit("")
    closed = F.repeat(F.lit("]}"), F.col("depth") - F.coalesce("after", F.lit(-1)) + 1 - F.when(F.col("after").isNull(), 1).otherwise(0))
    text = F.concat(indent, comma, F.expr("substring(own, 1, length(own) - 1)"), F.lit(',"children":['), closed)
    lines = met.select(F.lit(1).alias("part"), "root_uid", "place", text.alias("text"))
    ends = forest.sparkSession.createDataFrame([(0, "["), (2, "]")], "part int, text string")
    return lines.unionByName(ends, allowMissingColumns=True)


def write_forest_json(forest: DataFrame, folder: str, place: str = "thread_pos") -> None:
    """The document as text files that follow one another in the order of their names."""
    document_lines(forest, place).orderBy("part", "root_uid", "place").select("text").write.mode("overwrite").text(folder)


def forest_json(forest: DataFrame, place: str = "thread_pos") -> str:
    """The document as one text, for a thread or package that the caller chose to show; lines come one partition at a time."""
    rows = document_lines(forest, place).orderBy("part", "root_uid", "place").select("text").toLocalIterator()
    return "\n".join(r["text"] for r in rows)


def write_json(text: str, path: str) -> None:
    """Replace the file as a whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, prefix=".", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise



def loads(text: str) -> Any:
    """Strict JSON without recursion; later keys win, numbers keep their kind, lone surrogates are refused."""
    scan = json.decoder.scanstring
    number = json.scanner.NUMBER_RE
    at, end = 0, len(text)
    stack: list[tuple[Any, str | None]] = []

    def space(i: int) -> int:
        while i < end and text[i] in " \t\n\r":
            i += 1
        return i

    def fail(what: str) -> ValueError:
        return ValueError(f"{what} at {at}")

    def text_at(i: int) -> tuple[str, int]:
        value, i = scan(text, i + 1, True)
        value.encode("utf-8")
        return value, i

    value: Any = None
    while True:
        at = space(at)
        opened = False
        if at >= end:
            raise fail("unexpected end")
        c = text[at]
        if c in "{[":
            close = "}" if c == "{" else "]"
            value = {} if c == "{" else []
            at = space(at + 1)
            if at < end and text[at] == close:
                at += 1
            else:
                stack.append((value, None))
                opened = True
        elif c == '"':
            value, at = text_at(at)
        elif word := next((w for w in ("true", "false", "null") if text.startswith(w, at)), None):
            value, at = {"true": True, "false": False, "null": None}[word], at + len(word)
        elif m := number.match(text, at):
            whole, fraction, exponent = m.groups()
            value = float(whole + (fraction or "") + (exponent or "")) if fraction or exponent else int(whole)
            at = m.end()
        else:
            raise fail("unexpected character")
        while True:
            at = space(at)
            if not opened:
                if not stack:
                    if at < end:
                        raise fail("text after the end")
                    return value
                holder, key = stack.pop()
                if key is None:
                    holder.append(value)
                else:
                    holder[key] = value
                close = "}" if isinstance(holder, dict) else "]"
                if at < end and text[at] == close:
                    value, at = holder, at + 1
                    continue
                if at >= end or text[at] != ",":
                    raise fail("expected a comma")
                at = space(at + 1)
                stack.append((holder, None))
            holder = stack[-1][0]
            if isinstance(holder, dict):
                if at >= end or text[at] != '"':
                    raise fail("expected a key")
                key, at = text_at(at)
                at = space(at)
                if at >= end or text[at] != ":":
                    raise fail("expected a colon")
                at += 1
                stack[-1] = (holder, key)
            break


def flatten(trees: list[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    """Nodes of nested trees in preorder with ``parent_uid`` and ``thread_root_uid``."""
    stack = [(t, None, t.get("uid")) for t in reversed(trees)]
    while stack:
        node, parent, root = stack.pop()
        yield {**{k: v for k, v in node.items() if k != "children"}, "parent_uid": parent, "thread_root_uid": root}
        stack += [(c, node.get("uid"), root) for c in reversed(node.get("children") or [])]


def import_results(documents: DataFrame, fields: str = "message_id string, raw_sha256 string, in_reply_to string, date string, source_file string") -> DataFrame:
    """Flat rows of stored result documents (``path, value``), one JSON text a row.

    Unreadable documents give one row with ``error``; a thread list is looked
    for under ``threads``, ``roots`` or at the top.
    """
    names = [f.strip().split()[0] for f in fields.split(",")]
    columns = ["path", "error", "uid", "parent_uid", "thread_root_uid", *names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, value in zip(batch["path"], batch["value"], strict=True):
                try:
                    found = loads(value)
                    trees = found if isinstance(found, list) else found.get("threads") or found.get("roots") or []
                    rows += [{"path": path, "error": None, **node} for node in flatten(trees)]
                except Exception as e:
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            out = pd.DataFrame([tuple(r.get(c) for c in columns) for r in rows], columns=columns, dtype=object)
            yield out.astype({c: "Int64" for c in ("uid", "parent_uid", "thread_root_uid")})

    return documents.select("path", "value").mapInPandas(run, f"path string, error string, uid long, parent_uid long, thread_root_uid long, {fields}")


def public_rows(nodes: DataFrame) -> DataFrame:
    """A forest without its internal columns."""
    inner = {"chosen_pos", "canonical_uid", "parent_ref", "missing_refs", "self_refs", "ambiguous_refs", "cycle_refs"}
    return nodes.select(*[F.col(f"`{c}`") for c in nodes.columns if c not in inner])
