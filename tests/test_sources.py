"""Packages, mails, quote structure, JSON and the catalog."""

import io
import json
import random
import zipfile
from concurrent.futures import ThreadPoolExecutor
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from heliograph.functions import addresses, dates, headers, quotes
from heliograph.sources import catalog, export, mime, packages


def eml(mid="<a@x.org>", **more):
    m = EmailMessage()
    m["Message-ID"] = mid
    m["From"] = "Ann Lee <Ann@X.org>"
    m["To"] = "bob@y.org, Bob <bob@y.org>, c@z.org"
    m["Date"] = "Mon, 02 Sep 2024 10:00:00 +0200"
    for k, v in more.items():
        m[k.replace("_", "-")] = v
    m.set_content("Hello\n> quoted\n")
    return m


def package(entries, **flags):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            info.external_attr = flags.get("mode", 0o100644) << 16
            z.writestr(info, content)
    return out.getvalue()


def test_mail_row():
    m = eml(References="<r1@x> bare@token <r2@x> <r1@x>", In_Reply_To="<r2@x>")
    m.add_attachment(b"one", maintype="a", subtype="b", filename="f.txt")
    m.add_attachment(b"two", maintype="a", subtype="b", filename="f.txt")
    row = mime.parse_mail(m.as_bytes(), "1.eml")
    assert (row["message_id"], row["in_reply_to"], row["refs"]) == ("<a@x.org>", "<r2@x>", ["<r1@x>", "<r2@x>"])
    assert any("bare@token" in i for i in row["issues"])
    assert row["date"] == "2024-09-02T10:00:00+02:00"
    assert row["from"] == {"name": "Ann Lee", "address": "Ann@X.org"}
    assert [a["address"] for a in row["to"]] == ["bob@y.org", "c@z.org"]
    assert [(a["filename"], a["original_filename"], a["size"]) for a in row["attachments"]] == [("f.txt", None, 3), ("f(1).txt", "f.txt", 3)]
    assert row["lines"][1]["addresses"] == [{"name": "Ann Lee", "address": "Ann@X.org"}]
    assert [s["kind"] for s in row["quote_structure"]["segments"]] == ["own", "quote"]


def test_bad_mail_never_raises():
    for raw in (b"", b"\xff\xfe\0", b"Message-ID: no brackets@here\n\nx", b"From: \xff\xfe <a@b.c>\nDate: nonsense\nContent-Type: multipart/mixed\n\nbody"):
        row = mime.parse_mail(raw, "x")
        assert row["raw_sha256"]
    broken = b"Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain; charset=nope\n\n\xff\xfe\n--b\nContent-Disposition: attachment; filename=q.bin\nContent-Transfer-Encoding: base64\n\n!!!a\n--b--\n"
    row = mime.parse_mail(broken, "x")
    assert row["attachments"][0]["undecodable"]
    assert any(i.startswith("undecodable: text body") for i in row["issues"])


def read_headers(spark, *mails):
    """(received, identity) of every mail, in order."""
    rows = [(i, p["trace"], p["lines"]) for i, p in enumerate(mime.parse_mail(m if isinstance(m, bytes) else m.encode(), "m") for m in mails)]
    made = mime.values_of_headers(spark.createDataFrame(rows, f"k int, trace {headers.TRACE}, lines {headers.LINES}")).orderBy("k").collect()
    return [(r["received"], r["identity"]) for r in made]


def test_received_hops(spark):
    cases = {
        "from a.example (helo (x)) by b.example with SMTP;\n Mon, 02 Sep 2024 10:00:00 +0200 (CEST)": ("a.example", "b.example", "2024-09-02T08:00:00+00:00", "2024-09-02T10:00:00+02:00", "+0200", []),
        "by b; Mon, 02 Sep 2024 10:00:00": (None, "b", None, "2024-09-02T10:00:00", None, ["no_from_host", "no_zone"]),
        "by b; Mon, 02 Sep 2024 10:00:00 XYZ": (None, "b", None, "2024-09-02T10:00:00", "XYZ", ["no_from_host", "unknown_zone: XYZ"]),
        "from a by b": ("a", "b", None, None, None, ["no_time: no semicolon"]),
        "from a by b;": ("a", "b", None, None, None, ["no_time: empty after semicolon"]),
        "FROM a,; by (x) (y b; junk": ("a", "(y", None, None, None, ["bad_time: junk"]),
        "from from; from (c;d) x by ;y by z; 1 Jan 2024 00:10:00 +0545": ("from", "z", "2023-12-31T18:25:00+00:00", "2024-01-01T00:10:00+05:45", "+0545", []),
        "from (by b) ((c) a; 1 Jan 2024 23:50 -0730": ("(", None, "2024-01-02T07:20:00+00:00", "2024-01-01T23:50:00-07:30", "-0730", ["no_by_host"]),
    }
    hops = read_headers(spark, "".join(f"Received: {h}\n" for h in cases) + "\nx")[0][0]
    assert [h["index"] for h in hops] == list(range(len(cases)))
    for hop, (text, want) in zip(hops, cases.items(), strict=True):
        assert (hop["from_host"], hop["by_host"], hop["time_utc"], hop["time_original"], hop["timezone"], hop["issues"]) == want, text


def test_utc_does_not_depend_on_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        hops = read_headers(spark, "Received: by b; Sun, 10 Mar 2024 04:30:00 +0200\n\nx")[0][0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert hops[0]["time_utc"] == "2024-03-10T02:30:00+00:00"


def test_signatures(spark):
    cases = {
        "v=1; d=X.org; d=other; s=k; i=joe@mail.other.net; h=To : FROM:Subject; b=": ("X.org", "k", "joe", "mail.other.net", ["to", "from", "subject"], ["repeated_tag: d", "i_outside_d: mail.other.net"]),
        "v=1;d=x.org;s=k;i=@Sub.X.org;h=from;b=1": ("x.org", "k", None, "sub.x.org", ["from"], []),
        "v=1;d=x.org;s=k;i=evilx.org;h=;b=1": ("x.org", "k", None, "evilx.org", [], ["i_outside_d: evilx.org", "empty_h"]),
        "loose; 9=x; =y; V=2; s=; s=k; d=; s=l; d=q": (None, None, None, None, [], ["no_equals: loose", "bad_tag: 9", "bad_tag: ", "repeated_tag: s", "repeated_tag: d", "bad_v: 2", "no_d", "no_s", "no_h", "no_b"]),
        "": (None, None, None, None, [], ["no_v", "no_d", "no_s", "no_h", "no_b"]),
    }
    identity = read_headers(spark, "".join(f"DKIM-Signature: {h}\n" for h in cases) + "\nx")[0][1]
    for got, (text, want) in zip(identity["dkim"], cases.items(), strict=True):
        assert (got["d"], got["s"], got["i_local_part"], got["i_domain"], got["h"], got["anomalies"]) == want, text
        assert got["covers_from"] == ("from" in want[4])
    noted = [(a["kind"], a["index"], a["detail"]) for a in identity["anomalies"]]
    assert noted[-1] == ("duplicate_header", None, "repeated: 5")
    assert noted[:-1] == [("dkim_tag_error", i, d) for i, w in enumerate(cases.values()) for d in w[5]]


def test_message_ids_and_addresses(spark):
    ids = {
        "<A@B.org>": ("<A@B.org>", "A", "b.org", []), "plain": ("plain", None, None, ["no_domain"]), "x@y.z rest": ("x@y.z", "x", "y.z", ["no_angle_brackets"]), "< a b@c@D >": ("<a b@c@D>", "a b@c", "d", ["white_space"]),
        "<@d>": ("<@d>", None, "d", ["incomplete"]), "<l@> <q@w>": ("<l@>", "l", None, ["incomplete"]), "<open@x": ("<open@x", "<open", "x", ["no_angle_brackets"]), "": (None, None, None, ["empty"]), "<>": ("<>", None, None, ["no_domain"]),
    }
    mails = ["".join(f"Message-ID: {h}\n" for h in ids) + "\nx", "Sender: a@b.c, d@e\nSender:\nReply-To: nobody\nReply-To: <r@S.T>\nReturn-Path: <>\nFrom: a@b.c, Q <q@w.e>\n\nx", "\nx"]
    (_, first), (_, second), (hops, none) = read_headers(spark, *mails)
    for got, (text, want) in zip(first["message_id"]["headers"], ids.items(), strict=True):
        assert (got["value"], got["local_part"], got["domain"], got["anomalies"]) == want, text
    assert (second["from"][0]["count"], second["from"][0]["domain"], second["from"][0]["anomalies"], second["reply_to"][1]["domain"]) == (2, "b.c", [], "s.t")
    assert [(a["kind"], a["header"], a["index"], a["detail"]) for a in second["anomalies"]] == [
        ("malformed_value", "sender", 0, "no_domain: d@e"), ("malformed_value", "sender", 0, "several_addresses: 2"), ("malformed_value", "sender", 1, "empty"), ("duplicate_header", "sender", None, "repeated: 2"),
        ("malformed_value", "reply-to", 0, "no_domain: nobody"), ("malformed_value", "return-path", 0, "no_domain: <>"),  # the standard library writes an empty address so
    ]
    assert (hops, none["from"], none["message_id"]["present"], none["dkim"], none["anomalies"]) == ([], [], False, [], [])


@pytest.mark.parametrize(
    ("name", "good"),
    [("a.eml", True), ("d/a.eml", True), ("d/../a.eml", True), ("./a.eml", True), ("", False), (" ", False), ("../a", False), ("a/../../b", False), ("/a", False), ("C:a", False), ("a\\b", False), ("con", False), ("x/LPT1.txt", False), ("a./b", False), ("a ", False), ("d/..", False), ("console", True)],
)
def test_member_names(spark, name, good):
    assert spark.range(1).select(packages.safe_name(F.lit(name))).first()[0] is good


def test_rules_of_packages(spark):
    small = packages.Limits(entries=3, entry_bytes=2000, total_bytes=3000, ratio=20)
    files = {
        "ok": package([("a.eml", b"x"), ("n.txt", b"y")]), "slip": package([("../a.eml", b"x")]), "many": package([(f"{i}.eml", b"x") for i in range(4)]), "twice": package([("A.eml", b"x"), ("a.EML", b"y")]),
        "big": package([("a.eml", bytes(range(256)) * 8)]), "sum": package([(f"{i}.eml", bytes((j * 7 + i) % 251 for j in range(1500))) for i in range(3)]), "bomb": package([("a.eml", b"0" * 1900)]),
        "link": package([("a.eml", b"/etc")], mode=0o120777), "dir": package([("d/", b"")], mode=0), "junk": b"no zip", "empty": package([]),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "package string, content binary")
    got = {r["package"]: r["reason"] for r in packages.violations(packages.scan(df), small).collect()}
    assert got == {
        "slip": "unsafe_name", "many": "too_many_entries", "twice": "duplicate_name", "big": "entry_too_large", "sum": "package_too_large", "bomb": "compression_ratio", "link": "not_a_regular_file", "dir": "directory", "junk": "not_a_zip",
    }
    assert [r["name"] for r in packages.skipped(packages.scan(df.where("package = 'ok'"))).collect()] == ["n.txt"]


def test_mails_of_packages(spark):
    good = package([("1.eml", eml("<1@x>").as_bytes()), ("note.txt", b"n"), ("2.eml", eml("<2@x>", In_Reply_To="<1@x>").as_bytes())])
    df = spark.createDataFrame([("p", bytearray(good)), ("q", bytearray(b"junk"))], "package string, content binary")
    rows = packages.read_mails(df).orderBy("uid").collect()
    assert [(r["package"], r["uid"], r["message_id"], r["in_reply_to"]) for r in rows] == [("p", 0, "<1@x>", None), ("p", 1, "<2@x>", "<1@x>")]


def test_packages_by_path_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packages, "PART_BYTES", 700)
    names = [f"{i}.eml" if i % 3 else f"{i}.txt" for i in range(40)]
    files = {"many mails é": package([*((n, eml(f"<{n}@x>").as_bytes()) for n in names), ("note.txt", random.Random(1).randbytes(100_000))]), "junk": b"no zip", "empty": package([]), "slip": package([("../a.eml", b"x")]), "lies": package([("1.eml", b"Subject: a\n\nb"), ("2.eml", b"Subject: c\n\nd")])}
    with zipfile.ZipFile(io.BytesIO(files["lies"])) as z:
        at = files["lies"].rindex(b"PK\x01\x02")
        assert z.infolist()[1].filename == "2.eml"
    lies = bytearray(files["lies"])
    lies[at + 24] -= 1
    files["lies"] = bytes(lies)
    for name, content in files.items():
        (tmp_path / f"{name}.zip").write_bytes(content)
    found = packages.load(spark, str(tmp_path))
    assert found.columns == ["package", "length"]
    entries = packages.scan(found)
    broken = packages.violations(entries)
    assert {r["package"].rpartition("/")[2]: r["reason"] for r in broken.collect()} == {"junk.zip": "not_a_zip", "slip.zip": "unsafe_name"}
    assert packages.parts(entries, broken).where("package LIKE '%many%'").count() > 5
    by_path = packages.read_mails(found)
    given = spark.createDataFrame([(n, bytearray(c)) for n, c in files.items()], "package string, content binary")
    by_content = packages.read_mails(given)
    assert by_path.schema == by_content.schema
    want = [(i, f"<{n}@x>", n) for i, n in enumerate(n for n in names if n.endswith("eml"))]
    for mails in (by_path, by_content):
        assert [(r["uid"], r["message_id"], r["source_file"]) for r in mails.orderBy("uid").collect()] == want


def test_stream_of_packages(spark, tmp_path):
    from heliograph.streaming import ingest

    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    first = package([("1.eml", eml("<1@x>").as_bytes()), ("2.eml", eml("<2@x>", In_Reply_To="<1@x>").as_bytes())])
    (tmp_path / "in/a.zip").write_bytes(first)
    (tmp_path / "in/b.zip").write_bytes(first)
    (tmp_path / "in/c.zip").write_bytes(package([("../x.eml", b"x")]))
    ingest.ingest(spark, folder, out, mark).awaitTermination(120)
    assert spark.read.parquet(f"{out}/forest").select("uid", "parent_uid").orderBy("uid").collect() == [(0, None), (1, 0)]
    assert [r["reason"] for r in spark.read.parquet(f"{out}/rejected").collect()] == ["unsafe_name"]
    (tmp_path / "in/d.zip").write_bytes(package([("9.eml", eml("<9@x>").as_bytes())]))
    (tmp_path / "in/e.zip").write_bytes(first)
    ingest.ingest(spark, folder, out, mark).awaitTermination(120)
    assert spark.read.parquet(f"{out}/forest").count() == 3


def test_quote_structure():
    body = "Hi\n\nOn Monday Bob wrote:\nold text\n> older\n-- \nme\n-----Original Message-----\nfrom far\n\n****\nFrom: a\nSent: b\nTo: c\nrest"
    found = quotes.of_text(body)["segments"]
    assert [(s["kind"], s["level"], s["marker"]) for s in found] == [
        ("own", 0, None), ("separator", 0, "on_wrote"), ("quote", 1, "on_wrote"), ("quote", 1, ">"), ("separator", 0, "signature"), ("own", 0, None), ("separator", 0, "original_message"),
        ("forward", 0, None), ("separator", 0, None), ("separator", 0, "outlook_header"), ("forward", 0, None),
    ]
    for s in found:
        assert body[s["char_start"] : s["char_end"]] == s["text"]
    nested = quotes.of_html("<p>top</p><blockquote>one<blockquote>two</blockquote></blockquote></blockquote>end")
    assert [(s["kind"], s["level"], s["text"]) for s in nested["segments"]] == [("own", 0, "top"), ("quote", 1, "one"), ("quote", 2, "two"), ("own", 0, "end")]
    view = quotes.view_text(nested, "")
    assert all(view[s["char_start"] : s["char_end"]] == s["text"] for s in nested["segments"])
    assert quotes.of_text("") == quotes.structure([], "body_text")


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    norm = {"A@X.Org": "A@x.org", "a@b": "a@b", "a@@b": None, "a b@c": None, '"q"@c.d': None, "a@-b.c": None, "@c": None, "a@": None, "a@b..c": None, "a@" + "x" * 64: None}
    assert {k: one(addresses.normalize_address(F.lit(k))) for k in norm} == norm
    assert one(addresses.malformed_reason(F.lit("a@@b"))) == "at_signs:2"
    assert one(addresses.is_forward(F.lit("回复：RE: Fwd: x")))
    assert not one(addresses.is_forward(F.lit("Re: forward")))
    assert addresses.filter_key("Bob <Bob@X.Y>") == "Bob@x.y"
    for bad in ("a@b", "a@b.c, d@e.f", "", "x"):
        with pytest.raises(ValueError, match="address"):
            addresses.filter_key(bad)
    assert one(dates.instant_us(F.lit("1970-01-01T01:00:00+01:00"))) == 0
    assert one(dates.instant_us(F.lit("1970-01-01T01:00:00"))) is None
    assert one(dates.instant_us(F.lit("2024-99-01T01:00:00Z"))) is None
    assert one(addresses.first_msgid(F.lit("x tok@en <a@b> "))) == "<a@b>"
    assert one(addresses.first_msgid(F.lit("none"))) is None


def test_json_without_recursion(spark, tmp_path):
    for text in ('{"a": [1, -2.5e3, "x\\u00e9\\ud83d\\ude00", null, true], "b": {}}', "[]", '"s"', "0", '{"a":1,"a":2}'):
        assert export.loads(text) == json.loads(text)
    for text in ("", "[1,]", "{'a':1}", "[1 2]", '{"a" 1}', "[1]]", '"\\ud800"', "01", "nul", '{"a":1,}'):
        with pytest.raises(ValueError):
            export.loads(text)
    deep = "[" * 3000 + "]" * 3000
    assert isinstance(export.loads(deep), list)
    rows = [(i, i - 1 if i else None, i, f"m{i}") for i in range(1500)]
    forest = spark.createDataFrame(rows, "uid long, parent_uid long, thread_pos long, message_id string")
    text = export.forest_json(forest)
    flat = list(export.flatten(export.loads(text)))
    assert [(r["uid"], r["parent_uid"], r["thread_root_uid"]) for r in flat] == [(i, i - 1 if i else None, 0) for i in range(1500)]
    export.write_forest_json(forest, str(tmp_path / "parts"))
    parts = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == text.split("\n")
    assert export.forest_json(forest.limit(0)).split() == ["[", "]"]
    path = tmp_path / "t.json"
    export.write_json(text, str(path))
    assert path.read_text() == text
    docs = spark.createDataFrame([("p", json.dumps({"threads": [{"uid": 1, "message_id": "m", "children": [{"uid": 2, "children": []}]}]})), ("q", "junk")], "path string, value string")
    got = sorted(export.import_results(docs).collect(), key=lambda r: (r["path"], r["uid"] or 0))
    assert [(r["uid"], r["parent_uid"], r["message_id"]) for r in got[:2]] == [(1, None, "m"), (2, 1, None)]
    assert got[2]["error"].startswith("ValueError")


def test_nested_json_of_random_forests(spark):
    rng = random.Random(8)
    rows, place, root_of, depth_of = [], {}, {}, {}
    for uid in range(200):  # every mail hangs under an ancestor of the one before it, so arrival order is reading order
        chain = []
        at = uid - 1 if uid else None
        while at is not None:
            chain.append(at)
            at = rows[at][1]
        parent = None if rng.random() < 0.1 else rng.choice([*chain, chain[0]] if chain else [None])
        root_of[uid] = uid if parent is None else root_of[parent]
        depth_of[uid] = 0 if parent is None else depth_of[parent] + 1
        place[root_of[uid]] = place.get(root_of[uid], -1) + 1
        rows.append((uid, parent, root_of[uid], depth_of[uid], place[root_of[uid]], None if uid % 3 else f'a"\n{uid}'))
    forest = spark.createDataFrame(rows, "uid long, parent_uid long, root_uid long, depth long, thread_pos long, subject string").repartition(4)
    trees = json.loads(export.forest_json(forest))
    seen = []
    stack = [(t, None) for t in reversed(trees)]
    while stack:
        node, parent = stack.pop()
        seen.append((node["uid"], parent, node["subject"]))
        stack += [(c, node["uid"]) for c in reversed(node["children"])]
    assert seen == [(r[0], r[1], r[5]) for r in rows]
    assert export.forest_json(forest).split("\n")[1].startswith("  {")


def test_one_key_of_many_callers(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(20) as pool:
        keys = list(pool.map(lambda i: c.admit("job", f"j{i}", "same", "t"), range(20)))
    assert len(set(keys)) == 1
    assert {r["key"] for r in c.current("job").collect()} == set(keys)
    assert {catalog.create_or_read(spark, f"{tmp_path}/x/k", str(i)) for i in range(5)} == {"0"}


def test_snapshots_and_tail(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "log"))
    seen = lambda: sorted((r["key"], r["state"], r["created_at"]) for r in c.current().collect())
    for i in range(3):
        c.set_state("job", f"j{i}", "queued", target="t")
    before = seen()
    assert c.compact() and seen() == before and not c.compact()
    c.set_state("job", "j0", "completed", detail="d")
    c.set_state("job", "j1", "deleted")
    now = seen()
    assert [(k, s) for k, s, _ in now] == [("j0", "completed"), ("j2", "queued")] and now[0][2] == before[0][2]
    assert not c.compact(3) and c.compact(2) and seen() == now
    assert len(c.files.names("changes")) == 2, "what the snapshot before had taken is gone, what the last one took stays"
    c.set_state("job", "j2", "processing")
    assert c.compact() and [s for _, s, _ in seen()] == ["completed", "processing"]
    (tmp_path / "log/changes/half" / "_temporary").mkdir(parents=True)
    assert not c.compact() and "half" in c.files.names("changes")
    assert len(c.files.names("snapshots")) == 2 and c.history().count() == 6
    assert c.target("job", "j0") == (None, "d")


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "log"))
    key = c.admit("job", "j1", "once", "t1")
    assert c.admit("job", "j2", "once", "t1") == key == "j1"
    with pytest.raises(catalog.Conflict):
        c.admit("job", "j3", "once", "t2")
    c.set_state("job", "j1", "processing", progress="parsing")
    assert [r["key"] for r in c.unfinished("job").collect()] == ["j1"]
    assert c.target("job", "j1") == ("target_processing", None)
    c.set_state("job", "j1", "completed", detail="/result")
    assert c.target("job", "j1") == (None, "/result")
    assert c.target("job", "nope")[0] == "target_deleted_or_unknown"
    c.set_state("job", "j1", "deleted")
    assert c.latest("job").collect() == []


def test_package_with_one_lying_entry_gives_no_mail_and_harms_no_other(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("1.eml", eml("<one@x.org>").as_bytes())
        z.writestr("2.eml", eml("<two@x.org>").as_bytes())
        z.filelist[1].file_size -= 1
    sound = package([("1.eml", eml("<good@x.org>").as_bytes())])
    df = spark.createDataFrame([("bad", out.getvalue()), ("good", sound)], "package string, content binary").coalesce(1)
    assert packages.violations(packages.scan(df)).collect() == []
    assert [(r.package, r.message_id) for r in packages.read_mails(df).collect()] == [("good", "<good@x.org>")]


def test_small_packages_share_tasks(spark):
    runs = spark.range(500).selectExpr("'p' || id package", "cast(null as binary) content", "array(0, 1) entries", "0L first_uid", "100L bytes")
    assert packages.reading_tasks(runs) == spark.sparkContext.defaultParallelism
    assert packages.reading_tasks(runs.withColumn("bytes", F.lit(64 << 20))) == 500
    assert packages.reading_tasks(runs.limit(1)) == 1 and packages.reading_tasks(runs.limit(0)) == 1
