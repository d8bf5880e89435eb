"""The four analyses on small cases whose results are known by hand, and multiset pairing by brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from heliograph.operators import attachments, filters, identity, recipients, timing

HOP = "struct<index:int,raw:string,from_host:string,by_host:string,time_utc:string,time_original:string,timezone:string,issues:array<string>>"
TIMED = f"scope string, uid long, message_id string, raw_sha256 string, date string, parent_uid long, received array<{HOP}>"


def hop(i, time, issues=(), host="h"):
    return (i, None, host, "b", time, None, None, list(issues))


def at(minute, second=0):
    return f"2024-01-01T10:{minute:02}:{second:02}+00:00"


def test_timing_findings(spark):
    rows = [
        # skew of exactly the limit is none; hops: gap at the limit, above it, inversion, and one without a time
        ("s", 0, "<a>", "h0", at(0), None, [hop(0, at(30)), hop(1, None, ["x"]), hop(2, at(20)), hop(3, at(25)), hop(4, at(7, 1)), hop(5, at(2, 1)), hop(6, at(2))]),
        ("s", 1, "<b>", "h1", at(10), 0, [hop(0, at(12, 1))]),
        ("s", 2, "<c>", "h2", "2024-01-01T09:00:00", 1, [hop(0, at(1))]),
        ("s", 3, "<d>", "h3", at(0), 1, []),
        ("s", 4, "<e>", "h4", None, 3, None),
        ("s", 5, "<a>", "h5", at(0), None, [hop(0, at(0), host="other")]),
        ("t", 0, "<a>", "h0", at(0), None, []),
    ]
    mails = spark.createDataFrame(rows, TIMED)
    found = timing.findings(mails)
    got = [(r["scope"], r["id"], r["type"], r["node_uids"], r["value_us"], r["direction"], r["hop_from"], r["hop_to"]) for r in found.orderBy("scope", "seq").collect()]
    m = 60_000_000
    assert got[:5] == [
        ("s", "F0001", "abnormal_transit", [0], 18 * m - 1_000_000, None, 4, 3),
        ("s", "F0002", "hop_time_inversion", [0], -5 * m, None, 3, 2),
        ("s", "F0003", "client_clock_skew", [1], 2 * m + 1_000_000, "client_behind", None, None),
        ("s", "F0004", "reply_before_parent", [3, 1], 10 * m, None, None, None),
        ("s", "F0005", "chain_mismatch", [0, 5], None, None, None, None),
    ]
    assert len(got) == 5
    assert found.where("type = 'chain_mismatch'").first()["detail"] == "hops:7 vs 1"
    line = {r["uid"]: r for r in timing.timeline(mails, found).where("scope = 's'").collect()}
    assert (line[2]["time_basis"], line[2]["date_note"], line[4]["time_us"], line[4]["date_note"]) == ("received", "date_without_zone", None, "date_missing")
    assert line[1]["finding_ids"] == ["F0003", "F0004"]
    order = [r["uid"] for r in timing.timeline(mails, found).where("scope = 's'").orderBy(*timing.timeline_order()).collect()]
    assert order[-1] == 4
    stats = {r["scope"]: r.asDict() for r in timing.stats(mails, found).collect()}
    assert (stats["s"]["emails"], stats["s"]["emails_with_received"], stats["s"]["hops_total"], stats["s"]["hops_with_issues"], stats["t"]["findings_total"]) == (6, 4, 10, 1, 0)
    kept = filters.filter_timeline(timing.timeline(mails, found), at(10), at(10), "client_clock_skew").collect()
    assert [(r["uid"], r["finding_ids"]) for r in kept] == [(1, ["F0003"])]
    for bad in ({"x": 1}, {"clock_skew_seconds": True}, {"clock_skew_seconds": -1}, {"max_transit_seconds": 604_801}):
        with pytest.raises(ValueError, match="threshold|integer"):
            timing.thresholds(bad)
    for args in (("2024-01-01T00:00:00", None), (None, "x"), (at(9), at(8))):
        with pytest.raises(filters.BadParameter):
            filters.filter_timeline(timing.timeline(mails, found), *args)


def test_chain_differences_by_position(spark):
    rows = [("s", 0, "<a>", "x", None, None, [hop(0, at(3)), hop(1, at(2))]), ("s", 1, "<a>", "y", None, None, [hop(0, at(3), host="g"), hop(1, at(1))]), ("s", 2, "<b>", "x", None, None, [hop(0, at(1))]), ("s", 3, "<b>", "z", None, None, [hop(0, at(1))])]
    found = timing.findings(spark.createDataFrame(rows, TIMED)).collect()
    assert [(r["type"], r["detail"]) for r in found] == [("chain_mismatch", "0:from_host; 1:time")]


A = "struct<name:string,address:string>"
RCP = f"scope string, uid long, message_id string, raw_sha256 string, in_reply_to string, refs array<string>, date string, parent_uid long, thread_root_uid long, `from` {A}, `to` array<{A}>, cc array<{A}>"


def people(*addresses):
    return [("", a) for a in addresses]


def test_recipient_flow(spark):
    rows = [
        ("s", 0, "<0>", "h0", None, [], "1", None, 0, ("A", "a@X.com"), people("b@x.com", "B@x.com", "c@x.com"), people("d@x.com")),
        ("s", 1, "<1>", "h1", "<0>", [], "2", 0, 0, ("", "b@x.com"), people("a@x.com", "d@x.com"), people("e@x.com", "e@X.COM")),
        ("s", 2, "<2>", "h2", "<gone>", ["<0>"], "3", 0, 0, ("", "b@x.com"), people("a@x.com"), None),
        ("s", 3, "<3>", "h3", "<1>", [], "4", 1, 0, ("", "owner@x.com"), people("bad address"), []),
        ("s", 4, "<1>", "other", "<0>", [], "5", None, 4, ("", "z@x.com"), [], []),
        ("s", 5, "<5>", "h5", "<1>", [], "6", 1, 0, None, people("a@x.com"), []),
    ]
    mails = spark.createDataFrame(rows, RCP)
    p = recipients.prepare(mails)
    e = recipients.edges(p)
    events = [(r["uid"], r["type"], r["address"], r["from_role"], r["to_role"], r["fields"]) for r in recipients.events(e).orderBy("seq").collect()]
    assert events == [
        (1, "added", "e@x.com", None, None, ["Cc"]), (1, "role_changed", "d@x.com", "cc", "to", ["To", "Cc"]), (1, "dropped", "B@x.com", None, None, ["To"]), (1, "dropped", "c@x.com", None, None, ["To"]),
        (1, "reply_all_omitted", "B@x.com", None, None, ["From", "To", "Cc"]), (1, "reply_all_omitted", "c@x.com", None, None, ["From", "To", "Cc"]),
    ]
    reviews = [(r["uid"], r["kind"], r["cause"], r["candidate_uids"]) for r in recipients.reviews(p, e).orderBy("seq").collect()]
    assert reviews == [
        (2, "missing_parent", "missing_parent", []), (3, "malformed_address", "white_space", []), (3, "possible_mailing_list", "own_mail", []), (3, "reference_conflict", "parent_id", [1, 4]),
        (4, "reference_conflict", "own_id", [1, 4]), (5, "reference_conflict", "parent_id", [1, 4]),
    ]
    sides = recipients.provisional_differences(recipients.reviews(p, e), p).where("uid = 5").orderBy("candidate_uid").collect()
    assert [(r["candidate_uid"], r["dropped"]) for r in sides] == [(1, ["d@x.com", "e@x.com"]), (4, [])]
    evidence = {(r["uid"], r["cause"], r["candidate_uid"]): r for r in recipients.conflict_evidence(p).collect()}
    assert sorted(evidence, key=str) == [(2, "missing_parent", None), (3, "parent_id", 1), (3, "parent_id", 4), (4, "own_id", None), (5, "parent_id", 1), (5, "parent_id", 4)]
    assert (evidence[5, "parent_id", 1]["differences"]["dropped"], evidence[5, "parent_id", 4]["differences"]["added"], evidence[4, "own_id", None]["differences"]) == (["d@x.com", "e@x.com"], ["a@x.com"], None)
    assert (evidence[5, "parent_id", 1]["child"]["to"], evidence[5, "parent_id", 1]["candidate"]["cc"], evidence[2, "missing_parent", None]["child"]["from"]) == (["a@x.com"], ["e@x.com"], ["b@x.com"])
    assert sorted((r["message_id"], r["variant_count"], r["uid"]) for r in recipients.conflict_variants(p).collect()) == [("<1>", 2, 1), ("<1>", 2, 4)]
    ledger = {r["address"]: r for r in recipients.ledger(p).collect()}
    assert (ledger["e@x.com"]["occurrence_count"], ledger["a@X.com".lower()]["first_uid"], ledger["b@x.com"]["fields"], ledger["a@x.com"]["names"]) == (1, 0, ["From", "To"], ["A"])
    emails = recipients.email_rows(p, e, recipients.events(e), recipients.reviews(p, e))
    by = {r["uid"]: r for r in emails.collect()}
    assert [by[i]["skip_reason"] for i in range(6)] == ["thread_root", None, "missing_parent", "reference_conflict", "reference_conflict", "reference_conflict"]
    assert by[1]["compared"]
    stats = recipients.stats(emails, e, recipients.events(e), recipients.reviews(p, e), recipients.ledger(p)).first()
    assert (stats["edges_total"], stats["edges_compared"], stats["events_total"], stats["reviews_total"], stats["malformed_addresses"]) == (4, 1, 6, 6, 1)
    about = filters.filter_recipient_reviews(recipients.reviews(p, e), p, address="z@x.com").orderBy("seq").collect()
    assert [r["uid"] for r in about] == [3, 4, 5]


F_ITEM = "struct<filename:string,content_type:string,size:bigint,sha256:string,original_filename:string,undecodable:boolean>"
ATT = f"scope string, uid long, message_id string, raw_sha256 string, in_reply_to string, refs array<string>, date string, parent_uid long, thread_root_uid long, attachments array<{F_ITEM}>, issues array<string>"


def greedy(parent, child):
    """Counts of events by pairing sorted units one after the other."""
    p, c = list(parent), list(child)
    for x in list(p):
        if x in c:
            p.remove(x)
            c.remove(x)
    out = {}

    def pair(by, other, kind):
        for key in sorted({x[by] for x in p} & {x[by] for x in c}):
            left, right = sorted(x[other] for x in p if x[by] == key), sorted(x[other] for x in c if x[by] == key)
            for a, b in zip(left, right, strict=False):
                x, y = ((a, key), (b, key)) if by else ((key, a), (key, b))
                p.remove(x)
                c.remove(y)
                name = (kind, *(x + y))
                out[name] = out.get(name, 0) + 1

    pair(1, 0, "renamed")
    pair(0, 1, "content_changed")
    for kind, rest in (("removed", p), ("added", c)):
        for x in rest:
            out[kind, *x] = out.get((kind, *x), 0) + 1
    return out


def test_multisets_pair_as_units(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(60):
        sets = [[(f"n{rng.randrange(3)}", f"s{rng.randrange(3)}") for _ in range(rng.randrange(7))] for _ in range(2)]
        want[f"g{g}"] = greedy(*sets)
        for uid, items in enumerate(sets):
            rows.append((f"g{g}", uid, f"<{uid}>", f"h{uid}", "<0>" if uid else None, [], None, 0 if uid else None, 0, [(n, None, 1, s, None, None) for n, s in items], []))
    diff = attachments.differences(attachments.prepare(spark.createDataFrame(rows, ATT)))
    got = {}
    for r in diff.collect():
        kind = r["type"]
        key = {"renamed": ("renamed", r["previous_filename"], r["sha256"], r["filename"], r["sha256"]), "content_changed": ("content_changed", r["filename"], r["previous_sha256"], r["filename"], r["sha256"])}.get(kind, (kind, r["filename"], r["sha256"]))
        got.setdefault(r["scope"], {})[key] = r["count"]
    assert got == {k: v for k, v in want.items() if v}


def test_ten_thousand_attachments_on_one_edge(spark):
    n = 10_000
    item = lambda i, sha: (f"f{i}", "x/y", i, f"s{sha}", None, None)
    parent = [item(i, i) for i in range(n)]
    child = [item(i, i) for i in range(n // 2)] + [(f"new{i}", "x/y", i, f"s{i}", None, None) for i in range(n // 2, n - 100)] + [item(i, -i) for i in range(n - 100, n)]
    rows = [("s", 0, "<a>", "h0", None, [], None, None, 0, parent, []), ("s", 1, "<b>", "h1", "<a>", [], None, 0, 0, child, [])]
    began = time.perf_counter()
    diff = attachments.differences(attachments.prepare(spark.createDataFrame(rows, ATT)))
    got = {r["type"]: (r["n"], r["same"]) for r in diff.groupBy("type").agg(F.sum("count").alias("n"), F.max("matched_unchanged").alias("same")).collect()}
    assert got == {"renamed": (n // 2 - 100, n // 2), "content_changed": (100, n // 2)}
    assert time.perf_counter() - began < 30


def test_attachment_flow(spark):
    rows = [
        ("s", 0, "<0>", "h0", None, [], "1", None, 0, [("a(1).txt", "t", 1, "x", "a.txt", None), ("b", "t", 2, "y", None, None), ("c", "t", 3, "z", None, None)], []),
        ("s", 1, "<1>", "h1", "<0>", [], "2", 0, 0, [("new", "t", 1, "x", "", None), ("b", "t", 9, "w", None, None), ("q", "t", 0, "e", None, True)], []),
        ("s", 2, "<2>", "h2", "<1>", [], "3", 1, 0, [("d", "t", 4, "v", None, None)], ["附件 'd' 内容无法解码，大小按 0 记录"]),
        ("s", 3, "<3>", "h3", None, ["<9>"], "4", None, 3, None, None),
    ]
    p = attachments.prepare(spark.createDataFrame(rows, ATT))
    diff = attachments.differences(p)
    events = [(r["id"], r["uid"], r["type"], r["filename"], r["previous_filename"], r["previous_sha256"]) for r in attachments.events(diff).orderBy("seq").collect()]
    assert events == [("E0001", 1, "renamed", "new", "a.txt", None), ("E0002", 1, "content_changed", "b", None, "y")]
    assert sorted((r["uid"], r["type"], r["filename"]) for r in attachments.suppressed(diff).collect()) == [(1, "removed", "c"), (2, "removed", "b"), (2, "removed", "new")]
    assert [(r["uid"], r["kind"], r["cause"]) for r in attachments.reviews(p).orderBy("seq").collect()] == [(1, "undecodable_attachment", "marked"), (2, "undecodable_attachment", "legacy"), (3, "missing_parent", "missing_parent")]
    ledger = {r["sha256"]: r for r in attachments.ledger(p).collect()}
    assert (ledger["x"]["names"], ledger["x"]["first_uid"], ledger["x"]["first_filename"], ledger["x"]["occurrence_count"]) == (["a.txt", "new"], 0, "a.txt", 2)
    rows = {r["uid"]: r for r in attachments.email_rows(p, attachments.events(diff), attachments.reviews(p), diff).collect()}
    assert (rows[2]["verifiable_count"], rows[2]["undecodable_count"], rows[1]["suppressed"], rows[3]["attachment_count"]) == (0, 1, 1, 0)
    assert filters.filter_attachment_events(attachments.events(diff), filename="a.txt").count() == 1
    with pytest.raises(filters.BadParameter):
        filters.filter_attachment_events(attachments.events(diff), sha256="zz")


def ident(address=None, name="", sender=None, path=(), mid=None, dkim=(), several=False):
    def entry(i, a):
        d = a.rpartition("@")[2].lower() if a and "." in a else None
        both = [(name, a, d), ("", "x@y.z", "y.z")] if several else [(name, a, d)]
        return (i, a, len(both), both, a, name, d, [])

    return (
        [entry(0, address)] if address else [], [entry(0, sender)] if sender else [], [], [entry(i, a) for i, a in enumerate(path)], (mid is not None, [(0, mid, mid, None, mid.strip("<>").rpartition("@")[2], [])] if mid else []),
        [(i, None, True, "d.x", "s", None, None, None, list(h), "from" in h, []) for i, h in enumerate(dkim)], [("malformed_value", "sender", 0, "odd", None)] * 2,
    )


def test_identity(spark):
    from heliograph.functions.headers import IDENTITY

    schema = f"scope string, uid long, message_id string, subject string, date string, parent_uid long, root_uid long, thread_pos long, identity {IDENTITY}"
    rows = [
        ("s", 0, "<0@a.x>", "hello", "1", None, 0, 0, ident("me@a.x", "Me", path=("me@a.x", "r@b.x"), mid="<0@a.x>", dkim=[("from",)])),
        ("s", 1, "<1@c.x>", "Re: Fwd: hello", "2", 0, 0, 1, ident("you@c.x", "Me", sender="list@d.x", mid="<1@e.x>", dkim=[("to",), ("from",)])),
        ("s", 2, "<2@a.x>", "Re: hello", "3", 1, 0, 2, ident("me@a.x", "Me", mid="<2@z.x>", dkim=[("to",)])),
        ("s", 3, None, None, "4", 2, 0, 3, ident()),
        ("s", 4, "<4@q.x>", "x", "5", 2, 0, 4, ident("new@q.x", "Me", mid="<4@q.x>", dkim=[()])),
    ]
    checked = identity.check_mails(identity.prepare(spark.createDataFrame(rows, schema)))
    by = {r["uid"]: r for r in checked.collect()}
    assert [by[i]["from_domain_mismatch_status"] for i in range(5)] == ["observed", "needs_review", "observed", "inconclusive", "observed"]
    assert by[0]["from_domain_mismatch_match"] is False
    assert [by[i]["dkim_from_not_covered_status"] for i in range(5)] == ["observed", "needs_review", "observed", "inconclusive", "needs_review"]
    assert by[1]["signals"] == ["possible_forward", "possible_mailing_list"]
    seen = {r["uid"]: sorted(r["seen_domains"]) for r in identity.ancestor_domains(checked).collect()}
    assert seen == {1: ["a.x"], 2: ["a.x", "c.x"], 3: ["a.x", "c.x"], 4: ["a.x", "c.x"]}
    found = identity.findings(checked)
    got = [(r["type"], r["level"], r["status"], r["node_uids"]) for r in found.orderBy("seq").collect()]
    assert got == [
        ("from_domain_mismatch", "email", "observed", [0]), ("from_domain_mismatch", "email", "needs_review", [1]), ("message_id_domain_drift", "email", "needs_review", [1]), ("dkim_from_not_covered", "email", "needs_review", [1]),
        ("message_id_domain_drift", "email", "observed", [2]), ("dkim_from_not_covered", "email", "observed", [2]), ("dkim_from_not_covered", "email", "needs_review", [4]),
        ("reply_identity_change", "thread", "needs_review", [1, 0]), ("reply_identity_change", "thread", "observed", [2, 1]), ("reply_identity_change", "thread", "observed", [4, 2]), ("message_id_domain_drift", "thread", "needs_review", [0, 2]),
    ]
    flags = [(r["uid"], r["kind"], r["detail"]) for r in identity.review_flags(checked).orderBy("seq").collect()]
    assert ("possible_forward", "Re: Fwd: hello") in [(k, d) for u, k, d in flags if u == 1]
    assert [k for u, k, _ in flags if u == 3] == ["header_parse_anomaly", "missing_header", "missing_header"]
    assert (3, "missing_header", "From,Message-ID,DKIM-Signature") in flags
    reports = identity.email_reports(checked)
    assert [r["uid"] for r in filters.filter_identity_emails(reports, "from_domain_mismatch", "observed").collect()] == [0]
    assert [r["uid"] for r in filters.filter_identity_emails(reports, domain="b.x").collect()] == [0]
    assert filters.filter_identity_findings(found, domain="x").count() == found.count()
    threads = identity.thread_reports(checked, found).first()
    assert (threads["email_count"], threads["finding_ids"]) == (5, ["F0008", "F0009", "F0010", "F0011"])
    stats = identity.stats(checked, found, identity.review_flags(checked)).first()
    assert (stats["findings_total"], stats["inconclusive_dkim_from_not_covered"], stats["thread_count"]) == (11, 1, 1)
    with pytest.raises(filters.BadParameter):
        filters.filter_identity_findings(found, "nope")


def test_threads_are_followed_only_where_their_order_does_not_tell(spark, monkeypatch):
    """Chains and flags need no ancestors at all (F25); in random trees the domains seen are those found by walking up."""
    from heliograph.functions.headers import IDENTITY

    schema = f"scope string, uid long, message_id string, subject string, date string, parent_uid long, root_uid long, thread_pos long, identity {IDENTITY}"

    def checked(parents, domains):
        children = {}
        for i, p in enumerate(parents):
            children.setdefault(p, []).append(i)
        places, todo = {}, [0]
        while todo:
            i = todo.pop()
            places[i] = len(places)
            todo += children.get(i, [])[::-1]
        rows = [("s", i, f"<{i}@m.x>", "x", "1", parents[i], 0, places[i], ident(f"p@{d}.x" if d else None, "", mid=f"<{i}@m.x>")) for i, d in enumerate(domains)]
        return identity.check_mails(identity.prepare(spark.createDataFrame(rows, schema)))

    def walked(parents, domains):
        out = {}
        for i, p in enumerate(parents):
            if p is not None and domains[i] and domains[p] and domains[i] != domains[p]:
                above = set()
                while p is not None:
                    above.add(domains[p])
                    p = parents[p]
                out[i] = domains[i] in above
        return out

    seen = lambda c: {r["uid"]: r["seen_before"] for r in identity.reply_changes(c).collect()}
    rng = random.Random(25)
    for reach in (2, 5, 40):
        parents = [None] + [rng.randrange(max(0, i - reach), i) for i in range(1, 40)]
        domains = [rng.choice(["a", "b", "c", "d", None]) for _ in parents]
        assert seen(checked(parents, domains)) == walked(parents, domains)
    # the first c is on another branch
    assert seen(checked([None, 0, 1, 1, 3], ["a", "b", "c", "a", "c"])) == {1: False, 2: False, 3: True, 4: False}

    def never(*_):
        raise AssertionError("followed upwards")

    monkeypatch.setattr(identity, "ancestor_domains", never)
    chain, domains = [None, *range(11)], list("abacbcadabbc")
    rows = checked(chain, domains)
    assert seen(rows) == walked(chain, domains)
    assert identity.review_flags(rows).where("kind = 'missing_header'").count() == 12  # no signatures
    assert identity.findings(identity.finding_columns(rows)).drop("seq", "id").exceptAll(identity.findings(rows).drop("seq", "id")).count() == 0


def test_list_hints(spark):
    from heliograph.functions.headers import IDENTITY

    df = spark.createDataFrame([(ident("a@b.c", several=True, sender="x@y.z"),)], f"identity {IDENTITY}")
    assert df.select(recipients.list_hints(F.col("identity"), None)).first()[0] == ["from_has_several_addresses", "sender_differs_from_from"]


@pytest.mark.parametrize("value", ["", "  ", "a b.example", "x\u3000y", "a" * 254])
def test_domains_that_are_none_are_refused(value):
    with pytest.raises(filters.BadParameter):
        filters.domain_name(value)


def test_domains_are_trimmed_and_small():
    assert (filters.domain_name(" Mail.Example\n"), filters.domain_name(None), len(filters.domain_name("a" * 253))) == ("mail.example", None, 253)


def test_pairs_of_a_conflicting_id_are_dealt_to_tasks(spark, monkeypatch):
    rows = [("s", i, "<twin>", f"r{i}", None, None, i, ("", f"a{i}@x.com")) for i in range(60)]
    rows += [("s", i, f"<{i}>", f"r{i}", "<twin>", i % 60, i % 60, ("", "b@x.com")) for i in range(60, 100)]
    mails = spark.createDataFrame([(*r[:4], r[4], [], "2024", *r[5:], [], []) for r in rows], "scope string, uid long, message_id string, raw_sha256 string, in_reply_to string, refs array<string>, date string, parent_uid long, thread_root_uid long, `from` struct<name:string,address:string>, to array<struct<name:string,address:string>>, cc array<struct<name:string,address:string>>")
    monkeypatch.setattr(recipients, "SLICE_MAILS", 8)
    monkeypatch.setattr(recipients, "TASK_PAIRS", 100)
    found = recipients.conflict_evidence(recipients.prepare(mails)).where("cause = 'parent_id'").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["uid"], r["candidate_uid"]) for r in found) == [(a, b) for a in range(60, 100) for b in range(60)]
    assert all(r["differences"]["added"] == ["b@x.com"] and r["differences"]["reply_all_omitted"] == [f"a{r['candidate_uid']}@x.com"] for r in found)
    assert len({r["task"] for r in found}) > 3


def test_attachments_of_many_edges_are_dealt_by_their_number(spark, monkeypatch):
    files = lambda i: [{"filename": f"f{j}", "content_type": "x/y", "size": 1, "sha256": f"h{i + j}", "original_filename": None, "undecodable": None} for j in range(5)]
    mails = spark.createDataFrame([("s", i, f"<{i}>", f"r{i}", f"<{i - 1}>" if i else None, i - 1 if i else None, files(i)) for i in range(200)], "scope string, uid long, message_id string, raw_sha256 string, in_reply_to string, parent_uid long, attachments array<struct<filename:string,content_type:string,size:long,sha256:string,original_filename:string,undecodable:boolean>>")
    mails = mails.selectExpr("*", "cast(array() as array<string>) refs", "'2024' date", "0L thread_root_uid", "cast(array() as array<string>) issues")
    monkeypatch.setattr(attachments, "TASK_UNITS", 100)
    diff = attachments.differences(attachments.prepare(mails)).withColumn("task", F.spark_partition_id()).collect()
    assert {r["uid"] for r in diff} == set(range(1, 200)) and len({r["task"] for r in diff}) > 10


def test_ledgers_and_reviews_compare_no_edges(spark, monkeypatch):
    """What lists mails' own addresses, contents or reviews must not pay for the differences along edges."""
    from heliograph.operators import attachments, recipients
    from heliograph.plans import forensics, views

    def refuse(*_, **__):
        raise AssertionError("an edge was looked at")

    monkeypatch.setattr(attachments, "differences", refuse)
    monkeypatch.setattr(recipients, "edges", refuse)
    sf_dir = "/root/testdata/sf0.001"
    assert forensics.att_reviews(spark, sf_dir).count() > 0
    monkeypatch.setattr(views, "gate_edges", refuse)
    assert forensics.att_ledger(spark, sf_dir).agg({"occurrence_count": "sum"}).first()[0] > 0
    assert forensics.rcp_ledger(spark, sf_dir).agg({"occurrence_count": "sum"}).first()[0] > 0


def test_edges_and_events_are_dealt_by_the_number_of_mails(spark, monkeypatch):
    rows = [("s", i, f"<{i}>", i - 1 if i else None, f"<{i - 1}>" if i else None, [], "0" * 63 + str(i % 10), 0, None, [("", f"a{i}@x.example")]) for i in range(12)]
    mails = spark.createDataFrame(rows, "scope string, uid long, message_id string, parent_uid long, in_reply_to string, refs array<string>, raw_sha256 string, thread_root_uid long, date string, to array<struct<name:string,address:string>>")
    mails = mails.withColumn("from", F.struct(F.lit("").alias("name"), F.lit("f@y.example").alias("address"))).withColumn("cc", F.array().cast("array<struct<name:string,address:string>>"))
    monkeypatch.setattr(recipients, "TASK_MAILS", 1)
    monkeypatch.setattr(recipients, "TASK_EVENTS", 2)
    edges = recipients.edges(recipients.prepare(mails))
    assert edges.count() == 11 and edges.where("edge_compared").count() == 11
    assert "hashpartitioning(parent_uid" in (plan := edges._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan
    events = recipients.events(edges)
    assert ", 17), REPARTITION_BY_NUM" in events._jdf.queryExecution().executedPlan().toString()
    assert [r["seq"] for r in events.orderBy("seq").collect()] == list(range(1, 34))


def test_pairs_of_a_conflicting_id_carry_what_was_made_once_a_mail(spark):
    """Sets get their form before the pairs are made, and a local part is made once for all signs of a list."""
    mails = spark.createDataFrame([("s", i, "<twin>" if i < 3 else f"<{i}>", f"r{i}", None if i < 3 else "<twin>", [], "2024", None if i < 3 else 0, 0, ("", f"a{i}@x.com"), people("List-x@y.com" if i == 4 else "b@x.com"), []) for i in range(5)], RCP)
    p = recipients.prepare(mails)
    assert {r["uid"]: r["hints"] for r in p.collect()}[4] == ["list_shaped_address"]
    assert p._jdf.queryExecution().optimizedPlan().toString().count("substring_index(lambda") < 4
    found = recipients.conflict_evidence(p, show=lambda c: F.array_join(c, ";"), kinds=("added",)).where("cause = 'parent_id'")
    assert sorted((r["uid"], r["candidate_uid"], r["child"]["to"], r["candidate"]["from"], r["differences"].asDict()) for r in found.collect()) == [
        (u, c, "b@x.com" if u == 3 else "List-x@y.com", f"a{c}@x.com", {"added": [f"a{u}@x.com"] if u == 3 else ["List-x@y.com", f"a{u}@x.com"]}) for u in (3, 4) for c in range(3)
    ]
    plan = found.select("child")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_join(")


def test_threads_are_counted_without_numbers(spark, monkeypatch):
    from heliograph.plans import forensics

    rows = [
        ("s", 0, "<0>", "h0", None, [], "1", None, 0, ("A", "a@X.com"), people("b@x.com", "c@x.com"), people("d@x.com")), ("s", 1, "<1>", "h1", "<0>", [], "2", 0, 0, ("", "b@x.com"), people("a@x.com", "d@x.com"), people("e@x.com")),
        ("s", 2, "<2>", "h2", "<gone>", [], "3", 0, 0, ("", "b@x.com"), people("a@x.com"), []), ("s", 3, "<3>", "h3", "<1>", [], "4", 1, 0, ("", "owner@x.com"), people("bad address"), []),
        ("s", 4, "<1>", "other", "<0>", [], "5", None, 4, ("", "z@x.com"), [], []), ("s", 5, "<5>", "h5", "<0>", [], "6", 0, 0, None, people("list-a@x.com"), []),
    ]
    p = recipients.prepare(spark.createDataFrame(rows, RCP))
    e = recipients.edges(p)
    long = recipients.thread_summaries(recipients.email_rows(p, e, recipients.events(e), recipients.reviews(p, e))).drop("node_uids")
    counts = [tuple(r) for r in recipients.thread_counts(p, e).orderBy("thread_root_uid").collect()]
    assert counts == [tuple(r) for r in long.orderBy("thread_root_uid").collect()] and counts[0][3] == 4

    def refuse(*_, **__):
        raise AssertionError("something was numbered")

    monkeypatch.setattr(recipients, "numbered", refuse)
    assert forensics.rcp_threads(spark, "/root/testdata/sf0.001").agg({"email_count": "sum"}).first()[0] == 1500


def test_chains_are_compared_only_of_ids_of_several_contents(spark, monkeypatch):
    rows = [("s", 0, "<a>", "x", at(0), None, [hop(0, at(3))]), ("s", 1, "<a>", "x", at(0), None, [hop(0, at(1), host="g")]), ("s", 2, "", "y", at(9), 0, [hop(0, at(1))])]
    mails = spark.createDataFrame(rows, TIMED)
    other = mails.unionByName(spark.createDataFrame([("s", 3, "<a>", "z", at(0), None, [hop(0, at(0), host="f")])], TIMED))
    found = timing.findings(other, prepared=timing.slim(other), contents=other.select("scope", "message_id", "raw_sha256"))
    assert [r["node_uids"] for r in found.where("type = 'chain_mismatch'").collect()] == [[0, 1, 3]]

    def refuse(*_, **__):
        raise AssertionError("chains were compared")

    monkeypatch.setattr(timing, "chain_mismatches", refuse)
    assert [r["type"] for r in timing.findings(mails).orderBy("seq").collect()] == ["client_clock_skew"] * 1 + ["client_clock_skew"]


def test_findings_of_other_types_do_not_meet_the_mails(spark, monkeypatch):
    from heliograph.plans import forensics

    met, timeline = [], timing.timeline
    monkeypatch.setattr(timing, "timeline", lambda mails, found, *a: met.append(found) or timeline(mails, found, *a))
    forensics.qry_timeline_range(spark, "/root/testdata/sf0.001")
    assert [r["type"] for r in met[0].select("type").distinct().collect()] == ["hop_time_inversion"]
