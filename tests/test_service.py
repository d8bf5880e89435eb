"""From uploaded packages to filtered results, end to end."""

import json

import pytest
from pyspark.sql import functions as F
from test_sources import eml, package

from heliograph import service
from heliograph.operators import filters


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    w = service.Workspace(spark, str(tmp_path_factory.mktemp("work")))
    first = eml("<1@x.org>")
    reply = eml("<2@x.org>", In_Reply_To="<1@x.org>", References="<1@x.org>", Cc="late@z.org", Received="from a by b; Mon, 02 Sep 2024 12:00:00 +0200")
    reply.add_attachment(b"one", maintype="a", subtype="b", filename="f.txt")
    answer = eml("<3@x.org>", In_Reply_To="<2@x.org>")
    answer.add_attachment(b"one", maintype="a", subtype="b", filename="g.txt")
    a = w.submit(package([("1.eml", first.as_bytes()), ("2.eml", reply.as_bytes()), ("note.txt", b"n")]), "dir\\a.zip", "key-a")
    b = w.submit(package([("3.eml", answer.as_bytes()), ("1.eml", first.as_bytes())]), "b.zip")
    bad = w.submit(package([("../x.eml", b"x")]))
    assert w.work() == 3
    case = w.create_case([a, b])
    w.work()
    runs = {kind: w.analyse(kind, "case", case) for kind in service.ANALYSES}
    assert w.work() == 4
    return w, a, b, bad, case, runs


def test_jobs(done):
    w, a, b, bad, _, _ = done
    assert w.submit(package([("1.eml", eml("<1@x.org>").as_bytes())]), "a.zip", "other") != a
    assert w.status("job", a)["state"] == "completed"
    assert w.status("job", bad)["error"] == "unsafe_name"
    stats = w.result("job", a, "stats").first()
    assert (stats["zip_entries"], stats["eml_parsed"], stats["non_eml_skipped"], stats["thread_count"], stats["attachment_count"]) == (3, 2, 1, 1, 1)
    assert w.result("job", b, "stats").first()["missing_parent"] == 1
    tree = json.loads(w.tree_json("job", a))
    assert tree[0]["children"][0]["message_id"] == "<2@x.org>"
    assert "chosen_pos" not in tree[0]
    assert w.tree("job", a, compact=True).count() == 2
    with pytest.raises(service.Refused, match="target_failed"):
        w.result("job", bad, "forest")
    assert service.package_name("x/y\\z.zip") == "z.zip"


def test_phases_and_tasks(done):
    w, a, _, bad, case, runs = done
    phases = lambda key: [r["phase"] for r in w.catalog.history().where((F.col("key") == key) & F.col("phase").isNotNull()).orderBy("at").collect()]
    assert phases(a) == ["validating", "parsing", "threads", "writing"]
    assert (phases(bad), phases(case)) == (["validating"], ["merging", "threads", "writing"])
    assert phases(runs["analysis"]) == ["findings", "timeline", "stats"]
    seen = w.running(runs["analysis"])
    assert seen["jobs"] > 0 and seen["tasks_done"] <= seen["tasks"]
    assert w.running("nothing") == {"jobs": 0, "tasks": 0, "tasks_done": 0}


def test_cases(done):
    w, a, b, bad, case, _ = done
    stats = w.result("case", case, "stats").first()
    assert (stats["merged_nodes"], stats["source_emails"], stats["relinked_nodes"], stats["thread_count"]) == (3, 4, 1, 1)
    assert [r["relinked"] for r in w.tree("case", case, compact=True).orderBy("uid").collect()] == [False, False, True]
    for jobs, why in (([], "no_jobs"), ([a, a], "duplicate_jobs"), ([a, bad], "job_not_completed"), ([a, "nope"], "unknown_jobs")):
        with pytest.raises(service.Refused, match=why):
            w.create_case(jobs)


def test_analyses(done):
    w, a, _, _, _, runs = done
    assert w.result("analysis", runs["analysis"], "stats").first()["client_clock_skew"] == 1
    assert [r["uid"] for r in w.timeline(runs["analysis"], kind="client_clock_skew").collect()] == [1]
    assert w.identity_findings(runs["identity_check"]).count() == 0
    assert w.identity_flags(runs["identity_check"]).count() == 3
    assert w.identity_emails(runs["identity_check"], domain="x.org").count() == 3
    assert w.identity_threads(runs["identity_check"]).count() == 1
    events = [(r["type"], r["filename"]) for r in w.attachment_events(runs["attachment_flow"]).orderBy("seq").collect()]
    assert events == [("added", "f.txt"), ("renamed", "g.txt")]
    assert w.attachment_ledger(runs["attachment_flow"], filename="g.txt").first()["occurrence_count"] == 2
    assert w.attachment_reviews(runs["attachment_flow"]).count() == 0
    moved = [(r["type"], r["address"]) for r in w.recipient_events(runs["recipient_flow"], address="late@z.org").orderBy("seq").collect()]
    assert moved == [("added", "late@z.org"), ("dropped", "late@z.org"), ("reply_all_omitted", "late@z.org")]
    assert w.recipient_threads(runs["recipient_flow"], address="late@z.org").first()["matched_events"] == 3
    assert w.recipient_addresses(runs["recipient_flow"], "Late <late@Z.org>").count() == 1
    assert w.recipient_reviews(runs["recipient_flow"]).count() == 0
    with pytest.raises(service.Refused, match="target_deleted_or_unknown"):
        w.analyse("analysis", "job", "nope")
    with pytest.raises(filters.BadParameter):
        w.analyse("nothing", "job", a)


def test_restart_takes_up_unfinished_work(done):
    w, *_ = done
    key = w.submit(package([("9.eml", eml("<9@x.org>").as_bytes())]))
    w.catalog.set_state("job", key, "processing", target="upload.zip")
    again = service.Workspace(w.spark, w.folder)
    assert again.work() >= 1
    assert again.status("job", key)["state"] == "completed"
    again.delete_job(key)
    assert again.status("job", key) is None
    small = service.Workspace(w.spark, w.folder, max_upload=10)
    with pytest.raises(service.Refused, match="upload_too_large"):
        small.submit(b"x" * 11)
