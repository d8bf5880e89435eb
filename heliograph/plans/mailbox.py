"""Packages of real mail bytes made from the documents, and the queries that read them back.

Every document becomes one mail: its headers and body are a SQL formula that
Spark and the oracle both run, so that the oracle can hash the very bytes.
Twenty mails make a package; of every 24 packages ten are hostile in one way
each.  The oracle never parses anything: it states what the headers, hops,
signatures and attachments must come out as.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.lineage import shared_dir
from heliograph.plans import views
from heliograph.plans.registry import register
from heliograph.sources import packages

_PER_PACKAGE = 20

_BODY = "coalesce(text, '')"
_FIRST_FILE = "'one ' || doc_id"

#: One line of a mail after the other; a null line is left out.
_LINES = f"""concat_ws(chr(10),
  'Return-Path: <bounce' || (doc_id % 3) || '@Relay.Example>',
  'Received: from a.example (odd; comment) by b' || (doc_id % 5) || '.example with ESMTP; Mon, 05 Feb 2024 10:00:' || (10 + doc_id % 50) || ' +0200 (CEST)',
  CASE doc_id % 4 WHEN 0 THEN 'Received: from [10.0.0.1] by a.example' WHEN 1 THEN 'Received: from c.example by a.example; Mon, 05 Feb 2024 09:00:00 XYZ'
    WHEN 2 THEN 'Received: from c.example by a.example; nonsense' ELSE 'Received: by a.example with SMTP; Mon, 05 Feb 2024 09:00:00 GMT' END,
  CASE WHEN doc_id % 9 = 0 THEN 'DKIM-Signature: v=1; a=rsa; d=one.example; d=two.example; s=k; h=To:Cc' ELSE 'DKIM-Signature: v=1; a=rsa; d=host' || (doc_id % 7) || '.example; s=k' || (doc_id % 2) || ';' || chr(10) || ' h=From:To; b=x' END,
  CASE WHEN doc_id % 31 = 1 THEN 'Message-ID: d' || doc_id || '@doc.example' WHEN doc_id % 31 <> 0 THEN 'Message-ID: <d' || doc_id || '@doc.example>' END,
  CASE WHEN doc_id % 6 <> 0 THEN 'In-Reply-To: <d' || (doc_id - doc_id % 8) || '@doc.example>' END,
  CASE WHEN doc_id % 3 <> 0 THEN 'References: <d0@doc.example> bare@token <d' || (doc_id - doc_id % 8) || '@doc.example>' || chr(10) || ' <d0@doc.example>' END,
  CASE WHEN doc_id % 37 <> 0 THEN 'From: "Person ' || (doc_id % 50) || '" <U' || (doc_id % 50) || '@Host' || (doc_id % 7) || '.Example>' END,
  CASE WHEN doc_id % 29 = 0 THEN 'Sender: a@x.example' || chr(10) || 'Sender: b@x.example' END,
  'To: bob@y.example, Bob <bob@y.example>, c' || (doc_id % 3) || '@z.example',
  CASE WHEN doc_id % 2 = 0 THEN 'Cc: d@z.example' END,
  CASE WHEN doc_id % 19 = 0 THEN 'Date: nonsense' ELSE 'Date: Mon, 05 Feb 2024 10:00:' || (10 + doc_id % 50) || ' +0200' END,
  'Subject: =?utf-8?B?' || B64(coalesce(lang, '') || ' é') || '?=',
  'MIME-Version: 1.0',
  CASE WHEN doc_id % 11 = 0 THEN 'Content-Type: text/html; charset=utf-8' || chr(10) || chr(10) || '<p>plain &amp; simple ' || doc_id || '</p>'
    WHEN doc_id % 7 = 0 THEN 'Content-Type: multipart/mixed; boundary=b9' || chr(10) || chr(10) || '--b9' || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || B64({_BODY})
      || chr(10) || '--b9' || chr(10) || 'Content-Type: x/y' || chr(10) || 'Content-Disposition: attachment; filename=f.txt' || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || B64({_FIRST_FILE})
      || chr(10) || '--b9' || chr(10) || 'Content-Type: x/z' || chr(10) || 'Content-Disposition: attachment; filename=f.txt' || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || B64('two')
      || CASE WHEN doc_id % 21 = 0 THEN chr(10) || '--b9' || chr(10) || 'Content-Type: x/w' || chr(10) || 'Content-Disposition: attachment; filename=q.bin' || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || '!!!a' ELSE '' END
      || chr(10) || '--b9--' || chr(10)
    ELSE 'Content-Type: text/plain; charset=' || CASE WHEN doc_id % 5 = 0 THEN 'us-ascii' ELSE 'utf-8' END || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || B64({_BODY}) END)"""

_PACKAGE = f"CAST((doc_id - doc_id % {_PER_PACKAGE}) / {_PER_PACKAGE} AS BIGINT)"

MAIL_BYTES = f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, {_PACKAGE} AS package_no, {_LINES} AS eml FROM documents"


def _b64(text: str, call: str) -> str:
    """The formula with ``B64(x)`` as base64 of the UTF-8 of x; brackets inside x are balanced."""
    out, at = [], 0
    while (start := text.find("B64(", at)) >= 0:
        end, depth = start + 4, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out += [text[at:start], call.format(text[start + 4 : end - 1])]
        at = end
    return "".join([*out, text[at:]])


def _archive(pdf: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Writes the package of one number, which says what is wrong with it.

    Its bytes depend on the mails alone and it gets its name when it is whole,
    so that a repeated task replaces it by the same file.
    """
    number = int(pdf["package_no"].iloc[0])
    rows = pdf.sort_values("doc_id")
    files = [[f"d{i}.eml", eml.encode(), 0o100644, zipfile.ZIP_STORED] for i, eml in zip(rows["doc_id"], rows["eml"], strict=True)]
    case = number % 24
    if case == 1:
        files[-1][0] = "a/../../b.eml"
    elif case == 2:
        files.append([files[0][0].upper(), b"x", 0o100644, zipfile.ZIP_STORED])
    elif case == 3:
        files[0][2] = 0o120777
    elif case == 4:
        files.append(["folder/", b"", 0o40755, zipfile.ZIP_STORED])
    elif case == 5:
        files.append(["zeros.eml", bytes(400_000), 0o100644, zipfile.ZIP_DEFLATED])
    elif case == 7:
        files[0][0] = "Con.eml"
    elif case == 8:
        files[-1][0] = "a\\b.eml"
    elif case > 10 and case % 2:
        files.insert(0, ["note.txt", b"no mail", 0o100644, zipfile.ZIP_STORED])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content, mode, how in files:
            info = zipfile.ZipInfo(name)
            info.external_attr, info.compress_type = mode << 16, how
            archive.writestr(info, content)
        if case == 9:
            archive.filelist[0].flag_bits |= 1
        if case == 10:
            archive.filelist[-1].file_size -= 1
    content = b"no archive" if case == 6 else out.getvalue()
    store, path = packages.store_of(f"{folder}/p{number}.zip")
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as file:
        file.write(content)
    store.move(part, path)
    return pd.DataFrame({"bytes": [len(content)]})


def mail_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package, length) of all packages, written as files of the shared folder; a package has at most twenty documents, however many there are."""
    mails = views.run(spark, sf_dir, _b64(MAIL_BYTES, "replace(base64(encode({}, 'UTF-8')), chr(13) || chr(10), '')"))
    folder = f"{shared_dir(spark)}/mail-packages-{uuid.uuid4().hex}"
    store, path = packages.store_of(folder)
    store.create_dir(path)
    mails.select("doc_id", "package_no", "eml").groupBy("package_no").applyInPandas(lambda pdf: _archive(pdf, folder), "bytes long").agg(F.sum("bytes")).collect()
    return packages.load(spark, folder)


def _short(df: DataFrame) -> DataFrame:
    """Packages by number instead of path."""
    return df.withColumn("package", F.regexp_extract("package", r"([^/]+)\.zip$", 1))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(packages.read_mails(mail_packages(spark, sf_dir)))


_ALL = f"""m AS MATERIALIZED (SELECT *, package_no % 24 AS how, 'p' || package_no AS package, row_number() OVER (PARTITION BY package_no ORDER BY doc_id) - 1 AS uid, count(*) OVER (PARTITION BY package_no) AS n
  FROM ({_b64(MAIL_BYTES, "base64(encode({}))")}) x),
sound AS (SELECT * FROM m WHERE how = 0 OR how > 10)"""


def _joined(items: str) -> Column:
    return F.concat_ws("|", items)


@register(
    "src_violations",
    f"""WITH {_ALL} SELECT DISTINCT package, (CASE WHEN how IN (3, 7, 9) THEN 0 WHEN how = 6 THEN -1 WHEN how IN (2, 4, 5) THEN n ELSE n - 1 END)::BIGINT AS entry_idx,
  CASE WHEN how IN (1, 7, 8) THEN 'unsafe_name' WHEN how = 2 THEN 'duplicate_name' WHEN how = 3 THEN 'not_a_regular_file' WHEN how = 4 THEN 'directory' WHEN how = 5 THEN 'compression_ratio' WHEN how = 6 THEN 'not_a_zip' ELSE 'encrypted' END AS reason
FROM m WHERE how BETWEEN 1 AND 9""",
)
def src_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _short(packages.violations(packages.scan(mail_packages(spark, sf_dir))))
    return found.select("package", F.col("entry_idx").cast("long").alias("entry_idx"), "reason")


@register("src_skipped", f"WITH {_ALL} SELECT DISTINCT package, 'note.txt' AS name, 'not_eml' AS reason FROM m WHERE how > 10 AND how % 2 = 1 UNION ALL SELECT DISTINCT package, 'folder/', 'not_eml' FROM m WHERE how = 4")
def src_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(packages.skipped(packages.scan(mail_packages(spark, sf_dir))))


@register(
    "src_mails",
    f"""WITH {_ALL} SELECT package, uid::BIGINT AS uid, 'd' || doc_id || '.eml' AS source_file, sha256(eml) AS raw_sha256,
  CASE WHEN doc_id % 31 = 1 THEN 'd' || doc_id || '@doc.example' WHEN doc_id % 31 <> 0 THEN '<d' || doc_id || '@doc.example>' END AS message_id,
  CASE WHEN doc_id % 6 <> 0 THEN '<d' || (doc_id - doc_id % 8) || '@doc.example>' END AS in_reply_to,
  CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id < 8 THEN '<d0@doc.example>' ELSE '<d0@doc.example>|<d' || (doc_id - doc_id % 8) || '@doc.example>' END AS refs,
  CASE WHEN doc_id % 19 <> 0 THEN '2024-02-05T10:00:' || (10 + doc_id % 50) || '+02:00' END AS date,
  CASE WHEN doc_id % 37 <> 0 THEN 'Person ' || (doc_id % 50) END AS from_name, CASE WHEN doc_id % 37 <> 0 THEN 'U' || (doc_id % 50) || '@Host' || (doc_id % 7) || '.Example' END AS from_address,
  'bob@y.example|c' || (doc_id % 3) || '@z.example' AS to_addresses, CASE WHEN doc_id % 2 = 0 THEN 'd@z.example' ELSE '' END AS cc_addresses, coalesce(lang, '') || ' é' AS subject,
  sha256(CASE WHEN doc_id % 11 = 0 THEN 'plain & simple ' || doc_id ELSE regexp_replace({_BODY}, '^\\s+|\\s+$', '', 'g') END) AS body_sha256, doc_id % 11 = 0 AS body_is_html,
  concat_ws('|', CASE WHEN doc_id % 31 = 1 THEN 'loose_id' END, CASE WHEN doc_id % 3 <> 0 THEN 'loose_id' END, CASE WHEN doc_id % 19 = 0 THEN 'bad_date' END,
    CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0 AND regexp_matches({_BODY}, '[^\\x00-\\x7F]') THEN 'undecodable' END, CASE WHEN doc_id % 21 = 0 AND doc_id % 11 <> 0 THEN 'undecodable' END) AS issue_classes
FROM sound""",
)
def src_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what the standard library notes about an attachment's own coding follows its class "undecodable"
    classes = F.filter(F.transform("issues", lambda x: F.substring_index(x, ":", 1)), lambda x: x != "attachments")
    return mails(spark, sf_dir).select(
        "package", F.col("uid").cast("long").alias("uid"), "source_file", "raw_sha256", "message_id", "in_reply_to", _joined("refs").alias("refs"), "date", F.col("from.name").alias("from_name"), F.col("from.address").alias("from_address"),
        _joined("to.address").alias("to_addresses"), _joined("cc.address").alias("cc_addresses"), "subject", F.sha2("body_text", 256).alias("body_sha256"), "body_is_html", F.concat_ws("|", classes).alias("issue_classes"),
    )


@register(
    "prs_received",
    f"""WITH {_ALL} SELECT package, uid::BIGINT AS uid, 0::BIGINT AS hop, 'a.example' AS from_host, 'b' || (doc_id % 5) || '.example' AS by_host, '2024-02-05T08:00:' || (10 + doc_id % 50) || '+00:00' AS time_utc, '2024-02-05T10:00:' || (10 + doc_id % 50) || '+02:00' AS time_original, '+0200' AS timezone, '' AS issues FROM sound
UNION ALL SELECT package, uid::BIGINT, 1::BIGINT, CASE doc_id % 4 WHEN 0 THEN '[10.0.0.1]' WHEN 3 THEN NULL ELSE 'c.example' END, 'a.example', CASE WHEN doc_id % 4 = 3 THEN '2024-02-05T09:00:00+00:00' END,
  CASE doc_id % 4 WHEN 1 THEN '2024-02-05T09:00:00' WHEN 3 THEN '2024-02-05T09:00:00+00:00' END, CASE doc_id % 4 WHEN 1 THEN 'XYZ' WHEN 3 THEN 'GMT' END,
  CASE doc_id % 4 WHEN 0 THEN 'no_time: no semicolon' WHEN 1 THEN 'unknown_zone: XYZ' WHEN 2 THEN 'bad_time: nonsense' ELSE 'no_from_host' END FROM sound""",
)
def prs_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = mails(spark, sf_dir).select("package", "uid", F.explode("received").alias("h"))
    return hops.select("package", F.col("uid").cast("long").alias("uid"), F.col("h.index").cast("long").alias("hop"), "h.from_host", "h.by_host", "h.time_utc", "h.time_original", "h.timezone", _joined("h.issues").alias("issues"))


@register(
    "prs_attachments",
    f"""WITH {_ALL}, f AS (SELECT * FROM sound WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0)
SELECT package, uid::BIGINT AS uid, 0::BIGINT AS pos, 'f.txt' AS filename, NULL AS original_filename, 'x/y' AS content_type, length({_FIRST_FILE})::BIGINT AS size, sha256({_FIRST_FILE}) AS sha256, false AS undecodable FROM f
UNION ALL SELECT package, uid::BIGINT, 1::BIGINT, 'f(1).txt', 'f.txt', 'x/z', 3::BIGINT, sha256('two'), false FROM f
UNION ALL SELECT package, uid::BIGINT, 2::BIGINT, 'q.bin', NULL, 'x/w', NULL, NULL, true FROM f WHERE doc_id % 21 = 0""",
)
def prs_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mails(spark, sf_dir).select("package", "uid", F.posexplode("attachments").alias("pos", "f"))
    lost = F.coalesce("f.undecodable", F.lit(False))
    # what is left of lost content is the decoder's affair
    return files.select(
        "package", F.col("uid").cast("long").alias("uid"), F.col("pos").cast("long").alias("pos"), "f.filename", "f.original_filename", "f.content_type",
        F.when(~lost, F.col("f.size")).alias("size"), F.when(~lost, F.col("f.sha256")).alias("sha256"), lost.alias("undecodable"),
    )


@register(
    "prs_identity",
    f"""WITH {_ALL} SELECT package, uid::BIGINT AS uid, CASE WHEN doc_id % 37 <> 0 THEN 'host' || (doc_id % 7) || '.example' END AS from_domain, CASE WHEN doc_id % 29 = 0 THEN 2 ELSE 0 END::BIGINT AS n_sender, 'relay.example' AS return_domain,
  CASE WHEN doc_id % 31 <> 0 THEN 'doc.example' END AS id_domain, CASE WHEN doc_id % 31 <> 0 THEN 'd' || doc_id END AS id_local, CASE WHEN doc_id % 9 = 0 THEN 'one.example' ELSE 'host' || (doc_id % 7) || '.example' END AS dkim_d,
  CASE WHEN doc_id % 9 = 0 THEN 'k' ELSE 'k' || (doc_id % 2) END AS dkim_s, doc_id % 9 <> 0 AS covers_from, CASE WHEN doc_id % 9 = 0 THEN 'repeated_tag: d|no_b' ELSE '' END AS dkim_anomalies,
  concat_ws('|', CASE WHEN doc_id % 29 = 0 THEN 'duplicate_header sender' END, CASE WHEN doc_id % 31 = 1 THEN 'malformed_value message-id' END, CASE WHEN doc_id % 9 = 0 THEN 'dkim_tag_error dkim-signature|dkim_tag_error dkim-signature' END) AS anomalies
FROM sound""",
)
def prs_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda items: F.try_element_at(items, F.lit(1))
    m = mails(spark, sf_dir).withColumn("f", first(F.col("identity.from"))).withColumn("r", first(F.col("identity.return_path"))).withColumn("i", first(F.col("identity.message_id.headers"))).withColumn("k", first(F.col("identity.dkim")))
    return m.select(
        "package", F.col("uid").cast("long").alias("uid"), F.col("f.domain").alias("from_domain"), F.size("identity.sender").cast("long").alias("n_sender"), F.col("r.domain").alias("return_domain"), F.col("i.domain").alias("id_domain"), F.col("i.local_part").alias("id_local"),
        F.col("k.d").alias("dkim_d"), F.col("k.s").alias("dkim_s"), F.col("k.covers_from").alias("covers_from"), _joined("k.anomalies").alias("dkim_anomalies"), F.concat_ws("|", F.transform("identity.anomalies", lambda a: F.concat_ws(" ", a["kind"], a["header"]))).alias("anomalies"),
    )
