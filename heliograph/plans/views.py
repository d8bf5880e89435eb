"""Mail-shaped relations derived from the driver's tables.

The tables hold no mail, so each is given a mail's shape by a fixed formula.
The formulas are SQL that Spark and the oracle both run (only two function
names differ); nested columns are then built in Spark alone, and the oracle
works on the flat relations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.addresses import domain_of
from heliograph.lineage import keep, tasks_for
from heliograph.operators.gate import gate_edges

_TABLES = ("conversations", "documents", "orders", "lineitem", "customer", "nation", "supplier", "pages", "events")
#: Lines of orders that a task sorts, about.
TASK_LINES = 250_000


def spark_sql(text: str) -> str:
    text = re.sub(r"\bISO\(([^()]*)\)", r"(date_format(\1, 'yyyy-MM-dd') || 'T' || date_format(\1, 'HH:mm:ss') || '+00:00')", text)
    # the argument of SHA may hold one level of brackets
    return re.sub(r"\bSHA\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", text)


def duck_sql(text: str) -> str:
    text = re.sub(r"\bISO\(([^()]*)\)", r"(strftime(\1, '%Y-%m-%dT%H:%M:%S') || '+00:00')", text)
    return re.sub(r"\bSHA\(((?:[^()]|\([^()]*\))*)\)", r"sha256(\1)", text)


def _line_tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks_for(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(), TASK_LINES)


def run(spark: SparkSession, sf_dir: str, text: str, line_tasks: int | None = None) -> DataFrame:
    """A shared formula over the tables that it names, without registering views; the lines of an order are dealt to ``line_tasks`` if given."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"\b{t}\b", text)}
    if line_tasks and "lineitem" in used:
        used["lineitem"] = used["lineitem"].repartition(line_tasks, "l_orderkey")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(spark_sql(text), **used)


# ---------------------------------------------------------------- conversations

THREAD_MAILS = """
SELECT scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY conv_id, turn) - 1 AS BIGINT) AS uid, conv_id, turn, last_turn, id, prev_id, text, role,
  CASE WHEN conv_id % 17 = 0 OR (conv_id + turn) % 23 <> 0 THEN id END AS message_id,
  CASE WHEN conv_id % 17 = 0 AND turn = 0 THEN last_id WHEN conv_id % 17 <> 0 AND (conv_id + turn) % 29 = 0 THEN id
    WHEN conv_id % 17 <> 0 AND (conv_id * 7 + turn) % 11 = 0 THEN '<gone' || conv_id || '.t' || turn || '@mail.example>' WHEN turn > 0 THEN prev_id END AS in_reply_to,
  '2024-01-' || (10 + (conv_id * 3 + turn * 5) % 18) || 'T00:00:00+00:00' AS date
FROM (SELECT conv_id, turn, role, text, 'p' || (conv_id % 8) AS scope, '<c' || conv_id || '.t' || turn || '@' || role || '.example>' AS id,
    '<c' || conv_id || '.t' || (turn - 1) || '@' || lag(role) OVER (PARTITION BY conv_id ORDER BY turn) || '.example>' AS prev_id,
    '<c' || conv_id || '.t' || max(turn) OVER (PARTITION BY conv_id) || '@' || last_value(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || '.example>' AS last_id,
    max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) x
"""

_ALL_TURNS = "SELECT conv_id AS c, turn AS t, '<c' || conv_id || '.t' || turn || '@' || role || '.example>' AS earlier FROM conversations"


def thread_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run(spark, sf_dir, THREAD_MAILS)
    before = run(spark, sf_dir, _ALL_TURNS)
    met = base.select("conv_id", "turn").join(before, (F.col("conv_id") == F.col("c")) & (F.col("t") < F.col("turn")))
    refs = met.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "earlier"))), lambda x: x["earlier"]).alias("refs"))
    out = base.join(refs, ["conv_id", "turn"], "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    return out.select(
        "scope", "uid", "message_id", "in_reply_to", "refs", "date", F.sha2("text", 256).alias("raw_sha256"), F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn", F.lit(".eml")).alias("source_file"), F.col("role").alias("subject"),
        F.struct(F.col("role").alias("name"), F.concat("role", F.lit("@chat.example")).alias("address")).alias("from"),
        F.array().cast("array<struct<filename:string,content_type:string,size:bigint,sha256:string,original_filename:string,undecodable:boolean>>").alias("attachments"), F.array().cast("array<string>").alias("issues"),
    )


#: Flat twin: candidates in order, parents, roots and depths of the same mails.
THREAD_ORACLE = f"""
RECURSIVE m AS MATERIALIZED ({THREAD_MAILS}), turns AS ({_ALL_TURNS}),
cand AS (SELECT scope, uid, 0 AS pos, in_reply_to AS ref FROM m WHERE in_reply_to IS NOT NULL
  UNION ALL SELECT m.scope, m.uid, m.turn - t AS pos, earlier AS ref FROM m JOIN turns ON c = conv_id AND t < turn WHERE in_reply_to IS NULL OR earlier <> in_reply_to),
kinds AS (SELECT c.scope, c.uid, c.pos, p.uid AS target, c.ref = m.message_id AS is_self FROM cand c JOIN m ON m.scope = c.scope AND m.uid = c.uid LEFT JOIN m p ON p.scope = c.scope AND p.message_id = c.ref),
chosen AS (SELECT scope, uid, min(pos) AS pos FROM kinds WHERE target IS NOT NULL AND NOT coalesce(is_self, false) GROUP BY 1, 2),
plain AS (SELECT m.scope, m.uid, k.target AS parent_uid, coalesce(x.missing, 0) AS missing_refs, coalesce(x.own, 0) AS self_refs, 0 AS cycle_refs
  FROM m LEFT JOIN chosen c ON c.scope = m.scope AND c.uid = m.uid LEFT JOIN kinds k ON k.scope = m.scope AND k.uid = m.uid AND k.pos = c.pos
  LEFT JOIN (SELECT k.scope, k.uid, count(*) FILTER (WHERE target IS NULL AND NOT coalesce(is_self, false)) AS missing, count(*) FILTER (WHERE is_self) AS own
    FROM kinds k LEFT JOIN chosen c ON c.scope = k.scope AND c.uid = k.uid WHERE c.pos IS NULL OR k.pos < c.pos GROUP BY 1, 2) x ON x.scope = m.scope AND x.uid = m.uid
  WHERE conv_id % 17 <> 0),
ring AS (SELECT m.scope, m.uid, p.uid AS parent_uid, 0 AS missing_refs, 0 AS self_refs, CASE WHEN m.turn = 1 THEN 1 ELSE 0 END AS cycle_refs
  FROM m LEFT JOIN m p ON p.conv_id = m.conv_id AND p.turn = CASE WHEN m.turn = 0 THEN m.last_turn WHEN m.turn > 1 THEN m.turn - 1 END WHERE m.conv_id % 17 = 0),
linked AS MATERIALIZED (SELECT * FROM plain UNION ALL SELECT * FROM ring),
tree(scope, uid, root_uid, depth) AS (SELECT scope, uid, uid, 0 FROM linked WHERE parent_uid IS NULL
  UNION ALL SELECT l.scope, l.uid, t.root_uid, t.depth + 1 FROM linked l JOIN tree t ON t.scope = l.scope AND t.uid = l.parent_uid),
forest AS MATERIALIZED (SELECT l.scope, l.uid, m.message_id, m.date, l.parent_uid, t.root_uid, t.depth::BIGINT AS depth, l.missing_refs::BIGINT AS missing_refs, l.self_refs::BIGINT AS self_refs, l.cycle_refs::BIGINT AS cycle_refs
  FROM linked l JOIN tree t ON t.scope = l.scope AND t.uid = l.uid JOIN m ON m.scope = l.scope AND m.uid = l.uid)
"""

# -------------------------------------------------------------------- documents

CASE_MAILS = """
SELECT 'case' || (doc_id % 4) AS case_id, CAST(CAST(substr(source, 4) AS INT) AS INT) AS job_pos, source AS job_id, CAST(doc_id AS BIGINT) AS uid, SHA(text) AS raw_sha256, 'd' || doc_id || '.eml' AS source_file,
  CASE WHEN doc_id % 31 <> 0 THEN '<d' || (doc_id % 700) || '@doc.example>' END AS message_id,
  CASE WHEN doc_id % 13 = 0 THEN '<gone' || (doc_id % 50) || '@doc.example>' WHEN doc_id % 700 >= 8 THEN '<d' || ((doc_id % 700) - (doc_id % 700) % 8 - 8 + (doc_id % 4)) || '@doc.example>' END AS in_reply_to,
  CASE WHEN doc_id % 700 >= 8 AND doc_id % 5 <> 0 THEN '<d' || (doc_id % 4) || '@doc.example>' END AS ref_far,
  '2024-02-' || (10 + doc_id % 19) || 'T00:00:00+00:00' AS date, lang AS subject
FROM documents
"""


def case_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of mails in the jobs (sources) of four cases.

    References lead to lower numbers, so there are no cycles; copies of one
    text have different ids, of which the first occurrence's counts.
    """
    base = run(spark, sf_dir, CASE_MAILS)
    return base.withColumn("refs", F.array_compact(F.array("ref_far"))).drop("ref_far")


CASE_ORACLE = f"""
RECURSIVE o AS MATERIALIZED ({CASE_MAILS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, raw_sha256 ORDER BY job_pos, uid) AS n, count(*) OVER (PARTITION BY case_id, raw_sha256) AS source_count FROM o),
nodes0 AS (SELECT case_id, (row_number() OVER (PARTITION BY case_id ORDER BY job_pos, uid) - 1)::BIGINT AS uid, job_id, raw_sha256, message_id, in_reply_to, ref_far, date, source_count::BIGINT AS source_count FROM ranked WHERE n = 1),
nodes AS MATERIALIZED (SELECT *, CASE WHEN message_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY case_id, message_id) END AS variants FROM nodes0),
cand AS (SELECT case_id, uid, 0 AS pos, in_reply_to AS ref, message_id FROM nodes WHERE in_reply_to IS NOT NULL
  UNION ALL SELECT case_id, uid, 1, ref_far, message_id FROM nodes WHERE ref_far IS NOT NULL AND (in_reply_to IS NULL OR ref_far <> in_reply_to)),
ids AS (SELECT case_id, message_id AS ref, min(uid) AS target, count(*) AS v FROM nodes WHERE message_id IS NOT NULL GROUP BY 1, 2),
kinds AS (SELECT c.case_id, c.uid, c.pos, c.ref, ids.target, CASE WHEN c.ref = c.message_id THEN 'self' WHEN v IS NULL THEN 'missing' WHEN v > 1 THEN 'ambiguous' ELSE 'present' END AS kind
  FROM cand c LEFT JOIN ids ON ids.case_id = c.case_id AND ids.ref = c.ref),
chosen AS (SELECT case_id, uid, min(pos) AS pos FROM kinds WHERE kind = 'present' GROUP BY 1, 2),
tally AS (SELECT k.case_id, k.uid, count(*) FILTER (WHERE kind = 'missing') AS missing_refs, count(*) FILTER (WHERE kind = 'self') AS self_refs, count(*) FILTER (WHERE kind = 'ambiguous') AS ambiguous_refs
  FROM kinds k LEFT JOIN chosen c USING (case_id, uid) WHERE c.pos IS NULL OR k.pos < c.pos GROUP BY 1, 2),
linked AS MATERIALIZED (SELECT n.*, k.target AS parent_uid, k.ref AS parent_ref, coalesce(t.missing_refs, 0)::BIGINT AS missing_refs, coalesce(t.self_refs, 0)::BIGINT AS self_refs, coalesce(t.ambiguous_refs, 0)::BIGINT AS ambiguous_refs
  FROM nodes n LEFT JOIN chosen c ON c.case_id = n.case_id AND c.uid = n.uid LEFT JOIN kinds k ON k.case_id = n.case_id AND k.uid = n.uid AND k.pos = c.pos LEFT JOIN tally t ON t.case_id = n.case_id AND t.uid = n.uid),
tree(case_id, uid, root_uid, depth) AS (SELECT case_id, uid, uid, 0 FROM linked WHERE parent_uid IS NULL
  UNION ALL SELECT l.case_id, l.uid, t.root_uid, t.depth + 1 FROM linked l JOIN tree t ON t.case_id = l.case_id AND t.uid = l.parent_uid),
places AS (SELECT o.case_id, l.uid AS node, o.job_id, o.job_pos, min(o.uid) AS first_uid FROM o JOIN linked l ON l.case_id = o.case_id AND l.raw_sha256 = o.raw_sha256 GROUP BY 1, 2, 3, 4),
lacking AS (SELECT p.case_id, p.node, p.job_id, p.job_pos FROM places p JOIN linked l ON l.case_id = p.case_id AND l.uid = p.node AND l.parent_ref IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.case_id = p.case_id AND o.job_id = p.job_id AND o.message_id = l.parent_ref))
"""

# -------------------------------------------------------------- orders, lineitem

ORDER_MAILS = """
SELECT 's' || (o_custkey % 16) AS scope, CAST(o_orderkey AS BIGINT) AS uid, o_custkey, '<o' || o_orderkey || '@shop.example>' AS message_id, SHA('o' || o_orderkey) AS raw_sha256, ISO(o_orderdate) AS date, o_orderdate AS moment,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent_uid, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS thread_root_uid
FROM orders
"""

#: Hops come in header order (the last one first), ordered by the whole unique key of a line.
ORDER_HOPS = """
SELECT CAST(l_orderkey AS BIGINT) AS uid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) - 1 AS INT) AS idx, ISO(l_shipdate) AS time_utc, l_shipdate AS moment,
  'h' || (l_partkey % 5) || '.example' AS from_host, 'h' || (l_suppkey % 5) || '.example' AS by_host, CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END AS odd
FROM lineitem
"""

ORDER_PEOPLE = """
SELECT CAST(l_orderkey AS BIGINT) AS uid, CASE WHEN l_returnflag = 'N' THEN 'Cc' ELSE 'To' END AS field,
  CASE WHEN l_suppkey % 97 = 0 THEN 'broken address' WHEN l_partkey % 211 = 0 THEN 'staff@X.Example' ELSE 'S' || (l_suppkey % 10) || '@X.Example' END AS address,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS pos FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS BIGINT), 'Cc', 'S' || (l_suppkey % 10) || '@X.Example', CAST(100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 97 <> 0
"""

ORDER_FILES = """
SELECT CAST(l_orderkey AS BIGINT) AS uid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS idx, 'p' || (l_partkey % 7) AS name, SHA('s' || (l_suppkey % 5)) AS sha256,
  CAST(100 + l_suppkey % 5 AS BIGINT) AS size, CASE WHEN l_partkey % 61 = 0 THEN 1 ELSE 0 END AS bad FROM lineitem
"""


def _order_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run(spark, sf_dir, ORDER_MAILS).drop("moment")
    parent_id = F.when(F.col("parent_uid").isNotNull(), F.concat(F.lit("<o"), "parent_uid", F.lit("@shop.example>")))
    # one mail in nineteen claims a parent that is not there, one in twenty-three an older one
    claimed = F.when(F.col("uid") % 19 == 0, F.lit("<gone@shop.example>")).when((F.col("uid") % 23 == 0) & parent_id.isNotNull(), F.concat(F.lit("<o"), "thread_root_uid", F.lit("@shop.example>"))).otherwise(parent_id)
    return base.withColumn("in_reply_to", claimed).withColumn("refs", F.array().cast("array<string>")).withColumn("subject", F.lit(None).cast("string")).withColumn("thread_root_message_id", F.concat(F.lit("<o"), "thread_root_uid", F.lit("@shop.example>")))


#: How the twins say the same about claimed parents.
GATE_ORACLE = f"""
m0 AS MATERIALIZED ({ORDER_MAILS}),
m AS MATERIALIZED (SELECT *, CASE WHEN uid % 19 = 0 THEN '<gone@shop.example>' WHEN uid % 23 = 0 AND parent_uid IS NOT NULL THEN '<o' || thread_root_uid || '@shop.example>' WHEN parent_uid IS NOT NULL THEN '<o' || parent_uid || '@shop.example>' END AS claimed FROM m0),
gate AS MATERIALIZED (SELECT m.*, c.uid AS claimed_uid, CASE
    WHEN m.parent_uid IS NULL AND m.claimed IS NULL THEN 'thread_root'
    WHEN m.claimed = '<o' || m.parent_uid || '@shop.example>' THEN NULL
    WHEN c.uid IS NOT NULL THEN 'reference_conflict' ELSE 'missing_parent' END AS skip_reason
  FROM m LEFT JOIN m c ON c.scope = m.scope AND c.message_id = m.claimed)
"""


def timing_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = run(spark, sf_dir, ORDER_HOPS)
    null = F.lit(None).cast("string")
    hop = F.struct(
        F.col("idx").alias("index"), null.alias("raw"), "from_host", "by_host", "time_utc", null.alias("time_original"), F.lit("+0000").alias("timezone"), F.when(F.col("odd") == 1, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("issues")
    )
    grouped = hops.groupBy("uid").agg(F.array_sort(F.collect_list(hop)).alias("received"))
    return run(spark, sf_dir, ORDER_MAILS).drop("moment").join(grouped, "uid", "left")


def _with_people(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    tasks = _line_tasks(spark, sf_dir)
    people = run(spark, sf_dir, ORDER_PEOPLE, tasks)
    one = F.struct("pos", F.struct(F.concat(F.lit("n "), "address").alias("name"), "address").alias("a"))
    lists = people.groupBy("uid").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, one))), lambda x: x["a"]).alias(f.lower()) for f in ("To", "Cc")])
    sender = F.struct(F.lit("").alias("name"), F.concat(F.lit("c"), F.col("o_custkey") % 7, F.lit("@Y.Example")).alias("address"))
    return base.withColumn("from", sender).repartition(tasks, "uid").join(lists, "uid", "left")


def recipient_mails(spark: SparkSession, sf_dir: str, edges: bool = True) -> DataFrame:
    """Orders as mails with people; without ``edges`` nothing is looked up for their parent edges."""
    base = _order_base(spark, sf_dir)
    # the state of the edges is found before the addresses are there; it reads the mails several times, their windows run once
    return _with_people(spark, sf_dir, (gate_edges(keep(base, "order-mails")) if edges else base).drop("raw_sha256", "in_reply_to", "refs", "subject", "thread_root_message_id"))


#: Orders as mails of which one in forty shares its id with others, and some claim such an id.
CONFLICT_MAILS = f"""
SELECT scope, uid, o_custkey, raw_sha256, date, CAST(parent_uid AS BIGINT) AS parent_uid, CAST(thread_root_uid AS BIGINT) AS thread_root_uid,
  CASE WHEN uid % 40 = 7 THEN '<twin' || (o_custkey % 48) || '@shop.example>' ELSE '<o' || uid || '@shop.example>' END AS message_id,
  CASE WHEN uid % 40 = 9 OR parent_uid % 40 = 7 THEN '<twin' || (o_custkey % 48) || '@shop.example>' WHEN uid % 59 = 0 THEN '<gone@shop.example>' WHEN parent_uid IS NOT NULL THEN '<o' || parent_uid || '@shop.example>' END AS in_reply_to
FROM ({ORDER_MAILS}) x
"""


def conflicted_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the edges' state reads the mails several times, their windows run once
    base = keep(run(spark, sf_dir, CONFLICT_MAILS), "conflict-mails").withColumn("refs", F.array().cast("array<string>")).withColumn("subject", F.lit(None).cast("string"))
    return _with_people(spark, sf_dir, gate_edges(base))


def attachment_mails(spark: SparkSession, sf_dir: str, edges: bool = True) -> DataFrame:
    """Orders as mails with files; without ``edges`` nothing is looked up for their parent edges."""
    tasks = _line_tasks(spark, sf_dir)
    files = run(spark, sf_dir, ORDER_FILES, tasks)
    item = F.struct("idx", F.col("name").alias("filename"), F.lit("x/y").alias("content_type"), "size", "sha256", F.lit(None).cast("string").alias("original_filename"), F.when(F.col("bad") == 1, True).alias("undecodable"))
    lists = files.groupBy("uid").agg(F.array_sort(F.collect_list(item)).alias("attachments"))
    # the state of the edges is found before the files are there, and what it was found from is not needed with them
    base = _order_base(spark, sf_dir)
    base = (gate_edges(base) if edges else base).drop("raw_sha256", "in_reply_to", "refs", "subject", "thread_root_message_id")
    return base.withColumn("issues", F.array().cast("array<string>")).repartition(tasks, "uid").join(lists, "uid", "left")


# --------------------------------------------------------------- declared identity

IDENTITY_MAILS = """
SELECT 's' || (o.o_custkey % 16) AS scope, CAST(o.o_orderkey AS BIGINT) AS uid, o.o_custkey, '<o' || o.o_orderkey || '@' || (CASE WHEN o.o_orderkey % 6 = 0 THEN 'relay' || (o.o_orderkey % 3) ELSE lower(replace(n.n_name, ' ', '')) END) || '.example>' AS message_id,
  CASE WHEN o.o_orderkey % 6 = 0 THEN 'relay' || (o.o_orderkey % 3) ELSE lower(replace(n.n_name, ' ', '')) END || '.example' AS m_domain,
  CASE WHEN o.o_orderkey % 41 <> 0 THEN 'c' || o.o_custkey || '@' || (CASE WHEN o.o_orderkey % 9 = 0 THEN 'moved' ELSE lower(replace(n.n_name, ' ', '')) END) || '.example' END AS f_address,
  CASE WHEN o.o_orderkey % 41 <> 0 THEN (CASE WHEN o.o_orderkey % 9 = 0 THEN 'moved' ELSE lower(replace(n.n_name, ' ', '')) END) || '.example' END AS f_domain,
  CASE WHEN o.o_orderkey % 10 < 3 THEN 'c' || o.o_custkey || '@' || (CASE WHEN o.o_orderkey % 10 = 0 THEN 'bounce' ELSE lower(replace(n.n_name, ' ', '')) END) || '.example' END AS r_address,
  CASE WHEN o.o_orderkey % 10 < 3 THEN (CASE WHEN o.o_orderkey % 10 = 0 THEN 'bounce' ELSE lower(replace(n.n_name, ' ', '')) END) || '.example' END AS r_domain,
  CASE WHEN o.o_orderkey % 27 = 0 THEN 'Re: Fwd: order' WHEN o.o_orderkey % 5 = 0 THEN 'Re: order' ELSE 'order' END AS subject,
  CASE WHEN o.o_orderkey % 8 < 5 THEN 1 ELSE 0 END AS signed, CASE WHEN o.o_orderkey % 8 < 3 THEN 1 ELSE 0 END AS covered, ISO(o.o_orderdate) AS date,
  lag(o.o_orderkey) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS parent_uid, first_value(o.o_orderkey) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS root_uid,
  CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) - 1 AS BIGINT) AS thread_pos
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""


def identity_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run(spark, sf_dir, IDENTITY_MAILS)
    none = F.array().cast("array<string>")
    null = F.lit(None).cast("string")

    def entry(address: str) -> Column:
        d = domain_of(F.col(address))
        brief = F.struct(F.lit("").alias("name"), F.col(address).alias("address"), d.alias("domain"))
        return F.struct(F.lit(0).alias("index"), F.col(address).alias("raw"), F.lit(1).alias("count"), F.array(brief).alias("addresses"), F.col(address).alias("address"), F.lit("").alias("name"), d.alias("domain"), none.alias("anomalies"))

    def some(value: Column, present: Column) -> Column:
        return F.filter(F.array(value), lambda _: present)

    absent = F.lit(False)
    id_header = F.struct(F.lit(0).alias("index"), F.col("message_id").alias("raw"), F.col("message_id").alias("value"), null.alias("local_part"), F.col("m_domain").alias("domain"), none.alias("anomalies"))
    names = F.when(F.col("covered") == 1, F.array(F.lit("from"), F.lit("to"))).otherwise(F.array(F.lit("to")))
    signature = F.struct(F.lit(0).alias("index"), null.alias("raw"), F.lit(True).alias("present"), F.col("m_domain").alias("d"), F.lit("k").alias("s"), null.alias("i"), null.alias("i_local_part"), null.alias("i_domain"), names.alias("h"), (F.col("covered") == 1).alias("covers_from"), none.alias("anomalies"))
    identity = F.struct(
        some(entry("f_address"), F.col("f_address").isNotNull()).alias("from"), some(entry("f_address"), absent).alias("sender"), some(entry("f_address"), absent).alias("reply_to"), some(entry("r_address"), F.col("r_address").isNotNull()).alias("return_path"),
        F.struct(F.lit(True).alias("present"), F.array(id_header).alias("headers")).alias("message_id"), some(signature, F.col("signed") == 1).alias("dkim"),
        F.array().cast("array<struct<kind:string,header:string,index:int,detail:string,raw:string>>").alias("anomalies"),
    )
    return base.withColumn("identity", identity).drop("m_domain", "f_domain", "f_address", "r_domain", "r_address", "signed", "covered")
