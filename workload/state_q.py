"""Canonical state, provenance, schema evolution, sources and streams."""

from pyspark.sql import functions as F

from reconcile.operators import (
    catalog as ct, evolution as ev, fingerprint as fp, history as hs, provenance as pv,
)
from reconcile.plans import maintained as mp
from reconcile.plans.reconciliation import compute_plan
from reconcile.session import work_path
from reconcile.sources import (
    catalog as sc, commits as cm, plan_json as pj, reports as rp, snapshots as ss, walk,
)
from reconcile.streaming import changes as ch, tail
from .registry import query
from .views import MARK, cat

C = F.col
K = "database_name, normalized_key"
KEY = ["database_name", "normalized_key"]

# Orders stand for tables and their line items for columns.
_ITEM = """'{"l_linenumber":'||l_linenumber||',"l_partkey":'||l_partkey||',"l_returnflag":"'
 ||l_returnflag||'","note":null}'"""
_KEY_ITEM = """'{"l_suppkey":'||l_suppkey||'}'"""
# Ordinals end below the chunk size here, so each list is one chunk.
_LIST = """'{{"rows":'||count(*)||',"chunks":["'||sha256('['||
 string_agg({item}, ',' order by l_linenumber)||']')||'"]}}'"""
_STATE = f"""select 'db' as database_name, 'sales/tables/o'||o_orderkey as normalized_key,
 'tables' as kind, '{{"status":"'||o_orderstatus||'","owner":'||case when o_custkey%2=0
 then 'null' else '"c'||o_custkey||'"' end||',"columns":'||coalesce(c.digest,'null')||
 ',"keys":'||coalesce(k.digest,'null')||'}}' as state
from orders o
left join (select l_orderkey, {_LIST.format(item=_ITEM)} as digest
 from items group by 1) c on c.l_orderkey=o.o_orderkey
left join (select l_orderkey, {_LIST.format(item=_KEY_ITEM)} as digest from items where l_linestatus='F' group by 1) k on k.l_orderkey=o.o_orderkey"""


def _states(v, chunk=fp.CHUNK):
    key = lambda col: (F.lit("db").alias("database_name"),
                       cat("=sales/tables/o", col).alias("normalized_key"))
    orders = v.table("orders").select(
        *key("o_orderkey"), F.lit("tables").alias("kind"), C("o_orderstatus").alias("status"),
        F.when(C("o_custkey") % 2 != 0, cat("=c", "o_custkey")).alias("owner"))
    lines = v.items.select(
        *key("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        "l_linestatus", F.lit(None).cast("string").alias("note"))
    return fp.canonical_state(orders, ["status", "owner"], {
        "columns": (lines, "l_linenumber", ["l_linenumber", "l_partkey", "l_returnflag", "note"]),
        "keys": (lines.filter("l_linestatus = 'F'"), "l_linenumber", ["l_suppkey"]),
    }, chunk)


@query("e4_canonical_state", f"select {K}, state from ({_STATE}) s")
def _(v):
    return _states(v).select(*KEY, "state")


@query("e5_fingerprint", f"select {K}, sha256(kind||':'||state) as live_checksum from ({_STATE}) s")
def _(v):
    return _states(v).select(*KEY, "live_checksum")


@query("e4_chunked_child_list", """
select 'sales/tables/o'||l_orderkey as normalized_key, '{"rows":'||cast(sum(n) as bigint)||',"chunks":["'||string_agg(sha256('['||items||']'), '","'
 order by c)||'"]}' as columns
from (select l_orderkey, l_linenumber//2 as c, count(*) as n,
 string_agg('{"l_suppkey":'||l_suppkey||'}', ',' order by l_linenumber) as items
 from items group by 1,2) t group by l_orderkey""")
def _(v):
    lines = v.items.select(
        F.lit("db").alias("database_name"),
        cat("=sales/tables/o", "l_orderkey").alias("normalized_key"), "l_linenumber", "l_suppkey")
    return fp.child_list(lines, "columns", "l_linenumber", ["l_suppkey"], 2).drop("database_name")


# Customers hold orders, which hold line items and, of those, the returned ones. Order
# keys span several chunks; line numbers end below the chunk size.
_INNER = """(select l_orderkey, '{{"rows":'||count(*)||',"chunks":["'||sha256('['||
 string_agg('{{"l_linenumber":'||l_linenumber||',"l_partkey":'||l_partkey||'}}', ','
 order by l_linenumber)||']')||'"]}}' as value from items {where} group by 1)"""
_NESTED = f"""select 'db' as database_name, 'crm/tables/c'||c_custkey as normalized_key,
 '{{"c_mktsegment":"'||c_mktsegment||'","orders":'||coalesce(o.value,'null')||'}}' as state
from customer left join (select o_custkey, '{{"rows":'||cast(sum(n) as bigint)||',"chunks":["'||
 string_agg(sha256('['||entries||']'), '","' order by c)||'"]}}' as value
 from (select o_custkey, o_orderkey//4096 as c, count(*) as n, string_agg('{{"o_orderkey":'||
  o_orderkey||',"note":null,"items":'||coalesce(i.value,'null')||',"returned":'||
  coalesce(r.value,'null')||'}}', ',' order by o_orderkey) as entries
  from orders left join {_INNER.format(where="")} i on i.l_orderkey=o_orderkey
  left join {_INNER.format(where="where l_returnflag='R'")} r on r.l_orderkey=o_orderkey
  group by 1,2) t group by 1) o on o_custkey=c_custkey"""


def _nested_states(v):
    db = F.lit("db").alias("database_name")
    own = lambda col: cat("=crm/tables/c", col).alias("normalized_key")
    # A literal would leave the join with the lists but not their grouping, and they would travel twice.
    same_db = F.concat_ws("", F.lit("db"), F.substring("c_mktsegment", 1, 0)).alias("database_name")
    customers = v.table("customer").select(same_db, own("c_custkey"), F.lit("tables").alias("kind"), "c_mktsegment")
    orders = v.table("orders")
    # An order's lines stay in the task they are folded in, for the join and for their lists.
    owners = orders.select("o_orderkey", "o_custkey")
    lines = v.items_by_order.join(owners, C("l_orderkey") == C("o_orderkey")).select(
        db, own("o_custkey"), "o_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    items = fp.ChildList(lines, "l_linenumber", ["l_linenumber", "l_partkey"])
    return fp.canonical_state(customers, ["c_mktsegment"], {"orders": fp.ChildList(
        orders.select(db, own("o_custkey"), "o_orderkey", F.lit(None).cast("string").alias("note")),
        "o_orderkey", ["o_orderkey", "note"],
        {"items": items, "returned": items._replace(where=C("l_returnflag") == "R")})})


@query("e4_nested_state", f"select {K}, state, sha256('tables:'||state) as live_checksum from ({_NESTED}) s")
def _(v):
    return _nested_states(v).select(*KEY, "state", "live_checksum")


@query("e4_text_state", f"""
select database_name, normalized_key, sha256(kind||':'||text) as live_checksum
from manifest join documents using (doc_id)""")
def _(v):
    return fp.text_state(v.scripts, "content").select(*KEY, "live_checksum")


def _log_lines(v, blocks):
    """A commit log as lines: a header per order, a path per line item."""
    o = v.table("orders")
    head = o.select(
        C("o_orderkey").alias("k"), F.lit(0).alias("i"),
        cat("=COMMIT\x1fc", "o_orderkey", "=\x1fauthor", "o_custkey", "=\x1fd", "o_orderkey")
        .alias("line"))
    body = v.items.select(
        C("l_orderkey").alias("k"), C("l_linenumber").alias("i"),
        cat("=db\\p", "l_partkey", "=.sql").alias("line"))
    pos = C("k") * 100 + C("i")
    return head.unionByName(body).select(
        F.lit("log").alias("file"), F.floor(pos / blocks).alias("block"), pos.alias("line_no"),
        "line")


_TOUCH = """select l_orderkey*100+l_linenumber as line_no, 'db/p'||l_partkey||'.sql' as path,
 'c'||o_orderkey as git_hash, 'author'||o_custkey as git_author, 'd'||o_orderkey as git_date
from items join orders on o_orderkey=l_orderkey"""


@query("f1_attach_commit", _TOUCH)
def _(v):
    # An odd block size cuts through commits, so headers cross block borders.
    return pv.attach_commit(_log_lines(v, 10007)).drop("file", "block")


@query("f2_latest_commit_per_path", f"""
select path as object_path, git_hash, git_author, git_date from (select *, row_number() over
 (partition by path order by line_no) rn from ({_TOUCH}) t) u where rn=1""")
def _(v):
    touches = pv.attach_commit(_log_lines(v, 100000))
    return pv.latest_commit_per_path(touches, ["line_no"])


@query("f2_latest_commit_by_time", "select object_path, git_hash, git_author, git_date from commits")
def _(v):
    return pv.latest_commit_by_time(v.commits, ["committed_at", "commit_id"])


@query("a3_read_commit_log", """
select distinct object_path as path, 'c'||commit_id as git_hash, author as git_author,
 't'||commit_id as git_date from commit_touch""")
def _(v):
    path = work_path(v.spark, "commit-log")
    # Every touch is a complete block of text, so any cut between rows is a valid log.
    block = cat("=COMMIT\x1f", "git_hash", "=\x1f", "git_author", "=\x1f", "git_date", "=\n\n",
                "object_path", "=\n")
    v.commits.select(block.alias("value")).distinct().write.text(path)
    return cm.read_commit_log(v.spark, path).select("path", "git_hash", "git_author", "git_date")


@query("j1_script_columns", f"select {K}, cast(ordinal as int) as ordinal, column_name, type_name, nullable from file_columns")
def _(v):
    return ev.script_columns(v.table_scripts)


@query("h4_column_diff", f"select {K}, column_name, type_name, nullable, change from column_diff")
def _(v):
    return _diff(v).drop("ordinal")


def _diff(v):
    return ev.column_diff(ev.script_columns(v.table_scripts), v.live_columns)


@query("j2_additive_changes", f"""
select {K}, added, dropped, safe, added>0 and dropped=0 and safe as additive from additive""")
def _(v):
    return ev.additive_changes(_diff(v))


_LINE = """'ALTER TABLE [dbo].['||substr(normalized_key,12)||'] ADD ['||replace(column_name,']',']]')||'] '
 ||type_name||' '||case when nullable then 'NULL' else 'NOT NULL' end||';'"""
_LINES = f"""select d.database_name, d.normalized_key, d.ordinal, d.line from (select *, {_LINE} as line
 from column_diff where change='new') d join additive a on a.database_name=d.database_name
 and a.normalized_key=d.normalized_key and a.added>0 and a.dropped=0 and a.safe"""


@query("j3_proposed_changes", f"select {K}, cast(ordinal as int) as ordinal, line from ({_LINES}) t")
def _(v):
    diff = _diff(v)
    return ev.proposed_changes(diff, ev.additive_changes(diff))


@query("j3_proposal_text", f"""
select {K}, '-- Auto-generated migration for [dbo].['||substr(normalized_key,12)||']'||chr(10)
 ||'-- Added columns: '||count(*)||chr(10)||'-- Review this migration before running.'||chr(10)||chr(10)
 ||string_agg(line, chr(10) order by ordinal)||chr(10) as content from ({_LINES}) t group by 1,2""")
def _(v):
    diff = _diff(v)
    return ev.proposal_text(ev.proposed_changes(diff, ev.additive_changes(diff)))


_FILE = "database_name||'/dbo/tables/_migrations/'||substr(normalized_key,12)||'/001_{commit}_{slug}.sql'"


@query("j3_proposal_files", f"""
select distinct {K}, {_FILE.format(commit='abc1234', slug='auto_add_columns')} as path from ({_LINES}) t
where cast(substr(normalized_key,13) as bigint)%4<>0""")
def _(v):
    """Every fourth table has such a file already."""
    diff = _diff(v)
    texts = ev.proposal_text(ev.proposed_changes(diff, ev.additive_changes(diff)))
    there = v.table_scripts.filter(C("p_partkey") % 4 == 0).select(
        cat("database_name", "=/dbo/tables/_migrations/p", "p_partkey", "=/001_abc1234_auto_add_columns.sql").alias("path"))
    return ev.proposal_files(texts, "abc1234", there).drop("content")


@query("j4_template_files", f"""
select distinct {K}, {_FILE.format(commit='0000000', slug='describe_change')} as path from live_columns""")
def _(v):
    """A commit with a slash is no token, so zeros stand in for it."""
    columns = ct.column_lists(v.live_columns)
    return ev.template_files(ev.change_templates(v.table_scripts, columns), "a/b").drop("content")


@query("j4_change_templates", f"""
select f.database_name, f.normalized_key, '{MARK}'||chr(10)||'-- Table: [dbo].['||t||']'||chr(10)
 ||'-- Replace this scaffold with the actual migration SQL.'||chr(10)||'-- Schema: dbo'||chr(10)
 ||'-- Table: '||t||chr(10)||'-- Press Ctrl+C to stop migration.'||chr(10)
 ||'-- Detected columns:'||chr(10)||string_agg('--   '||column_name||' '||type_name||
 case when nullable then ' NULL' else ' NOT NULL' end, chr(10) order by column_name)||chr(10) as content
from (select *, substr(normalized_key,12) as t from live_columns) f group by 1,2,t""")
def _(v):
    return ev.change_templates(v.table_scripts, ct.column_lists(v.live_columns))


@query("j5_needs_template", f"""
select {K}, scenario from attrs p where planned_action='reprocess_changed_blocked'
 and not exists (select 1 from authored a where a.database_name=p.database_name
 and a.normalized_key=p.normalized_key)""")
def _(v):
    return ev.needs_template(v.plan, v.authored).select(*KEY, "scenario")


# --- sources -----------------------------------------------------------------


_TREE = """(select text, 'db'||doc_id%2||case doc_id%5 when 0 then '/.drafts/'||source
 when 1 then '/_old/deep/er/'||source when 2 then '/'||source||'/tables/_migrations/o'||doc_id
 when 3 then '/'||source||'/views' else '/'||source end||case doc_id%4 when 0 then '/.o' when 1 then '/_o'
 else '/o' end||doc_id||case doc_id%7 when 0 then '.SQL' when 1 then '.txt' else '.sql' end as path
 from documents)"""


def _script_folder(v):
    """Every document as a file, in folders of several depths, some names hidden."""
    i = C("doc_id")
    folder = (F.when(i % 5 == 0, cat("=/.drafts/", "source")).when(i % 5 == 1, cat("=/_old/deep/er/", "source"))
              .when(i % 5 == 2, cat("=/", "source", "=/tables/_migrations/o", "doc_id"))
              .when(i % 5 == 3, cat("=/", "source", "=/views")).otherwise(cat("=/", "source")))
    name = F.when(i % 4 == 0, "/.o").when(i % 4 == 1, "/_o").otherwise("/o")
    ends = F.when(i % 7 == 0, ".SQL").when(i % 7 == 1, ".txt").otherwise(".sql")
    root = work_path(v.spark, "scripts")
    path = F.concat(cat("=db", i % 2), folder, name, i.cast("string"), ends)
    walk.write_scripts(v.table("documents").select(path.alias("path"), C("text").alias("content")), root)
    return root


@query("a1_scan_tree", f"""
select path, strlen(text) as length, sha256(text) as checksum from {_TREE} t where path not like '%.txt'""")
def _(v):
    root = _script_folder(v)
    files = walk.read_scripts(walk.walk_tree(v.spark, root), root)
    return files.select("path", "length", F.sha2("content", 256).alias("checksum"))


@query("a1_folder_sizes", f"""
select folder, count(*) as files, cast(sum(n) as bigint) as bytes from (select strlen(text) as n,
 regexp_replace(path, '/[^/]*$', '') as folder from {_TREE} t where path not like '%.txt') u group by 1""")
def _(v):
    """Sizes come from the walk alone; no content is read."""
    files = walk.walk_tree(v.spark, _script_folder(v))
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("a4_a5_plan_lines", f"""
select {K}, object_path, kind, planned_action, checksum, ex as "exists",
 coalesce(parent_name,'') as parent_name from attrs""")
def _(v):
    path = work_path(v.spark, "plan")
    pj.write_plans(v.plan, path)
    return pj.read_plans(v.spark, path, "lines").select(
        *KEY, "object_path", "kind", "planned_action", "checksum", "exists", "parent_name")


@query("a4_a5_plan_documents", f"""
select {K}, object_path, planned_action, checksum, ex as "exists" from attrs""")
def _(v):
    path = work_path(v.spark, "plan-doc")
    schemas = ct.schema_actions(v.manifest, v.schemas_on_server)
    pj.write_plan_documents(v.plan, schemas, path)
    return pj.read_plans(v.spark, path, "parts").select(
        *KEY, "object_path", "planned_action", "checksum", "exists")


_SNAP = """select snapshot_key, object_path, planned_action, checksum_hex, exists_flag as "exists"
from snapshot_cur"""


@query("a6_snapshot_lines", _SNAP)
def _(v):
    path = work_path(v.spark, "snapshot")
    ss.write_snapshots(v.snapshot_cur, path)
    return ss.read_snapshots(v.spark, path, "lines")


@query("a6_snapshot_document", _SNAP)
def _(v):
    path = work_path(v.spark, "snapshot-doc")
    ss.write_snapshot_document(v.snapshot_cur, path)
    return ss.read_snapshots(v.spark, path, "parts").drop("version", "blocked")


@query("a7_read_reports", """
select scenario, applied, failed, skipped from reports""")
def _(v):
    path = work_path(v.spark, "reports")
    rp.write_reports(v.reports(0).unionByName(v.reports(1)), path)
    return rp.read_reports(v.spark, path, "apply", multi_line=False).select(
        "scenario", *[C(c).cast("bigint").alias(c) for c in ("applied", "failed", "skipped")])


@query("a7_shape_errors", """
select o_orderkey, case o_orderkey%4 when 1 then 'report JSON must be an object'
 else 'report field `timings` must be an object' end as reason from orders where o_orderkey%4 in (1,2)""")
def _(v):
    k = C("o_orderkey")
    value = (F.when(k % 4 == 0, '{"scenario":"a","timings":{}}').when(k % 4 == 1, "[1]")
             .when(k % 4 == 2, '{"timings":"x"}').otherwise('{"scenario":"b"}'))
    return rp.shape_errors(v.table("orders").select("o_orderkey", value.alias("value")),
                           "apply").select("o_orderkey", "reason")


@query("a8_write_run_report", f"select {K}, planned_action from attrs")
def _(v):
    path = work_path(v.spark, "run")
    rp.write_run_report(v.spark, path, "plan", 0, v.plan)
    return pj.read_plans(v.spark, f"{path}/plan", "lines").select(*KEY, "planned_action")


@query("a9_append_traces", """
select plan_db_path as path, count(*)*2 as n from runs_wide group by 1""")
def _(v):
    path = work_path(v.spark, "traces")
    rows = v.runs_wide.select(C("plan_db_path").alias("path"), "parallel_wall_ms")
    rp.append_traces(rows, path)
    rp.append_traces(rows, path)
    return rp.read_traces(v.spark, path, rows.schema).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"))


@query("a11_read_catalog", f"""
select {K}, 'object' as row_kind, kind, coalesce(parent_name,'') as parent_name from catalog""")
def _(v):
    path = work_path(v.spark, "catalog")
    v.catalog.select("database_name", F.upper("schema_name").alias("schema_name"), "kind",
                     F.upper("object_name").alias("object_name"), "parent_name").write.parquet(path)
    return sc.read_catalog(v.spark, path).select(*KEY, "row_kind", "kind", "parent_name")


# --- streams -----------------------------------------------------------------


def _event_stream(v):
    schema = v.table("events").schema
    raw = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf)
    return raw.withColumn("doc_id", C("event_id") % v.n_docs)


def _run(v, updates, name):
    state, mark = work_path(v.spark, name), work_path(v.spark, f"{name}-checkpoint")
    q = ch.upsert_query(updates, state, mark)
    q.awaitTermination()
    return state




@query("k1_stream_object_ddl", """
select m.database_name, m.schema_name, m.object_name, max(ddl_version) as ddl_version from ddl_events e
join manifest m on m.database_name=e.database_name and m.normalized_key=e.normalized_key
where m.schema_name<>'deploy_meta' group by 1,2,3""")
def _(v):
    kind = F.when(C("event_type") == "error", "ALTER_TABLE").otherwise("GRANT_DATABASE")
    events = _event_stream(v).join(v.manifest, "doc_id").select(
        "database_name", kind.alias("event_type"), F.upper("schema_name").alias("schema_name"),
        F.upper("object_name").alias("object_name"), C("event_id").alias("version"), "ts")
    state = _run(v, ch.stream_object_ddl(events), "object-ddl")
    return ch.read_object_ddl(v.spark, state).drop("updated_at")


def _event_files(v, parts):
    """The events in several files by id, read as a stream one file a batch."""
    path = work_path(v.spark, "event-files")
    v.table("events").repartitionByRange(parts, "event_id").write.parquet(path)
    rows = v.spark.readStream.schema(v.table("events").schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.withColumn("doc_id", C("event_id") % v.n_docs)


@query("k1_maintained_plan", f"""
select {K}, object_path, scenario, planned_action, counter, blocked, needs_provenance, message,
 ex as "exists", drift, prior, ntr as transitions from attrs""")
def _(v):
    """A plan of no changes, brought up to date by three batches of events."""
    kept = lambda df, name: (df.write.parquet(p := work_path(v.spark, name)), v.spark.read.parquet(p))[1]
    inputs = mp.Inputs(
        kept(v.manifest, "manifest"), kept(v.catalog, "catalog"),
        kept(hs.latest_object_history(v.history), "latest"), v.transitions, v.live)
    path = work_path(v.spark, "plan-store")
    none = v.object_ddl.limit(0)
    mp.create_plan(compute_plan(inputs.manifest, inputs.catalog, None, none, inputs.transitions,
                                inputs.live, latest=inputs.latest), path)
    kind = F.when(C("event_type") == "error", "ALTER_TABLE").otherwise("GRANT_DATABASE")
    events = _event_files(v, 3).join(inputs.manifest, "doc_id").select(
        "database_name", kind.alias("event_type"), "schema_name", "object_name",
        C("event_id").alias("version"), "ts")
    mp.maintain(events, path, work_path(v.spark, "plan-checkpoint"), inputs).awaitTermination()
    return mp.read_plan(v.spark, path).select(
        *KEY, "object_path", "scenario", "planned_action", "counter", "blocked",
        "needs_provenance", "message", "exists", "drift", "prior", "transitions")


@query("k2_stream_suspects", f"""
select e.database_name, e.normalized_key, max(e.ddl_version) as ddl_version
from ddl_events e join latest l on l.database_name=e.database_name
 and l.normalized_key=e.normalized_key where l.applied_ddl_version is null
 or e.ddl_version>l.applied_ddl_version group by 1,2""")
def _(v):
    latest = hs.latest_object_history(v.history)
    events = _event_stream(v).filter("event_type = 'error'").join(v.manifest, "doc_id").select(
        *KEY, C("event_id").alias("ddl_version"))
    updates = ch.stream_suspects(events, latest).groupBy(*KEY).agg(
        F.max("ddl_version").alias("ddl_version"))
    state = _run(v, updates, "suspects")
    return v.spark.read.parquet(state).groupBy(*KEY).agg(F.max("ddl_version").alias("ddl_version"))


@query("k2_uncleared_suspects", f"""
select {K}, ddl_version from flagged f join object_ddl o using ({K}) where suspect""")
def _(v):
    """Events and audit rows as two streams of several batches; the log arrives later."""
    at = C("ts").cast("timestamp")
    events = v._events_on_docs.filter("event_type = 'error'").join(v.manifest, "doc_id").select(
        *KEY, C("event_id").alias("ddl_version"), at.alias("ts"))
    audits = v.history.filter(C("event").isin("applied", "adopted")).select(
        *KEY, "applied_ddl_version", C("created_at").cast("timestamp").alias("created_at"))
    # Times follow the ids only roughly, so nothing may count as late: the horizon covers all times.
    ends = v.table("events").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    days = (ends.hi - ends.lo).days + 1
    done = v.spark.range(1).select(
        F.lit("").alias("database_name"), F.lit("").alias("normalized_key"),
        F.lit(0).cast("long").alias("version"), F.lit(ends.hi + (ends.hi - ends.lo) * 4).alias("at"))
    paths = work_path(v.spark, "events"), work_path(v.spark, "audits")
    for df, path, names in zip((events, audits), paths, (["ddl_version", "ts"], ["applied_ddl_version", "created_at"])):
        # The last file only moves the clock on, so that everything before it is settled.
        df.repartitionByRange(3, names[0]).write.parquet(path)
        done.toDF(*KEY, *names).coalesce(1).write.mode("append").parquet(path)
    streams = [v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(p)
               for df, p, n in zip((events, audits), paths, (2, 1))]
    left = ch.stream_uncleared(*streams, f"{days} days", f"{days} days")
    sink, mark = work_path(v.spark, "uncleared"), work_path(v.spark, "uncleared-checkpoint")
    q = (left.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True)
         .start(sink))
    q.awaitTermination()
    rows = v.spark.read.schema(left.schema).parquet(sink).join(
        hs.latest_object_history(v.history), KEY, "left_semi")
    return rows.groupBy(*KEY).agg(F.max("ddl_version").alias("ddl_version"))


@query("k3_stream_latest_history", f"""
select {K}, id, checksum, live_definition_checksum, applied_ddl_version from latest""")
def _(v):
    path = work_path(v.spark, "history-log")
    v.history.write.parquet(path)
    rows = v.spark.readStream.schema(v.history.schema).parquet(path)
    state = _run(v, tail.stream_latest_history(rows), "latest")
    return tail.read_latest_history(v.spark, state)


_LATEST = ["id", "checksum", "live_definition_checksum", "applied_ddl_version"]


def _kept_state(v):
    """The log in two halves by id, each streamed into the same state by a run of its own."""
    log, mark = work_path(v.spark, "history-log"), work_path(v.spark, "latest-state")
    half = C("id") >= F.lit(v.table("events").count() // 2)
    for part in (~half, half):
        v.history.filter(part).write.mode("append").parquet(log)
        rows = v.spark.readStream.schema(v.history.schema).parquet(log)
        tail.keep_latest_history(rows, mark).awaitTermination()
    return mark


@query("k3_latest_from_state", f"select {K}, {', '.join(_LATEST)} from latest")
def _(v):
    return tail.latest_from_state(v.spark, _kept_state(v))


@query("k3_changed_in_state", f"""
select {K}, {', '.join(_LATEST)} from latest where id >= (select count(*)//2 from events)""")
def _(v):
    return tail.changed_in_state(v.spark, _kept_state(v), 1, 1)
