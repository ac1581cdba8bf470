"""History, drift, plan and what is read off a plan."""

from pyspark.sql import functions as F

from reconcile.functions import checksums as ck
from reconcile.operators import (
    drift as dr, history as hs, products as pr, provenance as pv, snapshot as sn, transitions as tr,
)
from reconcile.plans import catalog_snapshots as cs
from reconcile.plans.reconciliation import compute_plan
from reconcile.session import work_path
from .catalog_q import _LE
from .registry import query
from .views import cat, sha

C = F.col
K = "database_name, normalized_key"
KEY = ["database_name", "normalized_key"]


@query("flagship_plan", "select scenario, count(*) as n from plan group by 1")
def _(v):
    return v.plan.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


@query("e1_latest_object_history", f"""
select {K}, id, checksum, live_definition_checksum, applied_ddl_version from latest
where {K.split(',')[0]}||'/'||normalized_key in (select snapshot_key from delta)""")
def _(v):
    return hs.latest_object_history(v.history, v.delta)


@query("e2_latest_migrations", "select database_name, path as normalized_key, recorded as checksum from log_last")
def _(v):
    return hs.latest_migrations(v.migration_log).drop("id")


@query("e3_object_ddl", f"select {K}, ddl_version from object_ddl")
def _(v):
    return hs.object_ddl(v.ddl_events).drop("updated_at")


@query("i1_suspects", f"select {K}, suspect from flagged")
def _(v):
    return dr.suspects(hs.latest_object_history(v.history), v.object_ddl).select(*KEY, "suspect")


@query("i2_drift", f"select {K}, drift from drifted where drift")
def _(v):
    flagged = dr.suspects(hs.latest_object_history(v.history), v.object_ddl)
    return dr.drift(flagged, v.live(dr.suspect_keys(flagged))).filter("drift").select(*KEY, "drift")


@query("i4_compute_plan", f"""
select {K}, object_path, scenario, planned_action, counter, blocked, needs_provenance, message,
 ex as "exists", drift, prior, ntr as transitions from attrs""")
def _(v):
    return compute_plan(
        v.manifest, v.catalog, v.history, v.object_ddl, v.transitions,
        v.live,
    ).select(*KEY, "object_path", "scenario", "planned_action", "counter", "blocked",
             "needs_provenance", "message", "exists", "drift", "prior", "transitions")


_SUMMARY = """count(*) as object_count, count(*) filter (counter='create') as create_count,
 count(*) filter (counter='adopt') as adopt_count, count(*) filter (counter='skip') as skip_count,
 count(*) filter (counter='changed') as changed_count, count(*) filter (blocked) as blocked_count"""


@query("e6_plan_summary", f"""
select s.database_name, coalesce(c.n,0) as schema_count, s.* exclude (database_name) from
(select database_name, {_SUMMARY} from attrs group by rollup (database_name)) s
left join (select database_name, count(*) as n from schemas group by rollup (database_name)) c
on c.database_name is not distinct from s.database_name""")
def _(v):
    from reconcile.operators.catalog import schema_actions
    return pr.plan_summary(v.plan, schema_actions(v.manifest, v.schemas_on_server), total=True)


@query("e7_action_counts", "select planned_action, count(*) as n from attrs group by 1")
def _(v):
    return pr.action_counts(v.plan)


@query("e8_plan_blockers", f"select {K}, scenario, message from attrs where blocked")
def _(v):
    return pr.plan_blockers(v.plan)


@query("i5_plan_verdict", """
select database_name, bool_or(blocked) as blocked, count(*) filter (blocked) as blockers
from attrs group by 1""")
def _(v):
    return pr.plan_verdict(v.plan)


@query("e11_merge_plans", f"""
select cast(sum(schema_count) as bigint) as schema_count, {', '.join(
    f'cast(sum({c}) as bigint) as {c}' for c in pr.COUNT_COLUMNS[1:])},
 bool_or(blocked_count>0) as blocked from
 (select s.*, (select count(*) from schemas c where c.database_name=s.database_name) as schema_count
  from (select database_name, {_SUMMARY} from attrs group by 1) s) t""")
def _(v):
    from reconcile.operators.catalog import schema_actions
    parts = [v.plan.filter(C("database_name") == d) for d in ("db0", "db1")]
    schemas = schema_actions(v.manifest, v.schemas_on_server)
    return pr.merge_summaries(pr.plan_summary(pr.merge_plans(parts), schemas))


@query("g1_order_plan", f"select {K}, planned_action from attrs")
def _(v):
    return pr.order_plan(v.plan).select(*KEY, "planned_action")


@query("g2_deploy_order", f"""
select {K}, cast(case when kind in ('tables','indexes','types','sequences','synonyms') then 0
 else 1 end as int) as batch, cast(doc_id%9 as int) as rank from attrs
where planned_action in ('create_object','update_existing_module')""")
def _(v):
    return pr.deploy_order(v.plan).select(*KEY, "batch", "rank")


@query("i9_adoption_gate", f"select {K} from attrs where planned_action='adopt_existing'")
def _(v):
    return pr.adoption_gate(v.plan)


@query("g5_adoption_sample", f"""
select {K} from attrs where planned_action='adopt_existing' order by 1,2 limit 10""")
def _(v):
    return pr.adoption_sample(pr.adoption_gate(v.plan))


@query("i10_metadata_records", f"""
select {K}, 'object' as kind, checksum,
 case planned_action when 'adopt_existing' then 'adopted' else 'applied' end as event
from attrs where planned_action not in ('create_object','skip_unchanged')""")
def _(v):
    return pr.metadata_records(v.plan, "repair")


@query("i10_baseline_records", f"""
select {K}, 'object' as kind, checksum, 'adopted' as event
from attrs where planned_action='adopt_existing'""")
def _(v):
    # A plan without its blocked rows, so that the baseline is not refused.
    return pr.metadata_records(v.plan.filter(~C("blocked")), "baseline")


@query("d9_with_provenance", f"""
select a.database_name, a.normalized_key,
 case when a.needs_provenance then c.git_hash end as git_hash,
 case when a.needs_provenance then c.git_author end as git_author
from attrs a left join commits c on c.object_path=a.object_path""")
def _(v):
    latest = pv.latest_commit_by_time(v.commits, ["committed_at", "commit_id"])
    return pr.with_provenance(v.plan, latest).select(*KEY, "git_hash", "git_author")


@query("e14_apply_outcome", """
select database_name, cast(sum(applied) as bigint) as applied, cast(sum(skipped) as bigint) as skipped,
 cast(sum(failed) as bigint) as failed from (
 select database_name, cast(due and not bad as int) as applied,
  cast(planned_action in ('adopt_existing','skip_unchanged','reprocess_changed',
   'reprocess_changed_blocked') as int) as skipped, cast(due and bad as int) as failed
 from (select *, planned_action in ('create_object','update_existing_module') as due,
  doc_id in (select doc_id from labels where toxic=1) as bad from attrs) a
 union all select database_name, cast(action='create_schema' as int), cast(action='exists' as int), 0
 from schemas
 union all select database_name, 1, 0, 0 from due_steps where recorded is null) t group by 1""")
def _(v):
    from reconcile.operators.catalog import schema_actions
    log = hs.latest_migrations(v.migration_log)
    toxic = v.table("labels").filter("toxic = 1").select("doc_id")
    bad = v.manifest.join(toxic, "doc_id", "left_semi")
    return pr.run_outcome(
        v.plan, schema_actions(v.manifest, v.schemas_on_server), v.authored, log, bad)


@query("e14_audit_rows", """
select kind, count(*) as n from (select kind from history union all select kind from migration_log) t
group by 1""")
def _(v):
    return pr.audit_rows_by_kind(v.history.select("kind").union(v.migration_log.select("kind")))


def _all_due(v):
    # Every table is due here; the plan of the given data replays few or none.
    return v.manifest.filter(C("kind") == "tables").withColumn(
        "planned_action", F.lit("reprocess_changed"))


@query("i8_pending_transitions", """
select a.database_name, a.normalized_key, a.path from authored a left join log_last l
 on l.database_name=a.database_name and l.path=a.path where l.path is null""")
def _(v):
    return tr.pending_transitions(
        _all_due(v), v.authored, hs.latest_migrations(v.migration_log)).select(*KEY, "path")


@query("i8_pending_of_plan", f"select {K}, path from due_steps where recorded is null")
def _(v):
    return tr.pending_transitions(
        v.plan, v.authored, hs.latest_migrations(v.migration_log)).select(*KEY, "path")


@query("i8_tampered_transitions", f"""
select a.database_name, a.normalized_key, a.path, l.recorded from authored a join log_last l
 on l.database_name=a.database_name and l.path=a.path where recorded<>'' and recorded<>checksum""")
def _(v):
    return tr.tampered_transitions(
        _all_due(v), v.authored, hs.latest_migrations(v.migration_log)).select(*KEY, "path", "recorded")


@query("i18_creation_records", f"""
select {K}, 'object' as kind, checksum, 'applied' as event from attrs
 where planned_action='create_object'
union all select a.database_name, a.path, 'migration', a.checksum, 'applied' from authored a
join attrs p on p.database_name=a.database_name and p.normalized_key=a.normalized_key
 and p.planned_action='create_object' and p.kind='tables'""")
def _(v):
    return tr.creation_records(v.plan, v.authored)


@query("e10_transition_lists", f"""
select {K}, string_agg(path, '|' order by ordinal) as paths from authored group by 1,2""")
def _(v):
    return tr.transition_lists(v.authored).select(*KEY, F.array_join("paths", "|").alias("paths"))


@query("d6_link_transitions", """
select a.database_name, a.normalized_key, a.path, m.object_path from authored a join manifest m
 on m.database_name=a.database_name and m.normalized_key=a.normalized_key and m.kind='tables'""")
def _(v):
    return tr.link_transitions(v.authored, v.manifest).select(*KEY, "path", "object_path")


@query("c6_missing_fingerprints", f"""
select {K}, id from history where event in ('applied','adopted') and live_definition_checksum is null""")
def _(v):
    return hs.missing_fingerprints(v.history).select(*KEY, "id")


@query("c7_invalid_checksums", f"""
select {K}, 'audit history checksum for '||normalized_key||' is undecodable' as message
from latest where id%5=0 and checksum<>''""")
def _(v):
    cut = F.when((C("id") % 5 == 0) & (C("checksum") != ""), F.substring("checksum", 1, 40))
    latest = hs.latest_object_history(v.history).withColumn(
        "checksum", F.coalesce(cut, "checksum"))
    return hs.invalid_checksums(latest).select(*KEY, "message")


@query("c7_repaired_checksums", f"""
select {K}, case when checksum='' or id%5=0 then '{ck.ZERO_DIGEST}' else checksum end as checksum
from latest""")
def _(v):
    cut = F.when((C("id") % 5 == 0) & (C("checksum") != ""), F.substring("checksum", 1, 40))
    latest = hs.latest_object_history(v.history).withColumn(
        "checksum", F.coalesce(cut, "checksum"))
    return hs.decoded_checksums(latest, repair=True).select(*KEY, "checksum")


@query("a10_append_history", """
select kind, event, count(*) as n from (select kind, event from history union all
 select 'object', case planned_action when 'adopt_existing' then 'adopted' else 'applied' end
 from attrs where planned_action not in ('create_object','skip_unchanged')) t group by 1,2""")
def _(v):
    from reconcile.sources import history as sh
    path = work_path(v.spark, "history")
    fresh = sha(cat("kind", "=:", "normalized_key"))
    # The fixture log holds rows without a fingerprint on purpose; give each one.
    old = v.history.withColumn(
        "live_definition_checksum", F.coalesce("live_definition_checksum", fresh))
    sh.append_history(old, path)
    new = pr.metadata_records(v.plan, "repair").withColumn("live_definition_checksum", fresh)
    sh.append_history(new, path, after_id=sh.last_id(old))
    return sh.read_history(v.spark, path).groupBy("kind", "event").agg(
        F.count(F.lit(1)).alias("n"))


_SNAP = f"""select {K}, schema_name, kind, object_name, coalesce(parent_name,'') as parent_name,
 'd1' as layout_digest from catalog"""


@query("i19_publish_snapshot", f"""
{_SNAP} c where database_name in (select m.database_name from manifest m left join catalog c
 on c.database_name=m.database_name and c.normalized_key=m.normalized_key
 group by 1 having count(*)=count(c.doc_id))""")
def _(v):
    rows = sn.snapshot_rows(v.catalog, v.manifest, "d1")
    return sn.publishable_rows(rows, v.manifest)


@query("i19_snapshot_valid", """
select m.database_name, count(*)=count(c.doc_id) as valid from manifest m left join catalog c
 on c.database_name=m.database_name and c.normalized_key=m.normalized_key group by 1""")
def _(v):
    meta = sn.snapshot_meta(sn.snapshot_rows(v.catalog, v.manifest, "d1"))
    return sn.snapshot_valid(meta, v.manifest, "d1")


# Digest of the object paths of the covered manifest, from its three levels.
_COVERED = "(select * from manifest where doc_id%2=1 or doc_id%10<>0)"
_DIGEST = f"""(select sha256(string_agg(d, chr(10) order by bucket)) from (
 select bucket, sha256(string_agg(d, chr(10) order by leaf)) as d from (
 select ('0x'||substr(sha256(path),1,12))::bigint%4096 as bucket,
  ('0x'||substr(sha256(path),1,12))::bigint//4096%4096 as leaf,
  sha256(unhex(string_agg({_LE}||hex(encode(path)), '' order by encode(path)))) as d
 from (select distinct object_path as path from {_COVERED} c) p group by 1,2) l group by 1) b)"""


@query("i19_publish_and_reuse", f"""
select c.database_name, c.normalized_key, c.schema_name, c.kind, c.object_name,
 coalesce(c.parent_name,'') as parent_name, {_DIGEST} as layout_digest
from catalog c where c.database_name='db0'""")
def _(v):
    """Two publishers: one whose catalog covers db0 alone, one whose catalog covers none."""
    path = work_path(v.spark, "snapshots")
    manifest = v.manifest.filter((C("doc_id") % 2 == 1) | (C("doc_id") % 10 != 0))
    cs.publish(v.catalog.filter(C("doc_id") % 14 != 7), manifest, path)
    cs.publish(v.catalog.filter("kind <> 'views'"), manifest, path)
    return cs.reuse(v.spark, path, manifest)


@query("e19_emptiness", """
select count(*)=0 as empty from history""")
def _(v):
    return hs.emptiness(v.history)


@query("e19_empty_databases", """
select database_name, count(*) filter (event='failed' and doc_even)=0 as empty from (
 select m.database_name, h.event, m.doc_id%2=0 as doc_even from manifest m left join history h
 on h.database_name=m.database_name and h.normalized_key=m.normalized_key) t group by 1""")
def _(v):
    """Failed runs on even documents are in one database only; the other one is empty."""
    even = v.manifest.filter(C("doc_id") % 2 == 0).select(*KEY)
    failed = v.history.filter("event = 'failed'").join(even, KEY, "left_semi")
    return hs.empty_databases(v.manifest, failed)
