"""Joins, validation, scope and set operators."""

from pyspark.sql import functions as F

from reconcile.operators import catalog as ct, history as hs, scope as sp, validate as vd
from reconcile.sources import tree
from .registry import query
from .views import cat

C = F.col
K = "database_name, normalized_key"
KEY = ["database_name", "normalized_key"]


@query("c1_duplicate_keys", f"""
select {K}, count(*) as n from (select {K} from manifest union all
 select {K} from delta) t group by 1,2 having count(*)>1""")
def _(v):
    again = v.manifest.join(v.table("labels").select("doc_id"), "doc_id", "left_semi")
    upper = again.withColumn("normalized_key", F.upper("normalized_key"))
    return vd.duplicate_keys(v.manifest.unionByName(upper)).select(*KEY, "n")


@query("c2_duplicate_ordinals", f"""
select {K}, ordinal, count(*) as n from (select {K}, turn//2 as ordinal from turns) t
group by 1,2,3 having count(*)>1""")
def _(v):
    return vd.duplicate_ordinals(
        v._turns.select(*KEY, F.floor(C("turn") / 2).alias("ordinal")))


@query("c3_ambiguous_children", """
select 'db'||cast(l_partkey%2 as string) as database_name,
 'ship/indexes/p'||cast(l_partkey as string) as normalized_key,
 min('s'||cast(l_suppkey%2 as string)) as first_parent,
 max('s'||cast(l_suppkey%2 as string)) as other_parent
from lineitem group by 1,2 having min(l_suppkey%2)<>max(l_suppkey%2)""")
def _(v):
    rows = v.table("lineitem").select(
        cat("=db", C("l_partkey") % 2).alias("database_name"),
        cat("=ship/indexes/p", "l_partkey").alias("normalized_key"),
        F.lit("indexes").alias("kind"), cat("=s", C("l_suppkey") % 2).alias("parent_name"))
    return vd.ambiguous_children(rows)


@query("c4_layout_violations", """
select path, case doc_id%8 when 5 then 'nested_object_path' else 'unknown_kind_folder' end as issue,
 case doc_id%8 when 5 then 'error' else 'warning' end as severity
from tree_files where doc_id%8 in (5,6)""")
def _(v):
    return vd.layout_violations(v.tree_files)


@query("c4_invalid_components", r"""
select database_name||'/'||schema_name||'/'||kind||'/'||case when toxic=1 then 'a\b' else '..' end
 ||'.sql' as path from manifest join labels using (doc_id) where toxic=1 or quality=1""")
def _(v):
    name = F.when(C("toxic") == 1, "a\\b").when(C("quality") == 1, "..").otherwise(C("object_name"))
    path = cat("database_name", "=/", "schema_name", "=/", "kind", "=/", name, "=.sql")
    return vd.invalid_components(
        v.manifest.join(v.table("labels"), "doc_id").select(path.alias("path")))


@query("c4_invalid_script_components", r"""
select case doc_id%4 when 0 then database_name||'/a'||chr(92)||'b/tables/_migrations/'||object_name||'/001_abcdef0_s.sql'
 when 1 then database_name||'/'||schema_name||'/tables/_migrations/../notes.sql'
 else database_name||'/'||schema_name||'/tables/_migrations/'||object_name||'/x'||chr(92)||'.sql' end as path
from manifest where doc_id%4<>3""")
def _(v):
    """Paths in the place of change scripts, most with one bad level."""
    i, place = C("doc_id") % 4, "=/tables/_migrations/"
    path = (F.when(i == 0, cat("database_name", "=/a\\b", place, "object_name", "=/001_abcdef0_s.sql"))
            .when(i == 1, cat("database_name", "=/", "schema_name", place, "=../notes.sql"))
            .when(i == 2, cat("database_name", "=/", "schema_name", place, "object_name", "=/x\\.sql"))
            .otherwise(cat("database_name", "=/", "schema_name", place, "object_name", "=/notes.sql")))
    return vd.invalid_components(v.manifest.select(path.alias("path")))


@query("c5_overlong_paths", """
select path, cast(u as int) as units from (select path, length(path)
 +len(regexp_extract_all(path,'[\\x{10000}-\\x{10FFFF}]')) as u
 from (select 'db/'||source||'/'||text as path from documents) d) t where u>512""")
def _(v):
    return vd.overlong_paths(
        v.table("documents").select(cat("=db/", "source", "=/", "text").alias("path")))


@query("c8_orphan_transitions", """
select c.conv_id, c.turn, m.database_name, m.normalized_key from conversations c
join manifest m on m.doc_id=c.conv_id*7+1 where m.kind<>'tables'""")
def _(v):
    steps = v.table("conversations").withColumn("doc_id", C("conv_id") * 7 + 1).join(
        v.manifest.select("doc_id", *KEY), "doc_id").select("conv_id", "turn", *KEY)
    return vd.orphan_transitions(steps, v.manifest)


@query("c9_changed_since_scan", f"""
select {K}, object_path, normalized_key||case when doc_id%29=0 then ': script not found'
 else ': file changed after scan' end as message from manifest where doc_id%17=0 or doc_id%29=0""")
def _(v):
    text = F.concat("content", F.when(C("doc_id") % 17 == 0, "x").otherwise(""))
    rescan = v.scripts.filter(C("doc_id") % 29 != 0).select("object_path", text.alias("content"))
    return vd.changed_since_scan(v.manifest, rescan)


@query("c10_missing_databases", """
select distinct 'r'||cast(n_nationkey%7 as string) as database_name from nation
where 'r'||cast(n_nationkey%7 as string) not in (select 'r'||cast(r_regionkey as string) from region)""")
def _(v):
    want = v.table("nation").select(cat("=r", C("n_nationkey") % 7).alias("database_name"))
    have = v.table("region").select(cat("=r", "r_regionkey").alias("database_name"))
    return vd.missing_databases(want, have)


@query("d1_scoped_catalog", f"""
select row_kind, database_name, schema_name, kind, object_name from (
 select 'object' as row_kind, c.database_name, c.schema_name, c.kind, c.object_name from catalog c
 join delta d on d.database_name=c.database_name and d.normalized_key=c.normalized_key
 where c.doc_id%13<>0
 union all select distinct 'schema', m.database_name, m.schema_name, '', '' from manifest m
 join delta d on d.database_name=m.database_name and d.normalized_key=m.normalized_key) t""")
def _(v):
    cols = ["row_kind", "database_name", "schema_name", "kind", "object_name", "is_shipped"]
    objects = v.catalog.select(
        F.lit("object").alias("row_kind"), "database_name", F.upper("schema_name").alias(
            "schema_name"), "kind", F.upper("object_name").alias("object_name"),
        (C("doc_id") % 13 == 0).alias("is_shipped")).select(cols)
    everywhere = v.manifest.select("database_name", "schema_name").distinct().select(
        F.lit("schema").alias("row_kind"), "database_name", "schema_name",
        F.lit("").alias("kind"), F.lit("").alias("object_name"), F.lit(False).alias("is_shipped"))
    scope = v.manifest.join(v.delta, KEY, "left_semi")
    return ct.scoped_catalog(objects.unionByName(everywhere), scope).drop("is_shipped")


@query("d2_catalog_parents", """
select m.doc_id as object_id, m.database_name, coalesce(p.object_name,'') as parent_name
from manifest m left join manifest p on m.kind='triggers' and p.doc_id=m.doc_id-60
 and p.database_name=m.database_name""")
def _(v):
    objs = v.manifest.select(
        "database_name", C("doc_id").alias("object_id"), "object_name",
        F.when(C("kind") == "triggers", C("doc_id") - 60).alias("parent_object_id"))
    return ct.catalog_parents(objs).select("object_id", "database_name", "parent_name")


@query("d2_hot_parent", """
select m.doc_id as object_id, m.database_name, coalesce(p.object_name,'') as parent_name
from manifest m left join (select database_name, min(doc_id) as first_id
 from manifest group by database_name) f on f.database_name=m.database_name and m.kind='triggers'
left join manifest p on p.doc_id=f.first_id and p.database_name=m.database_name""")
def _(v):
    # Every trigger of a database hangs on its first object.
    first = v.manifest.groupBy("database_name").agg(F.min("doc_id").alias("first_id"))
    objs = v.manifest.join(first, "database_name").select(
        "database_name", C("doc_id").alias("object_id"), "object_name",
        F.when(C("kind") == "triggers", C("first_id")).alias("parent_object_id"))
    return ct.catalog_parents(objs, spread=True).select("object_id", "database_name", "parent_name")


@query("d3_with_exists", f"select {K}, ex as \"exists\", parent_name from base")
def _(v):
    return ct.with_exists(v.manifest, ct.catalog_facts(v.catalog)).select(
        *KEY, "exists", "parent_name")


@query("d4_with_prior", f"select {K}, prior from base")
def _(v):
    return ct.with_prior(v.manifest, hs.latest_object_history(v.history)).select(*KEY, "prior")


@query("d5_with_parent", f"""
select {K}, parent_name, parent_managed, parent_exists, parent_prior, parent_label from plan""")
def _(v):
    known = ct.with_prior(ct.with_exists(v.manifest, ct.catalog_facts(v.catalog)),
                          hs.latest_object_history(v.history))
    return ct.with_parent(known, known).select(
        *KEY, "parent_name", "parent_managed", "parent_exists", "parent_prior", "parent_label")


@query("d5_with_parent_spread", f"""
select {K}, parent_name, parent_managed, parent_exists, parent_prior, parent_label from plan""")
def _(v):
    known = ct.with_prior(ct.with_exists(v.manifest, ct.catalog_facts(v.catalog)),
                          hs.latest_object_history(v.history))
    return ct.with_parent(known, known, spread=True).select(
        *KEY, "parent_name", "parent_managed", "parent_exists", "parent_prior", "parent_label")


@query("d7_hydrate_parents", f"""
select {K}, kind, case when kind='indexes' then case when doc_id%4<>0 then 'o'||(doc_id-2) end
 else parent_name end as parent_name from catalog""")
def _(v):
    snap = v.catalog.withColumn("parent_name", F.when(C("kind") == "indexes", "").otherwise(
        C("parent_name")))
    live = v.catalog.filter("kind = 'indexes'").select(
        "database_name", F.upper("schema_name").alias("schema_name"),
        F.upper("object_name").alias("object_name"),
        F.when(C("doc_id") % 4 != 0, cat("=o", C("doc_id") - 2)).otherwise("").alias("parent_name"))
    return ct.hydrate_parents(snap, live).select(*KEY, "kind", "parent_name")


@query("d8_table_columns", """
select 'db' as database_name, 'sales/tables/o'||cast(l_orderkey as string) as normalized_key,
 string_agg('c'||l_linenumber||' '||lower(l_returnflag)||' '||(l_linestatus='F'), ','
  order by l_linenumber) as columns
from items where l_orderkey in (select o_orderkey from orders where o_orderstatus='F') group by 1,2""")
def _(v):
    cols = v.items.select(
        F.lit("db").alias("database_name"), F.lit("Sales").alias("schema_name"),
        cat("=O", "l_orderkey").alias("table_name"), cat("=C", "l_linenumber").alias("column_name"),
        F.upper("l_returnflag").alias("type_name"),
        F.when(C("l_linestatus") == "F", "1").otherwise("0").alias("is_nullable"))
    tables = v.table("orders").filter("o_orderstatus = 'F'").select(
        F.lit("db").alias("database_name"), F.lit("tables").alias("kind"),
        cat("=sales/tables/o", "o_orderkey").alias("normalized_key"))
    lists = ct.column_lists(ct.table_columns(cols, tables))
    item = lambda c: F.concat_ws(" ", c["column_name"], c["type_name"], c["nullable"].cast("string"))
    return lists.select(*KEY, F.array_join(F.transform("columns", item), ",").alias("columns"))


@query("d10_ownership", f"""
select coalesce(m.database_name,c.database_name) as database_name,
 coalesce(m.normalized_key,c.normalized_key) as normalized_key,
 case when m.doc_id is not null then 'managed' when h.normalized_key is not null then 'orphaned'
  else 'unmanaged' end as ownership, c.normalized_key is not null as "exists",
 'none' as destructive_action
from manifest m full outer join (select {K} from catalog union all
 select 'db0', 'legacy/views/p'||cast(page_id as string) from pages) c
 on c.database_name=m.database_name and c.normalized_key=m.normalized_key
left join (select {K} from latest union
 select 'db0', 'legacy/views/p'||cast(doc_id as string) from labels) h
 on h.database_name=coalesce(m.database_name,c.database_name)
 and h.normalized_key=coalesce(m.normalized_key,c.normalized_key)""")
def _(v):
    # The pages stand for objects of an older layout that only the server has,
    # some of them with log rows of their own.
    def legacy(table, i):
        return v.table(table).select(
            F.lit("db0").alias("database_name"), cat("=legacy/views/p", i).alias("normalized_key"))

    catalog = v.catalog.select(*KEY).unionByName(legacy("pages", "page_id"))
    history = hs.latest_object_history(v.history).select(*KEY).unionByName(
        legacy("labels", "doc_id"))
    return ct.ownership(v.manifest, catalog, history)


_HITS = r"""
with known as (select object_path as path, normalized_key from manifest
 union all select path, normalized_key from authored),
 want as (select distinct replace(path,'\','/') as path from changed),
 hits as (select k.path, k.normalized_key from want w join known k on k.path=w.path
 union all select k.path, k.normalized_key from want w join known k
  on ends_with(k.path,w.path) or ends_with(w.path,k.path)
  where w.path not in (select path from known)),
 changed_keys as (select distinct string_split(path,'/')[1] as database_name, normalized_key
  from hits)"""
_CLOSURE = _HITS + """, closure as (select database_name, normalized_key from changed_keys union
 select m.database_name, p.normalized_key from changed_keys k
 join manifest m on m.kind='triggers' and m.database_name=k.database_name
  and m.normalized_key=k.normalized_key
 join catalog c on c.database_name=m.database_name and c.normalized_key=m.normalized_key
 join manifest p on p.database_name=m.database_name
  and p.normalized_key=m.schema_name||'/tables/'||c.parent_name)"""


def _changed_keys(v):
    return sp.keys_for_changed_paths(v.manifest, v.authored, v.changed)


@query("d11_keys_for_changed_paths", _HITS + " select * from changed_keys")
def _(v):
    return _changed_keys(v).select(*KEY)


@query("d12_expand_delta", _CLOSURE + " select * from closure")
def _(v):
    return sp.expand_delta(_changed_keys(v), v.manifest, v.catalog).select(*KEY)


@query("i7_git_scope", _CLOSURE + """ select m.database_name, m.normalized_key, m.kind
 from manifest m join closure c on c.database_name=m.database_name
 and c.normalized_key=m.normalized_key""")
def _(v):
    return sp.git_scope(v.manifest, v.authored, v.changed, v.catalog).select(*KEY, "kind")


@query("d13_for_database", """
select 'manifest' as t, database_name, normalized_key from manifest where database_name='db1'
union all select 'transitions', database_name, normalized_key from authored where database_name='db1'
union all select 'parents', database_name, parent_name from catalog where database_name='db1'
 and parent_name is not null""")
def _(v):
    parents = v.catalog.filter(C("parent_name").isNotNull()).select(
        "database_name", C("parent_name").alias("normalized_key"))
    parts = ct.for_database(
        {"manifest": v.manifest, "transitions": v.authored, "parents": parents}, "db1")
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("t"), *KEY)
        out = df if out is None else out.unionByName(df)
    return out


@query("e18_kinds_in_scope", f"""
select distinct kind from manifest m join delta d
 on d.database_name=m.database_name and d.normalized_key=m.normalized_key""")
def _(v):
    return ct.kinds_in_scope(v.manifest, v.delta)


_PIECE = ("upper(printf('%016x', octet_length(encode(path))))")
_LE = "||".join(f"substr({_PIECE},{15 - 2 * i},2)" for i in range(8))


@query("e9_layout_digest", f"""
select sha256(string_agg(d, chr(10) order by bucket)) as layout_digest,
 cast(sum(n) as bigint) as scripts from (
 select bucket, sum(n) as n, sha256(string_agg(d, chr(10) order by leaf)) as d from (
 select ('0x'||substr(sha256(path),1,12))::bigint%256 as bucket,
  ('0x'||substr(sha256(path),1,12))::bigint//256%256 as leaf, count(*) as n,
  sha256(unhex(string_agg({_LE}||hex(encode(path)), '' order by encode(path)))) as d
 from (select distinct path from (select path from tree_files union all select path from authored) f) p
 group by 1,2) l group by 1) b""")
def _(v):
    files = v.tree_files.select("path").unionByName(v.authored.select("path"))
    return sp.layout_digest(files, fan_out=256)


_HOT = f"""
select m.database_name, m.normalized_key, m.kind,
 case when m.kind in ('views','functions','procedures','triggers') or d.snapshot_key is not null
  or l.checksum is null or l.checksum='' or l.checksum<>m.checksum then 'hot' else 'stable' end
  as state
from manifest m left join latest l on l.database_name=m.database_name
 and l.normalized_key=m.normalized_key
left join delta d on d.database_name=m.database_name and d.normalized_key=m.normalized_key"""
_RANK = "||".join(
    f"substr(sha256('d1'||chr(0)||normalized_key),{15 - 2 * i},2)" for i in range(8))
_SPOT = f"""(select database_name, normalized_key, r as spot_rank from (select *, row_number() over
 (partition by database_name order by r, normalized_key) rn from (select database_name,
 normalized_key, {_RANK} as r from hot_rows where state='stable') a) b where rn<=8)"""


@query("g3_spot_check", f"with hot_rows as ({_HOT}) select * from {_SPOT} s")
def _(v):
    rows = sp.hot_or_stable(v.manifest, v.delta, hs.latest_object_history(v.history))
    return sp.spot_check(rows.filter("state = 'stable'"), "d1")


@query("i6_inspect_scope", f"""with hot_rows as ({_HOT}) select h.database_name, h.normalized_key,
 h.kind, case when s.spot_rank is not null then 'hot' else h.state end as state from hot_rows h
 left join {_SPOT} s on s.database_name=h.database_name and s.normalized_key=h.normalized_key""")
def _(v):
    return sp.inspect_scope(v.manifest, v.delta, hs.latest_object_history(v.history), "d1")


@query("i6_scope_verdict", f"""with hot_rows as ({_HOT}) select database_name,
 count(*) filter (state='hot') as hot, count(*) as total, count(*)=count(*) filter (state='hot')
 as full_inspect, count(*) filter (state='hot')=0 as allow_cache from hot_rows group by 1""")
def _(v):
    return sp.scope_verdict(
        sp.hot_or_stable(v.manifest, v.delta, hs.latest_object_history(v.history)))


@query("i17_choose_changed", r"""
select 'git-merge-base' as source, replace(path,'\','/') as path from (select case
 when starts_with(path,'repo/sql/') then substr(path,10) else path end as path from changed) t""")
def _(v):
    none = v.changed.select(F.lit("env-changed-files").alias("source"),
                            F.lit(None).cast("string").alias("path"))
    rows = none.unionByName(
        v.changed.select(F.lit("git-merge-base").alias("source"), "path")
    ).unionByName(v.changed.select(F.lit("git-head").alias("source"), "path"))
    return sp.choose_changed(rows, "repo/sql/")


_UNION_COLS = ["database_name", "schema_name", "kind", "object_name"]


@query("h1_union_catalog", """
select database_name, schema_name, kind, object_name from catalog where kind not in ('types')
union all select distinct database_name, schema_name, '', '' from manifest""")
def _(v):
    pick = lambda cond: v.catalog.filter(cond).select(_UNION_COLS)
    parts = {
        "schemas": v.manifest.select("database_name", "schema_name").distinct().select(
            "database_name", "schema_name", F.lit("").alias("kind"),
            F.lit("").alias("object_name")),
        "objects": pick(~C("kind").isin("types", "indexes")),
        "types": pick(C("kind") == "types"),
        "indexes": pick(C("kind") == "indexes"),
    }
    return ct.union_catalog(parts, ["tables", "views", "indexes"])


@query("h2_merge_stable", f"""
select {K}, 'loaded' as src from delta union all select c.database_name, c.normalized_key, 'stable'
from catalog c where c.database_name||'/'||c.normalized_key not in (select snapshot_key from delta)""")
def _(v):
    loaded = v.delta.select(*KEY, F.lit("loaded").alias("src"))
    return ct.merge_stable(loaded, v.catalog.select(*KEY, F.lit("stable").alias("src")))


@query("h5_schema_actions", "select * from schemas")
def _(v):
    return ct.schema_actions(v.manifest, v.schemas_on_server)


@query("a2_classify_paths", """
select path, case doc_id%8 when 1 then 'transition' when 3 then 'check' when 4 then 'check'
 when 0 then 'object' when 7 then 'object' else 'ignored' end as script_kind from tree_files""")
def _(v):
    return tree.classify_paths(v.tree_files.select("path"))


@query("a12_discover_databases", "select distinct database_name from manifest")
def _(v):
    hidden = v.tree_files.select(cat("=.git/", "path").alias("path"))
    top = v.table("region").select(cat("=top", "r_regionkey", "=/x.sql").alias("path"))
    files = v.tree_files.select("path").unionByName(hidden).unionByName(top)
    return tree.discover_databases(files)


