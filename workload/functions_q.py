"""Column functions over whole tables."""

from pyspark.sql import functions as F

from reconcile.functions import checksums as ck, kinds as kd, paths, text as tx
from reconcile.plans.reconciliation import scenario_attrs
from .registry import query
from .views import cat

C = F.col


@query("b1_normalized_key", """
select doc_id, lower(upper(schema_name)||'/'||kind||'/'||upper(object_name)) as k from manifest""")
def _(v):
    return v.manifest.select("doc_id", paths.normalized_key(
        F.upper("schema_name"), C("kind"), F.upper("object_name")).alias("k"))


@query("b2_key_from_path", """
select doc_id, case when len(p)>=4 then lower(p[-3]||'/'||p[-2]||'/'||p[-1]) end as k
from (select doc_id, string_split(regexp_replace(path,'(\\.sql)+$',''),'/') as p from tree_files) t""")
def _(v):
    return v.tree_files.select("doc_id", paths.key_from_path(C("path")).alias("k"))


@query("b3_split_key", """
select doc_id, schema_name as s, kind as k, object_name||'/'||lang as o
from manifest join documents using (doc_id)""")
def _(v):
    m = v.manifest.join(v.table("documents").select("doc_id", "lang"), "doc_id")
    p = paths.split_key(cat("normalized_key", "=/", "lang"))
    return m.select("doc_id", p["schema_name"].alias("s"), p["kind"].alias("k"),
                    p["object_name"].alias("o"))


@query("b4_normalize_paths", r"""
select doc_id, case doc_id%5 when 4 then null else object_path end as p from manifest""")
def _(v):
    p, i = C("object_path"), C("doc_id") % 5
    raw = (F.when(i == 0, cat("=sql/", p)).when(i == 1, cat("=repo/sql/", p))
           .when(i == 2, cat("=  repo\\sql\\", F.translate(p, "/", "\\"), "=  "))
           .when(i == 3, p).otherwise("  "))
    return v.manifest.select("doc_id", paths.normalize_path(raw, "repo/sql/").alias("p"))


@query("b5_changed_csv", """
select doc_id, p from manifest cross join (select unnest([0,1]) as i) u
cross join lateral (select case when u.i=0 then object_path else normalized_key end as p) x""")
def _(v):
    csv = cat("= ", "object_path", "= ,,", F.translate("normalized_key", "/", "\\"), "=, ")
    return v.manifest.select("doc_id", F.explode(paths.parse_changed_csv(csv)).alias("p"))


@query("b6_path_candidates", """
select doc_id, p from (
 select doc_id, unnest(case doc_id%3
  when 0 then [object_path, normalized_key||'.sql']
  when 1 then ['/'||normalized_key||'.sql', object_path]
  else [normalized_key] end) as p from manifest) t""")
def _(v):
    i, p = C("doc_id") % 3, C("object_path")
    db = F.when(i == 2, "").otherwise(C("database_name"))
    raw = F.when(i == 0, p).when(i == 1, cat("=/", "normalized_key", "=.sql")).otherwise(
        C("normalized_key"))
    return v.manifest.select("doc_id", F.explode(paths.path_candidates(db, raw)).alias("p"))


@query("b7_strip_sql_ext", """
select doc_id, case doc_id%4 when 0 then object_name when 1 then object_name
 when 2 then object_name||'.sqlx' else object_name end as n from manifest""")
def _(v):
    ext = F.element_at(F.array(F.lit(".sql"), F.lit(".SqL"), F.lit(".sqlx"), F.lit("")),
                       (C("doc_id") % 4 + 1).cast("int"))
    return v.manifest.select("doc_id", paths.strip_sql_ext(cat("object_name", ext)).alias("n"))


@query("b8_content_checksum", """
select doc_id, sha256(text||chr(13)) as c from documents""")
def _(v):
    crlf = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r"))
    d = v.table("documents")
    return d.select("doc_id", ck.content_checksum(crlf).alias("c"))


@query("b8_content_checksum_bytes", "select doc_id, sha256(text) as c from documents")
def _(v):
    raw = F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8")
    return v.table("documents").select("doc_id", ck.content_checksum_bytes(raw).alias("c"))


_LABELS = list(kd.TYPE_LABELS) + ["clr_trigger", "internal_table"]
_FOLDERS = [kd.TYPE_LABELS.get(x, x) for x in _LABELS]


@query("b9_kind_from_type_desc", f"""
select doc_id, ({_FOLDERS!r})[doc_id%{len(_LABELS)}+1] as kind from documents""")
def _(v):
    label = F.element_at(F.array(*[F.lit(x.upper()) for x in _LABELS]),
                         (C("doc_id") % len(_LABELS) + 1).cast("int"))
    return v.table("documents").select("doc_id", kd.kind_from_type_desc(label).alias("kind"))


@query("b10_kind_code", """
select doc_id, case when doc_id%10=0 then 0 else cast(doc_id%9+1 as int) end as code,
 doc_id%10<>0 and doc_id%9>=5 as module, doc_id%10<>0 and doc_id%9<5 as tx from documents""")
def _(v):
    k = F.when(C("doc_id") % 10 == 0, "queues").otherwise(C("kind"))
    return v.manifest.select("doc_id", kd.kind_code(k).alias("code"),
                             kd.is_module(k).alias("module"), kd.is_transactional(k).alias("tx"))


@query("b11_kind_rank", """
select doc_id, cast(case when doc_id%10=0 then 99 else doc_id%9 end as int) as r from documents""")
def _(v):
    k = F.when(C("doc_id") % 10 == 0, "queues").otherwise(C("kind"))
    return v.manifest.select("doc_id", kd.kind_rank(k).alias("r"))


@query("b12_parse_transition", r"""
select doc_id, case when ok then lower(p[-5]||'/tables/'||p[-2]) end as k,
 case when ok then regexp_extract(p[-1], '^(\d{3})_', 1) end as ordinal,
 case when ok then 'abcdef0' end as commit_hash, case when ok then 'step' end as slug
from (select doc_id, p, len(p)>=6 and p[-4]='tables' and p[-3]='_migrations'
 and regexp_matches(p[-1], '^\d{3}_[0-9a-fA-F]{7,}_.+\.sql$') as ok
 from (select doc_id, string_split(path,'/') as p from tree_files) a) b""")
def _(v):
    t = paths.parse_transition(C("path"))
    return v.tree_files.select("doc_id", t["normalized_key"].alias("k"),
                               t["ordinal"].alias("ordinal"), t["commit"].alias("commit_hash"),
                               t["slug"].alias("slug"))


@query("b13_is_scaffold", """
select conv_id, turn, role, conv_id%3=0 and turn%2=0 as s from conversations""")
def _(v):
    mark = F.when((C("conv_id") % 3 == 0) & (C("turn") % 2 == 0), paths.SCAFFOLD_MARK + "\r\n")
    text = F.concat(F.coalesce(mark, F.lit("--\n" + paths.SCAFFOLD_MARK + "\n")), "text")
    return v.table("conversations").select("conv_id", "turn", "role",
                                           paths.is_scaffold(text).alias("s"))


@query("b14_name_checks", r"""
select 'd'||doc_id as id, text<>'' and text not in ('.','..') and position('/' in text)=0
  and position('\' in text)=0 as component,
 regexp_full_match(text,'[A-Za-z0-9_-]+') as token,
 text<>'' and text not in ('.','..') and position('/' in text)=0 and position('\' in text)=0
  and length(text)<=128 as ident from documents
union all select 'p'||p_partkey, position('/' in p_name)=0, regexp_full_match(p_name,'[A-Za-z0-9_-]+'),
 position('/' in p_name)=0 and length(p_name)<=128 from part""")
def _(v):
    rows = v.table("documents").select(cat("=d", "doc_id").alias("id"), C("text").alias("n"))
    rows = rows.unionByName(
        v.table("part").select(cat("=p", "p_partkey").alias("id"), C("p_name").alias("n")))
    n = C("n")
    return rows.select("id", paths.valid_component(n).alias("component"),
                       paths.valid_token(n).alias("token"), paths.valid_ident(n).alias("ident"))


@query("b15_decode_checksum", f"""
select id, case id%4 when 3 then null else case when checksum='' then '{ck.ZERO_DIGEST}'
 else checksum end end as value, id%4<>3 as valid from history""")
def _(v):
    c, i = C("checksum"), C("id") % 4
    raw = F.when(i == 1, F.upper(c)).when(i == 2, F.concat(F.lit(" "), c, F.lit(" "))).when(
        i == 3, F.concat(F.lit("zz"), c)).otherwise(c)
    d = ck.decode_checksum(raw)
    return v.history.select("id", d["value"].alias("value"), d["valid"].alias("valid"))


@query("b16_parse_commit_date", """
select o_orderkey, case o_orderkey%3 when 0 then '1900-01-01 00:00:00'
 when 1 then '1900-01-01 00:00:00'
 else '2021-0'||(o_orderkey%9+1)||'-1'||(o_orderkey%10)||' 0'||(o_orderkey%10)||':00:00' end as d
from orders""")
def _(v):
    k = C("o_orderkey")
    good = cat("=2021-0", k % 9 + 1, "=-1", k % 10, "=T0", k % 10, "=:00:00")
    raw = F.when(k % 3 == 0, " ").when(k % 3 == 1, "yesterday").otherwise(good)
    d = F.date_format(ck.parse_commit_date(raw), "yyyy-MM-dd HH:mm:ss")
    return v.table("orders").select("o_orderkey", d.alias("d"))


_PLAN = "database_name, normalized_key, scenario"


@query("b17_scenario_attrs", f"""
select {_PLAN}, planned_action, counter, blocked, needs_provenance from attrs""")
def _(v):
    return scenario_attrs(v.plan.select("database_name", "normalized_key", "scenario")).select(
        "database_name", "normalized_key", "scenario", "planned_action", "counter", "blocked",
        "needs_provenance")


@query("b18_blocker_message", f"select {_PLAN}, message from attrs where message is not null")
def _(v):
    return v.plan.select("database_name", "normalized_key", "scenario", "message").filter(
        C("message").isNotNull())


@query("b19_source_identity", """
select c_custkey, octet_length(encode(c_name))||'~'||c_name||'~'||c_nationkey||'~'||c_mktsegment
 ||'~db' as s from customer""")
def _(v):
    return v.table("customer").select("c_custkey", ck.source_identity(
        C("c_name"), C("c_nationkey").cast("string"), C("c_mktsegment"), F.lit("db")).alias("s"))


@query("b20_scaffold_identity", r"""
select path, regexp_replace(string_split(path,'/')[-1], '^([^_]*)_[0-9a-fA-F]{1,40}_(.*)$',
 '\1_REV_\2') as s from (select path from authored union all select path from tree_files) t""")
def _(v):
    rows = v.authored.select("path").unionByName(v.tree_files.select("path"))
    return rows.select("path", tx.scaffold_identity(C("path")).alias("s"))


@query("b21_decode_nullable", """
select l_orderkey, l_linenumber, case l_linenumber%5 when 0 then true when 1 then false
 when 2 then true when 3 then false else true end as n from lineitem""")
def _(v):
    i = C("l_linenumber") % 5
    raw = (F.when(i == 0, "1").when(i == 1, "0").when(i == 2, "true").when(i == 3, "no"))
    return v.table("lineitem").select("l_orderkey", "l_linenumber",
                                      tx.decode_nullable(raw).alias("n"))


_DELTA = """case when b is null and a is null then 'n/a' when coalesce(a,0)=coalesce(b,0) then '='
 else case when a0<b0 then '-' else '+' end||abs(a0-b0)||'ms'||case when b0=0 then '' else
 ' ('||case when a0<b0 then '-' else '+' end
 ||cast(round_even(abs((a0-b0)::double/b0*100),0) as bigint)||'%)' end end"""


@query("b22_delta_text", f"""
select user_id, event_type, {_DELTA} as d from (select *, coalesce(a,0) as a0, coalesce(b,0) as b0
 from (select user_id, event_type,
 cast(floor(sum(value) filter (event_id%2=0)) as bigint) as b,
 cast(floor(sum(value) filter (event_id%2=1)) as bigint) as a from events group by 1,2) x) y""")
def _(v):
    side = lambda r: F.floor(F.sum(F.when(C("event_id") % 2 == r, C("value")))).cast("bigint")
    rows = v.table("events").groupBy("user_id", "event_type").agg(
        side(0).alias("b"), side(1).alias("a"))
    return rows.select("user_id", "event_type", tx.delta_ms_text(C("b"), C("a")).alias("d"))


@query("i2_drift_ladder", """
select database_name, normalized_key, drift from drifted""")
def _(v):
    from reconcile.operators import drift as dr, history as hs
    flagged = dr.suspects(hs.latest_object_history(v.history), v.object_ddl)
    return dr.drift(flagged, v.catalog).select("database_name", "normalized_key", "drift")


@query("i3_resolve_scenario", f"select {_PLAN} from plan")
def _(v):
    return v.plan.select("database_name", "normalized_key", "scenario")


