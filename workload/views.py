"""Reconciliation-shaped views derived from the driver tables.

The driver tables hold documents, events and orders, not database objects, so
each view derives manifest-, catalog- or history-shaped rows from all rows of
its tables.  Arithmetic on ids decides what a derived row looks like (which
kind, which key is missing on the server), never which input is read.
``SQL`` states the same views for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reconcile import KEY
from reconcile.functions import paths
from reconcile.operators import history as hs
from reconcile.plans.reconciliation import compute_plan

MARK = paths.SCAFFOLD_MARK


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def cat(*parts) -> Column:
    """Concatenate columns and literal strings ('=x' is the literal x)."""
    return F.concat(*[
        F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else text(p) for p in parts
    ])


KINDS = [
    "types", "sequences", "tables", "synonyms", "indexes", "views", "functions", "procedures",
    "triggers",
]


class Views:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    @cached_property
    def n_docs(self) -> int:
        return self.table("documents").count()

    @cached_property
    def scripts(self) -> DataFrame:
        """Manifest with the script text."""
        kind = F.element_at(
            F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 9 + 1).cast("int")
        )
        db = cat("=db", F.col("doc_id") % 2)
        d = self.table("documents").withColumn("kind", kind)
        key = cat("source", "=/", "kind", "=/o", "doc_id")
        return d.select(
            "doc_id",
            db.alias("database_name"),
            F.col("source").alias("schema_name"),
            "kind",
            cat("=o", "doc_id").alias("object_name"),
            key.alias("normalized_key"),
            cat(db, "=/", key, "=.sql").alias("object_path"),
            sha(F.col("text")).alias("checksum"),
            F.col("text").alias("content"),
        )

    @property
    def manifest(self) -> DataFrame:
        return self.scripts.drop("content")

    @cached_property
    def catalog(self) -> DataFrame:
        i = F.col("doc_id")
        trig = F.col("kind") == "triggers"
        parent = F.when(trig & (i % 5 == 3), "gone").when(
            trig & (i >= 60) & (i % 4 != 0), cat("=o", i - 60)
        )
        live = sha(F.concat("kind", F.lit(":"), "content", F.when(i % 17 == 0, "x").otherwise("")))
        return self.scripts.filter(i % 10 != 0).select(
            "database_name", "schema_name", "kind", "object_name", "normalized_key",
            parent.alias("parent_name"), live.alias("live_checksum"), "doc_id",
        )

    def live(self, keys: DataFrame) -> DataFrame:
        """Fingerprints of ``keys`` alone: joined first, hashed after."""
        i = F.col("doc_id")
        there = self.scripts.filter(i % 10 != 0).select(*KEY, "doc_id", "kind", "content")
        parts = F.concat("kind", F.lit(":"), "content", F.when(i % 17 == 0, "x").otherwise(""))
        return there.join(keys, KEY, "left_semi").select(*KEY, sha(parts).alias("live_checksum"))

    @property
    def _events_on_docs(self) -> DataFrame:
        return self.table("events").withColumn("doc_id", F.col("event_id") % self.n_docs)

    @cached_property
    def history(self) -> DataFrame:
        e = F.col("event_id")
        # Texts are digested before the join, once per document.
        docs = self.scripts.select(
            "doc_id", "database_name", "normalized_key", "checksum",
            sha(F.concat("kind", F.lit(":"), "content")).alias("live"),
            sha(cat("=stale", "normalized_key")).alias("stale"),
        )
        checksum = (
            F.when(e % 11 == 0, "").when(e % 7 == 0, F.col("stale")).otherwise(F.col("checksum"))
        )
        live = F.when(e % 13 != 0, F.col("live"))
        event = (
            F.when(F.col("event_type") == "click", "adopted")
            .when(F.col("event_type") == "error", "failed")
            .otherwise("applied")
        )
        return self._events_on_docs.join(docs, "doc_id").select(
            e.alias("id"), "database_name", "normalized_key", F.lit("object").alias("kind"),
            checksum.alias("checksum"), live.alias("live_definition_checksum"),
            e.alias("applied_ddl_version"), event.alias("event"), F.col("ts").alias("created_at"),
        )

    @property
    def ddl_events(self) -> DataFrame:
        rows = self._events_on_docs.filter(F.col("event_type") == "error")
        return rows.join(self.manifest, "doc_id").select(
            "database_name", "normalized_key", F.col("event_id").alias("ddl_version"),
            F.col("ts").alias("updated_at"),
        )

    @cached_property
    def object_ddl(self) -> DataFrame:
        return hs.object_ddl(self.ddl_events)

    @property
    def _turns(self) -> DataFrame:
        c = self.table("conversations").filter(
            ~((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0))
        )
        return c.withColumn("doc_id", F.col("conv_id") * 9 + 2).join(
            self.manifest.select(
                "doc_id", "database_name", "normalized_key", "schema_name", "object_name"
            ),
            "doc_id",
        )

    @cached_property
    def transitions(self) -> DataFrame:
        return self._turns.select(
            "database_name", "normalized_key", (F.col("turn") + 1).alias("ordinal")
        ).distinct()

    @cached_property
    def authored(self) -> DataFrame:
        """Change scripts with path and checksum."""
        one = self._turns.groupBy(
            "conv_id", "turn", "database_name", "normalized_key", "schema_name", "object_name"
        ).agg(F.min("text").alias("content"))
        ordinal = F.lpad((F.col("turn") + 1).cast("string"), 3, "0")
        path = cat(
            "database_name", "=/", "schema_name", "=/tables/_migrations/", "object_name", "=/",
            ordinal, "=_", F.substring(sha(F.col("content")), 1, 7), "=_step.sql",
        )
        return one.select(
            "conv_id", "turn", "database_name", "normalized_key", ordinal.alias("ordinal"),
            path.alias("path"), sha(F.col("content")).alias("checksum"),
        )

    @cached_property
    def migration_log(self) -> DataFrame:
        """Two audit rows per change script, the first one outdated."""
        c, key = F.col("conv_id"), F.col("path")
        step = F.explode(F.array(F.lit(0), F.lit(1)))
        rows = self.authored.withColumn("step", step)
        checksum = (
            F.when(F.col("step") == 0, sha(cat("=old", key)))
            .when(c % 5 == 0, "")
            .when(c % 5 == 1, sha(cat("=edited", key)))
            .otherwise(F.col("checksum"))
        )
        event = F.when(c % 7 == 0, "failed").otherwise("applied")
        return rows.select(
            (c * 1000 + F.col("turn") * 2 + F.col("step")).alias("id"), "database_name",
            key.alias("normalized_key"), F.lit("migration").alias("kind"),
            checksum.alias("checksum"), event.alias("event"),
        )

    @cached_property
    def tree_files(self) -> DataFrame:
        """Script paths of every shape a tree can hold."""
        i = F.col("doc_id")
        db, s, k, o = "database_name", "schema_name", "kind", "object_name"
        shapes = [
            cat(db, "=/", s, "=/", k, "=/", o, "=.sql"),
            cat(db, "=/", s, "=/tables/_migrations/", o, "=/001_abcdef0_step.sql"),
            cat(db, "=/", s, "=/tables/_migrations/", o, "=/01_abc_bad.sql"),
            cat(db, "=/checks/", o, "=.sql"),
            cat(db, "=/", s, "=/checks/", o, "=.SQL"),
            cat(db, "=/", s, "=/old/", k, "=/", o, "=.sql"),
            cat(db, "=/", s, "=/widgets/", o, "=.sql"),
            cat(db, "=/", s, "=/", k, "=/", o, "=.SQL"),
        ]
        path = shapes[-1]
        for n, shape in enumerate(shapes[:-1]):
            path = F.when(i % 8 == n, shape).otherwise(path)
        return self.manifest.select("doc_id", path.alias("path"))

    @cached_property
    def commit_touch(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = self.table("lineitem").select(
            "l_orderkey", (F.col("l_partkey") % self.n_docs).alias("doc_id")
        )
        return (
            orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
            .join(self.manifest.select("doc_id", "object_path"), "doc_id")
            .select(
                F.col("o_orderkey").alias("commit_id"),
                cat("=author", "o_custkey").alias("author"),
                F.col("o_orderdate").alias("committed_at"),
                "object_path",
            )
        )

    @property
    def commits(self) -> DataFrame:
        """Touches in the provenance operators' columns."""
        return self.commit_touch.select(
            "object_path", cat("=c", "commit_id").alias("git_hash"),
            F.col("author").alias("git_author"), cat("=t", "commit_id").alias("git_date"),
            "committed_at", "commit_id",
        )

    @cached_property
    def items(self) -> DataFrame:
        """Line items folded to one row per line number, which repeats in an order."""
        return self._items(self.table("lineitem"))

    @cached_property
    def items_by_order(self) -> DataFrame:
        """The same with an order's items in one task: one exchange serves the fold and what follows by order."""
        return self._items(self.table("lineitem").repartition("l_orderkey"))

    @staticmethod
    def _items(lines: DataFrame) -> DataFrame:
        # Flags are folded as code points, which keeps the aggregation hashed.
        numbers = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")]
        flags = [F.char(F.min(F.ascii(c))).alias(c) for c in ("l_returnflag", "l_linestatus")]
        return lines.groupBy("l_orderkey", "l_linenumber").agg(*numbers, *flags)

    @cached_property
    def phase_runs(self) -> DataFrame:
        run = F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("actual")
        return self.table("events").groupBy(
            run.alias("run"), cat("=scenario", F.col("user_id") % 4).alias("scenario"),
            F.col("event_type").alias("phase"),
        ).agg(F.floor(F.sum("value")).cast("bigint").alias("ms"))

    def _snapshot(self, skip: int, current: bool) -> DataFrame:
        i = F.col("doc_id")
        action = F.when((i % 9).isin(5, 6, 7, 8), "update_existing_module").otherwise(
            "skip_unchanged"
        )
        checksum = F.col("checksum")
        if current:
            action = F.when(i % 23 == 0, "fail").otherwise(action)
            checksum = F.when(i % 19 == 0, sha(checksum)).otherwise(checksum)
        return self.manifest.filter(i % skip != 0).select(
            cat("database_name", "=/", "normalized_key").alias("snapshot_key"), "object_path",
            action.alias("planned_action"), checksum.alias("checksum_hex"),
            (i % 10 != 0).alias("exists"),
        )

    @property
    def snapshot_base(self) -> DataFrame:
        return self._snapshot(29, False)

    @property
    def snapshot_cur(self) -> DataFrame:
        return self._snapshot(31, True)

    @property
    def delta(self) -> DataFrame:
        """Keys of labelled documents, the declared change set of the gate."""
        keys = self.manifest.join(self.table("labels").select("doc_id"), "doc_id", "left_semi")
        return keys.select(
            "database_name", "normalized_key",
            cat("database_name", "=/", "normalized_key").alias("snapshot_key"),
        )

    @property
    def changed(self) -> DataFrame:
        """Changed paths in several spellings, from labels and change scripts."""
        p = F.col("object_path")
        tail = F.translate(cat("normalized_key", "=.sql"), "/", "\\")
        spelled = F.when(F.col("toxic") == 1, tail).when(
            F.col("quality") == 1, p
        ).otherwise(cat("=repo/sql/", p))
        rows = self.table("labels").join(self.manifest, "doc_id").select(spelled.alias("path"))
        steps = self.authored.filter(F.col("ordinal") == "002")
        return rows.unionByName(
            steps.select(F.when(F.col("conv_id") % 2 == 0, F.col("path"))
                         .otherwise(cat("=x/", "path")).alias("path"))
        )

    @cached_property
    def plan(self) -> DataFrame:
        return compute_plan(
            self.manifest, self.catalog, self.history, self.object_ddl, self.transitions,
            self.live,
        )

    @property
    def schemas_on_server(self) -> DataFrame:
        return self.catalog.filter(F.col("kind") == "views").select(
            "database_name", "schema_name"
        ).distinct()

    @property
    def runs_wide(self) -> DataFrame:
        """Per-database run timings, one row per order."""
        k = F.col("o_orderkey")
        ms = {
            c: (k % (j + 3)).cast("bigint")
            for j, c in enumerate([
                "connect_ms", "parallel_wall_ms", "ensure_ms", "checksums_ms", "inspect_ms",
                "diff_ms", "apply_ms", "plan_db_query_ms", "plan_db_query_calls",
            ])
        }
        path = F.element_at(
            F.array(*[F.lit(x) for x in ("", "cold_full", "incremental", "git_delta")]),
            (k % 4 + 1).cast("int"),
        )
        return self.table("orders").select(
            F.col("o_orderpriority").alias("command"), k.alias("seq"),
            *[c.alias(n) for n, c in ms.items()],
            (k % 50 + 20).cast("bigint").alias("plan_wall_ms"),
            (k % 3 == 0).alias("l1_cache_hit"), path.alias("plan_db_path"),
        )

    def reports(self, run: int) -> DataFrame:
        """Apply reports per customer, from even or odd orders."""
        s = F.col("o_orderstatus")
        return self.table("orders").filter(F.col("o_orderkey") % 2 == run).groupBy(
            cat("=c", "o_custkey").alias("scenario")
        ).agg(
            F.count_if(s == "F").alias("applied"), F.count_if(s == "O").alias("skipped"),
            F.count_if(s == "P").alias("failed"), F.count(F.lit(1)).alias("audit_object_rows"),
            F.max(F.col("o_orderkey") % 4).alias("m"),
        ).select(
            "scenario", "applied", "failed", "skipped", "audit_object_rows",
            F.lit(0).cast("bigint").alias("audit_migration_rows"),
            F.lit(1).cast("bigint").alias("catalog_meta_rows"),
            F.col("m").alias("catalog_cache_rows"),
            F.when(F.col("failed") > 0, F.array(cat("=e", "failed"))).otherwise(
                F.array().cast("array<string>")
            ).alias("errors"),
            F.array(F.lit("setup")).alias("setup_steps"),
        )

    @property
    def stacks(self) -> DataFrame:
        """Allocation points: one per order, its line items are the stack."""
        lines = self.items.select(
            "l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).cast("int").alias("f"),
            F.col("l_quantity").cast("bigint").alias("q"),
        )
        return lines.groupBy(F.col("l_orderkey").alias("point_id")).agg(
            F.sum("q").alias("bytes"),
            F.transform(
                F.sort_array(F.collect_list(F.struct("l_linenumber", "f"))), lambda x: x["f"]
            ).alias("frames"),
        )

    @property
    def frames(self) -> DataFrame:
        """Frame texts, derived from the parts; indexes 38 and 39 have none."""
        words = [
            "bench_loop", "bench_warm", "bench_setup", "HashMap", "insert", "compute_diff",
            "decide_object", "transitions", "Vec push", "String clone", "main", "other",
        ]
        f = F.col("frame_id")
        word = F.element_at(F.array(*[F.lit(w) for w in words]), (f % 12 + 1).cast("int"))
        ids = self.table("part").select(
            (F.col("p_partkey") % 40).cast("int").alias("frame_id")
        ).distinct().filter(f < 38)
        return ids.select("frame_id", cat("=0xa", f, "=: own::", word, "= (f.rs:", f, "=)")
                          .alias("frame"))

    @property
    def table_scripts(self) -> DataFrame:
        """One table script per part, its columns varying with the part."""
        p = F.col("p_partkey")
        body = cat(
            "=CREATE TABLE dbo.p", p, "= ( -- main, columns\n  [id] INT NOT NULL,\n  size",
            F.col("p_size") % 3, "= DECIMAL(10,", F.col("p_size") % 5,
            "=) NULL,\n  brand NVARCHAR(50) DEFAULT ('a,b'),\n",
            F.when(p % 2 == 0, "  total AS (id * 2),\n").otherwise("  note [TEXT] ,\n"),
            "=  CONSTRAINT pk PRIMARY KEY (id)\n)",
        )
        return self.table("part").select(
            cat("=db", p % 2).alias("database_name"),
            cat("=dbo/tables/p", p).alias("normalized_key"), F.lit("tables").alias("kind"),
            body.alias("content"), "p_partkey", "p_size",
        )

    @property
    def live_columns(self) -> DataFrame:
        """Columns the server has for those tables."""
        p = F.col("p_partkey")
        rows = F.array(
            F.struct(F.lit("id").alias("c"), F.lit("int").alias("t"), F.lit(False).alias("n")),
            F.struct(
                F.when(p % 3 == 0, "gone").otherwise("brand").alias("c"),
                F.lit("nvarchar").alias("t"), F.lit(True).alias("n"),
            ),
        )
        return self.table("part").select(
            cat("=db", p % 2).alias("database_name"),
            cat("=dbo/tables/p", p).alias("normalized_key"), F.explode(rows).alias("r"),
        ).select(
            "database_name", "normalized_key", F.col("r.c").alias("column_name"),
            F.col("r.t").alias("type_name"), F.col("r.n").alias("nullable"),
        )


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL.

_EVENTS = ("(select e0.*, e0.event_id % q.n as did from events e0 cross join "
           "(select count(*) as n from documents) q)")

SQL: dict[str, str] = {
    "manifest": """
select doc_id, 'db'||cast(doc_id%2 as string) as database_name, source as schema_name, kind,
 'o'||cast(doc_id as string) as object_name,
 source||'/'||kind||'/o'||cast(doc_id as string) as normalized_key,
 'db'||cast(doc_id%2 as string)||'/'||source||'/'||kind||'/o'||cast(doc_id as string)||'.sql'
   as object_path,
 sha256(text) as checksum
from (select *, case doc_id%9 when 0 then 'types' when 1 then 'sequences' when 2 then 'tables'
 when 3 then 'synonyms' when 4 then 'indexes' when 5 then 'views' when 6 then 'functions'
 when 7 then 'procedures' else 'triggers' end as kind from documents) d""",
    "catalog": """
select m.database_name, m.schema_name, m.kind, m.object_name, m.normalized_key,
 case when m.kind='triggers' and m.doc_id%5=3 then 'gone'
  when m.kind='triggers' and m.doc_id>=60 and m.doc_id%4<>0
  then 'o'||cast(m.doc_id-60 as string) end as parent_name,
 sha256(m.kind||':'||d.text||case when m.doc_id%17=0 then 'x' else '' end) as live_checksum,
 m.doc_id
from manifest m join documents d on d.doc_id=m.doc_id where m.doc_id%10<>0""",
    "history": f"""
select e.event_id as id, m.database_name, m.normalized_key, 'object' as kind,
 case when e.event_id%11=0 then '' when e.event_id%7=0 then sha256('stale'||m.normalized_key)
  else m.checksum end as checksum,
 case when e.event_id%13=0 then null else sha256(m.kind||':'||d.text) end
  as live_definition_checksum,
 e.event_id as applied_ddl_version,
 case e.event_type when 'click' then 'adopted' when 'error' then 'failed' else 'applied' end
  as event, e.ts as created_at
from {_EVENTS} e join manifest m on m.doc_id = e.did join documents d on d.doc_id=m.doc_id""",
    "ddl_events": f"""
select m.database_name, m.normalized_key, e.event_id as ddl_version
from {_EVENTS} e join manifest m on m.doc_id = e.did where e.event_type='error'""",
    "object_ddl": """
select database_name, normalized_key, max(ddl_version) as ddl_version from ddl_events group by 1,2""",
    "turns": """
select c.conv_id, c.turn, c.text, m.database_name, m.normalized_key, m.schema_name, m.object_name
from conversations c join manifest m on m.doc_id=c.conv_id*9+2
where not (c.turn=0 and c.conv_id%3=0)""",
    "transitions": """
select distinct database_name, normalized_key, turn+1 as ordinal from turns""",
    "authored": """
select conv_id, turn, database_name, normalized_key, lpad(cast(turn+1 as string),3,'0') as ordinal,
 database_name||'/'||schema_name||'/tables/_migrations/'||object_name||'/'||
 lpad(cast(turn+1 as string),3,'0')||'_'||substr(sha256(content),1,7)||'_step.sql' as path,
 sha256(content) as checksum
from (select conv_id, turn, database_name, normalized_key, schema_name, object_name,
 min(text) as content from turns group by all) t""",
    "migration_log": """
select conv_id*1000+turn*2+step as id, database_name, path as normalized_key, 'migration' as kind,
 case when step=0 then sha256('old'||path) when conv_id%5=0 then ''
  when conv_id%5=1 then sha256('edited'||path) else checksum end as checksum,
 case when conv_id%7=0 then 'failed' else 'applied' end as event
from authored cross join (select unnest([0,1]) as step) s""",
    "tree_files": """
select doc_id, case doc_id%8
 when 0 then database_name||'/'||schema_name||'/'||kind||'/'||object_name||'.sql'
 when 1 then database_name||'/'||schema_name||'/tables/_migrations/'||object_name||'/001_abcdef0_step.sql'
 when 2 then database_name||'/'||schema_name||'/tables/_migrations/'||object_name||'/01_abc_bad.sql'
 when 3 then database_name||'/checks/'||object_name||'.sql'
 when 4 then database_name||'/'||schema_name||'/checks/'||object_name||'.SQL'
 when 5 then database_name||'/'||schema_name||'/old/'||kind||'/'||object_name||'.sql'
 when 6 then database_name||'/'||schema_name||'/widgets/'||object_name||'.sql'
 else database_name||'/'||schema_name||'/'||kind||'/'||object_name||'.SQL' end as path
from manifest""",
    "commit_touch": """
select o.o_orderkey as commit_id, 'author'||cast(o.o_custkey as string) as author,
 o.o_orderdate as committed_at, m.object_path
from orders o join lineitem l on l.l_orderkey=o.o_orderkey
cross join (select count(*) as n from documents) q join manifest m on m.doc_id = l.l_partkey % q.n""",
    "commits": """
select object_path, 'c'||commit_id as git_hash, author as git_author, 't'||commit_id as git_date
from (select object_path, commit_id, author, row_number() over (partition by object_path
 order by committed_at desc, commit_id desc) rn
 from (select distinct commit_id, author, committed_at, object_path from commit_touch) x) t
where rn=1""",
    "phase_runs": """
select case when event_id%2=0 then 'baseline' else 'actual' end as run,
 'scenario'||cast(user_id%4 as string) as scenario, event_type as phase,
 cast(floor(sum(value)) as bigint) as ms from events group by 1,2,3""",
    "snapshot_base": """
select database_name||'/'||normalized_key as snapshot_key, object_path,
 case when doc_id%9 in (5,6,7,8) then 'update_existing_module' else 'skip_unchanged' end
  as planned_action, checksum as checksum_hex, doc_id%10<>0 as exists_flag
from manifest where doc_id%29<>0""",
    "snapshot_cur": """
select database_name||'/'||normalized_key as snapshot_key, object_path,
 case when doc_id%23=0 then 'fail' when doc_id%9 in (5,6,7,8) then 'update_existing_module'
  else 'skip_unchanged' end as planned_action,
 case when doc_id%19=0 then sha256(checksum) else checksum end as checksum_hex,
 doc_id%10<>0 as exists_flag from manifest where doc_id%31<>0""",
    "delta": """
select database_name, normalized_key, database_name||'/'||normalized_key as snapshot_key
from manifest where doc_id in (select doc_id from labels)""",
    "changed": r"""
select case when l.toxic=1 then replace(m.normalized_key||'.sql','/','\')
 when l.quality=1 then m.object_path else 'repo/sql/'||m.object_path end as path
from labels l join manifest m on m.doc_id=l.doc_id
union all
select case when conv_id%2=0 then path else 'x/'||path end from authored where ordinal='002'""",
    "latest": """
select database_name, normalized_key, id, checksum, live_definition_checksum, applied_ddl_version
from (select *, row_number() over (partition by database_name, normalized_key order by id desc) rn
 from history where kind='object' and event in ('applied','adopted')) t where rn=1""",
    "flagged": """
select l.*, l.applied_ddl_version is null or coalesce(o.ddl_version,0)>l.applied_ddl_version
 as suspect
from latest l left join object_ddl o
 on o.database_name=l.database_name and o.normalized_key=l.normalized_key""",
    "drifted": """
select f.*, case when coalesce(length(f.checksum),0)<>64 then false
 when f.live_definition_checksum is null then true when not f.suspect then false
 when c.live_checksum is null then true
 else f.live_definition_checksum<>c.live_checksum end as drift
from flagged f left join catalog c
 on c.database_name=f.database_name and c.normalized_key=f.normalized_key""",
    "base": """
select m.*, c.normalized_key is not null as ex, c.parent_name, nullif(d.checksum,'') as prior,
 coalesce(d.drift,false) as drift, coalesce(t.n,0) as ntr
from manifest m
left join catalog c on c.database_name=m.database_name and c.normalized_key=m.normalized_key
left join drifted d on d.database_name=m.database_name and d.normalized_key=m.normalized_key
left join (select database_name, normalized_key, count(*) n from transitions group by 1,2) t
 on t.database_name=m.database_name and t.normalized_key=m.normalized_key""",
    "plan": """
select b.*, p.object_name as parent_label, p.normalized_key is not null as parent_managed,
 p.ex as parent_exists, p.prior as parent_prior,
 case when not b.ex then 'create' when b.prior is null then 'adopt'
 when b.drift then case when b.kind in ('views','functions','procedures','triggers')
  then 'module_update' else 'live_structural_drift_blocked' end
 when b.prior=b.checksum then 'skip_unchanged'
 when b.kind='tables' then case when b.ntr=0 then 'table_blocked_no_transitions'
  else 'table_reprocess' end
 when b.kind='triggers' and b.parent_name is not null then
  case when p.normalized_key is null or not p.ex then 'trigger_blocked_parent_missing'
   when p.prior is null then 'trigger_blocked_parent_changing' else 'trigger_update_module' end
 when b.kind in ('views','functions','procedures','triggers') then 'module_update'
 else 'structural_change_blocked' end as scenario
from base b left join base p on p.database_name=b.database_name
 and p.normalized_key=b.schema_name||'/tables/'||b.parent_name""",
    "attrs": """
select *, case scenario when 'create' then 'create_object' when 'adopt' then 'adopt_existing'
 when 'skip_unchanged' then 'skip_unchanged' when 'table_reprocess' then 'reprocess_changed'
 when 'trigger_update_module' then 'update_existing_module'
 when 'module_update' then 'update_existing_module'
 when 'structural_change_blocked' then 'fail' when 'live_structural_drift_blocked' then 'fail'
 else 'reprocess_changed_blocked' end as planned_action,
 case scenario when 'create' then 'create' when 'adopt' then 'adopt'
 when 'skip_unchanged' then 'skip' else 'changed' end as counter,
 scenario like '%blocked%' as blocked, scenario<>'skip_unchanged' as needs_provenance,
 case scenario
 when 'table_blocked_no_transitions' then
  'table '||normalized_key||' changed but has no non-scaffold transition scripts'
 when 'structural_change_blocked' then
  normalized_key||' changed but this object kind has no safe in-place update path'
 when 'live_structural_drift_blocked' then
  'live '||normalized_key||' differs from its last audited structural state'
 when 'trigger_blocked_parent_missing' then
  'trigger '||normalized_key||' parent table '||coalesce(parent_label,'?')||' not found'
 when 'trigger_blocked_parent_changing' then
  'trigger '||normalized_key||' parent table '||coalesce(parent_label,'?')||' is changing'
 end as message from plan""",
    "schemas": """
select w.database_name, w.schema_name,
 case when h.schema_name is null then 'create_schema' else 'exists' end as action
from (select distinct database_name, schema_name from manifest) w
left join (select distinct database_name, schema_name from catalog where kind='views') h
 on h.database_name=w.database_name and h.schema_name=w.schema_name""",
    "log_last": """
select database_name, normalized_key as path, checksum as recorded from (select *, row_number()
 over (partition by database_name, normalized_key order by id desc) rn
 from migration_log where event='applied') t where rn=1""",
    "due_steps": """
select a.database_name, a.normalized_key, a.path, a.checksum, l.recorded
from authored a join attrs p on p.database_name=a.database_name
 and p.normalized_key=a.normalized_key and p.planned_action='reprocess_changed'
left join log_last l on l.database_name=a.database_name and l.path=a.path""",
    "runs_wide": """
select o_orderpriority as command, o_orderkey as seq, o_orderkey%3 as connect_ms,
 o_orderkey%4 as parallel_wall_ms, o_orderkey%5 as ensure_ms, o_orderkey%6 as checksums_ms,
 o_orderkey%7 as inspect_ms, o_orderkey%8 as diff_ms, o_orderkey%9 as apply_ms,
 o_orderkey%10 as plan_db_query_ms, o_orderkey%11 as plan_db_query_calls,
 o_orderkey%50+20 as plan_wall_ms, o_orderkey%3=0 as l1_cache_hit,
 case o_orderkey%4 when 0 then '' when 1 then 'cold_full' when 2 then 'incremental'
  else 'git_delta' end as plan_db_path from orders""",
    "reports": """
select o_orderkey%2 as run, 'c'||cast(o_custkey as string) as scenario,
 count(*) filter (o_orderstatus='F') as applied, count(*) filter (o_orderstatus='O') as skipped,
 count(*) filter (o_orderstatus='P') as failed, count(*) as audit_object_rows,
 max(o_orderkey%4) as catalog_cache_rows from orders group by 1,2""",
    "items": """
select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey,
 min(l_returnflag) as l_returnflag, min(l_linestatus) as l_linestatus, min(l_quantity) as l_quantity
from lineitem group by 1,2""",
    "stack_rows": """
select l_orderkey as point_id, l_linenumber as pos, cast(l_partkey%40 as int) as frame_id,
 sum(cast(l_quantity as bigint)) over (partition by l_orderkey) as bytes from items""",
    "frames": """
select frame_id, '0xa'||frame_id||': own::'||(['bench_loop','bench_warm','bench_setup','HashMap',
 'insert','compute_diff','decide_object','transitions','Vec push','String clone','main','other'])
 [frame_id%12+1]||' (f.rs:'||frame_id||')' as frame
from (select distinct cast(p_partkey%40 as int) as frame_id from part) p where frame_id<38""",
    "file_columns": """
select 'db'||cast(p_partkey%2 as string) as database_name,
 'dbo/tables/p'||cast(p_partkey as string) as normalized_key, u.i as ordinal,
 case u.i when 0 then 'id' when 1 then 'size'||cast(p_size%3 as string) when 2 then 'brand'
  else 'note [text' end as column_name,
 case u.i when 0 then 'INT' when 1 then 'DECIMAL(10,'||cast(p_size%5 as string)||')'
  when 2 then 'NVARCHAR(50) DEFAULT (''A,B'')' else '' end as type_name,
 u.i<>0 as nullable
from part cross join (select unnest([0,1,2,3]) as i) u where u.i<3 or p_partkey%2=1""",
    "live_columns": """
select 'db'||cast(p_partkey%2 as string) as database_name,
 'dbo/tables/p'||cast(p_partkey as string) as normalized_key,
 case when u.i=0 then 'id' when p_partkey%3=0 then 'gone' else 'brand' end as column_name,
 case when u.i=0 then 'int' else 'nvarchar' end as type_name, u.i=1 as nullable
from part cross join (select unnest([0,1]) as i) u""",
    "column_diff": """
select f.database_name, f.normalized_key, f.column_name, f.ordinal, f.type_name, f.nullable,
 'new' as change from file_columns f where not exists (select 1 from live_columns d
 where d.database_name=f.database_name and d.normalized_key=f.normalized_key
 and d.column_name=f.column_name)
union all
select d.database_name, d.normalized_key, d.column_name, null, d.type_name, d.nullable, 'dropped'
from live_columns d where not exists (select 1 from file_columns f
 where d.database_name=f.database_name and d.normalized_key=f.normalized_key
 and d.column_name=f.column_name)""",
    "additive": """
select database_name, normalized_key, count(*) filter (change='new') as added,
 count(*) filter (change='dropped') as dropped,
 bool_and(change<>'new' or (length(type_name)>0 and length(type_name)<=128
  and not regexp_matches(type_name, '[;\\[\\]''"\\r\\n]')
  and column_name not like '%/%')) as safe
from column_diff group by 1,2""",
}

_ORDER = list(SQL)


def oracle(body: str) -> str:
    """``body`` preceded by the views it uses, directly or through others."""
    import re

    need: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "''", todo.pop())))
        for name in SQL:
            if name in words and name not in need:
                need.add(name)
                todo.append(SQL[name])
    ctes = ", ".join(f"{n} as ({SQL[n].strip()})" for n in _ORDER if n in need)
    if not ctes:
        return body
    if body.lstrip().lower().startswith("with "):
        return f"with {ctes}, {body.lstrip()[5:]}"
    return f"with {ctes} {body}"
