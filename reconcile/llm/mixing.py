"""Mixing sources to target weights through a tree of domains, languages, sources.

The token budget flows from the root to the leaves. At every node it is split by
the children's weights; a child that can't use its share (all its tokens, times
the allowed epochs) returns the rest to its siblings, and only what no child can
use was never given to the node, since a node's capacity is that of its subtree.
Each leaf then takes its budget as whole epochs and a prefix of one more epoch,
in an order seeded by epoch and document.

Scale: budgets are window functions over one row per leaf. A leaf's running sum
is two-level: sums of 4096 hash buckets place each bucket, rows are ordered
inside their bucket only, so a source with a third of all rows is spread over
4096 window partitions. Only ids and token counts are shuffled.

Arithmetic is exact: capacities, weights and budgets are integers; shares are
rounded down, which leaves fewer tokens than there are nodes unused.

Defined cases: null source or language is a child named ``unknown``; null text
has no tokens; documents without tokens come along with whole epochs and with a
prefix that reaches past them; repeated rows count as often as they occur; rows
without doc_id take part. A budget above all capacities takes everything. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Target weights; children that aren't listed weigh ``OTHER``.
DOMAIN_WEIGHTS = {"web": 50, "books": 30, "forum": 20}
LANGUAGE_WEIGHTS = {"en": 40, "de": 20, "fr": 20, "es": 20}
SOURCE_WEIGHTS: dict[str, int] = {}
OTHER = 10
#: Share of all tokens the mixture takes, in percent; passes over a leaf at most; seed.
BUDGET_PERCENT, EPOCHS, SEED = 60, 2, "mix-1"

WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """Domain of a source by its number: 0-7 web, 8-13 books, others forum."""
    number = F.regexp_extract(source, r"^src([0-9]{1,9})$", 1)
    n = F.when(number != "", number.cast("int"))
    return F.when(n <= 7, "web").when(n <= 13, "books").when(n.isNotNull(), "forum").otherwise("unknown")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(OTHER)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("long")


def _split(children: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Share ``budget`` of each parent among its children by weight and ``capacity``.

    In order of capacity per weight, children below the level of the rest are
    filled and the remaining ones get their weight's share of what is left.
    """
    w = children.withColumn("__w", _weight(name, weights)).withColumn("__ratio", F.col("capacity").cast("double") / F.col("__w"))
    order = Window.partitionBy(*parent).orderBy("__ratio", name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumns({
        "__left": F.greatest(F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0)),
        "__weights": F.sum("__w").over(after),
    })
    w = w.withColumn("__full", F.expr("capacity <= (__w * __left) div __weights"))
    # the level is set by the first child that isn't filled
    whole = Window.partitionBy(*parent)
    first = F.min(F.when(~F.col("__full"), F.struct("__ratio", name, "__left", "__weights"))).over(whole)
    w = w.withColumn("__first", first)
    share = F.expr("(__w * __first.__left) div __first.__weights")
    filled = F.col("__first").isNull() | (F.struct("__ratio", name) < F.struct(F.col("__first.__ratio"), F.col(f"__first.{name}")))
    return w.withColumn("budget", F.when(filled, F.col("capacity")).otherwise(F.least(share, "capacity"))).drop("__w", "__ratio", "__left", "__weights", "__full", "__first")


def budgets(leaves: DataFrame, budget: Column) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, capacity) with their budget."""
    languages = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = languages.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    root = domains.withColumn("budget", F.least(budget, F.sum("capacity").over(Window.partitionBy(F.lit(0)))))
    given = _split(root.withColumn("root", F.lit(0)), ["root"], "domain", DOMAIN_WEIGHTS).select("domain", "budget")
    given = _split(languages.join(given, "domain"), ["domain"], "lang", LANGUAGE_WEIGHTS).select("domain", "lang", "budget")
    return _split(leaves.join(given, ["domain", "lang"]), ["domain", "lang"], "source", SOURCE_WEIGHTS)


def tokens_of(docs: DataFrame) -> DataFrame:
    """doc_id, key, domain, lang, source, n_tokens of each row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("key"),
        domain_of(F.col("source")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


LEAF = ["domain", "lang", "source"]


def select(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, key, domain, lang, source, epoch, n_tokens, take_tokens of all chosen rows."""
    from .components import written

    rows = written(tokens_of(docs), "mix-tokens")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    given = budgets(leaves, F.lit(total * budget_percent // 100).cast("long")).where("budget > 0")
    given = written(
        given.select(*LEAF, F.expr("cast(budget div tokens as int)").alias("whole"), F.expr("budget % tokens").alias("rest")),
        "mix-budgets",
    )
    drawn = rows.join(given, LEAF).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    drawn = drawn.where((F.col("epoch") < F.col("whole")) | (F.col("rest") > 0))
    full = drawn.where("epoch < whole").withColumn("take_tokens", F.col("n_tokens"))
    last = drawn.where("epoch = whole").withColumn(
        "draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string")))
    )
    last = last.withColumn("bucket", F.substring("draw", 1, 3))
    sums = last.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEAF, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*LEAF, "bucket").orderBy("draw", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        last.join(sums, [*LEAF, "bucket"])
        .where("before < rest")
        .withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where("start < rest")
        .withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("rest") - F.col("start")))
    )
    columns = ["doc_id", "key", *LEAF, "epoch", "n_tokens", "take_tokens"]
    return full.select(columns).union(last.select(columns))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The chosen documents, all columns kept, once per epoch they are chosen in.

    The last document of a leaf's prefix comes whole. Rows that repeat doc_id and
    text come together.
    """
    from .components import free

    row, key = free(docs, "__row"), free(docs, "__key")
    chosen = select(docs, **how).select(F.col("key").alias(key), F.col("epoch").alias(free(docs, "__epoch"))).distinct()
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return keyed.join(chosen, F.col(row) == F.col(key)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")


def _case(column: str, weights: dict[str, int]) -> str:
    return "case " + column + "".join(f" when '{n}' then {w}" for n, w in weights.items()) + f" else {OTHER} end" if weights else str(OTHER)


def _sql_split(out: str, children: str, parent: str, name: str, weights: dict[str, int]) -> str:
    over = f"partition by {parent} order by ratio, {name}"
    return f"""
{out}_w as (select *, capacity::double / w as ratio from (select *, {_case(name, weights)} as w from ({children}) c) x),
{out}_l as (select *, greatest(budget - coalesce(sum(capacity) over ({over} rows between unbounded preceding and 1 preceding), 0), 0)::bigint as room,
  (sum(w) over ({over} rows between current row and unbounded following))::bigint as weights from {out}_w),
{out}_f as (select *, capacity <= (w * room) // weights as filled, row_number() over ({over}) as k from {out}_l),
{out}_s as (select *, min(case when not filled then k end) over (partition by {parent}) as level_k from {out}_f),
{out}_v as (select *, max(case when k = level_k then room end) over (partition by {parent}) as level_room,
  max(case when k = level_k then weights end) over (partition by {parent}) as level_weights from {out}_s),
{out} as (select * exclude (budget), case when level_k is null or k < level_k then capacity else least((w * level_room) // level_weights, capacity) end as budget from {out}_v),"""


ORACLE = f"""
with n as (select doc_id, case when nr <= 7 then 'web' when nr <= 13 then 'books' when nr is not null then 'forum' else 'unknown' end as domain,
  coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source, n_tokens
  from (select *, try_cast(nullif(regexp_extract(source, '^src([0-9]{{1,9}})$', 1), '') as int) as nr,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents) d),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {EPOCHS})::bigint as capacity from n group by all),
languages as (select domain, lang, sum(capacity)::bigint as capacity from leaves group by all),
domains as (select 0 as root, domain, sum(capacity)::bigint as capacity from languages group by all),
total as (select (sum(tokens)::bigint * {BUDGET_PERCENT}) // 100 as budget, sum(capacity)::bigint as capacity from leaves),
{_sql_split("d", "select x.*, least(t.budget, t.capacity) as budget from domains x, total t", "root", "domain", DOMAIN_WEIGHTS)}
{_sql_split("l", "select x.*, d.budget from languages x join d using (domain)", "domain", "lang", LANGUAGE_WEIGHTS)}
{_sql_split("s", "select x.*, l.budget from leaves x join l using (domain, lang)", "domain, lang", "source", SOURCE_WEIGHTS)}
given as (select domain, lang, source, (budget // tokens)::int as whole, (budget % tokens)::bigint as rest from s where budget > 0),
drawn as (select n.*, g.whole, g.rest, unnest(range(0, g.whole + 1))::int as epoch from n join given g using (domain, lang, source)),
part as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source
    order by md5(concat_ws(':', '{SEED}', epoch, doc_id, n_tokens)), doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from drawn where epoch = whole and rest > 0)
select doc_id, domain, lang, source, epoch, n_tokens, n_tokens as take_tokens from drawn where epoch < whole
union all
select doc_id, domain, lang, source, epoch, n_tokens, least(n_tokens, rest - start) from part where start < rest
"""
