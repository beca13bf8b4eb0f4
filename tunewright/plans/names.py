"""Names in model constructors, layers and compile calls resolved to what reaches them.

Every bare-name argument is a reference with a path: ``0``, ``1`` for positions, a keyword's name, ``0.units`` for the
argument of a layer that ``.add`` is given, ``metrics.0`` for an item of a list of metrics.  A reference takes the latest
literal assigned to its name before it in the notebook's walk (an as-of by notebook and name).  With ``chains`` names
assigned from names (``k = n``) are definitions too: each points to the definition that reached it, and pointer
doubling follows all chains at once, in as many rounds as the longest chain has binary digits.

Assignments of other expressions define nothing: they leave the name's value as it was.  A reference that nothing
reaches keeps the name itself as a text.  Windows are by (notebook, name), joins by position: a task holds the
assignments of one name of a notebook.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from ..sources.cells import fx_cells_load, fx_cells_load_sql, fx_cells_refs, fx_cells_refs_sql
from .corpus import MODEL_KEYWORDS, discover_tables, model_records, scan_events
from .registry import register

PLACE = ["notebook", "cell_index", "dfs"]


def references(events: DataFrame) -> DataFrame:
    """(notebook, cell_index, dfs, path, name) of every name that a model, a layer or a compile call is given."""
    calls = events.filter((F.col("scan") == "models") & (F.col("kind") == "call") & (
        F.col("func").isin(*MODEL_KEYWORDS)
        | (F.col("op") == "attr") & (F.col("layer").isNotNull() | (F.col("func") == "compile"))))
    return calls.select(*PLACE, F.explode("refs").alias("r")).select(*PLACE, "r.path", "r.name")


def _asof(defs: DataFrame, reads: DataFrame) -> DataFrame:
    """``reads`` (with notebook, name, cell_index, dfs) with ``d``: the definition of the name that comes last before."""
    extra = [c for c in reads.columns if c not in (*PLACE, "name")]
    d = F.struct("cell_index", "dfs", "name", "value", "plain")
    u = defs.select(*PLACE, "name", F.lit(0).alias("is_ref"), d.alias("d"),
                    *[F.lit(None).cast(reads.schema[c].dataType).alias(c) for c in extra]).unionByName(
        reads.select(*PLACE, "name", *extra, F.lit(1).alias("is_ref")), allowMissingColumns=True)
    # a read comes before a definition at its own place (k = k)
    w = (Window.partitionBy("notebook", "name").orderBy("cell_index", "dfs", F.col("is_ref").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return u.withColumn("d", F.last("d", ignorenulls=True).over(w)).filter("is_ref = 1").drop("is_ref")


def definitions(events: DataFrame, chains: bool = False) -> DataFrame:
    """(notebook, cell_index, dfs, name, value, plain) of every assignment; value is null where a chain ends in a
    name that has no value."""
    ev = events.filter(F.col("scan") == "models")
    lits = ev.filter(F.col("kind") == "literal").select(
        *PLACE, "name", F.col("args")["value"].alias("value"), F.col("args")["plain"].alias("plain"))
    if not chains:
        return lits
    none = F.lit(None).cast("string")
    alias = ev.filter(F.col("kind") == "alias").select(
        *PLACE, F.col("name").alias("own"), F.col("args")["of"].alias("name"))
    every = lits.unionByName(alias.select(*PLACE, F.col("own").alias("name"), none.alias("value"),
                                          none.alias("plain")))
    to = F.when(F.col("d.value").isNull(), F.struct(F.col("d.cell_index"), F.col("d.dfs"), F.col("d.name")))
    ptr = F.when(F.col("d").isNotNull(), to)
    cur = _asof(every, alias).select(*PLACE, F.col("own").alias("name"), F.col("d.value").alias("value"),
                                     F.col("d.plain").alias("plain"), ptr.alias("ptr"))
    while True:
        cur = reliable_checkpoint(cur)
        if cur.filter("value is null and ptr is not null").isEmpty():
            return lits.unionByName(cur.drop("ptr"))
        there = cur.select(F.col("notebook").alias("nb2"), F.col("cell_index").alias("c2"), F.col("dfs").alias("d2"),
                           F.col("name").alias("n2"), F.col("value").alias("v2"), F.col("plain").alias("p2"),
                           F.col("ptr").alias("ptr2"))
        cur = cur.join(there, (F.col("notebook") == F.col("nb2")) & (F.col("ptr.cell_index") == F.col("c2"))
                       & (F.col("ptr.dfs") == F.col("d2")) & (F.col("ptr.name") == F.col("n2")), "left").select(
            *PLACE, "name", F.coalesce("value", "v2").alias("value"), F.coalesce("plain", "p2").alias("plain"),
            F.when(F.coalesce("value", "v2").isNull(), F.col("ptr2")).alias("ptr"))


def resolve_names(events: DataFrame, chains: bool = False) -> DataFrame:
    """``references`` with value (JSON) and plain (as printed)."""
    got = _asof(definitions(events, chains), references(events))
    return got.select(*PLACE, "path", "name",
                      F.coalesce("d.value", F.concat(F.lit('"'), F.col("name"), F.lit('"'))).alias("value"),
                      F.coalesce("d.plain", "name").alias("plain"))


def resolve_calls(events: DataFrame, chains: bool = False) -> DataFrame:
    """The events with every name in arguments, layers and metrics replaced by what reaches it."""
    names = resolve_names(events, chains).groupBy(*PLACE).agg(  # of one call: its few arguments
        F.map_from_entries(F.collect_list(F.struct("path", F.struct("value", "plain")))).alias("_res"),
        F.lit("models").alias("scan"))
    ev = events.join(names, [*PLACE, "scan"], "left")

    def got(path: Column, field: str, old: Column) -> Column:
        return F.coalesce(F.element_at("_res", path)[field], old)

    here = F.col("_res").isNotNull()
    args = F.transform_values("args", lambda k, v: got(k, "value", v))
    items = F.transform("items", lambda v, i: got(F.concat(F.lit("metrics."), i.cast("string")), "value", v))
    listed = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    args = F.transform_values(args, lambda k, v: F.when((k == "metrics") & F.col("items").isNotNull(), listed)
                              .otherwise(v))
    kinds = F.transform_values("arg_kinds", lambda k, v: F.when(F.map_contains_key("_res", k), "lit").otherwise(v))
    pos = F.transform("pos_args", lambda v, i: got(i.cast("string"), "value", v))
    parts = F.transform("layer_args", lambda a, i: F.concat(
        F.coalesce(F.concat(a["key"], F.lit("=")), F.lit("")),
        got(F.concat(F.lit("0."), F.coalesce(a["key"], i.cast("string"))), "plain", a["value"])))
    layer = F.concat(F.col("layer_func"), F.lit("("), F.array_join(parts, ", "), F.lit(")"))
    new = {"args": args, "arg_kinds": kinds, "pos_args": pos, "items": items, "layer": layer}
    return ev.select(*[F.when(here, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
                       for c in events.columns])


# ----------------------------------------------------------------------------- queries

REFS_SQL = "with " + fx_cells_refs_sql() + """,
 w0 as (select *,
   last_value(case when kind = 0 then cast(p_size as varchar) end ignore nulls) over w n,
   last_value(case when kind = 2 then 'a' || cast(p_size % 4 as varchar) end ignore nulls) over w act,
   last_value(case when kind in (3, 5) then cell_index end ignore nulls) over w m_cell,
   last_value(case when kind in (3, 5) then kind end ignore nulls) over w m_kind
   from crf window w as (partition by notebook order by cell_index rows between unbounded preceding and current row)),
 w1 as (select *, last_value(case when kind = 1 then coalesce(n, '?') end ignore nulls) over w k from w0
   window w as (partition by notebook order by cell_index rows between unbounded preceding and current row)),
 v as (select * exclude (k), nullif(k, '?') k,
   nullif(last_value(case when kind = 6 then coalesce(k, '?') end ignore nulls) over w, '?') j from w1
   window w as (partition by notebook order by cell_index rows between unbounded preceding and current row))
"""


@register("literal_asof_positional", REFS_SQL + """
 select notebook, cell_index, path, r.name, coalesce(direct, '"' || r.name || '"') "value",
   coalesce(chained, '"' || r.name || '"') chained
 from (select notebook, cell_index, unnest([
     {'kind': 5, 'path': '0', 'name': 'j', 'direct': null::varchar, 'chained': j},
     {'kind': 5, 'path': '1', 'name': 'n', 'direct': n, 'chained': n},
     {'kind': 5, 'path': 'C', 'name': 'k', 'direct': null::varchar, 'chained': k},
     {'kind': 4, 'path': '0.0', 'name': 'n', 'direct': n, 'chained': n},
     {'kind': 4, 'path': '0.activation', 'name': 'act', 'direct': '"' || act || '"', 'chained': '"' || act || '"'},
     {'kind': 6, 'path': 'optimizer', 'name': 'act', 'direct': '"' || act || '"', 'chained': '"' || act || '"'},
     {'kind': 6, 'path': 'metrics.0', 'name': 'act', 'direct': '"' || act || '"', 'chained': '"' || act || '"'}
   ], recursive := true), v.kind own from v) r
 where own = kind""")
def q_literal_asof_positional(spark: SparkSession, sf: str) -> DataFrame:
    """J4 for every argument, by the latest literal and through chains of names."""
    ev = scan_events(fx_cells_refs(spark, sf))
    direct = resolve_names(ev).select(*PLACE, "path", "name", "value")
    chained = resolve_names(ev, chains=True).select(*PLACE, "path", F.col("value").alias("chained"))
    return direct.join(chained, [*PLACE, "path"]).drop("dfs")


@register("model_layers_resolved", REFS_SQL + r""",
 l as (select notebook, m_cell cell_index, string_agg('Dense(' || coalesce(n, 'n') || ', activation='
     || coalesce(act, 'act') || ')', ', ' order by cell_index) layers
   from v where kind = 4 and m_kind = 3 group by all),
 c as (select notebook, m_cell cell_index, arg_max(coalesce(act, 'act'), cell_index) opt
   from v where kind = 6 and m_cell is not null group by all)
 select notebook, cell_index, case kind when 3 then 'Sequential' else 'LogisticRegression' end model_type,
   case kind when 3 then coalesce('["[' || layers || ']"]', '[]')
     else '["' || coalesce(j, '\"j\"') || '","' || coalesce(n, '\"n\"') || '"]' end args_json,
   '{' || concat_ws(',', case kind when 5 then '"C":' || coalesce(k, '"k"') end,
     '"optimizer":"' || opt || '","metrics":["' || opt || '", "mae"]') || '}' kwargs_json
 from v left join l using (notebook, cell_index) left join c using (notebook, cell_index) where kind in (3, 5)""")
def q_model_layers_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Model records whose positional, layer and compile arguments are resolved through chains of names."""
    m = model_records(resolve_calls(scan_events(fx_cells_refs(spark, sf)), chains=True))
    kw = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("kwargs"), lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    return m.select("notebook", "cell_index", "model_type", "args_json", kw.alias("kwargs_json"))


@register("discover_tables_fallback", "with " + fx_cells_load_sql() + """,
 e as (select notebook, arg_max(case when kind = 0 then p_brand || '.csv' end, case when kind = 0 then cell_index end)
     path, bool_or(kind = 0) own, bool_or(kind = 1 and p_size % 3 = 0) df_test, bool_or(kind = 1 and p_size % 3 = 1)
     x_train, arg_max(p_type || '.csv', case when kind = 1 and p_size % 3 = 2 then cell_index end) test_path,
     bool_or(kind = 1 and p_size % 3 = 2) tst
   from cld where kind < 2 group by notebook),
 f as (select *, own and tst complete from e)
 select notebook,
   case when not complete and x_train then 'X_train' when own then 'my_train' end train_var,
   case when not complete and x_train then null when own then path end train_path,
   case when complete then 'my_test' when df_test then 'df_test' when tst then 'my_test' end test_var,
   case when complete then test_path when df_test then null when tst then test_path end test_path
 from f""")
def q_discover_tables_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A9 with the usual names where a notebook's own names do not say which table is which."""
    return discover_tables(fx_cells_load(spark, sf), fallback=True)
