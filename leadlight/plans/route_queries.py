"""Queries over route-solver output, with results made from orders and their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlight.plans.registry import register
from leadlight.sources.routes import flatten_solved, read_routes, route_counts, route_nodes
from leadlight.sources.storage import folder, stored


def solver_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, json) of a solver's result for every order, nested two or four levels deep.

    An order is made from its items in one reaction; every second item is made from its supplier in another.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    mol = lambda name, stocked, *more: F.struct(F.lit("mol").alias("type"), name.alias("smiles"), stocked.alias("in_stock"), *more)
    text_of = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    text = lambda letter, c: text_of(letter, F.col(c))

    def item(x: F.Column) -> F.Column:
        made = F.array(F.struct(F.lit("reaction").alias("type"), F.array(mol(text_of("S", x["l_suppkey"]), F.lit(True))).alias("children")))
        return mol(text_of("P", x["l_partkey"]), x["l_returnflag"] == "N", F.when(x["l_linenumber"] % 2 == 0, made).alias("children"))

    children = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), item).alias("items"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(children, "o_orderkey")
    reaction = F.array(F.struct(F.lit("reaction").alias("type"), F.col("items").alias("children")))
    first = F.to_json(mol(text("O", "o_orderkey"), F.lit(False), reaction.alias("children")))
    second = F.to_json(mol(text("Q", "o_orderkey"), F.lit(True)))
    known = F.when(F.col("o_orderkey") % 2 == 0, F.size("items"))
    facts = F.struct(
        F.col("o_orderkey").alias("row_index"), text("O", "o_orderkey").alias("target"), (F.col("o_orderstatus") == "F").alias("is_solved"), (F.col("o_orderkey") % 100 / 100).alias("top_score"), F.lit(2).alias("number_of_routes"),
        (F.col("o_orderkey") % 3).alias("number_of_solved_routes"), (F.col("o_custkey") / 8).alias("search_time"), F.lit(6).alias("max_transforms"), known.alias("number_of_steps"),
    )
    whole = F.concat(F.expr("substring(facts, 1, length(facts) - 1)"), F.lit(',"trees":['), first, F.lit(","), second, F.lit("]}"))
    return orders.withColumn("facts", F.to_json(facts)).select(F.col("o_orderkey").alias("key"), whole.alias("json"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solver_output(spark, sf_dir).select(F.col("key").alias("row_index"), F.parse_json("json").alias("v"))


def written_output(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a third of the results as JSON lines, a third in arrays, a third under ``data`` of table-oriented objects."""
    path, results = folder(spark, "solver"), stored(solver_output(spark, sf_dir), "solved")  # three writers read it
    kind = F.col("key") % 3
    results.where(kind == 0).select("json").write.text(f"{path}/lines")
    many = results.where(kind > 0).groupBy(kind.alias("kind"), F.floor(F.col("key") / 300).alias("part")).agg(F.array_join(F.collect_list("json"), ",").alias("joined"))  # 100 results at most
    many.where("kind = 1").select(F.concat(F.lit("["), "joined", F.lit("]"))).write.option("compression", "gzip").text(f"{path}/arrays")
    many.where("kind = 2").select(F.concat(F.lit('{"schema": {"fields": []}, "data": ['), "joined", F.lit("]}"))).write.text(f"{path}/tables")
    return path


_ITEMS = """items as (select o_orderkey as k, l_linenumber as n, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 as place, 'P' || l_partkey as part, 'S' || l_suppkey as supplier, l_returnflag = 'N' as stocked
  from orders join lineitem on l_orderkey = o_orderkey)"""


@register("retro_solved", f"""with {_ITEMS}, leaves as (
  select k, place, case when n % 2 = 0 then supplier else part end as text, n % 2 = 0 or stocked as stocked, n % 2 = 0 as made from items),
counted as (select k, count(*) as precursors, 1 + count(*) filter (made) as steps, coalesce(string_agg(text, ', ' order by place) filter (stocked), '') as yes, coalesce(string_agg(text, ', ' order by place) filter (not stocked), '') as no from leaves group by k)
select o_orderkey as row_index, 'ORD_' || o_orderkey as "Compound_ID", 'O' || o_orderkey as target, o_orderstatus = 'F' as is_solved, o_orderkey % 100 / 100 as top_score, 2 as number_of_routes, cast(o_orderkey % 3 as int) as number_of_solved_routes,
  o_custkey / 8 as search_time, 6 as max_transforms, cast(case when o_orderkey % 2 = 0 then precursors else steps end as int) as number_of_steps, cast(precursors as int) as number_of_precursors, yes as precursors_in_stock, no as precursors_not_in_stock,
  'targets/ORD_' || o_orderkey || '.html' as html_page, 2 as n_routes_exported
from orders join counted on k = o_orderkey""")
def retro_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solver files of three layouts, all columns, what the solver left out counted in the trees."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ordered = orders.join(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    targets = ordered.select(F.col("o_orderkey").alias("row_index"), F.concat(F.lit("ORD_"), F.col("o_orderkey").cast("string")).alias("Compound_ID"))
    return flatten_solved(targets, read_routes(spark, written_output(spark, sf_dir))).drop("routes_json")


_NODES = f"""with recursive {_ITEMS}, edges as (
  select k, 0 as route, '0' as parent, '0.0' as node, 'reaction' as kind, null as smiles, null::boolean as in_stock from items group by k
  union all select k, 0, '0.0', '0.0.' || place, 'mol', part, stocked from items
  union all select k, 0, '0.0.' || place, '0.0.' || place || '.0', 'reaction', null, null from items where n % 2 = 0
  union all select k, 0, '0.0.' || place || '.0', '0.0.' || place || '.0.0', 'mol', supplier, true from items where n % 2 = 0),
nodes as (
  select o_orderkey as row_index, r.route, '0' as node, null::varchar as parent, 0 as depth, 'mol' as kind, r.letter || o_orderkey as smiles, r.route = 1 as in_stock from orders, (values (0, 'O'), (1, 'Q')) r(route, letter) where o_orderkey in (select k from items)
  union all select n.row_index, n.route, e.node, e.parent, n.depth + 1, e.kind, e.smiles, e.in_stock from nodes n join edges e on e.k = n.row_index and e.route = n.route and e.parent = n.node)
select row_index, route, node, parent, depth, kind, smiles, in_stock from nodes"""


@register("retro_route_nodes", _NODES)
def retro_route_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every route tree."""
    return route_nodes(_results(spark, sf_dir))


@register("retro_route_counts", _NODES.replace("select row_index, route, node, parent", "select row_index, route, cast(count(*) filter (kind = 'reaction') as int) as steps, cast(count(*) filter (kind = 'mol' and not exists (select 1 from edges e where e.k = row_index and e.route = nodes.route and e.parent = nodes.node)) as int) as precursors from nodes group by all -- ", 1))
def retro_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and precursors of every route."""
    return route_counts(_results(spark, sf_dir)).select("row_index", "route", "steps", "precursors")
