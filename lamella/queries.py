"""Registered queries over the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions.fields import apply_nested_operations, field, generate_nested_exprs, when
from lamella.functions.flatten import FIXED_SIZE, convert_schema, unnest_all, unnest_rename
from lamella.operators.attributes import GROUP_AGGREGATIONS
from lamella.operators.view import HierarchyView
from lamella.packer import HierarchicalPacker
from lamella.plans.naming import col, q
from lamella.plans.schema import discover_levels
from lamella.plans.spec import Computed, HierarchySpec, HierarchyValidationError, LevelAttribute, LevelSpec
from lamella.sources.scratch import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

R, N, CU, O, SU = "region", "region.nation", "region.nation.customer", "region.nation.customer.orders", "region.nation.supplier"  # noqa: E741
RK, NK, CK, OK, SK = f"{R}.r_regionkey", f"{N}.n_nationkey", f"{CU}.c_custkey", f"{O}.o_orderkey", f"{SU}.s_suppkey"
BAL = f"{CU}.c_acctbal"

TREE = HierarchicalPacker(
    HierarchySpec.from_levels(
        [
            LevelSpec("region", ["r_regionkey"]),
            LevelSpec("nation", ["n_nationkey"], order_by=[q(NK)], parent_keys=["n_regionkey"], parent="region"),
            LevelSpec("customer", ["c_custkey"], order_by=[q(CK)], parent_keys=["c_nationkey"], parent="nation"),
            LevelSpec("orders", ["o_orderkey"], required_fields=["o_orderkey"], order_by=[q(OK)], parent_keys=["o_custkey"], parent="customer"),
            LevelSpec("supplier", ["s_suppkey"], required_fields=["s_suppkey"], order_by=[q(SK)], parent_keys=["s_nationkey"], parent="nation"),
        ]
    ),
    preserve_child_order=False,
)
SALES = HierarchicalPacker(
    HierarchySpec.from_levels(
        LevelSpec("customer", ["c_custkey"]),
        LevelSpec("orders", ["o_orderkey"], order_by=[q("customer.orders.o_orderkey")], parent_keys=["o_custkey"]),
        LevelSpec("lineitem", ["l_linenumber"], required_fields=["l_linenumber"], order_by=[q("customer.orders.lineitem.l_linenumber")], parent_keys=["l_orderkey"]),
    ),
    preserve_child_order=False,
)
S_O, S_L = "customer.orders", "customer.orders.lineitem"
S_CK, S_OK = "customer.c_custkey", "customer.orders.o_orderkey"
TALK = HierarchicalPacker(
    HierarchySpec.from_levels([LevelSpec("conversation", ["conv_id"]), LevelSpec("turn", ["turn"], order_by=[q("conversation.turn.turn")])]),
    preserve_child_order=False,
)


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def level_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Per-level tables with ancestors' keys, as a view holds them. Parents are dimensions, whose keys alone are joined."""
    out: dict[str, DataFrame] = {}
    for name in names:
        level = TREE.levels[name]
        df = TREE.prepare_level_table(name, table(spark, sf_dir, name))
        if level.parent:
            parent = TREE.levels[level.parent]
            link = f"{level.path}.{level.parent_keys[0]}"
            keys = out[parent.name].select(*[col(k) for k in parent.keys])
            df = df.join(keys, col(link) == col(parent.id_columns[0])).drop(link)
        out[name] = df
    return out


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat: a row for each customer with its nation and region."""
    t = level_tables(spark, sf_dir, "region", "nation", "customer")
    return t["region"].join(t["nation"], RK).join(t["customer"], [RK, NK])


def orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat: a row for each order, one of nulls for customers without."""
    orders = TREE.prepare_level_table("orders", table(spark, sf_dir, "orders"))
    flat = customers(spark, sf_dir)
    return flat.join(orders.withColumnRenamed(f"{O}.o_custkey", "__link"), col(CK) == F.col("__link"), "left").drop("__link")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat: a row for each line of an order, with its order and customer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(S_CK), F.col("c_name").alias("customer.c_name"), F.col("c_mktsegment").alias("customer.c_mktsegment"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("__c"), F.col("o_orderkey").alias(S_OK), F.col("o_totalprice").alias(f"{S_O}.o_totalprice"))
    kept = ("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("__o"), *[F.col(n).alias(f"{S_L}.{n}") for n in kept])
    return lines.join(o, F.col("__o") == col(S_OK)).join(c, F.col("__c") == col(S_CK)).drop("__o", "__c")


def view(spark: SparkSession, sf_dir: str, *names: str, **options) -> HierarchyView:
    return HierarchyView.from_tables(level_tables(spark, sf_dir, *names), TREE, **options)


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("conversation.conv_id"), *[F.col(c).alias(f"conversation.turn.{c}") for c in ("turn", "role", "text")])


def long(c: str | Column) -> Column:
    return (col(c) if isinstance(c, str) else c).cast("long")


def cents(c: str | Column, digits: int = 2) -> Column:
    return F.round((col(c) if isinstance(c, str) else c).cast("double"), digits)


SALE = "customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey"
CUSTOMERS = "region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey"


# packing


@query(f"SELECT n_nationkey::BIGINT AS nation_key, any_value(r_name) AS region_name, count(*)::BIGINT AS n_customers, round(sum(c_acctbal), 2) AS total FROM {CUSTOMERS} GROUP BY 1")
def H1_pack(spark, sf_dir):
    packed = TREE.pack(customers(spark, sf_dir), "nation")
    return packed.select(long(NK).alias("nation_key"), col(f"{R}.r_name").alias("region_name"), long(F.size(col(CU))).alias("n_customers"), cents(TREE.attribute_expr("c_acctbal", from_level="customer", to_level="nation", agg="sum")).alias("total"))


@query(
    "SELECT c_custkey::BIGINT AS customer_key, o_orderkey::BIGINT AS order_key, min(l_linenumber)::BIGINT AS first_line, max(l_linenumber)::BIGINT AS last_line, count(*)::BIGINT AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"
)
def H2_fold_order(spark, sf_dir):
    """Two folds below a root of many keys: lines by number within orders within customers."""
    nested = SALES.pack(sales(spark, sf_dir), "customer").select(col(S_CK).alias("k"), F.explode(col(S_O)).alias("o"))
    inner = F.col("o.lineitem")
    return nested.select(long("k").alias("customer_key"), long(F.col("o.o_orderkey")).alias("order_key"), long(F.get(inner, F.lit(0))["l_linenumber"]).alias("first_line"), long(F.try_element_at(inner, F.lit(-1))["l_linenumber"]).alias("last_line"), long(F.size(inner)).alias("n"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'region.r_regionkey'), (1, 'region.r_name'), (2, 'region.nation.n_nationkey'), (3, 'region.nation.n_name'), (4, 'region.nation.customer')) t(place, name)")
def H3_column_order(spark, sf_dir):
    packed = TREE.pack(customers(spark, sf_dir), "nation")
    return spark.createDataFrame(list(enumerate(packed.columns)), "place long, name string")


@query("SELECT * FROM (VALUES (0::BIGINT, 'n_nationkey'), (1, 'n_name'), (2, 'customer')) t(place, name)")
def H4_struct_field_order(spark, sf_dir):
    packed = TREE.pack(customers(spark, sf_dir), "region")
    return spark.createDataFrame(list(enumerate(packed.schema[N].dataType.elementType.names)), "place long, name string")


@query(f"SELECT c_custkey::BIGINT AS customer_key, any_value(c_name) AS customer_name, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(*)::BIGINT AS n_lines FROM {SALE} GROUP BY 1")
def H5_split_join(spark, sf_dir):
    packed = SALES.pack(sales(spark, sf_dir), "customer", parent_strategy="split_join")
    count = SALES.attribute_expr("l_linenumber", from_level="lineitem", to_level="customer", agg="count")
    return packed.select(long(S_CK).alias("customer_key"), col("customer.c_name").alias("customer_name"), long(F.size(col(S_O))).alias("n_orders"), long(count).alias("n_lines"))


SIZES_SQL = "SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1"


def _talk_sizes(packed: DataFrame) -> DataFrame:
    texts = col("conversation.turn")["text"]
    chars = F.aggregate(texts, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return packed.select(long("conversation.conv_id").alias("conv_id"), long(F.size(col("conversation.turn"))).alias("n_turns"), chars.alias("n_chars"))


@query(SIZES_SQL)
def H6_pack_streaming_balanced(spark, sf_dir):
    return _talk_sizes(TALK.pack_streaming(talks(spark, sf_dir), "conversation", partitions=8))


@query(SIZES_SQL)
def H8_pack_streaming_hash(spark, sf_dir):
    return _talk_sizes(TALK.pack_streaming(talks(spark, sf_dir), "conversation", partitions=8, partition_strategy="hash"))


@query(
    """WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY conv_id) AS k, count(*) AS n FROM conversations GROUP BY conv_id),
walk AS (SELECT k, n, 0 AS bucket, n AS filled FROM c WHERE k = 1 UNION ALL
 SELECT c.k, c.n, CASE WHEN filled + c.n > share THEN bucket + 1 ELSE bucket END, CASE WHEN filled + c.n > share THEN c.n ELSE filled + c.n END
 FROM walk JOIN c ON c.k = walk.k + 1, (SELECT ceil(count(*) / 8.0) AS share FROM conversations))
SELECT bucket::BIGINT AS bucket, count(*)::BIGINT AS n_entities, sum(n)::BIGINT AS n_rows FROM walk GROUP BY 1"""
)
def H7_balanced_buckets(spark, sf_dir):
    dealt = TALK.balanced_buckets(talks(spark, sf_dir), 8)
    return dealt.groupBy(long("__hier_bucket").alias("bucket")).agg(F.count_distinct(col("conversation.conv_id")).alias("n_entities"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT conv_id::BIGINT AS conv_id, row_number() OVER (ORDER BY conv_id)::BIGINT AS place FROM (SELECT DISTINCT conv_id FROM conversations)")
def H9_sorted_output(spark, sf_dir):
    """``place`` is where a conversation stands in the files, taken in the order of their names: rows of files before, and in its own."""
    folder = new_path(spark, "sorted")
    packed = TALK.pack_streaming(talks(spark, sf_dir), "conversation", partitions=8, tmp_dir=folder, defer=False)
    placed = packed.select(long("conversation.conv_id").alias("conv_id"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = placed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("one").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over a row per file
    return placed.join(F.broadcast(files.withColumn("before", before)), "file").select("conv_id", (F.col("before") + F.col("row") + 1).alias("place"))


CUSTOMER_ROWS = f"SELECT r_name AS region_name, n_name AS nation_name, c_custkey::BIGINT AS customer_key, c_acctbal AS balance FROM {CUSTOMERS}"


def _customer_rows(flat: DataFrame) -> DataFrame:
    return flat.select(col(f"{R}.r_name").alias("region_name"), col(f"{N}.n_name").alias("nation_name"), long(CK).alias("customer_key"), col(BAL).alias("balance"))


LINE_ROWS = f"SELECT c_custkey::BIGINT AS customer_key, o_orderkey::BIGINT AS order_key, l_linenumber::BIGINT AS line, l_quantity AS quantity FROM {SALE}"


def _line_rows(flat: DataFrame) -> DataFrame:
    return flat.select(long(S_CK).alias("customer_key"), long(S_OK).alias("order_key"), long(f"{S_L}.l_linenumber").alias("line"), col(f"{S_L}.l_quantity").alias("quantity"))


@query(LINE_ROWS)
def H10_unpack(spark, sf_dir):
    return _line_rows(SALES.unpack(SALES.pack(sales(spark, sf_dir), "customer"), "lineitem"))


@query("SELECT c_custkey::BIGINT AS customer_key, o_orderkey::BIGINT AS order_key FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def H11_explode_outer(spark, sf_dir):
    packed = TREE.pack(orders_of_customers(spark, sf_dir), "customer")
    return TREE.unpack(packed, "orders").select(long(CK).alias("customer_key"), long(OK).alias("order_key"))


@query(LINE_ROWS)
def H12_unpack_streaming(spark, sf_dir):
    return _line_rows(SALES.unpack_streaming(SALES.pack(sales(spark, sf_dir), "customer"), "lineitem"))


@query(LINE_ROWS)
def S7_unpack_to_a_path(spark, sf_dir):
    packed = SALES.pack(sales(spark, sf_dir), "customer")
    return _line_rows(SALES.unpack_streaming(packed, "lineitem", sink_path=new_path(spark, "unpacked")))


@query(SIZES_SQL)
def S3_pack_from_a_path(spark, sf_dir):
    _, path = written(talks(spark, sf_dir), "talks")
    return _talk_sizes(TALK.pack_streaming(path, "conversation", partitions=4, spark=spark))


@query(SIZES_SQL)
def S6_bucket_results(spark, sf_dir):
    """Two calls with one folder: each has files of its own."""
    folder = new_path(spark, "results")
    first, _ = (TALK.pack_streaming(talks(spark, sf_dir), "conversation", partitions=4, tmp_dir=folder, defer=False) for _ in range(2))
    return _talk_sizes(first)


@query(f"WITH s AS (SELECT * FROM {SALE}) SELECT 'customer' AS level, count(DISTINCT c_custkey)::BIGINT AS n FROM s UNION ALL SELECT 'orders', count(DISTINCT o_orderkey) FROM s UNION ALL SELECT 'lineitem', count(*) FROM s")
def H13_split_levels(spark, sf_dir):
    packed, _ = written(SALES.pack(sales(spark, sf_dir), "customer"), "packed")  # every level's table reads it
    return _counts(SALES.split_levels(packed))


@query("SELECT * FROM (VALUES ('customer')) t(level)")
def H14_granularity(spark, sf_dir):
    flat = customers(spark, sf_dir)
    return spark.createDataFrame([(n,) for n, v in TREE.levels.items() if TREE.is_at_granularity(v, flat.schema) and TREE.own_columns(v, flat.schema)], "level string")


@query(f"SELECT DISTINCT c_custkey::BIGINT AS customer_key, o_orderkey::BIGINT AS order_key, o_totalprice AS price FROM {SALE}")
def A5_distinct_by_key(spark, sf_dir):
    """A frame finer than the level: its rows become one per key, the first by row id."""
    p = HierarchicalPacker(SALES.spec)
    orders = p.split_levels(sales(spark, sf_dir))["orders"]
    return orders.select(long(S_CK).alias("customer_key"), long(S_OK).alias("order_key"), col(f"{S_O}.o_totalprice").alias("price"))


@query(f"SELECT DISTINCT n_nationkey::BIGINT AS nation_key, r_regionkey::BIGINT AS region_key, n_name AS nation_name FROM {CUSTOMERS}")
def H15_normalize(spark, sf_dir):
    return TREE.normalize(customers(spark, sf_dir))["nation"].select(long(NK).alias("nation_key"), long(RK).alias("region_key"), col(f"{N}.n_name").alias("nation_name"))


@query(
    "SELECT n_nationkey::BIGINT AS nation_key, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)::BIGINT AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::BIGINT AS n_suppliers FROM nation"
)
def H16_denormalize_branches(spark, sf_dir):
    nested = TREE.denormalize(level_tables(spark, sf_dir, "region", "nation", "customer", "supplier"), at_level="nation")
    size = lambda c: F.coalesce(F.size(col(c)), F.lit(0))
    return nested.select(long(NK).alias("nation_key"), long(size(CU)).alias("n_customers"), long(size(SU)).alias("n_suppliers"))


@query(f"SELECT c_custkey::BIGINT AS customer_key, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey)::BIGINT AS n_suppliers, n_name AS nation_name FROM {CUSTOMERS}")
def J3_branches_off_the_axis(spark, sf_dir):
    """Customers with their ancestors and, nested, the suppliers of their nation."""
    made = TREE.denormalize(level_tables(spark, sf_dir, "region", "nation", "customer", "supplier"), at_level="customer")
    return made.select(long(CK).alias("customer_key"), long(F.coalesce(F.size(col(SU)), F.lit(0))).alias("n_suppliers"), col(f"{N}.n_name").alias("nation_name"))


@query("SELECT conv_id::BIGINT AS conv_id, max(turn)::BIGINT AS first_turn, min(turn)::BIGINT AS last_turn FROM conversations GROUP BY 1")
def H20_row_id_keeps_input_order(spark, sf_dir):
    """Children without an ``order_by`` stand as the rows came: here by falling number."""
    p = HierarchicalPacker(HierarchySpec.from_levels(LevelSpec("conversation", ["conv_id"]), LevelSpec("turn", ["turn"])))
    flat = talks(spark, sf_dir).orderBy(col("conversation.conv_id"), col("conversation.turn.turn").desc())
    turns = col("conversation.turn")
    return p.pack(flat, "conversation").select(long("conversation.conv_id").alias("conv_id"), long(F.get(turns, F.lit(0))["turn"]).alias("first_turn"), long(F.try_element_at(turns, F.lit(-1))["turn"]).alias("last_turn"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_nationkey END::BIGINT AS nation_key, min(CASE WHEN c_custkey % 2 = 0 THEN n_name END) AS name, count(*)::BIGINT AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 HAVING nation_key IS NOT NULL")
def A3_first_that_is_not_null(spark, sf_dir):
    """An attribute with gaps takes its value where there is one; a null root key is an entity too, which is left out here as its names vary."""
    flat = customers(spark, sf_dir).withColumn(f"{N}.n_name", F.when(col(CK) % 2 == 0, col(f"{N}.n_name"))).withColumn(NK, F.when(col(CK) % 3 != 0, col(NK)))
    packed = TREE.pack(flat.drop(*[c for c in flat.columns if c.startswith(f"{R}.r_name")]), "nation", validate=False)
    return packed.filter(col(NK).isNotNull()).groupBy(long(NK).alias("nation_key")).agg(F.min(col(f"{N}.n_name")).alias("name"), F.sum(F.size(col(CU))).cast("long").alias("n"))


@query(f"SELECT 'region.r_name' AS name, count(*)::BIGINT AS n FROM (SELECT r_regionkey FROM {CUSTOMERS} GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1)")
def A4_uniformity(spark, sf_dir):
    """Regions whose name, replaced by customers' segments, has several values."""
    flat = customers(spark, sf_dir).withColumn(f"{R}.r_name", col(f"{CU}.c_mktsegment"))
    try:
        TREE.check_uniform(flat, "region")
        found = {}
    except HierarchyValidationError as e:
        found = e.details["non_uniform"]
    return spark.createDataFrame(list(found.items()), "name string, n long")


@query("SELECT c_custkey::BIGINT AS customer_key, greatest(count(o_orderkey), 1)::BIGINT AS n_rows, min(o_orderkey)::BIGINT AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def H18_build_from_tables(spark, sf_dir):
    built = TREE.build_from_tables(sources(spark, sf_dir, "region", "nation", "customer", "orders"), at_level="customer")
    return built.select(long(CK).alias("customer_key"), long(F.size(col(O))).alias("n_rows"), long(F.get(col(O), F.lit(0))["o_orderkey"]).alias("first_order"))


@query("SELECT n_nationkey::BIGINT AS nation_key, count(*)::BIGINT AS n_suppliers FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def H18_build_inner(spark, sf_dir):
    built = TREE.build_from_tables(sources(spark, sf_dir, "region", "nation", "supplier"), at_level="nation", join_type="inner")
    return built.select(long(NK).alias("nation_key"), long(F.size(col(SU))).alias("n_suppliers"))


@query("SELECT r_regionkey::BIGINT AS key, r_name AS label FROM region")
def H19_prepare_level_table(spark, sf_dir):
    made = TREE.prepare_level_table("region", table(spark, sf_dir, "region"), {"r_name": "label"})
    return made.select(long(RK).alias("key"), col("region.label").alias("label"))


@query("SELECT lower(c_mktsegment) AS segment, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def H21_computed_key(spark, sf_dir):
    spec = HierarchySpec.from_levels([LevelSpec("segment", [Computed("segment_key", F.lower(col("segment.c_mktsegment")))]), LevelSpec("customer", ["c_custkey"])])
    p = HierarchicalPacker(spec, preserve_child_order=False)
    flat = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment.c_mktsegment"), F.col("c_custkey").alias("segment.customer.c_custkey"))
    return p.pack(flat, "segment").select(F.col("segment_key").alias("segment"), long(F.size(col("segment.customer"))).alias("n"))


@query(f"SELECT n_nationkey::BIGINT AS nation_key, any_value(r_name || '!') AS note FROM {CUSTOMERS} GROUP BY 1")
def H22_extra_columns(spark, sf_dir):
    flat = customers(spark, sf_dir).withColumn("note", F.concat(col(f"{R}.r_name"), F.lit("!")))
    return TREE.pack(flat, "nation", extra_columns="preserve").select(long(NK).alias("nation_key"), "note")


# attributes

TEN = ("sum", "mean", "min", "max", "count", "first", "last", "single")
TEN_SQL = """min(CASE WHEN c_custkey % 4 = 0 THEN n_nationkey END)::DOUBLE AS v_single, round(sum(c_acctbal), 2) AS v_sum, round(avg(c_acctbal), 4) AS v_mean, min(c_acctbal) AS v_min, max(c_acctbal) AS v_max,
 count(*)::DOUBLE AS v_count, first(c_acctbal ORDER BY c_custkey) AS v_first, last(c_acctbal ORDER BY c_custkey) AS v_last, count(DISTINCT c_mktsegment)::BIGINT AS v_set, count(*)::BIGINT AS v_list"""


@query(f"SELECT n_nationkey::BIGINT AS nation_key, {TEN_SQL} FROM {CUSTOMERS} GROUP BY 1")
def A12_list_aggregations(spark, sf_dir):
    """"single" is of a field that has the nation's key for some customers and nulls for others."""
    packed = TREE.pack(customers(spark, sf_dir).withColumn(f"{CU}.mark", F.when(col(CK) % 4 == 0, col(NK))), "nation")

    def of(name: str, agg: str) -> Column:
        return TREE.attribute_expr(name, from_level="customer", to_level="nation", agg=agg, schema=packed)

    made = [F.round(of("mark" if a == "single" else "c_acctbal", a).cast("double"), 4 if a == "mean" else 2).alias(f"v_{a}") for a in TEN]
    return packed.select(long(NK).alias("nation_key"), *made, long(F.size(of("c_mktsegment", "set"))).alias("v_set"), long(F.size(of("c_acctbal", "list"))).alias("v_list"))


@query(
    f"SELECT n_nationkey::BIGINT AS nation_key, round(sum(c_acctbal), 2) AS v_sum, round(avg(c_acctbal), 4) AS v_mean, min(c_acctbal) AS v_min, max(c_acctbal) AS v_max, count(*)::BIGINT AS v_count, count(DISTINCT c_mktsegment)::BIGINT AS v_set, count(*)::BIGINT AS v_list, first(c_acctbal ORDER BY c_custkey) AS v_first, last(c_acctbal ORDER BY c_custkey) AS v_last, any_value(n_name) AS v_single FROM {CUSTOMERS} GROUP BY 1"
)
def A11_group_aggregations(spark, sf_dir):
    g = GROUP_AGGREGATIONS
    plain = [g[a](col(BAL), col(CK)).alias(a) for a in ("sum", "mean", "min", "max", "count", "list", "first", "last")]
    made = customers(spark, sf_dir).groupBy(col(NK)).agg(*plain, g["set"](col(f"{CU}.c_mktsegment")).alias("set"), g["single"](col(f"{N}.n_name")).alias("v_single"))
    return made.select(F.col("first").alias("v_first"), F.col("last").alias("v_last"), "v_single", long(NK).alias("nation_key"), cents("sum").alias("v_sum"), cents("mean", 4).alias("v_mean"), F.col("min").alias("v_min"), F.col("max").alias("v_max"), long("count").alias("v_count"), long(F.size("set")).alias("v_set"), long(F.size("list")).alias("v_list"))


@query(
    f"WITH o AS (SELECT c_custkey, o_orderkey, sum(l_quantity) s, avg(l_quantity) m, count(*) c FROM {SALE} GROUP BY 1, 2) SELECT c_custkey::BIGINT AS customer_key, round(sum(s), 2) AS total, round(avg(m), 10) AS mean_of_means, sum(c)::BIGINT AS n FROM o GROUP BY 1"
)
def A13_attribute_over_hops(spark, sf_dir):
    packed = SALES.pack(sales(spark, sf_dir), "customer")
    of = lambda a: SALES.attribute_expr("l_quantity", from_level="lineitem", to_level="customer", agg=a)
    return packed.select(long(S_CK).alias("customer_key"), cents(of("sum")).alias("total"), cents(of("mean"), 10).alias("mean_of_means"), long(of("count")).alias("n"))


@query(
    f"WITH n AS (SELECT r_regionkey, any_value(r_name) AS r_name, n_nationkey, sum(c_acctbal) s, avg(c_acctbal) m, count(*) c, max(c_acctbal) x, first(c_acctbal ORDER BY c_custkey) f FROM {CUSTOMERS} GROUP BY 1, 3) SELECT r_regionkey::BIGINT AS region_key, any_value(r_name) AS region_name, round(sum(s), 2) AS total, round(avg(m), 4) AS mean_of_means, sum(c)::BIGINT AS n, max(x) AS best, first(f ORDER BY n_nationkey) AS first_balance FROM n GROUP BY 1"
)
def A13_roll_up(spark, sf_dir):
    """The same reductions without arrays, for a root of few keys."""
    wanted = [LevelAttribute("c_acctbal", "customer", a, a) for a in ("sum", "mean", "count", "max", "first")]
    made = TREE.roll_up(customers(spark, sf_dir), *wanted, at_level="region")
    return made.select(long(RK).alias("region_key"), col(f"{R}.r_name").alias("region_name"), cents("region.sum").alias("total"), cents("region.mean", 4).alias("mean_of_means"), long("region.count").alias("n"), col("region.max").alias("best"), col("region.first").alias("first_balance"))


@query(f"SELECT c_custkey::BIGINT AS customer_key, max(l_extendedprice) AS best, count(DISTINCT o_totalprice)::BIGINT AS n_prices FROM {SALE} GROUP BY 1")
def A14_enrich(spark, sf_dir):
    packed = SALES.pack(sales(spark, sf_dir), "customer")
    rich = SALES.enrich(packed, LevelAttribute("l_extendedprice", "lineitem", "max", "best"), LevelAttribute("o_totalprice", "orders", "set", "prices"), at_level="customer")
    return rich.select(long(S_CK).alias("customer_key"), col("customer.best").alias("best"), long(F.size(col("customer.prices"))).alias("n_prices"))


@query(f"SELECT n_nationkey::BIGINT AS nation_key, min(c_acctbal) AS worst FROM {CUSTOMERS} GROUP BY 1")
def A15_promote_attribute(spark, sf_dir):
    made = TREE.promote_attribute(customers(spark, sf_dir), "c_acctbal", from_level="customer", to_level="nation", agg="min", alias="worst")
    return made.select(long(NK).alias("nation_key"), col(f"{N}.worst").alias("worst"))


@query("SELECT n_regionkey::BIGINT AS region_key, round(sum(c_acctbal), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def A10_rollup(spark, sf_dir):
    v = view(spark, sf_dir, "region", "nation", "customer")
    return v.level("customer").groupBy(*[col(k) for k in v.key_columns("region")]).agg(F.sum(col(BAL)).alias("t")).select(long(RK).alias("region_key"), cents("t").alias("total"))


@query(f"SELECT '{CK}' AS key, count(*)::BIGINT AS n FROM {CUSTOMERS} WHERE c_custkey % 7 = 0 UNION ALL SELECT '{NK}', count(*) FROM {CUSTOMERS} WHERE c_custkey % 10 = 0")
def I10_validate(spark, sf_dir):
    flat = customers(spark, sf_dir).withColumns({NK: F.when(col(CK) % 10 != 0, col(NK)), CK: F.when(col(CK) % 7 != 0, col(CK))})
    errors = TREE.validate(flat, raise_on_error=False)
    return spark.createDataFrame([(e.details["column"], e.details["null_count"]) for e in errors], "key string, n long")


# child predicates


@query(f"SELECT n_nationkey::BIGINT AS nation_key FROM {CUSTOMERS} GROUP BY 1 HAVING max(c_acctbal) > 9900")
def F1_any_child_satisfies(spark, sf_dir):
    packed = TREE.pack(customers(spark, sf_dir), "nation")
    return TREE.any_child_satisfies(packed, from_level="customer", to_level="nation", condition=lambda x: x["c_acctbal"] > 9900).select(long(NK).alias("nation_key"))


@query(f"SELECT n_nationkey::BIGINT AS nation_key FROM {CUSTOMERS} GROUP BY 1 HAVING min(c_acctbal) > -950")
def F2_all_children_satisfy(spark, sf_dir):
    packed = TREE.pack(customers(spark, sf_dir), "nation")
    return TREE.all_children_satisfy(packed, from_level="customer", to_level="nation", condition=lambda x: x["c_acctbal"] > -950).select(long(NK).alias("nation_key"))


# views


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "SELECT 'region' AS level, count(*)::BIGINT AS n FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1"
)
def F3b_filter_on_keys(spark, sf_dir):
    v = view(spark, sf_dir, "region", "nation", "customer", empty_parents="keep")
    return _counts(v.filter(col(RK) == 1).tables())


@query(
    f"WITH c AS (SELECT * FROM {CUSTOMERS} WHERE c_acctbal > 9000) SELECT 'region' AS level, count(DISTINCT r_regionkey)::BIGINT AS n FROM c UNION ALL SELECT 'nation', count(DISTINCT n_nationkey) FROM c UNION ALL SELECT 'customer', count(*) FROM c"
)
def V5_cascade_prune(spark, sf_dir):
    return _counts(view(spark, sf_dir, "region", "nation", "customer").filter(col(BAL) > 9000).tables())


@query("SELECT 'region' AS level, count(*)::BIGINT AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal > 9000")
def V8_cascade_keep(spark, sf_dir):
    return _counts(view(spark, sf_dir, "region", "nation", "customer", empty_parents="keep").filter(col(BAL) > 9000).tables())


@query(f"SELECT c_custkey::BIGINT AS customer_key FROM {CUSTOMERS} WHERE c_acctbal > n_nationkey * 300")
def F3d_filter_across_levels(spark, sf_dir):
    v = view(spark, sf_dir, "region", "nation", "customer")
    named = v.with_level("nation", lambda t: t.withColumn(f"{N}.n_limit", col(NK) * 300))
    return named.filter(col(BAL) > col(f"{N}.n_limit")).tables()["customer"].select(long(CK).alias("customer_key"))


@query("SELECT c_custkey::BIGINT AS customer_key FROM (SELECT *, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer) WHERE c_acctbal = m")
def F3c_window_predicate(spark, sf_dir):
    v = view(spark, sf_dir, "region", "nation", "customer")
    best = F.max(col(BAL)).over(Window.partitionBy(col(NK)))
    return v.filter(col(BAL) == best).tables()["customer"].select(long(CK).alias("customer_key"))


@query("SELECT count(*)::BIGINT AS n, 0::BIGINT AS none FROM customer")
def F3a_filter_without_columns(spark, sf_dir):
    v = view(spark, sf_dir, "region", "nation", "customer")
    n, none = (v.filter(F.lit(kept)).tables()["customer"].agg(F.count(F.lit(1)).alias(name)) for kept, name in ((True, "n"), (False, "none")))
    return n.crossJoin(F.broadcast(none))


@query("SELECT c_custkey::BIGINT AS customer_key FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def F3c_global_mean(spark, sf_dir):
    """A predicate against an aggregate of all rows: one row, lent to each by ``with_level``, so that no window takes all rows to one task."""
    v = view(spark, sf_dir, "region", "nation", "customer")
    lent = v.with_level("customer", lambda t: t.crossJoin(F.broadcast(t.agg(F.avg(col(BAL)).alias(f"{CU}.mean")))))
    return lent.filter(col(BAL) > col(f"{CU}.mean")).tables()["customer"].select(long(CK).alias("customer_key"))


@query("SELECT count(*)::BIGINT AS n FROM customer WHERE (SELECT max(c_acctbal) FROM customer) > 100")
def F3c_aggregate_predicate(spark, sf_dir):
    """A predicate that is an aggregate of all rows keeps all or none."""
    v = view(spark, sf_dir, "region", "nation", "customer", empty_parents="keep")
    kept = v.filter(F.max(col(BAL)) > 100)
    return kept.tables()["customer"].agg(F.count(F.lit(1)).alias("n"))


@query(CUSTOMER_ROWS)
def V1_level(spark, sf_dir):
    return _customer_rows(view(spark, sf_dir, "region", "nation", "customer", "supplier").level("customer"))


@query(f"SELECT c_custkey::BIGINT AS customer_key, any_value(n_name) AS nation_name, count(*)::BIGINT AS n_orders FROM {CUSTOMERS} JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 AND c_acctbal < 0 GROUP BY 1")
def V2_nested(spark, sf_dir):
    """Customers with their orders nested, both levels filtered."""
    v = view(spark, sf_dir, "region", "nation", "customer", "orders").filter(col(BAL) < 0, col(f"{O}.o_totalprice") > 100000)
    return v.nested("customer").select(long(CK).alias("customer_key"), col(f"{N}.n_name").alias("nation_name"), long(F.size(col(O))).alias("n_orders"))


@query("SELECT c_custkey::BIGINT AS customer_key, n_name || ':' || c_name AS label FROM nation JOIN customer ON n_nationkey = c_nationkey")
def V6_with_level(spark, sf_dir):
    v = view(spark, sf_dir, "region", "nation", "customer")
    named = v.with_level("customer", lambda t: t.withColumn(f"{CU}.label", F.concat_ws(":", col(f"{N}.n_name"), col(f"{CU}.c_name"))))
    return named.tables()["customer"].select(long(CK).alias("customer_key"), col(f"{CU}.label").alias("label"))


@query(
    "SELECT n_nationkey::BIGINT AS nation_key, round(sum(c_acctbal), 2) AS total, count(c_custkey)::BIGINT AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1"
)
def V7_promote(spark, sf_dir):
    v = view(spark, sf_dir, "region", "nation", "customer")
    total = F.sum(col(BAL)).over(Window.partitionBy(col(NK)))
    up = v.with_level("customer", lambda t: t.withColumn(f"{N}.total", F.round(total, 2)), promote="unique")
    up = up.with_level("customer", lambda t: t.withColumn(f"{N}.keys", col(CK)), promote="list")
    return up.tables()["nation"].select(long(NK).alias("nation_key"), col(f"{N}.total").alias("total"), long(F.coalesce(F.size(col(f"{N}.keys")), F.lit(0))).alias("n"))


@query(f"SELECT r_name AS region_name, count(*)::BIGINT AS n FROM {CUSTOMERS} GROUP BY 1")
def V10_subset_view(spark, sf_dir):
    full = level_tables(spark, sf_dir, "region", "nation", "customer")
    v = HierarchyView.from_tables({"region": full["region"], "customer": full["customer"]}, TREE)
    return v.level("customer").groupBy(col(f"{R}.r_name").alias("region_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey::BIGINT AS nation_key FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def J11_existence(spark, sf_dir):
    t = view(spark, sf_dir, "region", "nation", "supplier").tables()
    return t["nation"].join(t["supplier"], [RK, NK], "left_semi").select(long(NK).alias("nation_key"))


@query(CUSTOMER_ROWS)
def S1_S2_sink_and_scan(spark, sf_dir):
    folder = new_path(spark, "levels")
    v = view(spark, sf_dir, "region", "nation", "customer")
    v.sink_parquet(folder)
    p = HierarchicalPacker(HierarchySpec.from_levels([LevelSpec("region", ["r_regionkey"]), LevelSpec("nation", ["n_nationkey"]), LevelSpec("customer", ["c_custkey"])]))
    return _customer_rows(HierarchyView.scan_parquet(folder, p, spark=spark).level("customer"))


# nested expressions


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct in a struct for each customer."""
    inner = F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), inner.alias("account")).alias("who"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of structs for each order, by line."""
    line = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("items"))


@query("SELECT c_custkey::BIGINT AS customer_key, upper(c_name) AS name, round(c_acctbal * 2, 2) AS balance FROM customer")
def E8a_select_struct(spark, sf_dir):
    made = apply_nested_operations(_accounts(spark, sf_dir), {"c_custkey": None, "who": {"name": F.upper, "account": {"balance": lambda x: x * 2}}})
    return made.select(long("c_custkey").alias("customer_key"), F.col("who.name").alias("name"), F.round("who.account.balance", 2).alias("balance"))


@query("SELECT c_custkey::BIGINT AS customer_key, c_name AS name, c_mktsegment AS segment, round(c_acctbal + 1, 2) AS balance, c_acctbal < 0 AS debt FROM customer")
def E8b_with_fields(spark, sf_dir):
    made = apply_nested_operations(_accounts(spark, sf_dir), {"who": {"account": {"balance": lambda x: x + 1, "debt": field("balance") < 0}}}, struct_mode="with_fields", use_with_columns=True)
    return made.select(long("c_custkey").alias("customer_key"), F.col("who.name").alias("name"), F.col("who.account.segment").alias("segment"), F.round("who.account.balance", 2).alias("balance"), F.col("who.account.debt").alias("debt"))


@query("SELECT l_orderkey::BIGINT AS order_key, count(*)::BIGINT AS n, round(sum(l_quantity * l_extendedprice), 2) AS total, round(sum(l_quantity * 2), 2) AS doubled FROM lineitem GROUP BY 1")
def E6_E12_list_map_with_siblings(spark, sf_dir):
    made = apply_nested_operations(_lines(spark, sf_dir), {"l_orderkey": None, "items": {"quantity": lambda q: q * 2, "total": field("quantity") * field("price")}}, struct_mode="with_fields")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 2)
    return made.select(long("l_orderkey").alias("order_key"), long(F.size("items")).alias("n"), total(F.col("items.total")).alias("total"), total(F.col("items.quantity")).alias("doubled"))


@query("SELECT l_orderkey::BIGINT AS order_key, arg_max(l_partkey, (l_linenumber, l_partkey, l_quantity, l_extendedprice))::BIGINT AS last_part FROM lineitem GROUP BY 1")
def E14_whole_list_callable(spark, sf_dir):
    made = _lines(spark, sf_dir).select(F.col("l_orderkey"), *generate_nested_exprs({"items": F.reverse}, _lines(spark, sf_dir)))
    return made.select(long("l_orderkey").alias("order_key"), long(F.get("items", F.lit(0))["l_partkey"]).alias("last_part"))


@query("SELECT l_orderkey::BIGINT AS order_key, count(*) FILTER (l_extendedprice = m)::BIGINT AS n_best FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1")
def E15_aggregate_over_elements(spark, sf_dir):
    made = apply_nested_operations(_lines(spark, sf_dir), {"l_orderkey": None, "items": {"best": field("price") == field("price").list_max()}})
    return made.select(long("l_orderkey").alias("order_key"), long(F.size(F.filter(F.col("items.best"), lambda x: x))).alias("n_best"))


@query(
    "SELECT l_orderkey::BIGINT AS order_key, count(*) FILTER (l_quantity >= 40)::BIGINT AS n_large, count(*) FILTER (l_quantity >= 20 AND l_quantity < 40)::BIGINT AS n_middle FROM lineitem GROUP BY 1"
)
def E12_conditional_fields(spark, sf_dir):
    size = when(field("quantity") >= 40, "large").when(field("quantity") >= 20, "middle").otherwise("small")
    made = apply_nested_operations(_lines(spark, sf_dir), {"l_orderkey": None, "items": {"size": size}})
    count = lambda s: long(F.size(F.filter(F.col("items.size"), lambda x: x == s)))
    return made.select(long("l_orderkey").alias("order_key"), count("large").alias("n_large"), count("middle").alias("n_middle"))


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name AS \"who.name\", c_acctbal AS \"who.account.balance\", c_mktsegment AS \"who.account.segment\" FROM customer")
def E17_unnest_all(spark, sf_dir):
    return unnest_all(_accounts(spark, sf_dir).withColumn("c_custkey", long("c_custkey")))


@query("SELECT c_custkey::BIGINT AS customer_key, c_name AS who_name FROM customer")
def E16_unnest_rename(spark, sf_dir):
    made = unnest_rename(_accounts(spark, sf_dir), "who", "_")
    return made.select(long("c_custkey").alias("customer_key"), "who_name")


@query("SELECT * FROM (VALUES ('c_custkey', 'LongType()'), ('who', '{''name'': StringType(), ''account'': {''balance'': DoubleType(), ''segment'': StringType()}}')) t(name, kind)")
def E18_convert_schema(spark, sf_dir):
    return spark.createDataFrame([(n, repr(k)) for n, k in convert_schema(_accounts(spark, sf_dir)).items()], "name string, kind string")


@query("SELECT * FROM (VALUES ('region', 0::BIGINT), ('nation', 1), ('customer', 2)) t(name, depth)")
def I8_discover_levels(spark, sf_dir):
    found = discover_levels(TREE.pack(customers(spark, sf_dir), "region"))
    return spark.createDataFrame([(d.name, d.depth) for d in found], "name string, depth long")


# expressions on level frames


@query("SELECT c_custkey::BIGINT AS customer_key, round(100 * c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS share FROM customer")
def W1_window_share(spark, sf_dir):
    level = view(spark, sf_dir, "region", "nation", "customer").level("customer")
    total = F.sum(col(BAL)).over(Window.partitionBy(col(NK)))
    return level.select(long(CK).alias("customer_key"), F.round(100 * col(BAL) / total, 4).alias("share"))


@query(
    "SELECT c_custkey::BIGINT AS customer_key, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0::DOUBLE AS place FROM customer"
)
def W5_average_rank(spark, sf_dir):
    level = view(spark, sf_dir, "region", "nation", "customer").level("customer")
    rank = F.rank().over(Window.partitionBy(col(NK)).orderBy(col(BAL).desc()))
    peers = F.count(F.lit(1)).over(Window.partitionBy(col(NK), col(BAL)))
    return level.select(long(CK).alias("customer_key"), (rank + (peers - 1) / 2).alias("place"))


@query("SELECT o_custkey::BIGINT AS customer_key, round(sum(CASE WHEN o_totalprice >= 100000 THEN o_totalprice ELSE 0 END), 2) AS large, count(*)::BIGINT AS n, max(year(o_orderdate))::BIGINT AS last_year, max(isodow(o_orderdate))::BIGINT AS last_weekday FROM orders GROUP BY 1")
def W9_conditional_aggregates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    large = F.sum(F.when(F.col("o_totalprice") >= 100000, F.col("o_totalprice")).otherwise(0))
    return o.groupBy(long("o_custkey").alias("customer_key")).agg(F.round(large, 2).alias("large"), F.count(F.lit(1)).alias("n"), F.max(F.year("o_orderdate")).cast("long").alias("last_year"), F.max(F.weekday("o_orderdate") + 1).cast("long").alias("last_weekday"))


@query(f"SELECT n_nationkey::BIGINT AS nation_key, round(sum(c_acctbal), 2) AS total FROM {CUSTOMERS} GROUP BY 1 ORDER BY 2 DESC LIMIT 5")
def W10_top_nations(spark, sf_dir):
    level = view(spark, sf_dir, "region", "nation", "customer").level("customer")
    return level.groupBy(long(NK).alias("nation_key")).agg(F.round(F.sum(col(BAL)), 2).alias("total")).orderBy(F.desc("total")).limit(5)


@query("SELECT trim(lower(c_name)) AS low, upper(c_mktsegment) AS up, length(c_name)::BIGINT AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT trim(lower(s_name)), 'SUPPLIER', length(s_name) FROM supplier")
def W12_strings_and_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    c = c.select(F.trim(F.lower("c_name")).alias("low"), F.upper("c_mktsegment").alias("up"), long(F.length("c_name")).alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.trim(F.lower("s_name")).alias("low"), F.lit("SUPPLIER").alias("up"), long(F.length("s_name")).alias("n"))
    return c.unionByName(s)


# names, errors and plans: rows that follow from schemas alone


def facts(expected: list[tuple[str, str]]):
    """Registers a function that returns rows (name, value) beside the rows that it must give."""
    values = ", ".join("('" + n.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for n, v in expected)

    def register(f: Callable[[SparkSession, str], list[tuple[str, object]]]):
        def made(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.createDataFrame([(n, str(v)) for n, v in f(spark, sf_dir)], "name string, value string")

        made.__name__ = f.__name__
        made.__doc__ = f.__doc__
        query(f"SELECT * FROM (VALUES {values}) t(name, value)")(made)
        return made

    return register


def raised(f: Callable[[], object]) -> str:
    """The name of the error that ``f`` raises, of ours or Python's."""
    try:
        f()
    except Exception as e:  # noqa: BLE001
        return type(e).__name__
    return "none"


@facts([("parent_of", "nation"), ("children_of", "customer,supplier"), ("ancestors_of", "region,nation,customer"), ("axis_of", "region,nation,supplier"), ("descendants_of", "customer,orders,supplier"), ("is_ancestor_of", "True,False"), ("root", "region"), ("leaves", "orders,supplier"), ("reverse", "supplier,orders,customer,nation,region"), ("index_of", "3"), ("next_level", "orders,None"), ("ambiguous", "ValueError"), ("unknown", "KeyError")])
def I1_spec_navigation(spark, sf_dir):
    s = TREE.spec
    join = ",".join
    return [
        ("parent_of", s.parent_of("customer")), ("children_of", join(s.children_of("nation"))), ("ancestors_of", join(s.ancestors_of("orders"))), ("axis_of", join(s.axis_of("supplier"))),
        ("descendants_of", join(s.descendants_of("nation"))), ("is_ancestor_of", f"{s.is_ancestor_of('region', 'orders')},{s.is_ancestor_of('supplier', 'orders')}"), ("root", s.root), ("leaves", join(s.leaves)),
        ("reverse", join(s.reverse_topological_levels)), ("index_of", s.index_of("orders")), ("next_level", f"{s.next_level('customer').name},{s.next_level('orders')}"),
        ("ambiguous", raised(lambda: s.next_level("nation"))), ("unknown", raised(lambda: s.parent_of("planet"))),
    ]


@facts([("level_names", "customer,orders,lineitem"), ("root_level", "customer"), ("leaf_level", "lineitem"), ("leaf_levels", "orders,supplier"), ("axes", "region>nation>customer>orders,region>nation>supplier"), ("ambiguous", "ValueError"), ("get_child_levels", "nation")])
def I2_packer_navigation(spark, sf_dir):
    join = ",".join
    return [("level_names", join(SALES.level_names)), ("root_level", SALES.root_level), ("leaf_level", SALES.leaf_level), ("leaf_levels", join(TREE.leaf_levels)), ("axes", join(">".join(a) for a in TREE.axes)), ("ambiguous", raised(lambda: TREE.leaf_level)), ("get_child_levels", join(TREE.get_child_levels("region")))]


@facts([("short", "c_custkey"), ("long", CK), ("with ancestors", f"{RK},{NK},{CK}"), ("columns", "customer.orders.lineitem.l_linenumber")])
def I3_I9_keys_and_columns(spark, sf_dir):
    join = ",".join
    return [("short", join(TREE.get_level_keys("customer"))), ("long", join(TREE.get_level_keys("customer", form="long"))), ("with ancestors", join(TREE.get_level_keys("customer", include_ancestors=True, form="long"))), ("columns", join(SALES.get_level_columns("lineitem")))]


@facts([("flat", "n_nationkey,n_name"), ("packed", "n_nationkey,n_name"), ("long", f"{RK},region.r_name"), ("types", "c_custkey:bigint,c_name:string,c_acctbal:double,c_mktsegment:string")])
def I4_I5_fields_and_schema(spark, sf_dir):
    flat = customers(spark, sf_dir)
    packed = TREE.pack(flat, "region")
    types = TREE.get_level_schema("customer", TREE.pack(flat, "nation"))
    return [("flat", ",".join(TREE.get_level_fields("nation", flat))), ("packed", ",".join(TREE.get_level_fields("nation", packed))), ("long", ",".join(TREE.get_level_fields("region", flat, form="long"))), ("types", ",".join(f"{n}:{k.simpleString()}" for n, k in types.items()))]


@facts([("flat", "customer"), ("packed", "nation"), ("whole", "region"), ("two branches", "ValueError"), ("one of them", "supplier"), ("none", "ValueError")])
def I6_infer_current_level(spark, sf_dir):
    flat = customers(spark, sf_dir)
    both = flat.withColumn(SK, F.lit(1))
    return [("flat", TREE.infer_current_level(flat)), ("packed", TREE.infer_current_level(TREE.pack(flat, "nation"))), ("whole", TREE.infer_current_level(TREE.pack(flat, "region"))), ("two branches", raised(lambda: TREE.infer_current_level(both))), ("one of them", TREE.infer_current_level(both, axis="supplier")), ("none", raised(lambda: TREE.infer_current_level(spark.range(1))))]


@facts([("0", "3 levels, paths joined by '.'"), ("1", f"customer <customer>: {S_CK}"), ("2", f"  orders <{S_O}>: {S_OK}; inherits {S_CK}"), ("3", f"    lineitem <{S_L}>: {S_L}.l_linenumber; inherits {S_CK}, {S_OK}")])
def I7_describe(spark, sf_dir):
    return [(str(k), line) for k, line in enumerate(SALES.describe().split("\n"))]


@facts([("flat", "True customer region,nation,customer 0 0"), ("expected", "False customer region,nation,customer 1 0"), ("packed", "True nation region,nation,customer 0 0"), ("no scalar", "False customer region,nation,customer 1 0"), ("no key inside", "False region region 1 0"), ("nothing", "False None  1 1")])
def I11_validate_schema(spark, sf_dir):
    """Compatible, level, levels that are there, number of errors and of warnings."""
    flat = customers(spark, sf_dir)
    bare = flat.select(col(RK), F.array(F.struct(F.lit("x").alias("n_name"))).alias(N))
    cases = {"flat": (flat, None), "expected": (flat, "nation"), "packed": (TREE.pack(flat, "nation"), None), "no scalar": (flat.withColumn(NK, F.array(F.lit(1))), None), "no key inside": (bare, None), "nothing": (spark.range(1), None)}
    out = []
    for name, (df, level) in cases.items():
        r = TREE.validate_schema(df, expected_level=level)
        there = [n for n in r.present_levels if name != "no key inside" or n != "nation"]
        out.append((name, f"{r.is_compatible} {r.inferred_level} {','.join(there)} {len(r.errors)} {len(r.warnings)}"))
    return out


@facts([("escape", "net\\.sales"), ("join", "a.net\\.sales"), ("split", "a|net.sales")])
def I12_paths(spark, sf_dir):
    return [("escape", TREE.escape_field("net.sales")), ("join", TREE.join_path(["a", "net.sales"])), ("split", "|".join(TREE.split_path("a.net\\.sales")))]


@facts([("levels", "region,nation,customer"), ("keys", f"{RK},{NK}"), ("level_of", "customer"), ("columns", "8"), ("repr", "HierarchyView(levels=['region', 'nation', 'customer'], empty_parents='keep', restricted=[])")])
def V9_introspection(spark, sf_dir):
    v = view(spark, sf_dir, "region", "nation", "customer", empty_parents="keep")
    return [("levels", ",".join(v.levels)), ("keys", ",".join(v.key_columns("nation"))), ("level_of", v.level_of(BAL)), ("columns", len(v.columns)), ("repr", repr(v))]


@facts([("unknown column", "KeyError"), ("two branches", "ValueError"), ("aggregate beside rows", "ValueError"), ("finer column", "ValueError"), ("lost key", "ValueError"), ("no promote", "ValueError"), ("promote down", "ValueError"), ("no such promote", "ValueError"), ("varies", "HierarchyValidationError"), ("taken", "ValueError"), ("unknown level", "KeyError"), ("absent level", "KeyError"), ("no table", "ValueError"), ("no key", "HierarchyValidationError")])
def V11_F3e_H17_errors(spark, sf_dir):
    v = view(spark, sf_dir, "region", "nation", "customer", "supplier")
    add = lambda level, name, value=F.lit(1), **o: raised(lambda: v.with_level(level, lambda t: t.withColumn(name, value), **o))
    return [
        ("unknown column", raised(lambda: v.filter(col(f"{CU}.nothing") > 1))), ("two branches", raised(lambda: v.filter(col(BAL) > col(f"{SU}.s_acctbal")))), ("aggregate beside rows", raised(lambda: v.filter(col(BAL) > F.avg(col(BAL))))),
        ("finer column", add("nation", f"{N}.x", col(BAL))), ("lost key", raised(lambda: v.with_level("customer", lambda t: t.drop(NK)))), ("no promote", add("customer", f"{N}.x")), ("promote down", add("nation", f"{CU}.x", promote="first")),
        ("no such promote", add("customer", f"{N}.x", promote="any")), ("varies", add("customer", f"{N}.x", col(CK), promote="unique")), ("taken", add("customer", f"{N}.n_name", promote="first")), ("unknown level", raised(lambda: v.level("planet"))),
        ("absent level", raised(lambda: v.level("orders"))), ("no table", raised(lambda: HierarchyView.from_tables({}, TREE))), ("no key", raised(lambda: HierarchyView.from_tables({"region": spark.range(1)}, TREE))),
    ]


@facts([("recurse", "ValueError"), ("unknown column", "ValueError"), ("unknown field", "ValueError"), ("no dictionary", "TypeError"), ("bad mode", "ValueError"), ("field outside", "TypeError")])
def E5_errors(spark, sf_dir):
    df = _accounts(spark, sf_dir)
    fails = lambda spec, *o: raised(lambda: apply_nested_operations(df, spec, *o))
    return [("recurse", fails({"c_custkey": {"x": None}})), ("unknown column", fails({"nothing": None})), ("unknown field", fails({"who": {"nothing": None}})), ("no dictionary", fails({"who": 3})), ("bad mode", fails({"who": None}, "both")), ("field outside", fails({"who": field("name")}))]


@facts([("top", "2"), ("below", "3"), ("deep", "4")])
def E7_fixed_size_arrays(spark, sf_dir):
    """Arrays of structs keep their size where their elements are mapped, at any depth."""
    item = F.array(F.struct(F.lit(1).alias("v"), F.lit(2).alias("w")))
    made = F.struct(item.alias("below", metadata={FIXED_SIZE: 3}), F.struct(item.alias("deep", metadata={FIXED_SIZE: 4})).alias("s"))
    df = spark.range(1).select(item.alias("top", metadata={FIXED_SIZE: 2}), made.alias("in"))
    twice = {"v": lambda x: x * 2}
    out = apply_nested_operations(df, {"top": twice, "in": {"below": twice, "s": {"deep": twice}}}).schema
    inner = out["in"].dataType
    return [("top", out["top"].metadata[FIXED_SIZE]), ("below", inner["below"].metadata[FIXED_SIZE]), ("deep", inner["s"].dataType["deep"].metadata[FIXED_SIZE])]


@query("SELECT c_custkey::BIGINT AS customer_key, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_custkey % 2 = 1 AS is_null, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS literal FROM customer")
def E8c_E9_E13_null_structs_and_literals(spark, sf_dir):
    """A null struct stays null; None keeps a field, a literal makes one."""
    df = _accounts(spark, sf_dir).withColumn("who", F.when(F.col("c_custkey") % 2 == 0, F.col("who")))
    made = apply_nested_operations(df, {"c_custkey": None, "who": {"name": None, "literal": F.lit("x")}})
    return made.select(long("c_custkey").alias("customer_key"), F.col("who.name").alias("name"), F.col("who").isNull().alias("is_null"), F.col("who.literal").alias("literal"))


@query("SELECT c_custkey::BIGINT AS customer_key, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1) AS balance, c_acctbal <= 0 AS missing, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def W13_null_functions(spark, sf_dir):
    level = view(spark, sf_dir, "region", "nation", "customer").level("customer")
    known = F.when(col(BAL) > 0, col(BAL))
    return level.select(long(CK).alias("customer_key"), F.coalesce(known, F.lit(-1.0)).alias("balance"), known.isNull().alias("missing"), F.nullif(col(f"{CU}.c_mktsegment"), F.lit("BUILDING")).alias("segment"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines nested by order and customer, with each customer's quantities rolled up over two hops."""
    return A13_attribute_over_hops(spark, sf_dir)
