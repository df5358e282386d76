"""Laws that tie flat, nested and normalized frames to each other."""

import pytest
from pyspark.sql import functions as F

from lamella import HierarchicalPacker, HierarchySpec, HierarchyValidationError, HierarchyView, LevelAttribute, LevelSpec, discover_levels
from lamella.plans.naming import col
from tests.conftest import rows

LINEAR = HierarchySpec.from_levels([LevelSpec("farm", ["tag"]), LevelSpec("field", ["id"]), LevelSpec("bed", ["id"], required_fields=["id"])])
TREE = HierarchySpec.from_levels(
    [
        LevelSpec("farm", ["tag"]),
        LevelSpec("field", ["id"], parent="farm"),
        LevelSpec("bed", ["id"], parent="field"),
        LevelSpec("plant", ["id"], parent="bed"),
        LevelSpec("pump", ["make"], parent="field"),
    ]
)
K, C = "farm.tag", "farm.field.id"
#: Children in an order that doesn't depend on how joins deal the rows.
ORDERED = HierarchySpec.from_levels(LevelSpec("farm", ["tag"]), LevelSpec("field", ["id"], order_by=["`farm.field.id`"]), LevelSpec("bed", ["id"], required_fields=["id"], order_by=["`farm.field.bed.id`"]))


@pytest.fixture(scope="module")
def flat(spark):
    names = [K, "farm.name", C, "farm.field.acres", "farm.field.bed.id", "farm.field.bed.width"]
    data = [("oak", "Oak Hill", "north", 10, "s2", 20), ("oak", "Oak Hill", "north", 10, "s1", 10), ("oak", "Oak Hill", "low", 5, "s3", 30), ("elm", "Elm End", "pond", 2, "s4", None)]
    return spark.createDataFrame(data, "`" + "` string, `".join(names[:3]) + "` string, `farm.field.acres` long, `farm.field.bed.id` string, `farm.field.bed.width` long").select(*[col(n) for n in names]).coalesce(1)


@pytest.fixture(scope="module")
def tables(spark):
    def make(data, schema):
        return spark.createDataFrame(data, schema).coalesce(1)

    k, c = f"`{K}` string", f"`{C}` string"
    s = "`farm.field.bed.id` string"
    return {
        "farm": make([("oak", "Oak Hill"), ("elm", "Elm End"), ("ash", "Ash Row")], f"{k}, `farm.name` string"),
        "field": make([("oak", "north", 10), ("oak", "low", 5), ("elm", "pond", 2), ("ash", "brow", 3)], f"{k}, {c}, `farm.field.acres` long"),
        "bed": make([("oak", "north", "s1", 10), ("oak", "north", "s2", 20), ("oak", "low", "s3", 30), ("elm", "pond", "s4", 40)], f"{k}, {c}, {s}, `farm.field.bed.width` long"),
        "plant": make([("oak", "north", "s1", "b1", 5), ("oak", "north", "s2", "b2", 6), ("oak", "low", "s3", "b3", 7), ("elm", "pond", "s4", "b4", 8)], f"{k}, {c}, {s}, `farm.field.bed.plant.id` string, `farm.field.bed.plant.buds` long"),
        "pump": make([("oak", "north", "hand", 1), ("oak", "north", "wind", 2), ("oak", "low", "hand", 3), ("elm", "pond", "diesel", 4), ("ash", "brow", "hand", 5)], f"{k}, {c}, `farm.field.pump.make` string, `farm.field.pump.litres` long"),
    }


@pytest.mark.parametrize("level", ["farm", "field", "bed"])
def test_pack_and_unpack_are_inverse_at_every_level(flat, level):
    p = HierarchicalPacker(LINEAR)
    packed = p.pack(flat, level)
    assert p.infer_current_level(packed) == level
    again = p.unpack(p.pack(flat, "farm"), level)
    assert packed.columns == again.columns and rows(packed) == rows(again)
    assert rows(p.unpack(packed, "bed")) == rows(flat)
    assert rows(p.denormalize(p.normalize(flat, at_level=level), at_level=level)) == rows(packed)
    assert rows(p.pack(flat, level, parent_strategy="split_join")) == rows(packed)
    for how in ("balanced", "hash"):
        streamed = p.pack_streaming(flat, level, partitions=3, partition_strategy=how)
        assert streamed.schema == packed.schema and rows(streamed) == rows(packed)


def test_children_keep_input_order_or_the_declared_one(flat):
    first = HierarchicalPacker(LINEAR).pack(flat, "farm").filter(col(K) == "oak").first()
    assert [s["id"] for s in first["farm.field"][0]["bed"]] == ["s2", "s1"]
    spec = HierarchySpec.from_levels([LevelSpec("farm", ["tag"]), LevelSpec("field", ["id"], order_by=[col(C)]), LevelSpec("bed", ["id"], order_by=[col("farm.field.bed.id")])])
    got = HierarchicalPacker(spec).pack(flat, "farm").filter(col(K) == "oak").first()["farm.field"]
    assert [c["id"] for c in got] == ["low", "north"] and [s["id"] for s in got[1]["bed"]] == ["s1", "s2"]


def test_branches_fold_apart_and_split_again(tables):
    p = HierarchicalPacker(TREE)
    nested = p.denormalize(tables)
    oak = nested.filter(col(K) == "oak").first()["farm.field"]
    north = next(c for c in oak if c["id"] == "north")
    assert [s["id"] for s in north["bed"]] == ["s1", "s2"] and [s["make"] for s in north["pump"]] == ["hand", "wind"]
    back = p.split_levels(nested)
    for name in ("farm", "field", "pump"):
        assert rows(back[name]) == rows(tables[name])
    for axis in ("plant", "pump"):
        assert rows(p.pack(p.unpack(nested.filter(col(K) != "ash"), axis), "farm")) == rows(nested.filter(col(K) != "ash"))


def test_a_frame_flat_along_two_branches_keeps_every_child_once(tables):
    p = HierarchicalPacker(TREE)
    crossed = tables["farm"].join(tables["field"], K).join(tables["bed"], [K, C]).join(tables["pump"], [K, C])
    field = p.pack(crossed, "field").filter(col(C) == "north").first()
    assert sorted(s["id"] for s in field["farm.field.bed"]) == ["s1", "s2"] and sorted(s["make"] for s in field["farm.field.pump"]) == ["hand", "wind"]


def test_tables_from_foreign_keys(spark):
    spec = HierarchySpec.from_levels([LevelSpec("region", ["id"]), LevelSpec("store", ["id"], parent_keys=["region_id"], parent="region"), LevelSpec("club", ["id"], parent_keys=["region_id"], parent="region")])
    p = HierarchicalPacker(spec)
    sources = {
        "region": spark.createDataFrame([(1, "N"), (2, "S"), (3, "E")], "id long, name string"),
        "store": spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 9)], "id long, region_id long"),
        "club": spark.createDataFrame([(20, 1), (21, 1)], "id long, region_id long"),
    }
    built = {r["region.id"]: r for r in p.build_from_tables(sources).collect()}
    assert sorted(s["id"] for s in built[1]["region.store"]) == [10, 11] and sorted(s["id"] for s in built[1]["region.club"]) == [20, 21]
    assert [s["id"] for s in built[3]["region.store"]] == [None]
    assert [r["region.id"] for r in p.build_from_tables(sources, join_type="inner").collect()] == [1]
    with pytest.raises(HierarchyValidationError):
        p.build_from_tables({"store": sources["store"]})


def test_attributes_over_hops(flat):
    p = HierarchicalPacker(LINEAR)
    packed = p.pack(flat, "farm")
    wanted = [LevelAttribute("width", "bed", a, a) for a in ("sum", "mean", "min", "max", "count", "first", "last", "single", "list", "set")]
    got = {r[K]: r for r in p.enrich(packed, *wanted, LevelAttribute("acres", "field", "sum", "people"), at_level="farm").collect()}
    oak, elm = got["oak"], got["elm"]
    assert oak["farm.sum"] == 60 and oak["farm.mean"] == (15 + 30) / 2 and oak["farm.count"] == 3 and oak["farm.people"] == 15
    assert oak["farm.list"] == [[20, 10], [30]] and oak["farm.first"] == 20 and oak["farm.last"] == 30 and oak["farm.max"] == 30
    assert elm["farm.sum"] == 0 and elm["farm.mean"] is None and elm["farm.count"] == 1 and elm["farm.set"] == [[]]
    promoted = p.promote_attribute(flat, "width", from_level="bed", to_level="field", agg="max")
    assert {r[C]: r["farm.field.width"] for r in promoted.collect()} == {"north": 20, "low": 30, "pond": None}
    with pytest.raises(ValueError):
        p.attribute_expr("tag", from_level="farm", to_level="field")


def test_child_predicates(spark):
    p = HierarchicalPacker(LINEAR)
    df = spark.createDataFrame(
        [("all", [("a", 9)]), ("some", [("a", 9), ("b", 1)]), ("none", []), ("unknown", None), ("gap", [("a", None)])],
        f"`{K}` string, `farm.field` array<struct<id string, acres long>>",
    )
    big = lambda x: x["acres"] > 5
    some = p.any_child_satisfies(df, from_level="field", to_level="farm", condition=big)
    every = p.all_children_satisfy(df, from_level="field", to_level="farm", condition=big)
    assert sorted(r[0] for r in some.collect()) == ["all", "some"] and sorted(r[0] for r in every.collect()) == ["all", "none", "unknown"]
    with pytest.raises(ValueError):
        p.any_child_satisfies(df, from_level="bed", to_level="farm", condition=big)


def test_view_filters_all_levels(tables):
    v = HierarchyView.from_tables(tables, HierarchicalPacker(TREE))
    seen = v.filter(col("farm.field.pump.make") == "hand").tables()
    # ash has a hand but no streets: pruning takes its field, and then its pump, away
    assert sorted(r[C] for r in seen["field"].collect()) == ["low", "north"] and seen["pump"].count() == 2 and seen["bed"].count() == 3 and seen["farm"].count() == 1
    kept = HierarchyView.from_tables(tables, HierarchicalPacker(TREE), empty_parents="keep").filter(col("farm.field.pump.make") == "hand").tables()
    assert kept["field"].count() == 4 and kept["pump"].count() == 3
    assert v.filter(col(K) == "oak").tables()["plant"].count() == 3
    across = v.filter(col("farm.field.bed.width") > col("farm.field.acres") * 4).tables()
    assert sorted(r["farm.field.bed.id"] for r in across["bed"].collect()) == ["s3", "s4"]
    with pytest.raises(ValueError, match="branches"):
        v.filter(col("farm.field.bed.width") > col("farm.field.pump.litres"))
    with pytest.raises(KeyError):
        v.filter(col("farm.field.nothing") > 1)


def test_view_window_and_aggregate_predicates(tables):
    from pyspark.sql import Window

    v = HierarchyView.from_tables(tables, HierarchicalPacker(TREE), empty_parents="keep")
    n = "`farm.field.bed.width`"
    top = v.filter(F.col(n) == F.max(n).over(Window.partitionBy(f"`{K}`")))
    assert sorted(r["farm.field.bed.id"] for r in top.tables()["bed"].collect()) == ["s3", "s4"]
    assert v.filter(F.max(n) > 1000).tables()["bed"].count() == 0
    with pytest.raises(ValueError, match="over"):
        v.filter(F.col(n) > F.avg(n))


def test_view_equals_packing_the_filtered_frame(flat):
    p = HierarchicalPacker(ORDERED)
    v = HierarchyView.from_frame(flat, p)
    for predicate in (col("farm.field.bed.width") >= 20, col("farm.field.acres") > 3, col("farm.name") == "Oak Hill", col(C).isin("low", "pond")):
        want = p.pack(flat.filter(predicate), "farm")
        got = v.filter(predicate)
        assert rows(got.nested()) == rows(want)
        for name, table in p.split_levels(want).items():
            assert rows(got.tables()[name]) == rows(table)
        assert rows(got.level("field")) == rows(p.unpack(want, "field").drop("farm.field.bed"))


def test_view_with_level_and_promotion(flat, tmp_path, spark):
    v = HierarchyView.from_frame(flat, HierarchicalPacker(LINEAR))
    share = v.with_level("bed", lambda t: t.withColumn("farm.field.bed.share", col("farm.field.bed.width") / col("farm.field.acres")))
    got = {r["farm.field.bed.id"]: r["farm.field.bed.share"] for r in share.tables()["bed"].collect()}
    assert got == {"s1": 1.0, "s2": 2.0, "s3": 6.0, "s4": None} and "farm.field.acres" not in share.tables()["bed"].columns
    up = v.with_level("bed", lambda t: t.withColumn("farm.field.total", F.sum("`farm.field.bed.width`").over(__import__("pyspark").sql.Window.partitionBy(f"`{C}`"))), promote="unique")
    assert {r[C]: r["farm.field.total"] for r in up.tables()["field"].collect()} == {"north": 30, "low": 30, "pond": None}
    with pytest.raises(ValueError, match="promote"):
        v.with_level("bed", lambda t: t.withColumn("farm.field.x", F.lit(1)))
    with pytest.raises(ValueError, match="key"):
        v.with_level("bed", lambda t: t.drop(C))
    v.sink_parquet(str(tmp_path))
    again = HierarchyView.scan_parquet(str(tmp_path), HierarchicalPacker(LINEAR), spark=spark)
    assert rows(again.nested()) == rows(v.nested())
    with pytest.raises(FileNotFoundError):
        HierarchyView.scan_parquet(str(tmp_path / "none"), HierarchicalPacker(LINEAR), spark=spark)


def test_introspection_and_errors(flat):
    p = HierarchicalPacker(LINEAR)
    assert p.get_level_fields("field", flat) == ["id", "acres"] == p.get_level_fields("field", p.pack(flat, "farm"))
    assert p.get_level_keys("bed", include_ancestors=True, form="long") == [K, C, "farm.field.bed.id"]
    assert p.validate_schema(flat).is_compatible and not p.validate_schema(flat, expected_level="field").is_compatible
    assert [d.name for d in discover_levels(p.pack(flat, "farm"))] == ["farm", "field", "bed"]
    assert "inherits farm.tag, farm.field.id" in p.describe()
    assert p.validate(flat) == []
    with pytest.raises(HierarchyValidationError):
        p.validate(flat.withColumn(K, F.lit(None).cast("string")))
    with pytest.raises(HierarchyValidationError):
        p.check_uniform(flat.withColumn("farm.name", col("farm.field.bed.id")), "farm")
    with pytest.raises(HierarchyValidationError):
        p.pack(flat.withColumn("other", F.lit(1)), "field", extra_columns="error")
    assert "other" in p.pack(flat.withColumn("other", F.lit(1)), "field").columns
    for bad in ([LevelSpec("a"), LevelSpec("a")], [LevelSpec("a"), LevelSpec("b", parent="c"), LevelSpec("c", parent="a")], [LevelSpec("a", parent="b"), LevelSpec("b")]):
        with pytest.raises(ValueError):
            HierarchySpec.from_levels(bad)
    with pytest.raises(KeyError):
        p.pack(flat, "planet")


@pytest.mark.parametrize("sep", ["__", "::", "/", "|", " -> "])
def test_separators(spark, sep):
    spec = HierarchySpec.from_levels([LevelSpec("region", ["id"]), LevelSpec("store", ["id"])])
    p = HierarchicalPacker(spec, granularity_separator=sep)
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 3, 4.0)], "a long, b long, c double").toDF(f"region{sep}id", f"region{sep}store{sep}id", p.join_path(["region", "store", f"net{sep}sales"]))
    packed = p.pack(df, "region")
    assert packed.columns == [f"region{sep}id", f"region{sep}store"] and rows(p.unpack(packed, "store")) == rows(df)


def test_co_located_pack_shuffles_once(flat):
    p = HierarchicalPacker(LINEAR)
    plan = p.pack(flat, "farm", co_locate=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def greedy(sizes, partitions):
    share, out, bucket, filled = max(1, -(-sum(sizes) // partitions)), [], 0, 0
    for size in sizes:
        if filled and filled + size > share:
            bucket, filled = bucket + 1, 0
        out.append(bucket)
        filled += size
    return out


TWO = HierarchicalPacker(HierarchySpec.from_levels(LevelSpec("a", ["id"]), LevelSpec("b", ["id"])))


def test_buckets_take_entities_until_one_would_carry_them_over(spark):
    sizes = [1, 10, 1, 1, 1, 1, 1, 4, 30, 2, 2]
    keys = [None, *range(1, len(sizes))]
    df = spark.createDataFrame([(k, i) for k, n in zip(keys, sizes) for i in range(n)], "`a.id` long, `a.b.id` long").repartition(5)
    for partitions in (1, 2, 4, 8, 100):
        got = {(r["a.id"], r["__hier_bucket"]) for r in TWO.balanced_buckets(df, partitions).collect()}
        assert got == set(zip(keys, greedy(sizes, partitions)))
    assert TWO.balanced_buckets(df.limit(0), 4).count() == 0


def test_buckets_of_many_entities_by_join_and_in_runs(spark, monkeypatch):
    from lamella.streaming import bounded

    monkeypatch.setattr(bounded, "FEW", 3)
    monkeypatch.setattr(bounded, "FETCH", 7)
    sizes = [(k * 7) % 5 + 1 + 40 * (k % 11 == 0) for k in range(90)]
    df = spark.createDataFrame([(k, i) for k, n in enumerate(sizes) for i in range(n)], "`a.id` long, `a.b.id` long")
    got = {(r["a.id"], r["__hier_bucket"]) for r in TWO.balanced_buckets(df, 20).collect()}
    assert got == set(enumerate(greedy(sizes, 20)))


def test_balanced_packing_is_sorted_and_shuffles_once(spark, tmp_path):
    df = spark.createDataFrame([(k % 60, k) for k in range(900)], "`a.id` long, `a.b.id` long")
    lazy = TWO.pack_streaming(df, "a", partitions=12)
    assert plan_of(lazy).count("Exchange") == 1
    first, again = (TWO.pack_streaming(df, "a", partitions=12, defer=False, tmp_dir=str(tmp_path)) for _ in range(2))
    assert rows(first) == rows(again) == rows(TWO.pack(df, "a"))
    placed = first.selectExpr("_metadata.file_name AS file", "_metadata.row_index AS row", "`a.id` AS id").orderBy("file", "row").collect()
    assert [r["id"] for r in placed] == list(range(60)) and len({r["file"] for r in placed}) >= 10


def test_packing_fails_on_attributes_that_vary(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (2, None, 7), (2, "z", 8)], "`a.id` long, `a.name` string, `a.b.id` long")
    with pytest.raises(Exception, match="several values"):
        TWO.pack(df, "a").collect()
    assert {r["a.id"]: r["a.name"] for r in TWO.pack(df.coalesce(1), "a", validate=False).collect()} == {1: "x", 2: "z"}
    assert {r["a.id"]: r["a.name"] for r in TWO.pack(df.filter("`a.id` = 2"), "a").collect()} == {2: "z"}


def test_roll_up_equals_enriching_what_is_packed(flat):
    p = HierarchicalPacker(ORDERED, preserve_child_order=False)
    wanted = [LevelAttribute("width", "bed", a, a) for a in ("sum", "mean", "min", "max", "count", "first", "last", "single")]
    for level in ("farm", "field"):
        want = p.enrich(p.pack(flat, level), *wanted, at_level=level)
        got = p.roll_up(flat, *wanted, at_level=level)
        single = got.columns[-1]
        kept = [c for c in got.columns if not c.endswith(".single")]
        assert rows(got.select(*[col(c) for c in kept])) == rows(want.select(*[col(c) for c in kept])), single
    with pytest.raises(ValueError):
        p.roll_up(flat, LevelAttribute("width", "bed", "list"), at_level="farm")


def test_aliases_name_computed_keys():
    from lamella.plans.spec import named

    assert named(F.lower(F.col("x")).alias("k AS 'v'")).name == "k AS 'v'" and named("plain") == "plain"
    with pytest.raises(ValueError):
        named(F.col("x"))


def test_unpack_runs_on_a_stream(spark, flat, tmp_path):
    p = HierarchicalPacker(LINEAR)
    packed = p.pack(flat, "farm")
    packed.write.parquet(str(tmp_path / "in"))
    stream = p.unpack_streaming(spark.readStream.schema(packed.schema).parquet(str(tmp_path / "in")), "bed")
    query = stream.writeStream.format("memory").queryName("unpacked").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("unpacked")) == rows(flat)


def test_pack_streaming_from_a_path_and_written(spark, flat, tmp_path):
    p = HierarchicalPacker(LINEAR)
    flat.write.parquet(str(tmp_path / "flat"))
    got = p.pack_streaming(str(tmp_path / "flat"), "farm", partitions=2, defer=False, tmp_dir=str(tmp_path), spark=spark)
    assert rows(p.unpack(got, "bed")) == rows(flat)
    empty = p.pack_streaming(flat.limit(0), "field")
    assert empty.count() == 0 and empty.schema == p.pack(flat, "field").schema
    for bad in ({"partitions": 0}, {"partition_strategy": "round"}):
        with pytest.raises(ValueError):
            p.pack_streaming(flat, "field", **bad)


def test_null_root_keys_keep_their_attributes(spark):
    p = HierarchicalPacker(LINEAR)
    df = spark.createDataFrame([(None, "none", "a", 1), (None, "none", "b", 2), ("x", None, "c", 3)], f"`{K}` string, `farm.name` string, `{C}` string, `farm.field.acres` long")
    assert rows(p.pack(df, "farm", parent_strategy="split_join")) == rows(p.pack(df, "farm"))
    assert {r[K]: (r["farm.name"], len(r["farm.field"])) for r in p.pack(df, "farm").collect()} == {None: ("none", 2), "x": (None, 1)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attributes_read_only_their_own_leaf(spark, flat, tmp_path):
    p = HierarchicalPacker(LINEAR)
    p.pack(flat, "farm").write.parquet(str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    schema = plan_of(packed.select(p.attribute_expr("acres", from_level="field", to_level="farm", agg="sum"))).split("ReadSchema: ")[1]
    assert "acres" in schema and "width" not in schema and "bed" not in schema


def test_view_pushes_filters_and_columns_to_the_scans(spark, flat, tmp_path):
    p = HierarchicalPacker(LINEAR)
    HierarchyView.from_frame(flat, p).sink_parquet(str(tmp_path))
    v = HierarchyView.scan_parquet(str(tmp_path), p, spark=spark, empty_parents="keep")
    plan = plan_of(v.filter(col(K) == "oak").tables()["bed"].select(col("farm.field.bed.width")))
    assert "EqualTo(farm.tag,oak)" in plan or "EqualTo(`farm.tag`,oak)" in plan
    plan = plan_of(v.level("bed").select(col("farm.field.bed.width")))
    assert "acres" not in plan and "farm.name" not in plan
    assert "Join" not in plan_of(v.tables()["bed"])


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from lamella.sources.scratch import scratch_scope, small_batches, written

    place = lambda path: path.removeprefix("file://").removeprefix("file:")
    with scratch_scope(spark):
        _, outer = written(spark.range(3), "outer")
        with scratch_scope(spark):
            _, inner = written(spark.range(3), "inner")
            assert os.path.isdir(place(inner))
        assert os.path.isdir(place(outer)) and not os.path.exists(place(inner))
    kept, path = written(spark.range(3), "kept")
    assert not os.path.exists(place(outer)) and os.path.isdir(place(path)) and kept.count() == 3
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark, 500):
        with small_batches(spark, 200):
            assert spark.conf.get(key) == "200"
        assert spark.conf.get(key) == "500"
    assert spark.conf.get(key) == before
