"""Nested expressions and flattening."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella import apply_nested_operations, convert_schema, field, generate_nested_exprs, unnest_all, unnest_rename, when


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [(1, [("a", 2.0, 3), ("b", None, 1)], ("Ann", 30)), (2, [], ("Bob", None)), (3, None, None)],
        "id long, orders array<struct<item string, price double, quantity long>>, profile struct<name string, age long>",
    )


def test_siblings_see_original_values(orders):
    spec = {"orders": {"price": lambda x: x * 10, "total": field("price") * field("quantity")}}
    got = {r["id"]: r["orders"] for r in orders.select("id", *generate_nested_exprs(spec, orders, "with_fields")).collect()}
    assert got[1][0].asDict() == {"item": "a", "price": 20.0, "quantity": 3, "total": 6.0} and got[1][1]["total"] is None
    assert got[2] == [] and got[3] is None


def test_select_mode_keeps_only_the_spec_in_its_order(orders):
    out = apply_nested_operations(orders, {"id": None, "profile": {"age": None, "shout": field("name").apply(F.upper)}, "orders": {"quantity": None, "item": None}})
    assert out.schema["profile"].dataType.names == ["age", "shout"] and out.schema["orders"].dataType.elementType.names == ["quantity", "item"]
    assert [r["profile"] for r in out.orderBy("id").collect()][2] is None


def test_with_columns_and_new_ones(orders):
    out = apply_nested_operations(orders, {"id": lambda c: c + 1, "n": F.size("orders")}, use_with_columns=True)
    assert out.columns == ["id", "orders", "profile", "n"] and sorted(r["id"] for r in out.collect()) == [2, 3, 4]


def test_conditions_literals_and_reductions(orders):
    spec = {"orders": {"kind": when(field("quantity") > 2, "many").otherwise("few"), "one": F.lit(1), "most": field("price").list_max(), "share": field("quantity") / field("quantity").list_sum()}}
    first = apply_nested_operations(orders, spec).filter(F.size("orders") > 0).first()["orders"]
    assert [x["kind"] for x in first] == ["many", "few"] and first[1]["most"] == 2.0 and first[0]["share"] == 0.75
    back = apply_nested_operations(orders, {"orders": F.reverse}).first()["orders"]
    assert [x["item"] for x in back] == ["b", "a"]


def test_lists_of_lists(spark):
    df = spark.createDataFrame([([[(1,), (2,)], [(3,)]],)], "nested array<array<struct<value long>>>")
    got = apply_nested_operations(df, {"nested": {"value": lambda x: x * 2}}).first()["nested"]
    assert [[x["value"] for x in y] for y in got] == [[2, 4], [6]]


@pytest.mark.parametrize(
    ("spec", "error", "words"),
    [
        ({"nothing": None}, ValueError, "not found"),
        ({"id": {"x": None}}, ValueError, "Cannot recurse"),
        ({"profile": {"nothing": lambda x: x}}, ValueError, "non-existent field"),
        ({"profile": {"nothing": {"x": None}}}, ValueError, "non-existent struct field"),
        ({"profile": {}}, ValueError, "at least one"),
        ({"id": 3}, TypeError, "callable"),
        ({"profile": {"age": 3}}, TypeError, "callable"),
    ],
)
def test_errors(orders, spec, error, words):
    with pytest.raises(error, match=words):
        apply_nested_operations(orders, spec)


def test_bad_mode(orders):
    with pytest.raises(ValueError, match="struct_mode"):
        generate_nested_exprs({"id": None}, orders, "both")


def test_flatten_and_schema(spark, orders):
    assert unnest_rename(orders, "profile").columns == ["id", "orders", "profile.name", "profile.age"]
    deep = spark.createDataFrame([(((1, "x"), [1]),)], "a struct<b struct<c long, `d.e` string>, f array<long>>")
    flat = unnest_all(deep, "_")
    assert flat.columns == ["a_b_c", "a_b_d.e", "a_f"] and tuple(flat.first()) == (1, "x", [1])
    assert unnest_all(orders.select("id")).columns == ["id"]
    schema = T.StructType([T.StructField("v", T.ArrayType(T.LongType()), metadata={"fixed_size": 2}), T.StructField("s", T.StructType([T.StructField("w", T.ArrayType(T.StringType()))]))])
    assert convert_schema(schema) == {"v": (T.LongType(), 2), "s": {"w": [T.StringType()]}}
