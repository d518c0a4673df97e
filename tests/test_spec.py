import pytest

from millrace.functions.spec import expand, intervals, order_keys
from millrace.operators import columns as col


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`顧客` int, `my qty` int, amount int")
    assert expand(df, "a*,顧客") == ["amount", "顧客"]
    assert expand(df, "0L,0-1", by_index=True) == ["amount", "顧客", "my qty"]
    assert col.cut(df, "my qty:q,顧客").columns == ["q", "顧客"]
    with pytest.raises(ValueError):
        expand(df, "missing")
    with pytest.raises(ValueError):
        col.set_constant(df, {"amount": 1})


def test_order_and_intervals():
    assert [(k.numeric, k.desc) for k in order_keys("a,b%n,c%r,d%nr")] == [(False, False), (True, False), (False, True), (True, True)]
    assert intervals("[1,5),(9,MAX]") == [("[", 1.0, 5.0, ")"), ("(", 9.0, None, "]")]
    with pytest.raises(ValueError):
        order_keys("a%x")


def test_names():
    assert col.unique_names(["A", "", "A", "", "b"]) == ["A^^1", "^^1", "A^^2", "^^2", "b"]
    assert col.unique_names(["A", "b", "A"], prefix=True, by_position=True) == ["1^^A", "b", "3^^A"]
    assert col.blank_names(["A", "", "B", "", "C"]) == ["A", "^^1", "B", "^^2", "C"]
    assert col.group_names(["A", "x", "A", "y"], [("A", "G1"), ("A", "G2")]) == ["A", "G1_x", "A", "G2_y"]
    assert col.group_names(["A", "x", "y", "z"], [("A", "G")], ends=["y"], mark_start=True) == ["G_A", "G_x", "G_y", "z"]
    with pytest.raises(ValueError):
        col.unique_names(["a", "a", "a^^1"])
