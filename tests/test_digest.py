import functools
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnflow.functions import digest


def test_plain_values():
    h = digest.value_hash
    assert h(1) != h(1.0) and h(1.0) == h(1.00000001) and h(1.0) != h(1.0001)
    assert h(None) == h(float("nan")) and h(True) != h(1)
    assert h({"a": 1, "b": 2}) == h({"b": 2, "a": 1}) != h({"a": 2, "b": 1})
    assert h([1, 2]) != h([2, 1]) and h({1, 2}) == h({2, 1}) and h("ab") != h(b"ab")
    with pytest.raises(TypeError):
        h(threading.Lock())


def test_functions():
    def f(x, k=1):
        return x + k

    def g(x, k=2):
        return x + k

    def closing(n):
        return lambda x: x + n

    h = digest.value_hash
    assert h(f) == h(f) != h(g)
    assert h(closing(1)) == h(closing(1)) != h(closing(2))
    assert h(functools.partial(f, 1)) != h(functools.partial(f, 2))


def test_arguments_are_told_apart_by_name():
    a, b = digest.value_hash(1), digest.value_hash(2)
    assert digest.arguments_hash({"a": a, "b": b}) == digest.arguments_hash({"b": b, "a": a}) != digest.arguments_hash({"a": b, "b": a})


def test_truncated():
    assert digest.truncated({"a": {"b": {"c": {"d": "x"}}}, "e": "y"}, 2).keys() == {"a.b", "e"}


def test_frames(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (2, None, 2.0), (None, "b", None)], "x int, y string, z double")
    h = digest.frame_hash
    assert h(df) == h(df.orderBy("z", ascending=False)) == h(df.repartition(3))
    assert h(df) != h(df.distinct()) and h(df) != h(df.union(df)) and h(df.limit(0)) != h(df)
    assert h(df) != h(df.withColumnRenamed("x", "w"))
    a = spark.createDataFrame([(None, 1)], "x int, y int")
    b = spark.createDataFrame([(1, None)], "x int, y int")
    assert h(a) != h(b)
    zero = spark.createDataFrame([(0.0,)], "x double")
    assert h(zero) == h(spark.createDataFrame([(-0.0,)], "x double")) == h(spark.createDataFrame([(1e-9,)], "x double"))
    assert h(df, ordered_by=["z", "y"]) != h(df)
    nested = spark.createDataFrame([([1.0, None], {"a": 1, "b": 2})], "x array<double>, y map<string,int>")
    assert h(nested) == h(nested.repartition(2))


@settings(max_examples=10, deadline=None)
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.text("ab", max_size=2))), max_size=6), seed=st.randoms())
def test_order_of_rows_does_not_matter(spark, rows, seed):
    other = list(rows)
    seed.shuffle(other)
    schema = "x int, y string"
    assert digest.frame_hash(spark.createDataFrame(rows, schema)) == digest.frame_hash(spark.createDataFrame(other, schema))
