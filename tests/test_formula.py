import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.functions import formula as fm

CASES = [
    ("sub(max(u, v), max(u, v))", True), ("sub(u, v)", False), ("add(w, neg(w))", True), ("add(w, neg(max(u, w)))", False), ("div(w, sub(min(u, v), min(u, v)))", True),
    ("abs(add(div(u, v), neg(div(u, v))))", True), ("add(w, w)", False), ("add(neg(w), w)", False), ("sub(max(u, v), max(v, u))", False),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cancels(text, want):
    assert fm.cancels(text) is want


def test_features_used():
    assert fm.features_used("div(macd_8_24, abs(ret_norm_21))") == {"macd_8_24", "ret_norm_21"}
    assert fm.features_used("max(vs_factor, vs_factor)") == {"vs_factor"} and fm.features_used("min(0.5, -0.25)") == set()


def test_guards():
    assert fm.guard("add(a, b)") == "too few features"
    assert fm.guard("add(add(a, b), sub(c, c))") == "cancels"
    assert fm.guard("and(and(gt(a, b), lt(b, c)), or(a, c))") == "mostly logic"
    assert fm.guard("add(mul(a, b), c)") is None
    assert fm.guard("add(" * 20 + "a" + ", b)" * 20 + "") == "too few features" and fm.guard(fm.parse("add(c, " + "add(" * 20 + "a" + ", b)" * 20 + ")")) == "too long"


@pytest.mark.parametrize("text", ["add(a)", "add(a, b", "foo(a, b)", "add(a, b) c", "", "a b", "add(a,, b)"])
def test_bad_text(text):
    with pytest.raises(ValueError):
        fm.parse(text)


leaf = st.one_of(st.sampled_from(["a", "b", "c"]), st.floats(-1, 1).map(lambda x: round(x, 4)))
trees = st.recursive(leaf.map(lambda x: (x,)), lambda kids: st.sampled_from(sorted(fm.ARITY)).flatmap(lambda f: st.tuples(*[kids] * fm.ARITY[f]).map(lambda a: (f, *[x for k in a for x in k]))), max_leaves=8)


@settings(max_examples=100, deadline=None)
@given(trees)
def test_round_trip_of_text(p):
    assert fm.parse(fm.show(p)) == p


def test_columns_match_numpy(spark):
    rng = np.random.default_rng(2)
    cols = {k: rng.normal(size=50) for k in "abc"}
    df = spark.createDataFrame([tuple(map(float, x)) for x in zip(*cols.values())], "a double, b double, c double")
    texts = ["div(a, sub(b, b))", "if_then(gt(a, b), max(b, c), min(a, 0.5))", "or(and(a, lt(b, c)), neg(abs(c)))", "div(mul(a, b), add(c, 0.1))"]
    got = df.select(*[fm.to_column(t).alias(f"p{i}") for i, t in enumerate(texts)]).toPandas()
    for i, t in enumerate(texts):
        np.testing.assert_allclose(np.sort(got[f"p{i}"]), np.sort(fm.evaluate(fm.parse(t), cols, 50)), atol=1e-12)
