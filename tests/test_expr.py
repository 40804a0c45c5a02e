import math

import pytest

from stratamill.functions.expr import Expression, ExpressionError, Policy, columns


def value(spark, text, policy=Policy(), **metrics):
    df = spark.createDataFrame([tuple(float(v) if v is not None else None for v in metrics.values())] if metrics else [(0.0,)], ", ".join(f"`{k}` double" for k in metrics) or "_ double")
    v, e = Expression(text).compile(columns(list(metrics)), policy)
    return tuple(df.select(v.alias("v"), e.alias("e")).first())


@pytest.mark.parametrize(
    "text, expected",
    [("1 + 2 * 3", 7.0), ("(1 + 2) * 3", 9.0), ("2 - 3 - 4", -5.0), ("8 / 2 / 2", 2.0), ("3 < 2 < 1", 1.0), ("1 == 1 == 1", 1.0), ("-2 * -3", 6.0), ("min(3, max(1, 2))", 2.0), ("abs(-.5) + 5.", 5.5), ("1 != 2", 1.0)],
)
def test_arithmetic(spark, text, expected):
    assert value(spark, text) == (expected, None)


@pytest.mark.parametrize("text", ["", "1 +", "foo(1)", "min(1)", "1 2", "a $ b", "(1", "1e999"])
def test_syntax_errors(text):
    with pytest.raises(ExpressionError):
        Expression(text)


def test_identifiers_in_order():
    assert Expression("b.x + a - b.x * min(c, min)").identifiers == ["b.x", "a", "c", "min"]


def test_first_error_wins(spark):
    assert value(spark, "a / 0 + missing", a=1)[1] == "division_by_zero"
    assert value(spark, "missing + a / 0", a=1)[1] == "missing_metric"
    assert value(spark, "a * 1e300 * 1e300", a=1)[1] == "non_finite_result"
    assert value(spark, "a", a=math.inf)[1] == "non_finite_metric"
    assert value(spark, "a", a=None)[1] == "missing_metric"


def test_ieee_policy(spark):
    ieee = Policy(False, False)
    assert value(spark, "a / 0", ieee, a=1)[0] == math.inf
    assert value(spark, "a / 0", ieee, a=-1)[0] == -math.inf
    assert value(spark, "a / -0.0", ieee, a=1)[0] == -math.inf
    assert math.isnan(value(spark, "a / 0", ieee, a=0)[0])
    assert math.isnan(value(spark, "min(a, 1)", ieee, a=math.nan)[0])
    assert value(spark, "a == a", ieee, a=math.nan)[0] == 0.0


def test_report_aliases(spark):
    assert value(spark, "report.net_profit + total_trades", net_profit=2, **{"report.total_trades": 3}) == (5.0, None)
