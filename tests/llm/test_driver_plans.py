"""What the pipeline's driver has to plan: rounds of components, and exchanges in the plans of the mix."""

from lodeweave.llm import _common, mixing


def _recorded(monkeypatch, module):
    """The exchanges in the plan of each table that the module writes from now on, in order."""
    found = []
    write = _common.written

    def written(df, name="table"):
        found.append(_exchanges(df))
        return write(df, name)

    monkeypatch.setattr(module, "written", written)
    return found


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_components_end_with_the_first_round_that_changes_nothing(spark, monkeypatch):
    rounds = _recorded(monkeypatch, _common)
    stars = spark.createDataFrame([(1, 2), (3, 1), (5, 9), (9, 5)], "a long, b long")
    assert {tuple(r) for r in _common.components(stars).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 5)}
    assert len(rounds) == 2  # the edges, and one round


def test_no_edges_take_no_round(spark, monkeypatch):
    rounds = _recorded(monkeypatch, _common)
    assert _common.components(spark.createDataFrame([(7, 7), (None, 1)], "a long, b long")).count() == 0
    assert len(rounds) == 1


def test_plans_of_the_mix_are_small(spark, monkeypatch):
    plans = _recorded(monkeypatch, mixing)
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"word{i} " * (i % 40)) for i in range(300)], "doc_id long, source string, text string")
    plans.append(_exchanges(mixing.mix(docs)))
    assert max(plans) <= 12
