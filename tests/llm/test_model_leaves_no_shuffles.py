"""Counting a model shuffles one table at a time: its files are gone before the next step begins."""

from barloom.llm import kneser_ney as kn


def test_no_step_of_a_fit_holds_two_shuffles(spark, monkeypatch):
    exchanges, plain = [], kn.settle

    def watched(df):
        exchanges.append(df._jdf.queryExecution().sparkPlan().toString().count("FlatMapGroupsInArrow"))
        return plain(df)

    monkeypatch.setattr(kn, "settle", watched)
    texts = [f"the {k % 7} cat sat on the {k % 5} mat and {k} went" for k in range(400)]
    model = kn.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), order=3)
    assert exchanges == [1, 1, 1, 1, 1]
    assert model.tokens == sum(len(t.split()) + 1 for t in texts)
