"""Rounds over large graphs move numbers and not names."""

from lodestrata.operators import graph


def test_rounds_of_components_move_numbers(spark, monkeypatch):
    written, plain = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: written.append([k for _, k in df.dtypes]) or plain(df))
    ways = [("b", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("e", "d"), ("g", "g"), ("g", "a"), ("f", "h"), (None, "a"), ("a", None)]
    found = graph.strong_components(spark.createDataFrame(ways, "src string, dst string"), closure_nodes=0)
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d"), ("g", "g")]
    assert sum("string" in kinds for kinds in written) == 2 < len(written)  # the edges given and the nodes with their numbers


def test_joins_of_components_send_no_table_whole_that_grows(spark, monkeypatch):
    sent, plain, few = [], graph.materialise, getattr(graph, "SENT_ROWS", 0)

    def watched(df):
        sent.append("Broadcast" in df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(graph, "materialise", watched)
    monkeypatch.setattr(graph, "SENT_ROWS", -1, raising=False)  # as if all tables were large; their files stay small, as files of numbers do
    ways = [("b", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("e", "d"), ("g", "g"), ("g", "a"), ("f", "h"), ("d", "i"), ("i", "d"), ("p", "q"), ("q", "p"), (None, "a"), ("a", None)]
    found = graph.strong_components(spark.createDataFrame(ways, "src string, dst string"), closure_nodes=0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d"), ("g", "g"), ("i", "d"), ("p", "p"), ("q", "p")]
    assert len(sent) > 10 and not any(sent)
    assert 0 < few <= 200_000
