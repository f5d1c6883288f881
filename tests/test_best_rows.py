"""Best-of and keep-first with null keys, null orders and repeated rows."""

from textlens.operators import curves as CV
from textlens.operators import trials as TR
from textlens.operators.dedupe import keep_first

ROWS = [(2, None, "b", 1), (1, None, "a", 0), (None, "t", "c", 5), (None, "t", "c", 5), (None, "t", "d", 6), (4, "u", "e", 2), (4, "u", "e", 2),
        (4, "u", "f", 3), (7, "v", None, None), (7, "v", None, None), (None, "v", "g", 9), (None, None, "h", 8)]


def test_keep_first_keeps_null_groups_and_one_row_of_ties(spark):
    d = spark.createDataFrame(ROWS, "id int, text string, lang string, n int").repartition(3)
    for counted in (False, True):
        got = keep_first(d, "text", "id", count_col="copies" if counted else None).collect()
        by_text = {r.text: r for r in got}
        assert len(got) == 4 and set(by_text) == {None, "t", "u", "v"}
        assert tuple(by_text[None])[:4] == (1, None, "a", 0) and tuple(by_text["v"])[:4] == (7, "v", None, None)
        assert all(tuple(r)[:4] in ROWS for r in got)
        if counted:
            assert {t: r.copies for t, r in by_text.items()} == {None: 3, "t": 3, "u": 3, "v": 3}


def test_keep_first_of_numbers_keeps_a_group_without_order(spark):
    d = spark.createDataFrame([(None, "t", 5), (None, "t", 6), (1, "u", None), (2, "u", 4)], "id int, text string, n int")
    got = {r.text: (r.id, r.n) for r in keep_first(d, "text", "id").collect()}
    assert got["u"] == (1, None) and got["t"] in {(None, 5), (None, 6)}


def test_keep_first_takes_map_columns(spark):
    d = spark.createDataFrame([(1, "t", {"a": 1}), (1, "t", {"a": 1}), (2, "t", {"b": 2})], "id int, text string, m map<string,int>")
    assert [tuple(r) for r in keep_first(d, "text", "id").collect()] == [(1, "t", {"a": 1})]


def test_best_rows_of_null_keys_and_of_groups_without_values(spark):
    t = spark.createDataFrame([(None, 2, 0.5), (None, 1, 0.5), ("p", 3, None), ("p", 2, None), ("s", 1, None), ("s", 2, 0.1)],
                              "study string, trial int, value double")
    assert set(map(tuple, TR.best_trial(t).collect())) == {(None, 1, 0.5), ("p", 2, None), ("s", 2, 0.1)}
    e = t.toDF("model", "step", "eval_loss")
    assert set(map(tuple, CV.best_checkpoint(e).collect())) == {(None, 1, 0.5), ("p", 2, None), ("s", 2, 0.1)}
