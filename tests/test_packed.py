import pytest

from auditmill.operators.packed import FieldRule, candidates, parse, split_values, unwrap

ROBOTS, PLAIN = FieldRule(blank_separates=True), FieldRule()


@pytest.mark.parametrize(
    ("text", "separators", "quotes", "values"),
    [
        ('"a, b", c', ",", True, ["a, b", "c"]),
        ('"a ""b""", c', ",", True, ['a "b"', "c"]),
        (r'"a \"b\"", c', ",", True, ['a "b"', "c"]),
        ("'it''s', x", ",", True, ["it's", "x"]),
        ("won't, do", ",", True, ["won't", "do"]),
        ('"open, x', ",", True, ['"open', "x"]),
        (",, a ,,b,", ",", True, ["a", "b"]),
        ("http://x.example/a / b", "/", True, ["http://x.example/a", "b"]),
        ("unavailable_after: Tue, 02 Feb 2027 08:30:00 GMT, noindex", ",", True, ["unavailable_after: Tue, 02 Feb 2027 08:30:00 GMT", "noindex"]),
        ('""', ",", True, []),
        ("", ",", True, []),
    ],
)
def test_parse(text, separators, quotes, values):
    assert parse(text, separators, quotes) == values


def test_brackets_belong_to_no_value():
    assert unwrap(" [ (a, b) ] ") == "a, b"
    assert unwrap("[a], [b]") == "[a], [b]"
    assert unwrap("[") == "["


def test_blanks_separate_only_where_nothing_else_does():
    assert candidates("noindex nofollow", ROBOTS) == {"space": ["noindex", "nofollow"]}
    assert list(candidates("max-snippet: 5 all", ROBOTS).values()) == [["max-snippet: 5 all"]]
    assert ["noindex x", "all"] in candidates("noindex x, all", ROBOTS).values()
    assert list(candidates("In Stock", PLAIN).values()) == [["In Stock"]]


SHAPE = "field_name string, url_id long, raw string, pieces int, n string, cid long"


def test_fields_of_a_corpus(spark):
    rows = [("a", i, "x, y", 0, "", 1) for i in range(30)] + [("a", 40, "x; y, z", 0, "", 1), ("a", 41, None, 0, "", 1), ("a", 42, "  ", 0, "", 1), ("a", 43, "z", 0, "", 1), ("a", 44, "y,y", 0, "", 1), ("a", 45, "y,y", 0, "", 1)]
    rows += [("a", 46, "w" * 20_000 + ",x", 0, "", 1), ("a", None, "x|y", 0, "", 1)]
    got = {}
    for r in split_values(spark.createDataFrame(rows, SHAPE), {"a": PLAIN}).orderBy("url_id", "pos").collect():
        got.setdefault(r.url_id, []).append((r.pos, r.value))
    assert got[3] == [(1, "x"), (2, "y")] and got[40] == [(1, "x"), (2, "y"), (3, "z")]
    assert got[44] == got[45] == [(1, "y"), (2, "y")] and got[43] == [(1, "z")]
    assert [len(v) for _, v in got[46]] == [20_000, 1] and got[None] == [(1, "x"), (2, "y")]
    assert 41 not in got and 42 not in got


def test_single_values_can_be_left_out_and_tables_may_be_empty(spark):
    df = spark.createDataFrame([("a", 1, "x", 0, "", 1), ("a", 2, "x,y", 0, "", 1)], SHAPE)
    assert {r.url_id for r in split_values(df, {"a": PLAIN}, least=2).collect()} == {2}
    assert split_values(df.limit(0), {"a": PLAIN}).count() == 0
