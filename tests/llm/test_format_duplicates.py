import json
import random
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from auditmill.llm import folding
from auditmill.llm import format_duplicates as D


def canonical(text):
    t = unicodedata.normalize("NFC", text or "")
    return "".join(ch.casefold() for ch in t if unicodedata.category(ch)[0] in "LN")


TEXT = st.one_of(st.none(), st.text(alphabet="aAäÄéÉß sS-_ .​ 9́ıİK", max_size=12))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=8))
def test_folding_equals_canonical_strings(pairs):
    a, b = (pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))
    want = [canonical(x) == canonical(y) for x, y in pairs]
    assert folding.same(a, b).tolist() == want
    (a1, a2), (b1, b2) = folding.hashes(a), folding.hashes(b)
    assert ((a1 == b1) & (a2 == b2)).tolist() == want


def test_sliced_arrays_and_fields_stay_apart():
    whole = pa.array(["zz", "Ab-c", None, "", "abc"])
    h = folding.hashes(whole.slice(1))[0]
    assert h[0] == h[3] and h[1] == h[2] != h[0]
    x, y = folding.combined([pa.array(["ab", "a"]), pa.array(["c", "bc"])])
    assert x[0] != x[1] and y[0] != y[1]
    assert folding.hashes(pa.array([], pa.string()))[0].dtype == np.uint64


def export(rng, fields):
    keep = {k: v for k, v in fields.items() if v or rng.random() < 0.5}
    dress = lambda v: v if not v else rng.choice([v.upper(), f" {v}! ", v.replace(" ", "_"), v.replace(" ", " \t"), v])
    items = [(k, dress(v)) for k, v in keep.items()]
    rng.shuffle(items)
    return json.dumps(dict(items), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


SHAPE = "export_id long, payload string, id string, h1 int, f0 int"


def test_copies_equal_brute_force(spark):
    rng = random.Random(2)
    kinds = [{"title": f"Tëa pot {i % 9}", "metaDescription": rng.choice([None, "", "Wörds and 12"]), "h1": rng.choice(["One", "Two"])} for i in range(40)]
    rows = [(i, export(rng, rng.choice(kinds)), "x", 1, 2) for i in range(300)] + [(900, None, "", 0, 0), (901, "no json", "", 0, 0), (902, "{}", "", 0, 0), (903, '{"title": "' + "a" * 50_000 + '"}', "", 0, 0), (904, '{"title": "' + "A " * 50_000 + '"}', "", 0, 0)]
    rows += [(1000 + i, '{"title": "hot"}', "", 0, 0) for i in range(300)]
    records = D.from_payload(spark.createDataFrame(rows, SHAPE), "export_id", "payload", ["title", "metaDescription", "h1"])
    groups = {}
    for i, p, *_ in rows:
        try:
            o = json.loads(p or "{}")
            broken = ""
        except ValueError:
            o, broken = {}, p
        groups.setdefault((*[canonical(o.get(k)) for k in ("title", "metaDescription", "h1")], broken), []).append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    got = [tuple(r) for r in D.copies(records).collect()]
    assert set(got) == want and len(got) == len(want)
    once = {r.kept_id: r.copies for r in D.collapsed(records).collect()}
    assert once == {min(g): len(g) - 1 for g in groups.values()}


def test_collisions_are_told_apart(spark, monkeypatch):
    rows = [(1, "abc"), (2, "xyz"), (3, "ABC"), (4, "x.y.z")]
    records = spark.createDataFrame(rows, "id long, f0 string")

    def flat(df, with_fields=False):
        cols = ["id", "0L AS h1", "0L AS h2"] + ["f0"] * with_fields
        return df.selectExpr(*cols)

    monkeypatch.setattr(D, "hashed", flat)
    assert {tuple(r) for r in D.copies(records).collect()} == {(1, 3), (2, 4)}


def test_empty(spark):
    records = D.from_payload(spark.createDataFrame([], SHAPE), "export_id", "payload", ["title", "metaDescription", "h1"])
    assert D.copies(records).count() == 0 and D.collapsed(records).count() == 0


def test_unreadable_payloads_stay_apart(spark):
    rows = [(1, '{"title": "A"}'), (2, "broken {"), (3, "other <html>"), (4, "Broken"), (5, '{"title": null}'), (6, None), (7, "{}")]
    df = spark.createDataFrame(rows, "export_id long, payload string")
    records = D.from_payload(df, "export_id", "payload", ["title"])
    assert {(r.kept_id, r.copy_id) for r in D.copies(records).collect()} == {(2, 4), (5, 6), (5, 7)}
    assert {r.id for r in D.unreadable(df, "export_id", "payload", ["title"]).collect()} == {2, 3, 4}
