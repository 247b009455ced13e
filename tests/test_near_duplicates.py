import random

from auditmill.functions.text import page_words
from auditmill.operators.near_duplicates import classes, pairs
from auditmill.plans import queries
from auditmill.session import cut


def five(text):
    w = page_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    first, out = {}, {}
    for i, t in sorted(docs):
        out[i] = first.setdefault(" ".join(page_words(t)), i)
    sets = {i: five(t) for i, t in docs if out[i] == i}
    near = {}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                near[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return out, near


def documents():
    rng = random.Random(7)
    texts = [None, "", " - ", "Two words", "two  WORDS", "two words more", "äöü ß 日本 one", *[" ".join(rng.choices("a b c".split(), k=8)) for _ in range(60)]]
    for k in [5, 6, 12, 30, 60, 200] * 4:
        words = [f"w{rng.randrange(50)}" for _ in range(k)]
        texts.append(" ".join(words))
        for _ in range(6):
            other = list(words)
            for _ in range(rng.randrange(1 + k // 20)):
                other[rng.randrange(k)] = "x"
            texts.append(" ".join(other[rng.randrange(3) :] + ["end"] * rng.randrange(3)))
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    docs = documents()
    want, near = brute(docs)
    df = spark.createDataFrame(docs, "id long, text string")
    members = cut(classes(df))
    rows = members.collect()
    assert {r.id: r.class_id for r in rows} == want and len(rows) == len(docs)
    got = [tuple(r) for r in pairs(df, members).collect()]
    assert {(a, b): s for a, b, s in got} == near and len(got) == len(near) > 20


def test_query_has_a_row_for_every_document(spark, tmp_path):
    docs = documents()
    want, near = brute(docs)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.class_id, r.links) for r in queries()["jn18_near_duplicates"](spark, str(tmp_path)).collect()}
    assert got == {i: (c, sum(c in p for p in near)) for i, c in want.items()}
