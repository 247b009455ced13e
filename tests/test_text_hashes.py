from auditmill.functions.text import fnv1a64
from auditmill.plans import queries


def test_whole_texts_equal_brute_force(spark, tmp_path):
    texts = [None, "", "a", "ä", "日本語 😀", "x" * 70_000, "ü" * 40_000 + "end", "line\nbreak\x00", "ß ss", *[chr(200 + i) * i for i in range(50)]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hash for r in queries()["st4_text_hashes"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else int.from_bytes(fnv1a64(t.encode()).to_bytes(8, "big"), "big", signed=True) for i, t in enumerate(texts)}
