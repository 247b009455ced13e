import random

from pyspark.sql import functions as F

from auditmill.llm import residue as R

GOOD = ["Oak table, {n} cm", "How to choose a lamp no {n}", "Walnut shelf for the hall {n}", "Caring for wool rugs {n}", "The blue room guide {n}", "Page-turning stories for {n} nights", "Placeholder cards for table {n}"]
BAD = ["{{{{ page.title }}}}", "404 Not Found", "Please enable JavaScript", "Lorem ipsum dolor sit amet", "undefined", "[object Object]", "Insert title here", "Page not found | Oakshop", "Access denied", "%%seo_title%%", "503 Service Unavailable"]
SHAPE = "url_id long, field_name string, text string, score int, ids int, known string"


def corpus(seed=1, n=700):
    rng = random.Random(seed)
    rows = [(i, "title", rng.choice(GOOD).format(n=rng.randrange(500)), 0, 0, "") for i in range(n)]
    rows += [(n + i, "h1", t.format(), 0, 0, "") for i, t in enumerate(BAD)]
    return rows, set(range(n, n + len(BAD)))


def test_residue_is_found_and_content_kept(spark):
    rows, bad = corpus()
    odd = [(9000, "title", None, 0, 0, ""), (9001, "title", "", 0, 0, ""), (9002, "h1", " \t", 0, 0, ""), (9003, "title", "Oak table " * 4000, 0, 0, ""), (9004, "title", "Oak table, 5 cm | {{ shop.name }}", 0, 0, ""), (9005, "h1", "undefined", 0, 0, ""), (9005, "h1", "undefined", 0, 0, "")]
    got = [(r.url_id, r.field_name) for r in R.residue(spark.createDataFrame(rows + odd, SHAPE).select("url_id", "field_name", "text")).collect()]
    ids = {i for i, _ in got}
    assert bad <= ids and {9004, 9005} <= ids
    assert ids - bad == {9004, 9005} and len(got) == len(bad) + 3


def test_new_forms_are_learned_from_their_company(spark):
    rows, _ = corpus()
    rows += [(8000 + i, "title", f"Error 404: gone fishing {'| Oakshop' * (i % 2)}", 0, 0, "") for i in range(6)]
    rows += [(8100, "title", "[404] gone fishing", 0, 0, "")]
    ids = {r.url_id for r in R.residue(spark.createDataFrame(rows, SHAPE).select("url_id", "field_name", "text")).collect()}
    assert 8100 in ids


def test_forms_of_families_without_a_seed_are_found(spark):
    """The seed is a third of the families; the model has to find the others by what they share with it."""
    slots = ["page_title", "seo_title", "shop.name", "product.title", "post_title", "meta.title"]
    wraps = ["{{{{ {} }}}}", "{{{{{}}}}}", "[[{}]]", "%%{}%%", "<%= {} %>", "${{{}}}", "<{}>"]
    says = ["not found", "forbidden", "gone", "bad gateway", "no such page", "overloaded"]
    frames = ["Error 404: {}", "404 – {}", "HTTP 404 {}", "Oops, {}"]
    wanted = [w.format(x) for w in wraps for x in slots] + [f.format(x) for f in frames for x in says]
    rng = random.Random(4)
    rows = [(i, "title", rng.choice(GOOD).format(n=rng.randrange(500)), 0, 0, "") for i in range(1500)]
    rows += [(5000 + i, "h1", t + rng.choice(["", " | Oakshop", "!"]), 0, 0, "") for i, t in enumerate(wanted * 2)]
    fields = spark.createDataFrame(rows, SHAPE).select("url_id", "field_name", "text")
    families = ["braces", "status", "missing"]
    bad = {r[2] for r in rows if r[0] >= 5000}
    seeded = {r.text for r in R.units(fields.select("text").distinct(), families).filter("known").collect()}
    assert len(bad - seeded) >= 0.2 * len(bad)
    found = {r.text for r in R.scored(fields, families=families).collect()}
    assert len(found & (bad - seeded)) >= 0.9 * len(bad - seeded) and not found - bad
    first = {r.text for r in R.scored(fields, rounds=0, families=families).collect()}
    assert len(first & bad) < len(found & bad)


def test_words_of_residue_in_content_are_no_cases(spark):
    rows, _ = corpus(n=1200)
    rows += [(7000 + i, "title", f"Access Denied – the escape-room {w} {i}", 0, 0, "") for i, w in enumerate(["table", "lamp", "shelf", "rug"] * 10)]
    rows += [(7100 + i, "title", f"[Refurbished] walnut shelf {i}", 0, 0, "") for i in range(40)]
    rows += [(7200, "title", "Access Denied", 0, 0, ""), (7201, "title", "Error 500 <3", 0, 0, "")]
    ids = {r.url_id for r in R.residue(spark.createDataFrame(rows, SHAPE).select("url_id", "field_name", "text")).collect()}
    assert 7200 in ids and not ids & set(range(7000, 7140))


def test_passages_and_trust(spark):
    texts = ["Tray | {{x.y}}", "404 – Not found | Shop", "Copper %%page_title%% lamp", " \t", "[Handmade] tray", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(R.passages(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [["tray", "{{x.y}}"], ["404", "not found", "shop"], ["copper", "%%page_title%%", "lamp"], [], ["[handmade] tray"], []]
    cases = {("seite nicht gefunden", False): True, ("asdf asdf", False): True, ("null", True): True, ("access denied", True): False, ("access denied!", False): True, ("null island map", False): False, ("enter the loft", False): False, ("", False): False}
    df = spark.createDataFrame(list(cases), "u string, b boolean").coalesce(1)
    assert [r[0] for r in df.select(R.trusted(F.col("u"), F.col("b"))).collect()] == list(cases.values())


def test_empty(spark):
    none = spark.createDataFrame([], SHAPE).select("url_id", "field_name", "text")
    assert R.residue(none).count() == 0
    content = spark.createDataFrame([(1, "title", "Oak table", 0, 0, "")], SHAPE).select("url_id", "field_name", "text")
    assert R.residue(content).count() == 0
