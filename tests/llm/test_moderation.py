import numpy as np
import pytest

from auditmill.llm import boosting, moderation as M

GOOD = ["The stupid screw cost me an hour.", "I felt like an idiot when it fit.", "Kill the process and start again.", "Comments with insults are removed.", "Our guide to oak tables.", "Delivery took 5 days, too long.", "Tits and finches love this box.", "Der Tisch passt gut in jede Küche.", "La chatte dort sur la table.", "El pedido llega mañana.", "A hard steel core keeps it straight.", "Rats chewed the feet."]
BAD = ["You are a worthless idiot.", "Kill yourself, nobody would miss you.", "Immigrants are vermin and should be driven out.", "Horny singles want to fuck tonight.", "Halt die Fresse, du Arschloch.", "Ferme ta gueule, connard.", "Te voy a partir la cara, cabrón.", "I hope you die, moron.", "Gays are filth, get rid of them all.", "Watch her suck cock.", "Shut your mouth, bitch.", "People like you should be shot."]

GOOD += ["The lid rattles a bit.", "Three stars because it scratched.", "I would buy it again for my sister.", "Burn marks on the shelf were replaced.", "He got shot of the broken rack.", "We met many immigrants at the fair.", "Women and men alike book our workshop.", "You can order a new hinge from us.", "My dog loves the wool rug.", "Is your lamp hard to clean?", "Damn, that mirror is pretty.", "Wir haben 4 Seiten gefunden."]
BAD += ["Go to hell, scumbag.", "You are a disgusting wanker.", "Every one of those refugees is a parasite and should be locked up.", "Big hard cock ready in your area.", "Crawl back into your hole, you moron.", "Somebody should burn your house with you inside it.", "Du bist ein Vollidiot, verpiss dich.", "Eres un puto imbécil.", "Nobody would cry if you drop dead.", "These foreigners are rats, throw them out.", "She begged to be fucked hard.", "Stupid bitch, shut up."]


@pytest.fixture(scope="module")
def model():
    return M.train([(t, 0) for t in GOOD * 2] + [(t, 1) for t in BAD])


@pytest.mark.parametrize("text", ["Go to hell, you m0r0n!", "You pathetic b*****d", "What an i.d.i.o.t you are", "YOU ARE A FILTHY SCUMBAG.", "you st​upid cretin", "Fine table. Nice lamp. Drop dead, loser. Thanks."])
def test_unseen_abuse_however_written(model, text):
    assert M.score_texts(model, [text])[0] >= M.THRESHOLD


@pytest.mark.parametrize("text", ["The dog whistle called the bitch and her puppies.", "That damn hinge is ugly.", "We removed 3 comments with insults.", "", "Sehr schöne Lampe.", "Ring 555-1234 or see www.a.b.c"])
def test_harmless_text(model, text):
    assert M.score_texts(model, [text])[0] < M.THRESHOLD


def test_reading_through_disguises():
    assert M.read("f u c k")[0] == "fuck" and M.read("$lut$")[0] == "sluts"
    assert M.read("a a s s h o l e") == ("asshole", 1) and M.read("m*****n")[1] in (0, 1)
    assert M.read("plain 3 mm bolt") == ("plain 3 mm bolt", 0)
    assert M.features(["x", "", "You idiot!", "you idiot"]).shape == (4, len(M.FEATURES)) and M.features([]).shape == (0, len(M.FEATURES))


def test_levels_are_no_certainties_and_trees_use_what_they_are_given(model):
    assert 0 < model.level[0] < model.level[-1] < 1 and (np.diff(model.level) > 0).all()
    used = {f for t in model.trees for f in t.feature if f >= 0}
    assert len(used) >= 4


def test_scores_hold_for_sentences_of_kinds_not_seen():
    n, auc, error = M.held_out([(t, 0) for t in GOOD] + [(t, 1) for t in BAD])
    assert n == len(GOOD) + len(BAD) and auc >= 0.8 and error <= 0.3


def test_no_word_list_alone_decides(model):
    harmless = ["Tits and finches love this birdhouse.", "Kill the process if it hangs.", "The escort of the parcel was late.", "Comments that call people idiots are removed by the moderators."]
    assert (M.score_texts(model, harmless[:3]) < M.THRESHOLD).all()
    assert M.score_texts(model, ["Nobody would miss you."])[0] >= M.THRESHOLD


def test_documents(spark, model):
    shape = "doc_id long, source string, text string, score double, label int"
    long = "A calm sentence about tables. " * 3000
    rows = [(1, "a", "Nice. You are an idiot.", 9.0, 1), (1, "a", "Nice. You are an idiot.", 9.0, 1), (2, "a", None, 0.0, 0), (3, None, "", 0.0, 0), (4, "b", long, 0.0, 0), (5, "b", long + "Drop dead, you moron.", 0.0, 0)]
    samples = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([(t, 0) for t in GOOD] + [(t, 1) for t in BAD] + [(None, 1), ("x", None)])], "sample_id long, text string, label int")
    docs = spark.createDataFrame(rows, shape)
    got = M.scored(docs, samples)
    s = [(r.doc_id, r.score) for r in got.collect()]
    assert got.columns == ["doc_id", "source", "score"] and len(s) == 6
    by = dict(s)
    assert by[1] >= 0.5 and by[5] >= 0.5 and by[2] == by[3] == 0 and by[4] < 0.5
    assert {r.source: (r.documents, r.unwanted) for r in M.rates(got).collect()} == {"a": (3, 2), None: (1, 0), "b": (2, 1)}
    assert M.scored(docs.limit(0), samples).count() == 0
    with pytest.raises(ValueError, match="both kinds"):
        M.scored(docs, samples.filter("label = 1"))


def test_boosting_learns_and_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = boosting.fit(x, y, np.arange(400))
    p = m.probability(x)
    assert ((p > 0.5) == y).mean() > 0.95 and (np.diff(m.level) >= 0).all()
    at, level = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert level.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [1.0, 2.5, 4.0]
    assert boosting.isotonic(np.array([1.0, 1, 2]), np.array([1.0, 0, 1]), prior=0.5)[1].tolist() == [0.5, 0.75]
    falls = boosting.fit_margin(x[:, :1], (x[:, 0] < 0).astype(float), rises=np.array([1]))
    assert (np.diff(falls.margin(np.sort(x[:, :1], axis=0))) >= 0).all()
