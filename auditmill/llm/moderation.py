r"""Abusive, hateful or sexual content: boosted trees over dense features, calibrated.

Texts are scored sentence by sentence. A sentence is first read as a person
would: invisible characters go, look-alike letters, digits and signs become the
letters they stand for, spelt-out and stretched words are closed up, and words
with hidden letters are matched against the word lists. The features are the
densities of the word lists and phrases below, how near they stand to the second
person and to each other, capitals, punctuation, and the rate of disguised
words. Words that are as often harmless are a list of their own; no feature
says what a sentence means. Trees are trained on the judged sentences, with
disguised copies of them, and calibrated by isotonic regression on held-out
folds, with half a row of each kind in every step, so no level is 0 or 1. A
document's score is that of its worst sentence.

Sentences are cut by a built-in expression. A batch's distinct sentences are
scored at once: words are looked up once per distinct word, patterns run over
whole Arrow columns, and only sentences that look disguised are read one by one.

Training takes at most ``MOST_SAMPLES`` judged sentences, chosen by hash; every
document is scored whole.

Defined results. Null and empty texts have score 0. Repeated documents have
equal scores. Without judged sentences of both kinds the fit is an error.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditmill.llm.boosting import Boosted, fit

MOST_SAMPLES = 20_000
THRESHOLD = 0.5

# Word lists. A star stands for any ending. Languages: en, de, fr, es.
LISTS: dict[str, str] = {
    "insult": """
        idiot idiots moron* cretin* imbecile* dumbass* dickhead* asshole* arsehole* bastard* wanker* prick pricks scumbag* loser losers bitch bitches bitchy
        retard retards retarded twat* cunt* douche* jackass* dimwit* halfwit* nitwit* simpleton* tosser* bellend* braindead numbskull* blockhead* fuckwit* shithead* motherfuck* fucker* pissant scum degenerate*
        clown buffoon* creep pervert* whore* slut* skank* pig maggot* lowlife* dumbfuck* nutjob*
        arschl* vollidiot* idioten wichser* hurensohn* hurens* schlampe* trottel* depp deppen missgeburt* spast* mistk* drecksack* schwachkopf* dummkopf* vollpfosten* penner* fotze* nutte*
        connard* connasse* salope* salaud* encule* debile* abruti* cretins bouffon* ordure* pouffiasse* petasse* batard* tocard* minable*
        cabron* gilipoll* imbecil imbeciles pendej* puto putos hijoputa* zorra* idiota idiotas estupido* maricon* subnormal* capullo* payaso malnacid* pringado* tarado*
    """,
    "adjective": """
        stupid filthy pathetic worthless useless disgusting miserable shitty shittiest dirty ugly dumb fucking fuckin brainless gutless spineless vile repulsive rotten lousy crappy goddamn
        blode bloder blodes dumm dumme dummer dummes verdammt* dreckig* ekelhaft* widerlich* hasslich* erbarmlich*
        sale sales grosse pourri* degueulasse* minables
        asqueros* sucio sucia maldit* inutil* feo
    """,
    "profanity": """
        fuck fucks fucked shit shits bullshit crap piss pissed stfu gtfo ass asses wtf
        scheiss* scheisse kacke verpiss* fick fickt
        merde* bordel putain chier foutre
        mierda* joder cono hostia carajo
    """,
    "sexual": """
        cock cocks dick dicks pussy pussies tits titties boobs porn porno* horny cum cumming milf* blowjob* handjob* dildo* orgasm* erection* penis vagina clit anal anus gangbang* threesome* hardcore nudes nsfw fap masturbat* stripper* escort hooker* uncensored topless
        ficken fickte gefickt titten muschi geile geiler geil nutten wichsen blasen durchnehmen bumsen vogeln porno
        baiser baise bite couilles sucer branler nichons cul jouir
        follar follart* folla follando polla pollas tetas chupar correrse cachond* putas desnudas coger
    """,
    "body": """
        naked nude undressed moan moaned moaning lick licked licking suck sucking sucks legs thighs breasts nipples wet hard dress sheets spread begged inch kiss kissed slid ride singles cam babes tonight
        nackt nackte nackten weiber brust schwanz nue nues nus chatte seins cuisses desnud* culo pechos
    """,
    "harm": """
        kill kills killed die dies dead death murder* hang hanged shoot shot stab stabbed burn burned strangle* choke chokes choked starve* rape raped beat beaten bash smash break punch slap hurt suffer vanish* drown* gas gassed exterminat* lynch* execute* behead* rot bleed cripple
        stirb sterben verreck* toten umbringen erschiess* aufhang* schlagen fresse prugel* vergas* verhungern krepier*
        creve crever crevez mourir meurs tuer pendre frapper gueule bruler
        muerete mueras muerte morir matar maten ahorcar golpear partir quemar palos
    """,
    "group": """
        immigrant* migrant* refugee* foreigner* gays gay lesbian* homosexual* trans transgender* queer* jew jews jewish muslim* christians black blacks whites asian asians arab arabs gypsies gypsy mexican* disabled cripples women woman girls faith race religion elderly
        auslander* fluchtling* schwule* lesben juden muslime frauen behinderte* turken araber zigeuner*
        etrangers etrangeres migrants refugies juifs musulmans arabes noirs femmes espece handicapes
        inmigrantes extranjer* refugiad* judios musulmanes negros mujeres moros raza gitanos
    """,
    "degrade": """
        vermin animals animal rats rat dogs dog cockroach* roaches parasite* filth trash garbage subhuman* inferior savages disease plague cancer swarm breed fence driven deport* hates hate stinks stink waste excuse
        dreck abschaum ungeziefer ratten untermensch* einsperren abschieben raus mull viecher
        rats dehors vermine racaille enfermer expulser sauvages
        basura ratas escoria echarl* desaparecer expulsar salvajes asco plaga
    """,
    "second": """
        you your yours yourself yourselves u ur ya youre youve
        du dich dir dein* deine* euch euer eure* ihr
        tu te toi ton ta tes vous votre vos
        ti tus usted ustedes vosotros eres
    """,
    "first": "i me my mine myself we our ours us ich mir mich mein* wir uns unser* je j moi mon ma mes nous notre yo mi mis me nos nuestro*",
    "about": """
        insult insults moderat* report reported comment comments removed remove flag policy speech abuse filter deleted delete rules guideline* word words
        beleidigung* kommentar* bewertung* geloscht loschen melden regeln
        insultants insultes commentaire* supprimons supprimer signaler
        insultos insulto comentario* borramos borrar denunciar
    """,
}
HIDDEN = ("insult", "adjective", "profanity", "sexual", "body")
PHRASES: dict[str, str] = {
    "harm": r"kill (?:yo)?u?r ?self|drop dead|go to hell|rot in hell|burn in hell|(?:hope|wish)[^.]{0,30} (?:die|dies|choke\w*|starve|suffer|get (?:fired|hurt|sick|cancer)|rot|burn)|should be (?:shot|hanged|hung|killed|burn\w*|put down|locked up|gassed|beaten|punished)|ought to (?:\w+ ){0,2}(?:burn|shoot|kill|hang|beat)|(?:burn|blow up|torch) (?:down )?(?:your|you|their)|(?:break|smash|cut|rip|kick|bash) (?:\w+ )?(?:your|you|his|her|their) (?:\w+ )?(?:leg|legs|face|neck|head|teeth|arm|arms|skull|throat|in)|(?:find|know)(?: out)? where you (?:live|work|sleep)|watch your back|(?:across|in|into|to) (?:the|your) (?:face|head|teeth)|come (?:for|after) you|nobody would (?:miss|cry)|(?:better|cleaner) (?:off )?without you|waste of (?:oxygen|air|space|skin)|end your(?:self| life)|in die fresse|aufs maul|verreck|vermisst kein|sollte man (?:\w+ )?(?:einsperren|aufhangen|erschiessen|verhungern)|partir la cara|te mueras|ojala te|nadie te|va crever|creve|personne ne te|on devrait (?:les|vous) (?:\w+ )?(?:enfermer|pendre|tuer|gazer)|hay que (?:echar|matar|quemar)",
    "insult": r"fuck (?:you|u|off|yourself|them|him|her)\b|shut (?:your|the fuck|ur) ?(?:\w+ ){0,2}(?:mouth|up|trap|face|gob)?|(?:get|piss|fuck) (?:lost|off)|nobody (?:asked|cares|likes you|wants you)|(?:excuse|waste) (?:for|of) (?:a )?(?:human|oxygen|air|space|skin|person)|crawl back|(?:your )?(?:mother|mom|mama) (?:dropped|should|whore)|dropped (?:you|u) on (?:your|ur) head|brain[- ]?dead|brain[- ]dead|people like you|your (?:kind|sort)|(?:ugly|fat|stupid|dumb|silly) (?:cow|pig|hag|bitch|witch|goat)|piece of (?:shit|crap|trash)|(?:is|are) trash and|halt (?:die fresse|dein maul|die klappe|s maul)|(?:blode|dumme|alte|fette) (?:kuh|sau|ziege|gans|schlampe)|keiner hat dich|stuck scheisse|ferme (?:ta|la|vos)|ta gueule|espece d[e ]|(?:gros|grosse|sale) (?:merde|con|conne|porc|vache|pute)|bande d[e ]|bons? a rien|calla(?:te|d|os)|pedazo de|hijos? de puta|puta madre|vete a la|qu ?e? asco de",
    "sexual": r"(?:get|got|so|me|am) (?:hard|wet)\b|(?:made|make) (?:her|him|you|me) (?:come|cum)|spread (?:her|your|his|my) legs|ride (?:me|my)|hand (?:under|up|down|inside) (?:her|his|my|your) (?:\w+ )?(?:dress|skirt|shirt|pants|bra)|(?:hot|naked|nude|horny|dirty|sexy|wet|barely dressed|single) (?:\w+ )?(?:girls?|women|woman|babes?|singles|models?|pics?|wives|teens|sluts?|milfs?|cam)|cam (?:girls?|models?|shows?)|(?:nude|naked|dirty|nsfw) (?:pics?|photos?|clips?|selfies)|lick (?:every|your|my|her|his)|want to (?:fuck|ride|suck)|moan\w* for more|in your area|come twice|nackt(?:e|en)? (?:auf|weiber|frauen|girls)|geile (?:nackte|weiber|frauen)|heute noch|dich nackt|(?:nues?|chaudes?) (?:pretes?|ce soir)|a baiser|ce soir|desnud\w+ (?:quieren|sobre|esta)|verte desnud|esta noche",
    "degrade": r"(?:should|must|ought to) (?:\w+ )?(?:be )?(?:driven|thrown|kicked|locked|put down|sterili[sz]ed|banned|wiped|deported|removed|allowed to breed)|should not be allowed|get rid of (?:them|all|those)|(?:send|ship|kick|throw) (?:\w+ ){0,4}(?:back|out|home)|back (?:to|on) (?:where|the first)|keep \S+(?: \S+){0,3} out\b|not deserve (?:to|any)|less than (?:animals|human|dogs)|not (?:human|people)|god hates|(?:do|does|will) not serve|never (?:let|serve|hire|allow)|behind (?:a fence|bars)|ruin(?:s|ed)? everything|belongs? (?:behind|in a (?:cage|zoo|camp|grave))|like (?:sick |rabid |filthy )?(?:dogs|animals|rats|pigs)|hires? \S+(?: \S+){0,2} so of course|sink it|so do i|gehoren (?:alle |nicht )?(?:raus|her|weg|eingesperrt)|solche leute|leute wie (?:euch|du|die)|alle raus|sont des (?:rats|animaux|parasites|chiens|merdes)|jeter dehors|gens de (?:ton|votre|leur) espece|de (?:tu|su|vuestra) raza|son (?:basura|ratas|animales|escoria)|deberian desaparecer|a palos",
}
# Fixed value: words that are as often harmless, so that one of them alone says little.
HOMONYMS = frozenset("ass asses bitch bitches clown cock cocks creep cum culo dick dicks escort geil geile maggot pig porno prick pricks pussy tits vogeln zorra blasen coger polla pollas hard sale sales".split())
# What homonyms count as instead of the lists they are on.
DOUBLE = ("insult", "profanity", "sexual")
KINDS = (*LISTS, "double")
NEAR = (
    ("insult", "second"), ("double", "second"), ("adjective", "second"), ("harm", "second"), ("profanity", "second"), ("degrade", "second"),
    ("adjective", "insult"), ("adjective", "double"), ("adjective", "profanity"), ("first", "insult"), ("group", "degrade"), ("group", "harm"), ("sexual", "body"), ("double", "body"),
)
DENSE = ("insult", "adjective", "profanity", "sexual", "harm", "degrade", "about")
# Homonyms, the second person, groups and bodies count only by what they stand near to.
# Talk about moderation and about oneself can only lower a score, everything else only raise it.
LOWERS = ("d_about", "near_first_insult")
FEATURES = [f"d_{k}" for k in DENSE] + [f"p_{k}" for k in PHRASES] + [f"near_{a}_{b}" for a, b in NEAR] + ["capitals", "exclaims", "marks", "disguised"]

INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
LOOKALIKE = str.maketrans("авеёкмнорстухіјѕԁɡһӏαβεικνορτυχ", "abeekmhopctyxijsdghlabeiknoptux")
LEET = str.maketrans("013457@$!+|€£", "oieastasitlel")
LEET_L = str.maketrans("013457@$!+|€£", "oleastasltlel")
SPELT = re.compile(r"(?<![^\W_])([^\W_])([ .\-_·*/])(?:[^\W_]\2)+[^\W_](?![^\W_])")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
RAW = re.compile(r"\S+")
SENTENCE = r"(?<=[.!?…])[\"'»”)]*\s+|\n+"
# What may be a disguise: letters of other scripts, spelt-out or stretched words, signs and digits in words.
STRETCHED = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz0123456789_")
ODD = rf"[^\x00-\x7f]|[a-z0-9][ .\-_*/][a-z0-9][ .\-_*/][a-z0-9]|[0-9@$!*+|]\w|\w[0-9@$*+|]|{STRETCHED}"


def plain(text: str) -> str:
    """Lower case without accents; ß is ss."""
    t = unicodedata.normalize("NFKD", text.casefold())
    return "".join(ch for ch in t if not unicodedata.combining(ch)) if not t.isascii() else t


def _compile() -> tuple[dict[str, tuple[str, ...]], dict[str, tuple[str, ...]], dict[tuple[int, str], list[str]]]:
    exact: dict[str, set[str]] = {}
    stems: dict[str, set[str]] = {}
    hidden: dict[tuple[int, str], list[str]] = {}
    for kind, words in LISTS.items():
        for w in words.split():
            (stems if w.endswith("*") else exact).setdefault(w.rstrip("*"), set()).add(kind)
            if kind in HIDDEN and len(w.rstrip("*")) > 2:
                base = w.rstrip("*")
                for form in {base, base + "s"}:
                    hidden.setdefault((len(form), form[0]), []).append(form)
    freeze = lambda d: {k: tuple(sorted(v)) for k, v in d.items()}
    return freeze(exact), freeze(stems), hidden


EXACT, STEMS, MASKED = _compile()
STEM_SIZES = sorted({len(s) for s in STEMS}, reverse=True)
PATTERNS = {k: re.compile(rf"\b(?:{p})") for k, p in PHRASES.items()}


@lru_cache(maxsize=200_000)
def kinds(word: str) -> tuple[str, ...]:
    """The lists a plain word is on."""
    out = set(EXACT.get(word, ()))
    for n in STEM_SIZES:
        if n <= len(word) and (found := STEMS.get(word[:n])):
            out.update(found)
    return tuple(sorted(out))


@lru_cache(maxsize=200_000)
def _counted(word: str) -> tuple[int, ...]:
    """Places in ``KINDS`` of what a word counts as; homonyms are a kind of their own."""
    found = kinds(word) or (kinds(word.split("'")[0]) if "'" in word else ())
    if word in HOMONYMS and any(k in DOUBLE for k in found):
        found = (*[k for k in found if k not in DOUBLE], "double")
    return tuple(KINDS.index(k) for k in found)


def _bad(word: str) -> bool:
    return any(k in HIDDEN for k in kinds(word))


def _segment(joined: str) -> list[str]:
    """A run of single letters as the listed words it holds."""
    out, i = [], 0
    while i < len(joined):
        for n in range(min(14, len(joined) - i), 2, -1):
            if _bad(joined[i : i + n]):
                out.append(joined[i : i + n])
                i += n
                break
        else:
            i += 1
    return out


@lru_cache(maxsize=200_000)
def uncover(token: str) -> str | None:
    """The listed word a disguised token stands for, if any."""
    t = token.strip(".,;:?\"'()[]«»“”…")
    t = t.rstrip("!")
    if not t:
        return None
    forms = [t]
    if re.search(r"[^\W\d_]", t) and re.search(r"[0-9@$!+|€£]", t):
        forms = [t.translate(LEET), t.translate(LEET_L)]
    elif re.fullmatch(r"[@$][\w@$!+|€£]+", t):
        forms = [t.translate(LEET)]
    more = []
    for f in forms:
        if re.search(r"(\w)\1\1", f):
            more += [re.sub(r"(\w)\1{2,}", r"\1", f), re.sub(r"(\w)\1{2,}", r"\1\1", f)]
    forms += more
    for f in forms:
        if f != token and _bad(f):
            return f
    for f in forms:
        if "*" in f[1:] and len(f) > 2 and f[0].isalpha():
            shape = re.compile(re.escape(f).replace(r"\*", "."))
            for w in MASKED.get((len(f), f[0]), ()):
                if shape.fullmatch(w):
                    return w
    return None


def read(sentence: str) -> tuple[str, int]:
    """The sentence as plain words, and how many of them were disguised."""
    disguised = 0
    clean = INVISIBLE.sub("", sentence)
    odd = len(clean) != len(sentence)
    t = plain(clean)
    if not t.isascii():
        t = t.translate(LOOKALIKE)
    if SPELT.search(t):
        def close(m: re.Match) -> str:
            nonlocal disguised
            letters = re.sub(r"[^\w]|_", "", m[0]).translate(LEET)
            words = _segment(letters)
            disguised += len(words)
            return " ".join(words) if words else m[0]

        t = SPELT.sub(close, t)
    if re.search(r"[0-9@$!*+|€£]\w|\w[0-9@$*+|€£]|(\w)\1\1", t):
        out = []
        for tok in RAW.findall(t):
            w = uncover(tok)
            disguised += w is not None
            out.append(w + tok[-1] * (tok[-1] in ".,;:?!") if w else tok)
        t = " ".join(out)
    if odd and any(_bad(w) for w in TOKEN.findall(t)):
        disguised += 1
    return t, disguised


def _near(a: np.ndarray, b: np.ndarray) -> float:
    """How near two kinds of words come to each other, 1 for neighbours, 0 for never."""
    gap = np.abs(a[:, None] - b[None, :])
    gap = gap[gap > 0]
    return 1.0 / float(gap.min()) if gap.size else 0.0


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(float)


def features(sentences: Sequence[str]) -> np.ndarray:
    """The dense features of sentences, a row each, in the order of ``FEATURES``."""
    n = len(sentences)
    if not n:
        return np.zeros((0, len(FEATURES)))
    raw = pa.array(sentences, pa.string())
    lower = pc.utf8_lower(raw)
    odd = pc.match_substring_regex(lower, ODD).to_numpy(zero_copy_only=False)
    disguised = np.zeros(n)
    if odd.any():
        texts = lower.to_pylist()
        for i in np.flatnonzero(odd):
            texts[i], disguised[i] = read(sentences[i])
        lower = pa.array(texts, pa.string())
    words = pc.utf8_trim(pc.replace_substring_regex(pc.replace_substring(lower, "’", "'"), r"'+(?:[^\p{L}\p{N}]+|$)|[^\p{L}\p{N}']+'*", " "), " '")
    lists = pc.split_pattern(words, " ")
    offsets = lists.offsets.to_numpy()
    coded = lists.values.dictionary_encode()
    size = np.diff(offsets)
    at = coded.indices.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    table = np.zeros((len(coded.dictionary), len(KINDS)), bool)
    for i, w in enumerate(coded.dictionary.to_pylist()):
        for k in _counted(w):
            table[i, k] = True
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(at)) - np.repeat(offsets[:-1] - offsets[0], size)
    listed = np.flatnonzero(table.any(axis=1)[at])
    hit, where, who = table[at[listed]], place[listed], row[listed]
    counts = np.zeros((n, len(KINDS)))
    np.add.at(counts, who, hit)
    out = np.zeros((n, len(FEATURES)))
    k = len(DENSE)
    out[:, :k] = counts[:, [KINDS.index(d) for d in DENSE]] / np.maximum(size, 1)[:, None]
    for j, p in enumerate(PHRASES.values()):
        out[:, k + j] = _count(words, rf"\b(?:{p})")
    k += len(PHRASES)
    bounds = np.searchsorted(who, np.arange(n + 1))
    for j, (a, b) in enumerate(NEAR):
        ia, ib = KINDS.index(a), KINDS.index(b)
        for i in np.flatnonzero((counts[:, ia] > 0) & (counts[:, ib] > 0)):
            of = slice(bounds[i], bounds[i + 1])
            out[i, k + j] = _near(where[of][hit[of, ia]], where[of][hit[of, ib]])
    k += len(NEAR)
    length = np.maximum(pc.utf8_length(raw).to_numpy(zero_copy_only=False), 1)
    out[:, k] = _count(raw, r"\p{Lu}") / np.maximum(_count(raw, r"\p{L}"), 1)
    out[:, k + 1] = _count(raw, "!") / np.maximum(size, 1)
    out[:, k + 2] = _count(raw, r"[^\p{L}\p{N}\s]") / length
    out[:, k + 3] = disguised / np.maximum(size, 1)
    return out


def disguises(sentence: str, rng: random.Random) -> list[str]:
    """Copies of a judged sentence that say the same in another dress."""
    hits = [m for m in re.finditer(r"[^\W\d_]{3,}", sentence) if _bad(plain(m[0]))]
    out = [sentence.upper()]
    if hits:
        m = rng.choice(hits)
        w = m[0]
        leet = w.translate(str.maketrans("aeiosAEIOS", "@310$@310$"))
        masked = w[0] + "*" * (len(w) - 2) + w[-1]
        for new in (leet, masked, ".".join(w), w[0] + w[1] * 4 + w[2:]):
            out.append(sentence[: m.start()] + new + sentence[m.end() :])
    return out


def _group(text: str) -> int:
    """The same for sentences that begin alike; folds keep these together."""
    return xxhash.xxh32_intdigest(re.sub(r"\W+", " ", plain(text))[:12])


def train(rows: Sequence[tuple[str, int]], seed: int = 7) -> Boosted:
    """A calibrated model of judged sentences (text, label)."""
    rng = random.Random(seed)
    texts: list[tuple[str, int, int]] = []
    for text, label in sorted(set(rows)):
        texts += [(t, label, _group(text)) for t in [text, *disguises(text, rng)]]
    if len({label for _, label, _ in texts}) < 2:
        raise ValueError("judged sentences of both kinds are needed")
    x = features([t for t, _, _ in texts])
    y = np.array([label for _, label, _ in texts], float)
    return fit(x, y, np.array([g for _, _, g in texts]), rises=np.array([-1 if f in LOWERS else 1 for f in FEATURES]))


def _worst(model: Boosted, lists: pa.ListArray) -> np.ndarray:
    """The probability of the worst sentence of each list; 0 for none."""
    offsets = lists.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros(len(lists))
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    p = model.probability(features(coded.dictionary.to_pylist()))
    if len(p):
        np.maximum.at(out, np.repeat(np.arange(len(lists)), size), p[coded.indices.to_numpy(zero_copy_only=False)])
    return out


def score_texts(model: Boosted, texts: Sequence[str | None]) -> np.ndarray:
    """The probability of each text's worst sentence."""
    parts = [[s for s in map(str.strip, re.split(SENTENCE, t or "")) if any(map(str.isalpha, s))] for t in texts]
    return _worst(model, pa.array(parts, pa.list_(pa.string())))


def _score_batches(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, max(b.num_rows, 1), 500)):
                lists = part.column(part.num_columns - 1)
                score = pa.array(_worst(model, lists.cast(pa.list_(pa.string()))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], score], [*part.schema.names[:-1], "score"])

    return run


def sentences(text: Column) -> Column:
    """The sentences of a text, each with at least one letter; none for null."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s.rlike(r"\p{L}"))


def judged(samples: DataFrame, most: int = MOST_SAMPLES) -> list[tuple[str, int]]:
    rows = samples.filter(F.col("text").isNotNull() & F.col("label").isNotNull()).orderBy(F.xxhash64("text"), "sample_id").limit(most).select("text", "label").collect()
    return [(r.text, int(r.label)) for r in rows]


def scored(docs: DataFrame, samples: DataFrame, keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """(keep, score) of every document."""
    model = train(judged(samples))
    keep = list(keep)
    shape = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])
    return docs.select(*keep, sentences(F.col("text")).alias("__sentences")).mapInArrow(_score_batches(model), shape)


def held_out(rows: Sequence[tuple[str, int]], seed: int = 7) -> tuple[int, float, float]:
    """(judged sentences, area under the curve, calibration error), each sentence scored by a model that knows none like it."""
    rows = sorted(set(rows))
    groups = np.array([_group(t) for t, _ in rows])
    y = np.array([label for _, label in rows], float)
    p = np.zeros(len(rows))
    for k in range(5):
        test = groups % 5 == k
        rest = [r for r, t in zip(rows, test, strict=True) if not t]
        if test.any():
            p[test] = train(rest, seed).probability(features([t for (t, _), o in zip(rows, test, strict=True) if o]))
    good, bad = p[y == 0], p[y == 1]
    auc = float(((bad[:, None] > good[None, :]) + 0.5 * (bad[:, None] == good[None, :])).mean())
    edges = np.minimum((p * 5).astype(int), 4)
    error = sum(abs(p[edges == e].mean() - y[edges == e].mean()) * (edges == e).mean() for e in range(5) if (edges == e).any())
    return len(rows), auc, float(error)


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source how many documents are unwanted."""
    bad = F.count_if(F.col("score") >= threshold)
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), bad.alias("unwanted"), F.avg("score").alias("mean_score")).withColumn("rate", F.col("unwanted") / F.col("documents"))
