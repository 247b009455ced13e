r"""Template residue and error-page text, found by positive-unlabelled naive Bayes.

A field is cut into passages: at title separators, and where markup begins and
ends. Passages that many fields share are names (of sites, as a rule). The
units of the model are a field's core, all but its names, and each passage that
stands beside other content. A unit's features are its words, neighbouring
words with the edges, numbers by their length, signs, and identifiers by their
shape; of a passage beside content also that it stands there.

The positives are trusted units, recognised by the fixed patterns below; all
others are unlabelled. Expectation-maximization counts every unit with its
present probability and estimates the share of positives; it ends when that
share stands still. The patterns name the seed only, no feature and no decision
uses them: forms that no pattern names are learned from the company they keep.
Features are hashed into ``BUCKETS`` counters, which are all that reaches the
driver. A field is a case if its core
or a passage in it has more than even odds.

Features are made by built-in expressions; counting and scoring are numpy over
whole Arrow batches.

Defined results. Null, empty and blank fields are no cases. Repeated texts have
equal scores and count once in the model. Texts of any length are read whole.
An empty table gives no rows; without a trusted unit there are no cases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.functions.text import let
from auditmill.session import cut

BUCKETS = 1 << 20
# The most rounds; rounds end earlier once the share of positives changes by less than one in ``STILL``.
ROUNDS, STILL = 10, 500
# How many fields a passage must be in to be a name.
NAME = 20
# How many times as many fields a name is in as the rarest passage beside it.
NAMED = 8
# Strength of the prior of a feature's odds, in units: rare features say little.
PRIOR_UNITS = 2.0

# What a template's slot is called.
SLOT = (
    r"(?:page|seo|meta|post|product|item|article|site|store|shop|company|business|brand|category|collection|cms|current|blog|my|your|the|a|"
    r"main|sub|section|default|new|document|doc|"
    r"title|titel|titre|t[ií]tulo|headline|heading|header|h1|name|sitename|text|content|copy|caption|label|description|tagline|slogan|"
    r"überschrift|firmenname|produktname|nom|nombre|encabezado|texte|texto|inhalt|here|goes)"
)
_FILLER = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|"
    "exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|"
    "excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum|ut|et"
)
# The seed. What only programs write is trusted in any passage.
MACHINE: dict[str, str] = {
    "braces": r"\{\{|\}\}|\{%|%\}|\{[a-z]\w*[_.:][\w.:]+\}",
    "dollars": r"\$\{|#\{|\$[a-z][\w.:]*[_.:][\w.:]*\$",
    "tags": r"<%|%>|<\?php|&(?:lt|gt);%|<[a-z]\w*[_.:][\w.:]+>",
    "brackets": r"\[\[|\]\]|\[[a-z]\w*[_.:][\w.:]+\]",
    "doubled": r"%%[\w.: -]+%%|##[\w.: -]+##|@@[\w.: -]+@@|__[\w.: -]+__|%[a-z][\w.:]*[_.:]\w+%",
    "slots": rf"[\[{{<](?:{SLOT}[ _-]?)+[\]}}>]",
    "standins": r"^[(\[<]?(?:null|undefined|nan|none|nil|n/a|void|\[?object object\]?|array|object|false|true)[)\]>]?(?: (?:null|undefined|nan|none|nil))*$|^#(?:ref|value|name\?|n/a|div/0|null|num)!?$",
    "renderer": r"^(?:template|liquid|render(?:ing)?) error\b.*|^(?:translation missing|missing translation)\b.*",
}
# The seed. What people write as well is trusted only where it is all a field says.
HUMAN: dict[str, str] = {
    "status": r"(?:(?:http|error|fehler|erreur|status|code|http status|http error)[ :#-]*)?[45]\d\d(?:[ :–—-]+(?:page |seite |file )?(?:not found|nicht gefunden|introuvable|forbidden|verboten|interdit|no encontrad[ao]|no existe|unauthorized|bad gateway|gateway time-?out|service unavailable|internal server error|server error|too many requests|bad request|gone).{0,20})?",
    "missing": r"(?:(?:the |this |sorry,? (?:the|this) )?(?:page|seite|url|file|document)(?: you (?:requested|are looking for|were looking for))? (?:was |is |could |can ?not |can't |does |no longer )?(?:not |be )*(?:found|exists?|available|nicht gefunden)(?: anymore)?|(?:la )?p(?:age|ágina) (?:introuvable|non trouvée|no encontrada|no existe)|diese seite (?:existiert nicht|wurde nicht gefunden).{0,10}|(?:oops|sorry|uh oh|whoops)[,! ]+.{0,20}(?:page|find|wrong|exist|error).{0,30}|nothing (?:to see |was )?(?:here|found)(?: any ?more| yet)?)",
    "server": r"(?:(?:this|the|our) (?:site|server|service|page|shop|store) is (?:temporarily |currently |not )*(?:down|offline|unavailable|available|closed).{0,20}|(?:an? )?(?:unexpected |internal |unknown |fatal )?(?:server )?error (?:has )?occurr?ed.{0,20}|es ist ein fehler aufgetreten|une erreur (?:est survenue|s'est produite)|(?:se ha producido|ha ocurrido) un error|error (?:interno )?del servidor|something went wrong|etwas ist schief ?gelaufen|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|too many requests.{0,24}|error establishing a (?:database connection|connection to the database)|uncaught (?:exception|error).{0,30}|fatal error.{0,30})",
    "denied": r"access (?:is )?denied|zugriff verweigert|accès (?:refusé|interdit)|acceso denegado",
    "scripts": r"(?:(?:java)?scripts? (?:is|are) (?:switched |turned )?(?:off|disabled).{0,30}|.{0,40}(?:javascript|\bjs\b|cookies).{0,20}(?:enable|enabled|disabled|required|activ|aktiv|turn|benötigt|requis|necesari|habilit).{0,40}|.{0,30}(?:enable|activate|turn on|activer|activez|aktivieren|active|habilite|benötigt|requires?|needs?|without) (?:your )?(?:javascript|js\b|scripts?\b|scripting|cookies).{0,40})",
    "browsers": r"(?:(?:just a moment|one moment|please wait)?[, ]*(?:checking|verifying) (?:your|the) browser.{0,30}|are you (?:a )?(?:human|robot)\??|your browser (?:must|is not|does not|doesn't).{0,40})",
    "prompts": rf"(?:insert|enter|add|type|put|write|replace|edit|saisissez|entrez|escriba|introduzca|hier|ajoutez)(?: (?:this|the|a|your|you|votre|su|aquí|ihren?|here|hier|ici))* (?:{SLOT}[ -]?)+(?:here|hier|ici|aquí|einfügen|eingeben|to edit|goes here)?",
    "slot words": rf"(?:(?:your|ihr|votre|su) (?:{SLOT}[ -]?)+(?:here|goes here|hier)?|to ?do:? .{{0,12}}(?:{SLOT}[ -]?)+|(?:{SLOT}[ -]?)+(?:tbd|tba|todo|pending|missing)|\((?:{SLOT}[ -]?)+ ?missing\)|x{{2,}} (?:{SLOT}[ -]?)+x{{2,}}|\(?(?:no|missing|empty|unknown) (?:title|heading|headline|name|text)\)?)",
    "untitled": r"(?:copy of template.{0,30}|untitled(?: (?:document|page|post))?(?: ?\(?\d*\)?)|new page(?: \(?\d+\)?)?)",
    "filler": rf"(?:(?:{_FILLER})[ ,.]*){{3,}}|(?:this is )?(?:a )?(?:placeholder|dummy|sample|filler)(?: (?:text|copy|title|content|heading))+(?: .{{0,20}})?|blindtext(?: blindtext)*|texte? de (?:remplissage|relleno)|texto de relleno|(?:blah ?)+",
    "mashed": r"(?:(?:asdf|qwerty|test|xxx|abc|foo|bar) ?){2,}[0-9]*",
}
FAMILIES = (*MACHINE, *HUMAN)

# Markup: brackets around more than plain words, and words that hold signs prose doesn't.
MARKUP = r"(?:[{\[<]+[^{}\[\]<>]*[^\p{L}\s{}\[\]<>-][^{}\[\]<>]*[}\]>]+|[{\[<]{2,}[^{}\[\]<>]*[}\]>]*|[^\s]*(?:[$%#@_\\^~=]|[{\[<]{2}|[}\]>]{2})[^\s]*)+"
SEPARATOR = r"\s+[|–—·•»/-]\s+|\s*[|·•»]\s*|(?<=\w): (?=\S)"
TOKEN = r"\p{L}[\p{L}\p{N}]*(?:[._:][\p{L}\p{N}]+)+|[\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*|\p{L}+(?:['’-]\p{L}+)*|[^\p{L}\p{N}\s]+"
EDGES = " \t\n.!?…,;"


def passages(text: Column) -> Column:
    """The passages of a text in lower case: markup by itself, prose between separators."""
    t = F.lower(F.trim(F.regexp_replace(text, r"[\s\x00\x01\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " ")))
    pieces = F.split(F.regexp_replace(t, MARKUP, "\x01$0\x01"), "\x01")
    cells = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(F.split(p, SEPARATOR)))
    parts = F.transform(F.flatten(cells), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p.rlike(r"[\p{L}\p{N}]"))


def _bare(unit: Column) -> Column:
    return F.trim(unit, F.lit(EDGES))


def trusted(unit: Column, beside: Column, families: Sequence[str] = FAMILIES) -> Column:
    """Whether a unit is surely residue, by the patterns of some families."""
    bare = _bare(unit)
    machine = [p for k, p in MACHINE.items() if k in families]
    human = [p for k, p in HUMAN.items() if k in families]
    said = bare.rlike("|".join(machine)) if machine else F.lit(False)
    alone = bare.rlike(f"^(?:{'|'.join(human)})$") if human else F.lit(False)
    return said | (alone & ~beside)


def features(unit: Column, beside: Column) -> Column:
    """The hashed features of a unit, each once."""
    # a sign that touches a number ($5, <3, (404) is another than one before letters
    told = F.regexp_replace(_bare(unit), r"([^\p{L}\p{N}\s])(?=\p{N})", "$1\x02")
    tokens = F.regexp_extract_all(told, F.lit(f"({TOKEN})"), 1)

    def shape(t: Column) -> Column:
        digits = F.concat(F.lit("#"), F.least(F.length(t), F.lit(5)).cast("string"), F.when(F.length(t) == 3, F.substring(t, 1, 1)).otherwise(""))
        return (
            F.when(t.rlike("^[0-9]+$"), digits)
            .when(t.rlike(r"^\p{L}[\p{L}\p{N}]*[._:]"), F.lit("<id>"))
            .when(t.rlike(r"\p{N}"), F.lit("#x"))
            .otherwise(F.substring(t, 1, 24))
        )

    identifier = r"^\p{L}[\p{L}\p{N}]*[._:]"

    def words(t: Column) -> Column:
        pieces = F.flatten(F.transform(F.filter(t, lambda w: w.rlike(identifier)), lambda w: F.array_append(F.split(w, "[._:]"), w)))
        return let(F.transform(t, shape), lambda shapes: let(F.struct(shapes.alias("shapes"), F.size(shapes).alias("n"), F.concat(shapes, pieces).alias("words")), named))

    def named(x: Column) -> Column:
        shapes, n = x["shapes"], x["n"]
        pairs = F.zip_with(F.array_prepend(shapes, "^"), F.array_append(shapes, "$"), lambda a, b: F.concat(a, F.lit(" "), b))
        same = F.when((n > 1) & (F.size(F.array_distinct(shapes)) == 1), F.lit("=same")).otherwise("=mixed")
        whole = F.array(F.concat(F.lit("=words"), F.least(n, F.lit(8)).cast("string")), same)
        return let(F.concat(x["words"], pairs), lambda w: F.concat(w, whole, F.when(beside, F.array_append(F.transform(w, lambda v: F.concat(v, F.lit(" @"))), "=beside")).otherwise(F.array().cast("array<string>"))))

    hashed = F.transform(let(tokens, words), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    return F.array_distinct(hashed)


def units(texts: DataFrame, families: Sequence[str] = FAMILIES, name: int = NAME) -> DataFrame:
    """(text, ids, known): the core and the passages beside content of every text in ``texts`` (text, distinct)."""
    parts = cut(texts.select("text", F.posexplode(passages(F.col("text"))).alias("pos", "part")))
    shared = parts.groupBy("part").agg(F.count(F.lit(1)).alias("fields")).filter(F.col("fields") >= name)
    met = parts.join(shared, "part", "left").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("pos", "part", F.coalesce("fields", F.lit(1)).alias("fields")))).alias("parts"))
    met = met.withColumn("rarest", F.array_min(F.transform("parts", lambda p: p["fields"])))
    met = met.withColumn("own", F.filter("parts", lambda p: (p["fields"] < name) | (p["fields"] < NAMED * F.col("rarest"))))
    core = F.array_join(F.transform("own", lambda p: p["part"]), " - ")
    inner = F.filter("parts", lambda p: F.size(F.array_remove(F.col("own"), p)) > 0)
    rows = F.concat(F.array(F.struct(core.alias("unit"), F.lit(False).alias("beside"))), F.transform(inner, lambda p: F.struct(p["part"].alias("unit"), F.lit(True).alias("beside"))))
    flat = met.select("text", F.inline(rows))
    return flat.select("text", features(F.col("unit"), F.col("beside")).alias("ids"), trusted(F.col("unit"), F.col("beside"), families).alias("known"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch one after the other, and how many each row has."""
    ids = batch.column(batch.schema.get_field_index("ids"))
    offsets = ids.offsets.to_numpy()
    return ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


class Model:
    """Log odds per feature bucket. At most ``BUCKETS`` numbers, whatever the corpus."""

    def __init__(self, weight: np.ndarray, share: float):
        self.weight, self.share = weight.astype(np.float32), share
        self.bias = math.log(share / (1 - share)) if 0 < share < 1 else -math.inf

    def scores(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weight[flat], dtype=np.float64)])
        end = np.cumsum(size)
        return total[end] - total[end - size] + self.bias


def _expect(model: Model | None):
    """Units and positives per feature bucket under the present model; bucket -1 is all units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos, rows, found = np.zeros(BUCKETS), np.zeros(BUCKETS), 0, 0.0
        for b in batches:
            flat, size = _flat(b)
            known = b.column(b.schema.get_field_index("known")).to_numpy(zero_copy_only=False).astype(bool)
            p = known.astype(float)
            if model is not None and len(known):
                p = (known | (model.scores(flat, size) > 0)).astype(float)
            n += np.bincount(flat, minlength=BUCKETS)
            pos += np.bincount(flat, np.repeat(p, size), BUCKETS)
            rows, found = rows + len(known), found + p.sum()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(n[at], rows), pa.float64()), pa.array(np.append(pos[at], found), pa.float64())], ["bucket", "n", "pos"]
        )

    return run


def _maximize(counted) -> Model:
    """Odds of every feature, drawn towards those of all units by ``PRIOR_UNITS`` of them."""
    total = counted[counted["bucket"] == -1]
    rows, found = float(total["n"].sum()), float(total["pos"].sum())
    weight = np.zeros(BUCKETS)
    share = found / rows if rows else 0.0
    if 0 < share < 1:
        f = counted[counted["bucket"] >= 0]
        pos, neg = f["pos"].to_numpy(), (f["n"] - f["pos"]).to_numpy()
        weight[f["bucket"].to_numpy()] = np.log((pos + PRIOR_UNITS * share) / (np.maximum(neg, 0) + PRIOR_UNITS * (1 - share)) * (1 - share) / share)
    return Model(weight, share)


def learn(ready: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model of units (ids, known) after the seed and at most ``rounds`` rounds of expectation and maximization."""
    model, share = None, -1.0
    for _ in range(rounds + 1):
        parts = ready.select("ids", "known").mapInArrow(_expect(model), "bucket int, n double, pos double")
        counted = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toPandas()
        model = _maximize(counted)
        if abs(model.share - share) * STILL < max(share, 0):
            break
        share = model.share
    return model


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, size = _flat(b)
            score = model.scores(flat, size) if b.num_rows else np.zeros(0)
            found = np.flatnonzero(score > 0)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("text")).take(pa.array(found)), pa.array(score[found])], ["text", "score"])

    return run


def scored(fields: DataFrame, rounds: int = ROUNDS, families: Sequence[str] = FAMILIES) -> DataFrame:
    """(text, score) of every distinct text in ``fields`` that is residue; the score is the log odds of its worst unit."""
    texts = fields.filter(F.col("text").rlike(r"\S")).select("text").distinct()
    ready = cut(units(texts, families))
    model = learn(ready, rounds)
    bad = ready.select("text", "ids").mapInArrow(_score_batches(model), "text string, score double")
    return bad.groupBy("text").agg(F.max("score").alias("score"))


def residue(fields: DataFrame, rounds: int = ROUNDS, families: Sequence[str] = FAMILIES) -> DataFrame:
    """The rows of ``fields`` (keys and text) whose text is residue, with its score."""
    from auditmill.operators.skew import balanced_join

    bad = cut(scored(fields, rounds, families))
    return balanced_join(fields.filter(F.col("text").isNotNull()), bad, ["text"])
