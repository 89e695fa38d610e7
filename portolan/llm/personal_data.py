"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) are fixed patterns with their checks. Wider patterns propose further spans. On every
span five labelers vote for, against or not at all: its pattern's own check, a gazetteer, cue words before it, its
neighbouring characters, and its make-up. Expectation-maximisation over the counts of vote patterns estimates how far
each labeler is to be believed and how likely each vote pattern is personal data; with these as soft labels a naive Bayes
classifier of spans is trained on kinds, shapes and contexts. Base spans stay; a proposed span is added if the
classifier finds it more likely than not and it doesn't overlap a base span.

The counts cover all documents; what reaches the driver is their distinct combinations, a bounded number: kinds x
3**labelers x values of the features.

Patterns are written without unbounded groups, so Java's matcher neither recurses nor tries a run from its every place.
Places are code points, ends exclusive. Defined results: a null text is empty and has no spans; spans of one kind don't
overlap, those of different kinds may; null doc_ids and repeated rows are rows like any other; other columns are carried
unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
EMAIL = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++\.{LABEL}[A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\})", r"(?:\(dot\)|\[dot\]|\{dot\})"
HIDDEN_EMAIL = rf"(?<!{LOCAL}){LOCAL}++ ?{_AT} ?{LABEL}++(?:(?: ?{_DOT} ?|\.){LABEL}++)++"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api_?key)[=:][\x21-\x7E]{6,}+)"
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?<![A-Za-z])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Sra?|Mme)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?(?!\p{L})"

# Gazetteers and cue words.
GIVEN_AND_FAMILY_NAMES = [
    "Adams", "Ahmed", "Alexander", "Ali", "Allen", "Anderson", "Andrea", "Anna", "Anne", "Antonio", "Baker", "Barbara", "Bauer", "Becker", "Bernard",
    "Brown", "Campbell", "Carlos", "Carmen", "Carter", "Charles", "Chen", "Clark", "Claire", "Daniel", "David", "Davis", "Diaz", "Dubois", "Durand",
    "Edwards", "Elena", "Elizabeth", "Emma", "Evans", "Fernandez", "Fischer", "Garcia", "George", "Gomez", "Gonzalez", "Green", "Hall", "Hans", "Harris",
    "Hernandez", "Hill", "Hoffmann", "Hughes", "Jackson", "James", "Jean", "Jennifer", "Johnson", "Jones", "Jose", "Juan", "Julia", "Karen", "King",
    "Klaus", "Klein", "Koch", "Kumar", "Laura", "Laurent", "Lee", "Lefebvre", "Lewis", "Linda", "Li", "Lopez", "Louis", "Luis", "Marie", "Maria",
    "Mark", "Martin", "Martinez", "Mary", "Mason", "Meyer", "Michael", "Miller", "Mitchell", "Mohamed", "Moore", "Moreau", "Morgan", "Müller", "Nelson",
    "Nguyen", "Olivia", "Parker", "Patel", "Patricia", "Paul", "Perez", "Peter", "Petit", "Phillips", "Pierre", "Ramirez", "Richard", "Richter", "Robert",
    "Roberts", "Robinson", "Rodriguez", "Rousseau", "Ruiz", "Sanchez", "Sarah", "Schmidt", "Schneider", "Schulz", "Scott", "Simon", "Singh", "Smith",
    "Sophie", "Stewart", "Susan", "Taylor", "Thomas", "Thompson", "Torres", "Turner", "Wagner", "Walker", "Wang", "Weber", "White", "William", "Williams",
    "Wilson", "Wolf", "Wright", "Young", "Zhang",
]
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca"]
IBAN_LANDS = "^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR)"
CUES = {
    "email": "mail|contact|write|reply|correo|courriel", "ip": r"\bip\b|address|host|server|login", "card": "card|visa|credit|carte|karte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|appel|anruf", "secret": "key|secret|login|user|access|credential", "social": "ssn|social|security",
    "iban": "iban|account|bank|konto|compte|cuenta", "name": "name|dear|from|signed|contact",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _few_digits(low: int, high: int):
    return lambda m: F.length(_digits(m)).between(low, high)


def _small_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _luhn(m: Column) -> Column:
    chars = F.reverse(F.split(_digits(m), ""))
    value = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _always(m: Column) -> Column:
    return F.lit(True)


#: (kind, pattern, what a text must contain, check), base kinds first, in the order in which spans are listed.
KINDS = [
    ("email", EMAIL, "@", _always),
    ("ip", IP, "[0-9]", _small_parts),
    ("card", CARD, "[0-9]", lambda m: _few_digits(12, 19)(m) & _luhn(m)),
    ("phone", PHONE, r"\+", _few_digits(9, 15)),
    ("hidden_email", HIDDEN_EMAIL, r"(?:\(at\)|\[at\]|\{at\})", _always),
    ("secret", SECRET, "AKIA|[=:]", _always),
    ("local_phone", LOCAL_PHONE, "[0-9]", _always),
    ("social", SOCIAL, "[0-9]", lambda m: ~m.rlike(r"^(?:000|666|9..)|-00-|-0000$")),
    ("iban", IBAN, "[A-Z]{2}[0-9]", _always),
    ("name", NAME, "(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Sra?|Mme)", _always),
]
BASE = 4
LABELERS = 5
LEFT, RIGHT = 32, 8


def _candidates(text: Column, kind: int) -> list[Column]:
    """The pieces between the pattern's matches, and the matches; none where the guard isn't found."""
    _, pattern, guard, _ = KINDS[kind]
    none = F.array().cast("array<string>")
    may = F.contains(text, F.lit("@")) if guard == "@" else text.rlike(guard)
    return [
        F.when(may, F.split(text, pattern, -1)).otherwise(none).alias(f"p{kind}"),
        F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m{kind}"),
    ]


def _spans(kind: int) -> Column:
    """Array of (start, kind, end, body, before, after) of the kind's matches that pass its check."""
    p, m = F.col(f"p{kind}"), F.col(f"m{kind}")
    sizes = F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        sizes, none,
        lambda s, x: F.struct((s["at"] + x["a"] + x["b"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["a"])).alias("starts")),
        lambda s: s["starts"],
    )
    first = F.zip_with(starts, m, lambda s, b: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(b)).alias("end"), b.alias("body")))
    around = F.zip_with(F.slice(p, 1, F.size(m)), F.slice(p, 2, F.greatest(F.size(m), F.lit(1))), lambda a, b: F.struct(F.right(a, F.lit(LEFT)).alias("l"), F.left(b, F.lit(RIGHT)).alias("r")))
    whole = F.zip_with(first, around, lambda s, c: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["body"].alias("body"), c["l"].alias("before"), c["r"].alias("after")))
    check = KINDS[kind][3]
    return F.filter(whole, lambda s: s["start"].isNotNull() & check(s["body"]))


def _votes(s: Column) -> Column:
    """The labelers' votes on a span as a string of + - and 0."""
    body, before, after = s["body"], F.lower(s["before"]), s["after"]
    kind = s["kind"]
    names = [k for k, *_ in KINDS]
    is_ = lambda *ks: kind.isin(*[names.index(k) for k in ks])
    plus, minus, none = F.lit("+"), F.lit("-"), F.lit("0")
    pattern = (
        F.when(is_("email", "card", "phone", "secret", "social", "iban", "hidden_email"), plus)
        .when(is_("ip"), F.when(body.rlike(r"^(?:0|127|255)\."), minus).otherwise(plus))
        .when(is_("local_phone"), plus).otherwise(none)
    )
    last = F.lower(F.regexp_extract(body, r"([A-Za-z]+)$", 1))
    known = (
        F.when(is_("email", "hidden_email"), F.when(last.isin(*TOP_DOMAINS), plus).otherwise(minus))
        .when(is_("card"), F.when(body.rlike("^(?:4|5[1-5]|3[47]|6)"), plus).otherwise(minus))
        .when(is_("phone"), F.when(body.rlike(r"^\+(?:1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), plus).otherwise(minus))
        .when(is_("secret"), F.when(body.rlike("^AKIA"), plus).otherwise(none))
        # the North American plan: area codes and exchanges begin with 2 to 9, and N11 are services
        .when(is_("local_phone"), F.when(_digits(body).rlike("^(?:[2-9](?!11)[0-9]{2}){2}"), plus).otherwise(minus))
        .when(is_("iban"), F.when(body.rlike(IBAN_LANDS), plus).otherwise(minus))
        .when(is_("name"), F.when(body.rlike(r"(?<!\p{L})(?:" + "|".join(GIVEN_AND_FAMILY_NAMES) + r")(?!\p{L})"), plus).otherwise(none)).otherwise(none)
    )
    cue = none
    for name, words in CUES.items():
        which = [k for k in names if k == name or k.endswith("_" + name)]
        cue = F.when(is_(*which) & before.rlike(words), plus).otherwise(cue)
    near = F.when(before.rlike(r"[a-z0-9]$") | after.rlike(r"^[A-Za-z0-9]"), minus).when((before == "") | before.rlike(r"[\s(\[<:\"']$"), plus).otherwise(none)
    digits = _digits(body)
    make = (
        F.when(is_("secret"), F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]"), plus).otherwise(minus))
        .when(is_("ip", "card", "phone", "local_phone", "social", "iban"), F.when(digits.rlike(r"^(\d)\1*$"), minus).otherwise(plus))
        .when(is_("name"), F.when(F.length(body) > 6, plus).otherwise(none)).otherwise(F.when(F.length(body) >= 8, plus).otherwise(none))
    )
    return F.concat(pattern, known, cue, near, make)


def _features(s: Column) -> list[Column]:
    """What the classifier sees of a span: each a short string, prefixed by its kind."""
    body, kind = s["body"], s["kind"].cast("string")
    edge = lambda c: F.when(c == "", "e").when(c.rlike(r"^\s"), "s").when(c.rlike("^[A-Za-z0-9]"), "w").otherwise("p")
    size = F.least(F.floor(F.length(body) / 8), F.lit(6)).cast("string")
    share = F.floor(4 * F.length(_digits(body)) / F.greatest(F.length(body), F.lit(1))).cast("string")
    return [F.concat(kind, F.lit(f":{n}:"), v) for n, v in (("size", size), ("digits", share), ("before", edge(F.right(s["before"], F.lit(1)))), ("after", edge(s["after"])))]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as the struct column `row`, with the array `spans` of all spans, base and proposed, and their votes and features."""
    step = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    step = step.select("row", *[c for k in range(len(KINDS)) for c in _candidates(F.col("t"), k)])
    step = step.select("row", *[_spans(k).alias(f"s{k}") for k in range(len(KINDS))])
    step = step.select("row", F.concat(*[f"s{k}" for k in range(len(KINDS))]).alias("s"))
    told = F.transform(
        "s", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _votes(s).alias("votes"), F.array(*_features(s)).alias("features"))
    )
    return step.select("row", F.sort_array(told).alias("spans"))


class Reliabilities:
    """Expectation-maximisation over counts of (kind, votes): a labeler's chance to vote + or - on personal and other spans."""

    def __init__(self, counts: dict[tuple[int, str], int], rounds: int = 30):
        believed = {kv: 0.5 + 0.4 * math.tanh(kv[1].count("+") - 2 * kv[1].count("-")) for kv in counts}
        for _ in range(rounds):
            share = {k: [1.0, 1.0] for k in range(len(KINDS))}
            chance = [[{"+": 2.0, "0": 1.0, "-": 0.5}, {"+": 0.5, "0": 1.0, "-": 2.0}] for _ in range(LABELERS)]
            for (kind, votes), n in counts.items():
                p = believed[kind, votes]
                share[kind][0] += n * p
                share[kind][1] += n * (1 - p)
                for i, v in enumerate(votes):
                    chance[i][0][v] += n * p
                    chance[i][1][v] += n * (1 - p)
            for kind, votes in counts:
                odds = math.log(share[kind][0] / share[kind][1])
                for i, v in enumerate(votes):
                    yes, no = chance[i]
                    odds += math.log(yes[v] / sum(yes.values())) - math.log(no[v] / sum(no.values()))
                p = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
                # base spans that no labeler objects to anchor which of the two classes is the personal one
                believed[kind, votes] = max(p, 0.9) if kind < BASE and "-" not in votes else p
        self.believed = believed


class Classifier:
    """Naive Bayes over the spans' features, trained on counts of (kind, votes, features) with the votes' soft labels."""

    def __init__(self, rows: list[tuple[int, str, list[str], int]]):
        counts: dict = {}
        for kind, votes, _, n in rows:
            counts[kind, votes] = counts.get((kind, votes), 0) + n
        believed = Reliabilities(counts).believed
        share: dict = {}
        seen: dict = {}
        for kind, votes, features, n in rows:
            p = believed[kind, votes]
            for key, into in [(kind, share), *((f, seen) for f in features)]:
                old = into.get(key, (1.0, 1.0))
                into[key] = (old[0] + n * p, old[1] + n * (1 - p))
        self.weights = {str(k): math.log(a / b) for k, (a, b) in share.items()}
        for f, (a, b) in seen.items():
            whole = share[int(f.split(":")[0])]
            self.weights[f] = math.log(a / (whole[0] + 1)) - math.log(b / (whole[1] + 1))

    def column(self, s: Column) -> Column:
        """The log odds that the span is personal data."""
        if not self.weights:
            return F.lit(-1.0)
        weights = F.create_map(*[F.lit(x) for k, v in sorted(self.weights.items()) for x in (k, v)])
        own = F.aggregate(s["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(weights, f), F.lit(0.0)))
        return own + F.coalesce(F.try_element_at(weights, s["kind"].cast("string")), F.lit(0.0))


def train(found: DataFrame) -> Classifier:
    each = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n"))
    return Classifier([(r["kind"], r["votes"], list(r["features"]), r["n"]) for r in each.collect()])  # bounded: see above


def personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row struct, base, spans): arrays of (start, kind, end), sorted; spans holds base too. keep: the columns of row."""
    found = find(docs, text)
    fields = keep if keep is not None else docs.columns
    found = found.select(F.struct(*[F.col("row")[c].alias(c) for c in fields]).alias("row"), "spans")
    found = Scratch(docs.sparkSession).keep(found, "spans")
    model = train(found)
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: s["kind"] < BASE), plain)
    step = found.select("row", "spans", base.alias("base"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("spans", lambda s: (s["kind"] >= BASE) & (model.column(s) > 0) & free(s))
    return step.select("row", "base", F.sort_array(F.concat("base", F.transform(added, plain))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; null texts stay null."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k, *_ in KINDS])
    found = personal_data(docs, text).select("row", F.col("row")[text].alias("t"), "spans")
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        more = F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.get(names, s["kind"]))
        inside = s["end"] <= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(more).alias("out"))

    new = F.aggregate("spans", none, step, lambda a: F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, F.length("t"))))
    new = F.when(F.size("spans") == 0, F.col("t")).otherwise(new)
    found = found.select("row", new.alias("new"))
    return found.select(*[F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [n(i).alias(f"n_{KINDS[i][0]}") for i in range(BASE)]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
