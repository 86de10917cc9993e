"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

DataFrame functions only. The driver sees counts of vote patterns, whose number is bounded by the labelers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.rows import kept, whole

#: Kinds in the order in which spans at one place are listed; the first four have a base pattern.
KINDS = ("email", "ip", "card", "phone", "person")
BASE_KINDS = KINDS[:4]

# The base patterns. Possessive where nothing that follows could give a match back, so that long runs take
# linear time and no recursion; a card's run with too few digits is left out by the pattern itself.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond the base patterns; only what the classifier is sure of becomes a span.
MORE = {
    "email": r"(?i)[a-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+().-])(?<![0-9+]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?",
}
#: What a text must hold for one of the other patterns to be tried.
MORE_HINTS = {
    "email": r"(?i)[\[(]\x20?at\x20?[\])]", "ip": r"(?i)[0-9a-f]:[0-9a-f]{1,4}:[0-9a-f]", "card": r"[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}",
    "phone": r"[0-9]{3}[\x20.-][0-9]{4}", "person": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[A-Z]",
}

#: Characters before a span that the context labeler reads.
CONTEXT = 32
#: Gazetteers: endings of domains, first digits of card issuers, country codes, given names.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "it", "eu", "us", "ch", "at", "nl")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "35", "36", "38", "62")
COUNTRIES = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
NAMES = ("anna", "ana", "carlos", "claire", "david", "elena", "emma", "george", "hans", "james", "jean", "john", "jose", "juan", "karl", "laura", "lena", "luis", "maria", "marie", "mary", "michael", "paul", "peter", "pierre", "robert", "sarah", "sofia", "thomas", "william")
#: Words that speak for each kind right before it, and words that speak for a number of another sort.
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach|correo|courriel)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(ip|host|server|address|addr|login|client|from)\W*(?:\w+\W+)?$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|debit|pay|iban|account|karte|carte|tarjeta)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell|whatsapp|sms|telefon|handy)\W*(?:\w+\W+)?$",
    "person": r"(?i)(dear|hello|name|by|sincerely|regards|signed)\W*(?:\w+\W+)?$",
}
AGAINST = r"(?i)(order|invoice|version|ver|build|id|token|key|hash|isbn|sku|serial|page|no|nr|commit)[\s.:=#\"']*$"

LABELERS = ("regex", "gazetteer", "context", "boundary", "plausible")
#: Posterior from which a candidate beyond the base patterns is a span; rounds of EM and of training.
SURE, EM_ROUNDS, TRAIN_ROUNDS = 0.9, 30, 400


def _found(text: str, pattern: str, kind: str, base: bool) -> Column:
    """All leftmost matches as structs (start, end, kind, base, found, left, right), positions in code points.

    The pieces between matches come from ``split``, the matches from ``regexp_extract_all``; positions are running sums of
    their lengths.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    item = "struct<start:int,end:int,kind:string,base:boolean,found:string,left:string,right:string>"
    made = f"""named_struct('start', a.at + length(x.gap), 'end', a.at + length(x.gap) + length(x.found), 'kind', '{kind}', 'base', {str(base).lower()},
        'found', x.found, 'left', right(concat(a.tail, x.gap), {CONTEXT}), 'right', left(x.after, 2))"""
    return F.expr(f"""aggregate(
        transform(regexp_extract_all({text}, '{quoted}', 0), (m, i) -> named_struct('found', m, 'i', i)),
        named_struct('at', 0, 'tail', '', 'out', cast(array() as array<{item}>), 'gaps', split({text}, '{quoted}', -1)),
        (b, y) -> transform(array(named_struct('a', b, 'x', named_struct('gap', element_at(b.gaps, y.i + 1), 'found', y.found, 'after', element_at(b.gaps, y.i + 2)))),
            z -> named_struct('at', z.a.at + length(z.x.gap) + length(z.x.found), 'tail', right(z.x.found, {CONTEXT}),
                'out', concat(z.a.out, array({made.replace("a.", "z.a.").replace("x.", "z.x.")})), 'gaps', z.a.gaps))[0],
        b -> b.out)""")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.when(F.length(digits) > 0, F.aggregate(places, F.lit(0), add) % 10 == 0).otherwise(False)


def _small_part(p: Column) -> Column:
    """A number of any length is at most 255."""
    bare = F.regexp_replace(p, "^0+", "")
    return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)


def _valid(s: Column) -> Column:
    """The base rule of a match's kind."""
    found = s["found"]
    n = F.length(_digits(found))
    return (
        F.when(s["kind"] == "ip", F.forall(F.split(found, r"\."), _small_part))
        .when(s["kind"] == "card", n.between(14, 19) & _luhn(_digits(found)))
        .when(s["kind"] == "phone", n.between(10, 15))
        .otherwise(True)
    )


NO_SPANS = "cast(array() as array<struct<start:int,end:int,kind:string,base:boolean,found:string,left:string,right:string>>)"


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` and __spans: base spans that pass their rule, and other candidates that do not touch one of these."""
    t = docs.withColumn("__t", whole(text))
    none = F.expr(NO_SPANS)
    hints = {"email": F.col("__t").contains("@"), "phone": F.col("__t").contains("+"), "ip": F.col("__t").rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": F.col("__t").rlike(r"[0-9](?:[\x20-]?[0-9]){13}")}
    base = [F.when(hints[k], F.filter(_found("__t", BASE[k], k, True), _valid)).otherwise(none) for k in BASE_KINDS]
    more = [F.when(F.col("__t").rlike(MORE_HINTS[k]), _found("__t", p, k, False)).otherwise(none) for k, p in MORE.items()]
    t = t.withColumns({"__base": F.concat(*base), "__more": F.concat(*more)})
    apart = F.filter("__more", lambda m: ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return t.withColumn("__spans", F.transform(F.concat("__base", apart), with_votes)).drop("__t", "__base", "__more")


def with_votes(s: Column) -> Column:
    """A candidate's place, size and votes, without its text."""
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), _size(s).alias("size"), *[c.cast("int").alias(n) for n, c in votes(s).items()])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(s: Column) -> dict[str, Column]:
    """What each labeler says of a span: 1 personal data, -1 not, 0 nothing."""
    kind, found, left, right = s["kind"], s["found"], s["left"], s["right"]
    digits = _digits(found)
    domain = F.lower(F.regexp_extract(found, r"([A-Za-z]+)$", 1))
    first = F.lower(F.regexp_extract(found, r"\s([A-Z][a-z]+)", 1))
    starts = lambda codes: F.array_contains(F.array(*[digits.startswith(c) for c in codes]), F.lit(True))
    cue = F.coalesce(*[F.when(kind == k, left.rlike(p)) for k, p in CUES.items()])
    shape = (
        F.when(kind == "email", found.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$") | ~s["base"])
        .when(kind == "card", F.length(digits).between(14, 19) & _luhn(digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(F.lit(True))
    )
    listed = (
        F.when(kind == "email", domain.isin(*DOMAINS)).when(kind == "card", starts(ISSUERS))
        .when(kind == "phone", F.when(s["base"], starts(COUNTRIES)).otherwise(digits.rlike("^[2-9]")))
        .when(kind == "person", first.isin(*NAMES)).otherwise(~digits.rlike("^(0|255|127)"))
    )
    tied = left.rlike(r"[\p{L}0-9_=/#\"'@]$") | right.rlike(r"^[\p{L}0-9_=/@]")
    dull = digits.rlike(r"^(\d)\1*$") & (F.length(digits) > 0)
    return {
        "regex": _vote(shape, ~shape),
        "gazetteer": _vote(listed, ~listed & (kind != "person")),
        "context": _vote(cue, left.rlike(AGAINST)),
        "boundary": _vote(~tied, tied),
        "plausible": _vote(~dull & (F.length(found) <= 64), dull | (F.length(found) > 64)),
    }


def _size(s: Column) -> Column:
    return F.least(F.floor(F.length(s["found"]) / 8), F.lit(5)).cast("int")


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict[str, float], list[dict[int, dict[bool, float]]], dict[tuple[str, tuple[int, ...]], float]]:
    """EM for two classes over (kind, votes, count): each kind's share of personal data, each labeler's chance of a vote by class, posteriors.

    Labelers are taken as independent given the class. It starts from the majority; votes are smoothed by one each.
    """
    post = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in patterns}
    share: dict[str, float] = {}
    chance: list[dict[int, dict[bool, float]]] = []
    for _ in range(EM_ROUNDS):
        for kind in KINDS:
            n = sum(c for k, _, c in patterns if k == kind)
            share[kind] = (1 + sum(c * post[k, v] for k, v, c in patterns if k == kind)) / (2 + n)
        chance = []
        for j in range(len(LABELERS)):
            by = {x: {True: 1.0, False: 1.0} for x in (-1, 0, 1)}
            # A labeler is better than chance: a class's own vote starts with more weight.
            by[1][True] += 2.0
            by[-1][False] += 2.0
            for k, v, c in patterns:
                by[v[j]][True] += c * post[k, v]
                by[v[j]][False] += c * (1 - post[k, v])
            total = {y: sum(by[x][y] for x in by) for y in (True, False)}
            chance.append({x: {y: by[x][y] / total[y] for y in (True, False)} for x in by})
        for k, v, _ in patterns:
            odds = math.log(share[k] / (1 - share[k])) + sum(math.log(chance[j][x][True] / chance[j][x][False]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return share, chance, post


def classifier(patterns: list[tuple[str, tuple[int, ...], int, int]], post: dict[tuple[str, tuple[int, ...]], float]) -> dict[str, float]:
    """Weights of a logistic model of features (kind, votes, size), fitted to EM's posteriors by gradient steps with a weight penalty."""
    weights: dict[str, float] = {}
    rows = [(features(k, v, z), c, post[k, v]) for k, v, z, c in patterns]
    total = sum(c for _, c, _ in rows) or 1
    speed: dict[str, float] = {}
    for _ in range(TRAIN_ROUNDS):
        slope: dict[str, float] = {}
        for names, c, p in rows:
            x = sum(weights.get(f, 0.0) for f in names)
            miss = c / total * (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
            for f in names:
                slope[f] = slope.get(f, 0.0) + miss
        for f, s in slope.items():
            s -= 1e-4 * weights.get(f, 0.0)
            speed[f] = 0.99 * speed.get(f, 0.0) + 0.01 * s * s
            weights[f] = weights.get(f, 0.0) + 0.05 * s / (math.sqrt(speed[f]) + 1e-6)
    return weights


def features(kind: str, vote: tuple[int, ...], size: int) -> list[str]:
    return ["bias", f"kind:{kind}", f"size:{size}", *[f"{name}:{x}" for name, x in zip(LABELERS, vote, strict=True)]]


def _score(s: Column, weights: dict[str, float]) -> Column:
    """The classifier's log odds of a span as a column expression."""
    def of(prefix: str, value: Column, among) -> Column:
        out = F.lit(0.0)
        for x in among:
            out = F.when(value == x, weights.get(f"{prefix}:{x}", 0.0)).otherwise(out)
        return out

    total = F.lit(weights.get("bias", 0.0)) + of("kind", s["kind"], KINDS) + of("size", s["size"], range(6))
    for name in LABELERS:
        total = total + of(name, s[name], (-1, 0, 1))
    return total


def train(rows: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from the votes on all candidates of ``rows`` (with __spans); the driver gets their counts by pattern."""
    spans = rows.select(F.explode("__spans").alias("s"))
    counted = spans.groupBy(*[F.col(f"s.{n}").alias(n) for n in ("kind", "size", *LABELERS)]).agg(F.count("*").alias("n")).collect()
    table = sorted((r["kind"], tuple(r[n] for n in LABELERS), r["size"], r["n"]) for r in counted)
    joint: dict[tuple[str, tuple[int, ...]], int] = {}
    for k, v, _, c in table:
        joint[k, v] = joint.get((k, v), 0) + c
    post = reliabilities([(k, v, c) for (k, v), c in sorted(joint.items())])[2]
    return classifier(table, post)


def chosen(weights: dict[str, float]) -> Column:
    """The spans among __spans: base ones and those that the classifier is sure of, by start, then kind."""
    least = math.log(SURE / (1 - SURE))
    stay = F.filter("__spans", lambda s: s["base"] | (_score(s, weights) >= least))
    place = F.transform(stay, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return F.transform(F.array_sort(place), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key`` and spans, an array of structs (start, end, kind, base) by start, then kind; positions in code points, end exclusive.

    Base spans are the leftmost matches of their kinds' patterns that pass their rules; they always stay. Others are
    candidates of wider patterns that touch no base span and that the classifier, trained on this corpus, takes for
    personal data with probability ``SURE``. Texts are read once; votes are counted over all candidates of all rows.

    Null and empty texts have no spans; null keys and repeated rows give a row each; an empty table gives an empty one;
    other columns are not looked at.
    """
    rows = with_candidates(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__text")
    rows = kept(rows.select("__key", "__spans"))
    return rows.select(F.col("__key").alias(key), chosen(train(rows)).alias("spans"))


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, such as <email>. Null texts stay null, other columns are kept as they are.

    Texts are read twice, to count votes and to mask, so that they are neither shuffled nor written between.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(text).alias("__text"), *([F.struct(*[F.col(c) for c in rest]).alias("__rest")] if rest else []))
    rows = with_candidates(rows, "__text")
    weights = train(rows.select("__spans"))
    found = rows.withColumn("__chosen", chosen(weights))
    made = F.when(F.size("__chosen") > 0, masked("__text", "__chosen")).otherwise(F.col("__text"))
    return found.select(*[made.alias(c) if c == text else F.col("__rest").getField(c).alias(c) for c in docs.columns])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def pii_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``find_pii`` as counts of base spans, the digest of the base spans, and all spans as kind:start:end, comma-joined."""
    found = find_pii(docs, key, text)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: str, spans: str = "spans") -> Column:
    """The text with each span replaced by its kind in angle brackets; a span inside or across an earlier one is covered by it.

    A running copy of what precedes each span, so linear in spans times the pieces between them.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        )

    return F.aggregate(F.col(spans), start, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
