"""Personal data by weak supervision, in DataFrame and SQL functions only.

1. Candidates: spans that a pattern of their kind finds. A text is split at a pattern, so a
   candidate's place is the length of what stands before it, and its surroundings are at hand.
2. Labelers vote on each candidate for, against, or not at all: its form (checksums, ranges), a gazetteer,
   words of its kind before it, words that speak for something else, its edges, and values reserved for examples.
3. Votes are counted by pattern, of which there are at most 3 ** labelers for a kind, and
   expectation-maximisation finds how often each labeler votes so on personal and on other spans, and from
   that the chance of each pattern.
4. The final classifier is trained on all candidates with these chances as soft labels: naive Bayes on hashed
   features (shape, lengths, neighbouring words and characters), none of which is a vote. So it also decides where labelers abstain or disagree.

Spans of the base kinds (email, ip, card, phone) that meet their rule are always kept. The classifier adds spans of the
other kinds. Counts are of integers (chances in millionths), so partitioning does not change what is learned.

Defined results: a null or empty text has no spans. Texts of any length are searched whole, in time linear in
their length. Spans of different kinds may overlap; those of one kind do not. Equal rows get equal spans. A corpus without
candidates of a kind teaches nothing of it. An empty table gives an empty result. Columns beside doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import text_or_empty, written

#: Characters on either side of a candidate that labelers and features see.
AROUND = 40
#: Features are hashed to so many places for each kind.
PLACES = 2048
ROUNDS = 30
UNIT = 1_000_000

# Gazetteers and words of context.
GIVEN_NAMES = "Anna|Maria|John|James|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Elizabeth|Hans|Peter|Klaus|Jürgen|Ursula|Monika|Sabine|Jean|Pierre|Marie|Nathalie|Isabelle|Philippe|José|Juan|Carlos|Luis|Carmen|Ana|Lucía|Antonio|Thomas|Daniel|Paul|Laura|Sarah|Emma"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Doña"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd"
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|it|uk|eu|ch|at|info"
CUES = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write to|reach|schreib",
    "ip": "ip|address|adresse|host|server|login|logged|from|client",
    "card": "card|karte|carte|tarjeta|visa|mastercard|amex|payment|paid|credit",
    "phone": "tel|phone|call|fax|mobile|cell|ruf|appel|llam|whatsapp|sms",
    "number": "ssn|social security|iban|account|konto|compte|cuenta|tax|passport",
    "person": "name|dear|sincerely|regards|signed|author|patient|customer|lives|address|wohn|habite|vive",
}
AGAINST = "version|release|isbn|issn|doi|chapter|section|page|figure|table|build|part no|model|rfc|order no|price"


@dataclass(frozen=True)
class Kind:
    """What is searched for, and what its labelers know."""

    name: str
    pattern: str  # possessive where it repeats, and bound on its left, so that a long run is read once
    form: Callable[[Column], Column]
    gazetteer: str
    cues: str
    reserved: str
    base: bool = False


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def like(pattern: str) -> Callable[[Column], Column]:
    return lambda span: span.rlike(pattern)


OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
MAILBOX = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"

BASE = (
    Kind("email", rf"(?:\G|(?<!{MAILBOX})){MAILBOX}++@{LABEL}++(?:\.{LABEL}++)++", lambda s: F.lit(True), rf"\.(?:{DOMAINS})$", CUES["email"], r"@example\.|@test\.|noreply|no-reply", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", like(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "^(?:10|192|172|8|1)[.]", CUES["ip"], r"^(?:127\.|0\.|255\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)", True),
    Kind("card", "[0-9](?:[ -]?[0-9])++", lambda s: F.length(digits(s)).between(14, 19) & F.call_function("luhn_check", digits(s)), "^(?:4|5[1-5]|3[47]|6011|65)", CUES["card"], "^(?:([0-9])\\1+|4111 ?1111)", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda s: F.length(digits(s)).between(10, 15), r"^\+(?:1|33|34|44|49|39|41|43|31|32)", CUES["phone"], "555-?01[0-9]{2}$", True),
)
CAPITAL = r"\p{Lu}\p{Ll}++"
OTHER = (
    Kind(
        "masked_email",
        rf"(?<!{MAILBOX}){MAILBOX}++ ?[(\[{{](?:at|AT)[)\]}}] ?{LABEL}++(?: ?(?:[(\[{{](?:dot|DOT)[)\]}}]|\.) ?{LABEL}++)++",
        lambda s: F.lit(True),
        rf"[.)\]}}] ?(?:{DOMAINS})$",
        CUES["email"],
        "example|test",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+(.-])(?<![0-9+][ .-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])",
        lambda s: F.length(digits(s)).between(9, 12),
        r"^\(",
        CUES["phone"],
        "555-?01[0-9]{2}$",
    ),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", like("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), "^[0-8]", CUES["number"], "^(?:123-45-6789|078-05-1120)$"),
    Kind(
        "iban",
        "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        lambda s: F.length(F.regexp_replace(s, " ", "")).between(15, 34),
        "^(?:DE|FR|ES|IT|GB|CH|AT|NL|BE)",
        CUES["number"],
        "^([A-Z0-9])\\1+$",
    ),
    Kind("ip6", "(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])", like("[2-9a-fA-F]"), "^(?:2[0-9a-f]{3}|fd|fe80)", CUES["ip"], "^2001:0?db8:"),
    Kind("person", rf"(?<!\p{{L}})(?:(?:{TITLES})\.? |(?:{GIVEN_NAMES}) ){CAPITAL}(?:[ -]{CAPITAL})?", like(rf"^(?:{TITLES})\.? "), rf"(?:^|[ .])(?:{GIVEN_NAMES})(?: |$)", CUES["person"], "(?:Doe|Mustermann|Dupont)$"),
    Kind(
        "street",
        rf"(?<![0-9])[0-9]{{1,5}} {CAPITAL}(?: {CAPITAL})? (?:{STREETS})(?!\p{{L}})|(?<!\p{{L}})\p{{Lu}}\p{{Ll}}{{1,20}}(?:straße|strasse|weg|platz) [0-9]{{1,4}}(?![0-9])",
        lambda s: F.lit(True),
        f"(?:{STREETS}|straße)",
        CUES["person"],
        "^(?:123 Main|742 Evergreen)",
    ),
)
KINDS = (*BASE, *OTHER)
VOTES = 6  # labelers
PIECE = "struct<n:int,head:string,tail:string>"
ZIPPED = f"struct<span:string,before:{PIECE},after:{PIECE},last:int>"
SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,votes:string,features:array<int>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is made once, however often body uses it: the one element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cumulated(steps: Column, part: int = 256) -> Column:
    """Running sums of an array, part by part: what an element costs does not grow with the array."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("int"), operator.add)

    def of_parts(parts: Column) -> Column:
        one = lambda sums: lambda xs, b: let(total(F.slice(sums, 1, b)), lambda before: F.transform(xs, lambda _, i: before + total(F.slice(xs, 1, i + 1))))
        return let(F.transform(parts, total), lambda sums: F.flatten(F.transform(parts, one(sums))))

    def in_parts(xs: Column) -> Column:
        n = F.floor((F.size(xs) - 1) / part).cast("int")
        return let(F.transform(F.sequence(F.lit(0), n), lambda b: F.slice(xs, b * part + 1, part)), of_parts)

    return let(steps, in_parts)


def vote(for_: Column | None, against: Column | None) -> Column:
    """One labeler: 2 for, 0 against, 1 not at all."""
    found = F.lit("1")
    if against is not None:
        found = F.when(against, "0").otherwise(found)
    return F.when(for_, "2").otherwise(found) if for_ is not None else found


def votes(kind: Kind, span: Column, before: Column, after: Column) -> Column:
    glued = before.rlike(r"[\p{L}0-9_@/=]$") | after.rlike(r"^[\p{L}0-9_@/=]")
    return F.concat(
        vote(kind.form(span), ~kind.form(span)),
        vote(span.rlike(kind.gazetteer), None),
        vote(before.rlike(rf"(?i)(?:^|\P{{L}})(?:{kind.cues})"), None),
        vote(None, before.rlike(rf"(?i)(?:^|\P{{L}})(?:{AGAINST})")),
        vote(~glued, glued),
        vote(None, span.rlike(kind.reserved)),
    )


def features(span: Column, before: Column, after: Column) -> Column:
    """Places of the hashed features."""
    shape = span
    for pattern, mark in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), ("[0-9]+", "9")):
        shape = F.regexp_replace(shape, pattern, mark)
    said = (
        F.left(shape, F.lit(60)),
        F.least(F.floor(F.length(span) / 4), F.lit(12)).cast("string"),
        F.least(F.length(digits(span)), F.lit(20)).cast("string"),
        F.lower(F.regexp_extract(before, r"([\p{L}0-9]+)[^\p{L}0-9]*$", 1)),
        F.lower(F.regexp_extract(before, r"([\p{L}0-9]+)[^\p{L}0-9]+[\p{L}0-9]+[^\p{L}0-9]*$", 1)),
        F.lower(F.regexp_extract(after, r"^[^\p{L}0-9]*([\p{L}0-9]+)", 1)),
        F.right(before, F.lit(1)),
        F.left(after, F.lit(1)),
    )
    return F.array(*[F.pmod(F.hash(F.lit(i), x), F.lit(PLACES)) for i, x in enumerate(said)])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of start, kind (number), end, base, votes and features, in order of start and kind."""
    found = docs.select("doc_id", text_or_empty().alias("text"))
    found = found.select("doc_id", "text", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"m{i}") for i, k in enumerate(KINDS)])
    piece = lambda p: F.struct(F.length(p).alias("n"), F.left(p, F.lit(AROUND)).alias("head"), F.right(p, F.lit(AROUND)).alias("tail"))
    cut = lambda i, k: F.when(F.size(f"m{i}") > 0, F.transform(F.split("text", k.pattern, -1), piece)).alias(f"p{i}")
    found = found.select("doc_id", *[f"m{i}" for i in range(len(KINDS))], *[cut(i, k) for i, k in enumerate(KINDS)])

    def spans(i: int, kind: Kind) -> Column:
        # Arrays go through arguments of lambdas, never into them from outside, where they would be made for each element.
        def one(x: Column) -> Column:
            span, before, after, start = x["span"], x["before"]["tail"], x["after"]["head"], x["last"] - F.length(x["span"])
            valid = kind.form(span) if kind.base else F.lit(False)
            return F.struct(start.alias("start"), F.lit(i).alias("kind"), x["last"].alias("end"), valid.alias("base"), votes(kind, span, before, after).alias("votes"), features(span, before, after).alias("features"))

        def zipped(m: Column, p: Column) -> Column:
            ends = cumulated(F.zip_with(m, F.slice(p, 1, F.size(m)), lambda span, piece: piece["n"] + F.length(span)))
            around = F.arrays_zip(m.alias("span"), F.slice(p, 1, F.size(m)).alias("before"), F.slice(p, 2, F.size(m)).alias("after"), ends.alias("last"))
            return F.transform(around, lambda x: one(x.cast(ZIPPED)))

        m, p = F.col(f"m{i}"), F.col(f"p{i}")
        return F.when(F.size(m) > 0, let(p, lambda p: let(m, lambda m: zipped(m, p)))).otherwise(F.array().cast(SPANS))

    return found.select("doc_id", F.array_sort(F.concat(*[spans(i, k) for i, k in enumerate(KINDS)])).alias("spans"))


#: Votes that a labeler is thought to have cast before any are counted (against, none, for), on personal and on other spans.
FORE = {1: (0.5, 1.0, 2.0), 0: (2.0, 1.0, 0.5)}


def vote_chances(counted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, votes, chance (in millionths): expectation-maximisation over the patterns of votes (kind, votes, n).

    A kind has at most 3 ** VOTES patterns, so all of a kind stand in one row; each round is an
    expression on that row. A labeler's votes are independent given what the span is.
    """
    read = F.transform(F.sequence(F.lit(1), F.lit(VOTES)), lambda j: F.substring("votes", j, F.lit(1)).cast("int"))
    first = F.aggregate(read, F.lit(0.0), lambda a, v: a + v - 1)
    one = F.struct("votes", read.alias("v"), F.col("n").cast("double").alias("n"), (1 / (1 + F.exp(-first))).alias("q"))
    rows = counted.groupBy("kind").agg(F.sort_array(F.collect_list(one)).alias("state"))

    def weight(state: Column, y: int, held: Callable[[Column], Column] | None = None) -> Column:
        share = lambda p: p["n"] * (p["q"] if y else 1 - p["q"])
        return F.aggregate(state, F.lit(0.0), lambda a, p: a + (F.when(held(p), share(p)).otherwise(0.0) if held else share(p)))

    def learned(state: Column) -> Column:
        """prior: log odds; w: of each labeler's votes, 3 numbers each."""
        def rate(y: int, i: Column) -> Column:
            cast = weight(state, y, lambda p: F.get(p["v"], F.floor(i / 3).cast("int")) == i % 3)
            return (cast + F.get(F.array(*[F.lit(x) for x in FORE[y]]), i % 3)) / (weight(state, y) + sum(FORE[y]))

        w = F.transform(F.sequence(F.lit(0), F.lit(3 * VOTES - 1)), lambda i: F.ln(rate(1, i)) - F.ln(rate(0, i)))
        return F.struct((F.ln(weight(state, 1) + 1) - F.ln(weight(state, 0) + 1)).alias("prior"), w.alias("w"))

    def expected(p: Column, told: Column) -> Column:
        odds = F.aggregate(F.sequence(F.lit(0), F.lit(VOTES - 1)), told["prior"], lambda a, j: a + F.get(told["w"], 3 * j + F.get(p["v"], j)))
        return F.struct(p["votes"].alias("votes"), p["v"].alias("v"), p["n"].alias("n"), (1 / (1 + F.exp(-odds))).alias("q"))

    def step(state: Column, _: Column) -> Column:
        return let(learned(state), lambda told: F.transform(state, lambda p: expected(p, told)))

    done = rows.select("kind", F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("state"), step)).alias("p"))
    return done.select("kind", "p.votes", F.round(F.col("p.q") * UNIT).cast("long").alias("chance"))


def weights(found: DataFrame, chances: DataFrame) -> DataFrame:
    """One row, w: the classifier's weights, of each kind its prior and then PLACES features.

    chances has at most len(KINDS) * 3 ** VOTES rows, so it is broadcast.
    """
    each = found.select(F.explode("spans").alias("x")).select("x.kind", "x.votes", "x.features")
    soft = each.join(F.broadcast(chances), ["kind", "votes"])
    place = F.explode(F.array_prepend(F.transform("features", lambda f: f + 1), F.lit(0)))
    sums = soft.select("kind", place.alias("place"), "chance").groupBy("kind", "place").agg(F.sum("chance").alias("yes"), F.count("*").alias("n"))
    sums = sums.select("kind", "place", (F.col("yes") / UNIT).alias("yes"), (F.col("n") - F.col("yes") / UNIT).alias("no"))
    all_ = sums.where("place = 0").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    log_share = lambda part, whole: F.ln((F.col(part) + 1) / (F.col(whole) + 2))
    w = F.when(F.col("place") == 0, F.ln(F.col("yes") + 1) - F.ln(F.col("no") + 1)).otherwise(log_share("yes", "all_yes") - log_share("no", "all_no"))
    told = sums.join(F.broadcast(all_), "kind").select((F.col("kind") * (PLACES + 1) + F.col("place")).cast("bigint").alias("id"), w.alias("w"))
    slots = found.sparkSession.range(len(KINDS) * (PLACES + 1)).join(told, "id", "left")
    return slots.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("w"))


def pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of kind, start, end (code points, end exclusive), base, score (0 to 1), by start and then kind."""
    found = written(candidates(docs), "candidates")
    counted = found.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n"))
    chances = written(vote_chances(counted), "chances")
    learned = written(weights(found, chances), "weights")
    w = F.col("_w")
    names = F.array(*[F.lit(k.name) for k in KINDS])

    def judged(x: Column) -> Column:
        at = x["kind"] * (PLACES + 1)
        odds = F.aggregate(x["features"], F.get(w, at), lambda a, f: a + F.get(w, at + f + 1))
        return F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), (1 / (1 + F.exp(-odds))).alias("score"), x["kind"].alias("n"))

    scored = found.withColumn("_w", learned.select("w").scalar()).select("doc_id", F.transform("spans", judged).alias("spans"))
    kept = F.filter("spans", lambda x: x["base"] | ((x["n"] >= len(BASE)) & (x["score"] >= 0.5)))
    return scored.select("doc_id", F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), x["score"].alias("score"))).alias("spans"))
