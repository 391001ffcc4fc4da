"""Personal data by weak supervision, in column expressions throughout.

Strict patterns give the base spans. Looser patterns give further candidates.
Three labelers vote on every candidate: the form (checks such as Luhn), a
gazetteer (mail endings, card issuers, dialling codes, reserved addresses) and
the words before it. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is; its posteriors train a naive Bayes
classifier on the shape of a span. Candidates that the classifier accepts and
that touch no base span are added; base spans always stay.

Vote patterns and shapes are a fixed number of combinations, so what reaches the
driver does not grow with the corpus, while the counts cover every document.
A null text is empty. Offsets are code points.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.session import stage

KINDS = ("email", "ip", "card", "phone")

# Runs are entered at their first character, or where the last match ended, and
# never given back, so that a long run costs linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
# A run of digits with single separators is taken whole or not at all, so only
# runs of 12 to 19 digits need to be found.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

LOOSE_EMAIL = (
    r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?"
    r"[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"
)
LOOSE_PHONE = r"(?<![0-9+.(-])(?:\(0?[0-9]{2,4}\)|0[0-9]{2,4})[\x20/-][0-9](?:[\x20-]?[0-9]){4,10}+(?![0-9.,-])"

#: Words before a span that speak for its kind.
CUES = {
    "email": r"(?i)\b(?:e-?mail|contact|kontakt|correo|courriel|write to)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|téléphone|teléfono)\b",
}
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "eu", "uk", "de", "fr", "es")
CONTEXT = 24


def _running(values: Column, merge) -> Column:
    """Every value merged with all before it, by doubling: n log n steps for n values."""

    def step(held: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        earlier = F.concat(F.array_repeat(F.lit(None).cast("int"), back), F.slice(held, F.lit(1), F.size(held) - back))
        return F.zip_with(held, earlier, lambda x, y: F.when(y.isNull(), x).otherwise(merge(x, y)))

    rounds = F.ceil(F.log2(F.size(values))).cast("int")
    return F.when(F.size(values) > 1, F.aggregate(F.sequence(F.lit(0), rounds - 1), values, step)).otherwise(values)


#: So many matches and what lies before each fill the context: a match has five characters or more.
BACK = 5


def _spans(rows: DataFrame, patterns: dict[str, tuple[str, str, bool]]) -> DataFrame:
    """All matches per pattern as structs (start, kind, end, body, ahead, loose), leftmost first and non-overlapping.

    ``patterns`` gives pattern, kind and whether it is loose. Starts are running
    lengths of the matches and of what lies between them, and the context is cut
    from these pieces, so that many matches in a text cost little more than in
    proportion. Every step is a column of its own: none is worked out once a match.
    """
    col, names = F.col, list(patterns)
    bodies = [F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_bodies") for k, (p, _, _) in patterns.items()]
    gaps = [F.split("text", p, -1).alias(f"{k}_gaps") for k, (p, _, _) in patterns.items()]
    cut = rows.select("doc_id", *bodies, *gaps)
    before = lambda k: F.slice(F.concat(F.array(F.lit("")), f"{k}_bodies"), F.lit(1), F.size(f"{k}_bodies"))
    between = lambda k: F.slice(f"{k}_gaps", F.lit(1), F.size(f"{k}_bodies"))
    tail = lambda b, g: F.right(F.concat(F.right(b, F.lit(CONTEXT)), g), F.lit(CONTEXT))
    stepped = cut.select(
        "doc_id",
        *[f"{k}_bodies" for k in names],
        *[F.zip_with(before(k), between(k), lambda b, g: F.length(b) + F.length(g)).alias(f"{k}_steps") for k in names],
        *[F.zip_with(before(k), between(k), tail).alias(f"{k}_tails") for k in names],
    )
    kept = [f"{k}_{part}" for k in names for part in ("bodies", "tails")]
    started = stepped.select("doc_id", *kept, *[_running(col(f"{k}_steps"), lambda x, y: x + y).alias(f"{k}_starts") for k in names])

    def span(name: str, kind: str, loose: bool):
        def at(i: Column) -> Column:
            start, body = F.get(f"{name}_starts", i), F.get(f"{name}_bodies", i)
            ahead = F.concat_ws("", *[F.get(f"{name}_tails", i - k) for k in reversed(range(BACK))])
            return F.struct(
                start.alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (start + F.length(body)).alias("end"),
                body.alias("body"),
                F.right(ahead, F.lit(CONTEXT)).alias("ahead"),
                F.lit(loose).alias("loose"),
            )

        some = F.size(f"{name}_bodies") > 0
        return F.transform(F.when(some, F.sequence(F.lit(0), F.size(f"{name}_bodies") - 1)).otherwise(F.array().cast("array<int>")), at)

    return started.select("doc_id", *[span(k, kind, loose).alias(k) for k, (_, kind, loose) in patterns.items()])


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, term), F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets(body: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    small = lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255)
    return F.forall(F.split(body, r"\."), small)


def _sound(span: Column) -> Column:
    """The form check of the span's kind."""
    digits = _digits(span["body"])
    return (
        F.when(span["kind"] == 1, _octets(span["body"]))
        .when(span["kind"] == 2, F.length(digits).between(12, 19) & _luhn(digits))
        .when(span["kind"] == 3, F.length(digits).between(9 - 2 * span["loose"].cast("int"), 15))
        .otherwise(F.lit(True))
    )


def _known(span: Column) -> Column:
    """The gazetteer's vote: 1 or -1."""
    ending = F.lower(F.regexp_extract(span["body"], r"([A-Za-z0-9-]+)$", 1))
    digits = _digits(span["body"])
    first = F.substring(digits, 1, 1)
    octet = F.regexp_extract(span["body"], r"^0*([0-9]{1,3})", 1).try_cast("int")
    good = (
        F.when(span["kind"] == 0, ending.isin(*ENDINGS))
        .when(span["kind"] == 1, octet.between(1, 223) & (octet != 127))
        .when(span["kind"] == 2, first.isin("3", "4", "5", "6"))
        .otherwise(~first.isin("0") | (F.substring(digits, 2, 1) != "0"))
    )
    return F.when(F.coalesce(good, F.lit(False)), 1).otherwise(-1)


def _cued(span: Column) -> Column:
    """The context's vote: 1 or 0 (silent)."""
    hits = [F.when(span["kind"] == i, span["ahead"].rlike(CUES[k])) for i, k in enumerate(KINDS)]
    return F.when(F.coalesce(*hits), 1).otherwise(0)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, kind, end, loose, form, known, cued, shape) of every row."""
    strict = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    patterns = {k: (p, k, False) for k, p in strict.items()}
    patterns |= {"loose_email": (LOOSE_EMAIL, "email", True), "loose_phone": (LOOSE_PHONE, "phone", True)}
    found = _spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), patterns)

    def judged(s: Column) -> Column:
        digits = F.length(_digits(s["body"]))
        return F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["loose"].alias("loose"),
            _sound(s).alias("sound"), _known(s).alias("known"), _cued(s).alias("cued"),
            F.least(digits, F.lit(20)).alias("digits"), s["body"].rlike("[^0-9A-Za-z]").alias("parted"),
        )

    every = F.concat(*patterns)
    return found.select("doc_id", F.transform(every, judged).alias("spans"))


def _votes(row) -> tuple[int, int, int]:
    form = -1 if not row.sound else (0 if row.loose else 1)
    return form, row.known, row.cued


def reliabilities(rows: list, rounds: int = 50) -> dict:
    """Expectation-maximisation over counted vote patterns of one kind.

    Returns the posterior of each pattern that a span is personal data. Votes are
    taken as independent given the truth; counts are smoothed by one.
    """
    counts: dict[tuple, int] = {}
    for r in rows:
        counts[_votes(r)] = counts.get(_votes(r), 0) + r.n
    post = {v: 0.9 if sum(v) > 0 else 0.1 for v in counts}
    for _ in range(rounds):
        yes = sum(counts[v] * post[v] for v in counts) + 1
        no = sum(counts[v] * (1 - post[v]) for v in counts) + 1

        def odds(v: tuple, yes: float = yes, no: float = no, post: dict = post) -> float:
            out = math.log(yes / no)
            for k in range(3):
                a = sum(counts[w] * post[w] for w in counts if w[k] == v[k]) + 1
                b = sum(counts[w] * (1 - post[w]) for w in counts if w[k] == v[k]) + 1
                out += math.log(a / (yes + 2)) - math.log(b / (no + 2))
            return out

        post = {v: 1 / (1 + math.exp(-max(-30.0, min(30.0, odds(v))))) for v in counts}
    return post


#: What the final classifier reads of a span.
FEATURES = ("sound", "known", "cued", "digits", "parted")


def train(spans: DataFrame) -> dict[tuple, float]:
    """Log odds of personal data for every shape: (kind, *FEATURES) -> score.

    Reads counts over all spans; their number is bounded by the features' values.
    """
    shapes = (
        spans.select(F.inline("spans")).groupBy("kind", "loose", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    scores: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        rows = [r for r in shapes if r.kind == kind]
        post = reliabilities(rows)
        yes = sum(r.n * post[_votes(r)] for r in rows) + 1
        no = sum(r.n * (1 - post[_votes(r)]) for r in rows) + 1
        for r in rows:
            score = math.log(yes / no)
            for f in FEATURES:
                same = [q for q in rows if q[f] == r[f]]
                a = sum(q.n * post[_votes(q)] for q in same) + 1
                b = sum(q.n * (1 - post[_votes(q)]) for q in same) + 1
                score += math.log(a / (yes + 2)) - math.log(b / (no + 2))
            scores[kind, *(r[f] for f in FEATURES)] = score
    return scores


def find_personal(docs: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (start, kind, end) in order.

    Both are empty for a text without spans. A candidate is added if its score is
    above ``threshold`` and it overlaps no base span and no candidate before it in
    the order of kinds.
    """
    held = stage(candidates(docs), "pii-spans")
    scores = train(held)
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    accepted = [k for k, v in scores.items() if v > threshold]

    def wanted(s: Column) -> Column:
        hits = [
            reduce(lambda a, b: a & b, [s[f] == F.lit(v) for f, v in zip(("kind", *FEATURES), key, strict=True)])
            for key in accepted
        ]
        return s["loose"] & s["sound"] & reduce(lambda a, b: a | b, hits, F.lit(False))

    base = F.array_sort(F.transform(F.filter("spans", lambda s: ~s["loose"] & s["sound"]), plain))
    more = F.array_sort(F.transform(F.filter("spans", wanted), plain))
    split = held.select("doc_id", base.alias("base"), more.alias("more"))
    # Base spans by start and added ones by end, in one order: the base spans before an
    # added one begin before it ends, and it is clear of them if all end by its start.
    of = lambda at, added: lambda s: F.struct(s[at].alias("at"), F.lit(added).alias("base"), s.alias("span"))
    merged = F.array_sort(F.concat(F.transform("base", of("start", 1)), F.transform("more", of("end", 0))))
    both = (F.size("base") > 0) & (F.size("more") > 0)
    lined = split.select("*", F.when(both, merged).alias("line"))
    ends = F.transform("line", lambda c: F.when(c["base"] == 1, c["span"]["end"]))
    reached = lined.select("*", ends.alias("ends")).select("*", _running(F.col("ends"), lambda x, y: F.greatest(x, y)).alias("reach"))
    judged = F.zip_with("line", "reach", lambda c, r: F.when((c["base"] == 0) & (F.coalesce(r, F.lit(0)) <= c["span"]["start"]), c["span"]))
    clear = F.when(both, F.filter(judged, lambda s: s.isNotNull())).otherwise(F.col("more"))
    return reached.select("doc_id", "base", F.array_sort(F.concat("base", clear)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def personal_report(docs: DataFrame) -> DataFrame:
    """Counts per kind and digests of the base spans, with all spans listed."""
    of_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find_personal(docs).select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
