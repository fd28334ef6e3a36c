"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, a span classifier decides."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

KINDS = ["email", "ip", "card", "phone"]

# What a span of each kind looks like.  Quantifiers are possessive where nothing could be given back, so that no text makes a pattern run back and forth.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Forms that the strict patterns miss: spelled-out and bracketed signs, national phone numbers.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?[\[({](?:at|@)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({](?:dot|\.)[\])}])\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:[\[({](?:dot|\.)[\])}][0-9]{1,3}){3}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])|(?<![0-9+.-])00[1-9][0-9]{0,2}[\x20-][\x20().0-9-]{7,18}[0-9]",
}
#: Signs that a text must hold before a pattern is tried on it.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
# Gazetteers and context words.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca"]
CARD_STARTS = "^(4|5[1-5]|2[2-7]|3[47]|3[068]|6)"
CALLING_CODES = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|24|25|26|29|35|37|38|42|50|59|67|68|69|85|88|96|97|99)"
CONTEXT = {
    "email": "mail|contact|write|reply|kontakt|schreib|correo|courriel|adress",
    "ip": r"\bip\b|address|server|host|client|login|adresse|servidor|serveur",
    "card": "card|visa|master|amex|payment|paid|credit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|cell|fax|dial|ruf|anruf|llam|appel",
}
AGAINST = r"order|invoice|version|isbn|\bid\b|\bno\.|serial|token|sha|build|rev\."

_LABELERS = ["form", "check", "gazetteer", "context", "edges"]
_SPAN = "struct<kind: int, start: bigint, end: bigint, base: boolean, size: int, form: int, check: int, gazetteer: int, context: int, edges: int>"


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(text: Column, pattern: str) -> Column:
    """All matches of a pattern: start, end (code points), hit, before (40 characters), after (1), in order.

    The pieces between matches and the matches alternate, so their lengths give the places.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    start = "struct(0L as at, cast(array() as array<struct<start: bigint, end: bigint, hit: string, before: string, after: string>>) as out)"

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.char_length(x["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after")
        ))).alias("out"))

    def walk(p: Column) -> Column:
        placed = F.transform(p["hits"], lambda h, i: F.struct(
            h.alias("hit"), F.char_length(F.get(p["gaps"], i)).cast("long").alias("gap"), F.right(F.get(p["gaps"], i), F.lit(40)).alias("before"),
            F.left(F.get(p["gaps"], i + 1), F.lit(1)).alias("after"),
        ))
        return F.aggregate(placed, F.expr(start), add, lambda s: s["out"])

    return _once(parts, walk)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the card checksum: every second digit from the right doubled, less 9 above 9."""
    def part(i: Column, d: Column) -> Column:
        doubled = F.when((F.char_length(d) - i) % 2 == 0, 1).otherwise(2) * F.substring(d, i, F.lit(1)).cast("int")
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return _once(digits, lambda d: F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(d), F.lit(1))), F.lit(0), lambda s, i: s + part(i, d)) % 10 == 0)


def _passes(kind: str, hit: Column) -> Column:
    """The check that a strict match of a kind must pass."""
    d, n = _digits(hit), F.char_length(_digits(hit))
    if kind == "ip":
        return F.forall(F.split(hit, r"[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v.when(no, -1) if no is not None else v).otherwise(0)


def _candidates(text: Column, kind: str, strict: bool) -> Column:
    """A kind's candidate spans with the labelers' votes (1 for, -1 against, 0 none)."""
    k = KINDS.index(kind)

    def judged(x: Column) -> Column:
        hit, low = x["hit"], F.lower(x["before"])
        ok = _passes(kind, hit)
        digits = _digits(hit)
        if kind == "email":
            end = F.lower(F.regexp_extract(hit, "([A-Za-z0-9-]+)$", 1))
            known = _vote(end.isin(TOP_DOMAINS), ~end.rlike("[a-z]{2,}"))
        elif kind == "ip":
            first = F.regexp_extract(hit, "^0*([0-9]*)", 1)
            known = _vote(first.rlike("^([1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])$"), F.lit(True))
        elif kind == "card":
            known = _vote(digits.rlike(CARD_STARTS), F.lit(True))
        else:
            known = _vote(F.regexp_replace(digits, "^00", "").rlike(CALLING_CODES))
        glued = x["before"].rlike(r"[\p{L}0-9_]$") | x["after"].rlike(r"^[\p{L}0-9_]")
        return F.struct(
            F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (ok if strict else F.lit(False)).alias("base"),
            F.least(F.char_length(hit) / 5, F.lit(5)).cast("int").alias("size"), _vote(F.lit(strict) & ok).alias("form"), _vote(ok, ~ok).alias("check"),
            known.alias("gazetteer"), _vote(low.rlike(CONTEXT[kind]), low.rlike(AGAINST)).alias("context"), _vote(~glued, F.lit(True)).alias("edges"),
        ).cast(_SPAN)

    found = _found(text, (STRICT if strict else LOOSE)[kind])
    if kind == "card":
        # Only long runs of digits are candidates.
        found = F.filter(found, lambda x: F.char_length(_digits(x["hit"])).between(13, 19))
    none = F.array().cast(f"array<{_SPAN}>")
    if strict:
        worth = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9](?:[\\x20-]?[0-9]){12}")
        if kind == "ip":
            worth = text.rlike(r"[0-9]\.[0-9]++\.[0-9]")
    else:
        worth = {
            "email": F.contains(text, F.lit(" dot ")) | text.rlike(r"[\[({](?:at|@)[\])}]"), "ip": text.rlike(r"[0-9][\[({](?:dot|\.)[\])}][0-9]"),
            "phone": text.rlike(r"[0-9]{3}[).\x20-]{1,2}[0-9]{3}[.\x20-][0-9]{4}|00[1-9]"),
        }[kind]
    return F.when(worth, F.transform(found, judged)).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans of every row; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.concat(*[_candidates(F.col("text"), k, True) for k in KINDS]).alias("strict"), F.concat(*[_candidates(F.col("text"), k, False) for k in LOOSE]).alias("loose")
    )
    # A looser form of what is a base span already tells nothing new.
    free = F.filter("loose", lambda s: ~F.exists("strict", lambda b: b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", F.concat("strict", free).alias("spans"))


def reliabilities(votes: list[dict], rounds: int = 30) -> list[float]:
    """Probability that each vote pattern marks a true span, by expectation-maximisation for each kind.

    Labelers err independently given the truth; a labeler's chance of each vote under true and false
    spans is estimated in turn with the truth's.  The start is the share of votes for.
    votes: a row a distinct pattern (kind, the labelers' votes, n).
    """
    truth = []
    for v in votes:
        cast = [v[x] for x in _LABELERS]
        truth.append((1 + sum(c == 1 for c in cast)) / (2 + sum(c != 0 for c in cast)))
    for k in range(len(KINDS)):
        mine = [i for i, v in enumerate(votes) if v["kind"] == k]
        for _ in range(rounds if mine else 0):
            total = [1.0, 1.0]
            chance = {(x, c, y): 0.5 for x in _LABELERS for c in (-1, 0, 1) for y in (0, 1)}
            for i in mine:
                for y, p in ((1, truth[i]), (0, 1 - truth[i])):
                    total[y] += p * votes[i]["n"]
                    for x in _LABELERS:
                        chance[x, votes[i][x], y] += p * votes[i]["n"]
            for i in mine:
                score = [math.log(t / sum(total)) for t in total]
                for y in (0, 1):
                    for x in _LABELERS:
                        score[y] += math.log(chance[x, votes[i][x], y] / sum(chance[x, c, y] for c in (-1, 0, 1)))
                truth[i] = 1 / (1 + math.exp(min(50.0, max(-50.0, score[0] - score[1]))))
    return truth


def _features(v: dict) -> list[tuple]:
    """A pattern's features: its kind, its length by kind, each labeler's vote by kind and over all kinds."""
    k = v["kind"]
    return [("kind", k, 0), ("size", k, v["size"]), *[(x, k, v[x]) for x in _LABELERS], *[(x, -1, v[x]) for x in _LABELERS]]


def fit_classifier(votes: list[dict], truth: list[float], rounds: int = 500, rate: float = 0.5) -> dict[tuple, float]:
    """A logistic span classifier fitted to the patterns' probabilities: weights by feature.

    Each kind weighs the same, and within a kind a pattern as the root of its count, so that rare forms are fitted too.
    """
    size = {k: sum(math.sqrt(v["n"]) for v in votes if v["kind"] == k) for k in range(len(KINDS))}
    share = [math.sqrt(v["n"]) / size[v["kind"]] for v in votes]
    features = [_features(v) for v in votes]
    w: dict[tuple, float] = {f: 0.0 for x in features for f in x}
    for _ in range(rounds):
        slope = {f: -0.0005 * w[f] for f in w}
        for x, p, s in zip(features, truth, share, strict=True):
            gap = (p - 1 / (1 + math.exp(-sum(w[f] for f in x)))) * s
            for f in x:
                slope[f] += gap
        for f in w:
            w[f] += rate * slope[f]
    return w


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base): the personal data of every row.

    Candidates are the matches of strict patterns (base spans, if they pass their kind's
    check) and of looser ones.  Five labelers vote on each: the strict form, the check (card
    checksum, numbers up to 255, count of digits), gazetteers (top-level domains, card and calling
    codes, address ranges), the words before, and the signs around.  Vote patterns are counted over all
    rows (a bounded table: votes, kinds and six lengths); expectation-maximisation estimates how far each
    labeler is right, and a classifier of the span is fitted to what it gives.

    Base spans stay; a further candidate is added where the classifier finds it likelier
    than not and no base span overlaps it.  Places are code points, end exclusive.  A null
    text is empty; repeated rows get equal spans; without any candidate nothing is fitted.
    """
    held = stored(candidates(docs))
    columns = ["kind", "size", *_LABELERS]
    votes = [r.asDict() for r in held.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{c}").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("n")).collect()]
    votes.sort(key=lambda v: [v[c] for c in columns])
    weights = fit_classifier(votes, reliabilities(votes)) if votes else {}
    likely = sorted(tuple(v[c] for c in columns) for v in votes if sum(weights[f] for f in _features(v)) > 0)
    code = lambda s: F.concat_ws("/", *[s[c].cast("string") for c in columns])
    chosen = F.array(*[F.lit("/".join(map(str, x))) for x in likely]).cast("array<string>")

    def kept(spans: Column) -> Column:
        base = F.filter(spans, lambda s: s["base"])
        free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        added = F.filter(spans, lambda s: ~s["base"] & F.array_contains(chosen, code(s)) & free(s))
        return F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))

    return held.select("doc_id", F.when(F.size("spans") > 0, kept(F.col("spans"))).otherwise(F.array().cast("array<struct<start: bigint, kind: int, end: bigint, base: boolean>>")).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
