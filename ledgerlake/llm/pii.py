r"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

DataFrame functions only; what comes to the driver are counts of vote patterns, a few thousand rows at most.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_free_of, let, read_table, running, written

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive parts and the look-behinds keep each search linear in the text; they match at the same
# places as the plain patterns, since a run of such characters can only begin a match at its start or after a match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be of a kind; the classifier decides on these: addresses that are spelt out, addresses with bracketed
#: dots or of version 6, numbers that fail Luhn's check, numbers without a country's prefix.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(]\x20?(?:dot|DOT)\x20?[\])])\x20?[A-Za-z0-9-]{2,63}+){1,5}+|\x20(?:at|AT)\x20[A-Za-z0-9-]{1,63}+(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]{2,63}+){1,5}+)",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:(?:\.|\x20?[\[(](?:\.|dot|DOT)[\])]\x20?)[0-9]{1,3}){3}(?![0-9A-Za-z])|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:]))",
    "card": BASE["card"],
    "phone": r"(?<![0-9A-Za-z+.-])(?:(?:\([0-9]{2,5}\)|0[0-9]{1,4}|[0-9]{3})[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9A-Za-z-])",
}


def _may_have(kind: str, base: bool, text: Column) -> Column:
    """Whether a text has the characters that every match of a kind has; other texts are not searched."""
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])
    if base and kind in ("email", "ip", "phone"):
        return has({"email": "@", "ip": ".", "phone": "+"}[kind])
    if kind == "email":
        return has("at)", "at]", "AT)", "AT]", "at )", "at ]", "AT )", "AT ]", " dot ", " DOT ")
    if kind == "ip":
        return has("[", "(", "::") | text.rlike("(?:[0-9A-Fa-f]{1,4}:){7}")
    return text.rlike("[0-9]")


#: Words that stand before personal data, by kind. find_pii adds those that the corpus itself shows.
GAZETTEER = {
    "email": "mail email e-mail mailto mailbox inbox contact contacts write reach reply respond correo contacto escribir kontakt kontaktieren schreiben courriel courrier contactez adresse address cc bcc newsletter support helpdesk sender recipient absender empfänger remitente destinatario expéditeur destinataire".split(),
    "ip": "ip ipv4 ipv6 server host hostname address addr client gateway router dns ping ssh subnet node peer proxy firewall endpoint login logged connection from servidor dirección cliente serveur adresse hôte passerelle rechner knoten verbindung source destination remote listen bind".split(),
    "card": "card cards visa mastercard amex discover maestro credit debit payment pay paid charge charged billing pan cvv cvc expiry tarjeta crédito débito pago pagar karte kreditkarte zahlung bezahlt carte bancaire crédit paiement payer kartennummer".split(),
    "phone": "tel telephone phone phones call calls dial mobile cell cellphone fax hotline sms text whatsapp telefon telefonnummer handy anrufen rufnummer telefono teléfono móvil llamar llame téléphone portable appeler appelez fon number nummer número numéro".split(),
}
LABELERS = ("pattern", "valid", "gazetteer", "context", "shape")
_CONTEXT = 32
#: So many words before a span are its context.
_NEAR = 3
#: A word joins a kind's gazetteer where it stands before LEARN_ROWS of its sure spans at least, and makes up LEARN_TIMES
#: the share there that it has before the other kinds' candidates; at most LEARN_WORDS, the commonest, for each kind.
LEARN_ROWS, LEARN_TIMES, LEARN_WORDS = 20, 8, 200
_SPAN = "struct<start:int,end:int,match:string,before:string>"
EM_ROUNDS, FIT_ROUNDS = 40, 400


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether the digits of a text pass Luhn's check."""
    digits = F.reverse(F.filter(F.split(_digits(text), ""), lambda d: d != ""))

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern passes what the kind asks for besides."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return match.rlike(rf"\A{part}\.{part}\.{part}\.{part}\z")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<m, p>>: each match and what stands before it, and last what is left, with m null."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))


def _spans(pairs: Column) -> Column:
    """array<struct<start, end, match, before>> of _matches, in code points: what stands between gives the places."""

    def placed(x: Column) -> Column:
        start = x["at"] + F.length(x["x"]["p"])
        return F.struct(start.alias("start"), (start + F.length(x["x"]["m"])).alias("end"), x["x"]["m"].alias("match"), F.right(x["x"]["p"], F.lit(_CONTEXT)).alias("before"))

    sizes = F.transform(pairs, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
    return F.filter(F.transform(F.arrays_zip(pairs.alias("x"), running(sizes, lambda a, b: a + b).alias("at")), placed), lambda s: s["match"].isNotNull())


def _masked(kind: str, pairs: Column) -> Column:
    """The text of _matches with those that hold replaced by as many control characters, which no pattern takes."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["p"], F.when(x["m"].isNull(), "").when(_holds(kind, x["m"]), F.repeat(F.lit("\x01"), F.length(x["m"]))).otherwise(x["m"]))), "")


def _votes(kind: str, base: bool, s: Column) -> list[Column]:
    """1 for, -1 against, 0 without an opinion; in the order of LABELERS, of which the gazetteer votes later."""
    one, none, against = F.lit(1), F.lit(0), F.lit(-1)
    match, before, digits = s["match"], s["before"], _digits(s["match"])
    dotted = F.regexp_replace(match, "[^0-9]+", ".")
    valid = {
        "email": match.rlike(r"(?i)(?:\.|dot\s?[\])]?\s?)[a-z]{2,12}\z"),
        "ip": F.contains(match, F.lit(":")) | (_holds("ip", dotted) & dotted.rlike(r"\A[1-9]")),
        "card": _luhn(match),
        "phone": F.length(digits).between(9, 15),
    }[kind]
    shape = {
        "email": F.when(F.length(match) <= 64, one).otherwise(against),
        "ip": F.when(match.rlike(r"\A(?:0|127)\.|\A::1\z"), against).when(match.rlike(r"[\[(:]"), one).otherwise(none),
        "card": F.when(match.rlike(r"\A[3-6][0-9]{3}(?:[\x20-]?[0-9]{4}){3}\z"), one).when(digits.rlike(r"\A(.)\1+\z"), against).otherwise(none),
        "phone": F.when(match.startswith("+"), one).when(match.rlike(r"[()/]"), one).otherwise(none),
    }[kind]
    return [
        one if base else none,
        F.when(valid, one).otherwise(against),
        none,
        F.when(before.rlike(r"""(?i)(?:[=#$%&"/_]|\b(?:token|id|sha|hash|version|ver|v|release|build|isbn|issn|order|invoice|sku|serial|section))\s?[:#.]?\s?\z"""), against).otherwise(none),
        shape,
    ]


def _holding(kind: str):
    return lambda s: _holds(kind, s["match"])


def _labelled(place: int, base: bool):
    def labelled(s: Column) -> Column:
        size = F.least(F.lit(8), F.floor(F.length(s["match"]) / 4)).cast("int")
        votes = F.array(*_votes(KINDS[place], base, s))
        words = F.filter(F.split(F.lower(s["before"]), r"[^\p{L}0-9-]+"), lambda w: w != "")
        near = F.slice(F.reverse(words), 1, _NEAR)
        return F.struct(F.lit(place).alias("kind"), F.lit(base).alias("base"), s["start"].alias("start"), s["end"].alias("end"), size.alias("size"), votes.alias("votes"), near.alias("near"))

    return labelled


_CANDIDATE = "struct<kind:int,base:boolean,start:int,end:int,size:int,votes:array<int>,near:array<string>>"


def _of_kind(place: int, text: Column) -> Column:
    """All candidates of a kind in a text: base spans, then wider ones, which are sought in what base spans leave."""
    kind = KINDS[place]
    base, wider = _labelled(place, True), _labelled(place, False)
    none = F.array().cast(f"array<{_CANDIDATE}>")
    if kind == "card":  # the wider spans are the same matches that fail
        both = lambda found: F.concat(F.transform(F.filter(found, lambda s: _luhn(s["match"])), base), F.transform(F.filter(found, lambda s: ~_luhn(s["match"])), wider))
        return F.when(_may_have(kind, True, text), let(_matches(text, BASE[kind]), lambda pairs: let(_spans(pairs), both))).otherwise(none)
    more = F.when(_may_have(kind, False, text), let(_matches(text, WIDER[kind]), lambda w: F.transform(_spans(w), wider))).otherwise(none)
    left = lambda t: F.when(_may_have(kind, False, t), let(_matches(t, WIDER[kind]), lambda w: F.transform(_spans(w), wider))).otherwise(none)
    found = let(_matches(text, BASE[kind]), lambda pairs: F.concat(F.transform(F.filter(_spans(pairs), _holding(kind)), base), let(_masked(kind, pairs), left)))
    return F.when(_may_have(kind, True, text), found).otherwise(more)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `spans`: all candidates with kind (its place in KINDS), base, start, end, size, votes and near (the
    words before it, nearest first). Base spans are the base pattern's matches that hold; the rest are matches of the
    wider patterns that overlap no base span of their kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.concat(*[_of_kind(place, text) for place in range(len(KINDS))]).cast(f"array<{_CANDIDATE}>")
    return columns_free_of(docs, ["spans"]).select("*", spans.alias("spans"))


def learned_gazetteer(found: DataFrame) -> dict[int, list[str]]:
    """kind -> words of its gazetteer: the given ones, and those that stand before sure spans (base ones that are valid)
    much oftener than before candidates of other kinds. Words are counted over all candidates; what comes to the driver
    are LEARN_WORDS words for each kind at most."""
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.near", (F.col("s.base") & (F.col("s.votes")[1] > 0)).alias("sure"))
    totals = {r[0]: (r[1], r[2]) for r in spans.groupBy("kind").agg(F.count_if("sure"), F.count(F.lit(1))).collect()}
    everything = sum(n for _, n in totals.values())
    counts = spans.select(F.explode(F.array_distinct("near")).alias("word"), "kind", "sure").groupBy("word").pivot("kind", list(range(len(KINDS)))).agg(F.count_if("sure").alias("sure"), F.count(F.lit(1)).alias("n"))
    out = {place: set(GAZETTEER[kind]) for place, kind in enumerate(KINDS)}
    told = []
    for place in out:
        sure, mine = totals.get(place, (0, 0))
        if sure and everything > mine:
            elsewhere = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{k}_n"), F.lit(0)) for k in out if k != place])
            told.append(F.when((F.col(f"{place}_sure") >= LEARN_ROWS) & (F.col(f"{place}_sure") / sure >= LEARN_TIMES * (elsewhere + 1) / (everything - mine + 1)), F.struct(F.lit(place).alias("kind"), F.col(f"{place}_sure").alias("sure"))))
    if told:
        words = counts.select("word", F.explode(F.array_compact(F.array(*told))).alias("t")).select("word", "t.kind", "t.sure")
        best = words.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("sure").desc(), "word"))).where(F.col("rank") <= LEARN_WORDS)
        for r in best.select("kind", "word").collect():
            out[r.kind].add(r.word)
    return {place: sorted(words) for place, words in out.items()}


def _with_gazetteer(words: dict[int, list[str]]):
    """A span with the gazetteer's vote in its place."""
    at = LABELERS.index("gazetteer")
    lists = [F.array(*[F.lit(w) for w in words[k]]) for k in range(len(KINDS))]

    def voted(s: Column) -> Column:
        hit = reduce(lambda acc, k: F.when(s["kind"] == k, F.arrays_overlap(s["near"], lists[k])).otherwise(acc), range(len(KINDS)), F.lit(False))
        votes = F.array(*[F.when(hit, 1).otherwise(0) if i == at else s["votes"][i] for i in range(len(LABELERS))])
        return F.struct(s["kind"].alias("kind"), s["base"].alias("base"), s["start"].alias("start"), s["end"].alias("end"), s["size"].alias("size"), votes.alias("votes"))

    return voted


def estimate_reliabilities(patterns: list[tuple[tuple[int, ...], float]]) -> tuple[list[float], float]:
    """EM over vote patterns with their counts: (probability that each pattern's spans are true, prior). Each
    labeler has a chance of each vote on true and on false spans; a one more in each count keeps chances off 0."""
    soft = [0.9 if sum(v) > 0 else 0.5 if sum(v) == 0 else 0.1 for v, _ in patterns]
    prior = 0.5
    for _ in range(EM_ROUNDS):
        total = sum(n for _, n in patterns)
        true = sum(p * n for p, (_, n) in zip(soft, patterns, strict=True))
        prior = (true + 1) / (total + 2)
        chance = []
        for k in range(len(LABELERS)):
            by = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for p, (votes, n) in zip(soft, patterns, strict=True):
                by[votes[k]][0] += p * n
                by[votes[k]][1] += (1 - p) * n
            chance.append({v: (a / (true + 3), b / (total - true + 3)) for v, (a, b) in by.items()})
        soft = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[k][v][0] / chance[k][v][1]) for k, v in enumerate(votes))
            soft.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return soft, prior


def _inputs(votes: tuple[int, ...], size: int) -> list[float]:
    return [1.0, *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), size / 8]


def fit_classifier(counts: list[tuple[int, tuple[int, ...], int, int]]) -> dict[int, list[float]]:
    """kind -> weights of a logistic span classifier, from (kind, votes, size, rows): EM gives each vote pattern its
    probability, and the classifier learns these from votes and size, weighted by rows. A kind without rows has none."""
    out = {}
    for kind in sorted({c[0] for c in counts}):
        mine = sorted(c for c in counts if c[0] == kind)
        by: dict[tuple[int, ...], float] = {}
        for _, votes, _, n in mine:
            by[votes] = by.get(votes, 0) + n
        patterns = sorted(by.items())
        soft = dict(zip([v for v, _ in patterns], estimate_reliabilities(patterns)[0], strict=True))
        total = sum(by.values())
        rows = [(_inputs(votes, size), soft[votes], n / total) for _, votes, size, n in mine]
        w = [0.0] * len(rows[0][0])
        for _ in range(FIT_ROUNDS):
            g = [0.001 * x for x in w]
            for x, y, n in rows:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
                for i, xi in enumerate(x):
                    g[i] += n * (p - y) * xi
            w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
        out[kind] = w
    return out


def _probability(weights: dict[int, list[float]], s: Column) -> Column:
    def of(w: list[float]) -> Column:
        k = len(LABELERS)
        terms = [F.lit(w[0]), s["size"] * F.lit(w[-1] / 8)]
        for i in range(k):
            terms.append(F.when(s["votes"][i] > 0, F.lit(w[1 + i])).when(s["votes"][i] < 0, F.lit(w[1 + k + i])).otherwise(F.lit(0.0)))
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))

    out = F.lit(0.0)
    for kind, w in weights.items():
        out = F.when(s["kind"] == kind, of(w)).otherwise(out)
    return out


def find_pii(docs: DataFrame, text_col: str = "text", name: str = "pii") -> DataFrame:
    """docs with `spans`: array<struct<kind, start, end, base, p>> ordered by kind, then start; kind is a place in
    KINDS, start and end are code points, p is the classifier's probability.

    Every base span stays, whatever its p; a wider candidate, which overlaps no base span of its kind, stays with
    p >= 0.5. Candidates are found once and written; gazetteers and vote patterns are counted over all of them. Null
    and empty texts have no spans; an earlier column `spans` is replaced; empty tables give no rows. A text's spans
    are gathered in its own row, which is all that grows with a text; time is linear in a text and its matches.
    """
    found = written(candidates(docs, text_col), name)
    voted = found.withColumn("spans", F.transform("spans", _with_gazetteer(learned_gazetteer(found))))
    counts = voted.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.size").count().collect()
    weights = fit_classifier([(r[0], tuple(r[1]), r[2], r[3]) for r in counts])

    def scored(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), _probability(weights, s).alias("p"))

    kept = F.filter(F.transform("spans", scored), lambda s: s["base"] | (s["p"] >= 0.5))
    return voted.withColumn("spans", F.array_sort(kept))


#: Texts are cut into parts of this many code points before pieces of them are taken by place.
_PART = 1024


def redact(docs: DataFrame, text_col: str = "text", name: str = "pii") -> DataFrame:
    """docs, same columns: each span of find_pii, or union of overlapping ones, replaced by the upper-cased kind of
    its first span in brackets. Null texts stay null."""
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    found = find_pii(docs.select(rest.alias("doc"), F.col(text_col).alias("text")), "text", name)
    text = F.col("text")
    stop = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit(len(KINDS)).alias("kind"))
    spans = F.concat(F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), F.array(stop))
    mark = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))

    def between(parts: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _PART).cast("int")
        some = F.slice(parts, first + 1, F.floor((end - 1) / _PART).cast("int") - first + 1)
        return F.when(end > start, F.substring(F.array_join(some, ""), start - first * _PART + 1, end - start)).otherwise(F.lit(""))

    def cleaned(parts: Column, cuts: Column) -> Column:
        """Before each span that begins no earlier than those before it end: what stands between, then the mark."""
        covered = running(F.transform(cuts, lambda c: c["end"]), lambda a, b: F.greatest(a, b))
        pieces = F.transform(F.arrays_zip(cuts.alias("c"), covered.alias("at")), lambda z: F.when(z["c"]["start"] >= z["at"], F.concat(between(parts, z["at"], z["c"]["start"]), mark[z["c"]["kind"]])).otherwise(F.lit("")))
        return F.array_join(pieces, "")

    clean = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)), lambda parts: let(spans, lambda cuts: cleaned(parts, cuts)))
    return found.select(*[F.when(F.size("spans") == 0, text).otherwise(clean).alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _base_of(place: int):
    return lambda s: s["base"] & (s["kind"] == place)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _base_of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
ORACLES = {}
