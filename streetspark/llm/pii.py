"""Personal data by weak supervision (native).

Base spans come from fixed patterns and checks. Everything else that
looks like one of the kinds (also addresses written out, IPv6, national phone numbers) or like a secret is a candidate, on which five labelers vote 1, -1 or 0
(abstain): a shape regex, a gazetteer of prefixes or endings, the words around it, a
check of its content, and the separators. Base spans are candidates too. Per kind, expectation-maximisation over the counts
of vote patterns (at most 3^5) estimates how reliable each labeler is; its posteriors train
the final span classifier, a naive Bayes model over votes, length and the
sign before the span. The spans it accepts that do not overlap a base
span of any kind are added, cards only if they pass Luhn; base spans stay. Of added spans that overlap the first kind as listed wins.
Names and street addresses have no labelers: the four languages would need dictionaries that are not at hand.

All texts are read whole, in one pass; candidates are stored, their patterns
counted with map-side combining, and the accepted patterns joined back.

Nulls: a null text is empty; a null doc_id stays null. Repeated rows each
get their own result; empty table: empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, text_of

#: The kinds with base patterns.
KINDS = ["email", "ip", "card", "phone"]
#: All kinds, in the order of spans.
EVERY = [*KINDS, "secret"]
MARK = "\x01"
#: The base patterns; look-behinds and possessive repeats find the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, for candidates.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9A-Za-z])(?:(?:[0-9]{4}[\x20-]){3}[0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[1-9](?:[\x20.-][0-9]{2}){4}|0[1-9][0-9]{1,4}[\x20/-][0-9]{4,9}|[6789][0-9]{2}(?:[\x20.-][0-9]{3}){2})(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,200}+={0,2}(?![A-Za-z0-9+/_=-])",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel|escriba)\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|servidor|serveur)\W*$",
    "card": r"(?i)(?:card|visa|credit|karte|tarjeta|carte)\W*$",
    "phone": r"(?i)(?:phone|call|tel|mobile|telefon|llame)\W*$",
    "secret": r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|bearer|auth|credential)\W*$",
}
AGAINST = r"(?i)(?:token|key|hash|isbn|order|invoice|id|no|nr|version)\W*$"
#: Gazetteers: (beginnings or endings that speak for a kind, against it).
GAZETTEER = {
    "email": (r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$", r"(?i)(?:png|jpg|gif|js|css)$"),
    "ip": (r"(?i)^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|20[0-9a-f]{2}:|fe80:|fd)", r"^(?:0\.|127\.|1\.0\.|255\.)"),
    "card": (r"^(4|5[1-5]|2[2-7]|3[47]|6(011|5))", r"^(0|7|9|1)"),
    "phone": (r"(555|800|888)[0-9]{4}$", r"^(0000|1234|9999)"),
    "secret": (r"^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk-|sk_|pk_|rk_|xox[abp]-|eyJ)", r"^[A-Za-z]+$"),
}


LABELERS = 5
ROUNDS = 25


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, before): the pattern's matches in code points, the end exclusive, and 24 characters before.

    Matches are enclosed in marks and the text is cut there; a mark of the text itself has been replaced by another control character.
    """
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)

    def spans(p: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")

        def step(acc: Column, x: Column) -> Column:
            n = acc["at"] + F.length(x["p"])
            here = F.struct(acc["at"].alias("start"), n.alias("end"), x["p"].alias("match"), F.right(x["b"], F.lit(24)).alias("before"))
            return F.struct(n.alias("at"), F.when(x["i"] % 2 == 1, F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"))

        numbered = F.transform(p, lambda x, i: F.struct(x.alias("p"), i.alias("i"), F.coalesce(F.get(p, i - 1), F.lit("")).alias("b")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.when(F.size(p) > 1, F.aggregate(numbered, start, step, lambda a: a["out"])).otherwise(none)

    return let(parts, spans)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def doubled(v: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    return F.aggregate(F.transform(values, doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        small = lambda x: (F.length(part(x)) <= 3) & (F.lpad(part(x), 3, "0") <= "255")
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return luhn(digits_of(match))
    if kind == "phone":
        return F.length(digits_of(match)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(found(text, PATTERNS[kind]), lambda x: passes(kind, x["match"]))


def votes(kind: str, x: Column) -> Column:
    """Five votes on a candidate: shape, gazetteer, context, content, separators."""
    d, m = digits_of(x["match"]), x["match"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    cue = F.when(x["before"].rlike(CUES[kind]), 1).when(x["before"].rlike(AGAINST if kind != "secret" else r"(?i)(?:sha|md5|commit|digest|hash|checksum)\W*$"), -1).otherwise(0)
    listed = vote((d if kind in ("card", "phone") else m).rlike(GAZETTEER[kind][0]), (d if kind in ("card", "phone") else m).rlike(GAZETTEER[kind][1]))
    if kind == "email":
        shape = vote(m.rlike(PATTERNS["email"]) | m.rlike(r"(?i)[(\[]at[)\]]"), m.rlike(r"\.\.|^[.-]"))
        return F.array(shape, listed, cue, vote(F.length(m).between(6, 80), F.length(m) > 160), vote(m.rlike(r"\.[A-Za-z]{2,10}$"), m.rlike("[0-9]$")))
    if kind == "ip":
        four = m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
        shape, content = vote(four | m.contains(":"), F.length(d) < 5), vote(m.contains(":") | passes("ip", m), m.rlike(r"^[0-9.]+$"))
        return F.array(shape, listed, cue, content, vote(~m.rlike(r"(^|\.)0[0-9]"), m.rlike(r"(^|\.)0[0-9]")))
    if kind == "card":
        even = vote(m.rlike(r"^[0-9]+$") | m.rlike(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"), m.rlike(r"[ -][0-9]{1,2}[ -]"))
        return F.array(vote(F.length(d) == 16, ~F.length(d).isin(13, 14, 15, 16, 19)), listed, cue, F.when(luhn(d), 1).otherwise(-1), even)
    if kind == "phone":
        shape = vote(m.rlike(r"^(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$") | m.rlike(r"^(\+[0-9]{1,3} ?|0)[1-9]"), F.length(d) > 13)
        return F.array(shape, listed, cue, vote(F.length(d).between(9, 12), ~F.length(d).between(8, 15)), vote(m.rlike(r"[()+]"), m.rlike(r"^[0-9]{4}-[0-9]{2}-")))
    hexes = m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$")
    mixed = m.rlike("[0-9].*[0-9].*[0-9]") & m.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")
    return F.array(vote(hexes | m.rlike(GAZETTEER["secret"][0]), ~mixed), listed, cue, vote(mixed, ~mixed), vote(x["before"].rlike(r"[=:]\s*[\"']?$"), m.rlike("[/-][A-Za-z]{2,}[/-]")))


def candidates(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, votes, size, sign, base)."""

    def row(x: Column, base: bool) -> Column:
        n = F.length(digits_of(x["match"])) if kind in ("card", "phone") else F.ceil(F.length(x["match"]) / 4).cast("int")
        return F.struct(
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            votes(kind, x).alias("votes"),
            F.least(n, F.lit(20)).alias("size"),
            F.when(x["before"].rlike(r"[=\"':#$]\s*$"), 1).otherwise(0).alias("sign"),
            F.lit(base).alias("base"),
        )

    wide = F.transform(found(text, WIDER[kind]), lambda x: row(x, False))
    return F.concat(F.transform(base_spans(text, kind), lambda x: row(x, True)), wide) if kind in KINDS else wide


def reliabilities(patterns: DataFrame) -> DataFrame:
    """Per kind the vote patterns with the posterior ``p``, after expectation-maximisation.

    ``patterns``: kind, votes, n. A kind has at most 3^5 patterns, so its array is bounded.
    """

    def posterior(prior: Column, acc: Column, v: Column) -> Column:
        def side(true: bool) -> Column:
            def factor(j: Column) -> Column:
                a = F.get(acc, j) if true else 1.0 - F.get(acc, j)
                return F.when(F.get(v, j) == 1, a).when(F.get(v, j) == -1, 1.0 - a).otherwise(F.lit(1.0))

            start = prior if true else 1.0 - prior
            return F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), start, lambda s, j: s * factor(j))

        return let(F.array(side(True), side(False)), lambda s: F.get(s, F.lit(0)) / (F.get(s, F.lit(0)) + F.get(s, F.lit(1))))

    def expect(rows: Column, state: Column) -> Column:
        return F.transform(
            rows, lambda r: F.struct(r["n"].alias("n"), r["votes"].alias("votes"), posterior(state["prior"], state["acc"], r["votes"]).alias("p"))
        )

    def clamp(x: Column, low: float, high: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), x))

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, r: s + value(r))

    def maximise(e: Column) -> Column:
        def accuracy(j: Column) -> Column:
            right = lambda r: r["n"] * F.when(F.get(r["votes"], j) == 1, r["p"]).when(F.get(r["votes"], j) == -1, 1.0 - r["p"]).otherwise(F.lit(0.0))
            cast = lambda r: F.when(F.get(r["votes"], j) != 0, r["n"].cast("double")).otherwise(F.lit(0.0))
            return clamp((total(e, right) + 1.4) / (total(e, cast) + 2.0), 0.55, 0.99)

        prior = clamp(total(e, lambda r: r["n"] * r["p"]) / total(e, lambda r: r["n"].cast("double")), 0.02, 0.98)
        return F.struct(prior.alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(LABELERS - 1)), accuracy).alias("acc"))

    grouped = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("rows"))
    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.7), LABELERS).alias("acc"))
    rows = F.col("rows")
    state = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: maximise(expect(rows, s)))
    after = grouped.select("kind", "rows", state.alias("state"))
    after = after.select("kind", F.explode(expect(F.col("rows"), F.col("state"))).alias("e"))
    return after.select("kind", "e.votes", "e.n", "e.p")


def classifier(cands: DataFrame, posteriors: DataFrame) -> DataFrame:
    """Accepted (kind, votes, size, sign): naive Bayes over the votes, the size and the sign, with posteriors as soft labels."""
    seen = cands.groupBy("kind", "votes", "size", "sign").agg(F.count(F.lit(1)).alias("n"))
    soft = seen.join(posteriors.select("kind", "votes", "p"), ["kind", "votes"])
    named = [F.struct(F.lit(f"v{j}").alias("name"), F.get("votes", F.lit(j)).alias("value")) for j in range(LABELERS)]
    named += [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("size", "sign")]
    long = soft.select("kind", "votes", "size", "sign", (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"), F.explode(F.array(*named)).alias("f"))
    weight = long.groupBy("kind", F.col("f.name").alias("name"), F.col("f.value").alias("value")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    prior = soft.groupBy("kind").agg(F.sum(F.col("n") * F.col("p")).alias("all_yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("all_no"))
    weight = weight.join(prior, "kind").select("kind", "name", "value", F.ln((F.col("yes") + 1) / (F.col("all_yes") + 3) * (F.col("all_no") + 3) / (F.col("no") + 1)).alias("w"))
    keys = long.select("kind", "votes", "size", "sign", F.col("f.name").alias("name"), F.col("f.value").alias("value"))
    total = keys.join(weight, ["kind", "name", "value"]).groupBy("kind", "votes", "size", "sign").agg(F.round(F.sum("w"), 6).alias("w"))
    total = total.join(prior, "kind").select("kind", "votes", "size", "sign", (F.col("w") + F.ln((F.col("all_yes") + 1) / (F.col("all_no") + 1))).alias("score"))
    return total.where("score > 0")


def join_spans(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base (the base spans) and spans (all), arrays of (kind, start, end) in order."""
    safe = F.translate(text_of(docs["text"]), MARK, "\x02")
    kinds = [_named(base_spans(F.col("text"), k), k) for k in KINDS]
    wide = F.concat(*[candidates(F.col("text"), k) for k in EVERY])
    x = docs.select(docs["doc_id"].alias("doc_id"), F.when(safe.rlike(r"[0-9@]|[(\[]at[)\]]"), safe).otherwise("").alias("text"))
    x = x.select("doc_id", F.concat(*kinds).alias("base"), wide.alias("cands"))
    x = stored(x, "pii")
    cands = x.select(F.explode("cands").alias("c")).select("c.*")
    patterns = cands.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    accepted = stored(classifier(cands, reliabilities(patterns)), "pii-accepted")
    # a row a kind, with at most 3^5 votes times 20 sizes times 2 signs: bounded, so it is broadcast
    by_kind = accepted.agg(F.collect_set(F.struct("kind", "votes", "size", "sign")).alias("accepted"))
    y = x.join(F.broadcast(by_kind), F.lit(True), "left")

    def free(c: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    known = lambda c: F.array_contains("accepted", F.struct(c["kind"], c["votes"], c["size"], c["sign"]))
    true = lambda c: (c["kind"] != "card") | (F.get(c["votes"], F.lit(3)) == 1)
    good = F.filter("cands", lambda c: ~c["base"] & known(c) & true(c) & free(c))
    plain = F.transform(good, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    def apart(spans: Column) -> Column:
        """Without those that overlap an earlier one of the array, which is in the order of kinds."""
        taken = lambda kept, c: F.exists(kept, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.aggregate(spans, F.slice(spans, 1, 0), lambda kept, c: F.when(taken(kept, c), kept).otherwise(F.array_append(kept, c)))

    y = y.select("doc_id", "base", F.when(F.size("cands") > 0, let(plain, apart)).otherwise(F.slice("base", 1, 0)).alias("more"))

    def ordered(spans: Column) -> Column:
        number = lambda s: F.array_position(F.array(*map(F.lit, EVERY)), s["kind"])
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(number(s).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return y.select("doc_id", "base", F.when(F.size("more") > 0, ordered(F.concat("base", "more"))).otherwise(F.col("base")).alias("spans"))


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    x = find(table(spark, sf_dir, "documents"))
    return x.select("doc_id", *map(_count, KINDS), F.sha2(join_spans(F.col("base")), 256).alias("base_sha256"), join_spans(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda x: x["kind"] == "secret")).cast("long").alias("n_secret"))
