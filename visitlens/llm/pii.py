"""Personal data by weak supervision, in DataFrame operations only.

Strict patterns give the base spans; looser ones give more candidates. Regular-expression, gazetteer and context
labelers vote on every candidate. Expectation-maximisation estimates how reliable each labeler is from the counts of
vote patterns, and its posteriors train a naive Bayes span classifier over votes, shape and context. Candidates that the
classifier accepts are added; base spans always stay.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import write_table

KINDS = ["email", "ip", "card", "phone"]
# Possessive quantifiers keep long runs linear; what precedes a run is looked at so that it is tried once.
#: The base patterns, by kind.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, whose matches are candidates only.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: Cheap tests that a text must pass before a pattern is tried on it.
GATE = {"email": r"@|(?i)[(\[]at[)\]]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: Fixed values, gazetteers: endings of mail domains, telephone country codes, first digits of card issuers.
DOMAINS = (
    "com org net edu gov mil int info biz name io ai app dev me tv co cloud online site shop blog tech "
    "ad ae al am ar at au az ba bd be bg bo br by ca ch cl cn cr cu cy cz de dk do dz ec ee eg es eu fi fr ge gh gr gt hk hn hr hu id ie il in iq ir is it jo jp "
    "ke kr kw kz lb lk lt lu lv ly ma md mk mt mx my ng ni nl no np nz om pa pe ph pk pl pt py qa ro rs ru sa se sg si sk sn sv sy th tn tr tw tz ua ug uk us uy uz ve vn za zw"
).split()
COUNTRIES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 218 220 221 233 234 237 249 251 254 255 256 260 263 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 380 381 382 385 386 387 389 "
    "420 421 502 503 504 505 506 507 591 593 595 598 852 853 855 856 880 886 960 961 962 963 964 965 966 968 971 972 973 974 976 977 992 994 995 996 998"
).split()
ISSUERS = ["2", "34", "35", "36", "37", "38", "39", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "60", "62", "64", "65", "67"]
#: Words before a span that speak for, and against, personal data of a kind.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|an)\W*\z",
    "ip": r"(?i)\b(?:ip|address|host|from|client|server|adresse)\W*\z",
    "card": r"(?i)\b(?:card|visa|credit|mastercard|carte|karte|tarjeta)\W*\z",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|tel[eé]fono|t[eé]l)\W*\z",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|order|invoice|article|figure|table|chapter|id|no|v)\W*\z"
LABELERS = ["strict", "gazetteer", "context", "boundary", "shape"]
TAIL = 24


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", F.substring(number, 1, 19))


def base_valid(kind: str, match: Column) -> Column:
    """Whether a base match counts."""
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))
    if kind == "card":
        number = digits(match)
        return F.length(number).between(13, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def votes(kind: Column, strict: Column, match: Column, tail: Column) -> dict[str, Column]:
    """A vote for (1), against (-1) or neither (0) by each labeler."""
    number, low = digits(match), F.lower(match)

    def by_kind(make) -> Column:
        return reduce(lambda out, k: F.when(kind == k, make(k)).otherwise(out), KINDS, F.lit(0))

    def gazetteer(k: str) -> Column:
        if k == "email":
            return F.when(F.regexp_extract(low, r"([a-z0-9-]+)\W*\z", 1).isin(DOMAINS), 1).otherwise(-1)
        if k == "ip":
            first = F.regexp_extract(match, r"\A0*([0-9]{1,3})", 1)
            return F.when(first.isin("", "0", "255"), -1).otherwise(1)
        starts = COUNTRIES if k == "phone" else ISSUERS
        known = reduce(lambda a, b: a | b, (F.startswith(number, F.lit(x)) for x in starts))
        return F.when(known, 1).otherwise(-1 if k == "card" else 0)

    def shape(k: str) -> Column:
        if k == "email":
            return F.when(F.length(match) <= 254, 1).otherwise(-1)
        if k == "ip":
            return F.when(F.length(match) <= 21, 1).otherwise(-1)
        if k == "card":
            return F.when(F.length(number).between(13, 19) & luhn(number), 1).otherwise(-1)
        return F.when(F.length(number).between(9, 15) | (F.length(number) == 10), 1).otherwise(-1)

    return {
        "strict": F.when(strict, 1).otherwise(0),
        "gazetteer": by_kind(gazetteer),
        "context": F.when(tail.rlike(AGAINST), -1).otherwise(by_kind(lambda k: F.when(tail.rlike(CUES[k]), 1).otherwise(0))),
        "boundary": F.when(tail.rlike(r"[\p{L}\p{N}]\z"), -1).otherwise(1),
        "shape": by_kind(shape),
    }


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, base, kind, start, end, match, tail) of every match of every pattern, in one scan of the texts.

    A row without matches gives one with a null kind. A text split at a pattern gives the gaps between its matches, so lengths of gaps and matches add up to the spans.
    Only lengths, the matches and the last characters of each gap are shuffled, by row.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")

    def matches(kind: str, base: bool) -> Column:
        pattern = (BASE if base else LOOSE)[kind]
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(TAIL)).alias("tail")))
        both = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
        numbered = F.transform(
            both,
            lambda x, i: F.struct(
                F.lit(base).alias("base"), F.lit(kind).alias("kind"), i.alias("i"), x["g"]["n"].alias("gap"), x["g"]["tail"].alias("tail"), x["m"].alias("match")
            ),
        )
        none = F.array().cast("array<struct<base: boolean, kind: string, i: int, gap: int, tail: string, match: string>>")
        return F.when(text.rlike(GATE[kind]), F.filter(numbered, lambda x: x["match"].isNotNull())).otherwise(none)

    found = rows.select("rid", "doc_id", F.explode_outer(F.concat(*(matches(k, b) for b in (True, False) for k in KINDS))).alias("x")).select("rid", "doc_id", "x.*")
    before = Window.partitionBy("rid", "base", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(before).cast("long")
    return found.withColumn("end", end).select("rid", "doc_id", "base", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "tail")


def reliabilities(patterns: DataFrame, *, rounds: int = 10) -> dict[str, float]:
    """Expectation-maximisation over the counts of vote patterns (kind, one column per labeler, n).

    There are at most 3 ** 5 patterns of each kind, in one partition; each round is one aggregate of that table and
    gives at most 60 rows of sums. Returns log odds by kind, and by kind, labeler and vote.
    """
    odds = {k: math.log(0.7 / 0.3) for k in KINDS}
    odds |= {f"{k}:{j}{v}": math.log({-1: 0.2 / 0.6, 0: 1, 1: 0.6 / 0.2}[v]) for k in KINDS for j in LABELERS for v in (-1, 0, 1)}
    cast = F.explode(F.array(*(F.concat(F.lit(j), F.col(j).cast("string")) for j in LABELERS)))
    for _ in range(rounds):
        weighed = patterns.select("kind", (F.col("n") * posterior(odds)).alias("t"), "n", cast.alias("vote"))
        rows = weighed.groupBy("kind", "vote").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
        for k in KINDS:
            sums = {r["vote"]: (r["t"], r["n"] - r["t"]) for r in rows if r["kind"] == k}
            first = [x for v, x in sums.items() if v.startswith(LABELERS[0])]
            t, f = sum(x[0] for x in first), sum(x[1] for x in first)
            share = min(0.99, max(0.01, (t + 1) / (t + f + 2)))
            odds[k] = math.log(share / (1 - share))
            for j in LABELERS:
                for v in (-1, 0, 1):
                    a, b = sums.get(f"{j}{v}", (0.0, 0.0))
                    odds[f"{k}:{j}{v}"] = math.log((a + 0.5) / (t + 1.5)) - math.log((b + 0.5) / (f + 1.5))
    return odds


def posterior(odds: dict[str, float]) -> Column:
    """The probability that a candidate is personal data, given its votes."""
    held = F.create_map(*(F.lit(x) for item in odds.items() for x in item))
    keys = [F.col("kind")] + [F.concat(F.col("kind"), F.lit(f":{j}"), F.col(j).cast("string")) for j in LABELERS]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, (held[k] for k in keys))))


def span_features() -> Column:
    """Features of a candidate for the classifier, as strings of a bounded number of values."""
    shape = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace("match", "[0-9]+", "9"), "[A-Za-z]+", "a"), r"[^9a]+", "."), 1, 8)
    word = F.regexp_extract(F.lower("tail"), r"([\p{L}]+)\P{L}*\z", 1)
    made = [F.concat(F.lit(j), F.col(j).cast("string")) for j in LABELERS]
    made += [F.concat(F.lit("shape"), F.pmod(F.hash(shape), F.lit(64)).cast("string"))]
    made += [F.concat(F.lit("word"), F.pmod(F.hash(word), F.lit(64)).cast("string"))]
    return F.transform(F.array(*made), lambda x: F.concat(F.col("kind"), F.lit(":"), x))


def find_pii(docs: DataFrame, *, accept: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's personal data: doc_id, base and added (arrays of kind index, start, end; code points, end exclusive).

    Base spans are the leftmost non-overlapping matches of the base patterns that pass their tests. An added span is a
    loose match with a probability of ``accept`` or more that overlaps no base span, and no added span of an earlier
    kind. A null text is empty. Rows are numbered in the one scan, whose result is written.
    """
    found = candidates(docs, id_col=id_col, text_col=text_col)
    valid = reduce(lambda out, k: F.when(F.col("kind") == k, base_valid(k, F.col("match"))).otherwise(out), KINDS, F.lit(False))
    found = found.withColumn("strict", F.col("base") & F.coalesce(valid, F.lit(False)))
    cast = votes(F.col("kind"), F.col("strict"), F.col("match"), F.col("tail"))
    voted = found.select("rid", "doc_id", "base", "kind", "start", "end", "match", "tail", F.col("strict").alias("sure"), *(v.cast("int").alias(j) for j, v in cast.items()))
    everything = write_table(voted, "pii-votes")
    voted = everything.where("kind is not null")
    patterns = write_table(voted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")), "pii-patterns").coalesce(1)
    p = posterior(reliabilities(patterns))
    trained = (
        voted.select("kind", p.alias("p"), F.explode(span_features()).alias("feature"))
        .groupBy("feature")
        .agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f"))
    )
    by_kind = voted.groupBy("kind").agg(F.sum(p).alias("t"), F.sum(1 - p).alias("f")).collect()  # four rows at most
    totals = {r["kind"]: (r["t"], r["f"]) for r in by_kind}
    total = lambda at: reduce(lambda out, k: F.when(F.startswith("feature", F.lit(k + ":")), totals[k][at]).otherwise(out), totals, F.lit(0.0))
    weights = write_table(
        trained.select("feature", F.log(((F.col("t") + 0.5) / (total(0) + 1)) / ((F.col("f") + 0.5) / (total(1) + 1))).alias("weight")), "pii-weights"
    )
    prior = reduce(lambda out, k: F.when(F.col("kind") == k, float((totals[k][0] + 0.5) / (totals[k][1] + 0.5))).otherwise(out), totals, F.lit(1.0))
    loose = voted.where("not base").select("rid", "kind", "start", "end", F.log(prior).alias("prior"), F.explode(span_features()).alias("feature"))
    added = (
        loose.join(F.broadcast(weights), "feature", "left")  # 4 * (15 + 128) rows at most
        .groupBy("rid", "kind", "start", "end", "prior")
        .agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
        .where(1 / (1 + F.exp(-(F.col("prior") + F.col("weight")))) >= accept)
        .select("rid", F.lit(False).alias("base"), "kind", "start", "end")
    )
    index = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    sure = everything.select("rid", "doc_id", F.when(F.col("sure"), F.struct("base", index.alias("kind"), "start", "end")).alias("x"))
    more = added.select("rid", F.lit(None).cast(everything.schema["doc_id"].dataType).alias("doc_id"), F.struct("base", index.alias("kind"), "start", "end").alias("x"))
    spans = (
        sure.unionByName(more)
        .groupBy("rid")
        .agg(F.max("doc_id").alias("doc_id"), F.collect_list("x").alias("all"))
        .select(
            "doc_id",
            F.array_sort(F.transform(F.filter("all", lambda x: x["base"]), _span)).alias("base"),
            F.array_sort(F.transform(F.filter("all", lambda x: ~x["base"]), _span)).alias("more"),
        )
    )
    def apart(x: Column) -> Column:
        over = lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])
        return ~F.exists("base", over) & ~F.exists("more", lambda y: over(y) & (y["kind"] < x["kind"]))

    return spans.select("doc_id", "base", F.filter("more", apart).alias("added"))


def _span(x: Column) -> Column:
    return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas, in the order of the array."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
