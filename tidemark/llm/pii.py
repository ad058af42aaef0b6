"""Personal data: pattern spans, and terms that give a protected value away.

Base spans of four kinds (email, ip, card, phone) come from patterns, leftmost and without overlap per kind.
Their values are protected entities, and so are families of them (a mail domain, the first three numbers of an ip, the issuer
of a card, a phone number without its last four digits): most values stand in one text only, which
cannot tell its terms apart. Information theory then adds terms: with the number of different texts that hold an
entity e, a term t, and both, PMI(e; t) = log(N * n(e, t) / (n(e) * n(t))) measures how much
the term tells of the entity, and IC(e) = -log(n(e) / N) is all there is to tell. A term that discloses an entity
(PMI >= `threshold` * IC, seen together in `support` different texts or more: exact copies of a text tell nothing new and
count once) is, wherever it stands in a document of that entity, a span of kind `term`, and is generalised to a placeholder when the text is sanitised. All counts are of whole texts.

A secret gives itself away: a run of letters and digits of which no other text could tell anything. Its information is
estimated from its own characters, length times the entropy of their shares; a run of SECRET letters and digits or more, both
among them, with SECRET_BITS or more, that stands in at most `copies` different texts (so that the corpus does not foretell it) is a span of
kind `secret`.

DataFrame and SQL functions only. Positions come from cutting the text at the matches and adding up lengths, PART
matches at a time, so the cost grows with the text and not with its square.
Document counts of terms are aggregations over all texts; entities and terms meet per document they share, in the
documents with entities only, so no step pairs the documents of an entity with each other.

Cases: a null or empty text has no spans; spans count code points, end exclusive; the same text twice gives the
same spans twice and counts once; rows with a null id are documents too; an empty table gives an
empty table; other columns pass unread. A term or secret that stands in a base span is left as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table, with_and_without
from tidemark.llm.graph import salted_join

# Possessive forms of the stated patterns. A run of pattern characters is entered at its first character (or where
# the last match ended): any later start inside it would fail or succeed just the same, so only work is saved.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A term is a whole word: letters with their marks, and digits.
TERM = r"[\p{L}\p{M}\p{N}]++"
#: Characters, and bits of information, that make a secret.
SECRET, SECRET_BITS = 16, 50
SECRET_RUN = rf"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{{{SECRET},}}+"
#: Array elements that are added up one by one; longer arrays are cut to parts.
PART = 64
PLACES = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def in_parts(items: Column) -> Column:
    """array<array>: the items in order, PART to each."""

    def cut_up(a: Column) -> Column:
        n = F.ceil(F.size(a) / PART).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.slice(a, i * PART + 1, F.lit(PART)))

    return let(items, cut_up)


def spans_of(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<start, end, value>> of the matches; `possible` is a cheap test that spares most texts the search."""
    none = F.array().cast(PLACES)
    measured = lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), F.length(m).alias("own"))
    zipped = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), measured))

    def placed(part: Column, base: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["gap"]
            end = at + x["own"]
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

        return F.aggregate(part, F.struct(base.alias("at"), none.alias("out")), step)["out"]

    def all_parts(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["own"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(sums, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, bases, placed))

    return F.when(possible, let(in_parts(zipped), all_parts)).otherwise(none)


def information(value: Column) -> Column:
    """Bits in a run of characters: its length times the entropy of their shares."""
    n = F.length(value).cast("double")

    def entropy(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - let(share(c), lambda p: p * F.log2(p)))

    return n * let(F.filter(F.split(value, ""), lambda c: c != ""), entropy)


def secret_spans(text: Column) -> Column:
    """array<struct<start, end, value>> of the runs that hold enough information to be secrets."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(spans_of(text, SECRET_RUN, text.rlike(SECRET_RUN)), lambda s: information(s["value"]) >= SECRET_BITS)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass Luhn: from the right, every second one doubled (less 9 above 9), the sum a multiple of ten."""
    d = F.filter(F.split(F.reverse(digits(value)), ""), lambda c: c != "")
    worth = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of all base spans, kinds in order, then by start."""
    text = F.coalesce(text, F.lit(""))
    number = lambda v: F.length(digits(v))
    by_kind = {
        "email": spans_of(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans_of(text, IP, F.contains(text, F.lit("."))), lambda s: s["value"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")),
        "card": F.filter(spans_of(text, CARD, text.rlike("[0-9][ -]?[0-9]")), lambda s: F.when((number(s["value"]) >= 13) & (number(s["value"]) <= 19), luhn(s["value"])).otherwise(F.lit(False))),
        "phone": F.filter(spans_of(text, PHONE, F.contains(text, F.lit("+"))), lambda s: (number(s["value"]) >= 9) & (number(s["value"]) <= 15)),
    }
    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    return F.concat(*[F.transform(by_kind[k], named(k)) for k in KINDS])


def entity(span: Column) -> Column:
    """The protected value behind a span: writing does not matter."""
    return F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(digits(span["value"]))


def family(span: Column) -> Column:
    """What a protected value shares with its neighbours: mail domain, three numbers of an ip, issuer of a card, block of a phone number."""
    number = digits(span["value"])
    part = F.when(span["kind"] == "email", F.regexp_extract(F.lower(span["value"]), "@.*", 0)).when(span["kind"] == "ip", F.substring_index(span["value"], ".", 3))
    part = part.when(span["kind"] == "card", F.substring(number, 1, 6)).otherwise(number.substr(F.lit(1), F.length(number) - 4))
    return F.concat(F.lit("all "), span["kind"], F.lit(" "), part)


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return rows.withColumn("base", base_spans(F.col("text"))).withColumn("secrets", secret_spans(F.col("text")))


def outside(spans: Column, base: Column) -> Column:
    """The spans that overlap no base span; for short arrays only, see word_places for the words of a text."""
    return F.filter(spans, lambda t: ~F.exists(base, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))


def rare_secrets(rows: DataFrame, copies: int) -> DataFrame:
    """(h, secrets): per text, array<struct<start, end>> of the secrets that at most `copies` different texts hold.

    rows: (h, base, secrets) of all documents; only the few texts with such runs are looked at.
    """
    held = rows.filter(F.size("secrets") > 0).groupBy("h").agg(F.first("base").alias("base"), F.first("secrets").alias("secrets"))
    each = cut(held.select("h", F.explode(outside(F.col("secrets"), F.col("base"))).alias("s")).select("h", "s.*"))
    texts = each.select("h", "value").distinct().groupBy("value").agg(F.count("*").alias("texts"))
    rare = salted_join(each, texts, ["value"], ["h"]).filter(F.col("texts") <= copies)
    return rare.groupBy("h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("secrets"))


def word_places(texts: DataFrame) -> DataFrame:
    """(h, t, start, end, free): every word of (h, text, base), one row per h; `free` if it overlaps no base span.

    Places are sums in the text's order, and overlaps come from the furthest end before and the nearest start after a
    word among the base spans: cost grows with the text's length only.
    """
    found = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    zipped = F.arrays_zip(found.alias("m"), F.slice(F.split("text", TERM, -1), F.lit(1), F.size(found)).alias("gap"))
    rows = texts.select("h", F.posexplode(zipped).alias("pos", "x")).select("h", "pos", F.col("x.m").alias("m"), F.length("x.gap").alias("gap"))
    end = F.sum(F.col("gap") + F.length("m")).over(W.partitionBy("h").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("end", end).select("h", F.lower("m").alias("t"), (F.col("end") - F.length("m")).alias("start"), "end")
    base = texts.select("h", F.explode("base").alias("s")).select("h", F.lit(None).cast("string").alias("t"), "s.start", "s.end")
    both = rows.unionByName(base)
    # Frames from the partition's first row on are running values; such to its last row would be computed anew for every row.
    along = W.partitionBy("h").orderBy("start", F.col("t").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("h").orderBy(F.col("start").desc(), F.col("t").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("t").isNull(), F.col("end"))).over(along)
    ahead = F.min(F.when(F.col("t").isNull(), F.col("start"))).over(back)
    both = both.withColumn("reach", reach).withColumn("ahead", ahead).filter("t is not null")
    return both.select("h", "t", "start", "end", ((F.coalesce("reach", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))).alias("free"))


def term_spans(found: DataFrame, texts: DataFrame, *, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """(h, terms): per text with entities, array<struct<start, end>> of all places of the terms that disclose one of them, outside its base spans.

    found: (h, text, base) of the documents with base spans; texts: (text) of all documents.
    """
    places = found.groupBy("h").agg(F.first("text").alias("text"), F.first("base").alias("base"))
    holds = places.select("h", F.explode(F.array_distinct(F.flatten(F.transform("base", lambda s: F.array(entity(s), family(s)))))).alias("e"))
    # An entity that is too rare for any term to have support is not looked at further.
    n_e = holds.groupBy("e").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support)
    judged = cut(salted_join(holds, n_e, ["e"], ["h"]))

    words = word_places(places.join(judged.select("h").distinct(), "h", "left_semi"))
    words = cut(words)

    together = words.select("h", "t").distinct().join(judged, "h")
    both = together.groupBy("e", "t").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e")).filter(F.col("n_et") >= support)
    own = F.transform(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TERM), F.lit(0)), F.lower)
    # Every text once: only those that have copies are brought together.
    hashed = texts.select(F.xxhash64("text").alias("h"), "text")
    copied, single = with_and_without(hashed, "h", hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    once = copied.groupBy("h").agg(F.first("text").alias("text")).unionByName(single)
    n_t = once.select(F.explode(F.array_distinct(own)).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    n = texts.select(F.xxhash64("text").alias("h")).distinct().count()
    score = F.log(F.lit(float(n)) * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t")))
    told = both.join(n_t, "t").filter(score >= threshold * F.log(F.lit(float(n)) / F.col("n_e"))).select("e", "t", "n_et")
    # By entity and term: texts of an entity are not paired with terms that they do not hold.
    named = salted_join(together.select("h", "e", "t"), cut(told), ["e", "t"], ["h"], rows="n_et").select("h", "t").distinct()
    return words.filter("free").join(named, ["h", "t"]).groupBy("h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))


def disclosing_spans(docs: DataFrame, *, threshold: float = 0.8, support: int = 2, copies: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, base, terms, secrets): the base spans, the disclosing terms and the secrets of every row."""
    rows = with_base(docs, id_col, text_col)
    # Texts stay where they are: only those of documents with base spans (a few in a hundred) are handed on.
    rows = cut(rows.select("doc_id", "h", F.when(F.size("base") > 0, F.col("text")).alias("text"), "base", "secrets"))
    spans = rows.select("doc_id", "h", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    terms = term_spans(rows.filter("text is not null"), docs.select(F.col(text_col).alias("text")), threshold=threshold, support=support)
    more = terms.join(rare_secrets(rows.select("h", "base", "secrets"), copies), "h", "full")
    out = salted_join(spans, more, ["h"], ["doc_id"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select("doc_id", "h", "base", F.coalesce("terms", none).alias("terms"), F.coalesce("secrets", none).alias("secrets"))


def sanitised(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by a placeholder of its kind; overlapping spans by the first one's.

    spans: (doc_id, h, base, terms, secrets) as disclosing_spans gives it. Only rows with spans are joined to them by key.
    """
    of_kind = lambda c, kind: F.transform(c, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    some = spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.array_sort(F.concat(base, of_kind("terms", "term"), of_kind("secrets", "secret"))).alias("_spans"))
    some = some.filter(F.size("_spans") > 0).dropDuplicates(["_id", "_h"])
    some = cut(some)
    keyed = docs.withColumn("_key_h", F.xxhash64(text_col))
    touched, whole = with_and_without(keyed, "_key_h", some.select("_h").distinct())
    joined = touched.join(some, touched[id_col].eqNullSafe(some["_id"]) & (touched["_key_h"] == some["_h"]), "left")
    text = F.col(text_col)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    # The spans that begin behind the end of all before them, part by part.
    def first(acc: Column, s: Column) -> Column:
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(s))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def part_of(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), first)
        return F.struct(own["at"].alias("at"), F.concat(acc["out"], F.array(own["out"])).alias("out"))

    nested = F.array().cast("array<array<struct<start:int,end:int,kind:string>>>")
    kept = F.flatten(F.aggregate(in_parts(F.col("_spans")), F.struct(F.lit(0).alias("at"), nested.alias("out")), part_of)["out"])

    # Each part's stretch of the text is cut out once, and its spans are cut out of that: from its first span to the next part's.
    def replaced(part: Column, i: Column, parts: Column) -> Column:
        at = F.when(i == 0, F.lit(0)).otherwise(part[0]["start"])
        own = F.substring(text, at + 1, F.coalesce(F.get(parts, i + 1)[0]["start"], F.length(text)) - at)

        def step(acc: Column, s: Column) -> Column:
            return F.struct((s["end"] - at).alias("at"), F.concat(acc["out"], F.substring(acc["own"], acc["at"] + 1, s["start"] - at - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), acc["own"].alias("own"))

        done = lambda acc: F.concat(acc["out"], F.substring(acc["own"], acc["at"] + 1, F.length(acc["own"])))
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), own.alias("own")), step, done)

    clean = F.array_join(let(in_parts(kept), lambda parts: F.transform(parts, lambda p, i: replaced(p, i, parts))), "")
    changed = joined.select(*[(F.when(F.col("_spans").isNotNull(), clean).otherwise(text).alias(c) if c == text_col else F.col(c)) for c in docs.columns])
    return changed.unionByName(whole.select(*docs.columns))


def op9_query(spark, sf_dir: str) -> DataFrame:
    rows = disclosing_spans(table(spark, sf_dir, "documents"))
    joined = lambda spans, kind=None: F.transform(spans, lambda s: F.concat(kind if kind is not None else s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    base, terms, secrets = joined(F.col("base")), joined(F.col("terms"), F.lit("term")), joined(F.col("secrets"), F.lit("secret"))
    personal = F.size("base") + F.size("terms") + F.size("secrets")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms, secrets), ",").alias("spans"),
        F.size("secrets").cast("long").alias("n_secret"), F.size("terms").cast("long").alias("n_term"), personal.cast("long").alias("n_spans"), (personal > 0).alias("personal"),
    )
