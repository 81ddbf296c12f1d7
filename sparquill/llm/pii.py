"""Personal data, and terms that reveal it, with DataFrame expressions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected
entities. The corpus then tells how strongly a term reveals one. For the terms of texts
that mention an entity e, with c(t, e) the texts that hold t and mention e, df(t) the
texts that hold t and df(e) those that mention e, of N,

    P(e | t) = c / df(t)         PMI(t, e) = log2(c N / (df(t) df(e)))

A term with enough texts behind it and both figures above their thresholds discloses
the entity, and its occurrences become spans of kind term, too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import likely_in, null_safe_text, settle, shared_dir

#: The patterns, in the order of kinds. Lookbehind and \G start a match where a run of
#: its characters starts, and possessive loops don't go back: the leftmost matches
#: stay the same, and long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that a text must have for a match, where there is one.
_NEEDS = {"email": "@", "phone": "+"}
_CHUNK = 64


@dataclass(frozen=True)
class Disclosure:
    """Thresholds for terms: texts with term and entity, P(e | t), PMI in bits."""

    texts: int = 3
    probability: float = 0.5
    bits: float = 4.0


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _running(a: Column, start: Column) -> Column:
    """For each element the sum of those before it, plus start; appends to a growing array."""
    zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(a, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def sums_before(a: Column) -> Column:
    """As _running from 0, in chunks, so that an array of n takes n * n / _CHUNK copies at most."""
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / _CHUNK).cast("int")), lambda k: F.slice(v, k * _CHUNK + 1, _CHUNK))
    return _let(a, lambda v: _let(chunks(v), lambda c: _let(_running(F.transform(c, _sum), F.lit(0)), lambda at: F.flatten(F.transform(c, lambda x, k: _running(x, F.get(at, k)))))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: str, m: Column) -> Column:
    """The check that a match of a kind must pass."""
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        digit = lambda c, i: _let(c.cast("int") * (1 + i % 2), lambda d: d - F.when(d > 9, 9).otherwise(0))
        luhn = lambda d: F.length(d).between(13, 19) & (_sum(F.transform(F.split(F.reverse(d), ""), digit)) % 10 == 0)
        return _let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: Column, needs: str | None = None) -> Column:
    """struct<gaps, hits>: what the matches of a pattern leave between them, and the matches."""
    hit = F.contains(text, F.lit(needs)) & F.rlike(text, pattern) if needs else F.rlike(text, pattern)
    none = F.struct(F.array(F.lit("")).alias("gaps"), F.array().cast("array<string>").alias("hits"))
    return F.when(hit, F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))).otherwise(none)


def _spans(pieces: Column, holds) -> Column:
    """array<struct<s, e, m, before, after>> of the matches that hold; code points, end exclusive."""
    lengths = lambda p: F.zip_with(p["gaps"], p["hits"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    at = lambda p, b, m, i: F.struct((F.get(b, i) + F.length(F.get(p["gaps"], i))).alias("s"), (F.get(b, i) + F.length(F.get(p["gaps"], i)) + F.length(m)).alias("e"), m.alias("m"), F.get(p["gaps"], i).alias("before"), F.get(p["gaps"], i + 1).alias("after"))
    return _let(pieces, lambda p: _let(sums_before(lengths(p)), lambda b: F.filter(F.transform(p["hits"], lambda m, i: at(p, b, m, i)), lambda x: holds(x["m"]))))


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def entities(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds, for every kind, an array column of that name: struct<s, e, m, before, after>."""
    for kind, pattern in PATTERNS.items():
        spans = _spans(_pieces(F.col(text), F.lit(pattern), _NEEDS.get(kind)), lambda m, kind=kind: _holds(kind, m))
        rows = rows.withColumn(kind, spans)
    return rows


#: A term: a run of letters, hyphens and apostrophes, without letters or digits around it.
_TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}'’-]*+\p{L}?(?![\p{L}\p{N}])"


def _terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _mentions(kind: str) -> Column:
    """Per span of a kind the entity and the matched text."""
    spoken = {"email": F.lower, "ip": lambda m: m}.get(kind, lambda m: F.regexp_replace(m, r"[\x20().-]", ""))
    return F.transform(F.col(kind), lambda x: F.struct(F.concat(F.lit(f"{kind}:"), spoken(x["m"])).alias("entity"), x["m"].alias("m")))


def disclosing_terms(found: DataFrame, rows: DataFrame, how: Disclosure, base: str) -> DataFrame:
    """(term, entity, c, df_term, df_entity) of the terms that disclose an entity.

    found (t, mentions: array<struct<entity, m>>) and rows (t, text) are of all texts, t
    being a text's hash; equal texts count once. Words of a mention itself aren't terms
    next to it.
    """
    said = settle(found.select("t", F.explode("mentions.entity").alias("entity")).distinct(), f"{base}/said")
    with_entity = said.groupBy("entity").agg(F.count("*").alias("df_entity"))
    # c(t, e) is at most df(e), so an entity of fewer texts can have no term.
    often = settle(with_entity.where(F.col("df_entity") >= how.texts), f"{base}/often")
    said = settle(said.join(often.select("entity"), "entity", "left_semi"), f"{base}/often_said")
    own = F.array_join(F.transform(F.sort_array(F.array_distinct("mentions.m"), asc=False), lambda m: F.concat(F.lit("\\Q"), m, F.lit("\\E"))), "|")
    heard = found.where(F.size("mentions") > 0).join(said.select("t").distinct(), "t", "left_semi").select("t", own.alias("own"))
    texts = rows.where(likely_in(said, "t")(F.col("t"))).join(heard.dropDuplicates(["t"]), "t").dropDuplicates(["t"])
    near = settle(texts.select("t", F.explode(_terms(F.regexp_replace("text", F.col("own"), F.lit(" ")))).alias("term")), f"{base}/near")
    # Equal texts: df counts rows, and takes off the further rows of a text.
    copied = settle(found.groupBy("t").agg(F.count("*").alias("m")).where("m > 1"), f"{base}/copied")
    n = found.count() - (copied.agg(F.sum(F.col("m") - 1)).first()[0] or 0)
    bits = lambda df: F.log2(F.col("c") * n / (F.col(df) * F.col("df_entity")))
    strong = lambda df: (F.col("c") >= how.probability * F.col(df)) & (bits(df) >= how.bits)
    # In texts with entities df is known first; in all it is no less, which rules out most terms.
    df_near = near.groupBy("term").agg(F.count("*").alias("df_near")).where(F.col("df_near") >= how.texts)
    pairs = near.join(said, "t").groupBy("term", "entity").agg(F.count("*").alias("c")).where(F.col("c") >= how.texts)
    pairs = settle(pairs.join(df_near, "term").join(often, "entity").where(strong("df_near")).drop("df_near"), f"{base}/pairs")
    wanted = settle(pairs.select("term").distinct(), f"{base}/wanted")
    likely = likely_in(wanted, "term")
    terms = lambda df, *more: df.select(F.explode(F.filter(_terms(F.col("text")), likely)).alias("term"), *more)
    once = rows.where(likely_in(copied, "t")(F.col("t"))).groupBy("t").agg(F.first("text").alias("text"), (F.count("*") - 1).alias("more")).where("more > 0")
    # Counted before they meet the wanted terms, so each task sends a term once.
    counts = terms(rows).groupBy("term").agg(F.count("*").alias("k")).unionByName(terms(once, F.col("more")).groupBy("term").agg((-F.sum("more")).alias("k")))
    df = counts.groupBy("term").agg(F.sum("k").alias("df_term")).join(wanted, "term", "left_semi")
    return settle(pairs.join(df, "term").where(strong("df_term")).select("term", "entity", "c", "df_term", "df_entity"), f"{base}/disclosing")


def personal_data(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """Spans of personal data and of disclosing terms in every row of docs (doc_id, text).

    Returns doc_id, t (the text's xxhash64), and the arrays email, ip, card, phone, term:
    struct<s, e, m>, code points, end exclusive, and the matched text.

    A null text is empty and has no spans. Rows are told apart by doc_id (null is a
    value like others) and text; equal rows get equal results. Other columns are
    ignored. An empty table gives an empty result.
    """
    base = shared_dir(docs.sparkSession)
    text = null_safe_text().cast("string")
    rows = docs.select("doc_id", text.alias("text")).withColumn("t", F.xxhash64("text"))
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    found = entities(rows).select("doc_id", "t", *(bare(F.col(k)).alias(k) for k in PATTERNS), F.concat(*(_mentions(k) for k in PATTERNS)).alias("mentions"))
    found = settle(found, f"{base}/found")
    terms = settle(disclosing_terms(found, rows, how, base).select("term").distinct(), f"{base}/terms")
    held = rows.select("t", F.explode(F.filter(_terms(F.col("text")), likely_in(terms, "term"))).alias("term"))
    flagged = held.join(terms, "term", "left_semi").groupBy("t").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    flagged = settle(flagged, f"{base}/flagged")
    # Whole words out of a text's own list; only such texts go through the join.
    any_of = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?iu:"), F.array_join(F.transform("terms", lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    hit = rows.where(likely_in(flagged, "t")(F.col("t"))).join(flagged, "t").select("t", bare(_spans(_pieces(F.col("text"), any_of), lambda m: F.lit(True))).alias("term")).dropDuplicates(["t"])
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return found.drop("mentions").join(hit, "t", "left").select("doc_id", "t", *PATTERNS, F.coalesce("term", none).alias("term"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of what personal_data() found, a row for each of its rows: doc_id, n_KIND, base_sha256, spans."""
    base = F.concat(*(_joined(k, F.col(k)) for k in PATTERNS))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _joined("term", F.col("term"))), ",").alias("spans"),
    )


def _generalised(kind: str, pieces: Column) -> Column:
    hit = lambda m: F.when(m.isNull(), "").when(_holds(kind, m), f"<{kind.upper()}>").otherwise(m)
    return _let(pieces, lambda p: F.array_join(F.zip_with(p["gaps"], p["hits"], lambda g, m: F.concat(g, hit(m))), ""))


def sanitised(docs: DataFrame, found: DataFrame, term: str = "") -> DataFrame:
    """doc_id, text of docs with personal_data()'s entities generalised to <KIND>, and its terms to `term` (by default removed).

    Where spans overlap, the kind listed first takes the text. A row per row of docs; a
    null text becomes an empty one. Rows are told apart by text, so `found` has to be of
    these docs. Other columns are ignored. An empty table gives an empty result.
    """
    spans = found.select("t", *PATTERNS, "term").dropDuplicates(["t"])
    rows = docs.select("doc_id", null_safe_text().cast("string").alias("text")).withColumn("t", F.xxhash64("text")).join(spans, "t")
    text = F.col("text")
    for kind, pattern in PATTERNS.items():
        text = F.when(F.size(kind) > 0, _generalised(kind, _pieces(text, F.lit(pattern)))).otherwise(text)
    words = F.array_distinct(F.transform("term", lambda x: F.concat(F.lit("\\Q"), x["m"], F.lit("\\E"))))
    gone = F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])")), F.lit(term.replace("\\", "\\\\").replace("$", "\\$")))
    return rows.select("doc_id", F.when(F.size("term") > 0, gone).otherwise(text).alias("text"))
