"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived, an OR of
ANDs that every text with a match satisfies. Postings (trigram, document) of the
trigrams that queries name are intersected by Spark; a rule is only tried on the
documents that its query leaves. A rule for which no trigram is mandatory has no
query, and is tried on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from re import _constants as sre  # the parser that compiles every pattern in Python
from re import _parser as sre_parser

from .common import likely_in, settle, shared_dir, text_slices, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False
    base: bool = True

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.any_case else 0))


#: The base rules, and how well-known services write their tokens.
#: The keyword's letters are in either case; a value's alphabet holds both anyway.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # the same spans as those of [0-9a-f]+ with 16 or more
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("chat_app", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("fine_grained", r"github_pat_[A-Za-z0-9_]{60,}", base=False),
    Rule("project_host", r"glpat-[A-Za-z0-9_-]{20,}", base=False),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}", base=False),
    Rule("cloud_session", r"ya29\.[A-Za-z0-9_-]{20,}", base=False),
    Rule("payment", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", base=False),
    Rule("point_of_sale", r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}", base=False),
    Rule("mailing", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", base=False),
    Rule("mail_route", r"key-[0-9a-f]{32}", base=False),
    Rule("packages", r"npm_[A-Za-z0-9]{36}", base=False),
    Rule("package_index", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}", base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", base=False),
    Rule("shop", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", base=False),
    Rule("chat_hook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", base=False),
    Rule("chat_bot", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}", base=False),
    Rule("droplet", r"dop_v1_[0-9a-f]{64}", base=False),
    Rule("vault", r"hvs\.[A-Za-z0-9_-]{24,}", base=False),
    Rule("file_key", r"AGE-SECRET-KEY-1[0-9A-Z]{58}", base=False),
    Rule("url_password", r"://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{4,64}@", base=False),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}", base=False),
)
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]] | None:
    """Alternatives, each a set of trigrams (ASCII letters lowered) that a match must hold.

    None if some match needs no trigram. Parts of the pattern that are not a few fixed
    strings become gaps, which only weakens the query.
    """

    def cross(heads: list[tuple], tails: list[tuple]) -> list[tuple]:
        return [(*a[:-1], a[-1] + b[0], *b[1:]) for a, b in product(heads, tails)] if len(heads) * len(tails) <= most else [(*a, "") for a in heads]

    def of(nodes) -> list[tuple]:
        """Alternatives as runs of fixed text with gaps between them; always two ends."""
        out: list[tuple] = [("",)]
        for op, arg in nodes:
            out = cross(out, part(op, arg))
        return out

    gap: list[tuple] = [("", "")]

    def part(op, arg) -> list[tuple]:
        if op is sre.LITERAL:
            return [(chr(arg).lower() if arg < 128 else chr(arg),)]
        if op is sre.IN and len(arg) <= 4 and all(x is sre.LITERAL for x, _ in arg):
            return [(chr(x).lower(),) for _, x in arg]
        if op is sre.SUBPATTERN:
            return of(arg[3])
        if op is sre.BRANCH:
            found = [x for branch in arg[1] for x in of(branch)]
            return found if len(found) <= most else gap
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, top, inner = arg
            if (least, top) == (0, 1):
                return [("",), *of(inner)]
            return cross(of(inner), gap) if least else gap
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            return [("",)]
        return gap

    found = [frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in of(sre_parser.parse(pattern))]
    return None if not all(found) else list(dict.fromkeys(found))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of some trigrams (all ASCII, at most 65,535) over whole texts: doc_id, trigram (its number)."""
    fold = np.arange(256, dtype=np.uint32)
    fold[ord("A") : ord("Z") + 1] += 32
    named = [t.encode() for t in trigrams]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 24, np.uint16)
        for k, (a, b, c) in enumerate(named):
            table[a << 16 | b << 8 | c] = k + 1
        for batch in batches:
            for row, data, offsets in text_slices(batch, "text"):
                if len(data) < 3:
                    continue
                low = fold[data]
                found = table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
                at = np.flatnonzero(found)
                doc = np.searchsorted(offsets, at, "right") - 1
                within = at + 2 < offsets[doc + 1]
                pairs = np.unique(doc[within] << 16 | found[at[within]].astype(np.int64) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row).take(pa.array(pairs >> 16)), pa.array((pairs & 65535).astype(np.int32))], names=["doc_id", "trigram"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(work, "doc_id long, trigram int")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents that rules with a query have to be tried on: doc_id, rules (their numbers)."""
    queries = {k: q for k, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for alternative in q for t in alternative})
    terms = [(k, a, len(alternative), trigrams.index(t)) for k, q in queries.items() for a, alternative in enumerate(q) for t in alternative]
    # A row per rule, alternative and trigram: it grows with the rules alone.
    wanted = docs.sparkSession.createDataFrame(terms, "rule int, alternative int, needed int, trigram int")
    hits = postings(docs, trigrams).join(F.broadcast(wanted), "trigram").groupBy("doc_id", "rule", "alternative", "needed").agg(F.countDistinct("trigram").alias("n"))
    return hits.where("n = needed").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: bool = False) -> DataFrame:
    """The secrets of every row of docs (doc_id, text): doc_id, spans, and with `text` the text.

    spans: array of kind, start, end (code points, end exclusive), by start and then in
    the order of the rules. Matches of a rule are leftmost and do not overlap; those
    that are too short are left out, not tried again from another place.

    A null text is empty. Documents are looked up by doc_id, so rows that repeat one
    are tried for all that any of them is a candidate for, and rows without one for
    everything; neither changes what is found. Other columns are ignored. An empty
    table gives an empty result.
    """
    full = [k for k, rule in enumerate(rules) if trigram_query(rule.pattern) is None]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tried = settle(candidates(docs, rules), shared_dir(docs.sparkSession))
    maybe = F.coalesce(likely_in(tried, "doc_id")(F.col("doc_id")), F.lit(False))  # other texts don't go through the join
    rows = rows.where(maybe).join(tried, "doc_id", "left").unionByName(rows.where(~maybe).withColumn("rules", F.lit(None).cast("array<int>")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [rule.compiled() for rule in rules]
        for batch in batches:
            ids, texts, tried = (batch.column(n) for n in ("doc_id", "text", "rules"))
            out = []
            for k in range(batch.num_rows):
                body, some = texts[k].as_py(), tried[k].as_py() or []
                found = []
                for r in range(len(rules)) if not ids[k].is_valid else sorted({*full, *some}):
                    found += [(m.start(), r, m.end()) for m in compiled[r].finditer(body) if len(m[rules[r].group]) >= rules[r].least]
                out.append([{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, kind), *([texts] if text else [])], names=["doc_id", "spans", *(["text"] if text else [])])

    return rows.mapInArrow(work, f"doc_id long, spans {_SPANS}" + ", text string" * text)


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of what find_secrets() found, a row for each of its rows: doc_id, n_KIND, base_sha256, spans."""
    base = [rule.kind for rule in rules if rule.base]
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(said(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret replaced by `mask`; overlapping spans share one.

    Texts without secrets and all other columns stay; n_chars, if there, is the new
    length where a text changed. Rows are told apart by doc_id and text.
    """
    found = find_secrets(docs, rules, text=True).where("size(spans) > 0").distinct()

    @F.pandas_udf(T.StringType())
    def masked(texts, spans):
        import pandas as pd

        def one(body, own):
            out, at = [], 0
            for s in own:
                if s["start"] >= at:
                    out += [body[at : s["start"]], mask]
                at = max(at, s["end"])
            return "".join([*out, body[at:]])

        return pd.Series([one(b, s) for b, s in zip(texts, spans, strict=True)])

    i, t, clean = (unused(docs, name) for name in ("doc", "hash", "clean"))
    changed = settle(found.select(F.col("doc_id").alias(i), F.xxhash64("text").alias(t), masked("text", "spans").alias(clean)), shared_dir(docs.sparkSession))
    own = F.xxhash64(F.col("text").cast("string"))
    maybe = likely_in(changed, t)(own)  # only these go through the join, with their texts
    out = docs.where(maybe).join(changed, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (own == F.col(t)), "left")
    new = {"text": F.coalesce(clean, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(clean).isNotNull(), F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return docs.where(~maybe).unionByName(out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns)))
