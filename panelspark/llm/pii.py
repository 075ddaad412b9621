"""Personal data by bootstrapped contextual extraction (operator 4), in DataFrame functions only.

Base recognisers find emails, IP addresses, card and phone numbers. They seed the bootstrap: an entity and a token
(a word with a digit or @) are instances, and the words around one are its lexical patterns: the one, two or three words
before it, those after it, and the word on either side; words are whole, in lower case, and numbers and codes (words with
digits) stand as wildcards. Contexts go across other matches; where text is glued to a match, that side has none.
Rounds over the graph of distinct (pattern, instance) edges score patterns by the share of their
instances that are trusted for a kind, and instances of a fitting shape by their best pattern; seeds stay
at 1. A pattern is accepted if the scores of its instances sum to SUPPORT and to a share of CONFIDENCE of all
its instances, so what one pattern found supports further ones, less than a seed does. Rounds end when the
confidences rest, with a warning if they still move after ROUNDS. Accepted patterns mark further tokens of a fitting
shape as that kind, unless they overlap a base span. Copies of a text add no support, as edges are distinct; patterns of
fewer than SUPPORT instances can't be accepted and are left out of the graph.

Regular expressions are written so that Java matches them without recursion or repeated scans: every
repeat is possessive, and a match starts where a run starts or the last match ended.

Edge cases: null text is empty and has no spans; rows that repeat a doc_id, or have none, report the spans
of their own text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, materialize

KINDS = ("email", "ip", "card", "phone")
#: Least sum of the scores of a pattern's distinct instances, their least share, and most rounds over the graph.
SUPPORT, CONFIDENCE, ROUNDS = 4.0, 0.75, 24
#: What tells rows apart: doc_id, and a hash of the text.
ROW = ["doc_id", "rid"]

_SPACE = "\\x20\\x09-\\x0D"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+",
}
_NEEDS = {"email": "@", "phone": "+"}
# A part that is all zeros is taken by the first repeat.
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?+"
#: Shapes of unseen identifiers that a pattern may mark.
SHAPES = {
    "email": "^[^@]+@[^@]+$",
    "ip": "^[0-9A-Fa-f]{0,4}(?:[:.][0-9A-Fa-f]{0,4}){2,7}$",
    "card": "^[0-9](?:-?[0-9]){11,18}$",
    "phone": "^[0-9(][0-9()./-]{5,18}[0-9]$",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid() -> Column:
    m, kind = F.col("match"), F.col("kind")
    count = F.length(_digits(m))
    card = count.between(13, 19)
    return (
        F.when(kind == "ip", m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"))
        .when(kind == "card", F.when(card, _luhn(_digits(m))).otherwise(False))
        .when(kind == "phone", count.between(9, 15))
        .otherwise(True)
    )


#: Words of a context on each side, and text that may close a match before the next word.
CONTEXT, _CLOSING = 3, "^[)\\]}>\"'.,;:!?]*+"
_WORDS = f"^(?:[{_SPACE}]*+[^{_SPACE}]++){{0,{CONTEXT}}}[{_SPACE}]*+"
_FOUND = "array<struct<kind:string,i:int,gap:int,tail:string,head:string,match:string>>"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern in order, each with the gap before it and that gap's last and first words; then the last gap."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def last(gap: Column) -> Column:
        return F.reverse(F.regexp_extract(F.reverse(gap), _WORDS, 0))

    def row(gap: Column, match: Column) -> Column:
        return F.struct(F.length(gap).alias("gap"), last(gap).alias("tail"), F.regexp_extract(gap, _CLOSING + _WORDS[1:], 0).alias("head"), match.alias("match"))

    def numbered(r: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), r["gap"].alias("gap"), r["tail"].alias("tail"), r["head"].alias("head"), r["match"].alias("match"))

    # The last gap has no match after it, so it comes with a null one.
    return F.transform(F.zip_with(gaps, hits, row), numbered)


def _words(context: Column) -> Column:
    """Words of a context in lower case; numbers and codes are wildcards."""
    words = F.filter(F.split(F.lower(context), f"[{_SPACE}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike("^[0-9.,:/-]+$"), "<number>").when(w.rlike("[0-9@]"), "<code>").otherwise(w))


def _contexts(left: Column, right: Column) -> Column:
    """Patterns of an instance from the words on either side (arrays, left ones end at the instance)."""
    out = []
    for n in range(1, CONTEXT + 1):
        out += [F.when(F.size(left) >= n, F.concat(F.array_join(F.slice(left, -n, n), " "), F.lit(" _")))]
        out += [F.when(F.size(right) >= n, F.concat(F.lit("_ "), F.array_join(F.slice(right, 1, n), " ")))]
    out.append(F.when((F.size(left) > 0) & (F.size(right) > 0), F.concat(F.element_at(left, -1), F.lit(" _ "), F.element_at(right, 1))))
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def matches(docs: DataFrame) -> DataFrame:
    """ROW, kind, start, end, match and contexts of every match of PATTERNS; code points, end exclusive."""
    text = F.coalesce("text", F.lit(""))
    found = []
    for kind, pattern in PATTERNS.items():
        needed = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9@]")
        found.append(F.coalesce(F.when(needed, _found(text, kind, pattern)), F.array().cast(_FOUND)))
    rows = docs.select("doc_id", F.xxhash64(text).alias("rid"), F.explode(F.flatten(F.array(*found))).alias("r")).select(*ROW, "r.*")
    rows = rows.dropDuplicates([*ROW, "kind", "i"])
    order = W.partitionBy(*ROW, "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(order.rowsBetween(W.unboundedPreceding, 0))

    def at(c: str, n: int) -> Column:
        return F.coalesce(F.lag(c, n).over(order) if n >= 0 else F.lead(c, -n).over(order), F.lit(""))

    # A match is a word at least, so as many matches as words of a context are enough.
    near = {f"l{n}": F.concat(at("tail", n), at("match", n)) for n in range(1, CONTEXT)} | {f"r{n}": F.concat(at("match", -n), at("head", -n - 1)) for n in range(1, CONTEXT)}
    placed = rows.withColumns({"end": end, "next": at("head", -1), **near}).filter("match is not null")
    before = F.concat(*[F.col(f"l{n}") for n in range(CONTEXT - 1, 0, -1)], F.col("tail"))
    closed = F.regexp_replace("next", _CLOSING, "")
    after = F.concat(closed, *[F.col(f"r{n}") for n in range(1, CONTEXT)])
    none = F.array().cast("array<string>")
    left = F.when(before.rlike(f"[{_SPACE}]$"), _last(_words(before))).otherwise(none)
    right = F.when(closed.rlike(f"^[{_SPACE}]"), F.slice(_words(after), 1, CONTEXT)).otherwise(none)
    sides = placed.select(*ROW, "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", left.alias("left"), right.alias("right"))
    return sides.select(*ROW, "kind", "start", "end", "match", _contexts(F.col("left"), F.col("right")).alias("contexts"))


def _last(words: Column) -> Column:
    return F.slice(words, F.greatest(F.size(words) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT))


def _fits(kind: Column, token: Column) -> Column:
    fits = F.lit(False)
    for k, shape in SHAPES.items():
        fits = fits | ((kind == k) & token.rlike(shape))
    return fits


def learn(base: DataFrame, tokens: DataFrame, tmp: Scratch) -> DataFrame:
    """Accepted patterns (pattern, kind, confidence) from spans and tokens (contexts, match or token, ..)."""
    seeds = base.select(F.explode("contexts").alias("pattern"), F.col("match").alias("instance"))
    unknown = tokens.select(F.explode("contexts").alias("pattern"), F.col("token").alias("instance"))
    # Tokens that are seeds of the same pattern are the same instance.
    edges = seeds.union(unknown).distinct()
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total")).filter(F.col("total") >= SUPPORT)
    kinds = F.array_compact(F.array(*[F.when(F.bool_or(F.col("kind") == k), F.lit(k)) for k in KINDS]))
    trusted = base.filter(F.size("contexts") > 0).groupBy(F.col("match").alias("instance")).agg(kinds.alias("kinds"))
    # The one table of the graph: each edge with its pattern's total and the kinds its instance is trusted for, null if it is no seed.
    edges = tmp(edges.join(totals, "pattern").join(trusted, "instance", "left"))
    sure = edges.select("pattern", "total", F.explode("kinds").alias("kind"), F.lit(1.0).alias("score"))
    open_edges = edges.filter("kinds is null").drop("kinds")
    known, before = sure, (0, 0.0)
    for _ in range(ROUNDS):
        scored = known.groupBy("pattern", "total", "kind").agg(F.sum("score").alias("hit")).withColumn("confidence", F.col("hit") / (F.col("total") + 1))
        patterns = tmp(scored.filter((F.col("hit") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "kind", "confidence"))
        found = patterns.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if found[0] == before[0] and abs(found[1] - before[1]) <= 1e-3 * found[0]:
            return patterns
        before = found
        gained = open_edges.join(patterns, "pattern").filter(_fits(F.col("kind"), F.col("instance"))).groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        known = sure.union(open_edges.join(gained, "instance").select("pattern", "total", "kind", "score"))
    warnings.warn(f"confidences of {found[0]} patterns still move after {ROUNDS} rounds", stacklevel=3)
    return patterns


def extract(docs: DataFrame) -> DataFrame:
    """Spans (doc_id, rid, kind, start, end, is_base) of all texts; rid is the hash of the text."""
    with Scratch(docs.sparkSession) as tmp:
        return materialize(_extract(docs.select("doc_id", "text"), tmp))


def _extract(docs: DataFrame, tmp: Scratch) -> DataFrame:
    found = tmp(matches(docs).filter(_valid()))
    base = found.filter("kind <> 'token'")
    # A token without the marks around it; those that a base recogniser reads are no unknowns.
    opening = F.length(F.regexp_extract("match", "^[(\\[{<\"'=:,;]*", 0))
    token = F.regexp_replace(F.regexp_replace("match", "^[(\\[{<\"'=:,;]+", ""), "[)\\]}>\"'.,;:!?]+$", "")
    tokens = found.filter("kind = 'token'").select(*ROW, (F.col("start") + opening).alias("start"), token.alias("token"), "contexts").filter("token <> ''")
    read = F.lit(False)
    for kind in ("email", "ip"):
        read = read | F.col("token").rlike(f"^(?:{PATTERNS[kind]})$")
    tokens = tokens.filter(~read & ~F.col("token").rlike("^\\+[0-9]"))
    patterns = learn(base, tokens, tmp)
    marked = tokens.select(*ROW, "start", "token", F.explode("contexts").alias("pattern"))
    new = marked.join(patterns, "pattern").filter(_fits(F.col("kind"), F.col("token")))
    # A token that two kinds fit is of the surer one.
    new = new.withColumn("end", F.col("start") + F.length("token")).groupBy(*ROW, "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    new = new.select(*ROW, "kind", "start", "end", F.lit(False).alias("is_base"))
    spans = base.select(*ROW, "kind", "start", "end", F.lit(True).alias("is_base"))
    # A new span that meets a base span of any kind is left out: running ends to both sides.
    order = W.partitionBy(*ROW).orderBy("start", "end")
    own = F.when(F.col("is_base"), F.col("end"))
    ends_before = F.max(own).over(order.rowsBetween(W.unboundedPreceding, -1))
    starts_after = F.min(F.when(F.col("is_base"), F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    clash = F.coalesce(ends_before > F.col("start"), F.lit(False)) | F.coalesce(starts_after < F.col("end"), F.lit(False))
    return spans.unionByName(new).withColumn("clash", clash).filter("is_base or not clash").select(*ROW, "kind", "start", "end", "is_base").distinct()


def summary(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts and digest of its base spans, all spans as text, and how many were learned."""
    spans = extract(docs)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(number.alias("no"), "start", "end", "kind", "is_base")
    per_row = spans.groupBy(F.col("doc_id").alias("_id"), "rid").agg(F.sort_array(F.collect_list(span)).alias("s"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_rid"))
    joined = rows.join(per_row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_rid") == F.col("rid")), "left")
    every = F.coalesce("s", F.expr("array()").cast(per_row.schema["s"].dataType))

    def listed(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["kind"], r["start"], r["end"])), ",")

    base = F.filter(every, lambda r: r["is_base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda r: r["kind"] == kind)).cast("long").alias(f"n_{kind}")

    learned = (F.size(every) - F.size(base)).cast("long")
    return joined.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"), learned.alias("n_learned"))
