"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers; these are the seeds.
Every identifier-like string of the corpus, seed or not, is an instance with the lexical patterns it
stands in: the word before it and the word after it, each alone and together with its coarse shape
(whether it has an @, letters, digits).
Patterns and instances form a graph.  In each round a pattern is as sure as the mean score of its
distinct instances - a seed's score is always 1, that of an instance without a sure pattern 0 - and an
instance that is no seed scores one minus the chance that the surest patterns of all its words err.  After ROUNDS rounds, instances that score enough are identifiers nobody wrote a
pattern for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged
from .spans import matches, replaced

KINDS = ["email", "ip", "card", "phone"]
#: Production parameters: rounds, least distinct seeds of a pattern, least sureness, least score.
ROUNDS = 3
SUPPORT = 5
SURE = 0.8
SCORE = 0.9
#: Discovered spans go out by broadcast up to so many (16 bytes each and some).
BROADCAST_SPANS = 500_000

# A match starts where a run of its characters starts or the last match ended: the same matches as
# without the look-behind, found in time linear in the text.  Possessive marks keep what cannot be
# given back anyway, and so loop instead of recursing.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Card numbers are looked for where separators that no card holds are blanked out, so that a run of
# one character class is a match however long it is (nested repetition would recurse).
CARD = r"[0-9 -]{2,}"
CARD_BREAKS = r"(?<![0-9])[ -]|[ -](?![0-9])"
CANDIDATE = r"(?:(?<!\S)|\G)[^\s@]+@[^\s@]+|\+?\(?[0-9][0-9\x20().-]{5,}[0-9]|(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{8,}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    weighed = F.transform(F.split(F.reverse(digits), ""), weigh)
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base matches of a text: array of (start, kind's place in KINDS, end), in that order."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def kind(k: int, hint: Column, where: Column, pattern: str, ok) -> Column:
        got = F.filter(matches(where, pattern), ok) if ok else matches(where, pattern)
        return F.when(hint, F.transform(got, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))).otherwise(none)

    octets = lambda x: F.forall(F.split(x["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    card = lambda x: F.when(F.length(_digits(x["value"])).between(12, 19), _luhn(_digits(x["value"]))).otherwise(False)
    phone = lambda x: F.length(_digits(x["value"])).between(9, 15)
    return F.array_sort(
        F.concat(
            kind(0, F.contains(text, F.lit("@")), text, EMAIL, None),
            kind(1, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), text, IP, octets),
            kind(2, text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), F.regexp_replace(text, CARD_BREAKS, "_"), CARD, card),
            kind(3, text.rlike(r"\+[0-9]"), text, PHONE, phone),
        )
    )


def _word(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}=:]", "")


def _candidates(text: Column) -> Column:
    """Identifier-like strings: array of (start, end, value, shape, before, after).

    The words beside a string are looked for up to the string before and the one after it."""
    shape = lambda v: F.when(v.contains("@"), F.lit("@")).otherwise(F.concat(F.when(v.rlike(r"\p{L}"), F.lit("a")).otherwise(F.lit("")), F.when(v.rlike("[0-9]"), F.lit("9")).otherwise(F.lit(""))))

    def one(x: Column) -> Column:
        before = F.element_at(F.split(F.rtrim(F.right(x["left"], F.lit(40))), r"\s+"), -1)
        after = F.element_at(F.split(F.ltrim(F.left(x["right"], F.lit(40))), r"\s+"), 1)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), shape(x["value"]).alias("shape"), _word(before).alias("before"), _word(after).alias("after"))

    none = F.array().cast("array<struct<start:int,end:int,value:string,shape:string,before:string,after:string>>")
    return F.coalesce(F.when(text.rlike("[0-9@]"), F.transform(matches(text, CANDIDATE), one)), none)


def _extracted(docs: DataFrame, text_col: str, carry: list[str], p: str) -> DataFrame:
    """Per row: a fixed row number, the carried columns, base spans and candidates (written once)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    src = docs.select(*[F.col(f"`{c}`") for c in carry], text.alias(f"{p}text"))
    t = F.col(f"{p}text")
    got = src.withColumn(f"{p}spans", base_spans(t)).withColumn(f"{p}candidates", _candidates(t)).drop(f"{p}text")
    return staged(got.withColumn(f"{p}row", F.monotonically_increasing_id()), "pii")


def _instances(rows: DataFrame, p: str) -> DataFrame:
    """row, start, end, value, shape, before, after of every candidate, and whether a base span overlaps it (seed).

    Spans and candidates of a text lie in one order: a span overlaps a candidate if one that starts no
    later ends behind its start, or the next one starts before its end."""
    r = F.col(f"{p}row").alias("row")
    blank = [F.lit(None).cast("string").alias(c) for c in ("value", "shape", "before", "after")]
    spans = rows.select(r, F.explode(f"{p}spans").alias("s")).select("row", "s.start", "s.end", *blank, F.lit(True).alias("base"))
    some = rows.select(r, F.explode(f"{p}candidates").alias("c")).select("row", "c.*", F.lit(False).alias("base"))
    up = W.partitionBy("row").orderBy(F.asc("start"), F.desc("base")).rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy("row").orderBy(F.desc("start"), F.asc("base")).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = spans.unionByName(some).withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(up)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(down))
    seed = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return both.where(~F.col("base")).select("row", "start", "end", "value", "shape", "before", "after", seed.alias("seed"))


def _discovered(rows: DataFrame, p: str) -> DataFrame:
    """row and span of identifiers that the graph finds beside the seeds."""
    one = staged(_instances(rows, p), "instances")
    sides = [F.when(F.col(word) != "", F.concat_ws("\u0001", F.lit(side), word)) for side, word in (("b", "before"), ("a", "after"))]
    each = [F.struct(x.alias("word"), y.alias("pattern")) for x in sides for y in (x, F.concat(x, F.lit("\u0001"), F.col("shape")))]
    patterns = F.filter(F.array(*each), lambda x: x["word"].isNotNull())
    edges = staged(one.select("value", "seed", F.explode(patterns).alias("p")).select("value", "seed", "p.*").groupBy("word", "pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    values = staged(edges.groupBy("value").agg(F.max("seed").alias("seed")), "values")
    scores = values.select("value", F.col("seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        seen = edges.join(scores, "value")
        sure = seen.groupBy("pattern").agg(F.avg("score").alias("sure"), F.count(F.when(F.col("seed"), 1)).alias("seeds")).where((F.col("seeds") >= SUPPORT) & (F.col("sure") >= SURE))
        best = edges.join(sure, "pattern").groupBy("value", "word").agg(F.max("sure").alias("sure"))
        found = best.groupBy("value").agg(F.sum(F.log(F.lit(1.000001) - F.col("sure"))).alias("doubt"))
        score = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce(F.lit(1.0) - F.exp("doubt"), F.lit(0.0)))
        scores = staged(values.join(found, "value", "left").select("value", score.alias("score")), "scores")
    new = scores.where(F.col("score") >= SCORE).select("value")
    return one.where(~F.col("seed")).join(new, "value", "left_semi").select("row", F.struct("start", F.lit(len(KINDS)).alias("kind"), "end").alias("span"))


def _with_new(rows: DataFrame, p: str) -> DataFrame:
    """rows with all spans, base ones and discovered ones.  Few discoveries go out by broadcast; many are joined by row."""
    new = staged(_discovered(rows, p).groupBy(F.col("row").alias(f"{p}of")).agg(F.collect_set("span").alias(f"{p}new")), "discovered")
    if (new.select(F.sum(F.size(f"{p}new") + 1)).first()[0] or 0) <= BROADCAST_SPANS:
        new = F.broadcast(new)
    both = rows.join(new, F.col(f"{p}row") == F.col(f"{p}of"), "left").drop(f"{p}of")
    spans = f"{p}spans"
    return both.withColumn(f"{p}all", F.array_sort(F.concat(F.col(spans), F.coalesce(F.col(f"{p}new"), F.array().cast(rows.schema[spans].dataType)))))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "identifier"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_identifier.

    spans lists base spans and, as kind "identifier", what the graph discovers; the counts and the
    digest are of the base spans.  A null text counts as empty (no spans, digest of ""), a null id
    stays null, repeated rows are rows of their own, an empty table gives none, and columns other
    than id and text are not read."""
    p = "pii_in_"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = _with_new(_extracted(src, "text", ["doc_id"], p), p)
    base = F.col(f"{p}spans")

    def count(k: int) -> Column:  # a default argument of the lambda would be taken for the element's index
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col(f"{p}all")).alias("spans"), (F.size(f"{p}all") - F.size(base)).cast("long").alias("n_identifier"))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with every span of the text replaced by its kind in brackets.

    Spans that overlap become one mask, named after the first (ties: the shortest).  Null texts stay
    null; repeated rows and null ids stay as they are; n_chars, if docs has it, is set to the new
    length; an empty table gives none.  Texts are not shuffled unless discoveries are many."""
    p = "pii_in_"
    rows = _with_new(_extracted(docs, text_col, docs.columns, p), p)
    text, spans = F.col(f"`{text_col}`"), F.col(f"{p}all")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, "identifier"]])
    done = F.when(F.size(spans) > 0, replaced(text, spans, lambda s: F.get(names, s["kind"]))).otherwise(text)
    out = rows.withColumn(text_col, done)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(text.isNull(), F.col("n_chars")).otherwise(F.length(F.col(f"`{text_col}`"))).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
