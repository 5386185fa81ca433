"""Personal data by weak supervision, in DataFrame operations only.

Generators propose candidate spans. Labelers vote on each: the strict pattern, a gazetteer, the shape, and
words standing before the span for and against; a labeler may abstain. Expectation-maximisation over the
counts of vote patterns (3^5 per kind at most) estimates each labeler's reliability and each pattern's
probability; with those as soft labels a span classifier (naive Bayes over the votes, shape, length,
neighbouring characters and the preceding word, hashed) is trained. Spans that pass the strict pattern always stay; the
classifier adds other candidates that it finds likelier than not and that no strict span overlaps.

Null text counts as empty (no spans). Rows are told apart by position, so null and repeated doc_ids are kept
as they are. Ties of start and kind are ordered by end. Tables without any candidate train nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caregrid.llm.common import stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# The four strict patterns, written so that matching never goes back over what it has read.
_LOCAL = "[A-Za-z0-9._%+-]"
GENERATORS = (
    # name, kind, strict, needs, pattern
    ("email", "email", True, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", True, "[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", "card", True, "[0-9]", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", "phone", True, r"\+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email_words", "email", False, r"[\(\[ ](?:at|AT)[\)\] ]",
     rf"(?<!{_LOCAL})[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}(?: ?[\(\[](?:at|AT)[\)\]] ?| (?:at|AT) )[A-Za-z0-9-]{{1,63}}"
     r"(?:(?: ?[\(\[](?:dot|DOT)[\)\]] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{2,63}){1,4}"),
    ("phone_local", "phone", False, "[0-9]{3}", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]*[0-9])"),
)
# Gazetteers and cue words.
TLDS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "be", "us", "ca", "in", "ng", "br", "mx", "jp", "cn")
CALLING_CODES = "1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-9]|88[0-9]|9[679][0-9]"
CARD_ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|64[4-9]|35|30|36|38"
CUES_FOR = "mail|e-mail|contact|write|phone|tel|call|mobile|fax|card|visa|credit|payment|pay|ip|addr|host|server|login|from"
CUES_AGAINST = "version|isbn|issn|order|invoice|section|chapter|figure|table|page|build|release|serial|doi|part"
ROUNDS, BUCKETS, THRESHOLD = 25, 256, 0.5
LABELERS = 5
LEAST = (0.9, 0.55, 0.55, 0.55, 0.55)  # reliabilities are not estimated lower: a failed checksum or range is strong evidence


def _matches(generator: str, needs: str, pattern: str) -> Column:
    """Every match with the length of the gap before it and what stands on both sides."""
    text = text_or_empty()
    # an array of one: under a condition Spark would split the text anew for every use of the gaps
    once = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("values"), F.split(text, pattern, -1).alias("gaps")))
    rows = F.transform(once, lambda m: F.transform(m["values"], lambda value, i: F.struct(
        F.lit(generator).alias("generator"), i.alias("nth"), value.alias("value"), F.char_length(F.get(m["gaps"], i)).alias("gap"),
        F.lower(F.right(F.get(m["gaps"], i), F.lit(40))).alias("before"), F.left(F.get(m["gaps"], i + 1), F.lit(1)).alias("after"))))
    return F.when(text.rlike(needs), F.flatten(rows))


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    at = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, at(i)).otherwise(F.element_at(doubled, at(i) + 1)))
    return total % 10 == 0


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the numbered documents, and every candidate with place, votes and features."""
    found = F.concat(*[F.coalesce(_matches(g, needs, p), F.expr("array()").cast(
        "array<struct<generator:string,nth:int,value:string,gap:int,before:string,after:string>>")) for g, _, _, needs, p in GENERATORS])
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), found.alias("found")), "pii-found")
    c = rows.select("row", F.inline("found"))
    done = Window.partitionBy("row", "generator").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.char_length("value")
    c = c.withColumn("end", F.sum(F.col("gap") + n).over(done).cast("long")).withColumn("start", F.col("end") - n)
    kind = F.element_at(F.create_map(*[F.lit(x) for g in GENERATORS for x in g[:2]]), F.col("generator"))
    strict = F.col("generator").isin(*[g[0] for g in GENERATORS if g[2]])
    c = c.withColumn("kind", kind).withColumn("digits", F.regexp_replace("value", "[^0-9]", ""))
    size = F.char_length("digits")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    passes = (F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", F.col("value").rlike(rf"^{part}(?:\.{part}){{3}}$"))
              .when(F.col("kind") == "card", F.when(size.between(14, 19), _luhn(F.col("digits"))).otherwise(False))
              .otherwise(size.between(10, 15)))
    c = c.withColumn("base", strict & passes)
    c = c.where(F.col("base") | (F.col("kind") != "card") | size.between(13, 19))  # shorter numbers are no candidates
    return rows.select("row", "doc_id"), c.withColumn("votes", _votes(size)).withColumn("features", _features(size)).select(
        "row", "kind", "start", "end", "base", "votes", "features")


def _votes(size: Column) -> Column:
    """One of 1 (for), 0 (against) and 2 (abstains) from each labeler."""
    value, kind, yes, no, none = F.col("value"), F.col("kind"), F.lit(1), F.lit(0), F.lit(2)
    tld = F.lower(F.regexp_extract("value", r"([A-Za-z]+)$", 1))
    gazetteer = (F.when(kind == "email", F.when(tld.isin(*TLDS), yes).otherwise(none))
                 .when(kind == "ip", F.when(value.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), no).otherwise(yes))
                 .when(kind == "card", F.when(F.col("digits").rlike(f"^(?:{CARD_ISSUERS})"), yes).otherwise(no))
                 .otherwise(F.when(~value.startswith("+"), F.when(F.col("digits").rlike("^[2-9]"), yes).otherwise(no))
                            .when(F.col("digits").rlike(f"^(?:{CALLING_CODES})"), yes).otherwise(no)))
    shape = (F.when(kind == "email", F.when(F.char_length("value").between(6, 80), yes).otherwise(no))
             .when(kind == "ip", F.when(value.rlike(r"(?:^|\.)0[0-9]"), no).otherwise(yes))
             .when(kind == "card", F.when(size.isin(15, 16), yes).otherwise(no))
             .otherwise(F.when(size.between(10, 13), yes).otherwise(no)))
    strict = F.when(F.col("base"), yes).otherwise(no)
    cue_for = F.when(F.col("before").rlike(rf"\b(?:{CUES_FOR})s?\b"), yes).otherwise(none)
    cue_against = F.when(F.col("before").rlike(rf"\b(?:{CUES_AGAINST})s?\b"), no).otherwise(none)
    return F.array(strict, gazetteer, shape, cue_for, cue_against)


def _features(size: Column) -> Column:
    shape = F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[A-Za-z]+", "a"), "[0-9]+", "9"), "[^a9@.+() -]+", "x"), F.lit(16))
    hashed = lambda name, c: F.concat(F.lit(f"{name}="), F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("string"))
    word = F.regexp_extract("before", r"([a-z]+)[^a-z]*$", 1)
    votes = [F.concat(F.lit(f"vote{j}="), F.col("votes")[j].cast("string")) for j in range(LABELERS)]
    return F.array(*votes, hashed("shape", shape), hashed("word", word), hashed("left", F.right("before", F.lit(1))), hashed("right", F.col("after")),
                   F.concat(F.lit("digits="), F.least(size, F.lit(24)).cast("string")),
                   F.concat(F.lit("chars="), F.least(F.floor(F.char_length("value") / 4), F.lit(24)).cast("string")))


_POSTERIOR = """1 / (1 + exp(-(ln(m.prior / (1 - m.prior)) + aggregate(transform(p.votes, (v, j) ->
    CASE v WHEN 1 THEN ln(m.a[j] / (1 - m.a[j])) WHEN 0 THEN -ln(m.a[j] / (1 - m.a[j])) ELSE 0D END), 0D, (s, x) -> s + x))))"""


def vote_model(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, prior, reliability array, patterns array<(votes, n, posterior)>) by expectation-maximisation."""
    counts = spans.groupBy("kind", "votes").agg(F.count("*").alias("n"))
    each = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats"))  # 3^5 at most
    post = f"transform(pats, p -> named_struct('votes', p.votes, 'n', p.n, 'w', {_POSTERIOR}))"
    agree = "CASE p.votes[j] WHEN 1 THEN p.n * p.w WHEN 0 THEN p.n * (1 - p.w) ELSE 0D END"
    step = f"""transform(array({post}), q -> named_struct(
        'prior', least(0.98D, greatest(0.02D, (1 + aggregate(q, 0D, (s, p) -> s + p.n * p.w)) / (2 + aggregate(q, 0D, (s, p) -> s + p.n)))),
        'a', transform(sequence(0, {LABELERS - 1}), j -> least(0.98D, greatest(array({', '.join(f'{x}D' for x in LEAST)})[j],
            (8 + aggregate(q, 0D, (s, p) -> s + {agree})) / (10 + aggregate(q, 0D, (s, p) -> s + IF(p.votes[j] = 2, 0, p.n))))))))[0]"""
    start = f"named_struct('prior', 0.5D, 'a', array({', '.join(['0.8D'] * LABELERS)}))"
    fitted = each.withColumn("m", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (m, t) -> {step})"))
    return fitted.select("kind", F.col("m.prior").alias("prior"), F.col("m.a").alias("reliability"),
                         F.expr(f"transform(array(m), m -> {post})[0]").alias("patterns"))


def classifier(spans: DataFrame, votes: DataFrame) -> DataFrame:
    """(kind, bias, weights map): naive Bayes trained on the spans' posteriors; 4 rows, bounded maps."""
    soft = votes.select("kind", F.inline("patterns")).select("kind", "votes", F.col("w").alias("p"))
    s = spans.join(F.broadcast(soft), ["kind", "votes"])  # 4 * 3^5 rows at most
    total = s.groupBy("kind").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    seen = s.select("kind", "p", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(
        F.sum("p").alias("y"), F.sum(1 - F.col("p")).alias("n"))
    w = seen.join(total, "kind").select("kind", "feature", "yes", "no", F.log((F.col("y") + 1) / (F.col("yes") + 2)).alias("ly"), F.log((F.col("n") + 1) / (F.col("no") + 2)).alias("ln"))
    return w.groupBy("kind").agg(F.first(F.log((F.col("yes") + 1) / (F.col("no") + 1))).alias("bias"),
                                 F.map_from_entries(F.collect_list(F.struct("feature", F.col("ly") - F.col("ln")))).alias("weights"))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans array<(start, kind_order, end, base)>): one row per input row, spans in order."""
    rows, found = candidates(docs)
    spans = stored(found, "pii-spans")
    model = stored(classifier(spans, stored(vote_model(spans), "pii-votes")), "pii-model")
    scored = spans.join(F.broadcast(model), "kind", "left")  # 4 rows
    odds = F.aggregate("features", F.coalesce("bias", F.lit(0.0)), lambda a, f: a + F.coalesce(F.element_at("weights", f), F.lit(0.0)))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-odds)))
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "end").rowsBetween(1, Window.unboundedFollowing)
    scored = scored.where(F.col("base") | (F.col("p") >= threshold)).select(
        "row", "start", "end", "base", order.alias("kind_order"),
        F.max(F.when(F.col("base"), F.col("end"))).over(before).alias("reach"),
        F.min(F.when(F.col("base"), F.col("start"))).over(after).alias("next"))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    kept = scored.where(F.col("base") | clear).groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "kind_order", "end", "base"))).alias("spans"))
    none = F.expr("array()").cast("array<struct<start:bigint,kind_order:int,end:bigint,base:boolean>>")
    return rows.join(kept, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


