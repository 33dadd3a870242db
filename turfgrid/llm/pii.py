"""Personal data by bootstrapped contextual extraction, DataFrame operations only.

Seeds are the valid matches of four fixed expressions. A seed's left context (a label, or the two words
before it) is a pattern of its kind; other identifier-like strings in the same contexts are candidate
instances. Patterns and instances form a bipartite graph that is scored in rounds: a pattern is as good as
the share of its mentions whose instances are believed, an instance is believed unless all its patterns
fail, and seeds are always believed. Candidates that end up believed in a good pattern are reported beside
the seeds.

Texts are read once, into a narrow table of spans and mentions; rounds aggregate mentions by pattern and by
instance, so a very common context is a partial sum and never a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfgrid.llm import spans
from turfgrid.llm.storage import drop, written

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
#: A pattern needs this many different believed instances, and a mention of one that is no more than a start.
LEAST_SUPPORT = 3
DOUBT = 1.0
LEAST_PATTERN = 0.5
LEAST_INSTANCE = 0.5

# The expressions match what the plain ones match, in linear time: a run of characters is tried from its
# start only (or from the end of the match before), and never given back.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:\x20?[0-9]|-[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# identifier-like strings: groups of digits with separators, and spelled-out mail addresses
NUMBER = r"(?<![\p{L}\p{N}])[(]?[0-9]{2,}+[)]?(?:[\x20./()-]{1,2}+[0-9]{2,}+[)]?)*+(?![\p{L}\p{N}])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++"



def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _small_parts(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.regexp_extract(part, "([0-9]{1,3})$", 1).cast("int") <= 255))


def _counted(text: Column, low: int, high: int) -> Column:
    return F.length(digits(text)).between(low, high)


def _context(left: Column) -> Column:
    """What stands before a mention: a label, that is a word with : = or #, or else the last two words.

    One word without a mark says too little: almost anything follows it somewhere.
    """
    label = F.regexp_extract(left, r"([\p{L}_]+)\s*[:=#]\s*[\"'(\[<]*\s*$", 1)
    words = F.regexp_extract(left, r"([\p{L}_]+[^\p{L}\p{N}]{1,8}[\p{L}_]+[^\p{L}\p{N}]{0,8})$", 1)
    return F.lower(F.when(label != "", F.concat(label, F.lit(":"))).otherwise(F.regexp_replace(words, r"\s+", " ")))


def _mentions(matches: Column, kind: Column, seed: bool) -> Column:
    """(start, end, kind, context, instance, seed); kind null: any kind that its digits allow."""
    return F.transform(
        matches,
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), kind.cast("int").alias("kind"), _context(m["left"]).alias("context"), F.lower(F.regexp_replace(m["text"], r"[\s()/.+-]", "")).alias("instance"), F.lit(seed).alias("seed")),
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, n_*, mentions) per row: all of the text that later steps need."""
    table = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = spans.add_matches(table, "email", EMAIL, F.contains("text", F.lit("@")))
    table = spans.add_matches(table, "ip", IP, F.col("text").rlike(r"[0-9]\.[0-9]"))
    table = spans.add_matches(table, "card", CARD, F.col("text").rlike(r"[0-9][\x20-]?[0-9]"))
    table = spans.add_matches(table, "phone", PHONE, F.col("text").rlike(r"\+[0-9]"))
    table = spans.add_matches(table, "number", NUMBER, F.col("text").rlike("[0-9]{2}"))
    table = spans.add_matches(table, "spelled", SPELLED, F.col("text").rlike(r"[\[(]at[\])]"))
    table = table.withColumn("ip", F.filter("ip", lambda m: _small_parts(m["text"])))
    table = table.withColumn("card", F.filter("card", lambda m: _counted(m["text"], 14, 19) & luhn(digits(m["text"]))))
    table = table.withColumn("phone", F.filter("phone", lambda m: _counted(m["text"], 10, 15)))
    table = table.withColumn("base", F.array_sort(F.concat(*[spans.of_kind(F.col(k), i) for i, k in enumerate(KINDS)])))
    free = [F.filter(F.col(c), lambda m: ~spans.overlaps(F.col("base"), m["start"], m["end"])) for c in ("number", "spelled")]
    free[0] = F.filter(free[0], lambda m: F.length(digits(m["text"])) >= 7)
    seeds = [_mentions(F.col(k), F.lit(i), True) for i, k in enumerate(KINDS)]
    mentions = F.concat(*seeds, _mentions(free[0], F.lit(None), False), _mentions(free[1], F.lit(0), False))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return table.select("doc_id", F.xxhash64("text").alias("text_key"), *counts, "base", mentions.alias("mentions"))


def believed(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(context, kind, instance) of candidates that the graph believes.

    `edges` has context, kind, instance, seed and the number of mentions. In every round patterns are
    scored from instances and instances from patterns.
    """
    scores = edges.where("seed").select("kind", "instance").distinct().withColumn("belief", F.lit(1.0))
    for step in range(rounds):
        known = edges.join(scores, ["kind", "instance"], "left").withColumn("belief", F.coalesce("belief", F.lit(0.0)))
        weight = F.sum(F.col("belief") * F.col("mentions")) / (F.sum("mentions") + DOUBT)
        support = F.sum(F.when(F.col("belief") >= LEAST_INSTANCE, 1).otherwise(0))
        patterns = known.groupBy("context", "kind").agg(weight.alias("trust"), support.alias("support"))
        patterns = patterns.where((F.col("support") >= LEAST_SUPPORT) & (F.col("trust") >= LEAST_PATTERN) & F.col("context").rlike(r"\p{L}"))
        fails = F.exp(F.sum(F.ln(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))
        reached = edges.join(patterns, ["context", "kind"])
        fresh = reached.groupBy("kind", "instance").agg((1 - fails).alias("belief"), F.max("seed").alias("seed"))
        fresh = fresh.withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.col("belief"))).drop("seed")
        if step < rounds - 1:
            old = edges.where("seed").select("kind", "instance").distinct().withColumn("belief", F.lit(1.0))
            scores = written(old.union(fresh).groupBy("kind", "instance").agg(F.max("belief").alias("belief")), "beliefs")
    return reached.where("not seed").join(fresh.where(F.col("belief") >= LEAST_INSTANCE), ["kind", "instance"]).select("context", "kind", "instance").distinct()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every document.

    The counts and base_sha256 are of the fixed expressions; `spans` adds what the patterns discover. Null
    and empty texts have no spans; repeated rows give repeated rows; an empty table gives none.
    """
    rows = written(scan(docs), "spans")
    mentions = rows.where(F.size("mentions") > 0).select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.*")
    # candidates may be of each kind that their digits allow
    length = F.length(digits(F.col("instance")))
    kinds = F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.concat(F.when(length.between(12, 19), F.array(F.lit(2))).otherwise(F.array().cast("array<int>")), F.when(length <= 15, F.array(F.lit(3))).otherwise(F.array().cast("array<int>"))))
    mentions = mentions.where("context != ''").withColumn("kind", F.explode(kinds))
    edges = written(mentions.groupBy("context", "kind", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("mentions")), "edges")
    found = mentions.where("not seed").join(believed(edges), ["context", "kind", "instance"])
    # one kind per span: a mention believed in two kinds is of the first
    added = found.groupBy("doc_id", "text_key", "start", "end").agg(F.min("kind").alias("kind"))
    added = added.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key")), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    more = F.coalesce("added", none)
    return joined.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(spans.listing(F.col("base"), KINDS), 256).alias("base_sha256"),
        spans.listing(F.concat(F.col("base"), more), KINDS).alias("spans"),
        F.size(more).cast("bigint").alias("n_added"),
    )
