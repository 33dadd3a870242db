"""Secrets by multipart credential linking, DataFrame operations only.

Three fixed expressions give the strong findings. Weak candidates, long mixed tokens that alone could be
anything, are reported only where a complementary part stands in the same scope: an access identifier (a
key id, user or client name) or an endpoint (a URL or host). The parts of a document are joined by
intervals: a scope reaches `SCOPE` characters, so a candidate meets the parts of its own and the two
neighbouring stretches of that length, of which the nearest are enough; no pair of parts is emitted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfgrid.llm import spans
from turfgrid.llm.storage import written

KINDS = ["assign", "access", "hex", "linked"]
SCOPE = 200

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""
ACCESS = "AKIA[A-Z0-9]++"
HEX = "[0-9a-f]++"
_TOKEN = "[A-Za-z0-9+/_=-]"
WEAK = rf"(?<!{_TOKEN}){_TOKEN}{{20,}}+"
NAME = r"""(?i:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9_.@-]{3,}+"""
ENDPOINT = r"""(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]++|(?i:host|server|endpoint)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9.-]{3,}+)"""


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, n_*, weak, parts) per row: all of the text that later steps need."""
    table = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = spans.add_matches(table, "assign", ASSIGN, F.col("text").rlike("(?i:passw|secret|token|api_?key)"))
    table = spans.add_matches(table, "access", ACCESS, F.contains("text", F.lit("AKIA")))
    table = spans.add_matches(table, "hex", HEX, F.col("text").rlike("[0-9a-f]{24}"))
    table = spans.add_matches(table, "weak", WEAK, F.col("text").rlike(f"{_TOKEN}{{20}}"))
    table = spans.add_matches(table, "name", NAME, F.col("text").rlike("(?i:user|login|client|access|account)"))
    table = spans.add_matches(table, "endpoint", ENDPOINT, F.col("text").rlike("(?:://|(?i:host|server|endpoint))"))
    table = table.withColumn("assign", F.filter("assign", lambda m: F.length(F.regexp_extract(m["text"], VALUE, 1)) >= 6))
    table = table.withColumn("access", F.filter("access", lambda m: F.length(m["text"]) >= 20))
    table = table.withColumn("hex", F.filter("hex", lambda m: F.length(m["text"]) >= 24))
    table = table.withColumn("base", F.array_sort(F.concat(*[spans.of_kind(F.col(k), i) for i, k in enumerate(KINDS[:3])])))
    mixed = lambda m: m["text"].rlike("[0-9]") & m["text"].rlike("[a-z]") & m["text"].rlike("[A-Z]")
    taken = F.concat(F.col("base"), spans.of_kind(F.col("name"), 0), spans.of_kind(F.col("endpoint"), 0))
    weak = F.filter("weak", lambda m: mixed(m) & ~spans.overlaps(F.col("taken"), m["start"], m["end"]))
    table = table.withColumn("taken", taken).withColumn("weak", weak)
    parts = F.concat(*[F.transform(F.col(k), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in ("access", "name", "endpoint")])
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    return table.select("doc_id", F.xxhash64("text").alias("text_key"), *counts, "base", F.transform("weak", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("weak"), parts.alias("parts"))


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_key, start, end) of weak candidates with a part at most `scope` characters away.

    Parts are first reduced to their extremes per stretch of the text, so that a candidate meets three rows
    at most, however many parts a document has.
    """
    both = rows.where((F.size("weak") > 0) & (F.size("parts") > 0))
    weak = both.select("doc_id", "text_key", F.explode("weak").alias("w")).select("doc_id", "text_key", "w.start", "w.end").distinct()
    parts = both.select("doc_id", "text_key", F.explode("parts").alias("p")).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "p.*")
    # a part lies in every stretch that it touches
    stretch = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)))
    parts = parts.withColumn("__stretch", stretch).groupBy("__doc", "__key", "__stretch").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    near = weak.withColumn("__at", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") - 1 + scope) / scope))))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key")) & (F.col("__at") == F.col("__stretch"))
    # before the candidate the last part of a stretch is nearest, after it the first; in between any part is
    close = F.when(F.col("__at") < F.floor(F.col("start") / scope), F.col("start") - F.col("last") <= scope).when(F.col("__at") > F.floor((F.col("end") - 1) / scope), F.col("first") - F.col("end") <= scope).otherwise(True)
    return near.join(parts, same).where(close).select("doc_id", "text_key", "start", "end").distinct()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every document.

    The counts and base_sha256 are of the fixed expressions; `spans` adds weak candidates that are linked.
    Null and empty texts have no spans; repeated rows give repeated rows; an empty table gives none.
    """
    rows = written(scan(docs), "secrets")
    added = linked(rows).groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(F.collect_set(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added"))
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key")), "left")
    more = F.coalesce("added", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return joined.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS[:3]],
        F.sha2(spans.listing(F.col("base"), KINDS), 256).alias("base_sha256"),
        spans.listing(F.concat(F.col("base"), more), KINDS).alias("spans"),
        F.size(more).cast("bigint").alias("n_linked"),
    )
