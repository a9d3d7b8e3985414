"""Secrets: three kinds found by pattern, and weaker parts of credentials where complementary parts co-occur.

DataFrame functions only. A credential has parts of three roles: an access identifier, a secret, an endpoint. Base spans
are strong parts. Weak parts (a user name that something is set to, an address, an opaque value, an address of a service)
are everywhere in clean texts; one is reported only where it is linked to a strong part of another role, or to weak
parts of both other roles.

Two parts are linked where they lie in one scope (lines without a blank line between) and their intervals, widened by
``reach``, meet. This is an interval join on scope and bucket of ``reach`` code points: spans of a kind don't overlap, and
none is shorter than three code points, so a bucket holds a bounded number and pairs grow with the text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.llm.common import drop_table, materialise, write_table
from docflow.llm.pii import lines_of, with_matches

#: The three base kinds in their order. Fixed patterns, written for Java: possessive where nothing can be given back, and
#: the least length in the pattern where a shorter match can't hide another.
BASE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
#: Weak parts. What an identifier or an endpoint is written like.
WEAK = {
    "account": r"(?i:user_?name|user|login|account|client_?id|key_?id)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.@=-]++",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "opaque": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
    "url": r"(?<![A-Za-z0-9.+-])[A-Za-z][A-Za-z0-9.+-]*+://[^\s\"'<>]++",
    "host": r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}+",
}
KINDS = BASE | WEAK
ROLES = {"access": "identifier", "account": "identifier", "address": "identifier", "assign": "secret", "hex": "secret", "opaque": "secret", "url": "endpoint", "host": "endpoint"}
#: A value that something is set to counts from so many characters.
LEAST_VALUE = 6
#: Every report needs a base span or an opaque value, and each of those needs one of these.
SUSPECT = r"(?i:password|passwd|secret|token|api_?key)|[A-Za-z0-9+/_-]{16}"
#: A line without any of these holds no part.
LIKELY = r"[:=@]|[A-Za-z0-9+/_-]{16}"


def holds(kind: Column, match: Column) -> Column:
    """Whether a pattern's match is really of its kind."""
    value = F.regexp_extract(match, r"^[A-Za-z_]+[\"']?+\x20*+[:=]\x20*+[\"']?+(.*)$", 1)
    return (
        F.when(kind == "assign", F.length(value) >= LEAST_VALUE)
        .when(kind == "opaque", match.rlike("[0-9]") & match.rlike("[A-Za-z]"))
        .otherwise(True)
    )


def suspect(text: Column) -> Column:
    return F.coalesce(text.rlike(SUSPECT), F.lit(False))


def parts_of(df: DataFrame, text_col: str = "text") -> DataFrame:
    """text_key, scope, kind, k, start, end (code points of the text), match, role, strong: all parts in the distinct texts
    that can hold a report."""
    texts = df.where(suspect(F.col(text_col))).select(F.col(text_col).alias("text")).distinct().withColumn("text_key", F.sha2("text", 256))
    blank = F.sum((F.trim("line") == "").cast("int")).over(W.partitionBy("text_key").orderBy("line_no"))
    lines = lines_of(texts).withColumn("scope", blank).where(F.col("line").rlike(LIKELY))
    found = with_matches(lines, KINDS, ["text_key", "line_no", "at", "scope"]).where(holds(F.col("kind"), F.col("match")))
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return found.select("text_key", "scope", "kind", "k", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "match", role[F.col("kind")].alias("role"), (F.col("k") < len(BASE)).alias("strong"))


def near(parts: DataFrame, reach: int) -> DataFrame:
    """For each weak part and each part of its scope that its interval, widened by ``reach``, meets: text_key, k, start,
    end, role, and of the other other_k, other_start, other_end, other_role, other_strong."""
    buckets = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach)))
    weak = parts.where(~F.col("strong")).select("text_key", "scope", "k", "start", "end", "role", buckets(F.col("start") - reach, F.col("end") + reach).alias("bucket"))
    # the other stands in the bucket where it begins, and in those of its inside
    others = parts.select("text_key", "scope", *(F.col(c).alias(f"other_{c}") for c in ("k", "start", "end", "role", "strong")), buckets(F.col("start"), F.col("end") - 1).alias("bucket"))
    met = weak.join(others, ["text_key", "scope", "bucket"])
    apart = (F.col("other_start") <= F.col("end") + reach) & (F.col("start") <= F.col("other_end") + reach)
    # once for each pair: in the first bucket that both are in
    first = F.greatest(F.floor((F.col("start") - reach) / reach), F.floor(F.col("other_start") / reach))
    itself = (F.col("k") == F.col("other_k")) & (F.col("start") == F.col("other_start"))
    return met.where(apart & (F.col("bucket") == first) & ~itself).drop("scope", "bucket")


def linked(near_parts: DataFrame) -> DataFrame:
    """text_key, k, start of the weak parts to report: no base span overlaps them, and complementary parts are near that
    don't overlap them."""
    overlaps = (F.col("other_start") < F.col("end")) & (F.col("start") < F.col("other_end"))
    helps = ~overlaps & (F.col("role") != F.col("other_role"))
    told = near_parts.groupBy("text_key", "k", "start").agg(
        F.bool_or(overlaps & F.col("other_strong")).alias("inside"),
        F.bool_or(helps & F.col("other_strong")).alias("by_strong"),
        F.count_distinct(F.when(helps, F.col("other_role"))).alias("roles"),
    )
    return told.where(~F.col("inside") & (F.col("by_strong") | (F.col("roles") == 2))).select("text_key", "k", "start")


def credential_parts(parts: DataFrame, reach: int = 200) -> DataFrame:
    """text_key (SHA-256 of the text), kind, k, start, end, match, role, strong: of all parts the base spans, and the weak
    ones that are linked."""
    weak = parts.join(linked(near(parts, reach)), ["text_key", "k", "start"], "left_semi")
    return parts.where("strong").unionByName(weak.select(*parts.columns)).drop("scope")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_identifier, n_secret, n_endpoint for each row; spans are
    kind:start:end in code points, in order of start, then kind. The last three count all spans of a role.

    * Null texts count as empty, which have no spans: counts 0, the digest of the empty string, spans empty.
    * Repeated rows and rows of one id each get their row, with the spans of their text.
    * Kinds are told apart where spans overlap or start alike (ties); two spans of one kind can't start alike.
    * Very long texts are read whole, line by line; no pattern matches a line end.
    * No rows in, no rows out. Only the two columns named are read, whatever the others are called.
    """
    said = F.struct("start", "k", F.concat_ws(":", "kind", "start", "end").alias("said"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: x["said"]), ",")
    counts = [F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in BASE] + [F.count_if(F.col("role") == x).alias(f"n_{x}") for x in ("identifier", "secret", "endpoint")]
    spark, parts = df.sparkSession, parts_of(df, text_col)
    table = write_table(parts, "secret-parts")
    by_text = credential_parts(spark.read.schema(parts.schema).parquet(table), reach).groupBy("text_key").agg(*counts, F.array_sort(F.collect_list(said)).alias("all"))
    names = [f"n_{x}" for x in BASE], ["base_sha256", "spans"], ["n_identifier", "n_secret", "n_endpoint"]
    base = F.sha2(joined(F.filter("all", lambda x: x["k"] < len(BASE))), 256).alias("base_sha256")
    found = materialise(by_text.select("text_key", *names[0], base, joined(F.col("all")).alias("spans"), *names[2]), "secret-spans")  # so that the join's hot texts can be split
    drop_table(spark, table)
    none = {c: F.lit(0).cast("long") for c in names[0]} | {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")} | {c: F.lit(0).cast("long") for c in names[2]}
    doc_id, could = F.col(id_col).cast("long").alias("doc_id"), suspect(F.col(text_col))
    met = df.where(could).select(doc_id, F.sha2(text_col, 256).alias("text_key")).join(found, "text_key", "left")
    rest = df.where(~could).select(doc_id, *(x.alias(c) for c, x in none.items()))
    return met.select("doc_id", *(F.coalesce(c, x).alias(c) for c, x in none.items())).unionByName(rest)
