"""Personal data: four kinds found by pattern, and what gives them away by information-theoretic sanitisation.

DataFrame functions only. Texts that hold neither @ nor a digit can't hold a span and are left at once. The others are
cut into lines (no pattern matches a line end), and positions follow from running sums over the pieces that ``split``
leaves and the matches between them.

Protected entities are the spans of the four base kinds and secrets (opaque values that something is set to), each at
three levels: its value, its class (an address's domain, a network, an issuer, an area code) and its kind. A term is a
word of letters. With p estimated over the distinct lines of all documents, PMI(e; t) = log2 p(e, t) / (p(e) p(t)) is
what t reveals of e, and IC(e) = -log2 p(e) is all there is to reveal. Where PMI / IC reaches ``disclosure`` and enough
distinct lines show both (``SUPPORT``, more for wider levels, where chance brings lines together more easily), t is
disclosing for e: the term is generalised, or removed from ``removal`` up, wherever it stands in any line of any
document. Copies of a line count once, so repeated documents prove nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.llm.common import finished, fresh, materialise

#: The four kinds in their order. Fixed patterns, written for Java: possessive where nothing can be given back, and
#: not started within a run of the first class's characters, where the run's own start has failed already.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What is protected besides: an opaque value that follows = or :, of 20 characters or more, letters and digits.
SECRETS = {"secret": r"(?<=[=:][\x20\t]{0,3}[\"']?)[A-Za-z0-9][A-Za-z0-9+/_-]{19,}+"}
PROTECTED = KINDS | SECRETS
#: Distinct lines that must show a term together with an entity of the level.
SUPPORT = {"value": 2, "class": 3, "kind": 5}
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"
TERM = r"\p{L}{3,}+"
#: Terms that are sent to all executors at most; more are joined by a shuffle.
FEW_TERMS = 100_000


def holds(kind: Column, match: Column) -> Column:
    """Whether a pattern's match is really of its kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(F.split(match, r"\."), lambda x: x.rlike(BYTE)))
        .when(kind == "secret", match.rlike("[0-9]") & match.rlike("[A-Za-z]"))
        .when(kind == "card", n.between(13, 19) & F.when(n.between(13, 19), F.call_function("luhn_check", digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def with_matches(lines: DataFrame, patterns: dict[str, str], keys: list[str]) -> DataFrame:
    """A row for each match in column line: keys, kind, k (number of the kind), start and end within the line, match."""
    each = F.array(*(F.struct(F.lit(name).alias("kind"), F.lit(k).alias("k"), F.regexp_extract_all("line", F.lit(p), F.lit(0)).alias("m"), F.split("line", p, -1).alias("p")) for k, (name, p) in enumerate(patterns.items())))
    found = lines.select(*keys, F.explode(each).alias("e")).where(F.size("e.m") > 0)
    rows = found.select(*keys, "e.kind", "e.k", F.posexplode(F.arrays_zip(F.col("e.m").alias("m"), F.col("e.p").alias("p"))).alias("pos", "x")).where(F.col("x.m").isNotNull())
    sofar = W.partitionBy(*keys, "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length("x.p") + F.length("x.m")).over(sofar)
    return rows.select(*keys, "kind", "k", (end - F.length("x.m")).alias("start"), end.alias("end"), F.col("x.m").alias("match"))


def lines_of(texts: DataFrame) -> DataFrame:
    """text_key, line_no, at (the line's first code point), line, line_hash, of rows with text_key and text."""
    lines = texts.select("text_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    before = W.partitionBy("text_key").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")).withColumn("line_hash", F.xxhash64("line"))


def suspect(text: Column) -> Column:
    """Whether a text can hold a span; null texts can't."""
    return F.coalesce(text.rlike("[@0-9]"), F.lit(False))


def suspects(df: DataFrame, text_col: str) -> DataFrame:
    """text_key and text of the distinct texts that can hold a span."""
    return df.where(suspect(F.col(text_col))).select(F.col(text_col).alias("text")).distinct().withColumn("text_key", F.sha2("text", 256))


def base_spans(lines: DataFrame) -> DataFrame:
    """text_key, line_no, at, line_hash, kind, k, start, end (within the line), value, class: the spans of all protected
    kinds in lines of lines_of."""
    likely = lines.where(F.col("line").rlike("[@0-9]"))
    found = with_matches(likely, PROTECTED, ["text_key", "line_no", "at", "line_hash"]).where(holds(F.col("kind"), F.col("match")))
    kind = F.col("kind")
    value = F.when(kind.isin("card", "phone"), F.regexp_replace("match", "[^0-9]", "")).when(kind == "secret", F.col("match")).otherwise(F.lower("match"))
    wide = (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(value, 1, 6))
        .when(kind == "phone", F.substring(value, 1, 4))
    )
    return found.select("text_key", "line_no", "at", "line_hash", "kind", "k", "start", "end", value.alias("value"), wide.alias("class"))


def entities_of(base: DataFrame) -> DataFrame:
    """entity, need, line_hash: the entities of each distinct line at all levels, and how many lines must show a term."""
    level = lambda name, of: F.struct(F.concat_ws(":", F.lit(name), "kind", of).alias("entity"), F.lit(SUPPORT[name]).alias("need"))
    each = F.array(level("value", F.col("value")), level("class", F.coalesce("class", F.lit(""))), level("kind", F.lit(None).cast("string")))
    known = base.select("line_hash", "class", F.explode(each).alias("e")).where(F.col("class").isNotNull() | ~F.col("e.entity").startswith("class:"))
    return known.select("e.entity", "e.need", "line_hash").distinct()


def free_terms(hosts: DataFrame, base: DataFrame) -> DataFrame:
    """text_key, line_no, at, line_hash, start, end, term: the terms in lines with base spans that no base span overlaps."""
    key = ["text_key", "line_no"]
    words = with_matches(hosts, {"term": TERM}, [*key, "at", "line_hash"])
    # a term that a base span overlaps is part of it: running ends and the next start tell
    one = [*key, "at", "line_hash", "start", "end"]
    marks = words.select(*one, F.lower("match").alias("term")).unionByName(base.select(*one, F.lit(None).cast("string").alias("term")))
    own = F.col("term").isNull()
    by = W.partitionBy(*key).orderBy("start", ~own, "end")
    placed = marks.withColumns(
        {
            "reached": F.max(F.when(own, F.col("end"))).over(by.rowsBetween(W.unboundedPreceding, 0)),
            "next": F.min(F.when(own, F.col("start"))).over(by.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    free = placed.where(~own & (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    return free.select(*one, "term")


def said_in(text: str, *keys: Column) -> list[Column]:
    """Columns for a select: the keys, and each distinct word of the text column as ``word``."""
    return [*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("word")]


def disclosing_terms(df: DataFrame, terms: DataFrame, base: DataFrame, text_col: str, disclosure: float, removal: float) -> DataFrame:
    """term, value (remove or generalise). A line is the unit of all counts; a term within a span doesn't count."""
    everywhere = df.where(F.col(text_col).isNotNull()).select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("line"))
    n = float(everywhere.agg(F.countDistinct(F.xxhash64("line")).alias("n")).first()["n"])
    ic = F.log2(F.lit(n) / F.col("n_e"))

    def ratio(n_et: Column, n_t: Column) -> Column:
        return F.when(ic > 0, F.log2(F.lit(n) * n_et / (F.col("n_e") * n_t)) / ic)

    # what can't reach its support or disclosure, whatever other lines say, needs no pair: n_et <= n_e, n_et <= least_n_t <= n_t
    entities = entities_of(base)
    entities = entities.join(entities.groupBy("entity", "need").agg(F.count(F.lit(1)).alias("n_e")).where("n_e >= need").drop("need"), "entity")
    shown = terms.select("term", "line_hash").distinct()
    shown = shown.join(shown.groupBy("term").agg(F.count(F.lit(1)).alias("least_n_t")).where(F.col("least_n_t") >= min(SUPPORT.values())), "term")
    possible = (F.col("least_n_t") >= F.col("need")) & (ratio(F.least("n_e", "least_n_t"), F.col("least_n_t")) >= disclosure - 1e-9)
    pairs = entities.join(shown, "line_hash").where(possible).groupBy("entity", "need", "term", "n_e", "least_n_t").agg(F.count(F.lit(1)).alias("n_et"))
    together = materialise(pairs.where((F.col("n_et") >= F.col("need")) & (ratio(F.col("n_et"), F.col("least_n_t")) >= disclosure)), "pii-together")
    wanted = materialise(together.select("term").distinct(), "pii-wanted")
    said = everywhere.select(*said_in("line", F.xxhash64("line").alias("line_hash"))).select("line_hash", F.lower("word").alias("term"))
    elsewhere = said.join(few(wanted), "term", "left_semi").distinct().join(base.select("line_hash").distinct(), "line_hash", "left_anti")
    counts = elsewhere.groupBy("term").agg(F.count(F.lit(1)).alias("n_other"))
    told = together.join(counts, "term", "left").withColumn("ratio", ratio(F.col("n_et"), F.col("least_n_t") + F.coalesce("n_other", F.lit(0)))).where(F.col("ratio") >= disclosure)
    return told.groupBy("term").agg(F.when(F.max("ratio") >= removal, "remove").otherwise("generalise").alias("value"))


def few(terms: DataFrame) -> DataFrame:
    """The terms, sent to all executors where they are few."""
    return F.broadcast(terms) if terms.count() <= FEW_TERMS else terms


def all_spans(df: DataFrame, text_col: str = "text", disclosure: float = 0.9, removal: float = 0.999) -> tuple[DataFrame, DataFrame, Column]:
    """The lines that can hold spans, the spans of the base kinds and of the disclosing terms, and whether a row's text
    can have any. Lines and base spans are written once, for each distinct text."""
    key = ["text_key", "line_no"]
    text = F.col(text_col)
    lines = materialise(lines_of(suspects(df, text_col)), "pii-lines")
    base = materialise(base_spans(lines), "pii-base")
    terms = materialise(free_terms(lines.join(base.select(*key).distinct(), key, "left_semi"), base), "pii-terms")
    told = materialise(disclosing_terms(df, terms, base, text_col, disclosure, removal), "pii-told")
    spans = base.drop("line_hash", "class")
    if told.isEmpty():
        return lines, spans, suspect(text)
    sent = few(told)
    # texts without @ and digits that say a disclosing term
    others = df.where(~suspect(text)).select(F.sha2(text, 256).alias("text_key"), text.alias("text"))
    tell = others.select(*said_in("text", F.col("text_key"))).select("text_key", F.lower("word").alias("term")).join(sent, "term", "left_semi").select("text_key").distinct()
    more = materialise(lines_of(others.join(tell, "text_key", "left_semi").dropDuplicates(["text_key"])), "pii-more")
    # and all lines without base spans
    rest = lines.join(base.select(*key).distinct(), key, "left_anti").unionByName(more)
    tell = rest.select(*said_in("line", *map(F.col, key))).select(*key, F.lower("word").alias("term")).join(sent, "term", "left_semi").select(*key).distinct()
    words = with_matches(rest.join(tell, key, "left_semi"), {"term": TERM}, [*key, "at"]).withColumn("term", F.lower("match"))
    one = [*key, "at", "start", "end", "term"]
    hit = words.select(*one).unionByName(terms.select(*one)).join(sent, "term")
    hit = hit.select(*key, "at", F.lit("term").alias("kind"), F.lit(len(PROTECTED)).alias("k"), "start", "end", "value")
    return lines.unionByName(more), spans.unionByName(hit), F.coalesce(text.rlike(r"[@0-9]|\p{L}{3}"), F.lit(False))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term for each row; spans are kind:start:end
    in code points: the base kinds', then secrets, then terms.

    * Null texts count as empty, which have no spans: counts 0, the digest of the empty string, spans empty.
    * Repeated rows and rows of one id each get their row, with the spans of their text.
    * Kinds are told apart even where their spans overlap. Spans of one kind that start alike can't be (no ties).
    * Very long texts are read whole, line by line.
    * No rows in, no rows out. Only the two columns named are read.
    """
    could = F.lit(True)

    def by_text() -> DataFrame:
        nonlocal could
        _, spans, could = all_spans(df, text_col, **options)
        return told_of(spans)

    found = finished(df.sparkSession, by_text, "pii-found")  # a table, so that the join's hot texts can be split
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    met = df.where(could).select(doc_id, F.sha2(text_col, 256).alias("text_key")).join(found, "text_key", "left")
    rest = df.where(~could).select(doc_id)
    none = {f"n_{x}": F.lit(0).cast("long") for x in KINDS} | {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")} | {f"n_{x}": F.lit(0).cast("long") for x in ("secret", "term")}
    return met.select("doc_id", *(F.coalesce(c, x).alias(c) for c, x in none.items())).unionByName(rest.select("doc_id", *(x.alias(c) for c, x in none.items())))


def told_of(spans: DataFrame) -> DataFrame:
    """text_key and what ``find`` says of the text."""
    start, end = F.col("at") + F.col("start"), F.col("at") + F.col("end")
    said = F.struct("k", start.alias("s"), F.concat_ws(":", "kind", start, end).alias("said"))
    joined = lambda least: F.array_join(F.transform(F.filter("all", lambda x: x["k"] < least), lambda x: x["said"]), ",")
    counts = [F.count_if(F.col("kind") == name).alias(f"n_{name}") for name in (*KINDS, "secret", "term")]
    by_text = spans.groupBy("text_key").agg(*counts, F.array_sort(F.collect_list(said)).alias("all"))
    return by_text.select("text_key", *(f"n_{x}" for x in KINDS), F.sha2(joined(len(KINDS)), 256).alias("base_sha256"), joined(len(PROTECTED) + 1).alias("spans"), "n_secret", "n_term")


def sanitise(df: DataFrame, text_col: str = "text", **options: float) -> DataFrame:
    """The rows of ``df`` with each span of ``text_col`` replaced: protected kinds by their name in capitals and
    brackets, generalised terms by [TERM], removed ones by nothing. Overlapping spans are replaced together, under the
    first's name. Rows without spans (nulls, empty texts) stay as they are; so do all other columns, whatever their names.
    Repeated rows and equal texts are changed alike. No rows in, no rows out."""
    key, (clean, clean_key, text_key) = ["text_key", "line_no"], fresh(df, "clean", "clean_key", "text_key")
    could = F.lit(True)

    def by_text() -> DataFrame:
        nonlocal could
        lines, spans, could = all_spans(df, text_col, **options)
        return cleaned_texts(lines, spans).select(F.col("text_key").alias(clean_key), F.col("clean").alias(clean))

    texts = finished(df.sparkSession, by_text, "pii-clean")
    met = df.where(could).withColumn(text_key, F.sha2(F.col(text_col), 256)).join(texts, F.col(text_key) == F.col(clean_key), "left")
    cleaned = met.select(*(F.coalesce(F.col(clean), F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in df.columns))
    return cleaned.unionByName(df.where(~could))


def cleaned_texts(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """text_key and clean: the texts that have spans, with these replaced."""
    key = ["text_key", "line_no"]
    by = W.partitionBy(*key).orderBy("start", "k")
    ahead = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    groups = spans.withColumn("first", (ahead.isNull() | (ahead <= F.col("start"))).cast("int")).withColumn("g", F.sum("first").over(by.rowsBetween(W.unboundedPreceding, 0)))
    name = F.when(F.col("kind") != "term", F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).when(F.col("value") == "remove", "").otherwise("[TERM]")
    whole = groups.groupBy(*key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(name, F.struct("start", "k")).alias("name"))
    # what stands before each replacement, and what is left after the last
    previous = F.coalesce(F.lag("end").over(W.partitionBy(*key).orderBy("start")), F.lit(0)).alias("previous")
    last = F.lead("start").over(W.partitionBy(*key).orderBy("start")).isNull().alias("last")
    met = whole.select("*", previous, last).join(lines, key)
    slice_of = lambda a, n: F.substring(F.col("line"), (a + 1).cast("int"), n.cast("int"))
    part = F.concat(slice_of(F.col("previous"), F.col("start") - F.col("previous")), "name", F.when(F.col("last"), slice_of(F.col("end"), F.length("line"))).otherwise(""))
    cut = met.select(*key, "start", part.alias("part"))
    in_order = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("_v")))), lambda x: x["_v"])
    changed = cut.groupBy(*key).agg(F.array_join(in_order("start", F.col("part")), "").alias("clean"))
    parts = lines.join(changed.select("text_key").distinct(), "text_key", "left_semi").join(changed, key, "left")
    return parts.groupBy("text_key").agg(F.array_join(in_order("line_no", F.coalesce("clean", "line")), "\n").alias("clean"))
