"""Secret scans (operator 4), in DataFrame functions only.

Method: an incremental ledger of blobs.  Every historical version of every path is addressed by the SHA-256 of
its text.  Only pairs of a blob and a rule version that the ledger lacks are scanned, so copies are scanned once
and a new rule version rescans with that rule alone.  Findings stay with the blob and are joined back to all
paths that ever held it.

Spans are in code points, end exclusive.  Matches are leftmost and do not overlap within a kind; a match that
fails its rule's length test is dropped after matching.  Null texts count as empty.  Repeated rows and keys give
a row each; null keys are kept; extra columns are carried or ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # whose length is tested
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    # A run is matched whole, so asking for its length in the pattern drops just the matches that are too short.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
EXTRA = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("hubtoken", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chattoken", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE + EXTRA
BLOCK = 256  # matches walked at a time
SPAN = "struct<no:int,kind:string,key:string,start:int,end:int>"  # key: kind and version of the rule that found it


def no_spans() -> Column:
    """An empty list; made on call, as a column needs a session."""
    return F.expr(f"cast(array() as array<{SPAN}>)")


def spans_of(text: Column, rule: Rule, no: int) -> Column:
    """Spans of one rule.  Splitting by the pattern gives the texts between the matches, hence their places.

    Matches are walked in blocks of BLOCK, since a list that grows by one is copied each time: a fold over the
    blocks' lengths gives where each begins, and a fold within each block its spans.
    """
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, 0), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length).alias("tested"),
    )
    whole = lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(F.lit(no).alias("no"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("key"), begin.alias("start"), end.alias("end"))
        good = F.coalesce(x["tested"] >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def blocks(matches: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda i: F.slice(matches, i * BLOCK + 1, BLOCK))
        return F.transform(cut, lambda part: F.struct(part.alias("part"), F.aggregate(part, F.lit(0), lambda n, x: n + whole(x)).alias("length")))

    def places(cut: Column) -> Column:
        """Where each block begins, itself in blocks for texts of very many matches."""
        starts = F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")), lambda acc, c: F.struct((acc["at"] + c["length"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
        return F.zip_with(cut, starts, lambda c, at: F.aggregate(c["part"], F.struct(at.alias("at"), no_spans().alias("spans")), step)["spans"])

    # each step is bound to a variable of its own, so that none is worked out twice
    bound = lambda value, then: F.transform(F.array(value), then)[0]
    return F.when(text.rlike(rule.pattern), bound(found, lambda m: bound(blocks(m), lambda c: F.flatten(places(c))))).otherwise(no_spans())


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def new_findings(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Ledger rows (blob_id, scanned rule versions, spans) of the pairs that the ledger lacks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(blob_id(text).alias("blob_id"), text.alias("blob_text")).groupBy("blob_id").agg(F.first("blob_text").alias("blob_text"))
    todo = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        blobs = blobs.withColumn("todo", todo)
    else:
        seen = ledger.select("blob_id", F.explode("scanned").alias("rule")).groupBy("blob_id").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob_id", "left").withColumn("todo", F.array_except(todo, F.coalesce("seen", F.expr("cast(array() as array<string>)")))).where(F.size("todo") > 0)
    each = [F.when(F.array_contains("todo", r.key), spans_of(F.col("blob_text"), r, i)).otherwise(no_spans()) for i, r in enumerate(rules)]
    return blobs.select("blob_id", F.col("todo").alias("scanned"), F.concat(*each).alias("spans"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The ledger with what it lacked."""
    new = new_findings(versions, ledger, text_col, rules)
    return new if ledger is None else ledger.select("blob_id", "scanned", "spans").unionByName(new)


def by_path(versions: DataFrame, ledger: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Every version's row with the spans, by start, that current rule versions found in its blob, as secret_spans.

    A column secret_spans of the rows is replaced; all others are carried, whatever their names.
    """
    found = ledger.where(F.size("spans") > 0).select("blob_id", "spans")
    merged = found.groupBy("blob_id").agg(F.flatten(F.collect_list("spans")).alias("secret_spans"))
    keys = [r.key for r in rules]
    order = F.transform(
        F.array_sort(F.transform(F.filter("secret_spans", lambda s: s["key"].isin(keys)), lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s["kind"].alias("kind"), s["key"].alias("key")))),
        lambda s: F.struct(s["no"], s["kind"], s["key"], s["start"], s["end"]),
    )
    # A key of its own gives the findings an exchange of their own, so that Spark can split the paths of a frequent blob.
    merged = merged.select(F.concat("blob_id", F.lit("")).alias("blob_key"), order.alias("spans"))
    # the row is carried as one value, so that no name of its columns can clash
    packed = versions.select(F.struct("*").alias("row"), blob_id(F.col(text_col)).alias("blob_key"))
    joined = packed.join(merged, "blob_key", "left").select("row", F.coalesce("spans", no_spans()).alias("secret_spans"))
    return joined.select(*(F.col("row")[c].alias(c) for c in versions.columns if c != "secret_spans"), "secret_spans")


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(versions: DataFrame, text_col: str = "text", put: str = "[secret]") -> DataFrame:
    """The rows, with all their columns, with every secret of their text replaced."""
    # the row is carried as one value, so that no name of its columns can clash
    packed = versions.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    got = by_path(packed, new_findings(packed))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        head = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(put))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, head).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rebuilt = F.concat(done["out"], F.substring("text", done["at"] + 1, F.length("text")))
    text = F.when(F.size("secret_spans") > 0, rebuilt).otherwise(F.col("text"))
    return got.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in versions.columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, and digest and list of spans, for every row."""
    paths = docs.select(F.col(id_col), F.col(text_col))
    got = by_path(paths, new_findings(paths, None, text_col), text_col)
    base = F.filter("secret_spans", lambda s: s["no"] < len(BASE))
    count = lambda no: F.size(F.filter("secret_spans", lambda s: s["no"] == no)).cast("long")
    return got.select(
        id_col, *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secret_spans")).alias("spans")
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
