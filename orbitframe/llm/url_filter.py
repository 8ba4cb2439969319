"""URL filters (operator 3), in DataFrame functions only.

Method: two smoothed variable-order Markov models of characters, one fitted to the URLs that rules accept and
one to those that rules reject.  A URL that no rule fits is judged by the difference of its log-likelihoods per
character against a calibrated threshold.  For that each of five folds of the ruled URLs is scored by models of the
other four (all counts less its own), and the threshold keeps most of both classes of these scores; open URLs are scored by models of all ruled
URLs.  A fold without which a class is missing is not scored, and without any scores the threshold is 0.

Each context of up to three characters keeps its counts of following characters; the longest context is
interpolated with shorter ones (Witten-Bell), down to a uniform distribution.
Each distinct URL is scored once and joined back to its rows; the ratios of what follows each context are broadcast
if they are few, else joined.  Scores are whole millionths, so sums don't
depend on their order.

Null URLs and those without "://" have an empty host and path and fit no rule; they are scored as empty texts, that
is by the ratio of ending where a URL begins.  Repeated rows and null ids are kept; an empty table gives an empty
result; without URLs of both classes every open URL is allowed.  Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.shared import checkpointed

CONTEXT = 3
BINS = 200  # of the calibration's scores, from -BINS/20 to BINS/20 nats per character
UNIFORM = 1 / 256
FOLDS = 5
RATIO_ROWS = 200_000  # pairs of a context and a character that are broadcast at most, some 30 MB


class UrlRule(NamedTuple):
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [UrlRule("com", "/", "allow"), UrlRule("example.com", "/en/", "block"), UrlRule("www.example.com", "/en/", "allow"), UrlRule("net", "/es/", "block"), UrlRule("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[UrlRule] = RULES, value: str = "name") -> Column:
    """Name or action of the longest rule that fits, else null."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, value))) for r in sorted(rules, key=lambda r: -len(r.name))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def grams(urls: DataFrame) -> DataFrame:
    """One row per character of a URL: its context and itself; the end counts as a character."""
    padded = F.concat(F.lit("\x02" * CONTEXT), "tail", F.lit("\x03"))
    places = F.explode(F.sequence(F.lit(1), F.length("tail") + 1)).alias("at")
    return urls.select("*", padded.alias("padded"), places).select("*", F.substring("padded", F.col("at"), F.lit(CONTEXT)).alias("context"), F.substring("padded", F.col("at") + CONTEXT, F.lit(1)).alias("next"))


def models(train: DataFrame) -> list[DataFrame]:
    """For each context length, a row per context with counts of what follows, by class.

    train has tail, class, n and fold.  Counts are arrays: at a fold's place those of all other folds, at the last place
    those of all.
    """
    c = F.col
    counts = grams(train).groupBy("context", "next").agg(*(F.sum(F.when((c("class") == kind) & (c("fold") == f), c("n")).otherwise(0)).alias(f"{x}{f}") for x, kind in (("a", "allow"), ("b", "block")) for f in range(FOLDS)))
    out = []
    for k in range(CONTEXT + 1):
        part = counts.groupBy(F.right("context", F.lit(k)).alias(f"c{k}"), "next").agg(*(F.sum(f"{x}{f}").alias(f"{x}{f}") for x in "ab" for f in range(FOLDS)))
        whole = {x: sum((c(f"{x}{f}") for f in range(FOLDS)), F.lit(0)) for x in "ab"}
        part = part.select(f"c{k}", "next", *(F.array(*(whole[x] - c(f"{x}{f}") for f in range(FOLDS)), whole[x]).alias(x) for x in "ab"))
        row = part.groupBy(f"c{k}").agg(
            F.map_from_entries(F.collect_list(F.struct("next", F.struct("a", "b")))).alias(f"m{k}"),  # as many entries as there are characters at most
            *(F.array(*(F.sum(c(x)[v]) for v in range(FOLDS + 1))).alias(f"{x}n{k}") for x in "ab"),
            *(F.array(*(F.sum((c(x)[v] > 0).cast("long")) for v in range(FOLDS + 1))).alias(f"{x}t{k}") for x in "ab"),
        )
        out.append(row)
    return out


def scored(urls: DataFrame, train: DataFrame) -> DataFrame:
    """tail and score (millionths of nats per character) of distinct tails, each by the counts that its column counts_of names."""
    table = grams(urls.select("tail")).select("context", "next").distinct()
    for k, model in enumerate(models(train)):
        table = table.withColumn(f"c{k}", F.right("context", F.lit(k)))
        table = table.join(F.broadcast(model), f"c{k}", "left") if k == 0 else table.join(model, f"c{k}", "left")  # the empty context is one row
    variants = range(FOLDS + 1)
    p = {(x, v): F.lit(UNIFORM) for x in "ab" for v in variants}
    for k in range(CONTEXT + 1):
        for x, v in p:
            seen, n, kinds = F.coalesce(F.try_element_at(F.col(f"m{k}"), F.col("next"))[x][v], F.lit(0)), F.coalesce(F.col(f"{x}n{k}")[v], F.lit(0)), F.coalesce(F.col(f"{x}t{k}")[v], F.lit(0))
            p[x, v] = F.when(n > 0, (seen + kinds * p[x, v]) / (n + kinds)).otherwise(p[x, v])
        table = table.withColumns({f"p{x}{v}_{k}": p[x, v] for x, v in p})
        p = {(x, v): F.col(f"p{x}{v}_{k}") for x, v in p}
    ratio = table.select("context", "next", F.array(*(F.round(1e6 * (F.ln(p["a", v]) - F.ln(p["b", v]))).cast("long") for v in variants)).alias("ratio"))
    ratio = checkpointed(ratio)
    small = ratio.count() <= RATIO_ROWS  # a frequent context has many characters, which a join by context would gather
    each = grams(urls.select("tail", "counts_of")).select("tail", "counts_of", "context", "next").join(F.broadcast(ratio) if small else ratio, ["context", "next"])
    return each.groupBy("tail").agg((F.sum(F.col("ratio")[F.col("counts_of")]) / F.count("*")).alias("score"))


def threshold(held: DataFrame) -> float | None:
    """The score from which accepting keeps most of both classes; None without both."""
    at = F.greatest(F.least(F.floor(F.col("score") / 1e5), F.lit(BINS)), F.lit(-BINS)).cast("int")
    rows = held.groupBy(at.alias("bin")).agg(F.sum(F.when(F.col("class") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("class") == "block", F.col("n")).otherwise(0)).alias("b")).collect()
    a, b = {r.bin: r.a for r in rows}, {r.bin: r.b for r in rows}
    if not sum(a.values()) or not sum(b.values()):
        return None
    gain = {t: sum(v for k, v in a.items() if k >= t) / sum(a.values()) + sum(v for k, v in b.items() if k < t) / sum(b.values()) for t in range(-BINS, BINS + 2)}
    best = max(gain.values())
    good = [t for t in gain if gain[t] == best]
    return 1e5 * min(good, key=abs)


def usable_folds(present: list) -> list[int]:
    """The folds of ruled URLs without which both classes are still there."""
    of = lambda kind: {r["fold"] for r in present if r["class"] == kind}
    a, b = of("allow"), of("block")
    return sorted(k for k in a | b if a - {k} and b - {k})


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[UrlRule] = RULES) -> DataFrame:
    """id, host, path, rule and verdict of every row."""
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://(.*)$", 1), F.lit("")).alias("rest"))
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "ruled": rule_of(F.col("host"), F.col("path"), rules, "action")})
    rows = rows.withColumn("tail", F.concat("host", F.regexp_extract("rest", r"(?s)^[^/?#]*(.*)$", 1)))
    tails = checkpointed(rows.groupBy("tail", F.col("ruled").alias("class")).agg(F.count("*").alias("n")))
    fold = F.pmod(F.xxhash64("tail"), F.lit(FOLDS))
    ruled = F.col("class").isNotNull()
    tails = tails.withColumn("fold", fold).withColumn("counts_of", F.when(ruled, F.col("fold")).otherwise(FOLDS).cast("int"))
    present = tails.where(ruled).select("fold", "class").distinct().collect()
    if {r["class"] for r in present} != {"allow", "block"}:
        return rows.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    got = checkpointed(tails.select("tail", "class", "n", "fold").join(scored(tails, tails.where(ruled)), "tail"))
    limit = threshold(got.where(ruled & F.col("fold").isin(usable_folds(present))))
    found = got.where(~ruled).select("tail", F.when(F.col("score") >= (limit or 0.0), "allow").otherwise("block").alias("guess"))
    return rows.join(found, "tail", "left").select(id_col, "host", "path", "rule", F.coalesce("ruled", "guess", F.lit("allow")).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
