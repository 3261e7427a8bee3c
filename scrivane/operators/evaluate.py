"""Evaluation as relational algebra: samples, confusion counts, scores, tag runs, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified_sample(df: DataFrame, labels: list[str], order: str, n: int) -> DataFrame:
    """About n rows: of each combination of labels its share, at least one, the first by `order`; then the first n, in the order in which
    the combinations appear."""
    total = df.count()
    strata = df.groupBy(*labels).agg(F.count("*").alias("_g"), F.min(order).alias("_first"))
    quota = F.greatest(F.lit(1), F.ceil(F.lit(n) * F.col("_g") / F.lit(max(total, 1))))
    ranked = df.join(F.broadcast(strata), labels).withColumn("_k", F.row_number().over(Window.partitionBy(*labels).orderBy(order)))
    # No quota exceeds n, and that constant lets tasks cut their strata before the shuffle.
    return ranked.where((F.col("_k") <= n + 1) & (F.col("_k") <= quota)).orderBy("_first", "_k").limit(n).select(*df.columns)


def long_predictions(df: DataFrame, labels: list[str]) -> DataFrame:
    """Wide (x, pred_x) columns as rows (label, actual, predicted); a missing prediction is negative."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).cast("int").alias("actual"), F.coalesce(F.col(f"pred_{x}").cast("int"), F.lit(0)).alias("predicted")) for x in labels]))
    return df.select(pairs.alias("r")).select("r.*")


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Counts tp, fp, fn, tn of (actual, predicted) by key: one shuffle of partial counts."""
    a, p = F.col("actual") == 1, F.col("predicted") == 1
    cells = {"tp": a & p, "fp": ~a & p, "fn": a & ~p, "tn": ~a & ~p}
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in cells.items()])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f_beta(beta: float = 1.0) -> Column:
    p, r, b = precision(), recall(), beta * beta
    return _ratio((1 + b) * p * r, b * p + r)


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, F5, accuracy and support beside the counts, to four places."""
    cols = {"precision": precision(), "recall": recall(), "f1": f_beta(), "f5": f_beta(5.0), "accuracy": _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))}
    return counts.withColumns({k: F.round(v, 4) for k, v in cols.items()} | {"support": F.col("tp") + F.col("fn")})


def macro_micro(counts: DataFrame) -> DataFrame:
    """One row each: macro (mean of the rounded scores of the keys) and micro (scores of the summed counts)."""
    names = ["precision", "recall", "f1"]
    macro = scores(counts).agg(*[F.round(F.avg(c), 4).alias(c) for c in names]).select(F.lit("macro").alias("average"), *names)
    micro = scores(counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])).select(F.lit("micro").alias("average"), *names)
    return macro.unionByName(micro)


def auc(df: DataFrame, label: str, score: str, *by: str, buckets: int = 200) -> DataFrame:
    """Area under the ROC curve by key, ties counted half.

    Scores are first counted. Running sums then go over distinct scores within a bucket of scores, and over at most `buckets` buckets a key, so
    no task sees all distinct scores. The bounds of the buckets are approximate quantiles; they don't affect the result.
    """
    keys = list(by)
    hist = df.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    cuts = sorted(set(hist.agg(F.percentile_approx("_s", [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []))
    hist = hist.withColumn("_b", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("_s"))))
    totals = hist.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    part = hist.join(totals, [*keys, "_b"]).withColumn("won", F.col("p") * (below + F.col("n") / 2))
    return part.groupBy(*keys).agg(_ratio(F.sum("won"), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def token_offsets(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens (key, i, token) with the places they have when joined by one space."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("token") + 1).over(w), F.lit(0)).cast("int")
    return tokens.withColumn("start", start).withColumn("end", (start + F.length("token")).cast("int"))


def tag_runs(tokens: DataFrame, key: str) -> DataFrame:
    """Maximal runs of one non-zero tag: (key, tag, first, last, start, end)."""
    w, v = Window.partitionBy(key).orderBy("i"), Window.partitionBy(key, "tag").orderBy("i")
    island = F.row_number().over(w) - F.row_number().over(v)
    return tokens.withColumn("_island", island).where("tag <> 0").groupBy(key, "tag", "_island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


#: Width of the bins of positions by which intervals meet.
BIN = 256


def _binned(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """A row for each bin that [start, end) touches; an empty interval has its position's."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / BIN))))


def overlaps(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rows of `a` with those of `b` of the same key whose [start, end) meets theirs. how: inner, left_semi or left_anti.

    Pairs meet in bins of positions, each pair in that of the greater start, so that a long document isn't one quadratic task. For left_semi and
    left_anti no pairs are made: in the order of positions, an interval is met if the greatest end among those that start before its own end
    exceeds its start.
    """
    if how == "inner":
        b = b.select(*[F.col(c).alias(c if c == key else f"b_{c}") for c in b.columns])
        pairs = _binned(a, "start", "end", "_bin").join(_binned(b, "b_start", "b_end", "_bin"), [key, "_bin"])
        touch = (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start")) & (F.col("_bin") == F.floor(F.greatest("start", "b_start") / BIN))
        return pairs.where(touch).select(*a.columns, *[c for c in b.columns if c != key])
    row = F.struct(*a.columns)
    one = a.select(F.col(key).alias("_key"), row.alias("_row"), F.col("end").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(b.schema["end"].dataType).alias("_end"))
    two = b.where(F.col(key).isNotNull() & F.col("start").isNotNull()).select(F.col(key).alias("_key"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.col("start").alias("_at"), F.lit(1).alias("_side"), F.col("end").alias("_end"))
    reach = F.max("_end").over(Window.partitionBy("_key").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    met = F.coalesce(F.col("_reach") > F.col("_row.start"), F.lit(False))
    found = one.unionByName(two).withColumn("_reach", reach).where("_side = 0")
    return found.where(met if how == "left_semi" else ~met).select("_row.*")


#: Patterns of single tokens, the first that matches wins.
TOKEN_KINDS = (("EMAIL", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), ("PHONE", r"^[+]\([0-9]{3}\)[0-9]{3}-[0-9]{4}$"), ("ZIP", r"^[0-9]{5}(-[0-9]{4})?$"), ("ACCOUNT", r"^\d{6,12}$"))


def type_tokens(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens with the kind their text shows, if any; digits up to three tokens after GSTIN have none."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(TOKEN_KINDS):
        kind = F.when(F.col("token").rlike(pattern), name).otherwise(kind)
    w = Window.partitionBy(key).orderBy("i")
    after = F.lit(False)
    for k in (1, 2, 3):
        after = after | F.coalesce(F.upper(F.lag("token", k).over(w)).contains("GSTIN"), F.lit(False))
    return tokens.withColumn("kind", F.when(~(after & (kind == "ACCOUNT")), kind).otherwise(F.when(after & (kind == "ACCOUNT"), F.lit(None)).otherwise(kind)))


def region_scores(truth: DataFrame, hits: DataFrame, key: str, exempt_tag: int = 13) -> DataFrame:
    """tp, fn, fp by kind. truth: (key, region, tag, start, end, kinds); hits: (key, kind, start, end).

    A kind of a region is found if any hit of the kind meets the region. A kind that hits have in a region but truth hasn't is a false
    positive, save addresses and names in regions of the exempt tag; so is every hit that meets no region.
    """
    want = truth.select(key, "region", F.explode("kinds").alias("kind"))
    met = overlaps(hits, truth, key)
    have = met.select(key, F.col("b_region").alias("region"), "kind", F.col("b_tag").alias("tag")).distinct()
    found = want.join(have.select(key, "region", "kind", F.lit(1).alias("hit")), [key, "region", "kind"], "left")
    by_truth = found.groupBy("kind").agg(F.count_if(F.col("hit") == 1).alias("tp"), F.count_if(F.col("hit").isNull()).alias("fn"))
    spare = have.join(want, [key, "region", "kind"], "left_anti").where(~((F.col("tag") == exempt_tag) & F.col("kind").isin("ADDRESS", "NAME")))
    outside = overlaps(hits, truth, key, "left_anti")
    false = spare.select("kind").unionAll(outside.select("kind")).groupBy("kind").agg(F.count("*").alias("fp"))
    return by_truth.join(false, "kind", "full").na.fill(0).select("kind", *[F.col(c).cast("long").alias(c) for c in ("tp", "fn", "fp")])


ADDRESS_SIGNS = (
    r"(?i)\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd|way|court|ct|place|pl)\b", r"\b[A-Z]{2}\s+\d{5}\b", r"(?i)\bp\.?\s?o\.?\s?box\b", r"(?i)\b(apt|suite|ste|unit)\b",
    r"\b[0-9]{1,5}\s+\p{Lu}\p{Ll}+", r"(?i)\b(north|south|east|west)\b", r"\bUS\b",
)


def has_address_sign(text: Column, start: Column, end: Column, reach: int = 50) -> Column:
    """Whether any address pattern occurs within `reach` characters of [start, end)."""
    near = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, end - start + 2 * reach)
    out = F.lit(False)
    for p in ADDRESS_SIGNS:
        out = out | near.rlike(p)
    return out


def is_invoice_number(text: Column, start: Column, reach: int = 25) -> Column:
    """Whether the characters before `start` end with an invoice prefix or hold GSTIN."""
    at = F.greatest(start - reach, F.lit(0))
    before = F.substring(text, at + 1, start - at)
    return before.rlike(r"(?i)(invoice|inv|no|number|#)[\s:.#-]*$") | before.rlike("(?i)gstin")


def counts_by_kind(hits: DataFrame, key: str, docs: int) -> DataFrame:
    """Hits, documents with hits, and hits a document, by kind."""
    return hits.groupBy("kind").agg(F.count("*").alias("hits"), F.countDistinct(key).alias("docs")).withColumn("per_doc", F.round(F.col("hits") / F.lit(max(docs, 1)), 6))


def samples(df: DataFrame, by: str, order: str, cap: int) -> DataFrame:
    """At most `cap` rows a key, the first by `order`: a report for people."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_k") <= cap).drop("_k")


def label_shares(df: DataFrame, labels: list[str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).cast("long").alias("v")) for x in labels]))
    return df.select(rows.alias("r")).groupBy("r.label").agg(F.sum("r.v").alias("positives"), F.round(100 * F.avg("r.v"), 4).alias("percent"))


def fold_ids(df: DataFrame, strata: list[str], order: str, k: int) -> DataFrame:
    """Fold numbers 0 .. k - 1, dealt in turn within each stratum."""
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(*strata).orderBy(order)) - 1) % k).cast("int"))


def hold_out(df: DataFrame, key: str, percent: int = 20) -> DataFrame:
    """A column `held_out` from the MD5 sum of the key: no sort and no shuffle, and every stratum is split alike."""
    return df.withColumn("held_out", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100)) < percent)


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, least and greatest value of each metric over folds."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    return folds.select(rows.alias("r")).groupBy("r.metric").agg(F.avg("r.v").alias("mean"), F.stddev_samp("r.v").alias("std"), F.min("r.v").alias("min"), F.max("r.v").alias("max"))
