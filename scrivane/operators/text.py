"""Scanning and tagging of text columns: one Arrow-batched pass over the text, or column expressions where these suffice."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crf, pii, runs

HIT = "struct<kind: string, text: string, start: int, end: int>"
_STRUCT = pa.struct([("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scanner(model: crf.Model | None):
    """Hits of some texts at once."""
    if model is None:
        return lambda texts: map(pii.scan, texts)
    return lambda texts: map(pii.scan, texts, crf.decode_all(model, texts))


def pii_hits(df: DataFrame, key: str, text: str = "text", model: crf.Model | None = None, folded: bool = True) -> DataFrame:
    """(key, seq, kind, text, start, end): a row a hit, offsets in bytes. seq numbers the hits of a row after the fold.

    Only the two columns reach Python, in Arrow batches; nothing is shuffled. Null texts have no hits.
    """
    find = _scanner(model) if folded else lambda texts: map(pii.raw_hits, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in runs.slices(whole, 1, TAGGED_BYTES)):
            at, seq, hits = [], [], []
            for k, found in enumerate(find(batch.column(1).to_pylist())):
                for n, h in enumerate(found):
                    at.append(k)
                    seq.append(n)
                    hits.append(h)
            kind, said, start, end = zip(*hits, strict=True) if hits else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(seq, pa.int32()), pa.array(kind, pa.string()), pa.array(said, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                [key, "seq", "kind", "text", "start", "end"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, seq int, kind string, text string, start int, end int")


def with_hits(df: DataFrame, text: str = "text", column: str = "pii", model: crf.Model | None = None) -> DataFrame:
    """df with an array of hits a row."""
    find = _scanner(model)

    @F.pandas_udf(f"array<{HIT}>")
    def scan(texts):
        return pd.Series([[dict(zip(("kind", "text", "start", "end"), h, strict=True)) for h in found] for found in find(list(texts))])

    return df.withColumn(column, scan(F.col(text)))


def register_functions(spark: SparkSession, model: crf.Model | None = None) -> None:
    """SQL functions: scan_pii(text), an array of hits for inline(), and luhn_valid(text)."""
    find = _scanner(model)

    @F.pandas_udf(f"array<{HIT}>")
    def scan_pii(texts):
        return pd.Series([[dict(zip(("kind", "text", "start", "end"), h, strict=True)) for h in found] for found in find(list(texts))])

    spark.udf.register("scan_pii", scan_pii)


def _runs(df: DataFrame, key: str, text: str, member: np.ndarray, number: str, said: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs.slices(batch, 1):
                r = runs.Runs(part.column(1), member)
                columns = [part.column(0).take(pa.array(r.row)), pa.array(r.place(), pa.int32()), r.said.cast(pa.string()), pa.array(r.start, pa.int32()), pa.array(r.end, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [key, number, said, "start", "end"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, {number} int, {said} string, start int, end int")


def digit_runs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, run, start, end): maximal digit runs with byte offsets, numbered within their row.

    Whole batches are searched at once over their bytes; nothing is shuffled, and rows that share a key are numbered apart.
    """
    return _runs(df, key, text, runs.DIGIT, "n", "run")


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, i, word, start, end): tokens between ASCII white space, with byte offsets, numbered within their row as in digit_runs."""
    return _runs(df, key, text, runs.NOT_BLANK, "i", "word")


def shape(word: Column) -> Column:
    """The first ten characters as A, a, 0 or -."""
    s = F.substring(word, 1, 10)
    for pattern, to in ((r"[^\p{Lu}\p{Ll}0-9]", "-"), (r"\p{Lu}", "A"), (r"\p{Ll}", "a"), ("[0-9]", "0")):
        s = F.regexp_replace(s, pattern, to)
    return s


def neighbours(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, i, word, low, before1, before2, after1, after2, shape): tokens with the lower-cased words one and two places away; ends are marked.

    All of a row's words are in one array, so that nothing is shuffled or put in order.
    """
    words = df.select(key, F.expr(rf"regexp_extract_all(`{text}`, '[^ \\t\\n\\f\\r]+', 0)").alias("_words"))
    low = F.transform("_words", lambda w: F.when(F.octet_length(w) <= 20, F.lower(w)).otherwise("__LONG__"))
    words = words.select(key, "_words", low.alias("_low"))
    near = lambda i, k: F.coalesce(F.get("_low", i + k), F.lit("__BOS__" if k < 0 else "__EOS__")).alias(f"{'before' if k < 0 else 'after'}{abs(k)}")
    rows = F.transform("_words", lambda w, i: F.struct(w.alias("word"), F.get("_low", i).alias("low"), *[near(i, k) for k in (-1, -2, 1, 2)]))
    out = words.select(key, F.posexplode(rows).alias("i", "t")).select(key, "i", "t.*")
    return out.withColumn("shape", shape(F.col("word")))


def emissions(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Per (doc, token, label) the summed weights of features (key, i, feature) that the model (feature, label, w) knows."""
    return features.join(weights, "feature").groupBy("key", "i", "label").agg(F.sum("w").alias("score"))


def token_emissions(tokens: DataFrame, features: str, weights: Iterable[tuple[str, str, float]]) -> DataFrame:
    """emissions() of tokens whose features are an array in one row: the columns but `features`, with a row a label and its score.

    Weights (feature, label, w) are few, as they are looked up in a literal one after the other; nothing is joined, grouped or shuffled, so a task
    keeps one token.
    """
    of: dict[str, list[Column]] = defaultdict(list)
    for feature, label, w in weights:
        of[feature].append(F.struct(F.lit(label).alias("label"), F.lit(float(w)).alias("w")))
    known = F.create_map(*[c for name, entries in of.items() for c in (F.lit(name), F.array(*entries))])
    found = F.flatten(F.transform(F.filter(features, lambda f: f.isin(list(of))), lambda f: F.element_at(known, f)))
    rest = [c for c in tokens.columns if c != features]
    some = tokens.where(F.arrays_overlap(features, F.array(*map(F.lit, of)))).select(*rest, found.alias("_found"))
    summed = lambda x: F.aggregate(F.filter("_found", lambda e: e["label"] == x), F.lit(0.0), lambda total, e: total + e["w"])
    labels = F.array_distinct(F.transform("_found", lambda e: e["label"]))
    return some.select(*rest, F.inline(F.transform(labels, lambda x: F.struct(x.alias("label"), summed(x).alias("score")))))


#: Bytes of text that are tagged at once: a byte of text takes some eighty of arrays.
TAGGED_BYTES = 1 << 20
#: Bytes of text whose tokens' features are made at once: a token has some forty names.
NAMED_BYTES = 64 << 10


def feature_names(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, i, feature): all features of all tokens. A batch has those of a few texts, so that a worker's memory is bounded by its longest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs.slices(batch, 1, NAMED_BYTES):
                at, place, names = [], [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    words = [w for w, _, _ in crf.tokenize(t or "")]
                    for i in range(len(words)):
                        found = crf.token_features(words, i)
                        at += [k] * len(found)
                        place += [i] * len(found)
                        names += found
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(place, pa.int32()), pa.array(names, pa.string())], ["key", "i", "feature"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, i int, feature string")


def feature_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(feature, n): how often each feature name occurs. Slices of texts are counted as they come, so that names and counts are shuffled, not occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs.slices(batch, 0):
                r = runs.Runs(part.column(0), runs.NOT_BLANK)
                found = crf.count_features(r.said, r.bounds)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["feature", "n"])

    return df.select(F.col(text).cast("string")).mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def tag_tokens(df: DataFrame, key: str, model: crf.Model, text: str = "text") -> DataFrame:
    """(key, i, word, label): the best label path of each text, a row a token. Texts of a batch are decoded together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.labels, pa.string())
        for batch in batches:
            for part in runs.slices(batch, 1, TAGGED_BYTES):
                r = runs.Runs(part.column(1), runs.NOT_BLANK)
                path = crf.viterbi_all(model.emit(r.said, r.bounds), r.bounds, model.transitions)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r.row)), pa.array(r.place(), pa.int32()), r.said.cast(pa.string()), names.take(pa.array(path))], [key, "i", "word", "label"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, i int, word string, label string")
