"""Toxicity: boosted trees over a few dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import column, rows_out, slices, table
from riskflow.llm.labelled import SAMPLE, held_out, training_sample
from riskflow.session import freeze

# Insults of four languages: fixed values.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass fool loser losers trash garbage scum pathetic disgusting worthless clown clowns imbecile jerk bastard bitch asshole shit fuck fucking "
    "crap freak ugly vermin filth pig coward liar hate kill retard creep scumbag dimwit halfwit "
    "dumm dummkopf trottel arschloch scheisse abschaum versager schwachkopf depp widerlich ekelhaft "
    "imbécile crétin connard salope merde débile ordure abruti idiote con "
    "idiota estúpido estúpida imbécil tonto basura mierda cabrón puta asqueroso inútil escoria".split())
SECOND_PERSON = frozenset("you your yours yourself youre you're u ur du dich dir dein deine euch ihr tu toi te ton ta tes vous votre vos tú usted ustedes ti vosotros".split())
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…-*#%&$|"
REPEATED = re.compile(r"(.)\1{2,}")
#: Words between an insult and a second person that still belong together.
NEAR = 4
#: Words learnt from the labels at most, and the documents of label 1 each needs.
LEARNT = 256
MIN_DOCS = 5
#: Distinct words a worker remembers.
REMEMBERED = 400_000
FEATURES = ("insults", "insult_density", "learnt", "learnt_density", "learnt_most", "near_second_person", "second_person", "capitals", "exclamations", "questions", "obfuscation", "obfuscated_insults", "length")


class Words:
    """What each distinct word counts as: (insult, learnt weight, second person, capitals, obfuscated, obfuscated insult)."""

    def __init__(self, learnt: dict[str, float]):
        self.learnt, self.known = learnt, {}

    def __getitem__(self, word: str) -> tuple[bool, float, bool, bool, bool, bool]:
        if word not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            core = word.strip(EDGE)
            low = core.lower()
            letters = any(c.isalpha() for c in core)
            odd = letters and len(core) < 32 and (not core.isalpha() and "'" not in core or bool(REPEATED.search(low)))
            plain = REPEATED.sub(r"\1", low.translate(PLAIN)) if odd else low
            self.known[word] = (low in INSULTS, self.learnt.get(low, 0.0), low in SECOND_PERSON, len(core) > 2 and core.isupper(), odd, odd and plain != low and plain in INSULTS)
        return self.known[word]


def features(text: str | None, words: Words) -> list[float]:
    """The numbers in the order of ``FEATURES``; all from the text alone."""
    tokens = (text or "").split()
    n = len(tokens)
    kinds = [words[t] for t in tokens]
    insults = [i for i, k in enumerate(kinds) if k[0] or k[5] or k[1] > 2.0]
    second = [i for i, k in enumerate(kinds) if k[2]]
    near = 0
    if insults and second:
        at = np.searchsorted(np.array(second), np.array(insults))
        padded = np.array([-(10**9), *second, 10**9])
        near = int((np.minimum(np.array(insults) - padded[at], padded[at + 1] - np.array(insults)) <= NEAR).sum())
    plain, weights = sum(k[0] for k in kinds), [k[1] for k in kinds if k[1] > 0]
    m = max(1, n)
    return [float(plain), plain / m, sum(weights), sum(weights) / m, max(weights, default=0.0), float(near), len(second) / m, sum(k[3] for k in kinds) / m,
            (text or "").count("!") / m, (text or "").count("?") / m, sum(k[4] for k in kinds) / m, float(sum(k[5] for k in kinds)), math.log1p(n)]


def learn_words(sample: DataFrame, most: int = LEARNT, min_docs: int = MIN_DOCS) -> dict[str, float]:
    """Words that toxic documents of the sample hold far more often, with their cautious log-odds ratio."""
    schema = pa.schema([("word", pa.string()), ("label", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [(w, label) for text, label in zip(column(batch, "text"), column(batch, "label")) for w in {t.strip(EDGE).lower() for t in (text or "").split()} if w]
            yield rows_out(schema, zip(*out) if out else [[], []])

    total = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    ones, zeros = (float(x or 0) for x in total)
    counted = sample.select("text", "label").mapInArrow(work, "word string, label double").groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (F.lit(ones) - F.col("t") + 0.5)) - F.log(c / (F.lit(zeros) - F.col("c") + 0.5)) - 2 * F.sqrt(1 / t + 1 / c)
    best = counted.where(F.col("t") >= min_docs).select("word", odds.alias("weight")).where("weight > 0").orderBy(F.desc("weight"), "word").limit(most)
    return {r["word"]: r["weight"] for r in best.collect()}


def with_features(docs: DataFrame, learnt: dict[str, float], kept: list[str]) -> DataFrame:
    """``kept`` columns of ``docs`` (no text among them) and the vector ``features``."""
    own = docs.select(*kept, "text")
    fields = [f for f in own.schema if f.name in kept]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", x array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(learnt)
        for batch in slices(batches):
            made = pa.array([features(t, words) for t in column(batch, "text")], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], made], names=[*kept, "x"])

    return own.mapInArrow(work, ddl).select(*kept, array_to_vector("x").alias("features"))


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, rounds: int = 20, depth: int = 3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id``, ``text``), learnt from ``labels`` (``doc_id``, ``toxic``).

    Trees and learnt words come from at most ``sample_rows`` labelled rows outside the held-out fold; a third of them, by hash, is
    kept from the trees for the calibration. The text alone decides a score. Null and empty texts are scored like any. With no label, or one
    class alone, every score is that class's share (0.5 without labels). Repeated rows each get a row. An
    empty table gives an empty result.
    """
    sample = freeze(training_sample(docs, labels, F.col("toxic"), sample_rows).withColumn("fit", F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0))
    seen = {(r["fit"], r["label"]): r["n"] for r in sample.groupBy("fit", "label").agg(F.count("*").alias("n")).collect()}
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    flags = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if min(seen.get((True, 1.0), 0), seen.get((True, 0.0), 0)) == 0:
        all_, one = sum(seen.values()), sum(n for (_, label), n in seen.items() if label == 1.0)
        share = one / all_ if all_ else 0.5
        return flags.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    learnt = learn_words(sample.where("fit"))
    train = freeze(with_features(sample, learnt, ["label", "fit"]))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64).fit(train.where("fit"))
    margin = vector_to_array("probability")[1].alias("margin")
    calibration = trees.transform(train.where("not fit")).select("label", margin)
    if seen.get((False, 1.0), 0) and seen.get((False, 0.0), 0):
        curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(calibration)
    else:
        curve = None
    found = trees.transform(with_features(flags, learnt, ["doc_id", "held_out"])).select("doc_id", "held_out", margin)
    found = curve.transform(found) if curve else found.withColumn("score", F.col("margin"))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return found.select("doc_id", "held_out", score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
