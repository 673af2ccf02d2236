"""Quality rules: base counts of repetition and symbols, then perplexity bands of a character n-gram model.

The model is interpolated modified Kneser-Ney over characters, one per language. Spark counts in how many documents each
n-gram occurs and computes every probability; the result is one sorted array of n-gram codes a language with an array
of log-probabilities beside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import SPACE_BYTES, column, mix64, rows_out, sent_if_small, slices, table, written
from riskflow.session import freeze

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Characters of an n-gram, and bits of a character in its code. A corpus' commonest 2**15 - 2 characters have numbers of their own, the rarer ones share one.
ORDER = 4
CHAR_BITS = 15
RARE = (1 << CHAR_BITS) - 1
#: n-grams that a worker gathers, over all languages, before it merges them, and those it keeps then at most.
HELD_NGRAMS = 1_000_000
#: A model of at most so many n-grams (12 bytes each) is broadcast; a larger one is joined. Both give the same scores.
BROADCAST_NGRAMS = 8_000_000
#: A band reaches so many robust deviations below and above the median of a language's documents of one length class.
BAND = 5.0
#: Length classes, by powers of two, of fewer different documents than this take the scatter of their language, and languages of fewer that of all.
MIN_CLASS = 50
#: Quartile distances of a normal distribution become standard deviations by this factor.
QUARTILE = 1.4826
#: Log-probabilities are rounded to so many digits where quantiles are taken, so that few values are held.
DIGITS = 4


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one whole text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, SPACE_BYTES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW:
        known: dict[bytes, int] = {}
        code = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint64, count=n)
        h = np.zeros(n - WINDOW + 1, dtype=np.uint64)
        for k in range(WINDOW):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + code[k : n - WINDOW + 1 + k] + np.uint64(1))
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            starts = np.flatnonzero(np.isin(h, twice))
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            repeated = int((np.cumsum(cover[:n]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def code_points(text: str | None) -> np.ndarray:
    """White space is one kind of character."""
    c = np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4").astype(np.int64)
    c[(c >= 9) & (c <= 13)] = 32
    return c


def numbered(docs: DataFrame) -> np.ndarray:
    """For each code point its number: characters of ``docs`` by frequency, from 1; ``RARE`` for the rest. Two bytes a code point, whatever the corpus."""
    schema = pa.schema([("char", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in slices(batches):
            for text in column(batch, "text"):
                found = np.bincount(code_points(text))
                total[: len(found)] += found
        yield rows_out(schema, [np.flatnonzero(total), total[total > 0]])

    common = docs.select("text").mapInArrow(work, "char long, n long").groupBy("char").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "char").limit(RARE - 1).collect()
    out = np.full(0x110000, RARE, np.uint16)
    out[[r["char"] for r in common]] = np.arange(1, len(common) + 1)
    return out


def ngrams(text: str | None, numbers: np.ndarray) -> np.ndarray:
    """The code of the n-gram that ends at each character; the start is padded."""
    c = np.concatenate([np.zeros(ORDER - 1, np.int64), numbers[code_points(text)]])
    n = len(c) - ORDER + 1
    out = np.zeros(n, dtype=np.int64)
    for k in range(ORDER):
        out = (out << CHAR_BITS) | c[k : k + n]
    return out


COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("docs", pa.int64())])


def document_counts(docs: DataFrame, numbers) -> DataFrame:
    """``lang, gram, docs``: every n-gram of a language, and in how many documents it occurs. ``numbers``: the broadcast of ``numbered``."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, times = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(grams, kind="stable")
        grams, times = grams[order], times[order]
        at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        return grams[at], np.add.reduceat(times, at)

    def rows(lang: str, found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found[0]), 1 << 16):
            grams, times = (x[at : at + (1 << 16)] for x in found)
            yield rows_out(COUNTS, [[lang] * len(grams), grams, times])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in slices(batches, 256):
            here: dict[str, list] = {}
            for text, lang in zip(column(batch, "text"), column(batch, "lang")):
                if text:
                    here.setdefault(lang, []).append(np.unique(ngrams(text, numbers.value)))
            for lang, parts in here.items():
                held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
                size += len(held[lang][-1][0])
            if size > HELD_NGRAMS:
                held = {lang: [merge(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                while size > HELD_NGRAMS // 2:
                    lang = max(held, key=lambda x: len(held[x][0][0]))
                    size -= len(held[lang][0][0])
                    yield from rows(lang, held.pop(lang)[0])
        for lang, parts in held.items():
            yield from rows(lang, merge(parts))

    own = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), "text")
    return own.mapInArrow(work, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


def kneser_ney(counted: DataFrame) -> DataFrame:
    """``lang, gram, logp`` for every n-gram of ``document_counts``, as seen from a document that holds it.

    Such a document is left out of the evidence: the count is the number of other documents. Lower orders count the different
    continuations to the left, as Kneser-Ney has it; three discounts an order come from the counts of counts.
    """
    levels = [freeze(counted.select("lang", "gram", F.greatest(F.col("docs") - 1, F.lit(0)).alias("n")))]
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (CHAR_BITS * k)) - 1).cast("long"))
        levels.append(freeze(levels[-1].groupBy("lang", suffix.alias("gram")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n"))))
    levels.reverse()
    symbols = freeze(levels[0].groupBy("lang").agg((F.count("*") + 1).alias("symbols")))
    below = None
    for k, level in enumerate(levels):
        n = F.col("n")
        context = F.shiftright("gram", CHAR_BITS)
        seen = freeze(level.groupBy("lang").agg(*[F.count_if(n == i).alias(f"t{i}") for i in (1, 2, 3, 4)]))
        of_lang = sent_if_small(seen.select(F.col("lang").alias("d_lang"), *_discounts()))
        contexts = level.groupBy(F.col("lang").alias("c_lang"), context.alias("c_gram")).agg(
            F.sum("n").alias("total"), *[F.sum(F.when(n == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2)], F.sum(F.when(n > 2, 1).otherwise(0)).alias("n3"))
        contexts = contexts.join(of_lang, F.col("c_lang") == F.col("d_lang"))
        joined = level.join(contexts, (F.col("lang") == F.col("c_lang")) & (context == F.col("c_gram")))
        if below is None:
            joined = joined.join(sent_if_small(symbols), "lang")
            lower: Column = 1.0 / F.col("symbols")
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (CHAR_BITS * k)) - 1).cast("long"))
            joined = joined.join(below.select(F.col("lang").alias("s_lang"), F.col("gram").alias("s_gram"), F.col("p").alias("p_below")),
                                 (F.col("lang") == F.col("s_lang")) & (suffix == F.col("s_gram")))
            lower = F.col("p_below")
        discount = F.when(n == 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        free = (F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + F.col("n3") * F.col("d3")) / F.col("total")
        p = F.when(F.col("total") > 0, F.greatest(n - discount, F.lit(0.0)) / F.col("total") + free * lower).otherwise(lower)
        below = freeze(joined.select("lang", "gram", p.alias("p")))
    return below.select("lang", "gram", F.log("p").alias("logp"))


def _discounts() -> list[Column]:
    """Chen and Goodman's discounts for counts 1, 2 and more from the counts of counts t1 to t4; where these are missing, an even half step."""
    t = [F.col(f"t{i}").cast("double") for i in (1, 2, 3, 4)]
    y = F.when(t[0] > 0, t[0] / (t[0] + 2 * t[1])).otherwise(0.5)
    cut = lambda i, a, b: F.least(F.greatest(i - (i + 1) * y * b / a, F.lit(0.05)), F.lit(i - 0.05))
    return [F.when(t[i - 1] > 0, cut(i, t[i - 1], t[i])).otherwise(i * y).alias(f"d{i}") for i in (1, 2, 3)]


@dataclass(frozen=True)
class Model:
    """Sorted n-gram codes and log-probabilities by language, shared with the workers; or the table where these are too many. Numbers of characters."""

    table: DataFrame
    arrays: object | None
    numbers: object


def fit(docs: DataFrame, limit: int = BROADCAST_NGRAMS) -> Model:
    numbers = docs.sparkSession.sparkContext.broadcast(numbered(docs))
    probabilities = freeze(kneser_ney(document_counts(docs, numbers)))
    if probabilities.count() > limit:
        return Model(probabilities, None, numbers)
    found = probabilities.orderBy("lang", "gram").toArrow()
    lang, gram, logp = found["lang"].to_numpy(), found["gram"].to_numpy(), found["logp"].to_numpy().astype(np.float32)
    arrays = {x: (gram[lang == x], logp[lang == x]) for x in set(lang.tolist())}
    return Model(probabilities, docs.sparkSession.sparkContext.broadcast(arrays), numbers)


def mean_logp(text: str | None, numbers: np.ndarray, arrays: tuple[np.ndarray, np.ndarray] | None) -> float:
    """Mean log-probability a character; 0 for an empty text."""
    grams, times = np.unique(ngrams(text, numbers), return_counts=True)
    if not len(grams) or arrays is None:
        return 0.0
    return float(arrays[1][np.searchsorted(arrays[0], grams)].astype(np.float64) @ times) / int(times.sum())


FACTS = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")],
                   ("base_failed", pa.bool_()), ("lang", pa.string()), ("key", pa.int64()), ("logp", pa.float64())])
FACTS_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, base_failed boolean, lang string, key long, logp double"


def facts(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: base counts, language, key (of text and language), and mean log-probability a character."""
    shared, numbers = model.arrays, model.numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text, lang, key in zip(*(column(batch, c) for c in ("doc_id", "text", "lang", "key"))):
                counts = base_counts(text)
                logp = mean_logp(text, numbers.value, shared.value.get(lang)) if shared else None
                out.append((doc_id, *counts, len(text or ""), base_failed(counts[0], counts[4]), lang, key, logp))
            yield rows_out(FACTS, zip(*out) if out else [[]] * len(FACTS))

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang")).withColumn("key", F.xxhash64("text", "lang"))
    if shared:
        return own.mapInArrow(work, FACTS_DDL)
    scores = joined_scores(own, model)
    known = own.join(scores, "key", "left").select("doc_id", "text", "lang", "key", F.coalesce("mean", F.lit(0.0)).alias("mean"))

    def with_mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for plain in work(iter([batch])):
                yield plain.set_column(plain.num_columns - 1, FACTS.field("logp"), batch.column(batch.schema.get_field_index("mean")))

    return known.mapInArrow(with_mean, FACTS_DDL)


def joined_scores(own: DataFrame, model: Model) -> DataFrame:
    """``key`` (of text and language), ``mean``: the scores by a join, for a model too large to send to every worker."""
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("gram", pa.int64()), ("times", pa.int64())])
    numbers = model.numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for key, text, lang in zip(*(column(batch, c) for c in ("key", "text", "lang"))):
                grams, times = np.unique(ngrams(text, numbers.value), return_counts=True)
                if len(grams):
                    yield rows_out(schema, [[key] * len(grams), [lang] * len(grams), grams, times])

    keyed = own.dropDuplicates(["key"])
    grams = keyed.select("key", "text", "lang").mapInArrow(work, "key long, lang string, gram long, times long")
    # as in the arrays, one log-probability has 32 bits
    logp = F.col("logp").cast("float").cast("double")
    return grams.join(model.table, ["lang", "gram"]).groupBy("key").agg((F.sum(F.col("times") * logp) / F.sum("times")).alias("mean"))


BAND_COLUMNS = ("middle", "below", "above", "below_char", "above_char")


def length_class(n_chars: Column) -> Column:
    return F.floor(F.log2(F.greatest(n_chars, F.lit(1)))).cast("int")


def bands(found: DataFrame) -> DataFrame:
    """``lang, size, middle, below, above, below_char, above_char`` for each language and length class of ``found``.

    Taken from the documents that pass the base rules, those of equal length and score (copies) once: the median, and the distances of the
    quartiles from it as robust deviations. Classes of few documents have their language's median and its scatter of one
    character's log-probability, which falls with the root of the length. Written, and as a side of a join sent to where the documents are.
    """
    known = found.select("lang", length_class(F.col("n_chars")).alias("size"), "n_chars", "base_failed", F.round("logp", 9).alias("logp"))
    passed = freeze(known.where("not base_failed").distinct())
    quartiles = F.percentile(F.round("logp", DIGITS), F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    of_lang = freeze(passed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), quartiles[1].alias("middle")))
    away = passed.join(sent_if_small(of_lang), "lang").select("lang", "n", "middle", F.round((F.col("logp") - F.col("middle")) * F.sqrt("n_chars"), 2).alias("away"))
    away = freeze(away)
    ends = F.percentile("away", F.array(F.lit(0.25), F.lit(0.75))).alias("ends")
    of_all = away.agg(ends).first()["ends"] or [0.0, 0.0]
    scatter = away.groupBy("lang").agg(F.first("middle").alias("l_middle"), F.when(F.first("n") >= MIN_CLASS, ends).otherwise(F.array(*map(F.lit, of_all))).alias("l"))
    of_class = passed.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"), quartiles.alias("q"))
    own = F.coalesce(F.col("n") >= MIN_CLASS, F.lit(False))
    spread = lambda enough, x: F.when(enough, F.lit(QUARTILE) * F.greatest(x, F.lit(0.0))).otherwise(0.0)
    found = known.select("lang", "size").distinct().join(scatter, "lang", "left").join(of_class, ["lang", "size"], "left")
    return freeze(found.select(
        "lang", "size", F.when(own, F.col("q")[1]).otherwise(F.col("l_middle")).alias("middle"),
        spread(own, F.col("q")[1] - F.col("q")[0]).alias("below"), spread(own, F.col("q")[2] - F.col("q")[1]).alias("above"),
        spread(~own, -F.col("l")[0]).alias("below_char"), spread(~own, F.col("l")[1]).alias("above_char")))


def limits(middle: Column, below: Column, above: Column, below_char: Column, above_char: Column, n_chars: Column) -> tuple[Column, Column]:
    """The lowest and the highest perplexity of a band for a text of so many characters."""
    reach = lambda spread, char: BAND * F.greatest(spread + char / F.sqrt(F.greatest(n_chars, F.lit(1))), F.lit(10.0**-DIGITS))
    return F.exp(-(middle + reach(above, above_char))), F.exp(-(middle - reach(below, below_char)))


def judged(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The verdict on every row of ``docs`` (``doc_id``, ``text``, ``lang``; other columns are ignored).

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, perplexity,
    lower, upper``. A document is kept if it passes the base rules and its perplexity lies in the band of its language
    and length class. Null and empty texts have no words, so they fail; their perplexity is 1. A
    missing language is a language of its own. Repeated rows are judged each. An empty table gives an empty result.
    """
    return verdicts(freeze(facts(docs, model or fit(docs)))).drop("key")


def verdicts(found: DataFrame) -> DataFrame:
    """The columns of ``judged``, and ``key``, from the written ``facts``."""
    known = found.withColumn("size", length_class(F.col("n_chars"))).join(sent_if_small(bands(found)), ["lang", "size"], "left")
    low, high = limits(*[F.col(c) for c in (*BAND_COLUMNS, "n_chars")])
    known = known.select("*", F.exp(-F.col("logp")).alias("perplexity"), low.alias("lower"), high.alias("upper"))
    kept = ~F.col("base_failed") & F.col("perplexity").between(F.col("lower"), F.col("upper"))
    return known.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"),
                        "lang", "key", "perplexity", "lower", "upper")


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def keep_good(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all columns."""
    model = model or fit(docs)
    lang = F.coalesce(docs["lang"].cast("string"), F.lit(""))
    if model.arrays is None:
        # a verdict follows from text and language, whatever ids rows share
        good = verdicts(freeze(facts(docs, model))).where("kept").select(F.col("key").alias("_op7_key")).distinct()
        return docs.join(good, F.xxhash64(docs["text"], lang) == F.col("_op7_key"), "left_semi")
    shared, numbers = model.arrays, model.numbers

    @F.pandas_udf("struct<failed: boolean, logp: double>")
    def score(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        counts = [base_counts(t) for t in texts]
        return pd.DataFrame({"failed": [base_failed(c[0], c[4]) for c in counts], "logp": [mean_logp(t, numbers.value, shared.value.get(x)) for t, x in zip(texts, langs)]})

    # each text is scored once: rows and scores are written, as the bands follow from all scores
    scored = written(docs.select("*", score(docs["text"], lang).alias("_op7"), lang.alias("_op7_lang"), F.coalesce(F.char_length(docs["text"]), F.lit(0)).alias("_op7_chars")))
    known = bands(scored.select(F.col("_op7_lang").alias("lang"), F.col("_op7_chars").alias("n_chars"), F.col("_op7.failed").alias("base_failed"), F.col("_op7.logp").alias("logp")))
    known = sent_if_small(known).select(*[F.col(c).alias(f"_op7_{c}") for c in known.columns]).withColumnRenamed("_op7_lang", "_op7_of")
    low, high = limits(*[F.col(f"_op7_{c}") for c in (*BAND_COLUMNS, "chars")])
    here = (F.col("_op7_lang") == F.col("_op7_of")) & (length_class(F.col("_op7_chars")) == F.col("_op7_size"))
    return scored.join(known, here).where(~F.col("_op7.failed") & F.exp(-F.col("_op7.logp")).between(low, high)).select(docs.columns)
