"""Line deduplication by a deletion-neighbourhood join. DataFrame functions only.

Lines are word sequences; the edit bound is one word put in, left out or replaced. Two lines within it share a deletion
variant. The neighbourhood is emitted twice: first coarsely, a quarter of the line left out, which tells the few lines that can have a
partner; then word by word for those alone. Equal variants meet in groups whose earliest member is all that is kept of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import table
from riskflow.session import freeze

#: The longer line of a pair has at least so many words: one of them is then a fifth at most.
MIN_WORDS = 5
SEGMENTS = 4
#: So many suspected lines (24 bytes each) are sent to the scan; more are joined with a shuffle.
BROADCAST_LINES = 1_000_000
#: Words of a line scanned at once when its variants are hashed.
BLOCK = 32
#: What a variant stands for: a line that differs in this word, the longer line of a pair, the shorter one.
REPLACED, LONGER, SHORTER = range(3)


def _cut(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: each line of each text as it stands."""
    parts = F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)
    cut = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.posexplode(parts).alias("line_no", "line"))
    return cut.withColumn("line_no", F.col("line_no").cast("long"))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, norm``: each line of each text in lower case, one space between words, none at the ends."""
    return _normed(_cut(docs))


def _normed(cut: DataFrame) -> DataFrame:
    low = cut.select("doc_id", "line_no", F.lower("line").alias("low"))
    # most lines are so already; looking for bytes is much cheaper than matching a pattern
    found = F.col("low").startswith(" ") | F.col("low").endswith(" ") | F.contains("low", F.lit("  "))
    for space in "\t\u000b\f\r":
        found = found | F.contains("low", F.lit(space))
    norm = F.when(found, F.trim(F.regexp_replace("low", r"[\x20\x09-\x0D]+", " "))).otherwise(F.col("low"))
    return low.select("doc_id", "line_no", norm.alias("norm"))


def _named(found: DataFrame) -> DataFrame:
    """The number of words and two hashes of them that together name a line."""
    spaces = F.char_length("norm") - F.char_length(F.replace("norm", F.lit(" "), F.lit("")))
    return found.withColumns({"n": F.when(F.col("norm") == "", 0).otherwise(spaces + 1), "a": F.xxhash64("norm"), "b": F.xxhash64(F.lit("b"), "norm")})


def _with_coarse_keys(found: DataFrame) -> DataFrame:
    """``keys``: hashes of a line without one quarter, as itself and as the longer line of a pair: its last words then stand one place on.

    A word that differs, or is one too many, lies in some quarter of the shorter line, and the words before and after it are the same. These
    are the line's own text up to one space and from another on: no word is cut out. Keys a line does not have are null.
    """
    def key(m: str, q: int) -> str:
        front = f"substring_index(norm, ' ', cast({m} * {q} div {SEGMENTS} as int))" if q else "''"
        back = f"substring_index(norm, ' ', cast({m} * {q + 1} div {SEGMENTS} as int) - {m})" if q < SEGMENTS - 1 else "''"
        return f"xxhash64({m}, {q}, {front}, {back})"

    same = [f"case when n >= {MIN_WORDS - 1} then {key('n', q)} end" for q in range(SEGMENTS)]
    longer = [f"case when n >= {MIN_WORDS} then {key('(n - 1)', q)} end" for q in range(SEGMENTS)]
    return found.select("n", "a", "b", "doc_id", "line_no", F.expr(f"array({', '.join(same + longer)})").alias("keys"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")


def _variants(suspected: DataFrame) -> DataFrame:
    """``key, role, uid``: every word left out in turn, hashed with its position (REPLACED) and without (LONGER), and the whole line (SHORTER).

    A word's hash depends on its position, a line's is their exclusive or; leaving out word i moves the later ones down by one. Running
    totals over blocks give all variants of a line in little more than one pass.
    """
    own = suspected.withColumn("low", F.expr("transform(words, (w, j) -> xxhash64(w, j - 1))"))
    own = own.withColumn("high", F.expr("transform(words, (w, j) -> xxhash64(w, j))"))
    own = own.withColumn("e", F.expr("zip_with(high, low, (h, l) -> h ^ l)"))
    # a column that stands once inside a function of elements is put into it and worked out for each of them: those here are used twice or outside
    own = own.withColumn("blocks", F.expr(f"transform(sequence(0, (size(e) - 1) div {BLOCK}), k -> slice(e, cast(k * {BLOCK} + 1 as int), {BLOCK}))"))
    # of each block the running totals up to each of its words; then the totals of the blocks before it, and of the whole line moved down
    running = "aggregate({x}, array({first}), (s, v) -> concat(s, array(element_at(s, -1) ^ v)))"
    total = "aggregate({x}, 0L, (s, v) -> s ^ v)"
    own = own.withColumn("inner", F.expr(f"transform(blocks, x -> {running.format(x='x', first='0L')})"))
    own = own.withColumn("offsets", F.expr(running.format(x="transform(inner, x -> element_at(x, -1))", first=total.format(x="low"))))
    before = "flatten(zip_with(inner, slice(offsets, 1, size(inner)), (x, o) -> transform(slice(x, 1, size(x) - 1), v -> v ^ o)))"
    own = own.withColumn("v", F.expr(f"zip_with({before}, low, (p, l) -> p ^ l)"))
    replaced = f"transform(v, (x, i) -> named_struct('key', xxhash64('r', n, i, x), 'role', {REPLACED}))"
    # the same variant from neighbouring equal words is one
    longer = f"transform(array_distinct(v), x -> named_struct('key', xxhash64('d', n - 1, x), 'role', {LONGER}))"
    shorter = f"array(named_struct('key', xxhash64('d', n, {total.format(x='high')}), 'role', {SHORTER}))"
    made = F.expr(f"case when n < {MIN_WORDS} then {shorter} else concat({replaced}, {longer}, {shorter}) end")
    return own.select("uid", F.explode(made).alias("x")).select("x.key", "x.role", "uid")


def _within_one(x: str, y: str) -> Column:
    """Whether word lists x and y differ by one word put in, left out or replaced, or not at all; x is the longer."""
    same = f"coalesce(nullif(array_position(zip_with({x}, {y}, (u, w) -> u <=> w), false), 0) - 1, size({y}))"
    rest = f"slice({x}, cast({same} + 2 as int), size({x}))"
    return F.expr(f"case size({x}) - size({y}) when 0 then {rest} = slice({y}, cast({same} + 2 as int), size({x})) "
                  f"when 1 then {rest} = slice({y}, cast({same} + 1 as int), size({x})) else false end")


def _earliest_partners(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b, n, near``: for distinct lines, the earliest place of another line within the edit bound, if that is earlier."""
    coarse = distinct.select("uid", F.explode("keys").alias("key")).where("key is not null").repartition("key")
    shared = coarse.groupBy("key").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi").select("key")
    # keys of one line only are most: none is sorted to find the others
    suspected = coarse.join(shared.hint("shuffle_hash"), "key").select("uid").distinct()
    # numbered in the order of their places, so that the earliest of a group is its smallest number
    named = freeze(distinct.select("uid", "a", "b", "n", "place").join(suspected.hint("shuffle_hash"), "uid", "left_semi").drop("uid").orderBy("place"))
    named = named.withColumn("uid", F.monotonically_increasing_id())
    cut = _cut(docs)
    if named.count() <= BROADCAST_LINES:
        # a line is looked up where it stands first; rows that repeat an id may have others there
        where = named.select(F.col("place.doc_id").alias("_id"), F.col("place.line_no").alias("_no")).distinct()
        # stored, as what the next join asks of the hashes would be asked of every line
        cut = freeze(cut.join(F.broadcast(where), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("line_no") == F.col("_no")), "left_semi"))
        named = F.broadcast(named)
    texts = freeze(_named(_normed(cut)).select("a", "b", "n", "norm").join(named, ["a", "b", "n"]).groupBy("uid").agg(
        *[F.first(c).alias(c) for c in ("place", "a", "b", "n")], F.split(F.first("norm"), " ", -1).alias("words")))
    members = freeze(_variants(texts))
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("uid")))
    groups = members.groupBy("key").agg(first(REPLACED).alias("r"), first(LONGER).alias("t"), first(SHORTER).alias("s"), F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi")
    best = F.when(F.col("role") == REPLACED, F.col("r")).when(F.col("role") == LONGER, F.col("s")).otherwise(F.col("t"))
    pairs = members.join(groups.hint("shuffle_hash"), "key").select("uid", best.alias("other")).where("other < uid").distinct()
    left = texts.select("uid", "a", "b", "n", "place", F.col("words").alias("x"))
    right = texts.select(F.col("uid").alias("other"), F.col("place").alias("near"), F.col("words").alias("y"))
    # lines of rows that repeat an id may share a place
    both = pairs.join(left, "uid").join(right, "other").where("near < place")
    near = F.when(F.size("x") >= F.size("y"), _within_one("x", "y")).otherwise(_within_one("y", "x"))
    return both.where(near).groupBy("a", "b", "n").agg(F.min("near").alias("near"))


def line_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, n_words, kept, first_doc_id, first_line_no`` for every line of ``docs`` (``doc_id``, ``text``; others are ignored).

    A line goes if an earlier line (by doc_id, null last, then line number from 0) has the same words but for case and white space,
    or, where the longer has at least MIN_WORDS words, words within one edit. ``first_*`` is the earliest such line, or the line itself. Lines without
    a word stay. Null and empty texts are one line without a word. Rows that repeat an id stand at the same place: of equal
    lines at one place all stay. An empty table gives an empty result.
    """
    own = _with_coarse_keys(_named(lines(docs))).withColumn("place", _place())
    # hashes first: what is sorted by them is told apart by the first word compared
    own = own.groupBy("a", "b", "n").agg(F.min("place").alias("place"), F.count("*").alias("times"), F.first("keys").alias("keys"))
    # asked of a stored column: asked of the texts, they would be brought into the form of lines once more for it
    distinct = freeze(own.withColumn("uid", F.monotonically_increasing_id())).where("n > 0")
    near = _earliest_partners(distinct, docs)
    known = distinct.select("a", "b", "n", "place", "times").join(near.hint("shuffle_hash"), ["a", "b", "n"], "left").where("times > 1 or near is not null")
    known = known.select("a", "b", "n", F.least("place", F.coalesce("near", "place")).alias("first"))
    found = _named(lines(docs)).select("doc_id", "line_no", "a", "b", "n").join(known.hint("shuffle_hash"), ["a", "b", "n"], "left")
    place = F.coalesce(F.when(F.col("n") > 0, F.col("first")), _place())
    return found.select("doc_id", "line_no", F.col("n").cast("long").alias("n_words"), (place == _place()).alias("kept"),
                        place["doc_id"].alias("first_doc_id"), place["line_no"].alias("first_line_no"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``; all other columns as they are, one row for each id."""
    found = line_duplicates(docs)
    gone = found.where("not kept").groupBy(F.col("doc_id").alias("_op1_id")).agg(F.collect_set("line_no").alias("_op1_gone"))
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(_op1_gone, cast(i as bigint))), '\\n')")
    held = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_op1_id")), "left")
    return held.withColumn("text", F.when(F.col("_op1_gone").isNull(), F.col("text")).otherwise(kept)).select(docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM t),
d AS (SELECT w, len(w) AS n, min((doc_id IS NULL, doc_id, line_no)) AS place FROM l WHERE len(w) > 0 GROUP BY w),
v AS (SELECT w, n, place, i, w[:i - 1] || w[i + 1:] AS x FROM d, unnest(range(1, n + 1)) AS u(i) WHERE n >= 5),
r AS (SELECT n, i, x, min(place) AS best FROM v GROUP BY n, i, x),
near AS (
  SELECT v.w, r.best FROM v JOIN r USING (n, i, x) WHERE r.best < v.place
  UNION ALL SELECT v.w, s.place FROM v JOIN d s ON v.x = s.w WHERE s.place < v.place
  UNION ALL SELECT s.w, v.place FROM v JOIN d s ON v.x = s.w WHERE v.place < s.place),
b AS (SELECT w, min(best) AS best FROM near GROUP BY w),
f AS (SELECT d.w, least(d.place, coalesce(b.best, d.place)) AS first FROM d LEFT JOIN b ON d.w = b.w)
SELECT l.doc_id, l.line_no::BIGINT AS line_no, len(l.w)::BIGINT AS n_words,
  f.first IS NULL OR f.first IS NOT DISTINCT FROM (l.doc_id IS NULL, l.doc_id, l.line_no) AS kept,
  CASE WHEN f.first IS NULL THEN l.doc_id ELSE f.first[2] END AS first_doc_id,
  (CASE WHEN f.first IS NULL THEN l.line_no ELSE f.first[3] END)::BIGINT AS first_line_no
FROM l LEFT JOIN f ON l.w = f.w
"""
