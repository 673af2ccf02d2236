"""Exact and near-duplicates and lines against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskflow.llm import exact, lines, simhash
from riskflow.llm.components import components

SPACES = r"[\x20\x09-\x0D]"


def in_duck(df, sql):
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    con.execute("create table d as select doc_id::bigint doc_id, text::varchar as text, source::varchar as source from documents")
    con.unregister("documents")
    con.execute("create view documents as select * from d")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=repr)


def ordered(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@given(st.lists(st.integers(0, 5000), unique=True, min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_rice_codes_round_trip(values):
    values = np.array(sorted(values))
    for width in (0, 3, exact.rice_bits(len(values), 5001)):
        assert exact.rice_decode(*exact.rice_encode(values, width), len(values), width).tolist() == values.tolist()


def test_exact_duplicates_equal_sql(docs_of, awkward):
    df = docs_of(awkward)
    assert ordered(exact.exact_duplicates(df)) == in_duck(df, exact.OP5_SQL)
    kept = exact.keep_one(df)
    assert kept.columns == df.columns
    got = [re.sub(SPACES, "", r.text or "") for r in kept.collect()]
    assert sorted(got) == sorted({re.sub(SPACES, "", t or "") for _, t, *_ in awkward})
    assert exact.exact_duplicates(docs_of([])).count() == 0 and exact.keep_one(docs_of([])).count() == 0


def test_exact_digest_is_of_the_bare_text(docs_of):
    (row,) = exact.exact_duplicates(docs_of([(1, "a b\u000bé")])).collect()
    assert row.text_sha256 == hashlib.sha256("abé".encode()).hexdigest() and row.kept


def brute_fingerprint(text):
    words = [w for w in re.split(SPACES + "+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, marks):
    ids = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                a, b = ids[i], ids[j]
                ids = [min(a, b) if x in (a, b) else x for x in ids]
    least = {}
    for i, c in enumerate(ids):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return [least.get(c) for c in ids]


def test_near_duplicates_equal_brute_force(docs_of, awkward):
    rnd = random.Random(3)
    base = awkward[5][1].split()
    rows = list(awkward)
    for i in range(100, 130):
        w = base[:400]
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(400)] = "changed"
        rows.append((i, " ".join(w)))
    marks = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(((r[0], f"{m:016x}", c) for r, m, c in zip(rows, marks, near(rows, marks))), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs_of(rows)).collect()), key=repr)
    assert got == want
    assert len({c for *_, c in got}) < len({m for _, m, _ in got})  # some link without being equal
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_links_find_every_pair_within_the_bound(spark):
    rnd = random.Random(4)
    marks = {rnd.getrandbits(64) for _ in range(40)}
    for m in list(marks):
        for n in range(1, 7):
            marks.add(m ^ sum(1 << b for b in rnd.sample(range(64), n)))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "fp long")
    got, deep = (sorted(tuple(r) for r in simhash.links(df, deep=d).collect()) for d in (False, True))
    want = sorted((min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert got == want and deep == want


def test_near_stage_keeps_one_of_each_group(docs_of, awkward):
    df = docs_of(awkward)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = {r.component_id for r in simhash.near_duplicates(df).where("doc_id is not null").collect()}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(x for x in groups if x is not None)
    assert simhash.keep_one(docs_of([])).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    edges = path + [(200, 200 + i) for i in range(1, 50)] + [(300, 300), (400, 401), (401, 400)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(50)}, 400: 400, 401: 400}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_duplicates_equal_brute_force(docs_of):
    rnd = random.Random(9)
    base = [[rnd.choice("a b c d e f g h".split()) for _ in range(rnd.randint(3, 9))] for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "a b c d e f"), (40, "Title\n" + " ".join(["long"] * 700)), (41, " ".join(["long"] * 701)), (42, "title")]
    for i in range(5, 35):
        text = []
        for _ in range(rnd.randint(1, 4)):
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 2)):
                k, at = rnd.random(), rnd.randrange(len(w))
                if k < 0.4:
                    w[at] = rnd.choice("abcdxyz")
                elif k < 0.7:
                    w.insert(at, rnd.choice("abcdxyz"))
                elif len(w) > 1:
                    del w[at]
            text.append(rnd.choice(["  ", " ", "\t"]).join(w))
        rows.append((i, "\n".join(text)))
    every = sorted(((d is None, d or 0, k), d, line.lower().split()) for d, t, in rows for k, line in enumerate((t or "").split("\n")))
    want = []
    for place, d, w in every:
        first = next((q for q in every if q[0] <= place and w and q[2] and (q[2] == w or max(len(q[2]), len(w)) >= 5 and edits(q[2], w) <= 1)), (place, d, w))
        want.append((d, place[2], len(w), first[0] == place, first[1], first[0][2]))
    df = docs_of(rows)
    assert sorted((tuple(r) for r in lines.line_duplicates(df).collect()), key=repr) == sorted(want, key=repr)
    assert ordered(lines.line_duplicates(df)) == in_duck(df, lines.OP1_SQL)
    stripped = lines.without_repeats(df)
    assert stripped.columns == df.columns and stripped.count() == df.count()
    assert lines.line_duplicates(docs_of([])).count() == 0


def test_every_single_word_edit_is_found_and_lines_are_read_once(docs_of, monkeypatch):
    rows, frozen = [], []
    for n in range(4, 14):
        for at in range(n + 1):
            for put, left_out in ((["x"], 1), (["x"], 0), ([], 1)):
                if left_out and at == n:
                    continue
                w = [f"w{len(rows)}_{i}" for i in range(n)]
                rows.append((len(rows), " ".join(w) + "\n" + " ".join(w[:at] + put + w[at + left_out:])))
    kept = lines.freeze
    monkeypatch.setattr(lines, "freeze", lambda df: frozen.append(df) or kept(df))
    dropped = {r.doc_id for r in lines.line_duplicates(docs_of(rows)).where("line_no = 1 and not kept and first_line_no = 0").collect()}
    longest = {i: max(len(line.split()) for line in text.split("\n")) for i, text in rows}
    assert dropped == {i for i, n in longest.items() if n >= lines.MIN_WORDS}
    # the scan brings a line into its form once, also to tell lines without words, and takes no words apart for its keys
    scan = frozen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert scan.count("regexp_replace(") == 1 and "transform(" not in scan
