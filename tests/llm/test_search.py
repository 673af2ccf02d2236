"""Periodic runs, exact top-k search and the alignment of two tokenizers."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskflow.llm import alignment, runs, search


def plain_runs(words):
    """(start, length, period) of every maximal stretch, by walking along every period."""
    least = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                least.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in least.items()), key=lambda r: (r[0], r[2]))


def plain_row(words):
    found = plain_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return found, best, b" ".join(w for i, w in enumerate(words) if i not in dropped)


@given(st.lists(st.tuples(st.integers(1, 3), st.lists(st.integers(0, 2), max_size=60), st.integers(0, 9)), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_runs_equal_brute_force(documents):
    docs = []
    for letters, codes, period in documents:
        words = [b"%d" % (c % letters) for c in codes]
        docs.append((0, words[:9] + [words[9:][k % period] for k in range(len(words) - 9)] if 0 < period <= len(words) - 9 else words))
    for (_, words), row in zip(docs, runs._search(docs).to_pylist()):
        found, best, left = plain_row(words)
        assert [tuple(r.values()) for r in row["runs"]] == found
        assert (row["best"] and tuple(row["best"].values())) == best and row["collapsed"] == left


def test_extensions_equal_comparison():
    rnd = random.Random(2)
    for n in (2, 5, 14, 90, 400):
        code = np.array([rnd.choice([1, 1, 1, 2]) for _ in range(n - 1)] + [9], dtype=np.int64)
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j][:4000]
        i, j = (np.array(x) for x in zip(*pairs))
        want = []
        for a, b in pairs:
            k = 0
            while max(a, b) + k < n and code[a + k] == code[b + k]:
                k += 1
            want.append(k)
        assert runs.Extensions(code)(i, j).tolist() == want


def digest(text):
    return hashlib.sha256(text).hexdigest()


def test_query_of_runs_plants_and_digests(docs_of, awkward, spark, tmp_path):
    long_run = "w " * 70_000 + "end"
    rows = [*awkward, (70, "a b a b a b a b c", "en", "a"), (71, "x x x x x x", "en", "a"), (72, long_run, "en", "a")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, runs.op11_periodic_runs(spark, str(tmp_path)).collect()))
    want = Counter()
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
            g = zlib.crc32(str(doc_id).encode()) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found, best, left = ([(0, 70_000, 1)], (0, 70_000, 1), b"w end") if text == long_run else plain_row(words)
        said = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        want[doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(said), digest(left)] += 1
    assert got == want
    assert runs.periodic_runs(docs_of([])).count() == 0


def plain_top(rows, k):
    clip = lambda x: max(-search.MOST, min(search.MOST, x))
    usable = [(i, v) for i, v in rows if v is not None and None not in v]
    want = Counter()
    for a, (i, v) in enumerate(usable):
        if i is not None and i % 100 == 0:
            scored = sorted((-clip(sum(x * y for x, y in zip(v, w))), j is None, j or 0) for b, (j, w) in enumerate(usable) if b != a)
            want.update((i, rank, None if absent else j, -score) for rank, (score, absent, j) in enumerate(scored[:k], 1))
    return want


@pytest.mark.parametrize("parts", [[3, -2, 5, 0], [2**40, -(2**62), 5, 0, 2**63 - 1], [1]])
def test_top_k_equals_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 100)
    rnd = random.Random(4)
    rows = [(i if i % 7 else None, [rnd.choice(parts) for _ in range(rnd.randint(0, 5))]) for i in range(900)]
    rows += [(100, [1, 2]), (100, [1, 2]), (200, None), (5, [None, 1]), (300, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, vector array<long>, row int, shard string")
    assert Counter(map(tuple, search.top_k(df, F.col("vec_id") % 100 == 0).collect())) == plain_top(rows, 10)
    assert search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert search.top_k(df.where("vec_id = 5 and vector[0] is null"), F.lit(True)).count() == 0


def test_top_k_skips_what_cannot_win(spark, monkeypatch):
    """Well separated groups: most shards' bounds lie below the k-th score, and the result is whole."""
    monkeypatch.setattr(search, "SHARD", 64)
    rnd = np.random.default_rng(3)
    centres = np.eye(16, dtype=np.int64) * 1000
    rows = [(i, (centres[i % 16] + rnd.integers(-9, 9, 16)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    done, plain = [], search.visited

    def counted(blocks, visits, *rest):
        done.append((visits.count(), blocks.select("shard").distinct().count()))
        return plain(blocks, visits, *rest)

    monkeypatch.setattr(search, "visited", counted)
    assert Counter(map(tuple, search.top_k(df, F.col("vec_id") % 100 == 0).collect())) == plain_top(rows, 10)
    (first, shards), (others, _) = done
    assert first == 16 and others < 16 * shards / 4


def test_query_of_search_equals_sql(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([0.5, -0.25, 0.0, 0.0014]) for _ in range(6)]) for i in range(300)]
    rows += [(300, [nan] * 6), (301, [inf] * 6), (302, None), (303, [None] + [1.0] * 5), (100, [0.5] * 6), (None, [0.5] * 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = search.op12_top_k(spark, str(tmp_path))
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert Counter(map(tuple, found.collect())) == Counter(con.sql(search.OP12_SQL).fetchall())


def plain_alignment(rows):
    """Every column of the query, from whole texts and pairwise comparison of byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.tokenizer_paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def ranges(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at += len(of(i))
        return out

    docs, counts = [], Counter()
    for doc_id, text in rows:
        x, y = ranges(a.encode(f" {text or ''}", add_special_tokens=False).ids, bytes_a), ranges(b.encode(text or ""), bytes_b)
        whole = f" {text}".encode()
        if not text or b"".join(bytes_a(i) for *_, i in x) != whole or b"".join(bytes_b(i) for *_, i in y) != whole:
            docs.append((doc_id, None))
            continue
        links = [(i, j) for s, e, i in x for u, v, j in y if s < v and u < e]
        bounds = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups = [",".join(str(i) for _, e, i in x if low < e <= high) + "|" + ",".join(str(j) for _, e, j in y if low < e <= high) for low, high in zip([0, *bounds], bounds)]
        docs.append((doc_id, (len(x), len(y), groups, links)))
        counts.update(set(links))
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    for doc_id, known in docs:
        if known is None:
            yield doc_id, 0, 0, 0, 0, 0, 0, ""
        else:
            n_a, n_b, groups, links = known
            yield doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest(";".join(groups).encode())


ODD = ["", None, " ", "  a", "a  b", "\n", "\nfoo", "a\nb", "a \nb", "a\n b", "a\n\nb", "x\t y", "▁", "a▁b", "a<|endoftext|> b", "<s> x </s>", "é ﬁ", "中文字符没有空格" * 30, "　a b", "it's I'll",
       "\x1c a", "a\x85b c", "\x00 a", "😀 b😀", "end \n", "a b ", "<0x41> b", "\r\n a\r\nb", "a\rb c", "\n\n", " \n a", "a b\n"]


@pytest.mark.parametrize("limits", [{}, {"SHARD_KEYS": 32, "ROUND_KEYS": 64, "CHUNK": 16, "FAN": 2}])
def test_alignment_equals_brute_force(docs_of, awkward, spark, tmp_path, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    rows = [(*r, "en", "s")[:4] for r in awkward if len(r[1] or "") < 6000] + [(100 + i, t, "en", "s") for i, t in enumerate([*ODD, *ODD[5:9]])]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, alignment.op13_cross_tokenizer(spark, str(tmp_path)).collect()))
    assert got == Counter(plain_alignment([r[:2] for r in rows]))
    assert alignment.aligned(docs_of([]), *alignment.tokenizer_paths()).count() == 0


def test_perfect_hash_numbers_every_key_once_and_knows_strangers():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 2**47, 20_000))
    shards = 5
    own = alignment.shard_of(keys, shards)
    rows = [(s, *alignment.PerfectHash.build(keys[own == s])) for s in range(shards)]
    known = alignment.PerfectHash(shards, rows)
    index = known(keys)
    assert sorted(index.tolist()) == list(range(len(keys))) and (known.keys[index] == keys).all()
    strangers = np.setdiff1d(rnd.integers(0, 2**47, 5000), keys)
    assert (known(strangers) == -1).all()
    assert (alignment.PerfectHash(shards, rows[:2])(keys[own > 1]) == -1).all()


def test_workers_remember_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 1 << 20)
    own = alignment.Aligner(*alignment.tokenizer_paths())
    rnd = random.Random(3)
    most = 0
    for _ in range(60):
        own(["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(800)) for _ in range(4)])
        most = max(most, own.held)
    assert most < 3 << 20
