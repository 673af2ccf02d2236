"""Mixing, packing, pages and the pipeline."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from riskflow.llm import exact, html, mixing, packing, quality, simhash, tokens
from riskflow.llm.tokens import encoder
from tests.llm.test_dedup import in_duck, ordered


def test_mix_equals_sql_and_fills_targets(docs_of, awkward):
    df = docs_of(awkward)
    got = ordered(mixing.mix(df))
    assert got == in_duck(df, mixing.OP6_SQL)
    found = mixing.mix(df).collect()
    assert all(r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"] for r in found)
    assert sum(r.taken for r in found) <= sum(r["size"] for r in found)
    taken = mixing.take(df)
    assert taken.columns == df.columns
    times = Counter(r.doc_id for r in taken.collect())
    want = Counter()
    for r in found:
        want[r.doc_id] += r.taken // r["size"] if r["size"] else 0
    assert times == +want
    assert mixing.mix(docs_of([])).count() == 0 and mixing.take(docs_of([])).count() == 0 and {r.taken for r in mixing.mix(docs_of([(1, None), (2, " ")])).collect()} == {0}


def test_a_scarce_source_stops_at_three_times_its_size(docs_of):
    rows = [(i, "w " * 10, "en", "a") for i in range(5)] + [(100 + i, "w " * 10, "en", "b") for i in range(95)]
    found = mixing.mix(docs_of(rows)).collect()
    assert {r.target for r in found} == {150.0, 850.0}
    assert sum(r.taken for r in found if r.doc_id < 100) == 150 and sum(r.taken for r in found if r.doc_id >= 100) == 850


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=25))
@settings(max_examples=200, deadline=None)
def test_patterns_hold_every_piece_once(counts):
    patterns = packing.solve(counts, 40)
    held = Counter()
    for pattern, times in patterns:
        assert sum(n * k for n, k in pattern) <= 40 and times > 0
        for n, k in pattern:
            held[n] += k * times
    assert held == Counter(counts)
    bound = -(-sum(n * c for n, c in counts.items()) // 40)
    assert bound <= sum(t for _, t in patterns) <= 2 * bound  # two sequences never fit one


def least(pieces, size):
    best = [len(pieces)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= pieces[i]:
                rooms[k] -= pieces[i]
                go(i + 1, rooms)
                rooms[k] += pieces[i]
        go(i + 1, [*rooms, size - pieces[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rnd = random.Random(8)
    for _ in range(300):
        pieces = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))), reverse=True)
        fixed, rest = packing.reduce_instance(Counter(pieces), 20)
        left = sorted((n for n, c in rest.items() for _ in range(c)), reverse=True)
        assert sum(t for _, t in fixed) + (least(left, 20) if left else 0) == least(pieces, 20), pieces


def test_millions_of_pieces_are_fixed_in_a_few_steps():
    for n in (3, 4, 1000, 1_000_000):
        fixed, rest = packing.reduce_instance({1500: n, 540: n, 200: n}, 2048)
        assert len(fixed) + len(rest) < 12
        held = Counter(rest)
        for pattern, times in fixed:
            for length, each in pattern:
                held[length] += each * times
        assert held == {1500: n, 540: n, 200: n}


def test_workers_remember_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 1 << 20)
    code, rnd, most = tokens.Encoder(packing.tokenizer_path()), random.Random(3), 0
    for _ in range(60):
        code.encode(["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(800)) for _ in range(4)])
        most = max(most, code.held)
    assert most < 2 << 20


def test_ids_equal_the_tokenizer_on_whole_texts(awkward):
    code = encoder(packing.tokenizer_path())
    texts = [t or "" for _, t, *_ in awkward] + ["a  b", " a", "b ", "a\n b", "x\n\ny", "\nfoo bar", "a\nb c", "é à  \t z", "\x1c a \x1c", " \n ", "a <|endoftext|> b", "don't  stop"]
    rnd = random.Random(1)
    texts += ["".join(rnd.choice(["a", "b", " ", "\n", "\t", " ", ".", "1", "é"]) for _ in range(30)) for _ in range(400)]
    for t, ids in zip(texts, code.encode(texts)):
        assert code.tokenizer.encode(t, add_special_tokens=False).ids == ids.tolist(), repr(t)


def test_packed_pieces_rebuild_the_documents(docs_of, awkward):
    rows = [r for r in awkward if r[0] not in (9, None)]
    code = encoder(packing.tokenizer_path())
    found = packing.pack(docs_of(rows), packing.tokenizer_path(), 256).collect()
    ids = {r[0]: np.append(code.encode([r[1] or ""])[0], 0).astype("<u4") for r in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, parts in by_doc.items():
        parts.sort()
        assert [p for p, *_ in parts] == list(range(len(parts))) and all(n == 256 for _, _, n in parts[1:])
        assert [s for _, s, _ in parts] == [sum(n for *_, n in parts[:i]) for i in range(len(parts))] and sum(n for *_, n in parts) == len(ids[d])
    assert by_doc.keys() == ids.keys()
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    twice = packing.pack(docs_of([(1, "a b"), (1, "a b"), (None, None)]), packing.tokenizer_path()).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == 3
    assert packing.pack(docs_of([]), packing.tokenizer_path()).count() == 0


def page(n, article, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><div class='zz{n}'>Welcome to our lovely site</div><nav><a href=/>Home</a></nav>"
            f"{article}<div class=comments><p>first!</p></div><div class='cookie-notice'>We use cookies</div><form>Search</form><!-- x --><footer>&copy; {n}</footer></body>")


@pytest.mark.parametrize("source, text", [
    ("", ""), (None, ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b &lt;i&gt; <b>c</b>d", "a\nb <i> cd"), ("<article><header><h1>T</h1></header><p>x\n  y<br>z</p></article>", "T\nx y z"),
    ("<div class=sidebar>s</div><div id=content><h1>H</h1><p>para</p><script>var a='</p>'</script></div>", "H\npara"), ("<main>m<aside>no</aside></main><p>out", "m"),
    ("<article><p>a</p><div class='ad'>buy</div><p>b</p><article class=comment><p>c</p></article></article>", "a\nb"), ("<p title='a > b'>t</p", "t"), ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<body class='has-sidebar'><div class='page sidebar-right'><div class='sidebar'>s</div><div class='post-body'><p>the text itself, long enough to count</p></div></div>", "the text itself, long enough to count"),
    ("<div id=main><p>short</p><div class=comments><div class=post-content>a reader writes much more than the author did</div><div class=post-content>and another reader too, at length</div></div></div>", "short")])
def test_main_text(source, text):
    root = html.parse(source or "")
    html.settle(root)
    assert html.article(root) == text


def test_deep_pages_do_not_recurse():
    root = html.parse("<div>" * 20_000 + "deep")
    html.settle(root)
    assert html.article(root) == "deep"


def test_broken_pages_take_linear_time():
    for source in ("<div>" * 20_000 + "</b>" * 20_000 + "x", "<" + "a" * 200_000, "<b>" * 20_000 + "<hr>" * 20_000 + "x", "<td>" + "<b>" * 20_000 + "</div>" * 20_000 + "x"):
        began = time.monotonic()
        html.settle(html.parse(source))
        assert time.monotonic() - began < 3


def test_templates_of_a_section_go(spark):
    box = {s: f"<div>The {s} desk answers your letters every day.</div>" for s in ("news", "sport", "arts")}
    rows = [(i, f"http://h.example/{s}/{i}", f"<body><div><p>Story {i} of the {s} pages, told in full.</p>{box[s]}</div></body>") for i, s in enumerate(list(box) * 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (10**6, 0):
        got = {r.page_id: r.text for r in html.extract(df, limit=limit).collect()}
        assert got == {i: f"Story {i} of the {s} pages, told in full." for i, s in enumerate(list(box) * 6)}


def test_templates_go_on_both_paths(docs_of, spark):
    rows = [(i, f"http://h.example/{i}", page(i, f"<div><p>The story number {i} is told here at some length.</p><p>And it goes on.</p><p>Our motto stands below every story.</p></div>"), "x") for i in range(8)]
    same = page(0, "<div><p>One story under many addresses, told at length.</p></div>")
    rows += [(100 + i, f"http://copies.example/{i}", same, "x") for i in range(20)]
    rows += [(200, None, None, "x"), (201, "http://x", "", "x"), (202, "http://h.example/0", rows[0][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, subtree string")
    for limit in (10**6, 0):
        got = {r.page_id: r for r in html.extract(df, limit=limit).collect()}
        assert len(got) == len(rows)
        assert got[3].text == "The story number 3 is told here at some length.", got[3].text
        assert got[105].text == "One story under many addresses, told at length."
        assert got[200].text == "" and got[201].n_chars == 0 and got[202].text == got[0].text
    assert html.extract(df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs_of, awkward):
    df = docs_of(awkward)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns, name
        assert stage(spark, docs_of([]), "").count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "sequence_packing"]


def test_run_equals_the_operators_one_after_another(spark, docs_of, awkward, tmp_path, rows_of):
    rnd = random.Random(23)
    words = "the of and to in that with from river stone winter garden letter morning silver window".split()
    rows = [*awkward] + [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(20, 90))), "en", rnd.choice("abc")) for i in range(120)]
    rows += [(300 + i, rows[-1 - i][1] + " ", "en", "a") for i in range(10)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    docs = docs_of(rows)
    good = quality.judged(docs).where("kept").select("doc_id").distinct()
    docs = docs.where("doc_id is not null").join(good, "doc_id", "left_semi")
    kept = exact.exact_duplicates(docs).where("kept").select("doc_id")
    docs = docs.join(kept, "doc_id", "left_semi")
    near = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id")
    docs = docs.join(near, "doc_id", "left_semi")
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    packed = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got.collect())
    once = Counter({(r.doc_id, r.piece, r.length, r.ids_crc32): times[r.doc_id] for r in packing.pack(docs, packing.tokenizer_path()).collect() if times.get(r.doc_id)})
    assert packed == once and len(packed) > 20


@pytest.mark.parametrize("source, text", [
    ("<body><article><p>First part.</p></article><article><p>The second and longer part.</p></article></body>", "First part.\nThe second and longer part."),
    ("<body><main><h1>Heading</h1><p>Lead.</p><article><p>The text itself.</p></article></main><footer>x</footer></body>", "Heading\nLead.\nThe text itself."),
    ("<body><article><p>Teaser.</p></article><main><p>The long text of this page.</p></main></body>", "Teaser.\nThe long text of this page."),
    ("<body><div class='content'><p>One.</p></div><nav>n</nav><div class='content'><p>Two, longer.</p></div></body>", "One.\nTwo, longer."),
    ("<body><nav>n</nav><div><div><p>Short.</p></div><div><p>A longer paragraph.</p></div></div><footer>x</footer></body>", "Short.\nA longer paragraph."),
    ("<body><nav>n</nav><div><div class='content'><p>Teaser.</p></div><div><p>The story in a div without a name.</p></div></div><footer>x</footer></body>", "Teaser.\nThe story in a div without a name."),
    ("<body><nav>n</nav><article><p>Told in part.</p></article><div>" + "Bare words of the story. " * 5 + "</div><footer>x</footer></body>", "Told in part.\n" + ("Bare words of the story. " * 5).strip()),
    ("<body><article><p class='byline'>By A. Writer</p><p>Sum: <math><mi>x</mi></math></p><div class='legal'>The law says so.</div></article></body>", "By A. Writer\nSum: x\nThe law says so."),
])
def test_all_content_elements_of_a_page_are_kept(source, text):
    root = html.parse(source)
    html.settle(root)
    assert html.article(root) == text


def test_special_tokens_in_texts_as_the_plain_call_has_them():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a  <|endoftext|>  b", "a\n<|endoftext|>\nb <|endoftext|>c", "<|endoftext|><|endoftext|> d", "a <|endoftext|>\n\nb", " <|endoftext|> "]
    got = [x.tolist() for x in encoder(packing.tokenizer_path()).encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(50256 in ids for ids in got)
