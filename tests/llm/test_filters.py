"""Quality rules, toxicity, grades and personal data."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import grading, pii, quality, toxicity

SPACES = r"[\x20\x09-\x0D]"


def brute_base(text):
    text = text or ""
    words = [w for w in re.split(SPACES + "+", text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.sub(SPACES, "", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_brute_force(awkward):
    rnd = random.Random(2)
    texts = [t for _, t, *_ in awkward] + ["a\nb\na\n\n \n \nb", "x y z x y z x y z x y z", "#*$%&|<>   a"]
    texts += ["".join(rnd.choice("ab \n#") for _ in range(80)) for _ in range(200)]
    for t in texts:
        assert quality.base_counts(t) == brute_base(t), t


def discounts(t1, t2, t3, t4):
    y = t1 / (t1 + 2 * t2) if t1 else 0.5
    return [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a else i * y for i, a, b in ((1, t1, t2), (2, t2, t3), (3, t3, t4))]


def brute_kneser_ney(rows):
    """Mean log-probability by definition, from dictionaries."""
    docs = [(lang or "", [0] * 3 + [32 if 9 <= ord(c) <= 13 else ord(c) for c in text or ""]) for _, text, lang, *_ in rows]
    held = defaultdict(set)
    for k, (lang, c) in enumerate(docs):
        for i in range(len(c) - 3):
            held[lang, tuple(c[i : i + 4])].add(k)
    n = [None, None, None, None, {g: len(ks) - 1 for g, ks in held.items()}]
    for k in (3, 2, 1):
        n[k] = defaultdict(int)
        for (lang, g), count in n[k + 1].items():
            n[k][lang, g[1:]] += count > 0
    langs = {lang for lang, _ in docs}
    d = [None] + [{x: discounts(*[sum(v == i for (lang, _), v in n[k].items() if lang == x) for i in (1, 2, 3, 4)]) for x in langs} for k in (1, 2, 3, 4)]
    symbols = {x: sum(lang == x for lang, _ in n[1]) + 1 for x in langs}
    contexts = [None] + [defaultdict(list) for _ in range(4)]
    for k in (1, 2, 3, 4):
        for (lang, g), count in n[k].items():
            contexts[k][lang, g[:-1]].append(count)

    def p(lang, g):
        if not g:
            return 1 / symbols[lang]
        k, below = len(g), p(lang, g[1:])
        counts = contexts[k][lang, g[:-1]]
        total = sum(counts)
        if not total:
            return below
        cut = lambda c: 0.0 if c == 0 else d[k][lang][min(c, 3) - 1]
        return max(n[k][lang, g] - cut(n[k][lang, g]), 0) / total + sum(map(cut, counts)) / total * below

    return [sum(np.log(p(lang, tuple(c[i : i + 4]))) for i in range(len(c) - 3)) / max(1, len(c) - 3) for lang, c in docs]


def test_perplexity_equals_the_definition_on_both_paths(docs_of, awkward):
    rows = [r for r in awkward if r[0] is not None and r[0] not in (4, 5, 12, 9)]
    df = docs_of(rows)
    want = {r[0]: x for r, x in zip(rows, brute_kneser_ney(rows))}
    model = quality.fit(df)
    for m in (model, quality.Model(model.table, None, model.numbers)):
        got = {r.doc_id: r.logp for r in quality.facts(df, m).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-5)


def test_characters_have_numbers_of_their_own(docs_of, monkeypatch):
    monkeypatch.setattr(quality, "HELD_NGRAMS", 10)
    text = "\u8020\u8009 \U0001f600\u7600\U0001f600"
    numbers = quality.numbered(docs_of([(1, text), (2, None), (3, "\U0001f600\n")]))
    assert numbers[0x1F600] == 1 and numbers[32] == 2 and len({int(numbers[ord(c)]) for c in text}) == 5
    assert numbers[ord("x")] == quality.RARE and quality.code_points("a\t\n\x0b\x0c\r").tolist() == [97] + [32] * 5


def test_verdicts_and_stage_agree(docs_of, awkward):
    df = docs_of(awkward)
    found = quality.judged(df).collect()
    assert len(found) == len(awkward)
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.kept)
    assert quality.judged(docs_of([])).count() == 0 and quality.keep_good(docs_of([])).count() == 0


def test_strange_text_is_rejected_and_plain_text_kept(docs_of):
    rnd = random.Random(7)
    words = "the of and to in that with from river stone winter garden letter morning silver window".split()
    plain = [(i, " ".join(rnd.choice(words) for _ in range(120))) for i in range(150)]
    strange = [(1000 + i, " ".join("".join(rnd.choice("qxzjvkwQXZJ0123") for _ in range(7)) for _ in range(120))) for i in range(3)]
    kept = {r.doc_id: r.kept for r in quality.judged(docs_of(plain + strange)).collect()}
    assert all(kept[i] for i, _ in plain) and not any(kept[i] for i, _ in strange)

def test_both_limits_of_a_band_reject(docs_of):
    rnd = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8))) for _ in range(600)]
    common = words[:12]

    def text(n, some):
        t = " ".join(rnd.choice(some) for _ in range(n))
        return t[:n]

    def garbled(t):
        c, at = list(t), rnd.sample(range(len(t)), len(t) // 5)
        for i, x in zip(at, rnd.sample([c[i] for i in at], len(at))):
            c[i] = x
        return "".join(c)

    sizes = [100, 300, 1000]
    # most words of a usual text are rare ones, a few are common in all
    usual = lambda n: text(n, words + common * 20)
    clean = [(i, usual(n)) for n in sizes for i in range(n * 1000, n * 1000 + 120)]
    low = [(10_000_000 + n * 10 + i, text(n, common)) for n in sizes[1:] for i in range(3)]
    mixed = [(20_000_000 + n * 10 + i, garbled(usual(n))) for n in sizes for i in range(3)]
    rows = {r.doc_id: r for r in quality.judged(docs_of(clean + low + mixed)).collect()}
    assert not any(rows[i].base_failed for i, _ in low + mixed)
    assert [i for i, _ in low + mixed if rows[i].kept] == []
    assert all(rows[i].perplexity < rows[i].lower for i, _ in low) and all(rows[i].perplexity > rows[i].upper for i, _ in mixed)
    assert [i for i, _ in clean if not rows[i].kept and not rows[i].base_failed] == []
    assert all(rows[i].lower > 1 for i, _ in clean)


def test_symbols_count_like_other_characters(docs_of, spark):
    rnd = random.Random(17)
    words = "the of and to in that with from river stone winter garden letter morning silver window".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(120))) for i in range(60)]
    rows += [(1000 + i, "\n".join("| " + " | ".join(rnd.choice(words) for _ in range(4)) + " |" for _ in range(30))) for i in range(20)]
    numbers = quality.numbered(docs_of(rows))
    counted = {r.gram: r.docs for r in quality.document_counts(docs_of(rows), spark.sparkContext.broadcast(numbers)).collect()}
    assert counted == Counter(int(g) for _, t in rows for g in np.unique(quality.ngrams(t, numbers)))
    found, other = ({r.doc_id: (r.kept, round(r.perplexity, 6)) for r in quality.judged(docs_of(x)).collect()} for x in (rows, [(i, t.replace("|", "/")) for i, t in rows]))
    assert found == other


def test_stage_decides_per_row_with_and_without_arrays(docs_of, awkward, rows_of):
    rnd = random.Random(19)
    words = "the of and to in that with from river stone winter garden letter morning silver window".split()
    rows = awkward + [(i if i % 3 else None, " ".join(rnd.choice(words) for _ in range(60))) for i in range(100, 160)]
    rows += [(None, "too short"), (101, "too short"), (101, None), (102, " ".join("qxzjvkw0123"[rnd.randrange(8) :] + "QXZ"[rnd.randrange(3) :] for _ in range(60)))]
    df = docs_of(rows)
    model = quality.fit(df)
    joined = quality.Model(model.table, None, model.numbers)
    kept = rows_of(quality.keep_good(df, model))
    assert kept == rows_of(quality.keep_good(df, joined))
    assert len(kept) == quality.judged(df, joined).where("kept").count()
    assert "too short" not in [r[1] for r in kept] and None in [r[0] for r in kept]


def labelled(docs_of, spark):
    rnd = random.Random(11)
    words = "river stone winter garden letter morning silver window table paper".split()
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(words) for _ in range(rnd.randint(15, 60))]
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["you idiot", "stupid", "M0RON", "zorgblatt"])
        if poor:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(900, None), (901, ""), (None, "no id")]
    return docs_of(rows), spark.createDataFrame([*labels, (5000, 1, 1), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int"), rows


def auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_toxicity_on_held_out_rows(docs_of, spark):
    df, labels, rows = labelled(docs_of, spark)
    found = toxicity.scored(df, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert auc([(r.score, r.doc_id % 4 == 0) for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]) > 0.95


def test_scores_without_labels(docs_of, spark):
    df = docs_of([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.scored(df, none).collect()} == {0.5}
    assert {round(r.expected_grade, 6) for r in grading.graded(df, none).collect()} == {1.0}
    _, labels, _ = labelled(docs_of, spark)
    assert toxicity.scored(docs_of([]), labels).count() == 0 and grading.graded(docs_of([]), labels).count() == 0


def test_ordinal_gradient():
    rnd = np.random.default_rng(0)
    f, y, free = rnd.normal(size=30), rnd.integers(0, 3, 30), np.array([-0.3, 0.2])
    loss, by_f, by_free = grading.loss_and_gradient(f, y, free)
    for i in range(2):
        step = np.eye(2)[i] * 1e-6
        assert (grading.loss_and_gradient(f, y, free + step)[0] - loss) / 1e-6 == pytest.approx(by_free[i], rel=1e-3)
    step = np.eye(30)[4] * 1e-6
    assert (grading.loss_and_gradient(f + step, y, free)[0] - loss) / 1e-6 == pytest.approx(by_f[4], rel=1e-3)


def test_grades_on_held_out_rows(docs_of, spark):
    df, labels, rows = labelled(docs_of, spark)
    found = grading.graded(df, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 1 >= r.p_at_least_1 >= r.p_at_least_2 >= 0 and r.expected_grade == pytest.approx(r.p_at_least_1 + r.p_at_least_2)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert auc([(r.p_at_least_1, r.doc_id % 5 != 0) for r in held]) > 0.95


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    for _ in range(20_000):
        t = "".join(rnd.choice("a1.@-+ 2%_(é\n") for _ in range(rnd.randint(0, 30)))
        assert pii.base_spans(t) == brute_spans(t), t
    for _ in range(3000):
        t = "".join(rnd.choice("0123456789 -") for _ in range(40)) + " +1 (415) 555-0100 4111111111111111"
        assert pii.base_spans(t) == brute_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "@" * 300_000, "Hash Hash " * 30_000, "A1" * 100_000, "_" * 200_000, "1 " * 100_000 + "9a"):
        began = time.monotonic()
        base = pii.base_spans(t)
        pii.candidates(t, base)
        assert time.monotonic() - began < 5, t[:8]


def test_words_are_hashed_whole():
    hashed = grading.Hasher()
    assert hashed.of("x" * 80 + "a")[0] != hashed.of("x" * 80 + "b")[0] and hashed.of("a1" * 20)[1] != hashed.of("a1" * 20 + "!")[1]
    assert not hashed.known and hashed.of("word") == hashed.known["word"]


def test_personal_data_of_rows(docs_of, awkward):
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    rows = [*awkward, (70, f"mail a.b@c.org {secret} from 10.0.0.1"), (71, f"{secret} and more"), (72, "key: " + secret)]
    found = {r.doc_id: r for r in pii.personal_data(docs_of(rows)).where("doc_id is not null").collect()}
    r = found[70]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0)
    assert r.spans.startswith("email:5:14,ip:") and ",secret:" in r.spans
    assert found[1].spans == "" and found[1].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert pii.personal_data(docs_of(rows)).count() == len(rows) and pii.personal_data(docs_of([])).count() == 0


def test_reliabilities_favour_agreeing_labellers():
    patterns = [("secret", (1, 1, -1, 1, 1), 50), ("secret", (0, 0, -1, 0, -1), 400), ("secret", (1, 1, -1, -1, -1), 30), ("secret", (0, 1, -1, 0, -1), 20)]
    p = pii.reliabilities(patterns)
    assert p["secret", (1, 1, -1, 1, 1)] > 0.95 and p["secret", (0, 0, -1, 0, -1)] < 0.05
    assert pii.reliabilities([]) == {}
