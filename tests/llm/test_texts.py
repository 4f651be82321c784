import os
import random

import pytest

from siftwell.llm import artefacts as A
from siftwell.llm import bpe, mixing, splitting, subjects

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="no vocabulary files")
ODD = ["", " ", "  \n\t", "a", "don't I'LL they've  x", "\x1c\x1d a\x85b", "½5 ٣٤ 1² x", "é̂́ 👩‍🌾 мир naïve café", "﻿bom\r\n\r\n  end ", "<|endoftext|>", "x" * 3000, "0123456789abcdef" * 200, "　全角　ｆｕｌｌ", "\x00\x01", "a_b__c -- ::", "'s 't's ''ll"]


def why(text, kind):
    found = A.text_reason(text, kind)
    return found and found[0]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(bpe.vocabulary_path()))


@needs_vocabulary
def test_perfect_hash_is_minimal_and_the_two_tiers_agree(encoder):
    tokens = bpe.read_vocabulary(bpe.vocabulary_path())
    assert sorted(encoder.hash.slots) == list(range(len(tokens)))
    assert all(encoder.lookup(t) == i for i, t in enumerate(tokens))
    assert all(encoder.merge(t) == [i] for i, t in enumerate(tokens) if i % 7 == 0)
    assert encoder.lookup(b"surely not a token") == -1


@needs_vocabulary
def test_encoding_equals_a_public_library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_vocabulary(bpe.vocabulary_path()))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "ab Z9_'s\n\r\t.½éя世 \x1f🙂-{};\"t"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    for t in texts:
        assert encoder.encode(t) == other.encode_ordinary(t), t[:40]


@needs_vocabulary
def test_encoding_columns(spark, encoder):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate([*ODD, None])], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_column(df, "text").collect()}
    assert got == {i: encoder.encode(t) for i, t in enumerate([*ODD, None])} and got[len(ODD)] == [] == got[0]
    assert {r.doc_id: r.tokens for r in bpe.count_tokens(df, "text").collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.encode_column(df.limit(0), "text").count() == 0


def test_range_maximum_equals_brute_force():
    rng = random.Random(8)
    for _ in range(50):
        v = [rng.randrange(5) for _ in range(rng.randint(1, 70))]
        index = splitting.RangeMaximum(v)
        for _ in range(40):
            a = rng.randrange(len(v))
            b = rng.randrange(a, len(v))
            assert index.query(a, b) == max(range(a, b + 1), key=lambda i: (v[i], i))


def test_cuts_hold_limit_and_overlap():
    rng = random.Random(9)
    for _ in range(300):
        n, most, overlap = rng.randint(0, 200), rng.randint(1, 30), rng.randint(-1, 40)
        pieces = splitting.cuts([rng.randrange(4) for _ in range(n)], most, overlap)
        assert (pieces == []) == (n == 0)
        step = min(max(0, overlap), most - 1)
        for (first, own, last, _), after in zip(pieces, [*pieces[1:], None]):
            assert first <= own <= last and last - first + 1 <= most
            if after:
                assert after[1] == last + 1 and after[0] == max(first, after[1] - step)
        assert not n or (pieces[0][:2] == (0, 0) and pieces[-1][2] == n - 1)


CHUNKS = "chunk_id long, file_id long, start_line int, end_line int, kind string, most int"


def test_split_between_blocks(spark, rows):
    block = lambda name: [f"// about {name}", f"int {name}(int x) {{", *["    x += 1;"] * 6, "}", ""]
    code = "\r\n".join(["#include <a>", "", *block("one"), *block("two"), *block("three")])
    page = "\n".join(f"## H{i}\n```\n# no\n```\ntext\n" for i in range(4))
    chunks = spark.createDataFrame([(1, 10, 3, 32, "x", 1), (1, 10, 3, 32, "x", 1), (2, 20, 1, 24, "x", 1), (3, 30, 1, 40, "x", 1), (4, 40, 1, 40, "x", 1), (5, 10, None, 9, "x", 1), (6, 10, 9, 1, "x", 1), (7, 10, 1, 3, "x", 1), (8, None, 1, 90, "x", 1), (9, 50, 1, 3, "x", 1)], CHUNKS)
    files = spark.createDataFrame([(10, "Code"), (10, None), (20, "Docs"), (30, None), (40, "Code"), (50, "Code")], "file_id long, kind string")
    texts = spark.createDataFrame([(2, 10, "later"), (1, 10, code), (3, 20, page), (4, 50, "a" * 100000)], "doc_id long, file_id long, text string")
    limits = spark.createDataFrame([("Code", 13, 2), ("Docs", 9, 1), (None, 1, 1)], "kind string, max_lines int, overlap_lines int")
    pieces = splitting.split_oversized(chunks, files, texts, limits)
    assert sorted(map(tuple, splitting.block_cuts(pieces).collect())) == [(1, 13), (1, 23), (2, 7), (2, 13), (2, 19)]
    spans = sorted(map(tuple, pieces.select("chunk_id", "start_line", "end_line").collect()))
    assert [s for s in spans if s[0] == 1] == [(1, 3, 12), (1, 11, 22), (1, 21, 32)]
    assert all(b - a < 13 for c, a, b in spans if c == 4) and {s[0] for s in spans} == {1, 2, 4}
    assert splitting.split_oversized(chunks.limit(0), files, texts, limits).count() == 0
    assert splitting.split_oversized(chunks, files, texts, limits.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,kind,reason",
    [
        ("// Code generated by x. DO NOT EDIT.\nint a;", "Code", "generated"), ("// Licence\n//\n// @generated by x from y.idl\nint a;", "Code", "generated"), ("# T\n\ntext\n<!-- end of the output of x v1, edits are lost on the next run -->", "Docs", "generated"),
        ('int a;\nwrite(out, "// Code generated by x. DO NOT EDIT.");', "Code", None), ("int a;\n// first generated by x years ago, maintained by hand since then", "Code", None), ("# T\nGenerated files carry a DO NOT EDIT line.", "Docs", None),
        ("/* taken verbatim from lib@1.2.3 */\nint a;", "Code", "third_party"), ("// Copyright the cart authors\n// SPDX-License-Identifier: MIT\nint a;", "Code", None), ("", "Code", None), (None, "Code", None), (" \n", None, None),
        ("!function(a,b){a.x=b?1:0}(this,1);" * 80, "Code", "minified"), ('export const x = "' + "Ab0/" * 400 + '"', "Code", "data"), ("T = [\n" + "    (12, 0.5, 7),\n" * 90 + "]\n", "Code", "data"),
        ("INSERT INTO t VALUES (120034, 'abcdef012345', 830.25);\n" * 60, "Code", "data"), ("a = 1\n" * 40, "Config", None), ("word " * 4000, "Docs", None),
    ],
)
def test_reasons_of_texts(text, kind, reason):
    assert why(text, kind) == reason


def test_the_whole_comment_runs_tell():
    licence, code = "// Licence terms apply.\n" * 40, "int a;\nlong total(cart *c) {\n  return c->n + 1;\n}\nvoid close(void);\n"
    assert why(licence + "// Code generated by x. DO NOT EDIT.\n" + code, "Code") == "generated"
    assert why(licence + code, "Code") is None and why(licence + "//\n// vendored from upstream\n" + code, "Code") == "third_party"
    end = "// end of the output of x\n"
    assert why(code + end + "\n" * 9, "Code") == "generated"
    assert why(code + end + "// more\n" * 9, "Code") == "generated"
    assert why(code + end + "}\n\n\n}\n", "Code") == "generated"
    assert why(code + end + code, "Code") is None


@pytest.mark.parametrize(
    "text,reason",
    [
        ("\n".join(f'const a{i} = f(b{i}, "x{i}");' for i in range(40)), None),  # a run of like statements may be written by hand
        ("// Licence\n" * 20 + "\n".join(f"set(a{i}, b{i});" for i in range(9)), None),
        ("\n".join(f"def get_{i}(self):\n    return self.a{i}\n" for i in range(12)), "generated"),
        ("\n".join(f"def get_{i}(self):\n    return self.a{i}\n" for i in range(12)) + "\nx = 1\n", None),
        ("\n".join(f"def get_{i}(self):  \n    return self.a{i}\n" for i in range(12)), None),
        ("x=[" + ",".join(str(7 * i) for i in range(900)) + "]", "data"), ("[" + ",".join(f'"w{i}"' for i in range(600)) + "]", "data"),
        ("<ul>" + "".join(f"<li class=a{i}>word word word word</li>" for i in range(200)) + "</ul>", "minified"),
        ("a=1;" * 60 + "b(a)", "minified"), ("if (a) { b(); c(); d(); e(); f(); }", None), ("let s: &'a str = f(x); let t: &'b str = g(y);\n" * 3, None),
        ("x = 'don\\'t' // it's\ny = 1", None), ("/* open", None), ("key = " + "value " * 300, None), ("LIMIT = 5", None),
    ],
)
def test_reasons_of_layouts(text, reason):
    assert A.layout_reason(text, "Code") == reason


def test_canonical_layout():
    assert A.canonical("  if (a) { b(); }  ") == ["if (a) { b(); }"] and A.canonical("  ") == []
    wide = "f(" + ", ".join(f"argument_{i}" for i in range(20)) + ");g(1);"
    assert A.canonical(wide) == ["f(", *[f"  argument_{i}," for i in range(19)], "  argument_19", ");", "g(1);"]
    assert A.canonical(".a{b:c}" * 30) == [".a{b:c}"] * 30
    for text in ("((((" * 300, "))))" * 300, "{" * 500 + "}" * 500, '"' * 999, "a" * 5000):
        assert "".join("".join(A.canonical(text)).split()) == text
    code, chars, count, longest = A.lexed("a = 'x // y' // it's \"one\"\nb = \"/* no */\" /* 'c' */\n")
    assert code.split("\n")[0].strip() == 'a = "ssssss"' and (chars, count, longest) == (18, 2, 10)


def test_stamped_blocks():
    assert A.stamped(list("abab" * 3)) and not A.stamped(list("a" * 40)) and not A.stamped(list("abababa")) and not A.stamped(list("abab")) and not A.stamped([])


def test_artefacts(spark, rows):
    files = spark.createDataFrame([(1, "vendor/a.c", "Code"), (1, "vendor/a.c", "Code"), (2, "src/vendor_portal/a.c", "Code"), (3, "x/Cargo.lock", None), (4, "src/a.c", "Code"), (5, None, None), (None, "vendor/b.c", "Code"), (6, "web\\assets\\lib-1.2.3-x.css", "Code"), (7, "api/a.pb.go", "Code"), (8, "s/a.js.map", None)], "file_id long, path string, kind string")
    texts = spark.createDataFrame([(4, "// @generated\n", "Code"), (4, "int a;", "Code"), (99, "// @generated\n", "Code"), (None, "// @generated\n", "Code"), (2, None, None), (5, "", None)], "file_id long, text string, kind string")
    assert rows(A.artefacts(files, texts)) == [(1, "third_party", "path"), (3, "locked", "path"), (4, "generated", "comment"), (6, "third_party", "path"), (7, "generated", "path"), (8, "locked", "path")]
    assert A.artefacts(files.limit(0), texts).count() == 0


DOCS, TARGETS = "doc_id long, source string, tokens long, key string, share double", "source string, target_share double, max_repeats int"


def queue(docs, targets):
    """Brute force of the queue's totals, in any order of documents: a source
    advances to share times the virtual time, or to all that it may give."""
    sizes = {}
    for _, s, t, *_ in docs:
        if s and s.strip():
            sizes[s.strip().lower()] = sizes.get(s.strip().lower(), 0) + (t or 0)
    budget = sum(sizes.values())
    low, high = 0.0, 1e12
    got = lambda v: sum(min(sizes.get(s, 0) * m, share * v) for s, share, m in targets)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if got(mid) < budget else (low, mid)
    return budget, {s: min(sizes.get(s, 0) * m, share * low) for s, share, m in targets}


def test_mixing_meets_shares_and_caps(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["a", "A ", "a", "a", "b", " B", "c", None, " "]), rng.choice([None, 0, 50, 90, 200]), "clash", 0.5) for i in range(3000)]
    targets = [("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.2, 1), ("d", 0.0, 3)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    mix = mixing.fair_queue(d, t)
    budget, want = queue(docs, targets)
    report = {r.source: r for r in mixing.mix_report(d, t, mix).collect()}
    for s, x in want.items():
        assert abs(report[s].drawn - x) <= 1000, (s, report[s].drawn, x)
    assert budget <= sum(r.drawn for r in report.values()) < budget + 200
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert {s for s, r in report.items() if r.short} == {s for s, share, m in targets if sum((x[2] or 0) for x in docs if x[1] and x[1].strip().lower() == s) * m < share * budget}
    assert mix.groupBy("doc_id", "repeat").count().where("count > 1").count() == 0
    assert mix.groupBy("source").agg({"repeat": "max"}).where("source = 'a' and `max(repeat)` > 1").count() == 0


def test_mixing_nothing(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 1), ("z", None, None)], TARGETS)
    mix = mixing.fair_queue(d, t)
    assert mix.count() == 0
    assert {(r.source, r.drawn, r.actual_share, r.short) for r in mixing.mix_report(d, t, mix).collect()} == {("a", 0, None, False), ("z", 0, None, False)}
    assert mixing.fair_queue(spark.createDataFrame([(1, "a", 5, "", 0.0)], DOCS), t.limit(0)).count() == 0


WORDS = {"law": "court judge verdict appeal statute clause".split(), "music": "chord melody rhythm tempo choir octave".split(), "farm": "crop soil herd silo barley tractor".split()}
COMMON = "value name list index update the of record part limit".split()


def corpus(seed, n=240):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rng.choice([["law"], ["music"], ["farm"], ["law", "farm"], []])
        body = [rng.choice(COMMON) for _ in range(40)]
        for s in own:
            body += [rng.choice(WORDS[s]) for _ in range(16)]
        if own:
            body.append(rng.choice(WORDS[rng.choice(list(WORDS))]))
        rng.shuffle(body)
        docs.append((i, "_".join(body[:20]) + " " + "".join(w.title() for w in body[20:40]) + " " + " ".join(body[40:]), "clash"))
        truth[i] = set(own)
    return docs, truth


def test_subjects_spread_from_few_seeds_and_shrug_off_wrong_ones(spark):
    docs, truth = corpus(11)
    labels = [(i, s) for i, own in truth.items() if i % 6 == 0 for s in own]
    wrong = next(i for i, own in truth.items() if own == {"law"} and i % 6)
    labels += [(wrong, "music"), labels[0], (None, "law"), (1, None), (10**6, "law")]
    d = spark.createDataFrame([*docs, (9001, None, ""), (9002, "", ""), (9003, "  \n", "")], "doc_id long, text string, n string")
    got = {}
    for r in subjects.subject_areas(d, spark.createDataFrame(labels, "doc_id long, subject string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == own for i, own in truth.items())
    assert right >= 0.97 * len(truth) and not {9001, 9002, 9003} & set(got)
    assert got[wrong] == {"law"}


def test_edges_are_the_same_by_joins_and_within_tasks(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(4, 60)[0], "doc_id long, text string, n string")
    held = subjects.document_words(docs).select("doc_id", "n", "words").cache()

    def edges():
        return {r.doc_id: sorted(map(tuple, r.near)) for r in subjects.similar(subjects.signatures(held)).collect()}

    within = edges()
    monkeypatch.setattr(subjects, "BROADCAST_WORDS", 0)
    joined = edges()
    assert within.keys() == joined.keys() and len(within) > 40
    for doc, near in within.items():
        assert [h for h, _ in near] == [h for h, _ in joined[doc]] and all(abs(a - b) < 1e-4 for (_, a), (_, b) in zip(near, joined[doc]))
    held.unpersist()


def test_all_partners_are_heard(spark):
    docs = spark.createDataFrame(corpus(4, 60)[0], "doc_id long, text string, n string")
    sigs = subjects.signatures(subjects.document_words(docs).select("doc_id", "n", "words")).cache()
    vectors = {r.doc_id: {t.w: t.x for t in r.sig} for r in sigs.collect()}
    pairs = {(i, j): sum(x * b.get(w, 0) for w, x in a.items()) for i, a in vectors.items() for j, b in vectors.items() if i != j}
    listed = {(r.doc_id, j): cos for r in subjects.similar(sigs).collect() for j, cos in map(tuple, r.near)}
    assert {p for p, cos in pairs.items() if cos > 0.1001} <= set(listed) <= {p for p, cos in pairs.items() if cos > 0.0999}
    assert all(abs(pairs[p] - cos) < 1e-5 for p, cos in listed.items())

    parts = {i: {"law": 0.25, "farm": 0.75} if i % 3 else {"law": 1.0} for i in vectors if i % 2}
    labels = spark.createDataFrame([(i, list(p.items())) for i, p in parts.items()], "doc_id long, parts array<struct<subject string, part double>>")
    sums = subjects._sums(sigs, labels)
    want = {}
    for (i, j), cos in pairs.items():
        for s, part in parts.get(j, {}).items():
            want[i, s] = want.get((i, s), 0) + cos * part
    got = {(r.doc_id, r.subject): r.x for r in subjects._heard(sigs, labels, sums.select("w", "subject", "said")).collect()}
    assert all(abs(got.get(k, 0) - want.get(k, 0)) < 1e-5 for k in got.keys() | want.keys())
    sigs.unpersist()


def test_labels_are_the_same_by_joins_and_within_tasks(spark, monkeypatch):
    docs, truth = corpus(7, 120)
    d = spark.createDataFrame([*docs, (500, "", "")], "doc_id long, text string, n string")
    sigs = subjects.signatures(subjects.document_words(d).select("doc_id", "n", "words")).cache()
    seeds = spark.createDataFrame([(i, sorted(own)) for i, own in truth.items() if own and i % 5 == 0] + [(500, ["law"])], "doc_id long, marked array<string>")

    def labels():
        return {(r.doc_id, p.subject): p.part for r in subjects.propagated(sigs, seeds).collect() for p in r.parts}

    within = labels()
    monkeypatch.setattr(subjects, "BROADCAST_WORDS", 0)
    joined = labels()
    assert within.keys() == joined.keys() and len(within) > 80 and within[500, "law"] == 1
    assert all(abs(part - joined[k]) < 1e-6 for k, part in within.items())
    sigs.unpersist()


def test_subjects_without_labels_or_documents(spark):
    d, none = spark.createDataFrame(corpus(1, 5)[0], "doc_id long, text string, n string"), spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.subject_areas(d, none).count() == 0
    assert subjects.subject_areas(d.limit(0), spark.createDataFrame([(1, "law")], "doc_id long, subject string")).count() == 0


def test_words():
    assert subjects.words("targetField.push(read_item2(7)) HTTPServer läuft") == ["target", "field", "push", "read", "item", "httpserver", "läuft"]
