"""Operators 1, 2, 3, 7, 8, 10 and the pipeline against plain versions, and on odd rows."""

import math
import random
import re
import textwrap
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spoolyard.llm import common, exact_dedup, licenses, lines, mixing, near_dedup, registry, toxicity

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id here and more"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "x" * 3000 + " " + "y z " * 2000), (7, "ONE two three\nfour five six")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", "en", None, 1, "b") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, h string, n int, bucket string")


def find_of(parent):
    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return find


def plain_components(edges):
    parent: dict = {}
    find = find_of(parent)
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_both_ways(spark):
    pick = random.Random(2)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(30)] + [(300, i) for i in range(301, 340)]
    want = plain_components([e for e in edges if e[0] != e[1]])
    frame = spark.createDataFrame([*edges, (None, 1), (3, 3)], "a long, b long")
    assert dict(map(tuple, common.components(frame).collect())) == want
    high = frame.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    assert dict(map(tuple, common.star_components(common.keep(high, "t")).collect())) == want
    assert common.components(frame.limit(0)).count() == 0


# operator 8


def test_exact_matches_sql(same):
    same(exact_dedup.op8_exact_dedup, exact_dedup.ORACLE)


def test_exact_survives_colliding_hashes(spark):
    pick = random.Random(4)
    rows = [(i, "".join(pick.choices("ab \n", k=pick.randint(0, 4)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, hash_fn=lambda t: F.length(t)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"\s", "", t)].append((-len(t), i))
    for r in got:
        g = groups[re.sub(r"\s", "", rows[r.doc_id][1])]
        assert (r.keep_id, r.group_size, r.kept) == (min(g)[1], len(g), min(g)[1] == r.doc_id)


def test_exact_odd_rows(odd):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].keep_id == by[2].keep_id == by[3].keep_id == 3 and by[1].group_size == 3  # most code points
    assert by[5].group_size == 2 and by[5].kept and by[None].kept and by[None].group_size == 1
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


# operator 7


def plain_near(rows, k, similarity):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    root = plain_components(links)
    return {i: (len(sets[i]), root.get(i, i)) for i in ids}


def near_copies():
    """A chain of copies, a large group around one text, and texts that share a passage only."""
    pick = random.Random(9)
    word = lambda: "".join(pick.choices("abcdefgh", k=5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows, chain = [], base
    for _ in range(12):
        chain = [word() if pick.random() < 0.02 else w for w in chain]
        rows.append(" ".join(chain))
    for _ in range(60):
        rows.append(" ".join(word() if pick.random() < pick.choice((0.005, 0.02, 0.05)) else w for w in base))
    rows += [" ".join([word() for _ in range(40)] + passage) for _ in range(20)]
    rows += [rows[3], rows[3].upper(), "one two", "One two", "one"]
    pick.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "similarity"), [(3, 85), (5, 80)])
def test_near_matches_all_pairs(spark, k, similarity):
    rows = near_copies()
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k, similarity).collect()
    want = plain_near(rows, k, similarity)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_min_and_max_estimate_similarity():
    pick = np.random.default_rng(1)
    a = near_dedup.mix(pick.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.concatenate((a[:1700], near_dedup.mix(pick.integers(0, 2**63, 300).astype(np.uint64))))
    same = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(same - 1700 / 2300) < 0.2 and len(near_dedup.bands(near_dedup.signature(a))) == 20


def test_near_odd_rows(odd):
    rows = near_dedup.near_dedup(odd, 3, 85).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        assert (by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[7].component_id == 5 and not by[7].kept and by[5].kept
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_dedup(odd.limit(0)).count() == 0


# operator 1


def plain_lines(rows):
    """Dropped lines by all pairs: links are edit similarity alone, whatever buckets there are."""
    norms: dict = {}
    seen = [(i, k, norms.setdefault(n, len(norms))) for i, t in sorted(rows) for k, line in enumerate(t.split("\n")) if (n := lines.normalise(line))]
    names = list(norms)
    bags = [Counter(n) for n in names]
    may = lambda a, b: max((bags[a] - bags[b]).total(), (bags[b] - bags[a]).total()) * 100 <= (100 - lines.SIMILARITY) * max(len(names[a]), len(names[b]))
    links = [(a, b) for a in range(len(names)) for b in range(a) if may(a, b) and plain_edit(names[a], names[b])]
    root = plain_components(links)
    first, gone = set(), defaultdict(list)
    for i, k, n in seen:
        if root.get(n, n) in first:
            gone[i].append(k)
        first.add(root.get(n, n))
    return gone, len(links)


def plain_edit(a, b, least=lines.SIMILARITY):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return 100 * row[-1] <= (100 - least) * max(len(a), len(b))


def test_edit_similarity_in_the_bands():
    pick = random.Random(3)
    pairs = []
    for k in range(900):
        # Some lines are long enough for bands of several words, and for none.
        a = "".join(pick.choices("ab c", k=pick.randint(0, 60) if k < 700 else pick.randint(100, 500)))
        b = list(a)
        for _ in range(pick.randint(0, max(9, len(a) // 3))):
            b.insert(pick.randint(0, len(b)), pick.choice("abc")) if pick.random() < 0.5 or not b else b.pop(pick.randrange(len(b)))
        pairs.append((a, "".join(b), pick.choice((30, 50, 70, 80, 90))))
    most = np.array([max(len(a), len(b)) * (100 - least) // 100 for a, b, least in pairs])
    got = lines.edits_within([lines.codes_of(a) for a, _, _ in pairs], [lines.codes_of(b) for _, b, _ in pairs], most)
    assert got.tolist() == [plain_edit(*p) for p in pairs]
    may = lines.may_be_within([lines.codes_of(a) for a, _, _ in pairs], [lines.codes_of(b) for _, b, _ in pairs], most)
    assert not (got & ~may).any() and (~may).any()
    assert all(lines._whole(lines.codes_of(a).tolist(), lines.codes_of(b).tolist(), int(m)) == g for (a, b, _), m, g in zip(pairs, most, got, strict=True) if a and b)
    assert all(lines.edit_similar(*p) == g for p, g in zip(pairs[:50], got, strict=False))


def test_normalised_lines():
    texts = ["A  line, of 12 words!\n\n  --  \nÉté (2) ", "", "x\r\ny"]
    codes, start, size = lines.letters_of(texts)
    assert [codes[a : a + n].tobytes().decode("utf-32-le") for a, n in zip(start, size, strict=True)] == ["a line of 12 words", "", "", "été 2", "", "x", "y"]
    assert lines.normalise("Read-more: …") == "read more"


def test_lines_match_all_pairs(spark):
    pick = random.Random(6)
    word = lambda: "".join(pick.choices("abcdefgh", k=4))
    longs = [[word() for _ in range(150)] for _ in range(3)]
    rows = []
    for i in range(30):
        text = [" ".join(word() for _ in range(8)) for _ in range(3)]
        swapped = list(longs[i % 3])
        if i % 2:
            k = pick.randrange(140)
            swapped[k], swapped[k + 1] = swapped[k + 1], swapped[k]  # the same words, a few edits
        text.insert(pick.randrange(4), " ".join(swapped))
        text.append(f"Page {i}: the END of it!")
        rows.append((i, "\n".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.line_dedup(docs)
    kept = common.keep(got, "t")
    want, links = plain_lines(rows)
    assert links > 5
    assert {r.doc_id: r.dropped_lines for r in kept.collect() if r.n_dropped} == want
    clean = dict(map(tuple, lines.clean_texts(docs, kept).collect()))
    for i, t in rows:
        assert clean[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])


def edited_lines(seed, n):
    """Pairs of different normalised lines of edit similarity 0.9 or more: words replaced, or letters anywhere."""
    pick = random.Random(seed)
    word = lambda k: "".join(pick.choices("abcdefghilmnorstu", k=k))
    pairs = []
    while len(pairs) < n:
        a = [word(pick.randint(2, 9)) for _ in range(pick.choice((4, 8, 12, 20, 33, 60)))]
        b, edits = list(a), pick.randint(1, max(1, len(" ".join(a)) // 10))
        for _ in range(edits if len(pairs) % 2 else 1):
            k = pick.randrange(len(b))
            at = pick.randrange(len(b[k]))
            b[k] = b[k][:at] + word(1) + b[k][at + pick.randint(0, 1) :] if len(pairs) % 2 else word(len(b[k]))
        a, b = " ".join(a), " ".join(b)
        if a != b and plain_edit(a, b):
            pairs.append((a, b))
    return pairs


def test_lines_of_edit_similarity_are_found(spark):
    pairs = edited_lines(5, 400)
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    found = sum(r.n_dropped for r in lines.line_dedup(docs).collect())
    print("recall of pairs", found / len(pairs))
    assert found >= 0.97 * len(pairs)


def test_recall_by_words_and_edits(spark):
    """One typo, and a word replaced, dropped or put in, in lines of 5 to 150 words; of these the pairs at edit similarity 0.9."""
    pick = random.Random(21)
    word = lambda k: "".join(pick.choices("abcdefghilmnorstu", k=k))
    pairs = []
    for n in (5, 15, 40, 150):
        for kind in range(4):
            for _ in range(12):
                a = [word(pick.randint(2, 9)) for _ in range(n)]
                b, k = list(a), pick.randrange(n)
                b[k : k + 1] = ([b[k][:1] + "x" + b[k][2:]], [word(len(b[k]))], [], [b[k], word(4)])[kind]
                a, b = " ".join(a), " ".join(b)
                if a != b and lines.edit_similar(a, b):
                    pairs.append((a, b))
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    found = sum(r.n_dropped for r in lines.line_dedup(docs).collect())
    print("recall of pairs", found, len(pairs))
    assert found >= 0.97 * len(pairs) > 100


def test_large_buckets_count_by_two(spark):
    members = [(b, n) for n in range(10) for b in (1, 2)] + [(2, 10), (3, 0), (3, 11)] + [(1, n) for n in range(20, 30)]
    by = defaultdict(set)
    for r in lines.refined(spark.createDataFrame(members, "bucket long, node long")).collect():
        by[r.bucket].add(r.node)
    assert sorted(map(sorted, by.values())) == [list(range(10)), [0, 11]]


def test_large_buckets_lose_no_link(spark):
    """A pair whose only common bucket is large, and a group of near copies that goes by hubs."""
    pick = random.Random(2)
    letters = "abcdefghilmnorstu"

    def keys(texts):
        k, has = lines.keys_of(*lines.letters_of(texts))
        return [set(x[h].tolist()) for x, h in zip(k, has, strict=True)]

    a, b, key = next((a, b, min(both)) for a, b in edited_lines(9, 400) for p, q in (keys([a, b]),) if len(both := p & q) == 1)
    company = []
    while len(company) < 3 * lines.REFINE:
        tries = []
        for i in range(0, len(a) - 12, 3):
            # Two words around a run of a in its place.
            left, right = ("".join(pick.choices(letters, k=n)) for n in (i, len(a) - i - 18))
            tries.append(left + a[i : i + 18] + right)
        company += [t for t, k in zip(tries, keys(tries), strict=True) if key in k]
    long_ = "".join(pick.choices(letters, k=200))
    copies = [long_[:i] + "z" + long_[i + 1 :] for i in range(0, 200, 2)]
    found = {r.doc_id: r.n_dropped for r in lines.line_dedup(spark.createDataFrame(list(enumerate([a, b, *company, *copies])), "doc_id long, text string")).collect()}
    assert found[0] == 0 and found[1] == 1
    first = 2 + len(company)
    assert [found[i] for i in range(first, first + len(copies))] == [0] + [1] * (len(copies) - 1)


def test_near_copies_are_joined_by_few_comparisons(monkeypatch):
    """A text comes once to the task that settles its pairs, and pairs that are joined over others are not compared."""
    pick = random.Random(4)
    texts = []
    for _ in range(2):
        long_ = "".join(pick.choices("abcdefgh ijklmn", k=200)).strip()
        texts += [long_[:i] + "z" + long_[i + 1 :] for i in range(0, 180, 2)]
    n, compared, within = len(texts), [], lines.edits_within
    monkeypatch.setattr(lines, "edits_within", lambda a, *rest: compared.extend(a) or within(a, *rest))
    types = {"bucket": pa.int64(), "a": pa.int64(), "b": pa.int64(), "nodes": pa.binary(), "bytes": pa.int64(), "norms": pa.binary()}
    table = lambda m, **c: pa.RecordBatch.from_arrays([pa.array(c.get(k, [None] * m), t) for k, t in types.items()], names=list(types))
    flat = "\n".join([*texts, ""]).encode()
    own = table(1, nodes=[np.arange(n).tobytes()], bytes=[len(flat)], norms=[pa.compress(flat, "zstd", asbytes=True)])
    pairs = [(i, j) for j in range(n) for i in range(j)]
    for work in (table(len(pairs), a=[i for i, _ in pairs], b=[j for _, j in pairs]), table(n, bucket=[7] * n, a=list(range(n)))):
        compared.clear()
        links = [p for out in lines._settled(iter([own, work])) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
        assert plain_components(links) == {i: i // (n // 2) * (n // 2) for i in range(n)}
        assert len(links) == n - 2 and len(compared) <= 2 * n


def test_a_line_is_compared_by_its_own_text(spark):
    base = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "something else altogether here"), (1, base), (2, base + " more"), (3, "nothing like it"), (None, base + " most")]
    got = {r.doc_id: r.dropped_lines for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [], None: [0]}


def test_short_lines_are_exact_copies(spark):
    rows = [(1, "Read more\n2024\n这是一个没有空格的句子\n\n***"), (2, " Read more\n\n2024\nread more\n这是一个没有空格的句子\n2025"), (3, "***\n***\n \t")]
    got = {r.doc_id: r.dropped_lines for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 2, 3, 4], 3: [0, 1]}


def test_lines_odd_rows(odd):
    rows = {r.doc_id: r for r in lines.line_dedup(odd).collect()}
    assert set(rows) == {i for i, _ in ODD}
    assert rows[1].n_lines == 0 and rows[2].n_lines == 1 and rows[3].n_lines == 2
    assert rows[5].n_dropped == 0 and rows[7].n_dropped == 0
    assert lines.line_dedup(odd.limit(0)).count() == 0


# operator 2


def plain_headers(rows, least):
    vocab = {w for t in licenses.TEMPLATES.values() for w in licenses.template_words(t)}
    all_lines = [(p, k, licenses.template_words(x)) for p, t in rows for k, x in enumerate((t or "").split("\n")) if x]
    df = Counter(w for _, _, ws in all_lines for w in set(ws) & vocab)
    idf = lambda w: math.log((1 + len(all_lines)) / (1 + df.get(w, 0))) + 1
    out = {}
    for p, k, ws in all_lines:
        a = {w: n * idf(w) for w, n in Counter(ws).items()}
        best = []
        for name, t in licenses.TEMPLATES.items():
            b = {w: n * idf(w) for w, n in Counter(licenses.template_words(t)).items()}
            dot = sum(v * b.get(w, 0) for w, v in a.items())
            best.append((-round(dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 9) if a else 0, name))
        if best and -min(best)[0] >= least:
            out[p, k] = min(best)[1]
    return out


def test_headers_match_all_lines(spark):
    base = [f"line {i} of the text is under no license but the public one" for i in range(20)]
    rows = [(f"a/b/{i}", "\n".join([base[i], t, "the end", t.upper() + " extra words"])) for i, t in enumerate(licenses.TEMPLATES.values())]
    rows += [("x", None), ("y", ""), ("a/LICENSE", "Released under the MIT License."), ("z", "license license license of the the of")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.line_no): r.license for r in licenses.scan_headers(files).collect()}
    assert got == plain_headers(rows, licenses.LEAST) and {f"a/b/{i}" for i in range(13)} <= {p for p, _ in got}


def test_wrapped_headers_and_licence_files(spark):
    wrap = lambda text, mark, width=60: "\n".join(mark + x for x in textwrap.wrap(text, width))
    full = {f.stem: f.read_text() for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    cases = [(k, f"Copyright (c) 2020 Foo Bar\n\n{t}") for k, t in full.items()]
    cases += [(k, f"#!/bin/sh\n# Copyright 2021 Foo, Inc.\n#\n{wrap(t, '# ')}\n\necho {'one two three ' * 200}") for k, t in licenses.HEADERS.items()]
    cases += [(k, f"/*\n{wrap(t, '')}\n*/\nint main() {{ return {'x + ' * 300} 0; }}") for k, t in licenses.HEADERS.items()]
    cases += [("MIT", "code\n" + x + "\nmore code here") for x in ("Copyright 2020 Foo. Released under the MIT License.", "MIT License", "// SPDX-License-Identifier: MIT", "This project is licensed under the MIT License.")]
    cases += [(None, "We talked of a driving license for a while."), (None, "# a plain comment\nx = 1")]
    files = spark.createDataFrame([(str(i), t) for i, (_, t) in enumerate(cases)], "path string, text string").coalesce(2)
    best = {}
    for r in sorted(licenses.scan_texts(files).collect(), key=lambda r: r.cosine):
        best[int(r.path)] = r.license
    assert [(best.get(i), t[:40]) for i, (_, t) in enumerate(cases)] == [(k, t[:40]) for k, t in cases]


def test_inheritance_from_the_nearest_directory(spark):
    found = spark.createDataFrame([("a/LICENSE", 0, "MIT", 0.9), ("a/COPYING", 0, "GPL-3.0", 1.0), ("a/b/LICENSE", 0, "Apache-2.0", 1.0), ("a/b/own", 3, "MIT", 1.0), ("LICENSE", 0, "BSD-2-Clause", 1.0)], "path string, line_no long, license string, cosine double")
    paths = spark.createDataFrame([("a/x",), ("a/b/c/d",), ("a/b/own",), ("q/r",), ("top",), ("a/x",)], "path string")
    got = [(r.path, r.license, r.inherited_from) for r in licenses.inherit(paths, found, F.col("line_no") == 0).collect()]
    assert sorted(got) == sorted([("a/x", "GPL-3.0", "a")] * 2 + [("a/b/c/d", "Apache-2.0", "a/b"), ("a/b/own", "MIT", None), ("q/r", "BSD-2-Clause", ""), ("top", "BSD-2-Clause", "")])
    assert licenses.inherit(paths, found.limit(0), F.lit(True)).where("license is not null").count() == 0


def test_license_scan_of_documents(spark, sf_dir):
    rows = licenses.op2_license_scan(spark, sf_dir).collect()
    texts = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    assert len(rows) == len(texts)
    for r in rows:
        own = [t for t in licenses.TEMPLATES.values() if t in texts[r.doc_id].split("\n")]
        assert bool(own) == (r.license is not None and r.inherited_from is None)


# operator 3


def test_mixing_meets_targets(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(docs, labels, {"de": 0.3, "en": 0.3, "es": 0.2, "fr": 0.2}).collect()
    langs = dict(map(tuple, docs.select("doc_id", "lang").collect()))
    total, by = sum(r.n_tokens for r in rows), Counter()
    for r in rows:
        assert r.rate >= 0 and abs(sum(r.memberships.values()) - 1) < 1e-9
        for d, p in r.memberships.items():
            by[d] += r.n_tokens * r.rate * p / total
    assert {d: round(v, 3) for d, v in by.items()} == {"de": 0.3, "en": 0.3, "es": 0.2, "fr": 0.2}
    assert np.mean([max(r.memberships, key=r.memberships.get) == langs[r.doc_id] for r in rows]) > 0.9


def test_rates_stop_at_zero_like_the_plain_gradient(spark):
    pick = np.random.default_rng(3)
    p = pick.dirichlet((0.5, 0.5, 0.5), 50)
    n = pick.integers(1, 90, 50)
    soft = spark.createDataFrame([(int(k), x.tolist()) for k, x in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    steps = mixing.fit_rates(soft, ["a", "b", "c"], {"a": 1.0, "b": 0.02, "c": 0.0})
    got = np.array([r[0] for r in soft.select(mixing.rate_of(F.col("p"), steps)).collect()])
    rate, goal = np.ones(50), np.array([1, 0.02, 0]) / 1.02 * n.sum()
    for _ in steps:
        error = (rate * n) @ p - goal
        rate = np.maximum(0, rate - p @ (0.9 * error / (n @ p**2)))
    assert np.allclose(got, rate) and (got == 0).any()


def test_rates_of_many_overlapping_domains_meet_their_targets(spark):
    pick = np.random.default_rng(11)
    k = 12
    p = pick.dirichlet([0.5] * k, 300)
    n = pick.integers(1, 90, 300)
    goal = (n * pick.uniform(0.3, 2, 300)) @ p
    names = [f"d{d:02}" for d in range(k)]
    soft = spark.createDataFrame([(int(a), x.tolist()) for a, x in zip(n, p, strict=True)], "n_tokens long, p array<double>").coalesce(1)
    steps = mixing.fit_rates(soft, names, dict(zip(names, goal.tolist(), strict=True)), tokens=float(goal.sum()))
    rates = np.array([r[0] for r in soft.select(mixing.rate_of(F.col("p"), steps)).collect()])
    assert np.abs((rates * n) @ p - goal).max() <= 2e-5 * n.sum()
    with pytest.warns(UserWarning, match="not met"):
        mixing.fit_rates(soft, names, {names[0]: 1.0})


def test_mixing_knows_every_labelled_domain(spark):
    rows = [(i, f"lang{i % 40}", f"w{i % 40}a w{i % 40}b w{i % 40}c") for i in range(400)] + [(1000, "rare", "very seldom seen")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    model = mixing.fit_classifier(docs, docs.select("doc_id"), sample_rows=5)
    assert model["domains"] == sorted({r[1] for r in rows}) and abs(sum(map(math.exp, model["prior"])) - 1) < 1e-9
    few = docs.where("lang in ('lang1', 'rare')")
    with pytest.raises(ValueError, match="nowhere"):
        mixing.mix(few, few.select("doc_id"), {"rare": 0.5, "nowhere": 0.5})


def test_repeating_keeps_every_row(spark, sf_dir, odd):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.repeat_to_mix(docs, labels)
    assert out.columns == docs.columns and out.distinct().count() == docs.distinct().count() < out.count()
    few = spark.createDataFrame([(5, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    assert mixing.mix(odd, few).count() == len(ODD) == mixing.mix(odd, few.limit(0)).count()
    assert mixing.mix(odd.limit(0), few).count() == 0 and mixing.repeat_to_mix(odd.limit(0), few).count() == 0


# operator 10


def plain_best(terms, word):
    """Least edits of each term to the word, or to a beginning of it for a stem."""
    found = []
    for i, term in enumerate(terms):
        t, whole = term.removesuffix("$"), term.endswith("$")
        row = list(range(len(word) + 1))
        for c in t:
            new = [row[0] + 1]
            for j, d in enumerate(word, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        e = row[-1] if whole else min(row)
        if e <= toxicity.edits_allowed(term):
            found.append((e, -len(term), i))
    return (min(found)[2], min(found)[0]) if found else None


def test_automaton_is_the_edit_distance():
    pick = random.Random(8)
    terms = ["idiot$", "moron$", "disgusting$", "worthless$", "scum$", "lowei", "vequ", "lostra"]
    automaton = toxicity.LexiconAutomaton(terms)
    words = ["idiot", "idi0t", "ediot", "idioot", "moro", "oron", "scum", "scam", "loweiung", "lovei", "worthles", "wrthlss", "disgustin", ""]
    for t in terms:
        for _ in range(60):
            w = list(t.removesuffix("$") + pick.choice(("", "", "ung", "s")))
            for _ in range(pick.randint(0, 3)):
                k = pick.randrange(len(w) + 1)
                w[k : k + pick.randint(0, 1)] = pick.choice(["", "x", "e"])
            words.append("".join(w))
    for w in words:
        assert automaton.best(w) == plain_best(terms, w), w


def test_quotation_is_told_from_abuse():
    m = toxicity.Matcher(["idiot$"])
    assert m.matches("you are an Idi0t, yes") == [(0, True, False)]
    assert m.matches('he said: "you idiot" and left') == [(0, False, True)]
    assert m.matches("«idiot» est un mot") == [(0, False, True)] and m.matches("nothing here") == []
    weights, c = {(0, False): 6.0}, (-4.0, 8.0, 0.5)
    plain, quoted = (toxicity.score_of(toxicity.evidence(m.matches(t), weights), c) for t in ("an idiot again", 'the word "idiot" here'))
    assert plain > 0.5 > quoted


def test_toxicity_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    assert {"idiot$", "clown$", "scum$"} <= set(model["terms"])
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").collect()
    clean = [r.predicted for r in rows if r.held_out and not r.toxic]
    assert np.mean(clean) < 0.05 and np.mean([r.predicted == r.toxic for r in rows if r.held_out]) > 0.92
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, flipped) == model  # held-out labels are not read


def test_short_words_become_terms(spark):
    rows = [(i, f"word{i} other{i} thing{i} {'zug' if i % 2 else 'ok' + str(i)}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int").coalesce(1)
    assert "zug$" in toxicity.learn(docs, labels)["terms"]


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.score_documents(odd, toxicity.learn(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(odd.limit(0), toxicity.learn(odd.limit(0), labels)).count() == 0


# the pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.keep(stage(spark, at, sf_dir), "t")
        assert out.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (at, out))
        gone = set(before) - set(after)
        if name == "toxicity":
            model = toxicity.learn(at, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.score_documents(at, model).collect() if r.predicted}
            assert gone == bad
        elif name == "exact_dedup":
            assert len(after) == len({re.sub(r"[\x20\x09-\x0D]", "", t) for t in before.values()}) == len({re.sub(r"[\x20\x09-\x0D]", "", t) for t in after.values()})
        elif name == "near_dedup":
            assert gone == {i for i, (_, root) in plain_near(list(before.items()), 5, 80).items() if root != i}
        else:
            assert not gone and out.count() > len(after)
        at = out
    rows = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).collect()
    assert len(rows) == at.count() and set(r.doc_id for r in rows) == {r.doc_id for r in at.collect()}


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


# odd rows in every stage

STAGE_ROWS = [
    (1, "A same text of six words here", "en"), (5, "A same text  of six words here", "en"), (5, "B unique words that nobody else has at all", "en"), (None, "A same text of six words here", "en"),
    (7, "twice the very same row of one id", "en"), (7, "twice the very same row of one id", "en"), (None, "one two three four five six seven eight nine ten eleven twelve", "de"),
    (9, "one two three four five six seven eight nine ten eleven twelve thirteen", "de"), (3, None, None), (4, "", "en"), (-(2**63), " \n", "en"), (11, "z " * 5000 + "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "fr"),
]


@pytest.fixture(scope="module")
def stage_docs(spark):
    rows = [(i, t, lang, "s", None, 0, "b", "r", k) for k, (i, t, lang) in enumerate(STAGE_ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, h string, row_number string, k int")


def plain_stage(name, rows):
    """Numbers of the rows that stay."""
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    if name == "exact_dedup":
        groups = defaultdict(list)
        for r in rows:
            groups[bare(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.k))
        return {min(g)[-1] for g in groups.values()}
    near = plain_near([(r.k, r.text) for r in rows], 5, 80)
    groups = defaultdict(list)
    for r in rows:
        groups[near[r.k][1]].append((r.doc_id is None, r.doc_id or 0, r.k))
    return {min(g)[-1] for g in groups.values()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf_dir, stage_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, stage_docs, sf_dir)
    got = out.collect()
    if name == "byte_bpe":
        assert len(got) == len(STAGE_ROWS) and {r.doc_id: r.n_tokens for r in got}[3] == 0
    else:
        assert out.columns == stage_docs.columns
        stays = [r.k for r in got]
        if name in ("exact_dedup", "near_dedup"):
            assert sorted(stays) == sorted(plain_stage(name, stage_docs.collect()))
        else:
            assert set(stays) == set(range(len(STAGE_ROWS)))
    assert stage(spark, stage_docs.limit(0), sf_dir).count() == 0


def test_exact_dedup_of_colliding_hashes_and_odd_ids(spark):
    rows = [(None, "ab"), (1, "ab"), (1, "cd"), (1, "cd"), (None, "cd"), (-(2**63), "ef"), (2, "e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for fn in (exact_dedup.md5_128, lambda t: F.length(t)):
        got = exact_dedup.exact_dedup(docs, hash_fn=fn).collect()
        assert len(got) == len(rows)
        seen = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got)
        assert seen == sorted([("None", "1", 2, False), ("1", "1", 2, True), ("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), (str(-(2**63)), "2", 2, False), ("2", "2", 2, True), ("3", "3", 1, True)])


def test_license_scan_of_odd_rows(spark, tmp_path):
    rows = [(None, "Released under the MIT License.\nx", "a"), (1001, "nothing", "a"), (1002, "Released under the MIT License.\nbody", "a"), (None, None, None), (7, "", "b"), (7, "", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), str(r.license), str(r.inherited_from)) for r in licenses.op2_license_scan(spark, str(tmp_path)).collect())
    assert got == sorted([("None", "MIT", "None"), ("1001", "MIT", "a/1/10"), ("1002", "MIT", "None"), ("None", "None", "None"), ("7", "None", "None"), ("7", "None", "None")])
    paths = spark.createDataFrame([("a/x", "mine", 1.0, "d"), (None, "none", 2.0, "e")], "path string, license string, cosine double, dir string")
    found = spark.createDataFrame([("a/LICENSE", 0, "MIT", 0.9)], "path string, line_no long, license string, cosine double")
    assert sorted((str(r.path), str(r.license)) for r in licenses.inherit(paths, found, F.lit(True)).collect()) == [("None", "None"), ("a/x", "MIT")]
    nothing = paths.limit(0).select("path").withColumn("text", F.lit(""))
    assert licenses.scan_headers(nothing).count() == licenses.scan_texts(nothing).count() == licenses.inherit(paths.limit(0), found, F.lit(True)).count() == 0
