"""Near-duplicates, substrings, toxicity, licences and mixing against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from echoseq.llm import licenses, linking, minhash, mixing, substring, toxicity, words

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_word_spans():
    texts = ["", "a", " a", "a ", "é\x0bü\x0c x", " ", "  "]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.cumsum([0, *map(len, raw)])
    assert words.counts(data, off).tolist() == [len(WORD.findall(t)) for t in texts]
    s, e, first = words.spans(data, off)
    got = [[bytes(data[a:b]).decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [WORD.findall(t) for t in texts]


def test_sketch_is_unbiased_and_full():
    rng = np.random.default_rng(1)
    for n, share in ((1, 1.0), (5, 0.6), (400, 0.85), (3000, 0.3)):
        got = []
        for _ in range(20):
            k = round(n * share)
            x = rng.integers(0, 2**63, 2 * n - k, dtype=np.uint64)
            s = minhash.sketches(np.concatenate([x[:n], x[n - k :]]), np.array([n, n]))
            assert not (s == minhash.FULL).any()
            got.append((s[0] == s[1]).mean())
        assert abs(np.mean(got) - k / (2 * n - k)) < 0.05


def test_near_duplicates(spark):
    docs = fixtures.documents(spark)
    got = minhash.near_duplicates(spark, docs).collect()
    want = brute_classes([(i, t) for i, t, _ in fixtures.texts()])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert len(got) == docs.count()
    assert minhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_hot_group_by_blocks_loses_no_link(spark, monkeypatch):
    """Many near copies around no common source: most pairs don't link, and all buckets are large."""
    import random

    base = fixtures.words(5, 120)
    rows = [(i, " ".join(w if random.Random(i * 999 + k).random() > 0.035 else f"q{i}x{k}" for k, w in enumerate(base)), "s") for i in range(150)]
    monkeypatch.setattr(linking, "SMALL", 4)
    monkeypatch.setattr(linking, "BLOCK", 16)
    monkeypatch.setattr(linking, "ROUNDS", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, fixtures.documents(spark, rows, False, False)).collect()}
    assert got == brute_classes([(i, t) for i, t, _ in rows])
    assert 1 < sum(v[2] for v in got.values()) < 150


def brute_removed(rows, window=35):
    ws = [WORD.findall(t or "") for _, t, _ in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for w in ws for k in range(len(w) - window + 1))
    out = []
    for (i, _, _), w in zip(rows, ws, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings(spark):
    rows = [*fixtures.texts(), fixtures.texts()[0], (None, "one two three", None), (None, None, None)]
    got = [tuple(r) for r in substring.removed(spark, fixtures.documents(spark)).collect()]
    assert fixtures.plain(got) == fixtures.plain(brute_removed(rows))
    assert substring.removed(spark, fixtures.documents(spark).limit(0)).count() == 0


def test_cut_texts_keeps_columns(spark):
    docs = fixtures.documents(spark)
    out = substring.cut_texts(spark, docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "" and got[1].n_chars == 0 and got[7].text == "one two three" and got[8].text == "ONE two  three" and got[4].text is None
    assert got[10].row == "y" and len(got[10].text.split()) == 90


def thue_morse(n, one, two):
    return "".join((one, two)[bin(k).count("1") % 2] for k in range(n))


def test_structured_words_do_not_collide(spark):
    """Words over which polynomial hashes modulo 2**64 are equal for any base; and runs of words of that kind."""
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    tail = " ".join(f"t{k}" for k in range(40))
    rows = [(1, x, "s"), (2, y, "s"), (3, f"{x} {tail}", "s"), (4, f"{y} {tail}", "s"), (5, " ".join(x), "s"), (6, " ".join(y), "s")]
    docs = fixtures.documents(spark, rows, False, False)
    want = brute_classes([(i, t) for i, t, _ in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, docs).collect()} == want
    got = [tuple(r) for r in substring.removed(spark, docs).collect()]
    assert fixtures.plain(got) == fixtures.plain(brute_removed(rows))


def test_word_hashes_depend_on_every_byte():
    base = "abcdefghijklmnopqrstuvwxyz0123456789" * 3
    texts = {base[:k] for k in range(1, 108)} | {base[:k] + "X" + base[k + 1 : n] for n in (5, 8, 9, 16, 17, 63, 64, 65, 100) for k in range(n)}
    data = np.frombuffer(" ".join(sorted(texts)).encode(), np.uint8)
    s, e, _ = words.spans(data, np.array([0, len(data)]))
    one, two = words.word_hashes(data, s, e), words.word_hashes(data, s, e, 1)
    assert len(np.unique(one)) == len(texts) == len(np.unique(two)) and not (one == two).any()
    moved = np.concatenate([np.frombuffer(b"zz ", np.uint8), data])
    assert np.array_equal(words.word_hashes(moved, s + 3, e + 3), one)
    for n in (1, 2, 5, 16, 35):
        runs = words.run_hashes(one, np.arange(len(one) - n + 1), n)
        assert len(np.unique(runs)) == len(runs)
        assert np.array_equal(words.run_hashes(one[3:], np.arange(len(one) - n - 2), n), runs[3:])


def test_near_duplicates_at_eighty(spark):
    """Pairs between 0.80 and 0.85 link at 80 and not at 85."""
    import random

    base = fixtures.words(8, 216)
    rows = [(1, " ".join(base), "s"), (2, " ".join(w if k not in (20, 60, 100, 140) else "q" for k, w in enumerate(base)), "s"), (3, " ".join(random.Random(2).sample(base, 216)), "s")]
    both = len(shingles(rows[0][1]) & shingles(rows[1][1])) / len(shingles(rows[0][1]) | shingles(rows[1][1]))
    assert 0.8 <= both < 0.85
    docs = fixtures.documents(spark, rows, False, False)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, docs, 80).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, docs).collect()} == {1: 1, 2: 2, 3: 3}


def test_winnowing_always_keeps_a_seed():
    h = words.mix(np.arange(1, 401, dtype=np.uint64) % np.uint64(7))
    first = np.array([0, 34, 69, 400])
    doc, pos, _ = substring.anchors_of(h, first)
    for d, n in ((1, 35), (2, 331)):
        kept = set(pos[doc == d].tolist())
        assert all(kept & set(range(s, s + 20)) for s in range(n - 34))
    assert not (doc == 0).any()


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    docs = fixtures.documents(spark)
    got = mixing.mix(spark, docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = brute_targets(sizes)
    assert len(got) == docs.count()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r["size"]
    assert fixtures.plain(map(tuple, got)) == fixtures.plain(map(tuple, mixing.mix(spark, docs).collect()))
    out = mixing.emit(spark, docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(spark, docs.limit(0)).count() == 0


def test_mixing_comes_near_targets(spark):
    import random

    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(1, 400)), r.choice(["a", "a", "a", "b", "c", "d"])) for i in range(6000)]
    by = collections.defaultdict(lambda: [0.0, 0])
    for x in mixing.mix(spark, fixtures.documents(spark, rows, False, False)).collect():
        by[x.source][0] = x.target
        by[x.source][1] += x.taken
    assert all(abs(taken / target - 1) < 0.02 for target, taken in by.values())


def test_mixing_of_few_documents_comes_near_targets(spark):
    """Twenty sources of some fifty documents with a heavy tail of sizes."""
    import random

    r = random.Random(9)
    rows = [(i, " ".join(["w"] * int(min(3000, 20 * r.paretovariate(0.9)))), f"s{i % 20}") for i in range(1000)]
    by = collections.defaultdict(lambda: [0.0, 0])
    for x in mixing.mix(spark, fixtures.documents(spark, rows, False, False)).collect():
        by[x.source][0] = x.target
        by[x.source][1] += x.taken
    misses = sorted(abs(taken / target - 1) for target, taken in by.values())
    assert misses[10] < 0.03 and misses[-1] < 0.15


def test_emit_keeps_rows_that_differ_in_other_columns(spark):
    """Rows of one doc_id, source and text with other languages are rows of their own."""
    rows = spark.createDataFrame([(1, "a b c", lang, "s", 5) for lang in ("en", "de", "fr", "en")], "doc_id long, text string, lang string, source string, n_chars long")
    assert fixtures.plain(r.lang for r in mixing.emit(spark, rows).collect()) == ["de", "en", "en", "fr"]


def test_fold():
    assert toxicity.fold("ІDІОТ, you 1d10t! Stu​pid 2024") == " idiot you idiot stupid 2024 "
    assert toxicity.fold(None) == toxicity.fold("") == " "


def test_exceptions_and_scores():
    lex = toxicity.Lexicon({" trash": 4.0, " idiot ": 4.0}, ("trash can",), (-4.0, 2.5, 0.0))
    assert lex.score("the trash can is full") == lex.score("") == lex.score(None) < 0.1
    assert lex.score("you trash") > 0.3 and lex.score("idiotic") < 0.3 and lex.score("1d1ot") > 0.3


def brute_matches(lex, folded):
    """Every term at every place by plain comparison; the heaviest at a place counts if no exception phrase covers it."""
    gone, best = set(), {}
    for p in lex.exceptions:
        for k in range(len(folded)):
            if f" {p} " not in lex.terms and folded.startswith(f" {p} ", k):
                gone |= set(range(k, k + len(p) + 1))
    for t, weight in lex.terms.items():
        for k in range(len(folded)):
            if folded.startswith(t, k):
                best[k] = max(best.get(k, 0.0), weight)
    return sorted((k, x) for k, x in best.items() if k not in gone)


def test_matches_equal_plain_search():
    import math
    import random

    r = random.Random(11)
    for _ in range(40):
        some = lambda n: " ".join("".join(r.choice("ab") for _ in range(r.randrange(1, 4))) for _ in range(n))
        terms = {f" {some(1)}{r.choice(['', ' '])}": r.randrange(1, 9) / 2 for _ in range(6)}
        lex = toxicity.Lexicon(terms, tuple({some(r.randrange(1, 4)) for _ in range(4)}), (-3.0, 1.0, 0.5))
        text = some(60)
        f = toxicity.fold(text)
        want = brute_matches(lex, f)
        assert sorted(lex.matches(f)) == want
        total = sum(x for _, x in want)
        z = -3.0 + math.log1p(total) + 0.5 * math.log1p(100 * total / (len(text.split()) + 20))
        assert lex.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_many_phrases_take_linear_time():
    import time

    lex = toxicity.Lexicon({" trash": 4.0}, ("trash can",), (-4.0, 2.5, 0.0))
    began = time.time()
    assert lex.matches(toxicity.fold("trash can you " * 30_000 + "trash")) == [(30_000 * 14, 4.0)]
    assert time.time() - began < 20


def test_toxicity_learns_and_holds_out(spark):
    import random

    r = random.Random(3)
    plain = [f"w{k}ord" for k in range(400)]
    rows, labels = [], []
    for i in range(1200):
        t = [r.choice(plain) for _ in range(r.randrange(5, 200))]
        bad = i % 9 == 0
        if bad:
            for _ in range(3):
                t[r.randrange(len(t))] = r.choice(["zorgling", "zorgly", "blurb"])
        rows.append((i, " ".join(t), "s"))
        labels.append((i, 0, int(bad)))
    docs = fixtures.documents(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    lex = toxicity.fit(spark, docs, lab)
    got = toxicity.score(docs, lex).collect()
    assert len(got) == docs.count()
    held = [x for x in got if x.held_out]
    assert all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in held)
    assert all(x.predicted == int(x.doc_id % 9 == 0) for x in held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    clean = toxicity.reject(docs, lex)
    assert clean.columns == docs.columns and clean.count() == sum(1 - x.predicted for x in got)
    empty = toxicity.fit(spark, docs, lab.limit(0))
    assert empty.terms and toxicity.score(docs.limit(0), empty).count() == 0


def test_rare_toxic_terms_are_not_crowded_out(spark):
    """More than 20,000 word beginnings are commoner in toxic rows than the rare toxic word, and as common in clean ones."""
    ids = [i for i in range(60) if not toxicity.held_out(i)]
    common = " ".join(f"{k:05d}".translate(str.maketrans("0123456789", "bcdfghjklm")) + "xyz" for k in range(9000))
    rows = [(i, common + (" zorgling" if i in ids[:10:2] else ""), "s") for i in ids]
    lab = spark.createDataFrame([(i, 0, int(k < 10 and k % 2 == 0 or 10 <= k < 14)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    lex = toxicity.fit(spark, fixtures.documents(spark, rows, False, False), lab)
    assert any(" zorgling ".startswith(t) for t in lex.terms) and not any(t.startswith(" bc") for t in lex.terms)


def brute_license(matcher, text):
    units = [x for x in [*(text or "").split("\n"), text or ""] if x]
    got = [b for b in map(matcher.best, units) if b]
    return max(got, key=lambda x: (x[0], [-ord(c) for c in x[1]])) if got else None


def test_licenses(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/x.txt", "nothing here"), (3, "a/b/c/COPYING", "Licensed under the Apache License, Version 2.0."), (4, "a/b/c/d/e.txt", "plain"), (5, "a/b/y.txt", f"text\n# {mit}\nmore"),
        (6, "z.txt", "the license of the public"), (7, None, "plain"), (8, "a/q.txt", None), (9, "ab/q.txt", ""), (10, "a/NOTICE.md", "x\nThis work is licensed under the GNU General Public License, version 3.\n"), (2, "a/b/x.txt", "nothing here"), (None, "a/n.txt", "t"),
    ]
    files = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, path string, text string, dir string")
    m = licenses.fit(files)
    for _, _, t in rows:
        assert m.scan(t) == brute_license(m, t)
    got = {r.doc_id: (r.license, r.origin, r.license_dir) for r in licenses.scan(spark, files).collect()}
    assert got[1] == ("MIT", "own", None) and got[5] == ("MIT", "own", None) and got[10][0] == "GPL-3.0"
    near = got[2][0]
    assert got[2] == (near, "directory", "a") and near in ("MIT", "GPL-3.0") and got[8][0] == near and got[None][0] == near
    assert got[4] == ("Apache-2.0", "directory", "a/b/c")
    assert got[6] == got[7] == got[9] == (None, None, None)
    assert licenses.scan(spark, files).count() == len(rows) and licenses.scan(spark, files.limit(0)).count() == 0


def test_wrapped_and_embedded_licenses():
    """Headers over several lines on top of code, and a statement inside a long line; runs against brute force."""
    import textwrap

    m = licenses.Matcher({}, 1000)
    code = [f"x{k} = call{k}(y{k}, z{k})" for k in range(100)]
    for name, texts in licenses.TEMPLATES.items():
        for x in texts:
            if name == "BSD-3-Clause" or len(x) > 60:
                for width in (40, 50):
                    wrapped = [f"# {y}" for y in textwrap.wrap(x, width)]
                    assert m.scan("\n".join([*wrapped, *code])) == (1.0, name)
    assert m.scan(" ".join([*code[:9], "Released under the MIT License.", *code[9:20]]))[1] == "MIT"
    r = np.random.default_rng(3)
    pool = [*licenses.terms(licenses.TEMPLATES["GPL-2.0"][1]), *licenses.terms(licenses.TEMPLATES["MIT"][0]), *[f"q{k}" for k in range(8)]]
    hits = 0
    for _ in range(60):
        words = [*r.choice(pool, 12), *(x for x in licenses.terms("Released under the MIT License") if r.random() < 0.8), *r.choice(pool, 12)]
        got = [b for i in range(len(words)) for j in range(i + 1, min(len(words), i + m.longest) + 1) if (b := m.best(" ".join(words[i:j])))]
        want = min(got, key=lambda b: (-b[0], b[1])) if got else None
        hits += want is not None
        assert m.runs(" ".join(words)) == want
    assert hits


def test_licence_files_are_found_whatever_the_corpus():
    """Whole and cut licence texts, openings of long ones in long files, and prose with the same common words."""
    import random

    vocabulary = licenses.Vocabulary(licenses.TEMPLATES).terms
    r = random.Random(4)
    filler = " ".join(r.choice(["the", "of", "and", "software", "you", "may", "use"]) if r.random() < 0.3 else f"w{r.randrange(3000)}" for _ in range(6000))
    for df in ({}, {t: 990 for t in vocabulary}, {t: r.randrange(1000) for t in vocabulary}):
        m = licenses.Matcher(df, 1000)
        for name, texts in licenses.TEMPLATES.items():
            long = max(texts, key=len)
            if len(long) > 400:
                assert m.scan(f"{filler}\n{long}\n{filler}") == (1.0, name)
                cut = m.scan(long[: int(len(long) * 0.9)])
                assert cut[1] == name and cut[0] > 0.9
        if len(set(df.values())) < 2:
            assert m.scan(filler) is None
        assert m.scan("A b\n\n    GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n" + filler) == (1.0, "GPL-3.0")


def test_terms_of_a_buffer():
    texts = ["", "A.1b c..2 .3 x.", ".5", "é2.0É", "v1.2.3-rc", "end.", "9.9"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    hashes, first = licenses.term_hashes(data, off)
    want = [licenses.terms(t) for t in texts]
    assert np.diff(first).tolist() == [len(x) for x in want]
    assert hashes.tolist() == [int(licenses.hash_of(t)) for x in want for t in x]
