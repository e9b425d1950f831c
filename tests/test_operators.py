"""Kernels against plain Python: codes, Hamming join, alignment, components, plans and table changes."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoseq.functions import hashing, paths
from echoseq.operators import graph, hamming_join, match, organise, pair_blocks, planes, reconcile, tables
from echoseq.scratch import Scratch
from echoseq.sources import decode, frames


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def frames_df(spark, videos):
    rows = [(v, i, float(i), f"{h:016x}", signed(h)) for v, hs in videos.items() for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, timestamp double, phash string, h long")
    return Scratch(spark, "test").table(df, "frames")


def flipped(h, bits, rng):
    for b in rng.sample(range(64), bits):
        h ^= 1 << b
    return h


def distance(a, b):
    return bin(a ^ b).count("1")


def sliding(short, long, step, t):
    n, m = len(short), len(long)
    if not n or m < n:
        return 0.0
    return max(sum(distance(a, b) <= t for a, b in zip(short, long[s : s + n], strict=True)) / n for s in range(0, m - n + 1, step))


@pytest.fixture(scope="module")
def videos():
    r = random.Random(5)
    code = lambda: r.getrandbits(64)
    base = [code() for _ in range(40)]
    out = {1: base, 2: list(base), 3: [flipped(h, 10, r) for h in base], 4: [flipped(h, 11, r) for h in base]}
    for k, offset in enumerate((0, 9, 10, 25)):
        out[10 + k] = [code() for _ in range(offset)] + base + [code() for _ in range(25 - offset)]
    out |= {20: [code() for _ in range(30)], 21: [0] * 30, 22: [0] * 12, 23: base[:38], 24: [code()]}
    return out


def test_hex_and_hamming(spark):
    rows = spark.createDataFrame([("ffffffffffffffff",), ("8000000000000000",), ("0000000000000001",)], "p string")
    got = rows.select(hashing.from_hex("p").alias("h"), "p").select("h", "p", hashing.to_hex("h").alias("b"), hashing.hamming("h", F.lit(0).cast("long")).alias("d")).collect()
    assert [(r.h, r.b == r.p, r.d) for r in got] == [(-1, True, 64), (-(1 << 63), True, 1), (1, True, 1)]


@pytest.mark.parametrize("t", [0, 1, 3, 10, 13, 20])
def test_radius_join_is_exact(spark, t):
    r = random.Random(t)
    codes = [r.getrandbits(64) for _ in range(40)]
    codes = sorted({*codes, *(flipped(h, min(64, t + d), r) for h in codes for d in (-1, 0, 1) if t + d >= 0), 0, (1 << 64) - 1})
    df = spark.createDataFrame([(signed(h),) for h in codes], "h long")
    got = {(x.h1, x.h2, x.dist) for x in hamming_join.code_pairs(df, t).collect()}
    want = {(*sorted((signed(a), signed(b))), distance(a, b)) for i, a in enumerate(codes) for b in codes[:i] if distance(a, b) <= t}
    assert got == want


@pytest.mark.parametrize("plan", [hamming_join.WHOLE, hamming_join.bands(10, 4), hamming_join.bands(10, 8), hamming_join.bands(10, 13)])
def test_radius_join_splits_full_cells(spark, plan, monkeypatch):
    """Codes that crowd one cell of a band, with parts and blocks of a few codes each; each pair comes once."""
    for name, value in (("CELL", 7), ("BLOCK", 3), ("PAIRS", 20)):
        monkeypatch.setattr(hamming_join, name, value)
    r = random.Random(5)
    codes = sorted({r.getrandbits(24) for _ in range(60)} | {(1 << 63) | r.getrandbits(20) for _ in range(30)})
    df = spark.createDataFrame([(signed(h),) for h in codes] + [(None,)], "h long")
    got = [(x.h1, x.h2, x.dist) for x in hamming_join.code_pairs(df, 10, plan).collect()]
    want = {(*sorted((signed(a), signed(b))), distance(a, b)) for i, a in enumerate(codes) for b in codes[:i] if distance(a, b) <= 10}
    assert len(got) == len(set(got)) and set(got) == want


def test_plan_follows_the_number_of_codes():
    assert hamming_join.choose(10, 100) == hamming_join.WHOLE and hamming_join.choose(64, 10**9) == hamming_join.WHOLE
    assert len(hamming_join.choose(10, 10**5)) > len(hamming_join.choose(10, 10**8)) > len(hamming_join.choose(10, 10**10))


def test_knn_counts_own_frames(spark, videos):
    f = frames_df(spark, videos)
    flat = [(v, i, h) for v, hs in videos.items() for i, h in enumerate(hs)]
    want = set()
    for v, _, h in flat:
        for d, w, _ in sorted((distance(h, g), w, j) for w, j, g in flat)[:16]:
            if w != v and d <= 10:
                want.add((min(v, w), max(v, w)))
    assert {tuple(r) for r in hamming_join.knn_candidate_pairs(f, 10).collect()} == want


@pytest.mark.parametrize("step", [1, 3])
def test_alignment_equals_sliding_window(spark, videos, step):
    f = frames_df(spark, videos)
    v = spark.createDataFrame([(i, float(len(h)), len(h)) for i, h in videos.items()], "id long, duration double, n_frames long")
    got = {(r.short_id, r.long_id): r.confidence for r in match.scored(match.diagonals(f, v, 10, step), v).collect()}
    for (s, g), c in got.items():
        assert c == sliding(videos[s], videos[g], step, 10)
    for a in videos:
        for b in videos:
            if a < b and (a, b) not in got and (b, a) not in got:
                s, g = (a, b) if len(videos[a]) <= len(videos[b]) else (b, a)
                assert sliding(videos[s], videos[g], step, 10) == 0


@pytest.mark.parametrize("step", [1, 3])
@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_matches_equal_sliding_window(spark, videos, step, least):
    """Alignments from telling frames alone lose no match; a code that every video holds is among them."""
    r = random.Random(3)
    videos = {v: [7 if r.random() < 0.3 else h for h in hs] for v, hs in videos.items()} | {90 + k: [7] * (3 + k) for k in range(3)}
    f = frames_df(spark, videos)
    v = spark.createDataFrame([(i, float(len(h)), len(h)) for i, h in videos.items()], "id long, duration double, n_frames long")
    want = {}
    for a in videos:
        for b in videos:
            if a < b:
                s, g = (a, b) if len(videos[a]) <= len(videos[b]) else (b, a)
                c = sliding(videos[s], videos[g], step, 10)
                if c >= least:
                    want[s, g] = c
    p = match.MatchParams(frame_step=step, window=0.0, min_confidence=least)
    assert {(x.short_id, x.long_id): x.confidence for x in match.matches(f, v, p).collect()} == want
    assert {(x.short_id, x.long_id) for x in match.matched(match.compare(f, v, p), p).collect()} == set(want)
    # A code of a third of all frames is near most others, so it is no telling frame of videos that have rarer ones.
    told = match.telling(f, v, hamming_join.near_codes(f, 10), least)
    assert told.where("h = 7 and video_id < 90 and video_id not in (21, 22, 24)").count() <= (0 if least >= 0.8 else 1000)


def test_order_without_one_task(spark):
    rows = [(r, r % 7) for r in random.Random(1).sample(range(1000), 500)]
    got = {x.k: (x.before, x.w_before) for x in tables.in_order(spark.createDataFrame(rows, "k long, w long"), [F.col("k")], ("w",)).collect()}
    n = total = 0
    for k, x in sorted(rows):
        assert got[k] == (n, total)
        n, total = n + 1, total + x
    assert tables.in_order(spark.createDataFrame([], "k long"), [F.col("k")]).count() == 0


def test_types_and_gates(spark, videos):
    f = frames_df(spark, videos)
    v = spark.createDataFrame([(i, None if i == 24 else float(len(h)), len(h)) for i, h in videos.items()], "id long, duration double, n_frames long")
    got = {(r.short_id, r.long_id): r.match_type for r in match.matches(f, v, match.MatchParams(frame_step=1)).collect()}
    assert got[(1, 2)] == got[(23, 1)] == "duplicate" and got[(1, 11)] == "subclip" and (1, 4) not in got and (22, 21) in got
    assert all(a != 20 and b != 20 for a, b in got)
    none = match.matches(f, v, match.MatchParams(frame_step=1, filter_length=True)).collect()
    assert all(len(videos[r.short_id]) != len(videos[r.long_id]) for r in none)
    assert not [r for r in match.matches(f, v, match.MatchParams(window=13.0)).collect() if r.short_id == 22]
    done = spark.createDataFrame([(2, 1)], "video_a_id long, video_b_id long")
    assert (1, 2) not in {(r.short_id, r.long_id) for r in match.matches(f, v, match.MatchParams(), done).collect()}
    zero = spark.createDataFrame([(0.0, 0.0), (94.0, 100.0), (95.0, 100.0)], "short_duration double, long_duration double")
    assert [r[0] for r in zero.select(match.match_type()).collect()] == ["duplicate", "subclip", "duplicate"]
    for bad in ({"min_confidence": 0}, {"threshold": 65}, {"frame_step": 0}):
        with pytest.raises(ValueError):
            match.MatchParams(**bad)


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 50)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {x.node: x.label for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test").table).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    # The same in two steps: later edges are given between the labels of the first step.
    table, df = Scratch(spark, "test").table, lambda e: spark.createDataFrame(e, "a long, b long")
    r.shuffle(edges)
    labels = graph.connected_components(df(edges[:150]), table)
    known = {x.node: x.label for x in labels.collect()}
    grown = graph.grown_components(labels, df([(known.get(a, a), known.get(b, b)) for a, b in edges[150:]]), table).collect()
    assert len(grown) == len({x.node for x in grown})
    both = {x for a, b in edges for x in (a, b)}
    assert {x.node: x.label for x in grown if x.node in got} == got and {x.node for x in grown} <= both
    none = graph.grown_components(labels, df([]), table)
    assert {x.node: x.label for x in none.collect()} == known


def test_paths(spark):
    rows = [("/a/b/c.MP4", "c.MP4", "/a/b", ".MP4", "c"), ("x", "x", "", "", "x"), ("/a/.hid", ".hid", "/a", "", ".hid"), ("/a/n.tar.gz", "n.tar.gz", "/a", ".gz", "n.tar"), ("/a.b/c", "c", "/a.b", "", "c")]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string")
    got = df.select("p", paths.basename("p"), paths.dirname("p"), paths.extension("p"), paths.stem("p")).collect()
    assert [tuple(r) for r in got] == rows


def test_move_plan_and_outcomes(spark):
    v = spark.createDataFrame([(1, "/l/a.mp4", None), (2, "/l/x/a.mp4", None), (3, "/l/b.mp4", "/l/duplicates/1/b.mp4"), (4, "/l/c.mp4", None)], "id long, path string, moved_to string")
    m = spark.createDataFrame([(1, 1, 2, 0), (2, 3, 4, 0), (3, 1, 4, 1)], "id long, video_a_id long, video_b_id long, moved int")
    members = organise.groups(m, Scratch(spark, "test").table)
    assert tuple(organise.summary(members).first()) == (4, 2)
    disk = spark.createDataFrame([(p,) for p in ("/l/a.mp4", "/l/x/a.mp4", "/l/duplicates/1/b.mp4")], "path string")
    base = organise.next_base(v, "/l/duplicates")
    plan = {r.video_id: (r.group_id, r.target) for r in organise.move_plan(organise.numbered(members, m, base), v, "/l/duplicates", disk).collect()}
    assert plan == {1: (2, "/l/duplicates/2/a.mp4"), 2: (2, "/l/duplicates/2/a_2.mp4"), 3: (3, "/l/duplicates/3/b.mp4")}


def test_cleanup_outcomes(spark):
    g = "/l/duplicates"
    v = spark.createDataFrame([(1, "/l/a", f"{g}/1/a"), (2, "/l/b", f"{g}/1/b"), (3, "/l/c.x", f"{g}/2/c.x"), (4, "/l/d", f"{g}/2/d"), (5, "/l/e", f"{g}/10/e"), (6, "/l/f", None), (7, "/l/g", f"{g}/3/g"), (8, "/l/h", f"{g}/3/h")], "id long, path string, moved_to string")
    disk = spark.createDataFrame([(p,) for p in (f"{g}/1/a", f"{g}/1/b", f"{g}/2/c.x", "/l/c.x", "/l/f")], "path string")
    out = reconcile.group_outcomes(v, disk, g)
    assert {r.group_id: (r.n_records, r.n_deleted, r.returned_id) for r in out.collect()} == {1: (2, 0, None), 2: (2, 1, 3), 10: (1, 1, None), 3: (2, 2, None)}
    assert [tuple(r) for r in reconcile.return_plan(v, out, disk).collect()] == [(3, f"{g}/2/c.x", "/l/c_returned.x")]
    assert {r.id for r in reconcile.missing(v, disk).collect()} == {4, 5, 7, 8}
    cand = spark.createDataFrame([(1, 4), (1, 2)], "video_a_id long, video_b_id long")
    left = reconcile.cascade_delete({"videos": v, "candidate_pairs": cand}, reconcile.deleted_members(v, disk, g))
    assert {r.id for r in left["videos"].collect()} == {1, 2, 3, 6} and left["candidate_pairs"].count() == 1


def test_staleness(spark):
    v = spark.createDataFrame([(1_700_000_000.5,), (None,)], "fingerprinted_at double")
    assert [reconcile.is_stale(v, t).first()[0] for t in ("2023-11-14T22:13:20Z", "2023-11-14T22:13:21Z", "nonsense", "")] == [True, False, False, False]
    assert not reconcile.is_stale(v.limit(0), "2023-11-14T22:13:20Z").first()[0]


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    rows = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, x string")
    see = lambda df: sorted(tuple(r) for r in df.collect())
    assert see(tables.insert_ignore(t, rows, ["id"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert see(tables.upsert(t, rows.distinct(), ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert see(tables.update(t, rows.select("id"), "id", {"x": F.lit("z")})) == [(1, "a"), (2, "z")]
    m = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (4, 5, 0)], "video_a_id long, video_b_id long, moved int")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert see(tables.flag_pairs(m, ids, 1)) == [(1, 2, 1), (1, 3, 0), (4, 5, 0)] and see(tables.flag_pairs(m, ids, 1, False)) == [(1, 2, 1), (1, 3, 1), (4, 5, 0)]


def test_phash_is_robust():
    a, b = decode.ball(3, 1.0), decode.ball(4, 7.0)
    bright = np.clip(a.astype(int) + 20, 0, 255)
    d = lambda x, y: distance(int(hashing.phash(x), 16), int(hashing.phash(y), 16))
    assert len(hashing.phash(a)) == 16 and d(a, bright) <= 4 and d(a, a[::2, ::2]) <= 10 and d(a, b) > 10


def test_codes_are_shipped_a_few_times():
    """Seven million codes, those of 1 GB of documents: 8 bytes a copy stay well under the input's size."""
    plan = hamming_join.choose(10, 7_100_000)
    assert hamming_join.copies(plan, hamming_join.high_bits(plan, 7_100_000, 24)) < 40


def test_pairs_of_flagged_codes(spark, monkeypatch):
    monkeypatch.setattr(hamming_join, "CELL", 9)
    r = random.Random(4)
    codes = sorted({r.getrandbits(22) for _ in range(70)})
    df = spark.createDataFrame([(h, k % 5 == 0) for k, h in enumerate(codes)], "h long, flag boolean")
    want = {(a, b, distance(a, b)) for k, a in enumerate(codes) for b in codes if k % 5 == 0 and a != b and distance(a, b) <= 6}
    for plan in (hamming_join.WHOLE, hamming_join.bands(6, 4)):
        got = [(x.h1, x.h2, x.dist) for x in hamming_join.flagged_pairs(df, 6, plan).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_copies_are_compared_once(spark):
    """Thirty copies of one video and ten of another: two classes, whose pairs are compared instead of all of the videos'."""
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(12)]
    videos = {k: base for k in range(30)} | {100 + k: base[:11] for k in range(10)}
    f = frames_df(spark, videos)
    v = spark.createDataFrame([(i, float(len(h)), len(h)) for i, h in videos.items()], "id long, duration double, n_frames long")
    p, scratch = match.MatchParams(window=0.0), Scratch(spark, "test")
    assert match.class_pairs(*match.sequence_classes(f, v, scratch), p, scratch).count() == 3
    want = {(min(a, b, key=lambda x: (len(videos[x]), x)), max(a, b, key=lambda x: (len(videos[x]), x))) for a in videos for b in videos if a < b}
    got = [(x.short_id, x.long_id) for x in match.matches(f, v, p).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {(x.a, x.b) for x in match.candidates(f, v, p).collect()} == {(min(x), max(x)) for x in want}


def test_frames_of_documents_come_from_their_rows(spark):
    """The codes of the shuffled way, without a shuffle where no id repeats; rows of one id add up."""
    texts = [None, "", " \n ", "ÀÉ \tB  c\n", " ISTANBUL Êa\x1cz ", "a " * 64, "b " * 65, " ".join(f"W{k}" for k in range(200))]

    def plain(rows):
        words = {}
        for i, text in rows:
            for k, w in enumerate(w for w in re.split(r"[ \t\n\f\r]+", (text or "").lower()) if w):
                words.setdefault((i, k // 32), []).append(int(hashlib.md5(w.encode()).hexdigest()[:16], 16))
        return {k: sum((2 * sum(u >> b & 1 for u in us) > len(us)) << b for b in range(64)) for k, us in words.items()}

    for rows in ([(k, x) for k, x in enumerate(texts)], [(k // 2, x) for k, x in enumerate(texts)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = frames.doc_frames(df).collect()
        assert len(got) == len({(x.video_id, x.frame_idx) for x in got})
        assert {(x.video_id, x.frame_idx): int(x.phash, 16) for x in got} == plain(rows)
    wide = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(spark.sparkContext.defaultParallelism)
    plan = frames.doc_frames(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


@pytest.mark.parametrize("plan", [hamming_join.WHOLE, hamming_join.bands(10, 4)])
def test_near_codes_are_counted_where_they_are_found(spark, plan):
    r = random.Random(6)
    codes = sorted({r.getrandbits(24) for _ in range(90)})
    df = Scratch(spark, "test").table(spark.createDataFrame([(h,) for h in codes], "h long"), "codes")
    want = {}
    for a in codes:
        for b in codes:
            if distance(a, b) <= 10:
                want[distance(a, b)] = want.get(distance(a, b), 0) + 1
    blocks = Scratch(spark, "test").table(hamming_join.placed(df, plan), "blocks")
    assert {x.dist: x.n for x in hamming_join.near_counts(df, 10, plan, blocks).collect()} == want


def test_plan_weighs_cells_against_comparisons():
    """The 3.5 million codes of half a GB of documents: visiting 16-bit cells costs less than the comparisons it saves."""
    assert [len(hamming_join.choose(10, n)) for n in (700_000, 3_500_000)] == [5, 4]


def test_members_are_paired_in_blocks(spark, monkeypatch):
    """Classes of more videos than a row holds, with each other and with themselves; matches are not shuffled once they are found."""
    monkeypatch.setattr(match, "MEMBERS", 4)
    monkeypatch.setattr(match, "OUT", 7)
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    videos = {k: base for k in range(0, 30, 2)} | {k: [*base[:11], r.getrandbits(64)] for k in (1, 3)} | {k: base[:11] for k in range(101, 110)}
    f = frames_df(spark, videos)
    v = spark.createDataFrame([(i, float(len(h)), len(h)) for i, h in videos.items()], "id long, duration double, n_frames long")
    key = lambda x: (len(videos[x]), x)
    want = {(min(a, b, key=key), max(a, b, key=key)) for a in videos for b in videos if a < b}
    found = match.matches(f, v, match.MatchParams())
    got = [(x.short_id, x.long_id) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]
    both = [(x.a, x.b) for x in match.candidates(f, v, match.MatchParams()).collect()]
    assert len(both) == len(want) and set(both) == {(min(x), max(x)) for x in want}
    done = spark.createDataFrame([(max(x), min(x)) for x in want if sum(x) % 3], "video_a_id long, video_b_id long")
    left = [(x.short_id, x.long_id) for x in match.matches(f, v, match.MatchParams(), done).collect()]
    assert len(left) == len(set(left)) and set(left) == {x for x in want if sum(x) % 3 == 0}


def test_near_codes_of_one_reader_are_not_written(spark, videos):
    f = frames_df(spark, videos)
    for pairs in (hamming_join.candidate_pairs(f, 10), hamming_join.knn_candidate_pairs(f, 10), hamming_join.frame_pairs(f, 10)):
        assert not [x for x in pairs.inputFiles() if "-near" in x]


@pytest.mark.parametrize("length", [6, 70, 150, 300])
@pytest.mark.parametrize("step", [1, 3])
@pytest.mark.parametrize("least", [0.1, 0.4, 0.8])
def test_alignments_on_bit_planes(length, step, least, monkeypatch):
    """Words of 64 frames, tiles, chunks and held alignments of a few; null (one more than the last number) agrees with nothing."""
    for name, value in (("GRID", 2000), ("AT_ONCE", 50), ("HELD", 40)):
        monkeypatch.setattr(planes, name, value)
    r = random.Random(length)
    size = sorted(r.randint(max(1, length - 70), length) for _ in range(14)) + [length + 140]
    videos = [[r.choice([1, 1, 2, 3, 4]) for _ in range(n)] for n in size]
    videos[3], videos[5] = videos[2] + [2] * (size[3] - size[2]), [4] * size[5]
    n = np.array(size, np.int64)
    side = {"d": n.astype(float), "size": n, "first": np.cumsum(n) - n, "codes": np.array(sum(videos, []), np.uint8)}
    want = {}
    for p, x in enumerate(videos):
        for q, y in enumerate(videos):
            hits = [(sum(a == b < 4 for a, b in zip(x, y[s:], strict=False)), -s) for s in range(0, len(y) - len(x) + 1, step)]
            if hits and max(hits)[0] / len(x) >= least and len(x) >= 3:
                want[p, q] = (len(x), -max(hits)[1], max(hits)[0])
    got = [(p, q, *more) for x in planes.best_of_all(3, step, least, 3.0)(side, side) for p, q, *more in zip(*x, strict=True)]
    assert len(got) == len(want) and {(p, q): tuple(more) for p, q, *more in got} == want


def test_codes_within_the_threshold_get_one_number():
    assert planes.numbers(np.array([0, 1, 3, 1 << 40], np.uint64), 0).tolist() == [1, 2, 3, 4]
    assert planes.numbers(np.array([0, 1, 3, 255 << 40], np.uint64), 2).tolist() == [1, 1, 1, 2]
    assert planes.numbers(np.array([0, 1, 3], np.uint64), 1) is None


@pytest.mark.parametrize("strict", [False, True])
def test_sequences_of_few_codes_make_no_pairs(spark, strict, monkeypatch):
    """Five codes, two of them near one another: all pairs are compared in blocks, none is written or shuffled; null agrees with nothing."""
    monkeypatch.setattr(match, "MEMBERS", 4)
    monkeypatch.setattr(match, "OUT", 7)
    r = random.Random(8)
    codes = [0, 3, *(r.getrandbits(64) for _ in range(3))]
    videos = {k: [r.choice(codes) for _ in range(r.randint(8, 90))] for k in range(40)} | {k: [codes[2], codes[3]] * 6 for k in range(50, 60)}
    videos |= {60: videos[1], 61: videos[1][:-2], 62: [codes[4]] * 9 + [None], 63: [None] + [codes[4]] * 9}
    rows = [(v, i, h if h is None else signed(h)) for v, hs in videos.items() for i, h in enumerate(hs)]
    f = Scratch(spark, "test").table(spark.createDataFrame(rows, "video_id long, frame_idx long, h long"), "frames")
    v = spark.createDataFrame([(i, float(len(h)), len(h)) for i, h in videos.items()], "id long, duration double, n_frames long")
    best = lambda s, g: max(sum(None not in (a, b) and distance(a, b) <= 2 for a, b in zip(s, g[k:], strict=False)) for k in range(len(g) - len(s) + 1)) / len(s)
    want = {}
    for a, b in ((a, b) for a in videos for b in videos if a < b):
        s, g = (a, b) if len(videos[a]) <= len(videos[b]) else (b, a)
        if len(videos[s]) >= 10 and not (strict and len(videos[s]) == len(videos[g])) and (c := best(videos[s], videos[g])) >= 0.5:
            want[s, g] = c
    p = match.MatchParams(filter_length=strict, frame_step=1, threshold=2, min_confidence=0.5)
    found = match.matches(f, v, p)
    got = [(x.short_id, x.long_id, x.confidence) for x in found.collect()]
    assert len(got) == len(want) > 60 and {(a, b): c for a, b, c in got} == want
    assert not [x for x in found.inputFiles() if "-pairs" in x]
    assert "Cartesian" in found._jdf.queryExecution().executedPlan().toString()
    both = [(x.a, x.b) for x in match.candidates(f, v, p).collect()]
    assert len(both) == len(set(both)) and set(both) >= {(min(x), max(x)) for x in want}


@pytest.fixture
def near_videos(spark, monkeypatch):
    """Videos over several blocks: with frames that all share, repeated frames and a null one. (frames, videos, frame pairs, durations)."""
    monkeypatch.setattr(pair_blocks, "LARGE", 150)
    monkeypatch.setattr(pair_blocks, "SMALL", 40)
    monkeypatch.setattr(pair_blocks, "LEAST", 20)
    r = random.Random(3)
    pool = [r.getrandbits(64) for _ in range(60)]
    vs = {v: [flipped(r.choice(pool), r.choice((0, 3, 6)), r) if r.random() < 0.7 else r.choice((7, pool[0])) for _ in range(r.randrange(1, 14))] for v in r.sample(range(-40, 200), 60)}
    f = frames_df(spark, vs)
    f = f.unionByName(f.limit(1).selectExpr("video_id", "99L as frame_idx", "99.0D as timestamp", "phash", "cast(null as long) as h"))
    found = [(a, i, b, j) for a in vs for b in vs if a < b for i, x in enumerate(vs[a]) for j, y in enumerate(vs[b]) if distance(x, y) <= 10]
    d = {v: float(len(x) // 2) for v, x in vs.items()}
    v = spark.createDataFrame([(k, d[k], len(x)) for k, x in vs.items()], "id long, duration double, n_frames long")
    return f, v, found, d


def shuffles(df):
    """Exchanges of a plan, and of what it makes after its last Python stage."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.split("MapInArrow")[0].count("Exchange")


def test_candidate_pairs_in_blocks(spark, near_videos):
    f, _, found, _ = near_videos
    got = hamming_join.candidate_pairs(f, 10)
    assert shuffles(got) == 0
    assert sorted(map(tuple, got.collect())) == sorted({(a, b) for a, _, b, _ in found})


def test_frame_pairs_in_blocks(spark, near_videos):
    f, _, found, _ = near_videos
    got = hamming_join.frame_pairs(f, 10)
    assert shuffles(got) == 0 and "Join" not in got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert sorted((r.va, r.ia, r.vb, r.ib) for r in got.collect()) == sorted(found)


@pytest.mark.parametrize("step", [1, 3])
def test_best_diagonals_in_blocks(spark, near_videos, step):
    f, v, found, d = near_videos
    n, hits = {r.id: r.n_frames for r in v.collect()}, {}
    for a, i, b, j in found:
        short, long, s = (a, b, j - i) if d[a] <= d[b] else (b, a, i - j)
        at = hits.setdefault((short, long), {})
        if 0 <= s <= n[long] - n[short] and s % step == 0:
            at[s] = at.get(s, 0) + 1
    want = []
    for (short, long), at in hits.items():
        best = min(at.items(), key=lambda x: (-x[1], x[0]), default=(None, None))
        want.append((short, long, best[0], best[1], (best[1] or 0) / n[short]))
    got = match.best_diagonals(f, v, 10, step)
    assert shuffles(got) == 0
    key = lambda x: x[:2]
    assert sorted(((r.short_id, r.long_id, r.start, r.hits, r.confidence) for r in got.collect()), key=key) == sorted(want, key=key)


def test_candidate_pairs_without_known_ones(spark, near_videos):
    f, _, found, _ = near_videos
    want = sorted({(a, b) for a, _, b, _ in found})
    gone = want[::3] + [(1, 1), (500, 501), (want[1][1], want[1][0])]
    got = hamming_join.candidate_pairs(f, 10, spark.createDataFrame([*gone, (None, 3)], "a long, b long"))
    assert shuffles(got) == 0
    assert sorted(map(tuple, got.collect())) == sorted(set(want) - set(gone))


def test_uncompared_by_a_rule(spark, near_videos):
    f, _, found, _ = near_videos
    got = match.uncompared(hamming_join.candidate_pairs(f, 10), F.expr("(a + b) % 4 = 0"))
    assert shuffles(got) == 0
    assert sorted(map(tuple, got.collect())) == sorted({(a, b) for a, _, b, _ in found if (a + b) % 4})


def test_too_short_split_in_blocks(spark, near_videos):
    f, v, found, d = near_videos
    got = match.split(match.oriented_candidates(f, v, 10), match.MatchParams(window=3.0))
    assert shuffles(got) == 0
    want = {(a, b, d[a] < 3) if d[a] <= d[b] else (b, a, d[b] < 3) for a, _, b, _ in found}
    assert sorted((r.short_id, r.long_id, r.too_short) for r in got.collect()) == sorted(want)


def test_matches_without_pairs_of_a_rule(spark, videos):
    f = frames_df(spark, videos)
    v = Scratch(spark, "test").table(frames.videos_of(f), "videos")
    p = match.MatchParams(frame_step=1, window=0.0)
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    every, left = rows(match.matches(f, v, p)), match.matches(f, v, p, F.expr("(a + b) % 4 = 0"))
    assert shuffles(left) == 0
    assert 0 < len(rows(left)) < len(every) and rows(left) == [r for r in every if (r[0] + r[1]) % 4]
