"""Token ids, packing, records, archives, top-k, audio and the pipeline."""

import collections
import gzip
import hashlib
import io
import wave
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echoseq.llm import chroma, common, packing, records, shards, tokens, topk, toxicity, warc
from echoseq.scratch import Scratch

from . import fixtures


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*" \n.,'sS aé1-\t ", "<|endoftext|>", "<|endo"]), st.characters(codec="utf-8")), max_size=40).map("".join))
def test_chunks_equal_the_library(tokenizer, text):
    assert ids_of(tokens.chunks(tokens.default_path()).ids(text)) == tokenizer(text)


def test_added_tokens_are_the_librarys(spark, tokenizer):
    """The string of an added token has one id wherever it stands, in both queries' operators."""
    rows = [(1, "x<|endoftext|>y", "s"), (2, "a b<|endoftext|>, c", "s"), (3, "<|endoftext|>" * 3, "s")]
    assert tokenizer(rows[0][1]) == [87, 50256, 88, 0]
    want = {i: zlib.crc32(np.array(tokenizer(t), "<u4").tobytes()) for i, t, _ in rows}
    docs = fixtures.documents(spark, rows, False, False)
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(spark, docs).collect()} == want
    assert {r.doc_id: r.ids_crc32 for r in records.round_trip(spark, docs).collect()} == want


def test_packing(spark, tokenizer):
    docs = fixtures.documents(spark)
    got = packing.pack(spark, docs).collect()
    rows = [(i, t) for i, t, _ in [*fixtures.texts(), fixtures.texts()[0]]] + [(None, "one two three"), (None, None)]
    sequences, total = collections.defaultdict(list), 0
    want = collections.Counter()
    for i, t in rows:
        ids = tokenizer(t)
        total += len(ids)
        head = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        edges = [0, *range(head, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 2
    assert packing.pack(spark, docs.limit(0)).count() == 0


def test_best_fit_is_tight():
    bins = packing.best_fit([(6, ["a"]), (5, ["b"]), (5, ["c"]), (4, ["d"])], 10)
    assert sorted(used for used, _ in bins) == [10, 10]


def test_packing_levels_merge(spark):
    """Many partitions: underfull bins of all meet in the end, as wholes."""
    rows = [(i, "a b c", "s") for i in range(400)]
    docs = fixtures.documents(spark, rows, False, False).repartition(40)
    assert packing.pack(spark, docs, length=40).select("sequence_id").distinct().count() <= 41


def test_records_round_trip(spark, tokenizer):
    docs = fixtures.documents(spark)
    scratch = Scratch(spark, "test")
    root = scratch.path("shards")
    manifest = records.write_records(spark, docs, root, scratch)
    got = records.read_records(spark, manifest).collect()
    rows = [(i, t) for i, t, _ in [*fixtures.texts(), fixtures.texts()[0]]] + [(None, "one two three"), (None, None)]
    enc = {(i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for i, t in rows for ids in [tokenizer(t)]}
    assert {(r.doc_id, r.ids_crc32, r.n_tokens) for r in got} == enc and len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    # The index alone finds any record.
    shard = manifest.where("records > 2").first()["shard"]
    where, path = shards.open_fs(shard)
    index = records.read_index(shard)
    with where.open_input_file(path) as f:
        doc, some = records.read_record(f, index[-1])
    assert (doc, zlib.crc32(some.tobytes()), len(some)) in enc
    assert records.round_trip(spark, docs.limit(0)).count() == 0


def test_frames_detect_damage():
    data = records.frame(b"payload") + records.frame(b"")
    assert list(records.read_frames(io.BytesIO(data))) == [b"payload", b""]
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(records.Corrupt):
            list(records.read_frames(io.BytesIO(bytes(bad))))
    with pytest.raises(records.Corrupt):
        list(records.read_frames(io.BytesIO(data[:-1])))
    doc, ids = records.decode_sequence(records.encode_sequence(-5, np.array([1, 70_000])))
    assert doc == -5 and ids.tolist() == [1, 70_000]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    html = "<p>\n12 é</p>\n".encode()
    block = warc.page_block(7, html)
    arc = warc.arc_version_block("x.arc", "20010203040506", version) + warc.arc_record(version, "http://a/b", "20010203040506", block, 0, "x.arc") + warc.arc_record(version, "dns:a", "20010203", b"1.2.3.4", 9, "x.arc")
    head, page, dns = warc.read_arc(io.BytesIO(arc))
    assert head.fields["version"] == str(version) and page.block == block and dns.block == b"1.2.3.4"
    out = b"".join(warc.convert(r, f"x#{n}") for n, r in enumerate((head, page, dns)))
    info, one, two = warc.read_warc(io.BytesIO(out))
    assert info[0]["WARC-Type"] == "warcinfo" and one[0]["WARC-Date"] == "2001-02-03T04:05:06Z" and one[1] == block and two[1] == b"1.2.3.4"
    assert len({h["WARC-Record-ID"] for h, _ in (info, one, two)}) == 3
    for bad in (arc[:-12], arc.replace(b"text/html", b"text html", 1) if version == 1 else b"http://no version\n"):
        with pytest.raises(warc.BadArchive):
            list(warc.read_arc(io.BytesIO(bad)))


def test_archive(spark):
    long = "x" * 150
    rows = [(5, "http://a/5", long), (3, "http://a/3", long), (9, None, long), (1, "http://a b/\n1", "short"), (2, "", "short"), (4, "http://a/4", None), (6, "u", ""), (7, "u", "é" * 70), (8, "u", "é" * 70), (3, "http://a/3", long), (None, "http://n", long)]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, shard string")
    got = warc.archive(spark, pages).collect()
    first = {long: 3, "é" * 70: 7}
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    for i, _, html in rows:
        body = (html or "").encode()
        assert all(r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest() for r in by[i])
    assert fixtures.plain((r.record_type, r.refers_to) for r in by[3]) == [("response", None), ("revisit", 3)]
    assert [(by[i][0].record_type, by[i][0].refers_to) for i in (5, 9, 1, 2, 4, 6, 7, 8, None)] == [("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None), ("response", None), ("response", None), ("revisit", first["é" * 70]), ("revisit", 3)]
    assert warc.archive(spark, pages.limit(0)).count() == 0
    assert gzip.decompress(warc.gz(b"ab") + warc.gz(b"c")) == b"abc"


def brute_top(rows, k=20, every=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted(((-int(q @ v), j) for j, v in ok if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-3])
def test_top_k(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(8) * scale).tolist()) for i in range(700)]
    for i in range(300, 420):
        rows[i] = (i, rows[0][1])
    rows += [(1000, None), (1020, [None] * 8), (1040, [float("nan")] * 8), (None, [1.0] * 8), (1060, [1.0]), (1080, [float("inf")] * 8), (40, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, block string")
    got = [tuple(r) for r in topk.top_k(spark, df).collect()]
    want = brute_top(rows)
    # id 40 occurs twice: a query each, with a ranking of its own.
    assert sum(x[0] == 40 for x in got) == 40
    assert collections.Counter(got) == collections.Counter(want)
    few = [tuple(r) for r in topk.top_k(spark, df.where("vec_id < 5")).collect()]
    assert sorted(few) == sorted(brute_top(rows[:5]))
    assert topk.top_k(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e8, 1e9, 1e13, 1e30, 1e300])
def test_top_k_of_large_components(spark, scale):
    """Products beyond doubles and beyond 64 bits; those that 64 bits can't hold count as the largest number of their sign."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(8) * (scale if i % 3 else 1.0)).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(x) for x in np.floor(64 * np.array(v))] for i, v in rows}
    top = (1 << 63) - 1
    want = []
    for i in range(0, 150, 20):
        best = sorted((-max(-top, min(top, sum(a * b for a, b in zip(whole[i], whole[j], strict=True)))), j) for j in whole if j != i)[:20]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(spark, df).collect())) == want


def test_archives_are_converted_in_many_tasks(spark):
    """A join on the shard leaves the shards in few tasks; they are dealt out again, one each."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arcs = spark.createDataFrame([(f"part-{k:06d}",) for k in range(40)], "shard string")
        again = spark.createDataFrame([(f"part-{k:06d}", [k]) for k in range(0, 40, 3)], "shard string, again array<long>")
        todo = Scratch(spark, "test").table(arcs.join(again, "shard", "left"), "todo")
        got = warc.spread(todo, 40).mapInArrow(warc_tasks, "n long").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(r.n for r in got) == [1] * 40


def warc_tasks(batches):
    import pyarrow as pa

    yield pa.RecordBatch.from_pydict({"n": [sum(rb.num_rows for rb in batches)]})


def tone(seed, n=12_000):
    r = np.random.default_rng(seed)
    t = np.arange(n) / chroma.RATE
    hz = np.repeat(r.choice([220, 262, 330, 392, 440, 523, 660, 880, 990], n // 1000 + 1), 1000)[:n]
    return ((np.sin(2 * np.pi * hz * t) * 0.6 + r.standard_normal(n) * 0.02) * 100 + 128).clip(0, 255).astype(np.uint8)


def wav(x):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(chroma.RATE)
        f.writeframes(((x.astype(int) - 128) * 256).astype("<i2").tobytes())
    return out.getvalue()


def test_any_bytes_decode():
    """What begins like WAV but isn't is bare samples; every rate, width and number of channels gives samples at one rate."""
    for x in (b"RIFF1234WAVE and so on, said the prose", b"RIFF....WAVEfmt ", wav(tone(1))[:30], wav(tone(1)).replace(b"fmt ", b"fmt?")):
        assert len(chroma.decode(x)) == len(x)
    cut = wav(tone(1))[:5001]
    assert len(chroma.decode(cut)) == (5001 - 44) // 2
    y = np.sin(np.arange(44100) * 2 * np.pi * 440 / 44100)
    for size in (1, 2, 3, 4):
        for rate, channels in ((44100, 2), (chroma.RATE, 1), (8000, 1)):
            out = io.BytesIO()
            with wave.open(out, "wb") as f:
                f.setnchannels(channels)
                f.setsampwidth(size)
                f.setframerate(rate)
                t = np.repeat(np.sin(np.arange(rate) * 2 * np.pi * 440 / rate), channels)
                f.writeframes(((t * 100 + 128).astype(np.uint8).tobytes()) if size == 1 else b"".join(int(v * 0.78125 * (1 << 8 * size - 1)).to_bytes(size, "little", signed=True) for v in t))
            x = chroma.decode(out.getvalue())
            assert abs(len(x) - chroma.RATE) <= 1
            spectrum = np.abs(np.fft.rfft(x))
            assert np.argmax(spectrum[1:]) + 1 == 440 and 0.7 < np.abs(x).max() < 0.82
    assert len(y)


def test_integers_equal_direct_sums():
    """Integers from rectangles summed directly over the image of smoothed chroma, without integral images; long audio in steps."""
    x = chroma.decode(tone(3, 9000).tobytes())
    n = (len(x) - chroma.FRAME) // chroma.HOP + 1
    f = chroma.chroma(x, chroma.HOP * np.arange(n))
    image = np.array([sum(c * f[i + k].astype(float) for k, c in enumerate(chroma.SMOOTH)) for i in range(n - 4)])
    image /= np.maximum(np.sqrt((image**2).sum(1, keepdims=True)), 1e-6)
    got = chroma.integers(f, np.array([0, n]))[0]
    assert len(got) == n - 4 - chroma.WIDTH + 1
    for t in range(0, len(got), 7):
        code = 0
        for kind, y, h, wd, step in chroma.FILTERS:
            r = lambda a, b, c, d: image[t + a : t + b, y + c : y + d].sum()  # noqa: B023, E731
            plus, minus = {
                0: lambda: (r(0, wd, 0, h), 0),
                1: lambda: (r(0, wd, h // 2, h), r(0, wd, 0, h // 2)),
                2: lambda: (r(wd // 2, wd, 0, h), r(0, wd // 2, 0, h)),
                3: lambda: (r(0, wd // 2, h // 2, h) + r(wd // 2, wd, 0, h // 2), r(0, wd // 2, 0, h // 2) + r(wd // 2, wd, h // 2, h)),
                4: lambda: (r(0, wd, h // 3, h - h // 3), r(0, wd, 0, h // 3) + r(0, wd, h - h // 3, h)),
                5: lambda: (r(wd // 3, wd - wd // 3, 0, h), r(0, wd // 3, 0, h) + r(wd - wd // 3, wd, 0, h)),
            }[kind]()
            v = np.log((1 + plus) / (1 + minus)) - (np.log1p(h * wd * 0.25) if kind == 0 else 0)
            level = sum(v >= s for s in (-step, 0.0, step))
            code = code << 2 | (0, 1, 3, 2)[level]
        # A ratio within rounding of a quantiser step may fall to either side.
        assert bin(int(got[t]) ^ code).count("1") <= 1
    steps = chroma.FRAMES
    try:
        chroma.FRAMES = 17
        assert np.array_equal(chroma.integers(chroma.chroma(x, chroma.HOP * np.arange(n)), np.array([0, n]))[0], got)
    finally:
        chroma.FRAMES = steps


def test_votes_equal_counting():
    r = np.random.default_rng(4)
    for a, b in ((r.integers(0, 5, 60), r.integers(0, 5, 80)), (np.zeros(50, int), np.r_[np.zeros(70, int), 1]), (np.arange(9), np.arange(20, 30))):
        a, b = a.astype(np.uint32), b.astype(np.uint32)
        want = [sum(0 <= i + o < len(b) and a[i] == b[i + o] for i in range(len(a))) for o in range(1 - len(a), len(b))]
        votes = chroma.VOTES
        for cap in (votes, 100, 7):
            chroma.VOTES = cap
            try:
                assert chroma.offset_votes(a, b).tolist() == want
            finally:
                chroma.VOTES = votes
    silence = np.zeros(60_000, np.uint32)
    assert chroma.align(silence, silence) == (0, 60_000, 0)


def test_recall_of_noisy_recordings():
    """Bit errors of 10 %, at random, in recordings of a few seconds and more; shifted by part of a hop; excerpts."""
    r = np.random.default_rng(6)
    hits = 0
    for _ in range(20):
        a = r.integers(0, 2**32, 4000, dtype=np.uint32)
        b = a ^ np.packbits(r.random((len(a), 32)) < 0.1, axis=1).view(np.uint32).ravel()
        hits += chroma.linked(a.tobytes(), b[300:].tobytes())
    assert hits >= 18
    base = [tone(s, 20_000) for s in range(60, 70)]
    shifted = [x[int(r.integers(0, 2000)) :] for x in base]
    assert sum(chroma.linked(codes(x.tobytes()).tobytes(), codes(y.tobytes()).tobytes()) for x, y in zip(base, shifted, strict=True)) >= 9


def codes(audio):
    x = chroma.decode(audio)
    n = max((len(x) - chroma.FRAME) // chroma.HOP + 1, 0)
    return chroma.integers(chroma.chroma(x, chroma.HOP * np.arange(n)), np.array([0, n]))[0]


def test_audio_classes(spark):
    base = [tone(s) for s in range(6)]
    cut = base[0].copy()
    cut[6000:6200] = 128
    rows = [(i + 1, x.tobytes()) for i, x in enumerate(base)] + [(10, base[0].tobytes()), (11, cut.tobytes()), (12, wav(base[1])), (13, base[2][64 * chroma.HOP // 8 :].tobytes()), (20, None), (21, b""), (22, b"short"), (None, base[0].tobytes()), (1, base[0].tobytes())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, audio binary, codes int")
    got = chroma.recordings(spark, df).collect()
    own = {i: codes(a) for i, a in rows if i is not None and len(codes(a))}
    up = {i: i for i in own}
    for a in sorted(own):
        for b in sorted(own):
            if a < b and (own[a].tobytes() == own[b].tobytes() or chroma.linked(own[a].tobytes(), own[b].tobytes())):
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    for r in got:
        if r.doc_id is not None:
            assert r.class_id == up.get(r.doc_id, r.doc_id) and r.n_codes == len(own.get(r.doc_id, []))
    assert len(got) == len(rows) and up[10] == up[11] == 1 and len(set(up.values())) >= 6
    assert chroma.recordings(spark, df.limit(0)).count() == 0


def test_shifted_and_noisy_recordings_link(spark):
    """None of these reaches a Jaccard similarity of 0.85 of the integers; overlap and bit errors alone decide."""
    r = np.random.default_rng(5)
    base = [tone(s) for s in range(40, 46)]
    noisy = (base[1].astype(int) + r.integers(-3, 4, len(base[1]))).clip(0, 255).astype(np.uint8)
    rows = [(i + 1, x.tobytes()) for i, x in enumerate(base)] + [(11, b"seven b" + base[0].tobytes()), (12, noisy.tobytes()), (13, base[2][200 * chroma.HOP // 8 + 3 :].tobytes())]
    own = {i: codes(a) for i, a in rows}
    for x, y in ((1, 11), (2, 12), (3, 13)):
        a, b = np.unique(own[x]), np.unique(own[y])
        both = len(np.intersect1d(a, b))
        assert both < 0.85 * (len(a) + len(b) - both) and chroma.linked(own[x].tobytes(), own[y].tobytes())
    got = {x.doc_id: x.class_id for x in chroma.recordings(spark, spark.createDataFrame(rows, "doc_id long, audio binary")).collect()}
    assert got == {**{i: i for i in range(1, 7)}, 11: 1, 12: 2, 13: 3}


def test_links_without_a_shared_landmark(spark, monkeypatch):
    """Bit errors of 0.08 that leave no landmark whole, only one integer in three; and recordings that share one integer by chance."""
    monkeypatch.setattr(chroma, "REST", 1 << 9)
    r = np.random.default_rng(6)
    own = [r.integers(0, 1 << 32, n, dtype=np.uint32) for n in (40, 45, 60, 61, 200, 3) * 6]
    for k in range(len(own)):
        copy = own[k].copy()
        copy[np.arange(len(copy)) % 3 != 0] ^= np.uint32(sum(1 << (30 - 2 * f) for f in chroma.MARKS[:4]))
        own.append(copy[k % 3 :] if len(copy) > 40 else copy)
    for k in range(1, 36):
        own[k][5 % len(own[k])] = own[0][0]
    nodes = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(own)], "id long, codes binary")
    found = {x.node: x.label for x in chroma.link_recordings(nodes, common.Scratch(spark, "test")).collect()}
    up = list(range(len(own)))
    for b in range(len(own)):
        for a in range(b):
            if chroma.linked(own[a].tobytes(), own[b].tobytes()) and up[a] != up[b]:
                up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    assert [found.get(k, k) for k in range(len(own))] == up and sum(up[k + 36] == up[k] for k in range(36)) >= 30


def test_short_copies_share_a_class(spark):
    """Audio without integers: equal samples are one class, null and empty audio stay apart."""
    x = tone(50, 800)
    rows = [(1, x.tobytes()), (2, x.tobytes()), (3, wav(x)), (4, x[:-1].tobytes()), (5, b""), (6, b""), (7, None), (8, None), (None, x.tobytes())]
    got = chroma.recordings(spark, spark.createDataFrame(rows, "doc_id long, audio binary")).collect()
    assert {r.doc_id: (r.n_codes, r.class_id) for r in got if r.doc_id} == {i: (0, 1 if i in (2, 3) else i) for i in range(1, 9)} and len(got) == 9


def test_alignment():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**32, 300, dtype=np.uint32)
    b = np.concatenate([r.integers(0, 2**32, 40, dtype=np.uint32), a])
    assert chroma.align(a, b) == (40, 300, 0) and chroma.align(b, a) == (-40, 300, 0)
    c = a.copy()
    c[::7] ^= np.uint32(3)
    assert chroma.align(a, c) == (0, 300, 2 * len(a[::7]))


def brute_kept(rows, percent):
    """doc_ids that stay: the least of each class of texts linked at `percent` of distinct five-word shingles."""
    from .test_texts import shingles

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted(i for i in sets if find(i) == i)


def test_pipeline(spark):
    """Each stage against plain Python on its own input."""
    import corpus_pipeline as p

    from . import test_texts

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in p.STAGES:
        before = docs
        docs = Scratch(spark, "test").table(stage(spark, docs, sf), "stage")
        old = {r.doc_id: r for r in before.collect()}
        got = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
        if name == "toxicity":
            lexicon = toxicity.fit(spark, before, labels)
            want = [i for i, r in old.items() if lexicon.score(r.text) < 0.3]
            assert sorted(r.doc_id for r in got) == sorted(want) and all(r == old[r.doc_id] for r in got) and len(got) < len(old)
        if name == "near-duplicates":
            assert sorted(r.doc_id for r in got) == brute_kept([(i, r.text) for i, r in old.items()], 80)
            assert all(r == old[r.doc_id] for r in got) and len(got) < len(old)
        if name == "substrings":
            want = test_texts.brute_removed([(i, r.text, None) for i, r in old.items()])
            assert len(got) == len(old)
            for (i, n, g, digest), r in zip(sorted(want), sorted(got, key=lambda r: r.doc_id), strict=True):
                assert r.doc_id == i and len(test_texts.WORD.findall(r.text or "")) == n - g
                assert (r.text == old[i].text) if not g else (hashlib.sha256(r.text.encode()).hexdigest() == digest and r.n_chars == len(r.text))
        if name == "mixing":
            size = {i: len(test_texts.WORD.findall(r.text or "")) for i, r in old.items()}
            sizes, taken, copies = collections.Counter(), collections.Counter(), collections.Counter(r.doc_id for r in got)
            for i, r in old.items():
                sizes[r.source] += size[i]
                taken[r.source] += copies[i] * size[i]
            assert all(r == old[r.doc_id] for r in got) and max(copies.values()) <= 3
            for source, target in test_texts.brute_targets(sizes).items():
                assert abs(taken[source] - target) <= max(size[i] for i, r in old.items() if r.source == source)
        if name == "packing":
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokens.default_path())
            ids = {i: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for i, r in old.items()}
            times = collections.Counter(r.doc_id for r in before.collect())
            assert collections.Counter(x for r in got for x in [r.doc_id] * r.length) == collections.Counter({i: n * len(ids[i]) for i, n in times.items()})
            assert all(zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in got)
            full = collections.defaultdict(list)
            for r in got:
                full[r.sequence_id].append((r.offset, r.length))
            for s in full.values():
                s.sort()
                assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
            assert len(full) <= -(-sum(r.length for r in got) // 2048) * 1.02 + 1
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        empty = Scratch(spark, "test").table(stage(spark, empty, sf), "stage")
    assert empty.count() == 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    """Rows without a doc_id stay apart from document -1 and from each other; extra columns are carried."""
    import corpus_pipeline as p

    rows = [*fixtures.texts(), (-1, "one two three", "a"), (None, "one two three", "a"), (None, "one two three", "a")]
    docs = fixtures.documents(spark, rows)
    one = p.keep_one(spark, docs, "")
    assert one.columns == docs.columns
    got = collections.Counter(r.doc_id for r in one.collect())
    # The four rows without an id, and 7 and -1 of one class, whose least id stays.
    assert got[None] == 4 and got[-1] == 1 and got[7] == 0 and got[1] == 1 and got[2] == 0
    for stage in (p.cut_repeats, p.to_weights):
        out = stage(spark, one, "")
        assert out.columns == docs.columns and {r.row for r in out.collect()} == {"y"}
