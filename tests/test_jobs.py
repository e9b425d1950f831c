"""The commands from end to end on synthetic videos, and the driver entry points."""

import json
import os

import pytest

from echoseq import cli
from echoseq.plans import jobs
from echoseq.sources import decode, files, search_index, store

FILES = {"a.mp4": "ball:1:40", "b.MP4": "ball:1:40", "sub/c.mkv": "ball:1:25", "d.avi": "ball:9:40", "bad.mp4": "nonsense", "note.txt": "x"}


def decoder(path, fps):
    """The file names a synthetic video."""
    with open(path) as f:
        return decode.synthetic(f.read(), fps)


@pytest.fixture
def library(tmp_path):
    for name, text in FILES.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_life_cycle(spark, library):
    with pytest.raises(jobs.NoIndex):
        jobs.run_match(spark, library)
    assert not os.path.exists(os.path.join(library, store.FOLDER, "match.json"))
    failed = rows(jobs.run_index(spark, library, decoder=decoder))
    assert [p.rpartition("/")[2] for p, _ in failed] == ["bad.mp4"]
    s = store.Store(spark, library)
    ids = {r.path.rpartition("/")[2]: r.id for r in s.read("videos").collect()}
    assert sorted(ids, key=ids.get) == ["a.mp4", "b.MP4", "bad.mp4", "d.avi", "c.mkv"]
    assert s.read("frame_hashes").count() == 40 + 40 + 25 + 40
    before = s.read("frame_hashes").count()
    jobs.run_index(spark, library, decoder=decoder)
    assert s.read("frame_hashes").count() == before and s.read("videos").count() == 5

    dry = rows(jobs.run_match(spark, library, dry_run=True, frame_step=1))
    found = rows(jobs.run_match(spark, library, frame_step=1))
    assert dry == found and (ids["a.mp4"], ids["b.MP4"], "duplicate", 1.0) in found
    assert {(x[0], x[2]) for x in found if ids["c.mkv"] in x[:2]} == {(ids["c.mkv"], "subclip")}
    assert not [x for x in found if ids["d.avi"] in x[:2]]
    compared = s.read("comparisons").count()
    assert rows(jobs.run_match(spark, library, frame_step=1)) == [] and s.read("comparisons").count() == compared
    assert not jobs.is_stale(spark, library)

    summary = jobs.run_move(spark, library, dry_run=True).first()
    assert tuple(summary) == (3, 1) and os.path.exists(f"{library}/a.mp4")
    plan = rows(jobs.run_move(spark, library))
    assert len(plan) == 3 and sorted(os.listdir(f"{library}/duplicates/1")) == ["a.mp4", "b.MP4", "c.mkv"]
    assert all(r.moved == 1 for r in s.read("matches").collect())
    assert files.find_videos(spark, library).count() == 2 and rows(jobs.run_move(spark, library)) == []

    os.unlink(f"{library}/duplicates/1/b.MP4")
    os.unlink(f"{library}/duplicates/1/c.mkv")
    assert tuple(jobs.run_cleanup(spark, library).first()) == (1, 2, 1)
    assert os.path.exists(f"{library}/a.mp4") and not os.path.exists(f"{library}/duplicates/1")
    left = {r.id: r.moved_to for r in s.read("videos").collect()}
    assert set(left) == {ids["a.mp4"], ids["bad.mp4"], ids["d.avi"]} and left[ids["a.mp4"]] is None

    os.unlink(f"{library}/d.avi")
    assert [i for i, _ in rows(jobs.run_sync(spark, library, dry_run=True))] == [ids["d.avi"]] and s.read("videos").count() == 3
    jobs.run_sync(spark, library)
    assert s.read("videos").count() == 2 and s.read("frame_hashes").count() == 40


def test_configs_and_continue(spark, library):
    s = store.Store(spark, library)
    assert s.configs() == {} and s.load_config("index") is None
    jobs.run_index(spark, library, fps=0.5, decoder=decoder)
    jobs.run_match(spark, library, window=5.0, frame_step=1)
    assert s.load_config("index")["args"]["fps"] == 0.5 and s.load_config("match")["args"]["window"] == 5.0
    assert set(s.configs()) == {"index", "match"}
    assert rows(jobs.run_continue(spark, library, choose=lambda names: "match")) == []
    assert len(rows(jobs.run_continue(spark, library, "index", decoder=decoder))) == 1
    with open(os.path.join(s.root, "match.json"), "w") as f:
        f.write("{ invalid json }")
    assert set(s.configs()) == {"index"}
    with pytest.raises(jobs.NoIndex):
        jobs.run_continue(spark, library, "match")


def test_index_is_kept_in_chunks(spark, library):
    """A run that is stopped keeps its finished chunks, and the next one does the rest."""
    asked = []
    jobs.run_index(spark, library, decoder=decoder, chunk=2, stop=lambda: len(asked) == 1 or asked.append(1))
    s = store.Store(spark, library)
    done = [r.id for r in s.read("videos").where("fingerprinted_at is not null").collect()]
    assert len(done) == 2 and s.read("videos").count() == 5
    failed = rows(jobs.run_index(spark, library, decoder=decoder, chunk=2))
    assert len(failed) == 1 and s.read("videos").where("fingerprinted_at is not null").count() == 4
    assert s.read("frame_hashes").count() == 145 and s.read("frame_hashes").dropDuplicates(["video_id", "frame_idx"]).count() == 145


def test_match_is_kept_in_slices(spark, library):
    jobs.run_index(spark, library, decoder=decoder)
    s = store.Store(spark, library)
    jobs.run_match(spark, library, frame_step=1, slices=16, stop=lambda: s.read("comparisons").count() > 0)
    some, part = s.read("matches").count(), s.read("comparisons").count()
    jobs.run_match(spark, library, frame_step=1)
    whole = s.read("matches")
    assert 0 < part < s.read("comparisons").count() == 3 and some <= whole.count() == 3
    assert sorted(r.id for r in whole.collect()) == [1, 2, 3]


def test_search_index_follows_the_frames(spark, library, capsys):
    jobs.run_index(spark, library, decoder=decoder)
    s = store.Store(spark, library)
    with pytest.raises(LookupError):
        search_index.near(s, 10)
    assert search_index.build(s, 10) and not search_index.build(s, 10) and search_index.build(s, 9) and search_index.build(s, 10)
    assert search_index.meta(s.read("index_meta")).first()["codes"] == s.read("frame_hashes").select("h").distinct().count()
    found = rows(jobs.run_match(spark, library, frame_step=1))
    assert len(found) == 3 and not search_index.build(s, 10)
    with open(os.path.join(library, "new.mp4"), "w") as f:
        f.write("ball:1:30")
    config = s.load_config("match") | {"last_run": "2001-01-01T00:00:00Z"}
    store.replace_json(os.path.join(s.root, "match.json"), config)
    jobs.run_index(spark, library, decoder=decoder)
    assert jobs.is_stale(spark, library)
    again = rows(jobs.run_continue(spark, library, "match"))
    assert len(again) == 3 and "built again" in capsys.readouterr().err
    assert not search_index.build(s, 10) and not jobs.is_stale(spark, library)
    search_index.invalidate(s)
    assert s.read("index_meta").isEmpty() and s.read("index_blocks").isEmpty()


def test_other_schemes_are_refused(spark):
    for url in ("hdfs://host/lib", "s3a://bucket/lib"):
        with pytest.raises(ValueError, match="folder"):
            store.Store(spark, url)


def test_decoder_with_many_messages_and_a_limit():
    """Messages beyond a pipe's size don't stop a decoder; one that doesn't end is killed."""
    import sys

    code = "import sys; sys.stderr.write('x' * 2000000); sys.stdout.buffer.write(bytes(120 * 160 * 3))"
    assert len(list(decode.raw_frames([sys.executable, "-c", code], 60))) == 3
    with pytest.raises(RuntimeError, match="exit 3.*broken"):
        list(decode.raw_frames([sys.executable, "-c", "import sys; sys.stderr.write('broken'); sys.exit(3)"], 60))
    with pytest.raises(RuntimeError, match="exit"):
        list(decode.raw_frames([sys.executable, "-c", "import time; time.sleep(60)"], 1))


def test_audio_fingerprints(spark, library, tmp_path, monkeypatch):
    """Duration and fingerprint of the tool's output; a video's new fingerprint replaces its old one."""
    tool = tmp_path / "fpcalc"
    tool.write_text('#!/bin/sh\necho \'{"duration": 12.5, "fingerprint": "AQAB"}\'\n')
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert decode.chromaprint("x") == (12.5, "AQAB")
    tool.write_text("#!/bin/sh\necho nothing\n")
    assert decode.chromaprint("x") is None

    def heard(path, fps):
        return decoder(path, fps)._replace(audio=(9.5, "F"))

    jobs.run_index(spark, library, decoder=heard)
    s = store.Store(spark, library)
    assert {(r.duration, r.fingerprint) for r in s.read("audio_fingerprints").collect()} == {(9.5, "F")}
    v = jobs.load_videos(s.read("videos"), s.read("frame_hashes"), s.read("audio_fingerprints").limit(1))
    assert v.where("has_audio").count() == 1 and v.count() == 4


def test_json_is_atomic(tmp_path):
    path = str(tmp_path / "x.json")
    store.replace_json(path, {"a": 1})
    with pytest.raises(TypeError):
        store.replace_json(path, {"a": object()})
    assert json.load(open(path)) == {"a": 1} and os.listdir(tmp_path) == ["x.json"]


def test_cli(spark, library, capsys):
    assert cli.main(["match", library], spark) == 1 and "no index" in capsys.readouterr().err
    a = cli.parser().parse_args(["match", "d"])
    assert (a.window, a.frame_step, a.threshold, a.min_confidence, a.workers, a.nprobe) == (10.0, 3, 10, 0.8, 4, 32)
    jobs.run_index(spark, library, decoder=decoder)
    assert cli.main(["match", library, "--frame-step", "1"], spark) == 0 and "duplicate" in capsys.readouterr().out


def test_streaming(spark, library, tmp_path):
    from echoseq.streaming.ingest import ingest

    new = tmp_path / "arriving"
    new.mkdir()
    (new / "1.json").write_text(json.dumps({"path": f"{library}/a.mp4"}))
    ingest(spark, str(new), library, str(tmp_path / "cp"), decoder).awaitTermination(120)
    s = store.Store(spark, library)
    assert s.read("videos").count() == 1 and s.read("frame_hashes").count() == 40


def test_missing_decoder_is_an_error(spark, monkeypatch):
    monkeypatch.setenv("PATH", "")
    with pytest.raises(RuntimeError, match="ffmpeg"):
        decode.ffmpeg("x.mp4")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["short_id", "long_id", "match_type", "confidence"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sf001_counts(spark):
    from echoseq.plans.queries import QUERIES

    kinds = [r.match_type for r in QUERIES["q_match_every_start"](spark, "/root/testdata/sf0.01").collect()]
    assert (len(kinds), kinds.count("duplicate")) == (491, 156)
