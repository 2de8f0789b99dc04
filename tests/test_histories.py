"""Composed histories of cuts against the same cuts one by one."""

import random

import pytest

from cuetable.operators import edits


def remap(t, s, e):
    return t if t <= s else t - (e - s) if t >= e else s


def one_by_one(project, cuts):
    """The rule for one cut, in turn."""
    clips, captions, markers, samples, segments, hook = (list(x) if isinstance(x, list) else x for x in project)
    for s, e in cuts:
        if e <= s:
            continue
        at, left = 0, []
        for name, a, b in clips:
            start, end = at, at + b - a
            at = end
            if end <= s or start >= e:
                left.append((name, a, b))
                continue
            if start < s:
                left.append((name, a, a + s - start))
            if end > e:
                left.append((name + "-r", a + e - start, b))
        clips = left
        captions = [(i, remap(a, s, e), remap(b, s, e), flag or (a < e and b > s)) for i, a, b, flag in captions if remap(b, s, e) - remap(a, s, e) >= 30]
        kept = []
        for i, t, n in markers:
            n = s - t if t < s < t + n else n
            if not s <= t < e and n >= 80:
                kept.append((i, remap(t, s, e), n))
        markers = kept
        samples = [(i, remap(t, s, e)) for i, t in samples if not s <= t < e]
        segments = [(i, remap(a, s, e), remap(b, s, e)) for i, a, b in segments if remap(b, s, e) > remap(a, s, e)]
        hook = remap(hook or 8000, s, e)
    return clips, captions, markers, samples, segments, hook


def made(rng, n_cuts, length=20_000):
    clips, at = [], 0
    for i in range(rng.randint(1, 5)):
        size = rng.randint(50, length // 3)
        clips.append((f"c{i}", at + 1000 * i, at + 1000 * i + size))
        at += size
    spot = lambda: rng.randint(0, length)
    spans = sorted((i, *sorted((spot(), spot()))) for i in range(25))
    captions = [(i, a, b, False) for i, a, b in spans] + [(i, a, a + rng.randint(0, 400), False) for i, a in ((k, spot()) for k in range(25, 60))]
    project = clips, captions, [(i, spot(), rng.randint(10, 900)) for i in range(40)], [(i, spot()) for i in range(40)], [(i, a, b) for i, a, b, _ in captions], rng.choice([0, 3000, 9000])
    cuts = []
    for _ in range(n_cuts):
        s = rng.randint(0, length)
        cuts.append((s, s + rng.choice([0, -5, 1, 7, rng.randint(1, 300), rng.randint(1, 2 * length // n_cuts)])))
    return project, cuts


@pytest.mark.parametrize("history,block", [(512, 256), (4, 3)])
def test_histories(spark, monkeypatch, history, block):
    monkeypatch.setattr(edits, "BLOCK", block)
    rng = random.Random(history)
    videos = {f"v{k}": made(rng, n) for k, n in enumerate([1, 2, 3, 5, 8, 13, 50, 50])} | {"uncut": (made(rng, 1)[0], [])}
    rows = lambda part, columns: spark.createDataFrame([(v, *r) for v, (p, _) in videos.items() for r in p[part]], columns)
    project = {
        "clips": spark.createDataFrame([(v, i, *c) for v, (p, _) in videos.items() for i, c in enumerate(p[0])], "video_id string, ord int, clip_id string, src_start_ms bigint, src_end_ms bigint"),
        "captions": rows(1, "video_id string, id bigint, start_ms bigint, end_ms bigint, edit_review boolean"), "markers": rows(2, "video_id string, id bigint, time_ms bigint, duration_ms bigint"),
        "samples": rows(3, "video_id string, id bigint, time_ms bigint"), "segments": rows(4, "video_id string, id bigint, start_ms bigint, end_ms bigint"),
        "settings": spark.createDataFrame([(v, p[5]) for v, (p, _) in videos.items()], "video_id string, hook_end_ms bigint"),
        "quality": spark.createDataFrame([(v, "ok") for v in videos], "video_id string, status string")}
    cuts = spark.createDataFrame([(v, 3 * i, s, e) for v, (_, own) in videos.items() for i, (s, e) in enumerate(own)], "video_id string, seq bigint, cut_start_ms bigint, cut_end_ms bigint")
    after = edits.apply_edits(project, cuts, rows=7, history=history)
    want = {v: one_by_one(p, own) for v, (p, own) in videos.items()}
    got = {name: {v: [] for v in videos} for name in after}
    for name, df in after.items():
        for r in df.collect():
            got[name][r["video_id"]].append(tuple(r)[1:])
    for v, (clips, captions, markers, samples, segments, hook) in want.items():
        assert [c[1:] for c in sorted(got["clips"][v])] == clips, v
        assert sorted(got["captions"][v]) == sorted(captions) and sorted(got["markers"][v]) == sorted(markers)
        assert sorted(got["samples"][v]) == sorted(samples) and sorted(got["segments"][v]) == sorted(segments)
        assert got["settings"][v] == [(hook,)] and got["quality"][v] == [("ok", bool(videos[v][1]))]
