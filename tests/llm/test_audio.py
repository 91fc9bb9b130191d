from __future__ import annotations

import io
import wave

import numpy as np
import pytest

from seisframe.llm import audio


def vector(seed):
    return np.random.default_rng(seed).normal(0, 0.12, 64).tolist()


def wav(samples, rate, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(np.clip(samples * 20000, -32768, 32767).astype("<i2"), channels).tobytes())
    return out.getvalue()


def block(prints):
    return audio.QueryBlock(list(range(len(prints))), [p.astype("<u4").tobytes() for p in prints])


def test_cuts_and_noise_align_and_others_do_not():
    x, rate = audio.play(vector(1))
    own = audio.fingerprint(x, rate)
    step = int(audio.STEP * rate)
    found = block([own]).search(audio.fingerprint(x[6 * step :], rate))
    assert found == [(0, -6, 0.0)]
    noisy = audio.fingerprint(x + 0.2 * np.random.default_rng(0).standard_normal(len(x)), rate)
    assert [h[:2] for h in block([own]).search(noisy)] == [(0, 0)]
    others = [audio.fingerprint(*audio.play(vector(k))) for k in range(2, 40)]
    assert sum(len(block([own]).search(o)) for o in others) <= 1


def every_offset(own, items):
    """(offset, share) of the best match by plain loops; None without one."""
    need = min(audio.OVERLAP, len(own), len(items))
    found = []
    for shift in range(-len(own) + 1, len(items)):
        a, b = max(0, shift), min(len(items), len(own) + shift)
        if b - a >= max(need, 1):
            wrong = sum(int(items[i] ^ own[i - shift]).bit_count() for i in range(a, b)) / (32 * (b - a))
            found += [(wrong, a - b, shift)] if wrong <= audio.ERRORS else []
    return (min(found)[2], min(found)[0]) if found else None


@pytest.mark.parametrize("places", [50, 32_768])
def test_every_match_up_to_the_threshold_is_found(monkeypatch, places):
    monkeypatch.setattr(audio, "PLACES", places, raising=False)
    rng = np.random.default_rng(7)
    queries = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (34, 34, 1, 5, 12, 13, 80, 34, 0)]
    queries.append(np.full(20, 5, dtype=np.uint32))
    recordings = [np.full(30, 5, dtype=np.uint32), queries[6][20:], queries[0][:1], np.empty(0, dtype=np.uint32)]
    for q in queries:
        for share in (0.1, 0.17, 0.19, 0.21):
            flips = (rng.random((len(q), 32)) < share) @ (1 << np.arange(32, dtype=np.int64))
            x = q ^ flips.astype(np.uint32)
            before, cut = rng.integers(0, 1 << 32, rng.integers(0, 9), dtype=np.uint32), rng.integers(0, 9)
            recordings.append(np.concatenate([before, x[cut:]]))
    matches = 0
    for items in recordings:
        want = {k: hit for k, q in enumerate(queries) if (hit := every_offset(q, items))}
        assert {k: (shift, wrong) for k, shift, wrong in block(queries).search(items)} == want
        matches += len(want)
    assert matches > 15


def test_filters_match_plain_sums():
    x, rate = audio.play(vector(3))
    picture = audio.pitch_classes(x, rate)
    got = audio.fingerprint(x, rate)
    for at in (0, 7):
        word = 0
        for kind, c, h, w in audio.FILTERS:
            part = picture[at : at + w, c : c + h]
            first = {
                0: part.sum(), 1: part[:, : h // 2].sum(), 2: part[: w // 2].sum(),
                3: part[: w // 2, : h // 2].sum() + part[w // 2 :, h // 2 :].sum(),
                4: part[:, h // 3 : h - h // 3].sum(), 5: part[w // 3 : w - w // 3].sum(),
            }[kind]
            second = w * h * 0.2 if kind == 0 else part.sum() - first
            word = word << 2 | [0, 1, 3, 2][int(np.searchsorted(audio.SPLIT, np.log1p(first) - np.log1p(second)))]
        assert word == got[at]
    assert all(c + h <= 12 and w <= audio.WIDTH for _, c, h, w in audio.FILTERS)


def test_wav_is_read_and_broken_media_is_empty():
    x, rate = audio.play(vector(4))
    samples, got = audio.read_wav(wav(np.repeat(x, 2), 2 * rate, 2))
    assert got == rate and len(samples) == len(x)
    for bad in (None, b"", b"RIFFnothing", wav(x, rate)[:20]):
        assert len(audio.read_wav(bad)[0]) == 0
    assert len(audio.fingerprint(np.zeros(100), audio.RATE)) == 0


@pytest.mark.parametrize("size", [2, 2000])
def test_classes_and_queries(spark, size):
    rows = [(k, vector(k % 7) if k % 5 else vector(100 + k)) for k in range(0, 60)] + [(100, vector(1)), (200, None), (300, []), (None, vector(1))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, items string").repartition(3)
    got = {r.vec_id: r for r in audio.align(frame, "vec_id", "embedding", audio.play, every=10, block=size).collect()}
    assert len(got) == len(rows)
    prints = {i: audio.fingerprint(*audio.play(v)) for i, v in rows}
    first = {}
    for i in sorted(i for i in prints if i is not None):
        first.setdefault(prints[i].tobytes(), i)
    asked = {}
    for i in sorted(i for i in prints if i is not None and i % 10 == 0 and len(prints[i])):
        asked.setdefault(prints[i].tobytes(), i)
    for i, p in prints.items():
        hits = [(hit[1], q, hit[0]) for own, q in asked.items() if len(p) and (hit := every_offset(np.frombuffer(own, dtype="<u4"), p))]
        assert (got[i].n_items, got[i].class_id, got[i].n_links) == (len(p), first[p.tobytes()], len(hits))
        if hits:
            e, q, s = min(hits)
            assert (got[i].best_query, got[i].best_offset, got[i].best_errors) == (q, s, round(e, 6))


def test_recordings_of_different_lengths_and_a_very_long_one():
    rng = np.random.default_rng(5)
    recordings = [audio.play(rng.uniform(-1, 1, n).tolist()) for n in (64, 10, 64, 0, 3, 40, 5000)]
    for (x, rate), items in zip(recordings, audio.fingerprint_all(recordings), strict=True):
        assert np.array_equal(items, audio.fingerprint(x, rate))
    assert len(items) > 3900


def test_empty_table(spark):
    assert audio.align(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding", audio.play).collect() == []
