"""Bounded-space online packing against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from litmill.llm import bounded_pack as bp
from litmill.llm import packing


def brute(lengths, size, most, max_padding):
    """The rule in words, by scanning all windows: emitted and open windows as lists of (document, start, length)."""
    done, windows = [], []
    room = lambda w: size - sum(n for _, _, n in w)
    for doc, n in enumerate(lengths):
        start = 0
        while n >= size:
            done.append([(doc, start, size)])
            start, n = start + size, n - size
        if not n:
            continue
        fits = [w for w in windows if room(w) >= n]
        if fits:
            best = min(fits, key=room)
            best.append((doc, start, n))
            if not room(best):
                windows.remove(best)
                done.append(best)
            continue
        if len(windows) == most:
            full = min(windows, key=room)
            windows.remove(full)
            if (r := room(full)) > max_padding:
                full.append((doc, start, r))
                start, n = start + r, n - r
            done.append(full)
        windows.append([(doc, start, n)])
    return done, windows


def shown(sequences):
    return [[(d, s, len(i) // 4) for d, s, i, _ in w] for w in sequences]


@pytest.mark.parametrize("seed", range(30))
def test_online_rule(seed):
    r = random.Random(seed)
    size, most, pad = r.choice([(16, 3, 0), (64, 5, 0), (50, 4, 6)])
    lengths = [r.choice([r.randint(1, size // 2), r.randint(1, 3 * size)]) for _ in range(200)]
    w = bp.Windows(size, most, pad)
    for doc, n in enumerate(lengths):
        w.put((doc, 0, np.arange(n, dtype="<u4").tobytes(), n))
    done, left = brute(lengths, size, most, pad)
    assert shown(w.emitted) == done
    assert sorted(shown(w.open.values())) == sorted(left)
    before = len(w.emitted)
    rest = w.merge()
    full = [sum(len(p[2]) // 4 for p in s) for s in w.emitted[before:]]
    assert all(size - pad <= n <= size for n in full)
    tail = bp.halves(rest, size)
    n = [sum(len(p[2]) // 4 for p in s) for s in tail]
    assert all(x & (x - 1) == 0 for x in n) and n == sorted(set(n), reverse=True)
    got = Counter((p[0], t) for s in [*w.emitted, *tail] for p in s for t in np.frombuffer(p[2], "<u4").tolist())
    assert got == Counter((doc, t) for doc, n in enumerate(lengths) for t in range(n))


def check(got, rows, size):
    """Every id in one piece, sequences gapless and without padding."""
    ids = packing.Ids(packing.word_file())
    want = Counter()
    for r in rows:
        want[r[0], ids(r[1] or "") + bytes([1, 0, 0, 0])] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= size and at & (at - 1) == 0
    assert sum(r.length for r in got) == sum(len(flat) // 4 * n for (_, flat), n in want.items())
    for doc in {d for d, _ in want}:
        flats = [flat for (d, flat), n in want.items() if d == doc for _ in range(n)]
        spans = Counter()
        for r in by_doc[doc]:
            fits = [f for f in flats if len(f) // 4 == r.doc_tokens and zlib.crc32(f[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32]
            assert fits
            spans.update(range(r.start, r.start + r.length))
        assert spans == Counter(t for f in flats for t in range(len(f) // 4))


@pytest.mark.parametrize("size,most,many", [(2048, 64, 256), (64, 2, 2), (16, 3, 256)])
def test_pack(docs, rows, size, most, many, monkeypatch):
    """Nulls, empty and long texts, repeated rows, clashing columns; merged in one round or in several."""
    monkeypatch.setattr(bp, "MERGED", many)
    got = bp.bounded_pack(docs.repartition(7), size=size, open_windows=most).collect()
    check(got, rows, size)


def test_query_and_empty(spark, sf_dir, rows, none):
    out = bp.op12_bounded_pack(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(out.collect(), rows, 2048)
    assert bp.bounded_pack(none).collect() == []


def test_padding_that_is_allowed(docs):
    out = bp.bounded_pack(docs.repartition(2), size=64, open_windows=4, max_padding=8).collect()
    filled = Counter()
    for r in out:
        filled[r.sequence_id] += r.length
    assert all(n >= 56 or n & (n - 1) == 0 for n in filled.values())
