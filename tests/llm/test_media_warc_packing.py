import hashlib
import random
import zlib

import pytest
from test_dedup import frame, odd_rows

from lexiform.llm import mpegts, packing, warc


def test_ts_round_trip():
    rng = random.Random(1)
    for n in [0, 1, 100, 161, 162, 163, 175, 176, 177, 345, 576, 9215, 9216, 9217, 200_000]:
        payload = rng.randbytes(n)
        media = mpegts.mux(payload)
        s = mpegts.demux(media)
        assert len(media) % 188 == 0 and s.payload() == payload
        assert (s.gaps, s.broken, s.programs, s.streams) == (0, 0, {1: 0x1000}, {0x100: 6})
        assert [u.pts for u in s.units] == [k * 3600 for k in range(-(-n // mpegts.UNIT))]
        assert [u.random_access for u in s.units] == [k % 8 == 0 for k in range(len(s.units))]


def test_ts_faults():
    media = mpegts.mux(bytes(40_000))
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    s = mpegts.demux(b"".join(packets[:10] + packets[11:]))
    assert s.gaps == 1 and s.broken == 1 and len(s.units) == 4
    s = mpegts.demux(b"".join(packets[:10] + [packets[9]] + packets[10:]))
    assert s.repeats == 1 and s.payload() == bytes(40_000)
    assert mpegts.demux(media[:-100]).broken >= 1
    bad = bytearray(media)
    bad[20] ^= 1
    assert mpegts.demux(bytes(bad)).broken >= 1 and mpegts.demux(b"").units == []
    assert mpegts.demux(mpegts.mux(b"a" * 500) + mpegts.mux(b"b" * 500)).payload() == b"a" * 500 + b"b" * 500


def packet(pid, body, counter, start=False):
    """A packet by the standard's layout; what is not filled is stuffed by an adaptation field."""
    room = 184 - len(body)
    extra = b"" if not room else bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"")
    return bytes([0x47, 0x40 * start | pid >> 8, pid & 0xFF, (0x30 if room else 0x10) | counter & 15]) + extra + body


def section(table, number, body):
    return mpegts._section(table, number, body)


def test_ts_program_tables_decide():
    """Streams that no program names are left out, and a section may go on in the next packet, before the pointer."""
    pat = section(0, 1, (7).to_bytes(2, "big") + (0xE000 | 0x30).to_bytes(2, "big"))
    long = b"".join(bytes([0x06]) + (0xE000 | 0x200 + k).to_bytes(2, "big") + b"\xf0\x28" + bytes(40) for k in range(5))
    pmt = section(2, 7, (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\x00" + long)
    again = section(2, 7, (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\x00" + bytes([0x1B]) + (0xE000 | 0x300).to_bytes(2, "big") + b"\xf0\x00")
    assert len(pmt) > 183
    pes = lambda data: b"\0\0\1\xbd" + (len(data) + 3).to_bytes(2, "big") + b"\x80\0\0" + data
    tail = pmt[183:]
    media = b"".join([
        packet(0, b"\0" + pat, 0, True), packet(0x30, b"\0" + pmt[:183], 0, True), packet(0x30, bytes([len(tail)]) + tail + again, 1, True),
        packet(0x200, pes(b"named"), 0, True), packet(0x77, pes(b"stray"), 0, True), packet(0x300, pes(b"later"), 0, True), packet(0x77, b"more", 1),
    ])
    s = mpegts.demux(media)
    assert s.programs == {7: 0x30} and s.streams == {**{0x200 + k: 6 for k in range(5)}, 0x300: 0x1B}
    assert [(u.pid, u.data) for u in s.units] == [(0x200, b"named"), (0x300, b"later")]
    assert (s.broken, s.gaps, s.other) == (0, 0, 2)
    assert s.payload() == b"named" and s.payload(0x300) == b"later"


def plain_units(media):
    """(position, pts, random access, data) of the one stream of ``mux``, read packet by packet from the layout alone."""
    out = []
    for at in range(376, len(media), 188):
        p = media[at : at + 188]
        skip = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        if p[1] & 0x40:
            h = int.from_bytes(p[skip + 9 : skip + 14], "big")
            pts = (h >> 33 & 7) << 30 | (h >> 17 & 0x7FFF) << 15 | h >> 1 & 0x7FFF
            out.append([at, pts, bool(p[5] & 0x40), b""])
            skip += 14
        out[-1][3] += p[skip:]
    return out


def test_ts_columns_against_a_plain_reader(spark):
    rows = [r for r in odd_rows() if r[0] not in (9,)] + [(None, "null id"), (50, "w" * 120_000)]
    media = mpegts.mux_column(frame(spark, rows))
    got = mpegts.demux_column(media).withColumn("feature", mpegts.feature()).collect()
    by = {(r.doc_id, r.n_bytes): r.media for r in media.collect()}
    for r in got:
        m = bytes(by[r.doc_id, r.n_bytes])
        units = plain_units(m)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        assert [(u.position, u.pts, u.random_access, u.size) for u in r.units] == [(a, p, x, len(d)) for a, p, x, d in units]
        assert r.payload_sha256 == hashlib.sha256(b"".join(d for *_, d in units)).hexdigest()
        assert r.feature == f"programs=1;streams=256:6;units={len(units)};points={sum(x for _, _, x, _ in units)};first=0;last={units[-1][1]};gaps=0;broken=0"


def test_ts_columns(spark):
    rows = odd_rows()
    media = mpegts.mux_column(frame(spark, rows))
    got = mpegts.demux_column(media).collect()
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    units = mpegts.unit_table(media).collect()
    assert sum(u.size for u in units) == sum(r.payload_bytes for r in got)
    assert mpegts.demux_column(mpegts.mux_column(frame(spark, []))).collect() == []


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, digest int")


def warc_want(rows, least=0):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = best[h or ""]
        again = len(b) >= least and top != (-1 if i is None else i)
        out.append((i, len(b), warc.base32(hashlib.sha1(b).digest()), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 3])
def test_warc(spark, least):
    big = "".join(chr(65 + i % 23) for i in range(300_000)) + "é"
    rows = [(1, "u", "a"), (2, None, "a"), (3, "x\r\ny", ""), (4, "u", None), (5, "u", big), (6, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (8, "u", "é" * 40_000), (9, "u", big + "1"), (9, "u", big + "1"), (None, "u", "abc"), (10, "u", "abc"), (None, "u", "only")]
    got = warc.round_trip(pages(spark, rows), least=least).collect()
    assert all(r.intact for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == warc_want(rows, least)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_warc_file_and_damage(spark):
    rows = [(i, f"http://h/{i}", "text " * (i * 9000)) for i in range(5)]
    table = warc.write_table(pages(spark, rows), size=1000).collect()
    table.sort(key=lambda r: (r.record_id, r.chunk_no))
    assert max(len(r.data) for r in table) == 1000
    whole = b"".join(r.data for r in table)
    for step in (1 << 20, 777):
        got = list(warc.read_stream(whole[i : i + step] for i in range(0, len(whole), step)))
        assert [(g[0], g[4], g[6]) for g in got] == [(f"urn:x-page:{i}", len(h), True) for i, _, h in rows]
    damaged = [r if r.chunk_no != 3 else r.__class__(**{**r.asDict(), "data": b"\0" + r.data[1:]}) for r in table]
    got = warc.read_table(spark.createDataFrame(damaged, "record_id string, instance long, chunk_no int, last boolean, data binary, running binary")).collect()
    assert sorted(r.record_id[-1] for r in got if not r.intact) == ["1", "2", "3", "4"]


LOST = {"first": lambda r: r.chunk_no == 0, "middle": lambda r: r.chunk_no == 4, "last": lambda r: r.last, "all but one": lambda r: r.chunk_no != 5}


@pytest.mark.parametrize("kind", LOST)
def test_warc_lost_slices(spark, kind):
    """Whatever is lost of a record, it is one row, and its neighbours are as they were."""
    rows = [(i, f"http://h/{i}", f"text{i} " * 3000) for i in range(5)]
    table = warc.write_table(pages(spark, rows), size=1000).collect()
    for gone in range(5):
        left = [r for r in table if r.record_id != f"urn:x-page:{gone}" or not LOST[kind](r)]
        got = warc.read_table(spark.createDataFrame(left, "record_id string, instance long, chunk_no int, last boolean, data binary, running binary")).collect()
        assert sorted((r.record_id, r.intact) for r in got) == [(f"urn:x-page:{i}", i != gone) for i in range(5)]
        assert all(r.payload_digest == warc.base32(hashlib.sha1(rows[int(r.record_id[-1])][2].encode()).digest()) for r in got if r.intact)


def test_warc_slices_twice(spark):
    table = warc.write_table(pages(spark, [(1, "u", "a" * 5000), (2, "u", "b")]), size=1000).collect()
    twice = table + [r for r in table if r.record_id.endswith("1") and r.chunk_no == 2]
    got = warc.read_table(spark.createDataFrame(twice, "record_id string, instance long, chunk_no int, last boolean, data binary, running binary")).collect()
    assert sorted((r.record_id[-1], r.payload_bytes, r.intact) for r in got) == [("1", 5000, False), ("2", 1, True)]


def test_packing_slots_are_bounded():
    """The broadcast table: every length present, whatever the numbers of pieces."""
    rng = random.Random(4)
    for longest in (64, 512):
        sizes = tuple(longest // k for k in (8, 4, 2, 1))
        for scale in (1, 10, 10**6, 10**12):
            histogram = {n: rng.randrange(1, scale + 1) for n in range(1, longest + 1)}
            kinds = packing.plan(histogram, sizes)
            assert sum(len(k.items) for _, k in kinds) <= packing.most_slots(longest)


def test_packing_groups(spark, monkeypatch):
    """A length of many groups gets every slot once."""
    monkeypatch.setattr(packing, "GROUP", 7)
    got = packing.pack(frame(spark, [(i, "w " * (i % 3)) for i in range(300)] + [(None, "x"), (None, "x")]), sizes=(2, 5, 8)).collect()
    check_bins(got, (2, 5, 8))
    assert len(got) == 302


def check_bins(rows, sizes):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in b:
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_size for r in b} == {min(s for s in sizes if s >= at)}
    assert sorted(bins) == list(range(len(bins)))
    return bins


def test_packing(spark):
    rng = random.Random(2)
    rows = odd_rows() + [(100 + i, " ".join(["w"] * rng.choice([0, 1, 5, 99, 100, 299, 600, 2500]))) for i in range(400)]
    sizes = (128, 300, 1000)
    got = packing.pack(frame(spark, rows), sizes=sizes).collect()
    bins = check_bins(got, sizes)
    words = {}
    for r in got:
        words.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in rows:
        n = len((t or "").encode().split()) + 1
        copies = sum(1 for j, _ in rows if j == i)
        assert sorted(words[i]) == sorted([(s, min(1000, n - s)) for s in range(0, n, 1000)] * copies)
    alone = []  # bins of the longest size by first-fit decreasing
    for n in sorted((r.length for r in got), reverse=True):
        i = next((i for i, x in enumerate(alone) if x + n <= 1000), None)
        alone = alone + [n] if i is None else alone[:i] + [alone[i] + n] + alone[i + 1 :]
    assert sum(b[0].bin_size + 16 for b in bins.values()) <= 1016 * len(alone)
    assert packing.pack(frame(spark, [])).collect() == []


def test_plan_against_piecewise_best_fit():
    """Multiplicities only save work: placing pieces one at a time by the same rule costs as much."""
    rng = random.Random(3)
    for _ in range(30):
        sizes = tuple(sorted(rng.sample(range(20, 200), 3)))
        histogram = {}
        for _ in range(300):
            n = rng.randrange(1, sizes[-1] + 1)
            histogram[n] = histogram.get(n, 0) + rng.choice([1, 1, 7])
        best = None
        for room in packing.ROOM:
            bins = []
            for n in sorted(histogram, reverse=True):
                for _ in range(histogram[n]):
                    fit = [b for b in bins if b[0] >= n]
                    if fit:
                        b = min(fit, key=lambda b: b[0])
                    else:
                        s = min([s for s in sizes if s >= n * room] or [sizes[-1]], key=lambda s: ((s + 16) / (s // n * n), s))
                        bins.append(b := [s, 0])
                    b[0] -= n
                    b[1] += n
            cost = sum(min(s for s in sizes if s >= b[1]) + 16 for b in bins)
            best = cost if best is None else min(best, cost)
        mine = packing.plan(histogram, sizes)
        placed = {}
        for s, k in mine:
            assert k.fill <= s
            for n, each in k.items:
                placed[n] = placed.get(n, 0) + each * k.bins
        assert placed == histogram
        assert sum((s + 16) * k.bins for s, k in mine) <= 1.03 * best
