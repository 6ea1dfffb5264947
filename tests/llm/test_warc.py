"""op4: round trips through bundles, by the index and by a plain Zstandard reader."""

import hashlib
import io
import random
from collections import Counter
from pathlib import Path

import zstandard
from pyspark.sql import functions as F

from tidemark.llm.warc import parted, read, write

BIG = "<p>é</p>" * 200


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a", BIG), (2, None, BIG), (3, "http://c%0A\r\nX: y", BIG), (4, "d", "small"), (5, "e", "small"), (6, "f", None), (7, "g", ""), (None, "h", BIG), (None, "i", "lone" * 400), (None, "i", "lone" * 400), (9, "j", "x" * 700_000), (10, "k", "again" * 300), (10, "k", "again" * 300)]
    rows += [(100 + i, "hot", "hot" * 500) for i in range(40)]
    noise = random.Random(1)
    rows += [(1000 + i, "noise", noise.randbytes(1500).hex()) for i in range(200)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, length int, digest string").repartition(3)
    folder = f"file://{tmp_path}"
    index = write(pages, folder, frame_bytes=5000, bundle_bytes=20_000)
    got = read(index, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        group = [i for i, _, t in rows if hashlib.sha1((t or "").encode()).hexdigest() == r.payload_digest]
        newest = max((i for i in group if i is not None), default=None)
        revisit = r.payload_bytes >= 1000 and r.page_id != newest
        assert (r.record_type, r.refers_to) == (("revisit", newest) if revisit else ("response", None))
        payload = next((t or "").encode() for i, u, t in rows if i == r.page_id and (u or "") == r.url)
        assert r.payload_bytes == len(payload) and bytes(r.payload) == (b"" if revisit else payload)
    records = index.collect()
    names = {r.bundle for r in records}
    assert len({r.record_id for r in records}) == len(rows)
    frames = Counter((r.bundle, r.frame) for r in records)
    assert len(names) > 3 and len(frames) > len(names)  # noise doesn't shrink: bundles are closed by size, with several frames each
    assert all(Path(tmp_path, n).stat().st_size < 20_000 + 2 * 5000 + 1_000_000 * any(r.page_id == 9 for r in records if r.bundle == n) for n in names)
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO((Path(tmp_path) / n).read_bytes()), read_across_frames=True).read() for n in sorted(names))
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    one = index.where("page_id = 9")
    assert [len(r.payload) for r in read(one, folder).collect()] == [700_000]
    assert write(pages.limit(0), folder).count() == 0


def test_unique_payloads_stay_where_they_are(spark):
    """Shuffled are copies and what the filter can't tell from them; a filter of one word loses no copy."""
    digests = [f"one{i}" for i in range(3000)] + [f"some{i % 2000}" for i in range(8000)] + ["hot"] * 50
    hashed = spark.createDataFrame(list(enumerate([*digests, None, None])), "page_id long, whole string")
    groups = hashed.where("whole IS NOT NULL").groupBy("whole").agg(F.max("page_id").alias("newest"), F.lit("u").alias("uri"), F.count("*").alias("n")).where("n > 1")
    for words, most in ((1 << 21, 1000), (1, 3001)):
        at_home, moved = (x.collect() for x in parted(hashed, groups, words))
        assert sorted(r.page_id for r in at_home + moved) == list(range(len(digests) + 2))
        assert {r.page_id for r in moved} >= set(range(3000, 11_000)) and len(moved) - 8000 < most
        assert all(r.whole is None or r.whole.startswith("one") or (r.whole, r.newest, r.uri) == ("hot", 11_049, "u") for r in at_home)
