import base64
import hashlib
import io

from sedimenta.llm import warc

ROWS = [(1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "é" * 300_000), (6, "http://e", "a\r\n\r\nb"), (6, "http://e", "a\r\n\r\nb"), (7, "http://f", "a\r\n\r\nb"), (None, "http://g", "<p>same</p>"), (None, "http://h", "only without id")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string")


def want(rows, least):
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    first, seen, out = {}, set(), []
    for page, p in payloads:
        if page is not None and len(p) >= least:
            first[p] = min(first.get(p, page), page)
    n = {p: sum(x == p for _, x in payloads) for _, p in payloads}
    for page, p in payloads:
        digest, owner = base64.b32encode(hashlib.sha1(p).digest()).decode(), first.get(p)
        again = owner is not None and n[p] > 1 and (page != owner or (page, p) in seen)
        seen.add((page, p))
        out.append((page, len(p), digest, "revisit" if again else "response", owner if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    for least in (0, 10):
        folder = f"file://{tmp_path}/warc{least}"
        index = warc.write_warc(pages(spark), folder, least)
        assert sorted([tuple(r) for r in warc.read_warc(index, folder).collect()], key=str) == want(ROWS, least)
        assert index.select("record_id").distinct().count() == len(ROWS)


def test_one_record_by_its_id(spark, tmp_path):
    folder = f"file://{tmp_path}/one"
    for r in warc.write_warc(pages(spark), folder).collect():
        with open(f"{tmp_path}/one/{r.file}", "rb") as f:
            reader = warc.BundleReader(Sized(f.read()))
            raw = reader.record(r.record_id)
        assert len(raw) == r.length and raw == reader.frame(r.frame)[r.offset : r.offset + r.length]
        fields, _, _ = warc.parse_record(raw)
        assert fields["WARC-Record-ID"] == r.record_id and "X" not in fields


class Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_frames_stand_alone(spark):
    import zstandard

    out = io.BytesIO()
    bundle = warc.BundleWriter(out)
    for i in range(50):
        bundle.add(f"id{i}", bytes([i]) * 20_000)
    bundle.close()
    reader = warc.BundleReader(Sized(out.getvalue()))
    assert len(reader.index) == 50 and len(set(x[1] for x in reader.index)) > 2
    assert [raw for _, raw in reader.records()] == [bytes([i]) * 20_000 for i in range(50)]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(bytes([i]) * 20_000 for i in range(50))


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert warc.read_warc(warc.write_warc(pages(spark).where("false"), folder), folder).count() == 0
