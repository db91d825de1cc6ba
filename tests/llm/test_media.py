import hashlib
import zlib
from pathlib import Path

from quillspark.llm.media import ArchiveReader, register, samples, text_media, wav
from quillspark.scratch import Scratch


def expected(text):
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 if raw else 192)
    media = wav(payload)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()


COLUMNS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


def test_round_trip(spark, data, edge, nothing):
    for docs in (edge, spark.read.parquet(f"{data()}/documents.parquet")):
        want = sorted((repr(r["doc_id"]), *expected(r["text"])) for r in docs.select("doc_id", "text").collect())
        rows = text_media(docs).collect()
        assert sorted((repr(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in rows) == want
        assert all(r["error"] is None and r["feature"] for r in rows)
    assert text_media(nothing).count() == 0


def test_wav_is_lossless():
    payload = bytes(range(192))
    assert samples(wav(payload)) == payload and len(wav(payload)) == 44 + 192


def archive(spark, rows, **options):
    register(spark)
    path = Scratch(spark, "archive").path("a")
    df = spark.createDataFrame([(i, "n", bytearray(m), "bin") for i, m in rows], "id long, note string, media binary, extension string").coalesce(1)
    df.write.format("media_archive").option("path", path).mode("append").save()
    return path, spark.read.format("media_archive").option("path", path).options(**options).load()


def test_ranges_read_each_member_once(spark):
    rows = [(i, bytes([i % 256]) * (i * 37)) for i in range(300)]
    path, df = archive(spark, rows, rangeBytes=2000)
    assert len(ArchiveReader(path, 2000, 3).partitions()) > 3
    assert sorted((r["id"], bytes(r["media"])) for r in df.collect()) == rows


def test_a_broken_member_is_alone(spark):
    rows = [(i, hashlib.sha256(str(i).encode()).digest() * 20) for i in range(30)]
    path, df = archive(spark, rows)
    target = sorted((r["offset"], r["id"]) for r in df.collect())[11]
    file = next(Path(path.removeprefix("file://")).glob("*.zip"))
    raw = bytearray(file.read_bytes())
    raw[target[0] + 40 : target[0] + 50] = b"x" * 10
    file.write_bytes(raw)
    got = {r["id"]: r for r in df.collect()}
    assert got[target[1]]["media"] is None and got[target[1]]["attempts"] == 3 and got[target[1]]["error"]
    assert all(bytes(got[i]["media"]) == m for i, m in rows if i != target[1])


def test_a_passing_failure_is_retried(spark, monkeypatch):
    path, _ = archive(spark, [(i, bytes(50 + i)) for i in range(5)])
    from quillspark.llm import media

    real, failed = media.member, set()

    def flaky(store, p, info, ahead=b""):
        if info.header_offset not in failed:
            failed.add(info.header_offset)
            raise OSError("lost")
        return real(store, p, info, ahead)

    monkeypatch.setattr(media, "member", flaky)
    reader = ArchiveReader(path, 1 << 20, 3)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 5 and all(r["attempts"] == 2 and r["error"] is None for r in rows)


def test_lost_tasks_leave_nothing(spark):
    """What attempts that don't commit have written goes with the job's folder; archives of other jobs stay."""
    from quillspark.llm.media import ArchiveWriter, Written

    path, df = archive(spark, [(1, b"one")])
    writer = ArchiveWriter(path)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([2]), pa.array(["n"]), pa.array([b"two"]), pa.array(["bin"])], ["id", "note", "media", "extension"])
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    other = ArchiveWriter(path).write(iter([batch]))
    writer.commit([done, None])
    left = [p for p in Path(path.removeprefix("file://")).rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    assert sorted(p.suffix for p in left) == [".part", ".zip", ".zip"] and lost.archives != done.archives
    assert [p.stem for p in left if p.suffix == ".part"] == other.archives
    assert sorted(r["id"] for r in df.sparkSession.read.format("media_archive").option("path", path).load().collect()) == [1, 2]
    ArchiveWriter(path).abort([Written(["x"])])
