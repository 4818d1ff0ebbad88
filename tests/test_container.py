import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.codecs import sound
from framelake.operators import catalog, pictures
from framelake.sources import container
from tests.test_codecs import H, W, picture


def rows(n):
    return [("clip", i, picture(1 + i // 3)) for i in range(n)]


@pytest.fixture(scope="module")
def clip(spark, tmp_path_factory):
    container.register(spark)
    source = spark.createDataFrame(rows(14), "path string, frame_no long, picture binary")
    held = str(tmp_path_factory.mktemp("records") / "r")
    pictures.encode(source, W, H, keyint=5).write.parquet(held)
    records = spark.read.parquet(held)
    path = str(tmp_path_factory.mktemp("clips") / "a.clip")
    options = {"width": W, "height": H, "fps_num": 30, "fps_den": 1, "keyint": 5, "quality": 78}
    records.drop("path").write.format("framelake").options(**options).mode("append").save(path)
    return path


def test_written_file_reads_back(spark, clip):
    header = container.read(spark, clip, "header").first()
    assert (header["width"], header["height"], header["frame_count"], header["duration_us"]) == (W, H, 14, 14 * 1_000_000 // 30)
    assert os.listdir(os.path.dirname(clip)) == ["a.clip"]
    index, frames = container.read(spark, clip, "index"), container.read(spark, clip)
    assert catalog.index_mismatch(index, frames, ["path"]).count() == 0
    kinds = [r["frame_type"] for r in frames.orderBy("frame_no").collect()]
    assert kinds == [0, 2, 2, 1, 2, 0, 1, 2, 2, 1, 0, 2, 1, 2]
    offsets = [r["offset"] for r in container.read(spark, clip, "records").orderBy("frame_no").collect()]
    assert offsets == [r["offset"] for r in container.read(spark, clip, "scan").orderBy("frame_no").collect()] and offsets[0] == 96
    some = container.read(spark, clip).where("frame_no >= 6 and frame_no < 9")
    assert [r["frame_no"] for r in some.orderBy("frame_no").collect()] == [6, 7, 8]
    # small parts: each holds whole groups of pictures, and together they are the file
    parts = spark.read.format("framelake").option("part_bytes", 2000).load(clip)
    numbers = [sorted(r["frame_no"] for r in p) for p in parts.rdd.glom().collect()]
    assert len(numbers) > 2 and sorted(n for p in numbers for n in p) == list(range(14)) and [0, 1, 2, 3, 4] in numbers


def test_decoding_and_verification(spark, clip):
    frames, headers = container.read(spark, clip), container.read(spark, clip, "header")
    out = pictures.decode(frames, headers)
    got = {r["frame_no"]: r["picture"] for r in out.collect()}
    for _, n, source in rows(14):
        assert np.abs(np.frombuffer(got[n], np.uint8).astype(int) - np.frombuffer(source, np.uint8)).mean() < 12
    report = pictures.verify(out).first()
    assert (report["frames"], report["bad_frames"]) == (14, 0)
    # one broken record spoils the rest of its group only
    hurt = frames.withColumn("payload", F.when(F.col("frame_no") == 6, F.lit(b"x")).otherwise(F.col("payload")))
    bad = pictures.decode(hurt, headers).where("error is not null").orderBy("frame_no").collect()
    assert [r["frame_no"] for r in bad] == [6, 7, 8, 9] and bad[0]["error"] == "unknown payload mark"
    with pytest.raises(Exception, match="unknown payload mark"):
        pictures.decode(hurt, headers, strict=True).collect()


def test_other_generations(spark):
    source = spark.createDataFrame(rows(7), "path string, frame_no long, picture binary")
    headers = spark.createDataFrame([("clip", W, H)], "path string, width long, height long")
    for codec in (6, 7, 8):
        frames = pictures.encode(source, W, H, codec, keyint=4).withColumn("error", F.lit(None).cast("string"))
        assert pictures.verify(pictures.decode(frames, headers)).first()["bad_frames"] == 0


def test_broken_files(spark, clip, tmp_path):
    data = open(clip, "rb").read()
    (tmp_path / "old").write_bytes(b"GVID" + data[4:])
    (tmp_path / "cut").write_bytes(data[: len(data) - 40])
    (tmp_path / "empty").write_bytes(b"")
    got = {os.path.basename(r["path"]): r["error"] for r in container.read(spark, str(tmp_path), "index", "permissive").where("error is not null").collect()}
    assert "retired" in got["old"] and "index" in got["cut"] and got["empty"] == "no container"
    with pytest.raises(Exception, match="retired"):
        container.read(spark, str(tmp_path / "old"), "header").collect()
    # repair: records up to the fault, found without the index
    third = container.read(spark, clip, "records").where("frame_no = 3").first()["offset"]
    (tmp_path / "mid").write_bytes(data[:third] + b"JUNK" + data[third + 4 :])
    scan = container.read(spark, str(tmp_path / "mid"), "scan").orderBy("frame_no").collect()
    assert [r["frame_no"] for r in scan] == [0, 1, 2]
    again = catalog.repaired(container.read(spark, str(tmp_path / "mid"), "scan"), ["path"], F.col("frame_no") >= 0).orderBy("frame_no").collect()
    assert [r["record_offset"] for r in again] == [r["offset"] for r in scan]


def test_raw_stream(spark, clip, tmp_path):
    frames = container.read(spark, clip).orderBy("frame_no").collect()
    out = container.STREAM_HEAD.pack(b"GHS9", 9, W, H, W * H * 3 // 2)
    for r in frames:
        out += container.STREAM_RECORD.pack(r["frame_type"], 0, 0, 0, r["raw_size"], len(r["payload"]), r["crc32"]) + r["payload"]
    (tmp_path / "raw").write_bytes(out)
    got = container.read(spark, str(tmp_path / "raw"), "stream").orderBy("frame_no").collect()
    assert [(r["frame_no"], r["pts_us"], r["payload"]) for r in got] == [(r["frame_no"], r["pts_us"], r["payload"]) for r in frames]
    (tmp_path / "cut").write_bytes(out[:-3])
    assert container.read(spark, str(tmp_path / "cut"), "stream", "permissive").where("error is not null").count() == 1


def test_audio_file():
    pcm = (8000 * np.sin(np.arange(500) / 8)).astype(np.int16)[:, None]
    data = container.pack_audio_file(sound.encode_blocks(pcm), 48000, 1, 8, 500)
    h = container.parse_audio_header(data)
    assert (h["rate"], h["frames"], h["blocks"]) == (48000, 500, 16)
    assert np.abs(sound.decode_blocks(data[64:], 500, 1).astype(int) - pcm).max() < 200
    for bad in (data[:50], b"XXXX" + data[4:]):
        with pytest.raises(container.Malformed):
            container.parse_audio_header(bad)


def test_streams_equal_batches(spark, tmp_path):
    from framelake.streaming import telemetry as S

    os.makedirs(tmp_path / "in")
    samples = [{"stream": s, "wall_us": i * 250_000 + (2_000_000 if i > 20 else 0), "audio_us": i * 250_000, "drift_us": i * 1000, "queue_depth": 0 if 5 <= i < 8 else 3, "dropped": i % 2} for s in (1, 2) for i in range(60)]
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(x) for x in samples if k * 20 <= x["wall_us"] // 250_000 % 1000 < k * 20 + 20 or (k == 2 and x["wall_us"] // 250_000 >= 60)))
    stream, batch = S.read_samples(spark, str(tmp_path / "in"), 1), spark.read.schema(S.SAMPLE).json(str(tmp_path / "in"))
    S.run_once(S.latched_events(stream), str(tmp_path / "events"), str(tmp_path / "c1"))
    got = sorted((r["stream"], r["kind"], r["length_us"]) for r in spark.read.parquet(str(tmp_path / "events")).collect())
    assert got == [(s, k, n) for s in (1, 2) for k, n in (("freeze", 2_250_000), ("underrun", 0))]
    S.run_once(S.windowed(stream, delay="0 seconds"), str(tmp_path / "w"), str(tmp_path / "c2"))
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert closed and closed <= {tuple(r) for r in S.windowed(batch).collect()}
    assert S.sessions(batch, "1 second").count() == 4 and S.on_time(batch).count() == 84
