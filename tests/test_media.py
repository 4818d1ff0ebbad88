import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.codecs import sound
from framelake.operators import media, pictures
from framelake.sources import container
from tests.test_codecs import H, W, picture
from tests.test_container import clip, rows  # noqa: F401


def test_info_and_structure(spark, clip, tmp_path):  # noqa: F811
    row = media.info(spark, clip).first()
    assert (row["frames"], row["key_frames"], row["p_frames"], row["repeats"], row["fps"]) == (14, 3, 4, 7, 30.0)
    assert media.structure_faults(spark, clip).count() == 0
    data = bytearray(open(clip, "rb").read())
    data[container.HEADER.size] ^= 1  # the first record's mark
    (tmp_path / "bad").write_bytes(data)
    faults = media.structure_faults(spark, str(tmp_path / "bad")).collect()
    assert len(faults) == 14 and {r["fault"] for r in faults} == {"no record"}


def test_repair_and_sound(spark, clip, tmp_path):  # noqa: F811
    third = container.read(spark, clip, "records").where("frame_no = 7").first()["offset"]
    data = open(clip, "rb").read()
    (tmp_path / "bad").write_bytes(data[:third] + b"????" + data[third + 4 :])
    fixed = str(tmp_path / "fixed")
    assert media.repair(str(tmp_path / "bad"), fixed) == 7
    assert media.structure_faults(spark, fixed).count() == 0
    out = pictures.decode(container.read(spark, fixed), container.read(spark, fixed, "header"))
    assert pictures.verify(out).first()["bad_frames"] == 0
    pcm = np.zeros((48000, 1), np.int16)
    audio = container.pack_audio_file(sound.encode_blocks(pcm), 48000, 1, 8, 48000)
    both = str(tmp_path / "both")
    media.add_audio(fixed, both, audio)
    row = container.read(spark, both, "audio").first()
    assert bytes(row["payload"]) == audio and row["samples"] == 48000
    assert container.read(spark, both, "header").first()["duration_us"] == 1_000_000 and media.structure_faults(spark, both).count() == 0
    container.write_wav(str(tmp_path / "a.wav"), 48000, pcm)
    assert (tmp_path / "a.wav").stat().st_size == 44 + 96000
    (tmp_path / "none").write_bytes(data[:96])
    with pytest.raises(container.Malformed):
        media.repair(str(tmp_path / "none"), fixed)


def test_raw_pictures_planes_and_similarity(spark, tmp_path):
    (tmp_path / "raw.yuv").write_bytes(b"".join(p for _, _, p in rows(5)))
    raw = media.read_raw(spark, str(tmp_path / "raw.yuv"), W, H)
    assert [bytes(r["picture"]) for r in raw.orderBy("frame_no").collect()] == [p for _, _, p in rows(5)]
    cut = media.planes(raw.withColumn("path", F.lit("x")), W, H)
    assert [len(r["samples"]) for r in cut.where("frame_no = 0").orderBy("plane").collect()] == [W * H, W * H // 4, W * H // 4]
    pairs = spark.createDataFrame([(picture(1), picture(1)), (picture(1), picture(2)), (picture(1), None)], "a binary, b binary")
    same, other, none = (r["ssim"] for r in media.similarity(pairs, "a", "b", W, H).collect())
    assert same == pytest.approx(1) and 0 < other < 0.97 and none is None
    tags = spark.createDataFrame([("0.9-alpha.2",), ("1.0",)], "v string").select(media.version_tag("v").alias("t"))
    assert [r["t"] for r in tags.collect()] == ["0.9a2", "1.0"]
