import os

from packets import PORT

from wirelake.expr import FieldRef
from wirelake.streaming import tail_fields_text, windowed_conversations

REFS = (FieldRef("frame.number", "FT_FRAMENUM"), FieldRef("frame.time_epoch", "FT_ABSOLUTE_TIME"), FieldRef("frame.len", "FT_UINT32"), FieldRef("tcp.stream", "FT_UINT32"), PORT)


def test_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate((["1\x1f0.5\x1f10\x1f0\x1f80", "2\x1f59.0\x1f20\x1f0\x1f"], ["3\x1f61.0\x1f5\x1f0\x1f", "4\x1f400.0\x1f1\x1f1\x1f"], ["5\x1f401.0\x1f1\x1f1\x1f"], ["6\x1f1.0\x1f100\x1f0\x1f"])):
        (tmp_path / "in" / f"{i}.txt").write_text("".join(x + "\n" for x in lines))
        os.utime(tmp_path / "in" / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))  # the order of files is that of their times
    packets = tail_fields_text(spark, str(tmp_path / "in"), REFS, files_per_trigger=1)
    out = windowed_conversations(packets, ["tcp.stream"], "frame.number", "frame.time_epoch", "frame.len", "1 minute", "1 minute")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    rows = [tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()]
    # the packet that came late, after the watermark, isn't counted; the last window is still open
    assert rows == [(0, 1, 2, 2, 30), (0, 3, 3, 1, 5)]
