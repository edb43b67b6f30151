"""Batch parsers over a stream of files."""

import struct

from rastrel.sources.containers import written_tiff
from rastrel.streaming.arrivals import arriving_entries


def test_arriving_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.tif").write_bytes(written_tiff([[(256, 3, 1, struct.pack("<H", i))]]))
    (folder / "no.txt").write_text("no")
    q = arriving_entries(spark, str(folder), "*.tif").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(bytes(r.value)[0] for r in spark.sql("SELECT value FROM arrived").collect()) == [0, 1, 2]
