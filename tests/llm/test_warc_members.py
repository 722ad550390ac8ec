"""An archive gzipped per record, as WARC files commonly are."""

from __future__ import annotations

import gzip
import re
from pathlib import Path

from quietcount.llm import warc


def test_archive_gzipped_per_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(20)], "page_id long, url string, html string")
    folder = warc.new_path(spark, "warc")
    warc.write_archive(pages.coalesce(1), folder)
    for n, file in enumerate(Path(folder).rglob("*.gz")):
        records = re.split(rb"(?=WARC/1\.)", gzip.decompress(file.read_bytes()))
        (tmp_path / f"{n}.gz").write_bytes(b"".join(gzip.compress(r) for r in records if r))
    got = warc.read_archive(spark, str(tmp_path), with_payload=True).collect()
    assert sorted(r.page_id for r in got) == list(range(20))
