"""Archives whose last payload ends in the line ends that also separate records."""

import hashlib

import pytest

from tenderlens.llm import warc


@pytest.mark.parametrize("chunk", [4, 1 << 18])
@pytest.mark.parametrize("end", ["\r\n", "\r\n" * 2, "\r\n" * 3, "\r\n" * 5, "\r", "\n", "\r\n\r"])
def test_last_payload_ends_in_line_ends(spark, monkeypatch, chunk, end):
    monkeypatch.setattr(warc, "CHUNK_CHARS", chunk)
    source = "<html></html>" + end
    pages = spark.createDataFrame([(1, "http://a/", source)],
                                  "page_id long, url string, html string")
    (row,) = warc.round_trip(pages).collect()
    assert (row.payload_bytes, row.payload_digest) == \
        (len(source), hashlib.sha1(source.encode()).hexdigest())


def test_many_files_read_by_one_task(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>\r\n") for i in range(40)],
                                  "page_id long, url string, html string").repartition(20)
    assert sorted(r.page_id for r in warc.round_trip(pages).collect()) == list(range(40))
