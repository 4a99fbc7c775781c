import base64
import hashlib

from cladeframe.llm import warc
from cladeframe.llm.common import new_path

SCHEMA = "page_id long, url string, html string, kind int, digest string"
FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        first = min(same) if same else None
        again = first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip_rejects_magic_inside(spark):
    rows = [(k, f"http://x/{k}", f"<p>{k % 7}</p>" * k) for k in range(40)]
    rows += [(50, "a\r\nWARC/1.0\r\nb", "x" + FAKE), (51, None, None), (52, "", ""), (53, "u", FAKE * 3), (54, "u", "WARC/1.0\r\n"), (55, "ü", "é漢" * 60_000), (None, "n", "only"), (56, "r", "rr"), (56, "r", "rr"), (57, "v", "tail\r\n\r\nWARC/1.0\r\n\r\n"), (58, "w", FAKE * 3)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # records across splits
    try:
        path = new_path(spark, "warc")
        got = warc.round_trip(pages, path)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
        assert warc.broken(spark, path).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_and_broken(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(empty, new_path(spark, "warc")).count() == 0
    path = new_path(spark, "warc")
    spark.createDataFrame([(FAKE[:-4],), (FAKE.replace("h: 5", "h: 50")[:-4],)], "v string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    assert warc.broken(spark, path).count() == 1
