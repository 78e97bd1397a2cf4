"""Archives and their index by exact round trips; neighbour search against brute force."""

import gzip
import hashlib
import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnloom.llm import multiindex, warc

PAGES = "page_id long, url string, html string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        to = first.get(html or "")
        to = None if to is None or page_id == to else to
        out.append((page_id, len((html or "").encode()), digest(html), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip_of_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert found(warc.round_trip(pages)) == expected(rows)


ODD = [
    (1, "http://b.example.com/x?q=1 2#top", "<p>é</p>"),
    (2, "http://a.example.com/", "<p>é</p>"),
    (3, None, None),
    (4, "", ""),
    (5, "not a url\nwith a line feed\t%41 é", "x" * 300_000),
    (6, "http://a.example.com/", "other\r\n\r\nWARC/1.1\r\n"),
    (6, "http://a.example.com/", "other\r\n\r\nWARC/1.1\r\n"),
    (None, "http://a.example.com/", "<p>é</p>"),
    (None, None, "only a null id has this"),
]


def test_odd_pages(spark):
    pages = spark.createDataFrame(ODD, PAGES).withColumn("digest", F.lit(1)).withColumn("file", F.lit("f"))
    result = warc.round_trip(pages)
    assert result.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert found(result) == expected(ODD)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_are_gzip_members_and_ranges_hit_records(spark, tmp_path):
    pages = spark.createDataFrame(ODD, PAGES)
    manifest = warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=400)
    files = manifest.collect()
    assert sum(r.records for r in files) == len(ODD)
    for r in files:
        data = (tmp_path / "w" / r.file).read_bytes()
        assert len(data) == r.bytes and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    captures = warc.read_captures(manifest, str(tmp_path / "w"))
    index = warc.build_index(captures, block_lines=2)
    assert index.count() >= len(ODD) // 2
    wanted = spark.createDataFrame([("http://a.example.com/",), ("http://none.example.com/",)], "url string")
    records = warc.read_records(warc.locate(index, wanted), str(tmp_path / "w")).collect()
    assert sorted(r.record_id for r in records) == ["", "2", "6", "6"]
    assert {bytes(r.payload) for r in records if r.record_id == "6"} == {ODD[5][2].encode()}


def test_lookups_in_slices_of_the_directory(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 50}", f"page {i}") for i in range(200)]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    index = warc.build_index(warc.read_captures(manifest, str(tmp_path / "w")), block_lines=3)
    monkeypatch.setattr(warc, "DIRECTORY_SLICE", 10)
    monkeypatch.setattr(warc, "KEYS_A_ROW", 2)
    urls = spark.createDataFrame([(r[1],) for r in rows[::3]], "url string")
    got = warc.read_records(warc.locate(index, urls), str(tmp_path / "w")).collect()
    wanted = {r[1] for r in rows[::3]}
    assert sorted(int(r.record_id) for r in got) == [r[0] for r in rows if r[1] in wanted]


def test_keys_put_sites_together():
    assert warc.url_key("https://user@WWW.Example.com:443/a?b#c") == "com,example,www)/a?b"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("plain") == "plain"


def brute(vectors, queries, k):
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        scores = (matrix * np.array(vectors[q], np.float64)).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


def test_recall_against_brute_force(embeddings):
    got = results(multiindex.nearest_neighbours(embeddings, embeddings.where("vec_id % 20 = 0")))
    vectors = {r.vec_id: r.embedding for r in embeddings.collect()}
    exact = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert got.keys() == exact.keys()
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in exact[q]}) / 20 for q in exact])
    assert recall >= 0.9
    assert all(s == pytest.approx(np.dot(np.float64(vectors[q]), np.float64(vectors[v])), abs=1e-12)
               for q in got for v, s in got[q])


def test_whole_share_is_exact_with_ties_and_split_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(multiindex, "BLOCK_ROWS", 16)
    vectors = {i: [float(x) for x in rng.integers(-2, 3, 6)] for i in range(150)}
    vectors |= {i: [1.0, 1.0, 0.0, 2.0, 1.0, 1.0] for i in range(150, 260)}
    vectors = {i: v for i, v in vectors.items() if any(v)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 20 = 0")
    got = results(multiindex.nearest_neighbours(rows, asked, k=7, share=1.0, centroids=8))
    assert got == brute(vectors, [i for i in vectors if i % 20 == 0], 7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 5), (20, [2.0, 1.0], 5), (1, [1.0, 1.0], 5), (1, [1.0, 1.0], 5), (2, None, 5),
        (3, [0.0, 0.0], 5), (4, [1.0, None], 5), (5, [nan, 1.0], 5), (6, [inf, 1.0], 5), (None, [9.0, 9.0], 5),
        (40, [0.0, 0.0], 5), (7, [1.0, 2.0, 3.0], 5), (8, [], 5),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = results(multiindex.nearest_neighbours(df, df.where("vec_id % 20 = 0")))
    assert got == {0: [(20, 4.0), (1, 3.0)], 20: [(0, 4.0), (1, 3.0)]}
    none = df.where("vec_id = 99")
    assert multiindex.nearest_neighbours(none, none).count() == 0
    assert multiindex.nearest_neighbours(df, none).count() == 0


def test_heap_visits_cells_in_order():
    rng = np.random.default_rng(4)
    first, second = rng.normal(size=8), rng.normal(size=8)
    counts = rng.integers(0, 4, (8, 8))
    total = first[:, None] + second[None, :]
    order = sorted(np.ndindex(8, 8), key=lambda c: -total[c])
    for wanted in (1, 10, 40, int(counts.sum())):
        cells, held = set(), 0
        for c in order:
            if held >= wanted:
                break
            if counts[c]:
                cells.add(c)
                held += counts[c]
        got = multiindex.visited(first, second, counts, wanted)
        assert {(f, s) for f, bits in got.items() for s in range(8) if bits >> s & 1} == cells
