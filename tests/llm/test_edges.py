"""Broken media, odd records, pages whose asides have many names or whose articles repeat a text, rows that share an id."""

import json
import struct

import numpy as np
from pyspark.sql import functions as F

from fathom.llm import chat, html, media, sharding


def test_images_that_promise_more_than_they_hold(spark):
    huge = bytearray(media.encode_bmp(np.full((2, 2), 9, np.uint8)))
    huge[18:26] = struct.pack("<ii", 2**31 - 1, 2**31 - 1)
    broken = [b"P2 1 1 255\n300", b"P2 1 1 255\n-1", b"P3 1 1 255\n1 2 999999999999999999999", b"P5 99999999999 99999999999 255\n\x00", b"P1 99999 99999\n1", b"P6 2 2 65535\n\x00", bytes(huge)]
    good = media.encode_pgm(np.full((2, 3), 7, np.uint8))
    got = media.payload_digests(media.tiles(spark.createDataFrame([(k, x) for k, x in enumerate([*broken, good])], "k int, media binary"))).orderBy("k").collect()
    assert [r.tile is None and r.dhash is None and r.payload_sha256 is None for r in got] == [True] * len(broken) + [False]


def test_records_with_halves_of_pairs_and_odd_keys(spark):
    rows = [
        '{"messages": [{"role": "user", "content": "a\\ud800b"}]}',
        '{"messages": [{"role": "us\\udc00er", "content": "ab"}]}',
        '{"a\\ud800": 1}',
        json.dumps({"messages[].role": "user", "messages[].content": "x"}),
        json.dumps({"messages[]": {"role": "user", "content": "x"}}),
        json.dumps({"messages": [{"role": "user", "content": "\U0001f642"}]}),
    ]
    d = spark.createDataFrame([(k, 0, x) for k, x in enumerate(rows)], "conv_id long, turn long, record string")
    got = {r.conv_id: r.formatted for r in chat.format_records(d, "conv_id", "turn", "record").collect()}
    assert [got[k] for k in range(5)] == [None] * 5 and got[5] == "<|im_start|>user\n\U0001f642<|im_end|>\n"
    assert chat.paths({"a.b": {"c[]": 1}}) != chat.paths({"a": {"b": {"c": [1]}}})


def page(k, aside='class="a b c d sidebar"', quote="Always the same words of a quote."):
    words = " ".join(f"word{(k * 7 + i) % 90}" for i in range(60))
    return f"<html><body><div class='top'>Home About</div><article><h1>Title {k}</h1><p>{words}</p><blockquote>{quote}</blockquote><p>More {words}</p></article><div {aside}>Buy this now</div></body></html>"


def test_asides_with_many_names_go(spark):
    d = spark.createDataFrame([(k, f"http://h/{k}", page(k)) for k in range(6)], "page_id long, url string, html string")
    for r in html.extract(d).collect():
        assert "Buy" not in r.text and "Home" not in r.text and r.text.startswith(f"Title {r.page_id}\n")
    assert html._names('class="a b c d sidebar" id="e"') == ["a", "b", "c", "sidebar"] and html._names('class="b a"') == ["a", "b"]


def test_a_repeated_text_inside_of_articles_stays(spark):
    """The same quote on every page of a host, with the article marked as such and without."""
    plain = lambda k: page(k).replace("article>", "div>")
    for make in (page, plain):
        d = spark.createDataFrame([(k, f"http://h/{k}", make(k)) for k in range(6)], "page_id long, url string, html string")
        for r in html.extract(d).collect():
            assert r.text.split("\n")[2] == "Always the same words of a quote." and "Home" not in r.text


def test_rows_of_one_id_are_spread(spark):
    """A group over a shard's share whose rows agree in id and text."""
    rows = [(7, "same text")] * 1000 + [(k, f"other {k}") for k in range(200)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("last")).collect()
    sizes = [r.n for r in got]
    assert len(got) == 4 and max(sizes) < 1.1 * min(sizes) and sum(r["rows"] for r in got) == 1200 and all(r["last"] == r["rows"] - 1 for r in got)
