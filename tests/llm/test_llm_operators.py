"""The operators against brute force, on small tables with nulls, empty texts, ties, repeats and extra columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm.stage import text_key
from fathom.llm import chat, hmm, html, media, mixing, neardup, packing, quality, sharding, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, _text binary"


def words_of(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    return [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in r.integers(0, vocabulary, n)]


def base_texts():
    texts = [" ".join(words_of(s, 40 + 9 * s)) for s in range(30)]
    passage = " ".join(words_of(99, 70))
    texts += [texts[3], texts[3], texts[4].replace(" ", "\n", 3)]
    near = texts[20].split()
    near[100] = "changed"
    texts += [" ".join(near), f"{texts[5]} {passage} end", f"start {passage} {texts[6]}", f"{passage} {passage}"]
    return [*texts, None, "", " \n\t", "one", "Aé 🙂 <|im_end|> x", "ab " * 400, "z" * 5000, " ".join(words_of(7, 6000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a", "é"][i % 4], len(t or ""), "x", "y", None) for i, t in enumerate(base_texts())]
    rows += [rows[1], (None, "a null id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix_meets_targets(docs, empty):
    rows = mixing.mix(docs, rows_per_range=4).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0
    total = sum(r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert abs(sum(g[0].target for g in by.values()) - total) < 1e-6
    for g in by.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= 0.5
        assert all(r.taken <= 3 * r["size"] and r.source_size == sum(x["size"] for x in g) for r in g)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, rows_per_range=1000).collect()))


def test_mixed_rows_hold_the_words_taken(docs):
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    got = collections.Counter()
    for r in mixing.mixed_rows(docs).collect():
        got[r.source] += len(WORD.findall(r.text))
    assert +got == +want


def test_shards_are_near_equal_and_slots_gapless(docs, empty):
    rows = sharding.assign_shards(docs, 4).collect()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)  # one text can't be split, and its shard takes short ones for the rows' sake
    assert max(size.values()) <= max(1.1 * largest, 1.6 * sum(size.values()) / 4)
    shard = collections.defaultdict(set)
    for r in rows:
        shard[r.text or ""].add(r.shard)
    assert all(len(s) == 1 for s in shard.values()) and sharding.assign_shards(empty, 4).count() == 0


def test_a_group_over_a_shard_is_split(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "same text here").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = [r["count"] for r in sharding.assign_shards(d, 4).groupBy("shard").count().collect()]
    assert len(rows) == 4 and max(rows) <= 130


def test_packing_is_sound_and_tight():
    r = np.random.default_rng(5)
    lengths = np.minimum(2048, 1 + r.exponential(600, 3000).astype(int))
    runs = packing.plan(collections.Counter(lengths.tolist()))
    got = collections.Counter()
    for own, n in runs:
        assert sum(own) <= 2048
        for x in own:
            got[x] += n
    assert got == collections.Counter(lengths.tolist())
    assert sum(n for _, n in runs) <= math.ceil(lengths.sum() / 2048) * 1.01 + 1


def test_pieces_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    cut = packing.pieces(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    rows = packing.pack(cut).collect()
    whole = collections.defaultdict(dict)
    places = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 2048
        whole[r.doc_id][r.start] = ids
        places[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(base_texts()):
        got = np.concatenate([whole[i][s] for s in sorted(whole[i])]).tolist()
        assert got == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_word_cache_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    plain, cached = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer())
    rnd = random.Random(3)
    odd = [*range(0x400), *range(0x2000, 0x2070), 0x20AC, 0x2122, 0x4E00, 0x1F600]
    fuzz = ["".join(chr(rnd.choice(odd)) for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    assert [b for t in fuzz for b in cached(t)] == [b for t in cached.batch(fuzz) for b in t]
    for text in [*fuzz, "a\x1cb !\x1f! \u0130, \u0391\u03a3 \u03a3", "long word " * 150_000, "It's ABC-12 don't!!", "a b c é É ﬁ İI", "<|endoftext|> x<|startoftext|>'s", "漢字 3.14 ###$$$ é***", "'ve'll x's'", ""]:
        assert np.frombuffer(cached(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_words_that_recur_are_encoded_once(monkeypatch):
    """Common words outlive a full cache, long ones aren't kept, and the ids stay those of the tokenizer."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_WORDS", 400)
    monkeypatch.setattr(packing, "_PART", 300)
    plain, cached = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer())
    asked, encode = collections.Counter(), cached._encode
    monkeypatch.setattr(cached, "_encode", lambda words: asked.update(words) or encode(words))
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["".join(letters[n // 26**k % 26] for k in range(4)) + "q" for n in range(3000)]
    texts = []
    for n in range(0, 3000, 20):
        own = [w + ("" if k % 3 else "!?,.é'S"[k % 7]) for k, w in enumerate(rare[n : n + 20])]
        texts.append(" \t\n\r\x0b\x0c\xa0\x85\u2003"[n // 20 % 9].join(["The", *own, "COMMON,", "word" * 30, "e\u0301t\u00e9", "\u0301x", "\u039f\u03a3"]))
    for text in texts:
        assert np.frombuffer(cached(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert {w: asked[w] for w in ("the", "common", ",", "ét\u00e9", "\u03bf\u03c3")} == dict.fromkeys(("the", "common", ",", "ét\u00e9", "\u03bf\u03c3"), 1)
    assert len(cached.known) <= 500 and "word" * 30 not in cached.known
    assert cached.batch([" ", "", "\n\n"]) == [b""] * 3


def test_counts_of_the_quality_rules():
    texts = [t or "" for t in base_texts()] + ["a b\na b\n\n\na b", "x # $ |", "p q r s t u v w x p q r s t u v w y"]
    got = quality.rule_counts([t.encode() for t in texts])
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {j for k in range(len(words) - 7) if count[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[c][i]) for c in quality.COUNTS) == want, text[:40]


def test_the_classifier_learns_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) > 0
    model = quality.train(docs, labels.where(learn))
    rows = quality.judge(docs, model).join(labels.where(~learn), "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows) > 10


def test_quality_of_odd_rows(docs, empty, spark):
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality.judge(docs, model).collect()
    assert len(rows) == docs.count() and all(r.kept != r.base_failed for r in rows)
    assert quality.judge(empty, model).count() == 0


@pytest.mark.parametrize("encode", [media.encode_pgm, media.encode_bmp])
def test_images_round_trip(encode):
    image = np.random.default_rng(1).integers(0, 256, (9, 13)).astype(np.uint8)
    assert np.array_equal(media.decode(encode(image))[:, :, 0], image)


def test_other_netpbm_forms():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n")[:, :, 0].tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P4 9 1\n\x80\x80")[:, :, 0].tolist() == [[0, 1, 1, 1, 1, 1, 1, 1, 0]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[[258]]]


def test_area_resize_is_exact(monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, (37, 11, 1))
    weights = lambda n, m: np.array([[max(0.0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) for j in range(n)] for i in range(m)]) * m / n
    want = weights(37, 8) @ image[:, :, 0] @ weights(11, 9).T
    for rows in (4096, 5):
        monkeypatch.setattr(media, "STRIP_ROWS", rows)
        np.testing.assert_allclose(media.area_resize(image, 8, 9)[:, :, 0], want)


def test_payloads_read_back(docs, empty):
    rows = media.payload_digests(media.tiles(media.store_payloads(docs))).collect()
    texts = dict(enumerate(base_texts()))
    for r in rows:
        if r.doc_id is not None:
            data = (texts[r.doc_id] or "").encode()
            padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert np.load(__import__("io").BytesIO(r.tile)).shape == (32, 32, 1)
    assert len(rows) == docs.count() and media.tiles(media.store_payloads(empty)).count() == 0


def test_bad_media_are_null(spark):
    rows = media.tiles(spark.createDataFrame([(b"P5 9",), (b"BM",), (None,), (b"",), (b"GIF89a",)], "media binary")).collect()
    assert all(r.tile is None and r.dhash is None for r in rows)


def test_layouts_become_the_same_turns():
    known = chat.registry()
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"instruction": "q", "output": "a"},
        {"question": "q", "answer": "a"},
    ):
        assert chat.canonical(record, known) == want
    assert chat.canonical({"instruction": "q", "input": "i", "output": "a"}, known)[0] == ("user", "q\n\ni")
    assert chat.canonical({"unknown": 1}, known) is None


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|x", "<\\\\||", "a|b<", "<|im_start|>user\n", "", "\\<|"])
def test_control_strings_come_back(text):
    line, start, end = chat.format_turn("assistant", text)
    assert chat.read_turns(line) == [("assistant", text)] and chat.unescape(line[start:end]) == text
    assert line.count("<|") == 2 and chat.read_turns(chat.format_turn("a\nb\\" + text, text)[0]) == [("a\nb\\" + text, text)]


def test_main_text_of_pages():
    page = (
        '<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class="cookie-notice">c</div><div class="page-with-sidebar"><article>'
        '<h1>Head</h1><p>A &amp; <b>b</b>\n c<p>D</p><script>x="</p>"</script><div class="share">s</div><form>f</form></article>'
        '<aside>side</aside><section id="comments"><p>re</p></section></div><footer>f</footer></body></html>'
    )
    assert html.main_text(page) == "Head\nA & b c\nD"
    assert html.main_text("") == "" and html.main_text("plain <i>text</i>") == "plain text"
    assert html.main_text("<body><p>x<li>y</body>") == "x\ny"
    study = '<article><p>One.</p><div class="search-results-study"><p>Two is longer.</p></div></article>'
    assert html.main_text(study) == "One.\nTwo is longer."


@pytest.mark.parametrize("broken", ["<a " * 20000 + '"', "<a href='" * 20000, "<!--" * 20000, '<b class="ad">' * 20000, "<p" * 20000, "<div>" * 20000 + "</p>" * 20000, "<div>x" * 20000])
def test_broken_pages_take_time_in_proportion(broken):
    began = time.time()
    html.main_text(broken)
    assert time.time() - began < 20


def test_wrappers_cover_their_pages(spark):
    pages = [f"<body><article>{'<p>x</p>' * n}{f'<ul><li>i{n}</li></ul>' * (n % 2)}</article>{'<div>d</div>' * (n % 3)}</body>" for n in range(7)]
    matcher = html.Matcher(html.merge([html.signature(p) for p in pages]))
    assert all(html.filled(html.stream(p), matcher) is not None for p in pages)
    rows = [(i, f"http://h{i % 2}/", p, "old") for i, p in enumerate(pages)] + [(9, None, None, None), (10, "http://h0/", "", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(d).collect()}
    assert got[9] == got[10] == "" and got[3] == "x\nx\nx\ni3" and len(got) == 9
    assert html.extract(d.limit(0)).count() == 0


def unmarked(k):
    """A page of a host whose classes say nothing: a menu, a notice in the text, a varying teaser, the text, a footer."""
    words = " ".join(words_of(k, 40))
    more = f"<ul><li>{words_of(k + 99, 3)[0]} item</li></ul>" if k % 2 else ""
    return (
        f'<html><body><div class="k1"><ul>{"".join(f"<li><a href=x>{w}</a></li>" for w in words_of(k + 50, 5))}</ul></div><div class="k2">tip {words_of(k + 7, 2)[0]}</div>'
        f'<div class="k3"><h1>Title {k}</h1><p>{words}</p><div class="k4"><p>Subscribe to our letter today.</p></div><p>End {k} of it.</p>{more}</div><div class="k5">All rights reserved.</div></body></html>'
    )


def wanted(k):
    more = f"\n{words_of(k + 99, 3)[0]} item" if k % 2 else ""
    return f"Title {k}\n{' '.join(words_of(k, 40))}\nEnd {k} of it.{more}"


def test_the_wrapper_decides_where_classes_say_nothing(spark):
    rows = [(k, "http://plain.example/a", unmarked(k)) for k in range(8)] + [(8, "http://alone.example/", unmarked(8))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == wanted(k) for k in range(8))
    alone = html.main_text(unmarked(3))
    assert "Subscribe" in alone and alone != wanted(3)  # without others to compare with, the notice isn't known
    assert "Subscribe" in got[8] and "rights" not in got[8] and got[8].startswith("Title 8\n")


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><article><h1>Same</h1><p>All the same text.</p></article><footer>f</footer></body>"
    d = spark.createDataFrame([(k, "http://h/", page) for k in range(5)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(d).collect()} == {"Same\nAll the same text."}


def test_alignment_against_brute_force(monkeypatch):
    """The wrapper of two streams fits both, and keeps as many nodes as their longest common subsequence; long ones in blocks still fit."""
    r = np.random.default_rng(8)
    for n in range(60):
        a, b = (["abcd"[i] for i in r.integers(0, 4, int(r.integers(1, 9)))] for _ in range(2))
        merged = html.align(a, b)
        kept = [x for x in merged if isinstance(x, str)]
        best = max(k for k in range(len(a) + 1) if any(_inside(c, b) for c in itertools.combinations(a, k)))
        assert len(kept) == best
        matcher = html.Matcher(merged)
        assert matcher.match(a) is not None and matcher.match(b) is not None
    monkeypatch.setattr(html, "CELLS", 60)
    for n in range(20):
        a = [f"t{i}" for i in range(40)] + ["x"] * n
        b = [f"t{i}" for i in range(0, 40, 2)] + ["y"] * 9 + [f"t{i}" for i in range(30, 40, 3)]
        matcher = html.Matcher(html.align(a, b))
        assert matcher.match(a) is not None and matcher.match(b) is not None


def _inside(some, whole):
    rest = iter(whole)
    return all(x in rest for x in some)


def sets_of(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_near_duplicates_against_brute_force(docs, empty):
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()}
    texts = dict(enumerate(base_texts()))
    sets = {i: sets_of(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            union = len(sets[i].keys() | sets[j].keys())
            if same or (union and len(sets[i].keys() & sets[j].keys()) >= 0.8 * union):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in texts}
    kept = [r.doc_id for r in neardup.one_of_each(docs.where("doc_id IS NOT NULL")).collect()]
    assert sorted(kept) == sorted(set(got.values())) and neardup.near_duplicates(empty).count() == 0


def test_one_of_each_class_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(words_of(s, 60)) for s in range(50, 55))
    rows = [(None, a), (None, b), (None, b), (None, None), (7, c), (7, d), (7, d), (3, e), (None, e), (None, e + " more")]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, a), (None, b), (None, None), (7, c), (7, d), (3, e)], key=str)


@pytest.mark.parametrize("rare", [32, 2])
def test_near_duplicates_among_form_letters(spark, monkeypatch, rare):
    """Form letters that are no links among each other, some pairs of which are, against all pairs; then letters near each other."""
    monkeypatch.setattr(neardup, "RARE", rare)
    monkeypatch.setattr(neardup, "BLOCK", 40)
    form = [f"f{k}" for k in range(174)]
    texts = [" ".join([*form, *(f"u{i}_{k}" for k in range(26))]) for i in range(300)]
    for i in range(0, 120, 2):  # shares some of the own words of the letter before
        texts[i + 1] = " ".join([*form, *(f"u{i}_{k}" for k in range(5 + i % 5)), *(f"v{i}_{k}" for k in range(21 - i % 5))])
    for i in range(60):  # parts of another form, near to some and not to others
        texts.append(" ".join([f"g{k}" for k in range(200 - 3 * i)]))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(sets_of(t)) for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if c == b else c for c in least]
    assert 60 <= len(set(least)) < 300 and got == dict(enumerate(least))


def test_blocks_of_pairs_against_all_pairs():
    r = np.random.default_rng(5)
    base = np.arange(120)
    rows = []
    for i in range(60):
        own = np.sort(r.choice(base[: 100 + 10 * (i % 3)], 90 + i % 9, replace=False)).astype(np.int64)
        w = 1 + np.log(r.integers(1, 3, len(own)))
        rows.append((i, i, len(own) + i % 4, float(w.sum()) + i % 4, own, w))
    found = neardup.block_pairs(rows[:30], rows[30:], 0.8)
    links = {(a[0], b[0]) for a in rows[:30] for b in rows[30:] if (o := len(np.intersect1d(a[4], b[4]))) >= 0.8 * (a[2] + b[2] - o)}
    own = {(a[0], b[0]): max(neardup.similarity((np.append(a[4], -1 - a[0] - 1000 * np.arange(a[2] - len(a[4]))), np.append(a[5], np.ones(a[2] - len(a[4])))), (np.append(b[4], -1 - b[0] - 1000 * np.arange(b[2] - len(b[4]))), np.append(b[5], np.ones(b[2] - len(b[4])))))) for a in rows[:30] for b in rows[30:]}
    links |= {p for p, s in own.items() if s >= 0.8}

    def classes(pairs):
        least = list(range(60))
        for a, b in pairs:
            lo, hi = sorted((least[a], least[b]))
            least = [lo if c == hi else c for c in least]
        return least

    assert links and classes(links) == classes(p for p in found if own[p] >= 0.8)


def test_sketches_estimate_probability_jaccard():
    r = np.random.default_rng(0)
    key = r.integers(1, 1 << 62, 600).astype(np.uint64)
    key.sort()
    a, b = (key[:500], r.integers(1, 4, 500).astype(float)), (key[100:], r.integers(1, 4, 500).astype(float))
    shared = range(100, 500)
    weight = [dict(zip(x[0].tolist(), x[1].tolist(), strict=True)) for x in (a, b)]
    every = set(weight[0]) | set(weight[1])
    exact = sum(1 / sum(max(weight[0].get(o, 0) / weight[0][k], weight[1].get(o, 0) / weight[1][k]) for o in every) for k in key[list(shared)].tolist())
    assert abs(neardup.similarity(a, b)[0] - exact) < 1e-9
    owner = np.zeros(500, np.int64)
    s = [neardup.sketch(x[0], x[1], owner, 1, 2048)[0] for x in (a, b)]
    assert abs((s[0] == s[1]).mean() - exact) < 0.05


@pytest.mark.parametrize("length,gram", [(200, 64), (40, 16)])
def test_repeats_against_brute_force(docs, empty, monkeypatch, length, gram):
    monkeypatch.setattr(substrings, "BLOCK", 700)
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = collections.Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    want = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        want.append((i, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), kept))
    found = substrings.removed(docs, "text", length, gram)
    ids = docs.select("doc_id", text_key(F.col("text")).alias("_tid")).join(found, "_tid").collect()
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in ids]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substrings.remove_repeats(empty).count() == 0
    assert substrings.without_repeats(docs).count() == len(texts)


def test_deep_shallow_order():
    r = np.random.default_rng(3)
    strings = [bytes(r.integers(97, 99, int(n)).astype(np.uint8)) for n in r.integers(0, 40, 300)] + [b"a" * 50, b"a" * 50, b"a" * 49]
    order, common = substrings.multikey_sort(strings, depth=4)
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_scores_against_brute_force(docs, empty):
    rows = [r for r in hmm.score(docs, iterations=2).collect() if r.doc_id is not None]
    texts = dict(enumerate(base_texts()))
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    all_rows = [(r.doc_id, r.text) for r in docs.collect()]
    count = collections.Counter()
    for i, t in all_rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            count.update([*WORD.findall(lower(t)), None])
    n, v = sum(count.values()), len(count)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
    assert hmm.score(empty, iterations=1).count() == 0


def test_forward_equals_the_sum_over_paths():
    model = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.3, 0.3], [0.2, 0.6]]))
    import itertools

    for own in ([0], [2, 1], [0, 1, 2, 2]):
        total = 0.0
        for path in itertools.product(range(2), repeat=len(own)):
            p = model.start[path[0]] * model.emit[own[0], path[0]]
            for t in range(1, len(own)):
                p *= model.move[path[t - 1], path[t]] * model.emit[own[t], path[t]]
            total += p
        assert math.isclose(hmm.log_likelihood([np.array(own), np.array([1])], model)[0], math.log10(total), rel_tol=1e-12)


def test_training_raises_the_likelihood():
    r = np.random.default_rng(4)
    data = [np.where(np.arange(30) // 10 % 2 == 0, r.integers(0, 3, 30), r.integers(3, 6, 30)) for _ in range(40)]
    model, last = hmm.first_model(np.full(6, 1 / 6), 2), -np.inf
    for _ in range(6):
        now = hmm.log_likelihood(data, model).sum()
        assert now >= last - 1e-9
        last = now
        start, moves, emissions = hmm.expected_counts(data, model)
        model = hmm.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))
    assert math.isclose(emissions.sum(), 1200)


def test_counts_of_whole_chains(monkeypatch):
    """Baum-Welch counts against sums over plain recursions, whatever the length of the blocks."""
    r = np.random.default_rng(1)
    model = hmm.Model(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(7), 3).T)
    data = [r.integers(0, 7, n) for n in (1, 5, 23, 7, 40, 2, 16)]
    start, moves, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for s in data:
        alpha = [model.start * model.emit[s[0]]]
        for x in s[1:]:
            alpha.append((alpha[-1] @ model.move) * model.emit[x])
        beta = [np.ones(3)]
        for x in s[:0:-1]:
            beta.insert(0, model.move @ (model.emit[x] * beta[0]))
        whole = alpha[-1].sum()
        start += alpha[0] * beta[0] / whole
        for t, x in enumerate(s):
            emissions[x] += alpha[t] * beta[t] / whole
            if t:
                moves += alpha[t - 1][:, None] * model.move * (model.emit[x] * beta[t])[None, :] / whole
    for block in (512, 8, 3, 1):
        monkeypatch.setattr(hmm, "SEGMENT", block)
        for got, want in zip(hmm.expected_counts(data, model), (start, moves, emissions), strict=True):
            np.testing.assert_allclose(got, want, atol=1e-12)


def test_scores_are_those_of_a_plain_model(spark, docs):
    """score, from the vocabulary to the forward recursion, against a plain version that learns by the same counts."""
    iterations = 2
    rows = [r for r in hmm.score(docs, iterations=iterations).collect() if r.doc_id is not None]
    every = [("" if r.doc_id is None else str(r.doc_id), r.text) for r in docs.collect()]
    words = lambda t: [w.encode() for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
    learn = [t for i, t in every if zlib.crc32(i.encode()) % 10]
    count = collections.Counter(w for t in learn for w in [*words(t), None])
    kind = {w: int(k) for w in {w for _, t in every for w in words(t)} for k in [hmm.tokens([w])[1][0]]}
    key = {w: int(hmm.tokens([w])[0][0]) for w in kind}
    often = sorted((w for w in count if w is not None and count[w] >= hmm.OFTEN), key=lambda w: (-count[w], key[w]))
    symbol = {None: 0} | {w: k + 1 for k, w in enumerate(often)}
    n_own = len(symbol)
    class_n, class_types = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in count.items():
        if w not in symbol:
            class_n[kind[w]] += n
            class_types[kind[w]] += 1
    unigram = np.zeros(n_own + hmm.CLASSES)
    for w, k in symbol.items():
        unigram[k] = count[w]
    unigram[n_own:] = class_n
    unigram[0] += hmm.ADD
    unigram[n_own:] += hmm.ADD
    unigram /= unigram.sum()
    code = lambda t: np.array([symbol[w] if w in symbol else n_own + kind[w] for w in [*words(t), None]])
    model = hmm.first_model(unigram)
    for _ in range(iterations):
        start, moves, emissions = hmm.expected_counts([code(t) for t in learn], model)
        start, moves, emissions = start + 1, moves + 1, emissions + hmm.PRIOR * unigram[:, None]
        model = hmm.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))
    texts = dict(enumerate(base_texts()))
    for r in rows:
        own = code(texts[r.doc_id])
        p = model.start * model.emit[own[0]]
        total = 0.0
        for x in own[1:]:
            total += math.log10(p.sum())
            p = (p / p.sum()) @ model.move * model.emit[x]
        total += math.log10(p.sum())
        for w in words(texts[r.doc_id]):
            if w not in symbol:
                total += math.log10((count[w] + hmm.ADD) / (class_n[kind[w]] + hmm.ADD * (class_types[kind[w]] + 1)))
        assert math.isclose(r.score, total, rel_tol=1e-9), r.doc_id


def test_sums_are_made_by_few_tasks(spark, monkeypatch):
    """Each task sends a row for every symbol it has, so their number follows the cores or the tokens, not the files; the counts are the same."""
    r = np.random.default_rng(6)
    data = [r.integers(0, 50, n) for n in r.integers(1, 60, 200)]
    rows = [(np.array(s, "<u4").tobytes(),) for s in data]
    codes = spark.createDataFrame(rows, "symbols binary").repartition(40)
    cores, total = spark.sparkContext.defaultParallelism, sum(map(len, data))
    unigram = np.full(50, 1 / 50)
    start, moves, emissions = hmm.expected_counts(data, hmm.first_model(unigram))
    emit = emissions + hmm.PRIOR * unigram[:, None]
    for n, (size, most) in enumerate([(1 << 24, cores), (-(-total // 9), 9)]):
        monkeypatch.setattr(hmm, "TASK_TOKENS", size)
        spark.sparkContext.setJobGroup(f"sums-{n}", "sums")
        model = hmm.baum_welch(codes, unigram, iterations=1, n_tokens=total)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup(f"sums-{n}") for s in tracker.getJobInfo(job).stageIds}
        tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
        assert tasks and max(tasks) == max(cores, most)
        np.testing.assert_allclose(model.emit, emit / emit.sum(axis=0), rtol=1e-9)
        np.testing.assert_allclose(model.move, (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), rtol=1e-9)
        np.testing.assert_allclose(model.start, (start + 1) / (start + 1).sum(), rtol=1e-9)


def test_clashing_columns_and_keys(spark):
    d = spark.createDataFrame([(1, "a b", 7, 8, "g", 5, 2), (2, None, 7, 8, "g", 5, 2), (None, "", 7, 8, "g", 5, 2)], "doc_id long, text string, shard int, slot int, _group string, _tid int, _key int")
    got = sharding.assign_shards(d, 2)
    assert got.columns == ["doc_id", "text", "_group", "_tid", "_key", "size", "text_crc32", "shard", "slot"] and got.count() == 3
    near = neardup.near_duplicates(d)
    assert near.columns == [*d.columns, "class_id", "class_size"] and {(r.doc_id, r.class_id) for r in near.collect()} == {(1, 1), (2, 2), (None, 2)}
    assert neardup.one_of_each(d).columns == d.columns and neardup.one_of_each(d).count() == 2
    assert substrings.remove_repeats(d.withColumnRenamed("doc_id", "_TID2").withColumnRenamed("_tid", "x").withColumnRenamed("_TID2", "_tid"), id_col="_tid").count() == 3
    media_rows = media.payload_digests(media.store_payloads(d).withColumn("Payload_Bytes", F.lit(1)))
    assert media_rows.columns.count("payload_bytes") == 1 and media_rows.count() == 3


def test_every_group_is_placed_by_the_dot_product():
    """Placement of single vectors against plain loops."""
    r = np.random.default_rng(2)
    v = r.random((200, 3))
    v /= v.sum(axis=0)
    room, want = [[0.25] * 3 for _ in range(4)], [0] * 200
    for i in sorted(range(200), key=lambda i: (-max(v[i]), i)):
        gain = [sum(a * b for a, b in zip(v[i], s, strict=True)) for s in room]
        fits = [all(a >= b for a, b in zip(s, v[i], strict=True)) for s in room]
        best = max(range(4), key=lambda s: (gain[s] if fits[s] or not any(fits) else -9, -s))
        want[i] = best
        room[best] = [a - b for a, b in zip(room[best], v[i], strict=True)]
    left = np.full((4, 3), 0.25)
    assert sharding.pack_vectors(v, left).tolist() == want and np.allclose(left, room)


def test_parts_of_small_groups_hold_groups_of_one_size():
    assert sharding.tiers({12: 3, 13: 5, 14: 40, 15: 2, 17: 1}, 8) == {12: (12, 1), 13: (12, 1), 14: (14, 5), 15: (15, 1), 17: (15, 1)}
    assert sharding.tiers({}) == {}


def test_small_groups_are_placed_by_their_own_vectors(spark):
    """Parts against plain placing, and the balance of all three measures over many parts."""
    r = np.random.default_rng(4)
    sizes = np.column_stack([1 + r.pareto(1.2, 6000) * 300, 1 + r.pareto(1.5, 6000) * 40, 1 + (r.random(6000) < 0.02) * r.integers(1, 6, 6000)]).astype(int)
    sizes = np.minimum(sizes, sizes.sum(axis=0) // 500)  # larger groups never come here
    total = sizes.sum(axis=0).astype(float)
    level = np.floor(-np.log2((sizes / total).max(axis=1))).astype(int)
    room = np.full((8, 3), 1 / 8)
    rows = [(f"t{i:05d}", *map(int, x), int(k)) for i, (x, k) in enumerate(zip(sizes, level, strict=True))]
    d = spark.createDataFrame(rows, "text string, bytes long, tokens long, rows long, level int")
    whole = {x.text: x.shard for x in sharding.place_small(d, total, room, 10**6).collect()}
    turn = level.min() % 8
    want = (sharding.pack_vectors(sizes / total, room.copy()) - turn) % 8
    assert [whole[x[0]] for x in rows] == want.tolist()
    for per_part in (10**6, 200):
        got = {x.text: x.shard for x in sharding.place_small(d, total, room, per_part).collect()}
        used = np.zeros((8, 3))
        np.add.at(used, [got[x[0]] for x in rows], sizes / total)
        assert len(got) == 6000 and used.max() < 1.03 / 8


def test_broken_media_give_nulls(spark):
    beyond = bytearray(media.encode_bmp(np.full((2, 2), 9, np.uint8)))
    beyond[46:50] = (4).to_bytes(4, "little")
    for data in (bytes(beyond), b"P5 0 0 255\n", b"P5 1 0 255\n", b"P5 1 1 0\n\x00", b"P6", None, b""):
        r = media.payload_digests(media.tiles(spark.createDataFrame([(data,)], "media binary"))).first()
        assert (r.tile, r.dhash, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (None,) * 5


def test_records_nested_too_deep_are_unknown(spark):
    deep = '{"messages": ' + "[" * 50000 + "]" * 50000 + "}"
    d = spark.createDataFrame([(1, 0, deep), (2, 0, '{"messages": [{"role": "user", "content": "x"}]}')], "conv_id long, turn long, record string")
    got = {r.conv_id: r.formatted for r in chat.format_records(d, "conv_id", "turn", "record").collect()}
    assert got[1] is None and got[2] is not None


def test_another_tokenizer_is_used_as_it_is(tmp_path):
    import json

    from tokenizers import Tokenizer

    declared = json.loads(open(packing.default_tokenizer(), encoding="utf-8").read())
    declared["normalizer"] = None
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(declared, file)
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    assert not own.by_match and packing.WordTokenizer(packing.default_tokenizer()).by_match
    for text in ("Hello World hello", "Σ ß", ""):
        assert np.frombuffer(own(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_long_texts_score_like_their_grams(monkeypatch):
    """Quality features in blocks equal those in one."""
    r = np.random.default_rng(0)
    weights = r.normal(size=2 * quality.DIM).astype(np.float32)
    texts = [" ".join(words_of(k, 50 + 100 * k)).encode() for k in range(6)] + [b"", b"x"]
    whole = quality.margins(texts, weights)
    monkeypatch.setattr(quality, "GRAMS", 37)
    np.testing.assert_allclose(quality.margins(texts, weights), whole, atol=1e-5)


def test_bytes_bound_the_parts_of_a_batch():
    import pyarrow as pa

    from fathom.llm.stage import by_bytes

    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([b"x" * n for n in (10, 3000, 10, 10, 5000, 1, 1, 1, 2000)] )], names=["a", "b"])
    cut = list(by_bytes(iter([batch, batch.slice(0, 0)]), 1, 2500))
    assert [x for c in cut for x in c.column(0).to_pylist()] == list(range(9)) and len(cut) > 2


def test_a_hot_passage_is_found_across_parts(spark, monkeypatch):
    """Many texts share a passage; each part of a batch joins its places, and small batches are solved one by one."""
    monkeypatch.setattr(substrings, "STRETCH_BYTES", 500)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 2000)
    passage = " ".join(words_of(1, 60))
    rows = [(k, f"{' '.join(words_of(100 + k, 30))} {passage} {' '.join(words_of(500 + k, 20))}") for k in range(60)] + [(99, "short")]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    seen = collections.Counter(t[k : k + 200] for _, x in rows for t in [x.encode()] for k in range(len(t) - 199))
    for i, x in rows:
        t = x.encode()
        gone = {j for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for j in range(k, k + 200)}
        assert got[i].n_removed == len(gone) and got[i].kept == bytes(b for j, b in enumerate(t) if j not in gone)
    assert all(got[k].n_removed >= len(passage.encode()) for k in range(60)) and got[99].n_removed == 0
