"""Brute force, round trips and edge cases of the ten operators."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmura.llm import bpe, chat, jpeg, line_dedup, near_dup, packing, toxicity, url_filter, vectors, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    rows = [(None if i is None else int(i), t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here at all"), (7, "x" * 30000), (8, "日本語 é " * 300)]


# -- 1


def archive(n=6):
    raws = [warc.record(i, f"http://a/{i}", b"p%d" % i * 50, hashlib.sha256(b"p%d" % i * 50).hexdigest(), 100, None) for i in range(n)]
    return [warc.member(r) for r in raws]


def found(data):
    rows = list(warc.salvage("a", data))
    return [r[6] for r in rows if r[1] == "record"], [(r[2], r[3]) for r in rows if r[1] == "gap"]


def test_salvage_recovers_what_follows_damage():
    parts = archive()
    assert found(b"".join(parts)) == ([0, 1, 2, 3, 4, 5], [])
    torn = parts[2][:-12]
    data = parts[0] + parts[1] + torn + parts[3] + b"junk" + parts[4] + parts[5]
    ids, gaps = found(data)
    start = len(parts[0] + parts[1])
    assert ids == [0, 1, 3, 4, 5] and gaps == [(start, len(torn)), (start + len(torn) + len(parts[3]), 4)]
    flipped = bytearray(b"".join(parts))
    flipped[len(parts[0]) + 40] ^= 0xFF
    assert found(bytes(flipped))[0] == [0, 2, 3, 4, 5]
    assert found(b"") == ([], []) and found(b"nothing")[1] == [(0, 7)]


def test_salvage_of_plain_records_and_damaged_digests():
    a, b = (warc.record(i, "http://x", b"hello" * 30, hashlib.sha256(b"hello" * 30).hexdigest(), 150, None) for i in (1, 2))
    assert found(a + b)[0] == [1, 2]
    assert found(a.replace(b"hellohello", b"hellOhello", 1) + b) == ([2], [(0, len(a))])


def test_pages_round_trip(spark):
    big, rows = "é" * 80, [(3, "http://a", "é" * 80), (2, None, "é" * 80), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", "é" * 80), (2, "w", "é" * 80)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    out = warc.read_archives(warc.write_archives(warc.mark_revisits(pages))).where("kind = 'record'").collect()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out), key=str)
    want = [(3, 160, "revisit", 2), (2, 160, "response", None), (2, 160, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, 5, "response", None), (8, 5, "response", None), (None, 160, "revisit", 2)]
    assert got == sorted(want, key=str)
    assert {r.payload_digest for r in out if r.payload_bytes == 160} == {hashlib.sha256(big.encode()).hexdigest()}
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages.limit(0)))).count() == 0


def test_records_with_long_urls_are_read_back(spark):
    urls = ["http://a/" + "日" * 100_000, "http://a/" + "x" * 100_000, "http://a/ WARC/1.1\r\n\r\n"]
    pages = spark.createDataFrame([(i, u, "text") for i, u in enumerate(urls)], "page_id long, url string, html string")
    out = warc.read_archives(warc.write_archives(warc.mark_revisits(pages))).collect()
    assert {(r.kind, r.page_id, r.target_uri) for r in out} == {("record", i, u) for i, u in enumerate(urls)}
    plain = [warc.record(i, u, b"p", hashlib.sha256(b"p").hexdigest(), 1, None) for i, u in enumerate(urls)]
    assert found(b"".join(plain))[0] == [0, 1, 2]
    assert found(plain[0][:500_000] + plain[1]) == ([1], [(0, 500_000)])


def test_hostile_fields_are_gaps_or_nulls():
    good = warc.record(1, "http://x", b"p", hashlib.sha256(b"p").hexdigest(), 1, None)
    endless = good.replace(b"Content-Length: ", b"Content-Length: " + b"9" * 5000)
    assert found(endless + good) == ([1], [(0, len(endless))])
    for odd in ("²", "9" * 30, "1" * 5000, "-", "0x1"):
        raw = good.replace(b"<urn:x-page:1>", f"<urn:x-page:{odd}>".encode())
        assert found(raw + good) == ([None, 1], [])
    assert found(good.replace(b"<urn:x-page:1>", b"<urn:x-page:-%d>" % (1 << 63)))[0] == [-(1 << 63)]
    revisit = warc.record(2, "http://x", b"p" * 200, hashlib.sha256(b"p" * 200).hexdigest(), 200, 1)
    rows = list(warc.salvage("a", revisit.replace(b"Content-Length: 200", b"Content-Length: " + b"8" * 5000)))
    assert all(r[1] in ("record", "gap") for r in rows)
    nested = warc.member(good)
    for _ in range(1200):
        nested = warc.member(nested)
    assert found(nested + warc.member(good)) == ([1], [(0, len(nested))])


def test_salvage_of_flipped_cut_and_inserted_bytes():
    r, parts = random.Random(8), archive(5)
    plain = [warc.record(i, f"http://a/{i}", b"q%d" % i * 40, hashlib.sha256(b"q%d" % i * 40).hexdigest(), 80, None) for i in range(5)]
    for n in range(2000):
        data = bytearray(b"".join(r.sample(parts + plain, 6)))
        for _ in range(r.randint(1, 4)):
            at, kind = r.randrange(len(data)), r.randrange(3)
            if kind == 0:
                data[at] ^= 1 << r.randrange(8)
            elif kind == 1:
                del data[at : at + r.randint(1, 60)]
            else:
                data[at:at] = r.choice([b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"Content-Length: 99999999999999999999\r\n", bytes(r.randrange(256) for _ in range(5))])
        rows = list(warc.salvage("a", bytes(data)))
        ranges = sorted({(x[2], x[2] + x[3]) for x in rows})
        assert not data or ranges[0][0] == 0 and ranges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:])), n
        warc._frame(rows, [x.split()[0] for x in warc.RECORD_SCHEMA.split(", ")])


# -- 2


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = keys[::7]
    for size in (3, 100, 3000):  # an underestimate gives more levels, or level 0 again
        c = url_filter.build_cascade(listed, universe, size)
        assert c.has(keys).tolist() == [k in set(listed) for k in keys]
    assert len(c.levels) > 1 and not url_filter.build_cascade([], universe, 9).has(keys).any()


@pytest.mark.parametrize("bound", [64 << 20, 0])  # with 0 each rule has a cascade of its own
def test_rules(spark, bound):
    from murmura.llm.queries import RULES

    urls = [None, "nothing", "http://EXAMPLE.com/en/7a?q", "http://a.example.com/en/8", "x://com/en/", "http://xcom/en/", "http://example.net/de/81", "http://b.net/de/#z", "http://org", "://"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, RULES, max_bytes=bound).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: ("example.com/en/7", "allow"), 3: ("com/en/", "block"), 4: ("com/en/", "block"), 5: (None, "allow"), 6: ("example.net/de/8", "block"), 7: ("net/de/", "block"), 8: (None, "allow"), 9: (None, "allow")}
    assert url_filter.judge(pages.limit(0), RULES, max_bytes=bound).count() == 0
    assert len(url_filter.shards_of(RULES, 10, 0)) > 1 == len(url_filter.shards_of(RULES, 10, 64 << 20))


def test_rules_keep_large_ids_beside_null_ones(spark):
    from murmura.llm.queries import RULES

    rows = [(2**60 + 1, "http://example.com/en/7"), (None, "http://a.com/en/"), (2**63 - 1, "http://net/de/"), (2**60, "http://org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").coalesce(1)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect()}
    assert got == {2**60 + 1: ("example.com/en/7", "allow"), None: ("com/en/", "block"), 2**63 - 1: ("net/de/", "block"), 2**60: (None, "allow")}


def test_lines_to_drop_are_sent_to_all_tasks_only_while_the_driver_holds_them_with_ease(spark):
    rows = spark.range(492_422).selectExpr("id AS leaf", "id AS bucket")  # buckets of a table of 2 GB
    assert not line_dedup._held(rows, "many")[1] and line_dedup._held(rows.limit(10), "few")[1]
    assert not line_dedup._held(rows.limit(119_104), "several")[1]  # of half a GB


def test_rules_for_very_long_urls(spark):
    from murmura.llm.queries import RULES

    urls = ["http://" + "a." * 30_000 + "example.com/en/7" + "x" * 100_000, "http://" + "com." * 30_000 + "xx/en/", "http://a.net/de/8"] + ["http://example.net/de/8"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: (None, "allow"), 2: ("net/de/", "block"), **{i: ("example.net/de/8", "block") for i in (3, 4, 5)}}


# -- 3


def odd_texts(n=300):
    r = random.Random(5)
    return ["", " ", "  ", "a  b", "x \n y", "x\n ", "<|endoftext|> a<|endoftext|>", "don't  stop 12", "a" * 3000, " \xa0y\xa0 \xa0z", "\x1c \x1d z"] + ["".join(r.choice(" \n\tab'sZé1%<|\x1c\xa0日") for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_ids_equal_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, library = bpe.ForcedBoundaryBPE(path), Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "_CHARS", 40)
    texts = odd_texts() + ["''s 's\n's'ts'rehe 'll'l", "aa'"]
    for t, raw in zip(texts, mine.encode_all(texts), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids and mine.encode(t) == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forced_pairs_cut_texts():
    """Cuts are where pieces begin and between bytes that no token holds side by side, and none elsewhere."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, library = bpe.ForcedBoundaryBPE(path), Tokenizer.from_file(path)
    inside = {(x, y) for t in mine.tokens[:50256] for x, y in zip(t, t[1:])}
    assert int(mine.never.sum()) == 256 * 256 - len(inside) and not any(mine.never[x, y] for x, y in inside)
    for text in [t for t in odd_texts(80) if t and "<|" not in t]:
        raw, starts, ends = mine.cuts([text])
        at = np.cumsum([0] + [len(c.encode()) for c in text])
        pieces = {int(at[a]) for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(text)}
        forced = {i for i in range(1, len(raw)) if (raw[i - 1], raw[i]) not in inside}
        assert set(starts.tolist()) == pieces | forced and ends.tolist() == [len(raw)]


def test_digests(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), EDGE + [(100 + i, t) for i, t in enumerate(odd_texts(60))]
    out = bpe.digest_rows(documents(spark, texts), path).collect()
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out), key=str) == sorted(want, key=str)
    back = bpe.decode_column(bpe.encode_column(documents(spark, EDGE), path), path).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.digest_rows(documents(spark, []), path).count() == 0


# -- 4


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nearest_against_brute_force(spark, many_partitions):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 7)).astype("float32")
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(240)] + [(240, None), (241, [0.0] * 7), (242, [float("nan")] * 7), (243, [None] * 7), (250, [1.0, 2.0]), (7, [float(v) for v in x[7]])]
    out = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5, cell_rows=40).collect()
    y = x.astype(float)
    norm = np.sqrt((y * y).sum(1))
    for q in range(0, 240, 50):
        s = (y[q] * y).sum(1) / (norm[q] * norm)
        want = sorted((i for i in range(240) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == want
    assert not [r for r in out if r.query_id == 250]


def test_nearest_of_huge_and_tiny_numbers(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300]), (3, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r.vec_id, round(r.score, 9)) for r in vectors.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert out == [(1, 1.0), (3, 0.989949494), (2, 0.0)]
    assert vectors.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_vectors_count_once(spark):
    rows = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.5, 0.5]), (50, [1.0, 0.0])], "vec_id long, embedding array<float>")
    found = vectors.nearest(rows, F.col("vec_id") % 50 == 0, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(50, 1, 1), (50, 2, 2)]


# -- 5


def test_media_round_trip(spark):
    docs = documents(spark, EDGE)
    media = jpeg.store_texts(docs)
    out = {(r.doc_id, r.n_bytes): r for r in jpeg.media_features(media, keep=("n_bytes",)).collect()}
    for i, t in EDGE:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        r = out[i, len(raw)]
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p)) and r.error is None


def test_damaged_images():
    good = jpeg.store([bytes(range(64))])[0]
    assert [jpeg.decode([x])[0].error for x in (None, b"", good[:40])] == ["no start of image"] * 2 + ["segment cut short"]
    assert jpeg.decode([good])[0].payload == bytes(range(64)) and jpeg.decode([good.replace(b"\xff\xc0", b"\xff\xc2", 1)])[0].error == "not sequential Huffman coding"


def test_colour_thumbnail():
    """A hand-made 16 x 16 image in 4:2:0: four luminance blocks of DC 10, 20, 30, 40, then two of chrominance."""
    dc, ac = jpeg.canonical({s: 4 for s in range(8)}), jpeg.canonical({0: 2})
    bits = ""
    for diff in (10, 10, 10, 10, 0, 0):
        size = diff.bit_length()
        bits += f"{dc[size][0]:04b}" + (f"{diff:0{size}b}" if size else "") + f"{ac[0][0]:02b}"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    data = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([8] * 64)) + seg(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += seg(0xC4, jpeg._dht(0, {s: 4 for s in range(8)})) + seg(0xC4, jpeg._dht(0x10, {0: 2})) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    d = jpeg.decode([data])[0]
    assert (d.width, d.height, d.thumbnail.tolist()) == (16, 16, [[138, 148], [158, 168]])


def test_a_size_that_the_scan_cannot_hold_is_an_error():
    good = jpeg.store([bytes(range(64))])[0]
    at = good.index(b"\xff\xc0") + 5  # height and width in the frame's header
    false = good[:at] + b"\xff\xff\xff\xff" + good[at + 4 :]
    assert jpeg.decode([false, good])[0].error == "scan too short for the size"
    r = random.Random(4)
    for _ in range(300):
        data = bytearray(good)
        for _ in range(r.randint(1, 3)):
            data[r.randrange(2, len(data))] = r.randrange(256)
        jpeg.decode([bytes(data)])


# -- 6


def test_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 300, "ann", "hi"), (1, 300, "bob", None), (1, None, None, "x"), (2, 0, "system", "only")], "conv_id long, turn long, role string, text string")
    out = chat.rotate(turns).collect()
    assert {r.perspective for r in out} == {"ann", "bob", "unknown"} and {r.conv_id for r in out} == {1}
    for p in ("ann", "bob", "unknown"):
        mine = sorted((r for r in out if r.perspective == p), key=lambda r: r.char_start)
        text = "".join(r.segment for r in mine)
        assert [r.char_end for r in mine][-1] == len(text) and all(text[r.char_start : r.char_end] == r.segment for r in mine)
        said = [text[r.mask_start : r.mask_end] for r in mine if r.mask_start is not None]
        assert said == [{"ann": "hi", "bob": "", "unknown": "x"}[p] + "<|im_end|>"]


# -- 7


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh({"a": 1})
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    vec = rng.normal(size=(6, toxicity._WIDTH))
    at, mask, y = rng.integers(0, 6, (4, 3)), np.ones((4, 3, 1)), np.array([1.0, 0.0, 1.0])
    mask[2:, 1] = 0
    _, g, _ = net.gradients(vec, at, mask, y)
    for k in ("uf", "wb", "att", "out", "bf"):
        i = tuple(0 for _ in net.w[k].shape)
        old, e = net.w[k][i], 1e-3
        net.w[k][i] = old + e
        up = net.gradients(vec, at, mask, y)[0]
        net.w[k][i] = old - e
        down = net.gradients(vec, at, mask, y)[0]
        net.w[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 2e-4 + 0.02 * abs(g[k][i])


def test_learns_and_reads_whole_texts(spark):
    r = random.Random(2)
    words = [f"w{a}{b}" for a in "abcdef" for b in "ghijkl"]
    make = lambda y: " ".join(r.choice(words) for _ in range(60)) + (" grobble" if y else "") + " " + r.choice(words)
    net = toxicity.train([(make(i % 2), i % 2) for i in range(240)], rounds=4)
    tail = " ".join(r.choice(words) for _ in range(900)) + " grobble"
    out = toxicity.Scorer(net).scores([make(0), make(1), tail, ""])
    assert out[1] > 0.7 and out[2] > 0.7 and out[0] < 0.5 and 0 <= out[3] <= 1
    scored = toxicity.score(documents(spark, EDGE), net).collect()
    assert len(scored) == len(EDGE) and len({x.score for x in scored if x.doc_id in (1, 2)}) == 1
    assert toxicity.keep_clean(documents(spark, [(1, make(1)), (2, make(0))]), net).select("doc_id").collect() == [(2,)]
    assert toxicity.train([("a", 1)]) is None and toxicity.Scorer(None).scores(["x"]).tolist() == [0.0]


def test_characters_far_inside_a_long_run_count():
    r = random.Random(3)
    words = [f"w{a}{b}" for a in "abcdef" for b in "ghijkl"]
    make = lambda y: "".join(r.choice(words) for _ in range(40)) + ("grobble" if y else "") + "".join(r.choice(words) for _ in range(10))
    net = toxicity.train([(make(i % 2), i % 2) for i in range(240)], rounds=8)
    out = toxicity.Scorer(net).scores([make(i % 2) for i in range(40)])
    assert out[1::2].min() > out[::2].max()
    for n in (1, 39, 40, 41, 60, 61, 79, 80, 81, 500):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        parts = toxicity.words_of(word)
        assert max(map(len, parts)) <= 40 and (parts == [word]) == (n <= 40)
        assert all(any(word[i : i + 20] in p for p in parts) for i in range(n))


def plain_score(network, text):
    """A text's score by loops over windows, words, features, states and both directions."""
    w, h = {k: v.astype(float) for k, v in network.w.items()}, len(network.w["att"]) // 2
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    vectors = []
    for word in toxicity.words_of(text):
        marked = f"<{word}>"
        parts = {marked, marked[:4], marked[:5], marked[:6], marked[-4:], marked[-5:], *(marked[i : i + 3] for i in range(len(marked) - 2))}
        vectors.append(sum((w["table"][network.rows[p]] for p in parts if p in network.rows), np.zeros(w["table"].shape[1])))
    best = -np.inf
    for begin in toxicity.starts(len(vectors)):
        window = vectors[begin : begin + toxicity.WINDOW] or [np.zeros(w["table"].shape[1])]
        empty, both = not vectors, []
        for d, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
            state, states = np.zeros(h), {}
            for t in order:
                x, u = window[t] @ w[f"w{d}"] + w[f"b{d}"], w[f"u{d}"]
                z, r = sigmoid(x[:h] + state @ u[:, :h]), sigmoid(x[h : 2 * h] + state @ u[:, h : 2 * h])
                c = np.tanh(x[2 * h :] + (r * state) @ u[:, 2 * h :])
                state = state if empty else state + z * (c - state)
                states[t] = state
            both.append([states[t] for t in range(len(window))])
        joined = [np.concatenate(p) for p in zip(*both)]
        weight = np.exp([j @ w["att"] for j in joined])
        pooled = sum(a * j for a, j in zip(weight / weight.sum(), joined))
        best = max(best, pooled @ w["out"] + w["bias"][0])
    a, b = network.scale
    return float(sigmoid(a * best + b))


def test_scores_are_those_of_plain_loops():
    r = random.Random(9)
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    mild, bad = "one two three four five house garden table window".split(), "worthless stupid idiot".split()
    texts = [(say(mild + bad * (i % 2), r.randint(3, 120)), i % 2) for i in range(120)]
    network = toxicity.train(texts, rounds=3)
    some = [t for t, _ in texts[:30]] + ["", "!!", "a", "x" * 100, "Don't STOP", say(mild, 300) + " worthless idiot"]
    assert toxicity.Scorer(network).scores(some) == pytest.approx([plain_score(network, t) for t in some], abs=1e-4)


# -- 8


def brute_plan(lengths, kinds, most, penalties):
    n, before = len(lengths), np.concatenate([[0], np.cumsum(lengths)])
    cost = [0.0] + [float("inf")] * n
    for j in range(1, n + 1):
        for i in range(j):
            size = before[j] - before[i]
            if size <= most:
                waste = 0 if size in packing._POWERS else most - size
                cost[j] = min(cost[j], cost[i] + waste + packing._WINDOW + penalties[kinds[j - 1]])
    return cost[n]


def test_plan_is_optimal():
    r = random.Random(4)
    for _ in range(40):
        lengths, kinds = [r.randint(1, 250) for _ in range(25)], [r.randint(0, 2) for _ in range(25)]
        penalties, most = (0.0, 4.0, 24.0), 256
        ends, before, cost, start = packing.plan(lengths, kinds, most, penalties, True), np.concatenate([[0], np.cumsum(lengths)]), 0.0, 0
        for e in ends:
            size = before[e] - before[start]
            cost += (0 if size in packing._POWERS else most - size) + packing._WINDOW + penalties[kinds[e - 1]]
            start = e
        assert start == 25 and abs(cost - brute_plan(lengths, kinds, most, penalties)) < 1e-6


def test_pieces_hold_all_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [(i, t) for i, t in enumerate(odd_texts(60))] + [(900 + k, t) for k, (_, t) in enumerate(EDGE)] + [(990, "İ ΑΣ ΑΣ. ǅ ﬁ ẞ "), (991, "No stop " * 900)]
    out = packing.pack(documents(spark, texts), path).collect()
    for i, t in texts:
        ids = []
        for p in sorted((p for p in out if p.doc_id == i), key=lambda p: p.start):
            assert p.start == len(ids) and p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
            ids += p.ids
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [1]
    for s in {p.sequence_id for p in out}:
        mine = sorted((p for p in out if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in mine] == [0, *np.cumsum([p.length for p in mine])[:-1].tolist()] and sum(p.length for p in mine) <= 2048


def test_ids_of_all_code_points_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = packing.WordEncoder(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for begin in range(0, 0x40000, 1 << 14):  # beyond, one unassigned or private plane is like the next
        some = [c for c in range(begin, begin + (1 << 14)) if not 0xD800 <= c < 0xE000]
        texts = ["".join(f"a{chr(c)}b{chr(c)}{chr(c)} " for c in some[i : i + 64]) for i in range(0, len(some), 64)]
        ids, sentences, per = encoder.encode(texts)
        want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        ends = np.cumsum(sentences)[np.cumsum(per) - 1]
        assert [list(x) for x in np.split(ids, ends[:-1])] == want, hex(begin)


# -- 9


def test_templates(spark):
    rows = [(i, f"user {i} logged in from host {i * 3}\nown words are {chr(97 + i) * 3} here and there\n") for i in range(8)]
    docs = documents(spark, rows + [(90, None), (91, ""), (92, "user 9 logged in from host 1"), (None, "x y")])
    out = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs, keep_first=True).collect()}
    assert out[0].text == rows[0][1] and out[5].text == "" and out[90].text is None and out[91].text == "" and out[92].text == "" and out[None].text == "x y"
    assert 92 not in {r.doc_id for r in line_dedup.drop_recurring_lines(docs, drop_emptied=True).collect()}
    assert {r.text for r in line_dedup.drop_recurring_lines(docs).collect() if r.doc_id is not None and r.doc_id < 8} == {""}
    assert line_dedup.drop_recurring_lines(docs.limit(0)).count() == 0


# -- 10


def brute_components(texts, words, percent):
    sets = [set(near_dup.shingles(t, words).tolist()) for _, t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(texts)}


@pytest.mark.parametrize("block", [1500, 7])
def test_components(spark, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block)
    r = random.Random(9)
    texts = []
    for g in range(6):
        base = [f"w{r.randrange(900)}" for _ in range(60)]
        for _ in range(12):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(60)] = f"x{r.randrange(99)}"
            texts.append((len(texts) * 3 + 1, " ".join(words)))
    texts += [(1000, ""), (1001, ""), (1002, "Solo"), (1003, "sOLO"), (1004, texts[5][1])]
    out = near_dup.near_duplicates(documents(spark, texts), words=2).collect()
    assert {x.doc_id: x.component_id for x in out} == brute_components(texts, 2, 80)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


def test_a_chain_of_unlike_texts_is_settled_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 7)
    texts = [(i, " ".join(f"w{j}" for j in range(12 * i, 12 * i + 60))) for i in range(300)]  # neighbours share two thirds of their shingles or less
    docs = documents(spark, texts)
    classes = near_dup.sketch_rows(docs, 2).selectExpr("1 AS grp", "43 AS blocks", "pmod(hash(node), 43) AS block", "node", "doc_id", "h", "n_shingles AS n", "sketch", "node AS known")
    read = []

    def settle(_, tasks, *__):
        read.append(tasks.count())
        return spark.createDataFrame([], "a binary, b binary")

    monkeypatch.setattr(near_dup, "_settle", settle)
    assert near_dup._across(docs, near_dup.materialize(classes, "known"), 2, 80).count() == 300
    assert max(read) <= 10 * 300  # 25,757 when all members met


def test_sketches():
    a, b = np.arange(4000, dtype=np.uint64), np.arange(400, 4400, dtype=np.uint64)
    a, b = near_dup._mix(a), near_dup._mix(b)
    assert (near_dup.merge(near_dup.sketch(a), near_dup.sketch(b)) == near_dup.sketch(np.union1d(a, b))).all()
    assert abs(near_dup.estimate(near_dup.sketch(a), near_dup.sketch(b), 4000, 4000) - 3600 / 4400) < 0.12


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    out = {x.doc_id: x for x in near_dup.near_duplicates(documents(spark, EDGE)).collect()}
    assert out[5].component_id == 4 and out[1].n_shingles == 0 and out[None].component_id is None
