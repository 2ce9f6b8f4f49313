"""Each corpus operator against brute force, a round trip, or a reference library."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from cairn.llm import bpe, html_extract, mixing, sharding, simhash, topk, ts_media, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, score string, taken string, fp string"


def docs(spark, texts, sources=None):
    """Documents with extra columns whose names clash with those of results."""
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), 7, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "a", "a b", "Hello  World\n", "x" * 5000, "naïve déjà-vu 日本語 🙂", "don't stop 123 456", "a b c d e " * 2000, "a b", "a b"]


# --- byte-level BPE

@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, library):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcdehlnorst") for _ in range(rng.choice([30, 300, 3000]))) for _ in range(30)] + ["aaaa" * 500, "ab" * 999, "<|endoftext|>"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.encode(docs(spark, texts), path, public_tokenizers.PATTERN).collect()}
    short = {r.doc_id: r for r in bpe.digests(docs(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and bytes(got[i].decoded) == (text or "").encode()
        assert short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_shared_queue_equals_single_merges(monkeypatch):
    """Pre-tokens merged together against a search for the lowest pair in each alone; later tokens may have lower ranks here."""
    rng = random.Random(8)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.choice([2, 2, 3, 4]))) for _ in range(60)})
    ranks = {token: rank for rank, token in enumerate(rng.sample([b"a", b"b", b"c", *words], 3 + len(words)))}

    def alone(piece):
        spans = [piece] if piece in ranks else [bytes([b]) for b in piece]
        while found := [(ranks[x + y], k) for k, (x, y) in enumerate(zip(spans, spans[1:], strict=False)) if x + y in ranks]:
            k = min(found)[1]
            spans[k : k + 2] = [spans[k] + spans[k + 1]]
        return [ranks[x] for x in spans]

    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "SHARED", 400)
    coder, joins = bpe.Encoder(ranks, "[a-z]+"), []
    merge = coder.merge
    monkeypatch.setattr(coder, "merge", lambda pieces: (joins.append(len(pieces)), merge(pieces))[1])
    texts = [None, "", " ", *(" ".join("".join(rng.choice("abc") for _ in range(rng.choice([1, 5, 9, 9, 120]))) for _ in range(12)) for _ in range(60))]
    for part in (texts, texts[30:], texts[:3]):
        ids, bounds = coder.encode(part)
        assert [ids[a:b].tolist() for a, b in pairwise(bounds.tolist())] == [[x for w in (t or "").split() for x in alone(w.encode())] for t in part]
        assert [bytes(x).decode() for x in bpe._spelled(coder.tokens, ids, bounds)] == ["".join((t or "").split()) for t in part]
    assert len(joins) < sum(joins) / 5 and not coder.queue.mid[0] and not any(coder.queue.buckets)
    assert not any(len(piece) > bpe.MEMORY_LENGTH for piece in coder.memory)
    with pytest.raises(ValueError, match="no rank"):
        bpe.Encoder({b"a": 0}, "[a-z]+").encode(["ax"])


def test_bpe_empty_table(spark):
    assert bpe.digests(docs(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# --- transport streams

def test_transport_stream_round_trip(spark):
    texts = ODD + ["z" * n for n in (12287, 12288, 12289, 191, 192, 193)] + ["long text " * 30000]
    rows = {r.doc_id: r for r in ts_media.inspect(ts_media.store(docs(spark, texts))).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes % 188 == 0 and "breaks=0" in r.feature
        assert len(r.timestamps) == len(r.random_access) == -(-len(payload) // ts_media.UNIT)
        assert r.timestamps == [3003 * k for k in range(len(r.timestamps))]
    assert rows[10].media_sha256 == rows[11].media_sha256
    assert ts_media.inspect(ts_media.store(docs(spark, []))).count() == 0


def plain_parse(stream):
    """Payload, timestamps and random-access flags of a stream, packet by packet after the published layout."""
    pmt_pid = data_pid = None
    units, times, flags, counter = [], [], [], None
    for at in range(0, len(stream), 188):
        packet = stream[at : at + 188]
        assert packet[0] == 0x47
        start, pid = packet[1] >> 6 & 1, (packet[1] & 31) << 8 | packet[2]
        body, flag = packet[4:], 0
        if packet[3] >> 5 & 1:
            flag = packet[5] >> 6 & 1 if packet[4] else 0
            body = packet[5 + packet[4] :]
        assert packet[3] >> 4 & 1
        if pid in (0, pmt_pid):
            section = body[1 + body[0] :]
            length = (section[1] & 15) << 8 | section[2]
            crc = 0xFFFFFFFF
            for byte in section[: 3 + length]:
                for bit in range(7, -1, -1):
                    top = crc >> 31 ^ byte >> bit & 1
                    crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
            assert crc == 0
            if pid == 0:
                pmt_pid = (section[10] & 31) << 8 | section[11]
            else:
                data_pid = (section[13] & 31) << 8 | section[14]
        elif pid == data_pid:
            assert counter is None or packet[3] & 15 == (counter + 1) % 16
            counter = packet[3] & 15
            if start:
                units.append(b"")
                flags.append(flag)
            units[-1] += body
    out = b""
    for unit in units:
        assert unit[:4] == b"\x00\x00\x01\xbd" and len(unit) == 6 + int.from_bytes(unit[4:6], "big") and unit[7] >> 6 == 2
        pts = unit[9:14]
        assert pts[0] >> 4 == 2 and pts[0] & pts[2] & pts[4] & 1
        times.append((pts[0] >> 1 & 7) << 30 | pts[1] << 22 | pts[2] >> 1 << 15 | pts[3] << 7 | pts[4] >> 1)
        out += unit[9 + unit[8] :]
    return out, times, flags


def test_transport_stream_read_by_a_plain_parser(spark):
    texts = ["", "a", "z" * 12289, "words and words " * 9000]
    for r in ts_media.store(docs(spark, texts)).collect():
        payload = ts_media.pad(texts[r.doc_id].encode())
        got, times, flags = plain_parse(bytes(r.media))
        assert got == payload and times == [3003 * k for k in range(len(times))] and all(flags)
        seen = ts_media.inspect(spark.createDataFrame([r])).first()
        assert seen.media_sha256 == hashlib.sha256(r.media).hexdigest() and seen.feature.startswith(f"packets={len(r.media) // 188};units={len(times)};random_access={len(times)};breaks=0;last_pts={times[-1]};")


def test_transport_stream_sees_damage():
    stream = bytearray(ts_media.mux(ts_media.pad(b"q" * 50_000)))
    lost = bytes(stream[: 188 * 20] + stream[188 * 21 :])
    packets = np.frombuffer(lost, np.uint8).reshape(-1, 188)
    assert (packets[:, 0] == 0x47).all() and ts_media.demux(lost)["breaks"] == 1
    stream[10] ^= 1
    with pytest.raises(ValueError):
        ts_media.demux(bytes(stream))


# --- WARC

def pages(spark, htmls):
    return spark.createDataFrame([(i, f"http://h/{i}", h, "k", 3) for i, h in enumerate(htmls)], "page_id long, url string, html string, record_type string, payload int")


def test_warc_round_trip(spark):
    htmls = ["<p>a</p>", None, "", "<p>a</p>", "é🙂" * 1000, "WARC/1.1\r\n\r\n", "<p>a</p>", "\x1f\x8b\x08"]
    rows = {r.page_id: r for r in warc.round_trip(pages(spark, htmls)).collect()}
    latest = {}
    for i, h in enumerate(htmls):
        latest[h or ""] = i
    assert len(rows) == len(htmls)
    for i, h in enumerate(htmls):
        data, last = (h or "").encode(), latest[h or ""]
        r = rows[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.checked
        assert (r.record_type, r.refers_to) == (("response", None) if last == i else ("revisit", last))
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_null_and_repeated_rows(spark):
    rows = [(None, "u", "x"), (7, "a", "x"), (7, "b", "x"), (7, "b", "x"), (3, "c", "x"), (None, "u", "only null"), (None, "u", "only null"), (5, "long" * 50_000, "y")]
    frame = spark.createDataFrame([(i, u, h, 0) for i, u, h in rows], "page_id long, url string, html string, copies int")
    got = sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect()), key=str)
    assert got == sorted([(-1, 1, "revisit", 7), (7, 1, "revisit", 7), (7, 1, "response", None), (7, 1, "revisit", 7), (3, 1, "revisit", 7), (-1, 9, "response", None), (-1, 9, "revisit", None), (5, 1, "response", None)], key=str)


def test_warc_copies_are_written_in_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 3)
    rows = warc.round_trip(spark.range(10).selectExpr("1L as page_id", "'u' as url", "'same' as html")).collect()
    assert sorted(r.record_type for r in rows) == ["response"] + ["revisit"] * 9 and {r.refers_to for r in rows} == {1, None}


def warc_members(count):
    payloads = [f"payload {i} ".encode() * 50 for i in range(count)]
    return payloads, [warc.record("response", warc.record_id("0", i), i, f"http://x/{i}", p, warc.sha1_base32(p), len(p)) for i, p in enumerate(payloads)]


def test_warc_salvage_skips_damage():
    payloads, members = warc_members(6)
    broken = bytearray(members[2])
    broken[40] ^= 0xFF
    plain = gzip.decompress(members[4])
    data = members[0] + b"junk" + members[1] + bytes(broken) + members[3][:60] + plain + members[5]
    seen = list(warc.salvage(data))
    assert [int(h["x-page-id"]) for _, h, _, _, _ in seen if h] == [0, 1, 4, 5]
    gaps = [(at, size) for at, h, _, size, _ in seen if h is None]
    assert gaps == [(len(members[0]), 4), (len(members[0]) + 4 + len(members[1]), len(broken) + 60)]
    assert all(b == payloads[int(h["x-page-id"])] for _, h, b, _, _ in seen if h)


def test_warc_salvage_takes_long_headers_and_many_false_starts():
    _, members = warc_members(2)
    long_uri = warc.record("response", warc.record_id("9", 0), 9, "http://x/" + "y" * 300_000, b"z", warc.sha1_base32(b"z"), 1)
    junk = b"WARC/1.1\r\nno colon " * 50_000  # each looks like a version line
    seen = list(warc.salvage(members[0] + junk + long_uri + members[1]))
    assert [(h["x-page-id"] if h else size) for _, h, _, size, _ in seen] == ["0", len(junk), "9", "1"]


def test_warc_damaged_archives_lose_only_what_is_damaged(spark, tmp_path):
    frame = pages(spark, [f"<p>page {i} of many</p>" * 20 for i in range(60)])
    manifest = warc.write(frame, str(tmp_path / "w"))
    names = sorted(r.archive for r in manifest.collect())
    path = tmp_path / "w" / names[0]
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 0x55
    path.write_bytes(bytes(data))
    back = warc.read(spark, str(tmp_path / "w"), manifest).collect()
    lost = [r for r in back if r.record_type is None]
    assert len(lost) == 1 and lost[0].gap_bytes > 0 and lost[0].reason
    assert len({r.page_id for r in back if r.record_type}) == 59


# --- HTML

@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<html><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now</div><article><h1>T &amp; U</h1><p><b>One\n two<br>three<p>Four&nbsp;five</article><footer>&copy; x</footer></body>", "T & U One two three Four five"),
        ("<body><div id=main><div class=c><p>The first long paragraph of the story, with many words.</p><p>The second one is long as well, and ends here.</p></div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class=comments><p>I do not agree at all with this, it is all wrong from start to end.</p></div><script>var a='<p>no</p>'</script>", "The first long paragraph of the story, with many words. The second one is long as well, and ends here."),
        ("<article><header><h1>Title</h1></header><p>Body &lt;b&gt;</p><aside>Side</aside><form>Mail <input></form><!-- no --></article", "Title Body <b>"),
        ("<p>cut &am", "cut &am"),
        ("<p title='a > b'>quoted <span hidden>gone</span>tag</p>", "quoted tag"),
    ],
)
def test_html_main_text(page, text):
    assert html_extract.main_text(page) == text


LINKS = "<div><a href=/>Home</a> <a href=/a>News</a> <a href=/b>Contact us</a></div>"


def paragraphs(name, count):
    return [f"{name} {i} is a paragraph of the text with a good many words in it, so that it is dense and counts." for i in range(count)]


@pytest.mark.parametrize("pieces", [
    [("h1", ["The headline of the page"]), ("p", paragraphs("lead", 1)), ("div", paragraphs("body", 10))],
    [("section", paragraphs("short", 1)), ("section", paragraphs("long", 10)), ("section", paragraphs("next", 2))],
    [("article", paragraphs("first", 2)), ("article", paragraphs("second", 8)), ("article", paragraphs("third", 1))],
    [("div><article", paragraphs("first", 2)), ("div><article", paragraphs("second", 8))],
])
def test_html_keeps_what_stands_beside_the_core(pieces):
    inner = "".join(f"<{tag}>{texts[0]}</{tag}>" if tag in ("h1", "p") else f"<{tag}>{''.join(f'<p>{t}</p>' for t in texts)}</{tag.split('<')[-1]}>" + "</div>" * ("><" in tag) for tag, texts in pieces)
    page = f"<html><body>{LINKS}{inner}{LINKS}</body></html>"
    assert html_extract.main_text(page) == " ".join(t for _, texts in pieces for t in texts)


@pytest.mark.parametrize("wrap", [
    "<article class='post has-sidebar'>{}</article>", "<div id='page' class='site no-sidebar'>{}</div>", "<article class='post comments open'>{}</article>",
    "<div class='content share'>{}</div>", "<div class='research_search x'>{}</div>", "<form id='aspnetForm'>{}<input name=q></form>", "<div class=comments>{}</div>",
])
def test_html_names_do_not_empty_an_article(wrap):
    texts = ["A title", *paragraphs("first", 1), "Words <label>in a label</label> stand in a paragraph of the article as others do."]
    furniture = "<div class='cookie-notice'>We use cookies on this site.</div><ol id=comments><li>I do not agree with any of this.</ol><footer>(c) us</footer>"
    page = f"<body>{LINKS}{wrap.format(f'<h1>{texts[0]}</h1><p>{texts[1]}</p><p>{texts[2]}</p>')}{furniture}"
    assert html_extract.main_text(page) == " ".join(texts).replace("<label>", "").replace("</label>", "")


def test_html_furniture_goes_from_within_and_beside_an_article():
    parts = paragraphs("body", 4)
    inside = "<aside>Aside text</aside><div class='ad-slot'>Buy this now, it is cheap</div><form>Mail us<input></form><div class='related-posts'><a href=/>More</a></div><script>x()</script>"
    beside = "<header><p>Site name</p></header><div role=alert>A notice to all of you</div><div class='widget sidebar'><p>Side text that goes on for a while</p></div><section class='comment-list'>" + "".join(f"<p>{t}</p>" for t in paragraphs("comment", 6)) + "</section>"
    for sections in ("<p>{}</p><p>{}</p>IN<p>{}</p><p>{}</p>", "<section><h2>{}</h2><p>{}</p></section>IN<section><p>{}</p></section>{}"):
        body = sections.replace("IN", inside).format(*parts)
        assert html_extract.main_text(f"<body>{beside}<article>{body}</article>{beside}</body>") == " ".join(parts)


def random_tree(rng, depth=0):
    kids = [] if depth > 5 else [random_tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    tag = rng.choice(["div", "section", "p", "a", "b", "span"]) if depth else "body"
    return tag, [w for kid in kids for w in (kid, "".join(rng.choice("xyz  ") for _ in range(rng.randrange(30))))] or ["text of a leaf"]


def naive_counts(tree, in_link=False):
    """Characters, tags, link characters and link tags of a tree, counted afresh for each."""
    tag, parts = tree
    chars = tags = links = link_tags = 0
    for part in parts:
        if isinstance(part, str):
            n = len(part.replace(" ", ""))
            chars, links = chars + n, links + n * (in_link or tag == "a")
        else:
            c, t, lc, lt = naive_counts(part, in_link or tag == "a")
            chars, tags, links, link_tags = chars + c, tags + t + 1, links + lc, link_tags + lt + (part[0] == "a")
    return chars, tags, links, link_tags


def test_html_densities_equal_brute_force():
    rng = random.Random(8)

    def build(tree, parent=None):
        node = html_extract.Node(tree[0], parent, 0.0)
        node.parts = [x if isinstance(x, str) else build(x, node) for x in tree[1]]
        return node

    def naive_density(tree, body):
        c, t, lc, lt = naive_counts(tree)
        if not c or lc and lc >= c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + body[2] / max(1, body[0]) * c + math.e)
        return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)) + 1e-9) / base

    for _ in range(200):
        tree = random_tree(rng)
        body = naive_counts(tree)
        todo = list(zip([tree], [build(tree)], strict=True))
        html_extract.measure(todo[0][1])
        while todo:
            plain, node = todo.pop()
            kids = [x for x in plain[1] if not isinstance(x, str)]
            assert abs(node.density - naive_density(plain, body)) < 1e-9
            assert abs(node.score - sum(naive_density(k, body) for k in kids)) < 1e-6
            todo.extend(zip(kids, [x for x in node.parts if not isinstance(x, str)], strict=True))


def test_html_repeated_rows_and_nulls(spark):
    frame = spark.createDataFrame([(None, None, "<p>a b</p>", 1), (None, None, "<p>a b</p>", 1), (3, "u", None, 2)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html_extract.extract(frame).collect()), key=str) == [(3, "u", "", 0), (None, None, "a b", 3), (None, None, "a b", 3)]


def test_html_deep_and_long(spark):
    deep = "<div>" * 5000 + "core text of the page" + "</div>" * 5000
    frame = pages(spark, [deep, "<p>" + "w " * 200_000, None, "<<<>>> & < b", "<a href=\"x>never closed"])
    rows = {r.page_id: r for r in html_extract.extract(frame).collect()}
    assert rows[0].text == "core text of the page" and rows[1].n_chars == 399_999 and rows[2].text == ""
    assert html_extract.extract(pages(spark, [])).count() == 0


# --- SimHash

def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta Gamma delta eps zeta eta theta iota".split()) for _ in range(rng.choice([2, 5, 60, 400]))) for _ in range(40)]
    texts = ODD + base + [t + " tail" for t in base] + base[:10]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(prints)
    for i in prints:
        assert got[i].fingerprint == f"{prints[i]:016x}" and got[i].component_id == want[i]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_links_in_hot_shards(spark):
    rng = random.Random(9)
    centre, values = rng.getrandbits(64), set()
    for _ in range(600):
        v = centre
        for _ in range(rng.choice([1, 2, 4, 6])):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, 3, most=16)).collect()}
    want = brute_components(dict(zip(signed, [v & (2**64 - 1) for v in signed], strict=True)))
    groups, expected = defaultdict(set), defaultdict(set)
    for v in signed:
        groups[roots.get(v, v)].add(v)
        expected[want[v]].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_keep_one_keeps_one_of_each_group(spark):
    texts = ["one two three four five six", "one two three four five six", "quite another text of its own", None, ""]
    frame = docs(spark, texts).union(docs(spark, texts[:1]))
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == [0, 2, 3]
    assert simhash.keep_one(frame).columns == frame.columns
    assert simhash.keep_one(frame.limit(0)).count() == 0


@pytest.mark.parametrize("keep", [simhash.keep_one, simhash.keep_unlike])
def test_near_dedup_keeps_columns_of_any_name(spark, keep):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (2, "other words are here to stay"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'1' as _same", "'2' as node", "'3' as id", "'4' as same", "'5' as root", "'6' as name", "'7' as hash", "'8' as none", "'9' as in", "'x' as `a.b`", "'y' as _kept")
    kept = keep(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "", r._same, r.node, r.id, r.root, r["a.b"]) for r in kept.collect()) == [(0, "", "1", "2", "3", "5", "x"), (2, rows[3][1], "1", "2", "3", "5", "x"), (4, rows[0][1], "1", "2", "3", "5", "x")]


# --- top-k

def brute_top_k(vectors, k=20):
    sound = {i: v for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max(map(len, sound.values()))
    whole = {i: np.floor(64 * np.array(list(v) + [0.0] * (width - len(v)))) for i, v in sound.items()}
    out = []
    for q in whole:
        if q % 20 == 0:
            ranked = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [(16_384, 262_144, 4096), (30, 4, 60)])
def test_top_k_equals_brute_force(spark, monkeypatch, bounds):
    for name, value in zip(("ROW_BLOCK", "QUERY_CHUNK", "SAMPLE"), bounds, strict=True):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    vectors = {i: (rng.normal(size=8) * rng.choice([0.1, 1, 3])).tolist() for i in range(200)}
    for i in range(60, 100):
        vectors[i] = vectors[60]
    vectors |= {200: None, 201: [], 202: [float("nan")] * 8, 203: [None] + [1.0] * 7, 204: [float("inf")] * 8, 220: [0.0] * 8, 221: [1.0] * 3, 240: [2.0] * 5}
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors.items()], "vec_id long, embedding array<double>, rank int, score int")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == brute_top_k(vectors)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_bounds_hold_and_prune():
    """Every level bounds every score; few pairs are left where vectors have structure, and some go even where they have none."""
    rng = np.random.default_rng(2)
    free = np.floor(64 * rng.normal(size=(4000, 64)))
    shaped = np.floor(64 * rng.normal(size=(4000, 6)) @ rng.normal(size=(6, 64)))
    for rows, share in ((shaped, 0.05), (free, 0.75)):
        turn = topk.basis(rows[:1000])
        queries, ids = rows[:100], np.arange(4000)
        scores = queries @ rows.T
        for n in topk.levels(64):
            bound = topk.statistics(queries @ turn, n) @ topk.statistics(rows @ turn, n).T
            assert (bound >= scores - 1e-3).all()
        block = topk.Block(rows, ids, turn)
        found = block.best(queries, ids[:100], np.full(100, -np.inf), 20)
        for q in range(100):
            want = sorted((-int(scores[q, c]), c) for c in range(4000) if c != q)[:20]
            assert [(-s, r) for i, r, s in found if i == q] == want
        assert block.left / block.pairs < share, block.left / block.pairs


def test_top_k_few_rows_and_large_values(spark):
    frame = spark.createDataFrame([(0, [2.0**24, 1.0]), (1, [2.0**24, 3.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 2**60 + 64 * 192), (0, 2, 3, 2**36 + 64 * 64)]


# --- mixing

def test_mixing_targets_and_bounds(spark):
    rng = random.Random(2)
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", None, "tiny"]) for _ in range(400)]
    texts = [None if i % 50 == 0 else "w " * rng.choice([1, 5, 40, 300]) for i in range(400)]
    rows = mixing.report(docs(spark, texts, sources)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 2 * r.size
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    weights = dict(zip(sorted(x for x in sizes if x) + [None], [3, 1, 2, 3, 1, 2], strict=False))
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:  # share what is left by weight until no source is above its room
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
        if not open_:
            break
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - target[s]) <= 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.report(docs(spark, texts, sources)).collect()), key=str)


def test_mix_holds_what_the_report_says(spark):
    rng = random.Random(6)
    texts = [" \t".join(f"w{i}x{k}" for k in range(rng.choice([0, 1, 7, 300]))) + rng.choice(["", "  "]) for i in range(120)] + [None, "y " * 200_000]
    frame = docs(spark, texts, [rng.choice(["a", "a", "b", None]) for _ in texts])
    report = {r.doc_id: r for r in mixing.report(frame).collect()}
    rows = mixing.ordered(frame).collect()
    taken, places = defaultdict(int), []
    for r in rows:
        row = getattr(r, "in")
        own, whole = row.text.split(), texts[row.doc_id].split()
        assert own == whole[: len(own)] and len(own) == r.words and row.n_chars == len(row.text)
        assert row.text == texts[row.doc_id] or len(own) < len(whole)
        taken[row.doc_id] += len(own)
        places.append(r.position)
    assert places == sorted(places) and all(taken[i] == report[i].taken for i in report)
    assert sum(taken.values()) > sum(r.size for r in report.values())


def test_mix_moves_texts_by_bucket_once(spark):
    """The window and the join of a bucket share one shuffle of the rows, the range sort is the other."""
    frame = docs(spark, ["a b c", "d e", "f", "g h i j"], ["a", "a", None, "b"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = mixing.mix(frame)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def exchanges(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return exchanges(node.executedPlan())
        own = [node.outputPartitioning().toString()] if node.nodeName() == "Exchange" and "in#" in node.output().toString() else []
        return own + [x for k in range(node.children().size()) for x in exchanges(node.children().apply(k))]

    moves = exchanges(plan)
    assert len(moves) == 2 and "rangepartitioning" in moves[0] and "hashpartitioning" in moves[1], moves


def test_mix_orders_by_position_and_keeps_columns(spark):
    names = [f"'{i}' as {c}" for i, c in enumerate(["_mix", "_pass", "_mix_source", "_mix_size", "position", "passes", "mix", "id", "words", "`in`", "part", "bucket", "`a.b`"])]
    frame = docs(spark, ["a b c", "d e", "f", "g h i j"], ["a", "a", "b", "b"]).selectExpr("*", *names)
    out = mixing.mix(frame)
    assert out.columns == frame.columns and out.count() >= 4
    assert {tuple(r)[-len(names) :] for r in out.collect()} == {tuple(str(i) for i in range(len(names)))}
    assert mixing.report(docs(spark, [])).count() == 0 and mixing.mix(frame.limit(0)).count() == 0
    assert {r.taken for r in mixing.report(docs(spark, [None, ""])).collect()} == {0}


# --- sharding

def brute_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding_equals_brute_force(spark):
    texts = ODD * 30
    frame = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 300, F.col("doc_id")))  # 60 rows share a null id
    rows = sharding.shard(frame, 40).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        key = int(hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert (r.shard, r.grown_shard) == (brute_jump(key, 40), brute_jump(key, 41)) and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            data = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs(spark, []), 40).count() == 0


def test_sharding_gives_copies_slots_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = sharding.shard(spark.range(100).selectExpr("5L as doc_id", "'same' as text", "id as slot"), 40).collect()
    assert sorted(r.slot for r in rows) == list(range(100)) and len({r.shard for r in rows}) == 1
