"""Page text on written templates; MPEG audio by round trips and damaged streams."""

import hashlib
import os
import random
import struct
import zlib

import pytest

from heliograph.llm import html_text, mpeg_audio
from heliograph.llm.mpeg_audio import crc16, header, load, pad, parse, store

P1 = "The first paragraph says a lot, and it says it with commas, and stops. It goes on for a while."
P2 = "A second paragraph follows; it is not short either, and it ends the way the first one did."


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy now, buy more, buy all.</div><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; x</footer>",
        f"<header><h1>Site</h1></header><main><h1>Title</h1><p>{P1}<p>{P2}</main><aside>Also, read this long and punctuated note, please. It is long.</aside>",
        f"<div id='cookie-notice'><p>We use cookies, as all do. Accept them, please, all of them.</p></div><article><header><h1>Title</h1></header><p>{P1}</p><form><label>Mail</label><input></form><p>{P2}</p><section class='comments'><p>Reader says: {P1}</p></section></article>",
        f"<div class='content'><h2>Title</h2><p>{P1}</p><p>{P2}</p></div><div class='sidebar'><p>{P1}</p></div><ul><li>one</li><li>two</li></ul>",
        f"<script>var t=\"</p>\";if(a<b)x()</script><article><h1>Title</h1><p><b>{P1}<br><p>{P2}</p></article><style>p{{}}</style><!-- <p>no</p> -->",
    ],
)
def test_article_alone(body):
    assert html_text.main_text(page(body)) == f"Title\n{P1}\n{P2}"


def test_entities_space_and_broken_markup():
    text = html_text.main_text("<article><p>a &amp; b&nbsp;&lt;c&gt;\n\n  d &#233;&hearts; &copy <i>e</i>f</p><p>x<p>y</div></article>")
    assert text == "a & b <c> d é♥ © ef\nx\ny"
    assert html_text.main_text('<article><p title="a > b">in</p><p>cut &am') == "in\ncut &am"
    assert html_text.main_text("<p>1 < 2 and <b>3</p>") == "1 < 2 and 3"
    assert html_text.main_text("<" * 5000) in ("", "<" * 5000)
    assert html_text.main_text('<a href="' * 3000) == ""


@pytest.mark.parametrize("value", [None, "", "   ", "<html></html>", "<nav>only a menu</nav>"])
def test_pages_without_text(value):
    assert html_text.main_text(value) == ""


def test_threshold_and_smoothing():
    found = html_text.blocks(f"<div class='x'><span>a</span></div><div class='y'><p>{P1}</p><p>{P2}</p></div>")
    assert [b.path for b in found] == ["/div.x", "/div.y/p", "/div.y/p"]
    assert [b.text for b in html_text.select(found)] == [P1, P2]
    assert html_text.select([]) == []


@pytest.mark.parametrize(
    ("inside", "expect"),
    [
        ("<p>P</p><svg/><p>P</p>", "P|P"),
        ("<p>P</p><svg><path d='M0'/><text>no</text></svg><p>P</p>", "P|P"),
        ("<p>P</p><select><option>a<option>b<p>P</p>", "P|P"),
        ("<p>P</p><section id='discussion'><h2>Discussion</h2><p>P</p></section>", "P|Discussion|P"),
        ("<div class='legal-history'><p>P</p><p>Short.</p></div><div class='share-price'><p>It rose.</p></div><div class='social-science'><p>P</p></div>", "P|Short.|It rose.|P"),
        ("<p>P <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><noscript><p>P</p></noscript>", "P x=1|P"),
        # the ratios decide inside the article: lists of short links go, lists of text stay
        ("<p>P</p><ul><li><a href=a>One more</a></li><li><a href=b>And another</a></li><li><a href=c>Read on</a></li></ul><p>P</p>", "P|P"),
        ("<p>P</p><ol><li>first</li><li>second</li><li>third <a href=x>y</a></li></ol>", "P|first|second|third y"),
        ("<p>P</p><div class='share-buttons'><span>Tweet</span></div><div class='related-posts'><p>More of it</p></div><p>P</p>", "P|P"),
    ],
)
def test_markup_and_doubtful_labels_inside_an_article(inside, expect):
    words = "This is a long sentence of the story, with commas, and it goes on for quite some time."
    fill = lambda x: x.replace("P", words)
    got = html_text.main_text(page(f"<article>{inside.replace('>P', f'>{words}')}</article>"))
    assert got == fill(expect).replace("|", "\n")


def test_ratios_equal_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        parts = [f"<div class='c{rng.randrange(3)}'><p>{' '.join(rng.choice(['a,', 'bcd', 'efghij.', '<a href=x>link</a>']) for _ in range(rng.randrange(1, 30)))}</p></div>" for _ in range(rng.randrange(2, 12))]
        found = html_text.blocks(page("".join(parts)))
        paths, fused = html_text.path_ratios(found)
        nodes = {p: [b for b in found if b.path == p] for p in paths}
        plain = {p: sum(len(b.text) - b.linked for b in own) / len(own) for p, own in nodes.items()}
        marks = {p: sum(b.text.count(",") + b.text.count(".") for b in own) / len(own) for p, own in nodes.items()}

        def smooth(ratio, i, found=found):
            weights = {}
            for j, b in enumerate(found):
                if abs(i - j) <= 2:
                    x, y = found[i].path.split("/")[1:], b.path.split("/")[1:]
                    same = next((k for k, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y))) / max(len(x), len(y))
                    weights[j] = 2.718281828459045 ** (-((i - j) ** 2) / 2) * same
            return sum(w * ratio[found[j].path] for j, w in weights.items()) / sum(weights.values())

        for p in paths:
            want = sum((plain[p] * smooth(plain, b.order)) ** 0.5 * ((1 + marks[p]) * (1 + smooth(marks, b.order))) ** 0.5 for b in nodes[p]) / len(nodes[p])
            assert fused[p] == pytest.approx(want)


LONG = "".join(f"<p>{P1} {P2} {P1}</p>" for _ in range(6))


@pytest.mark.parametrize(
    "extra",
    [f"<section class='comments'>{LONG}</section>", "<div class='notice'><p>We use cookies, as all sites do, for statistics. By reading on, you agree.</p></div>", f"<div class='notice'>{LONG}</div>", f"<div class='ad-slot'>{LONG}</div>", f"<div class='ad'><div class='banner'>{LONG}</div></div>"],
)
def test_length_does_not_outweigh_a_label(extra):
    short = [f"Short paragraph number {i}." for i in range(8)]
    body = f"<article><h1>Title</h1>{''.join(f'<p>{x}</p>' for x in short[:4])}{extra}{''.join(f'<p>{x}</p>' for x in short[4:])}</article>"
    assert html_text.main_text(page(body)) == "\n".join(["Title", *short])


def test_the_best_path_decides_without_labels():
    text = "".join(f"<p>{P1} {P2}</p>" for _ in range(4))
    bare = f"<div>Home | About | Contact</div><div><h1>Title</h1>{text}</div><div>Copyright 2020 Example Inc. All rights reserved.</div>"
    assert html_text.main_text(page(bare)) == "\n".join(["Title", *[f"{P1} {P2}"] * 4])
    # a page that is all within a label has nothing better
    assert html_text.main_text(page(f"<div class='has-sidebar'>{text}</div>")) == "\n".join([f"{P1} {P2}"] * 4)
    # and a short teaser in an article does not push the text out
    assert html_text.main_text(page(f"<article><p>Read more</p></article><div>{text}</div>")).endswith("\n".join([f"{P1} {P2}"] * 4))


def test_weighed_ratios_equal_brute_force():
    rng = random.Random(6)
    labels = ["", "", " class='notice'", " class='comments'", " class='discussion'", " class='x'"]
    for _ in range(60):
        parts = [f"<div{rng.choice(labels)}><p>{' '.join(rng.choice(['a,', 'bcd', 'efghij.']) for _ in range(rng.randrange(1, 40)))}</p></div>" for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), f"<article><p{rng.choice(labels)}>{'word, ' * rng.randrange(1, 9)}</p></article>")
        paths, free = html_text.path_ratios(html_text.blocks(page("".join(parts))))
        label = {p: paths[p].weight / (10 if paths[p].body else 1) for p in paths}
        strict = {p: paths[p].weight if label[p] > 0.1 else min(paths[p].weight, 0.2 if paths[p].body else 0.02) for p in paths}
        best = next(p for p in paths if all(free[p] * strict[p] >= free[q] * strict[q] for q in paths))
        want = {p: paths[p].weight * (free[p] if free[p] < free[best] else free[best]) for p in paths}
        assert html_text._judged(paths, free) == pytest.approx(want)


def test_labels_and_end_tags_count_at_any_depth():
    deep = 2 * html_text.DEEP
    text = html_text.main_text(page(f"{'<div>' * deep}<nav>menu</nav><div class='comments'><p>{P2}</p></div><p>{P1}</p>{'</div>' * deep}<p>{P2}</p>"))
    assert text == f"{P1}\n{P2}"


def test_hostile_pages_do_not_stall():
    import time

    for text in ("<div class='" * 80_000, "<select>" * 120_000, "<svg>" * 200_000 + "<p>x", "<p>" * 300_000 + "end", "<a href=x>" * 90_000, "<div><p>x" * 100_000, "&amp;" * 200_000, "<p><b>" + "<b>" * 600 + "<h1>x</h1>" * 50_000, "<b>" * 50_000 + "</p>" * 50_000, "<div>" * 90_000 + "</x>" * 90_000, "<span><div>" + "<b>" * 100_000 + "</span>" * 80_000, "<dt><dd>" * 100_000):
        began = time.perf_counter()
        html_text.main_text(text)
        assert time.perf_counter() - began < 20, text[:10]


def test_extract_column(spark):
    df = spark.createDataFrame([(1, "u", page(f"<article><p>é{P1}</p></article>"), "old"), (2, "u", None, "old"), (2, "u", None, "old")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in rows] == [("é" + P1, len(P1) + 1), ("", 0), ("", 0)]
    assert html_text.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 384, 100_000])
def test_round_trip(n):
    raw = os.urandom(n)
    payload = pad(raw)
    assert len(payload) % 192 == 0
    assert len(payload) >= 192
    assert payload[:n] == raw
    assert set(payload[n:]) <= {32}
    media = store(payload, n)
    audio = parse(media)
    assert load(media) == (payload, n)
    frames = len(payload) // 192
    assert (len(audio.offsets), audio.samples, audio.crc_bad, audio.crc_good, audio.skipped, audio.resyncs) == (frames, 1152 * frames, 0, frames + 1, 0, 0)
    assert audio.duration_us == frames * 36_000
    assert (audio.table, audio.table_frames, audio.table_bytes) == ("Info", frames, 216 * (frames + 1))
    assert all(media[o : o + 2] == b"\xff\xfa" for o in audio.offsets)
    assert audio.toc == sorted(audio.toc)


def plain_frames(n, word=b"\xff\xfb\x90\x00", fill=b"\0"):
    h = header(word)
    return b"".join(word + fill * (h.size - 4) for _ in range(n))


def test_resynchronises_after_damage_and_finds_false_syncs():
    stream = plain_frames(5)
    size = header(b"\xff\xfb\x90\x00").size
    assert size == 417
    damaged = stream[: 2 * size] + b"junk\xff\xfb\x90" + stream[2 * size :]
    audio = parse(b"noise\xff\xe0" + damaged)
    assert len(audio.offsets) == 5
    assert audio.resyncs == 1
    assert audio.skipped == 14
    cut = parse(stream[:-100])
    assert len(cut.offsets) == 4
    assert cut.truncated
    assert parse(b"").header is None
    assert parse(os.urandom(50)).samples == 0


def test_variable_rate_tables_and_tags():
    low, high = b"\xff\xfb\x50\x00", b"\xff\xfb\xb0\x00"
    h = header(low)
    first = bytearray(plain_frames(1, low))
    at = 4 + h.side_bytes
    first[at : at + 116] = b"Xing" + struct.pack(">III", 7, 9, 5000) + bytes(range(100))
    title = b"TIT2" + struct.pack(">I", 6) + b"\0\0" + b"\x03Hello"
    tag = b"ID3\x03\0\0" + bytes([0, 0, 0, len(title)]) + title
    end = b"TAG" + b"Song".ljust(30, b"\0") + bytes(95)
    audio = parse(tag + bytes(first) + plain_frames(2, low) + plain_frames(1, high) + end)
    assert (audio.table, audio.table_frames, audio.table_bytes, len(audio.toc)) == ("Xing", 9, 5000, 100)
    assert len(audio.offsets) == 3
    assert audio.variable
    assert audio.tags["TIT2"] == "Hello"
    assert audio.tags["ID3v1:title"] == "Song"
    vbri = bytearray(plain_frames(1, low))
    vbri[36:68] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 7777, 12, 2, 10, 2, 1) + struct.pack(">HH", 3, 4) + b"\0\0"
    audio = parse(bytes(vbri) + plain_frames(2, low))
    assert (audio.table, audio.table_bytes, audio.table_frames, audio.toc) == ("VBRI", 7777, 12, [30, 40])


def test_checksums():
    media = bytearray(store(pad(b"x" * 400), 400))
    at = parse(bytes(media)).offsets[1]
    media[at + 10] ^= 1
    audio = parse(bytes(media))
    assert (audio.crc_bad, audio.crc_good) == (1, 3)

    def slow(data):
        c = 0xFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                top = c >> 15 ^ (byte >> bit & 1)
                c = c << 1 & 0xFFFF ^ (0x8005 if top else 0)
        return c

    rng = random.Random(1)
    for _ in range(50):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        assert crc16(data) == slow(data)


@pytest.mark.parametrize(
    ("word", "size", "samples", "rate"),
    [(b"\xff\xfb\x90\x00", 417, 1152, 44100), (b"\xff\xfb\x92\x00", 418, 1152, 44100), (b"\xff\xfd\x84\xc0", 384, 1152, 48000), (b"\xff\xff\x18\x00", 48, 384, 32000), (b"\xff\xf3\x80\xc0", 208, 576, 22050), (b"\xff\xe3\x40\xc0", 208, 576, 11025)],
)
def test_header_sizes(word, size, samples, rate):
    h = header(word)
    assert (h.size, h.samples, h.rate) == (size, samples, rate)
    assert header(b"\xff\xfb\xf0\x00") is None
    assert header(b"\xff\xfb\x9c\x00") is None


def test_columns(spark):
    texts = ["héllo", None, "", "héllo", "y" * 5000]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = mpeg_audio.digest_column(mpeg_audio.store_column(df)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert rows[0].feature == rows[3].feature
    assert rows[0].media == rows[3].media
    parsed = mpeg_audio.parse_column(spark.createDataFrame([(1, bytearray(store(pad(b"a"), 1)), "x"), (2, None, "x"), (3, bytearray(b"zz"), "x")], "id long, media binary, tags string")).orderBy("id").collect()
    assert parsed[0].seek_offsets == [parsed[0].media.find(b"\xff\xfa", 230)]
    assert parsed[0].tags == {"TXXX:payload-bytes": "1"}
    assert parsed[1].frames is None
    assert (parsed[2].frames, parsed[2].audio_layer) == (0, None)


@pytest.mark.parametrize(
    ("page", "expect"),
    [
        ("<html><body class='single has-sidebar'><div class='main'><h1>T</h1><p>P</p><p>P</p></div><div class='sidebarRight'>x y z</div></body>", "T|P|P"),
        ("<body><div class='site-header'>S</div><article><div class='entry-header'><h1>T</h1></div><p>P</p><ol class='commentlist'><li>P</li></ol></article></body>", "T|P"),
        ("<body><div class='navBar'>Home</div><div id='content'><h2>T</h2><p>P</p><div class='CookieBanner'><p>P</p></div></div></body>", "T|P"),
        ("<body><main class='page-menu'><p>P</p><p style='visibility: hidden'>P</p></main></body>", "P"),
        ("<body><table><tr><td><ul><li><a href='/'>x</a></ul></td><td><p>P<p>P</td></tr></table></body>", "P|P"),
    ],
)
def test_labels_and_links_around_the_article(page, expect):
    words = "This is a long sentence of the story, with commas, and it goes on for quite some time."
    assert html_text.main_text(page.replace(">P<", f">{words}<")) == expect.replace("P", words).replace("|", "\n")


@pytest.mark.parametrize("units", [1, 2, 5])
@pytest.mark.parametrize(("at", "mark"), [(65, b"TAG"), (161, b"APETAGEX"), (161, b"APETAGEX2000" + b"0" * 12), (161, b"APETAGEX" + b"2000\x38\x04\0\0" + b"\0" * 8)])
def test_marks_of_tags_in_the_text_are_text(units, at, mark):
    text = b"x" * (192 * (units - 1) + at) + mark
    media = store(pad(text), len(text))
    assert media[len(media) - {3: 128}.get(len(mark), 32) :].startswith(mark)
    assert load(media) == (pad(text), len(text))
    assert not parse(media).truncated
    # a tag after such frames is still one
    tagged = parse(media + b"TAG" + b"title".ljust(125, b"\0"))
    assert tagged.tags["ID3v1:title"] == "title"
    assert len(tagged.offsets) == units and not tagged.truncated
