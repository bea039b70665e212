"""Secrets, pages and MPEG audio against brute force and exact round trips."""

import random
import re

import pytest

from broadsheet.llm import extract, media, secrets

# Secrets.


def brute_spans(t):
    """The base kinds by the patterns as they are written."""
    out = []
    letters = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password")
    assert letters
    any_case = secrets.ASSIGN
    for name in ("password", "passwd", "secret", "token", "api", "key"):
        any_case = re.sub(rf"(?<![a-zA-Z\[]){name}", "".join(f"[{c.upper()}{c}]" for c in name), any_case)
    for kind, pattern in (("assign", any_case), ("access", secrets.ACCESS), ("hex", secrets.HEX)):
        for m in re.finditer(pattern, t):
            if len(m[2] if kind == "assign" else m[0]) >= secrets.LEAST[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


@pytest.fixture(scope="module")
def count(vocabulary):
    return secrets.Counter(*vocabulary)


def test_base_spans(count):
    rng = random.Random(1)
    bits = ["token", "PassWord", "api_key", "apikey", "key", "secret", "passwd", "=", ":", " ", "  ", '"', "'", "abc", "deadbeef" * 4, "AKIA" + "A1" * 8, "AKIA", "x" * 8, "12345678", "\n", "é", "ſecret", "toKen"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert [s for s in secrets.scan_text(t, count) if s[0] != "random"] == brute_spans(t), t


def test_random_strings(count):
    hits = ["ghp_x7Kd92LmQp4ZtVwB8nRfYc3HsJ6a", "q9Xv2LmZ7tKp4WbR8nYc"]
    misses = ["3f2504e0-4f89-11d3-9a0c-0305e82c3301", "internationalisation_of_standards", "2024-01-02-03-04-05-06-07", "D41D8CD98F00B204E9800998ECF8427E", "thandbleentioninging", "getElementsByTagNameNS", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    for t in hits:
        assert [s[0] for s in secrets.scan_text(f"see {t} here", count)] == ["random"], t
    for t in misses:
        assert secrets.scan_text(f"see {t} here", count) == [], t


def test_random_strings_of_any_letters(count):
    rng, found = random.Random(9), 0
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]
    for k in range(400):
        run = "".join(rng.choice(alphabets[k % 4]) for _ in range(rng.choice([20, 32, 40])))
        found += [s[0] for s in secrets.scan_text(f"see {run} here", count)] == ["random"]
    assert found >= 0.97 * 400
    for name in ("MAX_SUB_COMMAND_LENGTH", "ARRAY_CREATE_SUB_COMMAND_NAME", "sendMessageToEveryUser2", "a/path/of/several/words"):
        assert secrets.scan_text(name, count) == [], name


def test_long_texts_with_many_spans(count):
    text = "token=abcdefgh0123 " * 20_000 + "q9Xv2LmZ7tKp4WbR8nYc"
    spans = secrets.scan_text(text, count)
    assert len(spans) == 20_001 and spans[-1][0] == "random"


def test_scan_and_redact(docs, vocabulary):
    texts = [None, "", "nothing here", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "é token: abcdefgh é", "a", "a"]
    df = docs(texts)
    got = {r.doc_id: r.spans for r in secrets.scan(df, *vocabulary).collect()}
    assert [len(got[i]) for i in range(7)] == [0, 0, 0, 2, 1, 0, 0] and tuple(got[4][0]) == ("assign", 2, 17)
    clean = {r.doc_id: r.text for r in secrets.redact(df, *vocabulary).collect()}
    assert [clean[i] for i in range(7)] == [None, "", "nothing here", '[SECRET]" end', "é [SECRET] é", "a", "a"]
    assert secrets.scan(docs([]), *vocabulary).count() == 0
    with pytest.raises(ValueError):
        secrets.scan(df, *vocabulary, out="word")


# Pages.

ARTICLE = "<h1>Title &amp; more</h1><p>First  para\n graph.<br>Next</p><p><b>Bold<p>wo<i>rd</i>"
PAGES = {
    "whole": (f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a>Home page link</a></li></ul></nav><div class='ad'>Buy this thing now please</div><article>{ARTICLE}</article><footer>&copy; us and others</footer></body></html>", "Title & more\n\nFirst para graph. Next\n\nBold\n\nword"),
    "cut": (f"<body><nav><a>x</a></nav><article>{ARTICLE}</article><foot", "Title & more\n\nFirst para graph. Next\n\nBold\n\nword"),
    "inside": ("<article><h1>A b</h1><p>One two three.</p><aside>Related things here</aside><form><p>Sign up now</p></form><p>Four five.</p><div class='comments'><p>I think so too</p></div></article>", "A b\n\nOne two three.\n\nFour five."),
    "plain": ("<body><ul><li><a>a</a><li><a>b</a></ul><div><p>Some longer text stands here.</p><p>And a second paragraph too.</p></div><div class='footer'>f g</div></body>", "Some longer text stands here.\n\nAnd a second paragraph too."),
    "comment": ("<article><p>Seen <!-- not <p>seen</p> --> text.</p><!-- open <p>x</p>", "Seen text."),
    "nothing": ("<nav><a>a</a></nav>", ""), "empty": ("", ""), "null": (None, ""), "text": ("just words", "just words"), "reference": ("<p>&#233;&eacute;&nbsp;&am</p>", "éé &am"),
}


def test_pages(spark):
    df = spark.createDataFrame([(k, None, p) for k, (p, _) in PAGES.items()] + [("whole", "again", PAGES["whole"][0])], "page_id string, url string, html string")
    costs, default = extract.learn(df)
    got = extract.extract(df, costs, default).collect()
    assert len(got) == len(PAGES) + 1
    for r in got:
        assert r.text == PAGES[r.page_id][1], r.page_id
    assert extract.extract(df.limit(0), costs, default).count() == 0
    bare = extract.learn(df.limit(0))
    assert extract.main_text(PAGES["plain"][0], *bare) == PAGES["plain"][1]
    with pytest.raises(ValueError):
        extract.extract(df, costs, default, out="url")


def test_best_run_against_all_runs():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-2, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        low, high = extract.best_run(s)
        best = max((sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)
        assert sum(s[low:high]) == max(best, 0)


# Audio.


def test_payloads_round_trip():
    rng = random.Random(3)
    for n in [0, 1, 64, 100, 121, 122, 1416, 1417, 1418, 5000, 200_000]:
        payload = rng.randbytes(n)
        stream = media.store_payload(payload)
        found = media.parse(stream)
        assert found["payload"] == payload and found["bad_checksums"] == found["lost_bytes"] == 0
        assert found["frames"] == found["table_frames"] == len(found["seek_offsets"]) and found["samples"] == 1152 * found["frames"]
        assert found["duration_num"] * 32000 == found["samples"] * found["duration_den"]
        assert found["table_bytes"] == len(stream) - media._read_tag(stream)[0]
        assert all(media.parse_header(stream[o : o + 4]) for o in found["seek_offsets"])


def test_fake_headers_in_a_payload():
    payload = media.frame_head(14)[:4] * 3000
    assert media.parse(media.store_payload(payload))["payload"] == payload


def test_damage():
    payload = random.Random(4).randbytes(6000)
    stream = media.store_payload(payload)
    offsets = media.parse(stream)["seek_offsets"]
    flipped = bytearray(stream)
    flipped[offsets[1] + 10] ^= 1  # side information, under the checksum
    assert media.parse(bytes(flipped))["bad_checksums"] == 1
    noisy = stream[: offsets[2]] + b"\x00noise\xff\xfa" + stream[offsets[2] :]
    found = media.parse(noisy)
    assert found["payload"] == payload and found["lost_bytes"] == 8
    broken = bytearray(stream)
    broken[offsets[1]] = 0
    assert media.parse(bytes(broken))["frames"] == len(offsets) - 1
    assert media.parse(stream[:-10])["frames"] == len(offsets) - 1


def test_crc_by_the_polynomial():
    def divide(data):
        register = 0xFFFF
        for bit in "".join(f"{b:08b}" for b in data):
            top = register >> 15 ^ int(bit)
            register = (register << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        return register

    for data in (b"", b"\x00", b"123456789", bytes(range(40))):
        assert media.crc16(data) == divide(data)


def test_columns(spark):
    df = spark.createDataFrame([(1, b"abc", "w"), (2, None, None), (2, None, None), (None, b"", "w")], "doc_id long, payload binary, word string")
    rows = media.read_back(media.store(df)).collect()
    assert len(rows) == 4 and all(bytes(r.audio.payload) == bytes(r.payload or b"") for r in rows)
    assert media.read_back(spark.createDataFrame([(None,), (b"",), (b"junk",)], "media binary")).filter("audio.frames = 0").count() == 3
    assert media.store(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "second, rate, bits, samples",
    [(0xFD, 44100, 8, 1152), (0xFF, 44100, 8, 384), (0xF3, 22050, 8, 576), (0xE3, 11025, 8, 576), (0xF5, 24000, 8, 1152), (0xFB, 44100, 9, 1152)],
)
def test_other_versions_and_layers(second, rate, bits, samples):
    # Version 1 Layers II and I, version 2 Layer III, 2.5 Layer III, version 2 Layer II, version 1 Layer III, all without checksum.
    third = bits << 4 | (1 if rate in (24000, 48000) else 0) << 2
    head = media.parse_header(bytes((0xFF, second, third, 0xC0)))
    kbps = head.kbps
    assert head.rate == rate and head.samples == samples and not head.checked
    assert head.length == (12000 * kbps // rate * 4 if head.layer == 1 else samples // 8 * 1000 * kbps // rate)
    frame = bytes((0xFF, second, third, 0xC0)).ljust(head.length, b"\0")
    found = media.parse(frame * 5 + b"TAG" + bytes(125))
    assert (found["frames"], found["samples"], found["lost_bytes"], found["seek_offsets"][1]) == (5, 5 * samples, 0, head.length)
    assert found["duration_num"] * rate == found["samples"] * found["duration_den"]


def test_layer_one_checksum_and_tables():
    header = bytes((0xFF, 0xFE, 0x80, 0xC0))
    allocation = bytes(range(16))
    crc = media.crc16(header[2:] + allocation).to_bytes(2, "big")
    size = media.parse_header(header).length
    frame = (header + crc + allocation).ljust(size, b"\0")
    broken = bytearray(frame)
    broken[8] ^= 1
    found = media.parse(frame + bytes(broken) + frame)
    assert (found["frames"], found["bad_checksums"], found["lost_bytes"]) == (3, 1, 0)
    plain = bytes((0xFF, 0xFB, 0x90, 0x00))
    size = media.parse_header(plain).length
    table = (plain.ljust(media.VBRI_AT, b"\0") + b"VBRI" + bytes(6) + (3 * size).to_bytes(4, "big") + (2).to_bytes(4, "big")).ljust(size, b"\0")
    # An ID3v2.4 tag: sizes of seven bits a byte, text in UTF-8.
    text = b"\x03payload_bytes\x005" + bytes(150)
    tag_frame = b"TXXX" + media._syncsafe(len(text)) + b"\0\0" + text
    stream = b"ID3\x04\0\0" + media._syncsafe(len(tag_frame)) + tag_frame + table + plain.ljust(size, b"x") * 2
    assert media._read_tag(stream)[1]["payload_bytes"].startswith("5")
    found = media.parse(stream)
    assert (found["frames"], found["table_frames"], found["table_bytes"], found["lost_bytes"]) == (2, 2, 3 * size, 0)
