"""LZX streams and LIT containers made by hand."""

import struct
import uuid

import pytest

from vellumspark.functions import lzx
from vellumspark.operators import lit


class Writer:
    """Bits as LZX has them."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""
        return self

    def done(self):
        bits = self.bits + "0" * (-len(self.bits) % 16)
        return b"".join(struct.pack("<H", int(bits[i : i + 16], 2)) for i in range(0, len(bits), 16))


def lengths(w, wanted, before=None):
    """Code lengths by a code of lengths in which all 20 symbols take five bits."""
    for _ in range(20):
        w.put(5, 4)
    for new, old in zip(wanted, before or [0] * len(wanted), strict=True):
        w.put((old - new) % 17, 5)


def canonical(wanted):
    code, out = 0, {}
    for n in range(1, 17):
        for s, length in enumerate(wanted):
            if length == n:
                out[s] = (code, n)
                code += 1
        code <<= 1
    return out


def block(kind, size, symbols, n_main, low=None):
    """One block whose main code has only the symbols in use, all of one length."""
    w = Writer().put(0, 1).put(kind, 3).put(size, 24)
    if kind == lzx.ALIGNED:
        for _ in range(8):
            w.put(3, 3)
    used = sorted({s for s, *_ in symbols} | {0xFF})
    width = max(1, (len(used) - 1).bit_length())
    main = [width if s in used else 0 for s in range(n_main)]
    lengths(w, main[:256])
    lengths(w, main[256:])
    long = [8 if s < 249 else 0 for s in range(249)]
    lengths(w, long)
    codes, of_long = canonical(main), canonical(long)
    for s, *more in symbols:
        w.put(*codes[s])
        for kind_of, value, n in more:
            w.put(*(of_long[value] if kind_of == "long" else (value, n)))
    return w.done()


N = lzx.LITERALS + 8 * lzx.slots(15)


def test_stored_block():
    data = Writer().put(0, 1).put(lzx.STORED, 3).put(5, 24).done() + struct.pack("<3I", 1, 1, 1) + b"hello" + b"\0"
    assert lzx.decompress(data, 5, 15) == b"hello"


def test_verbatim_block():
    a, b = 97, 98
    # ab, then a match of 4 at distance 2 (slot 4: base 4, one bit; 4 - 2 = 2), then the repeated offset for 2, then 300 more.
    symbols = [(a,), (b,), (256 + 4 * 8 + 2, ("bits", 0, 1)), (256 + 0,), (256 + 7, ("long", 200, 0))]
    assert lzx.decompress(block(lzx.VERBATIM, 8 + 209, symbols, N), 8 + 209, 15) == (b"ab" * 200)[: 8 + 209]


def test_aligned_block():
    # slot 8: base 16, three bits by the aligned code; distance 16 - 2 + 3 = 17.
    text = bytes(range(65, 82))
    symbols = [(c,) for c in text] + [(256 + 8 * 8 + 5, ("bits", 3, 3))]
    assert lzx.decompress(block(lzx.ALIGNED, 24, symbols, N), 24, 15) == text + text[:7]


@pytest.mark.parametrize("data, fault", [(Writer().put(0, 1).put(7, 3).put(1, 24).done(), "block type"), (block(lzx.VERBATIM, 2, [(256,)], N), "before the start")])
def test_bad_streams(data, fault):
    with pytest.raises(lzx.LzxError, match=fault):
        lzx.decompress(data, 2, 15)
    with pytest.raises(lzx.LzxError, match="window"):
        lzx.decompress(b"", 0, 22)


def test_calls():
    body = b"\xe8" + struct.pack("<i", 100) + bytes(20)
    data = Writer().put(1, 1).put(1000, 32).put(lzx.STORED, 3).put(len(body), 24).done() + struct.pack("<3I", 1, 1, 1) + body + b"\0"
    assert lzx.decompress(data, len(body), 15) == body  # at place 0 the distance is the target
    shifted = bytes(5) + body
    data = Writer().put(1, 1).put(1000, 32).put(lzx.STORED, 3).put(len(shifted), 24).done() + struct.pack("<3I", 1, 1, 1) + shifted
    assert lzx.decompress(data, len(shifted), 15)[6:10] == struct.pack("<i", 95)


def number(n):
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def container(files, sections=(), per_chunk=3):
    """A LIT file; files: name -> (section, bytes), of which section 0 lies in the content."""
    content, entries, within = b"", [], {}
    for name, (section, data) in files.items():
        at = within.get(section, 0)
        if section == 0:
            at, content = len(content), content + data
        else:
            within[section] = at + len(data)
        entries.append((name, section, at, len(data)))
    size = 2048
    chunks = b""
    for k in range(0, len(entries), per_chunk):
        body = b"".join(number(len(n.encode())) + n.encode() + number(s) + number(o) + number(z) for n, s, o, z in entries[k : k + per_chunk])
        chunks += (b"AOLL" + struct.pack("<I", size - 44 - len(body)) + bytes(36) + body).ljust(size - 2, b"\0") + struct.pack("<H", len(entries[k : k + per_chunk]))
    directory = b"IFCM" + struct.pack("<IIII", 1, size, 0, 0) + bytes(4) + struct.pack("<II", len(chunks) // size, 0) + chunks
    header = 40
    second = b"CAOL" + bytes(20)
    begin = header + 32 + len(second) + 28
    second += b"ITSF" + bytes(12) + struct.pack("<II", begin + 8 + len(directory), 0) + bytes(4)
    head = b"ITOLITLS" + struct.pack("<IIII", 1, header, 2, len(second)) + bytes(16)
    places = struct.pack("<IIII", begin, 0, 8, 0) + struct.pack("<IIII", begin + 8, 0, len(directory), 0)
    return head + places + second + bytes(8) + directory + content


def names(*found):
    return struct.pack("<HH", 0, len(found)) + b"".join(struct.pack("<H", len(n)) + (n + "\0").encode("utf-16-le") for n in found)


def manifest(**states):
    out = b"\x01r"
    for state in lit.STATES:
        items = states.get(state.replace(" ", "_"), [])
        out += struct.pack("<I", len(items)) + b"".join(struct.pack("<I", 0) + b"\0".join(x.encode() for x in i) + b"\0" for i in items)
    return out + b"\0"


TAGS = lit.Tags({1: "html", 2: "body", 3: "h2", 4: "p", 5: "a"}, {5: {1: "href", 2: "%guid"}}, {0x8046: "title"})


def element(code, inside="", **attrs):
    out = f"\0\x01{chr(code)}"
    for k, v in attrs.items():
        out += chr(int(k[1:])) + chr(len(v) + 1) + v
    return out + "\0" + inside + "\0\x02\0"


META = lit.Tags({1: "package", 2: "dc:Title", 3: "dc:Creator"})


def book(**more):
    one = element(1, element(2, element(3, " Első ") + element(4, "a < é &amp;" + element(5, "link", _1="1#x", _2="zz"), _32838='say "hi"'))).encode()
    two = element(1, element(2, element(4, "no heading"))).encode()
    stored = Writer().put(0, 1).put(lzx.STORED, 3).put(len(two), 24).done() + struct.pack("<3I", 1, 1, 1) + two + b"\0"
    path = lit.STORAGE + "S"
    packed = {f"{path}/Content": (0, stored), f"{path}/ControlData": (0, bytes(12) + struct.pack("<I", 1)), f"{path}/Transform/List": (0, uuid.UUID(lit.PACKED).bytes_le),
        f"{path}/Transform/{lit.PACKED}/InstanceData/ResetTable": (0, bytes(12) + struct.pack("<IIII", 32, len(two), 0, len(stored)) + bytes(12) + struct.pack("<II", 0, 0))}
    files = {
        lit.NAMES: (0, names("Uncompressed", "S")), "/manifest": (0, manifest(spine=[("i1", "C:\\book\\a.htm", "Text/HTML"), ("i2", "C:\\book\\b.htm", "text/html"), ("i9", "C:\\book\\gone.htm", "text/html")], css=[("c1", "C:\\book\\s\\x.css", "text/css")])),
        "/meta": (0, element(1, element(2, "Title < x") + element(3, "Some One")).encode()), "/data/i1/content": (0, one), "/data/c1": (0, b"p{}"), **packed, "/data/i2/content": (1, two),
    }
    return container(files | more)


def test_books(spark):
    rows = {"a.lit": book(), "drm.LIT": book(**{lit.LICENCES[0]: (0, b"x")}), "no": b"PK", "v": b"ITOLITLS" + struct.pack("<I", 2), "cut": book()[:300], "nul": None, "empty": b""}
    df = spark.createDataFrame([(k, None if c is None else bytearray(c), "clash") for k, c in rows.items()], "name string, content binary, title string")
    got = {r.name: r for r in lit.books(df, "name", html=TAGS, meta=META).collect()}
    a = got["a.lit"]
    assert (a.title, a.author, a.error) == ("Title &lt; x", "Some One", None)
    assert [tuple(t) for t in a.toc] == [("lit-0", "Első", 2)]
    assert a.html == '<html><head>\n<title>Title &lt; x</title>\n<style>p{}</style>\n</head><body>\n<h2> Első </h2><p title="say &quot;hi&quot;">a &lt; é &amp;<a href="#x">link</a></p>\n<p>no heading</p>\n</body></html>'
    assert {k: r.error for k, r in got.items() if k != "a.lit"} == {"drm.LIT": lit.PROTECTED, "no": "Not a valid LIT file", "v": "Unknown LIT version 2", "cut": "No NameList in LIT file", "nul": None, "empty": "Not a valid LIT file"}
    found = lit.containers(df.where("name = 'a.lit'")).select("lit.*").first()
    assert [(i.internal, i.state, i.path, i.mime_type, i.error) for i in found["items"]] == [("i1", "spine", "a.htm", "text/html", "no tables of markup codes"), ("i2", "spine", "b.htm", "text/html", "no tables of markup codes"), ("i9", "spine", "gone.htm", "text/html", None), ("c1", "css", "s/x.css", "text/css", None)]
    assert len(found.entries) == 10


def test_parts():
    assert lit.variable(b"\x81\x00x", 0) == (128, 2) and lit.variable(b"", 0) == (0, 0)
    assert lit.guid(uuid.UUID(lit.PACKED).bytes_le) == lit.PACKED
    assert [lit.common_folder(p) for p in (["a/b/c", "a/b/d"], ["a", "b"], ["x/y", "x/y"], ["ab", "ac"])] == [4, 0, 3, 0]
    with pytest.raises(lit.LitError, match="Unknown tag 9"):
        lit.marked_up(element(9).encode(), TAGS)
    assert lit.marked_up("a\0\x03\x04\0b\0\x01\x04\0open".encode(), TAGS) == "a<p />b<p>open</p>"


@pytest.mark.parametrize("n", range(0, 3000, 97))
def test_cut_files_give_errors_not_crashes(n):
    found = lit._open(book()[:n], TAGS, META)
    assert found["error"] or found["items"] is not None
