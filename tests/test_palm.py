from vellumspark.operators import palm
from vellumspark.plans.fixtures import pack, pdb


def test_other_identities(spark):
    """Read as PalmDoc if that gives text; eReader's, blank, null and empty ones give no row."""
    rows = [(1, pdb(b"OTHERxyz", [b"\0" * 16, pack(b"a <b> "), pack(b"c")])), (2, pdb(b"OTHERxyz", [b"h", b" \n "])), (3, pdb(b"PNRdPPrs", [b"h", b"text"])), (4, None), (5, b"")]
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in rows], "k int, content binary")
    assert [tuple(r) for r in palm.texts(df, "k").collect()] == [(1, "<html><body><pre>a &lt;b&gt; c</pre></body></html>")]


def test_databases(spark):
    """Literal cases: compressions, no text records, header too short, unknown identities, damaged input."""
    head = lambda c, n: bytes((c >> 8, c & 255, 0, 0, 0, 0, 0, 0, 0, n))
    rows = {
        "raw": pdb(b"TEXtREAd", [head(1, 1), b"caf\xe9 \xc1x"]), "zero": pdb(b"TEXtREAd", [head(0, 1), b"caf\xe9 x"]), "huff": pdb(b"TEXtREAd", [head(17480, 1), b"caf\xe9 x"]),
        "packed": pdb(b"TEXTTlDc", [head(2, 2), pack(b"ab "), pack(b"cd"), b"picture"]), "none": pdb(b"TEXtREAd", [head(2, 0)]), "short": pdb(b"TEXTxxxx", [b"\2", pack(b"a b")]),
        "ztxt": pdb(b"zTXTGPlm", [b"h"]), "bad": pdb(b"zTXTGPlm", [b"h", b"not zlib"]), "other": pdb(b"ABCDefgh", [b"h", b" "]), "empty": b"", "null": None, "cut": pdb(b"TEXtREAd", [head(1, 1), b"text"])[:-2],
    }
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in rows.items()], "k string, content binary")
    got = {r.k: (r.html[17:-20] if r.html else None, r.error) for r in palm.books(df, "k").collect()}
    want = {"raw": "café Áx", "zero": "café x", "huff": "café x", "packed": "ab cd", "none": "", "short": "a b", "ztxt": "", "bad": "not zlib", "cut": "te"}
    assert {k: v[0] for k, v in got.items() if v[1] is None} == want
    assert {k: v[1].split(".")[0] for k, v in got.items() if v[1]} == {"other": "Nem támogatott PDB formátum: ABCDefgh", "empty": "Nem támogatott PDB formátum: ", "null": "Nem támogatott PDB formátum: "}
    tcr = spark.createDataFrame([(1, bytearray(b"nothing")), (2, bytearray(b"!!8-Bit!!")), (3, None)], "k int, content binary")
    assert {r.k: (r.text, r.error is None) for r in palm.tcr_books(tcr, "k").collect()} == {1: (None, False), 2: ("", True), 3: (None, False)}
