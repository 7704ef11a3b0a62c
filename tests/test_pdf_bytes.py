"""Signatures and metadata of PDFs as their bytes have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.operators import authenticity


def made(value: bytes, more: bytes = b"") -> bytes:
    return b"%PDF-1.7\n12 0 obj << /Producer (wrong) >> endobj\n2 0 obj\n<< /Producer " + value + b" /ModDate (D:2024)>>\nendobj\n" + more + b"trailer <</Root 1 0 R /Info 2 0 R>>\n%%EOF"


def test_information(spark):
    cases = {
        b"(plain)": "plain", b"(a (b (c) d) e)": "a (b (c) d) e", rb"(\101\\\(x\)\51 \7z)": "A\\(x)) \x07z", b"(two\\\nlines)": "twolines", b"<61 62 6>": "ab`", b"<FEFF20AC>": "€",
        b"(\xef\xbb\xbf\xc3\xb1)": "ñ", b"(\xf1)": "ñ", b"()": None, b"/Name": None,
    }
    rows = [(i, made(v)) for i, v in enumerate(cases)]
    rows += [(90, made(b"(x)", b"/Encrypt 3 0 R ")), (91, b""), (92, None), (93, b"%PDF no dictionary"), (94, made(b"(old)") + b"\n2 0 obj <</Producer (new)>> endobj trailer <</Info 2 0 R>>")]
    df = spark.createDataFrame(rows, "i int, c binary")
    got = {r["i"]: r["m"] for r in df.select("i", authenticity.information(F.col("c")).alias("m")).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i].get("Producer") == want and got[i]["ModDate"] == "D:2024", i
    assert got[90] == got[91] == got[92] == got[93] == {} and got[94] == {"Producer": "new"}


def test_signature_ranges(spark):
    body = b"x" * 50
    whole = lambda r: body + b"/ByteRange [" + r + b"]"
    size = len(whole(b"0 10 20 000"))
    cases = [b"", whole(b"0 10 20 %03d" % (size - 20)), whole(b"0 10 20 %03d" % (size - 21)), whole(b"0 10 05 %03d" % (size - 5)), whole(b"5 10 20 %03d" % (size - 20)), whole(b"0 10 20"), whole(b"0 10 20 99999999999999999999")]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*cases, None])], "i int, c binary")
    got = {r["i"]: r["r"] for r in df.select("i", authenticity.signature_ranges(F.col("c")).alias("r")).collect()}
    flags = {i: [(x["covers"], x["changed_after"]) for x in r or []] for i, r in got.items()}
    assert flags == {0: [], 1: [(True, False)], 2: [(False, True)], 3: [(False, True)], 4: [(False, True)], 5: [(False, True)], 6: [(False, True)], 7: []}
    assert (got[1][0]["gap"], got[1][0]["end"]) == (10, size)
