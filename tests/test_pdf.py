"""PDF files written byte by byte, read as relations."""

import zlib

import pytest

from evigrain.sources import files, pdf


def write(objects, trailer="<< /Root 1 0 R >>", head=b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"):
    """A file of (number, text or bytes) with a cross-reference table."""
    out, at = bytearray(head), {}
    for number, body in objects:
        at[number] = len(out)
        out += b"%d 0 obj\n" % number + (body if isinstance(body, bytes) else body.encode("latin-1")) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n" % (len(at) + 1) + b"0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[n] for n in sorted(at))
    return bytes(out) + f"trailer\n{trailer}\nstartxref\n{start}\n%%EOF".encode()


def pages(n, first=10, parent=2):
    return [(first + k, f"<< /Type /Page /Parent {parent} 0 R >>") for k in range(n)]


def simple(n=2, catalog="", more=()):
    kids = " ".join(f"{10 + k} 0 R" for k in range(n))
    return [(1, f"<< /Type /Catalog /Pages 2 0 R {catalog} >>"), (2, f"<< /Type /Pages /Kids [{kids}] /Count {n} /MediaBox [0 0 612 792] >>"), *pages(n), *more]


MARKS = [
    (3, "<< /Type /Outlines /First 100 0 R /Last 102 0 R /Count 3 >>"),
    (100, "<< /Title (1 Introduction) /Parent 3 0 R /Next 101 0 R /First 110 0 R /Last 111 0 R /Dest [10 0 R /Fit] >>"),
    (110, "<< /Title <FEFF4E0000200061> /Parent 100 0 R /Next 111 0 R /A << /S /GoTo /D [11 0 R /XYZ 0 0 0] >> >>"),
    (111, r"<< /Title (b \(in  brackets\) \101) /Parent 100 0 R /Prev 110 0 R /Dest [11 0 R /Fit] >>"),
    (101, "<< /Title (   ) /Parent 3 0 R /Prev 100 0 R /Next 102 0 R /Dest [10 0 R /Fit] >>"),
    (102, "<< /Title (2 Results) /Parent 3 0 R /Prev 101 0 R /Dest [11 0 R /Fit] >>"),
]
TOC = [(1, "1 Introduction", 1), (2, "一 a", 2), (2, "b (in brackets) A", 2), (1, "2 Results", 2)]


def read(spark, **contents):
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in contents.items()], "path string, content binary")
    return {r.path: (r.status, r.page_count, [tuple(t) for t in r.toc]) for r in pdf.summary(df).collect()}


def test_pages_outlines_and_bad_files(spark):
    plain = write(simple(2, "/Outlines 3 0 R", MARKS))
    stream = b"<< /Length 30 >>\nstream\n99 0 obj endobj trailer <</Root 7 \nendstream"
    inner = b"".join(f"{n} {k * 80} ".encode() for k, n in enumerate((1, 2, 10)))
    body = b"".join(t.ljust(80) for t in (b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [10 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R >>"))
    packed = zlib.compress(inner + body)
    modern = b"%PDF-1.5\n" + b"5 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(inner), len(packed)) + packed
    modern += b"\nendstream\nendobj\n6 0 obj\n<< /Type /XRef /Root 1 0 R /Length 4 >>\nstream\nabcd\nendstream\nendobj\nstartxref\n9\n%%EOF"
    tree = [(1, "<< /Type /Catalog /Pages 2 0 R >>"), (2, "<< /Type /Pages /Kids [3 0 R 12 0 R 4 0 R] >>"), (3, "<< /Type /Pages /Kids [10 0 R 11 0 R] >>"), (4, "<< /Type /Pages /Kids [] >>"), *pages(3)]
    updated = plain + b"\n10 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [10 0 R 11 0 R 12 0 R] /Count 3 >>\nendobj\n12 0 obj\n<< /Type /Page >>\nendobj\ntrailer\n<< /Root 1 0 R /Prev 9 >>\nstartxref\n9\n%%EOF"
    loop = [(1, "<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>"), (2, "<< /Type /Pages /Kids [10 0 R] >>"), *pages(1), (3, "<< /First 100 0 R >>"), (100, "<< /Title (a) /Parent 3 0 R /Next 101 0 R /Dest [10 0 R] >>"), (101, "<< /Title (b) /Parent 3 0 R /Next 100 0 R /Dest [10 0 R] >>")]
    got = read(
        spark, plain=plain, shifted=b"junk" + plain, with_stream=write([(8, stream), *simple(3)]), modern=modern, tree=write(tree), updated=updated, marks_loop=write(loop),
        encrypted=write(simple(2), "<< /Root 1 0 R /Encrypt 9 0 R >>"), no_pages=write([(1, "<< /Type /Catalog >>")]), no_root=write(simple(1), "<< /Size 3 >>"), cut=plain[:60], text=b"hello", empty=b"", null=None,
        bad_pack=modern.replace(packed, packed[:10] + b"x" * (len(packed) - 10)),
    )
    assert got == {
        "plain": ("ok", 2, TOC), "shifted": ("ok", 2, TOC), "with_stream": ("ok", 3, []), "modern": ("ok", 1, []), "tree": ("ok", 3, []), "updated": ("ok", 3, TOC), "marks_loop": ("ok", 1, []),
        "encrypted": ("encrypted", 0, []), "no_pages": ("broken", 0, []), "no_root": ("broken", 0, []), "cut": ("broken", 0, []), "text": ("not_pdf", 0, []), "empty": ("not_pdf", 0, []), "null": ("not_pdf", 0, []), "bad_pack": ("broken", 0, []),
    }


def test_page_order_sizes_and_long_chains(spark):
    n = 70
    marks = [(3, "<< /First 100 0 R >>")] + [(100 + k, f"<< /Title (mark {k}) /Parent 3 0 R {f'/Next {101 + k} 0 R' if k + 1 < n else ''} /Dest [{10 + k % 3} 0 R /Fit] >>") for k in range(n)]
    objects = simple(3, "/Outlines 3 0 R", marks)
    objects[3] = (11, "<< /Type /Page /MediaBox [10 0 110.5 50] >>")
    df = spark.createDataFrame([("a", bytearray(write(objects)))], "path string, content binary")
    known, root = pdf.latest(pdf.object_table(df)), pdf.roots(pdf.object_table(df))
    table = pdf.page_table(known, root)
    assert [tuple(r)[1:] for r in table.orderBy("page").collect()] == [(1, 10, 612.0, 792.0), (2, 11, 100.5, 50.0), (3, 12, 612.0, 792.0)]
    got = pdf.outline(known, root, table).orderBy("place").collect()
    assert [(r.level, r.title, r.page) for r in got] == [(1, f"mark {k}", k % 3 + 1) for k in range(n)]
    assert pdf.summary(df.limit(0)).count() == 0


def test_a_tree_that_leads_back_is_broken_not_endless(spark, monkeypatch):
    monkeypatch.setattr(pdf, "DEPTH", 6)
    back = [(1, "<< /Type /Catalog /Pages 2 0 R >>"), (2, "<< /Type /Pages /Kids [3 0 R] >>"), (3, "<< /Type /Pages /Kids [2 0 R] >>")]
    assert read(spark, back=write(back), good=write(simple(1))) == {"back": ("broken", 0, []), "good": ("ok", 1, [])}


def test_uploads_use_what_the_file_says(spark):
    rows = [("a", write(simple(2))), ("b", write(simple(2))), ("c", write(simple(1), "<< /Root 1 0 R /Encrypt 9 0 R >>")), ("d", b"%PDF-1.4 nothing"), ("e", b"text"), ("f", write(simple(3)))]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")
    known = df.where("path = 'f'").select(pdf.F.sha2("content", 256).alias("paper_id"))
    got = {r.path: (r.status, r.page_count) for r in files.accept_uploads(df, known, pdf.summary(df)).collect()}
    assert got == {"a": ("accepted", 2), "b": ("duplicate", 2), "c": ("encrypted", 0), "d": ("broken", 0), "e": ("not_pdf", 0), "f": ("duplicate", 3)}


@pytest.mark.parametrize(("token", "text"), [(rb"(a\(b\)\\)", "a(b)\\"), (rb"(\101\n\x)", "A\nx"), (b"<48 6>", "H`"), (b"(\xfe\xff\x4e\x00)", "一"), (b"(a\\\nb)", "ab"), (b"<>", "")])
def test_strings(token, text):
    assert pdf.text_string(token) == text


def test_rounds_follow_the_longest_chain_not_the_number_of_files(spark, monkeypatch):
    body = lambda k: "\n".join([f"1 0 obj\n<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>\nendobj", "2 0 obj\n<< /Type /Pages /Kids [10 0 R] >>\nendobj", "10 0 obj\n<< /Type /Page >>\nendobj", "3 0 obj\n<< /Type /Outlines /First 4 0 R >>\nendobj", f"4 0 obj\n<< /Title (a{k}) /Parent 3 0 R /Dest [10 0 R /Fit] /Next 5 0 R >>\nendobj", "5 0 obj\n<< /Title (b) /Parent 3 0 R /Dest [10 0 R /Fit] >>\nendobj"])
    files = spark.createDataFrame([(str(k), f"%PDF-1.4\n{body(k)}\ntrailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF".encode()) for k in range(300)], "path string, content binary")
    kind, calls = type(files), []
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: calls.append(1) or plain(self, *a))
    got = pdf.summary(files).collect()
    assert len(got) == 300 and all([t.title for t in r.toc] == [f"a{r.path}", "b"] for r in got)
    # 600 bookmarks in chains of two: two rounds, not ten
    assert len(calls) <= 14
