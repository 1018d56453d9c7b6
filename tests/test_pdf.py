"""PDF files made here: objects, filters, fonts and text, up to the blocks of a book."""

import base64
import random
import zlib

import pytest

from textloom.sources.files import read_bytes
from textloom.sources.model import ReadError
from textloom.sources.readers import pdf_objects, pdf_text
from textloom.sources.readers.pdf import read_pdf

BOOK = [("h", "Chapter One"), ("p", "It was “night” – café."), ("p", "Second paragraph."), ("h", "Chapter Two"), ("p", "The end.")]


def literal(text, encoding="cp1252"):
    return b"(" + text.encode(encoding).replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def stream(data, more=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), more, data)


def flate(data, more=b""):
    return stream(zlib.compress(data), b"/Filter /FlateDecode " + more)


def file_of(objects, root=1, table=True, extra=b""):
    """A file with a classic table of cross-references."""
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start = len(out)
    if table:
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in sorted(places.items()))
        out += b"trailer\n<< /Size 99 /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (root, extra, start)
    return bytes(out)


def packed_file(objects, root=1):
    """The same with an object stream and a stream of cross-references with a predictor."""
    inner = {n: b for n, b in objects.items() if b"stream" not in b}
    body = b" ".join(inner.values())
    at, heads = 0, []
    for n, b in inner.items():
        heads.append(b"%d %d" % (n, at))
        at += len(b) + 1
    head = b" ".join(heads) + b" "
    whole = {n: b for n, b in objects.items() if n not in inner} | {90: flate(head + body, b"/Type /ObjStm /N %d /First %d" % (len(inner), len(head)))}
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for n, b in whole.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    rows = {0: (0, 0, 65535)} | {n: (1, p, 0) for n, p in places.items()} | {n: (2, 90, i) for i, n in enumerate(inner)}
    start = len(out)
    rows[91] = (1, start, 0)
    lines, above = b"", bytes(6)
    for n in sorted(rows):
        kind, a, b = rows[n]
        row = bytes([kind]) + a.to_bytes(3, "big") + b.to_bytes(2, "big")
        lines += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above))
        above = row
    index = b" ".join(b"%d 1" % n for n in sorted(rows))
    out += b"91 0 obj\n" + flate(lines, b"/Type /XRef /W [1 3 2] /Size 99 /Index [%s] /Root %d 0 R /DecodeParms << /Predictor 12 /Columns 6 >>" % (index, root)) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    return bytes(out)


def content(set_text=literal, size=10):
    out, y = [b"BT"], 760
    for kind, text in BOOK:
        out.append(b"/F1 %d Tf 1 0 0 1 72 %d Tm %s Tj" % (size * 2 if kind == "h" else size, y, set_text(text)))
        y -= 40
    return b"\n".join([*out, b"ET"])


def book(page=None, font=None, more=None, resources=b"/Font << /F1 4 0 R >>"):
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << %s >> /MediaBox [0 0 612 792] >>" % resources,
        3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>",
        4: font or b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        5: page or flate(content()),
    } | (more or {})


def cid_book():
    """A font of two-byte codes with its own character map and widths."""
    chars = sorted({c for _, t in BOOK for c in t})
    code = {c: i + 3 for i, c in enumerate(chars)}
    shown = lambda t: b"<" + b"".join(b"%04X" % code[c] for c in t) + b">"
    single = b"".join(b"<%04X> <%s>\n" % (code[c], c.encode("utf-16-be").hex().encode()) for c in chars[:5])
    listed = b"<%04X> <%04X> [%s]" % (code[chars[5]], code[chars[8]], b" ".join(b"<%s>" % c.encode("utf-16-be").hex().encode() for c in chars[5:9]))
    ranges = b"".join(b"<%04X> <%04X> <%s>\n" % (code[c], code[c], c.encode("utf-16-be").hex().encode()) for c in chars[9:])
    cmap = b"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange\n5 beginbfchar\n%s endbfchar\n%d beginbfrange\n%s\n%s endbfrange\nend" % (single, len(chars) - 8, listed, ranges)
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>"
    below = b"<< /Type /Font /Subtype /CIDFontType2 /DW 500 /W [3 [250 300 300] 6 40 550] >>"
    return book(flate(content(shown)), font, {6: below, 7: flate(cmap)})


def form_book():
    form = flate(content(), b"/Type /XObject /Subtype /Form /BBox [0 0 600 800] /Matrix [1 0 0 1 0 0] /Resources << /Font << /F1 4 0 R >> >>")
    return book(stream(b"q 1 0 0 1 0 0 cm /Fm1 Do Q BI /W 2 /H 1 ID \x00(\xff EI q /Fm1 pop Q"), more={8: form}, resources=b"/XObject << /Fm1 8 0 R >>")


def kerned(text):
    """An array of strings with small moves within words and wide ones for spaces."""
    parts = b" -300 ".join(b" 20 ".join(literal(word[i : i + 2]) for i in range(0, len(word), 2)) for word in text.split(" "))
    return b"[" + parts + b"] TJ %"


def differing_book():
    font = b"<< /Type /Font /Subtype /TrueType /BaseFont /Y /FirstChar 32 /LastChar 126 /Widths [%s] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /quotedblleft /quotedblright 3 /endash /eacute] >> >>" % b" ".join([b"500"] * 95)
    shown = lambda t: literal(t.translate({"“": "\1", "”": "\2", "–": "\3", "é": "\4"} and {ord("“"): 1, ord("”"): 2, ord("–"): 3, ord("é"): 4}), "latin-1")
    return book(flate(content(shown)), font)


FILES = {
    "table": file_of(book()),
    "streams": packed_file(book()),
    "junk before": b"\n\njunk" + file_of(book()),
    "no table": file_of(book(), table=False),
    "wrong offsets": file_of(book()).replace(b"%\xe2\xe3\xcf\xd3\n", b"%\xe2\xe3\xcf\xd3 and some more\n"),
    "packed, no start": packed_file(book()).replace(b"startxref", b"startxxxx"),
    "two-byte codes": file_of(cid_book()),
    "packed two-byte codes": packed_file(cid_book()),
    "form": file_of(form_book()),
    "kerned": file_of(book(flate(content(kerned).replace(b" Tj", b"\n")))),
    "differences": file_of(differing_book()),
    "hexadecimal": file_of(book(stream(content(lambda t: b"<" + t.encode("cp1252").hex().encode() + b">").hex().encode() + b">", b"/Filter /ASCIIHexDecode"))),
    "two filters": file_of(book(stream(base64.a85encode(zlib.compress(content())) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]"))),
    "wrong length": file_of(book(flate(content()).replace(b"/Length ", b"/Length 9"))),
    "length elsewhere": file_of(book(b"<< /Length 9 0 R >>\nstream\n" + content() + b"\nendstream", more={9: b"%d" % len(content())})),
}


@pytest.mark.parametrize("name", FILES)
def test_the_book(name):
    doc = read_pdf(FILES[name])
    assert [(b.k, b.t) for b in doc.blocks] == BOOK, name
    assert read_bytes(FILES[name], "a.pdf").blocks and doc.format_key == "pdf"


def test_moves_of_text():
    """Lines by TD, T*, ' and ", scaling, word spacing and a turned page."""
    page = b"BT /F1 12 Tf 14 TL 72 700 Td (First line) Tj T* (second) Tj (third) ' 3 1 (fourth) \" 0 -20 TD (fifth) Tj T* (sixth) Tj ET q 2 0 0 2 10 20 cm BT /F1 6 Tf 5 Ts 1 0 0 1 30 40 Tm 50 Tz (abc) Tj ET Q BT 0 12 -12 0 300 100 Tm /F1 1 Tf (up) Tj ET"
    items = pdf_text.page_items(file_of(book(stream(page))))[0]
    assert [(i.text, round(i.x, 3), round(i.y, 3), round(i.size, 3)) for i in items] == [
        ("First line", 72, 700, 12), ("second", 72, 686, 12), ("third", 72, 672, 12), ("fourth", 72, 658, 12), ("fifth", 72, 638, 12), ("sixth", 72, 618, 12), ("abc", 70, 110, 12), ("up", 300, 100, 12),
    ]
    width = dict(zip(map(chr, range(32, 127)), map(int, pdf_text.HELVETICA.split())))
    assert round(items[0].width, 6) == round(sum(width[c] for c in "First line") * 0.012, 6)
    assert round(items[3].width, 6) == round(sum(width[c] for c in "fourth") * 0.012 + 6, 6)
    assert len(width) == 95 == len(pdf_text.TIMES.split())


def test_pages_keep_order_and_sections():
    kids = {20 + i: b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R %d 0 R] >>" % (40 + i, 60 + i) for i in range(3)}
    texts = {40 + i: stream(b"BT /F1 10 Tf 72 700 Td (Page %s begins with some) Tj" % b"abc"[i : i + 1]) for i in range(3)} | {60 + i: stream(b"0 -12 Td (words of its own) Tj ET") for i in range(3)}
    objects = book(more=kids | texts | {10: b"<< /Type /Pages /Kids [21 0 R 22 0 R 10 0 R 2 0 R] >>"})
    objects[2] = b"<< /Type /Pages /Kids [20 0 R 10 0 R] /Resources << /Font << /F1 4 0 R >> >> >>"
    doc = read_pdf(file_of(objects))
    assert [(b.t, b.s) for b in doc.blocks] == [(f"Page {c} begins with some words of its own", i) for i, c in enumerate("abc")]


def test_errors_and_empty_files():
    with pytest.raises(ReadError) as locked:
        read_pdf(file_of(book(), extra=b"/Encrypt << /V 4 >>"))
    assert locked.value.code == "pdfPassword"
    for data in (b"%PDF-1.4\n", b"%PDF-1.7\nstartxref\n0\n%%EOF", FILES["table"][:60]):
        with pytest.raises(ReadError) as damaged:
            read_pdf(data)
        assert damaged.value.code == "pdfOpen"
    assert read_pdf(file_of(book(stream(b"q Q")))).warnings == ["pdfNoText"]


def test_damaged_files_end_in_text_or_an_error():
    rng = random.Random(1)
    for name in ("table", "streams", "two-byte codes", "form"):
        for _ in range(60):
            data = bytearray(FILES[name])
            for _ in range(rng.randint(1, 12)):
                data[rng.randrange(len(data))] = rng.randrange(256)
            try:
                read_pdf(bytes(data[: rng.choice([len(data), rng.randrange(len(data))])]))
            except ReadError as error:
                assert error.code in ("pdfOpen", "pdfPassword")


def lzw(data):
    """Codes of the LZW filter, with its early change of width."""
    table, bits, out, word = {bytes([i]): i for i in range(256)}, [], 9, b""
    width = 9
    bits.append((256, 9))
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        bits.append((table[word], width))
        table[word + bytes([b])] = len(table) + 2
        width = 9 if len(table) + 3 < 512 else 10 if len(table) + 3 < 1024 else 11 if len(table) + 3 < 2048 else 12
        if len(table) + 2 >= 4094:
            bits.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = bytes([b])
    if word:
        bits.append((table[word], width))
    bits.append((257, width))
    whole = "".join(format(code, f"0{n}b") for code, n in bits)
    return int(whole + "0" * (-len(whole) % 8), 2).to_bytes((len(whole) + 7) // 8, "big") if out else b""


def test_filters():
    rng = random.Random(2)
    for size in (1, 2, 300, 20_000):
        data = bytes(rng.choice(b"abcab") if rng.random() < 0.9 else rng.randrange(256) for _ in range(size))
        undo = lambda name, x, parms={}: pdf_objects.FILTERS[name](x, parms)  # noqa: B006, E731
        assert undo("ASCII85Decode", b"<~" + base64.a85encode(data) + b"~>") == data
        assert undo("ASCIIHexDecode", data.hex().encode() + b">") == data
        assert undo("FlateDecode", zlib.compress(data)[:-4]) == data
        if size < 5000:
            assert undo("LZWDecode", lzw(data)) == data
    assert pdf_objects.FILTERS["RunLengthDecode"](b"\x02abc\xfed\x80zz", {}) == b"abcddd"


@pytest.mark.parametrize("how", range(5))
def test_predictors(how):
    rng = random.Random(how)
    columns, step = 12, 3
    rows = [bytes(rng.randrange(256) for _ in range(columns * step)) for _ in range(9)]
    coded, above = b"", bytes(columns * step)
    for row in rows:
        out = []
        for i, x in enumerate(row):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            paeth = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            out.append((x - (0, left, up, (left + up) // 2, paeth)[how]) & 255)
        coded, above = coded + bytes([how, *out]), row
    parms = {"Predictor": 15, "Colors": step, "Columns": columns}
    assert pdf_objects.FILTERS["FlateDecode"](zlib.compress(coded), parms) == b"".join(rows)
    tiff = b"".join(bytes((x - (row[i - step] if i >= step else 0)) & 255 for i, x in enumerate(row)) for row in rows)
    assert pdf_objects.FILTERS["FlateDecode"](zlib.compress(tiff), parms | {"Predictor": 2}) == b"".join(rows)


def test_objects():
    read = lambda data: list(pdf_objects.Objects(data))
    assert read(rb"(a\(b\)\\ (in) \101\n\
x) <48 6> /A#20b [1 -2.5 .5 +3 true null] << /K 4 0 R /L [5 0 R 6] >> % note") == [b"a(b)\\ (in) A\nx", b"H`", "A b", [1, -2.5, 0.5, 3, True, None], {"K": (4, 0), "L": [(5, 0), 6]}]
    assert read(b"[" * 5000) and read(b"<< /A") and read(b"(open") == [b"open"]


def test_glyph_names():
    names = {"a": "a", "eacute": "é", "ccaron": "č", "uni00E9": "é", "u1F600": "😀", "fi": "fi", "a.alt": "a", "g123": "", ".notdef": "", "quoteright": "’", "Adieresis": "Ä", "uniD800": ""}
    assert {n: pdf_text.glyph(n) for n in names} == names
