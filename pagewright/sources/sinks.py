"""Sinks: label files, dictionaries, texts, crops and documents."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_labels(df: DataFrame, path: str, split: str | None = None) -> None:
    """Lines of image and text parted by a tab; with split, one folder for each of its values. Tabs and line ends in texts become blanks."""
    clean = F.regexp_replace("text", r"[\t\r\n]+", " ")
    line = F.concat_ws("\t", "rel_img", clean).alias("value")
    if split:
        df.where("text is not null").select(split, line).write.mode("overwrite").partitionBy(split).text(path)
    else:
        df.where("text is not null").select(line).write.mode("overwrite").text(path)


def write_dictionary(chars: DataFrame, path: str) -> None:
    """One character a line by code point. An alphabet is small, so one file is right."""
    chars.select(F.col("ch").alias("value")).distinct().repartition(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """Trimmed texts; an empty table is an error."""
    rows = df.select(F.trim(text).alias("value")).where("value <> ''")
    if not rows.limit(1).count():
        raise ValueError("no text to write")
    rows.write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rebuild a table as Parquet, whatever was there."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def rewrite_from_source(df_of: Callable[[DataFrame], DataFrame], source: DataFrame, path: str) -> None:
    """Derive a table from its unchanged source into another path: running it again gives the same."""
    df_of(source).write.mode("overwrite").parquet(path)


def document_layers(pages: DataFrame, document: str, ordinal: str, layer: str) -> DataFrame:
    """(document, layers): the text layers of a document's pages in order, for a writer of whole documents.

    A document's pages are gathered in one row: hand documents of very many pages to a writer page by page instead.
    """
    return pages.groupBy(document).agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, layer))), lambda x: x[layer]).alias("layers"))


#: A writer of bytes: (name, bytes) -> None, called on executors.
Writer = Callable[[str, bytes], None]


def write_bytes(df: DataFrame, name: str, data: str, write: Writer) -> DataFrame:
    """(name, n_bytes, error) of handing each row's bytes to a writer; writing again under a name must replace it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, d in zip(b[name], b[data], strict=True):
                try:
                    if d is None:
                        raise ValueError("no bytes")
                    write(n, bytes(d))
                    rows.append((n, len(d), None))
                except Exception as e:
                    rows.append((n, 0, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["name", "n_bytes", "error"])

    return df.select(name, data).mapInPandas(run, "name string, n_bytes bigint, error string")


def searchable_pdf(pages: list[dict]) -> bytes:
    """A PDF of images with invisible text over them.

    A page has page_w, page_h, x, y, shown_w, shown_h (points, y from the top), the image (width, height, channels, data) and texts: (text, x,
    baseline, font_size). Text is coded as UTF-16 in a font that stands for nothing visible; blank texts are left out.
    """
    objects: list[bytes] = [b"", b"", b"<</Type/Font/Subtype/Type0/BaseFont/Unseen/Encoding/Identity-H/DescendantFonts[4 0 R]/ToUnicode 5 0 R>>",
                            b"<</Type/Font/Subtype/CIDFontType2/BaseFont/Unseen/CIDSystemInfo<</Registry(Adobe)/Ordering(Identity)/Supplement 0>>/DW 500>>"]
    cmap = b"begincmap/CMapName/Same def 1 begincodespacerange<0000><FFFF>endcodespacerange 1 beginbfrange<0000><FFFF><0000>endbfrange endcmap"
    objects.append(_stream(b"", cmap))
    kids = []
    for p in pages:
        w, h, c, data = p["image"]
        space = {1: b"DeviceGray", 3: b"DeviceRGB"}[c]
        if c == 3:  # images are blue, green, red
            data = b"".join(data[k : k + 3][::-1] for k in range(0, len(data), 3))
        objects.append(_stream(b"/Type/XObject/Subtype/Image/BitsPerComponent 8/ColorSpace/%s/Width %d/Height %d" % (space, w, h), data))
        image = len(objects)
        drawn = [f"q {p['shown_w']:.2f} 0 0 {p['shown_h']:.2f} {p['x']:.2f} {p['page_h'] - p['y'] - p['shown_h']:.2f} cm /I Do Q"]
        for text, x, baseline, size in p["texts"]:
            if text and text.strip():
                drawn.append(f"BT 3 Tr /F {size:.2f} Tf {x:.2f} {p['page_h'] - baseline:.2f} Td <{text.encode('utf-16-be').hex()}> Tj ET")
        objects.append(_stream(b"", "\n".join(drawn).encode()))
        kids.append(len(objects) + 1)
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %.2f %.2f]/Contents %d 0 R/Resources<</Font<</F 3 0 R>>/XObject<</I %d 0 R>>>>>>" % (p["page_w"], p["page_h"], len(objects), image))
    objects[0], objects[1] = b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % at for at in places)
    return bytes(out + b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))


def _stream(head: bytes, data: bytes) -> bytes:
    packed = zlib.compress(data)
    return b"<<%s/Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (head, len(packed), packed)


def pdf_texts(pdf: bytes) -> list[list[str]]:
    """The invisible texts of each page of a PDF made by searchable_pdf()."""
    out = []
    for m in re.finditer(rb"<</Filter/FlateDecode/Length (\d+)>>stream\n", pdf):
        drawn = zlib.decompress(pdf[m.end() : m.end() + int(m[1])])
        if drawn.startswith(b"q "):
            out.append([bytes.fromhex(t.decode()).decode("utf-16-be") for t in re.findall(rb"<([0-9a-f]+)> Tj", drawn)])
    return out


def pdf_documents(pages: DataFrame, document: str, ordinal: str) -> DataFrame:
    """(document, pdf): the PDF of each document's pages in order.

    pages has page_w, page_h, x, y, shown_w, shown_h, width, height, channels, data and texts<text, x, baseline, font_size>. A document's pages are
    gathered in one task: give documents of very many pages an ordinal a part, and a name a part.
    """
    columns = ["page_w", "page_h", "x", "y", "shown_w", "shown_h", "width", "height", "channels", "data", "texts"]
    kind = pages.schema[document].dataType.simpleString()
    whole = pages.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(ordinal, F.struct(*columns).alias("p")))).alias("ps")).select(document, F.transform("ps", lambda x: x["p"]).alias("ps"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, ps in zip(b[document], b["ps"], strict=True):
                made = [{**p, "image": (p["width"], p["height"], p["channels"], bytes(p["data"])), "texts": [(t["text"], t["x"], t["baseline"], t["font_size"]) for t in p["texts"]]} for p in ps]
                out.append((name, searchable_pdf(made)))
            yield pd.DataFrame(out, columns=[document, "pdf"])

    return whole.mapInPandas(run, f"`{document}` {kind}, pdf binary")


def file_writer(folder: str) -> Writer:
    """A writer of files below a folder of any file system that pyarrow knows; an existing file is replaced."""

    def write(name: str, data: bytes) -> None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(f"{folder}/{name}")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as f:
            f.write(data)

    return write


def encode(df: DataFrame, keys: list[str], encoders: list[Callable[[int, int, int, bytes], bytes]]) -> DataFrame:
    """df (keys, width, height, channels, data) encoded by the first encoder that doesn't fail: (keys..., encoded)."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, h, c, d in zip(b["width"], b["height"], b["channels"], b["data"], strict=True):
                value = None
                for e in encoders:
                    try:
                        value = e(int(w), int(h), int(c), bytes(d))
                        break
                    except Exception:
                        continue
                out.append(value)
            yield b[keys].assign(encoded=out)

    return df.select(*keys, "width", "height", "channels", "data").mapInPandas(run, f"{schema}, encoded binary")


def encode_portable(width: int, height: int, channels: int, data: bytes) -> bytes:
    """Binary PGM or PPM."""
    kind = {1: b"P5", 3: b"P6"}[channels]
    return kind + f"\n{width} {height}\n255\n".encode() + data


def write_options(path: str, options: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(options, f, ensure_ascii=False, indent=2)
