"""Files as documents: text, Markdown, JSON, CSV and DOCX through Spark's binary reader; results as text, JSON and DOCX."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import AND, BREAK, BREAKS, BULLET, MARKUP_TAGS
from ..shipping import ship

#: fixed values: encodings in the order they are tried, and the suffixes that are read
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "iso-8859-15")
SUFFIXES = ("txt", "md", "json", "csv", "docx", "pdf")
MOST_BYTES = 50 * 1024 * 1024
_MARKUP = re.compile(rf"</?(?:{'|'.join(MARKUP_TAGS.split())})(?:\s+[^>]*)?>", re.IGNORECASE)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsupportedFormat(ValueError):
    pass


_PICTURE = re.compile(r"<!--\s*Start of picture text\s*-->(.*?)<!--\s*End of picture text\s*-->", re.IGNORECASE | re.DOTALL)
_BR, _RULE = re.compile(r"<br\s*/?>", re.IGNORECASE), re.compile(r":?-+:?")
#: a row of a table of contents of which a column was cut in two: number, begin of a word, its rest, page
_CONTENTS = tuple(map(re.compile, (r"\d+|[A-ZIVXLCDM]+", r"[A-Za-zÄÖÜäöüß]+", r"[a-zäöüß].*", r"\d+|[ivxlcdmIVXLCDM]+|[-–—]")))


def _picture(m: re.Match) -> str:
    """Text of a picture: line breaks real, words glued together set apart."""
    apart = lambda w: re.sub(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ])", " ", w.group())
    return "\n\n" + re.sub(r"\b[A-Za-zÄÖÜäöüß]{4,}\b", apart, _BR.sub("\n", m.group(1))) + "\n\n"


_ITEM, _WORD_ENDS = re.compile(rf"{BULLET}(?:\s+|$)"), re.compile("[A-Za-zÄÖÜäöüß]-$")


def clean_cell_text(cell: str) -> str:
    """functions.text.clean_cell on one string: pieces between runs of breaks, sewn together by what meets at each."""
    cell = cell.strip()
    done, last, bare = "", "", False
    paragraphs = [False, *(len(re.findall(BREAK, run)) > 1 for run in re.findall(BREAKS, cell))]
    for k, (paragraph, piece) in enumerate(zip(paragraphs, re.split(BREAKS, cell), strict=True)):
        item = None if paragraph else _ITEM.match(piece)
        cut_word = bool(k and not paragraph and _WORD_ENDS.search(last)) and not re.match(rf"(?i:{AND})\b", piece)
        if item:
            done += " <br>- " + piece[item.end() :]
        elif cut_word and re.match("[a-zäöüß]", piece):
            done = done.removesuffix("-") + piece
        elif paragraph:
            done += " <br><br> " + piece
        else:
            sewn = not k or bare or (cut_word and re.match("[A-ZÄÖÜ][a-zäöüß]", piece))
            done += piece if sewn else " " + piece
        last, bare = piece, bool(item) and len(piece) == 1
    done = re.sub(rf"^(?:{BREAK}|\s)+|(?:{BREAK}|\s|{BULLET})+$", "", done)
    return re.sub(r"[ \t]+", " ", done).strip()


def _table_row(line: str) -> str:
    cells = line.split("|")[1:-1]
    if not all(_RULE.fullmatch(c.strip()) for c in cells if c.strip()):
        cells = [clean_cell_text(c) for c in cells]
        if len(cells) == 4 and all(p.fullmatch(c) for p, c in zip(_CONTENTS, cells, strict=True)):
            cells = [cells[0], "", cells[1] + cells[2], cells[3]]
    return "| " + " | ".join(c.strip() for c in cells) + " |"


def pdf_markdown(text: str | None, pictures: bool = True) -> str:
    """Markdown made from a PDF, cleaned: tags, picture blocks, table rows, breaks, comments, white space."""
    text = _PICTURE.sub(_picture if pictures else "", _MARKUP.sub("", text or "").strip())
    lines = []
    for line in map(str.strip, text.splitlines()):
        lines.append(_table_row(line) if line.startswith("|") and line.endswith("|") and line.count("|") >= 3 else _BR.sub("\n", line))
    text = re.sub(r"<!--.*?-->", "", "\n".join(lines), flags=re.DOTALL)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def decode(raw: bytes) -> str:
    """Text of bytes in the first encoding that fits; the last one fits anything."""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def json_text(raw: bytes) -> str:
    text = decode(raw)
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def _delimiter(text: str) -> str:
    sample = "\n".join([line for line in text.splitlines() if line.strip()][:5])
    try:
        return csv.Sniffer().sniff(sample, ";,|\t").delimiter
    except csv.Error:
        return ";" if ";" in sample and "," not in sample else "\t" if "\t" in sample else ","


def csv_markdown(raw: bytes) -> str:
    """A Markdown table of CSV bytes: blank rows dropped, short rows filled, line breaks in cells as <br>, pipes escaped."""
    text = decode(raw)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=_delimiter(text)) if any(c.strip() for c in r)] if text.strip() else []
    if not rows:
        return text if text.strip() else ""
    width = max(map(len, rows))
    cell = lambda c: "<br>".join(p.strip() for p in re.split(r"\r\n|\r|\n", c.strip()) if p.strip()).replace("|", r"\|")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    full = [[cell(c) for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join([line(full[0]), line([":---"] * width), *map(line, full[1:])])


def docx_markdown(raw: bytes, margins: bool = False) -> str:
    """A DOCX file's paragraphs as Markdown blocks, then its tables; with `margins` its headers before and its footers after."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else ElementTree.Element("none")
        body, styles = part("word/document.xml"), {x.get(f"{_W}styleId"): x.find(f"{_W}name") for x in part("word/styles.xml").iter(f"{_W}style")}
        formats = _list_formats(part("word/numbering.xml"))
        beside = {k: [_text(p).strip() for n in sorted(z.namelist()) if re.fullmatch(rf"word/{k}\d*\.xml", n) for p in part(n).iter(f"{_W}p")] if margins else [] for k in ("header", "footer")}
    names = {k: v.get(f"{_W}val", "").lower() for k, v in styles.items() if v is not None}
    in_tables = {p for t in body.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    blocks = [*beside["header"], *(_block(p, names, formats) for p in body.iter(f"{_W}p") if p not in in_tables), *map(_docx_table, body.iter(f"{_W}tbl")), *beside["footer"]]
    return _MARKUP.sub("", "\n\n".join(x for x in blocks if x)).strip()


def _text(p: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{_W}t"))


def _value(p: ElementTree.Element, path: str) -> str | None:
    found = p.find("/".join(_W + x for x in path.split("/")))
    return None if found is None else found.get(f"{_W}val", "")


def _list_formats(numbering: ElementTree.Element) -> dict[tuple[str, str], str]:
    """(list id, level) -> its number format."""
    kinds = {(a.get(f"{_W}abstractNumId"), x.get(f"{_W}ilvl")): _value(x, "numFmt") or "" for a in numbering.iter(f"{_W}abstractNum") for x in a.iter(f"{_W}lvl")}
    lists = {n.get(f"{_W}numId"): _value(n, "abstractNumId") for n in numbering.iter(f"{_W}num")}
    return {(n, level): kind for n, of in lists.items() for (a, level), kind in kinds.items() if a == of}


def _docx_table(t: ElementTree.Element) -> str:
    rows = [[" ".join(_text(p) for p in c.iter(f"{_W}p")).strip() for c in r.iter(f"{_W}tc")] for r in t.iter(f"{_W}tr")]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = len(rows[0])
    return "\n".join("| " + " | ".join(r) + " |" for r in (rows[0], [":---"] * width, *((r + [""] * width)[:width] for r in rows[1:])))


#: fixed values: styles that make a heading, by level
_HEADINGS = {1: ("heading 1", "überschrift 1"), 2: ("heading 2", "überschrift 2"), 3: ("heading 3", "überschrift 3"), 4: ("heading 4", "überschrift 4")}
_TITLES = {"title": 1, "titel": 1, "subtitle": 2, "untertitel": 2}


def _block(p: ElementTree.Element, names: dict[str, str], formats: dict[tuple[str, str], str]) -> str:
    """One paragraph: outline level, style, list kind, large bold line, or text with its marks."""
    text = _text(p).strip()
    if not text:
        return ""
    style = _value(p, "pPr/pStyle") or ""
    name, outline, list_id = names.get(style, style.lower()), _value(p, "pPr/outlineLvl"), _value(p, "pPr/numPr/numId")
    if outline and outline.isdigit() and int(outline) <= 5:
        return "#" * (int(outline) + 1) + " " + text
    level = _TITLES.get(name) or next((n for n, styles in _HEADINGS.items() if any(x in name or x.replace(" ", "") in name for x in styles)), 0)
    if level:
        return "#" * level + " " + text
    if list_id or "list" in name:
        kind = formats.get((list_id, _value(p, "pPr/numPr/ilvl") or "0"), "decimal" if "number" in name or "nummer" in name else "bullet")
        return ("- " if kind == "bullet" else "1. ") + text
    if "quote" in name or "zitat" in name:
        return "> " + text
    runs = [(_text(r), r.find(f"{_W}rPr/{_W}b") is not None, r.find(f"{_W}rPr/{_W}i") is not None, _value(r, "rPr/sz") or "0") for r in p.iter(f"{_W}r")]
    large = any(size.isdigit() and int(size) >= 32 for *_, size in runs)
    if large and len(text) < 60 and text[-1] not in ".!?" and all(bold for t, bold, *_ in runs if t.strip()):
        return "## " + text
    marked = lambda t, marks: f"{marks}{t.strip()}{marks}" if marks and t.strip() else t
    return "".join(marked(t, "**" * bold + "*" * italic) for t, bold, italic, _ in runs).strip()


def markdown_docx(text: str) -> bytes:
    """A DOCX file of Markdown text: headings as styles, other lines as paragraphs."""
    def paragraph(line: str) -> str:
        m = re.match(r"(#{1,6})\s+(.*)", line)
        props = f'<w:pPr><w:pStyle w:val="Heading{len(m.group(1))}"/></w:pPr>' if m else ""
        return f'<w:p>{props}<w:r><w:t xml:space="preserve">{escape(m.group(2) if m else line)}</w:t></w:r></w:p>'

    body = "".join(map(paragraph, text.split("\n")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def extract(suffix: str, raw: bytes, pdf: Callable[[bytes], str] | None = None) -> str:
    plain = lambda b: _MARKUP.sub("", decode(b)).strip()
    readers = {"txt": plain, "md": plain, "json": json_text, "csv": csv_markdown, "docx": docx_markdown, "pdf": pdf}
    if readers.get(suffix) is None:
        raise UnsupportedFormat(f"cannot read .{suffix} files")
    return readers[suffix](raw)


def extracted(suffix: Column, content: Column, pdf: Callable[[bytes], str] | None = None) -> Column:
    """Text of a file's bytes. PDF needs a function of the caller's, as no PDF library is assumed."""
    ship(SparkSession.active())
    return F.pandas_udf(lambda s, c: pd.Series([extract(x, y, pdf) for x, y in zip(s, c, strict=True)]), "string")(suffix, content)


def read_documents(spark: SparkSession, path: str, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, suffix, text) of the files under a path; larger ones than 50 MB and unknown suffixes are errors of their row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = [s for s in SUFFIXES if s != "pdf" or pdf]
    checked = files.withColumn("suffix", suffix).withColumn("error", F.when(~suffix.isin(*known), "unsupported").when(F.col("length") > MOST_BYTES, "too large"))
    good = checked.where("error is null").withColumn("text", extracted(F.col("suffix"), F.col("content"), pdf))
    bad = checked.where("error is not null").withColumn("text", F.lit(None).cast("string"))
    return good.unionByName(bad).select("path", "suffix", "text", "error")


def write_results(result: DataFrame, folder: str, with_mapping: bool = True) -> None:
    """anonymized, mapping and report tables of Engine.anonymize's output; without a mapping originals are redacted."""
    result.select("doc_id", "anonymized_text").write.mode("overwrite").parquet(f"{folder}/anonymized")
    entities = F.col("entities") if with_mapping else F.transform("entities", lambda e: e.withField("value", F.lit("[REDACTED]")))
    result.select("doc_id", F.lit(with_mapping).alias("reversible"), entities.alias("entities")).write.mode("overwrite").json(f"{folder}/report")
    if with_mapping:
        result.select("doc_id", F.explode("mapping").alias("placeholder", "original")).write.mode("overwrite").parquet(f"{folder}/mapping")


def glossary_lines(lines: DataFrame) -> DataFrame:
    """lines(line) -> (term, entity_type, role): `Term: TYPE | role`, also with `=`; comments and blank lines are skipped."""
    pattern = r"^\s*([^#:=][^:=]*?)\s*[:=]\s*([^|]+?)\s*(?:\|\s*(.*?)\s*)?$"
    rows = lines.where(~F.col("line").rlike(r"^\s*(#|$)") & F.col("line").rlike(pattern))
    part = lambda k: F.regexp_extract("line", pattern, k)
    return rows.select(part(1).alias("term"), F.upper(part(2)).alias("entity_type"), F.nullif(part(3), F.lit("")).alias("role"))


def ignore_terms(texts: DataFrame) -> DataFrame:
    """texts(text) -> term: split at line breaks and commas, trimmed, blanks dropped."""
    return texts.select(F.explode(F.split("text", r"[\n,]")).alias("t")).select(F.trim(F.regexp_replace("t", r"\r", "")).alias("term")).where("term <> ''")


def restored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Restoring for any keys, longest first, in one pass: for mappings whose keys aren't plain bracketed placeholders."""
    for f in frames:
        texts = []
        for text, mapping in zip(f["anonymized_text"], f["mapping"], strict=True):
            m = dict(mapping or {})
            keys = sorted(m, key=len, reverse=True)
            texts.append(re.sub("|".join(map(re.escape, keys)), lambda x, m=m: m[x.group()], text) if keys and text else text)
        yield f.drop(columns=["mapping"]).assign(restored_text=texts)
