"""Section finding, windows, packers, typed splitting and the adaptive chunker: one document to several chunks, in order.

Line logic is array functions within the row; packers are folds (aggregate), which stay in the JVM; where each step hangs on
the whole text before it, plain functions over Arrow batches, linear in the text.
"""

from __future__ import annotations

import difflib
import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexiforge.functions import analysis as A
from lexiforge.functions.text import by_slices, document_type, key

#: Section headers with their number and title. Strict: a numbered or named line, or one in capitals. Compat: any line that begins with a letter.
STRICT_HEADER = r"(?U)^\s*(?:(?:(?iu:раздел|глава|статья|section|chapter)\s+)?([\dIVXLC]+(?:\.\d+)*)[.):]?\s+)(\p{Lu}[^\n]{1,120})$|^\s*([\p{Lu}\s\d]{4,120})$"
COMPAT_HEADER = r"(?iuU)^\s*(?:раздел|глава|статья)?\s*([IVXLC]+|\d+(?:\.\d+)*)?\s*[.):\-]?\s*([A-ZА-ЯЁ][^\n]{2,120})\s*$"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _sections(docs: DataFrame, header: str) -> DataFrame:
    """docs (doc_id, text) with lines and sections, an array of structs; the row is never torn apart, so nothing is shuffled."""
    split = docs.withColumn("lines", F.split(F.coalesce("text", F.lit("")), _LINE_END))
    split = split.withColumn("lines", F.when(F.element_at("lines", -1) == "", F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines")))
    groups = len(re.findall(r"(?<!\\)\((?!\?)", header))

    def head(line: Column, n: Column) -> Column:
        own = A.strip(line)
        part = lambda k: _empty_as_null(A.strip(F.regexp_extract(own, header, k)))
        title = F.coalesce(*[part(k) for k in range(2, groups + 1)], own)
        number = part(1) if groups > 1 else F.lit(None).cast("string")
        return F.when((F.length(own) >= 3) & own.rlike(header) & ~F.endswith(own, F.lit(":")), F.struct(title.alias("title"), number.alias("number"), n.alias("start_line")))

    split = split.withColumn("heads", F.filter(F.transform("lines", head), lambda h: h.isNotNull()))

    def span(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get("heads", k + 1)["start_line"], F.size("lines"))
        body = A.strip(F.array_join(F.slice("lines", h["start_line"] + 2, F.greatest(end - h["start_line"] - 1, F.lit(0))), "\n"))
        return F.struct((k + 1).alias("section"), h["title"].alias("title"), h["number"].alias("number"), h["start_line"].alias("start_line"), end.alias("end_line"), body.alias("body"))

    return split.withColumn("sections", F.transform("heads", span)).drop("lines", "heads")


def find_sections(docs: DataFrame, header: str = STRICT_HEADER) -> DataFrame:
    """doc_id, section, title, number, start_line, end_line (exclusive) of every section."""
    return _sections(docs.select("doc_id", "text"), header).select("doc_id", F.inline("sections")).drop("body")


def section_chunks(docs: DataFrame, header: str = COMPAT_HEADER, cap: int | None = None, most: int = 1000) -> DataFrame:
    """doc_id, chunk_idx, section_title_raw, section_number, chunk_index_in_section, chunk.

    What stands before the first header is dropped, header lines are no text; each section's text is cut into windows, of which
    the first 1,000 count. A document without headers gives its sentences, titled generic. cap (C14) keeps a document's first chunks."""
    found = _sections(docs.select("doc_id", "text"), header).withColumn("windows", all_windows(F.transform("sections", lambda s: s["body"])))
    chunk = lambda title, number, i, text: F.struct(title.alias("section_title_raw"), number.alias("section_number"), i.alias("chunk_index_in_section"), text.alias("chunk"))
    cut = F.flatten(F.transform("sections", lambda s, k: F.transform(F.slice(F.get("windows", k), 1, most), lambda w, i: chunk(s["title"], s["number"], i, w))))
    plain = F.transform(A.sentences(F.coalesce("text", F.lit(""))), lambda x, i: chunk(F.lit("generic"), F.lit(None).cast("string"), i, x))
    chunks = F.when(F.size("sections") > 0, cut).otherwise(plain)
    return found.select("doc_id", F.posexplode(chunks if cap is None else F.slice(chunks, 1, cap)).alias("chunk_idx", "c")).select("doc_id", "chunk_idx", "c.*")


def canonical_section(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Titles (title) with canon: the exact alias, else the first alias that holds the title or is held by it. aliases (ord, alias, canon) is a small dimension."""
    t = titles.withColumn("k", key(F.col("title")))
    near = F.contains(F.col("k"), F.col("alias")) | F.contains(F.col("alias"), F.col("k"))
    rank = F.when(F.col("k") == F.col("alias"), -1).otherwise(F.col("ord"))
    return t.join(F.broadcast(aliases), near, "left").groupBy(*titles.columns).agg(F.min_by("canon", rank).alias("canon"))


def cut_windows(text: str, size: int = 1600, overlap: int = 250) -> list[str]:
    """C3 for one text: windows of size characters, each cut after its last full stop if that is near its end."""
    size, text = max(300, size), text.strip()
    overlap, out, at = max(0, min(overlap, size - 100)), [], 0
    while at < len(text):
        end = min(len(text), at + size)
        dot = text.rfind(".", at, end) + 1
        stop = end if end == len(text) or not dot or end - dot >= 200 else dot
        out.append(text[at:stop].strip())
        if stop >= len(text):
            break
        at = max(at + 1, stop - overlap)
    return [w for w in out if len(w) >= 20]


def windows(text: Column, size: int = 1600, overlap: int = 250) -> Column:
    """C3."""

    return by_slices(lambda t: cut_windows(t or "", size, overlap), ArrayType(StringType()))(text)


def all_windows(texts: Column, size: int = 1600, overlap: int = 250) -> Column:
    """C3 for each of an array of texts."""

    return by_slices(lambda row: [cut_windows(t or "", size, overlap) for t in row] if row is not None else [], ArrayType(ArrayType(StringType())))(texts)


def packed(parts: Column, limit: int, glue: str = "\n\n") -> Column:
    """Neighbours joined while they fit the limit; one that doesn't fit alone stays whole."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + len(glue) + F.length(p) <= limit
        return F.when(s["cur"] == "", F.struct(s["done"].alias("done"), p.alias("cur"))).when(fits, F.struct(s["done"].alias("done"), F.concat(s["cur"], F.lit(glue), p).alias("cur"))).otherwise(F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), p.alias("cur")))

    return F.aggregate(parts, state, step, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))


def hard_cut(parts: Column, limit: int) -> Column:
    """Parts over the limit in pieces of it."""
    return F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(p) / limit).cast("int") - 1)), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))))


def cut_messages(text: str, limit: int) -> list[str]:
    """C11 for one text: paragraphs joined up to the limit; a blank one ends a message, one over the limit is cut."""
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        nonlocal size
        if held:
            out.append("\n\n".join(held))
        held.clear()
        size = 0

    for paragraph in text.replace("\r\n", "\n").split("\n\n"):
        own = paragraph.strip()
        room = size + len(own) + (2 if held else 0)
        if own and room <= limit:
            held.append(own)
            size = room
            continue
        close()
        rest = max(0, -(-len(own) // limit) - 1) * limit
        out.extend(own[k : k + limit] for k in range(0, rest, limit))
        if own:
            held.append(own[rest:])
            size = len(own) - rest
    close()
    return [m for m in (m.strip() for m in out) if m]


def messages(text: Column, limit: int = 3896) -> Column:
    """C11."""

    return by_slices(lambda t: cut_messages(t or "", limit), ArrayType(StringType()))(text)


def pair_batches(pairs: Column, most: int = 40, chars: int = 12_000) -> Column:
    """The batch number of each of an array of pairs."""
    state = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).alias("c"))

    def step(s: Column, p: Column) -> Column:
        size = F.length(F.to_json(p))
        full = (s["n"] > 0) & ((s["n"] >= most) | (s["c"] + size > chars))
        b = F.when(full, s["b"] + 1).otherwise(s["b"])
        return F.struct(F.concat(s["ids"], F.array(b)).alias("ids"), b.alias("b"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, size).otherwise(s["c"] + size).alias("c"))

    return F.aggregate(pairs, state, step)["ids"]


def chunked(df: DataFrame, chunks: Column, cap: int | None = None) -> DataFrame:
    """A row for each chunk with its number; all of a document, or with cap (C14) its first ones."""
    return df.select("doc_id", F.posexplode(chunks if cap is None else F.slice(chunks, 1, cap)).alias("chunk_idx", "chunk"))


def with_overlap(chunks: DataFrame, n: int = 100) -> DataFrame:
    """The tail of the chunk before comes first."""
    order = Window.partitionBy("doc_id").orderBy("chunk_idx")
    return chunks.withColumn("chunk", F.concat(F.coalesce(F.right(F.lag("chunk").over(order), F.lit(n)), F.lit("")), F.col("chunk")))


# Titles that are headings in contracts, in statutes, and in other documents.
CONTRACT_TITLES = [
    "Предмет договора", "Права и обязанности сторон", "Обязанности сторон", "Гарантии сторон", "Ответственность сторон",
    "Срок действия договора", "Финансовые условия", "Стоимость услуг и порядок оплаты", "Порядок оплаты", "Термины и определения",
    "Прочие условия", "Обстоятельства непреодолимой силы", "Форс-мажор", "Конфиденциальность", "Право на использование изображений",
    "Порядок использования результатов интеллектуальной деятельности", "Заверения обстоятельства",
    "Адрес и банковские реквизиты", "Реквизиты и подписи сторон", "Подписи сторон",
]
POSITION_TITLES = [
    "Общие положения", "Цели и задачи", "Предмет регулирования", "Термины и определения", "Функции", "Права и обязанности",
    "Права организации", "Обязанности организации", "Ответственность", "Порядок взаимодействия", "Организация работы",
    "Порядок внесения изменений", "Заключительные положения",
]
GENERIC_TITLES = [
    "Введение", "Общие положения", "Термины и определения", "Порядок", "Права и обязанности", "Права", "Обязанности", "Ответственность",
    "Срок действия", "Финансовые условия", "Порядок оплаты", "Конфиденциальность", "Прочие условия", "Заключительные положения", "Приложения",
]
TITLES = {"contract": CONTRACT_TITLES, "position": POSITION_TITLES, "generic": GENERIC_TITLES}
KINDS = [("договор", "contract"), ("положение", "position")]
_NUMBERED = re.compile(r"(?:раздел|глава|section|chapter)\s+\d+[.:)]?$|\d+(?:\.\d+)*[.)]?\s+\S|[IVXLCDM]+[.)]\s+\S", re.IGNORECASE)
_SENTENCE_GAP = re.compile(r"(?<=[.!?…])\s+")
_PARAGRAPH_GAP = re.compile(r"\n\s*\n")


def _in_capitals(line: str) -> bool:
    """N29 on a line: of its letters, seven tenths and three at least are Cyrillic capitals."""
    letters = [c for c in line if c.isalpha()]
    capitals = sum(c == c.upper() and "а" <= c.lower() <= "я" for c in letters)
    return 3 <= len(line) <= 120 and bool(letters) and capitals >= max(3, int(0.7 * len(letters)))


def split_at_headings(text: str, titles: list[str]) -> list[tuple[str, str]]:
    """C6/C7 for one text: title and text (its heading line included) of each section; without headings the whole text, untitled.

    A heading line is one of titles, begins with a number, a named or a roman one, or is in capitals. What stands before the first
    one is dropped; a first line over 180 characters is no title, its number alone is."""
    known = {t.lower(): t for t in titles}
    marks, at = [], 0
    for line in text.split("\n"):
        own = line.strip()
        named, number = own.lower() in known, _NUMBERED.match(line)
        if own and (named or number or _in_capitals(own)):
            marks.append((at, known[own.lower()] if named else own if not number else number.group().strip()))
        at += len(line) + 1
    if not marks:
        return [("", text.strip())]
    out = []
    for (start, title), (end, _) in zip(marks, [*marks[1:], (len(text), "")]):
        part = text[start:end].strip()
        first = part.split("\n", 1)[0].strip()
        out.append((first if len(first) <= 180 else title, part))
    return out


def _filled(parts: list[str], limit: int, glue: str, first: str = "") -> list[str]:
    """Neighbours joined by glue while they fit; first begins every part, and is one alone where not even one neighbour fits at the start."""
    out, held, size = [], [], len(first)
    if first.strip() and parts and size + len(parts[0]) > limit:
        out.append(first)
    for p in parts:
        if held and size + len(glue) + len(p) > limit:
            out.append(first + glue.join(held))
            held, size = [], len(first)
        size += len(p) + (len(glue) if held else 0)
        held.append(p)
    if held:
        out.append(first + glue.join(held))
    return out


def smart_cut(text: str, kind: str, most: int = 2000, least: int = 400, part: int = 1600) -> list[str]:
    """C8/C9 for one text: sections, short ones joined to the one before; long ones packed from paragraphs with their title on every
    part, and what is still too long from sentences."""
    text, joined = re.sub(r"\r\n?", "\n", text), []
    for _, section in split_at_headings(text, TITLES[kind]):
        if section and joined and len(section) < least:
            joined[-1] += "\n\n" + section
        elif section:
            joined.append(section)
    out = []
    for section in joined:
        if len(section) <= most:
            out.append(section)
            continue
        title, _, body = section.partition("\n")
        title, body = title.strip(), body.strip() or section
        paragraphs = [p for p in map(str.strip, _PARAGRAPH_GAP.split(body)) if p]
        for p in _filled(paragraphs, part, "\n\n", title + "\n"):
            out.extend([p] if len(p) <= most else _filled(_SENTENCE_GAP.split(p), most, " "))
    return [c for c in map(str.strip, out) if c]


def smart_split(docs: DataFrame, most: int = 2000, least: int = 400, part: int = 1600) -> DataFrame:
    """doc_id, chunk_idx, chunk."""

    run = by_slices(lambda x: smart_cut(x["text"] or "", x["kind"], most, least, part), ArrayType(StringType()))
    return docs.select("doc_id", F.posexplode(run(F.struct("text", document_type(F.coalesce("text", F.lit("")), KINDS).alias("kind")))).alias("chunk_idx", "chunk"))


_TITLED = ArrayType(StructType([StructField("title", StringType()), StructField("text", StringType())]))


def heading_split(docs: DataFrame) -> DataFrame:
    """doc_id, section (from 0), title, text."""

    @F.pandas_udf(_TITLED)
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([[{"title": x, "text": y} for x, y in split_at_headings(re.sub(r"\r\n?", "\n", t or ""), TITLES[k])] for t, k in zip(texts, kinds)])

    return docs.select("doc_id", F.posexplode(run(F.col("text"), document_type(F.coalesce("text", F.lit("")), KINDS))).alias("section", "x")).select("doc_id", "section", "x.title", "x.text")


_HEADING_MARK = re.compile(r"^(?:#{1,6}\s+|[A-Z][^\n]{0,50}\n[-=]{3,}\s*$)", re.M)
_BULLET = re.compile(r"^[ \t]*(?:[\-*•]|[0-9]+\.)\s+", re.M)
_SENTENCE_START = re.compile(r"(?<=[.?!;])\s+(?=[A-ZА-ЯЁ0-9\"'(\[])|(?<=\n)")


def is_heading(block: str) -> bool:
    """A marked or underlined line in the block, or one short line with capitals in a fifth of it."""
    return bool(_HEADING_MARK.search(block)) or ("\n" not in block and 2 <= len(block) <= 80 and sum(map(str.isupper, block)) >= max(1, len(block) // 5))


def is_bullets(block: str) -> bool:
    """The block has a list item."""
    return bool(_BULLET.search(block))


def sentences_by_start(paragraph: str) -> list[str]:
    """Cut before a capital, digit, quote or bracket after an end mark, and after line ends; else at every full stop with a blank."""
    parts = _SENTENCE_START.split(paragraph)
    if len(parts) <= 1 and ". " in paragraph:
        parts = [p if p.endswith(".") else p + "." for p in paragraph.split(". ") if p]
    return [p for p in map(str.strip, parts) if p]


def adaptive_cut(text: str, target: int = 1000, least: int = 400, most: int = 1400, overlap: int = 0, near: float = 0.92) -> list[str]:
    """C10 for one text (A11, A9, J6): blocks to chunks.

    A heading takes the block after it along if both fit into most, and stands alone otherwise. List blocks stay whole, others are
    packed from sentences up to target. What is held grows up to most, takes further blocks while it is below least, and is let go
    from target on. Chunks near an earlier one (words, near) and short ones go."""
    text = re.sub("[\u200b-\u200d\ufeff]", "", re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"(\w)-\n(\w)", r"\1\2", re.sub(r"\r\n?", "\n", text))))).strip()
    blocks = [b for b in map(str.strip, _PARAGRAPH_GAP.split(text)) if b]
    heads = [is_heading(b) for b in blocks]
    chunks: list[str] = []
    held: list[str] = []
    size = k = 0

    def close() -> None:
        nonlocal size
        if held:
            chunks.append("\n\n".join(held).strip())
        held.clear()
        size = 0

    def hold(piece: str) -> None:
        nonlocal size
        if size and size + len(piece) > most:
            close()
        held.append(piece)
        size += len(piece)

    while k < len(blocks):
        follows = k + 1 < len(blocks) and not heads[k + 1]
        if heads[k]:
            close()
            pair = follows and len(blocks[k]) + 2 + len(blocks[k + 1]) <= most
            chunks.append("\n\n".join(blocks[k : k + 2]) if pair else blocks[k])
            k += 2 if pair else 1
            continue
        *full, last = [blocks[k]] if is_bullets(blocks[k]) else _filled(sentences_by_start(blocks[k]), target, " ") or [""]
        for piece in full:
            hold(piece)
        if last:
            hold(last)
            while size < least and k + 1 < len(blocks) and not heads[k + 1]:
                more = ("\n" if is_bullets(blocks[k + 1]) else "\n\n") + blocks[k + 1]
                if size + len(more) > most:
                    break
                held[-1] = (held[-1] + more).strip()
                size += len(more)
                k += 1
        if size >= min(target, most):
            close()
        k += 1
    close()
    if overlap > 0:
        chunks = [c if not i else chunks[i - 1][-overlap:] + c for i, c in enumerate(chunks)]
    return [c for c in map(str.strip, without_near(chunks, near) if near < 0.999 else chunks) if len(c) >= max(80, least // 3)]


def without_near(chunks: list[str], near: float) -> list[str]:
    """Chunks whose words are less similar than near to those of all kept before.

    Only those that share one of the first n - ceil(near * n) + 1 words, in the order of a sorted vocabulary, are compared."""
    kept: list[tuple[str, set]] = []
    lists: dict[str, list[int]] = defaultdict(list)
    for c in chunks:
        words = set(c.lower().split())
        first = sorted(words)[: len(words) - -(-int(round(near * 1e6)) * len(words) // 1_000_000) + 1] if words else []
        if not any(len(words & kept[k][1]) >= near * len(words | kept[k][1]) for k in {k for w in first for k in lists[w]}):
            for w in first:
                lists[w].append(len(kept))
            kept.append((c, words))
    return [c for c, _ in kept]


def adaptive_chunks(docs: DataFrame, target: int = 1000, least: int = 400, most: int = 1400, overlap: int = 0, near: float = 0.92) -> DataFrame:
    """doc_id, chunk_idx, chunk."""

    run = by_slices(lambda t: adaptive_cut(t or "", target, least, most, overlap, near), ArrayType(StringType()))
    return docs.select("doc_id", F.posexplode(run(F.col("text"))).alias("chunk_idx", "chunk"))


def aligned(pairs: DataFrame, by: str = "sentence") -> DataFrame:
    """The differing sentences (or lines) of text_a and text_b side by side: id, n, tag, original, recognized."""

    def run(batches):
        for b in batches:
            out = []
            for id_, x, y in zip(*(b.column(k).to_pylist() for k in range(3))):
                cut = (lambda t: [s.rstrip() for s in t.split("\n")]) if by == "line" else (lambda t: [s.strip() for s in _SENTENCE_GAP.split(t) if s.strip()])
                one, two, n = cut(x or ""), cut(y or ""), 0
                for tag, i, j, k, m in difflib.SequenceMatcher(None, one, two, autojunk=False).get_opcodes():
                    for p in range(max(j - i, m - k) if tag != "equal" else 0):
                        out.append((id_, n, tag, one[i + p] if i + p < j else "", two[k + p] if k + p < m else ""))
                        n += 1
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["id", "n", "tag", "original", "recognized"])

    return pairs.select("id", "text_a", "text_b").mapInArrow(run, "id long, n int, tag string, original string, recognized string")


def semantically_different(a: Column, b: Column) -> Column:
    """D3: they differ by more than case, white space and punctuation; digits count."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"(?U)[\s\p{P}\p{S}]+", "")
    return plain(a) != plain(b)
