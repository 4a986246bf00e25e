"""Text segmentation: sentences and lines with flags, headers, section trees, clauses, chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "mt", "fig", "eq", "ref", "vol", "no", "pp", "p", "vs", "etc", "cf", "al", "approx", "inc", "ltd", "co", "corp", "e.g", "i.e")
# Words that no span starts or ends with.
STOP_WORDS = frozenset("a an the of to in on at by for from with and or but nor so yet as is are was were be been being it its this that these those he she they we you i his her their our your my not no do does did have has had can could will would shall should may might must if then than".split())
PROTECTED = re.compile(
    r"https?://\S+|www\.\S+|(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+"  # addresses
    r"|\b(?:[A-Z]\.){1,4}(?=\s|$)"  # initials
    r"|\bv?\d+(?:\.\d+)+"  # versions and decimals
    r"|(?<![\w-])[\w-]++\.(?:md|txt|csv|json|js|py|html?|pdf|xml|bin)\b"  # file names
    r"|(?m:^[ \t]*+\d+\.(?=\s))"  # list ordinals
    rf"|\b(?:{'|'.join(map(re.escape, sorted(ABBREVIATIONS, key=len, reverse=True)))})\.",
    re.IGNORECASE,
)
HEADER = re.compile(r"(#{1,6})[ \t]+(.*\S)")
ORDERED = re.compile(r"(?:§\s*)?(?:(\d+(?:\.\d+)*)[.)]?|([IVXLC]+)[.)])[ \t]+([A-ZÀ-Þ].{0,80})")
RULE = re.compile(r"\s*([-*_=~])(?:\s*\1){2,}\s*")


def protect_dots(text: str) -> tuple[str, dict[str, str]]:
    """Addresses, numbers, names and abbreviations with dots as tokens between NULs, and what each stands for."""
    kept: dict[str, str] = {}

    def token(m: re.Match) -> str:
        name = f"\0{len(kept)}\0"
        kept[name] = m.group()
        return name

    return PROTECTED.sub(token, text), kept


def restore(text: str, kept: dict[str, str]) -> str:
    return re.sub(r"\0\d+\0", lambda m: kept[m.group()], text)


@dataclass
class Segment:
    """A half-open interval of a text with what stood before it."""

    start: int
    end: int
    blank_before: bool = False
    rule_before: bool = False
    level: int = 0  # of a header
    title: int = 0  # where a header's title starts

    def text(self, of: str) -> str:
        return of[self.start : self.end]


def _sentence_ends(line: str) -> list[int]:
    """Where sentences of a line end; dots in what ``protect_dots`` keeps end none."""
    ends = list(re.finditer(r"(?<![.!?])[.!?]++[\"'”’)\]]*+(?=\s)", line))
    if not ends:
        return []
    free = [True] * len(line)
    for m in PROTECTED.finditer(line):
        inner = m.end() - (m.group().endswith(".") and m.end() == len(line.rstrip()))
        free[m.start() : inner] = [False] * (inner - m.start())
    return [m.end() for m in ends if free[m.start()]]


def segments(text: str) -> list[Segment]:
    """Sentences and header lines in order; a line's end ends a sentence too. Offsets count code points of the text."""
    out: list[Segment] = []
    at, blank, rule = 0, True, False
    lines = text.splitlines(keepends=True)
    for i, raw in enumerate(lines):
        line = raw.rstrip("\r\n")
        start, at = at, at + len(raw)
        if not line.strip():
            blank = True
            continue
        if RULE.fullmatch(line):
            rule = True
            continue
        alone = blank or rule or i == 0
        next_blank = i + 1 >= len(lines) or not lines[i + 1].strip() or RULE.fullmatch(lines[i + 1].rstrip("\r\n")) is not None
        bare = line.strip()
        left = start + len(line) - len(line.lstrip())
        level = title = 0
        if m := HEADER.fullmatch(bare):
            level, title = len(m[1]), left + m.start(2)
        elif alone and next_blank and (m := ORDERED.fullmatch(bare)) and bare[-1] not in ".!?;,":
            level, title = (m[1] or "1").count(".") + 1, left + m.start(3)
        if level:
            out.append(Segment(left, left + len(bare), blank, rule, level, title))
        else:
            begin = 0
            for stop in [*_sentence_ends(line), len(line)]:
                piece = line[begin:stop]
                if piece.strip():
                    a = start + begin + len(piece) - len(piece.lstrip())
                    out.append(Segment(a, start + begin + len(piece.rstrip()), blank, rule))
                    blank = rule = False
                begin = stop
        blank = rule = False
    return out


@dataclass
class Section:
    """A header (or none) with sentences and sections below it."""

    header: Segment | None = None
    children: list = field(default_factory=list)

    def flatten(self) -> list[Segment]:
        out, todo = [], [self]
        while todo:
            c = todo.pop()
            if isinstance(c, Segment):
                out.append(c)
            else:
                out += [c.header] if c.header else []
                todo += reversed(c.children)
        return out

    def direct(self) -> list[Segment]:
        """Sentences right below, not those of sections."""
        return [c for c in self.children if isinstance(c, Segment)]


def sections(text: str) -> Section:
    """The tree of a text: a header opens a section below the last header of a smaller level, a blank line a paragraph."""
    root = Section()
    stack: list[tuple[int, Section]] = [(0, root)]
    paragraph: Section | None = None
    for s in segments(text):
        if s.level:
            while stack[-1][0] >= s.level:
                stack.pop()
            own = Section(s)
            stack[-1][1].children.append(own)
            stack.append((s.level, own))
            paragraph = None
            continue
        if paragraph is None or s.blank_before or s.rule_before:
            paragraph = Section()
            stack[-1][1].children.append(paragraph)
        paragraph.children.append(s)
    while len(root.children) == 1 and isinstance(root.children[0], Section) and not root.header:
        root = root.children[0]
    return root


def content(root: Section) -> list[dict]:
    """Sections that hold sentences: {start, end, header, ancestors, paragraph}; paragraph counts siblings where there are several."""
    out = []
    todo: list[tuple[Section, tuple, int | None]] = [(root, (), None)]
    while todo:
        section, above, place = todo.pop()
        own = section.direct()
        trail = (*above, section.header) if section.header else above
        if own:
            out.append({"start": own[0].start, "end": own[-1].end, "header": trail[-1] if trail else None, "ancestors": trail, "paragraph": place})
        below = [c for c in section.children if isinstance(c, Section)]
        bare = [c for c in below if not c.header]
        places = {id(c): i for i, c in enumerate(bare)} if len(bare) > 1 else {}
        todo += [(c, trail, places.get(id(c))) for c in reversed(below)]
    return out


def clauses(text: str) -> list[tuple[int, int]]:
    """Intervals of a sentence between strong, then weak marks."""
    out, at = [], 0
    for m in [*re.finditer(r"[;:—–]\s*|,\s+|\s+-\s+|[()]", text), None]:
        stop = m.start() if m else len(text)
        piece = text[at:stop]
        if piece.strip():
            a = at + len(piece) - len(piece.lstrip())
            out.append((a, at + len(piece.rstrip())))
        at = m.end() if m else stop
    return out


def spans(text: str, longest: int = 3) -> list[tuple[int, int]]:
    """Runs of one to three words within a clause that neither start nor end with a stop word."""
    out = []
    for a, b in clauses(text):
        words = [(a + m.start(), a + m.end()) for m in re.finditer(r"[\w'-]+", text[a:b])]
        low = [text[x:y].lower() for x, y in words]
        out += [(words[i][0], words[i + n - 1][1]) for i in range(len(words)) for n in range(1, longest + 1) if i + n <= len(words) and low[i] not in STOP_WORDS and low[i + n - 1] not in STOP_WORDS]
    return out


def chunks(text: str, short: int = 150, long: int = 400, group: int = 80) -> list[str]:
    """Pieces to embed: a short body whole, a medium one in groups of up to 80 words, a long one by sentence."""
    n = len(re.findall(r"\S+", text))
    if n < short:
        return [text.strip()] if text.strip() else []
    pieces = [s.text(text) for s in segments(text)]
    if n > long:
        return pieces
    out, own, size = [], [], 0
    for p in pieces:
        words = len(p.split())
        if own and size + words > group:
            out.append(". ".join(x.rstrip(".") for x in own))
            own, size = [], 0
        own.append(p)
        size += words
    return [*out, ". ".join(x.rstrip(".") for x in own)] if own else out


SEGMENTS = "document_id string, segment int, start int, end int, level int, blank_before boolean"
SECTIONS = "document_id string, section int, start int, end int, header string, ancestors array<string>, paragraph int"
CHUNKS = "document_id string, section int, chunk int, breadcrumb string, text string, range_start int, range_end int"
#: Letters of texts after which a task hands on the rows that they made.
LETTERS = 1 << 18


def _table(docs: DataFrame, rows_of: Callable[[str, str], Iterable[tuple]], types: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Rows of each text. Texts are taken from a batch one by one, and rows given on as soon as some hundred thousand letters made them,
    so that a worker's memory follows a text and not a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))

        rows: list[tuple] = []
        letters = 0
        for batch in batches:
            for i, t in zip(batch.column("document_id"), batch.column("text"), strict=True):
                own = t.as_py() or ""
                letters += len(own)
                for row in rows_of(i.as_py(), own):
                    rows.append(row)
                    if len(rows) >= LETTERS >> 5:
                        yield given(rows)
                        rows = []
                if letters >= LETTERS:
                    if rows:
                        yield given(rows)
                    rows, letters = [], 0
            pa.default_memory_pool().release_unused()
        if rows:
            yield given(rows)

    return docs.selectExpr("cast(document_id as string) document_id", "text").mapInArrow(run, schema)


def segment_table(docs: DataFrame) -> DataFrame:
    """(document_id, segment, start, end, level, blank_before) from (document_id, text): a row for each segment."""
    rows = lambda i, t: ((i, n, s.start, s.end, s.level, s.blank_before) for n, s in enumerate(segments(t)))
    return _table(docs, rows, {"document_id": pa.string(), "segment": pa.int32(), "start": pa.int32(), "end": pa.int32(), "level": pa.int32(), "blank_before": pa.bool_()}, SEGMENTS)


def section_table(docs: DataFrame) -> DataFrame:
    """(document_id, section, start, end, header, ancestors, paragraph): a row for each section that holds sentences."""

    def rows(i: str, t: str) -> Iterator[tuple]:
        title = lambda h: None if h is None else t[h.title : h.end]
        for n, c in enumerate(content(sections(t))):
            yield i, n, c["start"], c["end"], title(c["header"]), [title(h) for h in c["ancestors"]], c["paragraph"]

    return _table(docs, rows, {"document_id": pa.string(), "section": pa.int32(), "start": pa.int32(), "end": pa.int32(), "header": pa.string(), "ancestors": pa.list_(pa.string()), "paragraph": pa.int32()}, SECTIONS)


def chunk_table(docs: DataFrame) -> DataFrame:
    """(document_id, section, chunk, breadcrumb, text, range_start, range_end): what is embedded of each section, and where the section is."""

    def rows(i: str, t: str) -> Iterator[tuple]:
        for n, c in enumerate(content(sections(t))):
            crumb = " > ".join(t[h.title : h.end] for h in c["ancestors"])
            for k, x in enumerate(chunks(t[c["start"] : c["end"]])):
                yield i, n, k, crumb, x, c["start"], c["end"]

    return _table(docs, rows, {"document_id": pa.string(), "section": pa.int32(), "chunk": pa.int32(), "breadcrumb": pa.string(), "text": pa.string(), "range_start": pa.int32(), "range_end": pa.int32()}, CHUNKS)
