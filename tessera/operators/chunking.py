"""Chunking: texts to numbered chunks. Windows of fixed size are pure SQL; greedy packers run per Arrow batch."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let, sentences, tokens
from tessera.session import ship

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def numbered(docs: DataFrame, chunks: Column, keep: Sequence[str]) -> DataFrame:
    """keep columns, chunk_index, chunk_count, content."""
    own = docs.select(*keep, chunks.alias("_c"))
    # the outer form keeps Spark from making the chunks a second time to filter on their number
    out = own.select(*keep, F.posexplode_outer("_c").alias("chunk_index", "content"), F.size("_c").alias("chunk_count"))
    return out.where("content IS NOT NULL").select(*keep, "chunk_index", "chunk_count", "content")


def fixed(text: Column, size: int, overlap: int = 0) -> Column:
    """Every size characters, steps of size - overlap."""
    step, none = size - overlap, F.array().cast("array<string>")
    return let(
        text,
        lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)), F.lit(step)), lambda i: F.substring(t, i, F.lit(size)))).otherwise(none),
    )


def _windows(items: Column, size: int, overlap: int, join: str) -> Column:
    none = F.array().cast("array<string>")

    def of(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(size - overlap))
        return F.when(F.size(x) > 0, F.transform(starts, lambda i: F.array_join(F.slice(x, i, size), join))).otherwise(none)

    return let(items, of)


def token_windows(text: Column, size: int, overlap: int = 0) -> Column:
    return _windows(tokens(text), size, overlap, " ")


def sentence_windows(text: Column, size: int, overlap: int = 0) -> Column:
    return _windows(sentences(text), size, overlap, ". ")


def hierarchy(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, paragraph, sentence, content): paragraphs between blank lines, sentences in them, numbered from 0."""
    p = docs.select(id_col, F.posexplode(F.split(text, r"\n[ \t]*\n")).alias("paragraph", "p"))
    return p.select(id_col, "paragraph", F.posexplode(sentences(F.col("p"))).alias("sentence", "content"))


def sections(docs: DataFrame, id_col: str, text: str, header: str) -> DataFrame:
    """(id_col, section, content): lines under each header line that matches; 'preamble' before the first. A repeated name keeps its last text."""
    from pyspark.sql import Window

    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    is_header = F.col("line").rlike(header)
    w = Window.partitionBy(id_col).orderBy("n")
    named = lines.withColumns({"section": F.coalesce(F.last(F.when(is_header, F.trim("line")), True).over(w), F.lit("preamble")), "start": F.coalesce(F.last(F.when(is_header, F.col("n")), True).over(w), F.lit(-1))})
    texts = named.groupBy(id_col, "section", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("content"))
    return texts.groupBy(id_col, "section").agg(F.max_by("content", "start").alias("content"))


# --- packers: the next chunk depends on the one before, so they fold over a text


def pack(parts: Sequence[str], size: int, joined: str = "", overlap: int = 0) -> list[str]:
    """Parts put together greedily up to size; a chunk starts with the last `overlap` characters of the one before. A part beyond size stays whole."""
    out, now = [], ""
    for p in parts:
        if now and len(now) + len(joined) + len(p) > size:
            out.append(now)
            now = now[len(now) - overlap :] + joined + p if overlap and len(p) + overlap <= size else p
        else:
            now = now + joined + p if now else p
    return out + [now] if now else out


def split_recursive(text: str, size: int, overlap: int = 0, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """By the first separator that parts the text; parts beyond size by the next ones; then packed."""
    if len(text) <= size:
        return [text] if text else []
    for k, s in enumerate(separators):
        if s == "":
            return [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]
        if s in text:
            cut = text.split(s)
            parts = [p + s for p in cut[:-1]] + cut[-1:]
            fine = [q for p in parts if p for q in (split_recursive(p, size, 0, separators[k + 1 :]) if len(p) > size else [p])]
            return pack(fine, size, "", overlap)
    return [text]


def shared_words(a: str, b: str) -> float:
    """Jaccard of lower-cased words; 0 if neither has any."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 0.0


def split_adaptive(text: str, target: int, least_similarity: float = 0.1, most: int | None = None, alike: Callable[[str, str], float] = shared_words) -> list[str]:
    """Sentences packed up to `most`; a chunk of target characters or more also ends before a sentence that is little like the last one.

    alike(last sentence, next): shared words, or any model's similarity; with a target of 0 it alone decides, which is semantic chunking.
    """
    most = most or 2 * target or len(text)
    out, now, last = [], "", ""
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if now and (len(now) + 1 + len(s) > most or (len(now) >= target and alike(last, s) < least_similarity)):
            out.append(now)
            now = s
        else:
            now = f"{now} {s}" if now else s
        last = s
    return out + [now] if now else out


def split_tokens(text: str, tokenize: Callable[[str], list[str]], size: int, overlap: int = 0, join: str = "") -> list[str]:
    """Windows of size tokens of any tokenizer (pieces that make up the text, unless joined by something), each starting with the last `overlap` of the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    t = tokenize(text)
    return [join.join(t[i : i + size]) for i in range(0, max(1, len(t) - overlap) if t else 0, size - overlap)]


def section_hierarchy(docs: DataFrame, id_col: str, text: str, header: str) -> DataFrame:
    """(id_col, section, paragraph, sentence, content): sentences of paragraphs of the sections that sections() gives, numbered from 0 within each."""
    own = sections(docs, id_col, text, header)
    p = own.select(id_col, "section", F.posexplode(F.split("content", r"\n[ \t]*\n")).alias("paragraph", "p"))
    return p.select(id_col, "section", "paragraph", F.posexplode(sentences(F.col("p"))).alias("sentence", "content"))


def _closing(source: str, at: int) -> int:
    """The place behind the brace that closes the one at `at`; strings, templates and comments don't count. The end if none does."""
    depth, k, n = 0, at, len(source)
    while k < n:
        c = source[k]
        if c in "\"'`":
            k += 1
            while k < n and source[k] != c:
                k += 2 if source[k] == "\\" else 1
        elif source.startswith("//", k):
            k = source.find("\n", k) if "\n" in source[k:] else n
        elif source.startswith("/*", k):
            end = source.find("*/", k + 2)
            k = n if end < 0 else end + 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return k + 1
        k += 1
    return n


_JS_SKIP = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?(?:\*/|\Z)""", re.S)


def _without_comments(source: str) -> str:
    """The source with blanks in place of comments."""
    return _JS_SKIP.sub(lambda m: m.group(1) or re.sub(r"[^\n]", " ", m.group()), source)


_JS_LINE = re.compile(r"^[ \t]*(?:import\b[^\n;]*(?:\{[^}]*\})?[^\n;]*;?|export\s+(?:\*|\{)[^;]*;?|(?:const|let|var)\s[^\n;=]*=\s*require\([^)\n]*\);?)", re.M)
_JS_CLASS = re.compile(r"\bclass\s+[\w$]+(?:\s+extends\s+[\w$.]+)?\s*(?=\{)")
_JS_FUNCTION = re.compile(r"(?:\basync\s+)?\bfunction\b\s*\*?\s*[\w$]+\s*\([^)]*\)\s*(?=\{)|\b(?:const|let|var)\s+[\w$]+\s*=\s*(?:async\s+)?(?:function\b[^({]*)?\([^)]*\)\s*(?:=>)?\s*(?=\{)")
_JS_METHOD = re.compile(r"^[ \t]*(?:(?:static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b)[\w$#]+\s*\([^)]*\)\s*(?=\{)", re.M)


def split_javascript(source: str, size: int = 2000) -> list[str]:
    """JavaScript: imports, exports of names and requires as one chunk, then each class, the methods of a class beyond size as well, and each function outside classes; else the whole."""
    plain = _without_comments(source)
    head = [m.group().strip() for m in _JS_LINE.finditer(plain)]
    out, spans = (["\n".join(head)] if head else []), []
    for m in _JS_CLASS.finditer(plain):
        if spans and m.start() < spans[-1][1]:
            continue
        spans.append((m.start(), _closing(source, m.end())))
        body = source[m.start() : spans[-1][1]]
        out.append(body)
        if len(body) > size:
            code, at = plain[m.start() : spans[-1][1]], m.end() - m.start() + 1
            while found := _JS_METHOD.search(code, at):
                end = _closing(body, found.end())
                out.append(body[found.start() : end].strip())
                at = end
    at = 0
    while found := _JS_FUNCTION.search(plain, at):
        within = next((b for a, b in spans if a <= found.start() < b), None)
        end = _closing(source, found.end())
        if within is None:
            out.append(source[found.start() : end])
        at = within or end
    return out or ([source] if source else [])


def split_legal(text: str, least: int = 100, most: int = 1500) -> list[str]:
    """Statutes at their section headers, other texts at numbered or upper-case header lines, packed by paragraphs; a text without either by split_recursive() with 100 of overlap."""
    from tessera.operators.domains import statute_parts

    for header in (r"(?m)^[ \t]*(?:§+ ?|Section |SECTION |Sec\. )\d+", r"(?m)^(?:[IVX]+\.|[0-9]+\.|[A-Z][A-Z ]{3,60}$)"):
        if re.search(header, text):
            return statute_parts(text, header, least, most)
    return split_recursive(text, most, 100)


def split_medical(text: str, most: int = 1500) -> list[str]:
    """Paragraphs as medical_paragraphs() makes them, packed up to most; section headers of papers and notes start a chunk."""
    from tessera.operators.domains import PAPER, medical_paragraphs

    note = r"(?im)^(?:chief complaint|history of present illness|past medical history|medications|assessment|plan)\b"
    cuts = sorted({0, len(text), *(m.start() for p in (PAPER, note) for m in re.finditer(p, text))})
    return [c for a, b in zip(cuts, cuts[1:]) for c in pack(medical_paragraphs(text[a:b], most), most, "\n\n")]


def split_code(source: str, size: int = 2000) -> list[str]:
    """Python source: imports and plain assignments as one chunk, then each function and class; the methods of a class beyond size as well. Broken source by lines."""
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return pack(source.splitlines(keepends=True), size)
    text = lambda n: ast.get_source_segment(source, n) or ""
    head = [text(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom, ast.Assign))]
    out = ["\n".join(head)] if head else []
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(text(n))
            if isinstance(n, ast.ClassDef) and len(out[-1]) > size:
                out += [text(m) for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


def chunked(docs: DataFrame, splitter: Callable[[str], list[str]], id_col: str, text: str) -> DataFrame:
    """(id_col, chunk_index, chunk_count, content) by any function of a text; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, len(c), x) for i, t in zip(b[id_col], b[text]) if t is not None for c in [splitter(t)] for k, x in enumerate(c)]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "chunk_count", "content"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, chunk_index int, chunk_count int, content string")
