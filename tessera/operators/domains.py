"""Metadata and structure of particular kinds of texts: titles, dates, authors, entities, statutes, papers, notes, formulas; retrieval that uses them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOPWORDS, citations, let, tokens

#: Ways that dates are written; each gives whole dates.
DATES = (
    r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b",
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}\b",
    r"\b[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}\b",
)


def title(text: Column, most: int = 100) -> Column:
    """A first Markdown heading, or else the first line with text, if it is no longer than most."""
    heading = F.regexp_extract(text, r"(?m)^# +(.+)$", 1)
    first = F.regexp_extract(text, r"(?s)^[ \t\r\n]*([^\r\n]+)", 1)
    return F.when(heading != "", heading).when((first != "") & (F.length(first) <= most), F.trim(first))


def author(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?im)^[ \t]*(?:author|by)[: ]+([^\r\n]{2,80})$", 1)
    return F.when(found != "", F.trim(found))


def dates(text: Column) -> Column:
    return F.concat(*(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in DATES))


def entities(text: Column) -> Column:
    """struct of arrays: emails, urls, numbers with per cent, money, names (two capitalised words or more)."""
    find = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)))
    return F.struct(
        find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), find(r"https?://[^ \t\n\r]+").alias("urls"), find(r"[0-9]+(?:\.[0-9]+)?%").alias("per_cents"),
        find(r"\$[0-9][0-9,]*(?:\.[0-9]+)?").alias("money"), find(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+").alias("names"),
    )


def keywords(docs: DataFrame, id_col: str, text: str, n: int, least: int = 4, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(id_col, term, n, rank): the n most frequent words of each text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))
    each = docs.select(id_col, F.explode(words).alias("term")).where((F.length("term") >= least) & ~F.col("term").isin(list(stopwords)))
    counts = each.groupBy(id_col, "term").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= n)


#: What makes a legal text a statute, a case or a contract: patterns, each worth one, and words of which any is worth one; three make the kind (fixed values).
STATUTE_MARKS = (r"(?i)chapter\s+\d+", r"(?i)section\s+\d+", r"(?i)§\s*\d+", r"(?i)title\s+\d+", r"(?i)article\s+\d+", r"(?i)(\(a\)|\(1\)|\(i\))")
STATUTE_WORDS = ("shall", "pursuant to", "notwithstanding", "hereinafter", "provision", "subsection")
CASE_MARKS = (r"(?i)v\.\s", r"(?i)plaintiff", r"(?i)defendant", r"(?i)court of appeals", r"(?i)supreme court", r"(?i)district court", r"(?i)opinion of", r"(?i)held:")
CASE_WORDS = ("facts", "procedural history", "issue", "holding", "reasoning")
CITATION_MARKS = (r"\d+ U\.S\. \d+", r"\d+ S\.Ct\. \d+", r"\d+ F\.\d[d] \d+", r"\d+ F\. Supp\. \d+", r"\d+ [A-Za-z]\.[A-Za-z]\. \d+", r"(?i)[A-Za-z]+ v\. [A-Za-z]+,\s+\d+.*\d+")
CONTRACT_MARKS = (r"(?i)agreement", r"(?i)between.*and", r"(?i)parties", r"(?i)whereas", r"(?i)term of", r"(?i)section \d+(\.\d+)*", r"(?i)article \d+(\.\d+)*", r"(?i)in witness whereof", r"(?i)signatures")
CONTRACT_WORDS = ("terms and conditions", "payment", "termination", "breach", "warranty", "liability", "intellectual property")
#: What makes a medical text a research paper, if three are found in the lower-cased text (fixed values).
PAPER_MARKS = (
    r"\babstract\b", r"\bintroduction\b", r"\bmethods\b", r"\bresults\b", r"\bdiscussion\b", r"\bconclusion\b", r"\breferences\b", r"\bcite\b", r"\bet al\b",
    r"\bp\s*[<>=]\s*0\.\d+\b",
)


def _found(text: Column, patterns: Sequence[str]) -> Column:
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def _any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)).cast("int")


def kind_of_legal(text: Column) -> Column:
    """statute, case_law, contract, or else legal_document; the first that has three marks. A citation counts two for a case."""
    cited = 2 * F.greatest(*(text.rlike(p).cast("int") for p in CITATION_MARKS))
    kinds = {
        "statute": _found(text, STATUTE_MARKS) + _any(text, STATUTE_WORDS), "case_law": _found(text, CASE_MARKS) + _any(text, CASE_WORDS) + cited,
        "contract": _found(text, CONTRACT_MARKS) + _any(text, CONTRACT_WORDS),
    }
    out = F.lit("legal_document")
    for kind, score in reversed(kinds.items()):
        out = F.when(score >= 3, kind).otherwise(out)
    return out


def kind_of_medical(text: Column) -> Column:
    """paper (three marks or more), note, else other."""
    score = _found(F.lower(text), PAPER_MARKS)
    return F.when(score >= 3, "paper").when(text.rlike(r"(?i)(chief complaint|assessment|history of present|medications:)"), "note").otherwise("other")


def statute_parts(text: str, header: str, least: int, most: int) -> list[str]:
    """What stands from one header to the next, parts below least characters dropped, parts beyond most regrouped by paragraphs packed up to most."""
    import re

    from tessera.operators.chunking import pack

    cuts = [m.start() for m in re.finditer(header, text)]
    whole = [text[a:b].strip() for a, b in zip([0, *cuts], [*cuts, len(text)])]
    return [y for x in whole if len(x) >= max(1, least) for y in (pack(re.split(r"\n\s*\n", x), most, "\n\n") if len(x) > most else [x])]


def medical_paragraphs(text: str, most: int) -> list[str]:
    """Paragraphs between blank lines; one beyond most characters is packed from its lines, whose ends don't count, up to most."""
    import re

    out = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if len(p) <= most:
            out += [p] if p else []
            continue
        now, size = [], 0
        for line in p.split("\n"):
            if now and size + len(line) > most:
                out.append("\n".join(now))
                now, size = [], 0
            now.append(line)
            size += len(line)
        out.append("\n".join(now))
    return out


def search_in_section(results_of, chunks: DataFrame, section: str, k: int) -> DataFrame:
    """The k best of results_of(chunks of that section): a filter before the search."""
    return results_of(chunks.where(F.col("section") == section)).where(F.col("rank") <= k)


def split_at_headers(text: Column, header: str, least: int = 1) -> Column:
    """Array of what stands from one header to the next; parts shorter than least are dropped."""
    marked = F.split(F.regexp_replace(text, header, "\u0001$0"), "\u0001")
    return F.filter(F.transform(marked, lambda x: F.trim(x)), lambda x: F.length(x) >= least)


STATUTE, PAPER = r"(?m)^(?:§ ?|Section )[0-9]+", r"(?im)^(?:[0-9.]+ )?(?:abstract|introduction|background|methods?|results|discussion|conclusions?|references)\b"


#: LaTeX commands that stand for one character (fixed values).
SIGNS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ",
    "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "infty": "∞", "approx": "≈", "ne": "≠", "leq": "≤", "geq": "≥", "times": "×", "cdot": "·", "pm": "±", "sum": "∑", "prod": "∏", "int": "∫", "partial": "∂", "nabla": "∇",
    "in": "∈", "notin": "∉", "subset": "⊂", "supset": "⊃", "cup": "∪", "cap": "∩", "emptyset": "∅", "forall": "∀", "exists": "∃",
    "rightarrow": "→", "Rightarrow": "⇒", "leftarrow": "←", "Leftarrow": "⇐", "leftrightarrow": "↔", "Leftrightarrow": "⇔", "sqrt": "√",
}
#: Another name of one of them.
SIGN_NAMES = {"neq": "ne"}


def formulas(text: Column) -> Column:
    """LaTeX between dollar signs, double ones, brackets, or in equation environments; each once, blocks first."""
    blocks = (r"(?s)\$\$(.+?)\$\$", r"(?s)\\\[(.+?)\\\]", r"(?s)\\begin\{equation\}(.+?)\\end\{equation\}")
    inline = F.regexp_extract_all(F.regexp_replace(text, r"(?s)\$\$.+?\$\$", " "), F.lit(r"\$([^$\n]+)\$"), F.lit(1))
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in blocks), inline))


def formula_text(formula: Column) -> Column:
    """A formula in plain characters as far as that goes: known commands as their sign, fractions with a slash, sub- and superscripts without their braces, other braces out."""
    out = F.regexp_replace(formula, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "($1)/($2)")
    for name, sign in (SIGNS | {other: SIGNS[name] for other, name in SIGN_NAMES.items()}).items():
        out = F.regexp_replace(out, rf"\\{name}(?![A-Za-z])", sign)
    return F.trim(F.regexp_replace(out, r"[{}]", ""))


#: Legal citations by kind (fixed values).
CITATIONS = {
    "us_reports": r"\d+\s+U\.S\.\s+\d+", "supreme_court": r"\d+\s+S\.\s*Ct\.\s+\d+", "federal_reporter": r"\d+\s+F\.\s*\dd\s+\d+", "federal_supplement": r"\d+\s+F\.\s*Supp\.\s+(?:\dd\s+)?\d+",
    "us_code": r"\d+\s+U\.?S\.?C\.?\s+(?:§+\s*)?\d+", "federal_regulations": r"\d+\s+C\.?F\.?R\.?\s+(?:§+\s*)?\d+\.\d+", "federal_register": r"\d+\s+Fed\.\s*Reg\.\s+[0-9,]+",
}


def legal_citations(text: Column) -> Column:
    """Array of struct(kind, citation): the different citations of a text, white space in them closed up."""
    return F.concat(*(_named_citations(text, kind, p) for kind, p in CITATIONS.items()))


def _named_citations(text: Column, kind: str, pattern: str) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " ")))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("citation")))


#: Categories of medical files: words in the file's name, words in its folder's path; the first that fits (fixed values).
MEDICAL_FILES = {
    "research_papers": (("paper", "research", "study", "journal", "article"), ("papers", "research", "publications", "articles")),
    "clinical_notes": (("note", "patient", "clinical", "ehr", "emr", "chart"), ("notes", "patients", "clinical", "ehr", "emr")),
    "medical_textbooks": (("textbook", "handbook", "manual", "guide"), ("textbooks", "handbooks", "manuals")),
    "guidelines": (("guideline", "protocol", "standard", "recommendation"), ("guidelines", "protocols", "standards")),
}


def category_of_file(path: Column, categories: dict = MEDICAL_FILES) -> Column:
    name, folder = F.lower(F.regexp_extract(path, "([^/]*)$", 1)), F.lower(F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    out = F.lit("other")
    for kind, (names, folders) in reversed(categories.items()):
        out = F.when(name.rlike("|".join(names)) | folder.rlike("|".join(folders)), kind).otherwise(out)
    return out


def citation_first(queries: DataFrame, docs: DataFrame, plain: DataFrame, k: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank): a query that cites takes the documents with its citations, if they are half of k or more; others, and it else, take plain results."""
    asked = queries.select("query_id", F.explode(F.array_distinct(citations(F.col("query")))).alias("c"))
    have = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(citations(F.col(text)))).alias("c"))
    hits = asked.join(have, "c").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score"))
    hits = hits.withColumns({"rank": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")), "n": F.count("*").over(Window.partitionBy("query_id"))})
    own = hits.where(F.col("n") >= max(1, k // 2)).where(F.col("rank") <= k).drop("n")
    rest = plain.join(own.select("query_id").distinct(), "query_id", "left_anti").where(F.col("rank") <= k)
    return own.unionByName(rest.select(*own.columns))


def expanded_query(query: Column, found: Column) -> Column:
    """The query with the names found in it behind it."""
    return F.when(F.size(found) > 0, F.concat(query, F.lit(" "), F.array_join(found, " "))).otherwise(query)


def answer_confidence(accuracy: Column, cited: Column, complete: Column, relevance: Column) -> Column:
    """.4, .3, .2 and .1 parts, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * accuracy + 0.3 * cited + 0.2 * complete + 0.1 * relevance))


def compared(systems: DataFrame, parts: dict[str, float], by: str) -> DataFrame:
    """(by, parts..., overall, is_best): weighted sum of the parts' means over their number; of equals the first by name is best."""
    per = systems.groupBy(by).agg(*(F.round(F.avg(c), 6).alias(c) for c in parts))
    value = sum((F.col(c) * w for c, w in parts.items()), F.lit(0.0)) / len(parts)
    per = per.withColumn("overall", F.round(value, 6))
    return per.withColumn("is_best", F.row_number().over(Window.orderBy(F.desc("overall"), by)) == 1)  # a row for each system


def graph(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of reasoning steps(id, kind, text, parents)."""
    return steps.select("id", "kind", "text"), steps.select(F.explode("parents").alias("source"), F.col("id").alias("target"))


def sentences_with(docs: DataFrame, id_col: str, text: str, names: Sequence[str]) -> DataFrame:
    """(id_col, name, n): in how many words of a text each name stands."""
    words = docs.select(id_col, let(tokens(F.lower(text)), lambda w: F.filter(w, lambda x: x.isin([n.lower() for n in names]))).alias("w"))
    return words.select(id_col, F.explode("w").alias("name")).groupBy(id_col, "name").agg(F.count("*").alias("n"))
