"""Text column functions: cleaning, splitting, phrase extraction and matching, format checks.

Patterns carry (?U) where word characters and white space are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a citation, an identifier or a reference section.
EDGE_CITATION = r"(?Uis)\([^)]*(?:->|<->)[^)]*\|[^)]*\|[^)]*(?:\bkey\s*=\s*\d+)?[^)]*\)"
EDGE_KEY = r"(?Ui)\bkey\s*=\s*(\d+)\b"
NODE_ID = r"(?Ui)\b(?:gene|pathway|protein|drug|disease|cohort)\s*:\s*[a-z0-9_.\-]+\b"
REACTOME_ID = r"(?Ui)\bR-HSA-\d+\b"
URL = r"(?Ui)https?://\S+"
BRACKETS = r"(?U)\[(?:\s*\d+\s*(?:[,;\-]\s*\d+\s*)*)\]"
PMID = r"(?Ui)\bpmid\s*[:#]?\s*\d+\b"
DOI = r"(?Ui)\bdoi\s*[:#]?\s*\S+"
REFERENCES = r"(?Uis)\b(?:references|bibliography)\b.*"
KG_EDGE = r"([A-Za-z0-9_\-/\s]+?)\s*->\s*([A-Za-z0-9_\-/\s]+?)\s*\|\s*([^\|]+?)\s*\|"

#: Words that carry no content, and words of citations and identifiers.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "because", "by", "can", "could", "do", "does", "for", "from", "has", "have", "in", "into", "is", "it",
    "its", "may", "might", "of", "on", "or", "such", "that", "the", "their", "then", "these", "this", "to", "was", "were", "with", "without", "while",
    "will", "would",
)
JUNK_TOKENS = (
    "pmid", "doi", "http", "https", "www", "com", "org", "arxiv", "figure", "fig", "table", "supplementary", "reference", "references", "bibliography",
    "citation", "citations", "et", "al", "gene", "pathway", "protein", "drug", "disease", "cohort", "src", "dst", "key", "evidence", "evidence_score",
    "score", "edges", "nodes", "reactome", "string", "uniprot", "omnipath", "curated", "seed", "sl_pair", "in_pathway", "string_association", "encodes",
)
#: Words that are no key phrase by themselves.
PHRASE_STOP = (
    "none", "null", "na", "n/a", "unknown", "is", "are", "was", "were", "be", "been", "being", "the", "a", "an", "and", "or", "of", "to", "in", "on",
    "for", "with", "by", "as",
)
#: What a prompt that asks for structure mentions, the headings it may ask for, and the weights of the heuristic.
STRUCTURE_MARKERS = ["mechanistic summary", "evidence", "references", "output format", "required format", "json"]
HEADINGS = ["mechanistic summary", "evidence", "references", "caveat", "limitations"]
BASE_SCORE, STRUCTURE_SCORE, UNNAMED_SCORE = 0.2, 0.55, 0.1
#: Characters of a premise chunk and of its overlap with the next.
CHUNK, OVERLAP = 1200, 300
MIN_SENTENCE, MAX_SENTENCES = 25, 40
SECTIONS = 8
#: Unicode's white space, as (?U)\\s knows it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    """A text without the white space at its ends; no pattern is tried at every blank within it."""
    return F.trim(c, F.lit(WHITE))


def normalize(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.regexp_replace(F.regexp_replace(_s(c), r"(?U)\s+", " "), "^ | $", "")


def strip_citations(c: Column) -> Column:
    """A text up to its reference section, with citations, links and identifiers blanked, in this order."""
    out = F.regexp_replace(_s(c), REFERENCES, "")
    for pattern in (URL, BRACKETS, PMID, DOI, EDGE_CITATION, NODE_ID, REACTOME_ID):
        out = F.regexp_replace(out, pattern, " ")
    return out


def citations(c: Column) -> Column:
    """The graph citations of a text."""
    return F.regexp_extract_all(_s(c), F.lit(EDGE_CITATION), 0)


def citation_count(c: Column) -> Column:
    return F.size(citations(c))


def citation_keys(c: Column) -> Column:
    """Number of distinct edge keys that a text cites."""
    keys = F.transform(citations(c), lambda x: F.regexp_extract(x, EDGE_KEY, 1))
    return F.size(F.array_distinct(F.filter(keys, lambda k: k != "")))


def sentences(c: Column, least: int = MIN_SENTENCE) -> Column:
    """Sentences of a text without its citations, those of at least that many characters."""
    parts = F.split(strip_citations(F.regexp_replace(_s(c), r"(?U)^\s+|\s+$", "")), r"(?U)(?<=[.!?])\s+(?=[A-Z])")
    trimmed = F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: F.length(x) >= least)


def chunks(c: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of a text, each a stride further; one if it is short. The last can be a tail that its predecessor covers."""

    def cut(text: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
        many = F.filter(F.transform(starts, lambda i: trimmed(F.substr(text, i + 1, F.lit(size)))), lambda x: x != "")
        return F.when(F.length(text) == 0, F.expr("cast(array() as array<string>)")).when(F.length(text) <= size, F.array(text)).otherwise(many)

    # What a lambda names from outside is worked out again for every element; a lambda's own variable is not.
    return F.get(F.transform(F.array(trimmed(_s(c))), cut), F.lit(0))


def _full(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def paragraphs(c: Column, most: int = 24) -> Column:
    """Parts between blank lines; the lines of a text of one part. The first ``most``."""
    parts = _full(F.split(_s(c), r"(?U)\n\s*\n+"))
    return F.slice(F.when(F.size(parts) <= 1, _full(F.split(_s(c), r"\r\n|\n|\r"))).otherwise(parts), 1, most)


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(_s(c), F.lit("[A-Za-z0-9]+"), 0), lambda x: F.lower(x))


def content_tokens(c: Column) -> Column:
    """Tokens that carry content: no stop words, no words of citations, no numbers."""
    return content(tokens(c))


def content(words: Column) -> Column:
    """Those of a text's tokens that carry content."""
    return F.filter(words, lambda x: ~x.isin(*STOPWORDS, *JUNK_TOKENS) & x.rlike("[a-z]"))


def split_features(c: Column) -> Column:
    """Phrases of a field: lines, then parts at semicolons and commas, normalised, empty ones dropped."""
    return F.filter(F.transform(F.split(_s(c), "[;,\\r\\n]"), normalize), lambda x: x != "")


def dedupe_keep_order(items: Column) -> Column:
    """Normalised items, the first of each that differ in more than case."""
    clean = F.filter(F.transform(items, normalize), lambda x: x != "")
    low = F.transform(clean, F.lower)
    return F.filter(F.transform(clean, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())


def contains_feature(c: Column, feature: Column, span: int = 80) -> Column:
    """Whether a text has a feature: one token as a word, two within a span in either order, more anywhere each.

    Tokens are lower-cased and the text is not, so capitalised words don't match.
    """
    return contains_tokens(normalize(c), tokens(normalize(feature)), span)


def contains_tokens(text: Column, found: Column, span: int = 80) -> Column:
    """contains_feature for a normalised text and a feature's tokens. Plain containment goes first: patterns are only built for texts that hold every token."""
    word = lambda t: F.concat(F.lit(r"(?U)\b"), t, F.lit(r"\b"))  # noqa: E731  tokens hold no special characters
    near = lambda a, b: F.concat(F.lit(r"(?U)\b"), a, F.lit(rf"\b.{{0,{span}}}\b"), b, F.lit(r"\b"))
    n = F.size(found)
    return (
        F.when((n == 0) | ~F.forall(found, lambda t: F.contains(text, t)), F.lit(False))
        .when(n == 2, F.rlike(text, near(F.get(found, F.lit(0)), F.get(found, F.lit(1)))) | F.rlike(text, near(F.get(found, F.lit(1)), F.get(found, F.lit(0)))))
        .otherwise(F.forall(found, lambda t: F.rlike(text, word(t))))
    )


def mechanistic_section(c: Column) -> Column:
    """The text between the second section's heading and the third section, if it has 60 characters; else all of it."""
    text = _s(c)
    part = F.regexp_extract(text, r"(?Us)(?:^|\n)\s*2\s*\)\s*[Mm]echanistic\s+[Ss]ummary(.*?)(?:(?:^|\n)\s*3\s*\)|\z)", 1)
    part = F.regexp_replace(part, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(part) >= 60, part).otherwise(text)


def _lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\n|\r")


def _is_section(line: Column, number: int) -> Column:
    return F.lower(F.ltrim(line)).rlike(rf"^{number}[).: ]")


def primary_text(c: Column) -> Column:
    """What to score of an answer: its second section if that has 80 characters, else all but its evidence chains.

    Words that a line break splits are joined first.
    """
    whole = F.regexp_replace(_s(c), r"([A-Za-z])\r?\n([a-z])", "$1$2")
    lines = _lines(whole)
    n = F.size(lines)
    at = F.transform(lines, lambda x, i: F.when(_is_section(x, 2) & F.contains(F.lower(x), F.lit("mechanistic summary")), i))
    start = F.array_min(at)
    stops = F.array_min(F.transform(lines, lambda x, i: F.when((i > start) & (_is_section(x, 3) | _is_section(x, 4)), i)))
    head = F.get(lines, start)
    tail = F.when(F.contains(head, F.lit(":")), F.regexp_replace(F.regexp_replace(head, r"(?s)^[^:]*:", ""), r"(?U)^\s+|\s+$", "")).otherwise(F.lit(""))
    body = F.slice(lines, start + 2, F.greatest(F.coalesce(stops, n) - start - 1, F.lit(0)))
    chunk = F.regexp_replace(F.array_join(F.when(tail != "", F.concat(F.array(tail), body)).otherwise(body), "\n"), r"(?U)^\s+|\s+$", "")
    # A line is within the evidence chains if the last heading before it that opens or ends them opens them.
    marks = F.transform(lines, lambda x: F.when(_is_section(x, 3) & F.contains(F.lower(x), F.lit("evidence chains")), 1).when(_is_section(x, 4), 2).otherwise(0))
    state = F.aggregate(marks, F.array(F.lit(0)), lambda s, m: F.concat(s, F.array(F.when(m > 0, m % 2).otherwise(F.element_at(s, -1)))))
    rest = F.filter(F.transform(lines, lambda x, i: F.when(F.get(state, i + 1) == 0, x)), lambda x: x.isNotNull())
    return F.when(start.isNotNull() & (F.length(chunk) >= 80), chunk).otherwise(F.regexp_replace(F.array_join(rest, "\n"), r"(?U)^\s+|\s+$", ""))


def explicit_phrases(c: Column) -> Column:
    """The phrases after the first line that declares key process phrases, or key phrases, or process phrases."""

    def listed(pattern: str) -> Column:
        line = F.regexp_replace(F.regexp_extract(_s(c), pattern, 1), r"(?U)^\s+|\s+$", "")
        parts = F.when(F.contains(line, F.lit(";")), F.split(line, ";")).otherwise(F.split(line, ","))
        clean = F.transform(parts, lambda p: normalize(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""), r"(?U)\s*\([^)]*\)\s*$", ""), r"\.+$", "")))
        return F.filter(clean, lambda p: (F.length(p) >= 3) & (F.size(F.split(p, " ")) <= 8))

    found = [listed(p) for p in (r"(?U)[Kk]ey\s+process\s+phrases?[:\s]+([^\n]+)", r"(?U)[Kk]ey\s+phrases?[:\s]+([^\n]+)", r"(?U)[Pp]rocess\s+phrases?[:\s]+([^\n]+)")]
    return F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(found[2])


def filter_candidates(candidates: Column, truth: Column) -> Column:
    """Candidate phrases without edge punctuation and repeats; those that share text with the truth first, and of the others no short, empty or symbol-like ones."""
    clean = F.transform(candidates, lambda x: F.regexp_replace(F.regexp_replace(normalize(x), "^[^A-Za-z0-9]+", ""), "[^A-Za-z0-9]+$", ""))
    once = dedupe_keep_order(clean)
    gold = F.filter(F.transform(truth, normalize), lambda g: g != "")
    related = lambda x, b: F.exists(b["gold"], lambda g: F.contains(g, x) | F.contains(x, g))
    stop = F.array(*map(F.lit, PHRASE_STOP))
    other = lambda x, b: ~related(x, b) & (F.length(x) >= 3) & ~F.array_contains(stop, F.lower(x)) & x.rlike("[A-Za-z]") & ~x.rlike(r"^[A-Z0-9][A-Z0-9_\-]{1,9}$")
    # What a lambda names from outside is worked out again for every element; a lambda's own variable is not.
    bound = F.array(F.struct(once.alias("once"), gold.alias("gold")))
    return F.get(F.transform(bound, lambda b: F.concat(F.filter(b["once"], lambda x: related(x, b)), F.filter(b["once"], lambda x: other(x, b)))), F.lit(0))


def kg_sentences(context: Column, most: int = 200) -> Column:
    """Edges of a context as short sentences, then descriptions after the first colon of its lines, without repeats."""
    text = _s(context)
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    src, dst, rel = (F.regexp_extract_all(text, F.lit(KG_EDGE), i) for i in (1, 2, 3))
    edge = F.transform(F.arrays_zip(src, dst, rel), lambda x: F.concat_ws(" ", strip(x["0"]), strip(F.regexp_replace(strip(x["2"]), "_", " ")), strip(x["1"])))
    edge = F.filter(edge, lambda x: F.length(x) >= 8)
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (F.length(x) > 20) & (F.length(x) < 500) & F.contains(x, F.lit(":")) & ~F.startswith(x, F.lit("Edges")) & ~F.startswith(x, F.lit("Nodes")) & ~F.contains(x, F.lit("->")) & ~F.startswith(x, F.lit("##")) & ~F.startswith(x, F.lit("===")))
    told = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"(?s)^[^:]*:", ""))), lambda x: F.length(x) >= 15)
    keyed = F.concat(F.transform(edge, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))), F.transform(told, lambda x: F.struct(F.substring(F.lower(x), 1, 80).alias("k"), x.alias("v"))))
    # What a lambda names from outside is worked out again for every element; a lambda's own variable is not.
    told = F.transform(F.array(keyed), lambda x: F.struct(x.alias("all"), F.transform(x, lambda y: y["k"]).alias("keys")))
    first = F.get(F.transform(told, lambda x: F.filter(F.transform(x["all"], lambda y, i: F.when(F.array_position(x["keys"], y["k"]) == i + 1, y["v"])), lambda v: v.isNotNull())), 0)
    return F.slice(first, 1, most)


def section_numbers(c: Column) -> Column:
    """The expected section numbers that open a line of a text."""
    n = F.transform(F.regexp_extract_all(_s(c), F.lit(r"(?U)(?:^|\n)\s*(\d+)\s*\)"), 1), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(n, lambda x: (x >= 1) & (x <= SECTIONS)))


def structural_score(c: Column) -> Column:
    """How far a text is structured: numbered sections, headings with colons among its first 40 lines, bullets, length."""
    text = F.regexp_replace(_s(c), r"(?U)^\s+|\s+$", "")
    lines = _full(_lines(text))
    numbered = (F.size(section_numbers(text)) > 0).cast("double")
    headings = (F.size(F.filter(F.slice(lines, 1, 40), lambda x: F.endswith(x, F.lit(":")))) >= 2).cast("double")
    bullets = F.exists(lines, lambda x: x.rlike(r"^(- |\* |•)")).cast("double")
    score = 0.35 * numbered + 0.25 * headings + 0.20 * bullets + 0.20 * F.least(F.lit(1.0), F.length(text) / 800.0)
    return F.when(text == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def citations_expected(context: Column) -> Column:
    low = F.lower(_s(context))
    has = lambda x: F.contains(low, F.lit(x))
    return has("key=") | has("citation") & has("kg") | has("knowledge graph") & has("citation")


def grounding_asked(context: Column) -> Column:
    """Whether a prompt asks for citations, or for evidence chains."""
    return citations_expected(context) | F.contains(F.lower(_s(context)), F.lit("evidence chains"))


def structural_compliance(c: Column) -> Column:
    """The share of the expected section numbers that open a line of a text."""
    return F.size(section_numbers(c)) / F.lit(float(SECTIONS))


def heuristic_format(c: Column, context: Column) -> Column:
    """Format score of a text for what its prompt asks for."""
    text, ask = F.lower(_s(c)), F.lower(_s(context))
    structured = F.exists(F.array(*map(F.lit, STRUCTURE_MARKERS)), lambda m: F.contains(ask, m))
    named = F.filter(F.array(*map(F.lit, HEADINGS)), lambda m: F.contains(ask, m))
    required = F.when(structured & (F.size(named) == 0), F.array(F.lit(HEADINGS[0]), F.lit(HEADINGS[1]))).otherwise(named)
    present = F.filter(required, lambda m: F.contains(text, m))
    base = F.when(F.regexp_replace(text, r"(?U)\s+", "") != "", BASE_SCORE).otherwise(0.0)
    extra = F.when(F.size(required) > 0, STRUCTURE_SCORE * F.size(present) / F.greatest(F.size(required), F.lit(1))).otherwise(0.0)
    return F.least(F.lit(1.0), base + extra)


def json_object(c: Column) -> Column:
    """The JSON object that a text holds, fenced or else the first that parses; null if none does."""
    fenced = F.regexp_replace(F.regexp_extract(_s(c), r"(?is)```json\s*(.*?)```", 1), r"^\s+|\s+$", "")
    found = F.filter(F.regexp_extract_all(_s(c), F.lit(r"(?s)\{.*?\}"), 0), lambda x: F.try_parse_json(x).isNotNull())
    return F.coalesce(F.when((fenced != "") & F.try_parse_json(fenced).isNotNull(), fenced), F.get(found, F.lit(0)))


def set_prf(predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets; null without truth, 0 without predictions."""
    p, t = F.array_distinct(predicted), F.array_distinct(truth)
    hit = F.size(F.array_intersect(p, t)).cast("double")
    precision = F.when(F.size(p) == 0, F.lit(0.0)).otherwise(hit / F.greatest(F.size(p), F.lit(1)))
    recall = hit / F.greatest(F.size(t), F.lit(1))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(F.lit(0.0))
    known = F.size(t) > 0
    return F.when(known, precision), F.when(known, recall), F.when(known, f1)
