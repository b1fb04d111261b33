"""Text and path functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"

# Extensions by language, and words of paths.
LANGUAGES = {
    "python": [".py"],
    "javascript": [".js", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "go": [".go"],
    "java": [".java"],
    "csharp": [".cs"],
    "cpp": [".cpp", ".hpp"],
    "c": [".c", ".h"],
    "rust": [".rs"],
    "ruby": [".rb"],
    "php": [".php"],
    "swift": [".swift"],
    "kotlin": [".kt"],
    "scala": [".scala"],
    "shell": [".sh"],
    "sql": [".sql"],
    "yaml": [".yaml", ".yml"],
    "json": [".json"],
    "toml": [".toml"],
}
CONFIG_EXTENSIONS = [".yaml", ".yml", ".json", ".toml", ".sql", ".sh"]
TEST_PARTS = ["test", "tests", "__tests__", "fixtures", "fixture", "examples", "example"]
PROD_PARTS = ["src", "packages", "apps", "app", "lib"]


def strip(c: Column) -> Column:
    """Without leading and trailing white space, Unicode's included."""
    return F.regexp_replace(c, rf"\A{SPACE}++|{SPACE}++\z", "")


def lines(text: Column) -> Column:
    """Lines by all of Unicode's line ends; no empty last line."""
    parts = F.split(text, LINE_END)
    last = F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(last)


#: What no normal text has: marks that are looked for as they are, and those of texts beyond ASCII.
UNTIDY = ["\r", "\t", "\f", "\x0b", "\x1c", "\x1d", "\x1e", "\x1f", "  ", " \n", "\n ", "\n\n\n"]
UNTIDY_WIDE = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]


def is_normal(text: Column) -> Column:
    """Whether ``normalize_text`` would return the text as it is, for most such texts; never true of another. No pattern is run."""

    def free(marks: list[str]) -> Column:
        out = F.lit(True)
        for m in marks:
            out = out & ~text.contains(m)
        return out

    ends = F.lit(True)
    for m in (" ", "\n"):
        ends = ends & ~text.startswith(m) & ~text.endswith(m)
    return ends & free(UNTIDY) & ((F.octet_length(text) == F.length(text)) | free(UNTIDY_WIDE))


def normalize_text(text: Column) -> Column:
    """Unix line ends, single blanks, stripped lines, at most one blank line in a row.

    Whole-text replacements, whose possessive runs are looked at once: no array of lines is made.
    Texts that are normal already, as most are, pass unread by them.
    """
    flat = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t\f\x0B]++", " ")
    edges = r"[\t\x0B\f\r\x1c-\x1f\x85\p{Z}]++"
    rows = F.regexp_replace(flat, f"(?md)^{edges}|{edges}$", "")
    return F.when(is_normal(text), text).otherwise(strip(F.regexp_replace(rows, r"\n{3,}", "\n\n")))


def text_hash(text: Column) -> Column:
    """sha256 of the normalised text."""
    return F.sha2(normalize_text(text), 256)


def stable_id(prefix: str, raw: Column, size: int = 24) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(raw, 256), 1, size))


#: White space that ends no line, and the characters that end one.
INLINE = r"[\t \p{Zs}\x1f]"
ENDS = r"\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029"


def count_lines(text: Column) -> Column:
    """Lines with more than white space: runs from the first such character of a line to its end."""
    return F.regexp_count(text, F.lit(rf"[^\s\p{{Z}}\x1c-\x1f\x85][^{ENDS}]*+"))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s\p{Z}\x1c-\x1f\x85]++"))


def preview(text: Column, size: int = 180) -> Column:
    """Non-blank lines on one line, cut with dots beyond size characters."""
    flat = strip(F.regexp_replace(text, f"{INLINE}*+[{ENDS}]{SPACE}*+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 3), F.lit("..."))).otherwise(flat)


def grams(normalized: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the lower-cased text; a short text is one gram, an empty one none."""
    # Characters joined with their shifted neighbours: linear, and no lambda holds the text itself.
    chars = F.regexp_extract_all(F.lower(normalized), F.lit("(?s)."), F.lit(0))
    count = F.greatest(F.size(chars) - (n - 1), F.lit(0))
    cut = F.slice(chars, F.lit(1), count)
    for k in range(1, n):
        cut = F.zip_with(cut, F.slice(chars, F.lit(k + 1), count), lambda x, y: F.concat(x, y))
    short = F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.array(F.lower(normalized)))
    return F.when(count > 0, F.array_distinct(cut)).otherwise(short)


def jaccard(a: Column, b: Column) -> Column:
    """1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def language_for(ext: Column) -> Column:
    out = F.lit("text")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(exts), name).otherwise(out)
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]+)$", 1))


def path_parts(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def directory(path: Column, depth: int = 2) -> Column:
    parts = F.split(path, "/")
    head = F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(depth)))
    return F.when(F.size(parts) < 2, ".").otherwise(F.array_join(head, "/"))


def in_parts(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(path_parts(path), F.array(*map(F.lit, names)))


def is_test_path(path: Column) -> Column:
    return in_parts(path, TEST_PARTS)


def is_prod_path(path: Column) -> Column:
    return in_parts(path, PROD_PARTS)


def role_hint(path: Column, ext: Column) -> Column:
    return (
        F.when(ext.isin(CONFIG_EXTENSIONS), "config")
        .when(in_parts(path, ["fixture", "fixtures"]), "fixture")
        .when(in_parts(path, ["example", "examples"]), "example")
        .when(in_parts(path, ["test", "tests", "__tests__"]), "test")
        .when(is_prod_path(path), "production")
        .otherwise("unknown")
    )


def version_score(name: Column) -> Column:
    """The last v1.2.3 of a name as 1 + 2/10 + 3/100; 0 without one."""
    last = F.try_element_at(F.regexp_extract_all(name, F.lit(r"[vV](\d+(?:\.\d+)*)"), F.lit(1)), F.lit(-1))
    parts = F.split(last, r"\.")
    total = F.aggregate(F.zip_with(parts, F.sequence(F.lit(0), F.size(parts) - 1), lambda p, i: p.cast("double") / F.pow(F.lit(10.0), i)), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(total, F.lit(0.0))


def low(text: Column) -> Column:
    """Lower case of one letter for each letter; Java alone makes two of the dotted capital I."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def has_any(text: Column, terms: list[str]) -> Column:
    return contains_any(low(text), terms)


def contains_any(lowered: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | lowered.contains(t.lower())
    return out


def markdown_cell(c: Column, line_end: str = " ") -> Column:
    """A value for a table cell of a Markdown report; null is N/A."""
    return F.coalesce(F.replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(line_end)), F.lit("N/A"))


def yes_no(c: Column) -> Column:
    return F.when(c, "是").otherwise("否")
