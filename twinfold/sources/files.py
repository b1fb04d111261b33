"""File sources and report sinks: folders of documents, of source code and of skills."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import translate
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.text import LANGUAGES, extension, stable_id

# Extensions, folders and files by their handling.
DOCUMENTS = [".md", ".txt", ".html", ".htm", ".pdf", ".docx", ".pptx"]
CODE = sorted({e for x in LANGUAGES.values() for e in x})
SKIPPED_FOLDERS = [
    ".git", "node_modules", "dist", "build", "target", ".venv", "venv", "__pycache__", ".pytest_cache", "coverage", ".next", ".nuxt", ".turbo", ".cache", "vendor", "out", "bin",
    "obj", ".idea", ".vscode", ".opencode", ".agents", ".codex",
]
SKIPPED_FILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "go.sum", "*.min.js", "*.map", "*.generated.*", "*.pb.go", "*.lock", "*.pyc"]


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def _relative(root: str) -> Column:
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return F.replace(bare, F.lit(root.rstrip("/") + "/"), F.lit(""))


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, filename, file_ext, file_size, mtime, file_hash, content) of supported documents, ~$ files left out."""
    rows = binary_files(spark, root).withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("file_ext", extension(F.col("path")))
    rows = rows.where(F.col("file_ext").isin(DOCUMENTS) & ~F.col("filename").startswith("~$"))
    return rows.select(stable_id("doc", F.col("path")).alias("doc_id"), "path", "filename", "file_ext", F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("file_hash"), "content")


def glob_match(name: Column, path: Column, patterns: list[str]) -> Column:
    """Whether a file name or a path matches one of the glob patterns."""
    out = F.lit(False)
    for p in patterns:
        regex = "^" + translate(p).replace("(?s:", "(?:").replace("\\z", "$").replace("\\Z", "$")
        out = out | name.rlike(regex) | path.rlike(regex)
    return out


def decoded(content: Column) -> Column:
    """Text of bytes without those that are no UTF-8; a replacement character that the text itself holds is kept."""
    own = F.replace(content.cast("string"), F.lit("\ufffd"), F.lit("\ufdd0"))
    return F.replace(F.replace(F.make_valid_utf8(own), F.lit("\ufffd"), F.lit("")), F.lit("\ufdd0"), F.lit("\ufffd"))


def scan_code(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), max_kb: int = 1024) -> DataFrame:  # type: ignore[assignment]
    """Every file with its status: (path, ext, text, size, status).

    status is ok, excluded_folder, excluded, unsupported, too_large or binary; only ok
    rows have a text, without bytes that are no UTF-8. Files over the size limit are listed
    without reading their content: the source filters by length. It can't filter by name, so small
    files of skipped folders are read.
    """
    every, size = binary_files(spark, root), F.col("length")
    small, large = every.where(size <= max_kb * 1024).select("path", "length", "content"), every.where(size > max_kb * 1024).select("path", "length", F.lit(None).cast("binary").alias("content"))
    rows = small.unionByName(large).withColumn("rel", _relative(root)).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("ext", extension(F.col("path")))
    if include:
        wanted = F.lit(False)
        for i in include:
            wanted = wanted | (F.col("rel") == i) | F.col("rel").startswith(i.rstrip("/") + "/")
        rows = rows.where(wanted)
    folders = F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1)
    nul = F.instr(F.hex(F.substring("content", 1, 4096)), "00") > 0
    exact_nul = F.exists(F.sequence(F.lit(1), F.greatest(F.least(F.length("content"), F.lit(4096)), F.lit(1))), lambda i: F.hex(F.substring(F.col("content"), i, F.lit(1))) == "00")
    status = (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))), "excluded_folder")
        .when(glob_match(F.col("name"), F.col("rel"), [*SKIPPED_FILES, *exclude]), "excluded")
        .when(~F.col("ext").isin(CODE), "unsupported")
        .when(F.col("length") > max_kb * 1024, "too_large")
        .when(nul & exact_nul, "binary")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).select(F.col("rel").alias("path"), "ext", F.when(F.col("status") == "ok", decoded(F.col("content"))).alias("text"), F.col("length").alias("size"), "status")


#: Files of a skill that are scanned for risks (fixed values).
SKILL_FILES = [".md", ".py", ".sh", ".bash", ".zsh"]


def scan_skills(spark: SparkSession, root: str) -> DataFrame:
    """(skill, path, text) of the scannable files of the folders right under root, path being relative to the skill; bytes that are no UTF-8 are replaced."""
    rows = binary_files(spark, root).where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(SKILL_FILES)).withColumn("rel", _relative(root))
    parts = F.split("rel", "/", 2)
    return rows.where(F.col("rel").contains("/")).select(parts[0].alias("skill"), parts[1].alias("path"), F.col("content").cast("string").alias("text"))


def ignored_files(scanned: DataFrame) -> DataFrame:
    """(path) of files left out by pattern, size or content, with the reason where it is not a pattern; compiled files are not named."""
    note = F.when(F.col("status") == "too_large", " (too large)").when(F.col("status") == "binary", " (binary)").otherwise("")
    return scanned.where(F.col("status").isin("excluded", "too_large", "binary") & ~F.lower("path").endswith(".pyc")).select(F.concat("path", note).alias("path")).distinct()


def ignored_folders(scanned: DataFrame) -> DataFrame:
    """(path) of the outermost folders that are skipped whole."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size("f"), F.lit(1))), lambda i: F.element_at("f", i).isin(SKIPPED_FOLDERS)))
    rows = scanned.where(F.col("status") == "excluded_folder").select(folders.alias("f"))
    return rows.select(F.array_join(F.slice("f", F.lit(1), first), "/").alias("path")).distinct()


def unsupported(scanned: DataFrame) -> DataFrame:
    """(extension, files) of files of unsupported kinds, most first."""
    name = F.when(F.col("ext") == "", "(no extension)").otherwise(F.col("ext"))
    return scanned.where("status = 'unsupported'").groupBy(name.alias("extension")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "extension")


def total_unsupported(scanned: DataFrame) -> DataFrame:
    """One row: files of unsupported kinds."""
    return unsupported(scanned).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def coverage(scanned: DataFrame, depth_folder: Column, by: str = "ok") -> DataFrame:
    """Files by folder and extension of one status."""
    return scanned.where(F.col("status") == by).groupBy(depth_folder.alias("folder"), "ext").agg(F.count(F.lit(1)).alias("files"))


class _Reader(HTMLParser):
    """Headings, paragraphs, list items and code of a page, in the order in which they open."""

    TAKEN = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "code")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.blocks: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:  # type: ignore[type-arg]
        if tag == "title" and self.title is None:
            self.title = []
            self.open.append((tag, self.title))
        elif tag in self.TAKEN:
            if tag in ("p", "li"):
                self.open = [x for x in self.open if x[0] != "p" and (tag != "li" or x[0] != "li")]
            text: list[str] = []
            self.blocks.append((tag, text))
            self.open.append((tag, text))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        for _, text in self.open:
            text.append(data)


def html_markdown(source: str | None, name: str | None = None) -> tuple[str | None, str]:
    """(title, Markdown) of a page: headings with hashes, pre fenced, blocks apart by blank lines."""
    r = _Reader()
    r.feed(source or "")
    r.close()
    out = []
    for tag, text in r.blocks:
        body = "".join(text).strip()
        if not body:
            continue
        out.append(f"{'#' * int(tag[1])} {body}" if tag[0] == "h" else f"```\n{body}\n```" if tag == "pre" else body)
    title = "".join(r.title).strip() if r.title else ""
    return title or name, "\n\n".join(out)


#: Pages that are parsed before they are handed on.
ROWS = 64


def parse_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, markdown) of pages."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            got = [html_markdown(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[key, "title", "markdown"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, title string, markdown string")


def parse_documents(files: DataFrame) -> DataFrame:
    """(doc_id, title, markdown, failed): text and Markdown by decoding, HTML by its reader; office formats have no parser here and fail."""
    text = F.col("content").cast("string")
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    head = F.filter(F.split(text, "\n"), lambda x: x.startswith("#"))
    title = F.nullif(F.trim(F.regexp_replace(F.try_element_at(head, F.lit(1)), "^#+", "")), F.lit(""))
    plain = files.where(F.col("file_ext").isin(".md", ".txt")).select("doc_id", F.coalesce(title, stem).alias("title"), text.alias("markdown"), F.lit(False).alias("failed"))
    html = files.where(F.col("file_ext").isin(".html", ".htm")).withColumn("html", text)
    page = parse_html(html, "doc_id", "html").join(html.select("doc_id", stem.alias("stem")), "doc_id").select("doc_id", F.coalesce("title", "stem").alias("title"), "markdown", F.lit(False).alias("failed"))
    rest = files.where(~F.col("file_ext").isin(".md", ".txt", ".html", ".htm")).select("doc_id", stem.alias("title"), F.lit(None).cast("string").alias("markdown"), F.lit(True).alias("failed"))
    return plain.unionByName(page).unionByName(rest)


def changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose (doc_id, file_hash) is not stored yet."""
    return files.join(stored.select("doc_id", "file_hash"), ["doc_id", "file_hash"], "left_anti")


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows with new versions in place of old ones; documents that failed to parse keep their stored version."""
    return stored.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


def newest(rows: DataFrame, at: str, key: str, most: int = 500) -> DataFrame:
    """The newest rows, as a list endpoint has them; ties by the key, largest first."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(most)


#: Tables of the store, and the keys that name their rows.
TABLES = {"documents": "doc_id", "chunks": "chunk_id", "clusters": "cluster_id", "members": "cluster_id"}


def write_table(rows: DataFrame, store: str, name: str) -> None:
    """Write a table of the store whole; the rows may come from the table itself, so they are written beside it and put in its place last."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path  # type: ignore[union-attr]
    old, new = path(f"{store}/{name}"), path(f"{store}/{name}.new")
    rows.write.mode("overwrite").parquet(f"{store}/{name}.new")
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise RuntimeError(f"could not put {name} in place")


def read_store(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{store}/{name}")


def stored_chunks(spark: SparkSession, store: str, doc_id: str | None = None, most: int = 500) -> DataFrame:
    """Chunks of one document, all of them, or else the first of the table as a list endpoint has them; the filter reaches the scan."""
    rows = read_store(spark, store, "chunks")
    return rows.where(F.col("doc_id") == doc_id).orderBy("chunk_id") if doc_id is not None else rows.orderBy("chunk_id").limit(most)


def stored_clusters(spark: SparkSession, store: str) -> DataFrame:
    """Clusters by id, each with its members' number."""
    counts = read_store(spark, store, "members").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"))
    return read_store(spark, store, "clusters").join(counts, "cluster_id", "left").orderBy("cluster_id")
