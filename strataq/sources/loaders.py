"""Loading HTML, Markdown, text and extracted PDF pages into one document row each, with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions import text as T
from strataq.sources.fetch import FetchLimits, fetch_all
from strataq.sources.word import word
from strataq.tables import written

# Elements that never hold content.
DROPPED = ("script", "style", "nav", "footer", "header", "noscript", "iframe", "svg", "form")


def format_of(filename: Column, mime: Column) -> Column:
    """pdf, docx, html, markdown or text: by extension, then by MIME type."""
    ext = F.lower(F.regexp_extract(filename, r"([^.]*)$", 1))
    mime = F.coalesce(mime, F.lit(""))
    return (
        F.when((ext == "pdf") | (mime == "application/pdf"), "pdf")
        .when((ext == "docx") | mime.contains("wordprocessingml"), "docx")
        .when(ext.isin("html", "htm") | mime.contains("html"), "html")
        .when(ext.isin("md", "mdx", "markdown") | mime.contains("markdown"), "markdown")
        .otherwise("text")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, format, byte_size, checksum and raw content of all files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return rows.select(name.alias("filename"), format_of(name, F.lit(None).cast("string")).alias("format"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("checksum"), "content")


def as_text(content: Column) -> Column:
    """Bytes as UTF-8; what isn't becomes replacement characters, where decoding would end the job."""
    return F.make_valid_utf8(content.cast("string"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Markdown, text, HTML and Word files as documents; PDF needs an extractor first. A Word file that can't be read has no text."""
    rows = read_files(spark, path).where(F.col("format").isin("markdown", "text", "html", "docx"))
    rows = rows.withColumn("raw", F.when(F.col("format") == "docx", word(F.when(F.col("format") == "docx", F.col("content")))["text"]).otherwise(as_text(F.col("content"))))
    md = markdown(F.col("raw"), F.col("filename"))
    page = html(F.col("raw"))
    title = F.when(F.col("format") == "html", page["title"]).when(F.col("format") == "markdown", md["title"]).otherwise(T.title_of(F.col("filename"), F.col("raw")))
    text = F.when(F.col("format") == "html", page["text"]).when(F.col("format") == "markdown", md["text"]).otherwise(F.col("raw"))
    return rows.select("filename", "format", "byte_size", "checksum", title.alias("title"), text.alias("text"))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_body(raw: Column) -> Column:
    """The inside of the first article, main or body (in this order), without what is never content."""
    for tag in DROPPED:
        raw = F.regexp_replace(raw, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    raw = F.regexp_replace(raw, r"(?s)<!--.*?-->", "")
    inside = [F.regexp_extract(raw, rf"(?is)<{t}\b[^>]*>(.*?)(?:</{t}\s*>|$)", 1) for t in ("article", "main", "body")]
    return F.when(inside[0] != "", inside[0]).when(inside[1] != "", inside[1]).when(inside[2] != "", inside[2]).otherwise(raw)


#: (pattern, replacement) in the order in which markup becomes Markdown.
MARKUP = (
    *((rf"(?is)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)),
    (r"(?is)<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code>\s*)?</pre>", "\n\n```\n$1\n```\n\n"), (r"(?is)<code\b[^>]*>(.*?)</code>", "`$1`"),
    (r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"), (r"(?is)<(?:b|strong)\b[^>]*>", "**"), (r"(?is)</(?:b|strong)>", "**"),
    (r"(?is)<li\b[^>]*>\s*", "\n- "), (r"(?is)<br\s*/?>", "\n"), (r"(?is)</?(?:p|div|ul|ol|table|tr|section)\b[^>]*>", "\n\n"), (r"(?is)<[^>]+>", ""),
    (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
)


def markup_to_markdown(body: Column) -> Column:
    """Headings, list items, code, links, emphasis and paragraphs as Markdown; other tags go."""
    for pattern, by in MARKUP:
        body = F.regexp_replace(body, pattern, by)
    return F.regexp_replace(unescape(body), r"^\s+|\s+$", "")


def html(raw: Column) -> Column:
    """title and text of a page."""
    title = F.nullif(T.normalise_title(unescape(F.regexp_extract(raw, r"(?is)<title\b[^>]*>(.*?)</title>", 1))), F.lit(""))
    return F.struct(title.alias("title"), markup_to_markdown(html_body(raw)).alias("text"))


def markdown(raw: Column, filename: Column) -> Column:
    """title, text and the front matter's fields."""
    front = F.regexp_extract(raw, r"(?s)\A---\n(.*?)\n---\n?", 1)
    text = F.regexp_replace(raw, r"(?s)\A---\n.*?\n---\n?", "")
    lines = F.filter(F.split(front, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:\s*(.*)$", 1)), "^[\"']|[\"']$", "")
    fields = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]*):", 1), value(x))))
    return F.struct(F.coalesce(F.nullif(fields["title"], F.lit("")), T.title_of(filename, text)).alias("title"), text.alias("text"), fields.alias("metadata"))


def by_content_type(fetched: DataFrame) -> DataFrame:
    """url, format, title and text of fetched pages (url, content_type, content): the loader that the type, or else the name, asks for.

    The name is that of ``final_url``, if there is one, where redirects ended. PDF needs an extractor and has no text here, nor has a
    Word file that can't be read; a page that wasn't fetched is no row.
    """
    address = F.coalesce("final_url", "url") if "final_url" in fetched.columns else F.col("url")
    name = F.regexp_extract(F.regexp_replace(address, r"[?#].*$", ""), r"([^/]*)$", 1)
    rows = fetched.where("content is not null").withColumns({"name": name, "raw": as_text(F.col("content"))})
    rows = rows.withColumn("format", format_of(F.when(F.trim(F.coalesce("content_type", F.lit(""))) == "", F.col("name")).otherwise(""), F.lower("content_type")))
    docx = F.col("format") == "docx"
    rows = rows.withColumn("raw", F.when(docx, word(F.when(docx, F.col("content")))["text"]).otherwise(F.col("raw")))
    page, md = html(F.col("raw")), markdown(F.col("raw"), F.col("name"))
    pick = lambda field, plain: F.when(F.col("format") == "html", page[field]).when(F.col("format") == "markdown", md[field]).when(F.col("format").isin("text", "docx"), plain)
    return rows.select("url", "format", F.coalesce(F.nullif(pick("title", T.title_of(F.col("name"), F.col("raw"))), F.lit("")), F.col("url")).alias("title"), pick("text", F.col("raw")).alias("text"))


def from_web(urls: DataFrame, limits: FetchLimits = FetchLimits(), network: str | None = None) -> DataFrame:
    """url, format, title, text and error of each row of ``url``: fetched, and loaded by what came back."""
    got = written(fetch_all(urls, limits, network), "pages")  # once: what is asked for twice is asked for twice
    loaded = by_content_type(got).withColumn("error", F.lit(None).cast("string"))
    return loaded.unionByName(got.where("content is null").select("url", "error"), allowMissingColumns=True)


def pages(parts: Column) -> Column:
    """text and page_breaks of extracted pages: each is cleaned, and starts two characters after the one before."""
    clean = F.transform(parts, T.pdf_text)
    # one pass: the place after the last page so far goes along
    begun = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(clean, begun, lambda s, p: F.struct((s["upto"] + F.length(p) + 2).alias("upto"), F.concat(s["starts"], F.array(s["upto"])).alias("starts")), lambda s: s["starts"])
    return F.struct(F.array_join(clean, "\n\n").alias("text"), starts.alias("page_breaks"))


def page_of(breaks: Column, start: Column) -> Column:
    """The page that a character is on; null without pages."""
    return F.when(F.size(breaks) > 0, F.greatest(F.lit(1), F.size(F.filter(breaks, lambda b: b <= start))))
