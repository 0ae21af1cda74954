"""HTML jobs: per-row parsing inside Arrow batches (mapInArrow), everything
around it (cleaning, gates, link handling, names) stays native."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import html as H
from quarry.functions import text as TX
from quarry.operators.batches import new_columns, parts


def _map_html(df: DataFrame, inputs: tuple[str, ...], fn: Callable[..., tuple], out_fields: list[T.StructField]) -> DataFrame:
    """Append columns computed by ``fn(values of the inputs) -> values`` row by
    row; every input column passes through, so no join back is needed.  A
    worker holds one page's tree and the new values of one part of a batch."""
    schema = T.StructType(list(df.schema.fields) + out_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                rows = [fn(*row) for row in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new_columns(out_fields, rows)], schema.names)
    return df.mapInArrow(run, schema)


def html_to_markdown(df: DataFrame, html_col: str, out_col: str = "markdown", is_html: str | None = None) -> DataFrame:
    """Markdown of each page, then the native clean-up and quality gate:
    a page that fails the gate yields ''.  Rows where the column ``is_html``
    is false hold Markdown already and only pass the clean-up and gate."""
    def convert(page, flag=True):
        return (H.html_to_markdown(page) if flag else page,)
    md = _map_html(df, (html_col, is_html) if is_html else (html_col,), convert, [T.StructField("_md", T.StringType())])
    cleaned = TX.clean_markdown("_md")
    return md.withColumn("_md", cleaned) \
        .withColumn(out_col, F.when(TX.markdown_ok("_md"), F.col("_md")).otherwise(F.lit(""))).drop("_md")


def strip_html_noise(df: DataFrame, html_col: str, out_col: str = "html_clean") -> DataFrame:
    """Backslashes, img elements and appeal-instruction sections removed;
    ``malformed`` flags '</>' and '< >'."""
    out = _map_html(df, (html_col,), lambda page: (H.strip_noise(page),), [T.StructField(out_col, T.StringType())])
    return out.withColumn("malformed", F.col(html_col).contains("</>") | F.col(html_col).contains("< >"))


def select_text(df: DataFrame, html_col: str, selectors: dict[str, str], strip: bool = True) -> DataFrame:
    """Text of the first element matching each selector (tag, .class or
    tag.class); null when none matches."""
    def fn(page):
        root = H.parse(page)
        found = [H.select_one(root, s) for s in selectors.values()]
        return tuple(None if n is None else H.text_of(n, strip=strip) for n in found)
    return _map_html(df, (html_col,), fn, [T.StructField(n, T.StringType()) for n in selectors])


def extract_links(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                  allowed_prefix: Column | None = None) -> DataFrame:
    """href values of ``a`` elements; a leading '/' is resolved against the
    page's scheme://host; only links under ``allowed_prefix`` (default: same host)."""
    def hrefs(page):
        return ([n.attrs["href"] for n in H.iter_nodes(H.parse(page)) if n.tag == "a" and n.attrs.get("href")],)
    base = F.regexp_extract(url_col, r"^(https?://[^/?#]+)", 1)
    found = _map_html(pages, (html_col,), hrefs, [T.StructField("_hrefs", T.ArrayType(T.StringType()))])
    ex = found.select(*pages.columns, base.alias("_base"), F.explode("_hrefs").alias("_href"))
    link = F.when(F.col("_href").startswith("/"), F.concat("_base", "_href")).otherwise(F.col("_href"))
    prefix = allowed_prefix if allowed_prefix is not None else F.concat(F.col("_base"), F.lit("/"))
    return ex.withColumn("link", link).where(F.col("link").startswith(prefix)).drop("_base", "_href")


def page_entries(pages: DataFrame, title_selector: str | None = "h1",
                 content_selectors: tuple[str, ...] = ("article",), file_name_selector: str | None = "h1",
                 url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Crawled page -> knowledge entry: title (or 'Untitled'), content =
    title + blank line + selected texts joined by ' ' with camel-case
    spacing, file name from a selector or the url."""
    sels = {}
    if title_selector:
        sels["_title"] = title_selector
    if file_name_selector:
        sels["_fname"] = file_name_selector
    for i, s in enumerate(content_selectors):
        sels[f"_c{i}"] = s

    def fn(page):
        root = H.parse(page)
        found = [(k, H.select_one(root, s)) for k, s in sels.items()]
        return tuple(None if n is None else H.text_of(n, strip=not k.startswith("_c")) for k, n in found)
    sel = _map_html(pages, (html_col,), fn, [T.StructField(k, T.StringType()) for k in sels])
    title = F.coalesce(F.col("_title"), F.lit("Untitled")) if title_selector else F.lit("Untitled")
    body = F.concat_ws(" ", *[F.coalesce(F.col(f"_c{i}"), F.lit("")) for i in range(len(content_selectors))])
    content = TX.camel_space(F.concat(title, F.lit("\n\n"), body))
    fname = F.col("_fname") if file_name_selector else F.lit(None).cast("string")
    fname = F.coalesce(fname, F.concat(F.lit("unknown_entry_"), F.translate(url_col, "/", "_")))
    out = sel.withColumn("title", title).withColumn("content", content) \
        .withColumn("file_name", TX.entry_name(fname, "content"))
    return out.drop(*sels.keys())
