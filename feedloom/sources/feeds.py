"""Feeds and pages as rows: RSS 2.0, RDF and Atom, comment trees, front pages. A feed that fails is one error row.

Element names, header names and the page patterns here are fixed values of the formats read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scalars as S
from feedloom.functions.texts import unescaped
from feedloom.operators.reports import LINE_END

_RSS_ITEM = "struct<title:string,link:string,description:string,pubDate:string,bookmarkcount:string>"
_RSS = f"channel struct<item:array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>"
_ATOM = "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:struct<_VALUE:string>,updated:string>>"


def rss_items(feeds: DataFrame, body: str = "body", cap: int = 200, per_feed: int | None = None, tags: bool = True) -> DataFrame:
    """(source, ord, title, url, description, published, bookmarks, error): items of RSS 2.0 or RDF; Atom where there are none.

    Descriptions lose their tags unless tags is false. Bookmarks that are no number count 0; a feed without items that can't be read gives one row with its error.
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
    parsed = feeds.withColumns({"_r": F.from_xml(F.col(body), _RSS, options), "_a": F.from_xml(F.col(body), _ATOM, options)})
    rss = F.coalesce(F.when(F.size("_r.channel.item") > 0, F.col("_r.channel.item")), F.col("_r.item"))
    atom = F.transform("_a.entry", lambda e: F.struct(
        e["title"].alias("title"), F.coalesce(F.try_element_at(e["link"], F.lit(1))["_href"], F.lit("")).alias("link"),
        F.coalesce(e["summary"], e["content"]["_VALUE"]).alias("description"), e["updated"].alias("pubDate"), F.lit(None).cast("string").alias("bookmarkcount")))
    items = parsed.withColumn("_items", F.coalesce(F.when(F.size(rss) > 0, rss), F.when(F.size(atom) > 0, atom)))
    if per_feed:
        items = items.withColumn("_items", F.slice("_items", 1, per_feed))
    good = items.select("source", F.posexplode("_items").alias("ord", "i"))
    rows = good.select("source", "ord", F.coalesce("i.title", F.lit("")).alias("title"), S.strip(F.coalesce("i.link", F.lit(""))).alias("url"),
                       F.substring(S.strip_tags(F.coalesce("i.description", F.lit(""))) if tags else F.coalesce("i.description", F.lit("")), 1, cap).alias("description"), S.mail_date(F.col("i.pubDate")).alias("published"),
                       S.coerce_int(F.col("i.bookmarkcount")).alias("bookmarks"), F.lit(None).cast("string").alias("error"))
    bad = items.where("_items is null").select("source", F.lit(0).alias("ord"), F.lit("").alias("title"), F.lit("").alias("url"), F.lit("").alias("description"), F.lit(None).cast("string").alias("published"), F.lit(0).cast("long").alias("bookmarks"), F.lit("no items").alias("error"))
    return rows.unionByName(bad)


def linked_entries(entries: DataFrame) -> DataFrame:
    """Entries (url, content, ...) of a link aggregator: orig_url is the address behind '[link]' in the content, unescaped once
    more; an entry without one is a discussion, whose own address it is. Such feeds have no counts: 0."""
    behind = F.regexp_extract(unescaped(F.coalesce("content", F.lit(""))), r'href="([^"]+)">\[link\]', 1)
    return entries.withColumns({"orig_url": S.first_truthy(behind, F.col("url"), default=""), "score": F.lit(0), "num_comments": F.lit(0)})


def configured_items(feeds: DataFrame, config: DataFrame, body: str = "body", most: int = 20) -> DataFrame:
    """(source, category, ord, title, url, description, published) of configured feeds: config has name, url, category and
    max_items, each of which may be null; feeds has url and body.

    Entries without an address of the feed are skipped, and so are feeds that can't be read or are missing. Descriptions have
    their tags off, are cut at 500 characters and then stripped.
    """
    wanted = config.where(F.coalesce("url", F.lit("")) != "").select("url", F.coalesce("name", F.lit("Unknown")).alias("_name"), F.coalesce("category", F.lit("Tech")).alias("category"), F.coalesce("max_items", F.lit(most)).alias("_most"))
    bodies = wanted.join(feeds.select("url", body), "url").select(F.concat_ws("\x1f", "url", "_name").alias("source"), F.col(body).alias("body"))
    rows = rss_items(bodies, "body", cap=500).where("error is null")
    at = F.split("source", "\x1f")
    named = rows.select(at[0].alias("_feed"), at[1].alias("source"), "ord", S.strip(F.col("title")).alias("title"), F.col("url"), S.strip(F.col("description")).alias("description"), F.coalesce("published", F.lit("")).alias("published"))
    limits = wanted.select(F.col("url").alias("_feed"), F.col("_name").alias("source"), "category", "_most")
    return named.join(limits, ["_feed", "source"]).where("ord < _most").drop("_feed", "_most")


def paced(responses: DataFrame, group: str, buffer: float = 2.0, most: float = 70.0, tries: int = 2) -> DataFrame:
    """(group, ord, attempt, waited, status, used) of requests made one after another: responses has (group, ord, attempt,
    raw). Each waits for the reset the last answer named plus a buffer, at most so long; an answer that isn't 200 (or has no
    status line) is asked for again, tries times in all; used marks the answer that counts.

    A request only waits for the one before it, so the chain is a window over the requests of one group.
    """
    parts = response_parts(responses)
    good = F.col("status").isNull() | (F.col("status") == 200)
    first = F.min(F.when(good, F.col("attempt"))).over(Window.partitionBy(group, "ord"))
    asked = parts.withColumn("_first", first).where((F.col("attempt") < tries) & (F.col("_first").isNull() | (F.col("attempt") <= F.col("_first"))))
    before = F.lag(F.coalesce(F.col("reset_seconds") + buffer, F.lit(0.0))).over(Window.partitionBy(group).orderBy("ord", "attempt"))
    return asked.select(group, "ord", "attempt", F.least(F.coalesce(before, F.lit(0.0)), F.lit(most)).alias("waited"), "status", good.alias("used"))


def language_sections(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lang, body): the parts of a bilingual text by its markers, stripped; what stands before the first marker is no
    part, and of a language marked twice the last part counts."""
    marker = r"(?i)<!--\s*lang:(zh|en)\s*-->"
    pieces = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), LINE_END)).alias("pos", "line"))
    lang = F.when(F.col("line").rlike(marker), F.lower(F.regexp_extract("line", marker, 1)))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = pieces.withColumns({"_n": F.count(lang).over(w), "_lang": F.last(lang, ignorenulls=True).over(w), "_mark": lang.isNotNull()}).where("_n > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_mark"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    whole = parts.groupBy(key, "_lang", "_n").agg(S.strip(body).alias("body"))
    return whole.groupBy(key, F.col("_lang").alias("lang")).agg(F.max_by("body", "_n").alias("body"))


def published_histories(files: DataFrame, names: dict[str, str]) -> DataFrame:
    """(name, body): history files (name, body) under the name they are published by; only those that are JSON lists."""
    to = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    listed = F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("ARRAY"), F.lit(False))
    return files.where(listed).select(F.try_element_at(to, F.col("name")).alias("name"), "body").where("name is not null")


def alerts_of(files: DataFrame, key: str) -> DataFrame:
    """(key, step, error) of alert files (key, body): an object of steps, each with an object that has an error, or of older
    form with a bare text, whose error is unknown (null). Files that are no objects have no alerts."""
    v = F.try_parse_json("body")
    steps = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
    rows = files.select(key, F.explode(steps).alias("step", "_v"))
    return rows.select(key, "step", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.coalesce(F.try_variant_get("_v", "$.error", "string"), F.lit(""))).alias("error"))


def top_comments(trees: DataFrame, children: str = "children", top: int = 10, cap: int = 300, tags: bool = True) -> DataFrame:
    """(item_id, comments): of the first `top` children those with text, without tags, cut at `cap`; deleted ones dropped."""
    first = F.slice(F.coalesce(F.col(children), F.array()), 1, top)
    kept = F.filter(first, lambda c: c.isNotNull() & (F.trim(c) != "") & ~c.isin("[deleted]", "[removed]"))
    return trees.select("item_id", F.transform(kept, lambda c: F.substring(S.strip(S.strip_tags(c)) if tags else c, 1, cap)).alias("comments"))


def front_page(pages: DataFrame) -> DataFrame:
    """(source, ord, item, title, url, item_url, score, comments) of front pages (source, html).

    A page is cut at the rows of its items; each piece holds the item with its title, and its points and comments in the row
    below. Missing counts are 0. An item that links to nowhere else links to itself. A row without a title is no item.
    """
    pieces = pages.select("source", F.posexplode(F.split("html", r"(?=<tr class=\"athing submission\" id=\")")).alias("_at", "_p"))
    part = lambda pattern, i=1: F.regexp_extract("_p", pattern, i)
    link = r"<span class=\"titleline\"><a href=\"([^\"]+)\">([^<]+)</a>"
    named = pieces.select("source", "_at", part(r"^<tr class=\"athing submission\" id=\"(\d+)\">").alias("item"), part(link).alias("_to"), S.strip(part(link, 2)).alias("title"), "_p").where("item <> '' and _to <> ''")
    own = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("item"))
    count = lambda pattern: F.coalesce(F.when(part(pattern) == F.col("item"), part(pattern, 2).try_cast("long")), F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("_at")) - 1
    return named.select("source", place.alias("ord"), "item", "title", F.when(F.col("_to").startswith("http"), F.col("_to")).otherwise(own).alias("url"), own.alias("item_url"),
                        count(r"id=\"score_(\d+)\">(\d+) points").alias("score"), count(r"item\?id=(\d+)\">(\d+)&nbsp;comment").alias("comments"))


def rendered(urls: DataFrame, render, most: int = 8000) -> DataFrame:
    """(url, html, title, error) of addresses by render(url) -> (html, title), each in its batch; html is cut at `most`
    characters, and an address that fails has its error instead. render must be one a worker can run."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for url in f["url"]:
                try:
                    html, title = render(url)
                    rows.append((url, html[:most], title, None))
                except Exception as problem:
                    rows.append((url, None, None, str(problem)[:300]))
            yield pd.DataFrame(rows, columns=["url", "html", "title", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, title string, error string")


def link_contents(fetched: DataFrame) -> DataFrame:
    """(url, kind, title, content, comments) of fetched addresses (url, body), by the class of the address.

    Items and threads come as JSON: their own text, and the texts of the first five children, or of the first eight comments
    cut at 500 characters each, without the empty ones. Other pages are their body. Addresses of the closed service have a
    note instead. Contents are cut at 6000 and 4000 characters, comments at 1000.
    """
    kind = S.classify_url(F.col("url"))
    v = F.try_parse_json("body")
    get = lambda path, to="string": F.try_variant_get(v, path, to)
    texts = lambda path, field, n: F.filter(F.transform(F.slice(F.coalesce(get(path, "array<variant>"), F.array().cast("array<variant>")), 1, n), lambda c: F.try_variant_get(c, field, "string")), lambda t: t.isNotNull() & (t != ""))
    post = "$[0].data.children[0].data"
    item = F.struct(F.coalesce(get("$.title"), F.col("url")).alias("title"), F.coalesce(get("$.text"), F.lit("")).alias("content"), F.array_join(texts("$.children", "$.text", 5), "\n").alias("comments"))
    thread = F.struct(F.coalesce(get(f"{post}.title"), F.col("url")).alias("title"), F.coalesce(get(f"{post}.selftext"), F.lit("")).alias("content"),
                      F.array_join(F.transform(texts("$[1].data.children", "$.data.body", 8), lambda t: F.substring(t, 1, 500)), "\n").alias("comments"))
    closed = F.struct(F.lit("[Twitter/X]").alias("title"), F.lit("").alias("content"), F.lit("").alias("comments"))
    page = F.struct(F.col("url").alias("title"), F.substring(F.coalesce("body", F.lit("")), 1, 6000).alias("content"), F.lit("").alias("comments"))
    picked = F.when(kind == "hn", item).when(kind == "reddit", thread).when(kind == "twitter", closed).otherwise(page)
    return fetched.select("url", kind.alias("kind"), picked.alias("_c")).select("url", "kind", "_c.title", F.substring("_c.content", 1, 4000).alias("content"), F.substring("_c.comments", 1, 1000).alias("comments"))


def response_parts(raw: DataFrame) -> DataFrame:
    """(status, reset_seconds, body) of a raw response with headers, header names in any case; all of it is the body where it
    has no status line."""
    status = F.regexp_extract("raw", r"HTTP/\S+\s+(\d{3})", 1).try_cast("int")
    head = F.regexp_extract("raw", r"(?s)^(.*?)(?:\r?\n\r?\n|$)", 1)
    reset = F.regexp_extract(head, r"(?im)^x-ratelimit-reset:\s*([0-9.]+)", 1).try_cast("double")
    rest = F.when(F.col("raw").rlike(r"\r?\n\r?\n"), F.regexp_replace("raw", r"(?s)\A.*?\r?\n\r?\n", "")).otherwise("")
    return raw.withColumns({"status": status, "reset_seconds": F.when(status.isNotNull(), reset), "body": F.when(status.isNull(), F.col("raw")).otherwise(rest)})
