"""Pages: main text, title, date, links, and what is derived from them. One pass of the HTML parser per page, in Arrow batches."""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom import lexicons as lex
from corpusloom.functions.scalars import hit_date, hit_type, is_binary_url, normalize_url, resolve_url, url_host, url_path

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is dropped.
_DROP = frozenset("script style noscript svg canvas iframe form nav footer header aside".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Meta elements that hold a date, in order.
_META = [("property", "article:published_time"), ("name", "pubdate"), ("name", "publishdate"), ("name", "date"), ("name", "DC.date"), ("name", "DC.Date"), ("name", "DCTERMS.issued")]
#: Dates in a page's text, and the date that marks an item of a list, an abbreviated month with a dot.
_DATE = re.compile(r"\b20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b\d{1,2}\s+[A-Za-z]{3,9}\s+20\d{2}\b|\b[A-Za-z]{3,9}\.?\s+\d{1,2},\s*20\d{2}\b")
_ITEM_DATE = re.compile(r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.\s*\d{1,2},\s*\d{4}\b")
_NAV = re.compile(lex.NAVIGATION_WORDS, re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: "Node | None" = None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], parent

    def walk(self, skip: frozenset[str] = frozenset()) -> Iterator["Node | str"]:
        todo: list = [self]
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo.extend(k for k in reversed(x.kids) if isinstance(k, str) or k.tag not in skip)

    def all(self, *tags: str, skip: frozenset[str] = frozenset()) -> list["Node"]:
        return [x for x in self.walk(skip) if isinstance(x, Node) and x is not self and x.tag in tags]

    def text(self, glue: str = " ", skip: frozenset[str] = frozenset()) -> str:
        return glue.join(s for x in self.walk(skip) if isinstance(x, str) and (s := x.strip()))


class _Tree(HTMLParser):
    """A forgiving tree: unclosed elements end with their parent, paragraphs and list items with the next one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        ends = _CLOSES.get(tag)
        if ends and self.at.tag in ends:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _classes(n: Node) -> list[str]:
    return n.attrs.get("class", "").split()


def main_page(html: str | None) -> dict:
    """Title, date, main text, link density and raw links of a page."""
    root = parse(html)
    heads = [t for n in root.all("h1", skip=_DROP)[:1] if (t := n.text(skip=_DROP))]
    titles = [n.text("") for n in root.all("title", skip=_DROP)[:1]]
    date = ""
    metas = root.all("meta", skip=_DROP)
    for key, value in _META:
        m = next((m for m in metas if m.attrs.get(key) == value), None)
        if m is not None and m.attrs.get("content"):
            date = m.attrs["content"].strip()
            break
    if not date:
        for t in root.all("time", skip=_DROP)[:1]:
            date = (t.attrs.get("datetime") or t.text(skip=_DROP)).strip()
    if not date:
        found = _DATE.search(root.text(skip=_DROP))
        date = found[0] if found else ""

    def chosen(n: Node) -> bool:
        c = _classes(n)
        return n.tag in ("article", "main") or n.tag == "div" and (n.attrs.get("id") == "content" or any(x in c for x in ("content", "article", "post"))) or n.tag == "section" and any(x in c for x in ("content", "article"))

    blocks = root.all("article", "main", "div", "section", skip=_DROP)
    candidates = [n for n in blocks if chosen(n)] or blocks
    best, most = None, None
    for n in candidates:
        size = len(n.text(skip=_DROP))
        if size < 200:
            continue
        score = size - 2 * len(" ".join(a.text(skip=_DROP) for a in n.all("a", skip=_DROP)))
        if most is None or score > most:
            best, most = n, score
    if best is None:
        best = next(iter(root.all("body", skip=_DROP)), root)
    size = len(best.text(skip=_DROP))
    density = len(" ".join(a.text(skip=_DROP) for a in best.all("a", skip=_DROP))) / size if size else 1.0
    lines = (x.strip() for x in re.sub(r"\n{3,}", "\n\n", best.text("\n", skip=_DROP)).splitlines())
    text = "\n".join(x for x in lines if len(x) > 2 and not _NAV.fullmatch(x))
    links = [h for a in root.all("a", skip=_DROP) if (h := a.attrs.get("href", "").strip()) and not h.startswith(("mailto:", "javascript:", "tel:"))]
    return {"title": (heads or titles or [""])[0], "date": date, "text": text, "link_density": density, "hrefs": links}


def _batches(df: DataFrame, columns: list[str], one, schema: str) -> DataFrame:
    """Applies `one(html) -> dict or list of dicts` to the last column of each row, and keeps the others."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for values in pdf.itertuples(index=False, name=None):
                got = one(values[-1])
                for g in got if isinstance(got, list) else [got]:
                    rows.append((*values[:-1], *g.values()))
            yield pd.DataFrame(rows, columns=[c.split()[0].strip("`") for c in schema.split(", ")])

    return df.select(*columns).mapInPandas(run, schema)


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """`url, title, date, text, link_density, page_links`; links are absolute, without fragment, each once in the order of the page. Null pages are empty."""
    raw = _batches(pages.select(F.col(url).alias("url"), F.col(html).alias("html")), ["url", "html"], main_page, "url string, title string, date string, text string, link_density double, hrefs array<string>")

    def absolute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import urldefrag, urljoin

        def one(base, hrefs):
            out = {}
            for h in hrefs:
                try:
                    u = urldefrag(urljoin(base or "", h))[0].strip()
                except ValueError:
                    continue
                if u:
                    out[u] = None
            return list(out)

        for pdf in parts:
            pdf["page_links"] = [one(b, h) for b, h in zip(pdf["url"], pdf.pop("hrefs"))]
            yield pdf

    return raw.mapInPandas(absolute, "url string, title string, date string, text string, link_density double, page_links array<string>")


def is_directory(text: Column | str = "text", density: Column | str = "link_density", links: Column | str = "page_links") -> Column:
    """Little text with many links, or pager words with very many."""
    t, d, n = (F.col(c) if isinstance(c, str) else c for c in (text, density, links))
    size, n = F.length(F.trim(F.coalesce(t, F.lit("")))), F.coalesce(F.size(n), F.lit(0))
    pager = F.coalesce(t, F.lit("")).rlike(r"(?i)(page\s*\d+|pagination|next|previous|older|newer|archives?)")
    return ((size < 300) & ((n > 60) | (F.coalesce(d, F.lit(1.0)) > 0.35))) | ((size < 180) & (n > 20)) | (pager & (n > 50))


def link_score(url: Column | str) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    path = F.lower(url_path(u))
    query = F.lower(F.regexp_extract(u, r"\?([^#]*)", 1))
    depth = F.size(F.split(F.trim(path, F.lit("/")), "/"))
    points = [
        (path.rlike(r"/(news|press|siaran-pers|transkrip|speech|speeches|view|post|article|berita|detail|statement|release)/"), 5),
        (path.rlike(r"/\d{4}/\d{1,2}/\d{1,2}/"), 4),
        (path.rlike(r"\d{4,}"), 2),
        (depth >= 3, 1),
        (query.contains("page="), -3),
        (path.rlike(r"/(category|categories|tag|search|index|list|lists|archive|page)/"), -4),
    ]
    return sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0))


def article_links(pages: DataFrame, k: int = 3) -> DataFrame:
    """`url, link, score, rank`: the k best article links of a page on its own host; equal scores in the order of the page."""
    each = pages.select("url", F.posexplode("page_links").alias("pos", "link")).withColumn("link", normalize_url("link"))
    same = each.where(F.col("link").rlike("^https?://") & (url_host("link") == url_host("url")) & (F.col("link") != normalize_url("url")))
    kept = same.where(~F.lower(url_path("link")).rlike(r"\.(" + "|".join(lex.MEDIA_EXTENSIONS) + r")$")).withColumn("score", link_score("link")).where("score > 0")
    once = kept.groupBy("url", "link", "score").agg(F.min("pos").alias("pos"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("url").orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= k).select("url", "link", "score", "rank")


def crawl_records(seeds: DataFrame, fetched: DataFrame, k: int = 3) -> DataFrame:
    """The crawl log of seeds, from a table of fetched pages.

    `seeds`: `src_file, src_line, seed_url`; `fetched`: `url, final_url, via, http_status, content_type, html, binary_text`, one row for each
    address. Each seed gives a record; directory pages are followed to their k best article links, which give one each, unless a seed
    or an earlier directory has that address. Columns: those of the log without `timestamp`.
    """
    from corpusloom.plans.shared import settle

    order = W.partitionBy("seed_url").orderBy("src_file", "src_line")
    seeds = seeds.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    extracted = extract_pages(fetched.where(F.col("html").isNotNull()).select(F.col("url"), F.col("html")))
    page = settle(fetched.withColumn("has_html", F.col("html").isNotNull()).drop("html").join(extracted.withColumnRenamed("url", "u"), F.col("url") == F.col("u"), "left").drop("u"))
    base = seeds.join(page, F.col("seed_url") == F.col("url"), "left")
    binary = is_binary_url("seed_url")
    final = F.coalesce("final_url", "seed_url")
    ext = F.regexp_extract(F.lower(url_path(final)), r"\.([^.]*)$", 1)
    kind = F.when(F.lower(F.coalesce("content_type", F.lit(""))).contains("pdf") | (ext == "pdf"), "pdf").when(ext == "docx", "docx")
    full = F.length(F.coalesce("binary_text", F.lit(""))) > 0
    directory = F.coalesce(F.col("has_html") & is_directory(), F.lit(False)) & ~binary
    note = (
        F.when(binary & F.col("binary_text").isNull(), "binary_fetch_failed")
        .when(binary, F.coalesce(F.concat(kind, F.when(full, "_extracted").otherwise("_no_text")), F.lit("binary_unsupported")))
        .when(~F.coalesce("has_html", F.lit(False)), "fetch_failed")
        .when(directory, "directory")
        .otherwise("ok")
    )
    text = F.when(binary, F.coalesce("binary_text", F.lit(""))).when(directory, "").otherwise(F.coalesce("text", F.lit("")))
    title = F.when(binary & kind.isNotNull(), F.regexp_extract(url_path(final), r"([^/]*)$", 1)).otherwise(F.coalesce("title", F.lit("")))
    out = lambda df, *last: df.select("src_file", "src_line", "seed_url", final.alias("final_url"), "via", "http_status", "content_type", *last)
    first = out(base, directory.alias("is_directory"), F.lit(False).alias("followed_from_directory"), title.alias("title"), F.coalesce("date", F.lit("")).alias("date"), text.alias("text"), note.alias("note"))
    parents = base.where(directory).select("src_file", "src_line", "seed_url", final.alias("url"), "page_links")
    links = article_links(parents, k).withColumnRenamed("url", "parent")
    follow = parents.select("src_file", "src_line", "seed_url", F.col("url").alias("parent")).join(links, "parent").join(seeds.select(F.col("seed_url").alias("link")), "link", "left_anti")
    follow = follow.withColumn("_n", F.row_number().over(W.partitionBy("link").orderBy("src_file", "src_line", "rank"))).where("_n = 1")
    second = follow.select("src_file", "src_line", "seed_url", "link").join(page, F.col("link") == F.col("url"), "left").withColumn("final_url", F.coalesce("final_url", "link"))
    ok = F.coalesce(F.col("has_html"), F.lit(False))
    second = out(second, (ok & is_directory()).alias("is_directory"), F.lit(True).alias("followed_from_directory"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("text", F.lit("")).alias("text"), F.when(ok, "follow_ok").otherwise("follow_fetch_failed").alias("note"))
    return first.unionByName(second)


_BODY = re.compile("content|article|main", re.I)


def _body(root: Node) -> Node | None:
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.tag == "div" and _BODY.search(n.attrs.get("class", "")), lambda n: n.tag == "body"):
        for n in root.walk():
            if isinstance(n, Node) and test(n):
                return n
    return None


def site_article(html: str | None, tags: tuple[str, ...] = ("p", "h1", "h2", "h3", "h4", "h5", "h6"), least: int = 15, navigation: list[str] | None = lex.NAVIGATION_ZH, heads: tuple[str, ...] = ("h1", "h2", ".article-title", "title")) -> dict:
    """Title and paragraphs of a site's article page: each paragraph once, short ones and short ones with navigation words left out."""
    root = parse(html)
    title = ""
    for h in heads:
        n = next((x for x in root.walk() if isinstance(x, Node) and (x.tag == "div" and h[1:] in _classes(x) if h[0] == "." else x.tag == h)), None)
        if n is not None:
            title = n.text("").strip()
            if len(title) > 5:
                break
    skip = frozenset(("script", "style", "nav", "footer", "header", "iframe", "noscript"))
    body = _body(root)
    lines = {}
    for p in body.all(*tags, skip=skip) if body is not None else []:
        text = "".join(x for x in p.walk(skip) if isinstance(x, str)).strip()
        if len(text) >= least and not (navigation and len(text) < 50 and any(w in text for w in navigation)):
            lines[text] = None
    return {"title": title, "content": "\n\n".join(lines)}


def site_articles(pages: DataFrame, strict: bool = False) -> DataFrame:
    """`url, title, content` by the site parsers; `strict` takes paragraphs and small headings of 30 characters at least."""
    one = (lambda h: site_article(h, ("p", "h2", "h3"), 30, None, ("h1", "h2", "title"))) if strict else site_article
    return _batches(pages, ["url", "html"], one, "url string, title string, content string")


def keyword_links(pages: DataFrame, keyword: str) -> DataFrame:
    """`url, link, anchor`: links whose anchor contains the keyword, resolved against the page."""
    one = lambda h: [{"href": a.attrs["href"].strip(), "anchor": t} for a in parse(h).all("a") if a.attrs.get("href") and keyword in (t := a.text())]
    return _batches(pages, ["url", "html"], one, "url string, href string, anchor string").select("url", resolve_url("url", "href").alias("link"), "anchor").dropDuplicates(["url", "link"])


def dated_items(pages: DataFrame, domain: str) -> DataFrame:
    """`url, link, title`: list items with a date whose first link is an article page; each link once."""

    def one(h):
        rows = {}
        for li in parse(h).all("li"):
            a = next((a for a in li.all("a") if "href" in a.attrs), None)
            if a is None or not _ITEM_DATE.search(li.text()):
                continue
            href = a.attrs["href"].strip()
            link = domain + href if href.startswith("/") else href if href.startswith("http") else None
            if link and "/p/" in link.lower() and link.lower().endswith(".html") and len(t := a.text("")) >= 10:
                rows.setdefault(link, t)
        return [{"link": k, "title": v} for k, v in rows.items()]

    return _batches(pages, ["url", "html"], one, "url string, link string, title string")


def search_hits(pages: DataFrame) -> DataFrame:
    """`url, title, link, description, link_type, hit_date` of saved result pages; internal, relative, untitled and skipped hits left out."""

    def one(h):
        root = parse(h)
        divs = root.all("div")
        blocks = [d for d in divs if "g" in _classes(d)] or [d for d in divs if d.attrs.get("data-sokoban-container")]
        if not blocks:
            for x in root.all("h3"):
                p = x.parent
                while p is not None and p.tag != "div":
                    p = p.parent
                if p is not None:
                    blocks.append(p)
        rows = []
        for d in blocks:
            a = next((a for a in d.all("a") if "href" in a.attrs), None)
            link = a.attrs["href"] if a is not None else ""
            title = next((x.text("") for x in d.all("h3")), "")
            if not link.startswith("http") or "google.com/search" in link or not title:
                continue
            about = next((x.text("") for c in ("VwiC3b", "IsZvec", "lEBKkf") for x in d.all("div") if c in _classes(x)), "") or next((x.text("") for x in d.all("span") if "aCOpRe" in _classes(x)), "")
            rows.append({"title": title, "link": link, "description": about})
        return rows

    raw = _batches(pages, ["url", "html"], one, "url string, title string, link string, description string")
    kept = raw.select("url", "title", "link", "description", hit_type("title", "link").alias("link_type"), hit_date("title", "description", "link").alias("hit_date"))
    return kept.where(F.col("link_type").isNotNull()).select("url", F.substring("title", 1, 200).alias("title"), "link", F.substring("description", 1, 300).alias("description"), "link_type", "hit_date")
