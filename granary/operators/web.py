"""Web text: titles, links, application shells, Markdown, paragraph dedup and filtering of search results."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators.similar import first_unlike
from granary.sources.files import kept

#: Elements that are no content, and class or id names of such.
NOISE_TAGS = "script style nav footer header aside noscript iframe svg form button".split()
NOISE_NAMES = re.compile("nav|menu|sidebar|footer|header|banner|ad-|advertisement|popup|modal|comment|share|social|related|recommend|widget|pagination|breadcrumb|toc|table-of-contents|skip-link|screen-reader|sr-only|visually-hidden|cookie|consent|newsletter|intercom|drift|chat-widget", re.I)
#: Files that links to are not followed.
ASSETS = r"\.(jpg|png|gif|pdf|zip|mp4|mp3|css|js|ico|svg)$"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def page_title(html: Column, url: Column) -> Column:
    """og:title, else the title, else the first h1, else the address."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")), F.lit(""))
    og = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]*content=["']([^"']*)["']""", 1)
    return F.coalesce(clean(og), clean(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), clean(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1)), url)


def shell_page(html: Column) -> Column:
    """Whether a page is a script that draws itself: 1000 characters or more, over 30 % scripts, under 500 of visible text."""
    scripts = F.aggregate(F.regexp_extract_all(html, F.lit("(?is)<script[^>]*>.*?</script>"), F.lit(0)), F.lit(0), lambda s, x: s + F.length(x))
    visible = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " "))
    return (F.length(html) >= 1000) & (scripts > 0.3 * F.length(html)) & (F.length(visible) < 500)


def page_links(pages: DataFrame, most: int | None = None, id_col: str = "page_id") -> DataFrame:
    """page_id, position and link: links to the same host that look like content, in order, once each place."""
    href = F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href=["']([^"'#][^"']*)["']"""), F.lit(1))).alias("position", "href")
    raw = pages.select(id_col, "url", href)
    host, scheme = F.try_parse_url("url", F.lit("HOST")), F.try_parse_url("url", F.lit("PROTOCOL"))
    link = F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("//"), F.concat(scheme, F.lit(":"), "href")).when(F.col("href").startswith("/"), F.concat(scheme, F.lit("://"), F.try_parse_url("url", F.lit("AUTHORITY")), "href")).otherwise(F.concat(F.regexp_extract("url", r"^(.*/)", 1), "href"))
    found = raw.withColumn("link", link).where((F.try_parse_url("link", F.lit("HOST")) == host) & ~F.lower(F.coalesce(F.try_parse_url("link", F.lit("PATH")), F.lit(""))).rlike(ASSETS))
    out = found.select(id_col, "position", "link")
    if most is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("position"))).where(F.col("_n") <= most).drop("_n")


def crawl(pages: DataFrame, start: str | DataFrame, most_rounds: int | None = 5, most_pages: int | None = None) -> DataFrame:
    """url and depth of the pages of the starts' hosts that links reach, breadth first over a table of pages. start: a url, or a table of
    them. most_rounds: None goes on until a round finds no new page. Each round's pages are written to the shared folder."""
    links = kept(page_links(pages).join(pages.select("page_id", "url"), "page_id").select(F.col("url").alias("from"), F.regexp_replace("link", "#.*$", "").alias("url")).distinct())
    known = pages.select("url").distinct()
    starts = pages.sparkSession.createDataFrame([(start,)], "url string") if isinstance(start, str) else start.select("url")
    seen, depth = kept(known.join(starts.distinct(), "url", "left_semi").withColumn("depth", F.lit(0))), 0
    new = seen
    while most_rounds is None or depth < most_rounds:
        depth += 1
        reached = links.join(new.select(F.col("url").alias("from")), "from").select("url").distinct()
        new = kept(reached.join(known, "url", "left_semi").join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen.orderBy("depth", "url").limit(most_pages) if most_pages else seen


class _Markdown(HTMLParser):
    """Text of a page as Markdown: headings, paragraphs, lists, links, emphasis, code, tables' cells. The first article, else
    main, is taken alone; else the body without noise."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.skip = self.pre = 0
        self.href: list[str] = []

    def handle_starttag(self, tag, attrs):
        names = dict(attrs)
        noise = tag in NOISE_TAGS or bool(NOISE_NAMES.search(f"{names.get('class') or ''} {names.get('id') or ''}") and tag not in ("html", "body", "article", "main"))
        if tag in _VOID:
            if tag == "br" and not self.skip:
                self.out.append("\n")
            return
        self.stack.append((tag, noise))
        self.skip += noise
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append(f"\n\n{'#' * int(tag[1])} ")
        elif tag in ("p", "div", "section", "table", "ul", "ol", "blockquote"):
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "tr":
            self.out.append("\n| ")
        elif tag == "pre":
            self.pre += 1
            language = re.search(r"language-([\w+-]+)", names.get("class") or "")
            self.out.append(f"\n\n```{language[1] if language else ''}\n")
        elif tag == "a":
            self.href.append(names.get("href") or "")
            self.out.append("[")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")

    def handle_endtag(self, tag):
        if tag in _VOID or not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, noise = self.stack.pop()
            if not self.skip:
                self._close(t)
            self.skip -= noise
            if t == tag:
                return

    def _close(self, tag: str) -> None:
        if tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag == "pre":
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif re.fullmatch("h[1-6]|p|table|ul|ol", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_markdown(html: str | None) -> str:
    if not html:
        return ""
    for tag in ("article", "main"):
        if inner := re.search(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", html):
            html = inner[1]
            break
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = "\n".join(line.rstrip() for line in "".join(parser.out).split("\n"))
    return paragraph_dedup_text(re.sub(r"\n{3,}", "\n\n", text).strip())


def paragraph_dedup_text(text: str) -> str:
    seen, kept = set(), []
    for block in text.split("\n\n"):
        key = re.sub(r"\s+", " ", block.strip())
        if len(key) < 10 or key[:80] not in seen:
            kept.append(block)
        if len(key) >= 10:
            seen.add(key[:80])
    return "\n\n".join(kept).strip()


def _unrepeated(text: str) -> str:
    seen, kept = set(), []
    for block in text.split("\n\n"):
        key = re.sub(r"\s+", " ", block, flags=re.ASCII).strip(" ")[:80]
        if len(key) < 10 or key not in seen:
            kept.append(block)
            seen.add(key)
    return "\n\n".join(kept).strip(" ")


def paragraph_dedup(text: Column) -> Column:
    """The text without paragraphs whose first 80 characters, white space aside, came before; those of under 10 stay. One set for each
    text, so that long ones take no longer by the byte."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(_unrepeated, na_action="ignore")

    return run(text)


def to_markdown(html: Column) -> Column:
    @F.pandas_udf("string")
    def convert(pages):
        return pages.map(html_markdown)

    return convert(html)


def json_text(raw: Column, depth: int = 5) -> Column:
    """The texts over ten characters under well-known keys of a JSON answer, as sections; the raw text if it is no JSON object."""
    wanted = ("content", "text", "question", "answer", "title", "description", "body", "summary")

    def walk(node, level, out):
        if level > depth:
            return
        for key, value in node.items():
            if key.lower() in wanted and isinstance(value, str) and len(value) > 10:
                out.append(f"## {key.lower()}\n\n{value}\n\n")
            for child in [value] if isinstance(value, dict) else value if isinstance(value, list) else []:
                if isinstance(child, dict):
                    walk(child, level + 1, out)

    @F.pandas_udf("string")
    def read(values):
        def one(x):
            try:
                node = json.loads(x)
            except (TypeError, ValueError):
                return x
            if not isinstance(node, dict):
                return x
            out: list[str] = []
            walk(node, 0, out)
            return "".join(out)

        return values.map(one)

    return read(raw)


#: Marks of advertising in results.
LOW_QUALITY = r"(?i)(广告|推广|下载\s*APP|点击.*领|免费.*领取|充值|优惠券|限时.*抢|加微信|扫码|关注公众号)"


def filter_results(results: DataFrame, today: str, trusted: list[str], most: int, group: str = "query_id", threshold: float = 0.8) -> DataFrame:
    """Search results (query_id, position, name, snippet, url, published) without blank, advertising and near-duplicate ones, best first:
    3 for a trusted domain and up to 3 for recency, then by position. A result goes if its title is like one that stayed before it.
    Titles alone are compared, see similar.first_unlike(); a position is one result of its query. Titles and scores are stored once, and
    snippets are made again only for the results that stay."""
    blank = (F.trim("name") == "") & (F.trim("snippet") == "")
    good = ~blank & ~F.col("snippet").rlike(LOW_QUALITY) & ~F.col("name").rlike(LOW_QUALITY)
    score = F.when(X.domain(F.col("url")).isin(trusted), 3).otherwise(0) + X.recency(X.iso_date(F.col("published")), F.to_date(F.lit(today)))
    scored = kept(results.select(group, F.col("position").alias("place"), "name", score.alias("score"), good.alias("good"))).where("good")  # a column, as Spark would make names again for a filter
    stay = first_unlike(scored.select(group, "place", "name", F.array_sort(X.title_bigrams(F.col("name"))).alias("tokens")), group, threshold)
    ranked = scored.select(group, "place", "score").join(stay, [group, "place"], "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "place")))
    best = kept(ranked.where(F.col("rank") <= most).withColumnRenamed("place", "position"))
    return results.select(group, "position", "name", "snippet", "url", "published").join(best, [group, "position"], "left_semi").join(best, [group, "position"])


def parse_results(raw: DataFrame, column: str = "raw", least: int = 40, most: int = 4) -> DataFrame:
    """title, url, text and published of search answers: JSON with url at any depth, or blocks of Title:, URL: and Text: lines; each
    public address once, texts of `least` characters or more, `most` for each answer."""
    schema = "position int, title string, url string, text string, published string"

    def blocks(text):
        for block in re.split(r"(?m)(?=^Title:)", text):
            line = lambda name, b=block: (re.search(rf"(?m)^{name}:\s*([^\r\n]*)", b) or ["", ""])[1].strip()
            if body := re.search(r"(?is)(?:^|\n)(?:Text|Content|Summary|Highlights):\s*(.*)", block):
                yield line("Title"), line("URL"), body[1], line("Published Date") or line("Published")

    def walk(node):
        if isinstance(node, list):
            for x in node:
                yield from walk(x)
        elif isinstance(node, dict):
            if "url" in node:
                yield node.get("title") or node.get("name") or "", node["url"], node.get("text") or node.get("content") or node.get("snippet") or "", node.get("publishedDate") or ""
            for key in ("results", "data", "result", "content"):
                yield from walk(node.get(key))
            if isinstance(node.get("text"), str) and "url" not in node:
                try:
                    yield from walk(json.loads(node["text"]))
                except ValueError:
                    yield from blocks(node["text"])

    def parse(value):
        found = []
        try:
            found = list(walk(json.loads(value)))
        except (TypeError, ValueError):
            pass
        return [{"position": i, "title": str(t), "url": str(u), "text": str(x)[:4200], "published": str(p)} for i, (t, u, x, p) in enumerate(found or list(blocks(value or "")))]

    @F.udf(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>", useArrow=True)
    def read(value):
        return parse(value)

    keyed = raw.withColumn("_answer", F.monotonically_increasing_id())
    rows = keyed.select("_answer", F.explode(read(column)).alias("x")).select("_answer", "x.*").withColumn("url", X.public_url(F.col("url"))).where(F.col("url").isNotNull() & (F.length("text") >= least))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_answer", "url").orderBy("position"))).where("_n = 1")
    return once.withColumn("_k", F.row_number().over(Window.partitionBy("_answer").orderBy("position"))).where(F.col("_k") <= most).drop("_n", "_k", "_answer")
