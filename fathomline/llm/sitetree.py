"""Operator 1, main text of HTML pages by site style trees.

The pages of a host are merged into one tree whose nodes are the element paths of their DOMs. For each node two
entropies are summed up over all pages of the host: how much the sequence of its children varies (presentation) and
how rarely its text blocks repeat (content). Their composite is the node's importance: a branch that looks and reads
the same on every page has a low one. Both entropies are smoothed by ``SMOOTH`` pages of which nothing is known, so
that a node seen on one page has importance 1 and certainty grows with the pages.

On each page the importance is multiplied by what the markup says about the branch: navigation, footers, forms,
adverts, hidden parts and the like weigh ``NOISE_WEIGHT``, a text element (such as ``p``) with a telling name
``NAMED_WEIGHT``, the inside of ``article`` or ``main`` weighs ``ARTICLE_WEIGHT``, the rest of a page with such an element
``OUTSIDE_WEIGHT``, and everything else 1. Branches whose weighted importance is below ``THRESHOLD`` are taken out of each
page, inside articles as well; the text blocks that are left are joined in page order. Articles count only if they hold
most of the page's unmarked text, so teaser cards do not. A wrapper with a telling name, or a form, that holds most of
the text is no noise. Inline elements are part of their block, but those that name adverts are branches of their own.

A node's content covers all nodes below it: sums over the ``REACH`` nearest levels are made directly, those over deeper
ones by doubling, so work stays linear in the page and logarithmic in its depth. Nodes of low importance and pages then
meet as sorted rows of one shuffle by host: a task streams the rows of a host, first its nodes, then its pages. Hosts
with over a ``HEAVY``-th of all pages (at most that many hosts) are spread over ``SALTS`` salts.

Nulls: a null html gives an empty text, a null or unparsable address belongs to the host ''. If entropy would take out
all of a page, or most of its articles (copies on one host), what the markup allows stays. Repeated rows are each
extracted, and count as pages of their host. Very long and very deep pages take time in proportion to their length. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import materialize, table, text_or_empty

THRESHOLD, DAMPING, SMOOTH, SALTS, HEAVY, REACH = 0.2, 0.9, 4.0, 64, 256, 16
#: Weights of a node's importance by its role on a page.
NOISE_WEIGHT, NAMED_WEIGHT, OUTSIDE_WEIGHT, ARTICLE_WEIGHT = 0.1, 0.4, 0.25, 2.0

# Element kinds of HTML and the words by which class and id attributes name parts of a page.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|button|title|audio|video"
_NOISE_TAGS = frozenset("nav aside footer form menu dialog fieldset head".split())
_NOISE_WORDS = frozenset(
    "nav navbar navigation navi menu submenu breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar aside rail widget widgets ad ads adv advert adverts advertisement "
    "adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup share sharing social "
    "related recommended recommendations comment comments commentlist reply replies respond disqus pagination pager toolbar login search skip hidden".split()
)
#: Of these, the words that name adverts; and elements that hold text, on which any other word says little.
_ADVERTS = frozenset("ad ads adv advert adverts advertisement adsense promo promotion sponsor sponsored".split())
_TEXT_TAGS = frozenset("p li dd dt td th blockquote pre h1 h2 h3 h4 h5 h6 caption figcaption summary address".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table div section article main body html nav aside footer header form blockquote td th".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""",
    re.S | re.I,
)
#: What can follow the last ">" of a page: comments to its end, text, and "<" that opens nothing. The groups of _TOKEN stay empty.
_TAIL = re.compile(r"<!--.*|<!\[CDATA\[.*|[^<]+|<|(?!)()()()()()()()", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_FORM_TAGS = frozenset("form fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HIDDEN = re.compile(r"""\bhidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_LONG_NUMBER = re.compile(r"\d{3,}")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _tokens(source: str) -> Iterator[re.Match]:
    """Tokens of a page; behind its last ">" no tag is looked for, as each attempt would read to the end."""
    last, at = source.rfind(">"), 0
    while at <= last:
        m = _TOKEN.match(source, at)
        yield m
        at = m.end()
    yield from _TAIL.finditer(source, at)


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """Element nodes and text blocks of one page; a node's id is the hash of its path and the host."""

    def __init__(self, source: str, host: str = ""):
        self.parent, self.ids, self.step, self.tag, self.noise, self.named, self.article = [-1], [_hash(host)], [""], [""], [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self._read(source)
        own = [0] * len(self.parent)
        for node, text, _ in self.blocks:
            own[node] += len(text)
        self.own, self.size, self.article_size = own, own[:], [n if a else 0 for n, a in zip(own, self.article, strict=True)]
        for i in range(len(own) - 1, 0, -1):  # parents stand before their children
            self.size[self.parent[i]] += self.size[i]
            self.article_size[self.parent[i]] += self.article_size[i]

    def _read(self, source: str) -> None:
        stack, text, linked, in_link = [0], [], 0, 0
        places: dict[str, list[int]] = {}  # by tag, where its open elements stand in the stack
        scopes = [0]  # where the open elements that end tags do not cross stand
        side: list | None = None  # an open inline advert: its tag, how deep, its text, its attributes

        def push(tag: str, attrs: str) -> None:
            places.setdefault(tag, []).append(len(stack))
            if tag in _SCOPES:
                scopes.append(len(stack))
            stack.append(self._open(tag, attrs, stack[-1]))

        def pop_to(at: int) -> None:
            while len(stack) > at:
                places[self.tag[stack.pop()]].pop()
                if scopes[-1] == len(stack):
                    scopes.pop()

        def end_block() -> None:
            nonlocal linked
            if text:
                block = " ".join(html_lib.unescape("".join(text)).split())
                if block:
                    self.blocks.append((stack[-1], block, linked))
                text.clear()
            linked = 0

        def end_side() -> None:
            nonlocal side
            if side:
                block = " ".join(html_lib.unescape("".join(side[2])).split())
                if block:
                    self.blocks.append((self._open(side[0], side[3], stack[-1]), block, 0))
                side = None

        for m in _tokens(source):
            whole = m.group()
            if whole[0] != "<" or whole == "<":
                (side[2] if side else text).append(whole)
                linked += len(whole.strip()) if in_link and not side else 0
                continue
            name = m.group(3) or m.group(6)
            if not name:
                if m.group(1) and m.group(1).lower() not in ("button", "title"):
                    end_block()
                continue
            tag, closing, attrs = name.lower(), m.group(2) or m.group(5), m.group(4) or m.group(7) or ""
            if tag in _INLINE and not (closing and places.get(tag)):
                if side:
                    if tag == side[0]:
                        side[1] += -1 if closing else 1
                        if not side[1]:
                            end_side()
                elif not closing and attrs and tag not in _VOID and _words(attrs) & _ADVERTS:
                    side = [tag, 1, [], attrs]
                elif tag == "a":
                    in_link = 0 if closing else 1
                elif tag == "br":
                    text.append(" ")
                continue
            end_block()
            if side:  # an inline advert that holds whole blocks
                inner, side = side, None
                push(inner[0], inner[3])
                text += inner[2]
                end_block()
            if closing:
                in_link = 0
                at = places[tag][-1] if places.get(tag) else 0
                if at and not (tag in ("p", "li") and at < scopes[-1]):
                    pop_to(at)
                continue
            if tag in _VOID:
                continue
            while True:
                at = max([places[t][-1] for t in ("p", *_CLOSED_BY.get(tag, ())) if places.get(t)], default=0)
                if not at or at < scopes[-1]:
                    break
                pop_to(at)
            push(tag, attrs)
        end_side()
        end_block()

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        step, noise, named = tag, tag in _NOISE_TAGS, False
        inside = self.article[parent]
        if attrs:
            names = _attributes(attrs)
            words = {w.lower() for v in names.values() for w in _WORDS.findall(v)}
            if names:
                step += "." + ".".join(sorted({w.lower() for v in names.values() for w in _LONG_NUMBER.sub("", v).split()}))
            if inside or tag in _HEADINGS:  # ids and labels of sections are slugs of their titles: only a whole one names a role, and none on a heading
                whole = {v.strip().lower() for n, v in names.items() if n in ("id", "aria-label") and tag not in _HEADINGS}
                words = {w.lower() for n, v in names.items() if n in ("class", "role") for w in _WORDS.findall(v)} | whole
                words.discard("header")
            said = bool(words & _NOISE_WORDS) and tag not in ("html", "body", "main")
            named = said and inside and tag in _TEXT_TAGS and not words & _ADVERTS
            noise = noise or said and not named or bool(_HIDDEN.search(attrs))
        noise = noise or tag == "header" and not inside
        self.parent.append(parent), self.step.append(step), self.tag.append(tag), self.noise.append(noise), self.named.append(named)
        self.ids.append(_hash(str(self.ids[parent]), step))
        self.article.append(not noise and (inside or tag in ("article", "main")))
        return len(self.parent) - 1

    def _marked(self) -> list[bool]:
        """Whether a node is in a noise branch. A telling wrapper that holds most of the articles' text (of all, without any), or a form that holds most of the text, is none if it holds more than what is unmarked without it."""
        held = self.article_size if self.article_size[0] else self.size
        clean = self.own[:]  # text below a node without further noise
        for i in range(len(clean) - 1, 0, -1):
            if not self.noise[i]:
                clean[self.parent[i]] += clean[i]
        unmarked, marked = clean[0], []
        for i, (p, noise, tag) in enumerate(zip(self.parent, self.noise, self.tag, strict=True)):
            above = p >= 0 and marked[p]
            if noise and not above:
                form = tag in _FORM_TAGS and self.size[i] * 2 > self.size[0]
                if (form or (tag in _FORM_TAGS or tag not in _NOISE_TAGS and tag != "header") and held[i] * 2 > held[0]) and self.size[i] > unmarked:
                    noise, unmarked = False, unmarked + clean[i]
            marked.append(noise or above)
        return marked

    def kept(self, importance: dict[int, float]) -> list[str]:
        """Text blocks that are left without branches of low weighted importance; nodes not in ``importance`` have 1."""
        marked = self._marked()
        article: list[bool] = []
        for i, p in enumerate(self.parent):
            article.append(not marked[i] and (self.tag[i] in ("article", "main") or p >= 0 and article[p]))
        unmarked = [(n, t, links) for n, t, links in self.blocks if not marked[n]]
        in_article = sum(len(t) for n, t, _ in unmarked if article[n])
        has_article = in_article * 2 > sum(len(t) for _, t, _ in unmarked)
        holds = [False] * len(self.parent)  # what is around the articles is not judged
        for i in range(len(self.parent) - 1, 0, -1):
            if has_article and (article[i] or holds[i]):
                holds[self.parent[i]] = True
        out: list[bool] = []
        for i, p in enumerate(self.parent):
            around = holds[i] and not article[i]
            weight = NOISE_WEIGHT if marked[i] else NAMED_WEIGHT if self.named[i] else 1.0 if not has_article or around else ARTICLE_WEIGHT if article[i] else OUTSIDE_WEIGHT
            out.append(not around and importance.get(self.ids[i], 1.0) * weight < THRESHOLD or p >= 0 and out[p])
        found = [(n, t) for n, t, links in unmarked if has_article and article[n] or links * 5 <= len(t) * 3] or [(n, t) for n, t, _ in unmarked]
        if has_article and sum(len(t) for n, t in found if article[n] and not out[n]) * 2 <= in_article:
            return [t for n, t in found if article[n]]
        return [t for n, t in found if not out[n]] or [t for _, t in found]


def _attributes(attrs: str) -> dict[str, str]:
    return {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in _NAMES.finditer(attrs)}


def _words(attrs: str) -> set[str]:
    return {w.lower() for v in _attributes(attrs).values() for w in _WORDS.findall(v)}


_SEEN = "node long, host string, above array<long>, far long, kind byte, feature long, n long"


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and node: one row for the node (kind 0), one for its children's sequence (1) and one for each text block (2).

    ``above`` has the node and its nearest ancestors, ``REACH`` in all, and ``far`` the ancestor after them (null: none).
    """
    names = [c.split()[0] for c in _SEEN.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int8(), pa.int64(), pa.int64()]
    for batch in batches:
        sums: Counter = Counter()
        above: dict[int, tuple[str, list[int], int | None]] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(source.as_py(), host)
            ids, children = page.ids, {}
            for i, p in enumerate(page.parent):
                if ids[i] not in above:
                    chain, at = [], i
                    while at > 0 and len(chain) < REACH:
                        chain.append(ids[at])
                        at = page.parent[at]
                    above[ids[i]] = host, chain, ids[at] if at > 0 else None
                if p >= 0:
                    seq = children.setdefault(p, [])
                    if not seq or seq[-1] != page.step[i]:
                        seq.append(page.step[i])
            sums.update({(ids[i], 0, 0) for i in range(1, len(ids))} | {(ids[i], 1, _hash(*seq)) for i, seq in children.items() if i} | {(ids[i], 2, _hash(t)) for i, t, _ in page.blocks if i})  # once for each page
        cols = list(zip(*((node, *above[node], kind, feature, n) for (node, kind, feature), n in sums.items()), strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _below(own: DataFrame) -> DataFrame:
    """``node, all_texts, all_fresh``: sums of ``texts`` and ``fresh`` over each node and everything below it."""
    total = [F.sum("texts").alias("texts"), F.sum("fresh").alias("fresh")]
    sums = own.where("texts > 0").select(F.explode("above").alias("node"), "texts", "fresh").groupBy("node").agg(*total)
    reach = own.select("node", "far")
    while reach.where("far is not null").limit(1).count():  # sums now cover 16, 32, 64, .. levels
        further = sums.join(reach.where("far is not null"), "node").groupBy(F.col("far").alias("node")).agg(*total)
        sums = materialize(sums.unionByName(further).groupBy("node").agg(*total), "below")
        jump = reach.select(F.col("node").alias("far"), F.col("far").alias("farther"))
        reach = materialize(reach.join(jump, "far").select("node", F.col("farther").alias("far")), "reach")
    return sums.select("node", F.col("texts").alias("all_texts"), F.col("fresh").alias("all_fresh"))


def importance(pages: DataFrame) -> DataFrame:
    """``host, node, importance`` of the merged trees of ``pages (host, html)``."""
    seen = pages.select("host", text_or_empty(F.col("html")).alias("html")).mapInArrow(_observations, _SEEN)
    each = seen.groupBy("node", "kind", "feature").agg(F.sum("n").alias("n"), F.first("host").alias("host"), F.first("above").alias("above"), F.first("far").alias("far"))
    n = F.col("n").cast("double")
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))
    nodes = materialize(
        each.groupBy("node").agg(
            F.first("host").alias("host"), F.first("above").alias("above"), F.first("far").alias("far"), of(0, n).alias("m"),
            of(1, n).alias("styles"), of(1, n * F.log(n)).alias("styles_log"), F.count(F.when(F.col("kind") == 1, n)).alias("n_styles"),
            of(2, n).alias("texts"), of(2, n * F.log(n)).alias("texts_log")),
        "style_nodes")
    pages_log = F.log(F.col("m") + SMOOTH)
    # Content: 1 - mean entropy of a block over the pages that show it. Presentation: entropy of the child sequences, with the unknown pages' share.
    fresh = F.col("texts") - F.col("texts_log") / pages_log
    varied = F.when(F.col("styles") > 0, F.log("styles") - F.col("styles_log") / F.col("styles")).otherwise(0.0)
    own = nodes.select("node", "host", "above", "far", "n_styles", "texts", fresh.alias("fresh"), ((varied + F.log((F.col("m") + SMOOTH) / F.col("m"))) / pages_log).alias("presentation"))
    damped = F.pow(F.lit(DAMPING), F.greatest("n_styles", F.lit(1)))
    content = F.col("all_fresh") / F.col("all_texts")
    return own.join(_below(own), "node").select("host", "node", F.when(F.col("n_styles") == 0, content).otherwise((1 - damped) * F.col("presentation") + damped * content).alias("importance"))


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    hosted = with_host(pages.select("page_id", "url", "html"))
    low = importance(hosted).where(F.col("importance") < THRESHOLD / OUTSIDE_WEIGHT)  # the least weight of what is not noise
    sizes = hosted.groupBy("host").agg(F.count("*").alias("pages"))
    total = pages.count()
    heavy = F.broadcast(sizes.where(F.col("pages") > total / HEAVY).select("host", F.lit(SALTS).alias("salts")))  # at most HEAVY hosts
    salts = F.coalesce("salts", F.lit(1))
    nodes = low.join(heavy, "host", "left").select("host", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "importance")
    rows = hosted.join(heavy, "host", "left").select("host", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty(F.col("html")).alias("html"))
    both = nodes.unionByName(rows, allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, tree = None, {}
        for batch in batches:
            page_ids, urls, texts = [], [], []
            for here, kind, node, value, page_id, url, source in zip(*(batch.column(c) for c in ("host", "kind", "node", "importance", "page_id", "url", "html")), strict=True):
                if here.as_py() != host:
                    host, tree = here.as_py(), {}
                if not kind.as_py():
                    tree[node.as_py()] = value.as_py()
                else:
                    page_ids.append(page_id), urls.append(url), texts.append("\n\n".join(Page(source.as_py(), host).kept(tree)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            cols = ([v.as_py() for v in page_ids], [v.as_py() for v in urls], texts, list(map(len, texts)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "text", "n_chars"])

    return both.select("host", "kind", "node", "importance", "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
