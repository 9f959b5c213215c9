"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its open tags, each told apart by the path of tags and
classes that leads to it, and its text blocks with their path. Over the pages of
one host every token has an occurrence vector: how often it stands on each page.
Tokens with equal vectors form a class. Frequent classes whose tags nest in each
other are the template of the host; what stands between are slots. A text block
that belongs to the template is boilerplate. The tags of the class of the page
itself, once on each page they stand on, are the template's containers. From the
page downwards the container whose text, without the constant one, takes up most
of what its pages hold beside it is entered, and what remains of its slots is the
main text. Hosts without a template are read by the same volumes on the page alone.
Tags beside an article by their meaning and parts that name themselves so (all
words of one class name or id are such words) are left out of the slots.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm import common

#: Pages with different main texts that a host and each token of its template must have, and the share of all
#: pages that a token must stand on (it bounds a template by a hundred times the tokens of a page).
MIN_PAGES = 5
MIN_SHARE = 0.01
#: Share of the pages with its path that a constant text must stand on; passages that some stories share are no template.
MIN_CONSTANT = 0.5
#: Tokens that a class must have whose counts differ from page to page.
MIN_CLASS = 3
#: Share of the largest container's text from which one beside it is as good.
MIN_SLOT = 0.1
#: Share of uses beyond one a page that a container may have, for pages that list several articles.
MAX_EXTRA = 0.1
#: Rows up to which the tokens of all templates may be broadcast; it bounds the bytes too.
MAX_TOKENS = 500_000

# Names with a meaning in HTML, and words that name page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input label map menu nav noembed noframes "
    "noscript object option script select style svg template textarea title video xmp".split()
)
SKIP_WORDS = frozenset(
    "ad ads adbox adsbygoogle advert adverts advertisement advertising alert banner banners breadcrumb breadcrumbs comment comments "
    "consent contentinfo complementary cookie cookies copyright discussion disqus dropdown footer footers gdpr header "
    "legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promos promoted promotion recommended related replies reply respond search share sharing "
    "sidebar sidebars signup skip social sponsor sponsored subscribe subscription tooltip topbar widget widgets".split()
)
#: Words that may stand beside one of these in a name without giving it another meaning.
FRAME_WORDS = frozenset(
    "area articles bar block bottom box buttons container content form icon inner item items label left link links list "
    "main message module outer page panel post posts right section site slot small text title top unit wrap wrapper".split()
)
#: Tags that only hold others, and so can be a container.
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
#: Words of parts that other people wrote, which are left out however long they are.
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply respond".split())
HEADINGS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Tags that a start of the same kind closes, and where the search for it ends.
CLOSED_BY_LIKE = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table",
                  "option": "select datalist", "p": "td th li div article section body main"}

_EVENT = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|[^<]++|<",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _code(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def _attributes(source: str) -> dict[str, str]:
    out = {}
    for name, a, b, c, alone in _ATTRIBUTE.findall(source):
        out.setdefault((name or alone).lower(), a or b or c)
    return out


def _is_aside(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is beside the article by its tag or hidden."""
    if name in SKIP or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _skip_words(name: str, attributes: dict[str, str]) -> frozenset[str]:
    """Words by which an element names itself a part beside the article."""
    if name in HEADINGS and "comment" not in attributes.get("class", "").lower():
        return frozenset()
    found = set()
    for each in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        whole = each.replace("-", "").replace("_", "").lower()
        parts = [p.lower() for p in _PART.findall(each) if not p.isdigit()]
        if whole in SKIP_WORDS:
            found.add(whole)
        elif all(p in SKIP_WORDS or p in FRAME_WORDS for p in parts):
            found.update(SKIP_WORDS.intersection(parts))
    return frozenset(found)


class Page:
    """Tags and text blocks of a page. Broken nesting is mended as browsers do, roughly."""

    def __init__(self, source: str | None):
        self.tags: list[tuple[int, int]] = []  # path, path of the parent
        self._names: dict[int, str] = {}  # tag of a path
        #: Path of the first h1 that is not beside the article, and numbers of the named parts around it.
        self._h1: tuple[int, frozenset[int]] | None = None
        #: path, text, beside the article, inside an article, inside a main part, named parts around it
        self.blocks: list[tuple[int, str, bool, bool, bool, tuple]] = []
        self._open: list[tuple[str, int, bool, bool, bool, tuple]] = []
        #: Numbers of the named parts within an article that hold its first h1.
        self._titled: frozenset[int] | None = None
        self._text: list[str] = []
        self._read(source or "")
        self._flush()

    def _top(self):
        return self._open[-1] if self._open else ("", 0, False, False, False, ())

    def _flush(self):
        if self._text:
            text = " ".join(html_lib.unescape("".join(self._text)).split())
            self._text = []
            if text:
                self.blocks.append((self._top()[1], text, *self._top()[2:]))

    def _close(self, name: str, stops: frozenset[str] | tuple = ()):
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == name:
                if any(o[0] in BLOCK for o in self._open[i:]):
                    self._flush()
                del self._open[i:]
                return
            if self._open[i][0] in stops:
                return

    def _read(self, source: str):
        at, size = 0, len(source)
        while at < size:
            m = _EVENT.match(source, at)
            at = m.end()
            slash, name, rest = m.group(1), m.group(2), m.group(3)
            if name is None:
                piece = m.group(0)
                if piece[0] != "<" or len(piece) == 1:
                    self._text.append(piece)
                continue
            name = name.lower()
            if name in BLOCK:
                self._flush()
            if slash:
                self._close(name)
                continue
            if name in CLOSED_BY_LIKE:
                self._close(name, tuple(CLOSED_BY_LIKE[name].split()))
            elif name in BLOCK and name != "br":
                self._close("p", tuple(CLOSED_BY_LIKE["p"].split()))
            attributes = _attributes(rest)
            _, parent, aside, article, main, named = self._top()
            path = _code(str(parent), name, attributes.get("class", ""), attributes.get("id", ""))
            self.tags.append((path, parent))
            self._names[path] = name
            own = aside or _is_aside(name, attributes) or (name == "header" and not article and not main)
            if words := _skip_words(name, attributes):
                named = (*named, (len(self.tags), words, article or main))  # its number, its words, whether within an article
            if name == "h1" and self._h1 is None and not own:
                self._h1 = path, frozenset(k for k, _, _ in named)
            if name == "h1" and self._titled is None and (article or main) and not own:
                self._titled = frozenset(k for k, _, within in named if within)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else size
            elif name not in VOID and not rest.rstrip().endswith("/"):
                body = attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"
                self._open.append((name, path, own, article or name == "article", main or name == "main" or body, named))

    def _parents(self) -> dict[int, int]:
        """Parent of each path, parents before their children."""
        out: dict[int, int] = {}
        for path, parent in self.tags:
            out.setdefault(path, parent)
        return out

    @staticmethod
    def _weight(block: tuple) -> int:
        """Length of a block that may be article text by its tags; what readers wrote is none."""
        return 0 if block[2] or any(words & COMMENT_WORDS for _, words, _ in block[5]) else len(block[1])

    def _volumes(self, parents: dict[int, int], constant: frozenset[int]) -> dict[int, int]:
        """Length of the text in each path and what it holds, constant text left out."""
        out = dict.fromkeys((0, *parents), 0)
        for block in self.blocks:
            if _code(str(block[0]), "text", block[1]) not in constant:
                out[block[0]] += self._weight(block)
        for path in reversed(parents):
            out[parents[path]] += out[path]
        return out

    def tokens(self) -> dict[int, list]:
        """``{token: [parent, is text, is container, count, length of text]}``; token 0 is the page itself."""
        parents = self._parents()
        sizes = self._volumes(parents, frozenset())
        out = {0: [0, False, False, 1, sizes[0]]}
        for path, parent in self.tags:
            out.setdefault(path, [parent, False, self._names[path] in CONTAINERS, 0, sizes[path]])[3] += 1
        for block in self.blocks:
            held = out.setdefault(_code(str(block[0]), "text", block[1]), [block[0], True, False, 0, 0])
            held[3] += 1
            held[4] += self._weight(block)
        return out

    def _region(self, constant: frozenset[int], volumes: dict[int, int]) -> list[tuple] | None:
        """Slots of the main text by the template's containers; None if they single nothing out.

        ``volumes`` holds the mean length of the text in each container over its
        pages. A container is entered if it has most of what its pages hold
        beside it and no other one has ``MIN_SLOT`` of that; an article is not
        taken apart. A title outside is kept unless the region is an article.
        """
        parents = self._parents()
        sizes = self._volumes(parents, constant)
        over, inner = {0: 0}, {}  # nearest container above a path, containers next below one
        for path, parent in parents.items():
            over[path] = parent if parent in volumes or parent == 0 else over[parent]
            if path in volumes:
                inner.setdefault(over[path], []).append(path)
        at, kept = 0, frozenset()
        while self._names.get(at) != "article" and (below := inner.get(at)):
            best = max(below, key=lambda p: (volumes[p], p))
            loose = sizes[at] - sum(sizes[p] for p in below)
            if 2 * volumes[best] <= sum(volumes[p] for p in below) + loose:
                break
            large = [p for p in below if volumes[p] >= MIN_SLOT * volumes[best]]
            if len(large) > 1:
                kept = frozenset(below).difference(large)
                break
            at = best
        if self._names.get(at, "html") in ("html", "body") and not kept:
            return None
        within = {at}
        for path, parent in parents.items():
            if parent in within and path not in kept:
                within.add(path)
        title, around = self._h1 or (None, frozenset())
        first = next((b for b in self.blocks if b[0] == title), None) if self._names.get(at) != "article" else None
        found = [
            b for b in self.blocks
            if not b[2] and (b[0] in within or b is first) and _code(str(b[0]), "text", b[1]) not in constant
        ]
        named = [[(k, words) for k, words, _ in b[5] if self.tags[k - 1][0] in within and self.tags[k - 1][0] != at or b is first] for b in found]
        return self._unnamed(found, named, around)

    @staticmethod
    def _unnamed(blocks: list[tuple], named: list[list[tuple]], around: frozenset[int]) -> list[tuple]:
        """Blocks outside parts named as beside the article, unless such a name has most of the text (comments excepted)."""
        size: dict[str, int] = {}
        for b, parts in zip(blocks, named):
            for word in {w for _, words in parts for w in words}:
                size[word] = size.get(word, 0) + len(b[1])
        total = sum(len(b[1]) for b in blocks)
        free = {w for w, n in size.items() if 2 * n > total} - COMMENT_WORDS
        return [b for b, parts in zip(blocks, named) if all(k in around or words <= free for k, words in parts)]

    def _slots(self, template: frozenset[int] = frozenset()) -> list[tuple]:
        """Blocks outside the template and outside parts beside the article.

        A word names no such part if most of the text is in parts of that name
        (comments excepted), nor does one within an article that holds its title.
        Beside an article with a title, the first holds only for parts within one.
        """
        blocks = [b for b in self.blocks if not b[2] and _code(str(b[0]), "text", b[1]) not in template]
        named = [[(k, words) for k, words, within in b[5] if within or self._titled is None] for b in blocks]
        kept = self._unnamed(blocks, named, self._titled or frozenset())
        if self._titled is None:
            return kept
        return [b for b in kept if all(within or k in self._titled for k, _, within in b[5])]

    def main_key(self) -> int:
        """Hash of the longest text; copies of a page under several addresses share it."""
        slots = self._slots() or self.blocks
        return _code(max((b[1] for b in slots), key=lambda t: (len(t), t), default=""))

    def text(self, constant: frozenset[int] = frozenset(), volumes: dict[int, int] | None = None) -> str:
        """Slots that are article text, in page order, by the constant texts and container volumes of the host.

        Without containers these are the articles if they hold half of all slot
        text, else the main parts if these do, else all slots.
        """
        if volumes and (found := self._region(constant, volumes)) is not None:
            return "\n".join(b[1] for b in found)
        slots = self._slots(constant)
        total = sum(len(b[1]) for b in slots)
        for k in (3, 4):
            region = [b for b in slots if b[k]]
            if region and 2 * sum(len(b[1]) for b in region) >= total:
                slots = region
                break
        return "\n".join(b[1] for b in slots)


def template(tokens: list[tuple], pages: int) -> tuple[list[int], list[int], list[int]]:
    """Constant text tokens, containers, and the mean length of the text in these.

    Tokens are ``(token, parent, is text, pages, vector, vector, least, most, is
    container, uses, size)``. A text that stands equally often on each of its pages
    (``least`` is ``most``) is constant by itself. Of the others, tokens with the
    same vector are a class. Classes of ``MIN_CLASS`` tokens are valid as far as
    they nest: a token stays only if its parent path stays. Either way a text must
    stand on ``MIN_CONSTANT`` of the pages with its path (of all ``pages``, outside tags). Containers are in the
    class of the page itself, cut to the pages they stand on.
    """
    by_token = {t[0]: t for t in tokens}
    constant = {t[0] for t in tokens if t[2] and t[6] == t[7]}
    classes: dict[tuple, list] = {}
    for t in tokens:
        classes.setdefault(t[3:6], []).append(t)
    held = {t[0]: t for c in classes.values() if len(c) >= MIN_CLASS for t in c}
    held[0] = (0, 0, False, 0, 0, 0, 0, 0)
    while lost := [k for k, t in held.items() if k and t[1] not in held]:
        for k in lost:
            del held[k]
    constant.update(k for k, t in held.items() if t[2])
    place = {t[0]: t[3] for t in tokens}
    constant = {k for k in constant if place[k] >= MIN_CONSTANT * place.get(by_token[k][1], pages)}
    sizes = {t[0]: t[10] for t in tokens}
    for k in constant:
        up = by_token[k][1]
        while up in sizes:
            sizes[up] -= by_token[k][10]
            up = by_token[up][1]
    once = sorted(t[0] for t in tokens if t[8] and t[9] <= (1 + MAX_EXTRA) * t[3])
    return sorted(constant), once, [sizes[k] // by_token[k][3] for k in once]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _counted(batches):
    """Token counts of each host, summed up within a batch: pages, two sums that stand for the vector, uses, size, least and most.

    A token has a row for each of up to ``MIN_PAGES`` main texts; the first one holds the counts.
    """
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, key, source in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            if not host:
                continue
            page = Page(source)
            main = page.main_key()
            for token, (parent, is_text, holds, n, size) in page.tokens().items():
                mark = xxhash.xxh64_intdigest(f"{key} {n}", 9)
                held = sums.setdefault((host, token), [parent, is_text, holds, 0, 0, 0, 0, 0, n, n, {main}])
                held[3] += 1
                held[4] += mark >> 33
                held[5] += mark & 0x7FFFFFFF
                held[6] += n
                held[7] += size
                held[8], held[9] = min(held[8], n), max(held[9], n)
                if len(held[10]) < MIN_PAGES:
                    held[10].add(main)
        rows = []
        for (host, token), (*counts, mains) in sums.items():
            first, *more = mains
            rows.append((host, token, *counts, first))
            rows += [(host, token, *counts[:3], 0, 0, 0, 0, 0, *counts[8:], m) for m in more]
        cols = list(zip(*rows)) or [()] * 13
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)],
            ["host", "token", "parent", "is_text", "holds", "n", "v1", "v2", "uses", "size", "least", "most", "main"],
        )


_TEMPLATE = ("constant", "containers", "volumes")


def templates(pages: DataFrame) -> DataFrame:
    """``(host, constant, containers, volumes)``, arrays of longs, of every host with ``MIN_PAGES`` pages of different main texts.

    Occurrence vectors are held as sums that add up in any order, so counting is
    an ordinary aggregation: a host with a third of all pages sends a few
    rows for each token and batch. What is gathered for a host stands on at least
    ``MIN_SHARE`` of its pages and so is bounded by the size of a page.
    """
    counts = (
        pages.mapInArrow(_counted, "host string, token long, parent long, is_text boolean, holds boolean, n long, v1 long, v2 long, "
                         "uses long, size long, least long, most long, main long")
        .groupBy("host", "token")
        .agg(F.min("parent").alias("parent"), F.max("is_text").alias("is_text"), F.max("holds").alias("holds"),
             *[F.sum(c).alias(c) for c in ("n", "v1", "v2", "uses", "size")],
             F.min("least").alias("least"), F.max("most").alias("most"), F.count_distinct("main").alias("mains"))
        .where(F.col("mains") >= MIN_PAGES).drop("mains")
    )
    counts = common.cut(counts)
    size = counts.where("token = 0").select("host", F.col("n").alias("pages"))
    often = counts.join(size, "host").where(F.col("n") >= MIN_SHARE * F.col("pages"))
    gathered = often.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "is_text", "n", "v1", "v2", "least", "most", "holds", "uses", "size")).alias("tokens"))

    def deduced(batches):
        for batch in batches:
            out = [
                template([tuple(t.values()) for t in tokens if t["token"]], max(t["n"] for t in tokens if not t["token"]))
                for tokens in batch.column("tokens").to_pylist()
            ]
            lists = [pa.array([found[k] for found in out], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), *lists], ["host", *_TEMPLATE])

    return gathered.mapInArrow(deduced, f"host string, {', '.join(f'{c} array<long>' for c in _TEMPLATE)}")


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Null html gives an empty text. A page without a host, or of a host with few
    pages, is read without a template. Repeated rows each get the same text.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = common.cut(templates(rows.withColumn("key", F.xxhash64("page_id", "url", "html"))))
    tokens = found.agg(F.coalesce(F.sum(1 + F.size("constant") + 2 * F.size("containers")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(found) if tokens <= MAX_TOKENS else found, "host", "left")

    def run(batches):
        for batch in batches:
            texts = [
                Page(source).text(frozenset(constant or ()), dict(zip(containers or (), volumes or ())))
                for source, constant, containers, volumes in zip(*(batch.column(c).to_pylist() for c in ("html", *_TEMPLATE)))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", *_TEMPLATE).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
