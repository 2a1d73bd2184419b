"""Main text of web pages by template deduction.

The tokens of a page are the opening and closing tags of its containers and
the texts of its blocks, each with the path of containers around it.  Over
the pages of a host, a token's occurrence vector says how often each page has
it; tokens with equal vectors, whatever their places, form an equivalence
class.  Vectors are never gathered: an aggregate keeps the number of pages,
the sum, least and greatest count and an exclusive-or of hashes of (page,
count), equal for equal vectors.

A class is valid if it spans half of the host's pages and nests: every
container in it has both tags in it, the opening one first.  Containers of
valid classes nest into the host's template.  Texts of classes that are
constant, the same number of times on every page of the host, belong to the
template as well (notices, promotions, menus, whatever their tags are called)
and go; what is left between the template's tags are the slots.  Hosts with
fewer than ``LEAST_PAGES`` different pages have no vectors to compare and use
the template deduced over all pages.

The main slots are the template's ``article`` containers, or its ``main`` where
that holds text outside its articles; without either, the whole page, so that
no part of an article is lost that a smaller container would leave out.  Their
texts are extracted whole, but for furniture inside (menus, forms, adverts,
comments, scripts and so on): by tag, or by a class, id or role that names
nothing else; elements whose name only mentions furniture count as such where
they hold at most half of the page's text, and the page's layout never.  A
page that lacks the main slots is read by the same rules on its own
containers; a page of which nothing would be left keeps its constant texts.

Blocks are the text between block tags; character references are decoded,
white space inside a block becomes one space, blocks are joined by an empty
line.  Null and empty pages have an empty text; a null url is a host of its
own; repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.text import free_name
from mercato.operators._util import salted_join
from mercato.session import materialize, ship_package

LEAST_PAGES = 5
SPAN = 0.5
BROADCAST_TOKENS = 1_000_000     # 64-bit numbers of all templates that may be broadcast

MAIN = ("article", "main")
FURNITURE = frozenset("nav header footer aside form script style noscript template iframe "
                      "select button textarea dialog menu svg object title head".split())
# Containers that no word makes furniture.
LAYOUT = ("html", "body", *MAIN)
FURNITURE_WORDS = frozenset("nav navbar navigation menu header footer sidebar aside ad ads advert "
                            "advertisement banner sponsored promo cookie cookies consent notice "
                            "popup modal comment comments reply replies share social related "
                            "breadcrumb breadcrumbs newsletter subscribe login search widget "
                            "disclaimer pagination contentinfo complementary".split())
# Words that leave a name of furniture what it is (comment-list), and words
# that turn it into a statement about something else (has-sidebar).
NEUTRAL_WORDS = frozenset("list box section area wrapper container block item items bar site page "
                          "post article entry user main top bottom left right global primary "
                          "secondary inner outer group row col panel wrap link links text content "
                          "title head body thread".split())
STATING_WORDS = frozenset("has with no without is not show hide".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl "
                       "table figure details head title dialog menu noscript template select "
                       "button textarea iframe svg object blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre hr caption "
                                "figcaption address summary fieldset legend option".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")

# Elements that the next of their kind closes.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

_SCAN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)"
                   r"|[^<]+|<", re.S)
_MARK = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")




def scan(page: str):
    """(kind, name, attributes or text) of each piece: kind is "open",
    "close" or "text"; comments and the contents of scripts and styles are
    left out."""
    at, n, lower = 0, len(page), None
    while at < n:
        m = _SCAN.match(page, at)
        at = m.end()
        if m[2] is None:
            if not m[0].startswith("<!") and not m[0].startswith("<?"):
                yield "text", "", m[0]
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW and not m[3].rstrip().endswith("/"):
            if lower is None:
                lower = page.lower()
                if len(lower) != n:            # a letter whose lower case is longer
                    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = lower.find(f"</{name}", at)
            at = n if end < 0 else end
        elif name not in VOID and m[3].rstrip().endswith("/") and name in CONTAINERS:
            yield "close", name, ""


def marked(attributes: str) -> tuple[str, int]:
    """The words of an element's class, id and role, and whether they make
    it furniture: 2 if a name says nothing else, 1 if it mentions it."""
    words, level = [], 0
    for m in _MARK.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            own = _WORD.findall(name)
            words += own
            if FURNITURE_WORDS.isdisjoint(own) or not STATING_WORDS.isdisjoint(own):
                continue
            level = max(level, 2 if FURNITURE_WORDS.union(NEUTRAL_WORDS).issuperset(own) else 1)
    return ".".join(words), level


def number(*parts) -> int:
    """A 64-bit hash."""
    digest = hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"),
                             digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


@dataclass
class Page:
    """A page's elements (containers and marked furniture, in the order of
    opening, each with its parent before it) and its blocks."""

    parent: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)      # hash of the path of labels
    mark: list[int] = field(default_factory=list)
    opens: list[int] = field(default_factory=list)
    closes: list[int] = field(default_factory=list)
    pieces: list = field(default_factory=list)         # (element, text), None where a block ends
    out: list[bool] = field(default_factory=list)      # inside furniture
    chars: list[int] = field(default_factory=list)     # text inside that is not furniture


def parsed(html: str) -> Page:
    """One pass over the tags, linear in their number whatever their depth."""
    page = Page()
    stack: list[int] = []
    places: dict[str, list[int]] = {}          # name -> places in the stack
    same: list[int] = []                       # unmarked elements of the name, open inside
    at = 0

    def push(name: str, label: str, mark: int) -> None:
        up = stack[-1] if stack else -1
        places.setdefault(name, []).append(len(stack))
        stack.append(len(page.name))
        same.append(0)
        page.parent.append(up)
        page.name.append(name)
        page.path.append(number(page.path[up] if up >= 0 else "", label))
        page.mark.append(mark)
        page.opens.append(at)
        page.closes.append(at)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            i = stack.pop()
            same.pop()
            places[page.name[i]].pop()
            page.closes[i] = at

    for kind, name, more in scan(html):
        at += 1
        if kind == "text":
            page.pieces.append((stack[-1] if stack else -1, more))
            continue
        if name == "br":
            page.pieces.append((stack[-1] if stack else -1, " "))
            continue
        if name in BLOCKS:
            page.pieces.append(None)
        own = places.get(name)
        if kind == "open" and name not in VOID:
            label, mark = marked(more)
            if name in LAYOUT:
                mark = 0
            if own and name in SELF_CLOSING and own[-1] == len(stack) - 1:
                pop_to(own[-1])
            elif own and name not in CONTAINERS and name not in SELF_CLOSING:
                same[own[-1]] += 1
            paragraph = places.get("p")
            if name in BLOCKS and paragraph and paragraph[-1] == len(stack) - 1:
                pop_to(paragraph[-1])
            if name in CONTAINERS:
                push(name, f"{name}.{label}", 2 if name in FURNITURE else mark)
            elif mark == 2 and name not in RAW:
                push(name, f"{name}.{label}", mark)
        elif kind == "close" and own:
            if same[own[-1]]:
                same[own[-1]] -= 1
            else:
                pop_to(own[-1])
    at += 1
    pop_to(0)
    page.pieces.append(None)
    _sized(page)
    return page


def _sized(page: Page) -> None:
    """Sizes without furniture, and what is inside of furniture."""
    n = len(page.name)
    strong = [m == 2 for m in page.mark]
    for i in range(n):
        strong[i] = strong[i] or (page.parent[i] >= 0 and strong[page.parent[i]])
    size, total = [0] * n, 0
    for piece in page.pieces:
        if piece is not None and not (piece[0] >= 0 and strong[piece[0]]):
            chars = len(piece[1].strip())
            total += chars
            if piece[0] >= 0:
                size[piece[0]] += chars
    for i in range(n - 1, -1, -1):
        if page.parent[i] >= 0:
            size[page.parent[i]] += size[i]
    out = [s or (m == 1 and 2 * z <= total) for s, m, z in zip(strong, page.mark, size)]
    for i in range(n):
        out[i] = out[i] or (page.parent[i] >= 0 and out[page.parent[i]])
    chars = [0] * n
    for piece in page.pieces:
        if piece is not None and piece[0] >= 0 and not out[piece[0]]:
            chars[piece[0]] += len(piece[1].strip())
    for i in range(n - 1, -1, -1):
        if page.parent[i] >= 0:
            chars[page.parent[i]] += chars[i]
    page.out, page.chars = out, chars


def page_blocks(page: Page):
    """(element, text) of each block outside furniture, in page order."""
    held: list[str] = []
    where = -1
    for piece in page.pieces:
        if piece is None:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                yield where, text
        elif not (piece[0] >= 0 and page.out[piece[0]]):
            if not held:
                where = piece[0]
            held.append(piece[1])


def block_token(page: Page, element: int, text: str) -> int:
    return number("text", page.path[element] if element >= 0 else "", text)


def containers(page: Page) -> list[tuple[int, str, int, int, int]]:
    """(path, name, place, text inside, text inside but outside of articles)
    of the article and main elements outside furniture."""
    inner = [0] * len(page.name)
    covered = [False] * len(page.name)
    found = []
    for i in range(len(page.name)):
        up = page.parent[i]
        covered[i] = up >= 0 and (covered[up] or page.name[up] == "article")
        if page.name[i] == "article" and not covered[i] and up >= 0 and not page.out[i]:
            inner[up] += page.chars[i]
    for i in range(len(page.name) - 1, -1, -1):
        if page.parent[i] >= 0 and page.name[i] != "article":
            inner[page.parent[i]] += inner[i]
    for i, name in enumerate(page.name):
        if name in MAIN and not page.out[i]:
            found.append((page.path[i], name, page.opens[i], page.chars[i], page.chars[i] - inner[i]))
    return found


def choose_main(found: list[tuple[int, str, float, float, float]]) -> list[int]:
    """Paths of the main slots among :func:`containers`; none: the whole page."""
    mains = [c for c in found if c[1] == "main" and c[3] > 0]
    articles = [c for c in found if c[1] == "article" and c[3] > 0]
    if mains and (not articles or any(c[4] > 0 for c in mains)):
        return sorted({c[0] for c in mains})
    return sorted({c[0] for c in articles})


def main_text(html: str, slots: list[int] | None = None, constant: list[int] | None = None) -> str:
    """The blocks of a page in the elements with a path of ``slots`` (not
    given, or not on the page: as its own elements say) but for furniture and
    the blocks whose token is constant on the host."""
    page = parsed(html)
    wanted = set(slots or ())
    if not wanted.intersection(page.path):
        wanted = set(choose_main(containers(page)))
    inside = [False] * len(page.name)
    for i, path in enumerate(page.path):
        inside[i] = path in wanted or (page.parent[i] >= 0 and inside[page.parent[i]])
    blocks = [(i, text) for i, text in page_blocks(page)
              if not wanted or (i >= 0 and inside[i])]
    fixed = set(constant or ())
    varying = [text for i, text in blocks if block_token(page, i, text) not in fixed]
    return "\n\n".join(varying or [text for _, text in blocks])


# ---------------------------------------------------------------- template

OPEN, CLOSE, TEXT = 0, 1, 2


def page_tokens(html: str) -> list[dict]:
    """The distinct tokens of a page: kind, count and place of the first; for
    opening tags the element's name, the text inside and outside of articles."""
    page = parsed(html)
    found: dict[tuple[int, int], dict] = {}

    def add(kind: int, token: int, at: int, name: str = "", chars: int = 0, outside: int = 0):
        entry = found.setdefault((kind, token), {"kind": kind, "token": token, "n": 0, "at": at,
                                                 "name": name, "chars": 0, "outside": 0})
        entry["n"] += 1
        entry["chars"] += chars
        entry["outside"] += outside

    add(OPEN, number("page"), 0)
    add(CLOSE, number("page"), len(page.pieces) + 1)
    sizes = {opens: (chars, outside) for _, _, opens, chars, outside in containers(page)}
    for i, name in enumerate(page.name):
        if not page.out[i]:
            chars, outside = sizes.get(page.opens[i], (0, 0))
            add(OPEN, page.path[i], page.opens[i], name if name in MAIN else "", chars, outside)
            add(CLOSE, page.path[i], page.closes[i])
    for place, (i, text) in enumerate(page_blocks(page)):
        add(TEXT, block_token(page, i, text), place)
    return list(found.values())


_TOKEN = [("kind", pa.int32()), ("token", pa.int64()), ("n", pa.int64()), ("at", pa.int64()),
          ("name", pa.string()), ("chars", pa.int64()), ("outside", pa.int64())]
_TOKENS = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("token", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("at", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("chars", T.LongType()),
    T.StructField("outside", T.LongType())]))


@F.arrow_udf(_TOKENS)
def _page_tokens(pages: pa.Array) -> pa.Array:
    return pa.array([page_tokens(p.as_py()) for p in pages], pa.list_(pa.struct(_TOKEN)))


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array, slots: pa.Array, constant: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py(), s.as_py(), c.as_py())
                     for p, s, c in zip(pages, slots, constant)], pa.string())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _choose_main(templates: pa.Array) -> pa.Array:
    return pa.array([choose_main([(c["path"], c["name"], c["at"], c["chars"], c["outside"])
                                  for c in t.as_py()]) for t in templates], pa.list_(pa.int64()))


def token_classes(pages: DataFrame) -> DataFrame:
    """(host, of, kind, token, pages, n, vector, constant, at, name, chars,
    outside): the tokens of each host (null: of all hosts together) that span
    enough of its ``of`` pages; equal (pages, n, vector) are one class.
    ``pages``: host, html."""
    tokens = (pages.select("host", F.xxhash64("html").alias("page"),
                           F.explode(_page_tokens("html")).alias("t")).select("host", "page", "t.*"))
    key = ["kind", "token", "name"]
    seen = materialize(tokens.groupBy("host", *key).agg(
        F.count("*").alias("pages"), F.sum("n").alias("n"), F.min("n").alias("least"),
        F.max("n").alias("most"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.sum("at").alias("at"), F.sum("chars").alias("chars"), F.sum("outside").alias("outside")))
    kinds = pages.groupBy("host", F.xxhash64("html").alias("page")).agg(F.count("*").alias("rows"))
    sizes = kinds.groupBy("host").agg(F.sum("rows").alias("of"), F.count("*").alias("kinds"))
    total = sizes.agg(F.coalesce(F.sum("of"), F.lit(0)).alias("of"))
    everywhere = seen.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in ("pages", "n")], F.min("least").alias("least"),
        F.max("most").alias("most"), F.bit_xor("vector").alias("vector"),
        *[F.sum(c).alias(c) for c in ("at", "chars", "outside")])
    own = seen.join(sizes.where(F.col("kinds") >= LEAST_PAGES).drop("kinds"), "host")
    common = everywhere.crossJoin(F.broadcast(total)).withColumn("host", F.lit(None).cast("string"))
    wide = own.unionByName(common).where(F.col("pages") >= SPAN * F.col("of"))
    constant = (F.col("pages") == F.col("of")) & (F.col("least") == F.col("most"))
    return wide.withColumn("constant", constant).drop("least", "most")


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots, constant): the main slots of each host's template and
    its constant texts; the row of null host holds for all others."""
    classes = materialize(token_classes(pages))
    cls = ["host", "pages", "n", "vector"]
    # an opening and a closing tag in one class, in order: a nested pair
    pairs = (classes.where(F.col("kind") != TEXT).groupBy(*cls, "token")
             .agg(F.max(F.when(F.col("kind") == OPEN, F.col("at"))).alias("opens"),
                  F.max(F.when(F.col("kind") == CLOSE, F.col("at"))).alias("closes"),
                  F.max("name").alias("name"), F.max("chars").alias("chars"),
                  F.max("outside").alias("outside")).where("opens < closes"))
    nested = pairs.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("opens") / F.col("pages")).alias("at"), F.col("token").alias("path"), "name",
        (F.col("chars") / F.col("pages")).alias("chars"),
        (F.col("outside") / F.col("pages")).alias("outside")))).alias("template"))
    fixed = (classes.where((F.col("kind") == TEXT) & F.col("constant")).groupBy("host")
             .agg(F.array_sort(F.collect_list("token")).alias("constant")))
    both = nested.join(fixed.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left")
    return materialize(both.select("host", _choose_main("template").alias("slots"),
                                   F.coalesce("constant", F.array().cast("array<bigint>"))
                                   .alias("constant")))


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in the new column ``out``."""
    ship_package(pages.sparkSession)
    name = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)),
                      F.lit(""))
    host, body, own, common = (free_name(pages, c) for c in ("__host", "__html", "__own", "__common"))
    source = pages.withColumns({host: name, body: F.coalesce(F.col(html), F.lit(""))})
    found = templates(source.select(F.col(host).alias("host"), F.col(body).alias("html")))
    # one row, also of no pages
    general = found.where("host IS NULL").agg(F.max(F.struct("slots", "constant")).alias(common))
    hosts = found.where("host IS NOT NULL").select(F.col("host").alias(host),
                                                   F.struct("slots", "constant").alias(own))
    held = found.agg(F.sum(F.size("slots") + F.size("constant") + 4)).first()[0] or 0
    joined = (source.join(F.broadcast(hosts), host, "left") if held <= BROADCAST_TOKENS
              else salted_join(source, hosts, [host], how="left"))
    template = F.coalesce(own, common)
    joined = joined.crossJoin(F.broadcast(general))
    return (joined.withColumn(out, _main_text(F.col(body), template["slots"], template["constant"]))
            .drop(host, body, own, common))
