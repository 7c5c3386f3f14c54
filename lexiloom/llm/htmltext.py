"""Main text of web pages by equivalence classes of tokens over the pages of a host.

Tokens are opening tags (by their path and how often it came before) and the texts
of blocks (by their path). A token's occurrence vector is the set of the host's pages
that have it, folded into a sum of page hashes, so vectors are compared without
gathering pages: sums are added up before and after one shuffle, and a host with a
third of all pages costs a row per distinct token and task.

1. Tokens on half of a host's pages and more fall into classes of equal vectors.
2. Each page is held against them (_hold): a class is ordered if its tokens come in
   one order wherever they come, and nested if it lies in one gap between the tokens
   of any other class, or the other in one of its own. Classes that break this on
   more pages than BREAKS are dropped; the others are the template.
3. What the template leaves are the slots. The article or main element of the
   template with most text of its own, or else the lowest element with practically
   all of it, is the article. Its blocks are extracted, but for texts that belong to
   the template themselves: what stands on page after page in an article's box is
   no page's own.

Titles of sections that many articles share (h1 to h6, th, dt and the like) stay where
text of the page's own follows them. Tags and names that mark menus, forms, adverts and comments are never part of a slot.

Defined results: null and empty html give an empty text; a page without an article
slot gives its blocks outside marked parts; a null or unparsable url is a host of
its own; hosts with fewer than FEW pages use the article slot of all hosts together.
Time and memory of a page follow its length, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

FEW = 5
#: The share of a host's pages that template tokens stand on, and of pages that may break a class.
COMMON, BREAKS = 0.5, 0.02
#: Of the text that differs from page to page: what an article or main element holds at least, and any other slot.
SHARE, NEARLY_ALL = 0.6, 0.98
#: A template whose own texts are more than this share of the article's isn't believed: these are copies of one article.
OWN_TEXTS = 0.5
#: Up to so many bytes the templates are broadcast.
BROADCAST_BYTES = 64 << 20

# Names of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template svg iframe textarea select option button title canvas video audio".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math noscript object q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
#: What starts a block of its own. All other elements, unknown ones too, are parts of a line.
BLOCK = set(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav ol optgroup p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Elements whose text says what the next block is about.
TITLES = set("h1 h2 h3 h4 h5 h6 th dt summary caption legend".split())
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption summary".split())
ASIDE = set("nav header footer aside form head dialog menu".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MARKED = re.compile(
    r"^(ad|ads|adv|advert|adverts|advertisement|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|sidebar|side|footer|header|masthead|breadcrumb|breadcrumbs|cookie|cookies|consent|notice|notices|gdpr|popup|modal|comment|comments|reply|replies|respond|disqus|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|widget|pagination|pager|toolbar|copyright|disclaimer|skip)$"
)
ARTICLE_HEAD = {"article", "main"}
# Parts of a name that tell of a layout ("has-sidebar"), and nouns behind a marked part ("comment-list").
LAYOUT = set("no not has have with without".split())
HOLDER = set("area bar block body bottom box button buttons container content element fixed form group holder icons inner item items left link links list main outer overlay panel primary right row secondary section slot title toggle top unit wrap wrapper".split())
# Marks that hold whatever stands inside, even elements named article.
THREAD = re.compile(r"^(comment|comments|reply|replies|respond|disqus|related|recommended)$")
HEADING = set("h1 h2 h3 h4 h5 h6".split())

_token = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(?=[a-zA-Z/!?])|(?:[^<]|<(?![a-zA-Z/!?]))+", re.S)
_attribute = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Block:
    """A text block: its aside mark, the hash of its path and text, the watched elements it lies in, and the name of its own."""

    __slots__ = ("aside", "inside", "name", "path", "place", "text")

    def __init__(self, text, aside, path, inside, place, name):
        self.text, self.aside, self.path, self.inside, self.place, self.name = text, aside, path, inside, place, name


def _marks(names: str, inside: bool) -> list[str]:
    """The marked parts of class, id and role names: a whole name, its last part, or one before a holder."""
    found = []
    for name in names.split():
        parts = [name, *(w for w in re.split(r"[-_]+", name) if w)]
        if LAYOUT.intersection(parts):
            continue
        own = [name, parts[-1], *(a for a, b in zip(parts[1:], parts[2:], strict=False) if b in HOLDER or b.isdigit())]
        # an article's own header holds its headline
        found += [w for w in own if MARKED.match(w) and not (inside and w in ("header", "notice", "notices"))]
    return found


class _Open:
    """An open element."""

    __slots__ = ("aside", "name", "named", "path", "thread", "watched")

    def __init__(self, name, path, aside, thread, named, watched):
        self.name, self.path, self.aside, self.thread, self.named, self.watched = name, path, aside, thread, named, watched


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) - (1 << 63)


@lru_cache(maxsize=1 << 16)
def _step(parent: int, name: str) -> int:
    return _hash(f"{parent}/{name}")


@lru_cache(maxsize=256)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


def parse(page: str | None, watch=frozenset()) -> tuple[list[Block], list[tuple[int, int, str, int]]]:
    """Text blocks in page order, and every element: hash of its path, of its parent's, its name, and its place among elements and blocks.

    Blocks tell which of the paths in watch they lie in. Open elements are counted,
    not searched, so a page costs time by its length and not by its depth.
    """
    blocks: list[Block] = []
    elements: list[tuple[int, int, str, int]] = []
    stack: list[_Open] = []
    open_names: Counter = Counter()
    asides = threads = heads = place = 0
    # marks by name, the innermost first: [still valid, the next]; what holds an article is a layout whatever its name
    named: list | None = None
    name_of_block: list[tuple[bool, list | None]] = []
    held: list[str] = []
    unclosed: set[str] = set()

    def flush():
        nonlocal place
        if not held:
            return
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(Block(text, False, stack[-1].path if stack else 0, stack[-1].watched if stack else (), place, stack[-1].name if stack else ""))
            place += 1
            name_of_block.append((asides > 0, named))

    def close():
        nonlocal asides, threads, heads, named
        top = stack.pop()
        open_names[top.name] -= 1
        asides -= top.aside
        threads -= top.thread
        heads -= top.name in ARTICLE_HEAD
        if top.named:
            named = named[1]

    page = page or ""
    at, last = 0, page.rfind(">")
    while at < len(page):
        if at > last:
            # no tag ends any more
            held.append(html.unescape(page[at:]))
            break
        m = _token.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if not text.startswith(("<!", "<?")):
                held.append(html.unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if m[1]:
            if open_names.get(name):
                flush()
                while stack[-1].name != name:
                    close()
                close()
            continue
        if name in RAW:
            end = None if name in unclosed else _end_of(name).search(page, at)
            if end is None:
                unclosed.add(name)
            at = end.end() if end else (len(page) if name in ("script", "style") else at)
            held.append(" ")
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name not in BLOCK and not (m[3] and _marks(" ".join(x or y or z for _, x, y, z in _attribute.findall(m[3])).lower(), heads > 0)):
            continue
        flush()
        if name in TEXTUAL or name in ("div", "ul", "ol", "table", "section", "article"):
            shut = CLOSES.get(name, set()) | {"p"}
            while stack and stack[-1].name in shut:
                close()
        found = [(a.lower(), x or y or z) for a, x, y, z in _attribute.findall(m[3])] if m[3] else ()
        attributes = " ".join([value for _, value in found]) if found else ""
        inside = heads > 0
        if name in TEXTUAL:
            # headings and paragraphs have ids of their own subject
            own = [] if name in HEADING else [w for a, value in found if a == "class" for w in value.lower().split() if MARKED.match(w)]
        else:
            own = _marks(attributes.lower(), inside) if attributes and name not in ("html", "body", "article", "main") else []
        if name in ARTICLE_HEAD and not asides and not threads:
            cell = named
            while cell is not None and cell[0]:
                cell[0] = False
                cell = cell[1]
        parent = stack[-1].path if stack else 0
        path = _step(parent, f"{name}.{attributes.split()[0]}" if attributes.strip() else name)
        aside, thread = name in ASIDE and not (name == "header" and inside), bool(own) and any(map(THREAD.match, own))
        watched = stack[-1].watched if stack else ()
        stack.append(_Open(name, path, aside, thread, bool(own), (*watched, path) if path in watch else watched))
        open_names[name] += 1
        asides += aside
        threads += thread
        heads += name in ARTICLE_HEAD
        if own:
            named = [True, named]
        elements.append((path, parent, name, place))
        place += 1
    flush()
    # names that leave nothing of the page mark nothing
    by_name = any(not tag and not (cell and cell[0]) for tag, cell in name_of_block)
    for block, (tag, cell) in zip(blocks, name_of_block, strict=True):
        block.aside = tag or (by_name and cell is not None and cell[0])
    return blocks, elements


def _host(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]+)", url or "")
    return found[1].lower() if found else ""


TAG, TEXT = 0, 1


def tokens_of(blocks: list[Block], elements) -> list[tuple[int, int, int, str, int]]:
    """(token, kind, path, name, place) of a page's tokens: a path's k-th tag, and a text under its path, the first time."""
    out, times = [], Counter()
    for path, _, name, place in elements:
        times[path] += 1
        out.append((path if times[path] == 1 else _step(path, f"#{times[path]}"), TAG, path, name if times[path] == 1 else "", place))
    seen = set()
    for b in blocks:
        token = _hash(b.text, b.path & 0xFFFFFFFFFFFFFFFF)
        if token not in seen:
            seen.add(token)
            out.append((token, TEXT, b.path, "", b.place))
    return out


# 1. occurrence vectors

PARTS = "host string, token bigint, kind int, parent bigint, name string, pages bigint, total bigint, vector bigint, place bigint, chars bigint"


def _partial(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[n for n, _ in schema])


def _statistics(batches):
    """Partial sums per (host, token): pages, occurrences of its path, folded vector, places; token 0 counts the host's pages."""
    schema = [("host", pa.string()), ("token", pa.int64()), ("kind", pa.int32()), ("parent", pa.int64()), ("name", pa.string()), *((n, pa.int64()) for n in ("pages", "total", "vector", "place", "chars"))]
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            host, mark = _host(url), _hash(f"{page_id}\x00{url}")
            blocks, elements = parse(page)
            parents, total = {path: parent for path, parent, *_ in elements}, Counter(e[0] for e in elements)
            chars = {b.place: len(b.text) for b in blocks}
            tokens = tokens_of(blocks, elements)
            for key, own in ((host, tokens), ("*", [t for t in tokens if t[3]])):
                for token, kind, path, name, place in [(0, -1, 0, "", 0), *own]:
                    s = sums.get((key, token))
                    if s is None:
                        s = sums[key, token] = [kind, path if kind == TEXT else parents.get(path, 0), name, 0, 0, 0, 0, 0]
                    s[3] += 1
                    s[4] += total[path] if name else 1
                    s[5] = (s[5] + mark) & 0xFFFFFFFFFFFFFFFF
                    s[6] += place
                    s[7] = max(s[7], chars.get(place, 0))
        rows = [(h, t, *s[:5], s[5] - (1 << 63), *s[6:]) for (h, t), s in sums.items()]
        if rows:
            yield _partial(rows, schema)


# 2. classes

FRAME = np.dtype([("token", "<i8"), ("kind", "<i4"), ("cls", "<i4"), ("parent", "<i8"), ("once", "?"), ("head", "?"), ("textual", "?")])


def _classes(table: pa.Table) -> pa.Table:
    """The common tokens of a host in their mean order, with the numbers of their classes."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["place"] / r["pages"], r["token"]))
    numbers: dict[tuple, int] = {}
    for r in rows:
        numbers.setdefault((r["pages"], r["vector"]), len(numbers))
    frame = np.array([(r["token"], r["kind"], numbers[r["pages"], r["vector"]], r["parent"], bool(r["name"]) and r["total"] == r["pages"], r["name"] in ARTICLE_HEAD, r["name"] in TEXTUAL) for r in rows], FRAME)
    return pa.table({"host": [rows[0]["host"]], "frame": pa.array([frame.tobytes()], pa.binary()), "n_pages": pa.array([rows[0]["n_pages"]], pa.int64())})


@lru_cache(maxsize=512)
def _frame(blob: bytes):
    """A host's frame: tokens with their numbers, tag paths that stand once, and the sizes of classes."""
    frame = np.frombuffer(blob, FRAME)
    order = {int(t): k for k, t in enumerate(frame["token"])}
    once = frozenset(frame["token"][frame["once"]].tolist())
    texts = frozenset(frame["token"][frame["kind"] == TEXT].tolist())
    return frame, order, once, texts, np.bincount(frame["cls"], minlength=1)


def broken_classes(found: list[int], frame: np.ndarray, sizes: np.ndarray) -> set[int]:
    """The classes that a page breaks; found: the numbers of its frame tokens in page order."""
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at, k in enumerate(found):
        places[int(frame["cls"][k])].append((at, k))
    broken = set()
    for c, own in places.items():
        # all tokens or none, in the mean order
        if len(own) != sizes[c] or any(a[1] > b[1] for a, b in zip(own, own[1:], strict=False)):
            broken.add(c)
    whole = sorted((c for c in places if c not in broken), key=lambda c: (-len(places[c]), c))
    spans = {c: [at for at, _ in places[c]] for c in whole}
    for i, outer in enumerate(whole):
        for inner in whole[i + 1 :]:
            a, b = spans[outer], spans[inner]
            gaps = {int(x) for x in np.searchsorted(a, b)}
            if len(gaps) > 1 and len({int(x) for x in np.searchsorted(b, a)}) > 1:
                broken.add(inner)
    return broken


def _hold(batches):
    """Partial sums per host of pages held against its frame: pages that break a class, and characters of differing and of template texts in each element."""
    schema = [("host", pa.string()), ("what", pa.int32()), ("key", pa.int64()), ("amount", pa.int64())]
    for batch in batches:
        sums: dict[tuple[str, int, int], int] = defaultdict(int)
        for host, page, blob, general in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            frames = [("*", general)] if general else []
            if blob:
                frames.append((host, blob))
            if not frames:
                continue
            watch = frozenset().union(*(_frame(x)[2] for _, x in frames))
            blocks, elements = parse(page, watch)
            tokens = sorted(tokens_of(blocks, elements), key=lambda t: t[4])
            for key, x in frames:
                frame, order, once, texts, sizes = _frame(x)
                for c in broken_classes([order[t[0]] for t in tokens if t[0] in order], frame, sizes):
                    sums[key, 0, c] += 1
                for b in blocks:
                    if b.aside:
                        continue
                    token = _hash(b.text, b.path & 0xFFFFFFFFFFFFFFFF)
                    what = 2 if token in texts else 1
                    for path in (0, *b.inside):
                        if path == 0 or path in once:
                            sums[key, what, path] += len(b.text)
        if sums:
            yield _partial([(*k, n) for k, n in sums.items()], schema)


# 3. templates

TEMPLATE = "host string, slot bigint, texts binary, n_pages bigint"


def _template(frames: pa.Table, sums: pa.Table) -> pa.Table:
    """The article slot of a host, and the texts that belong to its template."""
    if not frames.num_rows:
        return pa.table({"host": pa.array([], pa.string()), "slot": pa.array([], pa.int64()), "texts": pa.array([], pa.binary()), "n_pages": pa.array([], pa.int64())})
    host, blob, pages = (frames[c][0].as_py() for c in ("host", "frame", "n_pages"))
    frame, _, _, _, sizes = _frame(blob)
    amount = {(r["what"], r["key"]): r["amount"] for r in sums.to_pylist()}
    valid = np.array([amount.get((0, c), 0) <= BREAKS * pages for c in range(len(sizes))])
    kept = frame[valid[frame["cls"]]]
    # a text that is alone in its class may be chance
    texts = kept[(kept["kind"] == TEXT) & (sizes[kept["cls"]] > 1)]["token"].tolist()
    tags = kept[kept["once"]]
    mass = lambda p: amount.get((1, p), 0)
    heads = {int(p): int(q) for p, q in tags[tags["head"]][["token", "parent"]].tolist()}
    parents = {int(p): int(q) for p, q in tags[["token", "parent"]].tolist()}

    def under_head(p):
        while (p := parents.get(p)) is not None:
            if p in heads:
                return True
        return False

    slot, left = 0, mass(0)
    # what stands beside an article isn't part of it; an article's own parts all are
    head = max((p for p in heads if not under_head(p)), key=lambda p: (mass(p), p), default=None)
    if head is not None and mass(head) >= SHARE * max(left, 1):
        slot = head
    plain = tags[~tags["textual"]]
    while slot not in heads:
        inner = plain[plain["parent"] == slot]["token"].tolist()
        best = max(inner, key=lambda p: (mass(p), p), default=None)
        if best is None or mass(best) < NEARLY_ALL * max(left, 1):
            break
        slot, left = best, mass(best)
    if amount.get((2, slot), 0) > OWN_TEXTS * (amount.get((2, slot), 0) + mass(slot)):
        texts = []
    return pa.table({"host": [host], "slot": pa.array([slot], pa.int64()), "texts": pa.array([np.array(texts, "<i8").tobytes()], pa.binary()), "n_pages": pa.array([pages], pa.int64())})


def _given(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))


def _host_column():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]+)", 1))


def _with_hosts(pages: DataFrame, rows: DataFrame, size) -> DataFrame:
    """pages with what rows tells of their host: broadcast if it is small, else joined, and Spark splits the large hosts."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return pages.join(F.broadcast(rows) if total <= BROADCAST_BYTES else rows, "host", "left")


def deduce_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host of FEW pages or more, and '*' for all together: the hash of its article slot's path (0: none) and the template's texts."""
    given = _given(pages, id_col, url_col, html_col)
    sums = given.mapInArrow(_statistics, PARTS).groupBy("host", "token").agg(*(F.first(c).alias(c) for c in ("kind", "parent", "name")), *(F.sum(c).alias(c) for c in ("pages", "total", "place")), F.xxhash64(F.sum(F.col("vector").cast("decimal(38,0)"))).alias("vector"), F.max("chars").alias("chars"))
    # most tokens stand on one page only
    sums = materialise(sums.where(F.col("pages") >= FEW))
    totals = sums.where("kind = -1").select("host", F.col("pages").alias("n_pages"))
    common = sums.where("kind >= 0").join(totals, "host").where(F.col("pages") >= COMMON * F.col("n_pages"))
    # a host's common tokens are at most twice as many as a page has
    frames = materialise(common.groupBy("host").applyInArrow(_classes, "host string, frame binary, n_pages bigint"))
    general = frames.where("host = '*'").select("frame").first()
    held = _with_hosts(given.withColumn("host", _host_column()), frames.where("host <> '*'").select("host", "frame"), F.length("frame"))
    held = held.select("host", "html", "frame", F.lit(bytes(general["frame"]) if general else None).cast("binary").alias("general"))
    parts = held.mapInArrow(_hold, "host string, what int, key bigint, amount bigint").groupBy("host", "what", "key").agg(F.sum("amount").alias("amount"))
    return frames.groupBy("host").cogroup(parts.groupBy("host")).applyInArrow(_template, TEMPLATE)


@lru_cache(maxsize=512)
def _texts(blob: bytes) -> frozenset:
    return frozenset(np.frombuffer(blob, "<i8").tolist())


def extract(page: str | None, slot: int | None, texts: bytes = b"") -> str:
    """The blocks of the slot without the template's texts, or all blocks outside marked parts if the page lacks it."""
    blocks, _ = parse(page, frozenset((slot,)) if slot else frozenset())
    common = _texts(texts)
    free = [b for b in blocks if not b.aside]
    own = [b for b in free if slot in b.inside] if slot else free
    if common:
        own, kept = own or free, []
        for b in reversed(own):
            # a title that many pages share belongs to the text of the page's own that follows it
            stays = _hash(b.text, b.path & 0xFFFFFFFFFFFFFFFF) not in common or (b.name in TITLES and bool(kept) and kept[-1] is not None)
            kept.append(b.text if stays else None)
        return "\n".join(t for t in reversed(kept) if t is not None)
    return "\n".join(b.text for b in own or free)


def _extract_batches(batches):
    for batch in batches:
        texts = [extract(p, s, t or b"") for p, s, t in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    templates = materialise(deduce_templates(pages))
    general = templates.where("host = '*'").first()
    own = templates.where("host <> '*'").select("host", "slot", "texts")
    given = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host_column().alias("host"))
    joined = _with_hosts(given, own, F.length("texts") + 100)
    joined = joined.select("page_id", "url", "html", F.coalesce("slot", F.lit(general["slot"] if general else None).cast("bigint")).alias("slot"), "texts")
    return joined.mapInArrow(_extract_batches, "page_id bigint, url string, text string, n_chars bigint")
