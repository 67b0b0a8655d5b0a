"""Main text of web pages: a host's repeated strings, with the markup as a hint.

1. A scan turns every page into blocks of text in page order.  Markup says what
   a block most likely is: prose of the article (``article`` or ``main``), doubtful
   inside the article (a class, id or role that often names boilerplate), other
   text, or chrome (``nav``, ``footer``, forms, adverts, comments and the like).
2. The tokens of every page make up two streams, the article's prose and all
   else.  Pages are range-partitioned and sorted by host and page, so a large
   host spans as many tasks as it needs; each run of ``BUCKET`` to twice as many
   pages of a host is a part whose suffix array is built by prefix doubling over the
   tokens themselves, to the depth of ``run`` tokens.  Suffixes of equal rank
   are repeats, and those that overlap make up the longer ones: a longer repeat
   on some pages is one of ``run`` tokens on as many at each of its places, so a
   deeper order would cover the same tokens.
3. Repeats outside prose are added up over a host's parts by a digest of those
   ``run`` tokens; one on ``repeats`` pages is boilerplate.  Whatever they cover
   goes and unique runs stay: in the doubtful blocks of an article, and in all
   text of a page without one.  Chrome, and what stands beside an article, goes
   by its markup.
4. Prose takes more, as articles of a host do share passages, and such passages
   are text: a block goes if repeats in prose cover all of it that are on at least
   ``share`` of the host's pages with prose, and on ``STANDING`` pages, and if all such
   blocks are no more than half of the page's prose.  Each part names the runs that
   are frequent in it, and these are counted exactly on all pages of the host.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stash

#: Tokens of a repeat, distinct pages it must be on outside prose, and least pages of a large host whose suffixes are sorted together.
RUN, PAGES, BUCKET = 6, 3, 256
#: Share of a host's pages with prose, and least number of them, that a repeat in prose must be on to be boilerplate.
SHARE, STANDING = 0.5, 10
#: Tokens from which on fewer pages are sorted together, and how few.
TOKENS, FEW = 1 << 20, 8

#: Comments, declarations, tags with well-formed attributes, other tags up to the next ">", a tag that the page's end cuts.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[\s/]++|[^\s\"'>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+)*+)>)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")

#: Elements without content, elements whose content is not text, blocks, chrome.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CHROME = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Parts of class names and ids that name chrome, and those that may as well stand on prose.
CERTAIN = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "adsense", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "footer", "comment", "comments", "disqus", "replies", "pagination"}
DOUBTFUL = {"promo", "promotion", "banner", "notice", "notices", "alert", "overlay", "subscribe", "signup", "side", "header", "respond", "share", "sharing", "social", "related", "recommended", "widget", "widgets", "pager", "skip", "toolbar", "hidden"}
#: Elements that end at the next tag of the same kind if they are not closed.
OPEN_ENDED = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}

#: What the markup says of a block.
ARTICLE, DOUBT, NEITHER, FLAGGED = 3, 2, 1, 0


def hint(name: str, attributes: str, inside: bool) -> int:
    """0 for an element that is no chrome, 1 for a doubtful one, 2 for chrome; a header inside an article is its own."""
    if name in CHROME and not (inside and name == "header"):
        return 2
    out = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return 2
        if key in ("class", "id") and name not in ("html", "body", "main", "article"):
            parts = {part for word in value.split() for part in (word, *re.split(r"[-_]+", word))}
            out = max(out, 2 if parts & CERTAIN else 1 if parts & DOUBTFUL else 0)
    return out


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, ARTICLE, DOUBT, NEITHER or FLAGGED) of every block in page order; the text has its white space settled."""
    page = page or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # name, hint, article
    hints = [0, 0, 0]
    article = 0
    words: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(words))).strip()
        if text:
            chrome = hints[2] or (hints[1] and not article)
            out.append((text, FLAGGED if chrome else DOUBT if hints[1] else ARTICLE if article else NEITHER))
        words.clear()

    def pop() -> None:
        nonlocal article
        _, h, a = stack.pop()
        hints[h] -= 1
        article -= a

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            words.append(page[at:])
            break
        words.append(page[at : m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not end and not attributes.endswith("/"):
                last = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = last.end() if last else len(page)
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in BLOCKS or name in CHROME:
            close()
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("body", "html"):
                    break  # a stray end tag doesn't close what it stands in
        elif name not in VOID and not attributes.endswith("/"):
            if name in OPEN_ENDED and stack and stack[-1][0] == name:
                pop()
            h, a = hint(name, attributes, article > 0), name in ("article", "main")
            if h or a or name in BLOCKS:
                stack.append((name, h, a))
                hints[h] += 1
                article += a
    close()
    return out


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every place's next ``depth`` tokens in lexicographic order, by prefix doubling; equal ones share a rank."""
    rank, wide = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    while wide < depth:
        step = min(wide, depth - wide)
        later = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])
        rank, wide = np.unique(rank << 32 | later, return_inverse=True)[1].astype(np.int64) + 1, wide + step
    return rank


def repeats_of(pages: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of pages' tokens: (rank, page, place) of every suffix of at least ``run`` tokens, by rank, page and place."""
    sizes = np.array([len(w) for w in pages], np.int64)
    known: dict[str, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for page in pages for w in page), np.int64, int(sizes.sum()))
    page = np.repeat(np.arange(len(pages)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = place + run <= sizes[page]
    rank = suffix_ranks(flat, run)[whole]
    order = np.argsort(rank, kind="stable")
    return rank[order], page[whole][order], place[whole][order]


def pack(texts: list[str]) -> tuple[bytes, int]:
    """Texts without line breaks in few bytes, as they are written, sorted and shuffled; and their size."""
    raw = "\n".join(texts).encode()
    return pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True), len(raw)


def unpack(packed: bytes, size: int) -> list[str]:
    return pa.Codec("zstd").decompress(packed, size, asbytes=True).decode().split("\n")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, repeats: int = PAGES, share: float = SHARE) -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` and ``n_chars``.

    Blocks are joined by an empty line; white space inside a block is one
    space; character references are decoded.  A page with an ``article`` or
    ``main`` has its text there, without the chrome in it, without what
    repeats of ``run`` tokens on at least ``repeats`` pages of its host cover in its
    doubtful blocks, and without the blocks of prose that stand on ``share`` of the
    host's pages; any other page has all that is neither chrome nor covered.

    A null page counts as empty; a page without main text has an empty text.
    A null url, or one without a host, belongs to the host ''.  Rows that repeat url and
    page are one page of the host and get the same result.  An empty table gives an empty
    result.  A tag that lacks a closing quote ends at its first ">".  Only the named columns are read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(F.lower(F.regexp_extract(url_col, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("host"), F.xxhash64(F.coalesce(url_col, F.lit("")), F.coalesce(html_col, F.lit(""))).alias("page"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [blocks_of(part.column("html")[i].as_py()) for i in range(part.num_rows)]
                # Pages that have blocks other than prose to decide on.
                open_ = [all(k != ARTICLE for _, k in f) or any(k == DOUBT for _, k in f) for f in found]
                packed = [pack([t for t, _ in f]) for f in found]
                cells = [pa.array(v, t) for v, t in ((open_, pa.bool_()), ([x for x, _ in packed], pa.binary()), ([n for _, n in packed], pa.int32()), ([[k for _, k in f] for f in found], pa.list_(pa.int8())))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "url", "host", "page")), *cells], names=["id", "url", "host", "page", "open", "packed", "size", "kinds"])

    parsed = stash(base.mapInArrow(parse, f"id {kind}, url string, host string, page long, open boolean, packed binary, size int, kinds array<tinyint>"), "blocks")
    streams = parsed.select("host", "page", "open", "packed", "size", "kinds").where(F.size("kinds") > 0)
    dealt = streams.repartitionByRange("host", "page").sortWithinPartitions("host", "page")
    least, part_share = max(repeats, STANDING), 0.8 * share

    def suffix_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal suffixes of a part of a host.

        Outside prose: their digest, their number of pages, and where they are in open pages.  Of prose: the runs on
        ``part_share`` of the part's pages with prose, and of a part so small that these are all its runs, its name and size.
        """

        def groups(host: str, held: list[tuple[int, bool, list[str], list[str]]], alone: bool) -> Iterator[pa.RecordBatch]:
            words = [w for _, _, *both in held for w in both]  # outside prose, prose, of one page after the other
            rank, stream, place = repeats_of(words, run)
            spell = lambda x, p: ["\n".join(words[a][k : k + run]) for a, k in zip(x.tolist(), p.tolist(), strict=True)]

            def side(prose: int) -> tuple[np.ndarray, ...]:
                """Streams and places of this side by rank, heads of the groups, each one's group and number of pages."""
                of = stream % 2 == prose
                r, x, p = rank[of], stream[of], place[of]
                new = np.ones(len(r), bool)
                new[1:] = r[1:] != r[:-1]
                heads, group = np.nonzero(new)[0], np.cumsum(new) - 1
                first = np.ones(len(r), bool)  # the first suffix of its page in its group
                first[1:] = new[1:] | (x[1:] != x[:-1])
                return x, p, heads, group, np.bincount(group, first, len(heads)).astype(np.int64)

            x, place_, heads, group, n = side(0)
            digests = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in spell(x[heads], place_[heads])), np.int64).reshape(-1, 2)
            wanted = np.array([o for _, o, *_ in held], bool)[x // 2]
            edges = np.append(0, np.cumsum(np.bincount(group, wanted, len(heads)).astype(np.int64)))
            names = np.array([p for p, *_ in held], np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v[wanted])) for v in (names[x // 2], place_)]
            cells = [pa.array([host] * len(heads), pa.string()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(n), *lists, pa.nulls(len(heads), pa.string())]
            yield pa.RecordBatch.from_arrays(cells, schema=columns)
            articles = sum(len(w) > 0 for *_, w in held)
            if alone and articles < least:
                return
            x, place_, heads, _, n = side(1)
            heads = heads[n >= part_share * articles - 1e-9]
            small = articles <= 1 / part_share
            cells = [[host], [int(names[0])], [None], [articles if small else None], [None], [None]]
            standing = pa.array(spell(x[heads], place_[heads]), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c * len(heads), f.type) for c, f in zip(cells, columns, strict=False)), standing], schema=columns)

        columns = pa.schema([("host", pa.string()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("pages", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("standing", pa.string())])
        enough = int(1 / part_share) + 1  # no part is small but one that is all the task has of its host
        most, fewest = max(BUCKET, enough), max(min(BUCKET, FEW), enough)
        now, held, tokens, inner = None, [], 0, False  # inner: the host began in this task, and no part of it has been dealt with
        for b in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            for host, page, open_, packed, size, kinds in zip(*(b.column(c).to_pylist() for c in ("host", "page", "open", "packed", "size", "kinds")), strict=True):
                if held and host != now:
                    yield from groups(now, held, inner)
                    held, tokens, inner = [], 0, True
                elif held and held[-1][0] != page and (len(held) >= 2 * most or (len(held) >= 2 * fewest and tokens >= TOKENS)):
                    yield from groups(now, held[: len(held) // 2], False)
                    held, inner = held[len(held) // 2 :], False
                    tokens = sum(len(w) for _, _, *both in held for w in both)
                if not held or held[-1][0] != page:  # a repeated row is the same page
                    texts = unpack(packed, size)
                    both = [[w for t, k in zip(texts, kinds, strict=True) if (k == ARTICLE) == prose for w in t.split()] for prose in (False, True)]
                    held.append((page, open_, *both))
                    tokens += len(both[0]) + len(both[1])
                now = host
        if held:
            yield from groups(now, held, False)

    schema = "host string, s1 long, s2 long, n long, pages array<long>, places array<long>, standing string"
    found = stash(dealt.mapInArrow(suffix_groups, schema), "suffixes")
    groups = found.where("standing IS NULL").drop("standing")
    often = groups.groupBy("host", "s1", "s2").agg(F.sum("n").alias("total")).where(F.col("total") >= repeats).select("host", "s1", "s2")
    hit = groups.where(F.size("pages") > 0).join(often, ["host", "s1", "s2"]).select("host", F.explode(F.arrays_zip("pages", "places")).alias("x"))
    marks = hit.groupBy("host", F.col("x.pages").alias("page")).agg(F.collect_list("x.places").alias("marks"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where a page's prose has the runs that some part of its host named."""
        for b in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            known: dict[str, tuple[set[str], set[str]]] = {}
            out: list[tuple[str, int, str, list[int]]] = []
            for i in range(b.num_rows):
                host, page, packed, size, kinds = (b.column(c)[i].as_py() for c in ("host", "page", "packed", "size", "kinds"))
                if host not in known:
                    runs = set(b.column("runs")[i].as_py())
                    known[host] = runs, {x.split("\n", 1)[0] for x in runs}
                runs, heads = known[host]
                words = [w for t, k in zip(unpack(packed, size), kinds, strict=True) if k == ARTICLE for w in t.split()]
                at: dict[str, list[int]] = {}
                for k in range(len(words) - run + 1):
                    if words[k] in heads and (x := "\n".join(words[k : k + run])) in runs:
                        at.setdefault(x, []).append(k)
                out += [(host, page, x, v) for x, v in at.items()]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["host", "page", "run", "places"])

    # A run of prose on ``share`` of a host's pages is on it in one of the host's parts, and on ``part_share`` in one that
    # is not small unless small parts are many; it is then counted on all pages, as parts with fewer do not name it.
    prose = parsed.where(F.array_contains("kinds", F.lit(ARTICLE).cast("tinyint")))
    articles = prose.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("articles")).where(F.col("articles") >= least)
    runs = found.where("standing IS NOT NULL").join(articles, "host")
    small = runs.where("n IS NOT NULL").select("host", "s1", "n").distinct().groupBy("host").agg(F.sum("n").alias("small"))
    few = F.col("small") * (1 - part_share) <= (share - part_share) * F.col("articles")
    named = stash(runs.join(small, "host", "left").where(F.col("n").isNull() | ~few).groupBy("host", "articles").agg(F.collect_set("standing").alias("runs")), "named")
    seen = stash(prose.join(named, "host").select("host", "page", "packed", "size", "kinds", "runs").mapInArrow(places, "host string, page long, run string, places array<long>"), "seen")
    totals = seen.groupBy("host", "run").agg(F.count_distinct("page").alias("total")).join(named.select("host", "articles"), "host")
    standing = totals.where((F.col("total") >= least) & (F.col("total") >= share * F.col("articles"))).select("host", "run")
    fixed = stash(seen.join(standing, ["host", "run"]).select("host", "page", "places").distinct().groupBy("host", "page").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("prose_marks")), "standing")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cover(marks: list[int] | None, n: int) -> np.ndarray:
            edge = np.zeros(n + 1, np.int64)
            at = np.array(marks or [], np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + run, -1)
            return np.cumsum(edge) > 0

        for b in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            texts_out = []
            for i in range(b.num_rows):
                packed, size, kinds, marks, prose_marks = (b.column(c)[i].as_py() for c in ("packed", "size", "kinds", "marks", "prose_marks"))
                texts = unpack(packed, size) if kinds else []
                article = ARTICLE in kinds or DOUBT in kinds
                if not marks and not prose_marks:
                    texts_out.append("\n\n".join(t for t, k in zip(texts, kinds, strict=True) if k == ARTICLE or k == (DOUBT if article else NEITHER)))
                    continue
                sizes = [len(t.split()) for t in texts]
                of = [k == ARTICLE for k in kinds]
                lengths = [sum(n for n, a in zip(sizes, of, strict=True) if a == side) for side in (False, True)]
                covered = [cover(m, n) for m, n in zip((marks, prose_marks), lengths, strict=True)]
                begin, own = [0, 0], []
                for n, a in zip(sizes, of, strict=True):
                    own.append(covered[a][begin[a] : begin[a] + n])
                    begin[a] += n
                # Blocks of prose go whole or not at all, and not if they are most of it: then they are the article, and its pages copies.
                whole = [a and bool(x.all()) for a, x in zip(of, own, strict=True)]
                if 2 * sum(n for n, w in zip(sizes, whole, strict=True) if w) > lengths[1]:
                    whole = [False] * len(whole)
                kept = []
                for text, kind_, x, gone in zip(texts, kinds, own, whole, strict=True):
                    if kind_ == ARTICLE:
                        if not gone:
                            kept.append(text)
                    elif kind_ == (DOUBT if article else NEITHER) and not x.all():
                        kept.append(text if not x.any() else " ".join(w for w, cut in zip(text.split(), x, strict=False) if not cut))
                texts_out.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts_out, pa.string())], names=["id", "url", "text"])

    # Pages that nothing was found for don't meet the marks, so their texts stay where they are.
    hosts = stash(fixed.select("host").distinct(), "hosts").withColumn("fixed", F.lit(True))
    told = parsed.join(hosts, "host", "left").withColumn("meets", F.col("open") | F.col("fixed").isNotNull())
    met = told.where("meets").join(marks, ["host", "page"], "left").join(fixed, ["host", "page"], "left")
    rest = told.where("NOT meets").withColumns({c: F.lit(None).cast("array<long>") for c in ("marks", "prose_marks")})
    cells = ("id", "url", "packed", "size", "kinds", "marks", "prose_marks")
    out = met.select(*cells).unionByName(rest.select(*cells)).mapInArrow(keep, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
