"""HTML extraction by nearest-URL page differencing.

A page is first cut into text lines: one for each block element, without markup and without the parts whose
element or attributes declare them to be something other than the article. Pages are then put in the order of
their URL paths within each host, and the lines of neighbours are aligned by their longest common subsequence: what
a site repeats from page to page is not the article. How much evidence that takes depends on what the page says of
itself:

* Where it has no <article> or <main>, it is paired with the nearer of its two neighbours (the longer common path; the
  earlier page on a tie), and the lines that they share are deleted.
* Where it has, only the lines in there are taken, and as two articles may well quote the same sentence, a line goes if
  it is aligned in all of the REACH nearest pages on either side that are different articles, two at least. A page that
  shares more than half of the article's characters is another version of it and does not count.

Pages of a host with the same lines (copies) count as one page in the pairing, so a copy does not delete its own
text, and pages without lines are passed over, however many of them there are.

Cases: a null or empty html gives the empty text; null URLs have the empty host and path, and are paired like
others; unclosed elements end with their parent; pages with equal URLs follow each other by id."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, named, quantiles, slices, small_batches

#: Different pages looked at on either side.
REACH = 2
MAX_BUCKETS = 4_000
SAMPLED = 50

# Element names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset("applet audio button canvas dialog embed form footer head iframe input map math menu nav noembed noframes noscript object picture script select style svg template textarea title video aside xmp datalist label fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that the start of another ends without an end tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: Words of class, id and role that mark what is no article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs masthead footer colophon comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations widget widgets login search searchbox pagination pager toolbar skip contentinfo complementary form dialog alertdialog menubar toc copyright disclaimer".split())
UNMARKED = frozenset("html body main".split())
#: Words before a mark by which a class tells what else is on the page, as in has-sidebar.
ABOUT = frozenset("has with no without is not".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def declared(name: str, attributes: str) -> str:
    """`gone` if the attributes mark an element as something other than the article, `header` if as a header."""
    found = ""
    if not attributes or attributes.isspace():
        return found
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role") and name not in UNMARKED:
            words = [w.lower() for w in SPLIT.split(value)]
            for before, word in zip(["", *words], words, strict=False):
                if before not in ABOUT:
                    if word in MARKS:
                        return "gone"
                    if word == "header":
                        found = "header"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "gone"
    return found


def lines_of(html: str | None) -> tuple[list[str], bool]:
    """The text lines of a page in order, and whether they come from an explicit article or main element."""
    if not html:
        return [], False
    stack: list[tuple[str, bool, bool, bool]] = []  # name, gone, in a header, in the article
    gone = in_header = in_main = False
    inside: list[str] = []
    outside: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if piece:
            text = "".join(piece)
            piece.clear()
            line = " ".join((entities.unescape(text) if "&" in text else text).split())
            if line:
                (inside if in_main else outside).append(line)

    def close(depth: int) -> None:
        nonlocal gone, in_header, in_main
        flush()
        del stack[depth:]
        _, gone, in_header, in_main = stack[-1] if stack else ("", False, False, False)

    at = 0
    while True:
        token = TOKEN.search(html, at)
        stop = token.start() if token else len(html)
        if stop > at and not gone and not in_header:
            piece.append(html[at:stop])
        if not token:
            break
        at = token.end()
        name = token[2]
        if name is None:
            if token[0].startswith("<![CDATA[") and not gone and not in_header:
                piece.append(entities.escape(token[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = name.lower()
        if token[1]:
            if name == "br" or name == "p" and not any(x[0] == "p" for x in stack):
                piece.append(" ") if name == "br" else flush()
                continue
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is None:
                continue
            if name not in BLOCKS and not stack[depth][1] and any(x[0] in BLOCKS for x in stack[depth:]):
                continue  # a stray end of formatting around blocks
            if name in BLOCKS or any(x[0] in BLOCKS for x in stack[depth:]):
                close(depth)
            else:
                del stack[depth:]
                _, gone, in_header, in_main = stack[-1] if stack else ("", False, False, False)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr") and not gone:
                piece.append(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSES:
                ends = CLOSES[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu") and stack[k][0] != name:
                        break
                    if stack[k][0] in ends:
                        close(k)
                        break
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        attributes = token[3]
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        kind = "gone" if gone or name in GONE else declared(name, attributes)
        own_gone = kind == "gone"
        main = in_main or (not own_gone and (name in ("article", "main") or "role" in attributes and bool(re.search(r"role\s*=\s*[\"']?(main|article)\b", attributes))))
        # Of a header only the headings are of the article, and of one outside of it nothing is.
        begins = (name == "header" or kind == "header") and name not in ("article", "main")
        header = (in_header or begins) and name not in HEADINGS
        if begins and not main and name not in HEADINGS:
            own_gone = True
        stack.append((name, own_gone, header, main))
        gone, in_header, in_main = own_gone, header, main
    flush()
    return (inside, True) if inside else (outside, False)


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indexes in a of a longest common subsequence of lines of a and b.

    Lines that only one of them has are left out; the rest is cut in halves by rows of lengths that are computed for
    all places of b at once in the bits of one number, so equal lines, however many, cost no more than others."""
    both = set(a) & set(b)
    number = {line: k for k, line in enumerate(both)}
    places = [i for i, line in enumerate(a) if line in both]
    return {places[i] for i in _aligned([number[a[i]] for i in places], [number[x] for x in b if x in both])}


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b."""
    at: dict[int, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    open_ = every
    for x in a:
        met = open_ & at.get(x, 0)
        open_ = ((open_ + met) | (open_ - met)) & every
    taken = np.unpackbits(np.frombuffer((every ^ open_).to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(taken, dtype=np.int64)))


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Indexes in a of a longest common subsequence, by halves."""
    out, todo = [], [(0, a, b)]
    while todo:
        shift, a, b = todo.pop()
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        out += range(shift, shift + head)
        shift, a, b = shift + head, a[head:], b[head:]
        tail = 0
        while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        out += range(shift + len(a) - tail, shift + len(a))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not a or not b:
            continue
        if len(a) == 1:
            out += [shift] if a[0] in b else []
            continue
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        todo += [(shift, a[:half], b[:cut]), (shift + half, a[half:], b[cut:])]
    return out


def common_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Pairing:
    """Streams the pages of a bucket in order and emits their texts; pages with equal lines are one group."""

    def __init__(self, emit):
        self.emit = emit
        self.clear()

    def clear(self) -> None:
        """Forgets the neighbours."""
        self.groups: list[tuple] = []  # host, path, lines, explicit, pages (rows to emit)
        self.done = 0  # of the groups held, those whose pages are out

    def add(self, host, path, lines, explicit, page) -> None:
        if not lines:  # nothing to compare with
            if page:
                self.emit(page, "")
            return
        last = self.groups[-1] if self.groups else None
        if last and last[0] == host and last[2] == lines and last[3] == explicit:
            if page:
                last[4].append(page)
            return
        self.groups.append((host, path, lines, explicit, [page] if page else []))
        while len(self.groups) - 1 - self.done >= REACH:
            self.settle()

    def settle(self) -> None:
        """Emits the pages of the first group that is not out."""
        now = self.groups[self.done]
        if now[4]:
            before = [g for g in self.groups[max(0, self.done - REACH) : self.done] if g[0] == now[0]]
            after = [g for g in self.groups[self.done + 1 : self.done + 1 + REACH] if g[0] == now[0]]
            gone = repeated(now, before, after)
            text = "\n\n".join(x for i, x in enumerate(now[2]) if i not in gone)
            for page in now[4]:
                self.emit(page, text)
            now[4].clear()
        self.done += 1
        if self.done > REACH:
            del self.groups[0]
            self.done -= 1

    def finish(self) -> None:
        while self.done < len(self.groups):
            self.settle()
        self.clear()


def repeated(now: tuple, before: list[tuple], after: list[tuple]) -> set[int]:
    """Indexes of the lines of a group (host, path, lines, explicit) that its neighbours of the host give away."""
    lines = now[2]
    if not now[3]:
        near = before[-1:] + after[:1]
        return shared_lines(lines, max(near, key=lambda g: common_path(g[1], now[1]))[2]) if near else set()
    size = sum(map(len, lines))
    shared = [shared_lines(lines, g[2]) for g in before + after]
    # A neighbour that has most of the article is another version of it, and no evidence.
    shared = [found for found in shared if 2 * sum(len(lines[i]) for i in found) <= size]
    return set.intersection(*shared) if len(shared) >= 2 else set()


def _key(url: str) -> "F.Column":
    """Host and path of a URL: lower-case host; the path without its end slash or .html, query and fragment."""
    u = F.coalesce(named(url).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1), r"(?:\.html?|/)$", "")
    return host, path


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", buckets: int | None = None) -> DataFrame:
    """id, url, text and n_chars for each page.

    Pages are dealt by the order of (host, path, id) to buckets, so a host of any size is spread over many. A first
    pass, of marks alone, finds the outer groups of each bucket; each bucket is then given a page of each of the REACH groups that stand
    before and after it, over as many buckets as a group goes on, so the texts do not depend on the cuts. Cuts come
    from a bounded sample of keys."""
    spark = pages.sparkSession
    small_batches(spark)
    host, path = _key(url_col)
    number = F.coalesce(named(id_col).cast("string"), F.lit(""))
    key = F.concat_ws("\u0001", host, path, F.when(F.length(number) < 24, F.lpad(number, 24, "0")).otherwise(number))
    buckets = buckets or min(MAX_BUCKETS, max(4, 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = pages.select(key.alias("key"))
    ordered = sorted((r[0] for r in bounded_sample(keys, "key", SAMPLED * buckets, seed=29).collect()), key=lambda k: k.encode())
    cuts = sorted(quantiles(ordered, buckets), key=lambda k: k.encode())
    id_type = pages.schema[id_col].dataType.simpleString()
    source = pages.select(named(id_col), named(url_col).cast("string"), host.alias("host"), path.alias("path"), key.alias("key"), named(html_col).cast("string"))
    encoded = [c.encode() for c in cuts]

    def parse(batches):
        import pyarrow.compute  # noqa: F401

        for piece in slices(batches, 5):
            rows = []
            for i, (key, page) in enumerate(zip(piece.column(4).to_pylist(), piece.column(5).to_pylist(), strict=True)):
                lines, explicit = lines_of(page)
                raw = "\n".join(lines).encode("utf-8", "surrogatepass")
                mark = sha256(f"{key.split(chr(1), 1)[0]}\0{explicit}\0".encode() + raw).digest()[:16]
                rows.append((bisect_right(encoded, key.encode()), explicit, len(raw), pa.compress(raw, codec="zstd", asbytes=True), mark))
            own = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([piece.column(k) for k in (0, 1, 2, 3, 4)] + own, names=names)

    def ends(batches):
        """The first page of each of the first and of the last REACH + 1 groups of each bucket."""
        held, now = [], None  # held: (number, mark, place of the page)

        def done():
            rows = list({x[0]: x for x in held[: REACH + 1] + held[-REACH - 1 :]}.values())
            columns = [pa.array([now] * len(rows), type=pa.int32())] + [pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "number", "mark", "at"])

        for batch in batches:
            for bucket, _, at, size, mark in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now:
                    yield done()
                    held, now = [], bucket
                if size and (not held or held[-1][1] != mark):
                    held.append((held[-1][0] + 1 if held else 0, mark, at))
                    held[REACH + 1 : -REACH - 1] = []
        yield done()

    names = ["id", "url", "host", "path", "key", "bucket", "explicit", "size", "packed", "mark"]
    kinds = f"id {id_type}, url string, host string, path string, key string, bucket int, explicit boolean, size bigint, packed binary, mark binary"
    parsed = source.mapInArrow(parse, kinds)
    dealt = parsed.withColumn("place", F.lit(0))
    if cuts:
        # The first pass moves marks, not texts; the few pages at the ends are then looked up and parsed once more.
        marks = parsed.select("bucket", "key", F.xxhash64("key").alias("at"), "size", "mark").repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "key", "mark")
        outer = marks.mapInArrow(ends, "bucket int, number bigint, mark binary, at bigint").collect()
        where = {(r["bucket"], r["number"]): (r["at"], r["mark"]) for r in outer}
        guests = [(*where[bucket, number], home, place) for bucket, number, home, place in _guests([(r["bucket"], r["number"], bytes(r["mark"])) for r in outer])]
        given = F.broadcast(spark.createDataFrame(guests, "__at bigint, __mark binary, home int, place int"))
        ats = F.broadcast(spark.createDataFrame(sorted({(g[0],) for g in guests}), "__at bigint"))
        found = source.join(ats, F.xxhash64(source["key"]) == ats["__at"], "left_semi").mapInArrow(parse, kinds)
        found = found.join(given, (F.xxhash64("key") == F.col("__at")) & (F.col("mark") == F.col("__mark"))).dropDuplicates(["home", "place"])
        dealt = dealt.unionByName(found.select(*[F.col("home" if n == "bucket" else n).alias(n) for n in names], "place"))
    # Guests are only there to be compared with.
    dealt = dealt.repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "place", "key", "mark")

    def pair(batches):
        ids, urls, texts = [], [], []

        def emit(page, text):
            ids.append(page[0])
            urls.append(page[1])
            texts.append(text)

        def done():
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids) if ids else pa.array([], type=held), pa.array(urls, type=pa.string()), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=[id_col, url_col, "text", "n_chars"])
            for x in (ids, urls, texts):
                x.clear()
            return out

        pairing, now, held = Pairing(emit), None, None
        for batch in batches:
            held = batch.column(0).type
            column = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names) if n not in ("id", "key", "mark")}
            for i in range(batch.num_rows):
                if column["bucket"][i] != now:
                    pairing.finish()
                    now = column["bucket"][i]
                packed = pa.decompress(column["packed"][i], column["size"][i], codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if column["size"][i] else ""
                page = None if column["place"][i] else (batch.column(0).slice(i, 1), column["url"][i])
                pairing.add(column["host"][i], column["path"][i], packed.split("\n") if packed else [], column["explicit"][i], page)
            if ids:
                yield done()
        pairing.finish()
        if ids:
            yield done()

    return dealt.mapInArrow(pair, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars bigint")


def _guests(outer: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """(bucket, number, home, place) of the groups given to each home: the last REACH + 1 that begin before it (places
    below 0; it may go on with the last) and the next REACH that are not its own last (places above 0).

    outer: bucket, number and mark of the first and the last REACH + 1 groups of each bucket that has any."""
    groups: dict[int, list[tuple[int, int, str]]] = {}
    for group in sorted(outer):
        groups.setdefault(group[0], []).append(group)
    out, tail, head = [], [], []
    for home, own in groups.items():
        out += [(*g[:2], home, k - len(tail)) for k, g in enumerate(tail)]
        goes_on = bool(tail) and tail[-1][2] == own[0][2]
        tail = (tail + own[goes_on:])[-REACH - 1 :]
    for home, own in reversed(groups.items()):
        follow = head[1:] if head and head[0][2] == own[-1][2] else head
        out += [(*g[:2], home, 1 + k) for k, g in enumerate(follow[:REACH])]
        head = (own + follow)[: REACH + 1]
    return out
