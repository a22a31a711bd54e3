"""Main text of pages by union-free regular-expression inference.

Pages of one host come from one template. A page becomes a stream of structural tokens (block tags with their class, and
text slots). Tandem repeats found in any page of the host fold into repeated groups in all of them, inner ones first. The
streams of a host are then aligned and merged two by two: what only one side has becomes an optional part. The result, a
regular expression without unions, gives every text its slot.

The slots say what is template and what is content. A text that fills its slot on nearly all different pages of the host is
template, wherever it lies and whatever its tag. Slots whose texts vary are content. Menus, footers, sidebars and forms vary
from page to page too, so their tags decide for them; class and id words decide outside the article only, and inside
it where a class word starts with the name of an advert, comments or the like. A heading is never judged by its words, a section's id
only as a whole.
Where a page has article or main elements these are the article, all of them; else every content slot is kept.

Alignment takes tokens that occur once on both sides as anchors and fills the gaps in one pass, so its time grows with the
length of the streams; merging in pairs reads every stream some log2(pages) times.

A host is one group up to ``GROUP`` pages and ``GROUP_BYTES`` of html; a larger one is dealt to several groups by page, each with
a wrapper of its own, so no task holds a large host; the number of tasks follows the bytes of all pages.

Defined cases: null html counts as empty and gives the empty text; a null url is the host ''; hosts of fewer than
``LEAST_PAGES`` different pages have no template texts (``LEAST_ITEMS`` in repeated groups), tags and words alone decide there; repeated rows give equal results and count as
one page; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import difflib
import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strokelake.llm.common import written
from strokelake.operators.keyed import measured

GROUP = 1000
GROUP_BYTES = 16 << 20
TASK_BYTES = 32 << 20
LEAST_PAGES = 4  # different pages that share the text of a slot before it can be template
LEAST_ITEMS = 25  # the same in a repeated group, whose items are the paragraphs of an article as well
NEARLY_ALL = 0.9  # share of the different pages of a group
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = set("a abbr b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg iframe object canvas head title select textarea option".split())
RAW = set("script style textarea title".split())
OUTSIDE = set("nav footer aside form menu dialog button fieldset".split())
CLOSED_BY = {"p": set("p div ul ol li table h1 h2 h3 h4 h5 h6 section article aside nav header footer form blockquote pre hr main".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|sidebar\w*|side|footer\w*|cookie\w*|consent|notice\w*|alert\w*|comment\w*|replies|disqus|respond|related|share\w*|social|breadcrumb\w*|subscribe|newsletter|popup|modal|widget\w*|toolbar|pagination|pager|masthead|contentinfo|complementary|search|login|signup)(?:$|[\s_-])",
    re.I,
)
MAIN = set("article main".split())
WORD_NOISE = re.compile(  # a whole class word, or one that starts with it: comments, comment-list
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|navbar|navigation|menu|sidebar|cookie\w*|notice|comments?|replies|disqus|share|social|breadcrumbs?|subscribe|newsletter|popup|modal|widget|toolbar|pagination|pager|login|signup)(?:[-_].*)?",
    re.I,
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ID_NOISE = re.compile(r"comments|respond|disqus_thread", re.I)
SPACE = re.compile(r"\s+")


def named_outside(tag: str, marks: list[tuple[str, str]], inside: bool) -> bool:
    """Whether class, id and role words put an element outside the article.

    Headings, articles and the page itself never; in the article only a class word that starts with the name, and there and
    for sections only a whole id.
    """
    if tag in HEADINGS or tag in MAIN or tag in ("html", "body"):
        return False
    for key, value in marks:
        if key == "id" and (inside or tag == "section"):
            noise = any(ID_NOISE.fullmatch(x) for x in value.split())
        elif inside:
            noise = any(WORD_NOISE.fullmatch(x) for x in value.split())
        else:
            noise = bool(NOISE.search(value))
        if noise:
            return True
    return False


def page_blocks(source: str) -> tuple[list[str], list[tuple[int, str, str, bool]]]:
    """Structural tokens, and the text blocks: (token place, text, container path, boilerplate by its place)."""
    tokens: list[str] = []
    blocks: list[tuple[int, str, str, bool]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, name, boilerplate
    held: list[str] = []
    raw_until, hidden = "", 0

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            tokens.append("#")
            path = "/".join(name for _, name, _ in stack if name)
            blocks.append((len(tokens) - 1, text, path, any(out for *_, out in stack)))

    def close(upto: int) -> None:
        nonlocal hidden
        flush()
        while len(stack) > upto:
            tag, name, _ = stack.pop()
            hidden -= tag in HIDDEN
            tokens.append("/" + name)

    for match in TOKEN.finditer(source):
        slash, tag, rest, text = match.groups()
        if raw_until:
            if not (tag and slash and tag.lower() == raw_until):
                continue
            raw_until = ""
        if text is not None:
            if not hidden:
                held.append(text)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br" or tag == "img":
                held.append(" ")
            continue
        if slash:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is None:
                flush()
            else:
                close(at)
            continue
        closes = CLOSED_BY
        while stack and tag in closes.get(stack[-1][0], ()):
            close(len(stack) - 1)
        flush()
        if tag in VOID or rest.rstrip().endswith("/"):
            continue
        found = [(key.lower(), a or b or c) for key, a, b, c in ATTRIBUTE.findall(rest)]
        marks = " ".join(value for _, value in found)
        inside = any(t in MAIN for t, *_ in stack)
        out = tag in OUTSIDE or (tag == "header" and not inside) or named_outside(tag, found, inside)
        name = tag + ("." + "-".join(sorted(marks.replace("/", "_").split())) if marks else "")
        stack.append((tag, name, out))
        tokens.append(name)
        if tag in HIDDEN:
            hidden += 1
            if tag in RAW:
                raw_until = tag
    close(0)
    return tokens, blocks


# ---- wrappers: lists of nodes; a node is a token, or [mark, nodes] with mark + (repeated) or ? (optional) ----


def plain(node) -> str:
    """What a node matches once, whatever its marks."""
    return " ".join(map(plain, node[1])) if isinstance(node, list) else node


def balanced(body: tuple[str, ...]) -> bool:
    """Whether a run of nodes closes what it opens, so that it can be one occurrence of a group."""
    depth = 0
    for key in body:
        if key.startswith("/"):
            depth -= 1
            if depth < 0:
                return False
        elif key != "#" and " " not in key:
            depth += 1
    return depth == 0


def tandem(keys: list[str], longest: int = 12) -> set[tuple[str, ...]]:
    """Balanced runs that occur twice in succession."""
    found: set[tuple[str, ...]] = set()
    i, n = 0, len(keys)
    while i < n:
        step = 1
        for size in range(1, min(longest, (n - i) // 2) + 1):
            if keys[i] == keys[i + size] and keys[i : i + size] == keys[i + size : i + 2 * size]:
                body = tuple(keys[i : i + size])
                if body in found or balanced(body):
                    found.add(body)
                    step = size
                    break
        i += step
    return found


def folded(nodes: list, known: set[tuple[str, ...]]) -> tuple[list, list[int]]:
    """Runs of known groups, also of one occurrence, become repeated groups (long ones first); and the new node of every old one."""
    keys = [plain(x) for x in nodes]
    sizes: dict[str, list[int]] = defaultdict(list)
    for first, size in sorted({(body[0], len(body)) for body in known}, reverse=True):
        sizes[first].append(size)
    out: list = []
    owner: list[int] = []
    i = 0
    while i < len(nodes):
        end = i
        for size in sizes.get(keys[i], ()):
            body = tuple(keys[i : i + size])
            if body in known:
                while tuple(keys[end : end + size]) == body:
                    end += size
                break
        if end > i:
            owner += [len(out)] * (end - i)
            out.append(["+", nodes[i : i + size]])
            i = end
        else:
            owner.append(len(out))
            out.append(nodes[i])
            i += 1
    return out, owner


def fold_all(streams: list[list], levels: int = 3) -> list[tuple[list, list[int]]]:
    """Every stream folded by the groups of all of them, inner groups first; and the node of every token."""
    now = [(list(tokens), list(range(len(tokens)))) for tokens in streams]
    for _ in range(levels):
        known: set[tuple[str, ...]] = set()
        for nodes, _ in now:
            known |= tandem([plain(x) for x in nodes])
        if not known:
            break
        after = []
        for nodes, place in now:
            out, owner = folded(nodes, known)
            after.append((out, [owner[x] for x in place]))
        now = after
    return now


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, ordered by the first number, whose second numbers increase."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(ends, b)
        if k:
            back[i] = at[k - 1]
        if k == len(ends):
            ends.append(b)
            at.append(i)
        else:
            ends[k], at[k] = b, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def gap(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int, small: int = 4096) -> list[tuple[int, int]]:
    """Pairs of equal keys between two anchors, in one pass unless the gap is small."""
    if a0 == a1 or b0 == b1:
        return []
    if (a1 - a0) * (b1 - b0) <= small:
        blocks = difflib.SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks()
        return [(a0 + m.a + i, b0 + m.b + i) for m in blocks for i in range(m.size)]
    where: dict[str, list[int]] = defaultdict(list)
    for i in range(a0, a1):
        where[a[i]].append(i)
    out: list[tuple[int, int]] = []
    reach, i = 32, a0  # a step may skip as much of ``a`` as was skipped of ``b``, and a little
    for j in range(b0, b1):
        places = where.get(b[j], [])
        k = bisect_left(places, i)
        if k < len(places) and places[k] - i <= reach:
            out.append((places[k], j))
            i, reach = places[k] + 1, 32
        else:
            reach += 2
    return out


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Increasing pairs of equal keys: equal ends, anchors that are unique on both sides, and what fits between them."""
    lo, a1, b1 = 0, len(a), len(b)
    while lo < a1 and lo < b1 and a[lo] == b[lo]:
        lo += 1
    while a1 > lo and b1 > lo and a[a1 - 1] == b[b1 - 1]:
        a1 -= 1
        b1 -= 1
    in_a, in_b = Counter(a[lo:a1]), Counter(b[lo:b1])
    there = {key: j for j, key in enumerate(b[lo:b1], lo) if in_b[key] == 1}
    anchors = increasing([(i, there[key]) for i, key in enumerate(a[lo:a1], lo) if in_a[key] == 1 and key in there])
    out = [(i, i) for i in range(lo)]
    i, j = lo, lo
    for x, y in [*anchors, (a1, b1)]:
        out += gap(a, b, i, x, j, y)
        if x < a1:
            out.append((x, y))
        i, j = x + 1, y + 1
    return out + [(a1 + k, b1 + k) for k in range(len(a) - a1)]


def optional(node):
    return node if isinstance(node, list) and node[0] == "?" else ["?", [node]]


def repeated(node) -> bool:
    return isinstance(node, list) and (node[0] == "+" or any(repeated(x) for x in node[1]))


def merge(one: list, two: list) -> tuple[list, list[int], list[int]]:
    """The wrapper that accepts what either accepts, and where the nodes of both are in it."""
    out: list = []
    at_one, at_two = [0] * len(one), [0] * len(two)
    i = j = 0
    for x, y in [*matches([plain(n) for n in one], [plain(n) for n in two]), (len(one), len(two))]:
        for k in range(i, x):
            at_one[k] = len(out)
            out.append(optional(one[k]))
        for k in range(j, y):
            at_two[k] = len(out)
            out.append(optional(two[k]))
        if x < len(one):
            at_one[x] = at_two[y] = len(out)
            marked = [n for n in (one[x], two[y]) if repeated(n)] or [one[x]]
            either = any(isinstance(n, list) and n[0] == "?" for n in (one[x], two[y]))
            out.append(optional(marked[0]) if either else marked[0])
        i, j = x + 1, y + 1
    return out, at_one, at_two


def aligned(streams: list[tuple[list[str], int]]) -> tuple[list, list[list[int]]]:
    """Wrapper of all streams (tokens, number of pages), merged two by two in order of frequency, and the node of every token."""
    order = sorted(range(len(streams)), key=lambda i: (-streams[i][1], streams[i][0]))
    nodes = fold_all([list(streams[i][0]) for i in order])
    places: list[list[int]] = [[] for _ in streams]
    for i, (_, place) in zip(order, nodes):
        places[i] = place
    level = [(made, [i]) for i, (made, _) in zip(order, nodes)]
    while len(level) > 1:
        after = []
        for k in range(0, len(level) - 1, 2):
            (one, left), (two, right) = level[k], level[k + 1]
            made, *moves = merge(one, two)
            for members, move in zip((left, right), moves):
                for i in members:
                    places[i] = [move[x] for x in places[i]]
            after.append((made, left + right))
        level = after + level[2 * len(after) :]
    return (level[0][0] if level else []), places


def infer(streams: list[tuple[list[str], int]]) -> list:
    """Wrapper of the streams."""
    return aligned(streams)[0]


def slots(wrapper: list, tokens: list[str]) -> list[int]:
    """Wrapper node of every token of a page that took no part in the inference; -1 where the wrapper has none."""
    nodes: list = list(tokens)
    place = list(range(len(nodes)))
    known = groups_of(wrapper)
    for _ in range(3):
        nodes, owner = folded(nodes, known)
        place = [owner[x] for x in place]
    found = {j: i for i, j in matches([plain(n) for n in wrapper], [plain(n) for n in nodes])}
    return [found.get(x, -1) for x in place]


def groups_of(nodes: list) -> set[tuple[str, ...]]:
    """Bodies of the repeated groups at any depth."""
    out: set[tuple[str, ...]] = set()
    for node in nodes:
        if isinstance(node, list):
            if node[0] == "+":
                out.add(tuple(plain(x) for x in node[1]))
            out |= groups_of(node[1])
    return out


# ---- content and template ----


def in_article(path: str) -> bool:
    return any(x.split(".")[0] in MAIN for x in path.split("/"))


def template_texts(pages: list[list[tuple[int, str]]], wrapper: list) -> set[tuple[int, str]]:
    """(slot, text) that nearly all different pages of a group share; a repeated group needs more pages to say so.

    Pages are as different as their longest text that is not itself on nearly all pages, so copies of a page count once.
    """
    if len(pages) < LEAST_PAGES:
        return set()
    on = Counter(key for page in pages for key in set(page))
    common = {key for key, n in on.items() if n >= NEARLY_ALL * len(pages)}
    if not common:
        return set()
    kinds: set[str] = set()
    sharing: dict[tuple[int, str], set[str]] = defaultdict(set)
    for page in pages:
        kind = max((text for slot, text in page if (slot, text) not in common), key=lambda t: (len(t), t), default="")
        if not kind:
            continue
        kinds.add(kind)
        for key in common.intersection(page):
            sharing[key].add(kind)
    return {
        (slot, text)
        for (slot, text), found in sharing.items()
        if len(found) >= max(LEAST_ITEMS if repeated(wrapper[slot]) else LEAST_PAGES, NEARLY_ALL * len(kinds))
    }


def host_of(url):
    """Authority of a URL as a column; '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def extract_group(pages: list[str]) -> list[str]:
    """Texts of the pages (html) of one group: one wrapper for all of them, slots judged by it, then the text of each."""
    sources: dict[str, int] = {}
    parsed = []
    for source in pages:
        if source not in sources:
            sources[source] = len(parsed)
            parsed.append(page_blocks(source))
    counts = Counter(tuple(tokens) for tokens, _ in parsed)
    wrapper, places = aligned([(list(t), n) for t, n in counts.items()])
    placed = dict(zip(counts, places))
    inner = [[(place[at], text, path, out) for at, text, path, out in blocks] for tokens, blocks in parsed for place in [placed[tuple(tokens)]]]
    fixed = template_texts([kept for blocks in inner if (kept := [(slot, text) for slot, text, _, out in blocks if not out])], wrapper)
    texts = []
    for blocks in inner:
        article = any(in_article(path) and not out for _, _, path, out in blocks)
        texts.append(
            "\n\n".join(
                text
                for slot, text, path, out in blocks
                if not out and (slot, text) not in fixed and (in_article(path) or not article)
            )
        )
    return [texts[sources[source]] for source in pages]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; the pages are shuffled once, by host and group."""
    source = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host")
    )
    sizes = written(source.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("n_bytes")), "hosts")
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(4 * pages.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES + 1)
    large = sizes.select("host", F.ceil(F.greatest(F.col("n") / GROUP, F.col("n_bytes") / GROUP_BYTES)).alias("groups")).filter("groups > 1")
    part = F.pmod(F.xxhash64("url", "page_id", F.xxhash64("html")), F.coalesce("groups", F.lit(1))).cast("int")
    dealt = source.join(measured(large), "host", "left").withColumn("part", part).drop("groups").repartition(tasks, "host", "part")

    def run(group: pa.Table) -> pa.Table:
        texts = extract_group(group.column("html").to_pylist())
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.table([group.column("page_id"), group.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return dealt.groupBy("host", "part").applyInArrow(run, "page_id long, url string, text string, n_chars long")
