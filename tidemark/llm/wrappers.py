"""Main text of web pages by inferred wrappers: union-free regular expressions over the token streams of a host.

A page is reduced to its element structure with text slots; runs of equal siblings, or of equal short sequences of
them, are repeated groups. The structures of a host are aligned one after the other: siblings that have no partner
become optional, one element that meets a run of it becomes a repeated group, and differing texts become slots.
A slot carries what alignment tells about it: how often it was filled, how many characters, how many of them in
links, and how many different texts. Wrappers are merged within the map tasks first, then in rounds of salted
groups, so that no task gets all pages of a host.

The finished wrapper is decided as a whole: which of its groups hold the article, and which slots in there are the
site's own (page furniture by element; outside of article elements also texts used over and over and lists of links). Every page is then matched to the
wrapper of its host, and the texts of the slots that were decided for are put out. Class names count only for
groups that hold less than half of the article's text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

_TAG = re.compile(r"""<!--|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTR = re.compile(r"""(?i)\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r" (?=class=|id=|role=|itemprop=|hidden$)")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements without text of the page: their content is passed over.
RAW = frozenset("script style noscript template iframe textarea title select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPE = frozenset("html body table td th caption ul ol dl div article section main button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu button label fieldset head search".split())
BOILER_ROLES = frozenset("banner complementary contentinfo search navigation".split())
#: A class or id counts as a name of page furniture if all words of it are in these two lists, one in the first.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner cookie cookies consent gdpr notice notices notification alert promo promoted sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments reply replies disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay toolbar pagination pager login signup".split()
)
NEUTRAL_WORDS = frozenset("area article articles bar block body bottom box button buttons container content form group inner item items left link links list main outer page panel post posts right section site slot story stories text thread top widget wrap wrapper n".split())
#: Levels of elements that a wrapper tells apart (deeper ones are read as their ancestor, furniture stays furniture at any
#: depth); children of a node beyond which the rarest are told apart by tag only; different texts that a slot remembers.
DEPTH, WIDE, KMV = 80, 64, 16
#: Outside of articles a slot is the site's own if its texts are used so many times as often as the main slot's.
REUSED = 4
LABEL, REPEATED, OPTIONAL, CHILDREN, STATS, TEXTS = range(6)


def _node(label: str, stats=None, texts=None) -> list:
    """label, repeated, optional, children; of a slot: [filled, characters, linked characters, smallest hashes]; numbers of texts."""
    return [label, 0, 0, [], stats, texts]


class Page:
    """texts: (text, in a link, begins a block); tree: elements and slots (#)."""

    def __init__(self, source: str | None, counted: bool):
        self.texts: list[tuple[str, bool, bool]] = []
        self.tree = _node("")
        source = source or ""
        stack: list[tuple[str, list]] = [("", self.tree)]
        links, fresh, at = 0, True, 0

        def text(part: str) -> None:
            nonlocal fresh
            if not part or part.isspace() and not self.texts:
                return
            children = stack[-1][1][CHILDREN]
            if not part.isspace():
                if not children or children[-1][LABEL] != "#":
                    children.append(_node("#", None, []))
                children[-1][TEXTS].append(len(self.texts))
                self.texts.append((entities.unescape(part), links > 0, fresh))
            else:  # space between two texts: of the slot that goes on, if one does
                if children and children[-1][LABEL] == "#":
                    children[-1][TEXTS].append(len(self.texts))
                self.texts.append((" ", links > 0, fresh))
            fresh = False

        while m := _TAG.search(source, at):
            text(source[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = source.find("-->", at)
                at = end + 3 if end >= 0 else len(source)
                continue
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attrs = bool(m[1] or m[4]), m[3] if m[2] else m[6]
            if tag not in INLINE:
                fresh = True
            if closing:
                if tag == "a":
                    links = max(0, links - 1)
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"(?i)</{re.escape(tag)}[\s/>]").search(source, at)
                if end or tag in ("script", "style"):
                    at = source.find(">", end.start()) + 1 or len(source) if end else len(source)
                continue
            if tag == "a":
                links += 1
            found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if "=" in attrs or "hidden" in attrs else {}
            if tag in INLINE and not (tag == "span" and found):
                continue
            gone = CLOSES.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else set())
            if gone:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in gone:
                        del stack[k:]
                        if stack[-1][0] not in gone:
                            break
                    elif stack[k][0] in SCOPE:
                        break
            if tag == "body":
                links = 0
            marks = [f"{k}={' '.join(sorted(re.sub(r'[0-9]+', 'N', v).split()))}" for k, v in sorted(found.items()) if k in ("class", "id", "role", "itemprop") and v]
            if "hidden" in found or found.get("aria-hidden") == "true":
                marks.append("hidden")
            node = _node(" ".join([tag, *marks]))
            if len(stack) > DEPTH and not (furniture(node[LABEL]) and stack[-1][1][LABEL] != node[LABEL]):
                stack.append((tag, stack[-1][1]))  # told apart no more; still open, so that its end tag closes it
                continue
            stack[-1][1][CHILDREN].append(node)
            stack.append((tag, node))
        text(source[at:])
        if counted:
            self._count(self.tree)

    def _count(self, top: list) -> None:
        todo = [top]
        while todo:
            node = todo.pop()
            todo += node[CHILDREN]
            if node[LABEL] == "#":
                own = [self.texts[k] for k in node[TEXTS]]
                whole = " ".join("".join(t for t, _, _ in own).split())
                node[STATS] = [1, sum(len(t) for t, _, _ in own), sum(len(t) for t, link, _ in own if link), [xxhash.xxh32_intdigest(whole.encode("utf-8", "surrogatepass"))]]

    def main_text(self, kinds: dict[int, int]) -> str:
        """The texts of the highest kind that the page has."""
        best = max(kinds.values(), default=0)
        if not best:
            return ""
        return " ".join("".join((" " if f else "") + t for k, (t, _, f) in enumerate(self.texts) if kinds.get(k, 0) == best).split())


def _merged(a, b):
    if a is None or b is None:
        return a or b
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], sorted({*a[3], *b[3]})[:KMV]]


def fold(node: list) -> list:
    """The tree with runs of equal siblings as one repeated node, and runs of equal sequences of two to four as a group."""
    children: list[list] = []
    for child in map(fold, node[CHILDREN]):
        if children and children[-1][LABEL] == child[LABEL]:
            children[-1] = align(children[-1], child)
            children[-1][REPEATED] = int(child[LABEL] != "#")
        else:
            children.append(child)
    for width in (2, 3, 4):
        if len(children) >= 2 * width:
            children = _grouped(children, width)
    return [node[LABEL], node[REPEATED], node[OPTIONAL], children, node[STATS], node[TEXTS]]


def _group(members: list[list]) -> list:
    return [f"({'|'.join(m[LABEL] for m in members)})", 0, 0, members, None, None]


def _grouped(children: list[list], width: int) -> list[list]:
    labels, out, i = [c[LABEL] for c in children], [], 0
    while i < len(children):
        n = 1
        while labels[i : i + width] == labels[i + n * width : i + (n + 1) * width] and len(labels) >= i + (n + 1) * width:
            n += 1
        if n == 1 or len(set(labels[i : i + width])) < width:
            out.append(children[i])
            i += 1
            continue
        whole = _group(children[i : i + width])
        for k in range(1, n):
            whole = align(whole, _group(children[i + k * width : i + (k + 1) * width]))
        whole[REPEATED] = 1
        out.append(whole)
        i += n * width
    return out


def _regrouped(children: list[list], other: list[list]) -> list[list]:
    """children with sequences that are a group of `other` as that group (once)."""
    have = {c[LABEL] for c in children}
    for g in other:
        if g[LABEL][:1] == "(" and g[LABEL] not in have:
            members = [m[LABEL] for m in g[CHILDREN]]
            for i in range(len(children) - len(members) + 1):
                if [c[LABEL] for c in children[i : i + len(members)]] == members:
                    children = [*children[:i], _group(children[i : i + len(members)]), *children[i + len(members) :]]
                    break
    return children


def align(a: list, b: list) -> list:
    """The wrapper of two nodes with the same label: matched children are aligned in turn, others are optional."""
    x, y = a[CHILDREN], b[CHILDREN]
    left, right = [c[LABEL] for c in x], [c[LABEL] for c in y]
    if left != right:
        x, y = _regrouped(x, y), _regrouped(y, x)
        left, right = [c[LABEL] for c in x], [c[LABEL] for c in y]
    if left == right:
        children = [align(c, d) for c, d in zip(x, y, strict=True)]
    else:
        children = []
        for op, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
            if op == "equal":
                met = [align(c, d) for c, d in zip(x[i:j], y[k:m], strict=True)]
            else:
                met = [[c[LABEL], c[REPEATED], 1, *c[CHILDREN:]] for c in (*x[i:j], *y[k:m])]
            for c in met:
                if children and children[-1][LABEL] == c[LABEL]:  # a run again
                    children[-1] = align(children[-1], c)
                    children[-1][REPEATED] = int(c[LABEL] != "#")
                else:
                    children.append(c)
        if len(children) > WIDE:
            children = _narrowed(children)
    return [a[LABEL], a[REPEATED] | b[REPEATED], a[OPTIONAL] | b[OPTIONAL], children, _merged(a[STATS], b[STATS]), None if a[TEXTS] is None and b[TEXTS] is None else [*(a[TEXTS] or []), *(b[TEXTS] or [])]]


def _filled(node: list) -> int:
    return max([node[STATS][0] if node[STATS] else 0, *map(_filled, node[CHILDREN])])


def _narrowed(children: list[list]) -> list[list]:
    """children with the rarest told apart by tag only ("div *"), wherever they stand; nothing is lost from their slots."""
    order = sorted(range(len(children)), key=lambda i: (-_filled(children[i]), i))
    keep, out, general = set(order[: WIDE // 2]), [], {}
    for i, c in enumerate(children):
        if i in keep and not c[LABEL].endswith(" *"):
            out.append(c)
            continue
        for member in c[CHILDREN] if c[LABEL][:1] == "(" else [c]:
            label = member[LABEL] if member[LABEL] == "#" else member[LABEL].split(" ")[0] + " *"
            named = [label, 1, 1, *member[CHILDREN:]]
            if label in general:
                general[label][:] = align(general[label], named)
            else:
                general[label] = named
                out.append(named)
    return out


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags: ( )? optional, ( )+ repeated, # a text slot."""
    inner = "".join(map(expression, node[CHILDREN]))
    label = node[LABEL]
    body = "#" if label == "#" else inner if not label or label[0] == "(" else f"<{label}>{inner}</{label.split(' ')[0]}>"
    return f"({body}){'*' if node[REPEATED] and node[OPTIONAL] else '+' if node[REPEATED] else '?'}" if node[REPEATED] or node[OPTIONAL] else body


def _values(label: str) -> tuple[str, list[str], list[str]]:
    """(tag, class, id, role and itemprop values, marks) of a label."""
    tag, *marks = _MARKS.split(label)
    return tag, [v for m in marks if "=" in m for v in m.split("=", 1)[1].split()], marks


def furniture(label: str) -> bool:
    """Page furniture by the element itself."""
    if " " not in label:
        return label in BOILER_TAGS
    tag, values, marks = _values(label)
    return tag in BOILER_TAGS or "hidden" in marks or any(m[5:] in BOILER_ROLES for m in marks if m.startswith("role="))


def named_furniture(label: str) -> bool:
    for value in _values(label)[1]:
        words = {w.lower() for w in _PIECES.findall(value)}
        if words & BOILER_WORDS and words <= BOILER_WORDS | NEUTRAL_WORDS:
            return True
    return False


def _is_article(label: str) -> bool:
    tag, _, marks = _values(label)
    return tag == "article" or "itemprop=articleBody" in marks


def _is_main(label: str) -> bool:
    tag, _, marks = _values(label)
    return tag == "main" or "role=main" in marks


def decide(tree: list) -> list:
    """The wrapper as [label, repeated, optional, children, kind]: kind 2 for the slots of articles, 1 for those of the densest
    part of the rest, 0 for others. An element's kind holds for what a page has there beyond the wrapper."""
    kinds: dict[int, int] = {}

    def open_(node: list) -> list[list]:
        """The children that are not furniture by themselves."""
        return [c for c in node[CHILDREN] if not furniture(c[LABEL])]

    def sums(node: list) -> tuple[int, int]:
        """(characters outside of links, characters) of the open part of a node."""
        own = (node[STATS][1] - node[STATS][2], node[STATS][1]) if node[STATS] else (0, 0)
        parts = [sums(c) for c in open_(node)]
        total[id(node)] = own[0] + sum(p[0] for p in parts), own[1] + sum(p[1] for p in parts)
        return total[id(node)]

    total: dict[int, tuple[int, int]] = {}
    sums(tree)

    def find(node: list, test) -> list[list]:
        if test(node[LABEL]):
            return [node] if total[id(node)][0] else []
        return [x for c in open_(node) for x in find(c, test)]

    def slots(node: list, test) -> Iterator[list]:
        for c in node[CHILDREN]:
            if c[LABEL] == "#":
                yield c
            elif not test(c):
                yield from slots(c, test)

    def times(slot: list) -> float:
        """How often a text of the slot is used, on the average."""
        n, seen = slot[STATS][0], slot[STATS][3]
        return n / (len(seen) if len(seen) < KMV else max(KMV, (KMV - 1) * (1 << 32) / (seen[-1] + 1)))

    def take(top: list, kind: int) -> None:
        nested = kind == 2 and _is_article(top[LABEL]) and any(c[LABEL].split(" ")[0] == "p" for c in top[CHILDREN])
        shut = lambda c: furniture(c[LABEL]) or nested and _values(c[LABEL])[0] == "article" or kinds.get(id(c)) == 2
        main = max(slots(top, shut), key=lambda s: s[STATS][1] - s[STATS][2], default=None)
        if main is None:
            return
        usual, whole = times(main), max(1, total[id(top)][0])

        def go(node: list) -> None:
            kinds[id(node)] = kind
            for c in node[CHILDREN]:
                if c[LABEL] == "#":
                    heading = node[LABEL].split(" ")[0] in HEADINGS
                    own = kind == 1 and c is not main and not heading and times(c) >= REUSED * usual
                    kinds[id(c)] = 0 if own else kind
                    continue
                if shut(c):
                    continue
                free, every = total[id(c)]
                if kind == 1 and every and 5 * free < every and (c[REPEATED] or any(x[REPEATED] for x in c[CHILDREN])):
                    continue  # a list of links; in an article they are its references
                if 2 * free < whole and named_furniture(c[LABEL]):
                    continue
                go(c)

        go(top)

    articles = find(tree, _is_article)
    for top in articles:
        take(top, 2)
    for top in [] if articles else find(tree, _is_main):
        take(_densest(top, total, kinds, open_), 2)
    sums_without = {id(n): total[id(n)] for n in articles}
    for n in articles:  # the densest part of what is left
        total[id(n)] = (0, 0)
    if articles:
        _resum(tree, total, open_, set(sums_without))
    rest = _densest(tree, total, kinds, open_)
    if total[id(rest)][0]:
        take(rest, 1)

    def out(node: list) -> list:
        return [node[LABEL], node[REPEATED], node[OPTIONAL], [out(c) for c in node[CHILDREN]], kinds.get(id(node), 0)]

    return out(tree)


def _resum(node: list, total: dict, open_, fixed: set[int]) -> tuple[int, int]:
    if id(node) not in fixed:
        own = (node[STATS][1] - node[STATS][2], node[STATS][1]) if node[STATS] else (0, 0)
        parts = [_resum(c, total, open_, fixed) for c in open_(node)]
        total[id(node)] = own[0] + sum(p[0] for p in parts), own[1] + sum(p[1] for p in parts)
    return total[id(node)]


def _densest(node: list, total: dict, kinds: dict, open_) -> list:
    """The deepest element that holds three fifths of its parent's text outside of links, all the way down."""
    while True:
        best = max(open_(node), key=lambda c: total[id(c)][0], default=None)
        if best is None or best[LABEL] == "#" or best[REPEATED] or 5 * total[id(best)][0] < 3 * total[id(node)][0] or not any(c[LABEL] != "#" for c in best[CHILDREN]):
            return node
        node = best


def match(page: list, wrapper: list, kinds: dict[int, int]) -> None:
    """Puts the kind of every text of the page (a folded tree) into kinds, by the slots of its host's wrapper."""
    x, y = page[CHILDREN], wrapper[3]
    left, right = [c[LABEL] for c in x], [c[0] for c in y]
    if left == right:
        pairs = zip(x, y, strict=True)
    else:
        x = _regrouped(x, y)
        left = [c[LABEL] for c in x]
        partner: dict[int, list] = {}
        for i, k, n in SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks():
            partner |= {i + d: y[k + d] for d in range(n)}
        by_label = {c[0]: c for c in reversed(y)}
        pairs = [(c, partner.get(i) or by_label.get(c[LABEL]) or by_label.get(c[LABEL].split(" ")[0] + " *")) for i, c in enumerate(x)]
    for c, w in pairs:
        if c[LABEL] == "#":
            kinds |= dict.fromkeys(c[TEXTS], w[4] if w else wrapper[4])
        elif w:
            match(c, w, kinds)
        elif not furniture(c[LABEL]):
            match(c, [c[LABEL], 0, 0, [], wrapper[4]], kinds)


def _host():
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(F.col("url"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def wrappers(pages: DataFrame, salts: tuple[int, ...] = (256, 16, 1)) -> DataFrame:
    """(host, wrapper: JSON of decide(), expression: the same to read) from pages (url, html)."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees: dict[str, list] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = fold(Page(source.as_py(), True).tree)
                trees[host] = align(trees[host], tree) if host in trees else tree
            if trees:
                yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array([json.dumps(_plain(t)) for t in trees.values()], pa.string())], names=["host", "tree"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for tree in batch.column("tree").to_pylist():
                tree = json.loads(tree)
                whole = tree if whole is None else align(whole, tree)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([json.dumps(_plain(whole))], pa.string())], names=["host", "tree"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [json.loads(t) for t in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([json.dumps(decide(t)) for t in trees], pa.string()), pa.array([expression(t) for t in trees], pa.string())], names=["host", "wrapper", "expression"])

    trees = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(learn, "host string, tree string")
    for salt in salts:
        trees = trees.withColumn("salt", F.pmod(F.xxhash64("tree"), F.lit(salt))).groupBy("host", "salt").applyInArrow(merge, "host string, tree string")
    return materialize(trees.mapInArrow(finish, "host string, wrapper string, expression string"), "wrappers")


def _plain(node: list) -> list:
    return [node[LABEL], node[REPEATED], node[OPTIONAL], [_plain(c) for c in node[CHILDREN]], node[STATS], None]


#: Pages aimed at, at most, between two copies of a wrapper.
STRETCH = 20_000


def extract(pages: DataFrame, learned: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html), by learned (host, wrapper).

    A null html is empty and gives an empty text. A null url belongs to the host ''. Repeated rows stay, pages that match the
    wrapper equally well in two ways take the first. Whole pages are read, however long. A page of a host without a wrapper gives
    an empty text. An empty table gives an empty result. Other columns are not read and may have any name.

    Pages and wrappers are dealt by host and salt and sorted, a wrapper before its pages: it is never copied into their rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    salts = max(64, pages.count() // STRETCH)
    salt = F.pmod(F.xxhash64(F.col(id_col), F.col("url")), F.lit(salts)).cast("int")
    rows = pages.select(_host().alias("host"), salt.alias("salt"), F.lit(1).alias("turn"), F.col(id_col).alias("page_id"), F.col("url"), F.col("html").cast("string").alias("html"))
    asked = rows.select("host", "salt").distinct()
    ahead = asked.join(learned.select("host", "wrapper"), "host").select("host", "salt", F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("wrapper").alias("html"))
    dealt = ahead.unionByName(rows).repartition("host", "salt").sortWithinPartitions("host", "salt", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper = None, None
        for batch in batches:
            texts, places = [], []
            for i, (host, turn, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(5), strict=True)):
                if turn == 0:
                    if host != now:
                        now, wrapper = host, json.loads(source.as_py())
                    continue
                kinds: dict[int, int] = {}
                page = Page(source.as_py(), False)
                if host == now and wrapper:
                    match(fold(page.tree), wrapper, kinds)
                places.append(i)
                texts.append(page.main_text(kinds))
            own = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(3), own.column(4), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return dealt.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long").withColumnRenamed("text", text_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, wrappers(pages))
