"""Main text of web pages by wrapper induction.

Each host has a reference page.  Every page of the host is aligned with the reference's
DOM tree by simple tree matching; text that stays the same at an aligned node on nearly
all pages is template, and what varies is content.  A slot outside articles that takes turns
between few texts (menus, adverts, notices) is template as well.  A tag (nav, footer, form)
or a role, class or id that speaks of adverts, comments and the like only marks an element: it
breaks the tie for what varies on every page, as reader comments do, and it decides on hosts
of too few pages for a wrapper.  A marked element stays where it holds most of the varying text
on most pages of the host that have it.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, map_texts, settle, stage, unstage
from .urls import host_of

#: Template text is the same on this share of a host's distinct pages, of which there are so many at least.
CONSTANT_SHARE, MANY_PAGES = 0.8, 8
#: With fewer pages, down to this number, it is the same on all of them.  That may be chance, so it never cuts an article, a
#: main part or most of a page, and marked elements and text outside an article are judged on each page.
LEAST_PAGES, FEW = 3, "few"
#: A marked element stays if on more than this share of the pages that have it, it holds more than this share of the varying text.
MOST = 0.5
#: A slot takes turns if its texts are at most this share of the places that it has on pages, each text counted once a page;
#: the second share holds where most pages have an article or main part, so that little is content outside of it.
TURNS, TURNS_BESIDE = 0.5, 0.9
#: Pairs of nodes from which runs of siblings are matched in arrays, and cells of the table that are kept at once; the match is the same.
PAIRS, ROWS_CELLS = 4096, 1 << 20
#: What the same text weighs in a match of pages: more texts that stay count before more nodes, however long the page.
TOLD = 1 << 16
#: Most bytes of references that are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>|<[A-Za-z/!?][^>]*+\Z""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
_HIDDEN = frozenset("script style noscript iframe svg button select textarea head title object canvas template datalist".split())
_TAGS = frozenset("nav footer aside form dialog menu".split())
#: A class, id or role of reader comments; one that only says whether there are any is none.
_COMMENTS = re.compile(r"(?:comments?|disqus|replies)(?:[-_](?!open|closed|on\b|off\b|enabled|disabled).*)?")
_OUT_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
alert sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments disqus replies related recommended share sharing social newsletter
subscribe popup modal widget pagination pager toolbar masthead login signup search contentinfo complementary""".split())
_KEEP_BY_CLASS = frozenset("html body main".split())
_SELF_CLOSING_P = _BLOCK - {"html", "body"}
_SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


#: Kinds of marks; whether words mark elements (tests see what is left without them).
TAG, WORD, COMMENTS, USE_WORDS = "tag", "word", "comments", True


@lru_cache(20_000)
def _look(tag: str, attrs: str) -> tuple[str, int, str]:
    """(label, whether the element is marked: 1, or 2 only outside an article; the kind of its mark: by tag, by word, or of comments)."""
    words, label, comments = set(), tag, False
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "class" and value:
            label = f"{tag}.{value.split()[0] if value.split() else ''}"
        words.update(w for w in re.split(r"[^a-z]+", value.lower()) if w)
        comments |= any(_COMMENTS.fullmatch(x) for x in value.lower().split())
    if tag in _TAGS or tag == "header":
        return label, 1 if tag in _TAGS else 2, TAG
    marked = 0 if tag in _KEEP_BY_CLASS or not USE_WORDS else 1 if words & _OUT_WORDS else 2 if "header" in words else 0
    return label, marked, COMMENTS if comments else WORD


class Page:
    """The DOM tree without what is never shown: per node label, children and own text; blocks in page order."""

    __slots__ = ("labels", "kids", "texts", "blocks", "paths", "marks")

    def __init__(self, source: str):
        self.labels, self.kids, self.texts, self.paths = ["#"], [[]], [""], [0]  # paths are hashed, so that deep nests stay small
        self.blocks: list[tuple[int, str, bool, int]] = []  # node, text, inside article or main, innermost mark
        self.marks: list[tuple[int, str, str]] = [(0, "", "")]  # of a marked element the mark around it, its place and kind; 0 is no mark
        # tag, node, hidden, in article, mark, place of the nearest block on the stack
        stack: list[tuple[str, int, bool, bool, int, int]] = [("#", 0, False, False, 0, 0)]
        open_: Counter[str] = Counter()  # of tags: without one on the stack nobody looks for it
        pending: list[str] = []
        at, n = 0, len(source)

        def flush() -> None:
            if pending:
                text = _SPACE.sub(" ", html.unescape("".join(pending))).strip()
                pending.clear()
                if text:
                    _, _, _, main, mark, block = stack[-1]
                    node = stack[block][1]
                    self.blocks.append((node, text, main, mark))
                    self.texts[node] = f"{self.texts[node]}\n{text}" if self.texts[node] else text

        def close(tags: tuple[str, ...]) -> None:
            if any(open_[t] for t in tags):
                self._close(stack, open_, tags)

        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                if not stack[-1][2]:
                    pending.append(source[at:])
                break
            if m.start() > at and not stack[-1][2]:
                pending.append(source[at:m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:  # an end tag
                if tag in _BLOCK:
                    flush()
                if open_[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    if any(x[0] in _BLOCK for x in stack[k:]):
                        flush()
                    open_.subtract(x[0] for x in stack[k:])
                    del stack[k:]
                continue
            if tag in _BLOCK:
                flush()
                if tag in _SELF_CLOSING_P:
                    close(("p",))
            if tag in _SIBLINGS:
                close(_SIBLINGS[tag])
            _, parent, hidden, main, mark, block = stack[-1]
            label, marked, kind = _look(tag, m[3] or m[6] or "")
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag in _VOID:
                if tag in ("br", "hr", "wbr", "img") and not hidden and tag != "wbr":
                    pending.append(" ")
                continue
            hidden = hidden or tag in _HIDDEN
            marked = not hidden and tag != "article" and (marked == 1 or marked == 2 and not main)
            main = not hidden and (main or tag in ("article", "main"))
            node = parent
            if tag in _BLOCK:
                block = len(stack)
                if not hidden:
                    node = len(self.labels)
                    self.labels.append(label)
                    self.kids.append([])
                    self.texts.append("")
                    self.paths.append(xxhash.xxh3_64_intdigest(f"{self.paths[parent]:x}/{label}"))
                    self.kids[parent].append(node)
            if marked:
                self.marks.append((mark, f"{xxhash.xxh3_64_intdigest(f'{self.paths[parent]:x}/{label}'):x}", kind))
                mark = len(self.marks) - 1
            stack.append((tag, node, hidden, main, mark, block))
            open_[tag] += 1
        flush()

    def holders(self, blocks: list[tuple[int, str, bool, int]]) -> set[int]:
        """The marks that hold more than MOST of the text of ``blocks``."""
        held = [0] * len(self.marks)
        for _, text, _, mark in blocks:
            held[0] += len(text)
            while mark:
                held[mark] += len(text)
                mark = self.marks[mark][0]
        return {k for k in range(1, len(held)) if held[k] > MOST * held[0]}

    def content(self, template: frozenset[str] | None) -> list[str]:
        """The texts that count, in page order; without a wrapper of many pages the page is judged alone, and text outside an article or main gives way to that inside."""
        blocks, alone = self.blocks, not template or FEW in template
        if template:
            constant = [b for b in blocks if not (alone and b[2]) and (self.key(b[0], b[1]) in template or not alone and not b[2] and self.slot(b[0]) in template)]
            if not alone or sum(len(b[1]) for b in constant) <= MOST * sum(len(b[1]) for b in blocks):
                gone = {id(b) for b in constant}
                blocks = [b for b in blocks if id(b) not in gone]
        if alone:  # a tag decides; comments stay only where they are all there is
            plain = any(b[2] and not b[3] for b in blocks) or all(self.marks[k][2] != COMMENTS for k in range(len(self.marks)))
            stays = {k for k in self.holders([b for b in blocks if not self._under(b[3], TAG)]) if self.marks[k][2] == WORD or self.marks[k][2] == COMMENTS and not plain}
        else:
            stays = {k for k, (_, place, _) in enumerate(self.marks) if f"~{place}" in template}
        out = [False]
        for k, (around, _, _) in enumerate(self.marks[1:], 1):
            out.append(out[around] or k not in stays)
        blocks = [b for b in blocks if not out[b[3]]]
        if alone and any(b[2] for b in blocks):
            blocks = [b for b in blocks if b[2]]
        return [b[1] for b in blocks]

    def _under(self, mark: int, kind: str) -> bool:
        while mark:
            if self.marks[mark][2] == kind:
                return True
            mark = self.marks[mark][0]
        return False

    def slot(self, node: int) -> str:
        """The name of a node's place on the pages of a host, whichever of its like it is."""
        return f"/{self.paths[node]:x}"

    @staticmethod
    def _close(stack: list, open_: Counter[str], tags: tuple[str, ...]) -> None:
        """End an open element of ``tags`` that no other container stands above."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                open_.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in ("div", "section", "article", "main", "table", "ul", "ol", "dl", "body", "blockquote", "form", "nav", "aside"):
                return

    def key(self, node: int, text: str) -> str:
        return f"{xxhash.xxh3_64_intdigest(f'{self.paths[node]:x} {text}'):x}"

    def folded(self, node: int = 0, depth: int = 0) -> list:
        """[label, key of text, children], with deep nests cut short."""
        kids = [self.folded(k, depth + 1) for k in self.kids[node]] if depth < 64 else []
        return [self.labels[node], self.key(node, self.texts[node]) if self.texts[node] else "", kids]


def sealed(tree: list) -> tuple:
    """(label, key of text, children, number of nodes, hash of all that, number of nodes with text) of a folded tree."""
    kids = [sealed(k) for k in tree[2]]
    return tree[0], tree[1], kids, 1 + sum(k[3] for k in kids), hash((tree[0], tree[1], *[k[4] for k in kids])), (tree[1] != "") + sum(k[5] for k in kids)


def match_trees(a: tuple, b: tuple, told: int = 1) -> tuple[int, list]:
    """Simple tree matching of sealed trees: the weight of the best order-keeping match, and a nested list of the keys of its equal texts.

    A pair of nodes weighs 1, and ``told`` more if both have the same text.
    """
    if a[0] != b[0]:
        return 0, []
    if a[4] == b[4]:
        return _whole(a, told), [a]
    same = a[1] == b[1] != ""
    weight, inner = _match_runs(a[2], b[2], told) if a[2] and b[2] else (0, [])
    return weight + 1 + same * told, [a[1], inner] if same else inner


def _whole(x: tuple, told: int) -> int:
    """The weight of a tree with its equal."""
    return 2 * x[3] + (told - 1) * x[5]


def _match_runs(a: list[tuple], b: list[tuple], told: int) -> tuple[int, list]:
    weight, found = 0, []
    lead, n = 0, min(len(a), len(b))
    while lead < n and a[lead][4] == b[lead][4]:
        lead += 1
    tail = 0
    while tail < n - lead and a[-1 - tail][4] == b[-1 - tail][4]:
        tail += 1
    if lead or tail:
        kept = a[:lead] + a[len(a) - tail:]
        weight, found = sum(_whole(x, told) for x in kept), kept
        a, b = a[lead:len(a) - tail], b[lead:len(b) - tail]
    if not a or not b:
        return weight, found
    if len(a) == len(b) == 1:
        w, inner = match_trees(a[0], b[0], told)
        return weight + w, [found, inner]
    if sum(x[3] for x in a) * sum(y[3] for y in b) > PAIRS:
        parts = [match_trees(a[i], b[j], told) for i, j in _best_pairs(a, b, told)]
        return weight + sum(w for w, _ in parts), [found, [f for _, f in parts]]
    above = [(0, None)] * (len(b) + 1)  # weight and a linked list of what is matched so far
    for x in a:
        row, last, leaf = [(0, None)], (0, None), not x[2]
        for j, y in enumerate(b):
            best = above[j + 1] if above[j + 1][0] >= last[0] else last
            if x[0] == y[0]:
                if leaf and not y[2]:
                    w, inner = (_whole(x, told), [x[1]]) if x[4] == y[4] else (1, None)
                else:
                    w, inner = match_trees(x, y, told)
                if above[j][0] + w > best[0]:
                    best = above[j][0] + w, ((inner, above[j][1]) if inner else above[j][1])
            row.append(best)
            last = best
        above = row
    size, chain = above[-1]
    while chain:
        found = [found, chain[0]]
        chain = chain[1]
    return weight + size, found


class _Levels:
    """A run of siblings by depth: each level's nodes in order as arrays, so that a tree is weighed against all nodes of a level at once."""

    def __init__(self, run: list[tuple], told: int):
        self.told = told
        self.levels: list[tuple] = []
        while run:
            kids = [k for y in run for k in y[2]]
            counts = np.array([len(y[2]) for y in run])
            labels: dict[str, list[int]] = {}
            for j, y in enumerate(run):
                labels.setdefault(y[0], []).append(j)
            ends = np.cumsum(counts)
            full = counts > 0
            self.levels.append((
                {label: np.array(at) for label, at in labels.items()}, np.array([hash(y[1]) if y[1] else 0 for y in run]), np.array([y[4] for y in run]),
                np.array([_whole(y, told) for y in run]), full, (ends - counts)[full], ends[full] - 1, np.repeat(np.arange(len(run)), counts) * (1 << 40)))
            run = kids

    def weights(self, x: tuple, depth: int = 0) -> np.ndarray | None:
        """The weight of tree ``x`` with each node of the level; None where none has its label."""
        labels, texts, hashes, whole, full, first, last, apart = self.levels[depth]
        at = labels.get(x[0])
        if at is None:
            return None
        out = np.zeros(len(texts), np.int64)
        out[at] = 1 + self.told * (texts[at] == hash(x[1])) if x[1] else 1
        if x[2] and len(apart):
            above = apart.copy()  # a multiple of 2 ** 40 for each run of siblings keeps running maxima within it
            for k in x[2]:
                w = self.weights(k, depth + 1)
                if w is not None:
                    above = _next_row(above, w, first, apart)
            inner = np.zeros(len(texts), np.int64)
            inner[full] = above[last] - apart[last]
            out[at] += inner[at]
        same = hashes == x[4]
        if same.any():
            out[same] = whole[same]
        return out


def _next_row(above: np.ndarray, w: np.ndarray, first: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The next row of the table of best weights, for runs of siblings side by side that begin at ``first``."""
    taken = np.empty_like(above)
    taken[1:] = above[:-1]
    taken[first] = apart[first]
    taken += w
    np.maximum(taken, above, out=taken)
    return np.maximum.accumulate(taken, out=taken)


def _best_pairs(a: list[tuple], b: list[tuple], told: int) -> list[tuple[int, int]]:
    """Indices of the pairs of the best order-keeping match of two runs of siblings of any length, with the table's rows in arrays.

    Rows are kept at the starts of blocks and made again within the block that is traced back,
    so memory grows with the root of the table's height.
    """
    right, n = _Levels(b, told), len(b)
    first, apart = np.zeros(1, np.int64), np.zeros(n, np.int64)
    step = max(1, ROWS_CELLS // n, round(len(a) ** 0.5))

    def rows(above: np.ndarray, part: list[tuple]) -> list[np.ndarray]:
        out = [above]
        for x in part:
            w = right.weights(x)
            out.append(out[-1] if w is None else _next_row(out[-1], w, first, apart))
        return out

    starts, block = [apart], []
    for s in range(0, len(a), step):
        block = rows(starts[-1], a[s:s + step])
        starts.append(block[-1])
    out, j = [], n - 1
    for s in reversed(range(0, len(a), step)):
        if s + step < len(a):
            block = rows(starts[s // step], a[s:s + step])
        i = len(block) - 1
        while i and j >= 0:
            here = block[i][j]
            if block[i - 1][j] == here:
                i -= 1
            elif j and block[i][j - 1] == here:
                j -= 1
            else:
                out.append((s + i - 1, j))
                i, j = i - 1, j - 1
    return out[::-1]


def equal_texts(found: list) -> set[str]:
    """The keys in what match_trees found: keys, whole trees, and lists of them."""
    out, left = set(), [found]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.add(x)
        elif isinstance(x, tuple):
            out.add(x[1])
            left += x[2]
        else:
            left += x
    return out - {""}


def extract(source: str | None, template: frozenset[str] | None = None) -> str:
    """The main text: blocks in page order joined by newlines, without blocks that are template; None is no wrapper."""
    return "\n".join(Page(source).content(template)) if source else ""


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """host and template for hosts with enough pages: "" or FEW, the keys of constant texts, "/" with slots that take turns, and "~" with the places of marked elements that stay.

    The reference is the page whose hashed id is smallest, of those of ordinary length; the
    counts cover every page, and exact copies of a page count once.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    hosted = pages.select(host_of(F.col("url")).alias("host"), "page_id", "html").filter((F.col("host") != "") & F.col("html").isNotNull())
    order = F.struct((F.length("html") > 100_000).alias("long"), F.xxhash64("page_id", "html").alias("h"))
    chosen = hosted.groupBy("host").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_PAGES)
    chosen = stage(chosen.select("host", F.col("o.h").alias("h")), "reference-ids")
    small = chosen.limit(100_001).count() <= 100_000
    refs = hosted.withColumn("h", F.xxhash64("page_id", "html")).join(F.broadcast(chosen) if small else chosen, ["host", "h"]).dropDuplicates(["host"])

    def fold(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([json.dumps(Page(x.as_py()).folded()) for x in batch.column(batch.schema.get_field_index("html"))], pa.string())]

    folded = stage(map_texts(refs.select("host", "html"), fold, [T.StructField("ref", T.StringType())], keep=["host"]), "references")
    size = folded.agg(F.coalesce(F.sum(F.length("ref")), F.lit(0))).first()[0]
    paired = hosted.select("host", "html").join(F.broadcast(folded) if size <= BROADCAST_BYTES else folded, "host")

    def align(batches):
        held: dict[str, list] = {}
        for batch in batches:
            out = []
            for host, source, ref in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "ref")), strict=True):
                if ref not in held:
                    if len(held) > 2000:
                        held.clear()
                    held[ref] = sealed(json.loads(ref))
                page, digest = Page(source), xxhash.xxh3_64_intdigest(source) >> 1
                same = equal_texts(match_trees(sealed(page.folded()), held[ref], TOLD)[1])
                out.append((host, "", digest))
                out += [(host, key, digest) for key in same]
                varying = [b for b in page.blocks if page.key(b[0], page.texts[b[0]]) not in same] if len(page.marks) > 1 else []
                if varying:  # not the reference itself, which varies nowhere
                    out += [(host, f"^{place}", digest) for _, place, _ in page.marks[1:]]
                    out += [(host, f"~{page.marks[k][1]}", digest) for k in page.holders(varying)]
                if any(b[2] for b in page.blocks):
                    out.append((host, "@", digest))
                out += {(host, page.slot(node) + f" {xxhash.xxh3_64_intdigest(text):x}", digest) for node, text, main, _ in page.blocks if not main}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "key", "digest"])

    same = paired.mapInArrow(align, "host string, key string, digest long").distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    same = stage(same, "constants")
    unstage(chosen, folded)
    total = same.filter(F.col("key") == "").select("host", F.col("n").alias("total"))
    place = F.substring("key", 2, 20)
    having = same.filter(F.col("key").startswith("^")).select("host", F.concat(F.lit("~"), place).alias("key"), F.col("n").alias("having"))
    mark = F.col("key").startswith("~")
    many = F.col("total") >= MANY_PAGES
    stays = F.when(mark, many & (F.col("n") > MOST * F.col("having"))).otherwise(F.col("n") >= F.when(many, CONSTANT_SHARE * F.col("total")).otherwise(F.col("total")))
    slot = F.col("key").startswith("/")
    beside = same.filter(F.col("key") == "@").select("host", F.col("n").alias("articles"))
    share = F.when(F.coalesce("articles", F.lit(0)) > MOST * F.col("total"), TURNS_BESIDE).otherwise(TURNS)
    turns = same.filter(slot).groupBy("host", F.substring_index("key", " ", 1).alias("key")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("places")).join(total, "host").join(beside, "host", "left").filter(
        many & (F.col("places") >= MANY_PAGES) & (F.col("texts") <= share * F.col("places"))).select("host", "key")
    rated = same.filter(~F.col("key").startswith("^") & ~slot & (F.col("key") != "@")).join(total, "host").filter(F.col("total") >= LEAST_PAGES).join(having, ["host", "key"], "left")
    constant = rated.filter(stays).withColumn("key", F.when((F.col("key") == "") & ~many, F.lit(FEW)).otherwise(F.col("key")))
    return constant.select("host", "key").unionByName(turns).groupBy("host").agg(F.collect_list("key").alias("template"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and wrapped of every page; wrapped tells that the wrapper of many pages decided.

    Null and empty html has empty text; pages without a host have no wrapper; repeated rows
    are each extracted; of pages that tie as the reference of a host any one is as good, since
    they are equal; an empty table gives an empty one; a page of any length is read whole, its
    tree compared to depth 64; other columns are ignored, whatever their names.
    """
    wrappers = settle(lambda: induce_wrappers(pages), "wrappers")
    small = wrappers.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0] <= BROADCAST_BYTES // 32
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = hosted.join(F.broadcast(wrappers) if small else wrappers, "host", "left").select("page_id", "url", "html", "template")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sources, templates = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("html", "template"))
        texts = [extract(s, None if t is None else frozenset(t)) for s, t in zip(sources, templates, strict=True)]
        wrapped = [t is not None and FEW not in t for t in templates]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(wrapped, pa.bool_())]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("wrapped", T.BooleanType())]
    return map_texts(joined, run, fields, keep=["page_id", "url"])
