"""Main text of web pages by wrapper induction.

The trees of a host's pages are aligned by simple tree matching (equal elements, order kept, most
pairs). A few pages give the outline of the host's template; all its pages are then aligned to it, and
for each slot of the outline is counted how much text it brings and on how many pages it is the same.
Slots that stay constant, or that serve navigation, are template; the slot that holds most of what
varies is the content. A page that does not fit its host's outline is judged by its own tree.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrywell.llm.html_tree import HOLDERS, Node, blocks, parse
from ferrywell.llm.staging import staged

#: Pages of a host that give its outline; the counts over it come from all pages.
REFERENCES = 8
#: Up to this many bytes the outlines of all hosts are sent to every executor, beyond it pages meet them in a join.
BROADCAST_BYTES = 32 << 20
#: Into how many parts a host with over a thousandth of all pages is dealt in that join.
SALTS = 64
SAME, VARYING, FEW, MOST = 0.9, 0.5, 5, 0.6


class Slot:
    """A place of the template, with what the aligned pages bring there."""

    __slots__ = ("key", "tag", "aside", "main", "text", "kids", "pages", "own", "links", "same")

    def __init__(self, key: str, tag: str, aside: bool, main: bool, text: int):
        self.key, self.tag, self.aside, self.main, self.text = key, tag, aside, main, text
        self.kids: list[Slot] = []
        self.pages = self.own = self.links = self.same = 0

    def below(self) -> list[Slot]:
        """This slot and all below it, parents first."""
        found = [self]
        for slot in found:
            found += slot.kids
        return found


def _is_slot(node: Node) -> bool:
    return node.tag in HOLDERS or node.key != node.tag or node.aside


def slot_nodes(node: Node) -> list[Node]:
    """The nearest elements below that are places of the template; plain prose belongs to its holder."""
    found = []
    for kid in node.nodes:
        found += [kid] if _is_slot(kid) else slot_nodes(kid)
    return found


def own_text(node: Node) -> tuple[int, int]:
    """Characters outside and inside of links, with those of the plain prose below."""
    own, links = node.own, node.links
    for kid in node.nodes:
        if not _is_slot(kid):
            more = own_text(kid)
            own, links = own + more[0], links + more[1]
    return own, links


def fingerprint(node: Node) -> int:
    return zlib.crc32("\n".join(blocks(node, set())).encode("utf-8", "surrogatepass"))


def _groups(nodes: list[Node]) -> list[list[Node]]:
    """Neighbours of one kind repeat one slot."""
    found: list[list[Node]] = []
    for node in nodes:
        if found and found[-1][0].key == node.key:
            found[-1].append(node)
        else:
            found.append([node])
    return found


class _Matching:
    """Simple tree matching of slots and elements; each pair is weighed once."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def weight(self, slot: Slot, node: Node) -> int:
        if slot.key != node.key:
            return 0
        pair = id(slot), id(node)
        if pair not in self.known:
            self.known[pair] = 1 + self.table(slot.kids, _groups(slot_nodes(node)))[-1][-1]
        return self.known[pair]

    def table(self, slots: list[Slot], groups: list[list[Node]]) -> list[list[int]]:
        rows = [[0] * (len(groups) + 1)]
        for slot in slots:
            above, row = rows[-1], [0]
            for j, group in enumerate(groups):
                best = max(above[j + 1], row[j])
                if slot.key == group[0].key:
                    best = max(best, above[j] + self.weight(slot, group[0]))
                row.append(best)
            rows.append(row)
        return rows

    def pairs(self, slots: list[Slot], groups: list[list[Node]]) -> list[tuple[int, int]]:
        """Positions of matched slots and groups, in order."""
        rows, i, j, found = self.table(slots, groups), len(slots), len(groups), []
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        return found[::-1]


def extend(slot: Slot, node: Node, matching: _Matching | None = None) -> None:
    """Add to the outline what a further page has beyond it."""
    matching = matching or _Matching()
    groups = _groups(slot_nodes(node))
    matched = dict((j, i) for i, j in matching.pairs(slot.kids, groups))
    kids, taken = [], 0
    for j, group in enumerate(groups):
        first = group[0]
        if j in matched:
            kids += slot.kids[taken:matched[j] + 1]
            taken = matched[j] + 1
        else:
            kids.append(Slot(first.key, first.tag, first.aside, first.main, fingerprint(first)))
        for each in group:
            extend(kids[-1], each)
    slot.kids = kids + slot.kids[taken:]


def outline(trees: list[Node]) -> Slot:
    root = Slot("body", "body", False, False, 0)
    for tree in trees:
        extend(root, tree)
    return root


def aligned(root: Slot, tree: Node) -> list[tuple[Slot, list[Node]]]:
    """Which elements of the page stand at which slot."""
    matching, found, work = _Matching(), {}, [(root, tree)]
    for slot, node in work:
        found.setdefault(id(slot), (slot, []))[1].append(node)
        groups = _groups(slot_nodes(node))
        for i, j in matching.pairs(slot.kids, groups):
            work += [(slot.kids[i], each) for each in groups[j]]
    return list(found.values())


def count(slot: Slot, nodes: list[Node]) -> tuple[int, int, int]:
    """Own and linked characters at a slot on one page, and whether its text is the outline's."""
    texts = [own_text(node) for node in nodes]
    return sum(t[0] for t in texts), sum(t[1] for t in texts), int(len(nodes) == 1 and fingerprint(nodes[0]) == slot.text)


def judged(root: Slot) -> tuple[set[int], set[int]]:
    """The slots that are content, and those below them that are not (as ids of slots)."""
    inside: dict[int, int] = {}

    def weigh(slot: Slot) -> int:
        if slot.aside:
            return inside.setdefault(id(slot), 0)
        inside[id(slot)] = slot.own + sum(map(weigh, slot.kids))
        return inside[id(slot)]

    weigh(root)

    def marked(slot: Slot, tags: tuple[str, ...]) -> list[Slot]:
        if slot.aside:
            return []
        if slot.main and slot.tag in tags or slot.main and slot.tag not in ("article", "main"):
            return [slot] if inside[id(slot)] else []
        return [m for kid in slot.kids for m in marked(kid, tags)]

    content = marked(root, ("article",)) or marked(root, ("main",))
    named = bool(content)
    if named:
        largest = max(content, key=lambda slot: inside[id(slot)])
        if inside[id(largest)] >= MOST * sum(inside[id(slot)] for slot in content):
            content = [largest]
    else:
        chosen = root
        while kid := max((k for k in chosen.kids if k.tag not in ("ul", "ol", "dl", "table", "header")), key=lambda k: inside[id(k)], default=None):
            if kid.key in [k.key for k in chosen.kids if k is not kid] or inside[id(kid)] < MOST * inside[id(chosen)] or not inside[id(kid)]:
                break
            chosen = kid
        content = [chosen]
    dropped: set[int] = set()
    for top in content:
        varies = top.same < VARYING * top.pages
        for slot in top.below()[1:]:
            constant = varies and slot.pages >= FEW and slot.same >= SAME * slot.pages
            linked = not named and slot.links > slot.own and slot.tag not in ("tr", "td", "th", "tbody", "thead")
            if slot.aside or constant or linked or (not named and slot.tag == "header" and not any(s.main for s in slot.below())):
                dropped.add(id(slot))
    return {id(slot) for slot in content}, dropped


def _asides(node: Node) -> set[int]:
    found, work = set(), [node]
    for each in work:
        if each.aside:
            found.add(id(each))
        else:
            work += each.nodes
    return found


def _by(root: Slot, verdict: tuple[set[int], set[int]], tree: Node) -> list[str]:
    content, template = verdict
    tops, dropped = [], _asides(tree)
    for slot, nodes in aligned(root, tree):
        if id(slot) in content:
            tops += nodes
        if id(slot) in template:
            dropped |= {id(node) for node in nodes}
    return [text for top in tops for text in blocks(top, dropped)]


def by_itself(tree: Node) -> list[str]:
    """The blocks of a page without others to compare it with."""
    root = outline([tree])
    for slot, nodes in aligned(root, tree):
        slot.own, slot.links, _ = count(slot, nodes)
        slot.pages = 1
    return _by(root, judged(root), tree)


def to_json(root: Slot) -> str:
    """Slots in the order of ``below``, each with its parent's number."""
    order = root.below()
    number = {id(slot): i for i, slot in enumerate(order)}
    parent = {id(kid): number[id(slot)] for slot in order for kid in slot.kids}
    return json.dumps([[parent.get(id(s), -1), s.key, s.tag, s.aside, s.main, s.text] for s in order])


def from_json(text: str) -> Slot:
    slots: list[Slot] = []
    for parent, *rest in json.loads(text):
        slots.append(Slot(*rest))
        if parent >= 0:
            slots[parent].kids.append(slots[-1])
    return slots[0]


@lru_cache(maxsize=256)
def _outline_of(text: str) -> tuple[Slot, dict[int, int]]:
    root = from_json(text)
    return root, {id(slot): i for i, slot in enumerate(root.below())}


@lru_cache(maxsize=256)
def _wrapper_of(text: str, counts: str) -> tuple[Slot, tuple[set[int], set[int]]]:
    root = from_json(text)
    order = root.below()
    for number, pages, own, links, same in json.loads(counts):
        slot = order[number]
        slot.pages, slot.own, slot.links, slot.same = pages, own, links, same
    return root, judged(root)


def main_text(html: str, template: str | None, counts: str | None) -> str:
    tree = parse(html)
    found = _by(*_wrapper_of(template, counts), tree) if template and counts else []
    return "\n\n".join(found or by_itself(tree))


def hosted(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), host in small letters (empty if there is none) and a hash of the html."""
    address = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumns({
            "host": F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), address, 1), "h": F.xxhash64("html")})


def _references(known: DataFrame) -> DataFrame:
    """(host, h) of the distinct pages with the least hashes; a host sends about three times what it keeps."""
    distinct = known.where("host != ''").select("host", "h").distinct()
    sizes = distinct.groupBy("host").agg(F.count("*").alias("n"))
    place = F.xxhash64("h").cast("double") / 2.0**64 + 0.5
    near = distinct.join(sizes, "host").where(place * F.col("n") <= 3 * REFERENCES + 8)
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.xxhash64("h"), "h"))
    return near.withColumn("rank", rank).where(F.col("rank") <= REFERENCES).select("host", "h", "rank")


def _attached(known: DataFrame, small: DataFrame, keys: list[str], broadcast_bytes: int) -> DataFrame:
    """All pages with what belongs to them: sent everywhere while that is small, else met in a join that deals out hot hosts."""
    size = F.sum(sum((F.length(F.col(c).cast("string")) for c in small.columns), F.lit(32 * len(small.columns))))
    if (small.agg(size).first()[0] or 0) <= broadcast_bytes:
        return known.join(F.broadcast(small), keys, "left")
    total = known.count()
    hot = known.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") * 1000 > total).select("host")
    hot = staged(hot, "html-hot").select("host", F.lit(True).alias("hot"))  # a thousand rows at most
    dealt = known.join(F.broadcast(hot), "host", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.col("h"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = small.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(copies)).drop("hot")
    return dealt.join(spread, [*keys, "salt"], "left").drop("salt")


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [to_json(outline([parse(page["html"]) for page in pages])) for pages in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["host", "template"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], list[int]] = {}

    def rows() -> pa.RecordBatch:
        keys, values = list(sums), list(sums.values())
        columns = [[k[0] for k in keys], [k[1] for k in keys], *([v[i] for v in values] for i in range(4))]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["host", "slot", "pages", "own", "links", "same"])

    for batch in batches:
        for host, html, template in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            root, number = _outline_of(template)
            for slot, nodes in aligned(root, parse(html.as_py())):
                held = sums.setdefault((host, number[id(slot)]), [0] * 4)
                for i, value in enumerate((1, *count(slot, nodes))):
                    held[i] += value
        if len(sums) > 100_000:
            yield rows()
            sums.clear()
    yield rows()


def induced(known: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """host, template, counts: the wrapper of every host, its counts taken over all its pages."""
    chosen = staged(_references(known), "html-references")
    examples = _attached(known.select("host", "h", "html"), chosen, ["host", "h"], broadcast_bytes).where("rank is not null")
    examples = examples.groupBy("host", "rank").agg(F.min("html").alias("html"))
    together = examples.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "html"))).alias("pages"))
    templates = staged(together.mapInArrow(_outlines, "host string, template string"), "html-outlines")
    pages = _attached(known.select("host", "h", "html"), templates, ["host"], broadcast_bytes).where("template is not null")
    counts = pages.select("host", "html", "template").mapInArrow(
        _counts, "host string, slot bigint, pages bigint, own bigint, links bigint, same bigint")
    sums = counts.groupBy("host", "slot").agg(*(F.sum(c).alias(c) for c in ("pages", "own", "links", "same")))
    listed = sums.groupBy("host").agg(F.array_sort(F.collect_list(F.array("slot", "pages", "own", "links", "same"))).alias("counts"))
    return staged(templates.join(listed, "host").select("host", "template", F.to_json("counts").alias("counts")), "html-wrappers")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(h.as_py(), t, c) for h, t, c in zip(part.column(2), *(part.column(i).to_pylist() for i in (3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row, its blocks joined by an empty line.

    Null and empty pages, and pages without text, give an empty text. Pages without a host, alone on
    theirs, or unlike it are judged by their own tree. Repeated rows each get the result, and copies of a page do
    not make its text a template, since a slot counts as constant only where the content around it
    varies. Long pages are handled as a whole. An empty table gives no rows; other columns are not read.
    """
    known = hosted(pages)
    wrappers = induced(known, broadcast_bytes)
    ready = _attached(known, wrappers, ["host"], broadcast_bytes)
    return ready.select("page_id", "url", "html", "template", "counts").mapInArrow(
        _extracted, "page_id bigint, url string, text string, n_chars bigint")
